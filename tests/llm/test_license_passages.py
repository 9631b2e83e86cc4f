import textwrap

from tabsmith.llm import licenses
from tabsmith.llm.license_texts import TEXTS

from .conftest import DOCS, words


def brute(text, templates, least=licenses.LEAST):
    """Best dice of any run of words against each template, all runs tried."""
    w = licenses.re.findall("[a-z0-9]+", (text or "").lower())
    grams = [f"{a} {b}" for a, b in zip(w, w[1:])]
    out = {}
    for k, (_, t) in enumerate(templates):
        own = set(licenses._bigrams(t))
        most = int(len(own) * (2 - least) / least + 1e-9)
        for i in range(len(grams)):
            for j in range(i + 1, min(len(grams), i + most) + 1):
                run = set(grams[i:j])
                d = 2 * len(run & own) / (len(run) + len(own))
                if d >= least:
                    out[k] = max(out.get(k, 0), d)
    return out


def found_in(spark, texts, **kw):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    return {r["row"]["doc_id"]: r["found"] for r in licenses.passages(docs, **kw).collect()}


def test_wrapped_embedded_and_full_texts(spark):
    pad = words(1, 300)
    texts = [f"{pad}\n{textwrap.fill(t, 60)}\n{pad}" for _, t in TEXTS]  # wrapped inside a longer document
    texts += [f"{pad} {t} {pad}" for _, t in TEXTS]  # part of one long line
    texts += [f"{words(2, 9)} released under the MIT License. {words(3, 9)}", pad, None, "", "one"]
    found = found_in(spark, texts)
    for i, (name, t) in enumerate(TEXTS + TEXTS):
        n = len(licenses.re.findall("[a-z0-9]+", t.lower()))
        assert (found[i][0]["license"], found[i][0]["dice"], found[i][0]["start"]) == (name, 1.0, 300)
        # a run ends with its last new bigram, so repeats at the end of the text are left out
        assert any((f["license"], f["dice"], f["start"]) == (name, 1.0, 300) and n - 3 <= f["words"] <= n for f in found[i])
    at = 2 * len(TEXTS)
    assert [(f["license"], f["start"], f["words"]) for f in found[at]] == [("MIT", 9, 5)]
    assert all(found[at + k] == [] for k in range(1, 5))


def test_against_all_runs(spark):
    import random

    rnd = random.Random(3)
    templates = licenses.TEMPLATES[:5] + licenses.TEMPLATES[-1:]
    texts = []
    for _ in range(60):
        w = " ".join(rnd.choice(templates)[1] if rnd.random() < 0.6 else words(rnd.randint(0, 99), 3) for _ in range(3)).split()
        for _ in range(rnd.randint(0, 5)):
            w.insert(rnd.randrange(len(w)), rnd.choice(["x", "all rights", "license"]))
        texts.append(" ".join(w))
    texts.append("All rights reserved. " * 200)
    found = found_in(spark, texts, templates=tuple((str(k), t) for k, (_, t) in enumerate(templates)))
    for i, text in enumerate(texts):
        best = {}
        for f in found[i]:
            best[int(f["license"])] = max(best.get(int(f["license"]), 0), f["dice"])
        assert {k: round(v, 9) for k, v in best.items()} == {k: round(v, 9) for k, v in brute(text, templates).items()}, text
    assert len(found[60]) == 200
