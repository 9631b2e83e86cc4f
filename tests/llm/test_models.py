import re
import zlib

import numpy as np

from tabsmith.llm import boosting, pii, toxicity

from ..conftest import SF01

SF1 = "/root/testdata/sf0.1"
from .conftest import DOCS


def test_toxicity_held_out(spark):
    out = toxicity_rows(spark)
    held = [r for r in out if r["held_out"]]
    toxic, clean = [r for r in held if r["toxic"]], [r for r in held if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.8 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)


def toxicity_rows(spark):
    labels = spark.read.parquet(f"{SF1}/labels.parquet")
    return toxicity.op3_toxicity(spark, SF1).join(labels, "doc_id").collect()


def test_noisy_or_finds_the_sentence(spark):
    clean = [f"The w{i} is a good w{i % 7}. It has w{i % 5} parts.\nAll fine here!" for i in range(200)]
    bad = [f"The w{i} is a good w{i % 7}. You are a grubbling, w{i}!\nAll fine here." for i in range(40)]
    model = toxicity.fit(clean + bad, [0] * 200 + [1] * 40)
    rows = [(1, "Such a good day. You grubbling! The end.", "", "", 0), (2, "Such a good day.", "", "", 0), (3, None, "", "", 0), (4, "", "", "", 0)]
    got = {r["row"]["doc_id"]: r for r in toxicity.score(spark.createDataFrame(rows, DOCS), model).collect()}
    assert got[1]["score"] > 0.5 > 0.3 > got[2]["score"] and got[3]["score"] == got[4]["score"] == 0
    (span,) = got[1]["sentences"]
    assert b"grubbling" in rows[0][1].encode()[span["start"] : span["start"] + span["length"]]
    assert toxicity.fit(["a b"], [0]).bias == -np.inf and toxicity.fit([], []).bias == -np.inf


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    model = boosting.fit(x[:3000], y[:3000])
    assert ((model.predict(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97
    assert boosting.fit(x[:10], np.zeros(10)).predict(x).max() < 0.5


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            good = (
                kind == 0
                or (kind == 1 and all(int(p) <= 255 for p in m.group().split(".")))
                or (kind == 2 and 12 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in double) % 10 == 0)
                or (kind == 3 and 9 <= len(d) <= 15)
            )
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_against_plain_patterns(spark):
    import random

    rnd = random.Random(5)
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "1.2.3.4", "256.1.1.1", "0001.02.3.255", "a@b.co", "@b.c", "x@y@z.w", "1.2.3.4.5.6.7.8", "日本+49-30-1234567", "é", ". "]
    texts = ["".join(rnd.choice("aZ9.@-+ ()1205%_é٣\n") for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += [rnd.choice(["", " ", "-"]).join(rnd.choice(parts) for _ in range(4)) for _ in range(3000)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF01}/documents.parquet").select("text").collect()]
    assert all(pii.base_spans(t) == brute_spans(t) for t in texts)
    assert pii.base_spans("9" * 200000 + "a" * 200000 + "@") == [] and pii.base_spans("") == []


def test_pii_query_keeps_base_spans(spark):
    out = {r["doc_id"]: r for r in pii.op6_pii(spark, SF01).collect()}
    for r in spark.read.parquet(f"{SF01}/documents.parquet").collect():
        base = brute_spans(r["text"])
        got = out[r["doc_id"]]
        assert [got[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in base) for i in range(4)]
        assert {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base} <= set(got["spans"].split(","))


def test_redaction():
    assert pii.redact_text("a x@y.z b 1.2.3.4", [(2, 0, 7, True), (4, 3, 6, False), (10, 1, 17, True)]) == "a <EMAIL> b <IP>"


def test_a_feature_counts_once_a_sentence(spark):
    """Scores against the model's own definition, sentence by sentence."""
    from tabsmith.llm.textkernel import Words, text_buffers
    import pyarrow as pa

    name = Words(*text_buffers(pa.array(["grubbling"]))).hashes()
    model = toxicity.Model(-5.0, name, np.ones(1))
    texts = ["grubbling " * n for n in (1, 3, 5, 8)] + ["grubbling a. grubbling b! c"]
    got = [r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("row.doc_id").collect()]
    p = 1 / (1 + np.exp(4.0))
    free = 1 / (1 + np.exp(-5.0))
    assert np.allclose(got[:4], p) and np.isclose(got[4], 1 - (1 - p) ** 2 * free)


class _Always:
    limits = [0.0] * 4

    def score(self, x):
        return (np.arange(len(x)) * 7919 % 1021).astype(np.int64)


def test_selection_against_plain_greedy_on_many_candidates():
    rng = np.random.default_rng(2)
    text = " ".join(str(rng.integers(10, 99999)) + rng.choice(["", "-", "/", "."]) + str(rng.integers(100, 99999)) for _ in range(3000))
    base = pii.base_spans(text)
    open_ = pii.addable(text, base)
    p, taken = _Always().score(np.zeros((len(open_), 1))), []
    for i in np.lexsort((np.arange(len(p)), -p)):
        a, k, b = open_[i]
        if not any(x < b and a < y for x, y, _ in taken):
            taken.append((a, b, k))
    assert len(open_) > 500 and sorted((a, k, b) for a, k, b, s in pii.spans_of(text, _Always()) if not s) == sorted((a, k, b) for a, b, k in taken)


def test_long_candidates_are_kept():
    ip = "0" * 300 + "1.2.3.999"
    assert any(b - a > 256 for a, _, b in pii.candidates(f"host {ip} end"))


def test_clashing_columns_of_models(spark):
    rows = [(1, "You grubbling! Mail a.b@c.example.org", 7, 8, 9), (2, None, 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, score int, spans int")
    out = toxicity.score(df, toxicity.fit(["a b. c", "d grubbling"], [0, 1]))
    assert out.select("row.row", "row.score", "row.spans").distinct().collect() == [(7, 8, 9)]
    found = pii.find(df, pii.train(df), redact=True)
    assert found.select("row.row", "row.score", "row.spans").distinct().collect() == [(7, 8, 9)] and found.where("redacted LIKE '%<EMAIL>%'").count() == 1
