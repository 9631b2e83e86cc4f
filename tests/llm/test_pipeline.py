"""The pipeline's stages against brute force on a small fixture, each on its own input."""

import corpus_pipeline as cp
from tabsmith.llm import toxicity
from tabsmith.llm.shared import stored

from .conftest import DOCS, words, write
from .test_duplicates import _components, _kept
from .test_models import brute_spans


def _fixture(spark, path):
    rows = [(i, words(i, 60) + f" row {i}.", "en", f"s{i % 3}", 0) for i in range(120)]
    rows += [(200 + i, words(i, 60) + f" row {i}. You grubbling w{i}!", "en", "s0", 0) for i in range(60, 100)]
    rows += [(300, rows[0][1], "en", "s1", 0), (301, rows[1][1] + " end", "en", "s1", 0)]
    rows += [(400 + i, words(700, 55) + " " + words(800 + i, 80), "en", "s2", 0) for i in range(5)]
    rows += [(500, "Write to jane.roe@mail.example.com or 10.1.2.3 today", "en", "s0", 0), (501, None, None, None, None), (502, "", "", "", 0), (None, words(900, 30), "en", "s0", 0)]
    write(spark.createDataFrame(rows, DOCS).repartition(3), path, "documents")
    labels = [(r[0], 1, int("grubbling" in r[1])) for r in rows[:160]]
    write(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), path, "labels")
    return rows


def test_stages(spark, tmp_path):
    rows = _fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(cp.STAGES)
    got = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    docs = stored(stages["toxicity"](spark, docs, str(tmp_path)))
    assert docs.columns == cp.COLUMNS and got(docs) == sorted(((i, t) for i, t, *_ in rows if "grubbling" not in (t or "")), key=str)

    before = [tuple(r) for r in docs.collect()]
    docs = stored(stages["near_duplicates"](spark, docs, str(tmp_path)))
    keep = {i for i, _, c in _components(before) if i == c}
    assert got(docs) == sorted(((i, t) for i, t, *_ in before if i in keep), key=str)

    before = [tuple(r) for r in docs.collect()]
    docs = stored(stages["repeated_passages"](spark, docs, str(tmp_path)))
    cut = {i: n for i, _, n, _ in _kept(before)}
    assert sum(n > 0 for n in cut.values()) == 4
    after = dict(got(docs))
    assert all(after[i] == t for i, t, *_ in before if not cut[i])
    assert all(len(after[i].split()) == len(t.split()) - cut[i] for i, t, *_ in before if cut[i])

    before = dict(got(docs))
    docs = stored(stages["personal_data"](spark, docs, str(tmp_path)))
    after = dict(got(docs))
    assert after[500] == "Write to <EMAIL> or <IP> today" and after[501] is None
    assert all(after[i] == t for i, t in before.items() if not brute_spans(t or ""))

    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in packed), key=str) == sorted(((i, len((t or "").split())) for i, t in got(docs)), key=str)
    whole = sorted((tuple(r[c] for c in ("doc_id", "piece", "n_tokens")) for r in cp.run(spark, str(tmp_path)).collect()), key=str)
    assert whole == sorted((tuple(r[c] for c in ("doc_id", "piece", "n_tokens")) for r in packed), key=str)
    assert toxicity.THRESHOLD == 0.3


def test_pipeline_of_an_empty_table(spark, no_docs, tmp_path):
    write(no_docs, tmp_path, "documents")
    write(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert cp.run(spark, str(tmp_path)).count() == 0
