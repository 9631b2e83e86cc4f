import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import bpe, neighbours, packing, url_filter
from tabsmith.llm.automaton import Lexicon, compile_words

from ..conftest import SF01
from .conftest import DOCS


def _brute(rows, k=10):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = []
    for q, x in rows:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in rows if i != q)[:k]
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return sorted(out)


def test_factor_one_is_exact_and_the_default_finds_nearly_all(spark):
    df = spark.read.parquet(f"{SF01}/embeddings.parquet")
    want = _brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    exact = sorted(tuple(r) for r in neighbours.nearest(df, F.col("id") % 100 == 0, relax=1.0).select("query_id", "rank", "vec_id", "score").collect())
    assert [r[:3] for r in exact] == [r[:3] for r in want] and np.allclose([r[3] for r in exact], [r[3] for r in want], atol=1e-12)
    got = {(r["query_id"], r["vec_id"]) for r in neighbours.op7_neighbours(spark, SF01).collect()}
    assert len(got & {(r[0], r[2]) for r in want}) >= 0.9 * len(want)


def test_vectors_that_take_no_part_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    rows += [(10 + i, [1.0, 0.0]) for i in range(30)] + [(10, [1.0, 0.0]), (90, [0.5, 0.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 100 == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(10 + i, 0.0) for i in range(10)]
    few = neighbours.nearest(spark.createDataFrame(rows[:1] + rows[-1:], "vec_id long, embedding array<float>"), F.col("id") % 100 == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in few] == [(90, 0.5)]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 100 == 0).count() == 0


def test_a_pruning_tree_is_exact_at_factor_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 2))
    x[500:900] = x[3]
    ids = rng.permutation(3000)
    tree = neighbours.VantageTree(ids, x, leaf=16)
    names, _ = tree.search(ids[:50], x[:50], 10, 1.0)
    for i in range(50):
        d = neighbours.distances(x[i][None], x)[0]
        d[i] = np.inf
        assert list(names[i]) == list(ids[np.lexsort((ids, d))[:10]])


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


def test_bpe_query_against_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    for r in bpe.op10_bpe(spark, SF01).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_on_odd_texts(library):
    codec = bpe.Codec.read(bpe.tokenizer_path())
    encoder = bpe.Encoder(codec, compile_words({b"abc": codec.merge(b"abc"), b"the": codec.merge(b"the")}))
    rnd = random.Random(1)
    parts = list("abcXYZ'sStTdD1239 .,!?<|>é\u0301\u0308ÅÅİIΣΑςﬁßДж日本語한글\u200b \x85\x1c\x1f\xa0\ufeff\t\n\r\x0b\x0c\u3000\u0130١²½🙂") + ["<|endoftext|>", "<|startoftext|>", "'ll", "'RE", "don't", "the abc"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(4000)] + ["x" * 20000, "", "ab" * 300]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(t.encode()), np.int32).tolist() == want
        assert b" ".join(map(codec.names.__getitem__, want)).decode() == library.decode(want, skip_special_tokens=False)
    bpe_memo = bpe.Recent(str, 3)
    assert [bpe_memo[i % 7] for i in range(50)] == [str(i % 7) for i in range(50)] and len(bpe_memo) <= 3 and len(bpe_memo.old) <= 3
    encoder.written.limit = 50
    n, listed, decoded = encoder.write(pa.array([*texts, None]))
    for t, k, a, b in zip([*texts, ""], n.to_pylist(), listed.to_pylist(), decoded.to_pylist()):
        want = library.encode(t, add_special_tokens=False).ids
        assert (k, a, b) == (len(want), " ".join(map(str, want)), library.decode(want, skip_special_tokens=False))


def test_merges_side_by_side():
    codec = bpe.Codec.read(bpe.tokenizer_path())
    rnd = random.Random(3)
    pieces = ["".join(rnd.choice("etaoinshrdlu'é日9") for _ in range(rnd.randint(1, 60))).encode() for _ in range(3000)] + [b"a" * n for n in range(1, 60)]
    assert codec.merge_all(pieces) == [codec.merge(p) for p in pieces] and codec.merge_all([]) == []


def test_decode_of_stored_ids(spark, library):
    codec = bpe.Codec.read(bpe.tokenizer_path())
    rows = [(1, "The café's 3 cats", "", "", 0), (2, None, "", "", 0), (3, "", "", "", 0), (4, "a " * 3000, "", "", 0)]
    df = spark.createDataFrame(rows, DOCS)
    lexicon = bpe.build_lexicon(df, codec)
    both = bpe.encode_written(df, codec, lexicon).collect()
    ids = {r["row"]["doc_id"]: r["ids"] for r in bpe.encode(df, codec, lexicon).collect()}
    assert {r["row"]["doc_id"]: r["listed"] for r in both} == {i: " ".join(map(str, x)) for i, x in ids.items()}
    again = bpe.decode(bpe.encode(df, codec, compile_words({})), codec).collect()
    want = {i: library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t, *_ in rows}
    assert {r["row"]["doc_id"]: r["decoded"] for r in both} == {r["row"]["doc_id"]: r["decoded"] for r in again} == want


def test_automaton():
    rnd = random.Random(2)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 7))).encode(): tuple(rnd.sample(range(99), rnd.randint(1, 3))) for _ in range(800)}
    lexicon = Lexicon(compile_words(words))
    assert len(lexicon) == len(words) and all(lexicon.find(w) == ids for w, ids in words.items())
    assert all(lexicon.find(w + b"x") is None for w in words) and (b"" in words) == (lexicon.find(b"") is not None)
    assert Lexicon(compile_words({})).find(b"a") is None
    some = [*words, *(w + b"x" for w in words), b"", b"zzz"]
    assert lexicon.find_all(some) == [lexicon.find(w) for w in some] and Lexicon(compile_words({})).find_all([b"a", b""]) == [None, None] and lexicon.find_all([]) == []
    shared = Lexicon(compile_words({a + b"ending": (1,) for a in (b"x", b"y", b"z")}))
    assert len(shared.final) == 8  # the ending's states are shared


def _check_packing(rows, lengths):
    seen = {}
    for r in sorted((r for r in rows if r["bin_id"] is not None), key=lambda r: (r["bin_id"], r["position"])):
        assert r["position"] == seen.get(r["bin_id"], 0) and r["position"] + r["n_tokens"] <= r["capacity"] and r["capacity"] in packing.SIZES
        seen[r["bin_id"]] = r["position"] + r["n_tokens"]
    assert sorted(sum(r["n_tokens"] for r in rows if r["id"] == i) for i in {r["id"] for r in rows}) == sorted(lengths)
    for r in rows:
        if r["bin_id"] is not None:
            assert packing.cost(r["capacity"]) == min(packing.cost(s) for s in packing.SIZES if s >= seen[r["bin_id"]])


def test_packing(spark):
    rnd = random.Random(4)
    lengths = [rnd.choice([0, 1, 17, 400, 700, 1500, 4096, 4097, 9000, rnd.randint(1, 6000)]) for _ in range(300)]
    df = spark.createDataFrame([(i, "a " * n, "", "", 0) for i, n in enumerate(lengths)], DOCS)
    _check_packing(packing.pack(df, shard_pieces=100).collect(), lengths)
    (none,) = packing.pack(spark.createDataFrame([(1, None, "", "", 0)], DOCS)).collect()
    assert none["n_tokens"] == 0 and none["bin_id"] is None


def test_best_fit_takes_the_least_room():
    bins, starts, final, _ = packing.pack_lengths([400, 300, 200, 100], (512,))
    assert bins == [0, 1, 1, 0] and starts == [0, 0, 300, 400] and final == [512, 512]
    assert packing.pack_best([4000, 90])[2] == [4096] and packing.pack_best([500])[2] == [512]


def test_urls(spark):
    rows = [
        (1, "https://A.B.net/x"), (2, "http://example.net/en/1?q"), (3, "http://www.Example.COM/de/"), (4, "http://notexample.com/de/"), (5, "ftp://x.org/fr/porn"),
        (6, "http://x.io/xxx/1"), (7, "http://x.io/xxxl/1"), (8, "http://x.io/casino-poker"), (9, "http://x.io/casino/casino"), (10, None), (11, "no scheme"), (12, ""),
        (13, "http://net?x://y.org/"), (14, "http://example.net#/en/"), (15, "a://b\nc.org/fr/x"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("HOST", F.lit(1)).withColumn("row", F.lit(2))
    got = {r["row"]["page_id"]: r for r in url_filter.judge_urls(df).collect()}
    assert {i: (r["host"], r["path"], r["rule"], r["verdict"]) for i, r in got.items()} == {
        1: ("a.b.net", "/x", "net/", "block"), 2: ("example.net", "/en/1", "example.net/en/", "allow"), 3: ("www.example.com", "/de/", "example.com/de/", "block"),
        4: ("notexample.com", "/de/", None, "allow"), 5: ("x.org", "/fr/porn", "org/fr/", "allow"), 6: ("x.io", "/xxx/1", None, "block"), 7: ("x.io", "/xxxl/1", None, "allow"),
        8: ("x.io", "/casino-poker", None, "block"), 9: ("x.io", "/casino/casino", None, "allow"), 10: ("", "", None, "allow"), 11: ("", "", None, "allow"), 12: ("", "", None, "allow"),
        13: ("net", "", None, "allow"), 14: ("example.net", "", None, "allow"), 15: ("b\nc.org", "/fr/x", "org/fr/", "allow"),
    }
    assert url_filter.judge_urls(df.limit(0)).count() == 0
