import hashlib
import random

import numpy as np
import pyarrow as pa

from tabsmith.llm import jaccard_join
from tabsmith.llm.jaccard_join import jaccard_groups, one_of_each
from tabsmith.llm.substring_dedup import remove_repeats

from .conftest import DOCS, edge_rows, words


def _shingles(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not w:
        return set()
    return {b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def _components(rows):
    sets = [(i, _shingles(t)) for i, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if sets[a][0] is not None and sets[b][0] is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((i, len(s), None if i is None else least[find(a)]) for a, (i, s) in enumerate(sets)), key=str)


def _near_copies(seed):
    """Groups of near copies at all distances around the limit, chains of them, a shared passage, and short texts."""
    rnd = random.Random(seed)
    rows, i = [], 0
    shared = words(99, 60)
    for size in (1, 3, 5, 6, 8, 12, 30, 70, 150, 400, 1200):
        base = words(size, size).split()
        for _ in range(8):
            text = list(base)
            for _ in range(rnd.randint(0, max(1, size // 20))):
                text[rnd.randrange(len(text))] = f"z{rnd.randrange(10**6)}"
            if rnd.random() < 0.3:
                text = text[: max(1, int(size * rnd.uniform(0.7, 1)))]
            if rnd.random() < 0.3:
                text += words(rnd.randrange(10**6), max(1, size // 8)).split()
            rows.append((i, " ".join(text), "en", "s", 0))
            i += 1
            base = text if rnd.random() < 0.5 else base
    rows += [(i + k, shared + " " + words(1000 + k, 20 + 10 * k), "en", "s", 0) for k in range(12)]
    rnd.shuffle(rows)
    return rows


def test_links_against_brute_force(spark):
    for seed in (1, 2):
        rows = _near_copies(seed)
        got = jaccard_groups(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
        assert sorted((tuple(r) for r in got), key=str) == _components(rows)


def test_links_of_edge_rows(spark, edge_docs):
    got = jaccard_groups(edge_docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == _components([tuple(r) for r in edge_docs.collect()])


def test_clashing_columns(spark, edge_docs):
    df = edge_docs.withColumn("ID", edge_docs.lang).withColumn("class", edge_docs.lang).withColumn("n_words", edge_docs.lang)
    assert jaccard_groups(df).count() == df.count()
    assert remove_repeats(df).count() == df.count()


def _kept(rows, k=13):
    first = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        cut = set()
        for p in range(len(w) - k + 1):
            if i is not None and first[tuple(w[p : p + k])] < i:
                cut.update(range(p, p + k))
        out.append((i, len(w), len(cut), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in cut)).hexdigest()))
    return sorted(out, key=str)


def _digest(df):
    return sorted(((r["row"]["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in df.collect()), key=str)


def test_repeats_against_brute_force(spark, edge_docs):
    assert _digest(remove_repeats(edge_docs)) == _kept([tuple(r) for r in edge_docs.collect()])
    rnd = random.Random(3)
    passages = [words(500 + k, rnd.randint(5, 40)) for k in range(20)]
    rows = [(rnd.randrange(60), " ".join(rnd.choice([*passages, words(rnd.randrange(10**6), 9)]) for _ in range(rnd.randint(0, 14))), "en", "s", 0) for _ in range(80)]
    assert _digest(remove_repeats(spark.createDataFrame(rows, DOCS).repartition(7))) == _kept(rows)


def test_factors_name_an_earlier_document(spark):
    a, b = words(1, 40), words(2, 40)
    rows = [(1, a, "", "", 0), (2, b, "", "", 0), (3, a + " " + b, "", "", 0)]
    got = {r["row"]["doc_id"]: r for r in remove_repeats(spark.createDataFrame(rows, DOCS), keep_whole=True).collect()}
    assert [(s["start"], s["length"], s["ref"]) for s in got[3]["spans"]] == [(0, 40, 1), (40, 40, 2)]
    assert got[3]["kept"] == "" and got[1]["kept"] == a


def _thue_morse(flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(1024))


def test_words_that_a_polynomial_cannot_tell_apart(spark):
    one, two = _thue_morse(0), _thue_morse(1)
    rows = [(1, " ".join([one] * 13), "", "", 0), (2, " ".join([two] * 13), "", "", 0), (3, " ".join([one] * 13), "", "", 0)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(tuple(r) for r in jaccard_groups(df).collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
    assert {r["row"]["doc_id"]: r["n_removed"] for r in remove_repeats(df).collect()} == {1: 0, 2: 0, 3: 13}


def test_words_that_share_a_hash_are_told_apart():
    from tabsmith.llm import jaccard_join
    from tabsmith.llm.textkernel import Words, text_buffers

    class Same(Words):
        def hashes(self):
            return super().hashes() & np.uint64(7)

    one, two = (Same(*text_buffers(pa.array([words(s, 40)]))) for s in (1, 2))
    codes = jaccard_join.exact_codes(one, two)
    assert len(set(codes[0].tolist()) | set(codes[1].tolist())) == len(set(words(1, 40).split()) | set(words(2, 40).split()))
    assert jaccard_join.exact_codes(*(Words(*text_buffers(pa.array([words(s, 40)]))) for s in (1, 2))) is None


def test_slices_of_equal_ends(spark):
    """Two partitions that agree on their first and last rows and on all counts."""
    a, x, b = words(1, 30), words(2, 30), words(3, 30)
    y = " ".join(x.split()[:20] + words(4, 10).split())
    parts = [[(5, a), (1, x), (9, b)], [(5, a), (7, y), (9, b)]]
    rdd = spark.sparkContext.parallelize(parts, 2).flatMap(lambda p: p)
    df = spark.createDataFrame(rdd, "doc_id long, text string")
    got = sorted((r["row"]["doc_id"], r["n_removed"]) for r in remove_repeats(df).collect())
    assert got == [(1, 0), (5, 0), (5, 0), (7, 20), (9, 0), (9, 0)]


def test_a_table_united_with_itself(spark):
    rnd = random.Random(5)
    passages = [words(600 + k, rnd.randint(13, 40)) for k in range(12)]
    rows = [(i, " ".join(rnd.choice([*passages, words(rnd.randrange(10**6), 9)]) for _ in range(6)), "en", "s", 0) for i in range(40)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for both in (df.union(df), df.union(df.orderBy("text")).repartition(4)):
        out = remove_repeats(both)
        assert _digest(out) == _kept(rows + rows)
        spans = {r["row"]["doc_id"]: sorted((s["start"], s["length"]) for s in r["spans"]) for r in out.collect()}
        assert all(len(set(v)) == len(v) for v in spans.values())


def test_one_of_each(spark):
    k, z, m = words(1, 40), words(2, 40), words(3, 40)
    rows = [(3, k, "en", "a", 1), (5, k, "en", "a", 1), (5, z, "en", "a", 1), (6, m, "en", "a", 1), (6, m, "en", "a", 1), (None, k, "en", "a", 1), (None, None, None, None, None), (8, "", "", "", 0), (8, "", "", "", 0), (9, m + " end", "en", "b", 2), (2, None, "de", "c", 3)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("source", "label").withColumnRenamed("lang", "fp")
    got = sorted((tuple(r) for r in one_of_each(df).collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[3], *rows[5:9], rows[10]], key=str)
    assert one_of_each(df.limit(0)).count() == 0


def test_exact_words_are_the_hashed_words():
    from tabsmith.llm.textkernel import Words, text_buffers

    texts = ["", " a  b\t\x0bc ", "x", None, "\n", "é ß 日 \x1c\x1f z", "long " * 50]
    w = Words(*text_buffers(pa.array(texts)))
    assert [x.encode() for x in w.exact().to_pylist()] == [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends)]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_shuffled_for_a_list_of_lost_rows(spark, edge_docs, monkeypatch):
    # pipeline: a list above Spark's own broadcast threshold made the texts of all rows go through a shuffle
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = sorted(map(tuple, one_of_each(edge_docs).collect()), key=str)
        single = spark.createDataFrame([r for r in edge_rows() if r[0] in (1, 2, 7, 8)], DOCS)
        assert "Exchange hashpartitioning" not in _plan(one_of_each(single)) and one_of_each(single).count() == 2
        monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
        assert sorted(map(tuple, one_of_each(edge_docs).collect()), key=str) == rows
        assert "Exchange hashpartitioning" in _plan(one_of_each(single))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_index_of_windows_is_done_before_texts_are_joined(edge_docs):
    # pipeline, repeated_passages: shuffle files of the index and of the texts were on disk together
    plan = _plan(remove_repeats(edge_docs))
    assert "FlatMapGroupsInArrow" not in plan and "ShuffledHashJoin" in plan
