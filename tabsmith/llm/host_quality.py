"""Host-level quality rules (operator 8), in column expressions only.

Each document is measured over its whole text and tested against rules.  The
share of failing documents of a host (the ``source`` column) is shrunk with a
beta prior fitted to all hosts by moments, and a host whose shrunk share passes
``HOST_LIMIT`` loses all its documents.  A document is also dropped when it fails
a base rule itself.

One pass measures the texts; the narrow measures are stored in the shared folder
and serve both the aggregate and the join back.  The aggregate is combined before
its shuffle, so a host with a third of all rows is a few partial counts; the join
is left to adaptive execution, which broadcasts a small host table and splits a
large host's partition.

Edge rows: a null text is empty (and fails the base rule of 20 words); a null
source is the host ``''``.  Repeated rows count as often as they occur.  An empty
table gives an empty result.  Only the named columns are read, so other columns
may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import query, table
from .shared import quoted, stored

MIN_WORDS = 20
REPEAT_PERCENT = 30
SYMBOL_PERCENT = 10
DUP_LINE_PERCENT = 50
WINDOW = 8
HOST_LIMIT = 0.5
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\f\r"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    for c in _SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _covered(h: Column, k: int) -> Column:
    """Words under windows whose hash occurs twice: starts in order, each adding at most k words."""

    def of_sorted(s: Column) -> Column:
        same = lambda j, o: F.get(s, j).getField("x") == F.get(s, j + o).getField("x")
        starts = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.when(same(j, -1) | same(j, 1), F.get(s, j).getField("i")))
        step = lambda a: F.aggregate(F.sequence(F.lit(1), F.size(a) - 1), F.lit(k).cast("long"), lambda acc, j: acc + F.least(F.lit(k), F.get(a, j) - F.get(a, j - 1)).cast("long"))
        return let(F.sort_array(F.filter(starts, lambda i: i.isNotNull())), step)

    return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), of_sorted)


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    found = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda w: let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h, k))),
    )
    return F.when(F.size(words) < k, F.lit(0).cast("long")).otherwise(found)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    text = F.coalesce(quoted(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.select(
        quoted(id_col).alias("id"), F.coalesce(quoted(host_col), F.lit("")).alias("host"),
        F.length(without(text, _SPACES)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        of_words.alias("w"), of_lines.alias("l"),
    )
    return out.select("id", "host", "word_chars", "n_symbols", "w.*", "l.*")


def host_verdicts(rated: DataFrame) -> DataFrame:
    """host, shrunk share of failing documents: (fails + a) / (rows + a + b), with a, b from the moments of all hosts."""
    hosts = rated.groupBy("host").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("failed").cast("long")).alias("fails"))
    share = F.col("fails") / F.col("rows")
    m = hosts.agg(F.sum("fails").alias("f"), F.sum("rows").alias("n"), F.sum(F.col("rows") * share * share).alias("s"), F.count(F.lit(1)).alias("k")).first()
    mean = (m["f"] or 0) / max(m["n"] or 0, 1)
    spread = (m["s"] or 0) / max(m["n"] or 0, 1) - mean * mean
    # what the hosts' sizes alone would spread
    chance = mean * (1 - mean) * (m["k"] or 0) / max(m["n"] or 0, 1)
    strength = min(max(mean * (1 - mean) / max(spread - chance, 1e-9) - 1, 1.0), 1e6)
    return hosts.select("host", ((F.col("fails") + mean * strength) / (F.col("rows") + strength)).alias("share"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, the measures, base_failed, host share and kept, a row for each row of ``docs``."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    other = (100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars")) | (100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines"))
    rated = stored(measure(docs, id_col, text_col, host_col).withColumn("base_failed", base).withColumn("failed", F.col("base_failed") | other))
    hosts = host_verdicts(rated)
    return rated.join(hosts, "host").withColumn("kept", ~F.col("base_failed") & (F.col("share") <= HOST_LIMIT))


@query("op8_host_quality", f"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS x FROM w, unnest(range(1, greatest(len(words) - 6, 1))) AS u(i)),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) z, unnest(range(0, 8)) AS u(k) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, host, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
d AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
f AS (SELECT *, (base_failed OR 100 * n_symbols > {SYMBOL_PERCENT} * word_chars OR 100 * n_dup_lines > {DUP_LINE_PERCENT} * len(lines)) AS failed FROM d),
h AS (SELECT host, count(*) AS r, count(*) FILTER (failed) AS f FROM f GROUP BY host),
s AS (SELECT sum(f) / sum(r) AS mean, sum(f * f / r) / sum(r) AS sq, count(*) / sum(r) AS per FROM h),
p AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(sq - mean * mean - mean * (1 - mean) * per, 1e-9) - 1, 1), 1e6) AS strength FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND (h.f + p.mean * p.strength) / (h.r + p.strength) <= {HOST_LIMIT}) AS kept
FROM f JOIN h ON f.host = h.host CROSS JOIN p
""")
def op8_host_quality(spark, sf_dir):
    out = judge(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
