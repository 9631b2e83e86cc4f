"""URL filter by rules and a weighted vocabulary (operator 1).

Rules name a host (with all its subdomains) and a path start; the longest rule
that fits decides.  Other urls are judged by an Aho-Corasick automaton over
strict and soft terms: a hit counts where no ASCII letter or digit touches it,
one strict term or several distinct soft terms reject the url.

Host and path are column expressions; the automaton runs over Arrow batches of
the url column, without a shuffle, and holds the vocabulary only.

Edge rows: a null url, or one without ``://``, has an empty host and path, fits
no rule and is judged by the vocabulary (null: no hits).  Rows are independent,
so repeats, ties and empty tables need no care; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import query, table
from .shared import quoted

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Weight 2 rejects alone; weight 1 needs another distinct term.
STRICT = ("porn", "porno", "xxx", "hentai", "camgirls", "spam-farm", "link-farm", "warez", "keygen")
SOFT = ("adult", "sex", "sexy", "nude", "escort", "casino", "betting", "poker", "slots", "jackpot", "viagra", "pills", "payday", "loan", "crack", "torrent", "spam", "clickbait", "promo", "replica")
REJECT_WEIGHT = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = frozenset(_LOWER + "0123456789")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Index of the longest rule that fits, else null."""
    out = F.lit(None).cast("int")
    for i, (_, h, p) in sorted(enumerate(rules), key=lambda r: len(r[1][1] + r[1][2])):
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(i)).otherwise(out)
    return out


def _vocabulary(strict, soft) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (term, False))
    for term in strict:
        found.add_word(term, (term, True))
    found.make_automaton()
    return found


def count_terms(text: str | None, automaton) -> tuple[int, int]:
    """Hits of strict terms, and distinct soft terms, that stand alone."""
    lowered = (text or "").translate(_FOLD)
    strict, soft = 0, set()
    for end, (term, is_strict) in automaton.iter(lowered):
        start = end + 1 - len(term)
        if (start and lowered[start - 1] in _ALNUM) or (end + 1 < len(lowered) and lowered[end + 1] in _ALNUM):
            continue
        if is_strict:
            strict += 1
        else:
            soft.add(term)
    return strict, len(soft)


_FOLD = str.maketrans(_UPPER, _LOWER)


def _hits(strict, soft):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _vocabulary(strict, soft)
        for batch in batches:
            counts = [count_terms(u, automaton) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())], names=["row", "n_strict", "n_soft"])

    return run


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT) -> DataFrame:
    """``row`` (the input row as a struct), host, path, rule, n_strict, n_soft, verdict."""
    src = pages.select(F.struct(*[quoted(c) for c in pages.columns]).alias("row"), quoted(url_col).alias("url"))
    schema = T.StructType([T.StructField("row", src.schema["row"].dataType), T.StructField("n_strict", T.LongType()), T.StructField("n_soft", T.LongType())])
    hits = src.mapInArrow(_hits(strict, soft), schema)
    url = F.col("row").getField(url_col)
    hits = hits.select("*", host_of(url).alias("host"), path_of(url).alias("path"))
    hits = hits.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("i"))
    name = F.get(F.array(*[F.lit(h + p) for _, h, p in rules]), F.col("i"))
    action = F.get(F.array(*[F.lit(a) for a, _, _ in rules]), F.col("i"))
    rejected = (F.col("n_strict") * REJECT_WEIGHT + F.col("n_soft")) >= REJECT_WEIGHT
    return hits.select("row", "host", "path", name.alias("rule"), "n_strict", "n_soft", F.coalesce(action, F.when(rejected, "block").otherwise("allow")).alias("verdict"))


def _sql() -> str:
    def hit(term: str) -> str:
        return f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')::BIGINT"

    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {i}"
        for i, (_, h, p) in sorted(enumerate(RULES), key=lambda r: -len(r[1][1] + r[1][2]))
    )
    names = ", ".join(f"'{h}{p}'" for _, h, p in RULES)
    actions = ", ".join(f"'{a}'" for a, _, _ in RULES)
    return f"""
WITH p AS (
  SELECT page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS low,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, CASE {fits} END AS i, {' + '.join(map(hit, STRICT))} AS strict_terms, {' + '.join(map(hit, SOFT))} AS n_soft FROM h)
SELECT page_id, host, path, ([{names}])[i + 1] AS rule, n_soft,
  coalesce(([{actions}])[i + 1], CASE WHEN strict_terms > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict
FROM r"""


@query("op1_url_filter", _sql())
def op1_url_filter(spark, sf_dir):
    out = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("row.page_id", "host", "path", "rule", "n_soft", "verdict")
