"""Merkle manifest of a table (operator 12): concatenated-level strings.

The rows of a group, in order, are the leaves of its tree.  An aligned block of
``fan ** block_levels`` consecutive nodes keeps each of its levels as one string
of fixed-width hex digests.  Fixed-width substrings of a level hash to the next
one, and the substrings that flank a node inside its run are its sibling segment,
so a leaf's path inside a block takes one substring or two a level.  The tops of
the blocks are the nodes of the next round, until every group has one root; the
roots of the groups, in order, are the leaves of a last tree.

A node of a run that is alone is hashed alone while other nodes remain on its
level; a lone leaf is its own root.

Plan: one scan makes the leaves (64 characters a row; no text is shuffled), a
range sort numbers them, blocks are groups of a fixed number of rows whatever the
size of a group, and paths are put together on blocks before the rows are spread
again.  Levels are held as bytes, so a substring costs its own length only.

Edge rows: a null field is ``-``; null groups are one group and come first; a null
id comes first in its group.  Rows with one id are ordered by their leaf, equal
rows are leaves of their own with equal digests.  A very long text only costs its
hashing.  An empty table has no rows and no root.  Column names of the input never
clash: the result holds ``row`` (the carried columns), leaf, subroot, root, path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import row_numbers
from .catalog import query, table
from .shared import quoted, stored

FAN = 2
BLOCK_LEVELS = 8
_WIDTH = 64


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def leaf_of(fields: list[Column]) -> Column:
    """H of the fields, each as byte count, colon and value, or ``-``."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(F.concat(*parts))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path of sibling segments give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def _parents(level: str, fan: int) -> str:
    w = _WIDTH * fan
    return f"""transform(array({level}), v -> CAST(array_join(transform(
      sequence(0, CAST((octet_length(v) + {w - 1}) div {w} AS INT) - 1), j -> sha2(substring(v, j * {w} + 1, {w}), 256)), '') AS BINARY))[0]"""


def _segments(fan: int) -> str:
    """Sibling segments of the member ``m`` on each level but the top."""
    return f"""transform(slice(levels, 1, size(levels) - 1), (v, l) ->
      transform(array(CAST(m.place div CAST(pow({fan}, l) AS BIGINT) AS INT)), i -> struct(
        CAST(substring(v, (i - i % {fan}) * {_WIDTH} + 1, (i % {fan}) * {_WIDTH}) AS STRING) AS before,
        CAST(substring(v, (i + 1) * {_WIDTH} + 1, ({fan} - 1 - i % {fan}) * {_WIDTH}) AS STRING) AS after))[0])"""


def _blocks(nodes: DataFrame, fan: int, block_levels: int) -> DataFrame:
    """One round: grp, block, total, members, levels (one string each) and top of every block of nodes."""
    size = fan**block_levels
    member = F.struct((F.col("pos") % size).alias("place"), "node", "row")
    grouped = nodes.groupBy("grp", F.floor(F.col("pos") / size).cast("long").alias("block")).agg(F.max("total").alias("total"), F.collect_list(member).alias("members"))
    members = F.expr("array_sort(members, (a, b) -> CAST(a.place - b.place AS INT))")
    powers = ", ".join(str(fan**i) for i in range(block_levels))
    levels = f"""aggregate(filter(array({powers}), p -> p < total), CAST(array(level) AS ARRAY<BINARY>),
      (done, p) -> array_append(done, {_parents("element_at(done, -1)", fan)}))"""
    grouped = grouped.withColumn("members", members).withColumn("level", F.expr("CAST(array_join(transform(members, m -> m.node), '') AS BINARY)"))
    return stored(grouped.withColumn("levels", F.expr(levels)).select("grp", "block", "total", "members", "levels", F.expr("CAST(element_at(levels, -1) AS STRING)").alias("top")))


def _rounds(nodes: DataFrame, fan: int, block_levels: int) -> list[DataFrame]:
    """The blocks of every round, the leaves' first; the last round has one block for each group."""
    size, out = fan**block_levels, []
    while True:
        out.append(_blocks(nodes, fan, block_levels))
        most = out[-1].agg(F.max("total").alias("n")).first()["n"] or 0
        if most <= size:
            return out
        nodes = out[-1].select("grp", F.col("block").alias("pos"), F.ceil(F.col("total") / size).cast("long").alias("total"), F.col("top").alias("node"), F.struct(F.lit(0).alias("none")).alias("row"))


def _paths(rounds: list[DataFrame], above: DataFrame, fan: int, size: int) -> DataFrame:
    """grp, pos, node, row, path and the columns of ``above`` for every leaf; ``above`` has a path for each group."""
    names = [c for c in above.columns if c not in ("grp", "path")]
    upper = above.withColumn("pos", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        upper = upper.select(F.col("grp").alias("g"), F.col("pos").alias("b"), F.col("path").alias("rest"), *names)
        joined = blocks.join(upper, F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b")))
        member = f"transform(members, m -> struct(m.place AS place, m.node AS node, m.row AS row, concat({_segments(fan)}, rest) AS path))"
        upper = joined.select("grp", "block", *names, F.expr(f"inline({member})"))
        upper = upper.select("grp", (F.col("block") * size + F.col("place")).alias("pos"), "node", "row", "path", *names)
    return upper


def merkle_manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", carry: list[str] | None = None, fan: int = FAN, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``row`` (the id and the ``carry`` columns), leaf, subroot, root and path (before and after segments) of every row."""
    size = fan**block_levels
    own = [id_col, *(carry or [])]
    leaves = docs.select(quoted(group_col).alias("grp"), quoted(id_col).alias("id"), leaf_of([quoted(f) for f in fields]).alias("node"), F.struct(*[quoted(c) for c in own]).alias("row"))
    nodes = row_numbers(leaves, ["id", "node"], within=["grp"], name="pos", total="total").drop("id")
    rounds = _rounds(nodes, fan, block_levels)
    roots = rounds[-1].select("grp", F.col("top").alias("node"), F.struct(F.lit(0).alias("none")).alias("row"), F.col("grp").alias("name"))
    roots = row_numbers(roots, ["name"], name="pos", total="total").select(F.lit(0).alias("grp"), "pos", "total", "node", F.struct(F.col("name").alias("name")).alias("row"))
    top_rounds = _rounds(roots, fan, block_levels)
    ends = top_rounds[-1].select("grp", F.array().cast("array<struct<before:string,after:string>>").alias("path"), F.col("top").alias("root"))
    above = _paths(top_rounds, ends, fan, size).select(F.col("row.name").alias("grp"), "path", "root", F.col("node").alias("subroot"))
    return _paths(rounds, stored(above), fan, size).select("row", F.col("node").alias("leaf"), "subroot", "root", "path")


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@query("op12_merkle_manifest", """
WITH RECURSIVE docs AS (
  SELECT *, list_reduce([4294967295] || [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')],
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))) AS crc
  FROM documents),
field AS (
  SELECT doc_id, lang, xor(crc, 4294967295) % 7 = 0 AS bend,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS n, coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS n1,
    coalesce(strlen(text) || ':' || text, '-') AS body
  FROM docs),
leaves AS (
  SELECT doc_id, lang, sha256(head || n || body) AS leaf, sha256(head || CASE WHEN bend THEN n1 ELSE n END || body) AS start_,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos
  FROM field),
lv AS (
  SELECT lang, 0 AS l, list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, l + 1, [sha256(nodes[2 * j + 1] || coalesce(nodes[2 * j + 2], '')) FOR j IN range(0, (len(nodes) + 1) // 2)] FROM lv WHERE len(nodes) > 1),
subs AS (
  SELECT lang, nodes[1] AS subroot, l AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM lv WHERE len(nodes) = 1),
tops AS (
  SELECT 0 AS l, list(subroot ORDER BY pos) AS nodes FROM subs HAVING count(*) > 0
  UNION ALL
  SELECT l + 1, [sha256(nodes[2 * j + 1] || coalesce(nodes[2 * j + 2], '')) FOR j IN range(0, (len(nodes) + 1) // 2)] FROM tops WHERE len(nodes) > 1),
steps AS (
  SELECT doc_id, l, CASE WHEN (leaves.pos >> l) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(nodes[xor(leaves.pos >> l, 1) + 1], '') AS step
  FROM leaves JOIN lv ON leaves.lang IS NOT DISTINCT FROM lv.lang WHERE len(nodes) > 1
  UNION ALL
  SELECT doc_id, 1000 + l, CASE WHEN (subs.pos >> l) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(nodes[xor(subs.pos >> l, 1) + 1], '')
  FROM leaves JOIN subs ON leaves.lang IS NOT DISTINCT FROM subs.lang, tops WHERE len(nodes) > 1),
ways AS (SELECT doc_id, list(step ORDER BY l) AS way FROM steps GROUP BY doc_id),
done AS (
  SELECT leaves.doc_id, leaf, subroot, (SELECT nodes[1] FROM tops WHERE len(nodes) = 1) AS root,
    sha256(array_to_string([x[2:] FOR x IN coalesce(way, [])], '')) AS proof_sha256,
    list_reduce([start_] || coalesce(way, []), lambda a, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root
  FROM leaves JOIN subs ON leaves.lang IS NOT DISTINCT FROM subs.lang LEFT JOIN ways ON leaves.doc_id = ways.doc_id)
SELECT *, folded_root = root AS verified FROM done
""")
def op12_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tampered = [F.try_add(F.col(f), F.lit(1)) if f == "n_chars" else F.col(f) for f in FIELDS]
    bent = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf_of(tampered))
    out = merkle_manifest(docs.withColumn("bent", bent), FIELDS, carry=["bent"])
    out = out.withColumn("folded_root", fold(F.coalesce("row.bent", "leaf"), F.col("path")))
    return out.select("row.doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
