"""Merkle manifest of a table: a tree of digests over its rows, the siblings that prove each row, and their check.

Every row is a leaf. The leaves of a group are numbered in order (a range shuffle, row numbers within its partitions,
and the partitions' offsets, so that a large group is in no one task) and folded up level by level: a node's number divided by the
fanout names its parent, which keeps its children in order and hashes their digests. What remains of each group is its
subroot; the subroots, in the order of the groups, are folded up likewise to the root. On the way down every level is joined
with the siblings collected above it, a level's nodes at a time, so the rows themselves are shuffled once for their numbers and
once into their parents, and never again: the last join is of their parents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, ascii_lower, discard, materialize, partitions, remainder

FANOUT = 8


def digest_of(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the values: each ``-`` if null, else its number of UTF-8 bytes, ``:`` and the value as text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)).cast("binary"), 256)


def hashed(digests: Column) -> Column:
    """The digest of an array of digests, joined as text."""
    return F.sha2(F.array_join(digests, "").cast("binary"), 256)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (grp, row, digest) with idx, from 0 in the order of row and digest, and total, the number of rows of the group."""
    spread = rows.repartitionByRange(partitions(rows.sparkSession), "grp", "row", "digest").sortWithinPartitions("grp", "row", "digest")
    placed = materialize(spread.withColumn("at", F.monotonically_increasing_id()), "merkle-leaves")
    part = F.shiftrightunsigned("at", 33)
    runs = placed.groupBy("grp", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = materialize(runs.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(own).alias("total")), "merkle-runs")
    return placed.withColumn("part", part).join(runs, ["grp", "part"]).select("grp", "row", "digest", (F.col("at") + F.col("shift")).alias("idx"), "total")


def _climb(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """The levels above numbered leaves: grp, idx, digest, total, and children in order (idx, digest, row)."""
    found, most = [], nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        child = F.struct("idx", "digest", *(c for c in nodes.columns if c == "row"))
        parent = nodes.where("total > 1").groupBy("grp", "total", F.floor(F.col("idx") / fanout).alias("parent")).agg(F.sort_array(F.collect_list(child)).alias("children"))
        level = parent.select("grp", F.col("parent").alias("idx"), hashed(F.col("children.digest")).alias("digest"), F.ceil(F.col("total") / fanout).alias("total"), "children")
        found.append(materialize(level, "merkle-level"))
        nodes, most = found[-1].drop("children"), -(-most // fanout)
    return found


def _tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """grp and digest of what remains of each group."""
    out = leaves.where("total = 1").select("grp", "digest")
    for level in levels:
        out = out.unionByName(level.where("total = 1").select("grp", "digest"))
    return out


def _descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with what ``tops`` has of their group, and path: the digests left and right of each ancestor, own level first."""
    carried = [c for c in tops.columns if c not in ("grp", "path")]

    def ends(nodes: DataFrame, *columns: str) -> DataFrame:
        return nodes.where("total = 1").join(tops, "grp").select("grp", *columns, "path", *carried)

    known = ends(levels[-1], "idx") if levels else None
    for k in reversed(range(len(levels))):
        own = ["row", "digest"] if k == 0 else ["idx"]
        met = levels[k].join(known, ["grp", "idx"]).select("grp", "path", *carried, F.col("children.digest").alias("all"), F.posexplode("children").alias("pos", "child"))
        left, right = F.array_join(F.slice("all", 1, F.col("pos")), ""), F.array_join(F.slice("all", F.col("pos") + 2, F.size("all")), "")
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        down = met.select("grp", *(F.col(f"child.{c}") for c in own), F.concat(step, "path").alias("path"), *carried)
        known = down.unionByName(ends(leaves if k == 0 else levels[k - 1], *own))
    return known if levels else ends(leaves, "row", "digest")


def manifest(rows: DataFrame, group: Column, order: list[Column], leaf: Column, keep: list[Column] = (), fanout: int = FANOUT) -> DataFrame:
    """A row for each of ``rows``: the ``order`` and ``keep`` columns by name, leaf, subroot, root, and path.

    ``path`` holds for each level, from the leaf's own to the root's, the digests left and right of the node, joined. Leaves
    stand by group, null first, and within it by ``order``, nulls first, then ``keep`` and digest, so rows that are equal in all of these change nothing by their places.
    Null values have a mark of their own in ``leaf``; a lone leaf is its subroot, a lone subroot the root. An empty table has no rows and no root. Columns that are
    not named are ignored, whatever their names.
    """
    own = F.struct(*order, *keep)
    named = F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string")))
    first = materialize(rows.select(named.alias("grp"), own.alias("row"), leaf.alias("digest")), "merkle-rows")
    leaves = _numbered(first)
    levels = _climb(leaves, fanout)
    discard(first)
    subroots = materialize(_tops(leaves, levels), "merkle-subroots")
    lone = _numbered(subroots.select(F.lit("").alias("grp"), F.struct(F.col("grp").alias("of")).alias("row"), "digest"))
    above = _climb(lone, fanout)
    roots = _tops(lone, above).select("grp", F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    tops = _descend(lone, above, roots).select(F.col("row.of").alias("grp"), F.col("digest").alias("subroot"), "root", "path")
    return _descend(leaves, levels, materialize(tops, "merkle-tops")).select("row.*", F.col("digest").alias("leaf"), "subroot", "root", "path")


def folded(leaf: Column | str, path: Column | str = "path") -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, F.col(leaf) if isinstance(leaf, str) else leaf, lambda so_far, s: F.sha2(F.concat(s.left, so_far, s.right).cast("binary"), 256))


def proof(path: Column | str = "path") -> Column:
    """The digest of all siblings on the way to the root."""
    return hashed(F.transform(path, lambda s: F.concat(s.left, s.right)))


def tampering_report(docs: DataFrame) -> DataFrame:
    """Every document of ``docs`` (doc_id, source, lang, n_chars, text) with its proof, and whether it still verifies after tampering.

    Where the crc32 of doc_id is divisible by 3 the text is lower-cased (A-Z) before it is verified. Rows with a null doc_id come first in their
    lang and are not tampered with; null texts stay. Repeated rows are leaves of their own.
    """

    def leaf(text: Column) -> Column:
        return digest_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    text = F.col("text")
    seen = F.when(F.coalesce(remainder(F.col("doc_id"), 3) == 0, F.lit(False)), leaf(ascii_lower(text))).otherwise(leaf(text))
    out = manifest(docs, F.col("lang"), [F.col("doc_id")], leaf(text), [seen.alias("seen")])
    out = out.withColumn("folded_root", folded("seen"))
    return out.select("doc_id", "leaf", "subroot", "root", proof().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_VALUE = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_VALUE.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, [unicode(c)::UBIGINT FOR c IN string_split(doc_id::VARCHAR, '')]), lambda a, b:
    list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"""


def _levels(name: str, leaves: str) -> str:
    return f"""{name}(lv, grp, idx, digest, total) AS (
  SELECT 0, grp, idx, digest, total FROM {leaves}
  UNION ALL
  SELECT lv + 1, grp, idx // {FANOUT}, sha256(string_agg(digest, '' ORDER BY idx)), (total + {FANOUT - 1}) // {FANOUT} FROM {name} WHERE total > 1 GROUP BY lv, grp, idx // {FANOUT}, total
)"""


def _steps(name: str, nodes: str, levels: str) -> str:
    """The steps of every leaf's way up: the siblings left and right of it in each level."""
    return f"""{name} AS (
  SELECT n.grp, n.idx, s.lv, coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx < n.idx // {FANOUT} ** s.lv), '') AS lft,
    coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx > n.idx // {FANOUT} ** s.lv), '') AS rgt
  FROM {nodes} n JOIN {levels} s ON s.grp = n.grp AND s.total > 1 AND s.idx // {FANOUT} = n.idx // {FANOUT} ** (s.lv + 1) GROUP BY n.grp, n.idx, s.lv
)""".replace(f"{FANOUT} ** s.lv", f"({FANOUT} ** s.lv)::BIGINT").replace(f"{FANOUT} ** (s.lv + 1)", f"({FANOUT} ** (s.lv + 1))::BIGINT")


ORACLE = f"""
WITH RECURSIVE
digests AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, {_LEAF.format("text")} AS digest,
    CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.format(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_LEAF.format("text")} END AS seen FROM documents
),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, seen, digest) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS total FROM digests
),
{_levels("tree", "leaves")},
subroots AS MATERIALIZED (
  SELECT '' AS grp, grp AS own, digest, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS total FROM tree WHERE total = 1
),
{_levels("upper_tree", "subroots")},
{_steps("lower_steps", "leaves", "tree")},
{_steps("upper_steps", "subroots", "upper_tree")},
every_step AS (
  SELECT grp, idx, lv, lft, rgt FROM lower_steps
  UNION ALL
  SELECT l.grp, l.idx, 1000 + u.lv, u.lft, u.rgt FROM leaves l JOIN subroots s ON s.own = l.grp JOIN upper_steps u ON u.idx = s.idx
),
ways AS (SELECT grp, idx, list({{'l': lft, 'a': '', 'r': rgt}} ORDER BY lv) AS way FROM every_step GROUP BY grp, idx),
done AS (
  SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, (SELECT digest FROM upper_tree WHERE total = 1) AS root,
    sha256(coalesce(array_to_string([w.l || w.r FOR w IN ways.way], ''), '')) AS proof_sha256,
    list_reduce(list_prepend({{'l': '', 'a': l.seen, 'r': ''}}, coalesce(ways.way, [])), lambda x, y: {{'l': '', 'a': sha256(y.l || x.a || y.r), 'r': ''}}).a AS folded_root
  FROM leaves l JOIN subroots s ON s.own = l.grp LEFT JOIN ways ON ways.grp = l.grp AND ways.idx = l.idx
)
SELECT *, folded_root = root AS verified FROM done
"""
