"""Operator 11, Merkle dataset manifest by lag and lead windows.

Each row is a leaf; the leaves of a group, in order, are hashed in runs of three, level by level, to the group's subroot, and
the subroots likewise to one root. A node lives on the row of its first leaf. At level j the nodes stand 3**j rows apart, so
`lag` and `lead` by 3**j and 2 * 3**j rows, masked by the node's slot in its run and by the run's length, give its siblings, and
rows of first children hash the parents. On the way back `lag` by the same offsets hands a parent's path down to its children.

A hot group is never gathered: rows get their places by ranges, the windows run in aligned chunks of 3**LEVELS rows, and the
chunks' tops are the next round's rows (log of the group's size rounds, each 243 times smaller than the one before).
Defined results: a null field hashes as `-`; a null group is a group of its own and sorts first; null ids sort first; rows that
share an id are ordered by their digest, so repeated rows are interchangeable; a group of one row has its leaf as subroot; an
empty table has no rows and no root. Fields are named, so further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinframe.llm.common import cut, documents, ranked, same

ARITY, LEVELS = 3, 5
CHUNK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' concatenation."""
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: Sequence[Column]) -> Column:
    """Each field as its UTF-8 byte count, `:` and value, or `-` where it is null."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda d, p: digest(p["before"], d, p["after"]))


def proof(path: Column) -> Column:
    """All siblings, level by level and left to right, as one string."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "")


def chunk_paths(nodes: DataFrame, by: list[str]) -> DataFrame:
    """nodes (by..., i, n, d) -> with chunk, path (siblings of up to LEVELS levels) and d, on a chunk's first row its top."""
    now = nodes.withColumn("chunk", F.expr(f"i div {CHUNK}"))
    own = Window.partitionBy(*by, "chunk").orderBy("i")
    none, others = F.lit(""), range(1, ARITY)
    for j in range(LEVELS):
        step = ARITY**j
        node, nodes_here = F.expr(f"i div {step}"), F.expr(f"(n + {step - 1}) div {step}")
        slot = node % ARITY
        live = (F.col("i") % step == 0) & (nodes_here > 1)
        now = now.select("*", slot.alias("slot"), F.least(F.lit(ARITY), nodes_here - node + slot).alias("run"), live.alias("live"))
        now = now.select("*", *[F.lag("d", k * step).over(own).alias(f"lag{k}") for k in others], *[F.lead("d", k * step).over(own).alias(f"lead{k}") for k in others])
        before = F.concat(*[F.when(F.col("slot") >= k, F.col(f"lag{k}")).otherwise(none) for k in reversed(others)])
        after = F.concat(*[F.when(F.col("slot") + k < F.col("run"), F.col(f"lead{k}")).otherwise(none) for k in others])
        now = now.withColumn(f"siblings{j}", F.when(F.col("live"), F.struct(before.alias("before"), after.alias("after"))))
        parent = digest(F.col("d"), F.col(f"siblings{j}.after"))
        now = now.withColumn("d", F.when(F.col("live") & (F.col("slot") == 0), parent).otherwise(F.col("d")))
        now = now.drop("slot", "run", "live", *[f"{x}{k}" for x in ("lag", "lead") for k in others])
    empty = F.array().cast(PATH)
    now = now.withColumn("path", F.when(F.col("i") % CHUNK == 0, empty))
    for j in reversed(range(LEVELS)):
        step = ARITY**j
        above = F.coalesce("path", *[F.when(F.expr(f"i div {step}") % ARITY == k, F.lag("path", k * step).over(own)) for k in others])
        now = now.withColumn("above", above)
        here = F.when(F.col(f"siblings{j}").isNull(), empty).otherwise(F.array(F.col(f"siblings{j}")).cast(PATH))
        now = now.withColumn("path", F.when(F.col("i") % step == 0, F.concat(here, F.col("above")))).drop("above")
    return now.drop(*[f"siblings{j}" for j in range(LEVELS)])


def trees(nodes: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """nodes (..., by..., i, n, d: each group's nodes in their order) -> the nodes with their whole path in their group's tree,
    and (by..., d) with each group's root."""
    rounds, now = [], nodes
    while True:
        rounds.append(cut(chunk_paths(now, by), "merkle"))
        tops = rounds[-1].where(F.col("i") % CHUNK == 0)
        now = tops.select(*by, F.expr(f"i div {CHUNK}").alias("i"), F.expr(f"(n + {CHUNK - 1}) div {CHUNK}").alias("n"), "d")
        if now.where("n > 1").isEmpty():
            break
    paths = rounds.pop()
    while rounds:  # a node of a round is a chunk of the one before
        upper = paths.select(*by, F.col("i").alias("chunk"), F.col("path").alias("upper"))
        below = rounds.pop()
        kept = [F.col(f"b.{c}") for c in below.columns if c != "path"]
        paths = below.alias("b").join(upper.alias("u"), same("b", "u", [*by, "chunk"])).select(*kept, F.concat("path", "upper").alias("path"))
    return paths, now.select(*by, "d")


def manifest(rows: DataFrame, group: str, order: str, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(group, order, keep..., leaf, subroot, root, path): one row for each of `rows`; `keep`: columns taken along; path: the siblings of every level from
    the leaf up to the root, as (before, after) pairs of joined hex digests."""
    plain = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), *[F.col(k).alias(f"k{n}") for n, k in enumerate(keep)], leaf([F.col(f) for f in fields]).alias("leaf"))
    placed = ranked(cut(plain, "leaves"), ["g"], ["o", "leaf"], "leaves").withColumn("d", F.col("leaf"))
    paths, subroots = trees(placed, ["g"])
    tops = ranked(subroots.withColumn("subroot", F.col("d")), [], ["g"], "subroots")
    upper, root = trees(tops, [])
    top = root.first()
    upper = upper.select("g", "subroot", F.col("path").alias("upper"))
    joined = paths.alias("p").join(upper.alias("u"), same("p", "u", ["g"]))
    named = [F.col("p.g").alias(group), F.col("o").alias(order), *[F.col(f"k{n}").alias(k) for n, k in enumerate(keep)]]
    return joined.select(*named, "leaf", "subroot", F.lit(top.d if top else None).cast("string").alias("root"), F.concat("path", "upper").alias("path"))


def changed(old: DataFrame, new: DataFrame, group: str, order: str) -> DataFrame:
    """(group, order, change) between two manifests of tables with unique ids: added, removed or changed. Groups whose subroots
    agree are dropped before any leaf is compared."""
    roots = lambda m: m.select(group, "subroot").distinct()
    differ = roots(old).exceptAll(roots(new)).unionByName(roots(new).exceptAll(roots(old))).select(group).distinct()
    pick = lambda m: m.alias("m").join(differ.alias("d"), same("m", "d", [group]), "left_semi").select(group, order, "leaf")
    both = pick(old).alias("a").join(pick(new).alias("b"), same("a", "b", [group, order]), "full")
    kind = F.when(F.col("a.leaf").isNull(), "added").when(F.col("b.leaf").isNull(), "removed").when(F.col("a.leaf") != F.col("b.leaf"), "changed")
    side = lambda c: F.when(F.col("a.leaf").isNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return both.select(side(group), side(order), kind.alias("change")).where("change is not null")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*FIELDS)
    without = leaf([F.regexp_replace(f, "\n", "") if f == "text" else F.col(f) for f in FIELDS])
    struck = docs.withColumn("struck", F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, without))
    found = manifest(struck, "source", "doc_id", FIELDS, keep=["struck"])
    folded = found.withColumn("folded_root", fold(F.coalesce("struck", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: bits of the id's decimal digits, least significant first, run through the CRC's feedback (fixed value: its reversed polynomial)
_CRC = """list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, length(t) + 1), lambda k: list_transform(range(0, 8), lambda b: ((ascii(t[k]) >> b) & 1)::BIGINT))),
  lambda c, x: xor(c >> 1, CASE WHEN ((c & 1) + x) % 2 = 1 THEN 3988292384 ELSE 0 END))"""
_LEAF = "sha256(concat({}))"
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"


def _oracle() -> str:
    def leaf_sql(text: str) -> str:
        return _LEAF.format(", ".join(_FIELD.format(text if f == "text" else f) for f in FIELDS))

    def climb(name: str, key: str) -> str:
        return f"""
{name} AS (SELECT 0 AS lvl, {key}, i, n, d FROM {name}_start
  UNION ALL SELECT any_value(lvl) + 1, {key}, i // 3, (any_value(n) + 2) // 3, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END FROM {name} WHERE lvl < 16 GROUP BY {key}, i // 3),
{name}_runs AS (SELECT lvl, {key}, i // 3 AS run, list(d ORDER BY i) AS members FROM {name} WHERE n > 1 GROUP BY ALL)"""

    walk = """SELECT w.k, w.g, w.i // 3, w.lvl + 1, sha256(array_to_string(r.members[:w.i % 3], '') || w.d || array_to_string(r.members[w.i % 3 + 2:], '')),
    w.proof || array_to_string(r.members[:w.i % 3], '') || array_to_string(r.members[w.i % 3 + 2:], '')"""
    return f"""
WITH RECURSIVE ids AS (SELECT *, doc_id::VARCHAR AS t FROM documents),
leaves AS (SELECT doc_id, source AS g, {leaf_sql("text")} AS leaf, CASE WHEN {_CRC} % 2 = 1 THEN {leaf_sql("replace(text, chr(10), '')")} ELSE {leaf_sql("text")} END AS bad FROM ids),
placed AS (SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
low_start AS (SELECT g, i, n, leaf AS d FROM placed),{climb("low", "g")},
subroots AS (SELECT g, d FROM low WHERE lvl = 16),
top_start AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n, d, g AS source FROM subroots),{climb("top", "g")},
root AS (SELECT d FROM top WHERE lvl = 16),
walk AS (SELECT k, g, i, 0 AS lvl, bad AS d, '' AS proof FROM placed UNION ALL {walk} FROM walk w JOIN low_runs r ON r.lvl = w.lvl AND r.run = w.i // 3 AND r.g IS NOT DISTINCT FROM w.g),
low_end AS (SELECT k, max_by(d, lvl) AS d, max_by(proof, lvl) AS proof FROM walk GROUP BY k),
walk2 AS (SELECT e.k, 0 AS g, s.i, 0 AS lvl, e.d, e.proof FROM low_end e JOIN placed p ON p.k = e.k JOIN top_start s ON s.source IS NOT DISTINCT FROM p.g
  UNION ALL {walk} FROM walk2 w JOIN top_runs r ON r.lvl = w.lvl AND r.run = w.i // 3),
ends AS (SELECT k, max_by(d, lvl) AS d, max_by(proof, lvl) AS proof FROM walk2 GROUP BY k)
SELECT doc_id, leaf, s.d AS subroot, root.d AS root, sha256(proof) AS proof_sha256, e.d AS folded_root, e.d = root.d AS verified
FROM placed p JOIN ends e ON e.k = p.k JOIN subroots s ON s.g IS NOT DISTINCT FROM p.g, root
"""


ORACLE = _oracle()
