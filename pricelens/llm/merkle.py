"""Merkle manifest of a dataset: every row a leaf, a tree a source, one root over the sources.

Slot pivot: a node's place in its tree, divided by ``FANOUT``, is its parent's
place, the remainder its slot there.  One conditional aggregate a slot spreads
a parent's children into ``FANOUT`` columns; the columns concatenated are hashed to the
parent, and the columns without a child's own are its siblings.  Levels go up
until every tree is one node.  On the way down each parent hands its children
the siblings met so far, so the join of a level is as long as that level, and all joins
together one and a half times as long as the leaves.  Nothing groups by source alone: places come from
one global sort, so a source that holds a third of all rows is cut like any run
of rows.  All of it is DataFrame functions.

Digests are lower-case hex SHA-256; inputs are concatenated as hex text.

Edge cases: nulls in any leaf column (source and doc_id too) are written ``-``;
an empty text is ``0:``; a text of any length is one row; rows without a source
are a tree of their own, the first; in a source rows without a doc_id come
first, and rows that repeat a doc_id stay separate leaves, ordered by leaf
digest (equal rows are equal leaves, so any order gives the same tree); rows
without a doc_id count as not tampered with; a lone leaf is its source's
subroot, a lone subroot the root; the empty table gives no rows; extra columns,
whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.shared import written
from pricelens.operators.ranking import global_rank

FANOUT = 3
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: What a parent adds to its children's proofs: digests before the child's own slot and behind it.
STEP = "array<struct<before: string, behind: string>>"
_OWN = [f"c{i}" for i in range(FANOUT)]


def framed(value: Column) -> Column:
    """UTF-8 byte count, ``:`` and the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts one after another; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf_digest(text: Column | None = None) -> Column:
    """The leaf of a row, with another text if one is given."""
    return digest(*[framed(F.col(c) if c != "text" or text is None else text) for c in LEAF_COLUMNS])


def tampered() -> Column:
    """Rows of the tampering trial: 2 divides the unsigned crc32 of the decimal doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))


def height(leaves: Column) -> Column:
    """Levels above the leaves of a tree of so many."""
    return F.size(F.filter(F.array(*[F.lit(FANOUT ** i) for i in range(40)]), lambda p: p < leaves))


def parents(nodes: DataFrame) -> DataFrame:
    """(tree, height, at, c0.., hash) of the parents of nodes (tree, height, at, hash)."""
    slot = F.col("at") % FANOUT
    spread = [F.max(F.when(slot == i, F.col("hash"))).alias(c) for i, c in enumerate(_OWN)]
    pivot = nodes.groupBy("tree", "height", F.floor(F.col("at") / FANOUT).alias("at")).agg(*spread)
    return pivot.withColumn("hash", digest(*map(F.col, _OWN)))


def forest(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, hash) of every tree's root, and the pivots of each level from the lowest up.

    ``leaves`` are (tree, height, at, hash), places from 0 on without gaps.  A tree
    rests once it is one node; each level is written once.
    """
    top = leaves.agg(F.max("height")).first()[0] or 0
    nodes, levels = leaves, []
    roots = nodes.where("height = 0").select("tree", "hash")
    for level in range(top):
        levels.append(written(parents(nodes.where(F.col("height") > level)), "merkle-level"))
        nodes = levels[-1].select("tree", "height", "at", "hash")
        roots = roots.unionByName(nodes.where(F.col("height") == level + 1).select("tree", "hash"))
    return roots, levels


def with_steps(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``nodes`` (tree, at, ...) of the level under ``levels`` with ``steps``: the siblings at their own level, at their parent's, and so on to the root."""
    none, slot = F.array().cast(STEP), F.col("at") % FANOUT
    row = [f"p{i}" for i in range(FANOUT)]  # the parent's children
    before = F.concat_ws("", *[F.when(slot > i, F.col(c)) for i, c in enumerate(row)])
    behind = F.concat_ws("", *[F.when(slot < i, F.col(c)) for i, c in enumerate(row)])
    own = F.array(F.struct(before.alias("before"), behind.alias("behind")))
    told = levels[-1].withColumn("steps", none) if levels else nodes.withColumn("steps", none)
    for under in [*levels[-2::-1], nodes] if levels else []:
        above = told.select("tree", F.col("at").alias("parent"), *[F.col(c).alias(r) for c, r in zip(_OWN, row, strict=True)], F.col("steps").alias("above"))
        told = (under.withColumn("parent", F.floor(F.col("at") / FANOUT)).join(above, ["tree", "parent"], "left")
                .withColumn("steps", F.when(F.col("above").isNull(), none).otherwise(F.concat(own, "above"))).drop("parent", "above", *row))
    return told


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["behind"]), 256))


def manifest(documents: DataFrame, found: Column | None = None) -> DataFrame:
    """doc_id, source, place, leaf, subroot, root, steps (the leaf's proof), and ``found``: the leaf digest as it is now.

    ``found`` is a column of ``documents``; null (or none at all) says that the leaf is as written.
    """
    told = F.lit(None).cast("string") if found is None else found
    leaves = written(documents.select("doc_id", "source", leaf_digest().alias("leaf"), told.alias("found")), "merkle-leaves")
    ranked = global_rank(leaves, [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), "leaf", "found"], "rank")
    sizes = written(ranked.groupBy(F.col("source").alias("name")).agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")), "merkle-sizes")
    trees = global_rank(sizes, ["first"], "tree").select("name", "first", (F.col("tree") - 1).alias("tree"), height(F.col("n")).alias("height"))
    placed = written(ranked.join(trees, ranked["source"].eqNullSafe(trees["name"]))
                     .select("doc_id", "source", "leaf", "found", "tree", "height", (F.col("rank") - F.col("first")).alias("at")), "merkle-placed")

    subroots, levels = forest(placed.select("tree", "height", "at", F.col("leaf").alias("hash")))
    n_trees = sizes.count()
    tops = written(subroots.select(F.lit(0).cast("long").alias("tree"), height(F.lit(n_trees)).alias("height"), F.col("tree").alias("at"), "hash"), "merkle-subroots")
    root, top_levels = forest(tops)
    high = with_steps(tops, top_levels).select(F.col("at").alias("tree"), F.col("hash").alias("subroot"), F.col("steps").alias("high"))
    high = written(high.withColumn("root", root.select("hash").scalar()), "merkle-trees")
    low = with_steps(placed.drop("height"), levels)
    return low.join(high, "tree").select("doc_id", "source", F.col("at").alias("place"), "leaf", "subroot", "root",
                                         F.concat("steps", "high").alias("steps"), F.coalesce("found", "leaf").alias("found"))


def verify(told: DataFrame) -> DataFrame:
    """``manifest`` rows with ``proof_sha256``, ``folded_root`` (from the leaf as found) and ``verified``."""
    siblings = F.transform("steps", lambda s: F.concat(s["before"], s["behind"]))
    folded = told.withColumn("proof_sha256", F.sha2(F.array_join(siblings, ""), 256)).withColumn("folded_root", fold(F.col("found"), F.col("steps")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
