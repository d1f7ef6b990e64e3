"""Merkle manifest of a table: a digest for each row, trees by source, one root, and proofs.

Every row is a leaf, the hash of its fields. The leaves of a source ascend by id; runs of ``arity``
neighbours become their parent until one node is left, the source's subroot. The subroots, by source,
make one more tree whose last node is the root.

Each level is a table of nodes (tree, place, digest). A node's siblings stand at places that follow from
its own: those of its run, shifted by 1, 2 ... slots (with two slots: place XOR 1). So a level equijoins
the nodes with themselves, once for each shift, and the rows of slot zero emit the parents. Proofs go the
other way: the nodes of a level join their parents, from the root down, and put their own siblings before
the parent's. A parent has ``arity`` children, so no key is hot however large a source is, and nothing
but the root and the longest tree's size comes to the driver.

Places come from a range sort by (source, id, digest) and a running sum over the counts of the ranges, so
that a source with a third of all rows is spread over many tasks.

Defined results: a field that is null counts as ``-``. Null ids come first, equal ids follow their leaves'
digests; repeated rows are leaves of their own. A row with a null id isn't tampered with. A table of one
row has the leaf as its root and an empty proof; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourline.llm.frames import col, stored

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels after which the way down is written, so that a plan joins no more of them.
CUT = 3
#: The tree over the subroots; trees of sources have the names that ``_tree`` gives.
_TOP = "root"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A field as it goes into a leaf: its length in bytes, a colon, the value; ``-`` if null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _tree(source: Column) -> Column:
    """A source's tree: names sort as the sources do, null first."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def with_places(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """The rows, stored, with their ``place`` in their tree by ``order``, from 0, and the tree's size ``n``."""
    dealt = rows.repartitionByRange(tree, *order).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    inside = W.partitionBy(tree, "part").orderBy(*[F.asc_nulls_first(c) for c in order])
    sizes = dealt.groupBy(tree, "part").agg(F.count(F.lit(1)).alias("rows"))  # a row for each range and each tree at most
    series = W.partitionBy(tree)
    before = F.coalesce(F.sum("rows").over(series.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(tree, "part", before.alias("start"), F.sum("rows").over(series).alias("n"))
    numbered = dealt.withColumn("place", F.row_number().over(inside) - 1).join(starts, [tree, "part"])
    return stored(numbered.withColumn("place", F.col("place") + F.col("start")).drop("part", "start"), "places")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (tree, place, n, digest) with the digests of their run ``before`` and ``after`` them, each joined to one text."""
    slot, run = F.pmod("place", F.lit(arity)), F.col("place") - F.pmod("place", F.lit(arity))
    out = nodes.withColumn("d0", F.col("digest"))
    for shift in range(1, arity):
        others = nodes.select("tree", F.col("place").alias("at"), F.col("digest").alias(f"d{shift}"))
        out = out.withColumn("at", run + F.pmod(slot + shift, F.lit(arity))).join(others, ["tree", "at"], "left").drop("at")
    at = [F.coalesce(*[F.when(F.pmod(slot + shift, F.lit(arity)) == s, F.col(f"d{shift}")) for shift in range(arity)]) for s in range(arity)]
    before = F.concat_ws("", *[F.when(slot > s, at[s]) for s in range(arity)])
    after = F.concat_ws("", *[F.when(slot < s, at[s]) for s in range(arity)])
    return out.select("tree", "place", "n", "digest", before.alias("before"), after.alias("after"))


def grow(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """The levels of all trees over leaves (tree, place, n, digest), the leaves first. A tree's last node has n = 1; levels above
    don't hold it."""
    longest = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes = [], leaves
    while True:
        levels.append(stored(with_siblings(nodes, arity), "level"))
        if longest <= 1:
            return levels
        first = levels[-1].filter((F.col("n") > 1) & (F.pmod("place", F.lit(arity)) == 0))
        parent = F.floor(F.col("place") / arity).cast("bigint")
        nodes = first.select("tree", parent.alias("place"), F.ceil(F.col("n") / arity).cast("bigint").alias("n"), digest(F.col("digest"), F.col("after")).alias("digest"))
        longest = -(-longest // arity)


def tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest): the last node of each tree."""
    return reduce(DataFrame.unionByName, [level.filter("n = 1").select("tree", "digest") for level in levels])


def paths(levels: list[DataFrame], above: DataFrame | None, arity: int) -> DataFrame:
    """(tree, place, path) of the leaves: the siblings before and after each node on the way up, the leaf's own first. ``above`` has
    the path (tree, rest) of each tree's last node."""
    known = None
    for height, level in reversed(list(enumerate(levels))):
        last = level.filter("n = 1").select("tree", "place")
        here = last.join(above, "tree") if above is not None else last.withColumn("rest", F.array().cast("array<struct<before:string,after:string>>"))
        here = here.select("tree", "place", F.col("rest").alias("path"))
        if known is not None:
            parents = known.select("tree", F.col("place").alias("parent"), F.col("path").alias("rest"))
            parent = F.floor(F.col("place") / arity).cast("bigint").alias("parent")
            inner = level.filter("n > 1").select("tree", "place", "before", "after", parent).join(parents, ["tree", "parent"])
            own = F.array(F.struct("before", "after"))
            here = here.unionByName(inner.select("tree", "place", F.concat(own, "rest").alias("path")))
        known = stored(here, "paths") if height % CUT == CUT - 1 else here
    return known


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", arity: int = ARITY) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row.

    ``folded_root`` folds the row's proof over the leaf of a copy that someone has tampered with: where the CRC-32 of the id is even,
    the text has lost its line breaks."""

    def leaf(text: Column) -> Column:
        return digest(*[field(text if f == text_col else col(f)) for f in fields])

    text, number = col(text_col).cast("string"), col(id_col).cast("bigint")
    tampered = F.coalesce(F.pmod(F.crc32(number.cast("string").cast("binary")), F.lit(2)) == 0, F.lit(False))
    seen = F.when(tampered & text.contains("\n"), leaf(F.replace(text, F.lit("\n"), F.lit(""))))
    rows = docs.select(_tree(col(source_col)).alias("tree"), number.alias("id"), leaf(text).alias("digest"), seen.alias("seen"))
    rows = with_places(rows, "tree", "id", "digest")
    levels = grow(rows.select("tree", "place", "n", "digest"), arity)
    subroots = tops(levels)
    over = with_places(subroots.select(F.lit(_TOP).alias("tree"), F.col("tree").alias("source"), "digest"), "tree", "source")
    high = grow(over.select("tree", "place", "n", "digest"), arity)
    found = tops(high).head(1)
    root = F.lit(found[0]["digest"] if found else None).cast("string")
    above = paths(high, None, arity).join(over.select("tree", "place", "source"), ["tree", "place"]).select(F.col("source").alias("tree"), F.col("path").alias("rest"))
    ways = paths(levels, above, arity)
    proved = rows.join(ways, ["tree", "place"]).join(subroots.select("tree", F.col("digest").alias("subroot")), "tree")
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), "").cast("binary"), 256)
    folded = F.aggregate("path", F.coalesce("seen", "digest"), lambda node, p: F.sha2(F.concat(p["before"], node, p["after"]).cast("binary"), 256))
    out = proved.select(
        F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", root.alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
