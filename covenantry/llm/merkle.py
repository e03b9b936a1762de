"""Merkle manifest of a table: a tree per source, a tree over the sources, proofs by recomputation.

Every row is a leaf.  Leaves of a source ascend by id, and every ``FAN`` consecutive nodes become
one node of the next level until one is left; the roots of the sources, in order of the sources,
form a tree of the same kind.

Only every ``STRIDE``-th level is stored.  A stored row is an aligned subtree: the up to
``FAN ** STRIDE`` nodes of one stored level below one node of the next, so a source of any size is
spread over many rows, and no row grows.  Proofs come from the root downwards: a stored subtree
meets the path of its top node, regenerates the levels in between from its nodes, hands each node
its siblings on the way up, and forgets those levels again.  The longest paths, those of leaves,
are turned into digests in place and are never shuffled.

Positions are exact without a window over a source: leaves are range-partitioned by (source, id),
a row's place in its partition is added to the number of rows that earlier partitions hold of the
same source.  Ties between equal ids are broken by the leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covenantry.llm.shared import written

FAN = 3
STRIDE = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PARTITION_SHIFT = 33    # monotonically_increasing_id keeps the partition above these bits


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one behind the other."""
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)


def field(value: Column) -> Column:
    """``-`` for null, else the size in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return digest(*[field(columns[name]) for name in columns])


def placed(leaves: DataFrame) -> DataFrame:
    """Add ``place`` (from 0, per ``tree``) and ``size`` (of the tree) to ``tree, rank, digest, ...``."""
    ordered = leaves.repartitionByRange("tree", "rank", "digest").sortWithinPartitions("tree", "rank", "digest")
    ordered = written(ordered.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("at", PARTITION_SHIFT)
    # one row per partition and tree: a tree has at most as many as there are partitions
    runs = ordered.groupBy("tree", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("tree").alias("of"), F.col("part").alias("run"), F.sum("n").over(tree).alias("size"),
                       (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    met = ordered.join(runs, (ordered["tree"] == runs["of"]) & (part == runs["run"]))
    return met.select(*leaves.columns, (F.col("at") + F.col("shift")).alias("place"), "size")


def joined(nodes: Column) -> Column:
    return F.concat_ws("", nodes)


def up(nodes: Column) -> Column:
    """The level above: each run of ``FAN`` nodes in one digest."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: digest(joined(F.slice(nodes, i * FAN + 1, FAN))))


def regrown(blocks: DataFrame, stride: int) -> DataFrame:
    """Add ``level0`` (the stored nodes) to ``level<stride>``; a level above the tree's last node is null."""
    found, size = blocks.withColumn("level0", F.col("nodes.digest")), F.col("size")
    for k in range(stride):
        # one column a level, so that no level is computed more than once
        found = found.withColumn(f"level{k + 1}", F.when(size > 1, up(F.col(f"level{k}"))))
        size = F.ceil(size / FAN)
    return found


def grow(leaves: DataFrame, stride: int = STRIDE) -> tuple[list[DataFrame], DataFrame]:
    """Stored subtrees level by level, and ``tree, top`` with the one node that is left of each tree.

    ``leaves`` has ``tree, place, size, digest`` and a struct ``row``, which only the subtrees of leaves keep.
    """
    span, nodes, stored, tops = FAN**stride, leaves, [], None
    while True:
        member = F.struct(*[c for c in ("place", "digest", "row") if c in nodes.columns])
        blocks = nodes.groupBy("tree", F.floor(F.col("place") / span).alias("block")).agg(
            F.array_sort(F.collect_list(member)).alias("nodes"), F.max("size").alias("size"))
        blocks = blocks.withColumn("nodes", F.transform("nodes", lambda x: x.dropFields("place")))
        top = F.coalesce(*[F.col(f"level{k}") for k in range(stride, -1, -1)])[0]
        # the levels in between are folded here and not kept
        blocks = written(regrown(blocks, stride).select("tree", "block", "size", "nodes", top.alias("top")), "merkle-level")
        stored.append(blocks)
        ended = blocks.filter(F.col("size") <= span).select("tree", "top")
        tops = ended if tops is None else tops.unionByName(ended)
        rest = blocks.filter(F.col("size") > span)
        if rest.isEmpty():
            return stored, tops
        nodes = rest.select("tree", F.col("block").alias("place"), F.ceil(F.col("size") / span).alias("size"), F.col("top").alias("digest"))


def siblings(at: Column, stride: int) -> Column:
    """``array<struct<before, after>>``: what stands left and right of a node and of its ancestors in their runs."""
    steps = []
    for k in range(stride):
        here = F.floor(at / FAN**k).cast("int")
        first = here - here % FAN
        steps.append(F.when(F.col(f"level{k + 1}").isNotNull(), F.struct(
            joined(F.slice(f"level{k}", first + 1, here - first)).alias("before"),
            joined(F.slice(f"level{k}", here + 2, first + (FAN - 1) - here)).alias("after"))))
    return F.filter(F.array(*steps), lambda x: x.isNotNull())


def descend(stored: list[DataFrame], tops: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Every leaf's ``row, digest, path`` and the columns of ``tops``, which holds ``tree`` and the ``path`` above it."""
    span = FAN**stride
    carried = ["path", *[c for c in tops.columns if c not in ("tree", "path")]]
    roots = tops.select(F.col("tree").alias("of"), *carried)
    above = None
    for k in range(len(stored) - 1, -1, -1):
        last = stored[k].filter(F.col("size") <= span).join(roots, F.col("tree") == F.col("of")).drop("of")
        if above is not None:
            inner = stored[k].filter(F.col("size") > span)
            inner = inner.join(above, (F.col("tree") == F.col("of")) & (F.col("block") == F.col("below"))).drop("of", "below")
            last = last.unionByName(inner)
        each = regrown(last, stride).select("*", F.posexplode("nodes").alias("at", "node"))
        each = each.withColumn("path", F.concat(siblings(F.col("at"), stride), "path"))
        if k:
            above = each.select(F.col("tree").alias("of"), (F.col("block") * span + F.col("at")).alias("below"), *carried)
    return each.select("node.row", "node.digest", *carried)


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its way up."""
    return F.aggregate(path, start, lambda h, x: digest(x["before"], h, x["after"]))


def manifest(leaves: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Per leaf ``row, digest, subroot, root, path`` from ``tree, rank, digest, row``.

    ``tree`` (not null, in the order wanted) names the tree, ``rank`` orders its leaves, ``row`` is a
    struct that is handed through.  Rows that repeat are leaves of their own; an empty table has no
    root and gives an empty table.
    """
    stored, tops = grow(placed(leaves), stride)
    crown = tops.select(F.lit(0).alias("tree"), F.col("tree").alias("rank"), F.col("top").alias("digest"), F.struct("tree").alias("row"))
    crown, root = grow(placed(crown), stride)
    no_path = F.array().cast("array<struct<before:string,after:string>>")
    paths = descend(crown, root.select("tree", no_path.alias("path"), F.col("top").alias("root")), stride)
    paths = paths.select("row.tree", "path", F.col("digest").alias("subroot"), "root")
    return descend(stored, written(paths, "merkle-paths"), stride)


def tampered(doc_id: Column, text: Column) -> Column:
    """The text as it was altered: rows whose crc32 of the id is even lose their line feeds; null ids and texts stay."""
    even = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def verify(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Per row ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` after the tampering.

    Nulls in any field are told apart from empty values; a null source comes first, as does a null
    id within its source.  Repeated ids and rows are leaves of their own.  Texts are hashed in one
    pass and travel no further, however long; columns beyond the five fields are not read.
    """
    columns = {name: F.col(name) for name in FIELDS}
    # a null source sorts before every other, also before the empty one
    tree = F.coalesce(F.concat(F.lit(":"), F.col("source")), F.lit("-"))
    leaves = docs.select(
        tree.alias("tree"), F.col("doc_id").alias("rank"), leaf(columns).alias("digest"),
        F.struct("doc_id", leaf({**columns, "text": tampered(F.col("doc_id"), F.col("text"))}).alias("later")).alias("row"))
    found = manifest(written(leaves, "merkle-leaves"), stride)
    proof = digest(joined(F.transform("path", lambda x: F.concat(x["before"], x["after"]))))
    return (found.select(F.col("row.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
                         proof.alias("proof_sha256"), fold(F.col("row.later"), F.col("path")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
