"""Merkle dataset manifest: a digest for every row, for every tree of rows and for the whole table, and a proof for every row.

Rows are the leaves of the tree that their partition value names, in the order of their key. While a tree has several
nodes, every 8 consecutive ones (the last run may be shorter, even one) are hashed into one. The roots of all trees, in the
order of the trees' names, are the leaves of one more tree, whose root stands for the table. A row's proof is the
other members of its runs, level by level up to that root.

Cogrouped subtree exchange: a superblock is ``SPAN`` = 8^3 consecutive nodes of a tree. Superblocks are first reduced to one
node each, and these nodes form the next, 512 times smaller table, until each tree has one superblock. Then the way goes back
down: the nodes of a superblock and the outer nodes that its rows need (the siblings of the superblock's ancestors) are
cogrouped by superblock, and one function reduces the superblock again, joins local and outer siblings into proofs
and folds the claimed leaves. So each row is shuffled by superblock twice, as digests only, and no task holds more than
512 rows of a tree, however large the tree is. Numbers of rows inside their tree come from a sort by ranges and counts
per range; rows of one key fall apart into ranges like others.

Defined results: a null tree name is a tree of its own and comes first; null keys come first in their tree; rows of one key
are ordered by their digest, equal rows are leaves each. A null column counts as ``-``. An empty table gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from embedspark.llm.common import discard, recording, written

ARITY, LOCAL_LEVELS = 8, 3
SPAN = ARITY**LOCAL_LEVELS
_PATH = "before array<string>, after array<string>, subroot string, root string"


def digest_of(columns: list[Column]) -> Column:
    """SHA-256 (hex) of columns in turn: ``-`` for null, else the length in UTF-8 bytes, ``:`` and the value."""

    def field(column: Column) -> Column:
        text = column.cast("string")
        return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def _hash(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def reduced(nodes: list[str], total: int) -> list[list[str]]:
    """The levels of a superblock, its nodes first. Only a tree of a single superblock ends with its root."""
    levels = [nodes]
    while len(levels) <= LOCAL_LEVELS if total > SPAN else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_hash("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return levels


def _siblings(level: list[str]) -> list[tuple[str, str]]:
    """What stands before and after each node in its run."""
    runs = (level[i : i + ARITY] for i in range(0, len(level), ARITY))
    return [("".join(run[:i]), "".join(run[i + 1 :])) for run in runs for i in range(len(run))]


def paths(nodes: list[str], total: int) -> Iterator[list[tuple[str, str]]]:
    """For each node of a superblock its siblings, level by level, inside the superblock."""
    levels = [_siblings(level) for level in reduced(nodes, total)[:-1]]
    return ([level[i // ARITY**up] for up, level in enumerate(levels)] for i in range(len(nodes)))


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that follows from a leaf and its siblings."""
    for before, after in path:
        leaf = _hash(before + leaf + after)
    return leaf


def _numbered(nodes: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Adds ``rank`` in the tree and the tree's ``total``; also returns the largest total."""
    dealt = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    stored = written(dealt.withColumn("place", F.monotonically_increasing_id()))
    stored = stored.withColumn("range", F.shiftright("place", 33))
    ranges = stored.groupBy("tree", "range").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")  # at most one row a range
    before = F.coalesce(F.sum("n").over(tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = written(ranges.select("tree", "range", (F.col("first") - before).alias("shift"), F.sum("n").over(tree).alias("total")))
    most = ranges.agg(F.max("total")).first()[0] or 0
    numbered = stored.join(ranges, ["tree", "range"]).withColumn("rank", F.col("place") - F.col("shift"))
    return numbered.drop("place", "range", "shift"), most


def _with_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("rank") / SPAN))


def _roots_of_blocks(nodes: DataFrame) -> DataFrame:
    """One node for each superblock."""

    def reduce_block(key, block):
        block, total = block.sort_values("rank"), int(block["total"].iloc[0])
        top = reduced([d.hex() for d in block["digest"]], total)[-1]
        return pd.DataFrame([(key[0], key[1], bytes.fromhex(top[0]), -(-total // SPAN))], columns=["tree", "rank", "digest", "total"])

    plain = _with_block(nodes).select("tree", "block", "rank", "digest", "total")
    return plain.groupBy("tree", "block").applyInPandas(reduce_block, "tree string, rank bigint, digest binary, total bigint")


def _ascend(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The tables of nodes from the leaves up, each reduced to superblocks, and the roots of the trees."""
    tables, roots = [nodes], None
    while True:
        above = written(_roots_of_blocks(tables[-1]))
        most = -(-most // SPAN)
        done = above.where("total = 1").select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        if most <= 1:
            return tables, roots
        tables.append(above.where("total > 1"))


def _descend(tables: list[DataFrame], tops: DataFrame, finish, schema: str) -> DataFrame:
    """Cogroups each table of nodes, from the top down, with the outer nodes of its superblocks.

    ``tops``: tree and the path above its root. ``finish`` makes the rows of the lowest table.
    """

    def outer_of_nodes(key, block: pd.DataFrame, path) -> pd.DataFrame:
        ranks, own = block["rank"].tolist(), paths([d.hex() for d in block["digest"]], int(block["total"].iloc[0]))
        rows = [
            (key[0], rank, [b for b, _ in local] + path[0], [a for _, a in local] + path[1], path[2], path[3])
            for rank, local in zip(ranks, own)
        ]
        return pd.DataFrame(rows, columns=["tree", "block", "before", "after", "subroot", "root"])

    def joined(make):
        def exchange(key, block, outer):
            own = outer.iloc[0]
            path = list(own["before"]), list(own["after"]), own["subroot"], own["root"]
            return make(key, block.sort_values("rank"), path)

        return exchange

    below = None
    for number, nodes in reversed(list(enumerate(tables))):
        # The single superblock of a tree that ends at this table has the tree's own path above it.
        single = nodes.where(f"rank = 0 AND total <= {SPAN}").select(F.col("tree").alias("tree"))
        outer = single.join(tops, "tree").select("tree", F.lit(0).cast("bigint").alias("block"), "before", "after", "subroot", "root")
        if below is not None:
            outer = outer.unionByName(below)
        make, kind = (finish, schema) if number == 0 else (outer_of_nodes, f"tree string, block bigint, {_PATH}")
        blocks = _with_block(nodes).groupBy("tree", "block")
        below = blocks.cogroup(outer.groupBy("tree", "block")).applyInPandas(joined(make), kind)
        if number:
            below = written(below)
    return below


def manifest(docs: DataFrame, tree: Column, key: Column, leaf: Column, claimed: Column | None = None) -> DataFrame:
    """Per row: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``leaf`` is the recorded digest (hex) of a row. ``claimed``, if it isn't null, is the digest whose proof is folded in
    its place, such as that of the row as it is found later. ``verified`` tells whether the fold gives the root.
    """
    claim = F.lit(None).cast("binary") if claimed is None else F.unhex(claimed)
    with recording() as folders:
        rows = docs.select(
            F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit("-")).alias("tree"),
            key.alias("key"),
            F.unhex(leaf).alias("digest"),
            claim.alias("claim"),
            F.monotonically_increasing_id().alias("row"),
        )
        leaves, most = _numbered(written(rows), ["key", "digest", "row"])
        kind = leaves.schema["key"].dataType.simpleString()
        # As text, because pandas would turn whole numbers with nulls into fractions.
        leaves = written(leaves.drop("row").withColumn("key", F.col("key").cast("string")))
        tables, subroots = _ascend(leaves, most)
        # The roots of the trees are the leaves of the one tree above them.
        heads = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
        heads, most = _numbered(heads, ["name"])
        heads = written(heads)
        head_tables, roots = _ascend(heads, most)

        def head_paths(_, block: pd.DataFrame, path) -> pd.DataFrame:
            digests = [d.hex() for d in block["digest"]]
            local = paths(digests, int(block["total"].iloc[0]))
            rows = [
                (name, [b for b, _ in own] + path[0], [a for _, a in own] + path[1], digest, path[3])
                for name, digest, own in zip(block["name"], digests, local)
            ]
            return pd.DataFrame(rows, columns=["tree", "before", "after", "subroot", "root"])

        empty = F.array().cast("array<string>")
        top = roots.select("tree", empty.alias("before"), empty.alias("after"), F.lit("").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
        tops = written(_descend(head_tables, top, head_paths, f"tree string, {_PATH}"))

        def prove(_, block: pd.DataFrame, path) -> pd.DataFrame:
            digests = [d.hex() for d in block["digest"]]
            outer = list(zip(path[0], path[1]))
            above, root = "".join(b + a for b, a in outer), path[3]
            rows = []
            local = paths(digests, int(block["total"].iloc[0]))
            for digest, other, own in zip(digests, block["claim"], local):
                proof = _hash("".join(b + a for b, a in own) + above)
                folded = fold(digest if other is None else other.hex(), own + outer)
                rows.append((digest, path[2], root, proof, folded, folded == root))
            found = pd.DataFrame(rows, columns=["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
            found.insert(0, "key", block["key"].to_numpy())
            return found

        schema = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        result = written(_descend(tables, tops, prove, schema).withColumn("key", F.col("key").cast(kind)))
        discard(docs.sparkSession, folders, keep=(result,))
    return result
