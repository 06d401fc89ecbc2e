"""Sharding by a hierarchical weighted hash tree.

Shards are leaves of a tree of regions, racks and shards. A row descends from
the root: at each level every child draws ``-ln(u) / weight`` with ``u`` hashed
from the row's key and the child's name, and the least draw wins, so a child is
taken in proportion to its weight. A change of weights below one child moves
rows only into or out of that child's subtree: the other draws stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one numbering group should hold; groups grow in number with the input.
SLOT_GROUP_ROWS = 50_000


@dataclass(frozen=True)
class Node:
    """A node of the tree: a leaf has a shard number, an inner node has children."""

    name: str
    weight: float
    shard: int | None = None
    children: tuple[Node, ...] = ()


def leaf(name: str, shard: int, weight: float = 1.0) -> Node:
    return Node(name, float(weight), shard)


def inner(name: str, children: list[Node]) -> Node:
    """A node whose weight is the sum of its children's."""
    return Node(name, sum(c.weight for c in children), None, tuple(children))


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> Node:
    """Regions of ``racks`` racks of ``per_rack`` shards, filled in order; the last region and rack may have fewer."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    size = per_rack * racks
    regions = []
    for r, start in enumerate(range(0, shards, size)):
        ids = range(start, min(start + size, shards))
        by_rack = [ids[k : k + per_rack] for k in range(0, len(ids), per_rack)]
        regions.append(inner(f"r{r}", [inner(f"r{r}k{k}", [leaf(f"s{s}", s) for s in rack]) for k, rack in enumerate(by_rack)]))
    return inner("root", regions)


def grow(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own.

    No other weight changes, so the new shard takes rows only into itself, from
    any tree and time after time. A shard put into a rack that is there raises
    the weights above it, and rows move into all of that region instead.
    """
    new = 1 + max(_shards(tree))
    return inner(tree.name, [*tree.children, inner(f"own{new}", [leaf(f"s{new}", new, weight)])])


def _shards(node: Node) -> list[int]:
    return [node.shard] if node.shard is not None else [s for c in node.children for s in _shards(c)]


def _draw(key: Column, node: Node) -> Column:
    """-ln(u)/weight with u in (0, 1] from 52 bits of an md5."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{node.name}"))), 1, 13), 16, 10).cast("bigint")
    return -F.log((bits + F.lit(1)) / F.lit(float(1 << 52))) / F.lit(node.weight)


def descend(key: Column, tree: Node) -> Column:
    """The shard that a string key reaches, as INT. Children of weight 0 are never taken."""

    def below(node: Node) -> Column:
        if node.shard is not None:
            return F.lit(node.shard)
        kids = [c for c in node.children if c.weight > 0]
        if len(kids) == 1:
            return below(kids[0])
        draws = [F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(kids)]
        won = F.array_min(F.array(*draws)).getField("i")
        out = below(kids[-1])
        for i, c in reversed(list(enumerate(kids[:-1]))):
            out = F.when(won == i, below(c)).otherwise(out)
        return out

    return below(tree)


def assign_shards(df: DataFrame, tree: Node, grown: Node | None = None, id_col: str = "doc_id", text_col: str = "text", rows: int | None = None) -> DataFrame:
    """Place each row in a shard and number the rows within each shard.

    Returns doc_id, size (UTF-8 bytes plus 1; 1 for a null text), text_crc32,
    law, shard, slot, grown_shard. A null id is the key ``null``: such rows share
    a shard. Repeated rows share a shard and get slots of their own; an empty
    table gives an empty result; extra columns are not read. Slots run from 0
    within a shard, by hash group and then id. ``rows`` (counted when not given)
    sets the number of numbering groups, so no task numbers a whole shard.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    placed = df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(text_col), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(key, tree).alias("shard"),
        (descend(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    rows = df.count() if rows is None else rows
    groups = max(1, rows // SLOT_GROUP_ROWS)
    # repeated rows of one id are spread too, by what else is in them
    placed = placed.withColumn("__group", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(groups)))
    sizes = placed.groupBy("shard", "__group").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("shard", "__group").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("__row", F.row_number().over(within))
    return numbered.join(starts, ["shard", "__group"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("__start") + F.col("__row") - 1).cast("bigint").alias("slot"), "grown_shard"
    )
