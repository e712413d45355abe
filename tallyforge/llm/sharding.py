"""Sharding by a hierarchical weighted hash tree, all in DataFrame functions.

The tree has regions, racks and shards. A row descends it: at each level every child draws -ln(u) / weight, u being
uniform from a hash of (row key, child's name), and the least draw wins; so a child gets rows in proportion to its weight, and
when weights change, rows move only into subtrees whose weight grew (or out of those whose weight fell). A new shard
comes as a region of its own (one rack, one shard), so no older subtree changes weight and rows move into the new
shard alone. The law is `key`: the doc_id and the number of shards decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.shared import read, staged

SHARDS = 40
#: Rows that one task ranks, about; the number of buckets in which a shard's rows are ranked follows from it.
ROWS_PER_BUCKET = 100_000


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. Its weight is its own (a shard) or the sum of its children's."""

    name: str
    children: tuple[Node, ...] = ()
    own: float = 1.0
    shard: int = -1

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def tree(weights: Sequence[float], racks: int = 4, per_rack: int = 5) -> Node:
    """Shards 0 to len(weights) - 1 in order, per_rack to a rack and racks to a region."""
    shards = [Node(f"s{i}", own=float(w), shard=i) for i, w in enumerate(weights)]
    level = [Node(f"k{i}", tuple(shards[i * per_rack : (i + 1) * per_rack])) for i in range(-(-len(shards) // per_rack))]
    return Node("root", tuple(Node(f"r{i}", tuple(level[i * racks : (i + 1) * racks])) for i in range(-(-len(level) // racks))))


def grown(root: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a new region."""
    n = max((s.shard for s in leaves(root)), default=-1) + 1
    return Node("root", (*root.children, Node(f"r+{n}", (Node(f"k+{n}", (Node(f"s{n}", own=weight, shard=n),)),))))


def leaves(node: Node) -> list[Node]:
    return [x for c in node.children for x in leaves(c)] if node.children else [node] if node.shard >= 0 else []


def depth(node: Node) -> int:
    return 1 + max(map(depth, node.children)) if node.children else 0


def number(name: str) -> int:
    """A node's number in the hashes: it stays as the tree grows."""
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=7).digest(), "little")


def with_shard(rows: DataFrame, key: str, root: Node, out: str) -> DataFrame:
    """rows with the shard in which each key ends, one level of the tree at a time; all leaves are equally deep.

    Children of weight 0 get nothing. Of equal draws the first child's wins.
    """
    level = [root]
    rows = rows.withColumn(out, F.lit(0))
    for left in range(depth(root) - 1, -1, -1):
        below = [c for node in level for c in node.children if c.weight > 0]
        place = {id(c): c.shard if not left else i for i, c in enumerate(below)}
        kids = F.array(*[F.array(*[F.struct(F.lit(number(c.name)).alias("id"), F.lit(c.weight).alias("weight"), F.lit(place[id(c)]).alias("to")) for c in node.children if c.weight > 0]) for node in level])
        # u in (0, 1] from 52 bits of a hash of the key and the child
        draw = lambda c: F.struct(-F.ln((F.shiftrightunsigned(F.xxhash64(F.col(key), c["id"]), 12) + 1) / float(1 << 52)) / c["weight"], c["to"].alias("to"))
        rows = rows.withColumn(out, F.array_min(F.transform(F.get(kids, F.col(out)), draw))["to"])
        level = below
    return rows


def slots(rows: DataFrame, shard: str, order: Sequence[str], per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """rows with slot: 0, 1, ... within each shard, by hash buckets of the order columns and by those within one.

    Each (shard, bucket) is ranked for itself and lifted by the number of rows in the shard's earlier buckets, so no task has a
    whole shard. The counts are the only table that is joined: shards x buckets rows.
    """
    total = rows.count()
    buckets = max(1, -(-total // per_bucket))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = rows.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(shard).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lifts = counts.select(F.col(shard).alias("_shard"), F.col("_bucket").alias("_b"), before.alias("_before"))
    place = F.row_number().over(W.partitionBy(shard, "_bucket").orderBy(*order)) - 1
    joined = rows.withColumn("_place", place).join(lifts, (F.col(shard) == F.col("_shard")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("slot", (F.col("_place") + F.col("_before")).cast("long")).drop("_bucket", "_place", "_shard", "_b", "_before")


def assign(docs: DataFrame, root: Node) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs (doc_id, text).

    size: the text's UTF-8 bytes plus 16. A null text counts as empty; a null doc_id is a key of its own; repeated rows each get a
    slot, in the same shard. An empty table gives an empty result; columns besides doc_id and text are left out.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), key.alias("_key"))
    rows = with_shard(with_shard(rows, "_key", root, "shard"), "_key", grown(root), "grown_shard")
    rows = staged(rows.select("doc_id", "size", "text_crc32", "shard", "grown_shard"), "sharded")
    out = slots(rows, "shard", ("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read(spark, sf_dir, "documents"), tree([1.0] * SHARDS))
