"""A Merkle manifest of a dataset by time-forward processing.

Rows are leaves, in the order of their key within each group; nodes meet in runs of two, level by level, up to the group's subroot, and the
subroots likewise up to the root.

1. Digests of rows are taken in the JVM. Places within the groups come from one sort by ranges, lifted by the counts of the ranges before.
2. Blocks of 2^BITS neighbouring nodes are swept in the order of their nodes' labels (the last leaf below, then the level: children before
   parents). A priority queue by label holds the digests on their way to parents, one for each level at most. The shuffle, sorted by group, block
   and place, is the queue between blocks: what a block's top is goes to the next round, with a 2^BITS-th of the rows.
3. A reversed sweep, from the root's block down, delivers to each node the proof suffix above it: its sibling, then its parent's suffix.

No task holds more than a block, whatever the size of a group, and the driver sees the root and the number of rounds only.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.shared import read, short_batches, staged

#: Levels of a block: a task has 2^BITS nodes of a group at a time.
BITS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
Path = list[tuple[str, str]]


def digest(fields: list[Column]) -> Column:
    """sha256 of the fields one after the other: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def parent(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def levels(size: int, bits: int) -> int:
    """Levels that a block of a group of size nodes has above them."""
    return bits if size > 1 << bits else (size - 1).bit_length()


def sweep_up(leaves: list[str], height: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """The top of a block, and of each inner node (last leaf, level) its children's digests."""
    n, queue, kids = len(leaves), [], {}

    def deliver(level: int, i: int, value: str) -> None:
        """To node i >> 1 of the level above; its label comes after those of all nodes below it."""
        heapq.heappush(queue, (min((i >> 1) + 1 << level + 1, n) - 1, level + 1, i, value))

    if not height:
        return leaves[0], kids
    top = ""
    for i, value in enumerate(leaves):
        deliver(0, i, value)
        while queue and queue[0][0] <= i:  # all children of this node have been heard
            last, level, child, value = heapq.heappop(queue)
            own = [value]
            while queue and queue[0][:2] == (last, level):
                own.append(heapq.heappop(queue)[3])
            kids[last, level] = own
            top = parent(own)
            if level < height:
                deliver(level, child >> 1, top)
    return top, kids


def sweep_down(n: int, height: int, kids: dict[tuple[int, int], list[str]]) -> list[tuple | None]:
    """Of each leaf the chain (side of the sibling, sibling, rest of the chain) up to the block's top."""
    out: list[tuple | None] = [None] * n
    queue = [(-(n - 1), -height, 0, 0, None)] if height else []  # the number keeps chains out of comparisons
    sent = 0
    while queue:
        last, level, i, _, above = heapq.heappop(queue)
        own, level = kids[-last, -level], -level - 1
        for k in range(len(own)):
            child = 2 * i + k
            chain = ("LR"[1 - k], own[1 - k], above) if len(own) > 1 else ("-", "", above)
            if level:
                sent += 1
                heapq.heappush(queue, (-(min(child + 1 << level, n) - 1), -level, child, sent, chain))
            else:
                out[child] = chain
    return out


def unchained(chain: tuple | None, rest: Path) -> Path:
    out = []
    while chain:
        out.append(chain[:2])
        chain = chain[2]
    return out + rest


def encoded(path: Path) -> str:
    """A proof as text, from the leaf to the root: L or R (where the sibling stands) and its digest, or - for none; comma-joined."""
    return ",".join(side + value for side, value in path)


def decoded(text: str) -> Path:
    return [(x[0], x[1:]) for x in text.split(",")] if text else []


def folded(value: str, path: Path) -> str:
    """The root that follows from a leaf and its proof."""
    for side, other in path:
        value = parent([other, value] if side == "L" else [value, other])
    return value


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Runs of rows of one (tree, block)."""
    own: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if own and (own[0]["tree"], own[0]["block"]) != (row["tree"], row["block"]):
                yield own
                own = []
            own.append(row)
    if own:
        yield own


def made(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def by_block(rows: DataFrame, bits: int) -> DataFrame:
    return rows.withColumn("block", F.shiftright("pos", bits)).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def tops(nodes: DataFrame, bits: int) -> DataFrame:
    """tree, pos, size, value of the next round's nodes: the top of each block."""
    schema = pa.schema({"tree": pa.string(), "pos": pa.int64(), "size": pa.int64(), "value": pa.binary()})

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for own in blocks_of(batches):
            size = own[0]["size"]
            top, _ = sweep_up([r["value"].hex() for r in own], levels(size, bits))
            out.append((own[0]["tree"], own[0]["block"], -(-size >> bits) if size > 1 << bits else 1, bytes.fromhex(top)))
            if len(out) == 1000:
                yield made(out, schema)
                out = []
        if out:
            yield made(out, schema)

    return by_block(nodes.select("tree", "pos", "size", "value"), bits).mapInArrow(sweep, "tree string, pos long, size long, value binary")


def delivered(nodes: DataFrame, above: DataFrame, bits: int, out: Callable[[dict, str, Path], tuple], schema: str) -> DataFrame:
    """out(node, subroot, proof) of each node; above: tree, pos, subroot, suffix of each block's top."""
    extra = [c for c in nodes.columns if c not in ("tree", "pos")]
    # a block's suffix comes before its nodes
    message = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "subroot", "suffix", *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in extra])
    node = nodes.select("tree", F.shiftright("pos", bits).alias("block"), "pos", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("suffix"), *extra)
    both = message.unionByName(node).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    kinds = nodes.sparkSession.createDataFrame([], schema).schema
    arrow = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in kinds])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for first, *own in blocks_of(batches):
            height = levels(own[0]["size"], bits)
            _, kids = sweep_up([r["value"].hex() for r in own], height)
            rest, subroot = decoded(first["suffix"]), first["subroot"]
            for row, chain in zip(own, sweep_down(len(own), height, kids), strict=True):
                done.append(out(row, subroot, unchained(chain, rest)))
                if len(done) == 1000:
                    yield made(done, arrow)
                    done = []
        if done:
            yield made(done, arrow)

    return both.mapInArrow(sweep, schema)


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows (with tree) with pos, from 0 in the order within each tree, and size, the tree's rows. Equal rows take their places in any order."""
    ranges = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie").drop("tie")
    ranged = staged(ranges.withColumn("part", F.spark_partition_id()).withColumn("line", F.monotonically_increasing_id()), name)
    counts = ranged.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    whole = W.partitionBy("tree")  # as many rows as there are ranges, at most
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lifts = counts.select("tree", "part", (before - F.col("first")).alias("lift"), F.sum("n").over(whole).alias("size"))
    return ranged.join(lifts, ["tree", "part"]).withColumn("pos", F.col("line") + F.col("lift")).drop("part", "line", "lift")


def climbed(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """The nodes of each round, up to one for each tree."""
    rounds = [nodes]
    size = nodes.agg(F.max("size").alias("n")).first()["n"] or 0
    while True:
        rounds.append(staged(tops(rounds[-1], bits), "merkle-tops"))
        if size <= 1 << bits:
            return rounds
        size = -(-size >> bits)


def descended(rounds: list[DataFrame], above: DataFrame, bits: int) -> DataFrame:
    """tree, pos, subroot, suffix of the tops of the first round's blocks, from above, which has them for each tree's top."""
    for nodes in rounds[-2:0:-1]:
        above = staged(delivered(nodes, above, bits, lambda r, s, path: (r["tree"], r["pos"], s, encoded(path)), "tree string, pos long, subroot string, suffix string"), "merkle-suffixes")
    return above


def manifest(leaves: DataFrame, order: list[str], bits: int = BITS, with_proofs: bool = False) -> DataFrame:
    """The manifest of leaves: columns tree (the group as text, null allowed), order, leaf and claimed (32-byte digests; claimed may be null).

    Returns the order columns, leaf, subroot, root, proof_sha256 (of the siblings' digests from the leaf to the root), folded_root
    (from claimed, else leaf, and the proof), verified (folded_root equals root), all digests as lowercase hex, and proof (see `encoded`) if
    asked for. Leaves ascend by the order columns (nulls first), then by digest; a null tree is a group of its own, before all others. A
    lone leaf is its group's subroot, a lone subroot the root. An empty table gives an empty result.
    """
    trees = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), "tree"), F.lit("")))
    nodes = placed(trees.withColumnRenamed("leaf", "value"), [*order, "value"], "merkle-leaves")
    rounds = climbed(nodes, bits)
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "value")
    top_nodes = placed(subroots, ["name"], "merkle-subroots")
    top_rounds = climbed(top_nodes, bits)
    top = top_rounds[-1].first()
    root = top["value"].hex() if top else ""
    above = top_rounds[-1].select("tree", "pos", F.lit("").alias("subroot"), F.lit("").alias("suffix"))
    above = delivered(top_nodes, descended(top_rounds, above, bits), bits, lambda r, _, path: (r["name"], 0, r["value"].hex(), encoded(path)), "tree string, pos long, subroot string, suffix string")
    above = descended(rounds, staged(above, "merkle-suffixes"), bits)
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["proof"] * with_proofs

    def finish(row: dict, subroot: str, path: Path) -> tuple:
        leaf = row["value"].hex()
        back = folded(row["claimed"].hex() if row["claimed"] else leaf, path)
        return (row["pos"], row["tree"], leaf, subroot, root, parent([v for _, v in path]), back, back == root, *([encoded(path)] if with_proofs else []), *[row[c] for c in order])

    kinds = ", ".join(f"{c} {'boolean' if c == 'verified' else 'string'}" for c in names)
    own = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in order)
    return delivered(nodes, above, bits, finish, f"pos long, tree string, {kinds}, {own}").select(*order, *names)


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (lang), leaf and claimed of each document. Where 7 divides the crc32 of doc_id, claimed is the leaf with n_chars raised by 1.

    A null n_chars stays null, and a row without doc_id isn't tampered with: both claim their own leaf. Only the columns of FIELDS count.
    """
    fields = {c: F.col(c) for c in FIELDS}
    raised = fields | {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("tree"), digest(list(fields.values())).alias("leaf"), F.when(tampered, digest(list(raised.values()))).alias("claimed"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    short_batches(spark)
    # digests once: the sort by ranges reads its input twice
    return manifest(staged(document_leaves(docs), "merkle-digests"), ["doc_id"])


FIELD_SQL = " || ".join(f"coalesce(strlen({{{c}}}::VARCHAR) || ':' || {{{c}}}::VARCHAR, '-')" for c in FIELDS)
CRC = "xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
PLAIN = {c: c for c in FIELDS}
SQL = f"""WITH RECURSIVE leaves AS (SELECT doc_id, lang, sha256({FIELD_SQL.format(**PLAIN)}) AS leaf,
  CASE WHEN n_chars IS NOT NULL AND ({CRC}) % 7 = 0 THEN sha256({FIELD_SQL.format(**PLAIN | {"n_chars": "(n_chars::HUGEINT + 1)"})}) END AS claimed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
up AS (SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY lang
  UNION ALL SELECT lang, level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM up WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM up WHERE len(nodes) = 1),
over AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL SELECT level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM over WHERE len(nodes) > 1),
tops AS (SELECT nodes[1] AS root FROM over WHERE len(nodes) = 1),
steps AS (SELECT p.lang, p.pos, u.level, p.pos >> u.level AS i, u.nodes FROM placed p JOIN up u ON u.lang IS NOT DISTINCT FROM p.lang AND len(u.nodes) > 1
  UNION ALL SELECT p.lang, p.pos, 1000 + o.level, s.place >> o.level, o.nodes FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN over o ON len(o.nodes) > 1),
paths AS (SELECT lang, pos, list({{'level': level, 'left': i % 2, 'other': coalesce(nodes[xor(i, 1) + 1], '')}} ORDER BY level) AS path FROM steps GROUP BY lang, pos),
found AS (SELECT p.doc_id, p.leaf, s.subroot, t.root, coalesce(list_transform(x.path, lambda e: e.other), []) AS others, coalesce(list_transform(x.path, lambda e: e.left), []) AS lefts, coalesce(p.claimed, p.leaf) AS claimed
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN tops t LEFT JOIN paths x ON x.lang IS NOT DISTINCT FROM p.lang AND x.pos = p.pos),
folds AS (SELECT *, list_reduce(list_concat([claimed], list_transform(range(0, len(others)), lambda k: CASE WHEN lefts[k + 1] = 1 THEN 'L' ELSE 'R' END || others[k + 1])),
  lambda a, b: sha256(CASE WHEN b[1] = 'L' THEN b[2:] || a ELSE a || b[2:] END)) AS folded_root FROM found)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(others, '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folds"""
