"""Training batch plans as rows (batch_id, slot, row)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.operators.sampling import before, placed
from tallyforge.sources.staging import staged


def covered(rows: DataFrame, key: str, dataset: str, batch_size: int, label: str = "label", seed: int = 42) -> DataFrame:
    """batch_id, kind, key: every batch has one attack (label 1) of each attack dataset, then attacks up to half, then live rows; the tail is dropped.

    Batch b takes the row at place b, cyclically, of each dataset's keyed order, and the next places of the orders of all attacks
    and of all live rows; attacks that the batch has already are passed over. Orders, not loops, decide.
    """
    half = batch_size // 2
    sizes = rows.groupBy(label, dataset).agg(F.count("*").alias("n")).collect()  # a row per dataset and label
    names = sorted(r[dataset] for r in sizes if r[label] == 1)
    n_all, n_attack = sum(r["n"] for r in sizes), sum(r["n"] for r in sizes if r[label] == 1)
    if not names or len(names) > batch_size:
        raise ValueError(f"{len(names)} attack datasets for batches of {batch_size}")
    extra = max(0, half - len(names))
    live, n_batches = batch_size - len(names) - extra, n_all // batch_size
    n_live = n_all - n_attack
    if live > n_live or extra + len(names) > n_attack or not n_batches:
        raise ValueError("a class is too small for this batch size")
    batches = rows.sparkSession.range(n_batches).withColumnRenamed("id", "batch_id")

    def stream(own: DataFrame, n: int, take: int, step: int, kind: str) -> DataFrame:
        """The take places from batch_id * step on of an order of n rows."""
        asked = batches.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(take - 1).cast("long")))).withColumn("place", F.pmod(F.col("batch_id") * step + F.col("at"), F.lit(n)))
        return asked.join(own.select(F.col(key), "place"), "place").select("batch_id", F.lit(kind).alias("kind"), "at", key)

    attacks = rows.where(F.col(label) == 1)
    by_set = placed(attacks, key, seed, [dataset]).join(attacks.groupBy(dataset).agg(F.count("*").alias("_n")), dataset)
    # row i of a dataset of n rows serves the batches i, i + n, ...
    cover = by_set.where(F.col("place") < n_batches).withColumn("batch_id", F.explode(F.sequence(F.col("place"), F.lit(n_batches - 1).cast("long"), F.col("_n")))).select("batch_id", F.lit("cover").alias("kind"), F.lit(0).cast("long").alias("at"), key)
    out = cover
    if extra:
        more = stream(placed(attacks, key, f"{seed}-attack"), n_attack, extra + len(names), extra, "attack").join(cover.select("batch_id", key), ["batch_id", key], "left_anti")
        more = more.withColumn("_i", F.row_number().over(W.partitionBy("batch_id").orderBy("at"))).where(F.col("_i") <= extra).drop("_i")
        out = out.unionByName(more)
    if live:
        out = out.unionByName(stream(placed(rows.where(F.col(label) == 0), key, f"{seed}-live"), n_live, live, live, "live"))
    return out.drop("at")


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit over counts[size] units, largest first, into batches of capacity. Rows: size, first rank, units, first batch: rank + i goes to batch + i.

    Batches that are equally full are classes of consecutive runs; a size takes the tightest class that it fits, a unit for each of its batches at a
    time, and what fits nowhere opens batches with as many of its size as they hold. There are a few rows for each pair of sizes.
    """
    open_: dict[int, list[tuple[int, int]]] = {}
    rows, batches = [], 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = min((r for r, runs in open_.items() if r >= size and runs), default=None)
            if room is None:
                each = capacity // size
                first, n, room = batches, -(-left // each), capacity
                batches += n
            else:
                first, n = open_[room].pop()
            for _ in range(room // size):
                m = min(n, left)
                if m:
                    rows.append((size, rank, m, first))
                    if m < n:  # the batches that get no more of this size
                        open_.setdefault(room, []).append((first + m, n - m))
                    n, rank, left, room = m, rank + m, left - m, room - size
            open_.setdefault(room, []).append((first, n))
    return np.array(rows, np.int64).reshape(-1, 4)


def unit_batches(units: DataFrame, batch_size: int, seed: int) -> DataFrame:
    """units (unit, part, size) with batch_id: best fit over the histogram of sizes, and units by their rank within their size."""
    counts = {r["size"]: r["n"] for r in units.groupBy("size").agg(F.count("*").alias("n")).collect()}  # batch_size rows at most
    table = best_fit(counts, batch_size)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    keys = table[:, 0] << 44 | table[:, 1]

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            row = table[np.searchsorted(keys, pdf["size"].to_numpy() << 44 | pdf["place"].to_numpy(), side="right") - 1]
            yield pdf[["unit", "part"]].assign(batch_id=row[:, 3] + pdf["place"].to_numpy() - row[:, 1])

    ranked = placed(units.withColumn("_u", F.concat_ws("|", "unit", "part")), "_u", seed, ["size"])
    kind = units.schema["unit"].dataType.simpleString()
    return ranked.select("unit", "part", "size", "place").mapInPandas(fill, f"unit {kind}, part long, batch_id long")


def spread(n_own: int, n_other: int, place: Column, first: bool) -> Column:
    """The place of the place-th of n_own rows when n_own and n_other rows are dealt evenly into one order; of equal shares, rows of the first kind lead."""
    if not n_other:
        return place
    odd = (2 * place + 1) * n_other
    before = F.ceil((odd - n_own) / F.lit(2 * n_own)) if first else F.floor((odd - n_own) / F.lit(2 * n_own)) + 1
    return place + F.least(F.lit(n_other), F.greatest(F.lit(0), before))


def source_pairs(rows: DataFrame, key: str, source: str, batch_size: int, label: str = "label", seed: int = 42, batches_a_part: int = 10_000) -> DataFrame:
    """batch_id, slot, key, repeated: a source and the rows that point to it share a batch; other rows fill up, steered to the label share; padding repeats rows.

    Units are a source with at most batch_size - 1 of its rows; a wider group is cut, each part with the source. All units are packed by best fit over
    the histogram of their sizes. What room that leaves is numbered over all batches, by label, and the n-th free row of a label takes the n-th slot; free rows that
    are left make further batches, of which only the last isn't full. So rows are repeated (each batch's own excepted) only in that last batch, unless
    there are fewer free rows than room. Every row is used; keys are distinct and not null; labels are 0 or 1. Building the result runs jobs.
    """
    if batch_size < 2:
        raise ValueError("a batch holds two rows at least")
    linked = rows.where(F.col(source).isNotNull()).select(F.col(key).alias("row"), F.col(source).alias("unit"), F.col(label).alias("label"))
    # a source's rows are ranked in two levels: it may have very many
    part = F.floor(F.col("place") / (batch_size - 1)).cast("long")
    kids = placed(linked, "row", seed, ["unit"]).withColumn("part", part).drop("place")
    heads = kids.select("unit", "part").distinct().join(rows.select(F.col(key).alias("unit"), F.col(label).alias("label")), "unit").select(F.col("unit").alias("row"), "unit", "label", "part")
    in_unit = staged(kids.select("row", "unit", "label", "part").unionByName(heads), "units")
    units = unit_batches(in_unit.groupBy("unit", "part").agg(F.count("*").alias("size")), batch_size, seed)
    # two parts of a source may meet, and a linked row may be a source itself
    bound = in_unit.join(units, ["unit", "part"]).groupBy("batch_id", "row").agg(F.first("label").alias("label"))
    bound = staged(bound, "bound")
    everything = rows.select(F.col(key).alias("row"), F.col(label).cast("int").alias("label"))
    free = staged(placed(everything.join(bound.select("row").distinct(), "row", "left_anti"), "row", seed, ["label"]), "free")
    n_free = {r["label"]: r["n"] for r in free.groupBy("label").agg(F.count("*").alias("n")).collect()}
    whole = everything.agg(F.count("*").alias("n"), F.coalesce(F.avg("label"), F.lit(0.0)).alias("share")).first()
    # room of each batch, and how much of it label 1 should get
    room = bound.groupBy("batch_id").agg(F.count("*").alias("size"), F.sum("label").cast("long").alias("ones"))
    need1 = F.least(F.greatest(F.bround(F.lit(whole["share"] * batch_size), 0).cast("long") - F.col("ones"), F.lit(0)), batch_size - F.col("size"))
    room = room.select("batch_id", "size", need1.alias("need1"), (batch_size - F.col("size") - need1).alias("need0"), F.floor(F.col("batch_id") / batches_a_part).alias("_part"), F.lit(0).alias("_all"))
    room = staged(before(room, "_all", ["batch_id"], "_part", {"at1": F.col("need1"), "at0": F.col("need0")}), "room")
    sums = room.agg(F.coalesce(F.sum("need1"), F.lit(0)).alias("s1"), F.coalesce(F.sum("need0"), F.lit(0)).alias("s0"), F.coalesce(F.max("batch_id") + 1, F.lit(0)).alias("n")).first()
    s, have = {1: sums["s1"], 0: sums["s0"]}, {y: n_free.get(y, 0) for y in (0, 1)}
    filled, over = {y: min(s[y], have[y]) for y in (0, 1)}, {y: max(0, have[y] - s[y]) for y in (0, 1)}
    short = {y: s[y] - filled[y] for y in (0, 1)}
    # slots: label, the number among the label's slots, the batch; those that their label can't fill are numbered on
    slots = room.select("batch_id", F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.col(f"at{y}").alias("at"), F.col(f"need{y}").alias("n")) for y in (1, 0)])).alias("s")).where("s.n > 0")
    slots = slots.select("batch_id", "s.y", F.explode(F.sequence(F.col("s.at"), F.col("s.at") + F.col("s.n") - 1)).alias("number"))
    y1 = F.col("y") == 1
    own = F.when(y1, F.col("number") < filled[1]).otherwise(F.col("number") < filled[0])
    slots = slots.withColumn("spare", F.when(~own, F.when(y1, F.col("number") - filled[1]).otherwise(F.col("number") - filled[0] + short[1])))
    slots = slots.select("batch_id", F.when(own, F.col("y")).otherwise(2).alias("kind"), F.coalesce("spare", "number").alias("number"))
    # free rows: the first of each label take its slots, the others what is short, then new batches with both labels dealt evenly
    place, first = F.col("place"), F.col("label") == 1
    extra = F.when(first, spread(over[1], over[0], place - s[1], True)).otherwise(spread(over[0], over[1], place - s[0], False))
    takes = F.when(first, place < s[1]).otherwise(place < s[0])
    offered = free.withColumn("kind", F.when(takes, F.col("label")).otherwise(2)).withColumn("number", F.when(takes, place).otherwise(extra).cast("long"))
    gaps = short[0] + short[1]
    settled = offered.join(slots, ["kind", "number"]).select("batch_id", "row")
    fresh = offered.where((F.col("kind") == 2) & (F.col("number") >= gaps)).select((F.floor((F.col("number") - gaps) / batch_size) + sums["n"]).cast("long").alias("batch_id"), "row")
    plan = staged(bound.select("batch_id", "row").unionByName(settled).unionByName(fresh), "plan")
    # what is still open is padded with rows from a place of the batch's own in keyed order: as many candidates as a batch has rows hold enough others
    total = whole["n"]
    open_ = plan.groupBy("batch_id").agg(F.count("*").alias("size")).where(F.col("size") < batch_size)
    spare = placed(everything.select("row"), "row", f"{seed}-spare").withColumnRenamed("place", "candidate")
    tried = F.explode(F.sequence(F.lit(0), F.lit(max(0, min(batch_size, total) - 1))))
    asked = open_.withColumn("try", tried).withColumn("candidate", F.pmod(F.xxhash64("batch_id") % max(1, total) + F.col("try"), F.lit(max(1, total)))) if total else open_.limit(0).withColumn("try", F.lit(0)).withColumn("candidate", F.lit(0).cast("long"))
    padding = asked.join(spare, "candidate").join(plan.select("batch_id", "row"), ["batch_id", "row"], "left_anti")
    padding = padding.withColumn("_n", F.row_number().over(W.partitionBy("batch_id").orderBy("try"))).where(F.col("_n") <= batch_size - F.col("size")).select("batch_id", "row", F.lit(True).alias("repeated"))
    done = plan.withColumn("repeated", F.lit(False)).unionByName(padding)
    slot = F.row_number().over(W.partitionBy("batch_id").orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("row").cast("string"))), "row")) - 1
    return done.select("batch_id", slot.cast("int").alias("slot"), F.col("row").alias(key), "repeated")


def pair_report(plan: DataFrame, rows: DataFrame, key: str, source: str) -> DataFrame:
    """n_linked, together (linked rows that share a batch with their source), n_repeated, n_unused."""
    linked = rows.where(F.col(source).isNotNull()).select(key, F.col(source).alias("_s"))
    p = plan.select("batch_id", key).distinct()
    met = p.join(linked, key).join(p.select("batch_id", F.col(key).alias("_s")), ["batch_id", "_s"], "left_semi").select(key).distinct()
    used = plan.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d"))
    return used.select(F.lit(0).alias("_one"), (F.col("n") - F.col("d")).alias("n_repeated"), F.col("d").alias("_used")).join(rows.agg(F.count("*").alias("_all"), F.count(source).alias("n_linked")).withColumn("_one", F.lit(0)), "_one").join(met.agg(F.count("*").alias("together")).withColumn("_one", F.lit(0)), "_one").select("n_linked", "together", "n_repeated", (F.col("_all") - F.col("_used")).alias("n_unused"))


def steps(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count_distinct("batch_id").alias("steps"))
