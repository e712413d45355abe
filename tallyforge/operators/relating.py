"""Joins: matching, overlays, exclusions, leakage, registries."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.sources.staging import staged


def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left rows with right's columns and is_matched; right has a row per key."""
    r = right.withColumn("_m", F.lit(True))
    return left.join(r, key, "left").withColumn("is_matched", F.coalesce("_m", F.lit(False))).drop("_m")


def overlay(rows: DataFrame, files: DataFrame, paths: Sequence[str], order: str = "ord") -> DataFrame:
    """rows (id, paths) with score: that of the last file (by order) in which one of the row's paths stands, and n_hits over all files.

    files: path, score, order. A row's distinct paths are exploded, so this is an equi-join, not an OR join.
    """
    keys = rows.select("id", F.explode(F.array_distinct(F.array(*paths))).alias("path"))
    hit = keys.join(files, "path").groupBy("id").agg(F.max_by("score", order).alias("score"), F.count_distinct(order).alias("n_hits"))
    return rows.join(hit, "id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)).cast("long"))


def aligned(rows: DataFrame, table: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """rows with value found by the first path, else by the second; rows without either have null."""
    a, b = table.select(F.col("path").alias(first), F.col(value).alias("_a")), table.select(F.col("path").alias(second), F.col(value).alias("_b"))
    return rows.join(a, first, "left").join(b, second, "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def excluded(rows: DataFrame, tables: Sequence[DataFrame], paths: Sequence[str]) -> DataFrame:
    """rows none of whose paths stands in one of the tables (path)."""
    keys = tables[0].select("path")
    for t in tables[1:]:
        keys = keys.union(t.select("path"))
    keys = keys.distinct()
    for p in paths:
        rows = rows.join(keys.select(F.col("path").alias(p)), p, "left_anti")
    return rows


def source_links(rows: DataFrame) -> DataFrame:
    """outcome, n over rows of label 1 (media_id, source_media_id, label): linked, no_source, not_found, not_live; and duplicate, the media ids that occur again."""
    n = F.row_number().over(W.partitionBy("media_id").orderBy("label"))
    ranked = rows.withColumn("_n", n)
    once = ranked.where("_n = 1").select(F.col("media_id").alias("source_media_id"), F.col("label").alias("_l"))
    j = rows.where("label = 1").join(once, "source_media_id", "left")
    outcome = F.when(F.col("source_media_id").isNull(), "no_source").when(F.col("_l").isNull(), "not_found").when(F.col("_l") != 0, "not_live").otherwise("linked")
    again = ranked.agg(F.count_if(F.col("_n") > 1).alias("n")).select(F.lit("duplicate").alias("outcome"), "n")
    return j.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n")).unionByName(again)


def same_content(train: DataFrame, test: DataFrame, content: str) -> DataFrame:
    """content, n_train, n_test, n_pairs for each content in both sets: counts first, so a hot content is one row and not its pairs."""
    a, b = train.groupBy(content).agg(F.count("*").alias("n_train")), test.groupBy(content).agg(F.count("*").alias("n_test"))
    return a.join(b, content).withColumn("n_pairs", F.col("n_train") * F.col("n_test"))


def near_hashes(train: DataFrame, test: DataFrame, most: int, h: str = "h", spare: int = 4) -> DataFrame:
    """train_hash, test_hash, distance, n_pairs: pairs of distinct 64-bit hashes at most `most` bits apart.

    Of most + spare bands of bits two such hashes share `spare` at least, so an equi-join on (which spare bands, their bits) misses none: the join's
    keys have 64 * spare / (most + spare) bits instead of the 64 / (most + 1) of one band, so that few hashes share one by chance. Equal hashes are one row.
    """
    bands = most + spare
    edges = [i * 64 // bands for i in range(bands + 1)]
    masks = [((1 << edges[i + 1] - edges[i]) - 1) << edges[i] for i in range(bands)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    choices = [signed(sum(masks[i] for i in chosen)) for chosen in combinations(range(bands), spare)]
    cut = F.array(*[F.struct(F.lit(i).alias("band"), F.col("v").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(choices)])
    side = lambda t, name: t.groupBy(F.col(h).alias("v")).agg(F.count("*").alias(f"n_{name}")).select(F.col("v").alias(f"{name}_hash"), f"n_{name}", F.explode(cut).alias("c")).select("*", "c.band", "c.bits").drop("c")
    j = side(train, "train").join(side(test, "test"), ["band", "bits"])
    d = F.bit_count(F.col("train_hash").bitwiseXOR(F.col("test_hash")))
    return j.withColumn("distance", d.cast("int")).where(F.col("distance") <= most).select("train_hash", "test_hash", "distance", (F.col("n_train") * F.col("n_test")).alias("n_pairs")).distinct()


def leaking(train: DataFrame, test: DataFrame, key: str, path: str, session: str, near: int | None = None) -> DataFrame:
    """type, distance, train_hash, test_hash, n_train, n_test, train_file, train_session, test_file, test_session: a row for each pair of hashes that leak.

    type exact: equal keys (distance 0). With near, keys are 64-bit hashes, and type near are different ones at most near bits apart. Files named are the
    first by path of each side; `leaking_files` has all. A hash is one row a side, however many files have it; null keys leak nothing.
    """
    side = lambda t, name: t.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_h")).agg(F.count("*").alias(f"n_{name}"), F.min(F.struct(F.col(path).alias("file"), F.col(session).alias("session"))).alias("_f")).select(F.col("_h").alias(f"{name}_hash"), f"n_{name}", F.col("_f.file").alias(f"{name}_file"), F.col("_f.session").alias(f"{name}_session"))
    a, b = staged(side(train, "train"), "train-hashes"), staged(side(test, "test"), "test-hashes")
    kind = lambda t, name, d: t.select(F.lit(name).alias("type"), d.cast("int").alias("distance"), *LEAK)
    out = kind(a.join(b, F.col("train_hash") == F.col("test_hash")), "exact", F.lit(0))
    if near is not None:
        pairs = near_hashes(a.withColumnRenamed("train_hash", "h"), b.withColumnRenamed("test_hash", "h"), near).where("distance > 0").select("train_hash", "test_hash", "distance")
        out = out.unionByName(kind(pairs.join(a, "train_hash").join(b, "test_hash"), "near", F.col("distance")))
    return out


LEAK = [f"{name}_{what}" for what in ("hash",) for name in ("train", "test")] + ["n_train", "n_test"] + [f"{name}_{what}" for name in ("train", "test") for what in ("file", "session")]


def leaking_files(train: DataFrame, test: DataFrame, leaks: DataFrame, key: str, path: str, session: str, salts: int = 16) -> DataFrame:
    """type, split, session, file, hash, distance, n_partners: every file of every leak, once for each type.

    distance is that of the nearest hash on the other side, n_partners how many hashes leak with the file's. Rows grow with the files. A hash that very many
    files have is dealt over `salts` tasks, where its row of the (far smaller) list of leaking hashes waits.
    """
    out = None
    for name, rows in (("train", train), ("test", test)):
        hashes = leaks.groupBy("type", F.col(f"{name}_hash").alias("hash")).agg(F.min("distance").alias("distance"), F.count("*").alias("n_partners"))
        waiting = hashes.withColumn("_s", F.explode(F.array(*map(F.lit, range(salts)))))
        files = rows.select(F.col(key).alias("hash"), F.col(path).alias("file"), F.col(session).alias("session")).withColumn("_s", F.pmod(F.xxhash64("file"), F.lit(salts)).cast("int"))
        part = files.join(waiting, ["hash", "_s"]).select("type", F.lit(name).alias("split"), "session", "file", "hash", "distance", "n_partners")
        out = part if out is None else out.unionByName(part)
    return out


def first_source(rows: DataFrame, path: str, source_rank: str) -> DataFrame:
    """rows with kept_in: the rank of the first source (by rank) that has the path, which keeps it."""
    return rows.withColumn("kept_in", F.min(source_rank).over(W.partitionBy(path)))


def overlap_counts(rows: DataFrame, path: str, source_rank: str) -> DataFrame:
    """kept_in, dropped_from, n."""
    r = first_source(rows, path, source_rank).where(F.col("kept_in") < F.col(source_rank))
    return r.groupBy("kept_in", F.col(source_rank).alias("dropped_from")).agg(F.count("*").alias("n"))


def unambiguous(rows: DataFrame, domain: str, source: str) -> DataFrame:
    """rows with the source put before a domain name that several sources have."""
    n = rows.groupBy(domain).agg(F.count_distinct(source).alias("_n"))
    return rows.join(n, domain).withColumn(domain, F.when(F.col("_n") > 1, F.concat_ws("/", source, domain)).otherwise(F.col(domain))).drop("_n")


def merged_tags(rows: DataFrame, base: str, own: str) -> Column:
    """Tags of base overlaid by own: own's value wins."""
    b, o = F.coalesce(F.col(base), F.expr("map()").cast("map<string,string>")), F.coalesce(F.col(own), F.expr("map()").cast("map<string,string>"))
    return F.map_concat(F.map_filter(b, lambda k, v: ~F.map_contains_key(o, k)), o)


def session_frames(sessions: DataFrame, frames: DataFrame, session: str) -> DataFrame:
    """A row for each frame of each session, sessions' columns first; inner."""
    return sessions.join(frames, session)


def session_report(sessions: DataFrame, frames: DataFrame, session: str) -> DataFrame:
    """n_sessions, n_empty (without frames), n_frames."""
    n = frames.groupBy(session).agg(F.count("*").alias("_n"))
    return sessions.join(n, session, "left").agg(F.count("*").alias("n_sessions"), F.count_if(F.col("_n").isNull()).alias("n_empty"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_frames"))


def not_yet(remote: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Remote rows whose key isn't local: what an incremental run fetches."""
    return remote.join(local.select(key), key, "left_anti")


def signature(columns: Sequence[str]) -> Column:
    """A digest of the columns' values, for skipping what hasn't changed."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def stale(current: DataFrame, stored: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, changed: rows whose signature is new, with the names of the columns that differ from the stored row (all, if there is none)."""
    now = current.select(key, *columns).withColumn("_sig", signature(columns))
    old = stored.select(F.col(key), F.struct(*columns).alias("_old"), signature(columns).alias("_was"))
    j = now.join(old, key, "left").where(F.col("_was").isNull() | (F.col("_was") != F.col("_sig")))
    differs = F.array_compact(F.array(*[F.when(F.col("_was").isNull() | ~F.col(c).eqNullSafe(F.col(f"_old.{c}")), F.lit(c)) for c in columns]))
    return j.select(key, F.array_join(differs, ",").alias("changed"))
