"""Queries over sampling, windows, set operations and batch plans."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions.keyed import gumbel, uniform
from tallyforge.functions.scores import band_weight, hardness, section
from tallyforge.operators import audit, batches
from tallyforge.operators import sampling as S
from tallyforge.plans import tables as T
from tallyforge.plans.catalog import register
from tallyforge.plans.columns import RANK
from tallyforge.plans.detection import r6

M, L, V = (f"WITH {x}" for x in (T.MANIFEST, T.LINKS, T.SAMPLES))
O = "md5('42|' || CAST(event_id AS VARCHAR)), event_id"  # noqa: E741


def ids(df):
    return df.select("event_id")


register("w02_percentile_rank", M + f" SELECT event_id, round({RANK}, 6) AS pct FROM manifest")(
    lambda s, d: audit.percentile_rank(T.manifest(s, d).select("event_id", "dataset", "score"), ["dataset"], "score", "event_id").select("event_id", F.round("pct", 6).alias("pct")))
register("w03_thinned_series", M + " SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY dataset ORDER BY score, event_id) - 1 AS i FROM manifest) WHERE i % 10 = 0")(
    lambda s, d: ids(audit.ranked(T.manifest(s, d).select("event_id", "dataset", "score"), ["dataset"], "score", "event_id").where("place % 10 = 0")))
register("w04_capped_groups", M + f" SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY grp ORDER BY {O}) AS n FROM manifest) WHERE n <= 3")(lambda s, d: ids(S.capped(T.manifest(s, d), ["grp"], 3, "event_id")))
register("w05_keep_first", M + " SELECT user_id, min(event_id) AS event_id FROM manifest GROUP BY user_id")(lambda s, d: S.keep_first(T.manifest(s, d), ["user_id"], ["event_id"]).select("user_id", "event_id"))
register("w06_top_per_key", M + " SELECT dataset, event_id, CAST(n AS INT) AS rank FROM (SELECT dataset, event_id, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, event_id) AS n FROM manifest) WHERE n <= 5")(lambda s, d: S.top_k(T.manifest(s, d), ["dataset"], [F.desc("score"), F.col("event_id")], 5).select("dataset", "event_id", "rank"))
register("w07_ranked_statuses", M + " SELECT event_type, n, CAST(row_number() OVER (ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, n DESC, event_type) AS INT) AS rank FROM (SELECT event_type, count(*) AS n FROM manifest GROUP BY 1)")(
    lambda s, d: T.manifest(s, d).groupBy("event_type").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "signup", 1).otherwise(2), F.desc("n"), "event_type"))))
register("w08_keyed_shuffle", M + f" SELECT event_id, row_number() OVER (ORDER BY {O}) - 1 AS place FROM manifest")(lambda s, d: S.placed(T.manifest(s, d), "event_id").select("event_id", "place"))
register("w09_first_rows", M + " SELECT event_id FROM manifest ORDER BY path LIMIT 100")(lambda s, d: ids(T.manifest(s, d).orderBy("path").limit(100)))
FAIR = ", n AS (SELECT dataset, label, count(*) AS n FROM manifest GROUP BY 1, 2), cap AS (SELECT least(max(c), (SELECT max(n) FROM n)) AS cap FROM (SELECT c, (SELECT sum(least(n, c)) FROM n) AS used FROM range(0, 20000) r(c)) WHERE used <= 3000)"
register("w10_fair_cap", M + FAIR + " SELECT cap FROM cap")(lambda s, d: S.fair_cap(T.manifest(s, d).groupBy("dataset", "label").agg(F.count("*").alias("n")), "n", 3000))
register("w10_map_subset", M + f", k AS (SELECT * FROM manifest WHERE dataset = 'src0'), x AS (SELECT * FROM manifest WHERE dataset <> 'src0'), n AS (SELECT dataset, label, count(*) AS n FROM x GROUP BY 1, 2), cap AS (SELECT max(c) AS cap FROM (SELECT c, (SELECT sum(least(n, c)) FROM n) AS used FROM range(0, 20000) r(c)) WHERE used <= 4000 - (SELECT count(*) FROM k)) SELECT event_id FROM k UNION ALL SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY dataset, label ORDER BY {O}) AS i FROM x), cap WHERE i <= cap")(
    lambda s, d: ids(S.map_subset(T.manifest(s, d), ["dataset", "label"], F.col("dataset") == "src0", 4000, "event_id")))
register("u01_union", M + " SELECT dataset, CAST(NULL AS VARCHAR) AS domain, count(*) AS n FROM manifest GROUP BY 1 UNION ALL SELECT NULL, 'd' || CAST(label AS VARCHAR), count(*) FROM embeddings GROUP BY 2")(
    lambda s, d: T.manifest(s, d).select("dataset").unionByName(T.samples(s, d).select("domain"), allowMissingColumns=True).groupBy("dataset", "domain").agg(F.count("*").alias("n")))
register("u02_repeated_union", M + " SELECT event_id, copy FROM manifest, range(1, 4) r(copy) WHERE label = 1")(lambda s, d: T.manifest(s, d).where("label = 1").select("event_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("copy")))
register("u03_set_operations", M + " SELECT 'gone' AS kind, count(*) AS n FROM (SELECT DISTINCT user_id FROM manifest WHERE label = 0 EXCEPT SELECT user_id FROM manifest WHERE label = 1) UNION ALL SELECT 'shared', count(*) FROM (SELECT user_id FROM manifest WHERE label = 0 INTERSECT SELECT user_id FROM manifest WHERE label = 1)")(
    lambda s, d: (lambda a, b: a.subtract(b).agg(F.count("*").alias("n")).withColumn("kind", F.lit("gone")).unionByName(a.intersect(b).agg(F.count("*").alias("n")).withColumn("kind", F.lit("shared"))))(*[T.manifest(s, d).where(F.col("label") == y).select("user_id") for y in (0, 1)]))
register("u04_distinct", M + " SELECT DISTINCT dataset, event_type FROM manifest")(lambda s, d: T.manifest(s, d).select("dataset", "event_type").distinct())
register("r01_class_cap", M + f" SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY label ORDER BY {O}) AS n FROM manifest) WHERE n <= 700")(lambda s, d: ids(S.capped(T.manifest(s, d), ["label"], 700, "event_id")))
register("r02_cell_sample", M + f", a AS (SELECT *, row_number() OVER (PARTITION BY dataset, label, grp ORDER BY {O}) AS i FROM manifest WHERE event_id % 4 > 0), b AS (SELECT *, row_number() OVER (PARTITION BY dataset, label ORDER BY {O}) AS j FROM a WHERE i <= 2) SELECT event_id FROM b WHERE j <= 150")(
    lambda s, d: ids(S.cell_sample(T.manifest(s, d), ["dataset", "label"], "grp", 2, 150, "event_id", usable=F.col("event_id") % 4 > 0)))
QUOTA = ", q0 AS (SELECT dataset, count(*) AS n, round_even(count(*) * 1000 / sum(count(*)) OVER (), 0) AS q FROM manifest GROUP BY 1), q AS (SELECT dataset, n, CAST(least(n, greatest(0, CASE WHEN dataset = (SELECT max(dataset) FROM q0) THEN 1000 - (SELECT sum(q) FROM q0 WHERE dataset < (SELECT max(dataset) FROM q0)) ELSE q END)) AS BIGINT) AS quota FROM q0)"
register("r03_quotas", M + QUOTA + " SELECT dataset, n, quota FROM q")(lambda s, d: S.quotas(T.manifest(s, d), "dataset", 1000))
register("r03_stratified_sample", M + QUOTA + f" SELECT event_id FROM (SELECT event_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY {O}) AS i FROM manifest) JOIN q USING (dataset) WHERE i <= quota")(lambda s, d: ids(S.stratified(T.manifest(s, d), "dataset", 1000, "event_id")))
register("r04_undersampled", M + " SELECT label, (SELECT min(n) FROM (SELECT count(*) AS n FROM manifest GROUP BY label)) AS n FROM manifest GROUP BY label")(lambda s, d: S.undersampled(T.manifest(s, d), "dataset", "event_id").groupBy("label").agg(F.count("*").alias("n")))
register("r05_oversampled", M + f", p AS (SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY {O}) - 1 AS place, count(*) OVER (PARTITION BY label) AS c FROM manifest), m AS (SELECT max(c) AS m FROM p) SELECT event_id, copy FROM p, m, range(1, 50) r(copy) WHERE place + (copy - 1) * c < m")(lambda s, d: S.oversampled(T.manifest(s, d), "event_id").select("event_id", "copy"))
register("r06_allocation", M + ", w AS (SELECT dataset, avg(value) AS w FROM manifest GROUP BY 1), e AS (SELECT dataset, w * 100 / sum(w) OVER () AS e FROM w), r AS (SELECT dataset, floor(e) AS f, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, dataset) AS r, 100 - sum(floor(e)) OVER () AS rest FROM e) SELECT dataset, CAST(f + CAST(r <= rest AS INT) AS BIGINT) AS amount FROM r")(
    lambda s, d: S.allocation(T.manifest(s, d).groupBy("dataset").agg(F.avg("value").alias("w")), "dataset", "w", 100))
U = "((CAST('0x' || substr(md5('42|' || CAST(event_id AS VARCHAR)), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)"
register("r07_weighted_sample", M + f" SELECT event_id FROM manifest WHERE score > 0 ORDER BY ln(score) - ln(-ln({U})) DESC, event_id LIMIT 500")(lambda s, d: ids(S.weighted(T.manifest(s, d).where("score > 0"), "score", 500, "event_id")))
register("r08_two_caps")(lambda s, d: ids(S.two_caps(T.manifest(s, d), ["score", "event_id"], "user_id", 2, "dataset", 100)))
register("r09_control_arm", M + f" SELECT event_id FROM (SELECT event_id, md5('control|' || CAST(event_id AS VARCHAR)) AS o, row_number() OVER (PARTITION BY grp ORDER BY md5('control|' || CAST(event_id AS VARCHAR)), event_id) AS n FROM manifest) WHERE n <= 2 ORDER BY o, event_id LIMIT 300")(lambda s, d: ids(S.first(S.capped(T.manifest(s, d), ["grp"], 2, "event_id", "control"), 300, "event_id", "control")))
register("r10_split", M + f" SELECT event_id, i <= least(greatest(1, round_even(n * 0.15, 0)), n - 1) AS is_val FROM (SELECT event_id, row_number() OVER (PARTITION BY label ORDER BY {O}) AS i, count(*) OVER (PARTITION BY label) AS n FROM manifest)")(lambda s, d: S.split(T.manifest(s, d), 0.15, "event_id").select("event_id", "is_val"))
FOLD = ", g AS (SELECT grp, CASE WHEN avg(label) > 0.5 THEN 1 ELSE 0 END AS y FROM manifest GROUP BY 1), f AS (SELECT grp, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42|' || grp), grp) - 1) % 5 AS INT) AS fold FROM g)"
register("r11_group_folds", M + FOLD + " SELECT grp, fold FROM f")(lambda s, d: S.folds(T.manifest(s, d), "grp").select("grp", "fold").distinct())


def cover(s, d):
    return batches.covered(T.manifest(s, d), "event_id", "dataset", 32)


COVER = M + """, n AS (SELECT count(*) // 32 AS nb, count(*) FILTER (WHERE label = 1) AS na, count(*) FILTER (WHERE label = 0) AS nl, count(DISTINCT dataset) FILTER (WHERE label = 1) AS nd FROM manifest),
  b AS (SELECT unnest(range(0, nb)) AS batch_id, n.* FROM n), p AS (SELECT event_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY md5('42|' || CAST(event_id AS VARCHAR)), event_id) - 1 AS place, count(*) OVER (PARTITION BY dataset) AS c FROM manifest WHERE label = 1),
  cover AS (SELECT batch_id, 'cover' AS kind, event_id FROM b JOIN p ON batch_id % c = place), pa AS (SELECT event_id, row_number() OVER (ORDER BY md5('42-attack|' || CAST(event_id AS VARCHAR)), event_id) - 1 AS place FROM manifest WHERE label = 1),
  pl AS (SELECT event_id, row_number() OVER (ORDER BY md5('42-live|' || CAST(event_id AS VARCHAR)), event_id) - 1 AS place FROM manifest WHERE label = 0),
  xa AS (SELECT batch_id, nd, pos, event_id FROM b, range(0, 64) r(pos), pa WHERE pos < 16 AND (batch_id * (16 - nd) + pos) % na = place AND NOT EXISTS (SELECT 1 FROM cover c WHERE c.batch_id = b.batch_id AND c.event_id = pa.event_id)),
  more AS (SELECT batch_id, 'attack' AS kind, event_id FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY pos) AS i FROM xa) WHERE i <= 16 - nd), live AS (SELECT batch_id, 'live' AS kind, event_id FROM b, range(0, 16) r(pos), pl WHERE (batch_id * 16 + pos) % nl = place)
  """
register("r12_covered_batches", COVER + "SELECT * FROM cover UNION ALL SELECT * FROM more UNION ALL SELECT * FROM live")(cover)
register("r15_steps", M + " SELECT count(*) // 32 AS steps FROM manifest")(lambda s, d: batches.steps(cover(s, d)))


def linked(s, d):
    rows = T.links(s, d)
    known = rows.where("label = 0").select(F.col("media_id").alias("source_media_id"), F.lit(1).alias("ok"))
    return rows.join(known, "source_media_id", "left").withColumn("source", F.when((F.col("ok") == 1) & (F.col("label") == 1), F.col("source_media_id")))


def pairs(s, d):
    from tallyforge.sources.staging import staged

    return staged(batches.source_pairs(linked(s, d), "media_id", "source", 32), "pairs")


register("r13_source_pair_batches")(pairs)
register("r14_pair_report", L + ", s AS (SELECT a.media_id FROM links a JOIN links b ON a.source_media_id = b.media_id AND b.label = 0 WHERE a.label = 1) SELECT count(*) AS n_linked, count(*) AS together, CAST(0 AS BIGINT) AS n_unused FROM s")(lambda s, d: batches.pair_report(pairs(s, d), linked(s, d), "media_id", "source").select("n_linked", "together", "n_unused"))


def mined(s, d):
    """Both labels with hardness, its percentile in (dataset, label), section and the band's ramp weight."""
    rows = T.manifest(s, d).withColumn("hardness", hardness(F.col("label"), F.col("score")))
    rows = audit.percentile_rank(rows, ["dataset", "label"], "hardness", "event_id")
    return rows.withColumn("section", section(F.col("pct"), 0.6, 0.95)).withColumn("weight", band_weight(F.col("pct"), 0.6, 0.95))


MINED = M + """, h AS (SELECT *, CASE WHEN label = 1 THEN 1 - score ELSE score END AS hardness FROM manifest),
  p AS (SELECT *, (row_number() OVER (PARTITION BY dataset, label ORDER BY hardness, event_id) - 1) / CAST(greatest(count(*) OVER (PARTITION BY dataset, label) - 1, 1) AS DOUBLE) AS pct FROM h),
  m AS (SELECT *, CASE WHEN pct > 0.95 THEN 'noise' WHEN pct >= 0.6 THEN 'band' ELSE 'easy' END AS section, 0.5 + 0.5 * (pct - 0.6) / (0.95 - 0.6) AS ramp FROM p)"""
register("k05_mining_sections", MINED + " SELECT label, section, count(*) AS n, round(avg(hardness), 6) AS mean_hardness FROM m GROUP BY 1, 2")(
    lambda s, d: r6(mined(s, d).groupBy("label", "section").agg(F.count("*").alias("n"), F.avg("hardness").alias("mean_hardness")), "mean_hardness"))
#: The pick: rows of the band by Gumbel keys of ramp x production likeness (a stand-in column here: 0.1 to 10 by user), at most 2 of a group, the first N_PICKED; and a control arm of the same size by a random order under the same cap.
N_PICKED = 200
LIKENESS = "(0.1 + 9.9 * (user_id % 13) / 12.0)"
PICK = f""", g AS (SELECT *, ln(ramp * {LIKENESS}) - ln(-ln({U})) AS gumbel FROM m WHERE section = 'band'),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY gumbel DESC, event_id) AS i FROM g) WHERE i <= 2 ORDER BY gumbel DESC, event_id LIMIT {N_PICKED}),
  o AS (SELECT *, md5('control|' || CAST(event_id AS VARCHAR)) AS o FROM m),
  ctl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY o, event_id) AS i FROM o) WHERE i <= 2 ORDER BY o, event_id LIMIT {N_PICKED})"""


def picked(s, d):
    """The mining arm: the band's rows in weighted order (ramp x production likeness), at most two of a group, the first N_PICKED."""
    band = mined(s, d).where("section = 'band'").withColumn("w", F.col("weight") * (0.1 + 9.9 * (F.col("user_id") % 13) / 12.0))
    ordered = band.withColumn("gumbel", gumbel(F.col("w"), uniform(42, F.col("event_id"))))
    capped = ordered.withColumn("_n", F.row_number().over(W.partitionBy("grp").orderBy(F.desc("gumbel"), "event_id"))).where("_n <= 2")
    return ids(capped.orderBy(F.desc("gumbel"), "event_id").limit(N_PICKED))


def control(s, d):
    """The control arm: as many rows of all sections in random order, under the same cap."""
    return ids(S.first(S.capped(mined(s, d), ["grp"], 2, "event_id", "control"), N_PICKED, "event_id", "control"))


register("k05_mining_arms", MINED + PICK + " SELECT 'selected' AS arm, event_id FROM k UNION ALL SELECT 'control', event_id FROM ctl UNION ALL SELECT 'review', event_id FROM m WHERE section = 'noise'")(
    lambda s, d: picked(s, d).select(F.lit("selected").alias("arm"), "event_id").unionByName(control(s, d).select(F.lit("control").alias("arm"), "event_id")).unionByName(ids(mined(s, d).where("section = 'noise'")).select(F.lit("review").alias("arm"), "event_id")))
register("k06_mixed_training_table", MINED + PICK + " SELECT arm, event_id, count(*) AS n FROM (SELECT a.arm, event_id FROM manifest, (VALUES ('selected'), ('control')) a(arm) UNION ALL SELECT 'selected', event_id FROM k, range(0, 3) r(c) UNION ALL SELECT 'control', event_id FROM ctl, range(0, 3) r(c)) GROUP BY 1, 2")(
    lambda s, d: mixed(s, d).groupBy("arm", "event_id").agg(F.count("*").alias("n")))


def mixed(s, d):
    """The base table and three copies of the arm's rows, for both arms."""
    base = ids(T.manifest(s, d)).withColumn("arm", F.explode(F.array(F.lit("selected"), F.lit("control"))))
    arms = picked(s, d).withColumn("arm", F.lit("selected")).unionByName(control(s, d).withColumn("arm", F.lit("control")))
    copies = arms.withColumn("c", F.explode(F.array(*map(F.lit, range(3))))).drop("c")
    return base.unionByName(copies)


register("k05_two_cap_pick")(lambda s, d: ids(S.two_caps(mined(s, d).where("section = 'band'").withColumn("bucket", F.col("event_id") % 20), ["pct", "event_id"], "grp", 2, "bucket", 25, 300)))
