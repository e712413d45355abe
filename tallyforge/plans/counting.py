"""Queries over counts, balance, quantiles and run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import aggregates as A
from tallyforge.plans import tables as T
from tallyforge.plans.catalog import register
from tallyforge.plans.columns import CLASS, good
from tallyforge.plans.detection import r6
from tallyforge.functions import boxes as B

M, P, BX, R, S = (f"WITH {x}" for x in (T.MANIFEST, T.PATCHES, T.BOXES, T.RUNS, T.SAMPLES))
REASON = "CASE WHEN event_id % 10 = 0 THEN 'missing' WHEN label = 1 AND event_id % 3 = 0 THEN 'no_box' END"


def with_reason(s, d):
    return T.manifest(s, d).withColumn("reason", F.expr(REASON))


register("a01_label_pivot", M + " SELECT dataset, count(*) FILTER (WHERE label = 0) AS n_0, count(*) FILTER (WHERE label = 1) AS n_1 FROM manifest GROUP BY 1")(lambda s, d: A.label_pivot(T.manifest(s, d), "dataset"))
register("a02_label_balance", M + " SELECT grp, n_0, n_1, least(n_0, n_1) = 0 AS one_class, least(n_0, n_1) > 0 AND least(n_0, n_1) < 0.05 * (n_0 + n_1) AS rare_class FROM (SELECT grp, count(*) FILTER (WHERE label = 0) AS n_0, count(*) FILTER (WHERE label = 1) AS n_1 FROM manifest GROUP BY 1)")(lambda s, d: A.label_balance(T.manifest(s, d), ["grp"]))
register("a03_class_weights", M + " SELECT label, round(sum(count(*)) OVER () / (2.0 * count(*)), 6) AS weight FROM manifest GROUP BY label")(lambda s, d: r6(A.class_weights(T.manifest(s, d)), "weight"))
register("a04_nested_counts", P + " SELECT zone, label, count(*) AS n FROM patches GROUP BY ROLLUP (zone, label)")(lambda s, d: A.nested_counts(T.patches(s, d), "zone", "label"))
register("a05_skips_by_label", M + f", q AS (SELECT label, {REASON} AS reason, count(*) AS n FROM manifest GROUP BY 1, 2), t AS (SELECT *, n / sum(n) OVER (PARTITION BY label) AS rate FROM q) SELECT label, reason, n, round(rate, 6) AS rate FROM t WHERE reason IS NOT NULL")(lambda s, d: r6(A.skip_rates(with_reason(s, d), "label", "reason"), "rate"))
register("a06_balance_findings", M + f""", q AS (SELECT label, {REASON} AS reason FROM manifest), k AS (SELECT avg(label) AS share FROM q WHERE reason IS NULL), t AS (SELECT count(*) FILTER (WHERE label = 0) AS t0, count(*) FILTER (WHERE label = 1) AS t1 FROM q)
  SELECT 'skewed' AS finding, CAST(NULL AS VARCHAR) AS reason, round(share, 6) AS amount FROM k WHERE share < 0.2 OR share > 0.8
  UNION ALL SELECT 'skip_gap', reason, round(abs(count(*) FILTER (WHERE label = 1) / max(t1) - count(*) FILTER (WHERE label = 0) / max(t0)), 6) FROM q, t WHERE reason IS NOT NULL GROUP BY reason HAVING abs(count(*) FILTER (WHERE label = 1) / max(t1) - count(*) FILTER (WHERE label = 0) / max(t0)) > 0.2""")(
    lambda s, d: r6(A.balance_findings(with_reason(s, d), "label", "reason"), "amount"))
register("a07_cell_statistics", M + " SELECT dataset, label, count(*) AS n_rows, count(DISTINCT grp) AS n_groups, count(*) FILTER (WHERE event_id % 10 = 0) AS n_missing, count(*) FILTER (WHERE event_id % 4 = 0) AS n_no_box FROM manifest GROUP BY 1, 2")(
    lambda s, d: A.cell_statistics(T.manifest(s, d), ["dataset", "label"], "grp", F.col("event_id") % 10 == 0, F.col("event_id") % 4 == 0))
register("a08_quantiles", M + " SELECT dataset, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM manifest GROUP BY 1")(lambda s, d: r6(A.quantiles(T.manifest(s, d), "value", [0.05, 0.25, 0.5, 0.75, 0.95], ["dataset"]), "p5", "p25", "p50", "p75", "p95"))
G = BX + ", g AS (SELECT *, least(x2 - x1, y2 - y1) AS short, greatest(x2 - x1, y2 - y1) AS long FROM boxes WHERE kind > 3 AND x2 > x1 AND y2 > y1)"


def sized(s, d):
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return good(s, d).withColumn("short", F.least(w, h)).withColumn("long", F.greatest(w, h)).withColumn("frame", F.lit(1000.0))


register("a09_legibility", G + " SELECT label, count(*) AS n, round(quantile_cont(px, 0.5), 6) AS p50, round(quantile_cont(px, 0.9), 6) AS p90, round(avg(CAST(px < 5 AS INT)), 6) AS share_under FROM (SELECT label, 0.04 * short * least(1.0, 192 / long) AS px FROM g) GROUP BY label")(
    lambda s, d: r6(A.legibility(sized(s, d).withColumn("px", 0.04 * F.col("short") * F.least(F.lit(1.0), 192 / F.col("long"))), ["label"], "px", 5.0), "p50", "p90", "share_under"))
register("a10_legibility_table", G + """, z AS (SELECT *, 0.04 * short * least(1.0, size / long) AS t, 0.35 * short * least(1.0, size / long) AS f FROM g, (VALUES (96), (192), (512)) v(size)), q AS (SELECT 'flag' AS dimension, flag AS value, * FROM z UNION ALL SELECT 'status', status, * FROM z UNION ALL SELECT 'label', CAST(label AS VARCHAR), * FROM z)
  SELECT dimension, value, size, count(*) AS n, round(avg(CAST(t < 5 AS INT)), 6) AS text_under, round(avg(CAST(f < 40 AS INT)), 6) AS face_under, round(quantile_cont(long / 1000, 0.5), 6) AS median_share FROM q GROUP BY 1, 2, 3""")(
    lambda s, d: r6(A.legibility_table(sized(s, d), ["flag", "status", "label"], [96, 192, 512]), "text_under", "face_under", "median_share"))
FILLED = G + """, q AS (SELECT 'flag' AS dimension, flag AS value, * FROM g UNION ALL SELECT 'status', status, * FROM g UNION ALL SELECT 'label', CAST(label AS VARCHAR), * FROM g)
  SELECT dimension, value, count(*) AS n, round(avg(CAST(x2 - x1 >= 500 * 0.98 AND y2 - y1 >= 5 * 0.98 AS INT)), 6) AS filled FROM q GROUP BY 1, 2"""
register("a10_filled_share", FILLED)(lambda s, d: r6(A.filled_share(good(s, d), ["flag", "status", "label"], F.lit(500.0), F.lit(5.0)), "filled"))
register("a11_low_confidence", "SELECT l_returnflag, round(avg(CAST(least(l_quantity / 50, l_discount * 10, 0.9) < 0.3 AS INT)), 6) AS share_low FROM lineitem GROUP BY 1")(
    lambda s, d: r6(T.table(s, d, "lineitem").withColumn("c", B.least_peak([F.col("l_quantity") / 50, F.col("l_discount") * 10, F.lit(0.9)])).groupBy("l_returnflag").agg(F.avg((F.col("c") < 0.3).cast("double")).alias("share_low")), "share_low"))
D = ", f AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS position, CAST(unnest(embedding) AS DOUBLE) AS x FROM samples), e AS (SELECT position, (avg(x) FILTER (WHERE label = 1) - avg(x) FILTER (WHERE label = 0)) / greatest(sqrt((var_samp(x) FILTER (WHERE label = 1) + var_samp(x) FILTER (WHERE label = 0)) / 2), 1e-9) AS d FROM f GROUP BY 1)"
register("a12_cohens_d", S + D + " SELECT CAST(position AS INT) AS position, round(d, 6) AS d FROM e")(lambda s, d: r6(A.cohens_d(T.samples(s, d), "embedding"), "d"))
SHORT = S + """, f AS (SELECT role, label, generate_subscripts(embedding, 1) - 1 AS position, CAST(unnest(embedding) AS DOUBLE) AS x FROM samples),
  e AS (SELECT role = 'train' AS tr, position, (avg(x) FILTER (WHERE label = 1) - avg(x) FILTER (WHERE label = 0)) / greatest(sqrt((var_samp(x) FILTER (WHERE label = 1) + var_samp(x) FILTER (WHERE label = 0)) / 2), 1e-9) AS d FROM f GROUP BY 1, 2)
  SELECT CAST(a.position AS INT) AS position, round(a.d, 6) AS d_before, round(b.d, 6) AS d_after, round(abs(a.d) - abs(b.d), 6) AS lost, abs(a.d) >= 0.1 AND (abs(b.d) < 0.25 * abs(a.d) OR sign(a.d) * sign(b.d) < 0) AS shortcut FROM e a JOIN e b ON a.tr AND NOT b.tr AND a.position = b.position"""
register("a13_shortcuts", SHORT)(lambda s, d: r6(A.shortcuts(*[A.cohens_d(T.samples(s, d).where((F.col("role") == "train") == t), "embedding") for t in (True, False)], ["position"], large=0.1), "d_before", "d_after", "lost"))
register("a14_selection_summary", M + ", x AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'selected' ELSE 'control' END AS arm FROM manifest), b AS (SELECT arm, dataset, count(*) AS n FROM x GROUP BY 1, 2) SELECT arm, count(*) AS n_rows, count(DISTINCT grp) AS n_groups, round(avg(score), 6) AS mean_score, (SELECT round(max(n) / sum(n), 6) FROM b WHERE b.arm = x.arm) AS largest_bucket_share FROM x GROUP BY arm")(
    lambda s, d: r6(A.selection_summary(T.manifest(s, d).withColumn("arm", F.when(F.col("event_id") % 2 == 0, "selected").otherwise("control")), "arm", "grp", "dataset", "score"), "mean_score", "largest_bucket_share"))
register("a15_most_common", M + ", n AS (SELECT dataset, event_type, count(*) AS n FROM manifest GROUP BY 1, 2) SELECT dataset, event_type, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, event_type) AS rank FROM n) WHERE rank <= 3")(lambda s, d: A.most_common(T.manifest(s, d), ["dataset"], "event_type", 3))
register("a16_best_epoch", R + " SELECT run, CAST(arg_min(epoch, ROW(val_eer, epoch)) AS INT) AS best_epoch, round(min(val_eer), 6) AS best_value FROM runs GROUP BY run")(lambda s, d: r6(A.best_epoch(T.runs(s, d), "run", "epoch", "val_eer").withColumn("best_epoch", F.col("best_epoch").cast("int")), "best_value"))
register("a16_best_epoch_max", R + " SELECT run, CAST(arg_max(epoch, ROW(val_eer, epoch)) AS INT) AS best_epoch, round(max(val_eer), 6) AS best_value FROM runs GROUP BY run")(lambda s, d: r6(A.best_epoch(T.runs(s, d), "run", "epoch", "val_eer", "max"), "best_value"))
TESTS = "SELECT run, round(min(val_eer) * 2, 6) AS test_eer FROM runs WHERE o_custkey % 2 = 0 GROUP BY run"
register("a17_run_rollup", R + f", t AS ({TESTS}) SELECT run, round(arg_max(val_eer, epoch), 6) AS last_value, round(coalesce(any_value(test_eer), min(val_eer)), 6) AS test_value FROM runs LEFT JOIN t USING (run) GROUP BY run")(
    lambda s, d: r6(A.run_rollup(T.runs(s, d), "run", "epoch", "val_eer", T.runs(s, d).where("o_custkey % 2 = 0").groupBy("run").agg(F.round(F.min("val_eer") * 2, 6).alias("test_eer")), "test_eer"), "last_value", "test_value"))
register("a18_trial_ranking", R + ", t AS (SELECT run, round(date_diff('second', min(o_orderdate), max(o_orderdate)) / 60.0, 6) AS minutes, CASE WHEN min(o_custkey) % 5 > 0 THEN round(min(val_eer), 6) END AS eer FROM runs GROUP BY run) SELECT run, minutes, eer, CAST(row_number() OVER (ORDER BY eer NULLS LAST, run) AS INT) AS rank FROM t")(
    lambda s, d: r6(A.trial_ranking(T.runs(s, d).groupBy("run").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.when(F.min("o_custkey") % 5 > 0, F.round(F.min("val_eer"), 6)).alias("eer")), "run", "a", "b", "eer"), "minutes"))
register("a19_dataset_use", M + " SELECT dataset, count(*) AS n_rows, round(500.0 / count(*), 6) AS reuse, 32 - count(*) OVER () AS live_slots FROM manifest WHERE label = 1 GROUP BY dataset")(lambda s, d: r6(A.dataset_use(T.manifest(s, d).where("label = 1"), "dataset", 500, 32), "reuse"))
register("a20_throughput", R + " SELECT run, round(max(n_epochs) * 100 / avg(val_eer), 6) AS mean_rate, round(max(n_epochs) * 100 / min(val_eer), 6) AS steady_rate FROM runs GROUP BY run")(lambda s, d: r6(A.throughput(T.runs(s, d).withColumn("n", F.col("n_epochs") * 100), "run", "n", "val_eer"), "mean_rate", "steady_rate"))
register("a21_median_domain_rows", S + ", n AS (SELECT label, domain, count(*) AS n FROM samples WHERE role = 'train' GROUP BY 1, 2) SELECT label, quantile_cont(n, 0.5) AS median_rows FROM n GROUP BY 1")(
    lambda s, d: T.samples(s, d).where("role = 'train'").groupBy("label", "domain").agg(F.count("*").alias("n")).groupBy("label").agg(F.percentile("n", 0.5).alias("median_rows")))
register("a22_audit_totals", BX + f" SELECT CASE {CLASS} WHEN 'ok' THEN 'ok' WHEN 'empty' THEN 'missing' ELSE 'unreadable' END AS status, count(*) AS n FROM boxes GROUP BY 1")(
    lambda s, d: A.status_totals(T.boxes(s, d), F.when(B.error_class(F.col("bbox")) == "ok", "ok").when(B.is_empty(F.col("bbox")), "missing").otherwise("unreadable")))
register("m14_objective", R + " SELECT run, round(min(val_eer), 6) AS objective FROM runs GROUP BY run")(lambda s, d: r6(A.best_epoch(T.runs(s, d), "run", "epoch", "val_eer").select("run", F.col("best_value").alias("objective")), "objective"))
