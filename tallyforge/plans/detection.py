"""Queries over the detection metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions.scores import logit
from tallyforge.operators import metrics as X
from tallyforge.plans import tables as T
from tallyforge.plans.catalog import register

M, P = f"WITH {T.MANIFEST}", f"WITH {T.PATCHES}"


def r6(df, *names):
    """Doubles rounded for comparison."""
    return df.withColumns({c: F.round(c, 6) for c in names})


def curve(source: str, keys: str = "", score: str = "score", sentinel: bool = True, extra: str = "") -> str:
    """SQL common tables c (counts), s (sweep) and e (equal error rate) over a source."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    top = f" UNION ALL SELECT {k}max(threshold) + 1e-6, 100.0, 0.0 FROM s0 {group}" if sentinel else ""
    return f""", c AS (SELECT {k}{score} AS score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM {source} {extra} GROUP BY {k}{score}),
  a AS (SELECT *, sum(pos) OVER ({part}) AS tp, sum(neg) OVER ({part}) AS tn, coalesce(sum(pos) OVER w, 0) AS bp, coalesce(sum(neg) OVER w, 0) AS bn FROM c WINDOW w AS ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  s0 AS (SELECT {k}score AS threshold, 100.0 * bp / tp AS frr, 100.0 * (tn - bn) / tn AS far FROM a WHERE tp > 0 AND tn > 0), s AS (SELECT * FROM s0{top}),
  e AS (SELECT {k}(arg_min(frr, ROW(round(abs(frr - far), 9), threshold)) + arg_min(far, ROW(round(abs(frr - far), 9), threshold))) / 2 AS eer, arg_min(threshold, ROW(round(abs(frr - far), 9), threshold)) AS eer_threshold FROM s {group})"""


DOCS = """, d AS (SELECT source_path, label, count(*) AS n_patches, avg(score) AS mean_score, avg(ln(least(greatest(score, 1e-7), 1 - 1e-7) / (1 - least(greatest(score, 1e-7), 1 - 1e-7)))) AS mean_logit,
  quantile_cont(score, 0.5) AS median, max(score) AS max, list_avg(list_sort(list(score), 'DESC')[1:3]) AS top3 FROM patches GROUP BY ALL),
  u AS (SELECT source_path, label, n_patches, rule, round(doc_score, 9) AS score FROM d UNPIVOT (doc_score FOR rule IN (mean_score, mean_logit, median, max, top3)))"""


def documents(s, d):
    return X.document_scores(T.patches(s, d), "source_path", ["label"]).withColumn("score", F.round("doc_score", 9))


@register("m03_document_eer_by_rule", P + DOCS + curve("u", "rule") + " SELECT rule, round(eer, 6) AS eer, round(eer_threshold, 6) AS eer_threshold FROM e")
def document_eer(s, d):
    return r6(X.eer(documents(s, d), ["rule"]), "eer", "eer_threshold")


register("m09_document_scores", P + DOCS + " SELECT source_path, rule, n_patches, round(score, 6) AS doc_score FROM u")(lambda s, d: r6(documents(s, d).select("source_path", "rule", "n_patches", F.col("score").alias("doc_score")), "doc_score"))
register("k11_document_table", P + DOCS + " SELECT source_path, label, n_patches, round(mean_score, 6) AS mean_score FROM d")(lambda s, d: r6(documents(s, d).where("rule = 'mean_score'").select("source_path", "label", "n_patches", F.col("doc_score").alias("mean_score")), "mean_score"))
register("m01_rates_at_threshold", M + " SELECT dataset, round(100.0 * count(*) FILTER (WHERE label = 1 AND score < 0.5) / count(*) FILTER (WHERE label = 1), 6) AS frr, round(100.0 * count(*) FILTER (WHERE label = 0 AND score > 0.5) / count(*) FILTER (WHERE label = 0), 6) AS far FROM manifest GROUP BY dataset")(
    lambda s, d: r6(X.at_threshold(T.manifest(s, d), 0.5, ["dataset"]).select("dataset", "frr", "far"), "frr", "far"))
register("m02_sweep", M + curve("manifest") + " SELECT round(threshold, 7) AS threshold, round(frr, 6) AS frr, round(far, 6) AS far FROM s")(lambda s, d: r6(X.sweep(T.manifest(s, d)).withColumn("threshold", F.round("threshold", 7)), "frr", "far"))
register("m03_eer", M + curve("manifest") + " SELECT round(eer, 6) AS eer, round(eer_threshold, 6) AS eer_threshold FROM e")(lambda s, d: r6(X.eer(T.manifest(s, d)), "eer", "eer_threshold"))
FIXED = "SELECT {k}count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg, 100.0 * count(*) FILTER (WHERE label = 1 AND score < 0.5) / count(*) FILTER (WHERE label = 1) AS bpcer, 100.0 * count(*) FILTER (WHERE label = 0 AND score > 0.5) / count(*) FILTER (WHERE label = 0) AS apcer FROM {t} {g}"
register("m04_metric_row", M + curve("manifest") + " SELECT n_pos, n_neg, round(bpcer, 6) AS bpcer, round(apcer, 6) AS apcer, round((bpcer + apcer) / 2, 6) AS acer, round(eer, 6) AS eer, round(eer_threshold, 6) AS eer_threshold FROM e, (" + FIXED.format(k="", t="manifest", g="") + ")")(
    lambda s, d: r6(X.metric_row(T.manifest(s, d)).drop("frr", "far"), "bpcer", "apcer", "acer", "eer", "eer_threshold"))
register("m05_eer_without_sentinel", M + curve("manifest", "dataset", sentinel=False) + " SELECT dataset, round(eer / 100, 6) AS eer, round(eer_threshold, 6) AS eer_threshold FROM e")(
    lambda s, d: r6(X.eer(T.manifest(s, d), ["dataset"], sentinel=False).withColumn("eer", F.col("eer") / 100), "eer", "eer_threshold"))
register("m06_det_curve", M + curve("manifest") + " SELECT round(threshold, 7) AS threshold, round(frr, 6) AS frr, round(far, 6) AS far FROM (SELECT *, row_number() OVER (ORDER BY threshold) - 1 AS i, count(*) OVER () AS n FROM s) WHERE i % greatest(1, n // 64) = 0")(
    lambda s, d: r6(X.det(T.manifest(s, d)).withColumn("threshold", F.round("threshold", 7)), "frr", "far"))
AUC = curve("manifest", "dataset") + " SELECT dataset, round(sum(pos * bn + 0.5 * pos * neg) / max(tp * tn), 6) AS auc FROM a GROUP BY dataset"
register("m07_auc", M + AUC)(lambda s, d: r6(X.auc(T.manifest(s, d), ["dataset"]), "auc"))
register("m07_auc_global", M + curve("manifest") + " SELECT round(sum(pos * bn + 0.5 * pos * neg) / max(tp * tn), 6) AS auc FROM a")(lambda s, d: r6(X.auc(T.manifest(s, d)), "auc"))
register("m08_metrics_by_zone", P + curve("patches", "zone") + ", f AS (" + FIXED.format(k="zone, ", t="patches", g="GROUP BY zone") + ") SELECT zone, n_pos, n_neg, round(bpcer, 6) AS bpcer, round(apcer, 6) AS apcer, round(eer, 6) AS eer FROM f JOIN e USING (zone)")(
    lambda s, d: r6(X.metric_row(T.patches(s, d), 0.5, ["zone"]).select("zone", "n_pos", "n_neg", "bpcer", "apcer", "eer"), "bpcer", "apcer", "eer"))
register("m10_document_eer_by_zone", P + ", z AS (SELECT zone, source_path, label, round(avg(score), 9) AS score FROM patches GROUP BY ALL HAVING count(*) >= 2)" + curve("z", "zone") + " SELECT zone, round(eer, 6) AS eer FROM e")(
    lambda s, d: r6(X.eer(X.document_scores(T.patches(s, d), "source_path", ["zone", "label"]).where("rule = 'mean_score' AND n_patches >= 2").withColumn("score", F.round("doc_score", 9)), ["zone"]).select("zone", "eer"), "eer"))
ERR = "CASE WHEN label = 1 AND score < eer_threshold THEN 'missed' WHEN label = 0 AND score >= eer_threshold THEN 'rejected' END"


def errors(s, d):
    rows = T.manifest(s, d)
    return X.row_errors(rows, X.eer(rows, ["dataset"]), ["dataset"])


register("m11_row_errors", M + curve("manifest", "dataset") + f" SELECT event_id, {ERR} AS error FROM manifest JOIN e USING (dataset)")(lambda s, d: errors(s, d).select("event_id", "error"))
register("m12_error_split", M + curve("manifest", "dataset") + f" SELECT label, event_id % 3 = 0 AS covered, count(*) AS n, count({ERR}) AS n_errors FROM manifest JOIN e USING (dataset) GROUP BY 1, 2")(
    lambda s, d: errors(s, d).groupBy("label", (F.col("event_id") % 3 == 0).alias("covered")).agg(F.count("*").alias("n"), F.count("error").alias("n_errors")))
BANDS = ", b AS (SELECT dataset, band, label, CASE WHEN band = 'none' THEN score WHEN event_id % 5 = 0 THEN 1 - score ELSE score END AS score FROM manifest, (VALUES ('none'), ('low')) v(band))"
register("m13_eer_change", M + BANDS + curve("b", "dataset, band") + " SELECT dataset, band, round(eer, 6) AS eer, round(eer - max(CASE WHEN band = 'none' THEN eer END) OVER (PARTITION BY dataset), 6) AS change FROM e")(
    lambda s, d: r6(X.change_from(X.eer(T.manifest(s, d).withColumn("band", F.explode(F.array(F.lit("none"), F.lit("low")))).withColumn("score", F.when((F.col("band") == "low") & (F.col("event_id") % 5 == 0), 1 - F.col("score")).otherwise(F.col("score"))), ["dataset", "band"]).select("dataset", "band", "eer"), ["dataset"], "band", "none", "eer"), "eer", "change"))
register("w01_running_counts", M + curve("manifest") + " SELECT score, pos, neg, CAST(bp AS BIGINT) AS below_pos, CAST(bn AS BIGINT) AS below_neg FROM a")(lambda s, d: X.running(X.counts(T.manifest(s, d)), [], "score", ["pos", "neg"]).drop("all_pos", "all_neg"))
register("s11_predictions", M + " SELECT event_id, label, score, round(CASE WHEN event_id % 2 = 0 THEN value - 50 ELSE ln(least(greatest(score, 1e-7), 1 - 1e-7) / (1 - least(greatest(score, 1e-7), 1 - 1e-7))) END, 6) AS logit FROM manifest")(
    lambda s, d: T.manifest(s, d).select("event_id", "label", "score", F.round(F.coalesce(F.when(F.col("event_id") % 2 == 0, F.col("value") - 50), logit(F.col("score"))), 6).alias("logit")))
