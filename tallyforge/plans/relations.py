"""Queries over sources, sinks and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import boxes as B
from tallyforge.functions import paths
from tallyforge.operators import audit
from tallyforge.operators import relating as J
from tallyforge.operators import rewriting, sampling
from tallyforge.plans import tables as T
from tallyforge.plans.catalog import register
from tallyforge.plans.columns import CLASS
from tallyforge.plans.detection import r6
from tallyforge.sources import manifests as X
from tallyforge.sources import sinks as K
from tallyforge.sources.staging import fresh_path

M, P, BX, R, L, V = (f"WITH {x}" for x in (T.MANIFEST, T.PATCHES, T.BOXES, T.RUNS, T.LINKS, T.SAMPLES))


def as_csv(df, name):
    """df written as CSV to the shared folder; its path."""
    return K.write(df, fresh_path(df.sparkSession, name), "csv")


def manifest_csv(s, d):
    m = T.manifest(s, d)
    rows = m.select(F.when(F.col("event_id") % 10 == 0, "").when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), "path")).otherwise(F.substring("path", 7, 1000)).alias("path"), F.col("label").cast("string").alias("label"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("["), F.concat_ws(",", F.col("event_id") % 50, F.lit(2), F.col("event_id") % 50 + 9, F.lit(30)), F.lit("]"))).alias("bbox"), F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("dataset")).alias("dataset"), F.col("event_id").alias("extra id"))
    return as_csv(rows, "manifest")


FULL = "CASE WHEN event_id % 2 = 0 THEN path ELSE '/home/' || substr(path, 7) END"
register("s01_manifest_scan", M + f" SELECT {FULL} AS path, label, CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 50 AS DOUBLE) END AS x1, CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE dataset END AS dataset FROM manifest WHERE event_id % 10 > 0")(
    lambda s, d: X.manifest(s, manifest_csv(s, d), "/home", require_bbox=True).select("path", "label", F.get("bbox", F.lit(0)).alias("x1"), "dataset"))
register("s02_tolerant_scan", M + " SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 10 > 0) AS n_with_path FROM manifest")(lambda s, d: X.read_csv(s, manifest_csv(s, d)).agg(F.count("*").alias("n"), F.count(F.nullif("path", F.lit(""))).alias("n_with_path")))
register("s03_open_columns", M + " SELECT event_id AS \"extra id\", label FROM manifest WHERE event_id % 10 > 0")(lambda s, d: X.manifest(s, manifest_csv(s, d), "/home").select(F.col("extra id").cast("long"), "label"))
register("s04_domain_manifest", M + " SELECT '/lake/' || dataset || '/s' || CAST(user_id AS VARCHAR) AS orig, '/mnt/' || dataset || '/s' || CAST(user_id AS VARCHAR) AS path, arg_min(event_type, event_id) AS domain, round(arg_min(score, event_id), 6) AS score FROM manifest GROUP BY dataset, user_id")(
    lambda s, d: X.domain_manifest(T.manifest(s, d).withColumn("path", F.col("grp")), ["event_id"], [("/lake", "/mnt")], "event_type", group_by="file", meta=["event_type"]).select("orig", "path", "domain", F.round("score", 6).alias("score")))
register("s05_several_tables", M + " SELECT event_id FROM (SELECT event_id FROM manifest WHERE label = 1 UNION ALL SELECT event_id FROM manifest WHERE dataset = 'src1') ORDER BY event_id LIMIT 500")(lambda s, d: X.several([T.manifest(s, d).where("label = 1"), T.manifest(s, d).where("dataset = 'src1'").drop("props")], ["event_id"], 500).select("event_id"))
FRAMES = ", frames AS (SELECT split_part(path, '/', 3) || '/' || split_part(path, '/', 4) AS session, path AS frame FROM manifest WHERE event_id % 3 > 0), keys AS (SELECT DISTINCT dataset || '/s' || CAST(user_id AS VARCHAR) AS session, dataset FROM manifest WHERE user_id % 2 = 0)"


def keys_and_frames(s, d):
    m = T.manifest(s, d)
    frames = m.where("event_id % 3 > 0").select(paths.session_key(F.substring("grp", 7, 1000)).alias("session"), F.col("path").alias("frame"))
    keys = m.where("user_id % 2 = 0").select(paths.session_key(F.concat_ws("/", "dataset", F.concat(F.lit("s"), "user_id"), "event_id")).alias("session"), "dataset").distinct()
    return keys, frames


register("s06_required_columns", M + " SELECT dataset, count(*) AS n FROM manifest GROUP BY 1")(lambda s, d: audit.require(T.manifest(s, d), "path", "label", "dataset").groupBy("dataset").agg(F.count("*").alias("n")))
register("s08_session_frames", M + FRAMES + " SELECT session, dataset, frame FROM keys JOIN frames USING (session)")(lambda s, d: J.session_frames(*keys_and_frames(s, d), "session"))
register("j15_session_report", M + FRAMES + ", n AS (SELECT session, count(*) AS n FROM frames GROUP BY 1) SELECT count(*) AS n_sessions, count(*) - count(n) AS n_empty, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_frames FROM keys LEFT JOIN n USING (session)")(lambda s, d: J.session_report(*keys_and_frames(s, d), "session"))
register("s10_embedding_set", V + " SELECT domain, label, count(*) AS n, CAST(min(len(embedding)) AS INT) AS dims FROM samples GROUP BY 1, 2")(lambda s, d: s.read.parquet(K.write(T.samples(s, d).select("vec_id", "domain", "label", "embedding"), fresh_path(s, "set"), partition_by=["domain"])).groupBy(F.col("domain").cast("string").alias("domain"), "label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("dims")))
register("s12_last_per_key", P + " SELECT source_path, max(line) AS line, arg_max(patch_id, ROW(line, patch_id)) AS patch_id FROM patches GROUP BY 1")(lambda s, d: X.last_per_key(T.patches(s, d).withColumn("o", F.struct("line", "patch_id")), "source_path", "o").select("source_path", "line", "patch_id"))
register("s13_run_reports", R + " SELECT run, 'test.eer' AS metric, round(min(val_eer), 6) AS metric_value FROM runs GROUP BY run UNION ALL SELECT run, 'samples', CAST(max(n_epochs) AS DOUBLE) FROM runs GROUP BY run")(
    lambda s, d: rewriting.flat_metrics(T.runs(s, d).groupBy("run").agg(F.to_json(F.struct(F.struct(F.round(F.min("val_eer"), 6).alias("eer")).alias("test"), F.max("n_epochs").alias("samples"), F.lit("note").alias("text"))).alias("value")), ["run"], "value"))
register("s14_history", R + " SELECT run, epoch, 'val_eer' AS metric, round(val_eer, 6) AS metric_value FROM runs UNION ALL SELECT run, epoch, 'keyed', CAST(o_orderkey AS DOUBLE) FROM runs WHERE o_orderkey % 2 = 0")(
    lambda s, d: X.history(T.runs(s, d).select("run", F.col("epoch").cast("long").alias("epoch"), F.round("val_eer", 6).cast("string").alias("val_eer"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise("n/a").alias("keyed")), ["run", "epoch"]))
register("s15_history_from_lists", R + " SELECT run, CAST(epoch AS INT) AS epoch, round(val_eer, 6) AS val_eer, o_orderkey FROM runs")(
    lambda s, d: X.history_from_lists(T.runs(s, d).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", F.round("val_eer", 6).alias("v"), "o_orderkey"))).alias("a")).select("run", F.col("a.v").alias("val_eer"), F.col("a.o_orderkey").alias("o_orderkey")), "run", ["val_eer", "o_orderkey"]))


def registry_text(s, d):
    src = T.table(s, d, "supplier").select(F.struct(F.concat(F.lit("s"), (F.col("s_suppkey") % 90).cast("string")).alias("name"), F.concat(F.lit("/csv/"), "s_suppkey").alias("csv"), F.element_at(F.array(F.lit("prod"), F.lit("odd"), F.lit(None)), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("role")).alias("s"))
    return src.agg(F.to_json(F.struct(F.collect_list("s").alias("sources"))).alias("value"))


SRC = "WITH r AS (SELECT 's' || CAST(s_suppkey % 90 AS VARCHAR) AS name, CASE s_suppkey % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'odd' ELSE 'train' END AS role FROM supplier)"
register("s16_registry", SRC + " SELECT role, count(*) AS n FROM r GROUP BY 1")(lambda s, d: X.registry(registry_text(s, d)).groupBy("role").agg(F.count("*").alias("n")))
register("s16_registry_errors", SRC + " SELECT name, 'role' AS problem FROM r WHERE role = 'odd' UNION ALL SELECT name, 'name' FROM r GROUP BY name HAVING count(*) > 1")(lambda s, d: X.registry_errors(X.registry(registry_text(s, d))))
register("s17_remote_paths", "SELECT DISTINCT split_part(url, '/', 3) AS bucket, substr(url, strpos(url, split_part(url, '/', 3)) + length(split_part(url, '/', 3)) + 1) AS key FROM pages WHERE url LIKE 'https://%'")(lambda s, d: X.remote_paths(T.table(s, d, "pages"), "url", "https").select(X.uri_parts(F.col("url")).alias("u")).select("u.bucket", "u.key").distinct())
register("s18_media_links", L + " SELECT CAST(media_id AS VARCHAR) AS media_id, coalesce(CAST(source_media_id AS VARCHAR), '') AS source_media_id FROM links")(lambda s, d: X.media_links(T.links(s, d)))
register("s19_new_runs", R + " SELECT DISTINCT run FROM runs WHERE o_custkey % 4 = 0")(lambda s, d: J.not_yet(T.runs(s, d).select("run").distinct(), T.runs(s, d).where("o_custkey % 4 > 0").select("run").distinct(), "run"))
register("s20_stale_sources", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 's_name,s_acctbal' ELSE 's_acctbal' END AS changed FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0")(
    lambda s, d: (lambda t: J.stale(t, t.where("s_suppkey % 5 > 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 7 == 0, F.lit(-1.5)).otherwise(F.col("s_acctbal"))), "s_suppkey", ["s_name", "s_acctbal"]))(T.table(s, d, "supplier")))
OVER = ", files AS (SELECT path, 1 AS ord, score FROM manifest WHERE event_id % 2 = 0 UNION ALL SELECT '/mnt' || substr(path, 6), 2, score / 2 FROM manifest WHERE event_id % 3 = 0)"


def overlaid(s, d):
    m = T.manifest(s, d).select(F.col("event_id").alias("id"), "path", paths.rewritten(F.col("path"), [("/lake", "/mnt")]).alias("moved"), "score")
    files = m.where("id % 2 = 0").select("path", F.lit(1).alias("ord"), "score").unionByName(m.where("id % 3 = 0").select(F.col("moved").alias("path"), F.lit(2).alias("ord"), (F.col("score") / 2).alias("score")))
    return m.drop("score"), files


register("j03_score_overlay", M + OVER + " SELECT event_id AS id, round(CASE WHEN event_id % 3 = 0 THEN score / 2 WHEN event_id % 2 = 0 THEN score END, 6) AS score, CAST(CAST(event_id % 2 = 0 AS INT) + CAST(event_id % 3 = 0 AS INT) AS BIGINT) AS n_hits FROM manifest")(lambda s, d: r6(J.overlay(*overlaid(s, d), ["path", "moved"]).select("id", "score", "n_hits"), "score"))
register("s21_overlay_hits", M + OVER + " SELECT ord, count(*) AS n FROM files GROUP BY ord")(lambda s, d: (lambda rows, files: rows.select("id", F.explode(F.array("path", "moved")).alias("path")).join(files, "path").groupBy("ord").agg(F.count_distinct("id").alias("n")))(*overlaid(s, d)))
register("j01_matched_predictions", P + " SELECT zone, count(*) AS n, count(*) FILTER (WHERE line % 4 = 0) AS n_unmatched FROM patches GROUP BY zone")(
    lambda s, d: J.matched(T.patches(s, d), T.patches(s, d).where("line % 4 > 0").select("patch_id", F.col("label").alias("label_b")), "patch_id").groupBy("zone").agg(F.count("*").alias("n"), F.count_if(~F.col("is_matched")).alias("n_unmatched")))
register("j02_label_mismatch", P + " SELECT patch_id FROM patches WHERE line = 3")(lambda s, d: J.matched(T.patches(s, d), T.patches(s, d).select("patch_id", F.when(F.col("line") == 3, 1 - F.col("label")).otherwise(F.col("label")).alias("label_b")), "patch_id").where("label <> label_b").select("patch_id"))
register("j04_aligned_values", M + " SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN value / 2 END, 6) AS feat FROM manifest")(
    lambda s, d: (lambda m: r6(J.aligned(m.select("event_id", "path", paths.rewritten(F.col("path"), [("/lake", "/mnt")]).alias("orig")), m.where("event_id % 3 = 0").select("path", F.col("value").alias("feat")).unionByName(m.where("event_id % 3 = 1").select(paths.rewritten(F.col("path"), [("/lake", "/mnt")]).alias("path"), (F.col("value") / 2).alias("feat"))), "path", "orig", "feat").select("event_id", "feat"), "feat"))(T.manifest(s, d)))
register("j05_excluded_rows", M + " SELECT event_id FROM manifest WHERE event_id % 5 > 0 AND event_id % 7 > 0")(
    lambda s, d: (lambda m: J.excluded(m.withColumn("orig", paths.rewritten(F.col("path"), [("/lake", "/mnt")])), [m.where("event_id % 5 = 0"), m.where("event_id % 7 = 0").withColumn("path", paths.rewritten(F.col("path"), [("/lake", "/mnt")]))], ["path", "orig"]).select("event_id"))(T.manifest(s, d)))
register("j06_source_links", L + ", o AS (SELECT CASE WHEN a.source_media_id IS NULL THEN 'no_source' WHEN b.media_id IS NULL THEN 'not_found' WHEN b.label <> 0 THEN 'not_live' ELSE 'linked' END AS outcome FROM links a LEFT JOIN links b ON a.source_media_id = b.media_id WHERE a.label = 1) SELECT outcome, count(*) AS n FROM o GROUP BY 1 UNION ALL SELECT 'duplicate', 0")(lambda s, d: J.source_links(T.links(s, d)))
SETS = "WITH t AS (SELECT sha256(text) AS content FROM documents WHERE CAST(substr(source, 4) AS INT) < 15), u AS (SELECT sha256(text) AS content FROM documents WHERE CAST(substr(source, 4) AS INT) >= 15)"


def leak_sets(s, d):
    t = T.table(s, d, "documents").select(F.sha2("text", 256).alias("content"), (F.substring("source", 4, 9).cast("int") < 15).alias("train"))
    return t.where("train"), t.where("NOT train")


register("j07_exact_leakage", SETS + " SELECT content, n_train, n_test, n_train * n_test AS n_pairs FROM (SELECT content, count(*) AS n_train FROM t GROUP BY 1) JOIN (SELECT content, count(*) AS n_test FROM u GROUP BY 1) USING (content)")(lambda s, d: J.same_content(*leak_sets(s, d), "content"))
SIGNS = "SELECT vec_id, list_sum([CASE WHEN embedding[i + 1] > {t} THEN (1::HUGEINT << i) ELSE 0 END FOR i IN range(0, 62)])::BIGINT AS h FROM embeddings"


def signs(s, d, t):
    """A 62-bit hash of each vector: which of its components are above t."""
    bit = lambda x, i: F.when(x > t, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))
    return T.table(s, d, "embeddings").select("vec_id", F.aggregate(F.transform(F.slice("embedding", 1, 62), bit), F.lit(0).cast("long"), lambda a, x: a + x).alias("h"))


register("j08_near_leakage", f"WITH a AS (SELECT h, count(*) AS n FROM ({SIGNS.format(t=0)}) GROUP BY 1), b AS (SELECT h, count(*) AS n FROM ({SIGNS.format(t=0.004)}) GROUP BY 1) SELECT a.h AS train_hash, b.h AS test_hash, CAST(bit_count(xor(a.h, b.h)) AS INT) AS distance, a.n * b.n AS n_pairs FROM a, b WHERE bit_count(xor(a.h, b.h)) <= 3")(
    lambda s, d: J.near_hashes(signs(s, d, 0.0), signs(s, d, 0.004), 3))
SRCS = ", x AS (SELECT grp AS path, event_id % 3 AS source FROM manifest), k AS (SELECT path, source, min(source) OVER (PARTITION BY path) AS kept_in FROM x)"
register("j09_source_overlap", M + SRCS + " SELECT kept_in, source AS dropped_from, count(*) AS n FROM k WHERE kept_in < source GROUP BY 1, 2")(lambda s, d: J.overlap_counts(T.manifest(s, d).select(F.col("grp").alias("path"), (F.col("event_id") % 3).alias("source")), "path", "source"))
register("j10_unambiguous_domains", M + ", x AS (SELECT event_id, dataset AS source, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE dataset || event_type END AS domain FROM manifest), n AS (SELECT domain, count(DISTINCT source) AS n FROM x GROUP BY 1) SELECT event_id, CASE WHEN n > 1 THEN source || '/' || domain ELSE domain END AS domain FROM x JOIN n USING (domain)")(
    lambda s, d: J.unambiguous(T.manifest(s, d).select("event_id", F.col("dataset").alias("source"), F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).otherwise(F.concat("dataset", "event_type")).alias("domain")), "domain", "source").select("event_id", "domain"))
register("j11_merged_tags", "SELECT n_nationkey, r_name AS region_tag, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE r_name END AS name_tag FROM nation JOIN region ON n_regionkey = r_regionkey")(
    lambda s, d: T.table(s, d, "nation").join(T.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("base", F.create_map(F.lit("region"), "r_name", F.lit("name"), "r_name")).withColumn("own", F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("name"), "n_name"))).withColumn("t", J.merged_tags(None, "base", "own")).select("n_nationkey", F.col("t")["region"].alias("region_tag"), F.col("t")["name"].alias("name_tag")))
register("j12_population_counts", M + ", s AS (SELECT dataset, label, count(*) AS sampled FROM manifest WHERE event_id % 20 = 0 GROUP BY 1, 2) SELECT dataset, label, count(*) AS population, any_value(sampled) AS sampled FROM manifest LEFT JOIN s USING (dataset, label) GROUP BY 1, 2")(
    lambda s, d: T.manifest(s, d).groupBy("dataset", "label").agg(F.count("*").alias("population")).join(T.manifest(s, d).where("event_id % 20 = 0").groupBy("dataset", "label").agg(F.count("*").alias("sampled")), ["dataset", "label"], "left"))
register("j14_described_runs", R + " SELECT run, any_value(c_mktsegment) AS segment FROM runs LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON o_custkey = c_custkey GROUP BY run")(
    lambda s, d: T.runs(s, d).select("run", "o_custkey").distinct().join(T.table(s, d, "customer").where("c_custkey % 3 > 0"), F.col("o_custkey") == F.col("c_custkey"), "left").select("run", F.col("c_mktsegment").alias("segment")))
register("j16_provenance", R + " SELECT run, coalesce(any_value(CASE WHEN c_acctbal > 0 THEN c_name END), run) AS label FROM runs LEFT JOIN customer ON o_custkey = c_custkey GROUP BY run")(
    lambda s, d: T.runs(s, d).select("run", "o_custkey").distinct().join(T.table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left").select("run", F.coalesce("c_name", "run").alias("label")))
register("k01_score_table", M + " SELECT path, label, score FROM manifest")(lambda s, d: s.read.parquet(K.write(K.score_table(T.manifest(s, d)), fresh_path(s, "scores"))))
register("k02_prediction_table", M + " SELECT event_id, round(1 / (1 + exp(-(value - 50))), 6) AS score, CAST(value >= 50 AS INT) AS prediction FROM manifest")(lambda s, d: r6(K.prediction_table(T.manifest(s, d).select("event_id", (F.col("value") - 50).alias("logit"))).drop("logit"), "score"))
ID = "substr(sha256('42|' || CAST(event_id AS VARCHAR) || '|' || path), 1, 32)"
register("k03_public_table", M + f" SELECT {ID} AS id, CAST(label AS VARCHAR) || '/' || substr({ID}, 1, 2) || '/' || {ID} AS relative_path, label FROM manifest")(lambda s, d: K.public_private(T.manifest(s, d), "path", "event_id", ["label"])[0])
register("k03_private_map", M + f" SELECT {ID} AS id, event_id, path FROM manifest")(lambda s, d: K.public_private(T.manifest(s, d), "path", "event_id", ["label"])[1])
register("k04_blob_layout", M + f" SELECT label, substr({ID}, 1, 1) AS bucket, count(*) AS n FROM manifest GROUP BY 1, 2")(
    lambda s, d: s.read.option("pathGlobFilter", "*.parquet").schema("id string, label int, bucket string").parquet(K.write(K.public_private(T.manifest(s, d), "path", "event_id", ["label"])[0].select("id", "label", F.substring("id", 1, 1).alias("bucket")).repartition("label", "bucket"), fresh_path(s, "blobs"), partition_by=["label", "bucket"])).groupBy("label", "bucket").agg(F.count("*").alias("n")))
register("k08_summary_json", M + " SELECT dataset, CAST(count(*) AS BIGINT) AS n FROM manifest GROUP BY 1")(lambda s, d: K.summary_json(T.manifest(s, d).groupBy("dataset").agg(F.count("*").alias("n"))).select(F.get_json_object("summary", "$.dataset").alias("dataset"), F.get_json_object("summary", "$.n").cast("long").alias("n")))
register("k10_clean_manifest", BX + f" SELECT id FROM boxes WHERE {CLASS} = 'ok'")(lambda s, d: X.readable(T.boxes(s, d).withColumn("path", F.col("id")), T.boxes(s, d).where("kind > 0").select(F.col("id").alias("path"), (B.error_class(F.col("bbox")) != "ok").alias("is_bad"))).where("status = 'ok'").select("id"))
register("s09_readability", BX + f" SELECT CASE WHEN kind = 0 THEN 'missing' WHEN {CLASS} = 'ok' THEN 'ok' ELSE 'unreadable' END AS status, count(*) AS n FROM boxes GROUP BY 1")(
    lambda s, d: X.readable(T.boxes(s, d).withColumn("path", F.col("id")), T.boxes(s, d).where("kind > 0").select(F.col("id").alias("path"), (B.error_class(F.col("bbox")) != "ok").alias("is_bad"))).groupBy("status").agg(F.count("*").alias("n")))
register("k12_trial_table", R + " SELECT run, CASE WHEN o_custkey % 2 = 0 THEN round(min(val_eer), 6) END AS eer, CASE WHEN o_custkey % 2 = 1 THEN max(n_epochs) END AS epochs FROM runs GROUP BY run, o_custkey")(
    lambda s, d: K.trial_table([T.runs(s, d).where("o_custkey % 2 = 0").groupBy("run").agg(F.round(F.min("val_eer"), 6).alias("eer")), T.runs(s, d).where("o_custkey % 2 = 1").groupBy("run").agg(F.max("n_epochs").alias("epochs"))]))
