"""Queries over the column functions: paths, keys, scores, boxes, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import boxes as B
from tallyforge.functions import keyed, paths, scores
from tallyforge.operators import audit, rewriting
from tallyforge.plans import tables as T
from tallyforge.plans.catalog import register

M, BX, RN = f"WITH {T.MANIFEST} ", f"WITH {T.BOXES} ", f"WITH {T.RUNS} "
RULES = [("/lake", "/mnt"), ("/lake/src1", "/data/one"), ("/lake/src2/", "/data/two")]


def both(name: str, sql: str, source, *columns):
    """A projection query: SQL, and a function of (spark, sf_dir) that selects columns from a source."""
    register(name, sql)(lambda spark, d: source(spark, d).select(*[c() if callable(c) else c for c in columns]))


both("p01_resolved_path", M + "SELECT event_id, CASE WHEN p LIKE '/%' THEN p ELSE '/home/' || dataset || '/' || p END AS full_path FROM (SELECT event_id, dataset, CASE WHEN event_id % 2 = 0 THEN path ELSE substr(path, 7) END AS p FROM manifest)",
     lambda s, d: T.manifest(s, d).withColumn("p", F.when(F.col("event_id") % 2 == 0, F.col("path")).otherwise(F.substring("path", 7, 1000))), "event_id", lambda: paths.resolved(F.col("p"), F.concat(F.lit("/home/"), F.col("dataset"))).alias("full_path"))
both("p02_first_rule_rewrite", M + "SELECT event_id, '/mnt' || substr(path, 6) AS new_path FROM manifest", T.manifest, "event_id", lambda: paths.rewritten(F.col("path"), RULES).alias("new_path"))
LONGEST = "CASE WHEN path LIKE '/lake/src1/%' THEN '/data/one' || substr(path, 11) WHEN path LIKE '/lake/src2/%' THEN '/data/two' || substr(path, 11) WHEN path LIKE '/lake/%' THEN '/mnt' || substr(path, 6) ELSE path END"
both("p03_longest_rule_rewrite", M + f"SELECT event_id, {LONGEST} AS new_path FROM manifest", T.manifest, "event_id", lambda: paths.longest_rewritten(F.col("path"), RULES).alias("new_path"))
register("p03_rewrite_counts", M + f"SELECT dataset, count(*) AS n_rows, CAST(sum(CAST({LONGEST} <> path AS INT)) AS BIGINT) AS n_rewritten FROM manifest GROUP BY dataset")(
    lambda s, d: rewriting.rewrite_counts(T.manifest(s, d), "path", RULES[1:] + RULES[:1], ["dataset"]))
register("p04_prefix_audit", M + "SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT (path LIKE '/lake/src0/%' OR path LIKE '/lake/src3/%')) AS n_uncovered FROM manifest")(
    lambda s, d: rewriting.prefix_audit(T.manifest(s, d), "path", ["/lake/src0", "/lake/src3/"]))
both("p05_label_casts", M + "SELECT event_id, CAST(CASE WHEN t IN ('0','1') THEN t END AS INT) AS strict_label, CAST(CASE WHEN try_cast(t AS DOUBLE) IN (0, 1) THEN try_cast(t AS DOUBLE) END AS INT) AS lenient_label FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(label AS VARCHAR) WHEN 1 THEN CAST(label AS VARCHAR) || '.0' WHEN 2 THEN '2' ELSE 'x' END AS t FROM manifest)",
     lambda s, d: T.manifest(s, d).withColumn("t", F.when(F.col("event_id") % 4 == 0, F.col("label").cast("string")).when(F.col("event_id") % 4 == 1, F.concat(F.col("label").cast("string"), F.lit(".0"))).when(F.col("event_id") % 4 == 2, "2").otherwise("x")), "event_id", lambda: audit.strict_label(F.col("t")).alias("strict_label"), lambda: audit.lenient_label(F.col("t")).alias("lenient_label"))
both("p06_session", M + "SELECT event_id, grp AS auto_session, grp || '/frames' AS parent_session, path AS file_session FROM manifest", T.manifest, "event_id", *[(lambda h=h: paths.session(F.col("path"), h).alias(f"{h}_session")) for h in ("auto", "parent", "file")])
both("p07_mining_group", M + "SELECT event_id, grp AS frame_group, '/lake/' || dataset AS folder_group FROM manifest", T.manifest, "event_id", lambda: paths.mining_group(F.col("path")).alias("frame_group"), lambda: paths.mining_group(F.concat(F.lit("/lake/"), F.col("dataset"), F.lit("/"), F.col("event_id"), F.lit(".png"))).alias("folder_group"))
both("p08_session_key", M + "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN dataset || '/s' || CAST(user_id AS VARCHAR) END AS session_key FROM manifest", T.manifest, "event_id", lambda: paths.session_key(F.when(F.col("event_id") % 5 > 0, F.concat_ws("/", "dataset", F.concat(F.lit("s"), "user_id"), "event_id")).otherwise(F.col("dataset"))).alias("session_key"))
both("p09_stem", M + "SELECT event_id, CAST(event_id AS VARCHAR) AS stem FROM manifest", T.manifest, "event_id", lambda: paths.stem(F.col("path")).alias("stem"))
both("p10_defaulted", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 'unknown' ELSE o_orderpriority END AS category FROM orders", lambda s, d: T.table(s, d, "orders"), "o_orderkey", lambda: paths.defaulted(F.when(F.col("o_orderkey") % 3 == 0, None).when(F.col("o_orderkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority")), "unknown").alias("category"))
both("p11_either_path", M + "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN path ELSE grp || '/' || CAST(event_id AS VARCHAR) END AS image_path FROM manifest", T.manifest, "event_id", lambda: paths.either_path(F.when(F.col("event_id") % 2 == 0, F.col("path")), F.col("grp"), F.col("event_id").cast("string")).alias("image_path"))
both("p12_logit", M + "SELECT event_id, round(ln(p / (1 - p)), 6) AS logit FROM (SELECT event_id, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM manifest)", T.manifest, "event_id", lambda: F.round(scores.logit(F.col("score")), 6).alias("logit"))
both("p13_sigmoid", M + "SELECT event_id, round(CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END, 6) AS p FROM (SELECT event_id, value - 50 AS x FROM manifest)", T.manifest, "event_id", lambda: F.round(scores.sigmoid(F.col("value") - 50), 6).alias("p"))
both("p14_decision", M + "SELECT event_id, CAST(value - 50 >= 0 AS INT) AS prediction FROM manifest", T.manifest, "event_id", lambda: scores.hard(F.col("value") - 50).alias("prediction"))
both("p15_output_summary", """WITH v AS (SELECT vec_id, [CAST(embedding[i] AS DOUBLE) FOR i IN range(1, 5)] AS v FROM embeddings), e AS (SELECT vec_id, v, [exp(x - list_max(v)) FOR x IN v] AS e FROM v),
  p AS (SELECT vec_id, CASE WHEN abs(list_sum(v) - 1) <= 1e-3 THEN v ELSE [x / list_sum(e) FOR x IN e] END AS p FROM e)
  SELECT vec_id, round(list_max(p), 6) AS top_share, ['a', 'b', 'c', 'd'][list_position(p, list_max(p))] AS top_label FROM p""",
     lambda s, d: T.table(s, d, "embeddings").select("vec_id", scores.softmax(F.slice(F.col("embedding").cast("array<double>"), 1, 4)).alias("p")), "vec_id", lambda: F.round(F.array_max("p"), 6).alias("top_share"), lambda: F.element_at(F.array(*map(F.lit, "abcd")), F.array_position("p", F.array_max("p")).cast("int")).alias("top_label"))
both("p16_hardness", M + "SELECT event_id, round(CASE WHEN label = 1 THEN 1 - score ELSE score END, 6) AS hardness FROM manifest", T.manifest, "event_id", lambda: F.round(scores.hardness(F.col("label"), F.col("score")), 6).alias("hardness"))
both("p17_opaque_id", M + "SELECT event_id, substr(sha256('42|' || CAST(event_id AS VARCHAR) || '|' || path), 1, 32) AS id FROM manifest", T.manifest, "event_id", lambda: keyed.opaque_id(F.lit("42"), F.col("event_id").cast("string"), F.col("path")).alias("id"))
both("p18_keyed_order", M + "SELECT event_id, md5('42|' || CAST(event_id AS VARCHAR)) AS shuffle_key FROM manifest", T.manifest, "event_id", lambda: keyed.shuffle_key(42, F.col("event_id")).alias("shuffle_key"))
both("p18_keyed_uniform", M + "SELECT event_id, round((CAST('0x' || substr(md5('42|' || CAST(event_id AS VARCHAR)), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0, 9) AS u FROM manifest", T.manifest, "event_id", lambda: F.round(keyed.uniform(42, F.col("event_id")), 9).alias("u"))
both("p19_forgiving_number", M + "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS number FROM manifest", T.manifest, "event_id", lambda: scores.forgiving(F.when(F.col("event_id") % 3 == 0, F.get_json_object("props", "$.k")).when(F.col("event_id") % 3 == 1, "true").otherwise("abc")).alias("number"))
both("p20_flat_metrics", M + "SELECT event_id, 'k' AS metric, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS metric_value FROM manifest UNION ALL SELECT event_id, 'eval.eer', round(value / 2, 6) FROM manifest UNION ALL SELECT event_id, 'history', round(value, 6) FROM manifest",
     lambda s, d: rewriting.flat_metrics(T.manifest(s, d).select("event_id", F.to_json(F.struct(F.get_json_object("props", "$.k").cast("double").alias("k"), F.struct(F.round(F.col("value") / 2, 6).alias("eer"), F.lit(True).alias("done")).alias("eval"), F.array(F.lit(1.0), F.round("value", 6)).alias("history"))).alias("report")), ["event_id"], "report"), "event_id", "metric", "metric_value")
both("p21_path_tail", M + "SELECT event_id, 'frames/' || CAST(event_id AS VARCHAR) || '.jpg' AS shown FROM manifest", T.manifest, "event_id", lambda: paths.tail(F.col("path"), 2).alias("shown"))
RANK = "(row_number() OVER (PARTITION BY dataset ORDER BY score, event_id) - 1) / CAST(greatest(count(*) OVER (PARTITION BY dataset) - 1, 1) AS DOUBLE)"
both("p22_band_weight", M + "SELECT event_id, round(0.5 + 0.5 * (score - 0.2) / 0.6, 6) AS weight FROM manifest WHERE score BETWEEN 0.2 AND 0.8", lambda s, d: T.manifest(s, d).where("score BETWEEN 0.2 AND 0.8"), "event_id", lambda: F.round(scores.band_weight(F.col("score"), 0.2, 0.8), 6).alias("weight"))
both("p23_section", M + "SELECT event_id, CASE WHEN score > 0.8 THEN 'noise' WHEN score >= 0.2 THEN 'band' ELSE 'easy' END AS section FROM manifest", T.manifest, "event_id", lambda: scores.section(F.col("score"), 0.2, 0.8).alias("section"))
both("p24_shown_number", M + "SELECT event_id, CASE WHEN event_id % 4 > 1 THEN round_even(floor(value * 4) / 16, 3) END AS shown FROM manifest", T.manifest, "event_id", lambda: scores.shown(F.when(F.col("event_id") % 4 == 0, None).when(F.col("event_id") % 4 == 1, float("nan")).otherwise(F.floor(F.col("value") * 4) / 16)).alias("shown"))
both("p25_short_run", RN + "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS short_name, substr(o_orderpriority, 1, 5) AS comment FROM runs", T.runs, "o_orderkey", lambda: paths.short_run(F.col("run")).alias("short_name"), lambda: F.substring("o_orderpriority", 1, 5).alias("comment"))
register("p26_shortest_suffix", M + """, p AS (SELECT dataset, path, string_split(path, '/') AS s FROM manifest), d AS (SELECT dataset, k, count(*) AS n, count(DISTINCT array_to_string(s[-k:], '/')) AS u FROM p, range(1, 7) r(k) WHERE k <= len(s) GROUP BY dataset, k)
  SELECT dataset, min(k) AS depth FROM d JOIN (SELECT dataset AS ds, count(*) AS total FROM manifest GROUP BY ALL) ON ds = dataset WHERE n = u AND n = total GROUP BY dataset""")(
    lambda s, d: rewriting.distinct_depth(T.manifest(s, d), "path", ["dataset"]))



def frame():
    """Width and height of the boxes' frame."""
    return F.lit(1000.0), F.lit(700.0)


GOOD = BX + ", g AS (SELECT * FROM boxes WHERE kind > 3 AND x2 > x1 AND y2 > y1)"


def good(s, d):
    return T.boxes(s, d).where("kind > 3 AND x2 > x1 AND y2 > y1").withColumn("b", F.array("x1", "y1", "x2", "y2"))


CLASS = "CASE kind WHEN 0 THEN 'empty' WHEN 1 THEN 'empty' WHEN 2 THEN 'size' WHEN 3 THEN 'degenerate' ELSE CASE WHEN x2 > x1 AND y2 > y1 THEN 'ok' ELSE 'degenerate' END END"
both("g01_box", BX + f"SELECT id, flag, CASE WHEN {CLASS} = 'ok' THEN x1 END AS x1, CASE WHEN {CLASS} = 'ok' THEN y2 END AS y2 FROM boxes", T.boxes, "id", "flag", lambda: F.get(B.box(F.col("bbox")), F.lit(0)).alias("x1"), lambda: F.get(B.box(F.col("bbox")), F.lit(3)).alias("y2"))
register("g02_box_audit", BX + f"SELECT {CLASS} AS error_class, count(*) AS n FROM boxes GROUP BY 1")(lambda s, d: audit.box_audit(T.boxes(s, d), "bbox"))
both("g03_exclusions", BX + "SELECT id, CAST(CASE WHEN kind <= 3 THEN 0 WHEN x2 > x1 AND y2 > y1 THEN CASE WHEN kind % 2 = 0 THEN 2 ELSE 1 END ELSE 0 END AS INT) AS n_boxes FROM boxes", T.boxes, "id", lambda: F.coalesce(F.size(B.box_list(F.when(F.col("kind") <= 3, "[[1,2]]").when(F.col("kind") % 2 == 0, F.concat(F.lit("["), "bbox", F.lit(","), "bbox", F.lit("]"))).otherwise(F.col("bbox")))), F.lit(0)).alias("n_boxes"))
QUADX, QUADY = ["x1", "x2", "x2 + 0.5", "x1 - 0.5"], ["y1", "y1 + 0.5", "y2", "y2 + 1.5"]
QSQL = "SELECT id, flag, round_even(greatest(0.0, least({x})), 0) AS a, round_even(greatest(0.0, least({y})), 0) AS b, round_even(least(1000.0, greatest({x})), 0) AS c, round_even(least(700.0, greatest({y})), 0) AS d FROM boxes".format(x=", ".join(QUADX), y=", ".join(QUADY))


def quad():
    return B.quad_box([F.expr(x) for x in QUADX], [F.expr(y) for y in QUADY], *frame())


both("g04_quad_box", BX + f"SELECT id, CASE WHEN c - a >= 8 AND d - b >= 8 THEN a END AS left_edge, CASE WHEN c - a >= 8 AND d - b >= 8 THEN d END AS bottom_edge FROM ({QSQL})", T.boxes, "id", lambda: F.get(quad(), F.lit(0)).alias("left_edge"), lambda: F.get(quad(), F.lit(3)).alias("bottom_edge"))
register("g05_detector_conversion", BX + f"SELECT CASE WHEN upper(trim(flag)) <> 'R' THEN 'decision' WHEN c - a >= 8 AND d - b >= 8 THEN 'ok' ELSE 'geometry' END AS reason, count(*) AS n FROM ({QSQL}) GROUP BY 1")(
    lambda s, d: audit.conversion_counts(T.boxes(s, d), F.upper(F.trim("flag")) == "R", quad()))
SIDES = ["left_edge", "top_edge", "right_edge", "bottom_edge"]


def four(b):
    return [(lambda i=i, n=n: F.get(b(), F.lit(i)).alias(n)) for i, n in enumerate(SIDES)]


def corners(sql: str, ok: str) -> str:
    return ", ".join(f"CASE WHEN {ok} THEN {x} END AS {n}" for x, n in zip(("a", "b", "c", "d"), SIDES, strict=True))


both("g06_clip_box", GOOD + f"SELECT id, {corners('', 'c > a AND d > b')} FROM (SELECT id, greatest(0.0, floor(x1 - 20.25)) AS a, greatest(0.0, floor(y1 - 20.25)) AS b, least(1000.0, ceil(x2 - 20.25)) AS c, least(700.0, ceil(y2 - 20.25)) AS d FROM g)", good, "id", *four(lambda: B.clipped(F.transform("b", lambda x: x - 20.25), *frame())))
both("g07_sorted_clip", GOOD + f"SELECT id, {corners('', 'c - a >= 8 AND d - b >= 8')} FROM (SELECT id, greatest(0, CAST(trunc(x1 + 0.75) AS INT)) AS a, greatest(0, CAST(trunc(y1 + 0.75) AS INT)) AS b, least(1000, CAST(trunc(x2 + 0.75) AS INT)) AS c, least(700, CAST(trunc(y2 + 0.75) AS INT)) AS d FROM g)", good, "id", *four(lambda: B.sorted_clip(F.array(F.col("x2") + 0.75, F.col("y1") + 0.75, F.col("x1") + 0.75, F.col("y2") + 0.75), *frame())))
both("g08_expanded_box", GOOD + f"SELECT id, {corners('', 'c > a AND d > b')} FROM (SELECT id, greatest(0.0, floor(x1 - (x2 - x1) * 12.5 / 100)) AS a, greatest(0.0, floor(y1 - (y2 - y1) * 12.5 / 100)) AS b, least(1000.0, ceil(x2 + (x2 - x1) * 12.5 / 100)) AS c, least(700.0, ceil(y2 + (y2 - y1) * 12.5 / 100)) AS d FROM g)", good, "id", *four(lambda: B.expanded(F.col("b"), 12.5, *frame())))
both("g09_interior", GOOD + "SELECT id, x1 + (x2 - x1) * 0.0625 AS left_edge, y1 + (y2 - y1) * 0.0625 AS top_edge, x2 - (x2 - x1) * 0.0625 AS right_edge, y2 - (y2 - y1) * 0.0625 AS bottom_edge FROM g", good, "id", *four(lambda: B.interior(F.col("b"), 0.0625)))
both("g10_intersection", GOOD + "SELECT id, round(greatest(0.0, least(x2, 400.0) - greatest(x1, 100.0)) * greatest(0.0, least(y2, 300.0) - greatest(y1, 50.0)), 6) AS shared FROM g", good, "id", lambda: F.round(B.intersection(F.col("b"), F.array(*map(F.lit, (100.0, 50.0, 400.0, 300.0)))), 6).alias("shared"))


def patch():
    return F.array(*map(F.lit, (200.0, 100.0, 328.0, 228.0)))


SHARE = "greatest(0.0, least(x2, 328.0) - greatest(x1, 200.0)) * greatest(0.0, least(y2, 228.0) - greatest(y1, 100.0)) / 16384.0"
both("g11_zone", GOOD + f"SELECT id, CASE WHEN s >= 0.999 THEN 'interior' WHEN s = 0 THEN 'exterior' WHEN s BETWEEN 0.125 AND 0.875 THEN 'edge' END AS zone FROM (SELECT id, {SHARE} AS s FROM g)", good, "id", lambda: B.zone(patch(), F.col("b"), 0.125).alias("zone"))
both("g12_worst_overlap", GOOD + f"SELECT id, round(greatest({SHARE}, greatest(0.0, 328.0 - 300.0) * greatest(0.0, 228.0 - 200.0) / 16384.0), 6) AS worst FROM g", good, "id", lambda: F.round(B.worst_overlap(patch(), F.array(F.col("b"), F.array(*map(F.lit, (300.0, 200.0, 900.0, 600.0))))), 6).alias("worst"))
LONG = "greatest(x2 - x1, y2 - y1)"


def scale():
    return B.export_scale(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 96)


both("g15_export_scale", GOOD + f"SELECT id, CAST(greatest(1, round_even(1000 * s, 0)) AS INT) AS export_width, CAST(greatest(1, round_even(700 * s, 0)) AS INT) AS export_height, s >= 1 AS not_downscaled FROM (SELECT id, least(1.0, 96.0 / {LONG}) AS s FROM g)", good, "id", lambda: B.scaled_side(F.lit(1000), scale()).alias("export_width"), lambda: B.scaled_side(F.lit(700), scale()).alias("export_height"), lambda: (scale() >= 1).alias("not_downscaled"))
both("g16_scaled_box", GOOD + f"SELECT id, round_even(x1 * s, 2) AS left_edge, round_even(y1 * s, 2) AS top_edge, round_even(x2 * s, 2) AS right_edge, round_even(y2 * s, 2) AS bottom_edge FROM (SELECT *, least(1.0, 96.0 / {LONG}) AS s FROM g)", good, "id", *four(lambda: B.scaled_box(F.col("b"), scale())))
both("g17_legible_px", GOOD + f"SELECT id, round(0.04 * least(x2 - x1, y2 - y1) * s, 6) AS text_px, round(0.35 * least(x2 - x1, y2 - y1) * s, 6) AS face_px FROM (SELECT *, least(1.0, 96.0 / {LONG}) AS s FROM g)", good, "id", lambda: F.round(B.legible_px(F.col("b"), scale(), 0.04), 6).alias("text_px"), lambda: F.round(B.legible_px(F.col("b"), scale(), 0.35), 6).alias("face_px"))
both("g18_fills_frame", GOOD + "SELECT id, x1 <= 0.02 * 1000 AND y1 <= 0.02 * 300 AND x2 >= 0.98 * 500 AND y2 >= 0.98 * 300 AS fills FROM g", good, "id", lambda: B.fills_frame(F.array("x1", "y1", F.col("x2") * 2.0, "y2"), F.lit(1000.0), F.lit(300.0)).alias("fills"))
both("g19_corner_confidence", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 4 > 0 THEN least(l_discount, l_tax, l_quantity / 50, 0.5) END AS confidence FROM lineitem", lambda s, d: T.table(s, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", lambda: B.least_peak([F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, F.when(F.col("l_orderkey") % 4 > 0, 0.5)]).alias("confidence"))
both("g20_frame_share", GOOD + "SELECT id, round(greatest((least(x2, 1000.0) - greatest(x1, 0.0)) / 1000, (least(y2, 700.0) - greatest(y1, 0.0)) / 700), 6) AS share FROM g", good, "id", lambda: F.round(B.frame_share(F.col("b"), *frame()), 6).alias("share"))
both("g21_letterbox", GOOD + f"SELECT id, w, h, CAST(floor((224 - w) / 2.0) AS INT) AS left_pad, CAST(floor((224 - h) / 2.0) AS INT) AS top_pad FROM (SELECT id, CAST(greatest(1, round_even((x2 - x1) * s, 0)) AS INT) AS w, CAST(greatest(1, round_even((y2 - y1) * s, 0)) AS INT) AS h FROM (SELECT *, least(1.0, 224.0 / {LONG}) AS s FROM g))",
     lambda s, d: good(s, d).withColumn("l", B.letterbox(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), 224)), "id", lambda: F.col("l.w").alias("w"), lambda: F.col("l.h").alias("h"), lambda: F.col("l.left").alias("left_pad"), lambda: F.col("l.top").alias("top_pad"))

LISTING = ", listing AS (SELECT path AS file FROM manifest WHERE event_id % 3 > 0)"


def listing(s, d):
    return T.manifest(s, d).where("event_id % 3 > 0").select(F.col("path").alias("file"))


register("f01_missing_files", M + LISTING + " SELECT dataset, count(*) AS n_rows, count(file) AS n_found, count(*) - count(file) AS n_missing FROM manifest LEFT JOIN listing ON path = file GROUP BY dataset")(
    lambda s, d: audit.missing_counts(T.manifest(s, d), listing(s, d), "path", "file", ["dataset"]))
register("f01_existing_rows", M + LISTING + " SELECT event_id FROM manifest WHERE path IN (SELECT file FROM listing)")(lambda s, d: audit.existing(T.manifest(s, d), listing(s, d), "path", "file").select("event_id"))
both("f02_empty_paths", M + "SELECT event_id FROM manifest WHERE event_id % 10 > 0", lambda s, d: audit.with_path(T.manifest(s, d).withColumn("path", F.when(F.col("event_id") % 10 == 0, "  ").otherwise(F.col("path"))), "path"), "event_id")
both("f03_decision_filter", "SELECT o_orderkey FROM orders WHERE upper(trim(o_orderstatus)) = 'F'", lambda s, d: audit.decided(T.table(s, d, "orders").withColumn("decision", F.concat(F.lower("o_orderstatus"), F.lit(" "))), "decision", "F"), "o_orderkey")
both("f04_drop_datasets", M + "SELECT event_id FROM manifest WHERE dataset NOT IN ('src1', 'src4')", lambda s, d: T.manifest(s, d).where(~F.col("dataset").isin("src1", "src4")), "event_id")
both("f05_usable_scores", M + "SELECT event_id FROM manifest WHERE event_id % 6 > 1", lambda s, d: T.manifest(s, d).withColumn("score", F.when(F.col("event_id") % 6 == 0, None).when(F.col("event_id") % 6 == 1, float("nan")).otherwise(F.col("score"))).where(scores.usable(F.col("score"))), "event_id")
both("f06_usable_geometry", BX + f"SELECT id FROM boxes WHERE {CLASS} = 'ok'", lambda s, d: T.boxes(s, d).where(B.box(F.col("bbox")).isNotNull()), "id")
register("f07_class_with_exclusion", M + "SELECT count(*) AS n_class, count(*) FILTER (WHERE event_id % 7 = 0) AS n_excluded FROM manifest WHERE label = 1")(
    lambda s, d: audit.class_exclusion(T.manifest(s, d), 1, T.manifest(s, d).where("event_id % 7 = 0").select("path"), "path"))
both("f08_percentile_band", M + f"SELECT event_id FROM (SELECT event_id, {RANK} AS pct FROM manifest) WHERE pct BETWEEN 0.6 AND 0.9", lambda s, d: audit.percentile_rank(T.manifest(s, d), ["dataset"], "score", "event_id").where("pct BETWEEN 0.6 AND 0.9"), "event_id")
register("f09_minimum_support", M + "SELECT grp, count(*) AS n FROM manifest GROUP BY grp HAVING count(*) >= 12")(lambda s, d: T.manifest(s, d).groupBy("grp").agg(F.count("*").alias("n")).where("n >= 12"))
register("f10_plain_evaluations", RN + "SELECT run, round(min(val_eer), 6) AS eer FROM runs WHERE coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 90 END, 0) = 0 GROUP BY run")(
    lambda s, d: T.runs(s, d).withColumn("rotate", F.when(F.col("o_orderkey") % 4 == 0, 90)).where(F.coalesce("rotate", F.lit(0)) == 0).groupBy("run").agg(F.round(F.min("val_eer"), 6).alias("eer")))
both("f11_artefact_names", M + "SELECT event_id FROM manifest WHERE event_id % 5 IN (0, 3)", lambda s, d: T.manifest(s, d).withColumn("name", F.concat("dataset", F.element_at(F.array(*map(F.lit, ("/report.json", "/../report.json", "/model.onnx", "/history.csv", "/report.json.tmp"))), (F.col("event_id") % 5 + 1).cast("int")))).where(audit.is_artefact(F.col("name"))), "event_id")
register("f12_all_boxed", BX + f"SELECT flag, count(*) FILTER (WHERE {CLASS} <> 'ok') AS n_without, count(*) FILTER (WHERE {CLASS} <> 'ok') = 0 AS all_boxed FROM boxes GROUP BY flag")(lambda s, d: audit.all_boxed(T.boxes(s, d), "bbox", ["flag"]))
