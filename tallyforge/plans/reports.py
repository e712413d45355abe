"""The domain report as a whole: trained probes, model scores, affinities and coverage together."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import domain_report as R
from tallyforge.operators import mining, probes, relating, sampling
from tallyforge.operators import vectors as V
from tallyforge.plans import domains as D
from tallyforge.plans import relations as L
from tallyforge.plans import tables as T
from tallyforge.plans.catalog import register
from tallyforge.plans.detection import r6
from tallyforge.sources.staging import fresh_path, staged
from tallyforge.sources.store import SignedStore

CELL = ["domain", "label"]


def aucs(s, d):
    return probes.cell_probes(T.samples(s, d), CELL, F.col("role") == "prod", "label")


register("v09_domain_probe_auc")(lambda s, d: r6(aucs(s, d), "auc"))
register("r11_balanced_folds")(lambda s, d: sampling.balanced_folds(T.manifest(s, d).select("event_id", "grp", "label"), "grp").select("event_id", "grp", "label", "fold"))


def scored(s, d):
    """The samples with the score of a probe that learned on train rows, and its errors at the production threshold."""
    t = T.samples(s, d)
    scores = V.transfer(t.where("role = 'train'"), t, "label", "embedding").select("vec_id", F.col("probability").alias("score"))
    return staged(R.production_errors(t.join(scores, "vec_id"), F.col("role") == "prod"), "scored")


def affinity(s, d):
    """Affinity between all cells (domain and label)."""
    cells = T.samples(s, d).select(F.col("vec_id").alias("id"), F.concat_ws("|", *CELL).alias("cell"))
    return V.affinity(D.near(s, d, "TRUE", "TRUE"), cells)


def cells(s, d):
    near = R.nearest_cells(affinity(s, d)).withColumns({c: F.split("cell", "[|]")[i].cast(kind) for i, (c, kind) in enumerate((("domain", "string"), ("label", "int")))})
    measures = [D.lifts(s, d).select(*CELL, "lift"), D.deltas(s, d).drop("side"), aucs(s, d).select(*CELL, "auc"), near.drop("cell")]
    return R.cell_table(scored(s, d), CELL, "role", "grp", measures)


register("v21_domain_report")(lambda s, d: r6(cells(s, d), "error", "lift", "auc", "self_lift"))


def production(s, d, rows=None):
    """Production rows with coverage, error and nearest domain; rows: the scored samples, if they are there."""
    own = (scored(s, d) if rows is None else rows).where("role = 'prod'").select("vec_id", "label", "domain", "grp", "score", "error")
    cover = D.covered(s, d).select(F.col("query_id").alias("vec_id"), "coverage")
    nearest = V.nearest_value(D.pool_near(s, d), D.pool_cells(s, d), "domain").select(F.col("query_id").alias("vec_id"), F.col("domain").alias("nearest_domain"))
    return staged(own.join(cover, "vec_id", "left").join(nearest, "vec_id", "left"), "production")


def groups(s, d, rows=None):
    rows = production(s, d) if rows is None else rows
    return R.breakdown(rows.withColumn("third", F.col("vec_id") % 3), ["domain", "third"], "label", "vec_id", "nearest_domain", D.LOW)


register("v22_breakdown_report")(lambda s, d: r6(groups(s, d), "coverage", "error"))


@register("v23_findings_report")
def found(s, d):
    rows = production(s, d)
    shared = R.overlaps(T.samples(s, d), "grp", "domain", "domain")
    return r6(R.findings(rows, staged(cells(s, d), "cells"), groups(s, d, rows), shared, D.LOW), "amount")


@register("k09_sample_report")
def sample_report(s, d):
    """A row for each sample: cluster, coverage, uncovered, score, error, nearest domain (production rows), and its place on the map."""
    rows = scored(s, d)
    near = production(s, d, rows).select("vec_id", "coverage", (F.col("coverage") < D.LOW).alias("uncovered"), "nearest_domain")
    on_map = sampling.map_subset(T.samples(s, d), CELL, F.col("role") == "prod", 400, "vec_id").select("vec_id")
    places = D.map_coordinates(s, d).join(on_map, "vec_id")
    out = rows.select("vec_id", "role", *CELL, "score", "error").join(D.regions(s, d).select("vec_id", "cluster"), "vec_id")
    return r6(out.join(near, "vec_id", "left").join(places, "vec_id", "left"), "coverage", "score", "x", "y")


def mined(s, d):
    """Candidates of label 1 outside production, scored by the trained probe, mined by likeness to production and clusters."""
    rows = scored(s, d).drop("error")
    pool, prod = rows.where("role <> 'prod' AND label = 1"), rows.where("role = 'prod' AND label = 1")
    return staged(mining.mine(pool, prod, 30, "vec_id", "domain", low=0.3, high=0.9, clusters=12, per_group=8, bucket_share=0.2), "mined")


register("k05_mined_rows")(lambda s, d: r6(mined(s, d).select("vec_id", "domain", "hardness", "pct", "section", "prod_weight", "bucket", "picked", "control"), "hardness", "pct", "prod_weight"))
register("k05_mining_summary")(lambda s, d: r6(mining.summary(mined(s, d), "domain"), "mean_score_picked", "mean_score_control", "largest_bucket_share"))


LEAKS = """WITH f AS (SELECT sha256(text) AS h, 'doc' || CAST(doc_id AS VARCHAR) AS file, source AS session, CAST(substr(source, 4) AS INT) < 15 AS train FROM documents),
  t AS (SELECT h, count(*) AS n, min(file) AS file, arg_min(session, file) AS session FROM f WHERE train GROUP BY 1), u AS (SELECT h, count(*) AS n, min(file) AS file, arg_min(session, file) AS session FROM f WHERE NOT train GROUP BY 1),
  p AS (SELECT t.h, t.n AS n_train, u.n AS n_test, t.file AS train_file, t.session AS train_session, u.file AS test_file, u.session AS test_session FROM t JOIN u USING (h))"""


def leak_sides(s, d):
    rows = T.table(s, d, "documents").select(F.sha2("text", 256).alias("h"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file"), F.col("source").alias("session"))
    train = F.substring("session", 4, 9).cast("int") < 15
    return rows.where(train), rows.where(~train)


register("k07_leak_pairs", LEAKS + " SELECT 'exact' AS type, h AS train_hash, n_train, n_test, train_file, train_session, test_file, test_session FROM p")(
    lambda s, d: relating.leaking(*leak_sides(s, d), "h", "file", "session").drop("distance", "test_hash"))


@register("k07_leak_files", LEAKS + " SELECT 'exact' AS type, CASE WHEN train THEN 'train' ELSE 'test' END AS split, session, file, h AS hash FROM f WHERE h IN (SELECT h FROM p)")
def leak_files(s, d):
    train, test = leak_sides(s, d)
    leaks = staged(relating.leaking(train, test, "h", "file", "session"), "leaks")
    return relating.leaking_files(train, test, leaks, "h", "file", "session").drop("distance", "n_partners")



NEAR = f"""WITH a AS ({L.SIGNS.format(t=0)}), b AS ({L.SIGNS.format(t=0.004)}), x AS (SELECT DISTINCT h FROM a), y AS (SELECT DISTINCT h FROM b),
  p AS (SELECT x.h AS th, y.h AS uh, bit_count(xor(x.h, y.h)) AS d FROM x, y WHERE bit_count(xor(x.h, y.h)) <= 3), m AS (SELECT CASE WHEN d = 0 THEN 'exact' ELSE 'near' END AS type, * FROM p)
  SELECT type, 'train' AS split, vec_id AS file, min(d)::INT AS distance, count(*) AS n_partners FROM m JOIN a ON a.h = th GROUP BY 1, 3
  UNION ALL SELECT type, 'test', vec_id, min(d)::INT, count(*) FROM m JOIN b ON b.h = uh GROUP BY 1, 3"""


@register("j08_near_leak_files", NEAR)
def near_leak_files(s, d):
    """Every vector whose sign hash, on one side, is at most three bits from one on the other."""
    train, test = (L.signs(s, d, t).withColumn("session", F.lit("all")) for t in (0.0, 0.004))
    leaks = staged(relating.leaking(train, test, "h", "vec_id", "session", 3), "leaks")
    return relating.leaking_files(train, test, leaks, "h", "vec_id", "session").select("type", "split", "file", "distance", "n_partners")


#: Two runs over the same store; in the second one a domain has a new signature and another is gone.
STORE = f"""WITH {T.SAMPLES} SELECT 1 AS run, domain, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM samples GROUP BY domain
  UNION ALL SELECT 2, domain, count(*), sum(vec_id * CASE WHEN domain = 'd3' THEN 2 ELSE 1 END)::BIGINT FROM samples WHERE domain <> 'd9' GROUP BY domain"""


@register("s20_signed_store", STORE)
def signed_store(s, d):
    """What the store holds of each domain after each run: only d3 was computed in the second, by other settings."""
    store, t, out = SignedStore(s, fresh_path(s, "store"), "domain"), T.samples(s, d), None
    for run, (times, kept) in enumerate(((1, "domain <> ''"), (2, "domain <> 'd9'")), 1):
        setting = F.when(F.col("domain") == "d3", F.lit(times)).otherwise(F.lit(1))
        signatures = t.where(kept).select("domain", setting.cast("string").alias("signature")).distinct()
        store.update(signatures, lambda changed, times=times: t.join(changed.select("domain"), "domain").select("domain", (F.col("vec_id") * times).alias("ids")))
        now = staged(store.read("ids long").groupBy("domain").agg(F.count("*").alias("n"), F.sum("ids").alias("ids")).select(F.lit(run).alias("run"), "domain", "n", "ids"), "stored")
        out = now if out is None else out.unionByName(now)
    return out
