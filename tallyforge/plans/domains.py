"""Queries over neighbours, coverage and domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import aggregates as A
from tallyforge.operators import domain_report as R
from tallyforge.operators import gaps as G
from tallyforge.operators import metrics as X
from tallyforge.operators import mining
from tallyforge.operators import sampling as S
from tallyforge.operators import vectors as V
from tallyforge.plans import tables as T
from tallyforge.plans.catalog import register
from tallyforge.plans.detection import r6
from tallyforge.sources.staging import staged

K = 5
VS = f"WITH {T.SAMPLES}"


def near_sql(name: str, queries: str, index: str, k: int = K) -> str:
    return f""", {name} AS (SELECT query_id, n AS rank, neighbour_id, distance FROM (SELECT q.vec_id AS query_id, i.vec_id AS neighbour_id, list_distance(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), i.vec_id) AS n FROM samples q JOIN samples i ON q.grp <> i.grp AND ({index}) WHERE {queries}) WHERE n <= {k})"""


def near(s, d, queries, index, k=K):
    t = T.samples(s, d)
    return staged(V.neighbours(t.where(queries), t.where(index), k), "near")


register("j13_neighbours", VS + near_sql("nb", "q.role = 'prod'", "i.role <> 'prod'") + " SELECT query_id, CAST(rank AS INT) AS rank, neighbour_id, round(distance, 6) AS distance FROM nb")(lambda s, d: r6(near(s, d, "role = 'prod'", "role <> 'prod'"), "distance"))
LOW = 0.8  # coverage under which a production row counts as uncovered
COVER = VS + near_sql("nb", "q.role = 'prod'", "q.label = i.label AND i.role IN ('prod', 'train')") + """, c AS (SELECT label, count(*) FILTER (WHERE role = 'train') AS pool, count(*) FILTER (WHERE role = 'prod') AS prod FROM samples GROUP BY 1),
  v AS (SELECT query_id, q.label, avg(CAST(s.role = 'train' AS INT)) / (max(pool) / (max(pool) + max(prod) - 1)) AS coverage FROM nb JOIN samples q ON query_id = q.vec_id JOIN samples s ON neighbour_id = s.vec_id JOIN c ON c.label = q.label GROUP BY 1, 2)"""


def lists(s, d):
    """Each production row's nearest rows of its label in production (domain null) and in every other domain."""
    t = T.samples(s, d).withColumn("cell", F.when(F.col("role") == "prod", F.lit("")).otherwise(F.col("domain")))
    near_ = V.neighbours_by(t.where("role = 'prod'"), t, "cell", K, within="label")
    return staged(near_.select("query_id", F.when(F.col("cell") != "", F.col("cell")).alias("domain"), "neighbour_id", "distance"), "lists")


def choices(s, d):
    """choice, domain: the pools that are asked about: base (all of train), -d (train without d) and +d (train and d)."""
    domains = T.samples(s, d).where("role <> 'prod'").select("domain", "role").distinct()
    train, other = domains.where("role = 'train'").select("domain"), domains.where("role <> 'train'").select("domain")
    base = train.select(F.lit("base").alias("choice"), "domain")
    named = domains.select(F.concat(F.when(F.col("role") == "train", "-").otherwise("+"), "domain").alias("choice"), F.col("domain").alias("_own"))
    pairs = named.join(F.broadcast(train), F.col("domain") != F.col("_own"))  # domains are few
    added = other.select(F.concat(F.lit("+"), "domain").alias("choice"), "domain")
    return base.unionByName(pairs.select("choice", "domain")).unionByName(added)


def coverages(s, d, which=None):
    t = T.samples(s, d)
    prod = F.col("role") == "prod"
    sizes = t.groupBy("label", F.when(~prod, F.col("domain")).alias("domain")).agg(F.count("*").alias("n"))
    asked = choices(s, d) if which is None else choices(s, d).where(F.col("choice") == which)
    return V.coverage_of(lists(s, d), asked, sizes, t.where(prod).select(F.col("vec_id").alias("query_id"), "label"), K)


def covered(s, d):
    """query_id, label, coverage: coverage of production by train of the same label."""
    t = T.samples(s, d)
    pool = t.where("role IN ('prod', 'train')")
    out = None
    for label in (0, 1):
        own = pool.where(F.col("label") == label)
        prod, train = own.where("role = 'prod'"), own.where("role = 'train'")
        flags = own.select(F.col("vec_id").alias("neighbour_id"), (F.col("role") == "train").alias("pool"))
        nb = staged(V.neighbours(prod, own, K), "covering")
        part = V.coverage(nb, flags, train.count(), prod.count()).withColumn("label", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


register("v02_coverage", COVER + " SELECT query_id, label, round(coverage, 6) AS coverage FROM v")(lambda s, d: r6(covered(s, d), "coverage"))
register("v03_uncovered", COVER + f" SELECT query_id, label, coverage < {LOW} AS uncovered FROM v")(lambda s, d: covered(s, d).select("query_id", "label", (F.col("coverage") < LOW).alias("uncovered")))
#: The default of the report.
register("v03_uncovered_default", COVER + f" SELECT query_id, label, coverage < {R.UNCOVERED} AS uncovered FROM v")(lambda s, d: covered(s, d).select("query_id", "label", (F.col("coverage") < R.UNCOVERED).alias("uncovered")))
register("v25_headline", COVER + f" SELECT label, count(*) AS n, count(*) FILTER (WHERE coverage >= {LOW}) AS n_covered, round(avg(CAST(coverage >= {LOW} AS INT)), 6) AS covered_share FROM v GROUP BY 1")(
    lambda s, d: r6(covered(s, d).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("coverage") >= LOW).alias("n_covered"), F.avg((F.col("coverage") >= LOW).cast("double")).alias("covered_share")), "covered_share"))
LIFT_PARTS = near_sql("lnb", "q.role = 'prod'", "q.label = i.label AND i.role <> 'prod'") + """, h AS (SELECT domain, label, count(*) AS hits FROM lnb JOIN samples ON neighbour_id = vec_id GROUP BY 1, 2), n AS (SELECT domain, label, count(*) AS n FROM samples WHERE role <> 'prod' GROUP BY 1, 2),
  l AS (SELECT domain, label, n, coalesce(hits, 0) AS hits, (coalesce(hits, 0) / sum(coalesce(hits, 0)) OVER (PARTITION BY label)) / (n / sum(n) OVER (PARTITION BY label)) AS lift FROM n LEFT JOIN h USING (domain, label))"""
LIFT = VS + LIFT_PARTS


def pool_cells(s, d):
    return T.samples(s, d).where("role <> 'prod'").select(F.col("vec_id").alias("neighbour_id"), "domain", "label")


def pool_near(s, d):
    return near(s, d, "role = 'prod' AND label = 1", "label = 1 AND role <> 'prod'").unionByName(near(s, d, "role = 'prod' AND label = 0", "label = 0 AND role <> 'prod'"))


def lifts(s, d):
    return V.lift(pool_near(s, d), pool_cells(s, d), ["domain", "label"])


register("v04_production_lift", LIFT + " SELECT domain, label, n, hits, round(lift, 6) AS lift FROM l")(lambda s, d: r6(lifts(s, d), "lift"))
register("v05_nearest_domain", LIFT + ", c AS (SELECT query_id, domain, count(*) AS n FROM lnb JOIN samples ON neighbour_id = vec_id GROUP BY 1, 2) SELECT query_id, arg_min(domain, ROW(-n, domain)) AS domain FROM c GROUP BY 1")(lambda s, d: V.nearest_value(pool_near(s, d), pool_cells(s, d), "domain"))
#: Every choice of pool is searched anew here.
DELTA_PARTS = """, dm AS (SELECT DISTINCT domain, role FROM samples WHERE role <> 'prod'),
  ch AS (SELECT 'base' AS choice, domain FROM dm WHERE role = 'train' UNION ALL SELECT CASE WHEN a.role = 'train' THEN '-' ELSE '+' END || a.domain, b.domain FROM dm a JOIN dm b ON b.role = 'train' AND a.domain <> b.domain UNION ALL SELECT '+' || domain, domain FROM dm WHERE role <> 'train'),
  pl AS (SELECT choice, vec_id, label, grp, embedding, TRUE AS pool FROM ch JOIN samples USING (domain) UNION ALL SELECT choice, vec_id, label, grp, embedding, FALSE FROM (SELECT DISTINCT choice FROM ch), samples WHERE role = 'prod'),
  sz AS (SELECT choice, label, count(*) FILTER (WHERE pool) AS pool, count(*) AS everything FROM pl GROUP BY 1, 2),
  dn AS (SELECT choice, query_id, label, pool FROM (SELECT i.choice, q.vec_id AS query_id, q.label, i.pool, row_number() OVER (PARTITION BY i.choice, q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), i.vec_id) AS n FROM samples q JOIN pl i ON q.grp <> i.grp AND q.label = i.label WHERE q.role = 'prod') WHERE n <= """ + str(K) + """),
  dv AS (SELECT dn.choice, query_id, dn.label, avg(CAST(dn.pool AS INT)) / (max(sz.pool) / (max(everything) - 1)) AS coverage FROM dn JOIN sz ON dn.choice = sz.choice AND dn.label = sz.label GROUP BY 1, 2, 3),
  dl AS (SELECT substr(x.choice, 2) AS domain, CASE WHEN x.choice[1] = '-' THEN 'train' ELSE 'other' END AS side, x.label, count(*) FILTER (WHERE CASE WHEN x.choice[1] = '-' THEN y.coverage >= 0.8 AND x.coverage < 0.8 ELSE x.coverage >= 0.8 AND y.coverage < 0.8 END) AS delta_covered FROM dv x JOIN dv y USING (query_id) WHERE x.choice <> 'base' AND y.choice = 'base' GROUP BY 1, 2, 3)"""


def deltas(s, d):
    """domain, side, label, delta_covered: production rows that a train domain's removal uncovers, or that adding another domain covers."""
    all_ = staged(coverages(s, d), "coverages")
    base = all_.where("choice = 'base'").select("query_id", F.col("coverage").alias("base"))
    j = all_.where("choice <> 'base'").join(base, "query_id")
    minus = F.col("choice").startswith("-")
    changed = F.when(minus, (F.col("base") >= LOW) & (F.col("coverage") < LOW)).otherwise((F.col("coverage") >= LOW) & (F.col("base") < LOW))
    return j.groupBy(F.expr("substring(choice, 2)").alias("domain"), F.when(minus, "train").otherwise("other").alias("side"), "label").agg(F.count_if(changed).alias("delta_covered"))


register("v06_delta_covered", VS + DELTA_PARTS + " SELECT domain, side, label, delta_covered FROM dl")(deltas)


AFF = VS + near_sql("nb", "TRUE", "TRUE") + """, sz AS (SELECT domain, count(*) AS size FROM samples GROUP BY 1), cn AS (SELECT a.domain AS src, b.domain AS dst, count(*) AS n FROM nb JOIN samples a ON query_id = a.vec_id JOIN samples b ON neighbour_id = b.vec_id GROUP BY 1, 2),
  g AS (SELECT x.domain AS src, y.domain AS dst, y.size, coalesce(n, 0) AS n FROM sz x CROSS JOIN sz y LEFT JOIN cn ON x.domain = src AND y.domain = dst), af AS (SELECT src, dst, n, log2((n + 1) / (sum(n) OVER (PARTITION BY src) * size / (SELECT sum(size) FROM sz) + 1)) AS log_lift FROM g)"""


def affinities(s, d):
    return V.affinity(near(s, d, "TRUE", "TRUE"), T.samples(s, d).select(F.col("vec_id").alias("id"), F.col("domain").alias("cell")))


register("v07_affinity", AFF + " SELECT src, dst, n AS count, round(log_lift, 6) AS log_lift FROM af")(lambda s, d: r6(affinities(s, d), "log_lift"))
register("v08_affinity_distance", AFF + ", sy AS (SELECT x.src, x.dst, (x.log_lift + y.log_lift) / 2 AS v FROM af x JOIN af y ON x.src = y.dst AND x.dst = y.src) SELECT p.src AS a, q.src AS b, round(1 - corr(p.v, q.v), 6) AS distance FROM sy p JOIN sy q ON p.dst = q.dst AND p.src < q.src GROUP BY 1, 2")(lambda s, d: r6(V.affinity_distance(affinities(s, d)), "distance"))


@register("v10_scaled_domain_auc")
def scaled_auc(s, d):
    value = G.side_auc(T.samples(s, d), F.col("role") == "prod", "vec_id", "embedding")
    return s.createDataFrame([(None if value is None else round(value, 6),)], "auc double")


@register("v11_production_weights")
def production_weights(s, d):
    t = T.samples(s, d)
    return r6(mining.likeness(t.where("role <> 'prod'"), t.where("role = 'prod'"), "vec_id", "embedding").withColumnRenamed("prod_weight", "weight"), "weight")


register("v12_transfer_auc")(lambda s, d: r6(X.auc(V.transfer(*[T.samples(s, d).where((F.col("role") == "train") == t) for t in (True, False)], "label", "embedding"), score="probability"), "auc"))
register("v01_reduced_vectors")(lambda s, d: V.centred_pca(T.samples(s, d), S.capped(T.samples(s, d), ["domain", "label"], 1000, "vec_id"), 16)[0].select("vec_id", "z"))
register("v13_centroid_distance", VS + ", e AS (SELECT role = 'prod' AS side, generate_subscripts(embedding, 1) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM samples), m AS (SELECT side, p, avg(x) AS m, var_pop(x) AS v FROM e GROUP BY 1, 2) SELECT round((SELECT sqrt(sum((a.m - b.m) ** 2)) FROM m a JOIN m b ON a.p = b.p AND a.side AND NOT b.side) / (SELECT avg(sq) FROM (SELECT sqrt(sum(v)) AS sq FROM m GROUP BY side)), 6) AS distance")(
    lambda s, d: r6(V.centroid_distance(T.samples(s, d), F.col("role") == "prod"), "distance"))


@register("v14_frechet_distance")
def frechet(s, d):
    value = G.frechet(*G.moments(T.samples(s, d), F.col("role") == "prod"))
    return s.createDataFrame([(round(value, 6),)], "distance double")


CROSS = VS + near_sql("nb", "TRUE", "TRUE") + " SELECT a.role = 'prod' AS prod, round(avg(CAST((b.role = 'prod') <> (a.role = 'prod') AS INT)), 6) AS cross_share FROM nb JOIN samples a ON query_id = a.vec_id JOIN samples b ON neighbour_id = b.vec_id GROUP BY 1"


def cross_share(s, d, where="TRUE"):
    side = T.samples(s, d).where(where).select("vec_id", (F.col("role") == "prod").alias("side"))
    n = near(s, d, where, where).join(side.select(F.col("vec_id").alias("query_id"), F.col("side").alias("prod")), "query_id").join(side.select(F.col("vec_id").alias("neighbour_id"), F.col("side").alias("other")), "neighbour_id")
    return r6(n.groupBy("prod").agg(F.avg((F.col("prod") != F.col("other")).cast("double")).alias("cross_share")), "cross_share")


register("v15_cross_share", CROSS)(cross_share)


register("v16_gap_report")(lambda s, d: r6(G.gap_report(T.samples(s, d), F.col("role") == "prod", k=K), "amount"))


def regions(s, d):
    t = T.samples(s, d)
    return staged(V.kmeans(t, max(2, min(30, t.count() // 20)), "embedding"), "regions")


register("v17_regions")(lambda s, d: regions(s, d).select("vec_id", "cluster"))
register("v18_candidate_buckets")(lambda s, d: V.kmeans(V.centred_pca(T.samples(s, d), T.samples(s, d), 16)[0].where("role = 'candidate'"), 8, "z").select("vec_id", "cluster"))
REG = VS + ", r AS (SELECT *, CAST(label * 5 + vec_id % 7 AS INT) % 6 AS cluster FROM samples)"


def fixed_regions(s, d):
    return T.samples(s, d).withColumn("cluster", ((F.col("label") * 5 + F.col("vec_id") % 7).cast("int") % 6))


register("v19_region_profile", REG + " SELECT cluster, count(*) AS n, count(*) FILTER (WHERE role = 'prod') AS n_prod, CASE WHEN count(*) FILTER (WHERE role = 'prod') = 0 THEN 'pool_only' WHEN count(*) FILTER (WHERE role = 'prod') > 0.8 * count(*) THEN 'production_gap' ELSE 'shared' END AS status FROM r GROUP BY 1")(lambda s, d: V.region_profile(fixed_regions(s, d), "cluster", F.col("role") == "prod"))
register("v20_closest_members", REG + """, e AS (SELECT cluster, generate_subscripts(embedding, 1) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM r), m AS (SELECT cluster, list(m ORDER BY p) AS c FROM (SELECT cluster, p, avg(x) AS m FROM e GROUP BY 1, 2) GROUP BY 1)
  SELECT cluster, side, CAST(rank AS INT) AS rank, vec_id FROM (SELECT cluster, role = 'prod' AS side, vec_id, row_number() OVER (PARTITION BY cluster, role = 'prod' ORDER BY list_distance(embedding::DOUBLE[], c), vec_id) AS rank FROM r JOIN m USING (cluster)) WHERE rank <= 3""")(
    lambda s, d: V.closest_members(fixed_regions(s, d).withColumn("side", F.col("role") == "prod"), "cluster", "side", "embedding", 3).drop("distance"))
register("v21_domain_table", LIFT + DELTA_PARTS + ", t AS (SELECT domain, role, label, count(*) AS rows, count(DISTINCT grp) AS n_groups FROM samples GROUP BY 1, 2, 3) SELECT domain, role, label, rows, n_groups, round(lift, 6) AS lift, delta_covered FROM t LEFT JOIN l USING (domain, label) LEFT JOIN dl USING (domain, label)")(lambda s, d: r6(domain_table(s, d), "lift"))


def domain_table(s, d):
    """A row per domain and label: role, rows, groups, and outside production its lift and what its removal or addition does to coverage."""
    cells = T.samples(s, d).groupBy("domain", "role", "label").agg(F.count("*").alias("rows"), F.count_distinct("grp").alias("n_groups"))
    return cells.join(lifts(s, d).select("domain", "label", "lift"), ["domain", "label"], "left").join(deltas(s, d).drop("side"), ["domain", "label"], "left")


META = """, b AS (SELECT 'domain' AS meta, s.label, domain AS value, coverage FROM v JOIN samples s ON query_id = vec_id UNION ALL SELECT 'third', s.label, CAST(vec_id % 3 AS VARCHAR), coverage FROM v JOIN samples s ON query_id = vec_id),
  bd AS (SELECT meta, value, label, count(*) AS n, avg(coverage) AS coverage, count(*) FILTER (WHERE coverage < 0.8) AS uncovered FROM b GROUP BY 1, 2, 3 HAVING count(*) >= 5)"""


def breakdown(s, d, cover=None):
    t = (covered(s, d) if cover is None else cover).drop("label").join(T.samples(s, d), F.col("query_id") == F.col("vec_id")).withColumn("third", (F.col("vec_id") % 3).cast("string"))
    g = t.unpivot(["vec_id", "label", "coverage"], ["domain", "third"], "meta", "value").groupBy("meta", "value", "label")
    return g.agg(F.count("*").alias("n"), F.avg("coverage").alias("coverage"), F.count_if(F.col("coverage") < LOW).alias("uncovered")).where("n >= 5")


register("v22_metadata_breakdown", COVER + META + " SELECT meta, value, label, n, round(coverage, 6) AS coverage, uncovered FROM bd")(lambda s, d: r6(breakdown(s, d), "coverage"))

#: The rules of the findings but those that need trained probes (separable) or a registry (leak), which v09 and j09 give: texts are ours.
FINDINGS = """, er AS (SELECT s.label, v.coverage < 0.8 AS low, count(*) AS n, avg(CAST(CASE WHEN s.label = 1 THEN score < 0.5 ELSE score >= 0.5 END AS INT)) AS err FROM v JOIN (SELECT *, (vec_id * 37 % 1000) / 1000.0 AS score FROM samples) s ON query_id = vec_id GROUP BY 1, 2),
  md AS (SELECT domain, label, role, rows, lift, delta_covered, quantile_cont(CASE WHEN role = 'train' THEN rows END, 0.5) OVER (PARTITION BY label) AS middle FROM (SELECT domain, role, label, count(*) AS rows FROM samples GROUP BY 1, 2, 3) t LEFT JOIN l USING (domain, label) LEFT JOIN dl USING (domain, label))
  SELECT 'coverage' AS kind, label, CAST(NULL AS VARCHAR) AS subject, round(avg(CAST(coverage < 0.8 AS INT)), 6) AS amount FROM v GROUP BY 2
  UNION ALL SELECT 'model', a.label, CASE WHEN a.err > b.err + 0.05 THEN 'tracks' ELSE 'does not' END, round(a.err - b.err, 6) FROM er a JOIN er b ON a.label = b.label AND a.low AND NOT b.low WHERE least(a.n, b.n) >= 10
  UNION ALL SELECT * FROM (SELECT 'uncovered_group', label, meta || '=' || value, CAST(uncovered AS DOUBLE) FROM bd WHERE uncovered >= greatest(5, 0.5 * n) ORDER BY uncovered DESC, meta, value, label LIMIT 5)
  UNION ALL SELECT 'candidate', label, domain, CAST(delta_covered AS DOUBLE) FROM md WHERE role IN ('candidate', 'test') AND delta_covered > 0
  UNION ALL SELECT 'collect', label, domain, round(lift, 6) FROM md WHERE role = 'train' AND lift >= 2 AND rows < middle
  UNION ALL SELECT 'low', label, domain, round(lift, 6) FROM md WHERE role = 'train' AND lift < 0.3 AND delta_covered = 0"""


@register("v23_findings", COVER + LIFT_PARTS + DELTA_PARTS + META + FINDINGS)
def found(s, d):
    """kind, label, subject, amount: what coverage, errors, lifts and deltas say, each rule as a select over the small tables."""
    cover = staged(covered(s, d), "cover")
    score = (F.col("vec_id") * 37 % 1000) / 1000.0
    wrong = F.when(F.col("label") == 1, score < 0.5).otherwise(score >= 0.5)
    errors = cover.drop("label").join(T.samples(s, d), F.col("query_id") == F.col("vec_id")).groupBy("label").agg(
        *[f.alias(f"{name}_{side}") for side, low in (("low", True), ("ok", False)) for name, f in (("n", F.count_if((F.col("coverage") < LOW) == low)), ("err", F.avg(F.when((F.col("coverage") < LOW) == low, wrong.cast("double")))))])
    gap = F.col("err_low") - F.col("err_ok")
    cells = staged(domain_table(s, d), "cells")
    middle = cells.where("role = 'train'").groupBy("label").agg(F.percentile("rows", 0.5).alias("middle"))
    train = cells.where("role = 'train'").join(middle, "label")
    row = lambda kind, subject, amount: [F.lit(kind).alias("kind"), "label", subject.cast("string").alias("subject"), amount.cast("double").alias("amount")]
    rules = [
        cover.groupBy("label").agg(F.avg((F.col("coverage") < LOW).cast("double")).alias("a")).select(*row("coverage", F.lit(None), F.col("a"))),
        errors.where("least(n_low, n_ok) >= 10").select(*row("model", F.when(gap > 0.05, "tracks").otherwise("does not"), gap)),
        breakdown(s, d, cover).where("uncovered >= greatest(5, 0.5 * n)").orderBy(F.desc("uncovered"), "meta", "value", "label").limit(5).select(*row("uncovered_group", F.concat_ws("=", "meta", "value"), F.col("uncovered"))),
        cells.where("role IN ('candidate', 'test') AND delta_covered > 0").select(*row("candidate", F.col("domain"), F.col("delta_covered"))),
        train.where("lift >= 2 AND rows < middle").select(*row("collect", F.col("domain"), F.col("lift"))),
        train.where("lift < 0.3 AND delta_covered = 0").select(*row("low", F.col("domain"), F.col("lift"))),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return r6(out, "amount")


@register("v24_map_coordinates")
def map_coordinates(s, d):
    z = V.centred_pca(T.samples(s, d), T.samples(s, d), 2)[0].select("vec_id", F.get("z", F.lit(0)).alias("x"), F.get("z", F.lit(1)).alias("y"))
    return V.unit_range(staged(z, "map"), ["x", "y"])


register("k09_sample_table", COVER + " SELECT vec_id, domain, role, round(coverage, 6) AS coverage FROM samples LEFT JOIN v ON query_id = vec_id")(lambda s, d: r6(T.samples(s, d).join(covered(s, d).drop("label"), F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "domain", "role", "coverage"), "coverage"))
register("v22_top_values", VS + ", n AS (SELECT role, domain, count(*) AS n FROM samples GROUP BY 1, 2) SELECT role, domain, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, domain) AS rank FROM n) WHERE rank <= 2")(lambda s, d: A.most_common(T.samples(s, d), ["role"], "domain", 2))
