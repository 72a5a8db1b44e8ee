"""Queries of curation, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import curation as C
from lumenfold.plans.carriers import ASSAY, CELLS, VEC, assay, cells, table, vectors
from lumenfold.plans.registry import query

_CURATED = f"""WITH {ASSAY}, p AS (SELECT *, 9 - log10(nm) AS p FROM assay_v WHERE nm > 0)
SELECT compound, round(avg(p), 6) AS p_mean, round(pow(10.0, 9 - avg(p)), 4) AS nm_mean, count(*) AS n, round(max(p) - min(p), 6) AS spread,
  array_to_string(list_sort(list(DISTINCT assay)), ',') AS assays FROM p GROUP BY compound"""


def _told(df):
    return df.select("compound", F.round("p_mean", 6).alias("p_mean"), F.round("nm_mean", 4).alias("nm_mean"), "n", F.round("spread", 6).alias("spread"), "assays")


@query("curate_measurements", _CURATED + " HAVING max(p) - min(p) <= 1.0")
def curate_measurements(spark, sf):
    return _told(C.curate(assay(spark, sf), ["compound"]))


@query("replicate_summary", _CURATED)
def replicate_summary(spark, sf):
    return _told(C.replicate_summary(assay(spark, sf), ["compound"]))


@query("min_measurements", _CURATED + " HAVING count(*) >= 30 AND max(p) - min(p) <= 1.7")
def min_measurements(spark, sf):
    return _told(C.curate(assay(spark, sf), ["compound"], min_measurements=30, max_spread=1.7))


@query("curate_events", """WITH p AS (SELECT user_id, event_type, 9 - log10(value) AS p, strftime(ts, '%Y-%m') AS assay FROM events WHERE value > 0)
SELECT user_id, event_type, round(avg(p), 6) AS p_mean, count(*) AS n, round(max(p) - min(p), 6) AS spread FROM p GROUP BY ALL HAVING max(p) - min(p) <= 1.0""")
def curate_events(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("value").alias("nm"), F.date_format("ts", "yyyy-MM").alias("assay"))
    return C.curate(e, ["user_id", "event_type"]).select("user_id", "event_type", F.round("p_mean", 6).alias("p_mean"), "n", F.round("spread", 6).alias("spread"))


@query("potency_transform", f"WITH {ASSAY} SELECT compound, assay, count(*) AS n, round(sum(9 - log10(nm)), 4) AS total FROM assay_v WHERE nm > 0 GROUP BY ALL")
def potency_transform(spark, sf):
    return assay(spark, sf).withColumn("p", C.potency(F.col("nm"))).filter("p is not null").groupBy("compound", "assay").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 4).alias("total"))


@query("binarize_activity", f"WITH {ASSAY} SELECT assay, (nm / 1000 <= 40.0)::INT AS label, count(*) AS n FROM assay_v GROUP BY ALL")
def binarize_activity(spark, sf):
    return assay(spark, sf).groupBy("assay", C.active(F.col("nm") / 1000, 40.0).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("truthy_filter", "SELECT count(*) AS n, count(DISTINCT doc_id) AS docs FROM documents WHERE text IS NOT NULL AND text <> '' AND n_chars IS NOT NULL AND n_chars <> 0")
def truthy_filter(spark, sf):
    return table(spark, sf, "documents").filter(C.truthy("text", "n_chars")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("median_dedupe", f"WITH {ASSAY} SELECT compound, round(median(nm), 6) AS median, round(stddev_samp(nm), 4) AS std, count(*) AS n FROM assay_v GROUP BY compound HAVING stddev_samp(nm) IS NULL OR stddev_samp(nm) <= 25000")
def median_dedupe(spark, sf):
    return C.median_dedupe(assay(spark, sf), ["compound"], "nm", 25000).select("compound", F.round("median", 6).alias("median"), F.round("std", 4).alias("std"), "n")


@query("coerce_numeric", "SELECT event_type, count(*) AS n, count(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)) AS numbers, sum(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)) AS total FROM events GROUP BY 1")
def coerce_numeric(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1)).withColumn("v", C.to_number("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("numbers"), F.sum("v").alias("total"))


@query("drop_missing", "SELECT source, count(*) AS n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY 1")
def drop_missing(spark, sf):
    return table(spark, sf, "documents").na.drop(subset=["text", "lang"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("keyword_filter", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), 'blue|green|antibody') OR regexp_matches(lower(p_type), 'steel|brass')")
def keyword_filter(spark, sf):
    p = table(spark, sf, "part")
    return p.filter(C.mentions(["p_name"], ["blue", "green", "antibody"]) | C.mentions(["p_type"], ["steel", "brass"])).select("p_partkey", "p_name")


@query("paired_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus IS DISTINCT FROM 'F' AND o_totalprice <= 100000")
def paired_filter(spark, sf):
    return table(spark, sf, "orders").filter(F.col("o_custkey").isNotNull() & ~F.col("o_orderstatus").eqNullSafe("F") & (F.col("o_totalprice") <= 100000)).select("o_orderkey", "o_totalprice")


@query("log_label", "SELECT c_custkey, round(log10(greatest(c_acctbal, 1e-10)), 6) AS y FROM customer WHERE isfinite(log10(greatest(c_acctbal, 1e-10)))")
def log_label(spark, sf):
    return table(spark, sf, "customer").withColumn("y", C.log_label(F.col("c_acctbal"))).filter(F.abs("y") != float("inf")).select("c_custkey", F.round("y", 6).alias("y"))


@query("log2_expression", "SELECT l_returnflag, round(sum(log2(l_quantity + 1)), 4) AS total FROM lineitem GROUP BY 1")
def log2_expression(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.log2(F.col("l_quantity") + 1)), 4).alias("total"))


@query("clip_numeric", "SELECT event_type, round(sum(CASE WHEN value / nullif(nullif(user_id, 8), 0) IS NULL THEN 0 ELSE greatest(-10, least(10, value / nullif(nullif(user_id, 8), 0))) END), 4) AS total FROM events GROUP BY 1")
def clip_numeric(spark, sf):
    x = F.expr("try_divide(value, nullif(nullif(user_id, 8), 0))")
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum(C.clipped(x, 10)), 4).alias("total"))


@query("standardize_labels", """SELECT c_custkey, round((c_acctbal - m) / s, 6) AS z FROM customer,
  (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def standardize_labels(spark, sf):
    return C.standardized(table(spark, sf, "customer"), "c_acctbal", F.col("c_mktsegment") != "BUILDING").select("c_custkey", F.round("z", 6).alias("z"))


@query("near_sigma", f"WITH {CELLS} SELECT model, rep, strategy, round(min_by(r2, sigma), 6) AS r2_high FROM cells WHERE abs(sigma - 0.6) < 0.05 GROUP BY ALL")
def near_sigma(spark, sf):
    return cells(spark, sf).filter(C.near(F.col("sigma"), 0.6)).groupBy("model", "rep", "strategy").agg(F.round(F.min_by("r2", "sigma"), 6).alias("r2_high"))


@query("in_lists", "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linenumber NOT IN (3, 4) GROUP BY 1")
def in_lists(spark, sf):
    return table(spark, sf, "lineitem").filter(F.col("l_returnflag").isin("A", "R") & ~F.col("l_linenumber").isin(3, 4)).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("compound_exclusion", f"WITH {CELLS} SELECT model, rep, count(*) AS n FROM cells WHERE NOT (model = 'N' AND rep IN ('F')) AND r2 > -10 GROUP BY ALL")
def compound_exclusion(spark, sf):
    return cells(spark, sf).filter(~((F.col("model") == "N") & F.col("rep").isin("F")) & (F.col("r2") > -10)).groupBy("model", "rep").agg(F.count(F.lit(1)).alias("n"))


@query("normalize_names", "SELECT replace(replace(lower(trim(p_type)), '-', '_'), ' ', '_') AS name, count(*) AS n FROM part GROUP BY 1")
def normalize_names(spark, sf):
    return table(spark, sf, "part").groupBy(C.normalized_name(F.col("p_type")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("derive_category", "SELECT CASE WHEN regexp_matches(lower(c_mktsegment), 'auto|mach') THEN 'probabilistic' ELSE 'deterministic' END AS kind, count(*) AS n FROM customer GROUP BY 1")
def derive_category(spark, sf):
    return table(spark, sf, "customer").groupBy(C.category(F.col("c_mktsegment"), ["auto", "mach"], "probabilistic", "deterministic").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("map_category", "SELECT CASE lang WHEN 'en' THEN 'germanic' WHEN 'de' THEN 'germanic' WHEN 'fr' THEN 'romance' ELSE 'other' END AS family, count(*) AS n FROM documents GROUP BY 1")
def map_category(spark, sf):
    return table(spark, sf, "documents").groupBy(C.mapped(F.col("lang"), {"en": "germanic", "de": "germanic", "fr": "romance"}).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("baseline_filter", f"WITH {CELLS}, bad AS (SELECT model, rep FROM cells WHERE sigma = 0 GROUP BY ALL HAVING avg(r2) < 0.51) SELECT c.model, c.rep, c.strategy, c.sigma, round(c.r2, 6) AS r2 FROM cells c ANTI JOIN bad USING (model, rep)")
def baseline_filter(spark, sf):
    c = cells(spark, sf)
    bad = c.filter("sigma = 0").groupBy("model", "rep").agg(F.avg("r2").alias("b")).filter("b < 0.51")
    return c.join(bad, ["model", "rep"], "left_anti").select("model", "rep", "strategy", "sigma", F.round("r2", 6).alias("r2"))


@query("valid_configs", f"WITH {CELLS}, ok AS (SELECT model, rep, strategy FROM cells GROUP BY ALL HAVING count(*) >= 11 AND min(r2) > 0.45) SELECT c.model, c.rep, c.strategy, c.sigma, round(c.r2, 6) AS r2 FROM cells c SEMI JOIN ok USING (model, rep, strategy)")
def valid_configs(spark, sf):
    c = cells(spark, sf)
    ok = c.groupBy("model", "rep", "strategy").agg(F.count(F.lit(1)).alias("n"), F.min("r2").alias("m")).filter("n >= 11 and m > 0.45")
    return c.join(ok, ["model", "rep", "strategy"], "left_semi").select("model", "rep", "strategy", "sigma", F.round("r2", 6).alias("r2"))


@query("first_match_join", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)
SELECT c.c_custkey, k.s_suppkey FROM customer c JOIN k ON c.c_nationkey = k.s_nationkey AND k.n = 1""")
def first_match_join(spark, sf):
    return C.first_match(table(spark, sf, "customer"), table(spark, sf, "supplier"), F.col("c_nationkey"), F.col("s_nationkey"), ["s_suppkey"]).select("c_custkey", "s_suppkey")


@query("both_parts_required", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_name IS NOT NULL AND o.o_orderpriority IS NOT NULL")
def both_parts_required(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).filter(c["c_name"].isNotNull() & o["o_orderpriority"].isNotNull()).select("o_orderkey", "c_name")


@query("membership_label", """SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN 0 ELSE 1 END AS label FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))""")
def membership_label(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return C.membership_label(table(spark, sf, "customer").select("c_custkey"), "c_custkey", o.filter("o_orderpriority = '1-URGENT'"), o.filter("o_orderpriority = '2-HIGH'"))


@query("presence_matrix", """SELECT o_custkey, max((l_returnflag = 'A')::INT) AS A, max((l_returnflag = 'N')::INT) AS N, max((l_returnflag = 'R')::INT) AS R
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def presence_matrix(spark, sf):
    o, li = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    return C.presence_matrix(o.join(li, o["o_orderkey"] == li["l_orderkey"]), "o_custkey", "l_returnflag", ["A", "N", "R"])


@query("zero_filled_features", f"WITH {VEC} SELECT d.doc_id, round(coalesce(list_sum(v.x), 0), 6) AS total FROM documents d LEFT JOIN vecs v ON d.doc_id = v.id")
def zero_filled_features(spark, sf):
    out = C.zero_filled(table(spark, sf, "documents").select("doc_id"), vectors(spark, sf).select(F.col("id").alias("doc_id"), "x"), "doc_id", "x", 64)
    return out.select("doc_id", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query("upsert_results", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT'
UNION ALL SELECT o_orderkey, o_totalprice * 2 FROM orders WHERE o_orderpriority = '1-URGENT'""")
def upsert_results(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return C.upsert(o, o.filter("o_orderpriority = '1-URGENT'").withColumn("o_totalprice", F.col("o_totalprice") * 2), ["o_orderpriority"]).select("o_orderkey", "o_totalprice")


@query("union_missing_columns", "SELECT c_custkey AS id, c_acctbal AS balance, NULL::VARCHAR AS kind FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def union_missing_columns(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("kind"))
    return c.unionByName(s, allowMissingColumns=True)


@query("common_sigmas", f"WITH {CELLS} SELECT sigma FROM cells WHERE model = 'A' INTERSECT SELECT sigma FROM cells WHERE model = 'N' AND r2 > 0.5")
def common_sigmas(spark, sf):
    c = cells(spark, sf)
    return c.filter("model = 'A'").select("sigma").intersect(c.filter("model = 'N' and r2 > 0.5").select("sigma"))


@query("rejected_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def rejected_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").filter("quality = 1").select("doc_id"))


@query("train_and_validation", "SELECT 'train' AS part, count(*) AS n FROM labels WHERE doc_id % 5 < 4 UNION ALL SELECT 'val', count(*) FROM labels WHERE doc_id % 5 = 4")
def train_and_validation(spark, sf):
    y = table(spark, sf, "labels")
    both = y.filter("doc_id % 5 < 4").withColumn("part", F.lit("train")).union(y.filter("doc_id % 5 = 4").withColumn("part", F.lit("val")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
