"""Queries of readers and sinks: a table is written in a format and read back by the format's reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import curation as C
from lumenfold.operators import selection as S
from lumenfold.plans.analytics import rounded
from lumenfold.plans.carriers import AA, CELLS, VEC, cells, proteins, table, vectors
from lumenfold.plans.registry import query
from lumenfold.plans.selection import _STAT, _scores
from lumenfold.sources import readers as R


@query("read_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def read_csv(spark, sf):
    path = R.scratch(spark, "csv")
    R.write_results(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path, "csv")
    return R.load(spark, "csv", path, schema="c_custkey long, c_name string, c_acctbal double")


@query("read_measurements", "SELECT l_partkey, l_extendedprice FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber = 1 AND l_extendedprice IS NOT NULL")
def read_measurements(spark, sf):
    return R.load(spark, "measurements", f"{sf}/lineitem.parquet", columns=("l_partkey", "l_extendedprice"), equal={"l_returnflag": "R", "l_linestatus": "O", "l_linenumber": 1}, present=("l_extendedprice",))


_CHAIN = """c AS (SELECT l_partkey AS compound, try_cast(CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE l_quantity::VARCHAR END AS DOUBLE) / 50 AS solubility FROM lineitem),
m AS (SELECT compound, median(log10(solubility)) AS y, count(*) AS n, max(log10(solubility)) - min(log10(solubility)) AS spread FROM c WHERE solubility IS NOT NULL AND solubility > 0 GROUP BY 1)"""


@query("solubility_chain", f"WITH {_CHAIN} SELECT compound, round(y, 6) AS y, n FROM m WHERE isfinite(y) AND spread <= 1")
def solubility_chain(spark, sf):
    """A data set's post-processing in one pass: cast, drop, log scale, one median per compound, spread filter."""
    raw = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_quantity").cast("string"))
    d = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("compound"), (raw.try_cast("double") / 50).alias("s")).filter("s is not null and s > 0").withColumn("y", F.log10("s"))
    m = d.groupBy("compound").agg(F.median("y").alias("y"), F.count(F.lit(1)).alias("n"), (F.max("y") - F.min("y")).alias("spread"))
    return rounded(m.filter("spread <= 1 and not isnan(y) and abs(y) < double('inf')").select("compound", "y", "n"))


@query("property_dataset", """WITH d AS (SELECT l_partkey AS compound, l_tax::DOUBLE AS y, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem WHERE l_tax IS NOT NULL), f AS (SELECT compound, y FROM d WHERE k = 1),
s AS (SELECT avg(y) AS m, stddev_pop(y) AS s FROM f WHERE compound % 5 <> 0) SELECT compound, round(y, 6) AS y, round(CASE WHEN s > 0 THEN (y - m) / s ELSE 0 END, 6) AS z FROM f, s""")
def property_dataset(spark, sf):
    """One of several properties as the label, the first measurement of each compound, standardized by the training compounds."""
    d = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("compound"), "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return rounded(C.property_dataset(d, ["compound"], ["l_quantity", "l_discount", "l_tax"], "l_tax", [F.col("l_orderkey"), F.col("l_linenumber")], F.col("compound") % 5 != 0))


@query("read_tsv", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0")
def read_tsv(spark, sf):
    path = R.scratch(spark, "tsv")
    table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.option("header", True).option("sep", "\t").csv(path)
    return R.load(spark, "tsv", path, schema="s_suppkey long, s_name string, s_acctbal double").filter("s_acctbal > 0")


@query("read_semicolon", "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS price FROM part GROUP BY 1")
def read_semicolon(spark, sf):
    path = R.scratch(spark, "semicolon")
    table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice").write.option("header", True).option("sep", ";").csv(path)
    return rounded(R.load(spark, "semicolon", path, schema="p_partkey long, p_brand string, p_retailprice double").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("price")))


def _commented(spark, sf, path: str, compression: str):
    """The nations, 25 rows, as one tab-separated text with comment lines before and between."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.concat_ws("\t", "n_nationkey", "n_name", "n_regionkey").alias("value"))
    head = spark.createDataFrame([(-2, "# version 2.4"), (-1, "n_nationkey\tn_name\tn_regionkey")], "k int, value string")
    notes = n.filter("k % 5 = 0").select("k", F.concat(F.lit("# before "), "k").alias("value"))
    lines = head.union(notes).union(n).repartition(1).sortWithinPartitions("k", F.desc(F.col("value").startswith("#")))
    lines.select("value").write.option("compression", compression).text(path)


@query("read_commented", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def read_commented(spark, sf):
    path = R.scratch(spark, "commented")
    _commented(spark, sf, path, "none")
    return R.load(spark, "tsv", path, schema="n_nationkey long, n_name string, n_regionkey long", comment="#")


@query("read_mutations", "SELECT n_regionkey::VARCHAR AS n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def read_mutations(spark, sf):
    path = R.scratch(spark, "mutations")
    _commented(spark, sf, path, "gzip")
    return R.load(spark, "mutations", path).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@query("read_runs", f"WITH {CELLS} SELECT model, rep, count(*) AS n, round(avg(r2), 6) AS r2 FROM cells GROUP BY ALL")
def read_runs(spark, sf):
    path = R.scratch(spark, "runs")
    cells(spark, sf).select("model", "rep", "sigma", "r2").withColumns({"m": F.col("model"), "p": F.col("rep")}).drop("model", "rep").write.partitionBy("m", "p").option("header", True).csv(path)
    d = R.load(spark, "runs", f"{path}/*/*/*.csv", schema="sigma double, r2 double", pattern=r"/m=([^/]+)/p=([^/]+)/", names=("model", "rep"))
    return rounded(d.groupBy("model", "rep").agg(F.count(F.lit(1)).alias("n"), F.avg("r2").alias("r2")))


@query("read_named_runs", f"WITH {CELLS} SELECT model, rep AS representation, strategy, count(*) AS n, round(min_by(r2, sigma), 6) AS baseline FROM cells GROUP BY ALL")
def read_named_runs(spark, sf):
    path = R.scratch(spark, "named-runs")
    R.write_named_runs(cells(spark, sf).select("model", "rep", "strategy", "sigma", "r2"), path, ("model", "rep", "strategy"))
    d = R.load(spark, "named_runs", path, schema="sigma double, r2 double")
    return rounded(d.groupBy("model", "representation", "strategy").agg(F.count(F.lit(1)).alias("n"), F.min_by("r2", "sigma").alias("baseline")))


def _fasta(spark, sf) -> str:
    path = R.scratch(spark, "fasta")
    kind = F.when(F.col("doc_id") % 3 == 0, "Heavy").otherwise("Light")
    d = proteins(spark, sf).select(F.concat(F.lit(">"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit("|"), (F.col("doc_id") % 2).cast("string"), F.lit("|"), kind, F.lit("\n"), F.substring("seq", 1, 60), F.lit("\n"), F.expr("substring(seq, 61)")).alias("value"))
    d.write.text(path)
    return path


_CHAINS = f"{AA}, chains AS (SELECT (doc_id // 2)::VARCHAR AS id, (doc_id % 2)::VARCHAR AS chain, CASE WHEN doc_id % 3 = 0 THEN 'Heavy' ELSE 'Light' END AS kind, seq FROM aas)"


@query("read_fasta", f"WITH {_CHAINS} SELECT id, chain, kind, length(seq) AS n, md5(seq) AS digest FROM chains")
def read_fasta(spark, sf):
    return R.load(spark, "fasta", _fasta(spark, sf)).select("id", "chain", "kind", F.length("sequence").cast("long").alias("n"), F.md5("sequence").alias("digest"))


@query("paired_chains", f"WITH {_CHAINS}, p AS (SELECT id, max_by(seq, CASE WHEN kind = 'Heavy' THEN chain END) AS heavy, max_by(seq, CASE WHEN kind = 'Light' THEN chain END) AS light FROM chains GROUP BY 1) SELECT id, md5(heavy) AS heavy, md5(light) AS light FROM p WHERE heavy IS NOT NULL AND light IS NOT NULL")
def paired_chains(spark, sf):
    return R.paired_chains(R.load(spark, "fasta", _fasta(spark, sf))).select("id", F.md5("heavy").alias("heavy"), F.md5("light").alias("light"))


@query("read_matrix", f"WITH {VEC} SELECT id, 64::BIGINT AS width, round(list_sum(x), 5) AS total FROM vecs")
def read_matrix(spark, sf):
    path = R.scratch(spark, "matrix")
    R.write_matrix(vectors(spark, sf).repartition(3, "id").select(F.concat(F.array(F.col("id").cast("double")), "x").alias("m")), path, "m")
    v = F.slice("values", 2, F.size("values") - 1)
    d = R.load(spark, "npy", path).select(F.element_at("values", 1).cast("long").alias("id"), F.size(v).cast("long").alias("width"), F.aggregate(v, F.lit(0.0), lambda s, x: s + x).alias("total"))
    return rounded(d, 5)


@query("read_json", "SELECT event_id, event_type, value FROM events WHERE value > 50")
def read_json(spark, sf):
    path = R.scratch(spark, "json")
    R.write_results(table(spark, sf, "events").select("event_id", "event_type", "value"), path, "json")
    return R.load(spark, "json", path, schema="event_id long, event_type string, value double").filter("value > 50")


@query("selection_table", f"WITH {_STAT} SELECT rep, rank, pos, round(c, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY c DESC, pos DESC) AS rank FROM stat) WHERE rank <= 3")
def selection_table(spark, sf):
    path = R.scratch(spark, "selection")
    R.write_results(S.top_features(_scores(spark, sf), 3).select("rep", "rank", F.col("pos").cast("long").alias("pos"), "score"), path)
    return rounded(R.load(spark, "parquet", path))


@query("cached_distances", f"WITH {VEC} SELECT a.id, round(list_distance(a.x, b.x), 6) AS distance FROM vecs a JOIN vecs b ON b.id = a.id + 1")
def cached_distances(spark, sf):
    from lumenfold.operators.neighbors import distance

    v = vectors(spark, sf).select("id", "x")
    path = R.scratch(spark, "distances")
    make = lambda: v.join(v.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id").select("id", distance(F.col("x"), F.col("y")).alias("distance"))
    R.cached(spark, path, make)
    return rounded(R.cached(spark, path, make))
