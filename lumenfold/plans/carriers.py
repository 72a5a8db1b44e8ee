"""Views of the tables that carry measurements, experiment runs, sequences, vectors and labels.

Each has a Spark form and the same definition in DuckDB SQL (a CTE body), so that a query over it
has an independent oracle. Columns are pruned to what the view needs; filters on them reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUCLEOTIDES = "ACGTacgt"
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements: compound, nm (a concentration), assay."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("compound"), F.col("l_extendedprice").cast("double").alias("nm"), F.col("l_returnflag").alias("assay"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment runs: model, rep, strategy, sigma, r2, rmse, mae."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_returnflag").alias("model"), c("l_linestatus").alias("rep"), c("l_linenumber").cast("string").alias("strategy"), F.round(c("l_discount") * 10, 1).alias("sigma"),
        (c("l_quantity") / 50).alias("r2"), (c("l_extendedprice") / 1e5).alias("rmse"), c("l_tax").alias("mae"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs averaged to one row per (model, rep, strategy, sigma)."""
    return runs(spark, sf_dir).groupBy("model", "rep", "strategy", "sigma").agg(F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.count(F.lit(1)).alias("n"))


def nucleotides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq: what is left of a text over the letters A, C, G, T."""
    return table(spark, sf_dir, "documents").select("doc_id", F.upper(F.regexp_replace("text", f"[^{NUCLEOTIDES}]", "")).alias("seq"))


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq: what is left of a text over the twenty amino-acid letters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.upper(F.regexp_replace("text", f"[^{AMINO_ACIDS}{AMINO_ACIDS.lower()}]", "")).alias("seq"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x (doubles), label, y = label + first component."""
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), x.alias("x"), F.col("label"), (F.col("label").cast("double") + F.element_at(x, 1)).alias("y"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, rep, sigma, y_true, y_pred, unc."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(c("l_returnflag").alias("model"), c("l_linestatus").alias("rep"), F.round(c("l_discount") * 10, 1).alias("sigma"), c("l_quantity").alias("y_true"), (c("l_extendedprice") / 1500).alias("y_pred"), (1 + 100 * c("l_tax")).alias("unc"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g, src, dst: small undirected graphs, every edge in both directions."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), (F.col("l_suppkey") % 5).alias("src"), (5 + F.col("l_partkey") % 5).alias("dst")).distinct()
    return e.union(e.select("g", F.col("dst").alias("src"), F.col("src").alias("dst")))


ASSAY = "assay_v AS (SELECT l_partkey AS compound, l_extendedprice::DOUBLE AS nm, l_returnflag AS assay FROM lineitem)"
RUNS = """runs AS (SELECT l_returnflag AS model, l_linestatus AS rep, l_linenumber::VARCHAR AS strategy, round(l_discount * 10, 1) AS sigma,
  l_quantity / 50 AS r2, l_extendedprice / 1e5 AS rmse, l_tax AS mae FROM lineitem)"""
CELLS = RUNS + ", cells AS (SELECT model, rep, strategy, sigma, avg(r2) AS r2, avg(rmse) AS rmse, avg(mae) AS mae, count(*) AS n FROM runs GROUP BY ALL)"
SEQ = "seqs AS (SELECT doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM documents)"
AA = "aas AS (SELECT doc_id, upper(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '', 'g')) AS seq FROM documents)"
VEC = "vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label, label::DOUBLE + embedding[1]::DOUBLE AS y FROM embeddings)"
PRED = """preds AS (SELECT l_returnflag AS model, l_linestatus AS rep, round(l_discount * 10, 1) AS sigma, l_quantity AS y_true, l_extendedprice / 1500 AS y_pred,
  1 + 100 * l_tax AS unc FROM lineitem)"""
EDGES = """half AS (SELECT DISTINCT l_orderkey AS g, l_suppkey % 5 AS src, 5 + l_partkey % 5 AS dst FROM lineitem),
  edges_v AS (SELECT g, src, dst FROM half UNION ALL SELECT g, dst, src FROM half)"""
