"""Readers and sinks: delimited text, sequences, mutation files, file-name columns, checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(name: str) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        READERS[name] = f
        return f

    return add


def load(spark: SparkSession, source: str, path: str, **options: object) -> DataFrame:
    """Dispatch by source name."""
    if source not in READERS:
        raise ValueError(f"unknown source {source!r}; known: {sorted(READERS)}")
    return READERS[source](spark, path, **options)


@reader("parquet")
def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@reader("measurements")
def read_measurements(spark: SparkSession, path: str, columns: tuple[str, ...], equal: dict[str, object], missing: tuple[str, ...] = (), present: tuple[str, ...] = ()) -> DataFrame:
    """A scan that carries its predicates: equalities (target, type, unit, relation), columns that must or mustn't be null, and the columns wanted.

    All of them reach the Parquet reader, so row groups are skipped and other columns aren't read.
    """
    d = spark.read.parquet(path)
    for name, value in equal.items():
        d = d.filter(F.col(name) == value)
    for name in missing:
        d = d.filter(F.col(name).isNull())
    for name in present:
        d = d.filter(F.col(name).isNotNull())
    return d.select(*columns)


@reader("csv")
def read_delimited(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", comment: str | None = None) -> DataFrame:
    """Text with a header. Without a schema every column is text: types are cast where they are used, in one scan."""
    r = spark.read.option("header", True).option("sep", sep)
    if comment:
        r = r.option("comment", comment)
    return (r.schema(schema) if schema else r).csv(path)


@reader("tsv")
def read_tsv(spark: SparkSession, path: str, schema: str | None = None, comment: str | None = None) -> DataFrame:
    return read_delimited(spark, path, schema, "\t", comment)


@reader("semicolon")
def read_semicolon(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return read_delimited(spark, path, schema, ";")


@reader("mutations")
def read_mutations(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated, plain or gzip, with # comment lines; the first other line is the header."""
    return read_tsv(spark, path, comment="#")


@reader("json")
def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


@reader("runs")
def read_with_provenance(spark: SparkSession, path: str, schema: str | None = None, pattern: str | None = None, names: tuple[str, ...] = ()) -> DataFrame:
    """Many files with ``source_file``, and columns from groups of a pattern over the path."""
    d = read_delimited(spark, path, schema).withColumn("source_file", F.col("_metadata.file_path"))
    for i, name in enumerate(names):
        d = d.withColumn(name, F.regexp_extract("source_file", pattern, i + 1))
    return d


@reader("named_runs")
def read_named_runs(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Files named MODEL_REP_STRATEGY.csv: the parts become columns."""
    return read_with_provenance(spark, path, schema, r"([^/_]+)_([^/_]+)_([^/.]+)\.csv$", ("model", "representation", "strategy"))


@reader("fasta")
def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, chain, kind, sequence from >ID|CHAIN|KIND headers; fields that a header lacks are empty. A record starts where a line starts with >."""
    text = spark.read.option("lineSep", "\n>").text(path)
    records = text.select(F.regexp_replace("value", r"^>|\r$", "").alias("value")).filter(F.trim("value") != "")
    lines = F.split("value", r"\r?\n")
    head = F.split(F.element_at(lines, 1), r"\|")
    field = lambda i: F.trim(F.coalesce(F.get(head, F.lit(i)), F.lit("")))
    body = F.array_join(F.slice(lines, 2, F.size(lines)), "")
    return records.select(field(0).alias("id"), field(1).alias("chain"), field(2).alias("kind"), F.regexp_replace(body, r"\s", "").alias("sequence"))


def paired_chains(fasta: DataFrame, heavy: str = "H", light: str = "L") -> DataFrame:
    """id, heavy, light: ids that have both kinds of chain; of several the last by chain name."""
    of = lambda k: F.max_by("sequence", F.when(F.upper(F.substring("kind", 1, 1)) == k, F.col("chain")))
    return fasta.groupBy("id").agg(of(heavy).alias("heavy"), of(light).alias("light")).filter("heavy is not null and light is not null")


@reader("npy")
def read_matrix(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(file, row, values) of NumPy matrices, by row ranges; object arrays are refused."""
    from lumenfold.sources.matrices import MatrixSource

    spark.dataSource.register(MatrixSource)
    return spark.read.format("matrix").options(**options).load(path)


def write_matrix(df: DataFrame, path: str, vector: str, **options: object) -> DataFrame:
    """Writes NumPy matrices, pieces of a bounded size, in place of those there; gives (file, rows). Ragged rows and nulls are refused."""
    from lumenfold.sources.matrices import MatrixSource

    df.sparkSession.dataSource.register(MatrixSource)
    df.select(F.col(vector).cast("array<double>").alias("values")).write.format("matrix").options(**options).mode("overwrite").save(path)
    return read_matrix(df.sparkSession, path).groupBy("file").agg(F.count(F.lit(1)).alias("rows"))


def file_system(path: str):  # noqa: ANN201
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under ``spark.checkpoint.dir``, or a temporary one where it is unset and the master is local."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_named_runs(df: DataFrame, path: str, keys: tuple[str, str, str]) -> None:
    """One CSV file MODEL_REP_STRATEGY.csv per value of the keys, whose rows are few (a row per noise level) and written by its task."""
    import pandas as pd

    system, folder = file_system(path)
    system.create_dir(folder, recursive=True)

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        system, folder = file_system(path)
        name = "_".join(str(pdf[k].iloc[0]) for k in keys)
        with system.open_output_stream(f"{folder}/{name}.csv") as f:
            f.write(pdf.drop(columns=list(keys)).to_csv(index=False).encode())
        return pd.DataFrame({"file": [f"{name}.csv"]})

    df.groupBy(*keys).applyInPandas(save, "file string").count()


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """Read-through cache: a Parquet table that is made where it is missing."""
    from pyspark.errors import AnalysisException

    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_checkpoint(df: DataFrame, path: str, partition: str) -> None:
    """Rewrite only the partitions that ``df`` has rows of: delete-and-append of their keys."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_results(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind in ("json", "parquet"):
        getattr(writer, kind)(path)
    else:
        raise ValueError(f"unknown sink {kind!r}")
