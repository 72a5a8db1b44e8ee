"""Helpers shared by the pipeline operators: shared-folder tables, checked broadcasts, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and holds no more rows than this.
BROADCAST_ROWS = 50_000


#: Rows in an Arrow batch: long texts come in batches, and Python workers hold a few at a time.
BATCH_ROWS = 1_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input; also bounds the Arrow batches of the session to what workers can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session with a local master gets a temporary folder (tests); on a cluster
    that is an error, for executors couldn't read each other's files there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` has, in any case: the given ones, with underscores where needed."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of materialized tables that nothing reads any more."""
    import pyarrow as pa
    from pyarrow import fs

    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            try:
                system, path = fs.FileSystem.from_uri(folder)
                system.delete_dir(path)
            except (pa.ArrowInvalid, OSError):  # a file system that pyarrow can't open, or files gone already: they stay
                continue


def join_small(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join a side expected to be small: broadcast when its counted rows allow it, else a shuffled join.

    The shuffled join is a plain equi-join of two exchanges, which adaptive execution splits where
    a key is hot.
    """
    n = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if n <= BROADCAST_ROWS else right, keys, how)


def keep_ids(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str, n_wanted: int) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in ``wanted`` (no row of it is lost, a few others stay).

    A bit field of at most 2**26 bits is broadcast, whatever the number of ids, so that wide rows
    which no later join needs aren't shuffled.
    """
    bits = 1 << min(26, max(16, (8 * max(1, n_wanted)).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = (
        wanted.select(place(F.col(wanted_key)).alias("_p"))
        .groupBy(F.shiftright("_p", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_p & 63 as int))")).alias("_bits"))
    )
    return (
        df.withColumn("_p", place(F.col(key)))
        .withColumn("_word", F.shiftright("_p", 6))
        .join(F.broadcast(words), "_word")
        .filter(F.expr("(shiftright(_bits, cast(_p & 63 as int)) & 1L) = 1L"))
        .drop("_word", "_bits", "_p")
    )


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of undirected long edges; component is the smallest node reachable.

    Alternating large-star and small-star rounds: every round is a partial aggregation plus an
    equi-join on the node, so a hub's edges are pre-aggregated and its join partition can be split.
    Null ends and self-loops are ignored. Each round's edges are written to the shared folder, and
    those of the round before are removed. Any long is a good id.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u is not null and v is not null and u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        # Large star: a node's larger neighbours attach to the smallest of its neighbourhood.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours attach to the smallest of those.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e, done = materialize(small.filter("u <> v").distinct(), "edges"), e
        discard(done)
        row = e.agg(F.count(F.lit(1)).alias("n"), *(F.expr(f"bit_xor(xxhash64({seed}, u, v))").alias(f"x{seed}") for seed in (1, 2))).first()
        now = tuple(row)
        if now == state or row["n"] == 0:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.groupBy("u").agg(F.min("v").alias("c"))
    return stars.select(F.col("u").alias("node"), F.col("c").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
