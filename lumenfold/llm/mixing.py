"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Golden-ratio points frac(k * phi) fall on the sources' shares of the unit interval; the r-th slot
that falls on a source takes the r-th block of that source's shuffled word stream, going round it
again when it is used up (never beyond ``max_epochs`` rounds). A source's blocks are equal, and so
many that one is a small part of it: between ``MIN_BLOCKS`` and ``MAX_BLOCKS``, single words where
the source has fewer. Points fall on a source a few times more or less often than it wants slots;
so that this never costs a small source its target, each has an exact quota: ranks beyond it are
left out, and missing ones are put at hashed places of the schedule. Every step is a DataFrame
operation:

* slots meet the shares through an equi-join on a cell of the unit interval, so a source with a
  large share is spread over many cells;
* ranks and stream positions are running sums within bounded chunks of a source plus a prefix sum
  over the chunks' totals, so no source is ordered in one task.

Only windows over the table of sources (one row per source) are unpartitioned.
"""

from __future__ import annotations

from decimal import Decimal, getcontext

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import fresh, join_small, materialize, or_empty, read_table

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block, about, and how many blocks a source has at least (if it has as many words) and at most, whatever its size: a source's taken words are within a block of its target.
BLOCK_WORDS, MIN_BLOCKS, MAX_BLOCKS = 32, 512, 1 << 16
#: Documents, and slots, of one source in one window partition, about.
CHUNK = 8_192
SEED = 17


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: one row per input row; a null or empty text has size 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(or_empty(F.col("text")), F.lit(WORD)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3) -> DataFrame:
    """One row per source: rank by code point (null last), its size, documents, target.

    Weights repeat along the ranks. A target stops at ``max_epochs`` times the source's size and
    the excess is shared again by weight, until none is above: target = min(weight * level, cap),
    where the level is read off running sums in the order of cap / weight.
    """
    by_rank, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("_ratio", "src")
    everything = Window.partitionBy()
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    s = s.withColumn("src", F.row_number().over(by_rank) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("src") % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * float(max_epochs)).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    s = s.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("_capped", F.sum("_cap").over(by_ratio) - F.col("_cap")).withColumn("_open", F.sum("weight").over(everything) - F.sum("weight").over(by_ratio) + F.col("weight"))
    s = s.withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_open"))
    s = s.withColumn("_level", F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct("_ratio", "src", "_level"))).over(everything)["_level"])
    return s.withColumn("target", F.least(F.col("weight") * F.col("_level"), F.col("_cap"))).select("src", "source", "source_size", "n_docs", "target")


def _golden(k: Column) -> Column:
    """frac(k / phi), with k split so that no product loses its fraction."""
    getcontext().prec = 60
    ratio = (Decimal(5).sqrt() - 1) / 2
    low, high = float(ratio), float((ratio * 2**20) % 1)
    x = F.shiftright(k, 20) * F.lit(high)
    y = k.bitwiseAND(F.lit(2**20 - 1)) * F.lit(low)
    z = (x - F.floor(x)) + (y - F.floor(y))
    return z - F.floor(z)


def block_words(size: Column) -> Column:
    """Words in a block of a source of this size."""
    blocks = F.least(F.greatest(size / F.lit(BLOCK_WORDS), F.lit(float(MIN_BLOCKS))), F.lit(float(MAX_BLOCKS)))
    return F.greatest(F.ceil(size / blocks), F.lit(1)).cast("long")


def schedule(sources: DataFrame, n_sources: int, max_epochs: int = 3, seed: int = SEED) -> DataFrame:
    """slot, src, rank, block, epoch: the order in which the mix takes blocks, by (slot, src).

    A source wants target / size rounds of its blocks, to the nearest whole block: its quota. The
    number of points is the sum of quotas and a source's share of the unit interval is in
    proportion. A slot that a source lacks by then has a hashed number, which another may have too.
    """
    spark = sources.sparkSession
    order = Window.orderBy("src")
    s = sources.filter("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block_words(F.col("source_size"))).cast("long"))
    s = s.withColumn("want", F.least(F.round(F.col("target") / block_words(F.col("source_size"))).cast("long"), F.col("blocks") * max_epochs)).filter("want > 0")
    s = s.withColumn("_all", F.sum("want").over(Window.partitionBy())).withColumn("hi", F.sum("want").over(order) / F.col("_all"))
    s = s.withColumn("lo", F.lag("hi", 1, 0.0).over(order)).withColumn("hi", F.when(F.lead("src").over(order).isNull(), F.lit(2.0)).otherwise(F.col("hi")))
    total = s.agg(F.sum("want")).first()[0] or 0
    cells = 4 * n_sources + 64
    cell = lambda u: F.least(F.floor(u * cells), F.lit(cells - 1)).cast("long")
    shares = s.select("src", "lo", "hi", "blocks", "want", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("_cell"))
    slots = spark.range(total).select(F.col("id").alias("slot"), _golden(F.col("id")).alias("_u")).withColumn("_cell", cell(F.col("_u")))
    hit = join_small(slots, shares, ["_cell"], rows=cells + n_sources).filter("_u >= lo and _u < hi").select("slot", "src", "blocks", "want")
    hit = hit.withColumn("_chunk", F.floor(F.col("slot") / F.lit(CHUNK)).cast("long"))
    before = hit.groupBy("src", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("src").orderBy("_chunk")) - F.col("_n")).drop("_n")
    ranked = hit.withColumn("_row", F.row_number().over(Window.partitionBy("src", "_chunk").orderBy("slot")) - 1).join(before, ["src", "_chunk"])
    ranked = ranked.withColumn("rank", F.col("_row") + F.col("_before")).filter("rank < want").select("slot", "src", "rank", "blocks")
    held = hit.groupBy("src").agg(F.count(F.lit(1)).alias("_held"))
    short = s.join(held, "src", "left").withColumn("_held", F.coalesce("_held", F.lit(0))).filter("_held < want")
    short = short.select("src", "blocks", F.explode(F.sequence(F.col("_held"), F.col("want") - 1)).alias("rank"))
    ranked = ranked.union(short.select(F.pmod(F.xxhash64("src", "rank", F.lit(seed)), F.lit(max(total, 1))).alias("slot"), "src", "rank", "blocks"))
    return ranked.select("slot", "src", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("epoch"))


def streams(sizes: DataFrame, sources: DataFrame, n_sources: int, seed: int = SEED) -> DataFrame:
    """doc_id, size, src, start: each row's place in its source's shuffled word stream."""
    d = sizes.withColumns({"_s": or_empty(F.col("source")), "_null": F.col("source").isNull()}).drop("source")
    s = sources.withColumns({"_s": or_empty(F.col("source")), "_null": F.col("source").isNull()})
    d = join_small(d, s, ["_s", "_null"], rows=n_sources).drop("_s", "_null")
    d = d.withColumn("_h", F.xxhash64(F.col("doc_id"), F.col("size"), F.lit(seed))).withColumn("_chunk", F.pmod("_h", F.floor(F.col("n_docs") / F.lit(CHUNK)) + 1))
    before = d.groupBy("src", "_chunk").agg(F.sum("size").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("src").orderBy("_chunk")) - F.col("_n")).drop("_n")
    upto = F.sum("size").over(Window.partitionBy("src", "_chunk").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("_upto", upto).join(before, ["src", "_chunk"]).withColumn("start", F.col("_before") + F.col("_upto") - F.col("size")).drop("_h", "_chunk", "_upto", "_before", "n_docs")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents with size, target and words taken, the mixed stream).

    The stream has one row per fragment of a document in a slot: slot, src, doc_id, start (the
    document's place in its source's stream), words. Documents: one row per input row, whatever
    its text or source; rows with equal doc_id count each for itself. An empty table gives none.
    A source's words taken miss its target by less than a block and a half: half a word where it has
    up to ``MIN_BLOCKS`` words, at most 0.3 % of its size beyond.
    """
    sizes = materialize(sized(docs), "sizes")
    sources = materialize(source_targets(sizes, weights, max_epochs), "sources")
    n = sources.count()
    placed = materialize(streams(sizes, sources, n, seed), "streams")
    placed = placed.withColumn("_block", block_words(F.col("source_size")))
    at = lambda c: F.floor(c / F.col("_block")).cast("long")
    pieces = placed.filter("size > 0").select("src", "doc_id", "start", "size", "_block", F.explode(F.sequence(at(F.col("start")), at(F.col("start") + F.col("size") - 1))).alias("block"))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("_block")) - F.greatest(F.col("start"), F.col("block") * F.col("_block"))
    pieces = pieces.select("src", "block", "doc_id", "start", words.alias("words"))
    stream = schedule(sources, n, max_epochs, seed).join(pieces, ["src", "block"]).select("slot", "src", "doc_id", "start", "words")
    taken = stream.groupBy("src", "start").agg(F.sum("words").alias("taken"))
    # Rows of size 0 share their start with a neighbour; they take nothing.
    out = placed.filter("size > 0").join(taken, ["src", "start"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    empty = placed.filter("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return out.union(empty), stream


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3) -> DataFrame:
    """The rows, with all their columns, each as often as the mix takes its words, to the nearest whole.

    Rows of size 0 (null or empty texts) stay once. Rows that repeat doc_id, source and size share
    their copies evenly, rounded up. An empty table gives none.
    """
    told = mix(docs, weights, max_epochs)[0].withColumn("n", F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1))
    copies = told.groupBy("doc_id", "source", "size").agg(F.ceil(F.sum("n") / F.count(F.lit(1))).cast("int").alias("n")).filter("n > 0")
    doc_id, source, size, n, own, copy = fresh(docs, "doc_id_", "source_", "size_", "n_", "own_", "copy_")
    copies = materialize(copies.toDF(doc_id, source, size, n), "copies")
    d = docs.withColumn(own, F.regexp_count(or_empty(F.col("text")), F.lit(WORD)).cast("long"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)) & F.col("source").cast("string").eqNullSafe(F.col(source)) & (F.col(own) == F.col(size))
    # Joined by a shuffle at every size; the copies are one row per document and so are never broadcast.
    return d.hint("merge").join(copies, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(docs.columns)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))[0].drop("source")
