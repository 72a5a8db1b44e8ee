"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles: weight = occurrences * mean inverse
document frequency of the five words. (A shingle's own document frequency would weigh down just the
shingles that a large group of copies shares, and so pull the group apart.) Document frequencies
cover the whole corpus; words are counted in a count-min sketch of fixed size, which is all that is
broadcast: a word's count is at most ``e / PLACES`` of all words' counts too large, mostly.

1. One pass makes of each document a 128-bit name of its word sequence and ``BANDS * ROWS`` samples.
   Documents with one name are a class; only one of its rows goes on.
2. Classes that agree on all samples of a band share a bucket. Every member of a bucket is paired
   with one pivot of it, so that a bucket of n members gives n - 1 pairs, not n**2. A last round
   compares, block by block, what isn't known to be connected: pairs whose sample agreement is not
   below what a pair at the threshold reaches with near certainty. It gives out links only, and so
   a link is left out only where its ends are connected already.
3. Every pair is verified by weighted Jaccard similarity over whole texts. Blocks of the last round
   move samples only; a text goes to a pair of blocks only if it has a pair to verify there.
4. Connected components over the links are the groups.

Classes are numbered in the table they are written to, so nothing depends on ids of documents being
distinct: rows that repeat an id under another text are documents of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import connected_components, discard, fresh, join_small, keep_ids, materialize, or_empty, read_table

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 4
#: Pairs at the threshold agree on fewer samples with probability 0.001.
MIN_AGREEMENT = 24
#: Members of a bucket in one block of the last round.
BLOCK_ROWS = 512
#: Rows and places of the count-min sketch of words, and the places of each sample's table of random draws.
WORD_ROWS, WORD_PLACES, DRAWS = 2, 1 << 18, 1 << 13
SEED = 5
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)


def word_hashes(text: str) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def word_places(h: np.ndarray) -> np.ndarray:
    """A word's place in each row of the sketch, rows one after another."""
    bits = WORD_PLACES.bit_length() - 1
    return np.stack([((h >> np.uint64(bits * k)) & np.uint64(WORD_PLACES - 1)).astype(np.int64) + k * WORD_PLACES for k in range(WORD_ROWS)])


def shingles(h: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and their weights; fewer than five words are one shingle."""
    if not len(h):
        return h, np.zeros(0, dtype=np.float32)
    width = min(SHINGLE, len(h))
    n = len(h) - width + 1
    rarity = idf[word_places(h)].max(axis=0)  # the row where fewest other words fall on the place
    s, w = np.full(n, np.uint64(width)), np.zeros(n, dtype=np.float32)
    for i in range(width):
        s = s + h[i : i + n] * ODD[i]
        w = w + rarity[i : i + n]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0x94D049BB133111EB)
    s ^= s >> np.uint64(32)
    names, first, times = np.unique(s, return_index=True, return_counts=True)
    return names, w[first] / width * times.astype(np.float32)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64))
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return both / (total - both) if total > both else float(total > 0)


class Sampler:
    """Consistent weighted samples: of each k, the element with the least ln a = ln c - r * (t - beta + 1), t = floor(ln w / r + beta).

    r and c are Gamma(2, 1) and beta uniform, drawn by the element's hash from tables for each k: r
    by one part of it, c and beta by another, so that few of a long text's elements share all three.
    A sample is named by its element and t.
    """

    def __init__(self, samples: int = BANDS * ROWS, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        shape = (samples, DRAWS)
        r, c, beta = rng.gamma(2, 1, shape), rng.gamma(2, 1, shape), rng.random(shape)
        self.r, self.one_by_r, self.beta = r.astype(np.float32), (1 / r).astype(np.float32), beta.astype(np.float32)
        self.base = (np.log(c) + 64).astype(np.float32)  # ranks above 0, so that their bits are in order
        self.less = (beta - 1).astype(np.float32)
        self.odd = rng.integers(1, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, names: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of samples for each run of elements that begins at ``starts``."""
        log_w = np.log(weights)
        low = (names & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out = np.empty((len(starts), len(self.odd)), dtype=np.uint32)
        for k, odd in enumerate(self.odd):
            mixed = names * odd
            at = (mixed >> np.uint64(65 - DRAWS.bit_length())).astype(np.int64)
            other = ((mixed >> np.uint64(66 - 2 * DRAWS.bit_length())) & np.uint64(DRAWS - 1)).astype(np.int64)
            t = np.floor(log_w * self.one_by_r[k].take(at) + self.beta[k].take(other))
            rank = np.maximum(self.base[k].take(other) + self.r[k].take(at) * (self.less[k].take(other) - t), np.float32(0))
            name = low ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
            out[:, k] = np.minimum.reduceat((rank.view(np.uint32).astype(np.uint64) << np.uint64(32)) | name, starts).astype(np.uint32)
        return out


def inverse_document_frequencies(docs: DataFrame) -> np.ndarray:
    """1 + ln((documents + 1) / (documents with the word + 1)) by place of the sketch: a fixed number of places."""
    places = WORD_ROWS * WORD_PLACES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(places, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                h = word_hashes(text.as_py())
                if len(h):
                    n += 1
                    seen[np.unique(word_places(np.unique(h)))] += 1
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array([-1, *at], pa.int32()), pa.array([n, *seen[at]], pa.int64())], ["place", "n"])

    counts = docs.select(or_empty(F.col("text"))).mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # WORD_ROWS * WORD_PLACES + 1 rows at most
    n = np.zeros(places + 1)
    n[counts["place"].to_numpy(dtype=np.int64)] = counts["n"]
    return (1 + np.log((n[-1] + 1) / (n[:-1] + 1))).astype(np.float32)


def text_key(text: Column) -> Column:
    """Tells apart the texts of rows with one id."""
    return F.xxhash64(or_empty(text.cast("string")))


def sketches(docs: DataFrame, idf: Broadcast) -> DataFrame:
    """doc_id, text_key, the name (h1, h2) of the word sequence, samples; null name and samples for a text without words."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            ids, keys, texts = batch.column(0), batch.column(1), batch.column(2)
            for lo, hi in _runs(texts):
                h1, h2, names, weights, owner = [], [], [], [], []
                for i in range(lo, hi):
                    h = word_hashes(texts[i].as_py())
                    if not len(h):
                        h1.append(None)
                        h2.append(None)
                        continue
                    digest = xxhash.xxh3_128_intdigest(h.tobytes())
                    h1.append((digest >> 64) - (1 << 63))
                    h2.append((digest & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                    s, w = shingles(h, idf.value)
                    names.append(s)
                    weights.append(w)
                    owner.append(i - lo)
                samples: list = [None] * (hi - lo)
                if owner:
                    starts = np.cumsum([0, *map(len, names[:-1])])
                    found = sampler(np.concatenate(names), np.concatenate(weights), starts).view(np.int32)
                    for i, row in zip(owner, found, strict=True):
                        samples[i] = row
                yield pa.record_batch([ids.slice(lo, hi - lo), keys.slice(lo, hi - lo), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(samples, pa.list_(pa.int32()))], ["doc_id", "text_key", "h1", "h2", "samples"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), or_empty(F.col("text"))).mapInArrow(add, "doc_id long, text_key long, h1 long, h2 long, samples array<int>")


def _runs(texts: pa.Array, chars: int = 400_000) -> Iterator[tuple[int, int]]:
    """Cuts a batch where enough text is together."""
    lo, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text.as_buffer())
        if size >= chars:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def verified(pairs: DataFrame, texts: DataFrame, idf: Broadcast, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole texts have at least this weighted Jaccard similarity."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, None
        for pdf in frames:
            good = []
            for b, ta, tb in zip(pdf["b"], pdf["ta"], pdf["tb"], strict=True):
                if b != last:
                    last, kept = b, shingles(word_hashes(tb), idf.value)
                good.append(weighted_jaccard(shingles(word_hashes(ta), idf.value), kept) >= similarity)
            yield pdf.loc[good, ["a", "b"]]

    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return both.mapInPandas(check, "a long, b long")


def candidate_pairs(pdf: pd.DataFrame) -> np.ndarray:
    """(agreement, i, j) of rows of one group, from different blocks or the one, that are to be verified.

    Left out are rows of one part (connected already) and pairs that meet in an earlier band's bucket too.
    """
    reps, parts, samples = pdf["rep"].to_numpy(), pdf["part"].to_numpy(), np.array(pdf["samples"].tolist(), dtype=np.int32)
    side, lo, hi, number = pdf["side"].to_numpy(), pdf["lo"].iloc[0], pdf["hi"].iloc[0], int(pdf["band"].iloc[0])
    right = np.flatnonzero(side == hi)
    found = [np.zeros((0, 3), dtype=np.int32)]
    for i in np.flatnonzero(side == lo):
        others = right[(reps[right] < reps[i] if lo == hi else reps[right] != reps[i]) & (parts[right] != parts[i])]
        same = samples[others] == samples[i]
        earlier = same[:, : number * ROWS].reshape(len(others), number, ROWS).all(axis=2).any(axis=1)
        agree = same.sum(axis=1, dtype=np.int16)
        good = (agree >= MIN_AGREEMENT) & ~earlier
        found.append(np.column_stack([agree[good], np.full(int(good.sum()), i), others[good]]).astype(np.int32))
    return np.concatenate(found)


def by_group(make: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Applies ``make`` to each run of rows of one (band, key, lo, hi); a group is two blocks at most."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for pdf in frames:
            for k, group in pdf.groupby(["band", "key", "lo", "hi"], sort=False):
                if k != key and held:
                    yield make(pd.concat(held, ignore_index=True))
                    held = []
                key = k
                held.append(group)
        if held:
            yield make(pd.concat(held, ignore_index=True))

    return run


def remaining_links(member: DataFrame, samples: DataFrame, texts: DataFrame, idf: Broadcast, similarity: float) -> DataFrame:
    """Links (a, b) between members (rep, band, key, size, part) of one bucket with different parts.

    A bucket is cut into blocks of about ``BLOCK_ROWS`` members, and every two blocks meet in a
    group of their own, so no task holds more than two blocks. A first pass over samples alone finds
    the members that have a pair to verify in a group; only they get their text there. A pair is
    verified, most agreeing first, unless links found in its group connect it already.
    """

    def concerned(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = candidate_pairs(pdf)
        return pdf.loc[np.unique(pairs[:, 1:]), ["band", "key", "lo", "hi", "side", "rep", "part", "samples"]]

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        reps, parts, texts, sets, out = pdf["rep"].to_numpy(), pdf["part"].to_numpy(), pdf["text"].to_numpy(), {}, []
        pairs = candidate_pairs(pdf)
        for _, i, j in pairs[np.argsort(-pairs[:, 0], kind="stable")]:
            x, y = find(int(parts[i])), find(int(parts[j]))
            if x == y:
                continue
            for k in (i, j):
                if k not in sets:
                    sets[k] = shingles(word_hashes(texts[k]), idf.value)
            if weighted_jaccard(sets[i], sets[j]) >= similarity:
                root[x] = y
                out.append((int(max(reps[i], reps[j])), int(min(reps[i], reps[j]))))
        return pd.DataFrame(out, columns=["a", "b"])

    group = ["band", "key", "lo", "hi"]
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    m = member.withColumn("side", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    m = m.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"lo": F.least("side", "_other"), "hi": F.greatest("side", "_other")})
    m = m.join(samples, "rep").select(*group, "side", "rep", "part", "samples").repartition(*group).sortWithinPartitions(*group)
    few = materialize(m.mapInPandas(by_group(concerned), "band int, key long, lo int, hi int, side int, rep long, part long, samples array<int>"), "concerned")
    m = few.join(texts.toDF("rep", "text"), "rep").repartition(*group).sortWithinPartitions(*group)
    return materialize(m.mapInPandas(by_group(meet), "a long, b long"), "more-links")


def agreement(x: str, y: str):  # noqa: ANN201
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, v: s + v)


def _grouped(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, text_key, class_id, group_id, kept of each row; see ``groups``."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(inverse_document_frequencies(docs))  # WORD_ROWS * WORD_PLACES floats
    sketch = materialize(sketches(docs, idf), "sketches")
    named = sketch.filter("h1 is not null and doc_id is not null")
    classes = named.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("samples").alias("samples"))
    classes = materialize(classes.select("h1", "h2", "first", "samples", F.monotonically_increasing_id().alias("rep")), "classes")
    bands = F.array(*(F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), *(F.element_at("samples", i * ROWS + j + 1) for j in range(ROWS))).alias("key")) for i in range(BANDS)))
    member = classes.select("rep", F.xxhash64("h1", "h2").alias("h"), F.explode(bands).alias("_b")).select("rep", "h", F.col("_b.band").alias("band"), "_b.key")
    shared = member.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    member = materialize(member.join(shared, ["band", "key"]).select("rep", "h", "band", "key", "size"), "members")
    ids = materialize(member.select("rep").distinct().join(classes.select("rep", "first.doc_id", "first.text_key"), "rep"), "ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), or_empty(F.col("text")).alias("text"))
    texts = keep_ids(texts, "doc_id", ids, "doc_id", ids.count()).join(ids, ["doc_id", "text_key"]).select("rep", "text").dropDuplicates(["rep"])
    texts = materialize(texts, "texts")
    samples = materialize(classes.select("rep", "samples").join(ids.select("rep"), "rep", "left_semi"), "samples")
    pivot = member.groupBy("band", "key").agg(F.min(F.struct("h", "rep")).alias("p"))
    pairs = member.join(pivot, ["band", "key"]).filter("rep <> p.rep").select(F.greatest("rep", "p.rep").alias("a"), F.least("rep", "p.rep").alias("b")).distinct()
    pairs = pairs.join(samples.toDF("a", "sa"), "a").join(samples.toDF("b", "sb"), "b").filter(agreement("sa", "sb") >= MIN_AGREEMENT).select("a", "b")
    linked = materialize(verified(pairs, texts, idf, similarity), "links")
    # A label that two members share proves that they are connected; two that differ prove nothing.
    label = linked.groupBy("a").agg(F.min("b").alias("part"))
    label = materialize(label.join(label.toDF("part", "_next"), "part", "left").select("a", F.coalesce("_next", "part").alias("part")), "labels")
    now = member.drop("h").join(label.toDF("rep", "_part"), "rep", "left").withColumn("part", F.coalesce("_part", "rep")).drop("_part")
    now = materialize(now, "open")
    mixed = now.groupBy("band", "key").agg(F.min("part").alias("_lo"), F.max("part").alias("_hi")).filter("_lo < _hi").select("band", "key")
    more = remaining_links(now.join(mixed, ["band", "key"]), samples, texts, idf, similarity)
    part = materialize(connected_components(linked.union(more)), "parts")
    discard(member, ids, texts, samples, linked, label, now, more)
    told = classes.select("h1", "h2", "first", "rep").join(part.toDF("rep", "_part"), "rep", "left").withColumn("_part", F.coalesce("_part", "rep"))
    best = told.groupBy("_part").agg(F.min("first").alias("best"))
    told = told.join(best, "_part").select("h1", "h2", F.col("first.doc_id").alias("class_id"), "best")
    out = sketch.select("doc_id", "text_key", F.when(F.col("doc_id").isNotNull(), F.col("h1")).alias("h1"), "h2").join(told, ["h1", "h2"], "left")
    kept = F.col("best").isNull() | (F.struct("doc_id", "text_key") == F.col("best"))
    return out.select("doc_id", "text_key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("best.doc_id", "doc_id").alias("group_id"), kept.alias("kept"))


def groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, group_id, kept: one row per input row.

    class_id is the smallest doc_id with the same words in the same order, group_id the smallest
    doc_id reachable by links; kept where the row's id and text are the group's (of one id's texts
    that with the smallest hash). A text without words (null or empty too) and a row with a null
    doc_id are in no group but their own. Rows that repeat doc_id and text are alike. An empty table
    gives no rows, and other columns are left out. Groups don't depend on partitioning.
    """
    return _grouped(docs, similarity).drop("text_key")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows, with all their columns, of one document of each group; rows repeating doc_id and text go too.

    A row with a null doc_id stays, and so does a text without words.
    """
    key, many = fresh(docs, "text_key", "many")
    told = materialize(_grouped(docs, similarity).filter("doc_id is not null"), "groups")
    gone = materialize(told.filter("not kept").select("doc_id", F.col("text_key").alias(key)).distinct(), "gone")
    repeated = told.groupBy("doc_id", F.col("text_key").alias(key)).agg(F.count(F.lit(1)).alias(many)).filter(F.col(many) > 1).drop(many)
    repeated = materialize(repeated, "repeated")
    own = docs.withColumn(key, text_key(F.col("text")))
    kept = join_small(own, gone, ["doc_id", key], "left_anti")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    once = join_small(kept, repeated, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return join_small(kept, repeated, ["doc_id", key], "left_anti").unionByName(once).select(docs.columns)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read_table(spark, sf_dir, "documents"))
