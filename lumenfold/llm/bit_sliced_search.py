"""Ranked lexical search over a bit-sliced impact index.

Index. Scan tasks cut documents into shards of at most ``SHARD_DOCS`` and write, for each term of a
shard, the documents that hold it and how often (nothing is shuffled); document counts, lengths and
frequencies are summed over all shards. From these every posting gets its impact, an integer, and
a shard's index is written: for each term one bitmap of the documents that hold it, and for each bit
of the impacts one bitmap over those documents.

Search. A task takes its shards one by one and all queries block by block. The slices of a query's
terms are spread over the shard's documents and added by carry arithmetic on whole bitmaps: three
operands of one weight become a sum and a carry of the next until two are left, whose sum ripples up.
A term that a query repeats comes in shifted, once for each bit of its number. The k best are found
from the most significant slice down: documents that have the bit, while there are at least k of
them, stay candidates alone; when they are fewer, they are in, and those without it go on. The last
candidates have equal scores and go by doc_id. The shards' best merge by a plain top-k, for all
statistics are global.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import discard, materialize, or_empty, read_table

TOP = 10
#: Documents and terms of a shard at most (one longer document is a shard alone); terms of the queries in one block.
SHARD_DOCS, SHARD_TERMS, QUERY_TERMS = 16_384, 8_000_000, 200_000
#: A term is a run of these; only A-Z are lower-cased.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Impact of tf occurrences in a document of length norm m, and the part of m that doesn't depend on the length.
UNIT, TF, NORM, FLAT, SLOPE = 1_000_000_000, 1_000, 8, 25, 75
POSTINGS = "docs array<long>, lengths array<long>, terms array<string>, counts array<int>, held binary, times binary"
SHARD = "docs array<long>, terms array<string>, counts array<int>, present binary, bits array<int>, slices binary"


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.translate(LOWER) if not text.isascii() else text.lower())


def postings(docs: DataFrame, shard_docs: int = SHARD_DOCS, asked: frozenset[str] | None = None) -> DataFrame:
    """One row per shard: its documents by id, their lengths, and for each term the numbers of its documents and its occurrences there.

    ``asked``: only these terms' postings are kept; lengths count every term.
    """

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[0] is None, r[0]))
        lists: dict[str, tuple[list[int], list[int]]] = {}
        for number, (_, _, counts) in enumerate(rows):
            for term, times in counts.items():
                held, often = lists.setdefault(term, ([], []))
                held.append(number)
                often.append(times)
        names = sorted(lists)
        held, times = (np.array([x for t in names for x in lists[t][j]], dtype=np.int32) for j in (0, 1))
        columns = [pa.array([[r[j] for r in rows]], pa.list_(pa.int64())) for j in (0, 1)]
        columns += [pa.array([names], pa.list_(pa.string())), pa.array([[len(lists[t][0]) for t in names]], pa.list_(pa.int32()))]
        return pa.record_batch([*columns, *(pa.array([x.tobytes()], pa.binary()) for x in (held, times))], [c.split()[0] for c in POSTINGS.split(", ")])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms_of(text.as_py())
                counts = Counter(words if asked is None else filter(asked.__contains__, words))
                if rows and (len(rows) >= shard_docs or size + len(counts) > SHARD_TERMS):
                    yield shard(rows)
                    rows, size = [], 0
                rows.append((doc_id, len(words), counts))
                size += len(counts)
        if rows:
            yield shard(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), or_empty(F.col("text"))).mapInArrow(build, POSTINGS)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(times: np.ndarray, lengths: np.ndarray, documents: int, total: int, weights: np.ndarray) -> np.ndarray:
    """What an occurrence of the term in a query adds to each posting's document. 64-bit integers as long as documents times a length stay below 10^17."""
    m = FLAT + (SLOPE * lengths * documents) // max(total, 1)
    tf = times.astype(np.int64)
    return weights * ((UNIT * tf) // (TF * tf + NORM * m))


def slices(values: np.ndarray) -> np.ndarray:
    """Bitmaps of the values' bits, least significant first."""
    n = int(values.max(initial=0)).bit_length()
    bits = (values[None, :] >> np.arange(n, dtype=np.int64)[:, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")


def index(listed: DataFrame, documents: int, total: int, weights: dict[str, int]) -> DataFrame:
    """A row per shard with each term's bitmaps, of the terms that have a weight above 0 (others add nothing)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = batch.column(1)[i].values.to_numpy()
                names, counts = batch.column(2)[i].as_py(), batch.column(3)[i].values.to_numpy()
                held, times = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int32) for c in (4, 5))
                edges = np.concatenate([[0], np.cumsum(counts)])
                w = np.array([weights.get(t, 0) for t in names], dtype=np.int64)
                gain = impacts(times, lengths[held], documents, total, np.repeat(w, counts))
                kept, present, bits, parts = [], [], [], []
                for j in np.flatnonzero(w > 0).tolist():
                    a, b = edges[j], edges[j + 1]
                    own = slices(gain[a:b])
                    mark = np.zeros(len(lengths), dtype=bool)
                    mark[held[a:b]] = True
                    kept.append(j)
                    present.append(np.packbits(mark, bitorder="little").tobytes())
                    bits.append(len(own))
                    parts.append(own.tobytes())
                lists = [pa.array([[names[j] for j in kept]], pa.list_(pa.string())), pa.array([[int(counts[j]) for j in kept]], pa.list_(pa.int32()))]
                rest = [pa.array([b"".join(present)], pa.binary()), pa.array([bits], pa.list_(pa.int32())), pa.array([b"".join(parts)], pa.binary())]
                yield pa.record_batch([batch.column(0).slice(i, 1), *lists, *rest], [c.split()[0] for c in SHARD.split(", ")])

    return listed.mapInArrow(build, SHARD)


class Shard:
    """A shard's bitmaps, spread over its documents as 64-bit words when asked for."""

    def __init__(self, docs: pa.Array, terms: list[str], counts: np.ndarray, present: np.ndarray, bits: np.ndarray, parts: np.ndarray) -> None:
        self.docs, self.n = docs, len(docs)
        self.words, self.bits, self.counts, self.parts = -(-self.n // 64), bits, counts, parts
        self.at = {t: j for j, t in enumerate(terms)}
        self.present = present.reshape(len(terms), -(-self.n // 8))
        sizes = -(-counts // 8) * bits
        self.begin = np.cumsum(sizes) - sizes

    def spread(self, j: int) -> np.ndarray:
        """(bits, words) of a term: its slices over all documents."""
        width = -(-int(self.counts[j]) // 8)
        own = self.parts[self.begin[j] : self.begin[j] + width * int(self.bits[j])].reshape(-1, width)
        own = np.unpackbits(own, axis=1, count=int(self.counts[j]), bitorder="little")
        out = np.zeros((len(own), self.words * 64), dtype=np.uint8)
        out[:, : self.n][:, np.unpackbits(self.present[j], count=self.n, bitorder="little").astype(bool)] = own
        return np.packbits(out, axis=1, bitorder="little").view(np.uint64)

    def score(self, query: dict[str, int]) -> list[np.ndarray]:
        """Slices of the scores, least significant first; ``query`` has each term's occurrences."""
        columns: list[list[np.ndarray]] = []  # bitmaps that count for the same power of two
        for term, times in query.items():
            if term not in self.at:
                continue
            for shift in (s for s in range(times.bit_length()) if times >> s & 1):
                for i, bitmap in enumerate(self.spread(self.at[term]), start=shift):
                    while len(columns) <= i:
                        columns.append([])
                    self._add(columns, i, bitmap)
        out, carry = [], None
        for i in range(len(columns)):
            left = [*columns[i], *([carry] if carry is not None else [])]
            carry = None
            while len(left) > 1:
                a, b = left.pop(), left.pop()
                c = left.pop() if left else np.zeros_like(a)
                x = a ^ b
                left.append(x ^ c)
                carry = a & b | x & c  # the only one: at most two operands and a carry come together
            out.append(left[0] if left else np.zeros(self.words, dtype=np.uint64))
        if carry is not None:
            out.append(carry)
        return out

    @staticmethod
    def _add(columns: list[list[np.ndarray]], i: int, bitmap: np.ndarray) -> None:
        """One more operand of weight i; of three, one stays and a carry goes up, so that at most two do."""
        while True:
            column = columns[i]
            column.append(bitmap)
            if len(column) < 3:
                return
            a, b, c = column
            x = a ^ b
            columns[i] = [x ^ c]
            bitmap, i = a & b | x & c, i + 1
            if len(columns) <= i:
                columns.append([])

    def top(self, scores: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k best with a score above 0, equal ones by their order in the shard."""
        if not scores:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        sure, open_to = np.zeros(self.words, dtype=np.uint64), np.bitwise_or.reduce(scores)
        if np.bitwise_count(open_to).sum() > k:
            for bitmap in reversed(scores):
                best = sure | open_to & bitmap
                n = int(np.bitwise_count(best).sum())
                if n > k:
                    open_to = open_to & bitmap
                else:
                    sure, open_to = best, open_to & ~bitmap
                if n == k:
                    open_to = np.zeros_like(sure)
                    break
        numbers = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
        best = numbers(sure)
        best = np.concatenate([best, numbers(open_to)[: max(0, k - len(best))]])
        value = np.zeros(len(best), dtype=np.int64)
        for i, bitmap in enumerate(scores):
            value |= ((bitmap[best >> 6] >> (best & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << i
        order = np.lexsort((best, -value))
        return best[order], value[order]


def _searcher(block: list[tuple], k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, terms, counts, bits = (batch.column(c)[i].values for c in (0, 1, 2, 4))
                present, parts = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint8) for c in (3, 5))
                shard = Shard(docs, terms.to_pylist(), counts.to_numpy().astype(np.int64), present, bits.to_numpy().astype(np.int64), parts)
                found = [(number, *shard.top(shard.score(dict(zip(names, times, strict=True))), k)) for number, names, times in block]
                best = np.concatenate([x[1] for x in found])
                number = np.repeat([x[0] for x in found], [len(x[1]) for x in found])
                yield pa.record_batch([pa.array(number.astype(np.int64)), docs.take(pa.array(best)), pa.array(np.concatenate([x[2] for x in found]))], ["number", "doc_id", "score"])

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: for each query (item_id, text) the k documents of ``docs`` (doc_id, text) that score highest.

    Null and empty texts have no terms: such documents are never found, such queries find none.
    Equal scores go by doc_id, a null one last; repeated doc_ids are documents of their own, repeated
    item_ids are one query of all their texts, a null item_id is one like others. An empty table on
    either side gives no rows. Queries travel to the tasks in blocks of ``QUERY_TERMS`` terms, and one
    job answers as many blocks as that bounds; more queries take more jobs over the same index.
    """
    spark = docs.sparkSession
    asked = _queries(queries)
    spans = materialize(asked, "queries")
    vocabulary = spans.select(F.explode("terms").alias("term")).distinct()
    names = frozenset(r["term"] for r in vocabulary.limit(QUERY_TERMS + 1).collect())
    listed = materialize(postings(docs, shard_docs, names if len(names) <= QUERY_TERMS else None), "postings")
    n, total = listed.select(F.explode("lengths").alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = listed.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
    known = df.join(vocabulary.withColumnRenamed("term", "terms"), "terms", "left_semi")
    found = None
    for part in _parts(spans):
        own = part.select(F.explode("terms").alias("terms")).distinct()
        weights = {r["terms"]: weight(n, r["df"]) for r in known.join(own, "terms", "left_semi").collect()}
        made = materialize(index(listed, n, total, weights), "index")
        rows = part.collect()
        block = [(i, r["terms"], r["times"]) for i, r in enumerate(rows)]
        if not block:
            continue
        hits = made.mapInArrow(_searcher(block, k), "number long, doc_id long, score long")
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "number long, item_id long")
        order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).join(F.broadcast(ids), "number").select("item_id", "rank", "doc_id", "score")
        best = materialize(best, "hits")
        discard(made)
        found = best if found is None else found.union(best)
    discard(listed)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


def _queries(queries: DataFrame) -> DataFrame:
    """item_id, terms and their occurrences, a row per item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = Counter(terms_of(text.as_py()))
                if counts:
                    yield pa.record_batch([pa.array([item] * len(counts), pa.int64()), pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["item_id", "term", "times"])

    cuts = queries.select(F.col("item_id").cast("long").alias("item_id"), or_empty(F.col("text"))).mapInArrow(cut, "item_id long, term string, times long")
    terms = cuts.groupBy("item_id", "term").agg(F.sum("times").alias("times")).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("term", "times"))).alias("t"))
    return terms.select("item_id", F.col("t.term").alias("terms"), F.col("t.times").alias("times"))


def _parts(spans: DataFrame) -> Iterator[DataFrame]:
    """The queries in parts of about ``QUERY_TERMS`` terms, by hash."""
    size = spans.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = -(-size // QUERY_TERMS)
    for i in range(parts):
        yield spans.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i) if parts > 1 else spans


def op12_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM words) GROUP BY ALL),
s AS (SELECT count_if(len(ts) > 0) AS docs, sum(len(ts)) AS total FROM words), df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT item_id, r, doc_id, sum(times * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::HUGEINT * ((1000000000 * tf::HUGEINT) // (1000 * tf + 8 * (25 + (75 * n::HUGEINT * docs) // total)))) AS score
  FROM q JOIN df USING (term) JOIN f USING (term), s GROUP BY ALL)
SELECT item_id, (row_number() OVER w)::INTEGER AS rank, doc_id, score::BIGINT AS score FROM p WHERE score > 0 WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10
"""
