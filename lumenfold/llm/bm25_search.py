"""Exact BM25 top-k search: an inverted index in shards, pruned by block maxima, merged by global statistics.

Index. Each scan task cuts its documents into shards (bounded by documents and tokens) and writes a
row per shard: its documents, ordered by length, and the postings of each term. Nothing is
shuffled. Document frequencies and the mean length are summed over all shards.

Search. Each task takes the shards of its split of the index one by one, and for each goes through
the query blocks, bounded files in the shared folder, in batches. Within a shard a query's terms go
by how many documents hold them. Lists of a single posting block are added up at once. Longer lists
are cut into posting blocks with their maximal impact; lists that one in ``COMMON`` of the documents
holds are kept as columns, with a maximum for each range of documents. The ranges' bounds are the
sums of these maxima (as in block-max WAND, but the pivots of a batch are found at once instead of one
at a time). What short lists and columns give the most promising documents sets the threshold, a
score that the k best surely reach; posting blocks that touch no range whose bound reaches it are
never decoded. The columns of the ranges that are left are one matrix product in single precision,
for all queries of a batch; documents whose sum may reach the threshold, given the rounding of such a
sum, are added up anew in double precision. Shards are searched in two jobs: the square root of their
number first, whose k-th best score is each query's threshold in all the others, so that these find
little more than what belongs to the result. Scores use global statistics, so the shards' top-k
lists merge by a plain top-k per query.

Terms are 64-bit hashes of lower-case words.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import materialize, or_empty, read_table, shared_dir
from lumenfold.llm.warc import file_system

K1, B = 1.2, 0.75
TOP = 10
SHARD_DOCS, SHARD_TOKENS = 8_192, 3_000_000
#: Documents of a range, postings of a posting block; a term is kept as a column if at least one in COMMON of a shard's documents holds it, and it is among the COLUMNS most held.
RANGE_DOCS, BLOCK_POSTINGS, COMMON, COLUMNS = 64, 64, 40, 2_048
#: Postings that a batch of queries decodes (or those of one query), sums that it holds.
BATCH_POSTINGS, BATCH_SUMS = 1_500_000, 1_500_000
#: Terms of the queries in one block, about: 16 bytes each are read at a time.
QUERY_TERMS = 1_000_000
DIGITS = 9
NOTHING = (np.zeros(0, dtype=np.int64), np.zeros(0))
WORDS = re.compile(r"\w+")
SHARD = "shard long, docs binary, lengths binary, terms binary, starts binary, held binary, times binary"


def term_hashes(text: str) -> np.ndarray:
    words = WORDS.findall(text.lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def build_index(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per shard. Null texts are empty documents; rows with a null doc_id are left out."""

    def shard(number: int, ids: list[int], tokens: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(t) for t in tokens], dtype=np.int32)
        order = np.argsort(lengths, kind="stable")
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), lengths[order])
        terms = np.concatenate([tokens[i] for i in order]) if len(owner) else np.zeros(0, dtype=np.int64)
        by_term = np.argsort(terms, kind="stable")  # owners stay in order
        terms, owner = terms[by_term], owner[by_term]
        new = np.ones(len(terms), dtype=bool)
        new[1:] = (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        times = np.diff([*at, len(terms)]).astype(np.int32)
        distinct, starts = np.unique(terms[at], return_index=True)
        parts = [np.array(ids, dtype=np.int64)[order], lengths[order], distinct, np.append(starts, len(at)).astype(np.int64), owner[at], times]
        return pa.record_batch([pa.array([number], pa.int64()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], [c.split()[0] for c in SHARD.split(", ")])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        ids, tokens, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                tokens.append(term_hashes(text.as_py()))
                size += len(tokens[-1])
                if len(ids) >= shard_docs or size >= shard_tokens:
                    yield shard(number, ids, tokens)
                    number, ids, tokens, size = number + 1, [], [], 0
        if ids:
            yield shard(number, ids, tokens)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), or_empty(F.col("text"))).filter("doc_id is not null").mapInArrow(build, SHARD)


def document_frequencies(index: DataFrame) -> DataFrame:
    """(term, df) over all shards; the row with a null term has the number of documents and of tokens (df, tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts, lengths in zip(*(batch.column(i) for i in range(3)), strict=True):
                terms, df = np.frombuffer(terms.as_buffer(), np.int64), np.diff(np.frombuffer(starts.as_buffer(), np.int64))
                lengths = np.frombuffer(lengths.as_buffer(), np.int32)
                yield pa.record_batch([pa.array([None], pa.int64()), pa.array([len(lengths)], pa.int64()), pa.array([int(lengths.sum())], pa.int64())], ["term", "df", "tokens"])
                yield pa.record_batch([pa.array(terms), pa.array(df), pa.array(np.zeros(len(df), dtype=np.int64))], ["term", "df", "tokens"])

    return index.select("terms", "starts", "lengths").mapInArrow(count, "term long, df long, tokens long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of (query_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                terms, times = np.unique(term_hashes(text.as_py()), return_counts=True)
                if len(terms):
                    yield pa.record_batch([pa.array([query_id] * len(terms), pa.int64()), pa.array(terms), pa.array(times.astype(np.int64))], ["query_id", "term", "qtf"])

    return queries.select(F.col("query_id").cast("long").alias("query_id"), or_empty(F.col("text"))).filter("query_id is not null").mapInArrow(cut, "query_id long, term long, qtf long")


class Shard:
    """A shard's index in memory, with impacts: what one occurrence of a term in the query adds, but for the term's idf."""

    def __init__(self, docs, lengths, terms, starts, held, times, mean_length: float) -> None:  # noqa: ANN001
        self.docs = np.frombuffer(docs.as_buffer(), np.int64)
        lengths = np.frombuffer(lengths.as_buffer(), np.int32)
        self.terms = np.frombuffer(terms.as_buffer(), np.int64)
        self.starts = np.frombuffer(starts.as_buffer(), np.int64)
        self.held = np.frombuffer(held.as_buffer(), np.int32)
        tf = np.frombuffer(times.as_buffer(), np.int32)
        norm = K1 * (1 - B + B * lengths / max(mean_length, 1e-9))
        self.impact = tf * (K1 + 1) / (tf + norm[self.held])
        n, self.df = len(self.docs), np.diff(self.starts)
        self.range_of = np.arange(n) // RANGE_DOCS
        self.range_starts = np.arange(0, n, RANGE_DOCS)
        common = np.flatnonzero(self.df * COMMON >= n)
        common = np.sort(common[np.argsort(-self.df[common], kind="stable")[:COLUMNS]])
        self.column = np.full(len(self.terms), -1)
        self.column[common] = np.arange(len(common))
        self.table = np.zeros((n, len(common)), dtype=np.float32)
        of_posting = np.repeat(self.column, self.df)
        dense = of_posting >= 0
        self.table[self.held[dense], of_posting[dense]] = self.impact[dense]
        self.maxima = np.maximum.reduceat(self.table, self.range_starts, axis=0) if n else self.table
        # Posting blocks of the other lists: where they begin and end, their maximum, the ranges they touch.
        self.n_blocks = np.where(self.column < 0, -(-self.df // BLOCK_POSTINGS), 0)
        self.first_block = np.cumsum(self.n_blocks) - self.n_blocks
        of_term = np.repeat(np.arange(len(self.df)), self.n_blocks)
        self.begin = self.starts[of_term] + (np.arange(len(of_term)) - self.first_block[of_term]) * BLOCK_POSTINGS
        self.end = np.minimum(self.begin + BLOCK_POSTINGS, self.starts[of_term + 1])
        self.most = np.array([]) if not len(self.begin) else np.maximum.reduceat(np.append(self.impact, 0.0), np.column_stack([self.begin, self.end]).ravel())[::2]
        self.lo, self.hi = self.held[self.begin] // RANGE_DOCS, self.held[self.end - 1] // RANGE_DOCS
        # The postings by document, terms ascending.
        self.by_doc = np.argsort(self.held.astype(np.uint16) if n <= 1 << 16 else self.held, kind="stable").astype(np.int32)
        self.term_by_doc = np.repeat(np.arange(len(self.df), dtype=np.int32), self.df)[self.by_doc]
        self.doc_starts = np.concatenate([[0], np.cumsum(np.bincount(self.held, minlength=n))])
        self.weight_of = np.zeros(len(self.terms))
        self.decoded = self.asked = 0  # postings

    def look_up(self, terms: np.ndarray) -> np.ndarray:
        """The terms' numbers in this shard, -1 where it lacks one."""
        order = np.argsort(terms)  # sorted terms are found in near places, one after another
        at = np.empty(len(terms), dtype=np.int64)
        at[order] = np.searchsorted(self.terms, terms[order])
        at = np.minimum(at, max(0, len(self.terms) - 1))
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def _decode(self, blocks: np.ndarray, of: np.ndarray, weights: np.ndarray, queries: int, within: np.ndarray | None = None) -> np.ndarray:
        """By query and document what the postings of these blocks add, within each query's ranges or everywhere."""
        postings, n = _runs(self.begin[blocks], self.end[blocks])
        self.decoded += len(postings)
        docs, gain, of = self.held[postings], self.impact[postings] * np.repeat(weights, n), np.repeat(of, n)
        if within is not None:
            inside = within[of, docs // RANGE_DOCS]
            docs, gain, of = docs[inside], gain[inside], of[inside]
        return np.bincount(of * len(self.docs) + docs, weights=gain, minlength=queries * len(self.docs)).astype(float, copy=False).reshape(queries, -1)

    def _scores(self, docs: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of some documents, in double precision; terms are added in one order, whatever the shard."""
        self.weight_of[at] = weights
        postings, n = _runs(self.doc_starts[docs], self.doc_starts[docs + 1])
        gain = self.weight_of[self.term_by_doc[postings]] * self.impact[self.by_doc[postings]]
        self.weight_of[at] = 0.0
        return np.round(np.bincount(np.repeat(np.arange(len(docs)), n), weights=gain, minlength=len(docs)), DIGITS)

    def top(self, at: np.ndarray, weights: np.ndarray, k: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids and scores of the best k that reach the floor, ties by doc_id; documents with score 0 aren't found."""
        found = self.tops(at, weights, np.array([0, len(at)]), k, np.array([floor]))
        return next(((docs, score) for _, docs, score in found), NOTHING)

    def batches(self, at: np.ndarray, edges: np.ndarray) -> list[int]:
        """Where to cut the queries, so that the postings and sums of a batch have a bounded size."""
        size = np.concatenate([[0], np.cumsum(np.where((at >= 0) & (self.column[at] < 0), self.df[at], 0))])[edges] if len(self.terms) else edges * 0
        cuts = [0]
        while cuts[-1] < len(edges) - 1:
            j = cuts[-1]
            upto = int(np.searchsorted(size, size[j] + BATCH_POSTINGS, side="right")) - 1
            cuts.append(max(j + 1, min(upto, j + max(1, BATCH_SUMS // len(self.docs)), len(edges) - 1)))
        return cuts

    def tops(self, at: np.ndarray, weights: np.ndarray, edges: np.ndarray, k: int, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query of a batch that finds any: its number, doc_ids and scores as ``top`` gives them. The terms at[edges[j]:edges[j + 1]] are query j's."""
        queries, n = len(edges) - 1, len(self.docs)
        of = np.repeat(np.arange(queries), np.diff(edges))
        there = at >= 0
        at, weights, of = at[there], weights[there], of[there]
        if not len(at):
            return
        edges = np.searchsorted(of, np.arange(queries + 1))
        self.asked += int(self.df[at].sum())
        column, n_blocks = self.column[at], self.n_blocks[at]
        dense, short, rest = column >= 0, n_blocks == 1, n_blocks > 1
        w = np.zeros((queries, self.table.shape[1]), dtype=np.float32)
        w[of[dense], column[dense]] = weights[dense]
        # No sum of m products in single precision, each term at least 0, is off by a larger share.
        off = 2.0**-23 * (np.bincount(of[dense], minlength=queries) + 8)
        partial = self._decode(self.first_block[at[short]], of[short], weights[short], queries)
        blocks, count = _runs(self.first_block[at[rest]], self.first_block[at[rest]] + n_blocks[rest])
        of_block, w_block = np.repeat(of[rest], count), np.repeat(weights[rest], count)
        most, lo, hi, ranges = self.most[blocks] * w_block, self.lo[blocks], self.hi[blocks], len(self.range_starts)
        from_columns = (w @ self.maxima.T) * (1 + off[:, None])
        row = of_block * (ranges + 1)
        ends = [np.bincount(row + x, most, queries * (ranges + 1)).reshape(queries, -1) for x in (lo, hi + 1)]
        bound = np.maximum.reduceat(partial, self.range_starts, axis=1) + np.cumsum(ends[0] - ends[1], axis=1)[:, :ranges] + from_columns
        floors = floors.astype(float)
        if n > k:
            # What short lists and columns alone give k documents is a score that the k best reach.
            for j in np.flatnonzero(floors <= 0):
                few = np.argpartition(-(partial[j] + from_columns[j][self.range_of]), k - 1)[:k]
                floors[j] = float((partial[j, few] + (self.table[few] @ w[j]) * (1 - off[j])).min())
        cut = (floors - 1e-6)[:, None]
        within = (bound * (1 + 1e-12) >= cut) & (bound > 0)
        upto = np.pad(np.cumsum(within, axis=1), ((0, 0), (1, 0)))
        touched = upto[of_block, hi + 1] > upto[of_block, lo]
        if touched.any():
            partial += self._decode(blocks[touched], of_block[touched], w_block[touched], queries, None if within.all() else within)
        # The columns of the ranges that some query of the batch still needs, as one matrix product.
        # Elsewhere sums lack postings, but stay below the bound and so below the cut.
        needed = within.any(axis=0)
        docs = np.flatnonzero(needed[self.range_of]) if 2 * needed.sum() < ranges else None
        score = w @ (self.table if docs is None else self.table[docs]).T
        score += partial if docs is None else partial[:, docs]
        may = score >= np.maximum(cut * (1 - off[:, None]) * (1 - 2.0**-22), 1e-30).astype(np.float32)
        many = np.flatnonzero(may.sum(axis=1) > k)
        if len(many):  # the documents with the best sums have a k-th best score that the result reaches
            least = np.partition(score[many], score.shape[1] - k, axis=1)[:, score.shape[1] - k]
            may[many] &= score[many] >= ((least - 1e-6) * (1 - 2 * off[many]))[:, None]
        own, place = np.nonzero(may)
        places = np.searchsorted(own, np.arange(queries + 1))
        for j in np.unique(own):
            few = place[places[j] : places[j + 1]]
            few = few if docs is None else docs[few]
            sums = self._scores(few, at[edges[j] : edges[j + 1]], weights[edges[j] : edges[j + 1]])
            best = np.lexsort((self.docs[few], -sums))[:k]
            best = best[(sums[best] > 0) & (sums[best] >= floors[j] - 1e-6)]
            if len(best):
                yield int(j), self.docs[few[best]], sums[best]


def _runs(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all runs from begin to end, one run after another, and how many each has."""
    n = end - begin
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum()), n


def search(index: DataFrame, queries: DataFrame, k: int = TOP, query_terms_in_block: int = QUERY_TERMS) -> DataFrame:
    """query_id, rank, doc_id, score: of each query (query_id, text) the k best documents of the index.

    Every occurrence of a word in a query counts. Ties of scores rounded to ``DIGITS`` decimals go
    by doc_id; documents that share no word with the query aren't results, so a query without
    words has none. Repeated query_ids are one query of both texts; repeated doc_ids are documents
    of their own.
    """
    spark = index.sparkSession
    df = materialize(document_frequencies(index), "frequencies")
    whole = df.filter("term is null").first()
    if whole is None:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    n, mean_length = float(whole["df"]), whole["tokens"] / whole["df"]
    q = query_terms(queries).groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf")).join(df.select("term", "df").filter("term is not null"), "term")
    rare = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    q = q.withColumn("weight", F.col("qtf") * rare).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("terms"))
    q = materialize(q.select("query_id", F.col("terms.term").alias("terms"), F.col("terms.weight").alias("weights"), F.size("terms").alias("n")), "queries")
    blocks = max(1, math.ceil((q.agg(F.sum("n")).first()[0] or 0) / query_terms_in_block))
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("floor", F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")

    def best(part: DataFrame, asked: DataFrame, before: DataFrame | None = None) -> DataFrame:
        """The k best so far: those of some shards and those found before."""
        path = f"{shared_dir(spark)}/query-blocks-{uuid.uuid4().hex}"
        asked.repartition("block").write.partitionBy("block").parquet(path)
        found = materialize(part.drop("shard").mapInArrow(_searcher(path, blocks, mean_length, k), "query_id long, doc_id long, score double"), "hits")
        found = found if before is None else before.select("query_id", "doc_id", "score").union(found)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

    # The low bits number a task's shards: the first ones come first, so that tasks share the work.
    shards = index.select("shard").count()
    first = [r["shard"] for r in index.select("shard").orderBy(F.expr("shard & 4294967295"), F.xxhash64("shard")).limit(math.ceil(math.sqrt(shards))).collect()]
    found = best(index.filter(F.col("shard").isin(first)), q)
    if len(first) == shards:
        return found
    floors = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    asked = q.drop("floor").join(floors, "query_id", "left").fillna(0.0, ["floor"])
    return best(index.filter(~F.col("shard").isin(first)), asked, found)


def _block(path: str, block: int) -> tuple[np.ndarray, ...] | None:
    """Query ids, where their terms begin, terms, weights and floors of a block; None for an empty one."""
    system, folder = file_system(f"{path}/block={block}")
    from pyarrow import fs, parquet

    if system.get_file_info(folder).type == fs.FileType.NotFound:
        return None
    t = parquet.read_table(folder, filesystem=system, columns=["query_id", "terms", "weights", "floor"], partitioning=None).combine_chunks()
    terms, weights = (t.column(c).combine_chunks() for c in ("terms", "weights"))
    edges = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())])
    return t.column("query_id").to_numpy(), edges, terms.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False), t.column("floor").to_numpy()


def _searcher(path: str, blocks: int, mean_length: float, k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(*(batch.column(c)[i] for c in range(6)), mean_length)
                for number in range(blocks):
                    if block := _block(path, number):
                        yield from found(shard, *block)

    def found(shard: Shard, ids: np.ndarray, edges: np.ndarray, terms: np.ndarray, weights: np.ndarray, floors: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = shard.look_up(terms)
        cuts = shard.batches(at, edges)
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = slice(edges[a], edges[b])
            hits = [(np.full(len(d), ids[a + j]), d, s) for j, d, s in shard.tops(at[own], weights[own], edges[a : b + 1] - edges[a], k, floors[a:b])]
            if hits:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*hits, strict=True)], ["query_id", "doc_id", "score"])

    return run


def op8_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    index = materialize(build_index(docs), "index")
    found = search(index, docs.filter(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text"))
    return found.withColumn("score", F.round("score", 6))


OP8_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents WHERE doc_id IS NOT NULL), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT count(*) AS n, (SELECT count(*) FROM t) / count(*) AS mean FROM documents WHERE doc_id IS NOT NULL), len AS (SELECT doc_id, count(*) AS len FROM t GROUP BY 1),
df AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
s AS (SELECT q.doc_id AS query_id, d.doc_id, sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score
  FROM f q JOIN df USING (term) JOIN f d USING (term) JOIN len ON len.doc_id = d.doc_id, n WHERE q.doc_id % 100 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER w AS rank, doc_id, round(score, 6) AS score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) QUALIFY row_number() OVER w <= 10
"""
