"""Best-fit packing of token pieces into fixed-length sequences.

The length histogram (at most ``capacity`` rows, whatever the corpus) is the only thing that
reaches the driver. There a configuration linear program over it is solved by multiplicative
weights, priced by a knapsack dynamic program, and rounded: each configuration is used as often as
its use's whole part says, then, those of the longest pieces first, once more where its pieces are
still there. The program is solved
again for what is left, until that is about a sequence or a solution places less than a tenth of
it (full configurations are used first, so that pieces wait for a better partner); the few pieces
left go by best fit, tightest gap first. Covering and rounding work on lengths
with multiplicities, so the plan, a table of runs "pieces number i to j of length l go to place p
of sequences q, q+1, ...", grows with the lengths present (a few rows for each) and not with the
pieces. It is shipped to the tasks, which look up each piece by its rank within its length.

Tokenizing runs in Arrow batches; token ids never leave the task that made them.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import materialize, or_empty, read_table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rounds of multiplicative weights at most, the share of its demand that a round covers of each length, and how fast a covered length's price falls.
ROUNDS, STEP, RATE = 100, 0.1, 3.0
#: How full a configuration must be for its whole uses, and for being used once more; emptier ones only if those place less than this share of what is left.
FULLNESS, PROGRESS = ((0.999, 0.99), (0.99, 0.95), (0.0, 0.0)), 0.1
#: Pieces of one length in one window partition, about.
SALT_ROWS = 20_000


#: The special token of the vocabulary; in a text it is one id, as the tokenizers library has it by default.
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def byte_bpe(vocabulary: str):
    """The byte-level BPE encoder of a rank file; ``encode_ordinary`` takes special tokens as ordinary text.

    The rank file holds the same vocabulary as the JSON of the ``tokenizers`` library and gives the
    same ids (tested) in a quarter of the CPU time.
    """
    import public_tokenizers
    import tiktoken

    with open(vocabulary) as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@lru_cache(maxsize=2)
def json_bpe(library: str | None = None):
    """The same encoder by the ``tokenizers`` library, from its JSON."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(library or public_tokenizers.path("byte_bpe_50k.json"))


def encoder(vocabulary: str | None = None, library: str | None = None):
    """Text -> ids; special tokens in the text are special.

    The rank file's encoder gives up on about a million white spaces in a row; such a text goes to
    the ``tokenizers`` library, which takes longer and gives the same ids.
    """
    bpe, allowed = byte_bpe(vocabulary or default_vocabulary()), set(SPECIAL)

    def encode(text: str) -> list[int]:
        try:
            return bpe.encode(text, allowed_special=allowed, disallowed_special=())
        except ValueError:  # its pattern's stack is full
            return json_bpe(library).encode(text, add_special_tokens=False).ids

    return encode


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None, library: str | None = None) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document's ids and ``end_id``; the first may be shorter.

    A null text counts as empty (one piece holding ``end_id``). Rows with equal doc_id are
    documents of their own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, library)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py()), end_id], dtype="<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                out += [(doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), or_empty(F.col("text"))).mapInArrow(cut, PIECES)


def knapsack_table(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best value of each room and the length it takes (0: none): unbounded knapsack, weights 1..capacity.

    Among equals the longest is taken, so that ties don't fill a configuration with short pieces.
    """
    capacity = len(price) - 1
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    useful = np.flatnonzero(price > 0)
    longest, fitting = useful[::-1], np.searchsorted(useful, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fit = longest[len(useful) - fitting[c] :]
        if len(fit):
            value = best[c - fit] + price[fit]
            k = int(value.argmax())
            if value[k] > best[c]:
                best[c], took[c] = value[k], fit[k]
    return best, took


def filling(took: np.ndarray, room: int) -> list[int]:
    """The lengths that a table takes into a room."""
    out = []
    while room > 0:
        if took[room]:
            out.append(int(took[room]))
        room -= int(took[room]) or 1
    return out


def configurations(histogram: np.ndarray, rounds: int = ROUNDS, step: float = STEP) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """A fractional solution of the configuration program: (use by configuration, share covered by length).

    Minimize the total use such that each length is covered: for every length, the sum over
    configurations of use times occurrences is at least its number of pieces. By multiplicative
    weights: a length's price is its share of the capacity times exp(-RATE * share covered). Each
    round raises the share that all lengths are to reach by a step; a knapsack table over the prices
    gives, for each length that is behind, the best configuration that holds it, which is used until
    the length has caught up or another one is more than a step ahead. Those far ahead are left out
    of the table.
    """
    capacity = len(histogram) - 1
    need, lengths = histogram.astype(float), np.flatnonzero(histogram)
    lengths = lengths[lengths > 0]
    covered, used = np.zeros(capacity + 1), {}
    target = 0.0
    for _ in range(rounds):
        if not len(lengths) or (least := float(covered[lengths].min())) >= 1:
            break
        target = min(1.0, max(target, least) + step)
        near = lengths[covered[lengths] < target + step]
        price = np.zeros(capacity + 1)
        price[near] = near / capacity * np.exp(-RATE * (covered[near] - least))
        _, took = knapsack_table(price)
        for length in lengths[::-1].tolist():
            if covered[length] >= target:
                continue
            parts = tuple(sorted((length, *filling(took, capacity - length)), reverse=True))
            held, times = np.unique(parts, return_counts=True)
            own = (target - covered[length]) * need[length] / parts.count(length)
            amount = min(own, float(((target + step - covered[held]) * need[held] / times).min()))
            if amount > 0:
                used[parts] = used.get(parts, 0.0) + amount
                covered[held] += amount * times / need[held]
    return used, covered


def best_fit(histogram: np.ndarray) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best fit, longest first, all pieces of a length at once: runs (length, pieces, first sequence, offset), number of sequences.

    Gaps are runs of sequences with equal room; a length takes from the tightest ones, or opens
    sequences that each hold as many as fit. The number of runs depends on the lengths present, not
    on the pieces.
    """
    capacity = len(histogram) - 1
    runs: list[tuple[int, int, int, int]] = []
    sequences = 0
    gaps: dict[int, list[tuple[int, int]]] = {}
    for length in np.flatnonzero(histogram)[::-1].tolist():
        n = int(histogram[length])
        while n:
            room = min((r for r, at in gaps.items() if r >= length and at), default=0)
            if room:
                first, many = gaps[room].pop()
                each = min(room // length, max(1, n // many))
            else:
                room, first, each = capacity, sequences, min(capacity // length, n)
                many = n // each
                sequences += many
            now = min(many, n)
            if now < many:
                gaps[room].append((first + now, many - now))
            for k in range(each):
                runs.append((length, now, first, capacity - room + k * length))
            n -= now * each
            if rest := room - each * length:
                gaps.setdefault(rest, []).append((first, now))
    return runs, sequences


def pack_histogram(histogram: np.ndarray, rounds: int = ROUNDS) -> tuple[list[tuple[int, int, int, int, int]], int, int]:
    """Runs (length, first rank, pieces, first sequence, offset), the number of sequences, and the pieces that best fit placed.

    Every piece of the histogram is in exactly one run.
    """
    capacity = len(histogram) - 1
    left, taken, runs, sequences = histogram.astype(np.int64).copy(), np.zeros(capacity + 1, dtype=np.int64), [], 0

    def place(length: int, times: int, offset: int, first: int) -> None:
        runs.append((length, int(taken[length]), times, first, offset))
        taken[length] += times
        left[length] -= times

    def use(parts: tuple[int, ...], times: int) -> int:
        """Fills as many sequences with a configuration as asked, at most as there are pieces."""
        held, each = np.unique(parts, return_counts=True)
        times = min(times, int((left[held] // each).min()))
        offset = 0
        for length in parts if times else ():
            place(length, times, offset, sequences)
            offset += length
        return times

    sequences += use((capacity,), int(left[capacity]))  # a full piece is a configuration by itself
    size = np.arange(capacity + 1)
    while (before := int(left @ size)) > capacity:
        used, _ = configurations(left, rounds)
        for whole, once in FULLNESS:
            for parts in sorted((p for p in used if sum(p) >= whole * capacity), key=lambda p: (-used[p], p)):
                sequences += use(parts, int(used[parts]))
                used[parts] %= 1
            for parts in sorted((p for p in used if sum(p) >= once * capacity), key=lambda p: tuple(-n for n in p)):
                sequences += use(parts, 1)
            if int(left @ size) <= (1 - PROGRESS) * before:
                break
        else:
            break
    residue = int(left.sum())
    rest, more = best_fit(left)
    for length, times, first, offset in rest:
        place(length, times, offset, sequences + first)
    return runs, sequences + more, residue


def _ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Adds ``_rank``, from 0 within each length; a frequent length is spread over salts."""
    most = max(histogram.values(), default=1)
    salts = max(1, -(-most // SALT_ROWS))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = (
        salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
        .select("length", "_salt", "_before")
    )
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("_row", F.row_number().over(within) - 1).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_row") + F.col("_before")).drop("_salt", "_row", "_before")


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces`` (doc_id, piece, start, length, ids_crc32)."""
    pieces = materialize(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    runs, _, _ = pack_histogram(counts)
    plan = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)

    def look_up(batches: Iterator) -> Iterator:
        for pdf in batches:
            at = np.empty(len(pdf), dtype=np.int64)
            for length in np.unique(pdf["length"]):
                rows = (pdf["length"] == length).to_numpy()
                a, b = np.searchsorted(plan[:, 0], [length, length + 1])
                at[rows] = a + np.searchsorted(plan[a:b, 1], pdf["_rank"].to_numpy()[rows], side="right") - 1
            pdf["sequence_id"] = plan[at, 3] + pdf["_rank"].to_numpy() - plan[at, 1]
            pdf["offset"] = plan[at, 4]
            yield pdf.drop(columns="_rank")

    return _ranked(pieces, histogram).select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInPandas(look_up, f"{PIECES}, sequence_id long, offset long")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(read_table(spark, sf_dir, "documents")))
