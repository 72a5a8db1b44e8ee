"""Byte-level BPE encoding and decoding: recursive DuckDB queries in each task.

Encoding. A text is cut where a space follows something that isn't white space (no match of the
pattern crosses such a place), new pieces are split by the pattern, and each new word that is no
token by itself becomes rows (word, position, token), one for each byte. A recursive query joins
neighbours to the merge table and contracts each word's leftmost pair of smallest rank, until no
pair is left. Words over ``SHORT`` bytes go by a second recursive query, which contracts more pairs
in a step where the order provably doesn't matter, so that a word of a million letters takes some
hundred steps and not a million. It contracts

* pairs of rank r that nothing can come before: every merge of the right token's bytes with what
  begins with the byte after it, and of the left token with what ends in the byte before it, has a
  rank above r, and so has every merge of the new token with either side;
* of the pairs that share the smallest rank all that don't overlap, from the left, up to the first
  one whose new token could merge at a smaller rank.

A worker keeps what it has encoded, up to ``KEPT`` entries: results don't depend on it.

Decoding. Ids join the vocabulary and are aggregated in the order of their positions.

Nothing is shuffled; a task holds a block of ``BLOCK_CHARS`` characters, or one longer text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import or_empty, read_table

#: Characters of the texts encoded together; ids decoded together; entries a worker keeps, and how long the pieces among them may be.
BLOCK_CHARS, BLOCK_IDS, KEPT, KEPT_CHARS = 3_000_000, 200_000, 800_000, 48
#: Longest words of the plain query; rows (bytes) a query begins with, and rows that its steps may leave.
SHORT, START_ROWS, STEP_ROWS = 32, 400_000, 8_000_000
#: Positions in a word take so many bits of a sort key.
PLACES = 31

#: Rows of a word's last step are its tokens.
LAST_STEP = "SELECT {0} FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step) ORDER BY w, pos"
CONTRACT = f"""
WITH RECURSIVE t(step, w, pos, tok, len) AS (
  SELECT 0, w, pos, tok, len FROM begun
  UNION ALL
  (WITH r AS MATERIALIZED (
      SELECT a.*, b.len AS more, m.rank FROM t a LEFT JOIN t b ON b.w = a.w AND b.pos = a.pos + a.len LEFT JOIN merges m ON m.pair = (a.tok::BIGINT << 20) | b.tok),
    b AS (
      SELECT w, min((rank::BIGINT << {PLACES}) | pos) AS best, arg_min(pos + len, (rank::BIGINT << {PLACES}) | pos) AS gone FROM r WHERE rank IS NOT NULL GROUP BY w)
    SELECT step + 1, r.w, pos, if(pos = best & {(1 << PLACES) - 1}, rank, tok), if(pos = best & {(1 << PLACES) - 1}, len + more, len) FROM r JOIN b ON b.w = r.w WHERE pos <> gone)
)
{LAST_STEP.format("w, tok")}
"""
CONTRACT_LONG = f"""
WITH RECURSIVE t(step, w, pos, tok, len, before, after) AS (
  SELECT 0, w, pos, tok, len, before, after FROM begun
  UNION ALL
  (WITH r AS MATERIALIZED (
      SELECT a.*, b.len AS more, b.after AS beyond, m.rank,
        m.rank IS NOT NULL AND coalesce(zl.rank > m.rank, true) AND coalesce(zr.rank > m.rank, true) AS safe, safe AND coalesce(al.rank > m.rank, true) AND coalesce(br.rank > m.rank, true) AS sure
      FROM t a LEFT JOIN t b ON b.w = a.w AND b.pos = a.pos + a.len LEFT JOIN merges m ON m.pair = (a.tok::BIGINT << 20) | b.tok
        LEFT JOIN least_left al ON al.side = a.before::BIGINT * 1048576 + a.tok LEFT JOIN least_left zl ON zl.side = a.before::BIGINT * 1048576 + m.rank
        LEFT JOIN least_right br ON br.side = b.after::BIGINT * 1048576 + b.tok LEFT JOIN least_right zr ON zr.side = b.after::BIGINT * 1048576 + m.rank
      WHERE a.step < $steps),
    b AS MATERIALIZED (SELECT w, min(rank) AS best FROM r WHERE rank IS NOT NULL GROUP BY w),
    c AS MATERIALIZED (SELECT r.w, pos, pos + len AS gone, sure, safe FROM r JOIN b ON b.w = r.w WHERE sure OR rank = best),
    runs AS (SELECT w, pos, gone, sum(starts) OVER (PARTITION BY w ORDER BY pos) AS run, coalesce(sum(ends) OVER (PARTITION BY w ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
      FROM (SELECT w, pos, gone, if(lag(gone) OVER (PARTITION BY w ORDER BY pos) = pos, 0, 1) AS starts, if(safe, 0, 1) AS ends FROM c WHERE NOT sure)),
    h AS MATERIALIZED (
      SELECT w, pos, gone FROM c WHERE sure
      UNION ALL
      SELECT w, pos, gone FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY pos) AS i FROM runs) WHERE i % 2 = 1 AND ended = 0)
    SELECT step + 1, r.w, r.pos, if(h.pos IS NULL, tok, rank), if(h.pos IS NULL, len, len + more), before, if(h.pos IS NULL, after, beyond)
    FROM r SEMI JOIN b ON b.w = r.w ANTI JOIN h g ON g.w = r.w AND g.gone = r.pos LEFT JOIN h ON h.w = r.w AND h.pos = r.pos)
)
{LAST_STEP.format("w, pos, tok, len, before, after, step")}
"""
DECODE = "SELECT doc, array_to_string(list(piece ORDER BY pos), '') AS bytes FROM ids JOIN vocabulary USING (id) GROUP BY doc"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def codec(vocabulary: str) -> Codec:
    """A worker's codec of a rank file."""
    return Codec(vocabulary)


def cut(text: str) -> list[str]:
    """Pieces that the pattern splits each for itself: a new one begins at a space after anything but white space."""
    if not text:
        return []
    if MIXED_SPACE.search(text) is None:
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)] if first else [" " + x for x in rest]
    return EDGE.split(text)


#: White space before a space: there the pieces depend on what stands before.
MIXED_SPACE, EDGE = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")


class Codec:
    """Ranks, their tables in DuckDB, and the pieces encoded so far."""

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers

        with open(vocabulary) as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.kept: dict[str, bytes] = {}
        self.single = np.full(256, -1, dtype=np.int64)
        for b in range(256):
            self.single[b] = self.ranks.get(bytes([b]), -1)
        self.con = duckdb.connect(config={"threads": 1, "preserve_insertion_order": False})
        merges, left, right = [], {}, {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    merges.append((a << 20 | b, rank))
                    ends, begins = token[i - 1] << 20 | b, token[i] << 20 | a
                    left[ends], right[begins] = min(left.get(ends, rank), rank), min(right.get(begins, rank), rank)
        for name, key, rows in (("merges", "pair", merges), ("least_left", "side", left.items()), ("least_right", "side", right.items())):
            keys, values = np.array(list(rows), dtype=np.int64).reshape(-1, 2).T
            self._table("made", pa.table({key: keys, "rank": values.astype(np.int32)}), f"CREATE TABLE {name} AS SELECT * FROM made")
        pieces = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "piece": [t.decode("latin-1") for t in self.ranks]})
        self._table("made", pieces, "CREATE TABLE vocabulary AS SELECT * FROM made")

    def _table(self, name: str, table: pa.Table, query: str, **parameters: int) -> pa.Table | None:
        """The rows of a query that reads ``table`` by a name."""
        self.con.register(name, table)
        try:
            found = self.con.sql(query, params=parameters or None)
            return None if found is None else found.to_arrow_table()
        finally:
            self.con.unregister(name)

    def _rows(self, words: list[bytes]) -> pa.Table:
        lengths = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        first = np.cumsum(lengths) - lengths
        before, after = np.roll(data, 1), np.roll(data, -1)
        before[first], after[first + lengths - 1] = -1, -1  # the merge tables hold no such byte
        owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = (np.arange(len(data)) - np.repeat(first, lengths)).astype(np.int32)
        return pa.table({"w": owner, "pos": pos, "tok": self.single[data].astype(np.int32), "len": np.ones(len(data), np.int32), "before": before, "after": after})

    def _contract(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of the word, token) in order, words of one length class at a time."""
        rows = self._rows(words)
        if len(words[0]) <= SHORT:
            found = self._table("begun", rows, CONTRACT)
            yield found.column("w").to_numpy(), found.column("tok").to_numpy()
            return
        while rows.num_rows:
            steps = max(1, STEP_ROWS // rows.num_rows)
            rows = self._table("begun", rows, CONTRACT_LONG.replace("$steps", str(steps)))
            more = rows.column("step").to_numpy() == steps
            done = rows.filter(pa.array(~more))
            yield done.column("w").to_numpy(), done.column("tok").to_numpy()
            rows = rows.filter(pa.array(more)).drop_columns("step")

    def merge(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words, as little-endian unsigned 32-bit integers."""
        out, rest = {}, []
        for w in words:
            own = w.encode()
            rank = self.ranks.get(own)
            if rank is not None:
                out[w] = rank.to_bytes(4, "little")
            else:
                rest.append((own, w))
        rest.sort(key=lambda x: len(x[0]))
        sizes = np.array([len(own) for own, _ in rest])
        begin = 0
        while begin < len(rest):
            end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), START_ROWS, side="right")))
            if sizes[begin] <= SHORT:
                end = min(end, int(np.searchsorted(sizes, SHORT, side="right")))
            for owner, tok in self._contract([own for own, _ in rest[begin:end]]):
                ids = tok.astype("<u4").tobytes()
                edges = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
                places = (4 * edges).tolist()
                for a, b, w in zip(places, places[1:], owner[edges[:-1]].tolist()):
                    out[rest[begin + w][1]] = ids[a:b]
            begin = end
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.kept) > KEPT:
            self.kept = {}
        kept = self.kept
        pieces = [cut(t) for t in texts]
        ids = [list(map(kept.get, ps)) for ps in pieces]
        new = {p for ps, own in zip(pieces, ids) if None in own for p, x in zip(ps, own) if x is None}
        plain = {p for p in new if p[1:].isalpha() and (p[0] == " " or p[0].isalpha())}  # one match each
        words = {p: self.pattern.findall(p) for p in new - plain}
        found = self.merge(plain | ({w for ws in words.values() for w in ws} - kept.keys()))
        kept.update(found)
        for p, ws in words.items():
            if p not in found:
                kept[p] = b"".join([kept[w] for w in ws])
        out = [b"".join(own if None not in own else [kept[p] if x is None else x for p, x in zip(ps, own)]) for ps, own in zip(pieces, ids)]
        for p in [p for x in (found, words) for p in x if len(p) > KEPT_CHARS]:
            kept.pop(p, None)
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each array of ids, which must all be in the vocabulary."""
        n = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)
        rows = pa.table({"doc": np.repeat(np.arange(len(ids), dtype=np.int32), n), "pos": (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32), "id": flat})
        if not rows.num_rows:
            return [b""] * len(ids)
        found = self._table("ids", rows, DECODE)
        by = dict(zip(found.column("doc").to_pylist(), found.column("bytes").to_pylist(), strict=True))
        return [by.get(i, "").encode("latin-1") for i in range(len(ids))]


def _blocks(batches: Iterator[pa.RecordBatch], size, most: int) -> Iterator[list[tuple]]:  # noqa: ANN001
    """Rows of the batches in lists of about ``most`` by size; a larger row is one alone."""
    block, held = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
            n = size(row)
            if block and held + n > most:
                yield block
                block, held = [], 0
            block.append(row)
            held += n
    if block:
        yield block


def _text_size(row: tuple) -> int:
    return row[-1].as_buffer().size


def _id_blocks(ids: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for i, x in enumerate(ids):
        if i > begin and held + len(x) > BLOCK_IDS:
            yield begin, i
            begin, held = i, 0
        held += len(x)
    if ids:
        yield begin, len(ids)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, ids (array of int).

    A null or empty text has no ids. Rows with equal doc_id are documents of their own, a null
    doc_id stays null; special tokens in a text are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary or default_vocabulary())
        for block in _blocks(batches, _text_size, BLOCK_CHARS):
            ids = own.encode([text.as_py() for _, text in block])
            edges = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            yield pa.record_batch([pa.array([d.as_py() for d, _ in block], pa.int64()), pa.ListArray.from_arrays(pa.array(edges), values)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), or_empty(F.col("text"))).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) -> doc_id, bytes (binary); null ids count as none, one outside the vocabulary is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary or default_vocabulary())
        known = np.sort(np.fromiter(own.ranks.values(), np.int64))
        for block in _blocks(batches, lambda row: len(row[-1]), BLOCK_IDS):
            ids = [np.array(x.as_py(), dtype=np.float64) for _, x in block]
            for x in ids:
                if len(x) and not np.isin(x, known).all():
                    raise ValueError("an id that the vocabulary doesn't hold")
            yield pa.record_batch([pa.array([d.as_py() for d, _ in block], pa.int64()), pa.array(own.decode(ids), pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>"))).mapInArrow(run, "doc_id long, bytes binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text) encoded and the ids decoded again in one pass: doc_id, n_tokens, digests of ids and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary or default_vocabulary())
        for block in _blocks(batches, _text_size, BLOCK_CHARS):
            encoded = own.encode([text.as_py() for _, text in block])
            ids = [np.frombuffer(x, "<u4") for x in encoded]
            decoded = [b for begin, end in _id_blocks(ids) for b in own.decode(ids[begin:end])]
            columns = [[d.as_py() for d, _ in block], [len(x) for x in ids], [hashlib.sha256(x).hexdigest() for x in encoded], [hashlib.sha256(x).hexdigest() for x in decoded]]
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.string()) for c in columns[2:])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), or_empty(F.col("text"))).mapInArrow(run, DIGESTS)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))
