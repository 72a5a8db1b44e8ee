"""Features of nucleotide strings, as column expressions over an upper-case DNA column."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default motifs (one is listed twice) and patterns of simple repeats.
MOTIFS = (
    "TATAAA", "TATAA", "TATA", "GGGCGG", "CCGCCC", "CCAAT", "ATTGG", "GT", "AG", "GTAAGT", "GTRAGT", "GCCACC", "ACCATG", "CG", "CGG", "CCG", "CGCG",
    "AATAAA", "ATTAAA", "AAAA", "TTTT", "GGGG", "CCCC", "ATAT", "GCGC", "TATA", "GGG",
)
REPEATS = ("AT", "TA", "GC", "CG", "AA", "TT", "GG", "CC", "AAA", "TTT", "GGG", "CCC", "ATAT", "TATA", "GCGC", "CGCG")
# Ambiguity codes that are expanded; others are counted as they stand.
AMBIGUOUS = {"R": "[AG]", "Y": "[CT]", "W": "[AT]", "S": "[GC]", "M": "[AC]", "K": "[GT]"}
BASES = "ACGT"


def dna(s: Column) -> Column:
    return F.translate(F.upper(s), "U", "T")


def clean(s: Column, alphabet: str = BASES, other: str = "N") -> Column:
    """Upper case, U as T for DNA and T as U for RNA, what isn't in the alphabet as ``other``."""
    up = F.upper(s)
    up = F.translate(up, "U", "T") if "T" in alphabet else F.translate(up, "T", "U")
    return F.regexp_replace(up, f"[^{alphabet}]", other)


def is_rna(df: DataFrame, column: str, order: str, rows: int = 100) -> DataFrame:
    """One row: whether the first rows hold more U than T."""
    first = df.orderBy(order).limit(rows).select(F.upper(column).alias("s"))
    n = lambda b: F.coalesce(F.sum(F.length("s") - F.length(F.replace("s", F.lit(b), F.lit("")))), F.lit(0))
    return first.agg((n("U") > n("T")).alias("is_rna"))


def count_of(s: Column, motif: str) -> Column:
    """Occurrences that don't overlap, from the left."""
    return (F.length(s) - F.length(F.replace(s, F.lit(motif), F.lit("")))) / F.lit(len(motif))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def ngrams(s: Column, n: int) -> Column:
    """All substrings of length n, in order; none for a shorter string."""
    return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substr(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def gc_windows(s: Column, window: int = 100) -> Column:
    """struct(variance, max, min) of the GC share over sliding windows, by prefix sums in Arrow batches: linear in the length.

    The same by higher-order functions reads each base once for every window that covers it.
    """

    @F.pandas_udf("variance double, max double, min double")
    def slide(texts: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(texts), 3))
        for k, text in enumerate(texts):
            if text:
                b = np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)
                upto = np.concatenate([[0], np.cumsum((b == 71) | (b == 67))])
                w = min(window, len(b))
                share = (upto[w:] - upto[:-w]) / w
                out[k] = share.var(), share.max(), share.min()
        return pd.DataFrame(out, columns=["variance", "max", "min"])

    return slide(F.coalesce(s, F.lit("")))


def gc_features(df: DataFrame, column: str, window: int = 100) -> DataFrame:
    """Adds content, skew, purines, and variance, maximum and minimum of GC over sliding windows; zeros for no bases."""
    s = F.col(column)
    n, g, c, a, t = F.length(s), *(count_of(s, b) for b in "GCAT")
    out = {
        "gc": ratio(g + c, n), "skew": ratio(g - c, g + c), "at": ratio(a + t, n), "purine": ratio(a + g, n),
        "gc_variance": F.col("_w.variance"), "gc_max": F.col("_w.max"), "gc_min": F.col("_w.min"),
    }
    return df.withColumn("_w", gc_windows(s, window)).withColumns(out).drop("_w")


def entropy(counts: list[Column], total: Column) -> Column:
    return -sum((F.when(c > 0, c / total * F.log2(c / total)).otherwise(0.0) for c in counts), F.lit(0.0))


def complexity_features(df: DataFrame, column: str) -> DataFrame:
    """Adds entropies, distinct k-mer shares, repeats, longest run, CpG ratio; zeros for fewer than two bases."""
    s = F.col(column)
    n = F.length(s)
    df = df.withColumn("_pairs", ngrams(s, 2))
    df = df.withColumn("_counts", F.array(*(F.size("_pairs") - F.size(F.array_remove("_pairs", d)) for d in map("".join, product(BASES, repeat=2)))))
    distinct = lambda k: F.size(F.array_distinct(ngrams(s, k)))
    repeats = sum((n - F.length(F.replace(s, F.lit(p * 3), F.lit(""))) for p in REPEATS), F.lit(0))
    runs = F.transform(F.regexp_extract_all(s, F.lit("(A+|C+|G+|T+)"), F.lit(1)), F.length)
    three = F.least(F.lit(3), n)
    short = F.when(n >= 3, distinct(3)).otherwise(F.lit(1))
    expected = count_of(s, "C") * count_of(s, "G") / n
    out = {
        "base_entropy": entropy([count_of(s, b) for b in BASES], n), "pair_entropy": entropy([F.element_at("_counts", i + 1) for i in range(16)], n - 1),
        "linguistic": short / F.least(F.pow(F.lit(4), three), n - three + 1), "repeat_fraction": F.least(repeats / n, F.lit(1.0)), "longest_run": F.array_max(runs).cast("double"),
        "distinct_4": F.when(n >= 4, distinct(4) / (n - 3)).otherwise(1.0), "cpg": ratio(count_of(s, "CG"), expected), "distinct_6": F.when(n >= 6, distinct(6) / (n - 5)).otherwise(0.0),
    }
    return df.withColumns({k: F.when(n >= 2, v).otherwise(0.0) for k, v in out.items()}).drop("_pairs", "_counts")


def positional_features(s: Column, bins: int = 10) -> Column:
    """Shares of A, C, G, T in each of equal stretches, as one array."""
    n = F.length(s)
    parts = []
    for i in range(bins):
        start = F.floor(n * F.lit(i) / bins)
        end = F.floor(n * F.lit(i + 1) / bins) if i < bins - 1 else n
        part = F.substr(s, (start + 1).cast("int"), (end - start).cast("int"))
        parts += [ratio(count_of(part, b), F.length(part)) for b in BASES]
    return F.array(*parts)


def motif_counts(s: Column, motifs: tuple[str, ...] = MOTIFS) -> Column:
    """Counts of each motif, as one array; ambiguity codes as classes of letters."""
    out = []
    for m in motifs:
        pattern = "".join(AMBIGUOUS.get(x, x) for x in m)
        out.append(F.regexp_count(s, F.lit(pattern)).cast("double") if "[" in pattern else count_of(s, m))
    return F.array(*out)


def one_hot(s: Column, length: int, alphabet: str = BASES) -> Column:
    """Flat 0/1 array of the first ``length`` letters; padding and other letters are zeros."""
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.array(*((F.substr(s, i, F.lit(1)) == b).cast("int") for b in alphabet))))


def kmer_counts(df: DataFrame, key: str, column: str, k: int = 6, lower: bool = True, normalize: bool = True) -> DataFrame:
    """(key, kmer, n, value), long form: only k-mers over the four bases; shares of the row's total over all k if normalized.

    A row's k-mers are counted where the row is, in Arrow batches, and only distinct ones leave it:
    nothing is shuffled. Rows that repeat a key are counted each for itself.
    """
    sizes = range(1, k + 1) if lower else [k]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.full(256, -1, dtype=np.int64)
        code[[ord(b) for b in BASES]] = range(4)
        names = {n: np.array(["".join(p) for p in product(BASES, repeat=n)]) for n in sizes if n <= 8}
        for batch in batches:
            rows, grams, counts, totals = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                c = code[np.frombuffer((text or "").encode("ascii", "replace"), dtype=np.uint8)]
                found = []
                for n in sizes:
                    if len(c) >= n:
                        number, good = np.zeros(len(c) - n + 1, dtype=np.int64), np.ones(len(c) - n + 1, dtype=bool)
                        for m in range(n):
                            part = c[m : len(c) - n + 1 + m]
                            number, good = number * 4 + part, good & (part >= 0)
                        at, times = np.unique(number[good], return_counts=True)
                        found.append((names[n][at] if n in names else ["".join(BASES[(x >> (2 * (n - 1 - m))) & 3] for m in range(n)) for x in at.tolist()], times))
                total = sum(int(t.sum()) for _, t in found)
                for name, times in found:
                    grams.extend(name)
                    counts.append(times)
                    rows.append(np.full(len(times), i))
                    totals.append(np.full(len(times), total))
            if grams:
                yield pa.record_batch([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(grams, pa.string()), pa.array(np.concatenate(counts), pa.int64()), pa.array(np.concatenate(totals), pa.int64())], [key, "kmer", "n", "total"])

    d = df.select(key, column)
    counts = d.mapInArrow(count, f"`{key}` {d.schema[key].dataType.simpleString()}, kmer string, n long, total long")
    return counts.select(key, "kmer", "n", (F.col("n") / F.col("total") if normalize else F.col("n").cast("double")).alias("value"))


GC = ("gc", "skew", "at", "purine", "gc_variance", "gc_max", "gc_min")
COMPLEXITY = ("base_entropy", "pair_entropy", "linguistic", "repeat_fraction", "longest_run", "distinct_4", "cpg", "distinct_6")


def hybrid_features(df: DataFrame, key: str, column: str, methods: tuple[str, ...] = ("gc", "complexity", "positional", "motifs")) -> DataFrame:
    """The key and one feature array per method."""
    s = F.col(column)
    known = {
        "gc": lambda d: gc_features(d, column).withColumn("f_gc", F.array(*GC)).drop(*GC), "complexity": lambda d: complexity_features(d, column).withColumn("f_complexity", F.array(*COMPLEXITY)).drop(*COMPLEXITY),
        "positional": lambda d: d.withColumn("f_positional", positional_features(s)), "motifs": lambda d: d.withColumn("f_motifs", motif_counts(s)),
    }
    if unknown := set(methods) - known.keys():
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    out = df.select(key, column)
    for m in methods:
        out = known[m](out)
    return out.select(key, *(F.col(f"f_{m}").alias(m) for m in methods))
