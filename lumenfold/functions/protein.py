"""Features of protein strings, as column expressions over an upper-case column."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import residues as R
from lumenfold.functions.sequence import count_of

LETTERS = "".join(sorted(R.RESIDUES))


def valid(s: Column) -> Column:
    return s.rlike(f"^[{LETTERS}]*$")


def require_valid(s: Column) -> Column:
    """The string, or an error where a letter isn't a residue."""
    return F.when(valid(s), s).otherwise(F.raise_error(F.concat(F.lit("not a protein sequence: "), F.substring(s, 1, 50))).cast("string"))


def property_sum(s: Column, index: int) -> Column:
    """Sum of a residue property, from letter counts."""
    return sum((count_of(s, a) * v[index] for a, v in R.RESIDUES.items() if v[index]), F.lit(0.0))


def motif_sum(s: Column, motifs: tuple[str, ...]) -> Column:
    return sum((count_of(s, m) for m in motifs), F.lit(0.0))


TITRATABLE = [(a, p, 1.0) for a, p in R.PKA_POSITIVE.items()] + [(a, p, -1.0) for a, p in R.PKA_NEGATIVE.items()]


def isoelectric_point(df: DataFrame, column: str, name: str = "isoelectric_point", rounds: int = 100) -> DataFrame:
    """Adds the pH of zero net charge, by bisection of 0..14; 7 for an empty string."""
    s = F.col(column)
    df = df.withColumn("_residues", F.array(*(count_of(s, a) for a, _, _ in TITRATABLE)))

    def net(ph: Column) -> Column:
        q = 1 / (1 + F.pow(F.lit(10.0), ph - R.PKA_N_END)) - 1 / (1 + F.pow(F.lit(10.0), R.PKA_C_END - ph))
        for i, (_, pka, sign) in enumerate(TITRATABLE):
            q = q + sign * F.element_at("_residues", i + 1) / (1 + F.pow(F.lit(10.0), (ph - pka) * sign))
        return q

    def halve(x: Column, step: Column) -> Column:
        # The interval's width follows from the step, so the state is its lower end.
        mid = x + step
        return F.when(net(mid) > 0, mid).otherwise(x)

    steps = F.array(*(F.lit(14.0 / 2 ** (k + 1)) for k in range(rounds)))
    low = F.aggregate(steps, F.lit(0.0), halve)
    return df.withColumn(name, F.when(F.length(s) > 0, low + 14.0 / 2 ** (rounds + 1)).otherwise(7.0)).drop("_residues")


def hydrophobic_stretch(s: Column, window: int = 7) -> Column:
    """The largest mean hydrophobicity of a sliding window, by prefix sums in Arrow batches; 0 for a shorter string."""

    @F.pandas_udf("double")
    def slide(texts: pd.Series) -> pd.Series:
        value = np.zeros(256)
        for a, v in R.RESIDUES.items():
            value[ord(a)] = v[0]
        out = np.zeros(len(texts))
        for k, text in enumerate(texts):
            b = np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)
            if len(b) >= window:
                upto = np.concatenate([[0.0], np.cumsum(value[b])])
                out[k] = (upto[window:] - upto[:-window]).max() / window
        return pd.Series(out)

    return slide(F.coalesce(s, F.lit("")))


def developability(df: DataFrame, heavy: str, light: str | None = None, window: int = 7) -> DataFrame:
    """Adds charges, hydrophobicity, weight, isoelectric point and liability motifs of one or both chains.

    Both chains must hold residues only (``require_valid`` checks).
    """
    h, li = F.col(heavy), F.lit("") if light is None else F.col(light)
    df = df.withColumn("_both", F.concat(h, li))
    both = F.col("_both")
    n = F.length(both)
    df = df.withColumn("_stretch", hydrophobic_stretch(both, window)).withColumn("_mean", F.when(n > 0, property_sum(both, 0) / n).otherwise(0.0))
    mean, square = F.col("_mean"), sum((count_of(both, a) * v[0] * v[0] for a, v in R.RESIDUES.items()), F.lit(0.0)) / F.greatest(n, F.lit(1))
    sticky = sum((count_of(both, a) for a, v in R.RESIDUES.items() if v[0] > 1.5), F.lit(0.0))
    q_heavy, q_light = property_sum(h, 1), property_sum(li, 1)
    some = lambda x: F.when(n > 0, x).otherwise(0.0)
    df = df.withColumns({
        "charge_heavy": q_heavy, "charge_light": q_light, "charge": q_heavy + q_light, "charge_asymmetry": F.abs(q_heavy - q_light) / F.greatest(n, F.lit(1)),
        "hydrophobicity": mean, "hydrophobicity_std": some(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))), "hydrophobic_stretch": F.when(n >= window, F.col("_stretch")).otherwise(mean),
        "hydrophobic_fraction": some(sticky / F.greatest(n, F.lit(1))), "weight_kda": (property_sum(both, 2) - F.when(n > 1, (n - 1) * R.WATER).otherwise(0.0)) / 1000,
        "deamidation": motif_sum(both, R.DEAMIDATION), "isomerization": motif_sum(both, R.ISOMERIZATION), "oxidation": motif_sum(both, R.OXIDATION),
        "sequons": F.regexp_count(both, F.lit(R.SEQUON)).cast("double"), "odd_cysteines": count_of(both, "C") % 2,
    })
    df = df.withColumn("liabilities", F.col("deamidation") + F.col("isomerization") + F.col("oxidation") + F.col("sequons"))
    return isoelectric_point(df, "_both").drop("_both", "_stretch", "_mean")


def consensus(germlines: dict[str, str]) -> str:
    """The most frequent letter of each place that all germlines have; the first seen among equals."""
    return "".join(Counter(column).most_common(1)[0][0] for column in zip(*germlines.values()))


HUMANNESS = ("best", "top3", "top5", "identity_std", "best_framework", "consensus_matches", "z")


def humanness(df: DataFrame, key: str, column: str, chain: str = "heavy") -> DataFrame:
    """Ungapped identity with a germline library (22 or 21 sequences): best, means of the best 3 and 5, deviation,
    best framework identity, consensus matches, z score of the best. Empty sequences are left out.

    A sequence is compared with the whole library as one letter matrix, in Arrow batches; nothing is
    shuffled or multiplied.
    """
    if chain not in ("heavy", "light"):
        raise ValueError(f"chain must be 'heavy' or 'light', not {chain!r}")
    library = list((R.HEAVY_GERMLINES if chain == "heavy" else R.LIGHT_GERMLINES).values())
    agreed = consensus(R.HEAVY_GERMLINES if chain == "heavy" else R.LIGHT_GERMLINES)

    @F.pandas_udf(", ".join(f"{name} double" for name in HUMANNESS))
    def compare(texts: pd.Series) -> pd.DataFrame:
        lengths = np.array([len(g) for g in library])
        width = int(lengths.max())
        letters = np.array([[*g.ljust(width)] for g in library])
        place = np.arange(width)
        frame = np.ones(width, dtype=bool)
        for a, b in R.CDR_RANGES:
            frame[a:b] = False
        common = np.array([*agreed])
        out = np.zeros((len(texts), len(HUMANNESS)))
        for k, text in enumerate(texts):
            s = np.array([*text[:width].ljust(width, "-")])
            used = place < np.minimum(lengths, len(text))[:, None]
            same = (letters == s) & used
            identity = same.sum(axis=1) / used.sum(axis=1)
            inside = (used & frame).sum(axis=1)
            framework = np.where(inside > 0, (same & frame).sum(axis=1) / np.maximum(inside, 1), 0.0)
            ranked, spread = np.sort(identity)[::-1], identity.std()
            z = (ranked[0] - identity.mean()) / spread if spread > 1e-10 else 0.0
            out[k] = ranked[0], ranked[:3].mean(), ranked[:5].mean(), spread, framework.max(), (s[: len(common)] == common).sum(), z
        return pd.DataFrame(out, columns=list(HUMANNESS))

    d = df.select(key, F.upper(F.trim(column)).alias("_s")).filter("_s <> ''")
    return d.withColumn("_h", compare("_s")).select(key, "_h.*")


def region(numbered: Column, start: int, end: int) -> Column:
    """The letters of numbered residues [(position, letter)] with start <= position <= end, in order."""
    inside = F.filter(numbered, lambda p: (p["position"] >= start) & (p["position"] <= end))
    return F.array_join(F.transform(inside, lambda p: p["letter"]), "")


def at_positions(numbered: Column, positions: list[int]) -> Column:
    """The letter at each position; a dash where there is none."""
    return once(F.map_from_entries(numbered), lambda m: F.array(*(F.coalesce(F.element_at(m, F.lit(p)), F.lit("-")) for p in positions)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)
