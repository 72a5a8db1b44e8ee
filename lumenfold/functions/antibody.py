"""Features of numbered antibody sequences: per region, per position, binding rule.

A numbered sequence is an array of structs (position, letter), as ``protein.region`` takes it. All
are expressions over one row, so nothing is shuffled. A sequence that couldn't be numbered (null or
empty) has zeros everywhere and no binding residues.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.protein import at_positions, once, region
from lumenfold.functions.sequence import count_of

ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
# First and last positions of the regions, and positions of both chains that matter to the fold.
CDRS = {"cdr1": (27, 38), "cdr2": (56, 65), "cdr3": (105, 117)}
FRAMEWORK = ((1, 26), (39, 55), (66, 104))
KEY_POSITIONS = {"heavy": (*range(105, 118), 1, 5, 9, 11, 23, 41, 49, 94), "light": (*range(105, 118), 2, 4, 35, 38, 46, 87, 98)}

Embedding = Callable[[Column], Column]


def letter_shares(letters: Column) -> Column:
    """Mean of the one-hot rows of a string: the share of each of the twenty letters; zeros for an empty one."""
    return once(letters, lambda s: F.array(*(count_of(s, a) / F.greatest(F.length(s), F.lit(1)) for a in ALPHABET)))


def letter_presence(letters: Column) -> Column:
    """Maximum of the one-hot rows of a string."""
    return once(letters, lambda s: F.array(*(s.contains(a).cast("double") for a in ALPHABET)))


def letter_deviation(letters: Column) -> Column:
    """Population deviation of the one-hot rows of a string."""
    return F.transform(letter_shares(letters), lambda m: F.sqrt(m * (1 - m)))


def pooled_regions(numbered: Column, mean: Embedding = letter_shares, top: Embedding = letter_presence, deviation: Embedding = letter_deviation) -> dict[str, Column]:
    """Name -> array: each complementarity-determining region's mean and maximum, the framework's mean and deviation.

    The three callables pool a region's letters; by default those are one-hot rows, and an embedding
    of letters may take their place.
    """
    out = {}
    for name, (a, b) in CDRS.items():
        letters = region(numbered, a, b)
        out |= {f"{name}_mean": mean(letters), f"{name}_max": top(letters)}
    frame = F.concat(*(region(numbered, a, b) for a, b in FRAMEWORK))
    return out | {"framework_mean": mean(frame), "framework_std": deviation(frame)}


def position_features(numbered: Column, chain: str = "heavy", positions: tuple[int, ...] | None = None) -> Column:
    """One-hot rows of the letters at key positions, one after another; a position without a residue has zeros."""
    if chain not in KEY_POSITIONS:
        raise ValueError(f"chain must be one of {sorted(KEY_POSITIONS)}, not {chain!r}")
    places = positions or KEY_POSITIONS[chain]
    return F.flatten(F.transform(at_positions(numbered, list(places)), lambda letter: F.array(*((letter == a).cast("int") for a in ALPHABET))))


def paratope(numbered: Column) -> Column:
    """For each residue whether it is taken to bind: those of the complementarity-determining regions."""
    inside = lambda p: F.greatest(*(p.between(a, b) for a, b in CDRS.values()))
    return F.transform(numbered, lambda r: inside(r["position"]))


def antibody_features(df: DataFrame, key: str, numbered: str, chain: str = "heavy", methods: tuple[str, ...] = ("regions", "positions", "paratope")) -> DataFrame:
    """The key and one array of numbers per method; an unknown method is an error.

    ``whole`` is the pooling of the whole sequence, the one scale of multi-scale features there is.
    """
    n = F.col(numbered)
    known = {
        "regions": lambda: F.concat(*pooled_regions(n).values()), "positions": lambda: position_features(n, chain).cast("array<double>"),
        "paratope": lambda: F.transform(paratope(n), lambda b: b.cast("double")), "whole": lambda: letter_shares(F.array_join(F.transform(n, lambda r: r["letter"]), "")),
    }
    if unknown := set(methods) - known.keys():
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    return df.select(key, *(known[m]().alias(m) for m in methods))
