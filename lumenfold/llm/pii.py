"""Personal data: base patterns, and further spans by aggregated weak supervision.

One pass over whole texts finds the base spans and wider candidates of each kind, and asks four
labelers about every candidate, none of which knows whether the base pattern matched: the form
(a regular expression of well-grouped values), the value (Luhn, ranges, digit counts), gazetteers
(issuer prefixes, calling codes, domain endings, reserved networks) and the words before it (those
that announce the kind, those that announce another number). Each votes yes, no or nothing. Votes
are counted by pattern (at most kinds * 3**4 rows, whatever the corpus); expectation-maximisation
over those counts estimates how reliable each labeler is for each kind and gives each pattern's
posterior. A logistic model of each kind's spans, which sees the words on both sides, the shape of
the value and the votes, is trained on the posteriors of a bounded sample of candidates
(``MAX_TRAINING_SPANS``, in hash order). Candidates that the model accepts, whose value no check
refutes and that overlap no base span of any kind are added. No text is shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import discard, materialize, or_empty, read_table
from lumenfold.llm.toxicity import Sparse, fit_linear

WORD = re.compile(r"\w+")
KINDS = ("email", "ip", "card", "phone")
#: The base patterns (each starts where the leftmost match can).
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wider shapes.
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,4}")
LOCAL_CALL = re.compile(r"(?<![\w+.])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[-. ])[0-9]{3,4}[-. ][0-9]{4}(?![\w])|\b00[1-9][0-9](?:[ -]?[0-9]){6,11}\b")
#: An international number by itself, where the base pattern runs on into the digits after it.
INTERNATIONAL = re.compile(r"(?<![\w+])\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9])")
#: Gazetteers and context words.
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "36", "38", "30", "6011", "62", "64", "65", "35")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "98", "351", "352", "353", "358", "380", "420", "421", "966", "971", "972")
ENDINGS = frozenset(("com", "org", "net", "edu", "gov", "mil", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "be", "us", "ca", "au", "jp", "cn", "in", "br", "ru", "pl", "se"))
CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|kontakt|correo|courriel|write to)\W"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|login|from|client|gateway)\W"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|carte|karte|tarjeta|payment)\W"),
    "phone": re.compile(r"(?i)\b(?:tel|phone|call|fax|mobile|cell|telefon|tél|llame|sms|whatsapp)\W"),
}
OTHER = re.compile(r"(?i)\b(?:order|invoice|isbn|issn|serial|ticket|version|page|ref|id|no|sku|article|item|case|model|part)\W*$")
#: Well-grouped values of each kind.
FORM = {
    "email": re.compile(r"[\w.%+-]+(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[1-9][0-9]{0,2}(?:\.(?:0|[1-9][0-9]{0,2})){3}"),
    "card": re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}"),
    "phone": re.compile(r"(?:\+|00)?[0-9]{0,3}[ .-]?(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ .-]?[0-9]{2,5}){1,4}"),
}
CONTEXT_CHARS = 40
YES, NONE, NO = 2, 1, 0
LABELERS = 4
ACCEPT = 0.5
#: Candidates of one kind that its span model is fitted to, at most, and the places of its hashed features.
MAX_TRAINING_SPANS, PLACES = 20_000, 1 << 12
CANDIDATE = "struct<kind:int,start:int,end:int,votes:int,base:boolean,held:array<int>>"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def part_value(part: str) -> int:
    """What an address part says, however many zeros stand before; any number over 999,999 is as good as another."""
    digits = part.lstrip("0")
    return int(digits or 0) if len(digits) <= 6 else 1_000_000


def base_emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from the @ sign so that long words cost nothing."""
    last = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            last = m.end()
            yield start, last


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, validated."""
    out = [(0, a, b) for a, b in base_emails(text)] if "@" in text else []
    out += [(1, *m.span()) for m in IP.finditer(text) if max(map(part_value, m[0].split("."))) <= 255]
    for m in CARD.finditer(text):
        if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return out


def wide_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """Candidates beyond the base patterns."""
    if "(at)" in text or "[at]" in text:
        yield from ((0, *m.span()) for m in SPELLED.finditer(text))
    yield from ((1, *m.span()) for m in IP.finditer(text))
    yield from ((2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits_of(m[0])) <= 19)
    yield from ((3, *m.span()) for m in LOCAL_CALL.finditer(text))
    if "+" in text:
        yield from ((3, *m.span()) for m in PHONE.finditer(text))
        yield from ((3, *m.span()) for m in INTERNATIONAL.finditer(text))


def votes(kind: int, text: str, start: int, end: int) -> list[int]:
    """The labelers' votes on a span: form, value, gazetteer, context."""
    value, before = text[start:end], text[max(0, start - CONTEXT_CHARS) : start]
    digits = digits_of(value)
    inside = bool(start and text[start - 1].isalnum()) or text[end : end + 1].isalnum()
    form = YES if not inside and FORM[KINDS[kind]].fullmatch(value) else NO
    if kind == 0:
        ending = re.split(r"[^A-Za-z0-9]+", value.rstrip(")]"))[-1].lower()
        check = YES if re.search("[A-Za-z]", value[:64]) else NO
        known = YES if ending in ENDINGS else NONE if len(ending) == 2 else NO
    elif kind == 1:
        parts = [part_value(p) for p in value.split(".")]
        check = YES if max(parts) <= 255 else NO
        known = NO if parts[0] in (0, 255) or value == "127.0.0.1" else YES if max(parts) <= 255 else NONE
    elif kind == 2:
        check = YES if 13 <= len(digits) <= 19 and luhn(digits) else NO
        known = YES if digits.startswith(ISSUERS) else NO
    else:
        check = YES if 10 <= len(digits) <= 15 else NONE if len(digits) >= 7 else NO
        known = (YES if digits.removeprefix("00").startswith(CALLING) else NO) if value.startswith(("+", "00")) else NONE
    context = YES if CONTEXT[KINDS[kind]].search(f"{before} ") else NO if OTHER.search(before) else NONE
    return [form, check, known, context]


def pack_votes(said: list[int]) -> int:
    return ((said[0] * 3 + said[1]) * 3 + said[2]) * 3 + said[3]


def span_features(kind: int, text: str, start: int, end: int, said: list[int]) -> list[int]:
    """Places of what the span model sees: words on both sides, the value's shape, votes."""
    before, after = text[max(0, start - CONTEXT_CHARS) : start].lower(), text[end : end + CONTEXT_CHARS].lower()
    left, right = WORD.findall(before)[-3:], WORD.findall(after)[:2]
    value = text[start:end]
    shape = re.sub(r"[A-Za-z]+", "a", re.sub("[0-9]+", lambda m: f"9{min(len(m[0]), 6)}", value))[:40]
    found = [f"l{len(left) - i}={w}" for i, w in enumerate(left)] + [f"l={w}" for w in left] + [f"r={w}" for w in right]
    found += [f"s={shape}", f"n={len(digits_of(value))}", f"b={before[-1:]}", f"e={after[:1]}", *(f"v{j}={v}" for j, v in enumerate(said))]
    return sorted({xxhash.xxh32_intdigest(f) & (PLACES - 1) for f in found})


def spans_of(text: str) -> list[dict]:
    """Base spans and candidates of a text, with votes and features."""
    spans = dict.fromkeys(base_spans(text), True)
    for s in wide_spans(text):
        spans.setdefault(s, False)
    out = []
    for (kind, a, b), base in spans.items():
        said = votes(kind, text, a, b)
        out.append({"kind": kind, "start": a, "end": b, "votes": pack_votes(said), "base": base, "held": span_features(kind, text, a, b, said)})
    return out


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and its candidates, base spans among them: one row per input row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.int32()), ("base", pa.bool_()), ("held", pa.list_(pa.int32()))]))
        for batch in batches:
            # Every pattern needs an ASCII digit or an at sign, spelled or not.
            may = pc.match_substring_regex(batch.column(1), r"[0-9@]|[\[(]at[\])]").to_pylist()
            found = [spans_of(t.as_py()) if m else [] for m, t in zip(may, batch.column(1), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), or_empty(F.col("text"))).mapInArrow(add, f"doc_id long, found array<{CANDIDATE}>")


def unpack(v: int) -> list[int]:
    return [v // 27 % 3, v // 9 % 3, v // 3 % 3, v % 3]


def reliabilities(counts: dict[int, float], rounds: int = 60) -> tuple[float, np.ndarray, dict[int, float]]:
    """Expectation-maximisation for one kind: the share of true candidates, P(vote | class) of each labeler, posteriors by vote pattern."""
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns])
    said = np.array([unpack(p) for p in patterns])
    belief = np.clip((said == YES).sum(axis=1) / np.maximum(1, (said != NONE).sum(axis=1)), 0.05, 0.95)
    prior, table = 0.5, np.zeros((2, LABELERS, 3))
    for _ in range(rounds):
        prior = (n @ belief + 1) / (n.sum() + 2)
        for k, b in enumerate((1 - belief, belief)):
            for j in range(LABELERS):
                # A labeler is held to err less than half of the time, by pseudo-counts.
                c = np.bincount(said[:, j], weights=n * b, minlength=3) + (np.array([0.5, 1, 2]) if k else np.array([2, 1, 0.5]))
                table[k, j] = c / c.sum()
        log = np.log(prior / (1 - prior)) + sum(np.log(table[1, j, said[:, j]] / table[0, j, said[:, j]]) for j in range(LABELERS))
        belief = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return float(prior), table, dict(zip(patterns, map(float, belief), strict=True))


def train_classifier(held: list[list[int]], target: np.ndarray) -> np.ndarray:
    """Weights of a logistic model of hashed features (and an intercept), fitted to the posteriors."""
    lengths = np.array([len(h) for h in held])
    x = Sparse(np.repeat(np.arange(len(held)), lengths), np.concatenate([np.asarray(h, dtype=np.int64) for h in held]), np.ones((len(held), 1)), PLACES)
    return fit_linear(x, target)


def fit(found: DataFrame) -> dict[int, np.ndarray]:
    """The span model of each kind that has candidates: reliabilities from all of them, weights from a bounded sample."""
    spans = found.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*")
    counts = spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 4 * 81 rows
    models = {}
    for kind in range(len(KINDS)):
        own = {r["votes"]: float(r["n"]) for r in counts if r["kind"] == kind}
        if not own:
            continue
        _, _, posterior = reliabilities(own)
        sample = spans.filter(F.col("kind") == kind).orderBy(F.xxhash64("doc_id", "start", "end"), "doc_id", "start", "end").limit(MAX_TRAINING_SPANS).select("votes", "held").collect()
        models[kind] = train_classifier([r["held"] for r in sample], np.array([posterior[r["votes"]] for r in sample]))
    return models


def choose(spans: list[dict], models: dict[int, np.ndarray], accept: float) -> list[tuple[int, int, int]]:
    """Base spans and accepted candidates as (kind, start, end); of overlapping candidates the more probable, then longer, then first one."""
    kept = [(c["kind"], c["start"], c["end"]) for c in spans if c["base"]]
    more = []
    for c in spans:
        if not c["base"] and c["kind"] in models and unpack(c["votes"])[1] != NO:
            w = models[c["kind"]]
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[c["held"]].sum() + w[PLACES])))))
            if p >= accept:
                more.append((-p, c["start"] - c["end"], c["start"], c["kind"], c["end"]))
    taken: list[tuple[int, int]] = []  # what the kept spans cover: disjoint, in order
    for a, b in sorted((a, b) for _, a, b in kept):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    for _, _, a, kind, b in sorted(more):
        at = bisect_left(taken, (a, b))
        if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
            taken.insert(at, (a, b))
            kept.append((kind, a, b))
    return sorted(kept, key=lambda s: (s[1], s[0], s[2]))


def detect(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, base and all spans (kind, start, end; code points, end exclusive): one row per input row.

    A null text counts as empty. Added spans of one document don't overlap each other: the more
    probable one stays, then the longer, then the first.
    """
    found = materialize(candidates(docs), "candidates")
    models = fit(found)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            rows = [r or [] for r in batch.column(1).to_pylist()]
            base = [told(choose([c for c in r if c["base"]], {}, accept)) for r in rows]
            yield pa.record_batch([batch.column(0), pa.array(base, span), pa.array([told(choose(r, models, accept)) for r in rows], span)], ["doc_id", "base", "spans"])

    return found.mapInArrow(add, "doc_id long, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame) -> DataFrame:
    """The same columns and rows, with each detected span of a text replaced by its kind in brackets.

    Rows that repeat both doc_id and text have the same spans. A null doc_id or text stays as it is;
    an empty table gives none.
    """
    # Added spans depend on the text and the models only, so they are found again by value, not joined.
    found = materialize(candidates(docs), "candidates")
    models = fit(found)
    discard(found)

    @F.pandas_udf("string")
    def mask(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([redact_text(t, models) if isinstance(t, str) else None for t in texts])

    return docs.withColumn("text", F.when(F.col("text").rlike(r"[0-9@]|[\[(]at[\])]"), mask("text")).otherwise(F.col("text")))


def redact_text(text: str, models: dict[int, np.ndarray], accept: float = ACCEPT) -> str:
    out, at = [], 0
    for kind, a, b in sorted(choose(spans_of(text), models, accept), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = detect(read_table(spark, sf_dir, "documents"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = lambda spans: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)
        for batch in batches:
            base, every = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            counts = [pa.array([sum(s["kind"] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
            yield pa.record_batch([batch.column(0), *counts, sha, pa.array([joined(b) for b in every], pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return spans.mapInArrow(digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
