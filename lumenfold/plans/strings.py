"""Queries of string features: nucleotides and proteins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import protein as P
from lumenfold.functions import residues as R
from lumenfold.functions import sequence as S
from lumenfold.plans.analytics import rounded
from lumenfold.plans.carriers import AA, SEQ, nucleotides, proteins, table
from lumenfold.plans.registry import query


def _count(s: str, m: str) -> str:
    return f"((length({s}) - length(replace({s}, '{m}', ''))) / {len(m)})"


_GRAMS = "CASE WHEN length(seq) >= {0} THEN list_transform(range(1, length(seq) - {0} + 2), lambda i: substr(seq, i, {0})) ELSE [] END"
_G, _C, _A, _T = (_count("seq", b) for b in "GCAT")


@query("clean_sequences", "SELECT doc_id, length(regexp_replace(replace(upper(regexp_replace(text, '[^a-zA-Z]', '', 'g')), 'U', 'T'), '[^ACGT]', 'N', 'g')) AS n, md5(regexp_replace(replace(upper(regexp_replace(text, '[^a-zA-Z]', '', 'g')), 'U', 'T'), '[^ACGT]', 'N', 'g')) AS digest FROM documents")
def clean_sequences(spark, sf):
    s = S.clean(F.regexp_replace("text", "[^a-zA-Z]", ""))
    return table(spark, sf, "documents").select("doc_id", F.length(s).cast("long").alias("n"), F.md5(s).alias("digest"))


@query("detect_rna", "WITH f AS (SELECT upper(text) AS s FROM documents ORDER BY doc_id LIMIT 100) SELECT sum(length(s) - length(replace(s, 'U', ''))) > sum(length(s) - length(replace(s, 'T', ''))) AS is_rna FROM f")
def detect_rna(spark, sf):
    return S.is_rna(table(spark, sf, "documents"), "text", "doc_id")


@query("gc_features", f"""WITH {SEQ}, w AS (SELECT *, length(seq) AS n, least(100, length(seq)) AS w FROM seqs),
v AS (SELECT *, CASE WHEN n > 0 THEN list_transform(range(1, n - w + 2), lambda i: length(regexp_replace(substr(seq, i, w), '[AT]', '', 'g')) / w) ELSE [] END AS s FROM w)
SELECT doc_id, round(CASE WHEN n > 0 THEN ({_G} + {_C}) / n ELSE 0 END, 6) AS gc, round(CASE WHEN {_G} + {_C} > 0 THEN ({_G} - {_C}) / ({_G} + {_C}) ELSE 0 END, 6) AS skew,
  round(CASE WHEN n > 0 THEN ({_A} + {_T}) / n ELSE 0 END, 6) AS at, round(CASE WHEN n > 0 THEN ({_A} + {_G}) / n ELSE 0 END, 6) AS purine,
  round(CASE WHEN n > 0 THEN list_var_pop(s) ELSE 0 END, 12) AS gc_variance, round(CASE WHEN n > 0 THEN list_max(s) ELSE 0 END, 6) AS gc_max, round(CASE WHEN n > 0 THEN list_min(s) ELSE 0 END, 6) AS gc_min FROM v""")
def gc_features(spark, sf):
    return rounded(S.gc_features(nucleotides(spark, sf), "seq").drop("seq"), 6, gc_variance=12)


def _entropy(parts: list[str], total: str) -> str:
    return "-(" + " + ".join(f"CASE WHEN {p} > 0 THEN {p} / {total} * log2({p} / {total}) ELSE 0 END" for p in parts) + ")"


_PAIRS = [f"len(list_filter(d, lambda x: x = '{a}{b}'))" for a in "ACGT" for b in "ACGT"]
_REPEATED = " + ".join(f"n - length(replace(seq, '{p * 3}', ''))" for p in S.REPEATS)


@query("complexity_features", f"""WITH {SEQ}, w AS (SELECT *, length(seq) AS n, {_GRAMS.format(2)} AS d FROM seqs)
SELECT doc_id, round(CASE WHEN n < 2 THEN 0 ELSE {_entropy([_A, _C, _G, _T], 'n')} END, 6) AS base_entropy, round(CASE WHEN n < 2 THEN 0 ELSE {_entropy(_PAIRS, '(n - 1)')} END, 6) AS pair_entropy,
  round(CASE WHEN n < 2 THEN 0 WHEN n = 2 THEN 1 ELSE len(list_distinct({_GRAMS.format(3)})) / least(64, n - 2) END, 6) AS linguistic,
  round(CASE WHEN n < 2 THEN 0 ELSE least(1, ({_REPEATED}) / n) END, 6) AS repeat_fraction,
  round(CASE WHEN n < 2 THEN 0 ELSE list_max(list_transform(regexp_extract_all(seq, '(A+|C+|G+|T+)'), lambda r: length(r))) END::DOUBLE, 6) AS longest_run,
  round(CASE WHEN n < 2 THEN 0 WHEN n < 4 THEN 1 ELSE len(list_distinct({_GRAMS.format(4)})) / (n - 3) END, 6) AS distinct_4,
  round(CASE WHEN n < 2 OR {_C} * {_G} = 0 THEN 0 ELSE {_count('seq', 'CG')} / ({_C} * {_G} / n) END, 6) AS cpg,
  round(CASE WHEN n < 6 THEN 0 ELSE len(list_distinct({_GRAMS.format(6)})) / (n - 5) END, 6) AS distinct_6 FROM w""")
def complexity_features(spark, sf):
    return rounded(S.complexity_features(nucleotides(spark, sf), "seq").drop("seq"))


@query("positional_features", f"""WITH {SEQ}, b AS (SELECT doc_id, i, substr(seq, floor(length(seq) * i / 10)::INT + 1, CASE WHEN i = 9 THEN length(seq) ELSE floor(length(seq) * (i + 1) / 10)::INT END - floor(length(seq) * i / 10)::INT) AS p FROM seqs, range(10) t(i))
SELECT doc_id, i AS bin, round(CASE WHEN p = '' THEN 0 ELSE {_count('p', 'A')} / length(p) END, 6) AS a, round(CASE WHEN p = '' THEN 0 ELSE {_count('p', 'C')} / length(p) END, 6) AS c, round(CASE WHEN p = '' THEN 0 ELSE {_count('p', 'G')} / length(p) END, 6) AS g, round(CASE WHEN p = '' THEN 0 ELSE {_count('p', 'T')} / length(p) END, 6) AS t FROM b""")
def positional_features(spark, sf):
    d = nucleotides(spark, sf).withColumn("f", S.positional_features(F.col("seq"))).select("doc_id", "f", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bin"))
    return rounded(d.select("doc_id", F.col("bin").cast("long").alias("bin"), *(F.element_at("f", F.col("bin") * 4 + k + 1).alias(b) for k, b in enumerate("acgt"))))


_MOTIF = ", ".join(f"len(regexp_extract_all(seq, '{''.join(S.AMBIGUOUS.get(x, x) for x in m)}'))::DOUBLE" if m == "GTRAGT" else _count("seq", m) for m in S.MOTIFS)


@query("motif_counts", f"WITH {SEQ}, m AS (SELECT doc_id, unnest([{_MOTIF}]) AS n, generate_subscripts([{_MOTIF}], 1) - 1 AS motif FROM seqs) SELECT doc_id, motif, n FROM m WHERE n > 0")
def motif_counts(spark, sf):
    d = nucleotides(spark, sf).select("doc_id", F.posexplode(S.motif_counts(F.col("seq"))).alias("motif", "n"))
    return d.filter("n > 0").select("doc_id", F.col("motif").cast("long").alias("motif"), "n")


@query("one_hot", f"WITH {SEQ}, o AS (SELECT doc_id, i, substr(seq, i, 1) AS b FROM seqs, range(1, 33) t(i)) SELECT doc_id, count(*) FILTER (WHERE b = 'A') AS a, count(*) FILTER (WHERE b = 'C') AS c, count(*) FILTER (WHERE b = 'G') AS g, count(*) FILTER (WHERE b = 'T') AS t, sum(CASE WHEN b <> '' THEN i * (position(b IN 'ACGT')) ELSE 0 END)::BIGINT AS weighted FROM o GROUP BY 1")
def one_hot(spark, sf):
    d = nucleotides(spark, sf).select("doc_id", F.posexplode(S.one_hot(F.col("seq"), 32)).alias("k", "v"))
    place, base = F.floor(F.col("k") / 4) + 1, F.col("k") % 4
    return d.groupBy("doc_id").agg(*(F.sum(F.when(base == j, F.col("v")).otherwise(0)).alias(b) for j, b in enumerate("acgt")), F.sum(F.col("v") * place * (base + 1)).cast("long").alias("weighted"))


@query("kmer_features", f"""WITH {SEQ}, k AS (SELECT doc_id, unnest(list_concat({_GRAMS.format(1)}, {_GRAMS.format(2)}, {_GRAMS.format(3)})) AS kmer FROM seqs), c AS (SELECT doc_id, kmer, count(*) AS n FROM k GROUP BY ALL)
SELECT doc_id, kmer, n, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS value FROM c""")
def kmer_features(spark, sf):
    return rounded(S.kmer_counts(nucleotides(spark, sf), "doc_id", "seq", 3))


def _property(s: str, i: int) -> str:
    return "(" + " + ".join(f"{_count(s, a)} * {v[i]}" for a, v in R.RESIDUES.items() if v[i]) + ")"


def _motifs(s: str, ms) -> str:
    return "(" + " + ".join(_count(s, m) for m in ms) + ")"


_TABLE = "MAP {" + ", ".join(f"'{a}': {v[0]}::DOUBLE" for a, v in R.RESIDUES.items()) + "}"
_SQUARES = "(" + " + ".join(f"{_count('seq', a)} * {v[0] ** 2!r}" for a, v in R.RESIDUES.items()) + ")"
_STICKY = _motifs("seq", [a for a, v in R.RESIDUES.items() if v[0] > 1.5])


@query("developability", f"""WITH {AA}, l AS (SELECT doc_id, unnest(string_split(seq, '')) AS a, generate_subscripts(string_split(seq, ''), 1) AS i FROM aas WHERE seq <> ''),
  m AS (SELECT doc_id, i, sum(({_TABLE})[a]) OVER (PARTITION BY doc_id ORDER BY i ROWS 6 PRECEDING) / 7 AS hy FROM l), t AS (SELECT doc_id, max(hy) FILTER (WHERE i >= 7) AS stretch FROM m GROUP BY 1),
  h AS (SELECT doc_id, seq, length(seq) AS n, stretch FROM aas LEFT JOIN t USING (doc_id))
SELECT doc_id, round({_property('seq', 1)}, 5) AS charge, round(CASE WHEN n > 0 THEN {_property('seq', 0)} / n ELSE 0 END, 5) AS hydrophobicity, round(CASE WHEN n > 0 THEN sqrt(greatest({_SQUARES} / n - ({_property('seq', 0)} / n) ** 2, 0)) ELSE 0 END, 5) AS hydrophobicity_std,
  round(CASE WHEN n >= 7 THEN stretch WHEN n > 0 THEN {_property('seq', 0)} / n ELSE 0 END, 5) AS hydrophobic_stretch,
  round(CASE WHEN n > 0 THEN {_STICKY} / n ELSE 0 END, 5) AS hydrophobic_fraction, round(({_property('seq', 2)} - CASE WHEN n > 1 THEN (n - 1) * {R.WATER} ELSE 0 END) / 1000, 7) AS weight_kda,
  {_motifs('seq', R.DEAMIDATION)} AS deamidation, {_motifs('seq', R.ISOMERIZATION)} AS isomerization, {_motifs('seq', R.OXIDATION)} AS oxidation, len(regexp_extract_all(seq, '{R.SEQUON}'))::DOUBLE AS sequons, {_count('seq', 'C')} % 2 AS odd_cysteines FROM h""")
def developability(spark, sf):
    d = proteins(spark, sf)
    keep = ("charge", "hydrophobicity", "hydrophobicity_std", "hydrophobic_stretch", "hydrophobic_fraction", "weight_kda", "deamidation", "isomerization", "oxidation", "sequons", "odd_cysteines")
    return rounded(P.developability(d, "seq").select("doc_id", *keep), 5, weight_kda=7)


_NET = f"1 / (1 + pow(10.0, {{0}} - {R.PKA_N_END})) - 1 / (1 + pow(10.0, {R.PKA_C_END} - {{0}}))" + "".join(f" + {a.lower()} / (1 + pow(10.0, {{0}} - {p}))" for a, p in R.PKA_POSITIVE.items()) + "".join(f" - {a.lower()} / (1 + pow(10.0, {p} - {{0}}))" for a, p in R.PKA_NEGATIVE.items())


@query("isoelectric_point", f"""WITH RECURSIVE {AA}, c AS (SELECT doc_id, length(seq) AS n, {', '.join(f"{_count('seq', a)} AS {a.lower()}" for a in [*R.PKA_POSITIVE, *R.PKA_NEGATIVE])} FROM aas),
b AS (SELECT *, 0 AS step, 0.0::DOUBLE AS lo, 14.0::DOUBLE AS hi FROM c UNION ALL SELECT * REPLACE (step + 1 AS step, CASE WHEN {_NET.format('((lo + hi) / 2)')} > 0 THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN {_NET.format('((lo + hi) / 2)')} > 0 THEN hi ELSE (lo + hi) / 2 END AS hi) FROM b WHERE step < 60)
SELECT doc_id, round(CASE WHEN n > 0 THEN (lo + hi) / 2 ELSE 7 END, 6) AS pi FROM b WHERE step = 60""")
def isoelectric_point(spark, sf):
    return rounded(P.isoelectric_point(proteins(spark, sf), "seq", "pi", 60).drop("seq"))


_CONSENSUS = P.consensus(R.HEAVY_GERMLINES)
_LIBRARY = ", ".join(f"('{g}')" for g in R.HEAVY_GERMLINES.values())


@query("humanness", f"""WITH {AA}, s AS (SELECT doc_id, seq FROM aas WHERE seq <> ''), p AS (SELECT doc_id, seq, g, least(length(seq), length(g)) AS n FROM s, (VALUES {_LIBRARY}) l(g)),
m AS (SELECT *, list_filter(range(0, n), lambda i: substr(seq, i + 1, 1) = substr(g, i + 1, 1)) AS hit, list_filter(range(0, n), lambda i: NOT (i BETWEEN 26 AND 37 OR i BETWEEN 55 AND 64 OR i BETWEEN 104 AND 116)) AS fr FROM p),
f AS (SELECT *, len(hit) / n AS identity, CASE WHEN len(fr) > 0 THEN len(list_intersect(hit, fr)) / len(fr) ELSE 0 END AS framework FROM m),
a AS (SELECT doc_id, any_value(seq) AS seq, list_sort(list(identity), 'DESC') AS ids, stddev_pop(identity) AS sd, avg(identity) AS mean, max(framework) AS best_framework FROM f GROUP BY 1)
SELECT doc_id, round(ids[1], 6) AS best, round(list_avg(ids[1:3]), 6) AS top3, round(list_avg(ids[1:5]), 6) AS top5, round(sd, 6) AS identity_std, round(best_framework, 6) AS best_framework,
  len(list_filter(range(1, least(length(seq), {len(_CONSENSUS)}) + 1), lambda i: substr(seq, i, 1) = substr('{_CONSENSUS}', i, 1)))::DOUBLE AS consensus_matches, round(CASE WHEN sd > 1e-10 THEN (ids[1] - mean) / sd ELSE 0 END, 5) AS z FROM a""")
def humanness(spark, sf):
    d = P.humanness(proteins(spark, sf), "doc_id", "seq")
    return rounded(d.withColumn("z", F.round("z", 5)))


@query("numbered_regions", f"WITH {AA} SELECT doc_id, substr(seq, 27, 12) AS cdr1, substr(seq, 56, 10) AS cdr2, substr(seq, 105, 13) AS cdr3, CASE WHEN length(seq) >= 40 THEN substr(seq, 40, 1) ELSE '-' END || CASE WHEN length(seq) >= 500 THEN substr(seq, 500, 1) ELSE '-' END AS picked FROM aas")
def numbered_regions(spark, sf):
    letters = F.filter(F.split("seq", ""), lambda a: a != "")
    numbered = F.transform(letters, lambda a, i: F.struct((i + 1).alias("position"), a.alias("letter")))
    d = proteins(spark, sf).withColumn("numbered", numbered)
    return d.select("doc_id", *(P.region(F.col("numbered"), a, b).alias(f"cdr{i + 1}") for i, (a, b) in enumerate(((27, 38), (56, 65), (105, 117)))), F.array_join(P.at_positions(F.col("numbered"), [40, 500]), "").alias("picked"))
