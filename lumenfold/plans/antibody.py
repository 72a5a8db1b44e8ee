"""Queries of antibody features; the carrier numbers residues by their place."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import antibody as B
from lumenfold.plans.analytics import rounded
from lumenfold.plans.carriers import AA, proteins
from lumenfold.plans.registry import query

_LETTERS = f"{AA}, residues AS (SELECT doc_id, unnest(string_split(substr(seq, 1, 128), '')) AS a, generate_subscripts(string_split(substr(seq, 1, 128), ''), 1) AS p FROM aas WHERE seq <> '')"
_REGION = "CASE WHEN p BETWEEN 27 AND 38 THEN 'cdr1' WHEN p BETWEEN 56 AND 65 THEN 'cdr2' WHEN p BETWEEN 105 AND 117 THEN 'cdr3' WHEN p <= 104 THEN 'framework' END"


def _numbered(spark, sf):
    """doc_id, numbered: a numbering has 128 positions, so a sequence's residues beyond have none."""
    letters = F.filter(F.split(F.substring("seq", 1, 128), ""), lambda a: a != "")
    return proteins(spark, sf).select("doc_id", F.transform(letters, lambda a, i: F.struct((i + 1).alias("position"), a.alias("letter"))).alias("numbered"))


@query("antibody_regions", f"""WITH {_LETTERS}, r AS (SELECT doc_id, {_REGION} AS region, a FROM residues), n AS (SELECT doc_id, region, count(*) AS n FROM r WHERE region IS NOT NULL GROUP BY ALL), c AS (SELECT doc_id, region, a, count(*) AS c FROM r WHERE region IS NOT NULL GROUP BY ALL)
SELECT doc_id, region, a AS letter, round(c / n, 6) AS mean, CASE WHEN region = 'framework' THEN round(sqrt(c / n * (1 - c / n)), 6) ELSE 1 END AS other FROM c JOIN n USING (doc_id, region)""")
def antibody_regions(spark, sf):
    pooled = B.pooled_regions(F.col("numbered"))
    d = _numbered(spark, sf).select("doc_id", *(v.alias(k) for k, v in pooled.items()))
    of = lambda region, other: F.transform(F.arrays_zip(f"{region}_mean", f"{region}_{other}"), lambda v, i: F.struct(F.lit(region).alias("region"), F.substr(F.lit(B.ALPHABET), i + 1, F.lit(1)).alias("letter"), v[f"{region}_mean"].alias("mean"), v[f"{region}_{other}"].alias("other")))
    parts = F.concat(*(of(r, "max") for r in B.CDRS), of("framework", "std"))
    return rounded(d.select("doc_id", F.explode(parts).alias("v")).select("doc_id", "v.*").filter("mean > 0"))


@query("antibody_positions", f"WITH {_LETTERS}, "
       f"places AS (SELECT unnest({list(B.KEY_POSITIONS['heavy'])}) AS p, unnest(range(0, {len(B.KEY_POSITIONS['heavy'])})) AS k) SELECT doc_id, (places.k * 20 + position(a IN '{B.ALPHABET}') - 1)::BIGINT AS place FROM residues JOIN places USING (p)")
def antibody_positions(spark, sf):
    d = _numbered(spark, sf).select("doc_id", F.posexplode(B.position_features(F.col("numbered"))).alias("place", "v")).filter("v = 1")
    return d.select("doc_id", F.col("place").cast("long").alias("place"))


@query("antibody_paratope", f"WITH {_LETTERS} SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE {_REGION} LIKE 'cdr%') AS binding, coalesce(sum(p) FILTER (WHERE {_REGION} LIKE 'cdr%'), 0)::BIGINT AS places FROM residues GROUP BY 1")
def antibody_paratope(spark, sf):
    d = _numbered(spark, sf).filter(F.size("numbered") > 0).withColumn("b", B.paratope(F.col("numbered")))
    total = lambda f: F.aggregate(F.transform("b", f), F.lit(0).cast("long"), lambda s, v: s + v)
    return d.select("doc_id", F.size("b").cast("long").alias("n"), total(lambda v, i: v.cast("long")).alias("binding"), total(lambda v, i: F.when(v, i + 1).otherwise(0).cast("long")).alias("places"))


@query("antibody_features", f"""WITH {_LETTERS}, c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE {_REGION} LIKE 'cdr%') AS binding, count(*) FILTER (WHERE p IN {B.KEY_POSITIONS['heavy']}) AS held, count(DISTINCT a) AS kinds FROM residues GROUP BY 1)
SELECT doc_id, 160::BIGINT AS regions, {20 * len(B.KEY_POSITIONS['heavy'])}::BIGINT AS positions, coalesce(held, 0)::DOUBLE AS positions_held, coalesce(n, 0)::BIGINT AS paratope, coalesce(binding, 0)::DOUBLE AS binding, round(CASE WHEN n > 0 THEN 1 ELSE 0 END, 6)::DOUBLE AS whole FROM aas LEFT JOIN c USING (doc_id)""")
def antibody_features(spark, sf):
    f = B.antibody_features(_numbered(spark, sf), "doc_id", "numbered", methods=("regions", "positions", "paratope", "whole"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    size = lambda c: F.size(c).cast("long")
    return f.select("doc_id", size("regions").alias("regions"), size("positions").alias("positions"), total("positions").alias("positions_held"), size("paratope").alias("paratope"), total("paratope").alias("binding"), F.round(total("whole"), 6).alias("whole"))
