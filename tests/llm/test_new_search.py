"""Byte-level BPE against the library, bit-sliced search and ball-tree clustering against loops and SQL."""

import base64
import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.llm import bit_sliced_search, byte_bpe, centroid_clustering, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    with open(byte_bpe.default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(texts, library):
    own = byte_bpe.codec(byte_bpe.default_vocabulary())
    got = [np.frombuffer(x, "<u4") for x in own.encode(texts)]
    assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in texts]
    assert own.decode(got) == [t.encode() for t in texts]


def test_bpe_of_every_document(spark, library):
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_byte_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = library.encode_ordinary(text or "")
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t\x1c\xa0ab'sstAéß中文字1²9.-_!😀"), max_size=60), max_size=5))
def test_bpe_of_random_texts(library, texts):
    same(texts, library)


def test_bpe_of_long_words(library):
    rng = np.random.default_rng(1)
    letters = lambda a, b, n: bytes(rng.integers(a, b, n).astype(np.uint8)).decode("latin-1")
    same(["", " ", "x" * 50_000, "ab" * 30_000, "aaab" * 10_000, letters(97, 123, 3_000), letters(192, 250, 20_000), letters(65, 91, 2_000), "<|endoftext|>", " " * 5_000 + "a"], library)
    own = byte_bpe.codec(byte_bpe.default_vocabulary())
    ids = np.frombuffer(own.encode([" " * 2_000_000])[0], "<u4")
    assert own.decode([ids]) == [b" " * 2_000_000]


def test_bpe_of_nulls_and_repeats(spark):
    d = spark.createDataFrame([(1, None), (None, "some words"), (1, "some words"), (1, "")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    e = byte_bpe.encode(d)
    assert sorted((r["doc_id"] is None, len(r["ids"])) for r in e.collect()) == [(False, 0), (False, 0), (False, 2), (True, 2)]
    assert sorted(bytes(r["bytes"]) for r in byte_bpe.decode(e).collect()) == [b"", b"", b"some words", b"some words"]
    assert byte_bpe.encode(d.limit(0)).count() == 0 and byte_bpe.round_trip(d.limit(0)).count() == 0
    with pytest.raises(Exception, match="vocabulary doesn't hold"):
        byte_bpe.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>")).collect()


@pytest.mark.parametrize("name", ["op12_bit_sliced_search", "op13_ball_tree_clusters"])
def test_new_operators_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in queries.QUERIES[name](spark, SF).select(columns).collect()) == sorted(want.fetchall())


def loop_search(docs, items, k):
    terms = {i: bit_sliced_search.terms_of(t or "") for i, (_, t) in enumerate(docs)}
    n, total = sum(bool(t) for t in terms.values()), sum(map(len, terms.values()))
    df = Counter(t for ts in terms.values() for t in set(ts))
    asked = {}
    for item, text in items:
        asked.setdefault(item, []).extend(bit_sliced_search.terms_of(text or ""))
    out = []
    for item, words in asked.items():
        scored = []
        for i, (doc_id, _) in enumerate(docs):
            tf = Counter(terms[i])
            m = 25 + 75 * len(terms[i]) * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in words if tf[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k])]
    return out


def test_bit_sliced_search_against_a_loop(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)] + ["É", "x" * 300, "A1"]
    docs = [(int(rng.integers(0, 90)), " ".join(rng.choice(words, rng.integers(1, 30)))) for _ in range(150)]
    docs += [(200, None), (201, ""), (202, "--"), (None, "w1 w2 É"), (203, "w1 " * 5000), (204, "w3"), (205, "W3"), (206, "w3")]
    items = [(1, "w1 W2 w2 é É"), (2, " ".join(["w3"] * 1000 + ["w4"])), (3, None), (4, "nowhere"), (5, "w5"), (5, "w6 w5"), (None, "w7 a1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit(1)).repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(loop_search(docs, items, 4), key=key)
    whole = bit_sliced_search.QUERY_TERMS
    for shard, block in ((16_384, whole), (7, 4)):
        bit_sliced_search.QUERY_TERMS = block
        try:
            got = sorted((tuple(r) for r in bit_sliced_search.search(d, q, k=4, shard_docs=shard).collect()), key=key)
        finally:
            bit_sliced_search.QUERY_TERMS = whole
        assert got == want
    assert bit_sliced_search.search(d.limit(0), q).count() == 0 and bit_sliced_search.search(d, q.limit(0)).count() == 0


def lloyd(points, first, rounds):
    centroids = [list(points[i]) for i in first]
    near = lambda p: min(range(len(centroids)), key=lambda c: (sum((x - y) ** 2 for x, y in zip(p, centroids[c])), c))
    for _ in range(rounds):
        own = [near(p) for p in points]
        for c in range(len(centroids)):
            held = [p for p, o in zip(points, own) if o == c]
            if held:
                centroids[c] = [sum(x) // len(held) for x in zip(*held)]
    return [(near(p), sum((x - y) ** 2 for x, y in zip(p, centroids[near(p)]))) for p in points]


@pytest.mark.parametrize("scale", [1, 3e4, 1e9, 1e18])
def test_clusters_against_a_loop(spark, scale):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(400, 3)) * scale, np.tile(rng.normal(size=3), (300, 1)), np.zeros((200, 3))]) + np.repeat(rng.normal(size=(9, 3)) * 5 * scale, 100, axis=0)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 2.0]), (903, [1.0, float("nan"), 2.0]), (904, [float("inf"), 0.0, 0.0])]
    d = spark.createDataFrame(rows + bad, "vec_id long, vector array<double>").withColumn("cluster", F.lit("clash")).repartition(3)
    got = {r["vec_id"]: r for r in centroid_clustering.cluster(d, k=6, dims=3).collect()}
    first = sorted(range(900), key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:6]
    want = lloyd([[math.floor(64 * c) for c in v] for _, v in rows], first, 3)
    assert set(got) == set(range(900))
    for i, (c, far) in enumerate(want):
        assert got[i]["cluster"] == c and got[i]["distance"] == (far if far < 1 << 63 else None)


def test_clusters_of_few_and_repeated_vectors(spark):
    d = spark.createDataFrame([(1, [0.5, 0.5]), (1, [0.5, 0.5]), (None, [9.0, 9.0]), (2, [9.0, 9.5])], "vec_id long, vector array<double>")
    got = centroid_clustering.cluster(d, k=16, dims=2).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "1", "2", "None"] and len({r["inertia"] for r in got}) == 1
    assert centroid_clustering.cluster(d.limit(0), dims=2).count() == 0


def test_whole_balls_are_settled(spark):
    """On clustered vectors most rounds' vectors are never looked at one by one."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (8, 16)).astype(float)
    points = np.concatenate([c + rng.integers(-30, 30, (500, 16)) for c in centres])
    tree, _ = centroid_clustering.Tree.build(points)
    seen = [0, 0]
    tree.settle(centres.astype(np.int64), lambda n, c: seen.__setitem__(0, seen[0] + int(tree.stop[n] - tree.begin[n])), lambda a, b, _: seen.__setitem__(1, seen[1] + b - a))
    assert sum(seen) == 4000 and seen[0] > 3900
