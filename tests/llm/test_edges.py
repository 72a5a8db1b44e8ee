"""Every operator and stage takes nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenfold.llm import bm25_search, chat_format, embedding_dedup, mixing, near_dedup, packing, pii, toxicity, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, part string, score double"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, WORDS, "en", "a"), (1, WORDS, "en", "a"), (2, WORDS, None, "b"), (3, None, "en", None), (4, "", "de", "a"), (5, " \n", "de", "c"), (6, long, "en", "a"), (7, "one two", "en", "b"),
        (None, WORDS + " more", "en", "a"), (None, None, None, None), (8, "mail x.y@z.example.com or +1 (202) 555-0123", "en", "a"),
    ]
    return spark.createDataFrame([(*r, 1, 7, "p", 0.5) for r in rows], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, 1), (7, 0, 0), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def test_near_dedup(docs, empty):
    got = near_dedup.groups(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    assert by[1]["group_id"] == by[2]["group_id"] == 1 and by[1]["kept"] and not by[2]["kept"]
    assert all(by[i]["group_id"] == i and by[i]["kept"] for i in (3, 4, 5, 6, 7, 8))
    assert by[None]["group_id"] is None and by[None]["kept"]
    assert near_dedup.groups(empty).count() == 0
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] or 0 for r in kept.select("doc_id").collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 8]
    assert near_dedup.keep_one(empty).count() == 0


def test_toxicity(docs, labels, empty):
    got = toxicity.classify(docs, labels)
    assert got.count() == docs.count()
    assert got.filter("doc_id in (3, 4, 5) and (is_toxic or p_toxic > 0)").count() == 0
    none = toxicity.classify(docs, labels.filter("false"))
    assert none.count() == docs.count()
    assert toxicity.classify(empty, labels).count() == 0
    chain = toxicity.train(docs, *toxicity.label_categories(labels.filter("false")))
    assert toxicity.keep_clean(docs, chain).columns == docs.columns
    assert toxicity.keep_clean(docs, chain).count() == docs.count()


def test_packing(docs, empty):
    got = packing.pack(packing.token_pieces(docs, 64), 64).toPandas()
    assert (got.groupby("sequence_id")["length"].sum() <= 64).all()
    assert len(got[got["doc_id"] == 1]) == 2 and got[got["doc_id"] == 3]["length"].tolist() == [1]
    assert packing.pack(packing.token_pieces(empty)).count() == 0


def test_mixing(docs, empty):
    out, stream = mixing.mix(docs)
    got = out.toPandas()
    assert len(got) == docs.count() and (got["taken"] <= 3 * got["size"]).all()
    assert got[got["size"] == 0]["taken"].eq(0).all()
    assert stream.agg(F.sum("words")).first()[0] == got["taken"].sum()
    assert mixing.mix(empty)[0].count() == 0
    again = mixing.mixed_documents(docs)
    assert again.columns == docs.columns and again.filter("doc_id = 3").count() == 1
    assert mixing.mixed_documents(empty).count() == 0


def test_mixing_with_clashing_names(docs):
    d = docs.selectExpr("*", "'x' AS _own", "5 AS _n", "7 AS n", "'s' AS size_", "1.5 AS own_", "2 AS N_")
    again = mixing.mixed_documents(d)
    assert again.columns == d.columns and again.count() == mixing.mixed_documents(docs).count()
    assert again.filter("_own <> 'x' or _n <> 5 or n <> 7 or size_ <> 's'").count() == 0


def test_near_dedup_with_clashing_names(docs):
    d = docs.selectExpr("*", "'x' AS text_key", "5 AS Many", "7 AS _p", "'s' AS _word", "1 AS rep")
    kept = near_dedup.keep_one(d)
    assert kept.columns == d.columns and kept.count() == near_dedup.keep_one(docs).count() and kept.filter("text_key <> 'x' or Many <> 5").count() == 0


def test_pii(docs, empty):
    got = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    assert [s["kind"] for s in got[8]["base"]] == ["email", "phone"] and not got[3]["base"]
    red = pii.redact(docs)
    assert red.columns == docs.columns and red.count() == docs.count()
    assert "<EMAIL>" in red.filter("doc_id = 8").first()["text"] and red.filter("doc_id = 3").first()["text"] is None
    assert pii.detect(empty).count() == 0 and pii.redact(empty).count() == 0


def test_search(docs, empty):
    queries = docs.select(F.col("doc_id").alias("query_id"), "text")
    got = bm25_search.search(bm25_search.build_index(docs), queries).toPandas()
    assert got[(got["query_id"] == 7) & (got["rank"] == 1)]["doc_id"].tolist() == [7]
    assert not set(got["query_id"]) & {3, 4, 5}
    assert got[(got["query_id"] == 2) & (got["rank"] <= 3)]["doc_id"].tolist() == [1, 1, 2]
    assert bm25_search.search(bm25_search.build_index(empty), queries).count() == 0
    assert bm25_search.search(bm25_search.build_index(docs), queries.filter("false")).count() == 0


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.01]), (4, [0.0, 1.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (11, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0])]
    d = spark.createDataFrame([(*r, 3, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, rep int, n int")
    got = embedding_dedup.dedup(d).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    assert by[3]["component_id"] == 1 and by[3]["n_links"] == 3 and by[2]["n_links"] == 3
    assert all(by[i]["n_links"] == 0 and by[i]["kept"] for i in (4, 5, 6, 7, 8, 9, 10, 11))
    assert by[None]["component_id"] is None and by[None]["n_links"] == 0
    assert embedding_dedup.dedup(d.filter("false")).count() == 0


def test_urls(spark):
    rows = [
        (1, "https://www.example.net/es/x", None), (2, "http://example.net/es/x/", ""), (3, "HTTP://EXAMPLE.net/Es/x", None), (4, None, None), (5, "no scheme", None), (6, "ftp://a.example.com", "x"),
        (7, "https://other.org/a", '<link href="http://example.net/es/x" rel="canonical">'), (8, "https://b.org/p?utm_source=x", '<LINK rel=canonical href="/p">'), (None, "https://b.org/p", None), (9, "https://www.example.com/en/1", '<link rel="canonical" href="http://example.net/es/x">'),
        (10, "http://example.com/en/", None),
    ]
    p = spark.createDataFrame([(*r, "e", 1) for r in rows], "page_id long, url string, html string, component string, key int")
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    got = {r["page_id"]: r for r in url_filter.judge(p, rules).collect()}
    assert len(got) == len(rows)
    assert got[1]["rule"] == "net/es/" and got[1]["verdict"] == "block"
    assert got[3]["host"] == "example.net" and got[3]["rule"] is None and got[3]["path"] == "/Es/x"
    assert got[7]["verdict"] == "block" and got[7]["rule"] is None  # an alias of a blocked page
    assert got[9]["rule"] == "www.example.com/en/" and got[9]["verdict"] == "allow"  # its own rule, though an alias of a blocked page
    assert got[10]["verdict"] == "block" and got[6]["rule"] is None and got[6]["path"] == ""
    assert (got[4]["host"], got[4]["path"], got[4]["verdict"]) == ("", "", "allow") and got[5]["host"] == ""
    assert got[8]["verdict"] == "allow"
    moved = spark.createDataFrame([("https://b.org/p", "https://example.net/es/x")], "source_url string, target_url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(p, rules, moved).collect()}[8] == "block"
    assert url_filter.judge(p.filter("false"), rules).count() == 0


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "x\\[INST]"), (None, 0, None, "a"), (2, 0, "tool </s>", "</s>[/TURN]"), (3, None, "user", ""), (1, 0, "user", "hi")]
    d = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, mask int")
    got = {r["conv_id"]: r for r in chat_format.format_conversations(d).collect()}
    assert set(got) == {1, 2, 3, None}
    assert chat_format.parse(got[1]["formatted"]) == [("user", "hi"), ("user", "hi"), ("assistant", ""), ("assistant", "x\\[INST]")]
    assert chat_format.parse(got[2]["formatted"]) == [("tool </s>", "</s>[/TURN]")]
    assert chat_format.format_conversations(d.filter("false")).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "x\r\ny", ""), (5, "http://c/", "é" * 100_000), (None, "http://d/", "same"), (1, "http://a/", "same")]
    d = spark.createDataFrame([(*r, 1, "q") for r in rows], "page_id long, url string, html string, bytes int, digest string")
    for compression in ("gzip", "none"):
        path = str(tmp_path / compression)
        warc.archive(d, path, compression=compression)
        got = warc.page_records(spark, path).collect()
        assert len(got) == len(rows)
        by = {r["page_id"]: r for r in got}
        assert (by[2]["record_type"], by[2]["refers_to"], by[2]["payload_bytes"]) == ("revisit", 1, 4)
        assert by[4]["refers_to"] == 3 and by[5]["payload_bytes"] == 200_000 and by[None]["record_type"] == "response"
    warc.archive(d.filter("false"), str(tmp_path / "none2"))
    assert warc.page_records(spark, str(tmp_path / "none2")).count() == 0


def test_stages_keep_columns(spark, docs, labels, empty, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() > 0
        assert name == "packing" or out.columns == docs.columns
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_special_token_in_a_text_is_one_id(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y \n<|endoftext|>  z", "<|endoftext|", "<<|endoftext|>>", " <|ENDOFTEXT|> it's"]
    mine = packing.encoder()
    assert mine(texts[0]) == [64, 220, 50256, 275]
    assert [mine(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    got = packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    want = [np.array([*t.encode(x, add_special_tokens=False).ids, 2], dtype="<u4") for x in texts]
    assert [(r["length"], r["ids_crc32"]) for r in got] == [(len(w), zlib.crc32(w.tobytes())) for w in want]


def test_plan_does_not_grow_with_the_pieces():
    capacity = 64
    h = np.random.default_rng(2).integers(0, 7, capacity + 1)
    h[0] = 0
    h[: capacity // 2] *= 4  # enough short pieces to fill the gaps
    runs, sequences, residue = packing.pack_histogram(h * 1_000)
    cover, taken = np.zeros((sequences, capacity), dtype=np.int8), np.zeros(capacity + 1, dtype=np.int64)
    for length, first, times, sequence, offset in runs:
        assert first == taken[length] and offset + length <= capacity
        taken[length] += times
        cover[sequence : sequence + times, offset : offset + length] += 1
    assert (taken == h * 1_000).all() and cover.max() == 1 and cover[:, 0].all()
    assert sequences <= 1.01 * -(-int(h @ np.arange(capacity + 1)) * 1_000 // capacity) + 1
    assert residue <= capacity and sum(times == 1 for _, _, times, _, _ in runs) <= 10 * capacity and len(runs) <= 60 * capacity
    assert len(packing.pack_histogram(h * 1_000_000)[0]) <= 60 * capacity
