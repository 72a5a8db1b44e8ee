"""What once stopped a job, broke a bound or missed its target: long runs, long hosts, long conversations, tiny sources, repeated ids."""

import collections
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenfold.llm import chat_format, mixing, near_dedup, packing, pii, toxicity, url_filter


@pytest.mark.parametrize("space", [" ", "\t", "\n"])
@pytest.mark.parametrize("n", [1_000_001, 3_000_000])
def test_encoder_takes_long_white_space(space, n):
    encode, library = packing.encoder(), packing.json_bpe()
    for text in (space * n, f"one {space * n}two"):
        assert encode(text) == library.encode(text, add_special_tokens=False).ids


def test_pipeline_takes_long_runs(spark, tmp_path):
    texts = [" " * 1_000_001, "a" + "\n" * 1_000_001 + "b", f"call {'0' * 5000}.1.1.1 now", "plain words of a clean document here", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() >= 4
    packed = packing.pack(packing.token_pieces(docs))
    assert packed.count() > 900


def test_address_parts_of_many_digits(spark):
    zeros = "0" * 5000
    assert pii.base_spans(f"x {zeros}.1.1.1 y") == [(1, 2, 5008)]
    assert pii.base_spans(f"x {'9' * 5000}.1.1.1 y") == []
    assert pii.base_spans(f"{zeros}255.0.0.{zeros}7") == [(1, 0, 10009)]
    assert pii.unpack(pii.pack_votes(pii.votes(1, "1000001.2.3.4", 0, 13)))[1] == pii.NO
    d = spark.createDataFrame([(1, f"x {zeros}.1.1.1 y")], "doc_id long, text string")
    assert pii.detect(d).first()["base"][0]["end"] == 5008


def test_choose_against_a_loop():
    rng = random.Random(3)
    model = {k: np.append(np.linspace(-2, 2, pii.PLACES), 0.3) for k in range(4)}
    for _ in range(60):
        spans = [{"kind": rng.randrange(4), "start": (a := rng.randrange(120)), "end": a + rng.randrange(1, 15), "votes": 80, "base": rng.random() < 0.2, "held": [rng.randrange(pii.PLACES)]} for _ in range(40)]
        kept = [(c["kind"], c["start"], c["end"]) for c in spans if c["base"]]
        score = lambda c: 1 / (1 + np.exp(-(model[c["kind"]][c["held"]].sum() + 0.3)))  # noqa: B023, E731
        for c in sorted((c for c in spans if not c["base"] and score(c) >= 0.5), key=lambda c: (-score(c), c["start"] - c["end"], c["start"], c["kind"], c["end"])):
            if all(c["end"] <= s or c["start"] >= e for _, s, e in kept):
                kept.append((c["kind"], c["start"], c["end"]))
        assert pii.choose(spans, model, 0.5) == sorted(kept, key=lambda s: (s[1], s[0], s[2]))
    many = [{"kind": 1, "start": 3 * i, "end": 3 * i + 2, "votes": 80, "base": False, "held": [pii.PLACES - 1]} for i in range(100_000)]
    began = time.perf_counter()
    assert len(pii.choose(many, model, 0.5)) == 100_000 and time.perf_counter() - began < 20


@pytest.mark.parametrize("n", [300, 30_000, 300_000])
def test_sample_agreement_is_the_similarity(n):
    rng = np.random.default_rng(n)
    sampler = near_dedup.Sampler()
    agree, similar = [], []
    for _ in range(40 if n < 1_000 else 6 if n < 100_000 else 2):
        names = rng.integers(0, 1 << 64, n + n // 4, dtype=np.uint64)
        weights = rng.choice([1.0, 2.0, 8.0], len(names)).astype(np.float32)
        order = np.argsort(names)
        names, weights, own = names[order], weights[order], rng.random(len(names))
        a, b = own < 0.9, own >= 0.1  # ends differ, the middle is shared
        both = near_dedup.weighted_jaccard((names[a], weights[a]), (names[b], weights[b]))
        x, y = (sampler(names[k], weights[k], np.array([0])) for k in (a, b))
        agree.append((x == y).mean())
        similar.append(both)
    spread = np.sqrt(0.16 / (len(agree) * near_dedup.BANDS * near_dedup.ROWS))
    assert abs(np.mean(agree) - np.mean(similar)) < max(0.02, 3 * spread)


def test_long_near_copies_are_found(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(5000)]
    text = [words[i] for i in rng.integers(0, 5000, 100_000)]
    rows, at = [(0, " ".join(text))], 1
    for _ in range(4):
        other = list(text)
        for i in rng.choice(100_000, 1_900, replace=False):  # about nine shingles in ten are left
            other[i] = "changed"
        rows.append((at, " ".join(other)))
        at += 1
    got = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["group_id"] for r in got} == {0}


def test_training_bound_holds(spark):
    docs = spark.createDataFrame([(7, f"text number {i} of one id") for i in range(3000)] + [(i, f"other text {i}") for i in range(100, 150)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] + [(i, i % 2) for i in range(100, 150)] + [(i, 1) for i in range(5000, 9000)], "doc_id long, toxic int")
    seen = []

    def spy(sample, categories):
        seen.append(sample.count())
        return [[] for _ in categories]

    kept, toxicity.choose_features = toxicity.choose_features, spy
    try:
        toxicity.train(docs, labels, ["toxic"], max_rows=10)
        toxicity.train(docs.filter("doc_id <> 7"), labels, ["toxic"], max_rows=1000)
    finally:
        toxicity.choose_features = kept
    assert seen == [10, 50]  # labels of absent documents use up nothing


def test_hosts_of_many_labels(spark):
    long = ".".join(["a"] * 100_000)
    pages = spark.createDataFrame([(1, f"http://{long}.example.com/en/x", None), (2, f"http://{long}/", None), (3, "http://.com/", None), (4, "http://com./", None), (5, "http://net/es/", None)], "page_id long, url string, html string")
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    began = time.perf_counter()
    got = {r["page_id"]: r["rule"] for r in url_filter.judge(pages, rules).collect()}
    assert got == {1: "example.com/en/", 2: None, 3: "com/", 4: None, 5: "net/es/"} and time.perf_counter() - began < 60


def test_conversations_without_id_stay_apart(spark):
    rows = spark.createDataFrame([(None, i, "assistant", f"text {i}") for i in range(50)] + [(1, 0, "user", "hi"), (1, 1, "assistant", "ho")], "conv_id long, turn long, role string, text string")
    got = collections.Counter((r["conv_id"], r["n_turns"]) for r in chat_format.digests(chat_format.format_conversations(rows)).collect())
    assert got == {(None, 1): 50, (1, 2): 1}


def test_long_conversation_costs_its_length():
    turns = [("user" if i % 2 == 0 else "assistant", f"text </s> {i} " * 20) for i in range(20_000)]
    began = time.perf_counter()
    out, spans = chat_format.turn_spans(chat_format.bracket_template, turns)
    for k in range(0, 20_000, 37):
        a, b = chat_format.text_span(chat_format.bracket_template, turns, k, spans[k], out, chat_format.escape(turns[k][1]))
        assert chat_format.unescape(out[a:b]) == turns[k][1]
    assert chat_format.parse(out) == turns and time.perf_counter() - began < 30
    few = turns[:60]
    assert chat_format.turn_spans(lambda t: chat_format.bracket_template(t), few) == chat_format.turn_spans(chat_format.bracket_template, few)


def test_every_prefix_of_an_incremental_template_is_compared():
    turns = [("user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(12)]
    whole = lambda t: "".join(chat_format.bracket_turn(*x) for x in t)
    for odd in range(1, 13):  # only the prefix of so many turns comes out otherwise
        template = chat_format.Incremental(lambda t, odd=odd: whole(t) + "." * (len(t) == odd), chat_format.bracket_turn)
        assert chat_format.turn_spans(template, turns)[1] is None
        assert chat_format.turn_spans(template, turns[: odd - 1]) == chat_format.turn_spans(chat_format.bracket_template, turns[: odd - 1])
    assert chat_format.turn_spans(chat_format.bracket_template, turns) == chat_format.turn_spans(whole, turns)
    assert chat_format.turn_spans(chat_format.bracket_template, []) == ("", [])


def test_incremental_template_that_rewrites_is_found():
    forgetful = chat_format.Incremental(lambda turns: "".join(chat_format.bracket_turn(r, t) for r, t in turns[-3:]), chat_format.bracket_turn)
    assert chat_format.turn_spans(forgetful, [("user", str(i)) for i in range(4)])[1] is None
    assert chat_format.turn_spans(forgetful, [("user", str(i)) for i in range(3)])[1] is not None


def test_query_renders_every_prefix(spark, monkeypatch):
    given = []
    monkeypatch.setattr(chat_format, "format_conversations", lambda rows, *a, f=chat_format.format_conversations: given.append(a) or f(rows, *a))
    chat_format.op7_chat_format(spark, "/root/testdata/sf0.001")
    (template,) = given[0]
    turns, seen = [("user", "a </s>"), ("assistant", "b"), ("tool", ""), ("assistant", "b")], []
    found = chat_format.turn_spans(lambda t: seen.append(len(t)) or template(t), turns)
    assert not isinstance(template, chat_format.Incremental) and seen == [0, 1, 2, 3, 4]
    assert found == chat_format.turn_spans(chat_format.bracket_template, turns)


def test_small_sources_meet_their_targets(spark):
    rows, at = [], 0
    for source, words, each in [("big", 40_000, 100), *((f"s{n:03}", n, 1) for n in range(1, 101, 9)), (None, 7, 2), ("", 5, 5)]:
        for a in range(0, words, each):
            rows.append((at, source, " ".join(["x"] * min(each, words - a))))
            at += 1
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out, stream = mixing.mix(d)
    for r in out.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.first("source_size").alias("size"), F.max(F.col("taken") / F.col("size")).alias("times")).collect():
        assert abs(r["taken"] - r["target"]) <= max(0.5, 0.003 * r["size"]) and r["times"] <= 3
    # The schedule by hand: slots go by golden-ratio points, the quota is exact, blocks repeat in order.
    plan = mixing.schedule(mixing.source_targets(mixing.sized(d)), 14).toPandas()
    for _, g in plan.groupby("src"):
        assert sorted(g["rank"]) == list(range(len(g)))
    assert stream.agg(F.sum("words")).first()[0] == out.agg(F.sum("taken")).first()[0]
    assert re.fullmatch(r"\d+", str(plan["slot"].max()))
