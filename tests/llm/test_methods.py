"""Operators against brute force, exact round trips and held-out accuracy."""

import base64
import collections
import hashlib
import importlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lumenfold.llm import bm25_search, chat_format, common, embedding_dedup, mixing, near_dedup, packing, pii, queries, toxicity, url_filter, warc

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{i}_" for i in range(1, 14)} == {re.match(r"op\d+_", n)[0] for n in queries.QUERIES}
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("shift", [False, True])
def test_components_against_union_find(spark, shift):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    if shift:  # ids near both ends of the long range
        far = lambda x: x * 2**52 - 2**63 if x % 2 else 2**63 - 1 - x
        pairs = [(far(a), far(b)) for a, b in pairs]
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    d = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.connected_components(d).collect()}
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}


def test_near_dedup_against_all_pairs(spark, documents):
    got = near_dedup.groups(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    idf = near_dedup.inverse_document_frequencies(spark.read.parquet(f"{SF}/documents.parquet"))
    reps = got.drop_duplicates("class_id")
    text = documents.set_index("doc_id")["text"]
    sets = {i: near_dedup.shingles(near_dedup.word_hashes(text[i]), idf) for i in reps["class_id"]}
    where = collections.defaultdict(list)
    for i, (names, _) in sets.items():
        for n in names.tolist():
            where[n].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = {(a, b) for v in where.values() for a in v for b in v if a < b}
    for a, b in pairs:
        if near_dedup.weighted_jaccard(sets[a], sets[b]) >= near_dedup.SIMILARITY:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {i: find(i) for i in sets}
    have = dict(zip(reps["class_id"], reps["group_id"], strict=True))
    assert have == want
    same = documents.assign(k=[" ".join((t or "").lower().split()) for t in documents["text"]]).query("k != ''").groupby("k")["doc_id"].min()
    assert set(same) == set(reps["class_id"]) - set(documents.loc[[not (t or "").split() for t in documents["text"]], "doc_id"])


def test_texts_of_a_repeated_id_are_documents_of_their_own(spark):
    w, v = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(5, w), (5, v), (3, v), (7, w), (5, w), (9, "alone"), (9, "Alone"), (None, w)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"], r["group_id"], r["kept"]) for r in near_dedup.groups(d).filter("doc_id is not null").collect())
    assert got[:5] == [(3, 3, 3, True), (5, 3, 3, False), (5, 5, 5, True), (5, 5, 5, True), (7, 5, 5, False)]
    assert [g[3] for g in got[5:]] in ([True, False], [False, True])
    kept = [tuple(r) for r in near_dedup.keep_one(d).collect()]
    assert sorted(k[1].lower() for k in kept) == sorted([w, w, v, "alone"]) and (3, v) in kept and (5, w) in kept and (None, w) in kept


def test_last_round_moves_no_needless_text(spark, monkeypatch):
    """With tiny blocks the last round finds the same groups as with one block."""
    words = [f"w{i}" for i in range(80)]
    rng = np.random.default_rng(8)
    rows, base = [], list(words)
    for i in range(60):  # a chain: each text differs from the one before in a few words
        base[int(rng.integers(80))] = f"x{i}"
        rows.append((i, " ".join(base)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r["doc_id"]: r["group_id"] for r in near_dedup.groups(d, 0.7).collect()}
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    assert {r["doc_id"]: r["group_id"] for r in near_dedup.groups(d, 0.7).collect()} == whole


def test_samples_agree_as_often_as_weighted_sets(spark):
    rng = np.random.default_rng(1)
    sampler = near_dedup.Sampler(2_000)
    names = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    a, b = rng.gamma(2, 1, 300).astype(np.float32) + 0.1, rng.gamma(2, 1, 300).astype(np.float32) + 0.1
    starts = np.array([0])
    agree = (sampler(names, a, starts) == sampler(names, b, starts)).mean()
    assert abs(agree - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxicity.train(docs, *toxicity.label_categories(labels.filter("doc_id % 4 <> 0")))
    held = labels.filter("doc_id % 4 = 0").select("doc_id", "toxic")
    got = toxicity.score(docs, chain).join(held, "doc_id").toPandas()
    hit = got["p_toxic"] >= 1 / (1 + math.exp(-chain.cuts[-1]))
    assert (hit & (got["toxic"] == 0)).sum() <= 0.01 * len(got)
    assert (hit & (got["toxic"] == 1)).sum() >= 0.9 * (got["toxic"] == 1).sum()
    assert len(chain.rest[1]) == len(chain.rest[0]) + 1  # the later model sees the earlier one's log-odds


def test_chain_against_a_loop(spark, documents, monkeypatch):
    """Probabilities recomputed by a plain loop; out-of-fold models never see the rows that they score."""
    fitted = []
    plain = toxicity.fit_linear
    monkeypatch.setattr(toxicity, "fit_linear", lambda x, y, *a, **k: (fitted.append(len(y)), plain(x, y, *a, **k))[1])
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    y, categories = toxicity.label_categories(labels)
    chain = toxicity.train(docs, y, categories)
    fold = [r["n"] for r in docs.join(y.na.drop().select("doc_id").distinct(), "doc_id").groupBy(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(toxicity.FOLDS)).alias("f")).agg(F.count(F.lit(1)).alias("n")).orderBy("f").collect()]
    rows = sum(fold)
    assert fitted == [*(rows - n for n in fold), rows] * 2
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for doc_id, text in zip(documents["doc_id"], documents["text"], strict=True):
        raw = re.findall(r"\w+", text or "")
        want = [0.0, 0.0]
        if raw:
            kinds = set(raw)
            words = {w.lower() for w in kinds}
            words |= {w[:5] + "*" for w in words if len(w) > 5}
            shapes = [math.log1p(len(raw)) / 10, len(kinds) / len(raw), sum(w.isupper() for w in kinds) / len(kinds), text.count("!") / len(text) * 10, text.count("|") / len(text) * 10]
            z = []
            for k in range(2):
                total = sum(chain.features[k].get(w, 0.0) for w in words)
                for weight, value in zip(chain.rest[k], [*shapes, *z, 1.0], strict=True):
                    total += weight * value
                z.append(max(-30.0, min(30.0, total)))
            want = [sigmoid(v) for v in z]
        assert math.isclose(got[doc_id]["p_low_quality"], want[0], abs_tol=1e-9) and math.isclose(got[doc_id]["p_toxic"], want[1], abs_tol=1e-9)


def test_token_ids_are_those_of_the_tokenizers_library(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mine = packing.encoder()
    odd = ["", " ", "\n\n  x", "<|endoftext|> it's 3,14 ½ ñ ü 漢字 🙂‍↔️​ a", "a" * 3000, "\t\r\n 'LL 're", "١٢٣ ⅷ", "x́̀"]
    texts = odd + documents["text"].fillna("").tolist()[:300]
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine(text) == e.ids

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60))
    def same(text):
        assert mine(text) == t.encode(text, add_special_tokens=False).ids

    same()


def test_packing_round_trip(spark, documents):
    got = queries.QUERIES["op3_best_fit_packing"](spark, SF).toPandas().sort_values(["sequence_id", "offset"])
    by = got.groupby("sequence_id")
    assert (got["offset"] == by["length"].cumsum() - got["length"]).all() and (by["length"].sum() <= 1024).all()
    bound = -(-got["length"].sum() // 1024)
    assert bound <= got["sequence_id"].nunique() <= 1.005 * bound + 1
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(importlib.import_module("public_tokenizers").path("byte_bpe_50k.json"))
    encode = lambda text: library.encode(text, add_special_tokens=False).ids
    pieces = {(r.doc_id, r.piece): r for r in got.itertuples()}
    assert len(pieces) == len(got)
    n = 0
    for doc_id, text in zip(documents["doc_id"], documents["text"], strict=True):
        ids = np.array([*encode(text or ""), 2], dtype="<u4")
        at = 0
        for k in range(-(-len(ids) // 1024)):
            r = pieces[doc_id, k]
            assert r.start == at and (k == 0 or r.length == 1024) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at, n = at + r.length, n + 1
        assert at == len(ids)
    assert n == len(got)


def test_knapsack_against_enumeration():
    price = np.array([0, 0.1, 0.0, 0.45, 0.3, 0.0, 1.0, 0, 0, 0, 0])
    best = {0: 0.0}
    for c in range(1, 11):
        best[c] = max([best[c - 1], *(best[c - i] + price[i] for i in range(1, c + 1))])
    value, took = packing.knapsack_table(price)
    parts = packing.filling(took, 10)
    assert np.allclose(value, [best[c] for c in range(11)]) and math.isclose(price[parts].sum(), value[10]) and sum(parts) <= 10


@pytest.mark.parametrize("pieces", [1_000, 10_000, 100_000, 10_000_000])
def test_configuration_program_covers_its_demand_and_places_the_pieces(pieces):
    capacity = 1024
    rng = np.random.default_rng(6)
    share = rng.gamma(1.5, 1, capacity + 1) * np.exp(-np.arange(capacity + 1) / 400)
    share[0] = 0
    h = rng.multinomial(pieces, share / share.sum())
    size = np.arange(capacity + 1)
    used, covered = packing.configurations(h)
    assert all(sum(parts) <= capacity for parts in used)
    assert np.minimum(covered, 1) @ (h * size) >= 0.98 * (h @ size)
    runs, sequences, residue = packing.pack_histogram(h)
    bound = -(-int(h @ size) // capacity)
    assert residue <= capacity and residue <= 0.1 * pieces  # best fit places the rest only
    assert bound <= sequences <= 1.003 * bound + 2
    assert len(runs) <= 30 * capacity  # whatever the number of pieces


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_plan_places_every_piece_once(lengths):
    runs, sequences, _ = packing.pack_histogram(np.bincount(lengths, minlength=41))
    taken, filled = collections.Counter(), collections.defaultdict(list)
    for length, first, times, sequence, offset in runs:
        assert first == taken[length]
        taken[length] += times
        for i in range(times):
            filled[sequence + i].append((offset, length))
    assert taken == collections.Counter(lengths) and len(filled) == sequences
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40


def test_mixing_targets_and_reruns(spark, documents):
    got = queries.QUERIES["op4_mix_sources"](spark, SF).toPandas().set_index("doc_id")
    assert got.equals(queries.QUERIES["op4_mix_sources"](spark, SF).toPandas().set_index("doc_id").loc[got.index])
    size = documents.set_index("doc_id")["text"].fillna("").map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    assert (got["size"] == size.loc[got.index]).all() and (got["taken"] <= 3 * got["size"]).all()
    sizes = documents.assign(size=documents["doc_id"].map(size)).groupby("source")["size"].sum().sort_index()
    weight = {s: 1.0 + i % 3 for i, s in enumerate(sizes.index)}
    target, open_ = {}, set(sizes.index)
    left = float(sizes.sum())
    while True:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    got["source"] = documents.set_index("doc_id")["source"].loc[got.index]
    for s, g in got.groupby("source"):
        assert math.isclose(g["target"].iloc[0], target[s], rel_tol=1e-9) and abs(g["taken"].sum() - target[s]) <= 0.02 * target[s]


def test_water_level_of_small_sources(spark):
    d = spark.createDataFrame([(1, " ".join(["x"] * 1000), "a"), (2, "x y", "b"), (3, "x", None)], "doc_id long, text string, source string")
    t = {r["source"]: r["target"] for r in mixing.source_targets(mixing.sized(d)).collect()}
    assert t["b"] == 6 and t[None] == 3 and math.isclose(t["a"], 1003 - 9)


def test_longest_rule_against_a_loop(spark):
    got = queries.QUERIES["op5_url_filter"](spark, SF).toPandas()
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas().set_index("page_id")["url"]
    assert len(got) == len(pages)
    for r in got.itertuples():
        url = pages[r.page_id] or ""
        rest = url.partition("://")[2] if "://" in url else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [(k, v) for k, v in url_filter.RULES if (host == (h := k.split("/")[0]) or host.endswith(f".{h}")) and path.startswith(k[len(h) :])]
        best = max(fit, key=lambda x: len(x[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, best[0]) and (best[1] is None or r.verdict == best[1])


def test_redirect_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    hosts = [f"h{i}.org" for i in range(60)] + [f"h{i}.net" for i in range(20)] + ["example.com", "www.example.com"]
    urls = [f"https://{hosts[i % len(hosts)]}/{'en' if i % 3 else 'es'}/p{i}" for i in range(240)]
    links = [(i, int(rng.integers(240))) for i in rng.integers(0, 240, 110)] + [(200 + i, 201 + i) for i in range(30)] + [(230, 200)]  # a chain that closes to a cycle
    moved = [(int(a), int(b)) for a, b in rng.integers(0, 240, (30, 2))]
    canonical = {}
    for a, b in links:
        canonical.setdefault(int(a), b)
    pages = spark.createDataFrame([(i - 2**63, u, f'<link rel="canonical" href="{urls[canonical[i]]}">' if i in canonical else None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    redirects = spark.createDataFrame([(urls[a], urls[b]) for a, b in moved], "source_url string, target_url string")
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    got = {r["page_id"] + 2**63: r for r in url_filter.judge(pages, rules, redirects).collect()}
    root = list(range(240))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in [*canonical.items(), *moved]:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    own = {i: dict(url_filter.RULES).get(got[i]["rule"]) for i in range(240)}
    blocked = {find(i) for i in range(240) if own[i] == "block"}
    aliases = allowed = 0
    for i in range(240):
        want = own[i] or ("block" if find(i) in blocked else "allow")
        assert got[i]["verdict"] == want and got[i]["component"] + 2**63 == find(i)
        aliases += own[i] is None and want == "block"
        allowed += own[i] == "allow" and find(i) in blocked
    assert aliases > 5 and allowed > 0


def test_embeddings_against_brute_force(spark):
    got = queries.QUERIES["op6_embedding_dedup"](spark, "/root/testdata/sf0.1").toPandas().set_index("vec_id")
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.array(e["embedding"].tolist(), dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    want = near.sum(axis=1) - 1
    have = got.loc[e["vec_id"], "n_links"].to_numpy()
    assert (have <= want).all() and have.sum() >= 0.9 * want.sum()


def test_pairs_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(12)
    a = rng.standard_normal((3_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    away = rng.standard_normal(a.shape)
    away -= (away * a).sum(axis=1, keepdims=True) * a
    cos = np.where(np.arange(3_000) % 2, 0.9505, 0.9495)[:, None]  # every other pair is a little below
    b = cos * a + np.sqrt(1 - cos**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>")
    got = embedding_dedup.dedup(d).toPandas().set_index("vec_id")
    linked = got["n_links"].to_numpy()[np.argsort(got.index)]
    assert linked[0:3_000:2].sum() == 0 and linked[1:3_000:2].mean() >= embedding_dedup.RECALL - 0.02


@pytest.mark.parametrize("block_rows", [8_192, 7])
def test_windows_against_all_pairs(spark, monkeypatch, block_rows):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(2)
    rows = [(int(i), int(c), float(x)) for i, (c, x) in enumerate(zip(rng.integers(0, 9, 400), np.round(rng.normal(0, 1.4, 400), 2), strict=True))]
    rows += [(400 + i, 3, 0.25) for i in range(30)]  # a hot place
    got = {(r["a"], r["b"]): r["n"] for r in embedding_dedup.collisions(spark.createDataFrame(rows, "rep long, cell long, at double")).collect()}
    want = {(a, b): 1 for a, c, x in rows for b, e, y in rows if a < b and c == e and abs(x - y) <= embedding_dedup.WINDOW}
    assert got == want


def test_vectors_of_a_repeated_id(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (2**63 - 1, [1.0, 0.01]), (-(2**63), [0.01, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.dedup(d).collect())
    assert got == [(-(2**63), 2, -(2**63)), (1, 1, 1), (1, 2, -(2**63)), (2, 2, -(2**63)), (2**63 - 1, 1, 1)]


def test_calibration_reaches_its_recall():
    rng = np.random.default_rng(0)
    steps, tables = embedding_dedup.calibrate(5_000)
    sigma = math.sqrt(2 - 2 * embedding_dedup.THRESHOLD)
    diff = rng.normal(0, sigma, (4_000, tables, steps + 1))
    shift = rng.random((4_000, tables, steps))
    met = (np.floor(shift + diff[:, :, :steps]) == 0).all(axis=2) & (np.abs(diff[:, :, steps]) <= embedding_dedup.WINDOW)
    assert (met.sum(axis=1) >= embedding_dedup.COUNT).mean() >= embedding_dedup.RECALL - 0.02


def test_chat_query_against_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = {r[0]: r[1:] for r in c.execute(chat_format.OP7_SQL).fetchall()}
    got = {r[0]: tuple(r)[1:] for r in chat_format.op7_chat_format(spark, SF).collect()}
    assert got == want and -7 in got


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a </s>", ""]), st.text(alphabet="[]/\\<>sINTOUSYRLE </s>\n", max_size=25)), max_size=5))
def test_template_is_reversible_and_masks_texts(turns):
    out, spans = chat_format.turn_spans(chat_format.bracket_template, turns)
    assert chat_format.parse(out) == turns
    for k, (span, (_, text)) in enumerate(zip(spans, turns, strict=True)):
        a, b = chat_format.text_span(chat_format.bracket_template, turns, k, span, out, chat_format.escape(text))
        assert chat_format.unescape(out[a:b]) == text


def test_templates_that_rewrite_history_are_reported(spark):
    d = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")

    def rewriting(turns):
        return f"{len(turns)}:" + "".join(t for _, t in turns)

    r = chat_format.format_conversations(d, rewriting).first()
    assert r["rewrites"] and not r["spans"] and not r["mask"]


def test_search_against_brute_force(spark, documents):
    got = queries.QUERIES["op8_bm25_search"](spark, SF).toPandas()
    tokens = [collections.Counter(re.findall(r"\w+", (t or "").lower())) for t in documents["text"]]
    lengths = np.array([sum(c.values()) for c in tokens])
    held = collections.defaultdict(list)
    for i, c in enumerate(tokens):
        for w, n in c.items():
            held[w].append((i, n))
    ids, n = documents["doc_id"].to_numpy(), len(documents)
    for q in np.flatnonzero(ids % 100 == 0):
        score = np.zeros(n)
        for w, times in tokens[q].items():
            at, tf = np.array(held[w]).T
            score[at] += times * math.log(1 + (n - len(at) + 0.5) / (len(at) + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[at] / lengths.mean()))
        best = np.lexsort((ids, -np.round(score, 9)))[:10]
        mine = got[got["query_id"] == ids[q]].sort_values("rank")
        assert mine["doc_id"].tolist() == ids[best].tolist() and np.allclose(mine["score"], score[best])


def test_blocks_that_cannot_reach_the_threshold_are_not_decoded(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(2_000)]
    share = 1 / np.arange(1, 2_001)
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(20, 400)), p=share / share.sum()))) for i in range(4_000)]
    index = bm25_search.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert len(index) == 1
    shard = bm25_search.Shard(*(warc.pa.scalar(bytes(index[0][c]), warc.pa.binary()) for c in ("docs", "lengths", "terms", "starts", "held", "times")), 200.0)
    for words in (("w40", "w900", "w60"), ("w30", "w50"), ("w1", "w35", "w1500"), ("w700",), ("w2", "w3")):
        terms = np.unique(bm25_search.term_hashes(" ".join(words)))
        at = shard.look_up(terms)
        w = np.log(1 + (4_000 - shard.df[at] + 0.5) / (shard.df[at] + 0.5))
        score = np.zeros(4_000)
        for t, x in zip(at, w, strict=True):
            a, b = shard.starts[t], shard.starts[t + 1]
            score[shard.held[a:b]] += shard.impact[a:b] * x
        best = np.lexsort((shard.docs, -np.round(score, 9)))[:10]
        docs, got = shard.top(at, w, 10)
        assert docs.tolist() == shard.docs[best].tolist() and np.allclose(got, score[best])
    assert shard.decoded <= 0.6 * shard.asked


def test_whole_documents_as_queries_decode_few_postings(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(3_000)]
    share = 1 / np.arange(1, 3_001)
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(20, 600)), p=share / share.sum()))) for i in range(3_000)]
    rows += [(3_000 + i, rows[7][1]) for i in range(30)]  # copies: ties go by doc_id
    index = bm25_search.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    shard = bm25_search.Shard(*(warc.pa.scalar(bytes(index[0][c]), warc.pa.binary()) for c in ("docs", "lengths", "terms", "starts", "held", "times")), 300.0)
    at, weights, edges, want = [], [], [0], []
    for doc in (7, 100, 200, 2_999):
        own = shard.look_up(np.unique(bm25_search.term_hashes(rows[doc][1])))
        w = np.log(1 + (len(rows) - shard.df[own] + 0.5) / (shard.df[own] + 0.5))
        score = np.zeros(len(rows))
        for t, x in zip(own, w, strict=True):
            a, b = shard.starts[t], shard.starts[t + 1]
            score[shard.held[a:b]] += shard.impact[a:b] * x
        score = np.round(score, 9)
        best = np.lexsort((shard.docs, -score))[:10]
        want.append((shard.docs[best], score[best]))
        docs, got = shard.top(own, w, 10)
        assert docs.tolist() == want[-1][0].tolist() and np.allclose(got, want[-1][1])
        at, weights, edges = [*at, *own], [*weights, *w], [*edges, edges[-1] + len(own)]
    assert shard.decoded <= 0.1 * shard.asked
    # All queries at once, with floors that the tenth, the third or no document reaches.
    for floors in ([0.0] * 4, [s[9] for _, s in want], [s[2] for _, s in want], [s[0] + 1 for _, s in want]):
        got = {j: (d.tolist(), s) for j, d, s in shard.tops(np.array(at), np.array(weights), np.array(edges), 10, np.array(floors))}
        for j, (docs, score) in enumerate(want):
            reach = score >= floors[j]
            assert got.get(j, ([],))[0] == docs[reach].tolist() and np.allclose(got[j][1] if j in got else [], score[reach])


def test_search_over_small_shards_and_query_blocks(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    q = d.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    whole = bm25_search.search(bm25_search.build_index(d), q)
    parts = bm25_search.search(bm25_search.build_index(d, 150, 50_000), q, query_terms_in_block=500)
    assert whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0


@settings(max_examples=2_000, deadline=None)
@given(st.text(alphabet="ab.@1239 -+()%é", max_size=45))
def test_base_spans_against_the_patterns(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    want = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    want += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    want += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    assert pii.base_spans(text) == want


def test_estimated_reliabilities():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.3
    right = np.array([0.95, 0.8, 0.7, 0.6])
    said = np.where(rng.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]) * 2
    counts = collections.Counter((said @ [27, 9, 3, 1]).tolist())
    prior, table, _ = pii.reliabilities({k: float(v) for k, v in counts.items()})
    assert abs(prior - 0.3) < 0.03 and np.abs(table[1, :, pii.YES] - right).max() < 0.05


def luhn_number(rng, prefix, n):
    head = prefix + "".join(map(str, rng.integers(0, 10, n - len(prefix) - 1)))
    return next(f"{head}{d}" for d in range(10) if pii.luhn(f"{head}{d}"))


def test_added_spans_precision_and_recall(spark):
    """Beside base spans: local numbers, spelled addresses and old 13-digit cards are added, look-alikes aren't."""
    rng = np.random.default_rng(9)
    grouped = lambda d: f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}"
    texts, planted = [], {}
    for i in range(200):
        n = int(rng.integers(1000, 9999))
        texts.append(f"the office phone is +1 (202) 555-{n} on weekdays, mail user{i}@mail.example.com or pay by card {grouped(luhn_number(rng, '4', 16))} there")
        texts.append(f"they moved the {n} chairs in {1900 + i % 100} and counted {i} of them, order no {rng.integers(10**8, 10**9)} came later")
        texts.append(f"order {grouped(''.join(map(str, rng.integers(0, 10, 16))))} was sent, see version {i}.{n}.{i}.300 of it")
    for i in range(40):
        n = int(rng.integers(1000, 9999))
        for value, form in ((f"(202) 555-{n}", "please call me, phone: {} today"), (f"202-555-{n}", "you may call {} at any time"), (f"user{i} (at) mail (dot) example (dot) org", "write to {} about it"), (luhn_number(rng, "4", 13), "her visa card {} was lost")):
            planted[len(texts)] = value
            texts.append(form.format(value))
    texts += ["we met (at) noon. come again", "see isbn 978-0306-4061 there", "on 12-2020-1234 and 1999-2004 no one came"]
    texts += [t.replace("phone: ", "") for t in ("ticket 4111 1111 1111 1112 was closed",)]
    got = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    added = {i: [texts[i][s["start"] : s["end"]] for s in r["spans"] if s not in r["base"]] for i, r in got.items()}
    found = sum(planted[i] in added[i] for i in planted)
    wrong = sum(len([s for s in a if s != planted.get(i)]) for i, a in added.items())
    assert found >= 0.9 * len(planted) and wrong <= 0.02 * len(planted)
    assert all(b in r["spans"] for r in got.values() for b in r["base"])
    for i, t in enumerate(texts):
        for v in added[i]:
            digits = pii.digits_of(v)
            assert not (len(digits) == 16 and not pii.luhn(digits)), t


def test_warc_predicates_skip_payloads(spark, tmp_path):
    d = spark.createDataFrame([(i, f"http://h/{i}", "same" if i % 2 else f"page {i}") for i in range(40)], "page_id long, url string, html string")
    warc.archive(d, str(tmp_path), compression="none")
    read = spark.read.format("warc").option("path", str(tmp_path)).load()
    some = read.filter("record_type = 'revisit' AND target_uri > 'http://h/3'")
    assert "PushedFilters" in some._jdf.queryExecution().toString() or some.count()
    assert some.count() == sum(1 for i in range(40) if i % 2 and i > 1 and f"http://h/{i}" > "http://h/3")
    assert read.filter("payload is not null and record_type = 'revisit'").count() == 0
    reader = warc.WarcReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, IsNull

    assert [type(f) for f in reader.pushFilters([EqualTo(("record_type",), "response"), IsNull(("payload",))])] == [IsNull]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 21


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_unwanted_payloads_are_not_decoded(spark, tmp_path, monkeypatch, compression):
    long = "".join(f"<p>{i * i % 977}</p>" for i in range(20_000))
    d = spark.createDataFrame([(i, f"http://h/{i}", f"{i}{long}" if i % 2 else "same") for i in range(20)], "page_id long, url string, html string").coalesce(2)
    warc.archive(d, str(tmp_path), compression=compression)
    spent = []
    plain = warc.Member._more
    monkeypatch.setattr(warc.Member, "_more", lambda self, n: (before := self.inflated, plain(self, n), spent.append(self.inflated - before))[1])

    def run(payload, kind, **options):
        spent.clear()
        r = warc.WarcReader({"path": str(tmp_path), "payload": payload, **options})
        list(r.pushFilters([warc.EqualTo(("record_type",), kind)]))
        parts = r.partitions()
        return [row for p in parts for row in r.records(p)], sum(spent), len(parts)

    rows, inflated, parts = run("true", "revisit")
    assert len(rows) == 9 and inflated <= 20 * 1_500  # the headers of twenty records
    rows, inflated, _ = run("false", "response")
    assert len(rows) == 11 and all(r["payload"] is None and r["payload_length"] > 0 for r in rows) and inflated <= 20 * 1_500
    rows, _, more = run("true", "response", split_bytes="5000")
    assert more > parts and sorted(len(r["payload"]) for r in rows)[-10:] == sorted(len(f"{i}{long}") for i in range(1, 20, 2))
    read = spark.read.format("warc").option("path", str(tmp_path)).option("split_bytes", 5_000).load()
    assert read.count() == 20
    for f in tmp_path.glob("*.idx"):  # archives of others have no index
        f.rename(f.with_suffix(".gone"))
    rows, _, without = run("true", "response")
    assert without == parts and len(rows) == 11


def test_warc_writer_leaves_nothing_half_done(spark, tmp_path):
    d = spark.createDataFrame([(i, f"http://h/{i}", f"page {i}") for i in range(10)], "page_id long, url string, html string")
    warc.archive(d, str(tmp_path))
    before = sorted(p.name for p in tmp_path.iterdir())
    writer = warc.WarcWriter({"path": str(tmp_path)}, True)
    rows = [{c: None for c in warc.arrow_schema().names} | {"record_type": "response", "record_id": "<urn:page:1>", "payload": b"x", "payload_length": 1}]
    message = writer.write(iter([warc.pa.RecordBatch.from_pylist(rows, warc.arrow_schema())]))
    writer.write(iter([]))  # an attempt whose message never comes
    assert set(before) <= {p.name for p in tmp_path.iterdir()}
    writer.abort([message])
    assert sorted(p.name for p in tmp_path.iterdir()) == before
    message = writer.write(iter([warc.pa.RecordBatch.from_pylist(rows, warc.arrow_schema())]))
    writer.write(iter([]))
    writer.commit([message])
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"{message.name}.warc.gz", f"{message.name}.warc.gz.idx"]
    assert [r["page_id"] for r in warc.page_records(spark, str(tmp_path)).collect()] == [1]


def test_warc_round_trip(spark):
    got = {r["page_id"]: r for r in queries.QUERIES["op10_warc_round_trip"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    first = {}
    for p in pages:
        first[p["html"]] = min(first.get(p["html"], p["page_id"]), p["page_id"])
    assert len(got) == len(pages)
    for p in pages:
        data, r = (p["html"] or "").encode(), got[p["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert r["refers_to"] == (None if first[p["html"]] == p["page_id"] else first[p["html"]])


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").select("doc_id").collect()}
    first = corpus_pipeline.reject_toxic(spark, docs, SF)
    left = {r[0] for r in first.select("doc_id").collect()}
    assert len(toxic & left) <= 0.2 * len(toxic) and len(left) >= docs.count() * 0.8
    second = corpus_pipeline.drop_near_copies(spark, docs, SF)
    groups = near_dedup.groups(docs)
    assert second.count() == groups.filter("kept").count()
    masked = corpus_pipeline.mask_personal_data(spark, docs, SF)
    assert masked.filter(F.col("text").rlike(r"\+[0-9] \([0-9]{3}\)")).count() == 0 and masked.filter("n_chars <> length(text)").count() == 0
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        before, stage = stage, common.materialize(f(spark, stage, SF), f"test-{name}")
        if name == "mixing":
            want = collections.Counter()
            for r in mixing.mix(before)[0].collect():
                want[r["doc_id"]] += 1 if r["size"] == 0 else math.floor(r["taken"] / r["size"] + 0.5)
            got = collections.Counter(r[0] for r in stage.select("doc_id").collect())
            assert got == +want  # ids are distinct after deduplication
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(importlib.import_module("public_tokenizers").path("byte_bpe_50k.json"))
    want = collections.Counter()
    for doc_id, text in stage.select("doc_id", "text").collect():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    assert collections.Counter(zip(pieces["doc_id"], pieces["piece"], pieces["start"], pieces["length"], pieces["ids_crc32"])) == want
    pieces = pieces.sort_values(["sequence_id", "offset"])
    by = pieces.groupby("sequence_id")["length"]
    assert (by.sum() <= 1024).all() and (pieces["offset"] == by.cumsum() - pieces["length"]).all()
