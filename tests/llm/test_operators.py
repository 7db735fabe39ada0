"""Each operator against a brute-force version, and with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyquery.llm import chat, common, counts, decontaminate, embeddings, langid, neardup, packing, quality, secrets, substrings
from skyquery.llm.queries import table, tokenizer_path
from skyquery.llm.tokens import Encoder


def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those that operators add."""
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, base, "en", 1.0, "x"), (2, base, "en", 2.0, None), (2, base, "en", 2.0, None), (3, None, None, None, "x"), (4, "", "en", 0.0, ""), (5, "   \n\t", "de", 0.0, "y"), (None, base + " x", "en", 1.0, "x"), (6, "word " * 30000, "en", 1.0, "z"),
        (7, "ÄÖÜ 123 !!! 😀", "de", 1.0, "x"), (8, base + " thirteen", "en", 1.0, "x"), (9, "a", "en", 1.0, "x"), (9, "b", "en", 1.0, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, _text string")


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark)


@pytest.fixture(scope="module")
def docs(spark, data):
    return table(spark, data, "documents")


@pytest.fixture(scope="module")
def large(data):
    """The next larger tables."""
    return data.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def large_docs(spark, large):
    return table(spark, large, "documents")


def test_held_out_rule(spark):
    got = [r[0] for r in spark.range(50).select(common.held_out(F.col("id"))).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)]


# --- components and blocks ---
@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_components(spark, edges):
    got = dict(common.components(spark.createDataFrame(edges, "u long, v long")).collect())
    parent = list(range(31))
    for _ in range(31):
        for u, v in edges:
            parent[u] = parent[v] = min(parent[u], parent[v])
    linked = {n for u, v in edges if u != v for n in (u, v)}
    assert got == {n: parent[n] for n in linked}


def test_chain_components(spark):
    got = common.components(spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    assert got.count() == 201 and got.select("root").distinct().collect()[0][0] == 0


def test_blocks_meet_every_pair_once(spark):
    frame = spark.range(50).select(F.lit(1).alias("g"), F.col("id"), F.lit(50).alias("n"))
    rows = common.block_rows(frame, ["g"], "n", "id", 8).collect()
    blocks = defaultdict(list)
    for r in rows:
        blocks[r.blk].append(r)
    met = Counter()
    for members in blocks.values():
        for a in members:
            for b in members:
                if a.id < b.id and (members[0].same or a.side != b.side):
                    met[a.id, b.id] += 1
    assert len(met) == 50 * 49 // 2 and set(met.values()) == {1}


# --- 1 quality ---
def auc(pairs):
    good, bad = ([s for s, y in pairs if y == k] for k in (1, 0))
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_quality_on_held_out_documents(spark, large_docs, large):
    """Learned from the others, judged on the held-out ones."""
    labels = table(spark, large, "labels")
    model = quality.fit(large_docs.filter(~common.held_out("doc_id")), labels)
    held = large_docs.filter(common.held_out("doc_id"))
    got = quality.score(held, model, keep=["doc_id"]).join(labels, "doc_id").select("score", "quality", "predicted").collect()
    assert len(got) > 60 and auc([(r.score, r.quality) for r in got]) > 0.95 and np.mean([r.predicted == r.quality for r in got]) > 0.9
    again = quality.QualityModel.unpack(model.pack(), model.params)
    assert np.allclose(again.logit, model.logit, atol=1e-5)


def test_quality_features_are_of_characters():
    params = quality.QualityParams(grams=(3, 3))
    buckets, owner, _ = quality.word_features(["äöü".encode(), b"abc", "öüx".encode()], params)
    # the word and its three-character strings, edges included
    assert np.bincount(owner).tolist() == [4, 4, 4]
    shared = set(buckets[owner == 0].tolist()) & set(quality.word_features(["xäöü".encode()], params)[0].tolist())
    assert len(shared) == 2


def test_quality_scorer_equals_the_mean_of_vectors():
    params = quality.QualityParams(buckets=1 << 10, width=4, epochs=2)
    texts = [b"good fine words here", b"bad | bad | bad | x", b"fine good text words", b"| bad | y"] * 3
    model = quality.train(texts, [1, 0, 1, 0] * 3, params)
    for text in [*texts, b"", b"one", b"x x x x"]:
        feature, weight = quality._document_features(text, params)
        z = float(weight @ model.logit[feature]) + model.bias if len(feature) else model.bias
        assert quality.Scorer(model)([text])[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_odd_inputs(spark, odd):
    labels = spark.createDataFrame([(1, 1), (7, 0), (7, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = quality.score(odd, quality.fit(odd, labels))
    assert got.count() == odd.count() and set(got.columns) == {*odd.columns, "predicted"} and got.filter("score is null or score < 0 or score > 1").count() == 0
    empty = quality.fit(odd.limit(0), labels.limit(0))
    assert [r.score for r in quality.score(odd.limit(1), empty).collect()] == [0.5] and quality.score(odd.limit(0), empty).count() == 0


# --- 2 counts ---
def test_counts_follow_deltas(spark, tmp_path):
    c = lambda *rows: spark.createDataFrame(rows, "source string, lang string, version string, tokens long")
    rollup = counts.Rollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().count() == 0
    first = c(("a", "en", "v1", 10), ("a", "en", "v1", 5), ("b", None, "v1", 7))
    assert rollup.commit("one", counts.inserted(first)) and not rollup.commit("one", counts.inserted(first))
    rollup.commit("two", counts.deleted(c(("b", None, "v1", 7))))
    rollup.commit("three", counts.revised(c(("a", "en", "v1", 5)), c(("a", "en", "v2", 6))))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}
    assert got == {("a", "en", "v1"): (1, 10), ("a", "en", "v2"): (1, 6)} and rollup.batches() == ["one", "three", "two"]
    # what a broken commit leaves lies aside and does not count
    (tmp_path / "r/_aside-x/changes").mkdir(parents=True)
    assert len(rollup.batches()) == 3 and {tuple(r) for r in rollup.totals().collect()} == {k + v for k, v in got.items()}
    with pytest.raises(ValueError):
        rollup.commit("../x", counts.inserted(first))


def test_counts_fold(spark, tmp_path):
    """Totals stay when batches are folded and purged, folded batches are not committed again, and empty batches count as such."""
    c = lambda *rows: counts.inserted(spark.createDataFrame(rows, "source string, lang string, version string, tokens long").withColumn("docs", F.lit("x")))
    rollup, state = counts.Rollup(spark, f"file://{tmp_path}/r"), lambda: {tuple(r) for r in rollup.totals().collect()}
    assert not rollup.fold()
    rollup.commit("a", c(("s", "en", "v", 3), ("s", None, "v", None)))
    rollup.commit("b", c(("s", "en", "v", 4)).limit(0))
    assert rollup.fold() and not rollup.fold()
    rollup.commit("c", c(("s", "en", "v", 5)))
    expected = {("s", "en", "v", 2, 8), ("s", None, "v", 1, 0)}
    assert state() == expected
    rollup.purge()
    assert state() == expected and rollup.batches() == ["a", "b", "c"] and not rollup.commit("a", c(("s", "en", "v", 3)))
    assert rollup.fold() and state() == expected
    rollup.purge()
    assert state() == expected and sorted(x.name for x in (tmp_path / "r").iterdir()) == ["fold=000000002"]


def test_concurrent_commits_count_once(spark, tmp_path, monkeypatch):
    changes = counts.inserted(spark.createDataFrame([("s", "en", "v", 3)], "source string, lang string, version string, tokens long"))
    rollup = counts.Rollup(spark, f"file://{tmp_path}/r")
    assert rollup.commit("a", changes)
    # a second writer that looked before the first one was done
    monkeypatch.setattr(rollup, "committed", lambda batch: False)
    assert not rollup.commit("a", changes) and [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "v", 1, 3)]
    assert sorted(x.name for x in (tmp_path / "r").iterdir()) == ["batch=a"]


def test_token_counts(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    for r in counts.count_tokens(odd.withColumn("keep", F.col("text")), tokenizer_path(), keep=["doc_id", "keep"]).collect():
        assert r.tokens == len(t.encode(r.keep or "", add_special_tokens=False).ids)


# --- 3 near duplicates ---
def brute_classes(rows, threshold=0.8):
    sets = {}
    for k, text in rows:
        w = (text or "").encode().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links = {a: {b for b in sets if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold} for a in sets}
    root = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in links[a]:
                root[a] = root[b] = min(root[a], root[b])
    return links, root


def test_near_duplicates(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for _ in range(12):
        base = list(rng.choice(words, 60))
        for _ in range(int(rng.integers(1, 9))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(0, 60))] = str(rng.choice(words))
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, rows[0][1]), (n + 1, rows[0][1])]
    links, root = brute_classes(rows)
    # small chunks, so that clusters go through several blocks
    got = {r.doc_id: r for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), neardup.NearDupParams(chunk=4, verify_chunk=3, weight=200)).collect()}
    assert {k: r.n_links for k, r in got.items()} == {k: len(v) for k, v in links.items()}
    assert {k: r.class_id for k, r in got.items()} == root


def test_near_duplicates_odd_inputs(spark, odd):
    got = neardup.classes(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[1][0].n_links == 4 and {r.class_id for r in by[2]} == {1} and by[3][0].class_id == 3 and by[5][0].n_links == 0 and by[8][0].class_id == 1
    assert neardup.classes(odd.limit(0)).count() == 0


def test_near_duplicates_at_other_thresholds(spark):
    """Pairs below the usual bounds, and parameters that cannot reach the recall."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):
        base = [f"x{w}" for w in rng.integers(0, 4000, 60)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:48] + [f"y{w}" for w in rng.integers(0, 4000, int(rng.integers(6, 14)))]))]
    links, root = brute_classes(rows, 0.5)
    assert sum(map(len, links.values())) >= 70
    params = neardup.NearDupParams(threshold=0.5, trees=24, depth=4)
    got = {r.doc_id: r for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), params).collect()}
    assert {k: r.n_links for k, r in got.items()} == {k: len(v) for k, v in links.items()} and {k: r.class_id for k, r in got.items()} == root
    with pytest.raises(ValueError):
        neardup.forest_depth(neardup.NearDupParams(threshold=0.1))


def test_forest_shortens_where_it_is_cheap():
    params = neardup.NearDupParams()
    assert neardup.forest_depth(params) == 4 and neardup.levels(params) == [8, 6, 4]
    sizes = np.ones((3, 16, 3), np.int64)
    sizes[1, :5] = [1, 50, 900]
    sizes[2] = [3, 3, 3]
    level = neardup.shortened(sizes, params)
    # the crowded trees keep longer prefixes than the others, and pairs at the threshold meet all the same
    assert level[1, :5].max() < 2 and (level[1, 5:] == 2).all()
    for row in level:
        assert 1 - np.prod(1 - 0.8 ** np.array([8, 6, 4])[row]) >= 0.999


def test_labels_sort_like_their_minima():
    params = neardup.NearDupParams()
    low = np.arange(128, dtype=np.uint32) * np.uint32(2654435761)
    high, rest = neardup.labels(low, params).view(np.uint64)
    short = ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).reshape(16, 8).tolist()
    whole = [(int(a) << 64) | int(b) for a, b in zip(high, rest, strict=True)]
    assert whole == [sum(x << 16 * (7 - i) for i, x in enumerate(row)) for row in short]


def test_long_near_duplicates(spark):
    """Texts whose shingles fill several blocks."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 9000, 30000)]
    rows = [(0, " ".join(words)), (1, " ".join([*words[:15000], "new", *words[15000:]])), (2, " ".join(words[:26000])), (3, " ".join(words[:9000]))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), neardup.NearDupParams(weight=20_000)).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (0, 2), 3: (3, 0)}


# --- 4 packing ---
def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = ["Hello, world! it's 5km", "a\x1cb\x85c d", "<|endoftext|>x y<|startoftext|>", "İstanbul ΣΣ ẛ̣", "", " ", "the&&& of%%% \"quoted\" (x)", "don't 's dogs' a--b", "ciónñ Straße...", "😀 é ́x"]
    for text, ids in zip(texts, Encoder(tokenizer_path())([x.encode() for x in texts]), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, text


def best_fit_decreasing(histogram, capacity):
    """How many sequences plain best fit, longest first, takes: piece by piece."""
    free = []
    for n in sorted(Counter(histogram).elements(), reverse=True):
        at = min((k for k, f in enumerate(free) if f >= n), key=free.__getitem__, default=None)
        if at is None:
            free.append(capacity - n)
        else:
            free[at] -= n
    return len(free)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=25))
def test_plan_packs_all(histogram):
    params = packing.PackingParams(capacity=64, large=10, groups=4)
    made = packing.plan(histogram, params)
    held = Counter()
    for run, n in made:
        assert n > 0 and sum(a * b for a, b in run) <= 64
        for a, b in run:
            held[a] += b * n
    assert held == Counter(histogram)
    assert sum(n for _, n in made) <= best_fit_decreasing(histogram, 64)


def check_packing(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity


def test_packing(spark, docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    check_packing(rows, 4096)
    texts = {r.doc_id: r.text for r in docs.collect()}
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        by[r.doc_id].append(r)
    assert set(by) == set(texts)
    for k in list(texts)[::20]:
        ids = np.array([*t.encode(texts[k] or "", add_special_tokens=False).ids, 1], "<u4")
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in by[k]] == [(i, 4096 * i, len(ids[4096 * i : 4096 * i + 4096]), zlib.crc32(ids[4096 * i : 4096 * i + 4096].tobytes())) for i in range(-(-len(ids) // 4096))]
    assert len({r.sequence_id for r in rows}) <= best_fit_decreasing(Counter(r.length for r in rows), 4096)
    strange = packing.pack_documents(odd, tokenizer_path()).collect()
    check_packing(strange, 4096)
    assert sum(r.piece == 0 for r in strange) == odd.count() and max(r.piece for r in strange) == 7
    assert packing.pack_documents(odd.limit(0), tokenizer_path()).count() == 0


# --- 5 secrets ---
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(found, key=lambda x: (x[0], secrets.KINDS.index(x[1]))))


def brute_random(text, model):
    """All spans, from the pairs of characters one at a time."""
    base = [x.split(":") for x in brute_secrets(text).split(",") if x]
    rest = list(text)
    for _, s, e in base:
        rest[int(s) : int(e)] = " " * (int(e) - int(s))
    rest = "".join(rest)

    def likely(x):
        at = [secrets.ALPHABET.index(c) for c in x]
        ratio = sum(model.table[a * len(secrets.ALPHABET) + b] for a, b in zip(at, at[1:])) / 1000.0 / (len(at) - 1)
        return ratio > model.thresholds[max(k for k, least in enumerate(secrets.LENGTHS) if least <= len(x))]

    found = [(int(s), secrets.KINDS.index(k), int(e)) for k, s, e in base]
    for m in re.finditer(secrets.CANDIDATE, rest):
        if likely(m[0]):
            found.append((m.start(), 3, m.end()))
        elif re.search("[/_=-]", m[0]):
            found += [(m.start() + p.start(), 3, m.start() + p.end()) for p in re.finditer(secrets.PART, m[0]) if likely(p[0])]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


@pytest.fixture(scope="module")
def secret_model(docs):
    return secrets.train(secrets.labelled_samples(docs))


def test_secret_models_on_strings_kept_back(docs, secret_model):
    """Precision and recall on the samples that the models have not seen."""
    found = secrets.measured(secrets.labelled_samples(docs), secret_model).collect()
    right, wrong, all_ = (sum(f(r) for r in found) for f in (lambda r: r.flagged * r.random, lambda r: r.flagged * (not r.random), lambda r: r.n * r.random))
    assert right / all_ > 0.97 and right / (right + wrong) > 0.99


def test_random_spans_against_brute_force(spark, docs, secret_model):
    rng = np.random.default_rng(4)
    token = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), n))
    plain = ["-" * 28, "DEFAULT_CONNECTION_TIMEOUT_SECONDS", "AbstractSingletonProxyFactoryBean", "/usr/local/share/applications/config", "9807915762804490", "a_perfectly_ordinary_long_identifier_name", "=" * 300, "internationalization"]
    made = [f"é {token(16)} x", f"four_words_of_text={token(20)}", f"{token(14)}/{'-' * 40}/some/ordinary/path/with/{token(24)}", f"token={token(10)}/{token(30)} {token(40)}", "AKIA" + "Q7" * 12 + "-" + token(18), token(3000), " ".join(token(12) for _ in range(300))]
    texts = [*plain, *made, *[r.text or "" for r in docs.limit(60).collect()]]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.s for r in secrets.scan(frame, secret_model).select("i", secrets.joined(F.col("secret_spans")).alias("s")).collect()}
    assert all(got[i] == brute_random(x, secret_model) for i, x in enumerate(texts))
    assert not any(got[i] for i in range(len(plain))) and all(got[len(plain) + i] for i in range(len(made)))


def test_secret_columns_may_have_other_names(spark, secret_model):
    frame = spark.createDataFrame([("token = abcdef123", 1, 2)], "text string, base_spans int, secret_spans int")
    r = secrets.scan(frame, secret_model, base_column="b", spans_column="s").first()
    assert (r.base_spans, r.secret_spans, len(r.b), len(r.s)) == (1, 2, 1, 1) and len(secrets.scan(frame, secret_model).first().secret_spans) == 1


def test_secrets(spark, docs, odd, secret_model):
    model = secret_model
    hexes = "0123456789abcdef" * 2
    texts = [
        'token = "abcdef123456"', "token=token:abcdefgh password: x secret = longenough1", "é😀 api_key:ABCDEF12 APIKEY='zzzzzz'", f"{hexes} {hexes}x{hexes[:23]}", "AKIA" + "A" * 16 + " AKIA" + "B" * 15 + " xAKIA" + "C" * 30, "passwd='a' Passwd  =  'abcdefg'", "", "plain words only here",
        " ".join(["token = abcdefgh1"] * 300), f"token={hexes}", "Kq7Zx9Lm2Wv8Rt4Yp6Nb3Hd5Jc1Gf", "a_perfectly_ordinary_long_identifier_name thinking_about_something",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("extra", F.lit(1))
    found = secrets.scan(frame, model).withColumn("clean", secrets.redacted(F.col("text"), F.col("secret_spans"))).select("i", "text", secrets.joined(F.col("base_spans")).alias("base"), secrets.joined(F.col("secret_spans")).alias("all"), "clean").collect()
    for r in found:
        assert r.base == brute_secrets(r.text), r.text
        assert {x for x in r.base.split(",") if x} <= set(r["all"].split(","))
        spans = sorted(tuple(map(int, s.split(":")[1:])) for s in r["all"].split(",") if s)
        out, at = "", 0
        for s, e in spans:
            if s >= at:
                out += r.text[at:s] + secrets.MASK
            at = max(at, e)
        assert r.clean == out + r.text[at:]
    by = {r.i: r["all"] for r in found}
    assert "random:" in by[10] and "random" not in by[11] and by[7] == ""
    assert secrets.scan(odd, model).count() == odd.count() and secrets.scan(odd.limit(0), model).count() == 0
    nothing = secrets.train(secrets.labelled_samples(odd.limit(0)).limit(0))
    assert secrets.scan(frame, nothing).filter("size(secret_spans) <> size(base_spans)").count() == 0


# --- 6 embeddings ---
def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16))
    for i in range(0, 120, 4):
        x[i + 1 : i + 4] = x[i] + rng.standard_normal((3, 16)) * 0.12
    x[200:260] = x[200] + rng.standard_normal((60, 16)) * 0.02
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [1.0, None] * 8), (304, []), (305, rows[0][1]), (306, rows[0][1][:8]), (None, rows[0][1]), (305, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("root", F.lit(0))
    got = {r.vec_id: r for r in embeddings.linked(frame, embeddings.EmbeddingParams(recall=0.99999, chunk=16)).collect()}
    full = {k: np.array(v, np.float32).astype(float) for k, v in rows if k is not None and (k < 300 or k == 305)}
    ids = sorted(full)
    y = np.array([full[k] / np.linalg.norm(full[k]) for k in ids])
    near = (y @ y.T >= 0.95) & ~np.eye(len(ids), dtype=bool)
    assert {k: got[k].n_links for k in ids} == dict(zip(ids, near.sum(1).tolist(), strict=True))
    root = dict(zip(ids, ids, strict=True))
    for _ in ids:
        for i, j in zip(*np.nonzero(near), strict=True):
            low = min(root[ids[i]], root[ids[j]])
            root[ids[i]] = root[ids[j]] = low
    assert {k: got[k].component_id for k in ids} == root and all(got[k].n_links == 0 and got[k].kept for k in (300, 301, 302, 303, 304))
    assert embeddings.linked(frame.limit(0)).count() == 0


def test_equal_vectors_and_text_ids(spark):
    """Copies are counted without being compared; ids that are texts are ordered as texts."""
    rng = np.random.default_rng(6)
    one, two = rng.standard_normal((2, 8))
    rows = [(f"k{i:04}", one.tolist()) for i in range(600)] + [("a", (one + 0.01 * two).tolist()), ("z", two.tolist())]
    got = {r.vec_id: r for r in embeddings.linked(spark.createDataFrame(rows, "vec_id string, embedding array<double>"), embeddings.EmbeddingParams(chunk=16)).collect()}
    assert {got[f"k{i:04}"].n_links for i in range(600)} == {600} and got["a"].n_links == 600 and got["z"].n_links == 0
    assert {got[k].component_id for k in got if k != "z"} == {"a"} and sorted(k for k in got if got[k].kept) == ["a", "z"]


def test_learned_codes_are_balanced():
    rng = np.random.default_rng(0)
    x = embeddings.unit_rows(rng.standard_normal((2000, 16)) + 0.3)
    q = embeddings.learn(x, 2000, 16, embeddings.EmbeddingParams())
    signs = (x - q.mean) @ q.rotations[0] >= 0
    assert np.abs(signs.mean(0) - 0.5).max() < 0.15 and np.allclose(q.rotations[0] @ q.rotations[0].T, np.eye(16))


def threshold_twins(norm, n, width=64, seed=0):
    """n vectors whose mean has the given norm, and for each one at cosine 0.951."""
    rng = np.random.default_rng(seed)
    mean, (r, z) = np.zeros(width), rng.standard_normal((2, n, width))
    mean[0], r[:, 0], z[:, 0] = norm, 0, 0
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    z -= (z * r).sum(1, keepdims=True) * r
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = max(-1.0, (0.951 - norm**2) / (1 - norm**2))
    return mean + np.sqrt(1 - norm**2) * r, mean + np.sqrt(1 - norm**2) * (c * r + np.sqrt(1 - c * c) * z)


@pytest.mark.parametrize("norm", [0.0, 0.7, 0.85, 0.9, 0.97])
def test_tables_find_pairs_of_off_centre_vectors(norm):
    learned = embeddings.learn(threshold_twins(norm, 3000)[0], 1_000_000, 64, embeddings.EmbeddingParams())
    one, two = threshold_twins(norm, 3000, seed=5)
    assert (learned.substrings(one) == learned.substrings(two)).any(1).mean() > 0.99


@pytest.mark.parametrize("norm", [0.0, 0.85])
def test_recall_against_brute_force(spark, norm):
    x = np.concatenate(threshold_twins(norm, 1500)).astype(np.float32)
    got = embeddings.linked(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    links = int((y @ y.T >= 0.95).sum()) - len(y)
    assert links >= 3000 and 0.99 * links < sum(r.n_links for r in got) <= links


# --- 7 languages ---
@pytest.mark.parametrize("block", [8, 1, 3])
def test_languages_on_held_out_documents(spark, large_docs, odd, block):
    """Learned from the others, judged on the held-out ones, with languages in one block or several."""
    model = langid.fit(large_docs.filter(~common.held_out("doc_id")), langid.LanguageParams(block=block))
    held = langid.identify(large_docs.filter(common.held_out("doc_id") & F.col("lang").isNotNull()), model, keep=["doc_id", "lang"]).collect()
    assert len(held) > 150 and len(model.blocks) == -(-len(model.languages) // block)
    assert np.mean([r.lang_pred == r.lang for r in held if r.lang_pred != "und"]) > 0.98 and all(0 <= r.score <= 1 for r in held) and np.mean([r.rejected for r in held if r.lang_pred != "und"]) < 0.05
    strange = langid.identify(odd.withColumn("lang_pred", F.lit(1)), model).collect()
    assert len(strange) == odd.count()
    by = {r.doc_id: r for r in strange}
    assert by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == "und" and by[7].lang_pred in model.languages and by[3].rejected


def test_foreign_languages_are_rejected(spark, large_docs):
    model = langid.fit(large_docs.filter(~common.held_out("doc_id")))
    foreign = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan ja heille on annettu järki ja omatunto", "Все люди рождаются свободными и равными в своём достоинстве и правах",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van az emberek ésszel és lelkiismerettel bírván", "xq zvk wqj qqz kkxw vvzq jxq wzzk qkx vjw zxqv kqqj wvx",
    ]
    assert all(r.rejected for r in langid.identify(spark.createDataFrame(list(enumerate(foreign)), "i int, text string"), model).collect())


def test_no_language(spark, odd):
    none = langid.fit(odd.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"} and langid.identify(odd.limit(0), none).count() == 0


def test_kneser_ney_sums_to_one():
    counts_ = Counter()
    for word in "banana bandana cabana anna ban can".split():
        counts_.update(langid._strings(word, 3))
    characters = sorted({c for s in counts_ for c in s})
    model = langid.KneserNey(dict(counts_), 3, len(characters) + 1)
    for context in ("ba", "an", " b", "na", "xx", ""):
        total = sum(model.of(context + c) for c in characters) + model.of(context + "\0")
        assert total == pytest.approx(1.0, abs=0.02), context
    merged = langid.build({"x": dict(counts_)}, 3, len(characters) + 1)
    logp, n = merged.words([b"banana", b"q1,Ban"])
    expected = sum(np.log(model.of(s)) for s in langid._strings("banana", 3))
    assert logp[0, 0] == pytest.approx(expected, rel=1e-5) and n.tolist() == [7, 2 + 4]


# --- 8 substrings ---
def brute_removed(rows, length):
    seen, out = set(), {}
    for k, text in sorted(rows):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            window = tuple(w[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        out[k] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


@pytest.mark.parametrize("hot", [500, 20, 1])
def test_substrings(spark, hot):
    """Also where shards are dealt anew, once or down to whole windows."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    passages = [" ".join(rng.choice(words, 30)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choice(words, int(rng.integers(0, 25)))), str(rng.choice(passages)), " ".join(rng.choice(words, int(rng.integers(0, 25))))]
        rows.append((i, " ".join(parts)))
    rows += [(60, rows[5][1]), (61, "same " * 90), (62, "a b " * 40), (66, "x " + "a b c d e " * 30), (67, "y z " + "b c d e a " * 20 + "q"), (68, passages[0] + " " + passages[0]), (63, None), (64, ""), (65, "short text")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.removed(spark.createDataFrame(rows, "doc_id long, text string"), substrings.SubstringParams(hot=hot)).collect()}
    assert got == brute_removed(rows, 20)


def test_substrings_odd_inputs(spark, odd):
    got = substrings.removed(odd).collect()
    assert len(got) == odd.count() and substrings.removed(odd.limit(0)).count() == 0
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[6][0].n_removed == 29999 and [(x.first, x.end) for x in by[6][0].spans] == [(1, 30000)]
    assert [r.n_removed for r in by[2]] == [0, 0] and by[3][0].n_words == 0


def test_suffix_automaton():
    assert substrings.repeated_windows([b"a b c d", b"x a b c y", b"b c d a b c d"], 3) == [[], [1], [0, 3, 4]]
    a = substrings.SuffixAutomaton()
    for c in [1, 2, 3, 1, 2]:
        a.extend(c)
    assert a.match([1, 2, 3, 9, 3, 1, 2, 2]) == [1, 2, 3, 0, 1, 2, 3, 1]


@pytest.mark.parametrize("words", [200_000, 40])
def test_reference_is_broadcast(spark, words):
    """In one shard, and in several, with a text that is cut."""
    rng = np.random.default_rng(4)
    passages = [" ".join(f"w{i}" for i in rng.integers(0, 60, 70)) for _ in range(4)]
    rows = [(1, f"x y {passages[0]} z"), (2, "nothing"), (3, None), (4, " ".join(passages[1].split()[30:60]) + " end"), (5, " ".join(passages[2].split()[:19])), (1, "another text"), (6, passages[3])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    reference = spark.createDataFrame([(f"before {p} after",) for p in passages[:3]] + [(None,), ("",)], "text string")
    known = {tuple(w[i : i + 20]) for p in passages[:3] for w in [["before", *p.split(), "after"]] for i in range(len(w) - 19)}
    expected = []
    for _, text in rows:
        w = (text or "").split()
        gone = {j for i in range(len(w) - 19) if tuple(w[i : i + 20]) in known for j in range(i, i + 20)}
        expected.append((len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = substrings.removed_by_reference(frame, reference, substrings.SubstringParams(reference=words)).collect()
    assert sorted((r.n_removed, r.kept) for r in got) == sorted(expected) and expected[0] == (70, "x y z")
    assert substrings.removed_by_reference(frame, reference.limit(0)).filter("n_removed > 0").count() == 0


# --- 9 decontamination
def test_leaks(spark, odd):
    question = "a farmer named Alice has 12 apples and gives 5 apples to her friend Bob who lives 30 km away from town"
    other = question.replace("Alice", "Clara").replace("Bob", "Peter").replace("12", "45").replace(" 5 ", " 9 ").replace("30", "8")
    twisted = other.replace("9 apples", "45 apples").replace("8 km", "45 km").replace("Peter", "Clara")  # several values of the item as one
    benchmark = spark.createDataFrame([(1, question), (2, "completely different words that never occur in any of the documents at all here"), (3, None), (4, "What is 12?"), (5, "..."), (None, question)], "item_id long, text string")
    rows = [(10, f"some words before. {question} and after"), (11, f"Intro text here. {other}. The end"), (12, "nothing to see " * 9), (13, None), (14, ""), (15, question[:40]), (16, f"Intro text here. {twisted}. The end"), (17, "They ask: what is 12? ..."), (18, "What is 13?"), (None, "what is 12")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("hash", F.lit("x")).withColumn("item", F.lit(2))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(frame, benchmark).collect()}
    # a short item is matched with its values, a template not where its slots contradict one another
    assert set(got) == {(10, 1), (11, 1), (17, 4), (None, 4)}
    assert {r.doc_id for r in decontaminate.without_leaks(frame, benchmark).collect()} == {12, 13, 14, 15, 16, 18, None}
    assert decontaminate.find_leaks(odd, benchmark.limit(0)).count() == 0 and decontaminate.find_leaks(odd.limit(0), benchmark).count() == 0 and decontaminate.find_leaks(odd, benchmark).count() == 0
    named = decontaminate.find_leaks(frame.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), benchmark.withColumn("item_id", F.concat(F.lit("i"), "item_id"))).collect()
    assert {(r.doc_id, r.item_id) for r in named} == {("d10", "i1"), ("d11", "i1"), ("d17", "i4"), (None, "i4")}
    # few bits let more windows through to the join, which tells them apart
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, benchmark, decontaminate.LeakParams(bits=4)).collect()} == set(got)


def test_one_binding_for_a_document_and_item(spark):
    """Halves of an item with other values each do not count together; the same values do."""
    first = "in the small shop 12 boxes of ripe fruit were brought by Bob to the old market square"
    second = "while the good friend of Bob and of Alice sold the other 12 boxes on the far side of town"
    swap = lambda text, *pairs: " ".join(dict(pairs).get(w, w) for w in text.split())
    between = " and then something else was said for a while before it went on with the rest of it " * 2
    one = swap(first, ("12", "45"), ("Bob", "Peter"))
    same = swap(second, ("12", "45"), ("Bob", "Peter"), ("Alice", "Eva"))
    apart = swap(second, ("12", "77"), ("Bob", "Karl"), ("Alice", "Eva"))
    benchmark = spark.createDataFrame([(1, f"{first} {second} and nobody knew what the price of it all would be when the long day was over at last for them")], "item_id long, text string")
    rows = [(1, one + between + same), (2, one + between + apart)]
    got = {r.doc_id: r.share for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark, decontaminate.LeakParams(share=0.05)).collect()}
    assert got[1] > 1.6 * got[2]


def brute_leaks(docs, items, window=8, share=0.5, run=3):
    """Items with plain words, numbers and names inside sentences only, word by word: for each the best place in the document. A value stands for what it most often meets there, in runs of agreeing words; what two values stand for does not count."""
    kind = lambda w: "#" if w.isdigit() else "@" if w[:1].isupper() else w
    out = set()
    for d, text in docs:
        w = text.split()
        for k, item in items:
            x = item.split()
            for at in range(-len(x) + 1, len(w)):
                ok = [0 <= at + i < len(w) and kind(a) == kind(w[at + i]) for i, a in enumerate(x)]
                ok = [any(all(ok[j : j + run]) for j in range(max(0, i - run + 1), i + 1) if j + run <= len(x)) for i in range(len(x))]
                slots = [i for i, a in enumerate(x) if ok[i] and kind(a) != a]
                met = defaultdict(list)
                for i in slots:
                    met[x[i]].append(w[at + i])
                stands = {a: max(bs, key=lambda b: (bs.count(b), -bs.index(b))) for a, bs in met.items()}
                stands = {a: b for a, b in stands.items() if list(stands.values()).count(b) == 1}
                for i in slots:
                    ok[i] = stands.get(x[i]) == w[at + i]
                good = sum(all(ok[i : i + window]) for i in range(len(x) - window + 1))
                if good >= share * (len(x) - window + 1):
                    out.add((d, k))
    return out


def test_reparameterised_items_against_brute_force(spark):
    rng = np.random.default_rng(12)
    words = [f"w{c}{d}" for c in "abcdefghijklmnop" for d in "qrstuvwxyz"]
    names, numbers = ["Anna", "Bert", "Carl", "Dora", "Emil", "Fritz"], [str(n) for n in range(10, 99)]

    def text(n):
        return [str(rng.choice(names) if (r := rng.random()) < 0.1 else rng.choice(numbers) if r < 0.2 else rng.choice(words)) for _ in range(n)]

    items = [(k, " ".join(["start", *text(int(rng.integers(14, 40)))])) for k in range(25)]
    docs = []
    for d in range(150):
        body = text(int(rng.integers(0, 60)))
        if d % 3:
            item = items[int(rng.integers(0, 25))][1].split()
            swap = dict(zip([*names, *numbers], [*rng.permutation(names).tolist(), *rng.permutation(numbers).tolist()], strict=True))
            copy = [swap.get(w, w) for w in item]
            if d % 3 == 2:
                copy = [str(rng.choice(names)) if w in names else str(rng.choice(numbers)) if w in numbers else w for w in item]
            body += copy + text(10)
        docs.append((d, " ".join(["begin", *body])))
    expected = brute_leaks(docs, items)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), decontaminate.LeakParams(covered=2.0)).collect()}
    assert len(expected) > 50 and any(d % 3 == 2 for d, _ in expected) and got == expected


def test_leaks_in_documents(spark, docs, data):
    items = table(spark, data, "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    texts = {r.item_id: r.text for r in items.collect()}
    assert got == {(d.doc_id, k) for d in docs.collect() for k, t in texts.items() if t in (d.text or "")}


def test_leaks_of_names_and_replaced_words(spark):
    asked = "Tom has 5 apples and 3 pears. Tom gives 2 apples to his friend. How many apples does Tom have left?"
    short = "Tom has 5 red apples. He finds 3 ripe pears. Sue takes 2 sour plums. What does Tom have left?"
    names = "yesterday O'Neil sold 40 old tools to McKay and then J. Lee from the USA bought 7 more of them"
    plain = "the quick brown fox jumps over the lazy dog near the old stone bridge at dawn every single morning"
    few = "all small green boats drift slowly past another quiet harbour wall"
    told = "It happened on 9 May. There were no apples left. Tom was sad, and many friends have asked him why."
    benchmark = spark.createDataFrame(list(enumerate([asked, short, names, plain, few], 1)), "item_id long, text string")
    changed = lambda text, *pairs: " ".join(dict(pairs).get(w, w) for w in text.split())
    rows = [
        (1, changed(asked, ("Tom", "Bob"), ("5", "8"), ("3", "4"), ("2", "6"))),
        (2, changed(short, ("Tom", "Bob"), ("Sue", "Ann"), ("5", "8"), ("3", "4"), ("2", "6"))),
        (3, changed(names, ("O'Neil", "Baker"), ("McKay", "O'Hara"), ("J.", "K."), ("Lee", "Fox"), ("USA", "UK"), ("40", "60"), ("7", "9"))),
        (4, changed(plain, ("dog", "cat"))),
        (5, changed(few, ("slowly", "gently"))),
        (6, "so " + asked.lower()),
        (7, told), (8, told.upper()), (9, "THIS TEXT IS ALL IN CAPITALS AND HAS NOTHING OF THE ITEMS IN IT AT ALL " * 4), (10, "all small green boats drift away"),
    ]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 1)}


# --- 10 chat ---
def test_reply_trees(spark):
    rows = [
        ("t", 1, None, "user", "hi", 1.0), ("t", 2, 1, "assistant", "good <|im_end|> \\<| x", 5.0), ("t", 3, 1, "assistant", "bad", -1.0), ("t", 4, 2, "user", "more\n|", 0.0), ("t", 5, 4, "assistant", "<", None), ("t", 6, 3, "user", "why", 0.0),
        (None, 1, None, "sys\ntem", None, 1.0), ("u", 7, 99, "user", "orphan", 1.0), ("u", 8, 8, None, "self", 1.0),
    ]
    frame = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double").withColumn("leaf", F.lit(0))
    made = chat.format_trees(frame)
    back = {(r.tree, r.leaf): r for r in chat.read_back(made).collect()}
    assert set(back) == {("t", 5), ("t", 6), (None, 1), ("u", 7), ("u", 8)}
    long = back["t", 5]
    assert long.rank == 1 and long.roles == ["user", "assistant", "user", "assistant"] and long.texts == ["hi", "good <|im_end|> \\<| x", "more\n|", "<"] and long.loss_texts == ["good <|im_end|> \\<| x", "<"]
    assert back["t", 6].rank == 2 and back[None, 1].roles == ["sys\ntem"] and back[None, 1].texts == [""]
    assert chat.format_trees(frame, top=1).filter("tree = 't'").count() == 1 and chat.format_trees(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.paths(spark.createDataFrame([("c", 1, 2), ("c", 2, 1)], "tree string, node long, parent long"))


def test_repeated_messages_and_long_texts(spark):
    """Of rows that repeat a tree and node one counts; texts of any length come back whole."""
    long = "<|im_end|>\\" * 40_000
    rows = [("t", 1, None, "user", long, 1.0), ("t", 1, None, "user", long, 1.0), ("t", 2, 1, "assistant", "b", 1.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", None, 1, "user", "x", 1.0)]
    got = chat.read_back(chat.format_trees(spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double"))).collect()
    assert [(r.roles, r.texts) for r in got] == [(["user", "assistant"], [long, "a"])]


def test_long_chain(spark):
    chain = spark.range(1, 301).select(F.lit("c").alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(1.0).alias("score"))
    r = chat.read_back(chat.format_trees(chain)).first()
    assert r.leaf == 300 and r.texts == [str(i) for i in range(1, 301)] and r.score == 300.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<|x"]), st.text(alphabet="ab<|>\\\n _im_end", max_size=20)), min_size=1, max_size=8))
def test_chat_round_trip(spark, turns):
    frame = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.format_trees(chat.linear(frame))).first()
    assert list(zip(r.roles, r.texts, strict=True)) == turns and r.loss_texts == [t for role, t in turns if role == "assistant"]
    for s in r.loss_spans:
        assert hashlib.sha256(r.formatted[s.start : s.end].encode()).digest()
