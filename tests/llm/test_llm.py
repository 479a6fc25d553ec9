"""Training-data operators: SQL, brute force, exact round trips, held-out labels, and the odd cases of every operator."""

from __future__ import annotations

import collections
import hashlib
import sys
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import public_tokenizers  # noqa: E402
import regex  # noqa: E402
import tiktoken  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from loomgraph.llm import ann, bpe, chat, common, exact_dedup, minhash, mixing, quality, substrings, toxicity, url_filter  # noqa: E402
from loomgraph.llm.plans import QUERIES, RANKS, SQL  # noqa: E402

SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
DOCS = "doc_id long, text string, source string, lang string, n_chars long, digest string, row string, h int, key string, v int, a int"


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr), [columns[i] for i in order]


def documents(spark, texts, ids=None, sources=None):
    """Documents with columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, s, "en", 1, "x", "y", 1, "z", 2, 3) for i, t, s in zip(ids, texts, sources, strict=True)], DOCS)


def words(seed, n, pool=5000):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, pool, n)]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = QUERIES[name](spark, SMALL)
    cur = con.execute(SQL[name])
    assert rows_of(got.columns, got.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("lower", [False, True])
def test_words_of_slices_and_pieces(lower):
    texts = ["a B c", None, "", " d  E ", "F\tg\nh", "é\u00a0É x"] * 3
    fold = lambda t: (t or "").encode().lower().split() if lower else (t or "").encode().split()
    whole = pa.array(texts)
    for part, want in [(whole, texts), (whole.slice(4), texts[4:]), *zip(common.pieces(whole, 8), [texts[a:b] for a, b in common.slices(np.array([len((t or "").encode()) for t in texts]), 8)], strict=True)]:
        codes, ends, found = common.split_words(part, lower=lower)
        assert [[found[c] for c in codes[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)] == [fold(t) for t in want]


# ---- 1

def test_bpe_against_the_library(spark):
    found = {r.doc_id: r for r in bpe.decode(bpe.encode(spark.read.parquet(f"{SMALL}/documents.parquet"), RANKS, public_tokenizers.PATTERN), RANKS).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        assert found[r.doc_id].ids == LIBRARY.encode_ordinary(r.text)
        assert bytes(found[r.doc_id].decoded) == r.text.encode()


def test_bpe_odd_cases(spark):
    texts = [None, "", " ", "  two  spaces \n\n x", "it's we'LL", "日本語 текст x", "a" * 30_000, "ab c" * 5000, "same", "same"]
    docs = documents(spark, texts, ids=[*range(8), 8, 8])
    got = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == collections.Counter(
        (i, tuple(LIBRARY.encode_ordinary(t or "")), (t or "").encode()) for i, t in zip([*range(8), 8, 8], texts, strict=True))
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []
    assert bpe.encode(documents(spark, ["x"], ids=[None]), RANKS, public_tokenizers.PATTERN).first().doc_id is None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Z'sl \n\t 　é9.日\x1c\x85"), max_size=30), max_size=4))
def test_pretokens_are_the_patterns_matches(texts):
    pattern, known = regex.compile(public_tokenizers.PATTERN), {}
    stream, counts = bpe.pretokens(pa.array(texts, pa.string()), pattern, known)
    names, at = list(known), 0
    for text, n in zip(texts, counts, strict=True):
        assert [names[c] for c in stream[at : at + n]] == pattern.findall(text)
        at += n


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=120))
def test_merges_are_the_librarys(text):
    ranks = bpe.read_ranks(RANKS)
    assert [i for w in regex.findall(public_tokenizers.PATTERN, text) for i in bpe.merge_word(w.encode(), ranks)] == LIBRARY.encode_ordinary(text)


# ---- 2

def test_url_rules(spark):
    urls = [None, "no address", "http://A.Net/x", "http://a.example.net/en/1", "http://example.com/de/", "http://x.org/fr/a?b", "http://net", "http://xnet/", "http://b.org/en/", "http://b.org/en/"]
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls)], "page_id long, url string, n int, site int")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert [got[i].rule for i in range(10)] == [None, None, "net/", "example.net/en/", "example.com/de/", "org/fr/", None, None, None, None]
    assert [got[i].verdict for i in (2, 3, 4, 5)] == ["block", "allow", "block", "allow"]
    assert (got[2].host, got[2].path) == ("a.net", "/x") and (got[0].host, got[0].path) == ("", "") and got[8].verdict == got[9].verdict
    assert url_filter.judge(pages.limit(0)).collect() == []


def test_url_models_are_planned_once(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://example.org/fr/y"), (3, "http://b.com/z")], "page_id long, url string")
    judged = url_filter.judge(pages)
    assert judged._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") <= 2
    assert any("url-scores" in path for path in judged.inputFiles())


def test_url_models_tell_classes_apart(spark):
    good = [(i, f"http://site{i % 7}.example.net/en/{i}") for i in range(100)]
    bad = [(100 + i, f"http://zzqq{i % 7}.net/kk/{i}") for i in range(100)]
    asked = [(200, "http://site3.example.com/en/5"), (201, "http://zzqq3.com/kk/5")]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(good + bad + asked, "page_id long, url string")).collect()}
    assert got[200] == "allow" and got[201] == "block"


# ---- 3

def exact_expected(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    least = lambda i: -1 if i is None else i
    return collections.Counter((i, max(groups[t or ""], key=least), len(groups[t or ""])) for i, t in rows)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.length(t) % 3])
def test_exact_dedup(spark, digest):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (None, "a"), (6, "ab"), (7, "ba"), (8, "x" * 100_000), (9, "x" * 100_000), (9, "x" * 100_000), (None, "lone")]
    got = exact_dedup.dedup(documents(spark, [t for _, t in rows], ids=[i for i, _ in rows]), digest=digest).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == exact_expected(rows)
    assert sum(r.kept for r in got) == len({t or "" for _, t in rows})
    assert {r.text_sha256 for r in got} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}


def test_exact_dedup_empty(spark):
    assert exact_dedup.dedup(documents(spark, ["x"]).limit(0)).collect() == []


def test_exact_state_goes_on(spark):
    """A second batch of arrivals meets the state that the first one left."""
    inbox, state, out = (common.shared_path(spark, n) for n in ("inbox", "state", "out"))
    schema = "doc_id long, digest string, locator long"
    for batch in ([(1, "d", 0), (2, "e", 1)], [(3, "d", 2), (0, "e", 3)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(inbox)
        exact_dedup.keeper_state(spark.readStream.schema(schema).parquet(inbox), state, out)
    assert {(r.digest, r.n, r.keeper.doc_id) for r in exact_dedup.latest(spark, out).collect()} == {("d", 2, 3), ("e", 2, 2)}


# ---- 4

def test_targets_and_draws(spark):
    texts = [" ".join(words(i, n)) for i, n in enumerate([50, 900, 3, 0, 120, 77, 300, 41])] + [None]
    sources = ["b", "a", None, "c", "é", "a", "b", "z", "a"]
    docs = documents(spark, texts, sources=sources)
    sizes = mixing.measured(docs)
    goal = mixing.targets(sizes)
    per = collections.Counter()
    for t, s in zip(texts, sources, strict=True):
        per[s] += len((t or "").split())
    names = sorted([s for s in per if s is not None]) + [None]
    want = dict(zip(names, mixing.share_of(mixing.WEIGHTS, [per[s] for s in names]), strict=True))
    assert {r.source: r.target for r in goal.collect()} == pytest.approx({s: float(x) for s, x in want.items()})
    draws = mixing.mix(sizes, goal, block_words=16, bucket=10, shard=12, fan=3)
    rows = draws.collect()
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += r["take"]
        assert 0 < r["take"] <= 16
    assert all(taken[s] == round(want[s]) for s in names)
    assert len({(r.row, r["pass"], r.block) for r in rows}) == len(rows)
    sizes_of = collections.Counter(r.shard for r in rows)
    assert max(sizes_of.values()) - min(sizes_of.values()) <= len(sizes_of) and len(sizes_of) > 3
    assert {(r.shard, r.position) for r in rows} == {(s, p) for s, n in sizes_of.items() for p in range(n)}
    by_row = collections.Counter()
    for r in rows:
        by_row[r.row] += r["take"]
    assert all(by_row[r.row] <= 2 * r.size for r in sizes.collect())
    assert sorted(map(tuple, mixing.mix(sizes, goal, block_words=16, bucket=10, shard=12, fan=3).collect())) == sorted(map(tuple, rows))


def test_mix_without_words_or_rows(spark):
    for docs in (documents(spark, [None, "", " "]), documents(spark, ["x"]).limit(0)):
        sizes = mixing.measured(docs)
        goal = mixing.targets(sizes)
        got = mixing.taken(sizes, goal, mixing.mix(sizes, goal)).collect()
        assert all((r.taken, r.target, r.size) == (0, 0.0, 0) for r in got) and len(got) == docs.count()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2000), min_size=1, max_size=6), st.integers(1, 40), st.integers(2, 6), st.integers(0, 9))
def test_deal_adds_up(quotas, leaves, fan, seed):
    out = mixing.deal(quotas, leaves, fan, np.random.default_rng(seed))
    assert [sum(got[s] for _, got in out) for s in range(len(quotas))] == quotas and sum(n for n, _ in out) == leaves
    assert all(abs(sum(got) - sum(quotas) * n / leaves) <= 1 for n, got in out) and all(g >= 0 for _, got in out for g in got)


def test_large_hypergeometric_keeps_its_bounds():
    rng = np.random.default_rng(1)
    for good, bad, drawn in ((3, 10**10, 10**9), (10**10, 3, 10**10 + 1), (10**10, 10**10, 10**10)):
        got = mixing.hypergeometric(rng, good, bad, drawn)
        assert max(0, drawn - bad) <= got <= min(good, drawn)


def test_mixed_texts(spark):
    docs = documents(spark, [" ".join(words(i, 40)) for i in range(6)], sources=list("aabbcc")).withColumn("nth", F.monotonically_increasing_id())
    docs = common.frozen(docs, "rows")
    sizes = mixing.measured(docs, row_col="nth")
    draws = common.frozen(mixing.mix(sizes, mixing.targets(sizes), block_words=8), "d")
    texts = mixing.mixed_texts(docs, draws, "nth").collect()
    assert sum(len(r.text.split()) for r in texts) == draws.agg(F.sum("take")).first()[0]
    own = {r.nth: r.text.split() for r in docs.collect()}
    for r in texts:
        assert not collections.Counter(r.text.split()) - collections.Counter(own[r.nth])


# ---- 5

def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    test = labels.where("doc_id % 4 = 0")
    got = quality.judged(docs, labels.where("doc_id % 4 <> 0")).select("doc_id", "_score").join(test, "doc_id").collect()
    right = [(r._score >= 0.5) == (r.quality == 1) for r in got]
    assert np.mean(right) > 0.95 and sum(r._score < 0.5 for r in got if r.quality == 1) <= 0.02 * len(got)


def test_sparse_sites_keep_to_their_prior(spark):
    rows = [("h1", "a", 1000.0, 900.0), ("h1", "b", 1.0, 0.0), ("h2", "a", 1000.0, 100.0), (None, None, 1.0, 1.0), ("h3", None, 500.0, 480.0)]
    got = {(r.h, r.p): r for r in quality.posteriors(spark.createDataFrame(rows, "h string, p string, n double, good double")).collect()}
    base = got[("h1", "a")]._global
    assert abs(got[("h1", "a")]._path - 0.9) < 0.02 and got[("h1", "b")]._path > 0.3 and got[("h2", "a")]._path < 0.2
    assert 0 < got[(None, None)]._path < 1 and abs(base - 1481.5 / 2503) < 0.01


def test_quality_odd_cases(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, [None, "", "one two", "x" * 50_000, "one two"], ids=[None, 1, 2, 3, 2], sources=[None, "a", "a", "b", "a"])
    got = quality.judged(docs, labels).collect()
    assert len(got) == 5 and all(0 < r._score < 1 for r in got) and set(docs.columns) <= set(quality.judged(docs, labels).columns)
    assert quality.accepted(docs.limit(0), labels).collect() == []


# ---- 6

def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    base = words(1, 200)
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "one two", "ONE two", "one two three", " ".join(base), " ".join(base)])]
    for i in range(8, 60):  # copies of one text with few to many words changed, and chains of copies of copies
        own = list(base) if i % 3 else rows[-1][1].split()
        for at in rng.integers(0, len(own), 1 + i % 9):
            own[at] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(own)))
    rows += [(60 + i, " ".join(words(100 + i, 80))) for i in range(10)]
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    for block in (2_000, 5):
        got = minhash.near_duplicates(docs, block=block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_near(rows)


def test_near_copies_far_from_their_original(spark):
    """Outsiders of a large group: similar to each other, not to the central document."""
    base, rng, rows = words(1, 150), np.random.default_rng(5), []
    for i in range(60):
        own = list(base)
        for at in rng.choice(150, int(rng.integers(1, 4)) if i < 30 else 7, replace=False):
            own[at] = f"y{rng.integers(40)}"
        rows.append((i, " ".join(own)))
        if i >= 50:
            rows.append((100 + i, " ".join([*own[:-1], "end"])))
    want = brute_near(rows)
    for block in (2_000, 11):
        got = minhash.near_duplicates(documents(spark, [t for _, t in rows], ids=[i for i, _ in rows]), block=block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
    assert len({c for _, c, _ in want.values()}) > 3


def test_near_duplicates_odd_ids(spark):
    text = " ".join(words(5, 50))
    got = minhash.near_duplicates(documents(spark, [text, text, text, text + " end", None], ids=[None, 4, 4, 2, None])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(2, 2), (4, 2), (4, 2)]
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert minhash.near_duplicates(documents(spark, ["x"]).limit(0)).collect() == []


def test_near_duplicates_of_ids_with_several_texts(spark):
    """Rows that repeat an id are one node, which links whatever its texts are linked with."""
    a, b, c, d = (" ".join(words(300 + i, 50)) for i in range(4))
    rows = [(5, a), (5, b), (2, b), (9, a + " end"), (7, c), (7, None), (6, c), (8, d), (8, d), (8, d + " end")]
    got = minhash.near_duplicates(documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == sorted((i, {5: 2, 9: 2, 7: 6}.get(i, i), i in (2, 6, 8)) for i, _ in rows)


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(2)
    for share in (0.95, 0.85, 0.75):
        n = 4000
        union = rng.integers(0, 2**63, n, dtype=np.uint64)
        own = int(n * (1 - share) / 2)
        a, b = np.unique(union[: n - own]), np.unique(union[own:])
        x, y = (minhash.odd_sketch(minhash.minhashes(s)) for s in (a, b))
        differ = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        k = minhash.BANDS * minhash.ROWS
        assert abs(1 + minhash.BITS / (4 * k) * np.log(1 - 2 * differ / minhash.BITS) - share) < 0.12


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 163)] + [(5, 3), (3, 9), (7, 7)]
    got = {r.id: r.root for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 164)) and got[5] == got[9] == 3 and 7 not in got


# ---- 7

def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id"), labels).where("held_out").join(labels, "doc_id").collect()
    toxic = [r.predicted for r in got if r.toxic == 1]
    clean = [r.predicted for r in got if r.toxic == 0]
    assert len(toxic) > 40 and np.mean(toxic) > 0.9 and np.mean(clean) < 0.03


def test_toxicity_odd_cases(spark):
    docs = documents(spark, [None, "", "x " * 30_000, "y" * 50_000, "a"], ids=[1, 2, 3, None, 4])
    one_class = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, one_class).collect()
    assert len(got) == 5 and all(r.score == 0 and r.predicted == 0 for r in got)
    net = toxicity.train(["bad idea", "good idea"] * 20, np.array([1, 0] * 20, np.float32))
    scores = net.texts(pa.array([None, "", "bad", "a bad one " + "word " * 500]))
    assert np.isfinite(scores).all() and scores[0] == scores[1]


def test_every_word_is_in_a_window():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        text, first, size = toxicity.windows_of(np.array([0, n]))
        assert set(range(n)) == {f + k for f, s in zip(first, size, strict=True) for k in range(s)} and len(text) >= 1
        assert all(s <= toxicity.WINDOW for s in size)


def test_gradients_are_the_slopes():
    rng = np.random.default_rng(0)
    net = toxicity.Network([b"a", b"bb"])
    net.p = {k: v.astype(np.float64) * (0.1 if k == "gram" else 1) for k, v in net.p.items()}
    given_words, codes = [b"a", b"bb", b"ccc"], rng.integers(0, 3, (5, 4))
    real, label = np.arange(5)[:, None] < np.array([5, 3, 1, 4]), np.array([1, 0, 1, 0.0])

    def loss():
        logit = net.forward(net.inputs(given_words)[0], codes, real)[0].astype(np.float64)
        return np.mean(np.log1p(np.exp(logit)) - label * logit)

    grads = net.gradients(given_words, codes, real, label)
    for name in ("word", "ask", "Wf", "Ub", "cb", "pay", "pick", "out", "bias"):
        at = np.unravel_index(int(np.abs(grads[name]).argmax()), grads[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = loss()
        net.p[name][at] = old - 1e-3
        down = loss()
        net.p[name][at] = old
        assert (up - down) / 2e-3 == pytest.approx(grads[name][at], rel=0.05, abs=1e-5), name


# ---- 8

def brute_spans(rows):
    first, split = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def test_substrings(spark):
    passage, short = words(1, 30, 50), words(2, 13, 50)
    texts = [None, "", " ".join(short), " ".join(short[:12]), "a " * 60, "a " * 40]
    for i in range(25):
        own = words(10 + i, 20 + 7 * i, 40 if i % 2 else 4000)
        texts.append(" ".join(own[:10] + passage[i % 5 : 14 + i % 17] + own[10:] + (short if i % 3 else [])))
    texts += [texts[10], texts[10], texts[12] + " é"]
    rows = list(enumerate(texts))
    got = substrings.remove_repeats(documents(spark, texts), shards=5).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_spans(rows)
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in got)


def test_substrings_odd_ids(spark):
    text = " ".join(words(3, 40))
    got = substrings.remove_repeats(documents(spark, [text, text, text, text], ids=[None, 5, 5, 7])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (5, 0), (5, 0), (7, 40)]
    assert substrings.remove_repeats(documents(spark, ["x"]).limit(0)).collect() == []


def test_substrings_of_ids_with_several_texts(spark):
    """Each text of an id is judged on its own words: a shorter one, one without words, one that is a copy."""
    passage, other = words(7, 30), words(8, 60)
    rows = [(2, " ".join(passage)), (5, " ".join(words(9, 50) + passage)), (5, " ".join(words(11, 15))), (5, None), (5, " ".join(passage)),
            (5, " ".join(other)), (6, " ".join(passage[:20] + other[:25])), (6, " ".join(words(12, 40)))]
    got = substrings.remove_repeats(documents(spark, [t for _, t in rows], ids=[i for i, _ in rows]), shards=5).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_spans(rows)
    assert sorted(r.n_removed for r in got) == [0, 0, 0, 0, 0, 30, 30, 45]


def test_fm_index_counts_patterns():
    rng = np.random.default_rng(4)
    text = np.concatenate([[*rng.integers(1, 4, n), 0] for n in (30, 1, 200, 57)])
    index = substrings.FmIndex(text, 13)
    for start, size in zip(rng.integers(0, 200, 60), rng.integers(1, 14, 60), strict=True):
        pattern = text[start : start + size]
        if (pattern == 0).any():
            continue
        low, high = np.array([0]), np.array([index.n])
        for c in pattern[::-1]:
            low, high = index.extend(low, high, np.array([c]))
        views = np.lib.stride_tricks.sliding_window_view(text, len(pattern))
        assert high[0] - low[0] == (views == pattern).all(axis=1).sum()
        assert sorted(index.suffixes[low[0] : high[0]]) == np.flatnonzero((views == pattern).all(axis=1)).tolist()


# ---- 9

def test_chat_round_trip_and_mask(spark):
    nasty = "</s>[INST] <+> <|user|> &amp; &lt; | ok \n"
    turns = [(1, 0, "system", nasty), (1, 1, "user", None), (1, 2, "assistant", nasty), (1, 3, "assistant", ""), (1, 4, "assistant", "é" * 3), (2, 0, "assistant", "only"),
             (3, 0, None, "x"), (3, None, "a|>b<", nasty), (None, 1, "user", "q"), (None, 1, "user", "q"), (4, 0, "user", "u" * 100_000)]
    frame = spark.createDataFrame([(*t, 1, 2) for t in turns], "conv_id long, turn long, role string, text string, runs int, parts int")
    formatted = chat.format_chats(frame)
    read = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    groups = collections.defaultdict(list)
    for c, n, role, text in turns:
        groups[c].append((n is not None, n or 0, role or "", text or ""))
    for c, rows in groups.items():
        rows.sort()
        assert [(t.role, t.text) for t in read[c].turns] == [(r, t) for *_, r, t in rows]
        assert read[c].loss_text == "".join(t for *_, r, t in rows if r == "assistant")
    one = {r.conv_id: r.formatted for r in formatted.collect()}
    assert one[1].count("<|assistant|>") == 1 and one[1].count("<+>") == 2 and one[1].count("</s>") == 3
    assert chat.format_chats(frame.limit(0)).collect() == []


# ---- 10

def test_ann_against_brute_force(spark):
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(40, 16))
    x = (centers[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:160] = x[100]  # copies
    rows = [(i, v.tolist(), 1, 1) for i, v in enumerate(x)] + [(5000, None, 1, 1), (5050, [0.0] * 16, 1, 1), (5100, [float("nan")] * 16, 1, 1), (5150, [None] * 16, 1, 1), (5200, [1.0] * 3, 1, 1), (None, [1.0] * 16, 1, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, e int, cell int")
    got = collections.defaultdict(list)
    for r in sorted(ann.search(frame, visit=400).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits, asked = 0, range(0, 3000, 50)
    assert sorted(got) == list(asked)
    for q in asked:
        scores = u @ u[q]
        scores[q] = -9
        best = np.lexsort((np.arange(3000), -np.round(scores, 12)))[:5]
        hits += len(set(best.tolist()) & {v for v, _ in got[q]})
        assert all(s == pytest.approx(scores[v], abs=1e-12) for v, s in got[q]) and len(got[q]) == 5
    assert hits >= 0.9 * 5 * len(asked)
    assert [v for v, _ in got[100]] == [101, 102, 103, 104, 105] and [v for v, _ in got[150]] == [100, 101, 102, 103, 104]


def test_ann_few_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id) for r in ann.search(frame).orderBy("rank").collect()] == [(1, 2), (2, 1), (3, 3)]
    assert ann.search(frame.limit(0)).collect() == [] and ann.search(frame.limit(1)).collect() == []


def test_walk_is_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(9), rng.random(7)
    cells = ann.walk(a, b, np.ones(63, int), 63)
    sums = (a[:, None] + b[None]).ravel()
    assert sorted(cells) == list(range(63)) and (np.diff(sums[cells]) >= -1e-12).all()


# ---- pipeline

def test_pipeline(spark):
    """Stage by stage against brute force."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        after = stage(spark, docs, SMALL)
        if name != "tokens":
            assert sorted(after.columns) == sorted(["doc_id", "lang", "n_chars", "source", "text"])
            docs = common.frozen(after, "stage")
            after = docs
        kept[name] = (before, [r.asDict() for r in after.collect()])
    before, after = kept["quality"]
    ids = {r["doc_id"] for r in after}
    assert sum(i not in ids for i, r in labels.items() if r.quality == 1) <= 2 and sum(i in ids for i, r in labels.items() if r.quality == 0) <= 3
    before, after = kept["exact_dedup"]
    last = {}
    for r in before:
        last[r["text"]] = max(r["doc_id"], last.get(r["text"], -1))
    assert {r["doc_id"] for r in after} == set(last.values())
    before, after = kept["near_dedup"]
    want = brute_near([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"] for r in after} == {i for i, (_, _, k) in want.items() if k}
    before, after = kept["mixing"]
    source, own = {r["doc_id"]: r["source"] for r in before}, {r["doc_id"]: r["text"] for r in before}
    per, got = collections.Counter(), collections.Counter()
    for r in before:
        per[r["source"]] += len(r["text"].split())
    for r in after:
        got[source[r["doc_id"]]] += len(r["text"].split())
        assert not collections.Counter(r["text"].split()) - collections.Counter(own[r["doc_id"]].split())
    want = mixing.share_of(mixing.WEIGHTS, [per[s] for s in sorted(per)])
    assert all(abs(got[s] - float(w)) <= 1 for s, w in zip(sorted(per), want, strict=True))
    before, after = kept["tokens"]
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in after) == collections.Counter((r["doc_id"], tuple(LIBRARY.encode_ordinary(r["text"]))) for r in before)


def test_exact_stage_odd_ids(spark):
    """Repeated rows, one id with several texts, rows without an id: one row of each text stays."""
    rows = [(7, "x"), (7, "x"), (3, "x"), (None, "x"), (5, "T1"), (5, "T2"), (9, "T1"), (None, "n"), (None, "n"), (8, None), (8, "")]
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    after = corpus_pipeline.without_copies(spark, docs, SMALL)
    assert after.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in after.collect()), key=repr) == sorted([(7, "x"), (9, "T1"), (5, "T2"), (None, "n"), (8, "")], key=repr)


def test_near_stage_odd_ids(spark):
    """One id with several texts loses only those that a near copy stands for; rows without an id are judged as well."""
    a, b, c, d = (" ".join(words(200 + i, 60)) for i in range(4))
    rows = [(5, a), (5, b), (9, a + " end"), (None, b + " end"), (None, c), (None, c), (2, d), (2, d + " end"), (1, d[:20]), (1, "lone"), (None, ""), (3, None)]
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    after = corpus_pipeline.without_near_copies(spark, docs, SMALL)
    assert after.columns == docs.columns
    got = sorted((r.doc_id or 0, (r.text or "").removesuffix(" end")) for r in after.collect())
    assert got == sorted([(5, a), (5, b), (0, c), (2, d), (1, d[:20]), (1, "lone"), (0, ""), (3, "")])


def test_copies_of_unique_ids_need_no_numbers(spark):
    docs = documents(spark, ["x", "y", "x"], ids=[4, 2, 9])
    assert sorted((r._row, r.doc_id) for r in corpus_pipeline.numbered(docs).collect()) == [(2, 2), (4, 4), (9, 9)]
    assert sorted(r.doc_id for r in corpus_pipeline.without_copies(spark, docs, SMALL).collect()) == [2, 9]
