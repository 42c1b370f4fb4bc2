"""Small fixtures with nulls, empty and repeated rows against brute force; see the operators' docstrings for the defined cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import queries as Q
from strandline.llm.decontaminate import drop_contaminated, find_benchmark_hits
from strandline.llm.embedding_dedup import link_vectors
from strandline.llm.jaccard_join import cluster_documents, keep_one_of_each
from strandline.llm.line_dedup import dedup_lines, drop_repeated_lines
from strandline.llm.lm_score import score_texts
from strandline.llm.packing import Packer, differencing, fill_windows, pack_documents
from strandline.llm.quality import learn_quality, score_quality
from strandline.llm.sharding import assign_shards
from strandline.llm.suffix_dedup import remove_repeated_strings, suffix_order
from strandline.llm.url_filter import Rule, judge_urls

RNG = np.random.default_rng(5)
WORDS = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "Eta", "theta", "iota", "kappa", "lambda", "mu"]
DOC = "doc_id long, text string, lang string, source string, n_chars long, key string"


def prose(n):
    return " ".join(RNG.choice(WORDS, n) + np.array([str(x) for x in RNG.integers(0, 30, n)], object))


BASE = prose(120)
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE + " tail word"), (4, prose(200)), (5, None), (6, ""), (7, "  \n "), (8, "one two"), (9, "one two"), (10, "ONE  two"),
    (11, prose(3000)), (12, "\n".join([prose(12), "the same line of text in many places here now yes", prose(15)])),
    (13, "\n".join([prose(12), "the same line of text in many places here now yes", prose(9)])),
    (14, "\n".join(["the same line of words in many places here now yes", "the same line of text in many places here now", prose(8)])),
    (15, prose(60) + " " + BASE[:300] + " " + prose(60)), (15, prose(30)), (16, BASE), (16, BASE), (None, BASE), (None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in TEXTS]
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def test_url_rules_and_posterior(spark):
    urls = ["http://A.org/x", "https://b.example.org/es/1", "http://example.org/en/12#a", "http://x.com/fr/?q", "http://x.com/de/", None, "no scheme", "http://notorg/x", "ftp://a.org"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(100 + i, "http://bad.net/p") for i in range(60)] + [(200 + i, "http://good.net/p") for i in range(60)], "page_id long, url string")
    bad = spark.createDataFrame([(100 + i, True) for i in range(60)] + [(200 + i, False) for i in range(60)] + [(None, True), (3, None)], "page_id long, bad boolean")
    got = {r.page_id: r for r in judge_urls(pages, bad).collect()}
    assert [got[i].rule for i in range(9)] == ["org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, None, None]
    assert (got[0].host, got[3].path, got[5].host, got[6].path, got[8].path) == ("a.org", "/fr/", "", "", "")
    assert got[100].verdict == "block" and got[200].verdict == "allow"
    none = judge_urls(pages.limit(0), bad.limit(0), rules=(Rule("a/", "block"),))
    assert none.count() == 0
    assert {r.verdict for r in judge_urls(pages, bad.limit(0), rules=()).collect()} == {"allow"}


def brute_hits(items, text, window):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    w, hit, found = split(lower(text)), set(), set()
    for i, t in items:
        v = split(lower(t))
        m = min(window, len(v))
        for a in range(len(v) - m + 1 if m else 0):
            for b in range(len(w) - m + 1):
                if w[b : b + m] == v[a : a + m]:
                    hit |= set(range(b, b + m))
                    found.add(i)
    return len(w), len(hit), sorted(str(i) for i in found if i is not None)


def test_decontamination(spark, docs, empty):
    items = [(1, BASE[:200]), (1, BASE[:200]), (2, "One, two!"), (10, "two"), (3, None), (4, "?!"), (None, prose(12)), (5, "theta iota never seen together so far in any of these texts")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.text, r._sl.n_words, r._sl.n_hit, list(r._sl.item_ids)) for r in find_benchmark_hits(docs, bench, 6).collect()), key=str)
    assert got == sorted(((i, t, *brute_hits(items, t, 6)) for i, t in TEXTS), key=str)
    assert drop_contaminated(docs, bench, 6).columns == docs.columns
    assert find_benchmark_hits(empty, bench).count() == 0
    assert drop_contaminated(docs, bench.limit(0)).count() == len(TEXTS)


def test_language_model(docs, empty):
    got = {}
    for r in score_texts(docs, folds=3).collect():
        got.setdefault(r.doc_id, r)
    train, tokens = Counter(), {}
    for i, t in TEXTS:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["\n"]
        tokens.setdefault(i, w)
        if i is None or zlib.crc32(str(i).encode()) % 3:
            train.update(w)
    n, v = sum(train.values()), len(train)
    for i in (1, 4, 5, 6, 8, 11):
        base = sum(np.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[i])
        assert got[i].base_score == pytest.approx(base) and got[i].n_tokens == len(tokens[i]) and got[i].train_tokens == n
        assert got[i].n_known == sum(w in train for w in tokens[i]) and got[i].score < 0
    assert score_texts(empty).count() == 0


def test_embedding_links(spark):
    centres = RNG.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + RNG.normal(scale=0.08 + 0.02 * (i % 5), size=16)).tolist(), i % 2) for i in range(150)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, rows[0][1], None), (203, None, 0), (204, [0.0] * 16, 0), (205, [float("nan")] * 16, 0), (206, [1.0], 0), (207, [None, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_vectors(df).collect()}
    fine = {i: (np.float32(v).astype(float), y) for i, v, y in rows if i < 202}
    near = {i: {j for j, (w, z) in fine.items() if j != i and y == z and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93} for i, (v, y) in fine.items()}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert got[i] == (len(near.get(i, ())), min(seen), min(seen) == i)
    assert link_vectors(df.limit(0)).count() == 0


def test_jaccard_components(spark, docs, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in cluster_documents(docs, 3, 80).collect()), key=str)
    sets = []
    for _, t in TEXTS:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} - {()})
    label = {i: i for i, _ in TEXTS}
    for _ in range(5):
        for (a, _), s in zip(TEXTS, sets, strict=True):
            for (b, _), r in zip(TEXTS, sets, strict=True):
                if a is not None and b is not None and s and r and 100 * len(s & r) >= 80 * len(s | r):
                    label[a] = label[b] = min(label[a], label[b])
    for (i, n, c), (j, m) in zip(got, sorted(((i, len(s)) for (i, _), s in zip(TEXTS, sets, strict=True)), key=str), strict=True):
        assert (i, n) == (j, m)
        assert i is None or c == label[i]
    kept = keep_one_of_each(docs, 3, 80)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 2
    assert cluster_documents(empty).count() == 0 and keep_one_of_each(empty).count() == 0


def test_suffix_order_sorts_suffixes():
    for n in (0, 1, 2, 3, 4, 7, 50, 300):
        s = RNG.integers(1, 4, n)
        rank = suffix_order(s, n + 1)
        order = sorted(range(n), key=lambda i: s[i:].tolist())
        assert np.argsort(rank).tolist() == order


def test_repeated_strings(docs, empty):
    rows = [(i, t) for i, t in TEXTS if i is not None]
    first = {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    got = defaultdict(list)
    for r in remove_repeated_strings(docs).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.kept_sha256))
    for i, t in rows:
        b = (t or "").encode()
        gone = {k for j in range(len(b) - 49) if first[b[j : j + 50]] < i for k in range(j, j + 50)}
        rest = bytes(x for k, x in enumerate(b) if k not in gone)
        assert (len(b), len(gone), hashlib.sha256(rest).hexdigest()) in got[i]
    assert all(r[1] == 0 for r in got[None])
    assert remove_repeated_strings(empty).count() == 0


def test_shards_fit(spark, docs, empty):
    for limit in (300, 1200, 5000, 1 << 20):
        rows = assign_shards(docs, limit).collect()
        assert len(rows) == len(TEXTS)
        shards = defaultdict(list)
        for r in rows:
            shards[r.shard, r.page].append(r.n_bytes)
            assert len(r.shard) == r.local_depth
        assert all(sum(s) <= limit or len(s) == 1 or sum(x > 0 for x in s) == 1 for s in shards.values())
    assert assign_shards(empty, 100).count() == 0


def test_quality_rules_learn_junk(spark, empty):
    rows = [(i, prose(40) if i % 3 else "!!! ### " * 30, int(i % 3 > 0)) for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (999, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(1, None, 0), (None, 1, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    model = learn_quality(df, labels, usable=F.col("doc_id") < 200)
    got = {r.doc_id: r.score for r in score_quality(df, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows) and 0 <= got[999] <= 1 and 0 <= got[None] <= 1
    flat = learn_quality(df, labels.limit(0))
    assert score_quality(empty, flat).count() == 0 and not flat.rules


def test_differencing_and_packing(docs, empty):
    sizes = RNG.integers(1, 900, 200).tolist()
    parts = differencing(sizes, 20)
    assert sorted(i for p in parts for i in p) == list(range(200))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) < 50
    assert all(sum(sizes[i] for i in p) <= 1000 for p in fill_windows(sizes, 1000))
    packer, out = Packer(64, 0), []
    for i, n in enumerate(RNG.integers(1, 200, 700).tolist()):
        out += packer.add(i, np.arange(n, dtype=np.uint32))
    out += packer.finish()
    filled = Counter()
    for _, _, ids, _, s, _ in out:
        filled[s] += len(ids)
    assert all(n == 64 or n & (n - 1) == 0 for n in filled.values())
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer_path())
    strange = "İstanbul it's we'LL ½ 12 <|endoftext|> a b é \x1c x ΣΑΣ 日本"
    df = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(50, strange)], "doc_id long, text string"))
    want = sorted(str((i, tok.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in [*TEXTS, (50, strange)] if i not in (15, 16, None))
    got = defaultdict(list)
    for r in pack_documents(df, Q.tokenizer_path(), with_ids=True).collect():
        got[r.doc_id].append((r.start, list(r.token_ids)))
        assert zlib.crc32(np.array(r.token_ids, "<u4").tobytes()) == r.ids_crc32 and len(r.token_ids) == r.length
    assert sorted(str((i, [x for _, p in sorted(v) for x in p])) for i, v in got.items() if i not in (15, 16, None)) == want
    assert pack_documents(empty, Q.tokenizer_path()).count() == 0


def test_line_dedup(docs, empty):
    got = {(r.doc_id, r.key): r for r in dedup_lines(docs.where("doc_id in (12, 13, 14)")).collect()}
    assert got[12, "x"]._removed is None and got[13, "x"]._removed == [1] and got[14, "x"]._removed == [0, 1]
    kept = drop_repeated_lines(docs)
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert "1" in ids and "2" not in ids and "5" in ids and "7" in ids and kept.columns == docs.columns
    assert drop_repeated_lines(empty).count() == 0


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, "/root/testdata/sf0.001")
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= before.count()
        before = after
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() >= before.count()


def test_few_labels_do_not_speak_for_the_web(spark):
    urls = [(i, f"http://h{i}.d{i % 7}.net/p") for i in range(30)] + [(100, "http://only.org/a"), (101, "http://only.org/b")]
    pages = spark.createDataFrame(urls, "page_id long, url string")

    def blocked(bad):
        labels = spark.createDataFrame(bad, "page_id long, bad boolean")
        return {r.host for r in judge_urls(pages, labels, rules=()).collect() if r.verdict == "block"}

    assert blocked([(0, True)]) == set()  # one bad page blocks nothing, its own host neither
    assert not {h for h in blocked([(0, True), (100, True)]) if not h.endswith((".d0.net", "only.org"))}  # two do not reach other domains
    assert "only.org" not in blocked([(i, True) for i in range(3)] + [(i, False) for i in range(3, 30)])


def test_odd_urls_and_columns(spark):
    long = "http://Long.example.com/" + "x" * 200_000
    rows = [(None, long, "a", "b"), (1, long, "a", "b"), (1, long, "a", "b"), (2, "http:///path", "c", "d"), (3, "x://HOST?q/r", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, _n string")
    got = judge_urls(pages, spark.createDataFrame([(1, False), (None, True)], "page_id long, bad boolean"), rules=()).collect()
    assert sorted((r.page_id or 0, r.host, len(r.path), r.verdict) for r in got) == [(0, "long.example.com", 200_001, "allow"), (1, "long.example.com", 200_001, "allow"), (1, "long.example.com", 200_001, "allow"), (2, "", 5, "allow"), (3, "host", 0, "allow")]


def test_the_beta_quantile(spark):
    # chances that beta(a, b) lies at or below 0.3, from binomial sums where a and b are whole numbers
    from math import comb

    from strandline.llm.url_filter import quantile_exceeds

    cases = [(a, b) for a in (1, 2, 3, 7, 20, 60) for b in (1, 2, 5, 11, 40, 90)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in cases], "a double, b double")
    got = {(int(r.a), int(r.b)): r.x for r in df.withColumn("x", quantile_exceeds(F.col("a"), F.col("b"), 0.3)).collect()}
    for a, b in cases:
        n = a + b - 1
        below = sum(comb(n, j) * 0.3**j * 0.7 ** (n - j) for j in range(a, n + 1))
        assert got[a, b] == (below < 0.05), (a, b, below)
