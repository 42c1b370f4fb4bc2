"""Defined cases of the operators and stages: clashing columns, long texts, chains, and whole results by brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import lm_score
from strandline.llm import queries as Q
from strandline.llm.components import connected_components
from strandline.llm.decontaminate import drop_contaminated, find_benchmark_hits
from strandline.llm.jaccard_join import cluster_documents, keep_one_of_each
from strandline.llm.line_dedup import dedup_lines, drop_repeated_lines
from strandline.llm.packing import pack_documents
from strandline.llm.quality import STATISTICS, learn_quality, score_quality, with_statistics
from strandline.llm.sharding import assign_shards
from strandline.llm.suffix_dedup import remove_repeated_strings

RNG = np.random.default_rng(23)
WORDS = np.array([f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "ha", "jo", "ki") for b in ("r", "n", "st", "l", "m", "t")])


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def test_components_of_a_long_path_and_a_hub(spark):
    order = RNG.permutation(1000).tolist()
    edges = list(zip(order, order[1:], strict=False)) + [(2000 + i, 1500) for i in range(300)] + [(None, 1), (5, None), (9, 9)]
    edges += [(i, i + 1) for i in range(3000, 3400)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1000)) and all(got[2000 + i] == 1500 for i in range(300)) and all(got[i] == 3000 for i in range(3000, 3401))


@pytest.fixture(scope="module")
def clash(spark):
    names = ["_gone", "gone", "_id", "_rk", "removed", "_removed", "_sl", "hits", "score", "statistics", "page", "shard", "n_bytes", "_row", "_text", "node", "component", "a.b", "_h", "_b"]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate([prose(40), "", None, prose(30) + "\n" + prose(9), prose(40)] + [prose(25)] * 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))


def test_columns_with_the_names_of_helpers_stay(spark, clash):
    items = spark.createDataFrame([(1, prose(12))], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    model = learn_quality(clash, labels)
    others = [c for c in clash.columns if c not in ("doc_id", "text")]
    stages = {
        "lines": drop_repeated_lines(clash), "copies": keep_one_of_each(clash), "benchmark": drop_contaminated(clash, items),
        "quality": score_quality(clash, model, name="other").drop("other"), "marked": dedup_lines(clash, name="found").drop("found"),
    }
    before = {r.doc_id: r for r in clash.collect()}
    for name, out in stages.items():
        assert out.columns == clash.columns, name
        rows = out.collect()
        assert rows and all(r[c] == before[r.doc_id][c] for r in rows for c in others), name
    replaced = score_quality(clash, model)
    assert replaced.columns.count("score") == 1 and 0 <= replaced.first().score <= 1
    shards = assign_shards(clash, 1000)
    assert len(set(shards.columns)) == len(shards.columns) and shards.count() == 8
    assert find_benchmark_hits(clash, items).columns.count("_sl") == 1
    for run in (cluster_documents, remove_repeated_strings, lm_score.score_texts, lambda d: pack_documents(d, Q.tokenizer_path())):
        assert run(clash).count() >= 8


def test_long_texts_are_taken_whole(spark):
    tail = prose(60)
    long = " ".join(np.tile(RNG.choice(WORDS, 3000), 700)) + " " + tail  # over 8 MB
    lines = "\n".join(["x" + prose(8)] + [f"line {i} of many " + prose(6) for i in range(3000)])
    df = spark.createDataFrame([(1, tail), (2, long), (3, long), (4, lines), (5, lines + "\nlast")], "doc_id long, text string").repartition(2)
    assert len(long) > 8 << 20
    cut = {r.doc_id: r for r in remove_repeated_strings(df).collect()}
    assert cut[2].n_removed in (len(tail), len(tail) + 1) and cut[3].n_removed == len(long.encode()) and cut[5].n_removed == len(lines)
    comps = {r.doc_id: r.component_id for r in cluster_documents(df).collect()}
    assert comps == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4}
    items = spark.createDataFrame([(7, " ".join(tail.split()[-12:]))], "item_id long, text string")
    assert {r.doc_id: r._sl.n_hit for r in find_benchmark_hits(df, items).collect()}.items() >= {1: 12, 2: 12, 3: 12, 4: 0}.items()
    scores = {r.doc_id: r for r in lm_score.score_texts(df).collect()}
    assert scores[2].n_tokens == len(long.split()) + 1 and scores[2].score == pytest.approx(scores[3].score)
    tokens = {r.doc_id: r.doc_tokens for r in pack_documents(df, Q.tokenizer_path()).collect()}
    assert tokens[2] == tokens[3] > 1_000_000
    left = {r.doc_id: r.text for r in drop_repeated_lines(df).collect()}
    assert left[2] == long and 3 not in left and left[5] == "last"
    assert with_statistics(df).count() == 5


def test_rule_column_equals_numpy(spark):
    rows = [(i, prose(int(RNG.integers(3, 60))) + ("" if i % 3 else " ### !!" * int(RNG.integers(1, 9))), int(i % 3 > 0)) for i in range(300)]
    df = spark.createDataFrame([r[:2] for r in rows] + [(999, ""), (None, None)], "doc_id long, text string")
    model = learn_quality(df, spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int"))
    assert model.rules
    stats = with_statistics(df).select("doc_id", "_sl.*").toPandas()
    want = dict(zip(stats["doc_id"].fillna(-1).astype(int), model.score(stats[list(STATISTICS)].to_numpy(float)), strict=True))
    for r in score_quality(df, model).collect():
        assert r.score == pytest.approx(want[-1 if r.doc_id is None else r.doc_id], abs=1e-9)


def test_language_model_is_normalised_and_scores_as_defined(spark, monkeypatch):
    frequency = RNG.random(lm_score.CLASSES)
    frequency /= frequency.sum()
    table = lm_score.LogBilinear(lm_score.LogBilinear.start(frequency)).table()
    assert np.allclose((10.0 ** table.astype(float)).sum(1), 1, atol=1e-4)

    monkeypatch.setattr(lm_score, "train_classes", lambda trigrams, f: lm_score.LogBilinear(lm_score.LogBilinear.start(f)))
    texts = [(i, " ".join(f"w{int(x)}" for x in RNG.zipf(1.3, 80) % 400)) for i in range(40)] + [(90, None), (91, "never seen WORDS ß")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.score_texts(df, folds=4).collect()}
    import zlib

    words = {i: [w.encode() for w in re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()] + [b""] for i, t in texts}
    count = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 4 for w in ws)
    ranked = sorted((w for w in count if w), key=lambda w: (-count[w], w))
    single = {w: k for k, w in enumerate([b"", *ranked[: lm_score.SINGLE - 1]])}
    ends = Counter()
    for w in count:
        if w not in single:
            ends[w[-2:]] += count[w]
    suffix = {s: lm_score.SINGLE + k for k, s in enumerate(sorted(ends, key=lambda s: (-ends[s], s))[: lm_score.SHARED - 1])}

    def kind(w):
        return single.get(w, suffix.get(w[-2:], lm_score.CLASSES - 1)) if w not in single else single[w]

    mass, size = np.zeros(lm_score.CLASSES), np.zeros(lm_score.CLASSES)
    for w, c in count.items():
        mass[kind(w)] += c
        size[kind(w)] += 1
    frequency = (mass + 0.5) / (mass + 0.5).sum()
    model = lm_score.LogBilinear(lm_score.LogBilinear.start(frequency)).table()
    for i, ws in words.items():
        k = [single[b""]] * 2 + [kind(w) for w in ws]
        total = sum(float(model[k[j] * lm_score.CLASSES + k[j + 1], k[j + 2]]) for j in range(len(ws)))
        total += sum(np.log10((count[w] + 0.1) / (mass[kind(w)] + 0.1 * (size[kind(w)] + 1))) for w in ws if kind(w) >= lm_score.SINGLE)
        assert got[i].score == pytest.approx(total, rel=1e-4)


def test_sequences_are_gapless_whole_and_full(spark):
    texts = [(i, prose(int(n))) for i, n in enumerate(RNG.integers(0, 900, 120))] + [(7, prose(50)), (7, prose(50)), (None, prose(9)), (None, None)]
    rows = pack_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), Q.tokenizer_path(), capacity=256).collect()
    sequences, pieces = defaultdict(list), defaultdict(int)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id] += r.length
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == 256 or at & (at - 1) == 0 and at < 256
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(Q.tokenizer_path()), defaultdict(int)
    for i, t in texts:
        want[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    assert pieces == want


def brute_lines(docs):
    """Texts without lines that a line within one edit, at most a fifth of the longer, precedes."""
    every = [(i, no, line) for i, t in docs for no, line in enumerate(t.split("\n")) if t is not None and line.strip(" \t\x0b\f\r")]

    def near(a, b):
        if a == b:
            return True
        a, b = sorted((a.split(" "), b.split(" ")), key=len)
        if len(b) < 5 or len(b) - len(a) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        return any(b[:j] + b[j + 1 :] == a for j in range(len(b)))

    gone = {(i, no) for i, no, line in every if any((j, m) < (i, no) and near(line, other) for j, m, other in every)}
    left = {i: "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone) for i, t in docs}
    return {i: t for i, t in left.items() if t.strip() or not any(g[0] == i for g in gone)}


def brute_copies(docs, k=5, percent=80):
    sets = {}
    for i, t in docs:
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} - {()})
    low = {i: i for i in sets}
    for _ in sets:
        for a, s in sets.items():
            for b, r in sets.items():
                if s and r and 100 * len(s & r) >= percent * len(s | r):
                    low[a] = low[b] = min(low[a], low[b])
    return {i for i in low if low[i] == i}


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    test_item = prose(30)
    base = prose(120)
    words = base.split()
    texts = [prose(int(n)) for n in RNG.integers(30, 80, 20)] + [base, base, " ".join(words[:60] + ["changed"] + words[61:]), " ".join(words[:90]), prose(20) + " " + test_item[:90] + " " + prose(20)]
    texts += [f"{prose(30)}\na line that many documents of this table share\n{prose(12)}" for _ in range(3)] + [f"{prose(30)}\na line that most documents of this table share\nyes\nyes" for _ in range(2)]
    texts += ["### !!! @@@ " * int(n) for n in RNG.integers(5, 30, 12)]
    docs = list(enumerate(texts))
    junk = {i for i, t in docs if "###" in t}
    spark.createDataFrame([(i, t, "en", "s", len(t), "kept") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, more string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i not in junk), 0) for i, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, test_item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def texts_of(df):
        return {r.doc_id: r.text for r in df.collect()}

    good = stages["quality"](spark, now, str(tmp_path))
    assert set(texts_of(good)) == {i for i, _ in docs} - junk
    lines = stages["lines"](spark, good, str(tmp_path))
    assert texts_of(lines) == brute_lines(sorted(texts_of(good).items()))
    single = stages["near_copies"](spark, lines, str(tmp_path))
    assert set(texts_of(single)) == brute_copies(sorted(texts_of(lines).items()))
    clean = stages["benchmark"](spark, single, str(tmp_path))
    windows = {tuple(test_item.split()[j : j + 10]) for j in range(21)}
    hit = {i for i, t in texts_of(single).items() if any(tuple(t.split()[j : j + 10]) in windows for j in range(len(t.split())))}
    assert hit and set(texts_of(clean)) == set(texts_of(single)) - hit
    for step in (good, lines, single, clean):
        assert step.columns == now.columns and {r.more for r in step.collect()} == {"kept"}
    whole = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in whole} == set(texts_of(clean)) and all(r.n == r.t for r in whole)
    empty = now.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
