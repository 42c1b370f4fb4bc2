"""Vector codes and hard negatives against brute force over odd rows."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from strandline.llm import hard_negatives as H
from strandline.llm.hard_negatives import Best, mine_hard_negatives
from strandline.llm.vector_codes import VantagePointTree, codebook_text, encode_vectors, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(seed, n=700, d=16, scale=1.0):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 1, (n, d)) * rng.lognormal(0, 0.6, (n, 1)) * scale
    v[n // 2 : n // 2 + n // 3] = v[3]  # a third of all rows are one vector
    out = [(int(i), [float(np.float32(x)) for x in v[i]], int(rng.integers(0, 4))) for i in rng.permutation(n)]
    out += [(n, None, 1), (n + 1, [1.0] * (d - 1) + [None], 1), (n + 2, [float("nan")] * d, 2), (n + 3, [float("inf")] * d, 0), (n + 4, out[0][1], None), (None, out[1][1], 1)]
    return out


def kept_rows(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]


def codes_by_loop(rows):
    """Rounds as the docstring defines them, entry by entry."""
    kept = kept_rows(rows)
    whole = [[int(np.floor(4096 * float(x))) for x in r[1]] for r in kept]
    width = len(whole[0]) // 8
    first = sorted((r[0], w) for r, w in zip(kept, whole, strict=True) if r[0] is not None)[:16]
    books = [[w[p * width : (p + 1) * width] for _, w in first] for p in range(8)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(6):
        for p in range(8):
            held = defaultdict(list)
            for w in whole:
                part = w[p * width : (p + 1) * width]
                held[nearest(part, books[p])[1]].append(part)
            books[p] = [[sum(c) // len(held[i]) for c in zip(*held[i], strict=True)] if i in held else e for i, e in enumerate(books[p])]
    out, by_label = [], defaultdict(int)
    for r, w in zip(kept, whole, strict=True):
        found = [nearest(w[p * width : (p + 1) * width], books[p]) for p in range(8)]
        error = sum(d for d, _ in found)
        by_label[r[2]] += error
        out.append((r[0], "".join(f"{i:02x}" for _, i in found), error, r[2]))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[y], digest) for i, c, e, y in out), key=str)


@pytest.mark.parametrize("n", [700, 9])
def test_codes_equal_a_plain_loop(spark, n):
    rows = rows_of(3, n)
    got = vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == codes_by_loop(rows)


def test_tree_finds_the_nearest_and_leaves_out_entries():
    rng = np.random.default_rng(5)
    entries = rng.integers(-50, 50, (64, 2))
    entries[40] = entries[7]
    tree, x = VantagePointTree(entries), rng.integers(-60, 60, (4000, 2))
    index, squared = tree.nearest(x)
    every = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    assert np.array_equal(index, every.argmin(1)) and np.array_equal(squared, every.min(1))
    assert tree.visited < 0.6 * every.size


def test_codes_of_odd_tables(spark):
    assert vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    mixed = [(i, [float(i)] * 8, 0) for i in range(5)] + [(9, [1.0] * 16, 1), (9, [2.0] * 16, 1), (10, [], 2), (11, [3.0] * 5, None), (12, [1e30] * 8, 3), (None, [1.0] * 3, 0)]
    table = spark.createDataFrame(mixed, SCHEMA).selectExpr("*", "1 as d", "2 as code", "3 as n")
    got = vector_codes(table).collect()
    assert len(got) == len(mixed) and all(len(r.code) == (16 if r.vec_id is not None else 0) for r in got)
    _, books = encode_vectors(table)
    assert sorted(books) == [0, 5, 8, 16] and len(books[16][0]) == 2
    assert {r.codebooks_sha256 for r in got if r.vec_id == 9} == {hashlib.sha256(codebook_text(books[16]).encode()).hexdigest()}


def negatives_by_loop(rows):
    kept = [(i, (y + 1) % 10 if i % 7 == 0 else y, [int(np.floor(256 * float(x))) for x in v]) for i, v, y in kept_rows(rows) if i is not None and y is not None]
    out = []
    for i, y, v in kept:
        if i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, z == y) for j, z, w in kept if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2])[:5]:
            window = sorted((t, k) for t, k, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize(("bucket", "block", "shard"), [(1 << 20, 1 << 19, 8), (2048, 512, 2)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, bucket, block, shard):
    monkeypatch.setattr(H, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(H, "BLOCK_BYTES", block)
    monkeypatch.setattr(H, "SHARD", shard)
    rows = rows_of(11) + [(50, [0.5] * 16, 2), (50, [0.25] * 16, 3), (100, [0.0] * 16, 1), (150, [1.0] * 4, 1), (151, [2.0] * 4, 1), (152, [1.5] * 4, 2)]
    got = mine_hard_negatives(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as shard", "3 as norm").repartition(6))
    assert sorted(map(tuple, got.collect())) == negatives_by_loop(rows)


def test_hard_negatives_of_odd_tables(spark):
    assert mine_hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    huge = [(0, [1e20] * 4, 1), (50, [1e19] * 4, 0), (1, [1e19] * 4, 2), (2, [7e18] * 4, 0)]
    got = mine_hard_negatives(spark.createDataFrame(huge, SCHEMA)).collect()
    assert all(r.positive_score <= 2**63 - 1 for r in got)
    same = [(i, [1.0, 2.0], 1) for i in range(120)]
    assert {r[0] for r in mine_hard_negatives(spark.createDataFrame(same, SCHEMA)).collect()} <= {0, 50, 100}


def test_buckets_below_the_needed_norm_are_left_out():
    rng = np.random.default_rng(2)
    block = {"keys": np.arange(8), "ids": np.arange(8), "labels": np.zeros(8, np.int64), "d": 6}
    vectors = np.floor(rng.normal(0, 300, (8, 6)))
    block = {k: v if k == "d" else np.asarray(v, np.int64).tobytes() for k, v in block.items()} | {"vectors": vectors.tobytes(), "queries": b"", "lows": b"", "highs": b""}
    best = Best(block, 2, True)
    near = {"ids": np.arange(100, 150).tobytes(), "labels": np.zeros(50, np.int64).tobytes(), "d": 6, "vectors": (w := np.floor(rng.normal(0, 300, (50, 6)))).tobytes(), "top": float(np.sqrt((w * w).sum(1)).max())}
    best.meet(near)
    seen = best.compared
    far = near | {"vectors": np.ones((50, 6)).tobytes(), "top": float(np.sqrt(6.0))}
    best.meet(far)
    assert best.compared == seen and best.need() > np.sqrt(6.0)
