"""Repeated strings where ids or anchors repeat, against brute force."""

import hashlib
from collections import Counter

import numpy as np

from strandline.llm import suffix_dedup
from strandline.llm.suffix_dedup import remove_repeated_strings

RNG = np.random.default_rng(11)


def noise(n):
    return "".join(RNG.choice(list("abcdefghijklmnopqrstuvwxyz "), n))


def brute(rows, length=50):
    first, out = {}, Counter()
    for i, t in sorted(rows):
        b = t.encode()
        for j in range(len(b) - length + 1):
            first.setdefault(b[j : j + length], i)
    for i, t in rows:
        b = t.encode()
        gone = sorted({k for j in range(len(b) - length + 1) if first[b[j : j + length]] < i for k in range(j, j + length)})
        spans = sum(k - 1 not in set(gone) for k in gone)
        out[i, len(b), len(gone), spans, hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in set(gone))).hexdigest()] += 1
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated_strings(df).collect())


def test_rows_of_one_id_keep_their_own_bytes(spark):
    whole, passage = noise(200), noise(90)
    rows = [
        (1, whole), (2, noise(40) + passage), (5, whole), (5, noise(400)), (5, noise(150) + passage + noise(60)), (5, passage + noise(300)),
        (7, noise(300)), (7, noise(120) + passage), (7, noise(120) + passage), (9, whole[:60]), (9, whole),
    ]
    rows += [(7, rows[6][1])]
    assert found(spark, rows) == brute(rows)


def test_windows_of_a_large_key_leave_its_block(spark, monkeypatch):
    header = noise(120)
    rows = [(i, noise(int(RNG.integers(0, 60))) + header + noise(70)) for i in range(120)]
    rows += [(200 + i, rows[i][1][30:] + noise(20)) for i in range(0, 120, 3)] + [(400, rows[7][1] + rows[9][1])]
    sizes = spark.sparkContext.accumulator(0)
    whole = suffix_dedup.smallest_documents

    def block(contents, low, length):
        held = Counter()
        for c in contents:  # contents of the header's edges share most of its bytes
            held[header[:30].encode() in c or header[-30:].encode() in c] += len(c)
        sizes.add(held[True])
        return whole(contents, low, length)

    monkeypatch.setattr(suffix_dedup, "smallest_documents", block)
    expected = brute(rows)
    assert found(spark, rows) == expected
    before = sizes.value
    monkeypatch.setattr(suffix_dedup, "KEY_BYTES", 2000)
    assert found(spark, rows) == expected
    assert sizes.value - before < before / 4


def test_routing_moves_distinct_contents_only(spark, monkeypatch):
    line = noise(58)
    rows = [(i, line + ("\n" + line) * 40 + f" {i % 3}") for i in range(30)]  # one anchor, many occurrences of few contents
    frame, kept = type(spark.range(1)), []
    whole = frame.join

    def join(self, other, on=None, how=None):
        out = whole(self, other, on, how)
        if how == "left_semi":
            kept.append(out.count())
        return out

    expected = brute(rows)
    monkeypatch.setattr(suffix_dedup, "KEY_BYTES", 2000)
    monkeypatch.setattr(frame, "join", join)
    assert found(spark, rows) == expected
    assert 0 < sum(kept) < 200


def test_one_row_a_batch_stands_for_equal_contents(spark, monkeypatch):
    line = noise(58)
    rows = [(i, line + ("\n" + line) * 40 + f" {i % 3}") for i in range(30)]
    frame, filtered = type(spark.range(1)), []
    whole = frame.join

    def join(self, other, on=None, how=None):
        if how == "left_semi":  # what the optimizer filters by key: it moves the filter below the aggregate
            keys = {r.key for r in other.collect()}
            met = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in self.inputFiles()})
            filtered.append((met.where("low is not null").where(met.key.isin(keys)).count(), met.where(met.key.isin(keys)).count()))
        return whole(self, other, on, how)

    expected = brute(rows)
    monkeypatch.setattr(suffix_dedup, "KEY_BYTES", 2000)
    monkeypatch.setattr(frame, "join", join)
    assert found(spark, rows) == expected
    assert len(filtered) == 1 and 0 < 5 * filtered[0][0] < filtered[0][1]
