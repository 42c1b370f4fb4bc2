"""SentencePiece encoding and decoding against the library, over odd and random texts."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import pieces
from strandline.llm import queries as Q
from strandline.llm.pieces import PieceTokenizer, decode_pieces, encode_pieces

ODD = ["", None, " ", "  a", "a ", "▁x", "hello  world\n\nfoo", "\x00a", "日本語 テキスト", "<s> </s> <unk> <0x41>", "ａｂ", "é", " " * 90 + "x" + " " * 37, "a" * 5000, "ab" * 3000, "=" * 77, "\n\n\t ", " ▁ ▁▁", "🙂👍🏽", "﻿x​ "]


@pytest.fixture(scope="module")
def model():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def random_texts(sp, seed, n, longest):
    rng = random.Random(seed)
    vocabulary = [sp.id_to_piece(i).replace("▁", " ") for i in range(259, sp.vocab_size())]
    letters = "ab tehns  ▁\n\t.éß日本🙂1290=-*#/ing"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(longest))) for _ in range(n)]
    texts += ["".join(rng.choice(vocabulary) for _ in range(rng.randrange(longest // 4))) for _ in range(n)]
    return texts + ["".join(rng.choice(vocabulary).strip() for _ in range(rng.randrange(longest // 4))) for _ in range(n)]


@pytest.mark.parametrize(("pace", "slow"), [(512, 16), (1, 2)])
def test_ids_and_texts_equal_the_library(model, monkeypatch, pace, slow):
    monkeypatch.setattr(pieces, "PACE", pace)
    monkeypatch.setattr(pieces, "SLOW_ROUNDS", slow)
    path, sp = model
    tokenizer, texts = PieceTokenizer(path), ODD + random_texts(sp, 4, 120, 160)
    ids, rows = tokenizer.encode(pa.array(texts, pa.string()))
    data, bounds = tokenizer.decode(ids, rows)
    for i, text in enumerate(texts):
        want = sp.encode(text or "", add_bos=True, add_eos=True)
        assert ids[rows[i] : rows[i + 1]].tolist() == want
        assert data[bounds[i] : bounds[i + 1]].tobytes().decode() == sp.decode(want)


def test_any_ids_decode_as_in_the_library(model):
    path, sp = model
    tokenizer, rng = PieceTokenizer(path), random.Random(8)
    rows = [[rng.randrange(sp.vocab_size() if rng.random() < 0.5 else 260) for _ in range(rng.randrange(12))] for _ in range(2000)]
    data, bounds = tokenizer.decode(np.array(sum(rows, []), np.uint32), np.append(0, np.cumsum([len(r) for r in rows])))
    assert [data[a:b].tobytes().decode() for a, b in zip(bounds, bounds[1:], strict=False)] == [sp.decode(r) for r in rows]


def test_a_word_of_many_letters(model):
    path, sp = model
    text = "".join(random.Random(1).choice("abcdehinorst") for _ in range(50_000))
    assert PieceTokenizer(path).encode(pa.array([text]))[0].tolist() == sp.encode(text, add_bos=True, add_eos=True)


def test_words_are_forgotten_beyond_the_bound(model, monkeypatch):
    path, sp = model
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    tokenizer = PieceTokenizer(path)
    for seed in range(5):
        texts = random_texts(sp, seed, 20, 80)
        assert tokenizer.encode(pa.array(texts))[0].tolist() == sum((sp.encode(t, add_bos=True, add_eos=True) for t in texts), [])


def test_the_query_and_its_columns(spark, model, tmp_path):
    path, sp = model
    rows = [(i, t, "x", 1.5) for i, t in enumerate(ODD)] + [(None, "two words", "y", 0.0), (3, "  a", "z", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces string, ids double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op11_sentencepiece(spark, str(tmp_path)).collect()}
    want = set()
    for i, t, *_ in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == want
    out = encode_pieces(docs, path, name="found")
    assert out.columns == [*docs.columns, "found"] and out.count() == len(rows)
    back = decode_pieces(out.selectExpr("doc_id", "text", "found.ids as ids"), path)
    assert all((r.text or "") == r.decoded.text or "▁" in r.text for r in back.collect())
    assert encode_pieces(docs.limit(0), path).count() == 0
