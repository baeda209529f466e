"""SentencePiece encoding against the library."""

import hashlib
import random

import pytest
import public_tokenizers
import sentencepiece

from spikeframe.llm import queries
from spikeframe.llm.common import table
from spikeframe.llm.piece_bpe import PieceEncoder, PieceModel, encode_decode_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["▁", " ", "  ", "a", "e", "the", "in", "ing", "th", "\n", "\t", "é", "é", "日", "本", "한", "\x00", "​", "﻿", "😀", "﷽", "ß", "ﬁ", "<s>", "</s>", "<unk>", "<0x41>", "1", "0", "."]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder(PieceModel.load(MODEL))


def ids_of(raw):
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


def test_random_texts(library, encoder):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    for k in range(0, len(texts), 50):  # batches, whose words share one prefix table
        some = texts[k : k + 50]
        assert [ids_of(r) for r in encoder.encode(some)] == [library.encode(t, add_eos=True) for t in some]
        assert [encoder.decode(ids_of(r)) for r in encoder.encode(some)] == [library.decode(library.encode(t, add_eos=True)) for t in some]


@pytest.mark.parametrize("text", ["", " ", "\n", " " * 50_000, "a" * 50_000, "é日" * 20_000, "▁▁a▁", "ab  cd   ef ", "x" * 63, "x" * 64, "x" * 65])
def test_edges(library, encoder, text):
    assert ids_of(encoder.encode([text])[0]) == library.encode(text, add_eos=True)


def test_decoding_of_any_ids(library, encoder):
    rng = random.Random(3)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(3, 32_000), rng.randrange(3, 259), 28705, 264, 2, 1, 0]) for _ in range(rng.randint(0, 9))]
        assert encoder.decode(ids) == library.decode(ids)


def test_pieces_whose_borders_merge_are_not_cut(library):
    """With a piece that goes over a space, texts are taken whole; characters without a piece of their own still merge."""
    scores = {"▁": (3, -9.0), "a": (4, -9.0), "b": (5, -9.0), "a▁": (6, -1.0), "▁b": (7, -2.0), "xy": (8, -3.0)}
    enc = PieceEncoder(PieceModel(scores, list(range(100, 356)), [1, 2], 0, 2))
    assert enc.split is None
    assert ids_of(enc.encode(["a b"])[0]) == [3, 6, 5, 2]  # ▁ a▁ b: the better pair goes first
    assert ids_of(enc.encode(["xyx"])[0]) == [3, 8, 100 + ord("x"), 2]


def test_equal_scores_merge_from_the_left():
    scores = {c: (3 + i, -9.0) for i, c in enumerate("▁a")} | {"aa": (5, -1.0), "aaa": (6, -1.0)}
    enc = PieceEncoder(PieceModel(scores, list(range(100, 356)), [], 0, 2))
    assert ids_of(enc.encode(["aaaa"])[0]) == [3, 6, 4, 2]


def test_query_on_odd_rows(spark, odd, nothing, library):
    out = encode_decode_pieces(odd, MODEL)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    want = sorted((r["doc_id"] or -1, tuple(library.encode(r["text"] or "", add_eos=True)), r["text"] or "") for r in odd.collect())
    assert sorted((r["doc_id"] or -1, tuple(r["ids"]), r["decoded"]) for r in out.collect()) == want
    assert encode_decode_pieces(nothing, MODEL).count() == 0


def test_query_equals_the_library(spark, sf_dir, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in table(spark, sf_dir, "documents").collect():
        ids = library.encode(r["text"] or "", add_eos=True)
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    out = queries.op12_pieces(spark, sf_dir)
    assert sorted(tuple(r) for r in out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted(want)
