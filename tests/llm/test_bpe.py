"""Ids and texts as the tokenizers library has them, whole tables and odd texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from marketspark.llm import bpe, queries
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    alphabets = ["ab", "aab ", "abc <|endoftext|>", "'s t're'LL\n\t  ", "0123456789 ", "éßçñ中文字՘࢏\U00010940 ", "　 \x1c\x85᠎ a-", "".join(chr(rng.randrange(1, 0x2FFF)) for _ in range(50))]
    made = ["".join(rng.choice(x) for _ in range(rng.randrange(60))) for x in rng.choices(alphabets, k=n)]
    return [x.replace("a", "<|endoftext|>", 1) if rng.random() < 0.2 else x for x in made]


def test_ids_of_odd_texts(vocabulary, library):
    encoder = bpe.Encoder(vocabulary)
    texts = odd_texts(1500)
    for text, ids in zip(texts, encoder.ids(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_long_pieces_and_cut_texts(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 50)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(3000)), "a" * 5000 + "the" * 500, " ".join(odd_texts(200, 3)), "x  \n \n" * 300, "<|endoftext|>" * 40]
    for text, ids in zip(texts, bpe.Encoder(vocabulary).ids(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_both_ways_to_encode_a_piece(vocabulary):
    encoder = bpe.Encoder(vocabulary)
    pieces = [x.encode() for x in odd_texts(300, 5) if x]
    assert [encoder.encode_piece(x) for x in pieces] == encoder.encode_pieces(pieces)


def test_where_pieces_begin(vocabulary):
    """Many texts at once as the format's expression cuts them one by one, blanks and contractions at all ends included."""
    form = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    rng = random.Random(4)
    texts = ["".join(rng.choices(["'", "s", "re", "l", "v", "e", "d", " ", "\n", "1", "-", "é"], k=rng.randrange(9))) for _ in range(20_000)] + odd_texts(2000, 9)
    shown = [x.translate(vocabulary.odd) for x in texts]
    points = np.array([ord(c) for x in texts for c in x], dtype=np.uint32)
    want, at = [], 0
    for x in shown:
        want += [at + m.start() for m in form.finditer(x)]
        at += len(x)
    sizes = np.array([len(x) for x in texts if x])
    assert bpe.piece_starts(points, sizes, vocabulary.classes).tolist() == want
    assert bpe.piece_starts(points[:0], sizes[:0], vocabulary.classes).tolist() == []


def test_long_pieces_are_not_remembered(vocabulary, library):
    """Ids stay right when short and long pieces are new together, and each new short piece is encoded once."""
    encoder = bpe.Encoder(vocabulary)
    long = ["z" * 70, "qx" * 50]
    seen, together = [], encoder.encode_together
    encoder.encode_together = lambda pieces: seen.extend(pieces) or together(pieces)
    texts = [f"one {long[0]} two{long[1]}", f"two one {long[1]}<|endoftext|>", "three one", f"<|endoftext|>{long[0]} two", ""]
    for _ in range(3):
        assert [x.tolist() for t in texts for x in encoder.ids([t])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in encoder.ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(seen) == [b" one", b" two", b"one", b"three", b"two"]
    assert sorted(encoder.known) == [" one", " two", "one", "three", "two"]


def test_bounded_memory(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 5)
    monkeypatch.setattr(bpe, "PAIR_SLOTS", 4)
    texts = odd_texts(200, 7)
    encoder = bpe.Encoder(vocabulary)
    assert [x.tolist() for t in texts for x in encoder.ids([t])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_classes_of_all_code_points(vocabulary, library):
    """Characters whose class depends on the Unicode version are cut as the library cuts them."""
    odd = sorted(vocabulary.odd)
    points = [*odd[:: max(1, len(odd) // 400)], *range(0x21, 0x3000, 7), *range(0x1F000, 0x1F900, 11)]
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}-" for c in points]
    assert [x.tolist() for x in bpe.Encoder(vocabulary).ids(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_query_over_the_table(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_bpe_round_trip(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows_both_ways(spark, vocabulary, library):
    rows = [(1, None, 0), (2, "", 0), (None, "no id", 0), (3, "twice", 1), (3, "twice", 1), (4, "w " * 300_000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumnRenamed("ids", "decoded")
    docs = docs.selectExpr("*", "decoded AS `a.b`", "text AS __text")
    got = sorted(bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect(), key=repr)
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, _ in rows]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert bpe.decode(bpe.encode(docs.limit(0), vocabulary), vocabulary).count() == 0


def test_ids_that_are_no_tokens(spark, vocabulary, library):
    lists = [[1, 60_000, -5, 50256, None], None, [], [162, 240], [447]]
    rows = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(rows, vocabulary).collect()}
    assert got == {0: '"<|endoftext|>', 1: "", 2: "", 3: library.decode([162, 240], skip_special_tokens=False), 4: library.decode([447], skip_special_tokens=False)}


def test_other_kinds_of_tokenizers():
    with pytest.raises(ValueError):
        bpe.load(public_tokenizers.path("word_bpe_49k.json"))
