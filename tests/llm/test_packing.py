"""Packing's ids against the tokenizer's own, and what encoding asks of Python."""

import gc
import random
import tracemalloc
from itertools import islice, product
from string import ascii_lowercase

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from rowsense.llm import packing

TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))
#: Endings, letters of which lower case or normal form change more than themselves, digits, spaces, and what is odd.
PARTS = [
    *("'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", '"', "a", "S", "re", "L", "h", "H", "\xe9", "É", "İ", "İ", "Σ", "ς", "\xdf", "ẞ"),
    *("ǅ", "ﬀ", "K", "̱", "ͅ", "\xbd", "3", "٣", "Ⅳ", "。", "日本", "\U0001d7ce", "\U0001d400", "\U0001f600", "</w>", "\x00", "\x1b"),
    *(" ", "  ", "\n", "\t", "\xa0", "\x85", " ", "　", "​", "﻿", "<", "|", "<|", "<|endoftext|>", "\x1c", "\x1f", "᠎"),
]


def own(texts):
    return [x.ids for x in Tokenizer.from_file(TOKENIZER).encode_batch_fast(texts, add_special_tokens=False)]


def test_ids_of_odd_texts_side_by_side():
    draw = random.Random(5)
    texts = ["", *("".join(draw.choices(PARTS, k=draw.randint(0, 25))) for _ in range(4000)), "\x1c", ""]
    ids, lengths = packing.Encoder(TOKENIZER).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == own(texts)


def test_marks_keep_the_order_that_the_tokenizer_gives_them(spark):
    """What is in lower case isn't normalized again."""
    texts = ["aİ̱b", "İ̱̇"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: b"" for i in range(len(texts))}
    for p in sorted(packing.pack(docs, TOKENIZER).collect(), key=lambda p: p["start"]):
        got[p["doc_id"]] += bytes(p["ids"])
    assert [np.frombuffer(got[i], "<u2").tolist() for i in range(len(texts))] == [[*x, packing.END] for x in own(texts)]


def test_a_distinct_piece_is_looked_up_once_for_many_texts():
    class Counted(packing.PieceTable):
        asked = 0

        def __getitem__(self, piece):
            Counted.asked += 1
            return super().__getitem__(piece)

    texts = [" ".join(f"{w}{end}" for w in ("alpha", "beta", "gamma")) for end in (",", ".", ";", "!", "?") for _ in range(200)]
    encoder = packing.Encoder(TOKENIZER)
    encoder.pieces = Counted()
    ids, lengths = encoder.encode(pa.array(texts))
    assert Counted.asked == 8 and [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == own(texts)


def test_forgotten_pieces_are_learned_again(monkeypatch):
    monkeypatch.setattr(packing, "PIECES_HELD", 3)
    encoder = packing.Encoder(TOKENIZER)
    for texts in (["one two three four five"], ["five six"], ["six one"]):
        ids, lengths = encoder.encode(pa.array(texts))
        assert ids.tolist() == own(texts)[0] and lengths.tolist() == [len(ids)]
    assert len(encoder.pieces) == 3


def test_pieces_of_many_texts_outlive_the_others(monkeypatch):
    monkeypatch.setattr(packing, "PIECES_HELD", 4)
    monkeypatch.setattr(packing, "PIECES_KEPT", 2)
    encoder = packing.Encoder(TOKENIZER)
    for texts in (["two one"], ["one three two"], ["one four five three"], ["six two one three five"]):
        ids, lengths = encoder.encode(pa.array(texts))
        assert ids.tolist() == own(texts)[0] and lengths.tolist() == [len(ids)]
    assert list(encoder.pieces)[:2] == ["one", "two"] and "four" not in encoder.pieces


def test_memory_does_not_grow_with_distinct_words():
    """600,000 words one after another: the table and the arrays stay under 48 MB."""
    words = ("".join(w) for w in product(ascii_lowercase, repeat=5))
    encoder = packing.Encoder(TOKENIZER)
    tracemalloc.start()
    try:
        for _ in range(20):
            encoder.encode(pa.array([" ".join(islice(words, 30_000))]))
        assert tracemalloc.get_traced_memory()[1] < 48 << 20
    finally:
        tracemalloc.stop()


def test_a_worker_holds_no_encoder_after_its_task(spark):
    docs = spark.createDataFrame([(i, "some words") for i in range(40)], "doc_id long, text string").repartition(4)
    assert packing.tokenized(docs, TOKENIZER).filter("df is null").count() == 40

    def held(batches):
        for batch in batches:
            n = sum(isinstance(x, packing.Encoder) for x in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], names=["n"])

    assert {r["n"] for r in docs.select("doc_id").mapInArrow(held, "n long").collect()} == {0}


def test_the_whole_tokenizer_is_loaded_for_odd_texts_alone():
    encoder = packing.Encoder(TOKENIZER)
    encoder.encode(pa.array(["some words"]))
    assert "tokenizer" not in vars(encoder)
    ids, _ = encoder.encode(pa.array(["a <|endoftext|> b"]))
    assert ids.tolist() == own(["a <|endoftext|> b"])[0]


def test_chunks_are_bounded_by_bytes_and_rows():
    sizes = [10, 10, packing.CHUNK_BYTES * 3, 10, *([0] * 10_000), packing.CHUNK_BYTES // 2]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array(["x" * n for n in sizes])], names=["doc_id", "text"])
    got = list(packing.chunks(batch.slice(1), 1))
    assert [i for c in got for i in c.column(0).to_pylist()] == list(range(1, len(sizes)))
    assert [2] in [c.column(0).to_pylist() for c in got]
    assert all(sum(len(t) + packing.ROW_BYTES for t in c.column(1).to_pylist()) <= 2 * packing.CHUNK_BYTES for c in got if c.num_rows > 1)
    assert list(packing.chunks(batch.slice(0, 0), 1)) == []


def test_a_long_text_is_cut_at_spaces(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_BYTES", 40)
    draw = random.Random(6)
    texts = ["".join(draw.choices([*PARTS, " "], k=200)) for _ in range(200)] + ["x" * 500, "x" * 500 + " y", " " * 500]
    encoder = packing.Encoder(TOKENIZER)
    got = [encoder.encode(pa.array([t])) for t in texts]
    assert [ids.tolist() for ids, _ in got] == own(texts) and all(n.tolist() == [len(ids)] for ids, n in got)
    assert "".join(packing.at_spaces("ab cd  ef", 2)) == "ab cd  ef"
