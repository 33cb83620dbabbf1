import itertools
import zlib
from array import array

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from accessloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n", "Hello, World's 42nd   test", "<|startoftext|>x <|endoftext|>", "ΣΑΣ İstanbul ﬁ Ａ", "a\x1cb\x85c\xa0d", "é e ́",
    "naïve ÀÉÎ " * 900, "word " * 30_000, "同じ 文字 \U0001f600", "same", "same",
]


def test_the_curve_visits_every_cell_by_single_steps():
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        keys = packing.hilbert(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_pieces_rebuild_every_document(spark):
    docs = spark.createDataFrame([(i if i else None, t, 2, 3) for i, t in enumerate(TEXTS)], "doc_id long, text string, curve int, start int")
    rows = packing.packed_pieces(docs, PATH).collect()
    lib = Tokenizer.from_file(PATH)
    for i, text in enumerate(TEXTS):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in rows if r.doc_id == (i or None)), key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids) and {r.doc_tokens for r in own} == {len(ids)}
        for r in own:
            assert r.ids_crc32 == zlib.crc32(array("I", ids[r.start : r.start + r.length]).tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= 2048
        short += at < 2048
    assert short <= 4


def test_a_hot_key_spreads_over_ranges():
    import pyarrow as pa

    bounds = np.array([5, 7, 7, 7, 7, 9])
    keys, packing_keys = np.full(1000, 7), packing.curve_keys
    try:
        packing.curve_keys = lambda texts: keys
        batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x"] * 1000)], names=["doc_id", "text"])
        parts = next(packing.key_rows(bounds)([batch])).column(3).to_numpy()
    finally:
        packing.curve_keys = packing_keys
    assert set(parts) == {1, 2, 3, 4, 5} and np.bincount(parts).max() < 300


def test_empty_table_and_neighbours(spark):
    assert packing.packed_pieces(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    import pyarrow as pa

    a, b = "the cat sat on a mat by the door " * 5, "les chats sont sur le tapis dans la maison " * 5
    keys = packing.curve_keys(pa.array([a, a + "ok", b, None]))
    assert abs(keys[0] - keys[1]) < abs(keys[0] - keys[2])


def test_whole_words_are_hashed():
    import pyarrow as pa

    def buckets(text):
        data, offsets = packing.text_bytes(pa.array([text]))
        return packing.word_buckets(data, offsets)[0].tolist()

    assert len(set(buckets("prefixedword prefixedXYZZY информация информатика"))) == 4
    assert buckets("Word wORD") == buckets("word word") and buckets("同じ文字 x") == buckets("同 じ 文 字 x")
    assert buckets("a同b") == buckets("a 同 b") and buckets("\U0001f600z") == buckets("\U0001f600 z") and buckets("同") == buckets(" 同 ")
    data, offsets = packing.text_bytes(pa.array(["同a", None, "b", "", "é 語"]))
    assert packing.word_buckets(data, offsets)[1].tolist() == [0, 2, 2, 3, 3, 5]


def test_ranges_follow_the_amount_of_text(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 97} " * 200) for i in range(400)], "doc_id long, text string")
    monkeypatch.setattr(packing, "RANGE_BYTES", 20_000)
    monkeypatch.setattr(packing, "SAMPLE", 100)
    monkeypatch.setattr(packing, "TO_A_RANGE", 5)
    bounds = packing.range_bounds(docs, 4)
    assert len(bounds) + 1 == -(-sum(len(f"word{i % 97} ") * 200 for i in range(400)) // 20_000)
    assert (packing.range_bounds(docs.repartition(9), 4) == bounds).all()
    places = lambda df: sorted((r.doc_id, r.start, r.length) for r in packing.packed_pieces(df, PATH).select("doc_id", "start", "length").collect())
    assert places(docs) == places(docs.repartition(3).orderBy("text"))
