import tracemalloc
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from addrloom.llm import token_files as T

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "  ", "It's they've 'S x's. don't!", "<|endoftext|> a<|startoftext|>b", "éa ẛ̣ ﬁ ﷺ", "A b c\x1cd\x85e", "ΑΣ ΣΑΣ İx ǅ", "日本語 123 ٣٤", "!!! ... a.b,c. é.. ß! _x_ a_.", "word " * 5000, "x" * 3000, "ab.' cd'. 'll. ̸. ≠"]


def expected(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def test_round_trip(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rows = [(i * 3 % 1009, x, 1, 2) for i, x in enumerate(texts)] + [(5, "twice", 1, 2), (5, "twice", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, shard int").repartition(4)
    got = sorted(T.token_digest(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    ids = {}
    for (d, x, *_), e in zip(rows, expected([r[1] for r in rows])):
        ids.setdefault(d, []).append((zlib.crc32(np.array(e, "<u4").tobytes()), len(e)))
    at = 0
    for r in got:
        assert (r.ids_crc32, r.n_tokens) in ids[r.doc_id]
        assert r.start == at
        at += r.n_tokens


def test_one_document_by_index(spark):
    docs = spark.createDataFrame([(i, f"alpha {i} beta") for i in range(20)], "doc_id long, text string").coalesce(1)
    manifest, folder = T.write(docs, PATH)
    row = manifest.orderBy("shard").first()
    files, path = T._open(f"{folder}/{row.dictionary}.zdict")
    reader = T.ShardReader(row.uri, files.open_input_stream(path).read())
    k = 0
    assert reader.ids(k).tolist() == expected([f"alpha {reader.doc_ids[k]} beta"])[0]


def test_empty_table(spark):
    assert T.token_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_known_chunks_take_no_object_each():
    """Their lookups were most of the time of op10_token_files: a text of known chunks may not become a Python object a chunk (33 bytes and more)."""
    for text in (b"alpha Beta, gamma. ", "alpha Ωmega gamma ".encode()):
        encoder, n = T.ChunkEncoder(PATH, 2), 200_000
        once = encoder.encode([text])[0]
        tracemalloc.start()
        ids = encoder.encode([text * n])[0]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert ids == once * n
        assert peak < 24 * n * len(text.split()) + 6 * len(text) * n, peak


def test_groups_of_one_kind_and_white_space():
    encoder = T.ChunkEncoder(PATH, 2)
    for texts in ([], [""], ["", "  ", "\t\n\x0b\x0c\r"], ["ab\tcd\nab\x0bcd\x0cab\rcd"], ["Ω\tß\nΩ\x0bß\x0cΩ\rß "], ["a. b,c", "Ω", "", "a. b,c", "Ω x"], [f"w{i}x q{i * 7919 % 1000:x}z" for i in range(3000)]):
        got = encoder.encode([x.encode() for x in texts])
        assert [np.frombuffer(x, "<u2").tolist() + [2] for x in got] == expected(texts)
