import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from addrloom.llm import toxicity as T
from tests.llm.test_decontaminate import brute
from tests.llm.test_near_copies import brute as brute_near_copies

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
    model, now = T.trained(spark, D), docs
    rows = {r.doc_id: r for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, now, D)
        assert out.columns == docs.columns
        got = out.collect()
        if k == 0:
            want = [d for (d, r), s in zip(rows.items(), model.scores(r.text.encode() for r in rows.values())) if round(s, 9) < 0.7]
        elif k == 1:
            comp = brute_near_copies([(d, r.text) for d, r in rows.items()])
            want = [d for d in rows if comp[d] == d]
        elif k == 2:
            hit = brute([(d, r.text) for d, r in rows.items()], items)
            want = [d for d in rows if not hit[d][1]]
        else:
            want = sorted(rows)
            assert 1 <= len(got) / len(rows) <= 2
            got = list({r.doc_id: r for r in got}.values())
        assert sorted(r.doc_id for r in got) == sorted(want) and want
        rows = {r.doc_id: r for r in got}
        now = spark.createDataFrame(got, docs.schema)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in corpus_pipeline.STAGES[4][1](spark, now, D).collect():
        ids = t.encode(rows[r.doc_id].text, add_special_tokens=False).ids + [2]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_run(spark):
    assert corpus_pipeline.run(spark, D).count() > 50
