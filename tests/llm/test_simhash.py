import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from addrloom.llm import simhash as S


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def test_fingerprints_of_odd_texts():
    for t in ["", " \n", "One", "Two words", "É a\x85b c d e", "a b c a b c a b c", "x " * 70000]:
        assert S.fingerprint(t.encode()) == brute_fingerprint(t)


def test_keys_meet_within_two_bits():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**63, 40, dtype=np.uint64)
    for fp in fps:
        own = set(S.keys_of(np.array([fp]))[1].tolist())
        near = np.array([fp ^ np.uint64(1 << i) ^ np.uint64(1 << j) for i in range(64) for j in range(i)] + [fp ^ np.uint64(1 << i) for i in range(64)])
        rows, keys = S.keys_of(near)
        met = {int(r) for r, k in zip(rows, keys) if int(k) in own}
        assert len(met) == len(near)


@pytest.mark.parametrize("most", [1024, 3])
def test_links_connect_as_all_pairs_do(spark, most):
    rng = np.random.default_rng(7)
    fps = set()
    for seed in rng.integers(0, 2**63, 6, dtype=np.uint64):
        x = int(seed)
        for _ in range(25):
            fps.add(x)
            x ^= 1 << int(rng.integers(64))
            x ^= 1 << int(rng.integers(64)) if rng.random() < 0.6 else 7 << int(rng.integers(60))
    rows = [(i, x) for i, x in enumerate(sorted(fps))]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(x), i) for i, x in rows], "fp long, rep long")
    comp = {r.node: r.root for r in S.components(S.links(df, most)).collect()}
    want = brute_components(rows)
    by = {signed(x): i for i, x in rows}
    parts = {}
    for fp, i in by.items():
        parts.setdefault(comp.get(fp, fp), set()).add(i)
    wanted = {}
    for i, c in want.items():
        wanted.setdefault(c, set()).add(i)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, wanted.values()))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(300)
    more = spark.createDataFrame([(9001, None), (9002, ""), (9003, "one"), (9004, "One"), (9005, " \n ")], "doc_id long, text string")
    docs = docs.unionByName(more).withColumn("fp", F.lit("clash")).withColumn("key", F.lit(1)).cache()
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in S.groups(docs).collect()}
    want = brute_components(rows)
    assert got == {d: (fp, want[d]) for d, fp in rows}


def test_empty_table(spark):
    assert S.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
