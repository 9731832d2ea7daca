import random

import corpus_pipeline
from addrloom.llm import common, simhash
from addrloom.llm import near_copies as N
from pyspark.sql import functions as F


def brute(rows):
    """The least id of each document's component, over all pairs."""

    def grams(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return {d: least[top(i)] for i, (d, _) in enumerate(rows)}


def test_stage_keeps_one_of_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = brute(rows)
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, None).collect()}
    assert got == {d for d in want if want[d] == d}
    assert {56, 255, 770, 875, 944}.isdisjoint(got)


def test_chains_and_odd_texts(spark):
    rng = random.Random(3)
    rows, words = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "two words")], []
    for group in range(6):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(12):  # each step changes a word more, so that the ends are no near copies
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
    base = [f"b{k}" for k in range(150)]
    rows += [(len(rows) + k, " ".join([*base[:140], *(f"y{k} {i}" for i in range(k % 7))])) for k in range(60)]
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    assert {r.doc_id: r.component_id for r in N.groups(docs).collect()} == want
    assert N.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefix_filter_keeps_texts_with_a_shared_passage_apart(spark):
    """Half of each text is shared, some texts differ in few words: pairs are met only if they can be similar, and no similar one is missed."""
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(80))
    texts = [f"{passage} {' '.join(f'u{k}x{i}' for i in range(80))}" for k in range(30)]
    for k in range(10):
        words = texts[k].split()
        words[rng.randrange(80, 160)] = f"z{k}"
        texts.append(" ".join(words))
    sets = [N.shingle_set(x.encode().split(), 5) for x in texts]
    hard = spark.createDataFrame([(k, len(s), k) for k, s in enumerate(sets)], "node long, n long, c long")
    held = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "node long, shingles binary")
    met = {tuple(sorted((r.node, r._node))) for r in N._prefix_pairs(N._prefixes(hard, held, 0.8), 0.8).collect()}
    similar = {(i, j) for j in range(len(texts)) for i in range(j) if N.jaccard(sets[i], sets[j]) >= 0.8}
    assert similar <= met and len(similar) == 10
    assert len(met) <= 2 * len(similar)


def test_texts_without_copies_are_not_shuffled(spark):
    """One pair among long texts that are not alike, where no table is small enough to be broadcast."""
    rng = random.Random(11)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(1500)) for _ in range(300)]
    texts[7] = texts[6] + " more"
    docs = common.materialise(spark.createDataFrame([*enumerate(texts), (None, "no id"), (-5, None)], "doc_id long, text string"), "test-docs")
    sc = spark.sparkContext._jsc.sc()

    def shuffled() -> int:
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    threshold, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = [r.doc_id for r in simhash.one_of_each(docs, shingle=5, similarity=0.8).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(kept, key=str) == sorted([*(k for k in range(300) if k != 7), None, -5], key=str)
    assert shuffled() - before < 0.2 * sum(map(len, texts))


def test_marked_ids_hold_all(spark):
    ids = [0, -1, 5, 1 << 62, -(1 << 63), None, *range(1000, 3000, 7)]
    table = common.materialise(spark.createDataFrame([(x,) for x in ids], "id long"), "test-ids")
    rows = spark.createDataFrame([(x,) for x in [*ids, *range(10_000, 20_000)]], "id long")
    got = [r.id for r in rows.where(common.maybe_in(table, F.col("id"))).collect()]
    assert set(ids) <= set(got) and len(got) < len(ids) + 2000
    assert rows.where(common.maybe_in(common.materialise(table.limit(0), "test-ids"), F.col("id"))).count() == 0
