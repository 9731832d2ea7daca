"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into segments A (22 bits), B and C (21 each). If two fingerprints differ in two bits at
most, then in one of the rings A-B, B-C, C-A the first segment is equal and the second differs in one bit at most
(pigeonhole over the nine ways to place two errors). A key is the first segment whole with the index of a Golay (23, 12)
codeword near the second. Words at distance 3 from their codeword are listed under the five codewords at distance 4 as
well; two words that differ in one bit then always share a codeword, since codewords are 7 bits apart. That gives 3 to
18 keys of 34 bits a fingerprint. Fingerprints that share a key are verified by their distance.

No bucket is expanded into pairs. Equal fingerprints are one row first. A key with two fingerprints gives the pair; up
to `most` of them are compared in one array and give a spanning forest of their links; beyond that, each fingerprint
lists itself and its 64 one-bit variants, and those that share a variant are linked to the least of them: two
fingerprints share a variant exactly if they differ in two bits at most, so that loses no connection and is linear.
Components come from alternating large-star and small-star rounds, each written to the shared folder.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; copies share a fingerprint;
repeated ids are kept, row by row; a null id is kept and is never a component's name, unless all its ids are null; only the id and the
text are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, maybe_in, release, table

SEED, SHINGLE, DISTANCE, MOST = 42, 3, 2, 1024
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def majority(hashes: np.ndarray, block: int = 1 << 15) -> int:
    """The bits that are set in over half of some hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), block):
        part = hashes[a : a + block]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bytes split and lower-case as ASCII does: blanks are space and \\t to \\r, and only A-Z change."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    return majority(np.fromiter((xxh64_intdigest(g, seed) for g in grams), np.uint64))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py() or b"") for x in b.column(1).cast(pa.large_binary())), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
        release()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


@lru_cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """remainders: of x^i by the generator for each bit i; leader: the least error of each remainder; beside: for remainders whose
    leader has three bits, the five errors of four bits."""
    from itertools import combinations

    rem = [1]
    for _ in range(22):
        x = rem[-1] << 1
        rem.append(x ^ GENERATOR if x >> 11 else x)
    leader, beside = np.zeros(2048, np.int64), [[] for _ in range(2048)]
    for weight in range(1, 5):
        for bits in combinations(range(23), weight):
            s = 0
            for i in bits:
                s ^= rem[i]
            e = sum(1 << i for i in bits)
            if weight < 4:
                leader[s] = e
            else:
                beside[s].append(e)
    return np.array(rem), leader, np.array([x if len(x) == 5 else [0] * 5 for x in beside])


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word six codeword indices; where fewer apply, the first is repeated."""
    rem, leader, beside = golay()
    s = np.zeros(len(words), np.int64)
    for i in range(23):
        s ^= ((words >> i) & 1) * rem[i]
    nearest = (words ^ leader[s]) >> 11
    others = (words[:, None] ^ beside[s]) >> 11
    others[~beside[s].any(axis=1)] = nearest[~beside[s].any(axis=1), None]
    return np.column_stack([nearest, others])


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all different keys of each fingerprint."""
    u = fps.view(np.uint64)
    cut = [((u >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    rows, keys = [], []
    for ring in range(3):
        index = codeword_indices(cut[(ring + 1) % 3])
        key = (np.int64(ring) << 34) | (cut[ring][:, None] << 12) | index
        new = np.ones(key.shape, bool)
        new[:, 1:] = index[:, 1:] != index[:, :1]
        r, c = np.nonzero(new)
        rows.append(r)
        keys.append(key[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def forest(fps: np.ndarray, distance: int = DISTANCE) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among some fingerprints: breadth first, each row compared with those not reached yet."""
    left, a, b = fps.view(np.uint64).copy(), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            for y in left[near]:
                a.append(int(x))
                b.append(int(y))
                queue.append(y)
            left = left[~near]
    signed = lambda v: np.array(v, np.uint64).view(np.int64).tolist()
    return signed(a), signed(b)


def _far(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """Verified links (a, b) between different fingerprints that connect what the full set of links connects. distinct: a written table
    with one row for each fp."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy()
            for k in range(0, len(fps), 8192):
                part = fps[k : k + 8192]
                rows, keys = keys_of(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(expand, "key long, fp long")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    counts = materialise(counts, "simhash-keys")
    pairs = counts.where("n = 2").where(_far(F.col("a"), F.col("b")) <= DISTANCE).select("a", "b")
    members = materialise(keyed.join(counts.where("n > 2").select("key", "n"), "key"), "simhash-members")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for group in batch.column(0):
                x, y = forest(group.values.to_numpy())
                a += x
                b += y
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    some = members.where(F.col("n") <= most).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(trees, "a long, b long")
    many = members.where(F.col("n") > most).select("fp").distinct()
    variant = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.when(i < 0, F.lit(0)).otherwise(F.lit(1)).cast("long"), F.greatest(i, F.lit(0)))))
    varied = many.select("fp", F.explode(variant).alias("v"))
    least = varied.groupBy("v").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("v", "a")
    stars = varied.join(least, "v").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(some).unionByName(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (a, b), root the least node reachable: alternating large-star and small-star until
    nothing changes. Least neighbours are written before they are joined, so that AQE can split a node with very many edges; tables of
    past rounds are deleted."""
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{label}-low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, f"{label}-large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}-least")
        joined = large.join(least, "u")
        small = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        past, edges = edges, materialise(small, label)
        for table_ in (past, low, large, least):
            discard(table_)
        now = edges.agg(F.count("*").alias("n"), F.countDistinct("u").alias("d"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == now and now.n == now.d:
            break
        mark = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id for each row."""
    prints = materialise(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    comp = materialise(components(links(distinct)), "simhash-components")
    named = comp.join(distinct, comp.node == distinct.fp).groupBy("root").agg(F.min("rep").alias("component_id"))
    changed = comp.join(named, "root").select(F.col("node").alias("fp"), "component_id")
    reps = distinct.join(changed, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    reps = materialise(reps, "simhash-reps")  # then both sides of the last join are plain exchanges, whose hot keys AQE can split
    return prints.join(reps, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The rows of docs, with their own columns, less the documents whose component has one of a lesser id. Rows of one id are one
    document. With a similarity, links are those of `near_copies`, else fingerprints of three-word shingles within two bits."""
    if similarity is None:
        found = groups(docs, doc_id, text)
    else:
        from . import near_copies

        found = near_copies.groups(docs, doc_id, text, shingle, similarity)
    lost = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_lost")).distinct()
    lost = materialise(lost, "simhash-lost")
    maybe = maybe_in(lost, F.col(doc_id))  # most rows are kept without a join
    return docs.where(~maybe).unionByName(docs.where(maybe).join(lost, F.col(doc_id) == F.col("_lost"), "left_anti"))


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_golay": op3_simhash_golay}
ORACLES: dict[str, str] = {}
