"""SimHash near-duplicates by a similarity: the general form of `simhash`, for links of a Jaccard similarity of 0.8 or more.

Two texts are near copies if their sets of shingles (five words) have a Jaccard similarity of 0.8 at least. Golay keys of their
fingerprints (see `simhash`) bring together texts whose fingerprints differ in two bits at most. At a similarity of 0.8,
however, fingerprints of 64 bits differ in 9.7 bits on average, and Golay keys wide enough for that meet by chance far too
often to be of use on many texts (README has the figures). MinHash bands of the same shingles therefore bring together the rest: 24 keys a
text, each over 4 minima, so that a pair of similarity 0.8 misses all of them with a chance of 3.2e-6, and more similar pairs with
less. Candidates are first held against each other by a byte of each of their 96 minima: the share of equal bytes estimates the
similarity with a deviation of 0.04, and a pair below `PLAUSIBLE`, six deviations under the threshold, is dropped (a pair of
similarity 0.8 with a chance under 1e-7). Every candidate that is left is checked on the whole sets, so links are exact.

Texts with equal words are one node first. In each key all nodes are checked against a hub. Where that leaves several
components in a key, its nodes go on by a prefix filter: shingles get one order, those of a single component first, then the rarer
ones, and of two similar sets from different components some of the first shingles are the same. So texts that share long
passages but are not similar do not meet, as their own shingles come first. In each such shingle nodes are checked against the one
with the least share of own shingles, the likeliest original, then pairs of components that are still apart, where the places of the
shingle leave room for the similarity. The filter is exact, so components are those of all pairs that meet in a key.

Defined cases: words are split and lower-cased as for fingerprints; a text of fewer words is one shingle; null and wordless
texts are copies of each other; nodes are named by 64 bits of their words' hash, as are shingles; ids are treated as in simhash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, forget, materialise, maybe_among, release, scratch
from .simhash import SEED, components, majority
from .simhash import links as golay_links

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 4
HUB_ORDERS = 4
PLAUSIBLE = 0.55  # share of equal bytes, for a threshold of 0.8


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of all shingles, repeats included."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    return np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64)


def shingle_set(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The different shingles' hashes, sorted."""
    return np.unique(shingle_hashes(words, shingle))


def node_of(words: list[bytes]) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(b" ".join(words), SEED + 1) - (1 << 63)


def minima(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS, block: int = 1 << 11) -> np.ndarray:
    """The least value of the shingles under each of some random orders."""
    rng = np.random.default_rng(SEED)
    times = rng.integers(0, 1 << 63, (bands * rows, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, (bands * rows, 1), np.uint64) * np.uint64(2)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), block):
        np.minimum(least, (times * shingles[k : k + block] + plus).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray, rows: int = ROWS) -> list[int]:
    from xxhash import xxh64_intdigest

    return [xxh64_intdigest(x.tobytes(), band) - (1 << 63) for band, x in enumerate(least.reshape(-1, rows))]


def sketch(least: np.ndarray) -> bytes:
    """A byte of each minimum, mixed first, as least values have low bits that differ little."""
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def _prints(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """doc_id, node, fp (the fingerprint), n (shingles), sketch and keys for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            nodes, prints, sizes, sketches, keys = [], [], [], [], []
            for x in b.column(1).cast(pa.large_binary()):
                words = (x.as_py() or b"").lower().split()
                hashes = shingle_hashes(words, shingle)
                found = np.unique(hashes)
                nodes.append(node_of(words))
                prints.append(majority(hashes))
                sizes.append(len(found))
                least = minima(found)
                sketches.append(sketch(least))
                keys.append(band_keys(least) if len(found) else [])
            fps = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), fps, pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "fp", "n", "sketch", "keys"])
        release()

    return _rows(docs, doc_id, text).mapInArrow(run, "doc_id long, node long, fp long, n long, sketch binary, keys array<long>")


def _sets(docs: DataFrame, doc_id: str, text: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """node and its set as bytes for each node of wanted (node, rep), a written table. Texts that cannot be wanted are not shuffled."""

    maybe_wanted = maybe_among(wanted.select("rep"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: set[tuple] = set()  # an id may hold a text many times: a task sends it once
        for b in batches:
            b = b.filter(maybe_wanted(b.column(0)))
            nodes = [node_of((x.as_py() or b"").lower().split()) for x in b.column(1).cast(pa.large_binary())]
            new = []
            for pair in zip(b.column(0).to_pylist(), nodes):
                new.append(pair not in seen)
                seen.add(pair)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nodes, pa.int64())], names=["doc_id", "text", "node"]).filter(pa.array(new, pa.bool_()))
        release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            sets = [shingle_set((x.as_py() or b"").lower().split(), shingle).tobytes() for x in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])
        release()

    rows = _rows(docs, doc_id, text).mapInArrow(named, "doc_id long, text string, node long")
    one = rows.join(wanted.withColumnRenamed("node", "_node"), (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    return materialise(one.dropDuplicates(["node", "rep"]).select("node", "text").mapInArrow(run, "node long, shingles binary"), "near-sets")


def _golay_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs of nodes (node, n, _node, _n) whose fingerprints are equal or linked by Golay keys. Nodes of one fingerprint are paired with the
    least of them, and linked fingerprints by their least nodes."""
    least = F.min(F.struct("node", "n")).alias("low")
    prints = materialise(distinct.groupBy("fp").agg(least, F.count("*").alias("m")).select("fp", F.col("low.node").alias("_node"), F.col("low.n").alias("_n"), "m"), "near-fps")
    equal = distinct.join(prints.where("m > 1"), "fp").where("node <> _node").select("node", "n", "_node", "_n")
    side = lambda c, node, n: prints.select(F.col("fp").alias(c), F.col("_node").alias(node), F.col("_n").alias(n))
    linked = golay_links(prints.select("fp")).join(side("a", "node", "n"), "a").join(side("b", "_node", "_n"), "b")
    return equal.unionByName(linked.select("node", "n", "_node", "_n"))


def _plausible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sketches do not rule out the similarity."""
    least = similarity - (SIMILARITY - PLAUSIBLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(b.num_rows, -1) for k in (2, 3))
            yield b.select([0, 1]).filter(pa.array((x == y).mean(axis=1) >= least)) if b.num_rows else b.select([0, 1])

    a = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x"))
    b = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            left, right = b.column(2), b.column(3)
            good = [jaccard(np.frombuffer(left[k].as_py(), np.uint64), np.frombuffer(right[k].as_py(), np.uint64)) >= similarity for k in range(b.num_rows)]
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))
        release()

    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _prefixes(hard: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The first shingles of each node (node, n, c) in one order of all: those of one component alone, then the rarer ones. Rows are node, n,
    c, own (how many come first that no other component has), pos (counted from 1) and key (the shingle), for as many as two sets of
    that similarity must share one of; those that one component alone has are left out, as they make no pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            sizes = [0, *(len(x.as_py()) // 8 for x in b.column(1))]
            values = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(values))], names=["node", "keys"])
        release()

    spread = sets.select("node", "shingles").mapInArrow(run, "node long, keys array<long>").join(hard, "node").select("node", "n", "c", F.explode("keys").alias("key"))
    common = spread.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key", "m")
    met = spread.join(materialise(common, "near-common"), "key").groupBy("node").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.sort_array(F.collect_list(F.struct("m", "key"))).alias("keys"))
    met = met.withColumn("own", F.col("n") - F.size("keys")).withColumn("most", F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1 - F.col("own"))
    first = met.where("most > 0").select("node", "n", "c", "own", F.posexplode(F.slice("keys", F.lit(1), F.col("most").cast("int"))).alias("k", "x"))
    return materialise(first.select("node", "n", "c", "own", (F.col("own") + F.col("k") + 1).alias("pos"), F.col("x.key").alias("key")), "near-prefixes")


def _prefix_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (node, n, _node, _n) of different components that share a first shingle, at places that leave room for the similarity. The
    smaller set of a pair needs fewer of its first shingles."""
    share = similarity / (1 + similarity)
    small = rows.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * 2 * share - 1e-9) + 1)
    other = rows.select("key", *(F.col(x).alias(f"_{x}") for x in ("node", "n", "c", "pos")))
    room = 1 + F.least(F.col("n") - F.col("pos"), F.col("_n") - F.col("_pos")) >= (F.col("n") + F.col("_n")) * share - 1e-9
    near = (F.col("n") <= F.col("_n")) & (F.col("n") >= F.col("_n") * (similarity - 1e-9))
    return small.join(other, "key").where((F.col("c") != F.col("_c")) & near & room).select("node", "n", "_node", "_n")


def links(members: DataFrame, pairs: DataFrame, distinct: DataFrame, sets_of, similarity: float = SIMILARITY) -> DataFrame:
    """Verified links (a, b) that connect what all similar pairs of a key, and the given pairs (node, n, _node, _n), would connect.
    members: a written table of different (key, node, n); sets_of makes the sets of some nodes."""

    def ordered(pairs: DataFrame) -> DataFrame:
        near = F.least("n", "_n") >= F.greatest("n", "_n") * (similarity - 1e-9)  # less similar by their sizes alone
        return pairs.where(near).select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()

    def checked(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        likely = materialise(_plausible(pairs, distinct, similarity), "near-likely")
        if sets is not None:
            return materialise(_verified(likely, sets, similarity), "near-links")
        nodes = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
        return materialise(_verified(likely, sets_of(nodes), similarity), "near-links")

    order = F.struct(F.xxhash64(F.pmod("key", F.lit(HUB_ORDERS)), "node").alias("o"), F.col("node"), F.col("n"))
    hubs = members.groupBy("key").agg(F.min(order).alias("hub")).select("key", F.col("hub.node").alias("_node"), F.col("hub.n").alias("_n"))
    met = members.join(hubs, "key").where("node <> _node").select("node", "n", "_node", "_n")
    tried = materialise(ordered(met.unionByName(pairs)), "near-pairs")
    first = checked(tried)

    comp = materialise(components(first, "near-steps"), "near-components")
    named = members.join(comp.select("node", "root"), "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("c"))
    named = materialise(named, "near-named")
    counts = named.groupBy("key", "c").agg(F.count("*").alias("m"))
    split = counts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("m").alias("m")).where("parts > 1 and m > 2").select("key")
    hard = materialise(named.join(split, "key").select("node", "n", "c").distinct(), "near-hard")
    if hard.isEmpty():
        return first
    sets = sets_of(hard.select("node"))
    rows = _prefixes(hard, sets, similarity)

    hubs = rows.groupBy("key").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("o"), F.col("node"), F.col("n"), F.col("c"))).alias("hub"))
    hubs = materialise(hubs.select("key", F.col("hub.node").alias("_node"), F.col("hub.n").alias("_n"), F.col("hub.c").alias("_c")), "near-hubs")
    central = ordered(rows.join(hubs, "key").where("c <> _c").select("node", "n", "_node", "_n")).join(tried, ["a", "b"], "left_anti")
    central = materialise(central, "near-pairs")
    first = materialise(first.unionByName(checked(central, sets)), "near-links")

    comp = materialise(components(first, "near-steps"), "near-components")
    rows = rows.join(comp.select("node", "root"), "node", "left").withColumn("c", F.coalesce("root", "node")).drop("root")
    rows = materialise(rows, "near-prefixes")
    met = _prefix_pairs(rows, similarity)
    more = materialise(ordered(met).join(tried.unionByName(central), ["a", "b"], "left_anti"), "near-pairs")
    return first if more.isEmpty() else first.unionByName(checked(more, sets))


def _groups(docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """As groups, and the tables that the result reads."""
    prints = materialise(_prints(docs, doc_id, text, shingle), "near-prints")
    distinct = materialise(prints.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")), "near-distinct")
    keyed = distinct.select("node", "n", F.explode("keys").alias("key"))
    shared = materialise(keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key"), "near-keys")
    members = materialise(keyed.join(shared, "key").select("key", "node", "n"), "near-members")
    pairs = materialise(_golay_pairs(distinct), "near-golay")

    def sets_of(nodes: DataFrame) -> DataFrame:
        return _sets(docs, doc_id, text, shingle, materialise(distinct.select("node", "rep").join(nodes, "node"), "near-wanted"))

    comp = materialise(components(links(members, pairs, distinct, sets_of, similarity), "near-steps"), "near-components")
    named = comp.join(distinct.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("component_id"))
    changed = comp.join(named, "root").select("node", "component_id")
    reps = distinct.select("node", "rep").join(changed, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    reps = materialise(reps, "near-reps")
    return prints.select("doc_id", "node").join(reps, "node").select("doc_id", "component_id"), [prints, reps]


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id for each row. All other tables written on the way are deleted."""
    with scratch() as made:
        out, needed = _groups(docs, doc_id, text, shingle, similarity)
    for x in made:
        if not any(x is y for y in needed):
            discard(x)
    return out
