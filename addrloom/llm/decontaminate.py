"""Benchmark decontamination by suffix arrays over the training shards.

A task gathers documents to shards of some megabytes. A shard's words are hashed, ranked, and all its suffixes sorted by
prefix doubling (only suffixes that still tie are sorted again) to a depth that covers a window. The suffixes of all
test items are then searched in the array at once, one for each different window: word by word the interval of shard suffixes
that agree is narrowed by binary search, and the interval holds every place of the window. Different windows of one size
have intervals apart from each other, so places are listed once, however often words repeat. Words that are hit are
compared byte by byte. The longest verbatim match of each document is found by extending matches at hit places in the suffix
array of the items, by powers of two, so it costs no more than the hit words times two logarithms.

Test items lie in the shared folder as blocks of bounded size, as many as there need be. Each shard searches one block after
another, and a worker keeps `KEPT` of them, so neither a long text nor a large test set has to fit as a whole; documents are never
shuffled.

Defined cases: a null or wordless text has no words and no hits; a wordless item has no windows; an item shorter than a
window is one window; repeated documents are judged row by row; an item id counts once however many rows it has; a null
item id is the empty string; only ids and texts are read; an empty table on either side gives no hits or no rows. A
text of over `PIECE` bytes is searched in overlapping pieces, and its longest match may run over any number of them. Of longest matches of
one length the first place counts, and of items that match there the one with the least id.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, keep_rows, materialise, release, table
from .token_files import _open, write_file

WINDOW = 10
PIECE = 2 << 20  # bytes of a shard, and of a text that is searched at once
BLOCK = 2 << 20  # bytes of test items in one block
KEPT = 2  # blocks that a worker keeps
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

_CLASS = np.zeros(256, bool)
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
LONG = 48  # bytes from which a word is hashed alone


def words_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some bytes start and end."""
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = _CLASS[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hash_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z as a-z."""
    from xxhash import xxh64_intdigest

    low, size = _LOW[buf], end - start
    h = size.astype(np.uint64)
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -LONG + 1, "left") :] if len(size) and size.max() >= LONG else order
    at, left, acc = start[order], size[order], h[order]
    n = len(order)
    for j in range(int(left[0]) if n else 0):
        n = int(np.searchsorted(-left[:n], -j, "left"))  # those longer than j
        acc[:n] = (acc[:n] ^ low[at[:n] + j]) * _P
        acc[:n] ^= acc[:n] >> np.uint64(29)
    h[order] = acc
    for k in np.flatnonzero(size >= LONG):
        h[k] = xxh64_intdigest(low[start[k] : end[k]].tobytes())
    return h


def suffix_array(rank: np.ndarray, depth: int, levels: list | None = None) -> np.ndarray:
    """All suffixes of a word sequence in the order of their first words, at least `depth` of them. levels takes for 1, 2, 4.. words the
    place where each suffix's group of ties starts."""
    n = len(rank)
    sa = np.argsort(rank, kind="stable")
    first = np.concatenate([[True], np.diff(rank[sa]) != 0]) if n else np.zeros(0, bool)
    place = np.zeros(n + 1, np.int64)  # of a suffix: where its group of ties starts in the array; the end comes first
    place[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0)) + 1
    k = 1
    while k < depth:
        if levels is not None:
            levels.append(place.copy())
        alone = first & np.concatenate([first[1:], [True]])
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            if levels is None:
                break
            k *= 2
            continue
        pos = sa[open_]
        key = place[pos] * np.int64(n + 2) + place[np.minimum(pos + k, n)]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[True], np.diff(key) != 0])
        sa[open_] = pos[order]
        first[open_] = new
        place[sa[open_]] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] + 1
        k *= 2
    if levels is not None:
        levels.append(place)
    return sa


def narrow(values: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, t, want: np.ndarray, right: bool) -> np.ndarray:
    """Binary search, for all queries at once, of the word at offset t (one, or one a query) in each query's interval of the suffix array."""
    lo, hi, last = lo.copy(), hi.copy(), len(values) - 1
    while True:
        going = lo < hi
        if not going.any():
            return lo
        mid = (lo + hi) >> 1
        v = values[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + t, last)]
        up = going & ((v <= want) if right else (v < want))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(going & ~up, mid, hi)


def same_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the words i are the words j, byte by byte, with A-Z as a-z."""
    size = end[i] - start[i]
    same = size == end[j] - start[j]
    for t in range(int(min(LONG, size.max(initial=0)))):
        k = np.flatnonzero(same & (size > t))
        same[k] = _LOW[buf[start[i[k]] + t]] == _LOW[buf[start[j[k]] + t]]
    for k in np.flatnonzero(same & (size > LONG)):
        same[k] = bytes(_LOW[buf[start[i[k]] : end[i[k]]]]) == bytes(_LOW[buf[start[j[k]] : end[j[k]]]])
    return same


class Items:
    """A block of test items: their words, and their different windows with the items that hold them."""

    def __init__(self, ids: list[str], texts: list[bytes], window: int):
        self.ids, self.window = ids, window
        self.words = [[w.lower() for w in WORD.findall(x)] for x in texts]
        joined = np.frombuffer(b"\n".join(texts), np.uint8)
        self.hashes = hash_words(joined, *words_of(joined))
        counts = np.array([len(x) for x in self.words], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(counts)])
        sizes = np.minimum(counts, window)
        n_windows = np.where(counts > 0, counts - sizes + 1, 0)
        item = np.repeat(np.arange(len(ids)), n_windows)
        at = self.offsets[item] + np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        size = sizes[item]
        kind = np.zeros(len(at), np.int64)
        for n in np.unique(size):
            k = size == n
            kind[k] = self._classes(int(n))[at[k]] * (window + 1) + n
        _, first, which = np.unique(kind, return_index=True, return_inverse=True)
        self.at, self.size, self.item = at[first], size[first], item[first]  # of each different window, one place
        pairs = np.unique(which.astype(np.int64) * max(1, len(ids)) + item)
        self._window_of, self._item_of = pairs // max(1, len(ids)), pairs % max(1, len(ids))
        self._sets: dict[bytes, frozenset] = {}
        self._array = None

    def _classes(self, n: int) -> np.ndarray:
        """Equal numbers where the same n words stand, by joining classes of powers of two; only places inside an item count."""
        one = np.unique(self.hashes, return_inverse=True)[1].astype(np.int64)
        whole, done, power, k = None, 0, one, 1
        while True:
            if n & k:
                whole, done = (power, k) if whole is None else (self._joined(whole, power, done), done + k)
            k *= 2
            if k > n:
                return whole
            power = self._joined(power, power, k // 2)

    @staticmethod
    def _joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        at = np.minimum(np.arange(len(a)) + shift, len(a) - 1)
        return np.unique(a * (len(a) + 1) + b[at], return_inverse=True)[1].astype(np.int64)

    def items_of(self, window: int) -> frozenset:
        """The ids of the items that hold a window; windows with the same items share the set."""
        a, b = np.searchsorted(self._window_of, [window, window + 1])
        key = self._item_of[a:b].tobytes()
        if key not in self._sets:
            self._sets[key] = frozenset(self.ids[k] for k in self._item_of[a:b])
        return self._sets[key]

    def array(self) -> tuple:
        """The suffix array of the items, with an end mark behind each: vocabulary, array, levels, the item of each place, and for each
        level the pairs of its groups with the group that they form on the next."""
        if self._array is None:
            n, counts = len(self.hashes), np.diff(self.offsets)
            vocabulary, rank = np.unique(self.hashes, return_inverse=True)
            owner = np.repeat(np.arange(len(counts)), counts)
            text = np.zeros(n + len(counts), np.int64)
            text[np.arange(n) + owner] = rank + 1
            levels: list[np.ndarray] = []
            sa = suffix_array(text, int(counts.max(initial=1)) + 1, levels)
            first = np.zeros(len(vocabulary) + 1, np.int64)
            first[text] = levels[0][:-1]
            joins, m = [], len(text)
            for k in range(len(levels) - 1):
                key = levels[k][:-1] * np.int64(m + 2) + levels[k][np.minimum(np.arange(m) + (1 << k), m)]
                key, at = np.unique(key, return_index=True)
                joins.append((key, levels[k + 1][at]))
            self._array = vocabulary, first, sa, levels, np.repeat(np.arange(len(counts)), counts + 1), joins
        return self._array

    def longest(self, hashes: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of a text the length of the longest match from it, and its interval of the suffix array. Words of one run stand
        one after another, and no match leaves its run."""
        vocabulary, first, sa, levels, _, joins = self.array()
        known = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        n, m = len(hashes), len(sa)
        here = np.where(vocabulary[known] == hashes, first[known + 1], -1)
        classes = [here]
        for k, (keys, values) in enumerate(joins):
            b = np.minimum(np.arange(n) + (1 << k), n - 1)
            whole = (np.arange(n) + (1 << k) < n) & (run[b] == run) & (here >= 0) & (here[b] >= 0)
            key = np.where(whole, here * np.int64(m + 2) + here[b], -1)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            here = np.where(whole & (keys[at] == key), values[at], -1)
            classes.append(here)
        lo, hi, size = np.zeros(n, np.int64), np.full(n, m), np.zeros(n, np.int64)
        for k in range(len(classes) - 1, -1, -1):
            at = np.arange(n) + size
            want = np.where((at < n) & (run[np.minimum(at, n - 1)] == run), classes[k][np.minimum(at, n - 1)], -1)
            go = np.flatnonzero(want >= 0)
            a = narrow(levels[k], sa, lo[go], hi[go], size[go], want[go], False)
            b = narrow(levels[k], sa, lo[go], hi[go], size[go], want[go], True)
            good = a < b
            go = go[good]
            lo[go], hi[go] = a[good], b[good]
            size[go] += 1 << k
        return size, lo, hi

    def best(self, hashes: np.ndarray, words: np.ndarray, doc: np.ndarray, short: list[tuple]) -> list[tuple]:
        """For each document with hits its longest match as (doc, words, word, item). words: those hit, sorted; doc: their documents;
        short: matches of items shorter than a window."""
        out: dict[int, tuple] = {}
        for d, n, w, i in short:
            out[d] = max(out.get(d, (0, 0, "")), (n, w, i), key=_better)
        if len(words):
            run = np.cumsum(np.concatenate([[True], (np.diff(words) != 1) | (np.diff(doc) != 0)]))
            size, lo, hi = self.longest(hashes, run)
            order = np.lexsort((words, -size, doc))
            first = order[np.concatenate([[True], np.diff(doc[order]) != 0])]
            _, _, sa, _, owner, _ = self.array()
            for k in first[size[first] >= self.window].tolist():
                item = min(self.ids[i] for i in np.unique(owner[sa[lo[k] : hi[k]]]))
                d = int(doc[k])
                out[d] = max(out.get(d, (0, 0, "")), (int(size[k]), int(words[k]), item), key=_better)
        return [(d, *x) for d, x in out.items()]


class _Reversed(str):
    def __lt__(self, other: str) -> bool:
        return str.__gt__(self, other)

    def __gt__(self, other: str) -> bool:
        return str.__lt__(self, other)


def _better(match: tuple) -> tuple:
    return match[0], -(match[1] or 0), _Reversed(match[2] or "")


class Shard:
    def __init__(self, texts: list[bytes], window: int):
        self.raw = b"\n".join(texts)
        self.buf = buf = np.frombuffer(self.raw, np.uint8)
        self.start, self.end = words_of(buf)
        n, bounds = len(self.start), np.cumsum([len(x) + 1 for x in texts])
        self.doc = np.searchsorted(bounds, self.start, "right")
        self.n_words = np.bincount(self.doc, minlength=len(texts))
        self.base = np.concatenate([[0], np.cumsum(self.n_words)[:-1]]).astype(np.int64)
        self.vocabulary, self.first, rank = np.unique(hash_words(buf, self.start, self.end), return_index=True, return_inverse=True)
        self.word_rank = rank
        # One end mark after each document's words, of rank 0, which no test word has.
        slot = np.arange(n) + self.doc
        self.rank = np.zeros(n + len(texts), np.int64)
        self.rank[slot] = rank + 1
        self.word_at = np.full(n + len(texts), -1, np.int64)
        self.word_at[slot] = np.arange(n)
        self.sa = suffix_array(self.rank, window)

    def search(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """(window, word of the shard where it occurs) for every place of every different window."""
        none = np.zeros(0, np.int64)
        if not len(self.vocabulary) or not len(items.at):
            return none, none
        known = np.minimum(np.searchsorted(self.vocabulary, items.hashes), len(self.vocabulary) - 1)
        rank = np.where(self.vocabulary[known] == items.hashes, known + 1, -1)
        live = np.flatnonzero(rank[items.at] > 0)
        leading = self.rank[self.sa]
        lo = np.searchsorted(leading, rank[items.at[live]], "left")
        hi = np.searchsorted(leading, rank[items.at[live]], "right")
        done, dlo, dhi, t = [], [], [], 1
        while len(live):
            full = (items.size[live] == t) & (lo < hi)
            done.append(live[full])
            dlo.append(lo[full])
            dhi.append(hi[full])
            go = (items.size[live] > t) & (lo < hi)
            live, lo, hi = live[go], lo[go], hi[go]
            want = rank[items.at[live] + t]
            lo, hi = narrow(self.rank, self.sa, lo, hi, t, want, False), narrow(self.rank, self.sa, lo, hi, t, want, True)
            t += 1
        done, dlo, dhi = (np.concatenate(x) if x else none for x in (done, dlo, dhi))
        n = dhi - dlo
        which = np.repeat(np.arange(len(done)), n)
        place = self.sa[dlo[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        window, word = done[which], self.word_at[place]
        if not len(window):
            return none, none
        # Equal hashes are equal words: the shard's are compared with the first of theirs, and one place of each window with the item's.
        words = np.flatnonzero(np.cumsum(self._cover(word, items.size[window])[:-1]) > 0)
        heads = np.concatenate([[0], np.cumsum(n[n > 0])[:-1]])
        if same_words(self.buf, self.start, self.end, words, self.first[self.word_rank[words]]).all() and all(self._same(items, int(window[k]), int(word[k])) for k in heads):
            return window, word
        sure = [self._same(items, int(w), int(p)) for w, p in zip(window, word)]
        return window[sure], word[sure]

    def _cover(self, word: np.ndarray, size: np.ndarray) -> np.ndarray:
        cover = np.bincount(word, minlength=len(self.start) + 1)
        return cover - np.bincount(word + size, minlength=len(self.start) + 1)

    def _same(self, items: Items, window: int, word: int) -> bool:
        k, n = int(items.item[window]), int(items.size[window])
        j = int(items.at[window] - items.offsets[k])
        found = WORD.findall(self.raw[self.start[word] : self.end[word + n - 1]])
        return [w.lower() for w in found] == items.words[k][j : j + n]

    def hits(self, items: Items) -> tuple[np.ndarray, dict[int, set], list[tuple]]:
        """The words that the block hits; the items of each document; matches of short items as (doc, words, word, item)."""
        window, word = self.search(items)
        if not len(window):
            return word, {}, []
        hit = np.flatnonzero(np.cumsum(self._cover(word, items.size[window])[:-1]) > 0)
        doc = self.doc[word]
        sets: dict[int, dict[int, frozenset]] = {}
        n = np.int64(len(items.at) + 1)
        for pair in np.unique(doc * n + window).tolist():
            x = items.items_of(int(pair % n))
            sets.setdefault(int(pair // n), {})[id(x)] = x
        short = []
        for k in np.unique(window[items.size[window] < items.window]).tolist():
            at = np.sort(word[window == k])
            docs, first = np.unique(self.doc[at], return_index=True)
            short += [(int(d), int(items.size[k]), int(at[f]), min(items.items_of(k))) for d, f in zip(docs, first)]
        return hit, {d: set().union(*x.values()) for d, x in sets.items()}, short

    def matches(self, blocks: Iterable[Items], longest: bool = True) -> tuple[np.ndarray, list[set], list[tuple]]:
        """The words that are hit, and for each document the ids of its items and its longest match (words, start, item)."""
        hit, n_docs = np.zeros(len(self.start), bool), len(self.n_words)
        found: list[set] = [set() for _ in range(n_docs)]
        best: list[tuple] = [(0, None, None)] * n_docs
        for items in blocks:
            words, sets, short = self.hits(items)
            hit[words] = True
            for d, x in sets.items():
                found[d] |= x
            if longest and len(words):
                for d, n, w, i in items.best(self.vocabulary[self.word_rank[words]], words, self.doc[words], short):
                    best[d] = max(best[d], (n, w - int(self.base[d]), i), key=_better)
        return hit, found, best


def judge_long(text: bytes, blocks: Blocks, window: int, piece: int) -> tuple:
    """A text of over a piece: pieces overlap by a window less one word, and their hits are joined by the word's number."""
    start, end = words_of(np.frombuffer(text, np.uint8))
    cover, items, hashes = np.zeros(len(start), bool), set(), np.zeros(len(start), np.uint64)
    words: dict[int, list] = {}
    short: dict[int, list] = {}
    a = 0
    while a < len(start):
        b = max(int(np.searchsorted(end, start[a] + piece, "right")), min(a + 2 * window, len(start)))
        s = Shard([text[start[a] : end[b - 1]]], window)
        hashes[a:b] = s.vocabulary[s.word_rank]
        for k, block in enumerate(blocks):
            hit, found, small = s.hits(block)
            if len(hit):
                cover[a + hit] = True
                items |= found[0]
                words.setdefault(k, []).append(a + hit)
                short.setdefault(k, []).extend((0, n, a + w, i) for _, n, w, i in small)
        a = b if b == len(start) else b - window + 1
    longest = (0, None, None)
    for k, found in words.items():
        at = np.unique(np.concatenate(found))
        for _, n, w, i in blocks[k].best(hashes[at], at, np.zeros(len(at), np.int64), short[k]):
            longest = max(longest, (n, w, i), key=_better)
    return len(start), int(cover.sum()), items, longest


class Blocks:
    """The blocks of test items in the shared folder, read one after another; a worker keeps the last ones."""

    kept: dict[tuple, Items] = {}

    def __init__(self, uris: list[str], window: int):
        self.uris, self.window = uris, window

    def __len__(self) -> int:
        return len(self.uris)

    def __getitem__(self, k: int) -> Items:
        key = self.uris[k], self.window
        if key not in Blocks.kept:
            while len(Blocks.kept) >= KEPT:
                Blocks.kept.pop(next(iter(Blocks.kept)))
            files, path = _open(self.uris[k])
            with files.open_input_stream(path) as f:
                Blocks.kept[key] = Items(*pickle.loads(f.read()), self.window)
        return Blocks.kept[key]

    def __iter__(self) -> Iterator[Items]:
        return (self[k] for k in range(len(self)))


def stored_blocks(benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK, item_id: str = "item_id", item_text: str = "text") -> Blocks:
    """Writes the test items as blocks of about `block` bytes; the driver sees a path for each."""
    spark = benchmark.sparkSession
    folder = fresh_path(spark, "benchmark")
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get(), 0
        ids, texts, held = [], [], 0

        def put() -> pa.RecordBatch:
            uri = f"{folder}/{task.partitionId():06d}-{n:04d}-{task.taskAttemptId()}"
            write_file(uri, iter([pickle.dumps((ids, texts))]))
            return pa.RecordBatch.from_pydict({"uri": [uri]})

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1).cast(pa.large_binary())):
                ids.append(i.as_py())
                texts.append(t.as_py())
                held += len(texts[-1])
                if held >= block:
                    yield put()
                    n, ids, texts, held = n + 1, [], [], 0
        if ids:
            yield put()

    uris = materialise(rows.repartition(1 + size // (8 * block)).mapInArrow(write, "uri string"), "benchmark-blocks")
    return Blocks(sorted(r.uri for r in uris.collect()), window)


def clean_rows(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """The rows of docs, with their own columns, that hold no window of the benchmark."""
    blocks = stored_blocks(benchmark, window)

    def make_mask():
        def mask(texts: list[bytes]) -> list[bool]:
            short = [x for x in texts if len(x) <= piece]
            s = Shard(short, window)
            found = iter(s.matches(blocks, longest=False)[1])
            return [not (next(found) if len(x) <= piece else judge_long(x, blocks, window, piece)[2]) for x in texts]

        return mask

    return keep_rows(docs, text, make_mask, piece)


def judge(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, items (the ids, sorted as strings), longest match (words, start word, item) for each row."""
    blocks = stored_blocks(benchmark, window, block, item_id, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list, results: list) -> pa.RecordBatch:
            n_words, n_hit, items, longest = zip(*results)
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.concat_arrays(ids), "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                "longest_words": pa.array([x[0] for x in longest], pa.int64()), "longest_start": pa.array([x[1] for x in longest], pa.int64()), "longest_item": pa.array([x[2] for x in longest], pa.string()),
            })

        def shard(texts: list[bytes]) -> list[tuple]:
            s = Shard(texts, window)
            hit, found, longest = s.matches(blocks)
            return list(zip(s.n_words.tolist(), np.bincount(s.doc[hit], minlength=len(texts)).tolist(), found, longest))

        ids, texts, size = [], [], 0
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            for k in range(batch.num_rows):
                x = column[k].as_py() or b""
                if len(x) > piece:
                    if texts:
                        yield out(ids, shard(texts))
                        ids, texts, size = [], [], 0
                    yield out([batch.column(0).slice(k, 1)], [judge_long(x, blocks, window, piece)])
                    continue
                ids.append(batch.column(0).slice(k, 1))
                texts.append(x)
                size += len(x)
                if size >= piece:
                    yield out(ids, shard(texts))
                    ids, texts, size = [], [], 0
        if texts:
            yield out(ids, shard(texts))
        release()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<string>, longest_words long, longest_start long, longest_item string")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest_words", "longest_start", "longest_item")


def _sql_words(text: str) -> str:
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_words("text")} AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, coalesce(CAST(item_id AS VARCHAR), '') AS item, {_sql_words("text")} AS w FROM benchmark),
bw AS (
  SELECT q, item, n, unnest(range(1, len(w) - n + 2)) AS j, w FROM (SELECT *, least({WINDOW}, len(w)) AS n FROM b) WHERE n > 0
), bk AS (SELECT q, item, n, j, array_to_string(w[j:j + n - 1], ' ') AS win FROM bw),
dw AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, (SELECT DISTINCT n FROM bk) WHERE len(w) >= n),
dk AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM dw),
m AS (SELECT r, p, n, q, j, item FROM dk JOIN bk USING (n, win)),
hit AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS word FROM (SELECT DISTINCT r, p, n FROM m)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM m) GROUP BY r),
island AS (SELECT r, item, min(p) - 1 AS start, count(*) + min(n) - 1 AS size
  FROM (SELECT *, p - row_number() OVER (PARTITION BY r, q, p - j ORDER BY p) AS g FROM m) GROUP BY r, q, item, p - j, g),
best AS (SELECT r, item, start, size FROM island QUALIFY row_number() OVER (PARTITION BY r ORDER BY size DESC, start, item) = 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(size, 0) AS BIGINT) AS longest_words, CAST(start AS BIGINT) AS longest_start, best.item AS longest_item
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r) LEFT JOIN best USING (r)
"""

QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES = {"op1_decontaminate": ORACLE}
