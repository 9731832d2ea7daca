"""Token files: every document's ids compressed alone with a zstandard dictionary that all shards share.

Format of a shard (little-endian): magic `ALZDOC1\\n`, SHA-256 of the dictionary (32 bytes), then one zstandard frame a
document over its ids as unsigned 16-bit integers (32-bit for vocabularies over 65,536), then the index: n doc_ids as
int64, n null marks as uint8, n + 1 frame offsets as uint64, n counts of ids as uint64; then n, the index's offset and
the width of an id as uint64, and the magic again. The last 32 bytes lead to the index, so one document is read by two
short reads and decoded without its neighbours. The dictionary lies beside the shards as `<sha256>.zdict`.

Writing: a range shuffle deals the rows in ascending id order, each task encodes, compresses and writes one shard under
a name of its own attempt, and returns a manifest row. The manifest, written as a table, alone says which files count,
so an attempt that was lost or ran twice does no harm.

Defined cases: a null text counts as empty, an empty text has the end id alone; a null id is kept, first in order;
repeated ids stay, ordered by a hash of their text; only the id and the text are read; an empty table gives no shard.
The dictionary is trained on the ids of about `dictionary_docs` documents, four times as many at most, picked by a hash of
the id; it only changes the size of the files. The memory of chunks already encoded is bounded and changes nothing but speed.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, kept, materialise, release, table

MAGIC = b"ALZDOC1\n"
MEMO_ENTRIES = 200_000
#: White space between chunks, as blanks.
BLANKS = bytes(ord(" ") if chr(c) in "\t\n\x0b\f\r" else c for c in range(256))
#: Of Latin-1: its lower case, and the kinds of its characters: blanks, `a` letters and digits, `.` full stop and comma, `#` others.
LOWER = bytes(ord(chr(c).lower()) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 256 else c for c in range(256))
KINDS = bytes(ord(" " if chr(c) in " \t\n\x0b\f\r" else "." if chr(c) in ".," else "a" if chr(c).isascii() and chr(c).isalnum() or 192 <= c and c not in (215, 247) else "#") for c in range(256))


class ChunkEncoder:
    """Encodes a text chunk by chunk (chunks lie between ASCII blanks) and remembers chunks it has seen.

    It serves tokenizers whose pre-tokenizer never joins characters across white space and drops white space, as
    `word_bpe_49k.json` does; then the ids of a text are those of its chunks, in order.
    """

    TAIL = b".,!?$%&*|#;:"

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(f"<u{width}")
        self.letters = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
        self.plain: tuple[dict, dict] = ({}, {})
        self.mixed: tuple[dict, dict] = ({}, {})
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    def parted(self, text: bytes) -> tuple[bytes, bool]:
        """A text with a blank behind each chunk, and whether it is Latin-1 in lower case: so for a text in Latin-1 whose full stops and
        commas touch no other mark. Those are pieces of their own then and are set apart, which leaves far fewer different chunks."""
        try:
            latin = text.decode().encode("latin-1")
        except UnicodeEncodeError:
            return text.translate(BLANKS) + b" ", False
        kinds = latin.translate(KINDS)
        if b".." in kinds or b".#" in kinds or b"#." in kinds or b"<|" in latin:
            return text.translate(BLANKS) + b" ", False
        return latin.translate(BLANKS).translate(LOWER).replace(b".", b" . ").replace(b",", b" , ") + b" ", True

    def _known(self, chunks: list[bytes], memo: dict, older: dict, learn) -> tuple[dict, dict]:
        """Both generations of a memory, in which all of these different chunks are known: what is met again moves to the new one."""
        if len(memo) > MEMO_ENTRIES:
            memo, older = {}, memo
        fresh = [x for x in chunks if x not in memo]
        again = list(map(older.get, fresh))
        memo.update((x, ids) for x, ids in zip(fresh, again) if ids is not None)
        if unknown := [x for x, ids in zip(fresh, again) if ids is None]:
            gc.disable()  # many small objects and no cycles
            learn(unknown, memo)
            gc.enable()
        return memo, older

    def _learn_plain(self, chunks: list[bytes], memo: dict) -> None:
        words = [x for x in chunks if x.isalpha() or self.letters(x.decode("latin-1"))]
        self._learn_words(words, memo)
        others = [x for x in chunks if x not in memo]
        for x, e in zip(others, self.tokenizer.encode_batch_fast([x.decode("latin-1") for x in others], add_special_tokens=False)):
            memo[x] = np.array(e.ids, dtype=self.dtype).tobytes()

    def _learn_words(self, names: list[bytes], memo: dict, at_once: int = 50_000, a_text: int = 200) -> None:
        """A word of letters is one piece, whose last token alone ends a word: many are encoded as one text, as short ones take the least
        time a word, and cut there. Where a vocabulary has no word ends, they stay unknown here."""
        for a in range(0, len(names), at_once):
            part = names[a : a + at_once]
            lines = [b" ".join(part[k : k + a_text]).decode("latin-1") for k in range(0, len(part), a_text)]
            ids = np.concatenate([np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                data, cuts = ids.astype(self.dtype).tobytes(), (ends * self.dtype.itemsize).tolist()
                memo.update(zip(part, map(data.__getitem__, map(slice, [0, *cuts[:-1]], cuts))))

    def _learn_mixed(self, chunks: list[bytes], memo: dict) -> None:
        """A word of Latin-1 letters with marks behind it is put together from the word in lower case and the marks."""
        simple, others, words, plain = [], [], {}, self.plain[0]
        for c in chunks:
            core = c.rstrip(self.TAIL)
            if core and self.letters(w := core.decode()):
                word, tail = w.encode("latin-1").translate(LOWER), c[len(core) :]
                words[word] = plain.get(word)
                if tail and tail not in memo:
                    others.append(tail)
                simple.append((c, word, tail))
            else:
                others.append(c)
        self._learn_words([w for w, ids in words.items() if ids is None], words)
        others += [c for c, w, _ in simple if words[w] is None]
        others = list(set(others))
        for x, e in zip(others, self.tokenizer.encode_batch_fast([x.decode() for x in others], add_special_tokens=False)):
            memo[x] = np.array(e.ids, dtype=self.dtype).tobytes()
        memo.update((c, words[w] + memo[tail] if tail else words[w]) for c, w, tail in simple if words[w] is not None)

    def _joined(self, parts: list[bytes], memo: dict, older: dict, learn) -> tuple[list[bytes], dict, dict]:
        """The ids of each part, and both generations of its memory. Different chunks alone become Python objects."""
        if not parts:
            return [], memo, older
        data = b"".join(parts)
        ends = np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == ord(" ")) + 1])
        at = np.searchsorted(ends, np.cumsum([0, *map(len, parts)]))
        found = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        _, sizes, names = found.dictionary.buffers()
        chunks = bytes(names[: int(np.frombuffer(sizes, np.int64)[len(found.dictionary)])]).split(b" ")[:-1]
        memo, older = self._known([x for x in chunks if x], memo, older, learn)
        ids = pa.array([memo[x] if x else b"" for x in chunks], pa.large_binary()).take(found.indices)
        starts, out = np.frombuffer(ids.buffers()[1], np.int64)[at].tolist(), memoryview(ids.buffers()[2] or b"")
        return [bytes(out[a:b]) for a, b in zip(starts, starts[1:])], memo, older

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        parts = [self.parted(x) for x in texts]
        plain, *self.plain = self._joined([p for p, is_plain in parts if is_plain], *self.plain, self._learn_plain)
        mixed, *self.mixed = self._joined([p for p, is_plain in parts if not is_plain], *self.mixed, self._learn_mixed)
        plain, mixed = iter(plain), iter(mixed)
        return [next(plain if is_plain else mixed) for _, is_plain in parts]


def encoder(path: str, width: int) -> ChunkEncoder:
    """One for each Python worker, kept between tasks of this operator."""
    return kept(("tokens", path, width), lambda: ChunkEncoder(path, width))


def id_width(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else 4


def groups(texts: pa.Array, most_bytes: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of a column of texts by size, as bytes; null as empty."""
    start, out, size = 0, [], 0
    for k, x in enumerate(texts.cast(pa.large_binary())):
        b = x.as_py() or b""
        out.append(b)
        size += len(b)
        if size >= most_bytes:
            yield start, out
            start, out, size = k + 1, [], 0
    if out:
        yield start, out


def train_dictionary(sample: list[bytes], size: int = 64 << 10) -> bytes:
    """A trained dictionary, or the sample's last bytes where there is too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-size:]


def _zdict(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks: Iterator[bytes]) -> None:
    files, path = _open(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    with files.open_output_stream(path) as out:
        for c in chunks:
            out.write(c)


class ShardReader:
    """Random and sequential access to one shard."""

    def __init__(self, uri: str, dictionary: bytes):
        import zstandard

        files, path = _open(uri)
        self.file = files.open_input_file(path)
        end = self.file.size()
        tail = self.file.read_at(32, end - 32)
        n, at, width = (int(x) for x in np.frombuffer(tail[:24], "<u8"))
        head = self.file.read_at(40, 0)
        if tail[24:] != MAGIC or head[:8] != MAGIC or head[8:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: not a shard, or another dictionary's")
        index = self.file.read_at(end - 32 - at, at)
        self.n, self.width = n, width
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.nulls = np.frombuffer(index, "u1", n, 8 * n)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 9 * n)
        self.counts = np.frombuffer(index, "<u8", n, 17 * n + 8)
        self.unzip = zstandard.ZstdDecompressor(dict_data=_zdict(dictionary))

    def ids(self, k: int, frame: bytes | None = None) -> np.ndarray:
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        frame = self.file.read_at(b - a, a) if frame is None else frame
        return np.frombuffer(self.unzip.decompress(frame, max_output_size=int(self.counts[k]) * self.width), f"<u{self.width}")

    def all(self, span: int = 8 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """Every document in order, by long reads."""
        k = 0
        while k < self.n:
            a = int(self.offsets[k])
            last = max(k + 1, int(np.searchsorted(self.offsets, a + span, "right")) - 1)
            data = self.file.read_at(int(self.offsets[last]) - a, a)
            for j in range(k, last):
                yield j, self.ids(j, data[int(self.offsets[j]) - a : int(self.offsets[j + 1]) - a])
            k = last


LONGEST_SAMPLE = 64 << 10  # bytes of a document that may train the dictionary, which changes sizes only


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", dictionary_docs: int = 500, level: int = 3) -> tuple[DataFrame, str]:
    """Writes the shards and returns their manifest (shard, uri, n_docs, n_tokens, dictionary) and the folder."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    width = max(id_width(tokenizer_path), 4 if end_id >= 1 << 16 else 2)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    share = min(1.0, dictionary_docs / max(1, rows.count()))  # a hash of the id picks about so many rows; no task sends more than its own
    picked = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) <= int(share * (1 << 40))) & (F.octet_length("text") <= LONGEST_SAMPLE)
    sample = rows.where(picked).select("text").limit(4 * dictionary_docs).collect()
    end = np.array([end_id], f"<u{width}").tobytes()
    data = train_dictionary([x + end for x in encoder(tokenizer_path, width).encode([(r.text or "").encode() for r in sample])])
    digest = hashlib.sha256(data).hexdigest()
    write_file(f"{folder}/{digest}.zdict", iter([data]))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the other cores have tasks of their own
        task = TaskContext.get()
        uri = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        encode = encoder(tokenizer_path, width).encode
        zdict = _zdict(data)
        if zdict:
            zdict.precompute_compress(level=level)  # else every frame would digest the dictionary anew
        zipper = zstandard.ZstdCompressor(level=level, dict_data=zdict, write_content_size=True)
        ids, nulls, sizes, counts = [], [], [], []

        def content() -> Iterator[bytes]:
            yield MAGIC + hashlib.sha256(data).digest()
            for batch in batches:
                ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False).astype("u1"))
                for _, texts in groups(batch.column(1)):
                    frames = []
                    for x in encode(texts):
                        counts.append(len(x) // width + 1)
                        frames.append(zipper.compress(x + end))
                        sizes.append(len(frames[-1]))
                    yield b"".join(frames)
            n, offsets = len(sizes), np.concatenate([[40], 40 + np.cumsum(np.array(sizes, "<u8"))]).astype("<u8")
            yield b"".join([*(x.tobytes() for x in ids), *(x.tobytes() for x in nulls), offsets.tobytes(), np.array(counts, "<u8").tobytes()])
            yield np.array([n, offsets[-1], width], "<u8").tobytes() + MAGIC

        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is not None:
            rest = batches
            batches = (b for part in ([first], rest) for b in part)
            write_file(uri, content())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int64()), "uri": [uri], "n_docs": pa.array([len(sizes)], pa.int64()), "n_tokens": pa.array([sum(counts)], pa.int64()), "dictionary": [digest]})
        release()

    # Rows with the same id and text are interchangeable; their number lets many of them fall into several ranges.
    keyed = rows.withColumns({"_h": F.xxhash64("text"), "_k": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("doc_id", "_h", "_k").sortWithinPartitions("doc_id", "_h", "_k").select("doc_id", "text")
    manifest = ordered.mapInArrow(shard, "shard long, uri string, n_docs long, n_tokens long, dictionary string")
    return materialise(manifest, "manifest"), folder


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard, offset of every document, from the files that the manifest names. The window is over
    one row a shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    n = max(1, manifest.count())
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long")).repartition(n, "shard")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = _open(f"{folder}/{row['dictionary']}.zdict")
                with files.open_input_stream(path) as f:
                    dictionary = f.read()
                reader = ShardReader(row["uri"], dictionary)
                crcs = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in reader.all()), np.int64, reader.n)
                counts = reader.counts.astype(np.int64)
                starts = row["base"] + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
                for a in range(0, reader.n, 50_000):
                    cut = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(reader.doc_ids[cut], pa.int64(), mask=reader.nulls[cut].astype(bool)),
                        "start": starts[cut], "n_tokens": counts[cut], "ids_crc32": crcs[cut],
                        "shard": np.full(len(counts[cut]), row["shard"], np.int64), "frame_offset": reader.offsets[:-1][cut].astype(np.int64),
                    })

    return based.select("shard", "uri", "dictionary", "base").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, frame_offset long")


def token_digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return read(*write(docs, public_tokenizers.path("word_bpe_49k.json")))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"))


QUERIES = {"op10_token_files": op10_token_files}
ORACLES: dict[str, str] = {}
