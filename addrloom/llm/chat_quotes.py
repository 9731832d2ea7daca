"""Chat formatting by quotation linking.

A message's lines carry a quote level (their leading `>` marks, any depth). Lines of level 0 are the message's own words, less a line
that announces a quote; consecutive quoted lines of one level are a passage. Passages are normalised to their words, so a passage
that a mail client has wrapped anew stays the same, and are hashed: shingles of `SHINGLE` words, thinned by winnowing, so that
any run of `SHINGLE + WINNOW - 1` common words shares a hash; a passage of fewer words is hashed whole and must be a whole line,
sentence or message of its original. Each hash points, within its conversation, to the latest message before that says it in its
own words, and a passage belongs to the message that most of its hashes point to (half of them at least); of several with as
many, to the latest. A message replies to the original of its first passage of level 1 that has one.

Threads are found by pointer doubling over the replies, so a message gets its thread's root and depth. A conversation
in reply order is its messages by (root, turn), without quotes: threads one after another, parents before replies; `position`
numbers them. Hashes of own words are computed only in conversations with a quote. The latest message before and the position are
found by a range sort: each part works by itself and then takes over what the parts before it hold of its first group, so no
conversation and no hash, however frequent, is gathered in a task, and no pairs are formed.

Defined cases: a null text counts as empty and stays a message; a quote without original gives no link; repeated rows
(one conversation and turn) all stay, share links and get positions of their own; null conversations or turns are kept without
links, and null conversations are numbered together; passages without a word are no passages; only the four columns are read; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, table

SHINGLE, WINNOW = 4, 4
MARKS = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
INTRODUCES = re.compile(r"\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$|^-{2,}\s*(?:original|forwarded) message\s*-{2,}\s*$", re.I)
APART = re.compile(r"[\W_]+")
SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The own words, and the quoted passages with their levels."""
    own, passages = [], []
    lines = text.split("\n")
    marks = [MARKS.match(x) for x in lines]
    levels = [m[1].count(">") if m else 0 for m in marks]
    for k, (line, mark, level) in enumerate(zip(lines, marks, levels)):
        if level:
            if k and levels[k - 1] == level:
                passages[-1][1].append(line[mark.end() :])
            else:
                passages.append((level, [line[mark.end() :]]))
        elif not (any(levels[k + 1 : k + 3]) and INTRODUCES.search(line.rstrip())):
            own.append(line)
    return "\n".join(own).strip(), [(n, "\n".join(x)) for n, x in passages]


def words_of(text: str) -> list[str]:
    return APART.sub(" ", unicodedata.normalize("NFKC", text).casefold()).split()


def _hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words).encode(errors="replace")) - (1 << 63)


def winnowed(words: list[str]) -> set[int]:
    """Of each `WINNOW` shingles in a row the least hash."""
    hashes = [_hash(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)]
    return {min(hashes[k : k + WINNOW]) for k in range(max(1, len(hashes) - WINNOW + 1))} if hashes else set()


def passage_hashes(text: str) -> set[int]:
    words = words_of(text)
    return winnowed(words) if len(words) >= SHINGLE + WINNOW - 1 else {_hash(words)} if words else set()


def own_hashes(body: str) -> set[int]:
    """What a passage may look for: the body's winnowed shingles, and whole lines, sentences and messages that are short."""
    out = winnowed(words_of(body))
    for part in {body, *body.split("\n"), *SENTENCE.split(body)}:
        words = words_of(part)
        if words and len(words) < SHINGLE + WINNOW - 1:
            out.add(_hash(words))
    return out


def read(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, body and the hashes of each passage with its number and level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quote = pa.struct([("number", pa.int32()), ("level", pa.int32()), ("hashes", pa.list_(pa.int64()))])
        for b in batches:
            bodies, quotes = [], []
            for x in b.column(3):
                body, passages = parse(x.as_py() or "")
                bodies.append(body)
                found = ((n, sorted(passage_hashes(y))) for n, y in passages)
                quotes.append([{"number": k, "level": n, "hashes": h} for k, (n, h) in enumerate(f for f in found if f[1])])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(bodies, pa.string()), pa.array(quotes, pa.list_(quote))], names=["conv_id", "turn", "role", "body", "quotes"])

    rows = messages.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, body string, quotes array<struct<number:int,level:int,hashes:array<long>>>")


def own_words(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, h: the different hashes of the messages' own words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [sorted(own_hashes(x.as_py() or "")) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(hashes, pa.list_(pa.int64()))], names=["conv_id", "turn", "own"])

    return parsed.select("conv_id", "turn", "body").mapInArrow(run, "conv_id long, turn long, own array<long>").select("conv_id", "turn", F.explode("own").alias("h"))


def replies(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, parent, n_linked for messages with a passage that is found."""
    asked = parsed.where(F.size("quotes") > 0).select("conv_id", "turn", F.explode("quotes").alias("q"))
    # A turn may hold several rows: a passage is named by its turn, number and hashes.
    asked = asked.select("conv_id", "turn", "q.number", "q.level", F.xxhash64("q.hashes").alias("passage"), F.size("q.hashes").alias("n"), F.explode("q.hashes").alias("h")).distinct()
    asked = materialise(asked, "chat-asked")
    quoting = materialise(asked.select("conv_id").distinct(), "chat-quoting")
    wanted = materialise(asked.select("conv_id", "h").distinct(), "chat-wanted")
    said = own_words(parsed.join(quoting, "conv_id", "left_semi")).join(wanted, ["conv_id", "h"], "left_semi").distinct()
    events = asked.withColumns({"says": F.lit(False), "origin": F.lit(None).cast("long")}).unionByName(said.withColumns({"says": F.lit(True), "origin": F.col("turn")}), allowMissingColumns=True)
    sorted_, edges = _parts(events.where("conv_id is not null and turn is not null"), ["conv_id", "h"], ["turn", "says"], F.max("origin"), F.max("v"))
    latest = F.max("origin").over(Window.partitionBy("part", "conv_id", "h").orderBy("turn", "says").rowsBetween(Window.unboundedPreceding, 0))
    found = sorted_.withColumn("origin", latest).join(F.broadcast(edges), (F.col("conv_id") == F.col("_conv_id")) & (F.col("h") == F.col("_h")) & (F.col("part") == F.col("_part")), "left")
    found = found.where("not says").withColumn("origin", F.coalesce("origin", "before")).where("origin is not null")
    held = found.groupBy("conv_id", "turn", "number", "level", "passage", "n", "origin").agg(F.count("*").alias("k")).where("2 * k >= n")
    best = held.groupBy("conv_id", "turn", "number", "level", "passage").agg(F.max(F.struct("k", "origin")).alias("best"))
    first = F.min(F.when(F.col("level") == 1, F.struct("number", "passage", F.col("best.origin").alias("origin"))))
    return best.groupBy("conv_id", "turn").agg(first.getField("origin").alias("parent"), F.countDistinct("number", "passage").alias("n_linked"))


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, root, depth of all messages with a parent, by pointer doubling."""
    now = materialise(links.where("parent is not null").select("conv_id", "turn", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        step = now.join(above, ["conv_id", "up"], "left")
        step = materialise(step.select("conv_id", "turn", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.col("_up").isNotNull().alias("moved")), "threads")
        discard(now)
        if step.where("moved").isEmpty():
            return step.select("conv_id", "turn", F.col("up").alias("root"), "depth")
        now = step


def _parts(rows: DataFrame, group: list[str], order: list[str], value: Column, before: Column) -> tuple[DataFrame, DataFrame]:
    """rows sorted by range of (group, order) into parts, and for each group that several parts hold, by part, what `before` makes of the
    values `v` that the parts before have: two rows at most for each part's edge, so they may be broadcast."""
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())  # equal rows may fall into several parts
    dealt = keyed.repartitionByRange(*group, *order, "_row").withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt.drop("_row"), "chat-sorted")
    values = materialise(dealt.groupBy(*group, "part").agg(value.alias("v")), "chat-values")
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in group]
    spread = values.groupBy(*group).agg(F.count("*").alias("_n")).where("_n > 1")
    some = values.join(F.broadcast(spread), same(values, spread), "left_semi")
    over = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return dealt, some.select(*[F.col(c).alias(f"_{c}") for c in (*group, "part")], before.over(over).alias("before"))


def positioned(linked: DataFrame) -> DataFrame:
    """position: a message's number, from 0, in the reply order of its conversation."""
    order = ["root", "turn", "_k"]
    dealt, edges = _parts(linked.withColumn("_k", F.xxhash64("role", "body")), ["conv_id"], order, F.count("*"), F.sum("v"))
    inside = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order)) - 1
    out = dealt.withColumn("_i", inside).join(F.broadcast(edges), F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("part") == F.col("_part")), "left")
    return out.withColumn("position", (F.col("_i") + F.coalesce("before", F.lit(0))).cast("long")).select(*linked.columns, "position")


def link(messages: DataFrame, **columns: str) -> DataFrame:
    """conv_id, turn, role, body, n_quoted (passages), n_linked (of them, those with an original), reply_to, root, depth, position."""
    parsed = materialise(read(messages, **columns), "chat")
    links = materialise(replies(parsed), "chat-replies")
    rooted = materialise(links.join(threads(links), ["conv_id", "turn"], "left"), "chat-rooted")
    out = parsed.join(rooted, ["conv_id", "turn"], "left")
    out = out.select("conv_id", "turn", "role", "body", F.size("quotes").cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("parent").alias("reply_to"), F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
    return positioned(out)


def op9_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations"))


QUERIES = {"op9_chat_quotes": op9_chat_quotes}
ORACLES: dict[str, str] = {}
