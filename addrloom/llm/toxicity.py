"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon names the symbol of a word: insult (with a weight), threat, target, negation, report or quotation mark; other
words are `other`. Small transducers read a clause's symbols: one counts insults and threats, one adds weight where a
target stands in the clause, one takes it away behind a negation within its reach, and one where the clause reports what
somebody said or stands in quotes. Their composition is one machine, which turns a clause into a weight, so matched
clauses are scored and not words alone. A clause is read from both ends: from the right to learn whether a target follows, and
with that from the left, so `you are an idiot` and `an idiot, you are` weigh the same. A threat without a target hardly
counts. A logistic model over a text's clause weights gives the score; its features for density and the number of
clauses end at 10 and 5, where they say no more.

The insult lexicon and the model are learned from labelled rows (`is_training` says which): at most `MOST_TRAINING` of
either label, by least hash of the id, one text of at most `LONGEST_TRAINING` bytes an id. For the model's features, each half of
them is read with the lexicon of the other half; scores use the lexicon of all. Stems (prefixes of 4 to 9 letters) and whole
words get the log odds of their document counts. Label, lang, source and id are no inputs of a score.

Defined cases: a null, empty or wordless text matches no clause and gets the model's score for none; repeated rows get equal
scores; without labelled rows of both kinds the built-in lexicon and weights serve; only the id and the text are read;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_rows, release, table

MOST_TRAINING, LONGEST_TRAINING = 3000, 64 << 10
THRESHOLD = 0.7

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = range(8)

#: The general vocabulary of the grammar, for the four languages of the corpus.
THREATS = "kill hurt destroy beat punish attack umbringen töten verletzen tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours yourself u du dich dein ihr euch tu toi ton vous votre usted tú vosotros".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't nicht kein keine nie ne jamais aucun nunca jamás ningún".split()
REPORTS = "said says told claimed wrote reported called quoted sagte schrieb behauptete a-dit écrit dijo escribió afirmó".split()
INSULTS = "idiot moron stupid trash pathetic worthless disgusting loser clown scum".split()
QUOTES = frozenset("\"“”„«»")


class Transducer:
    """Reads symbols, writes symbols and multiplies weights; arcs[(state, symbol)] = (state, symbol, weight). Where no arc is named the
    symbol passes on with weight 1 and the state stays."""

    def __init__(self, arcs: dict[tuple, tuple], start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol: int) -> tuple:
        return self.arcs.get((state, symbol)) or (state, symbol, 1.0)

    def then(self, other: Transducer, symbols: Iterable[int] = range(8)) -> Transducer:
        """The composition: other reads what this writes. States are pairs that can be reached."""
        start = (self.start, other.start)
        arcs, todo, seen = {}, [start], {start}
        while todo:
            a, b = todo.pop()
            for s in symbols:
                na, out, wa = self.step(a, s)
                nb, out, wb = other.step(b, out)
                arcs[(a, b), s] = ((na, nb), out, wa * wb)
                if (na, nb) not in seen:
                    seen.add((na, nb))
                    todo.append((na, nb))
        return Transducer(arcs, start)


def negation(reach: int = 3, factor: float = 0.3) -> Transducer:
    """Up to `reach` words behind a negation, insults and threats weigh less."""
    arcs: dict = {}
    for n in range(reach + 1):
        arcs[n, NEGATION] = (reach, NEGATION, 1.0)
        for s in (OTHER, TARGET, REPORT):
            arcs[n, s] = (max(0, n - 1), s, 1.0)
        for s in (INSULT, THREAT):
            arcs[n, s] = (max(0, n - 1), s, factor if n else 1.0)
        arcs[n, END] = (0, END, 1.0)
    return Transducer(arcs)


def reported(factor: float = 0.5) -> Transducer:
    """From a verb of saying to the clause's end, and between quotation marks, insults weigh less."""
    arcs: dict = {(0, REPORT): (1, REPORT, 1.0), (1, END): (0, END, 1.0), (0, QUOTE): (2, QUOTE, 1.0), (2, QUOTE): (0, QUOTE, 1.0), (1, QUOTE): (1, QUOTE, 1.0)}
    for state in (1, 2):
        arcs[state, INSULT] = (state, INSULT, factor)
        arcs[state, THREAT] = (state, THREAT, factor)
    return Transducer(arcs)


def targeted(bonus: float = 1.5) -> Transducer:
    """In a clause with a target insults weigh more, and threats much more. From the right a target ahead has been seen: then the
    clause starts in state 1."""
    arcs: dict = {(0, TARGET): (1, TARGET, 1.0), (0, THREAT): (0, THREAT, 0.2)}
    arcs |= {(1, INSULT): (1, INSULT, bonus), (1, THREAT): (1, THREAT, 2 * bonus), (1, END): (0, END, 1.0)}
    return Transducer(arcs)


GRAMMAR = negation().then(reported()).then(targeted())


@dataclass
class Lexicon:
    """Weights of whole words and of stems; a word's own weight comes before that of its longest stem."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        if word in self.words:
            return self.words[word]
        return max((self.stems.get(word[:n], 0.0) for n in range(4, min(len(word), 9) + 1)), default=0.0)


EDGE = re.compile(r"^[^\w]*|[^\w]*$")
CLAUSE_END = re.compile(r"[.!?;:…][\W_]*$")
FIXED = {w: s for s, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}


class Reader:
    """Turns a text into its clause weights. What a chunk between blanks means is remembered, up to a bound."""

    def __init__(self, lexicon: Lexicon, most: int = 60_000):
        self.lexicon, self.most = lexicon, most
        self.memo: dict[bytes, tuple | None] = {}

    def meaning(self, chunk: bytes) -> tuple | None:
        """The symbols of a chunk with their weights; None for a plain word inside a clause."""
        text = chunk.decode(errors="replace").lower()
        word = EDGE.sub("", text)
        out = [(QUOTE, 1.0)] * (bool(text) and text[0] in QUOTES)
        if word in FIXED:
            out.append((FIXED[word], 1.0))
        elif word and (w := self.lexicon.weight(word)) > 0:
            out.append((INSULT, w))
        elif word:
            out.append((OTHER, 1.0))
        if len(text) > 1 and text.rstrip(".,!?;:…")[-1:] in QUOTES:
            out.append((QUOTE, 1.0))
        if CLAUSE_END.search(text):
            out.append((END, 1.0))
        return tuple(out) if any(s != OTHER for s, _ in out) else None

    def clauses(self, text: bytes) -> tuple[list[float], int]:
        """The weights of the clauses that match, and the number of words."""
        memo = self.memo
        if len(memo) > self.most:
            memo.clear()
        chunks = text.split()
        for c in set(chunks):
            if c not in memo:
                memo[c] = self.meaning(c)
        found = [(k, m) for k, c in enumerate(chunks) if (m := memo[c]) is not None]
        out: list[float] = []
        state, total, last, hit, after = GRAMMAR.start, 0.0, -1, False, True
        step = GRAMMAR.arcs
        for at, (k, symbols) in enumerate(found):
            if after:  # a clause begins: look for a target from its end
                state = (state[0], int(self.targets(found, at)))
                after = False
            for _ in range(min(3, k - last - 1)):  # plain words between; the machine forgets after three
                state = step[state, OTHER][0]
            last = k
            for s, w in symbols:
                state, _, factor = step[state, s]
                if s in (INSULT, THREAT):
                    total += w * factor
                    hit = True
                elif s == END:
                    if hit:
                        out.append(total)
                    total, hit, after = 0.0, False, True
        if hit:
            out.append(total)
        return out, len(chunks)

    @staticmethod
    def targets(found: list[tuple], at: int) -> bool:
        """Whether the clause that begins there has a target."""
        for k in range(at, len(found)):
            for s, _ in found[k][1]:
                if s == TARGET:
                    return True
                if s == END:
                    return False
        return False


def features(weights: list[float], n_words: int) -> list[float]:
    """Numbers the model reads: how heavy and how dense the matched clauses are."""
    total = sum(weights)
    top = sorted(weights, reverse=True)
    return [1.0, math.log1p(total), top[0] if top else 0.0, top[1] if len(top) > 1 else 0.0, min(10.0, 100 * total / (n_words + 30)), min(5.0, math.log1p(len(weights)))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 60) -> np.ndarray:
    """Newton's method with a ridge on all weights but the first."""
    b, keep = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    keep[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def stems_of(text: bytes) -> tuple[set[str], set[str]]:
    words = {w for c in set(text.split()) if len(w := EDGE.sub("", c.decode(errors="replace").lower())) > 2}
    return words, {w[:n] for w in words for n in range(4, min(len(w), 9) + 1)}


def learn_lexicon(rows: list[tuple[bytes, int]], least: int = 4, odds: float = 2.5) -> Lexicon:
    """Log odds of document counts, smoothed; kept if seen in `least` toxic texts and at least e^odds times likelier there."""
    n = Counter(y for _, y in rows)
    counts: list[tuple[Counter, Counter]] = [(Counter(), Counter()), (Counter(), Counter())]
    for text, y in rows:
        words, stems = stems_of(text)
        counts[y][0].update(words)
        counts[y][1].update(stems)
    out = Lexicon()
    for kind, into in ((0, out.words), (1, out.stems)):
        for w, k in counts[1][kind].items():
            if k >= least:
                x = math.log((k + 0.5) / (n[1] + 1)) - math.log((counts[0][kind][w] + 0.5) / (n[0] + 1))
                if x >= odds:
                    into[w] = x - odds + 1.0
    for w in INSULTS:
        out.words.setdefault(w, 2.0)
    return out


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray
    reader: Reader | None = None

    def scores(self, texts: Iterable[bytes]) -> Iterator[float]:
        if self.reader is None:
            self.reader = Reader(self.lexicon)
        reader = self.reader
        for x in texts:
            z = float(np.dot(self.coefficients, features(*reader.clauses(x))))
            yield 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


DEFAULT = np.array([-4.0, 1.5, 0.5, 0.3, 0.3, 0.5])


def train(docs: DataFrame, labels: DataFrame, is_training: Column, doc_id: str = "doc_id", text: str = "text", most: int = MOST_TRAINING) -> Model:
    """A bounded number of labelled rows is read: `most` of either label, by the least hash of the id."""
    parts = []
    for y in (1, 0):
        ids = labels.where((F.col("toxic") == y) & is_training).select(F.col("doc_id").alias("_i")).distinct().orderBy(F.xxhash64("_i"), "_i").limit(most)
        parts.append(ids.withColumn("_y", F.lit(y)))
    ids = parts[0].unionByName(parts[1])
    size = F.octet_length(text)
    rows = docs.where(size.isNull() | (size <= LONGEST_TRAINING)).select(F.col(doc_id).alias("_i"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(ids), "_i")
    one = rows.groupBy("_i", "_y").agg(F.min(F.struct(F.xxhash64("t"), "t")).alias("t")).select("_i", "_y", "t.t")
    got = sorted(((str(r._i), r.t.encode(), r._y) for r in one.toLocalIterator()), key=lambda r: (r[2], len(r[0]), r[0]))
    halves = [[(t, y) for _, t, y in got[k::2]] for k in (0, 1)]
    if any(len({y for _, y in half}) < 2 for half in halves):
        return Model(Lexicon(dict.fromkeys(INSULTS, 2.0)), DEFAULT)
    x, y = [], []
    for own, other in (halves, halves[::-1]):
        reader = Reader(learn_lexicon(other))
        x += [features(*reader.clauses(t)) for t, _ in own]
        y += [label for _, label in own]
    return Model(learn_lexicon(halves[0] + halves[1]), fit_logistic(np.array(x), np.array(y, float)))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score, rounded to 9 places, for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, b = Reader(sent.value.lexicon), sent.value.coefficients
        for batch in batches:
            x = np.array([features(*reader.clauses(t.as_py() or b"")) for t in batch.column(1).cast(pa.large_binary())]).reshape(-1, len(b))
            s = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(s, 9))], names=["doc_id", "score"])
        release()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def mild_rows(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their own columns, that score below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make_mask():
        own = Model(sent.value.lexicon, sent.value.coefficients)  # its reader's memory ends with the task
        return lambda texts: [round(s, 9) < threshold for s in own.scores(texts)]

    return keep_rows(docs, text, make_mask)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def trained(spark: SparkSession, sf_dir: str) -> Model:
    return train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), trained(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
