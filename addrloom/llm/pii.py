"""Personal data by weak supervision.

Base spans (email, ip, card, phone) come from fixed patterns and always stay. Beyond them, candidate spans of more kinds are
proposed widely, and six labelers vote on each: two regular expressions (strict shape, whole token), two gazetteers
(words that announce a kind, words that deny it) and two of context (assignment or quotes before it, mixed characters).
Votes are counted by pattern over all documents, at most 3^6 rows a kind. Expectation-maximisation estimates each
labeler's reliability from the counts, and its soft labels train a logistic span classifier. Its verdict on a kind and a vote
pattern alone decides whether a candidate becomes a span: no labeler can veto or force one. Every pattern is scanned in linear time.

One scan reads the texts and leaves offsets only; nothing of a text is shuffled. Offsets are code points.

Defined cases: a null text counts as empty; an empty or very long text is read whole; repeated rows are read row by row;
a candidate that overlaps a base span is dropped; only the id and the text are read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "national_id", "secret", "written_email")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # a match starts where digits do, so each run is read a few times
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part is the run of its characters before the @, from the last match on."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > free and text[s - 1] in LOCAL:
            s -= 1
        if s < at and (m := DOMAIN.match(text, at + 1)):
            out.append((s, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


#: What proposes candidates, cheap test first: kind, characters one of which must occur, pattern (group 1 is the span), strict shape.
#: The patterns ask for little more than the kind's characters; the votes decide.
PROPOSALS = (
    ("secret", "=:", re.compile(r"[=:][\x20]?[\"']?([A-Za-z0-9_/+-]{12,})"), re.compile(r"([0-9a-f]{16,}|[0-9A-F]{16,}|(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_/+-]{16,})")),
    ("national_id", "-", re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"), re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}")),
    ("account", "0123456789", re.compile(r"\b([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?)\b"), re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9\x20]*[0-9]{4}\x20?[0-9]{2}[A-Z0-9\x20]*")),
    ("phone", "(", re.compile(r"(?<![0-9+ ])[\x20]?(\([0-9]{2,5}\)[\x20]?[0-9][0-9 -]{4,10}[0-9])"), re.compile(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}")),
    ("phone", "-. ", re.compile(r"(?<![0-9A-Za-z+().-])([0-9]{3}[-.][0-9]{3}[-.][0-9]{4})(?![0-9-])"), re.compile(r"[2-9][0-9]{2}([-.])[2-9][0-9]{2}\1[0-9]{4}")),
)
AT = re.compile(r"[\x20]?(?:[\[(](?:at|AT)[\])]|\{at\})[\x20]?")
WRITTEN_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:[\x20]?(?:[\[({](?:dot|DOT)[\])}]|\.)[\x20]?[A-Za-z0-9-]++)+")
WRITTEN = re.compile(r".+[\[({](?:at|AT)[\])}].+(?:[\[({](?:dot|DOT)[\])}]|\.).+")
WRITTEN_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._-")


def written_emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans like `name [at] host [dot] org`, found from each bracketed at."""
    free = 0
    for m in AT.finditer(text):
        s = m.start()
        while s > free and text[s - 1] in WRITTEN_LOCAL:
            s -= 1
        if s < m.start() and (d := WRITTEN_DOMAIN.match(text, m.end())):
            yield s, d.end()
            free = d.end()


#: Gazetteer of words that announce a kind, and of words that deny one.
ANNOUNCE = {
    "secret": ("token", "secret", "password", "passwd", "api", "key", "auth", "bearer"), "national_id": ("ssn", "social", "security", "id"),
    "account": ("iban", "account", "konto", "compte", "cuenta", "bank"), "phone": ("phone", "tel", "call", "fax", "mobile"), "written_email": ("mail", "email", "contact", "write", "at"),
}
DENY = ("example", "sample", "version", "sha", "commit", "http", "https", "isbn", "checksum")
LABELERS = ("shape", "whole_token", "announced", "denied", "assigned", "mixed")
WORDS = re.compile(r"[a-z]+")


def votes(text: str, kind: str, a: int, b: int, shape: re.Pattern) -> str:
    """One character a labeler: + for, - against, 0 abstains."""
    span, before = text[a:b], text[max(0, a - 40) : a].lower()
    near = set(WORDS.findall(before))
    joined = (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())
    kinds = {"d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in span}
    return "".join((
        "+" if shape.fullmatch(span) else "-",
        "-" if joined else "+",
        "+" if near & set(ANNOUNCE[kind]) else "0",
        "-" if near & set(DENY) else "0",
        "+" if re.search(r"[=:(]\s?[\"']?$", before) else "0",
        "+" if "d" in kinds and len(set(span)) > 4 else "-",
    ))


def proposed(text: str) -> Iterator[tuple[str, int, int, re.Pattern]]:
    for kind, chars, pattern, shape in PROPOSALS:
        if any(c in text for c in chars):
            for m in pattern.finditer(text):
                yield kind, *m.span(1), shape
    if "(" in text or "[" in text or "{" in text:
        for a, b in written_emails(text):
            yield "written_email", a, b, WRITTEN


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    """Proposed spans that overlap no base span, with their votes. The base spans are merged and searched by their starts."""
    starts, ends = [], []
    for _, a, b in sorted(taken, key=lambda s: s[1:]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for kind, a, b, shape in proposed(text):
        k = bisect_right(ends, a)  # the first base span that ends behind a
        if k == len(starts) or starts[k] >= b:
            out.append((kind, a, b, votes(text, kind, a, b, shape)))
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base spans and candidates with their votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64())])
        cand = pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("votes", pa.string())])
        for batch in batches:
            base, more = [], []
            for x in batch.column(1):
                t = x.as_py() or ""
                found = base_spans(t)
                base.append([dict(zip(("kind", "a", "b"), s)) for s in found])
                more.append([dict(zip(("kind", "a", "b", "votes"), s)) for s in candidates(t, found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(span)), pa.array(more, pa.list_(cand))], names=["doc_id", "base", "candidates"])
        release()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, base array<struct<kind:string,a:long,b:long>>, candidates array<struct<kind:string,a:long,b:long,votes:string>>")


def estimate(patterns: list[str], counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for a labeler's chances of each vote given a true span or none; returns (patterns' posterior, chances[class, labeler, vote], prior)."""
    seen = np.array([["+-0".index(c) for c in p] for p in patterns])
    score = np.array([p.count("+") - p.count("-") for p in patterns], float)
    q = 1 / (1 + np.exp(-score))  # starts from the votes' majority
    chances = np.full((2, len(LABELERS), 3), 1 / 3)
    prior = 0.5
    for _ in range(rounds):
        old = q
        for c, w in ((1, q * counts), (0, (1 - q) * counts)):
            for j in range(len(LABELERS)):
                n = np.bincount(seen[:, j], weights=w, minlength=3) + 1.0
                chances[c, j] = n / n.sum()
        prior = float(np.clip((q @ counts + 1) / (counts.sum() + 2), 0.01, 0.99))
        log = [np.log(p) + np.log(chances[c][np.arange(len(LABELERS)), seen]).sum(axis=1) for c, p in ((0, 1 - prior), (1, prior))]
        q = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
        if np.abs(q - old).max() < 1e-9:
            break
    return q, chances, prior


def span_features(kind: str, pattern: str) -> list[float]:
    return [1.0, *(float(c == "+") - float(c == "-") for c in pattern), *(float(kind == k) for k in KINDS[3:])]


def train_classifier(counted: list[tuple[str, str, int]]) -> dict[tuple[str, str], float]:
    """Chance of a span for each (kind, votes) that occurs: a ridge logistic regression on EM's soft labels, weighted by counts."""
    if not counted:
        return {}
    patterns = sorted({v for _, v, _ in counted})
    n = np.array([sum(c for _, v, c in counted if v == p) for p in patterns], float)
    q = dict(zip(patterns, estimate(patterns, n)[0]))
    x = np.array([span_features(k, v) for k, v, _ in counted])
    y, w = np.array([q[v] for _, v, _ in counted]), np.array([c for *_, c in counted], float)
    w = w / w.sum() * min(w.sum(), 1000.0)
    b = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1]), x.T @ (w * (y - p)) - 0.1 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return {(k, v): float(s) for (k, v, _), s in zip(counted, 1 / (1 + np.exp(-np.clip(x @ b, -30, 30))))}


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, base and added: arrays of (kind, a, b), sorted by kind as listed and start."""
    scanned = materialise(scan(docs, doc_id, text), "pii-scan")
    counted = scanned.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes").count().orderBy("kind", "votes")
    chances = train_classifier([tuple(r) for r in counted.collect()])  # bounded: kinds times vote patterns
    good = [f"{k} {v}" for (k, v), p in chances.items() if p >= least]
    chosen = F.filter("candidates", lambda c: F.concat_ws(" ", c["kind"], c["votes"]).isin(good)) if good else F.filter("candidates", lambda c: F.lit(False))
    added = F.transform(chosen, lambda c: F.struct(c["kind"].alias("kind"), c["a"].alias("a"), c["b"].alias("b")))
    return scanned.select("doc_id", _sorted(F.col("base")).alias("base"), _sorted(added).alias("added"), _sorted(F.concat("base", added)).alias("all"))


def _sorted(spans):
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("r"), s["a"].alias("a"), s["b"].alias("b"), s["kind"].alias("kind"))))
    return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["a"].alias("a"), s["b"].alias("b")))


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


QUERIES = {"op6_personal_data": op6_personal_data}
ORACLES: dict[str, str] = {}
