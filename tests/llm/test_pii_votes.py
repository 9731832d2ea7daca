"""The votes decide: planted spans, labelers that disagree, hostile texts."""

import random
import time

import pytest

from addrloom.llm import pii as P


def test_classifier_beats_each_labeler():
    rng = random.Random(6)
    right = (0.9, 0.8, 0.75, 0.7, 0.65, 0.8)  # how often each labeler is right where it votes
    silent = (0.0, 0.0, 0.4, 0.5, 0.4, 0.0)
    rows = []
    for _ in range(6000):
        truth = rng.random() < 0.5
        rows.append((truth, "".join("0" if rng.random() < s else "+" if (rng.random() < r) == truth else "-" for r, s in zip(right, silent))))
    counts = {}
    for _, v in rows:
        counts[v] = counts.get(v, 0) + 1
    chance = P.train_classifier([("secret", v, n) for v, n in sorted(counts.items())])
    score = lambda said: sum(said(v) == t for t, v in rows) / len(rows)
    ours = score(lambda v: chance["secret", v] >= 0.5)
    single = [score(lambda v, k=k: v[k] == "+") for k in range(len(right))]
    assert ours > max(single) + 0.02
    odd = [v for _, v in rows if v[0] == "-" and chance["secret", v] >= 0.5]
    assert odd  # found against the vote of the strict shape


def planted(rng, k):
    """A text with a span of a kind, or None for a decoy, in contexts that make labelers disagree."""
    hex_ = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((16, 32, 40))))
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice((13, 18, 24))))
    mixed = "".join(rng.choice("abcdefgXYZ0123456789") for _ in range(20))
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    fill = lambda: " ".join(rng.choice("the old lamp stood near a green door while rain fell".split()) for _ in range(rng.randrange(3, 9)))
    kind, lead, span = (
        ("secret", rng.choice(('token = "', "password: ", "api_key=")), rng.choice((hex_, mixed))),
        ("national_id", rng.choice(("ssn: ", "social security no ", "")), f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"),
        ("phone", rng.choice(("tel ", "call ", "phone ")), f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{digits(4)}"),
        ("written_email", rng.choice(("mail to ", "contact ", "")), f"{word[:6]} [at] {word[6:12]} [dot] org"),
        ("account", rng.choice(("iban ", "account ", "konto ")), f"DE{digits(20)}"),
        (None, rng.choice(("title: ", "see =", "http://x.y/?page=")), word),
    )[k % 6]
    return f"{fill()} {lead}{span} {fill()}", kind, span


def test_recall_and_precision_of_planted_spans(spark):
    rng = random.Random(3)
    rows = [planted(rng, k) for k in range(1800)]
    found = P.find(spark.createDataFrame([(i, t, "x") for i, (t, _, _) in enumerate(rows)], "doc_id long, text string, base string"))
    got = {(r.doc_id, s.kind, rows[r.doc_id][0][s.a : s.b]) for r in found.collect() for s in r["added"]}
    want = {(i, k, s) for i, (_, k, s) in enumerate(rows) if k}
    recall, precision = len(got & want) / len(want), len(got & want) / max(1, len(got))
    assert recall >= 0.95 and precision >= 0.9, (recall, precision)


@pytest.mark.parametrize("text", ["1" * 300_000, "(" + "a" * 300_000, "1.1" * 100_000, "a@" * 100_000, "+1(" * 60_000, "[at]" * 60_000, "a [at] b.c" * 20_000, "1.1.1.1 =aaaaaaaaaaaaaaaa " * 20_000, "=" + "a" * 300_000])
def test_hostile_texts_take_linear_time(text):
    began = time.perf_counter()
    P.candidates(text, P.base_spans(text))
    assert time.perf_counter() - began < 5  # under a second on an idle machine
