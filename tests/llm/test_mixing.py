import math
from collections import Counter, defaultdict

import pytest

from addrloom.llm import mixing as M


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, epoch int, tokens int")


def sample():
    rows = [(i, "big" if i % 3 else f"s{i % 7}", "w " * (1 + i * 37 % 90)) for i in range(3000)]
    return rows + [(9001, None, "a b c"), (9002, None, "d e"), (9003, "blank", " "), (9004, "blank", None), (9005, "big", None)]


def brute_exponent(shares, limit):
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        z = sum(s**mid for s in shares)
        rep = [s**mid / z / s for s in shares]
        lo, hi = (lo, mid) if max(rep) / min(rep) <= limit else (mid, hi)
    return hi


@pytest.mark.parametrize("limit", [1.5, 2.0, 4.0])
def test_repetition_limit_and_no_loss(spark, limit):
    rows = sample()
    got = M.mixture(rows_of(spark, rows), repetition_limit=limit).collect()
    tokens = defaultdict(int)
    for _, s, t in rows:
        tokens[s] += len((t or "").split())
    total = sum(tokens.values())
    shares = [v / total for v in tokens.values() if v]
    alpha = brute_exponent(shares, limit)
    z = sum(s**alpha for s in shares)
    weight = {s: (v / total) ** alpha / z if v else 0 for s, v in tokens.items()}
    times = Counter((r.doc_id, r.source) for r in got)
    assert set(times) == {(d, s) for d, s, _ in rows}
    assert max(times.values()) <= math.ceil(limit)
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.n_tokens
        assert r.weight == pytest.approx(weight[r.source], abs=1e-4)
    budget = tokens["big"] / weight["big"]
    for s, v in tokens.items():
        if v:
            assert abs(taken[s] - weight[s] * budget) <= 90 + 1e-3 * v  # one document and the search's step
    for s in tokens:  # the stream of a source: slots are the tokens before, over the budget
        own = sorted((r for r in got if r.source == s), key=lambda r: (r.epoch, r.slot))
        at = 0
        for r in own:
            if tokens[s]:
                assert r.slot == pytest.approx(at / (r.repeats * tokens[s]), abs=1e-9)
            at += r.n_tokens


def test_entropy_target(spark):
    got = M.weights(rows_of(spark, sample()).select("source", M.n_tokens(M.F.col("text")).alias("n_tokens")), target_entropy=0.9).collect()
    w = [r.weight for r in got if r.weight]
    h = -sum(x * math.log(x) for x in w) / math.log(len(w))
    assert sum(w) == pytest.approx(1) and 0.9 <= h < 0.9 + 1e-4


def test_rows_keep_their_columns(spark):
    df = rows_of(spark, sample())
    out = M.mixed_rows(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in M.mixture(df).collect())


def test_smaller_budget(spark):
    rows = [(i, "ab"[i % 2], "w " * 10) for i in range(1000)]
    got = M.mixture(rows_of(spark, rows), repetition_limit=1.0, budget_tokens=5000).collect()
    assert abs(sum(r.n_tokens for r in got) - 5000) <= 20


def test_one_source_and_empty_table(spark):
    assert M.mixture(rows_of(spark, [(1, "a", "x y"), (1, "a", "x y")])).count() == 2
    assert M.mixture(rows_of(spark, [])).count() == 0
