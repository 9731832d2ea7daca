import hashlib
import random
import re

from addrloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[j : j + n]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in wins}
    out = {}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in wins:
                    hit |= set(range(p, p + n))
                    found |= wins[k]
        out[d] = (len(w), len(hit), sorted(found))
    return out


def made():
    rng = random.Random(3)
    vocabulary = ["aa", "b", "Ünï", "d4", "eee", "x" * 60, "y" * 60, "ZZ", "日本", "q"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 9, 10, 11, 25])))) for i in range(2, 30)]
    items += [(40, items[5][1]), (41, None), (42, " .,; "), (None, items[7][1] + " tail"), (2, "again " * 12)]
    docs = []
    for d in range(120):
        t = [rng.choice(vocabulary + ["unknown"]) for _ in range(rng.randrange(0, 80))]
        if d % 3 == 0:
            t.insert(rng.randrange(len(t) + 1), ", ".join((items[d % len(items)][1] or "").upper().split()))
        docs.append((d, " ".join(t)))
    docs += [(500, None), (501, ""), (502, "\n\n"), (503, "x" * 200), (504, "again-again " * 400)]
    return docs, items


def check(spark, docs, items, **more):
    a = spark.createDataFrame([(*r, 1, "clash") for r in docs], "doc_id long, text string, items int, n_hit string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in D.judge(a, b, **more).collect()}
    want = brute(docs, items)
    assert {d: (r.n_words, r.n_hit, r["items"]) for d, r in got.items()} == want
    return got


def test_against_brute_force(spark):
    docs, items = made()
    got = check(spark, docs, items)
    for d, t in docs:
        r = got[d]
        if r.n_hit and r.longest_words:
            w = words(t)[r.longest_start : r.longest_start + r.longest_words]
            assert any(" ".join(w) in " ".join(words(x)) for i, x in items if str(i if i is not None else "") == r.longest_item)


def test_small_pieces_and_blocks(spark):
    docs, items = made()
    check(spark, docs, items, piece=150, block=60)


def test_real_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    check(spark, docs, items)


def test_empty_tables(spark):
    docs, items = made()
    none = []
    check(spark, none, items)
    check(spark, docs, none)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def brute_longest(text, items):
    """(words, start, item) of the longest common run of a window or a whole short item; then the first place, then the least id."""
    w, best = words(text), (0, None, None)
    for i, t in items:
        v, before, i = words(t), [], "" if i is None else str(i)
        before = [0] * (len(v) + 1)
        for a in range(len(w)):
            now = [0] * (len(v) + 1)
            for b in range(len(v)):
                if w[a] == v[b]:
                    n = now[b + 1] = before[b] + 1
                    if (n >= 10 or len(v) < 10 and n == len(v)) and (best[1] is None or (-n, a - n + 1, i) < (-best[0], best[1], best[2])):
                        best = (n, a - n + 1, i)
            before = now
    return best


def test_longest_matches_and_ties(spark):
    docs, items = made()
    rng = random.Random(8)
    long = " ".join(f"w{i}" for i in range(400))
    items += [(91, long), (90, long), (92, "aa " * 30)]
    docs += [(600, "lead " * 60 + " ".join(long.split()[100:]) + " tail"), (601, long), (602, "aa " * 200), (603, f"{long[:900]} {long}")]
    docs += [(700 + k, " ".join(rng.choice(long.split()[:3]) for _ in range(30)) + " " + " ".join(long.split()[k : k + 9 + k])) for k in range(20)]
    for more in ({}, {"piece": 150, "block": 60}):
        got = check(spark, docs, items, **more)
        for d, t in docs:
            assert (got[d].longest_words, got[d].longest_start, got[d].longest_item) == brute_longest(t, items), d


def test_one_word_said_a_million_times(spark):
    docs = [(1, "a " * 2_100_000), (2, "b"), (3, "a, A! " * 20)]
    got = check_counts(spark, docs, [("x", "a " * 1000), ("y", "a a"), ("z", "b c")])
    assert got == {1: (2_100_000, 2_100_000, ["x", "y"], 1000), 2: (1, 0, [], 0), 3: (40, 40, ["x", "y"], 40)}


def check_counts(spark, docs, items):
    rows = D.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    return {r.doc_id: (r.n_words, r.n_hit, r["items"], r.longest_words) for r in rows}


def test_items_with_one_template(spark):
    template = " ".join(f"t{k}" for k in range(40))
    items = [(f"i{k:05d}", f"{template} question {k}") for k in range(3000)]
    docs = [(d, f"{template} doc {d}") for d in range(200)]
    got = check_counts(spark, docs, items)
    assert all(x == (42, 40, [i for i, _ in items], 40) for x in got.values())
