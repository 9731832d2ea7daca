"""Generated threads against a brute-force version of the linking."""

import random
import time
from collections import Counter

from addrloom.llm import chat_quotes as C


def wrapped(text, width):
    """The text's words in lines of a width."""
    lines, line = [], ""
    for w in text.split():
        if line and len(line) + 1 + len(w) > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*lines, line]


def made(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(300)]
    rows = []
    for conv in range(25):
        said = []
        for turn in range(rng.randrange(1, 30)):
            own = "yes" if rng.random() < 0.2 else " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 60)))
            quotes, text = [], ""
            if said and rng.random() < 0.7:
                at = rng.randrange(len(said))
                text = "Somebody wrote:\n" + "".join(f"> {x}\n" for x in wrapped(said[at], rng.choice((20, 47, 90))))
                if at and rng.random() < 0.4:
                    text += "".join(f">> {x}\n" for x in wrapped(said[rng.randrange(at)], 33))
            said.append(own)
            rows.append((conv, turn, "user", text + "\n".join(wrapped(own, 60))))
    return rows


def brute(rows):
    """Parents by looking at every message before; roots by walking up."""
    parsed = {(c, t): C.parse(x) for c, t, _, x in rows}
    out = {}
    for (c, t), (_, passages) in parsed.items():
        parent = None
        for level, text in passages:
            votes = Counter()
            wanted = C.passage_hashes(text)
            for h in wanted:
                origin = max((u for (d, u), (body, _) in parsed.items() if d == c and u < t and h in C.own_hashes(body)), default=None)
                if origin is not None:
                    votes[origin] += 1
            best = max(((k, o) for o, k in votes.items() if 2 * k >= len(wanted)), default=None)
            if best and level == 1 and parent is None:
                parent = best[1]
        out[c, t] = parent
    roots = {}
    for c, t in out:
        root, depth = t, 0
        while out[c, root] is not None:
            root, depth = out[c, root], depth + 1
        roots[c, t] = root, depth
    order = {}
    for c in {c for c, _ in out}:
        for k, (_, t) in enumerate(sorted((roots[d, t][0], t) for d, t in out if d == c)):
            order[c, t] = k
    return {k: (out[k], *roots[k], order[k]) for k in out}


def test_threads_against_brute_force(spark):
    rows = made()
    got = {(r.conv_id, r.turn): (r.reply_to, r.root, r.depth, r.position) for r in C.link(spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, body string, h long")).collect()}
    want = brute(rows)
    assert got == want and sum(p is not None for p, *_ in want.values()) > 150


def test_rewrapped_passages_and_short_replies(spark):
    text = "The quick brown fox jumps over the lazy dog near the river bank and then goes home to sleep until morning comes again"
    rows = [(1, 0, "user", text), (1, 1, "user", "thanks"), (1, 2, "user", "thanks"), (1, 3, "user", "On Monday Ann wrote:\n" + "".join(f"> {x}\n" for x in wrapped(text, 24)) + "I see"), (1, 4, "user", "> thanks\nyou are welcome")]
    got = {r.turn: r for r in C.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[3].reply_to, got[3].body, got[3].n_quoted, got[4].reply_to) == (0, "I see", 1, 2)


def test_one_conversation_of_equal_words(spark):
    n = 4000  # everybody quotes the same word and says it: pairs would be eight million
    rows = [(7, t, "user", "> ok\nok") for t in range(n)] + [(8, 0, "user", "hello")] + [(None, 1, "user", "> ok")] * 3
    got = C.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {r.turn: (r.reply_to, r.root, r.position) for r in got if r.conv_id == 7}
    assert by == {t: (t - 1 if t else None, 0, t) for t in range(n)}
    assert sorted(r.position for r in got if r.conv_id is None) == [0, 1, 2]


def test_long_messages():
    began = time.perf_counter()
    body, passages = C.parse("> a b c d e f g h i\n" * 50_000 + "x " * 500_000)
    C.own_hashes(body)
    assert len(passages) == 1 and C.passage_hashes(passages[0][1])
    assert time.perf_counter() - began < 20
