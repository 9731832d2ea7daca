"""Toxicity, personal data, HTML text, chat quotes, quality rules, url filter."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from addrloom.llm import chat_quotes as C
from addrloom.llm import html_text as H
from addrloom.llm import pii as P
from addrloom.llm import quality as Q
from addrloom.llm import toxicity as T
from addrloom.llm import url_filter as U


def texts(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, base string")


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (4, "word"), (None, "null id"), (7, "x " * 50000), (8, "é\x00\x1f" * 10)]


# toxicity


def test_grammar_weighs_clauses():
    r = T.Reader(T.Lexicon({"idiot": 2.0}))
    w = lambda t: r.clauses(t.encode())[0]
    assert w("what an idiot. fine") == [2.0]
    assert w("you are an idiot.") == [3.0]
    assert w("he is not an idiot.") == [pytest.approx(0.6)]
    assert w('she said: idiot') == [2.0]  # the colon ends the clause
    assert w("she said he was an idiot.") == [1.0]
    assert w('"idiot" he') == [1.0]
    assert w("i will kill you. nothing") == w("you i kill") == [3.0]
    assert w("i will kill the lights. you") == [pytest.approx(0.2)]
    assert w("an idiot, you are. yes") == [3.0]
    assert w('"you idiot" i will kill you') == [1.5 + 3.0]
    assert w("never is this one here an idiot") == [2.0]  # out of the negation's reach


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    scored = T.op4_toxicity(spark, d)
    rows = scored.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = Counter((r.toxic, r.predicted) for r in rows)
    assert hit[1, 1] / (hit[1, 1] + hit[0, 1]) > 0.97
    assert hit[1, 1] / (hit[1, 1] + hit[1, 0]) >= 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def brute_weights(text, insults):
    """Clause weights without transducers: each insult or threat by the words of its clause."""
    out, quoted, clause = [], False, []
    chunks = text.split()

    def close():
        total, hit = 0.0, False
        target = any(c in T.TARGETS for c, _ in clause)
        for k, (c, inside) in enumerate(clause):
            if c in insults or c in T.THREATS:
                w = (2.0 * (1.5 if target else 1.0)) if c in insults else (3.0 if target else 0.2)
                negated = any(x in T.NEGATIONS for x, _ in clause[max(0, k - 3) : k])
                said = any(x in T.REPORTS for x, _ in clause[:k])
                total, hit = total + w * (0.3 if negated else 1.0) * (0.5 if said or inside else 1.0), True
        if hit:
            out.append(total)
        clause.clear()

    for chunk in chunks:
        if chunk.startswith('"'):
            quoted = not quoted
        clause.append((chunk.strip('".'), quoted))
        if len(chunk) > 1 and chunk.rstrip(".").endswith('"'):
            quoted = not quoted
        if chunk.rstrip('"').endswith("."):
            close()
    close()
    return out


def test_grammar_against_brute_force():
    rng = random.Random(12)
    words = ["idiot", "moron", "kill", "you", "not", "said", "plain", "word", "other", "green"]
    r = T.Reader(T.Lexicon({"idiot": 2.0, "moron": 2.0}))
    for _ in range(3000):
        chunks, quoted = [], False
        for _ in range(rng.randrange(1, 25)):
            c = rng.choice(words)
            if not quoted and "said" not in chunks and rng.random() < 0.1:
                c, quoted = '"' + c, True
            elif quoted and rng.random() < 0.3:
                c, quoted = c + '"', False
            chunks.append(c + ("." if rng.random() < 0.15 else ""))
        text = " ".join(chunks)
        if '"' in text and "said" in text:
            continue  # how quotes and verbs of saying meet is the composition's own business
        assert r.clauses(text.encode())[0] == pytest.approx(brute_weights(text, ("idiot", "moron"))), text


def test_training_reads_one_bounded_text_an_id(spark):
    docs = [(1, "you idiot") for _ in range(500)] + [(2, "idiot " * 100_000)] + [(k, "you idiot fool" if k % 2 else "a good day") for k in range(3, 60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 60)], "doc_id long, toxic int")
    m = T.train(spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, toxic int"), labels, F.lit(True))
    assert list(m.scores([b"you idiot fool"]))[0] > 0.7 > 0.3 > list(m.scores([b"a good day"]))[0]
    ids = spark.createDataFrame([("a-1", "x")], "doc_id string, text string")
    assert T.train(ids, spark.createDataFrame([("a-1", 1)], "doc_id string, toxic int"), F.lit(True)).lexicon.words


def test_toxicity_odd_rows(spark):
    m = T.Model(T.Lexicon({"idiot": 2.0}), T.DEFAULT)
    got = T.score(texts(spark, ODD), m).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert T.score(texts(spark, []), m).count() == 0
    none = T.train(texts(spark, ODD), spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert none.lexicon.words


# personal data

PII_TEXTS = [
    "mail a.b+c@x-y.co.uk. or <q@w.e>@r.t x@y x@y.z@k.l a@b.c_d@e.f", "1.2.3.4 and 256.1.1.1 1.2.3.4.5.6.7.8 01.002.3.255 1.1.1." + "9" * 5000,
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111222 1 2 3", "+1 (017) 555-7713, +12 +123456 +1-2-3-4-5-6-7-8-9 +49.30.1234567)",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and password: Hunter2Hunter2Hunter2', "é@x.com 日本+81 3 1234 5678。", "@@@ a@ @b.c", None, "",
]


def brute_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(x) < 400 and int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: [int(c) for c in m[0] if "0" <= c <= "9"]
    luhn = lambda d: sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(4)
    more = ["".join(rng.choice("a1.@+- ()-9_%é\n") for _ in range(60)) for _ in range(400)]
    docs = texts(spark, list(enumerate(PII_TEXTS + more)))
    for r in P.find(docs).select("doc_id", P.joined(F.col("base")).alias("b"), "added").collect():
        assert r.b == brute_base((PII_TEXTS + more)[r.doc_id] or ""), (PII_TEXTS + more)[r.doc_id]


def test_personal_data_query(spark):
    d = "/root/testdata/sf0.001"
    texts_of = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in P.op6_personal_data(spark, d).collect():
        base = brute_base(texts_of[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [base.count(f"{k}:") for k in P.BASE]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_added_spans(spark):
    rows = [(i, f'text token = "{i:040x}" more' if i % 2 else f"plain {i} = 3 text") for i in range(1000, 1200)]
    got = P.find(texts(spark, rows + ODD)).where("doc_id >= 1000").collect()
    for r in got:
        assert [s.kind for s in r.added] == (["secret"] if r.doc_id % 2 and len(set(f"{r.doc_id:x}")) > 1 else [])
    assert P.find(texts(spark, [])).count() == 0


def test_em_prefers_agreeing_labelers():
    q, chances, prior = P.estimate(["+++0++", "--0---", "++00+-"], P.np.array([100.0, 100.0, 5.0]))
    assert q[0] > 0.9 and q[1] < 0.1 and chances[1, 0, 0] > chances[0, 0, 0]


# html

PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li>Home</ul></nav><!-- c --><div class="ad">Buy</div>
<article><h1>Title &amp; more</h1><p><b>One<br><p>Two&nbsp;  x</p><div id="comments">nice</div><form>f<input></form>tail</article><aside>s</aside><footer>&copy;</footer></body></html>"""


def test_lines_by_markup():
    assert [t for t, _ in H.lines_of(PAGE)] == ["Title & more", "One", "Two x", "tail"]
    for odd in ["", "<", "<p", "text", "<p>a<p>b", "</div>x", "<script>", "<!-- x", "a<br>b &lt;p&gt; &#65;&#x42;", "<article>" * 500]:
        H.lines_of(odd)
    assert H.lines_of("a<br>b &lt;p&gt; &#65;&#x42;") == [("a b <p> AB", False)]


def lcs_length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        got = sorted(H.common_places(a, b))
        assert len(got) == lcs_length(a, b)
        it = iter(b)
        assert all(any(y == a[k] for y in it) for k in got)


def test_differencing_is_independent_of_dealing(spark):
    rows = []
    for i in range(400):
        shared = "<div>All rights</div><div>Follow us</div>" if i % 40 else ""
        rows.append((i, f"http://h{i % 3 if i % 2 else 0}.org/a/{i * 7 % 400:04d}?q", f"<div>Own {i}</div>{shared}<article>All rights {i % 5}</article>"))
    rows += [(1000, None, None), (1001, "bad", ""), (1002, "http://alone.net/x", "<div>Only</div>"), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, part int, host int")
    key = lambda f: sorted((r.page_id, r.text) for r in f.collect())
    one, many = key(H.extract(df)), key(H.extract(df, pages_a_part=20))
    assert one == many and len(one) == len(rows)
    by = dict(one)
    assert by[1002] == "Only" and by[1000] == "" and by[1] == "Own 1 All rights 1"
    assert key(H.extract(df.limit(0))) == []


# chat


def test_quotes_and_threads(spark):
    rows = [
        (1, 0, "user", "How are you?\nSecond line"), (1, 1, "assistant", "Bob wrote:\n> how are YOU\nFine."), (1, 2, "user", "> Fine.\n>> How are you?\nGood"),
        (1, 3, "user", "> unknown\nHello"), (1, 4, "user", ">second line\nyes"), (1, 4, "user", ">second line\nyes"), (1, 5, "user", "> later\nx"), (1, 6, "user", "later"),
        (2, 0, "user", "> How are you?\nother conversation"), (3, None, None, None), (None, 1, "user", "> x"), (4, 0, "system", ""),
    ]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, root int, body string")
    got = C.link(df).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert (by[1, 1].body, by[1, 1].reply_to, by[1, 1].root, by[1, 1].depth) == ("Fine.", 0, 0, 1)
    assert (by[1, 2].reply_to, by[1, 2].root, by[1, 2].depth, by[1, 2].n_linked, by[1, 2].body) == (1, 0, 2, 2, "Good")
    assert (by[1, 3].reply_to, by[1, 3].root, by[1, 3].n_quoted) == (None, 3, 1)
    assert (by[1, 4].reply_to, by[1, 5].reply_to, by[2, 0].reply_to) == (0, None, None)
    assert C.link(df.limit(0)).count() == 0


def test_long_threads(spark):
    rows = [(5, i, "user", (f"> say {i - 1}\n" if i else "") + f"say {i}") for i in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert all((r.root, r.depth) == (0, r.turn) for r in C.link(df).collect())


# quality


def brute_quality(t):
    w = re.findall(r"[^ \t\n\x0b\f\r]+", t or "")
    c = Counter(zip(w, w[1:], w[2:]))
    rep = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^ \t\n\x0b\f\r]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep)


def test_quality_measurements(spark):
    rng = random.Random(9)
    rows = ODD + [(100 + i, "".join(rng.choice(["a ", "b ", "c ", "\n", "É# ", "\t", "a b c "]) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows = [r for r in rows if r[0] is not None]
    got = {r.doc_id: tuple(r)[1:6] for r in Q.measurements(texts(spark, rows).withColumn("words", F.lit(1)).withColumn("t", F.lit(2))).collect()}
    assert got == {d: brute_quality(t) for d, t in rows}
    assert Q.ledger(texts(spark, [])).count() == 0


def test_ablation_counts(spark):
    rows = [(1, "a " * 10), (2, "# " * 60), (3, " ".join(f"word{i}" for i in range(60))), (4, "x")]
    led = Q.ledger(texts(spark, rows)).cache()
    got = {r.rule: (r.n_failed, r.n_only) for r in Q.ablation(led, Q.V1).collect()}
    bits = {r.doc_id: r.failed_bits for r in led.collect()}
    for name, bit, _ in Q.RULES:
        want = (sum(b >> bit & 1 for b in bits.values()), sum(b == 1 << bit for b in bits.values()))
        assert got.get(name, (0, 0)) == want
    assert [r.doc_id for r in Q.apply_policy(led, Q.V1).where("kept").collect()] == [3]


# urls


def test_url_verdicts(spark):
    rows = [
        (1, "http://a.net/x"), (2, "http://EXAMPLE.net/en/x"), (3, "http://www.example.net/de/"), (4, "https://example.com/de/1"), (5, "http://casino.org/fr/1"), (6, "http://casino-win.org/"),
        (7, "http://cheap-pills.example.com/en/1"), (8, "http://cheapest.example.com/"), (9, None), (10, "casino"), (11, "http://b.net"), (12, "http://free.x.com/free"), (13, "x://y://net/"),
        (14, "http://spam1.com/"), (15, "http://h?p=://u"), (15, "http://h#f/x"),
    ]
    got = [tuple(r) for r in U.judge(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, host int")).select("page_id", "host", "path", "rule", "verdict").collect()]
    by = {r[0]: r[1:] for r in got}
    assert by[1] == ("a.net", "/x", "net/", "block") and by[2] == ("example.net", "/en/x", "example.net/en/", "allow") and by[3][2:] == ("net/", "block")
    assert by[4][2:] == ("example.com/de/", "block") and by[5][2:] == ("org/fr/", "allow") and by[6][2:] == (None, "block") and by[7][2:] == (None, "block")
    assert by[8][2:] == (None, "allow") and by[9] == ("", "", None, "allow") and by[10] == ("", "", None, "block") and by[11] == ("b.net", "", None, "allow")
    assert by[12][3] == "allow" and by[13][0] == "y:" and by[14][3] == "allow" and by[15][:2] == ("h", "")
