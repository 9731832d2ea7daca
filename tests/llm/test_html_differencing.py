import random
import time

import pytest

from addrloom.llm import html_text as H
from tests.llm.test_texts import lcs_length


def test_names_never_drop_articles():
    assert H.lines_of('<html><body class="has-sidebar"><article class="post share"><p>A<p>B</p></article></body>') == [("A", H.OWN), ("B", H.OWN)]
    assert H.lines_of('<ul><li class="nav">a<li>b</ul>') == [("b", H.OPEN)]
    assert H.lines_of("<nav><a>x</a><article><p>text</article>") == [("text", H.OWN)]
    assert H.lines_of("<nav><article><p>x</article></nav><p>y") == [("y", H.OPEN)]
    assert H.lines_of("<article>a<p>b</p><div>c<p>d</p></div></article>") == [("a", H.OWN), ("b", H.OWN), ("c", H.OPEN), ("d", H.OWN)]
    assert H.lines_of("<article><p class=ad>x<div>y</div></article>") == [("y", H.OPEN)]
    assert H.lines_of('<script>if (a <b && "</script><p>x') == [("x", H.OPEN)]


@pytest.mark.parametrize("piece", ["<a ", "<a \"'", "<li><div>", "<span class=ad>", "<", "<!--", "<p>a", "</x>", "&am", '<a ">"'])
def test_hostile_pages_take_linear_time(piece):
    began = time.perf_counter()
    H.lines_of(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 8  # a second or two on an idle machine; a quadratic scan takes hours


def test_long_alignments():
    r = list(range(50_000))
    assert len(H.common_places(r, r[::-1])) == 1
    rng = random.Random(5)
    for _ in range(150):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        got = sorted(H.common_places(a, b, most_pairs=0))
        assert len(got) == lcs_length(a, b)
        it = iter(b)
        assert all(any(y == a[k] for y in it) for k in got)


def subsequence(a, b):
    """The places in a of some longest common subsequence, by the full table."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif t[i - 1][j] >= t[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def made(seed=1):
    """Pages of lines that differ from each other, so that the common subsequence is unique; each page as (id, url, lines)."""
    rng, out = random.Random(seed), []
    for host in range(5):
        site = [f"site {host} line {k}" for k in range(6)]
        for k in range((3, 40, 80, 1, 25)[host]):
            own = [(f"text {host} {rng.randrange(10**6)} and more words of its own", rng.randrange(3)) for _ in range(rng.randrange(4))]
            if rng.random() < 0.2 and out and out[-1][1].startswith(f"http://h{host}.org/"):
                out.append((len(out), f"http://h{host}.org/{rng.randrange(100):03d}", out[-1][2]))  # a copy elsewhere
                continue
            shared = [(x, 0) for x in site if rng.random() < 0.7]
            lines = shared[:2] + own + shared[2:]
            out.append((len(out), f"http://h{host}.org/{rng.randrange(100):03d}?x", lines))
    return out


def written(lines):
    """Kind 0: a block outside; 1: a paragraph of an article; 2: a bare container inside one."""
    return "<nav>Menu</nav>" + "".join((f"<div>{t}</div>", f"<article><p>{t}</p></article>", f"<article><div>{t}</div></article>")[k] for t, k in lines) + "<footer>end"


def brute(pages):
    out, n_shared = {}, 0
    path = lambda u: u.split("?")[0].split("/", 3)[3]
    for i, url, lines in pages:
        host, texts = url.split("/")[2], [t for t, _ in lines]
        order = sorted((path(u), j) for j, u, _ in pages if u.split("/")[2] == host)
        at = order.index((path(url), i))
        other = next((pages[j][2] for _, j in [*order[:at][::-1]] if [t for t, _ in pages[j][2]] != texts), None)
        other = other if other is not None else next((pages[j][2] for _, j in order[at + 1 :] if [t for t, _ in pages[j][2]] != texts), None)
        shared = set(subsequence(texts, [t for t, _ in other])) if other is not None else set()
        if sum(len(texts[k]) for k in shared) > H.COPIES * sum(map(len, texts)):
            shared = set()
        gone = {k for k in shared if lines[k][1] != 1}
        n_shared += len(gone)
        out[i] = " ".join(t for k, t in enumerate(texts) if k not in gone)
    return out, n_shared


@pytest.mark.parametrize("pages_a_part", [2000, 9])
def test_query_against_brute_force(spark, pages_a_part):
    pages = made()
    df = spark.createDataFrame([(i, u, written(x), "clash", 1) for i, u, x in pages], "page_id long, url string, html string, host string, seq int").repartition(3)
    rows = H.extract(df, pages_a_part=pages_a_part).collect()
    want, n_shared = brute(pages)
    assert {r.page_id: r.text for r in rows} == want and len(rows) == len(pages)
    assert sum(r.n_shared for r in rows) == n_shared > 300


def test_many_equal_rows_and_one_host(spark):
    page = lambda own: f"<div>Top of all</div><p>{own}</p><div>End</div>"
    rows = [(1, "http://a.org/m", page("The text said many times over"))] * 300 + [(k, f"http://a.org/{k}", page(f"Another text {k} of this host")) for k in range(2, 60)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), pages_a_part=5).collect()
    assert len(got) == len(rows) and {r.text for r in got if r.page_id == 1} == {"The text said many times over"}
    assert all(r.text == f"Another text {r.page_id} of this host" for r in got if r.page_id > 1)
