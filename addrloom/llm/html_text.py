"""Main text of web pages, with nearest-URL page differencing.

A page is cut into blocks of text (the lines), and each line is `DROPPED`, `OWN` or `OPEN`. Markup settles the first two: head,
scripts, menus, headers, footers, sidebars, adverts, notices, forms and reader comments are dropped; paragraphs, headings,
list items, quotes, tables and the like inside `article` or `main` are the page's own. All other lines are open: what stands
outside an article, and bare containers (`div`, `section`, `span`) inside one.

Open lines are decided by differencing. Each page is paired with the nearest page of its host in the order of URL paths that has
other lines: the last before it, or where all before it are its copies the first after it; none if all are. The two line sequences
are aligned by their longest common subsequence, and open lines that both share are deleted. Pages that share over
`copies` of their characters are copies of each other and tell nothing about their lines: then nothing is deleted.

No page's text takes part in the search for partners. A first reading leaves a row of line hashes for each different page, and
these rows are sorted by range of (host, path, id, lines) in a number of parts that does not grow with the data. Edges of
the parts (the outermost page and the first one that differs from it, on the same host) are exchanged as a small table, so pairs
are the same however rows are dealt, and a host, or a group of copies, may hold any part of all rows. The second reading
drops what the first one has decided; where nothing is to be deleted, no text is shuffled at all.

Defined cases: null html gives an empty text, null url an empty host and path; repeated rows are kept, and have the same partner;
pages of one host, path and id are ordered by the hash of their lines; a tag or comment that never ends swallows the rest of the
page; an unclosed menu ends where an article begins; very long pages are read whole in linear time; lines are compared by 64-bit hashes;
only id, url and html are read; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release, table
from .url_filter import split_url

COPIES = 0.9  # pages that share more of their characters are copies
PAGES_A_PART, MOST_PARTS = 2000, 4096  # of the sorted line hashes; the driver sees a row of fixed size for each part

TAG = re.compile(r"/?[A-Za-z][^\s/>]*")
STOP = re.compile(r"[>\"']")
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "object", "canvas", "title")}
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
DROP = frozenset("nav header footer aside form menu dialog button head".split())
ARTICLE = frozenset(("article", "main"))
WHOLE = frozenset(("html", "body", "main", "article"))  # no name or role drops these
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre table caption figcaption address".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag ends if it is open: (tags ended, tags that shelter them).
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))), **dict.fromkeys(("td", "th"), (("td", "th"), ("table", "tr"))), **dict.fromkeys(("tr", "tbody", "thead", "tfoot"), (("tr", "caption"), ("table",)))}
NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|header|masthead|cookie|cookies|consent|notice|notices|popup|modal|newsletter|subscribe|share|social|related|comment|comments|disqus|replies|widget)(?:$|[\s_-])", re.I)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

OPEN, OWN = 0, 1


def dropped_by_attributes(attributes: str) -> bool:
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and NAMES.search(value) or name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


def tags_of(html: str, seek: list[int]) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of the tags of a page; comments and declarations have no name. The reader may set seek[0] to go on
    from there. Each character is looked at a bounded number of times: once quotes have swallowed the rest of a page, they
    mean nothing behind that place."""
    at, size, quotes = html.find("<"), len(html), True
    while 0 <= at < size - 1:
        nxt = html[at + 1]
        if nxt in "!?":
            opens, ends = ("<!--", "-->") if html.startswith("<!--", at) else ("<![CDATA[", "]]>") if html.startswith("<![CDATA[", at) else ("<!", ">")
            k = html.find(ends, at + len(opens))
            end = k + len(ends) if k >= 0 else size
            yield at, end, "", ""
            at = html.find("<", max(end, seek[0]))
            continue
        m = TAG.match(html, at + 1)
        if m is None:
            at = html.find("<", at + 1)
            continue
        k = m.end()
        while quotes:
            stop = STOP.search(html, k)
            if stop is None:
                quotes = False
            elif stop[0] == ">":
                k = stop.start()
                break
            else:
                k = html.find(stop[0], stop.end()) + 1
                if not k:
                    quotes = False
        if not quotes:
            k = html.find(">", m.end())
        end = k + 1 if k >= 0 else size
        yield at, end, m[0].lower(), html[m.end() : k if k >= 0 else size]
        at = html.find("<", max(end, seek[0]))


class Tree:
    """The open elements of a page that matter: blocks, and whatever drops its text."""

    def __init__(self, html: str):
        self.html, self.open = html, []
        self.places: dict[str, list[int]] = {}  # of the open elements by tag
        self.blocks: list[int] = []
        self.dropping: list[int] = []
        self.articles = self.contents = 0
        self.events: dict[str, tuple[list[int], list[bool]]] = {}

    def top(self, tags: Iterable[str]) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def close(self, k: int) -> None:
        while len(self.open) > k:
            tag, drop = self.open.pop()
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            if drop:
                self.dropping.pop()
            self.articles -= tag in ARTICLE
            self.contents -= tag in CONTENT

    def ends(self, tag: str, at: int) -> bool:
        """Whether the next tag of that name ends an element, rather than starts one or is missing."""
        if tag not in self.events:
            found = [(m.start(), m[1] == "/") for m in re.finditer(rf"<(/?){tag}(?=[\s/>])", self.html, re.I)]
            self.events[tag] = [a for a, _ in found], [e for _, e in found]
        places, ends = self.events[tag]
        k = bisect_left(places, at)
        return k < len(places) and ends[k]

    def start(self, tag: str, attributes: str, at: int) -> None:
        if tag in BLOCKS and self.blocks and self.open[self.blocks[-1]][0] == "p":
            self.close(self.blocks[-1])
        if tag in ENDS:
            ended, shelter = ENDS[tag]
            least = self.top(shelter)
            k = min((p[-1] for t in ended if (p := self.places.get(t)) and p[-1] > least), default=-1)
            if k >= 0:
                self.close(k)
        if tag in ARTICLE and self.dropping and (name := self.open[self.dropping[0]][0]) in DROP and not self.ends(name, at):
            self.close(self.dropping[0])
        if tag in VOID or attributes.endswith("/"):
            return
        drop = tag in DROP and not (tag == "header" and self.articles) or bool(attributes) and tag not in WHOLE and dropped_by_attributes(attributes)
        if tag in BLOCKS or drop:
            k = len(self.open)
            self.open.append((tag, drop))
            self.places.setdefault(tag, []).append(k)
            if tag in BLOCKS:
                self.blocks.append(k)
            if drop:
                self.dropping.append(k)
            self.articles += tag in ARTICLE
            self.contents += tag in CONTENT

    def end(self, tag: str) -> None:
        if p := self.places.get(tag):
            self.close(p[-1])

    @property
    def kind(self) -> int:
        return OWN if self.articles and (self.contents or self.open[self.blocks[-1]][0] in ARTICLE) else OPEN


def lines_of(html: str) -> list[tuple[str, int]]:
    """The page's lines in order, less the dropped ones, each OWN or OPEN."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    tree, at, seek, size = Tree(html), 0, [0], len(html)

    def flush() -> None:
        if parts:
            if text := " ".join(_html.unescape("".join(parts)).split()):
                out.append((text, tree.kind))
            parts.clear()

    for start, end, name, attributes in tags_of(html, seek):
        if start > at and not tree.dropping:
            parts.append(html[at:start])
        at = end
        if not name:
            continue
        if name in RAW:
            m = RAW[name].search(html, end)
            at = seek[0] = m.end() if m else size
        elif name in ("br", "/br"):
            if not tree.dropping:
                parts.append(" ")
        else:
            tag = name.removeprefix("/")
            if tag in BLOCKS:
                flush()
            if name[0] == "/":
                tree.end(tag)
            else:
                tree.start(tag, attributes, start)
    if at < size and not tree.dropping:
        parts.append(html[at:])
    flush()
    return out


def common_places(a: list[int], b: list[int], most_pairs: int = 1 << 20) -> set[int]:
    """Places of a longest common subsequence in a. Equal ends are taken off, then few equal pairs are chained directly, and
    many are aligned by halves over rows of bits, so space stays linear."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = set(range(head)) | set(range(len(a) - tail, len(a)))
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    both = set(x) & set(y)
    places = [k for k, v in enumerate(x) if v in both]
    x, y = [x[k] for k in places], [v for v in y if v in both]
    where: dict[int, list[int]] = {}
    for j, v in enumerate(y):
        where.setdefault(v, []).append(j)
    chosen = chained(x, where) if sum(len(where[v]) for v in x) <= most_pairs else halved(x, y)
    return out | {head + places[k] for k in chosen}


def chained(x: list[int], where: dict[int, list[int]]) -> list[int]:
    """Hunt and Szymanski's chains: for each length the least end in the other sequence."""
    ends: list[int] = []
    links: list[tuple] = []  # for each length its best chain (place in x, rest)
    for i, v in enumerate(x):
        for j in reversed(where[v]):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    out, link = [], links[-1] if links else None
    while link is not None:
        out.append(link[0])
        link = link[1]
    return out


def prefix_bits(x: list[int], y: list[int]) -> int:
    """After all of x, the columns of y where the length of the common subsequence grows are zero bits (Hyyro's recurrence)."""
    masks: dict[int, int] = {}
    for j, v in enumerate(y):
        masks[v] = masks.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    v = full
    for c in x:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return v


def lengths(bits: int, n: int) -> list[int]:
    out = [0]
    for c in reversed(bin(bits | 1 << n)[3:]):
        out.append(out[-1] + (c == "0"))
    return out


def halved(x: list[int], y: list[int]) -> list[int]:
    """Hirschberg's halves of x, each with the part of y where both halves are longest together."""
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if b - a == 0 or d - c == 0:
            continue
        if b - a == 1:
            if x[a] in y[c:d]:
                out.append(a)
            continue
        m = (a + b) // 2
        before, after = lengths(prefix_bits(x[a:m], y[c:d]), d - c), lengths(prefix_bits(x[m:b][::-1], y[c:d][::-1]), d - c)
        k = max(range(d - c + 1), key=lambda j: before[j] + after[d - c - j])
        todo += [(a, m, c, c + k), (m, b, c + k, d)]
    return out


def hash_line(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode(errors="replace")) - (1 << 63)


def shared_open(hashes: list[int], kinds: list[int], sizes: list[int], other: list[int], copies: float = COPIES) -> list[int]:
    """The open lines to delete: those shared with the other page, unless both are copies."""
    shared = common_places(hashes, other)
    if sum(sizes[k] for k in shared) > copies * sum(sizes):
        return []
    return [k for k in sorted(shared) if kinds[k] == OPEN]


KEY = ("host", "path", "p", "seq", "form")  # p: the id; seq: the lines; form: their kinds
KEYS = "host string, path string, p long, seq long, form long"


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


def _groups(html: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, list[str]]]:
    """Consecutive pages of some megabytes together, with the place of the first."""
    first, group, held = 0, [], 0
    for k, x in enumerate(html):
        group.append(x.as_py() or "")
        held += len(group[-1])
        if held >= size or len(group) == 1024:
            yield first, group
            first, group, held = k + 1, [], 0
    if group:
        yield first, group


def _read(pages: DataFrame, texts: bool) -> DataFrame:
    """For each row its key and, by choice, its lines or their hashes, kinds and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages, urls, hosts, paths, htmls = b.columns
            for a, group in _groups(htmls):
                found = [lines_of(x) for x in group]
                hashes = [[hash_line(t) for t, _ in x] for x in found]
                kinds = [bytes(k for _, k in x) for x in found]
                cut = slice(a, a + len(group))
                out = {"host": hosts[cut], "path": paths[cut], "p": pages[cut].fill_null(-(1 << 63))}
                out |= {"seq": pa.array([_hash(np.array(x, "<i8").tobytes()) for x in hashes], pa.int64()), "form": pa.array(map(_hash, kinds), pa.int64())}
                if texts:
                    out |= {"page_id": pages[cut], "url": urls[cut], "lines": pa.array([[t for t, _ in x] for x in found], pa.list_(pa.string()))}
                else:
                    out |= {"hashes": pa.array(hashes, pa.list_(pa.int64())), "kinds": pa.array(kinds, pa.binary()), "sizes": pa.array([[len(t) for t, _ in x] for x in found], pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_pydict(out)
        release()

    host, path = split_url(F.col("url"))
    rows = pages.withColumns({"host": host, "path": path}).select("page_id", "url", "host", "path", "html")
    return rows.mapInArrow(run, f"{KEYS}, page_id long, url string, lines array<string>" if texts else f"{KEYS}, hashes array<long>, kinds binary, sizes array<long>")


def _edges(dealt: DataFrame) -> DataFrame:
    """Rows of dealt that other parts need, with `part` set to the part that needs them: for each part the last page before it that
    differs from its first page, and the first page after it that differs from its last page, on the same host."""
    key = F.struct("host", *KEY[1:])
    ends = materialise(dealt.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high")), "html-ends")  # a row a part

    def other(end: str) -> Column:
        return F.when((F.col("host") == F.col(f"{end}.host")) & (F.col("seq") != F.col(f"{end}.seq")), key)

    inner = dealt.join(F.broadcast(ends), "part").groupBy("part").agg(F.first("low").alias("low"), F.first("high").alias("high"), F.min(other("low")).alias("low2"), F.max(other("high")).alias("high2"))
    inner = materialise(inner, "html-inner")
    short = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.xxhash64(F.col(f"{c}.host")).alias("host"), F.col(f"{c}.seq").alias("seq"))).alias(c)
    rows = inner.select("part", *map(short, ("low", "high", "low2", "high2"))).orderBy("part").collect()  # MOST_PARTS rows of fixed size
    wants = []
    for k, row in enumerate(rows):
        for end, step, names in ((row.low, -1, ("high", "high2")), (row.high, 1, ("low", "low2"))):
            at, found = k + step, None
            while 0 <= at < len(rows) and rows[at][names[0]].host == end.host and found is None:
                found = next(((rows[at].part, n) for n in names if (x := rows[at][n]) is not None and x.seq != end.seq), None)
                at += step
            if found is not None:
                wants.append((row.part, *found))
    wanted = dealt.sparkSession.createDataFrame(wants, "to int, part int, name string")
    named = inner.join(F.broadcast(wanted), "part").select("to", F.coalesce(*[F.when(F.col("name") == n, F.col(n)) for n in ("low", "high", "low2", "high2")]).alias("k"))
    named = materialise(named.select("to", *[F.col(f"k.{c}").alias(c) for c in KEY]), "html-wanted")  # two rows a part at most
    return dealt.drop("part").join(F.broadcast(named), list(KEY)).withColumn("part", F.col("to")).drop("to")


def deletions(pages: DataFrame, copies: float = COPIES, pages_a_part: int = PAGES_A_PART) -> DataFrame:
    """The key and the numbers of the lines to delete, for each different page that has some."""
    prints = materialise(_read(pages, texts=False), "html-prints")
    same = [F.first(c).alias(c) for c in ("hashes", "kinds", "sizes")]  # equal keys have equal lines
    different = materialise(prints.groupBy(*KEY).agg(*same), "html-pages")
    parts = min(MOST_PARTS, 1 + different.count() // pages_a_part)
    dealt = materialise(different.repartitionByRange(parts, *KEY).withColumn("part", F.spark_partition_id()), "html-dealt")
    rows = dealt.withColumn("ghost", F.lit(False)).unionByName(_edges(dealt).withColumn("ghost", F.lit(True)))
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", *KEY).select("part", *KEY, "hashes", "kinds", "sizes", "ghost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Final rows have lines to delete. Rows of a host's first run are put out without them, and one row for the run's lines follows."""
        out: list[tuple] = []
        kinds_of = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string())

        def full() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * len(kinds_of)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_of)], names=["part", *KEY, "gone", "state"])

        at, seq, lines, partner, forms = None, None, None, None, {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                part, host, path, p, now, form, hashes, kinds, sizes, ghost = row
                if at != (part, host):
                    at, partner, forms = (part, host), None, {}
                elif seq != now:
                    for f, (k, n) in forms.items():  # the first run ends
                        if gone := shared_open(lines, k, n, hashes, copies):
                            out.append((part, host, None, None, seq, f, gone, "run"))
                    partner, forms = lines, {}
                seq, lines = now, hashes
                if not ghost and OPEN in kinds:
                    if partner is None:
                        forms[form] = kinds, sizes
                        out.append((part, host, path, p, now, form, None, "first"))
                    elif gone := shared_open(hashes, kinds, sizes, partner, copies):
                        out.append((part, host, path, p, now, form, gone, "final"))
                if len(out) >= 4096:
                    yield full()
        yield full()
        release()

    found = materialise(rows.mapInArrow(run, f"part int, {KEYS}, gone array<int>, state string"), "html-found")
    runs = found.where("state = 'run'").select("part", "host", "seq", "form", F.col("gone").alias("_gone"))
    first = found.where("state = 'first'").join(runs, ["part", "host", "seq", "form"]).select(*KEY, F.col("_gone").alias("gone"))
    return materialise(found.where("state = 'final'").select(*KEY, "gone").unionByName(first), "html-deletions")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", copies: float = COPIES, pages_a_part: int = PAGES_A_PART) -> DataFrame:
    """page_id, url, text, n_lines (before differencing) and n_shared (deleted by it) for each row."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    gone = deletions(rows, copies, pages_a_part)
    read = _read(rows, texts=True)
    if gone.isEmpty():  # nothing to join: the texts stay where they are
        return read.select("page_id", "url", F.array_join("lines", " ").alias("text"), F.size("lines").cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_shared"))
    kept = F.filter("lines", lambda line, k: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), k))
    n_shared = F.coalesce(F.size("gone"), F.lit(0))
    return read.join(gone, list(KEY), "left").select("page_id", "url", F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept), " ").alias("text"), F.size("lines").cast("long").alias("n_lines"), F.greatest(n_shared, F.lit(0)).cast("long").alias("n_shared"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared")


QUERIES = {"op5_html_text": op5_html_text}
ORACLES: dict[str, str] = {}
