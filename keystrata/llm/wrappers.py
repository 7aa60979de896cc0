"""Main text of web pages by wrapper induction over all pages of a host.

A page is read as runs: the text of an element with text of its own, inline elements in it
included, or of an inline element in one that has none.  Its DOM tree, in which neighbours of
one tag, class and id are one repeated node, is aligned with the host's tree by simple tree
matching (the largest order-keeping match of equal labels from the root down).  The host's
tree is the merged one of its `SEEDS` most frequent trees; a node that finds no partner there
is named by its label below its parent's name, so that it too is counted.

For every host all its distinct pages are counted: a run whose text at its aligned node is on
at least `SHARE` of them is template, a node that is on as many but whose text varies is a
slot.  Distinct are pages of different main text by the element names alone, so copies of a
page prove nothing; pages without text are left out.

Constant text is dropped, inside the article element too (there `INSIDE` pages at least
must have it, as near copies share paragraphs); slots are content, outside the article too.
Names decide the rest: menus, headers, footers, sidebars, notices, adverts, forms and
comments are dropped even where they vary; on headings and paragraphs of a host that has a
template, class and id decide nothing, since they often name the content; what is neither
template nor slot is content in the article, or anywhere on a page that has none.  A host
with one distinct page has no template, so that names alone decide.

Counts are made of one row a distinct page and summed per host and run; what is left, the
template, is joined by host: broadcast only if its summed size was found small, else in
salted rows, so that a host with a third of all pages is not one task.

Edge cases: null or empty html gives an empty text; broken markup is read as far as it
goes, in linear time; elements may nest to any depth, but below `DEPTH` levels, or where two
nodes have more than `WIDE` pairs of children, labels alone align them; pages without "://" in
their url share the host ""; rows without an id are extracted like others, repeated rows one
by one; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_batches
from .urlfilter import host_path

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# Fixed values of HTML: elements without content, raw text, blocks, and what ends an open p or li
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CHROME = frozenset("nav header footer aside form menu button select option input dialog label fieldset head".split())
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notification|popup|modal|overlay|comments?|disqus|replies|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|share|sharing|social|related|recommend\w*|newsletter|subscribe|widget|toolbar|pagination|pager|copyright)(?=$|[\s_-])", re.I)
#: Names that say where a thing stands: outside the article only.
LAYOUT = re.compile(r"(?:^|[\s_-])(?:header|masthead|side|search|login|signup)(?=$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
TEXT = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote".split())
SALTS, BROADCAST_BYTES = 32, 8 << 20
#: Trees that seed a host's tree; levels and pairs of children that are matched as trees.
SEEDS, DEPTH, WIDE = 4, 60, 4096
#: Labels whose neighbours are no repetition of one thing.
PLAIN = frozenset("div section span".split())
#: Least share of a host's distinct pages, and least pages outside and inside the article
SHARE, OUTSIDE, INSIDE = 0.5, 2, 3


class Node:
    __slots__ = ("tag", "label", "chrome", "noise", "kids", "up", "key")

    def __init__(self, tag: str, attrs: str, up):
        self.tag, self.up, self.kids, self.key = tag, up, [], None
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)} if attrs else {}
        mark = f"{found.get('class', '')} {found.get('id', '')}".strip()
        self.label = f"{tag}.{mark}" if mark else tag
        self.chrome = tag in CHROME or found.get("role", "").lower() in ROLES
        self.noise = self.chrome or (tag not in ("html", "body", "article", "main") and bool(mark and (NOISE.search(mark) or LAYOUT.search(mark))))

    def skipped(self) -> bool:
        return self.chrome or (self.noise and self.tag not in TEXT)


def parse(html: str) -> Node:
    """A tree of elements and strings; open elements end with the text."""
    root = cur = Node("#", "", None)
    at, opened = 0, Counter()

    def close(upto: Node):
        nonlocal cur
        while cur is not upto:
            opened[cur.tag] -= 1
            cur = cur.up

    while True:
        lt = html.find("<", at)
        if lt < 0:
            if at < len(html):
                cur.kids.append(unescape(html[at:]))
            return root
        m = NAME.match(html, lt)
        if not m and html[lt + 1:lt + 2] not in ("!", "?"):  # a sign, no tag
            cur.kids.append(unescape(html[at:lt + 1]))
            at = lt + 1
            continue
        if lt > at:
            cur.kids.append(unescape(html[at:lt]))
        if not m:
            mark, end = next(((a, b) for a, b in (("<!--", "-->"), ("<![CDATA[", "]]>")) if html.startswith(a, lt)), ("<!", ">"))
            to = html.find(end, lt + len(mark))
            if to < 0:
                return root
            at = to + len(end)
            continue
        rest = REST.match(html, m.end())
        to = rest.end() if rest else html.find(">", m.end()) + 1  # an open quote ends with the tag
        if not to:
            return root
        attrs, tag, at = html[m.end():to - 1], m[2].lower(), to
        if m[1]:
            x = cur
            while opened[tag] and x is not root and x.tag != tag:
                if x.tag in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    x = root  # a stray end tag does not close the article
                    break
                x = x.up
            if opened[tag] and x is not root:
                close(x.up)
            continue
        if tag in BLOCK:  # a block ends an open paragraph, an item ends the item before
            x = cur
            while x is not root and (x.tag not in BLOCK or x.tag in ("p", "li", "dt", "dd", "tr")) and x.tag != "div":
                if x.tag == "p" or (x.tag == tag and tag in ("li", "dt", "dd", "tr")):
                    close(x.up)
                    break
                x = x.up
        if tag in VOID:
            cur.kids.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        node = Node(tag, attrs, cur)
        cur.kids.append(node)
        if not attrs.rstrip().endswith("/") or tag in BLOCK:
            cur = node
            opened[tag] += 1


def item(s: str) -> int:
    h = xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def below(parent: int, label: str, place: object = "") -> int:
    """Name of a node: its parent's, its label, and its place among equal ones of the host's tree."""
    return item(f"{parent}/{label}/{place}")


class Tree:
    """A node of an aligned tree; in a page's, `nodes` are the elements it stands for."""
    __slots__ = ("label", "kids", "nodes", "key")

    def __init__(self, label: str, nodes=()):
        self.label, self.kids, self.nodes, self.key = label, [], list(nodes), 0


def tree_of(nodes: list[Node], level: int = 0) -> Tree:
    out = Tree(nodes[0].label, nodes)
    if level < DEPTH:
        groups: list[list[Node]] = []
        for k in (k for n in nodes for k in n.kids if not isinstance(k, str) and not k.skipped()):
            if groups and groups[-1][0].label == k.label and k.label not in PLAIN:
                groups[-1].append(k)
            else:
                groups.append([k])
        out.kids = [tree_of(g, level + 1) for g in groups]
    return out


def shape(t: Tree) -> list:
    return [t.label, [shape(k) for k in t.kids]]


def of_shape(x: list) -> Tree:
    t = Tree(x[0])
    t.kids = [of_shape(k) for k in x[1]]
    return t


class Matching:
    """Simple tree matching of two trees: sizes of the largest matches, and who meets whom."""

    def __init__(self):
        self.known: dict[tuple[int, int], int] = {}

    def size(self, a: Tree, b: Tree) -> int:
        if a.label != b.label:
            return 0
        at = id(a), id(b)
        if at not in self.known:
            self.known[at] = 1 + (self.rows(a, b)[-1][-1] if len(a.kids) * len(b.kids) <= WIDE else 0)
        return self.known[at]

    def rows(self, a: Tree, b: Tree) -> list[list[int]]:
        rows = [[0] * (len(b.kids) + 1)]
        for x in a.kids:
            row = [0]
            for j, y in enumerate(b.kids):
                row.append(max(row[j], rows[-1][j + 1], rows[-1][j] + self.size(x, y)))
            rows.append(row)
        return rows

    def partners(self, a: Tree, b: Tree) -> list[tuple[int, int]]:
        """Pairs of matched children of a and b, ascending; by labels alone where they are many."""
        if len(a.kids) * len(b.kids) > WIDE:
            free: dict[str, list[int]] = {}
            for j in range(len(b.kids) - 1, -1, -1):
                free.setdefault(b.kids[j].label, []).append(j)
            out, last = [], -1
            for i, x in enumerate(a.kids):
                while free.get(x.label) and free[x.label][-1] <= last:
                    free[x.label].pop()
                if free.get(x.label):
                    last = free[x.label].pop()
                    out.append((i, last))
            return out
        rows, i, j, out = self.rows(a, b), len(a.kids), len(b.kids), []
        while i and j:
            s = self.size(a.kids[i - 1], b.kids[j - 1])
            if s and rows[i][j] == rows[i - 1][j - 1] + s:
                out.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return out[::-1]


class Template:
    """A host's tree, merged of its seeds in their order; all its nodes are named."""

    def __init__(self, seeds: tuple[str, ...]):
        self.root, self.named = Tree("#"), {}
        for s in seeds:
            self.merge(self.root, of_shape(json.loads(s)), Matching())

    def merge(self, t: Tree, page: Tree, m: Matching):
        met = {j: i for i, j in m.partners(t, page)}
        kids, at = list(t.kids), 0
        for j, x in enumerate(page.kids):
            if j in met:
                at = kids.index(t.kids[met[j]]) + 1
                self.merge(t.kids[met[j]], x, m)
                continue
            new = Tree(x.label)
            new.key = below(t.key, x.label, sum(k.label == x.label for k in kids))
            self.merge(new, x, m)
            kids.insert(at, new)
            at += 1
        t.kids = kids

    def names(self, page: Tree) -> list[int]:
        """Names of a page's nodes, the root first, each before what is below it."""
        key = json.dumps(shape(page))
        if key not in self.named:
            if len(self.named) >= 1000:
                self.named.clear()
            out, m = [], Matching()

            def walk(t: Tree | None, x: Tree, name: int):
                out.append(name)
                met = {j: t.kids[i] for i, j in m.partners(t, x)} if t else {}
                for j, k in enumerate(x.kids):
                    walk(met.get(j), k, met[j].key if j in met else below(name, k.label))

            walk(self.root, page, 0)
            self.named[key] = out
        return self.named[key]


@lru_cache(maxsize=64)
def host_tree(seeds: tuple[str, ...]) -> Template:
    return Template(seeds)


class Run:
    __slots__ = ("at", "inside", "named", "parts", "text")

    def __init__(self, at: int, inside: bool, named: bool):
        self.at, self.inside, self.named, self.parts, self.text = at, inside, named, [], ""

    def key(self) -> int:
        """Of the text at its place; odd inside the article."""
        return item(f"{self.at}\0{self.text}") & ~1 | self.inside

    def place(self) -> int:
        return self.at & ~1


def article(root: Node, tag: str) -> list[Node]:
    """The outermost elements of that tag which no name speaks against."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.noise:
            continue
        if node.tag == tag:
            out.append(node)
        else:
            stack += [k for k in reversed(node.kids) if not isinstance(k, str)]
    return out


def read(html: str) -> tuple[Node, list[Node]]:
    """The tree of a page and its articles."""
    root = parse(html)
    main = article(root, "article") or article(root, "main")
    for node in main:  # a header inside the article belongs to it
        for x in node.kids:
            if not isinstance(x, str) and x.tag == "header":
                x.chrome = x.noise = False
    stack = list(main)
    while stack:
        node = stack.pop()
        node.noise = node.chrome or bool(node.noise and NOISE.search(node.label.partition(".")[2]))
        stack += [k for k in node.kids if not isinstance(k, str)]
    return root, main


def tree_text(html: str) -> str:
    """The page's tree of labels, equal for pages that are built alike."""
    return json.dumps(shape(tree_of([read(html)[0]])))


def runs(html: str, seeds: tuple[str, ...] = ()) -> tuple[list, bool]:
    """The runs of a page, None between blocks, and whether it has an article."""
    root, main = read(html)
    if seeds:
        tree = tree_of([root])
        stack = [tree]
        for name in host_tree(seeds).names(tree):
            t = stack.pop()
            for n in t.nodes:
                n.key = name
            stack += reversed(t.kids)
    out: list = [None]
    opened = False  # whether the last run may take more text

    def enter(node: Node, key: int, inside: bool, named: bool, held):
        nonlocal opened
        key = node.key if node.key is not None else below(key, node.label)
        named, inside, block = named or node.noise, inside or node in main, node.tag in BLOCK
        if block:
            held = None
            out.append(None)
        if held is None:
            opened = False
            if any(isinstance(k, str) and k.strip() for k in node.kids):
                held = key
        return iter(node.kids), key, inside, named, held, block

    frames = [enter(root, 0, False, False, None)]
    while frames:
        kids, key, inside, named, held, block = frames[-1]
        k = next(kids, None)
        if k is None:
            if block:
                out.append(None)
            if held is None or held == key:
                opened = False
            frames.pop()
        elif not isinstance(k, str):
            if not k.skipped():
                frames.append(enter(k, key, inside, named, held))
        else:
            last, at = out[-1], key if held is None else held
            if not opened or last is None or last.at != at or last.named != named:
                last = Run(at, inside, named)
                out.append(last)
                opened = True
            last.parts.append(k)
    for r in out:
        if r:
            r.text = " ".join("".join(r.parts).split())
    return out, bool(main)


def joined(page: list, keep) -> str:
    blocks, part = [], []
    for r in [*page, None]:
        if r is None:
            s = " ".join("".join(part).split())
            part = []
            if s:
                blocks.append(s)
        elif not r.text or keep(r):
            part += r.parts
    return "\n".join(blocks)


def by_names(page: list, main: bool) -> str:
    return joined(page, lambda r: not r.named and (r.inside or not main))


def evidence(html: str, seeds: tuple[str, ...]) -> tuple[int, list[int]] | None:
    """What a page says of its host: a hash of its main text by names, equal for copies, and
    its texts and places; None without a text."""
    page, main = runs(html, seeds)
    text = by_names(page, main)
    if not text:
        return None
    own = [r for r in page if r and r.text]
    return item(text), sorted({r.key() for r in own} | {r.place() for r in own if not r.inside})


def seeds_of(pages: list[str]) -> tuple[str, ...]:
    """The most frequent trees of a host's pages; ties go by the text of the tree."""
    counts = Counter(tree_text(h) for h in pages if h)
    return tuple(sorted(counts, key=lambda t: (-counts[t], t))[:SEEDS])


def template(pages: list[str]) -> tuple[list[int], tuple[str, ...]] | None:
    """Constant texts and known places of a host, and its seeds; None if its pages tell nothing."""
    seeds = seeds_of(pages)
    seen = dict(e for e in (evidence(h, seeds) for h in pages) if e)
    if len(seen) < 2:
        return None
    counts = Counter(k for keys in seen.values() for k in keys)
    return [k for k, c in counts.items() if c >= (INSIDE if k & 1 else OUTSIDE) and c >= SHARE * len(seen)], seeds


def extract(html: str, wrapper: tuple[list[int], tuple[str, ...]] | None = None) -> str:
    if wrapper is None:
        return by_names(*runs(html))
    known = frozenset(wrapper[0])
    page, main = runs(html, wrapper[1])
    return joined(page, lambda r: r.key() not in known and (r.inside or not main or r.place() in known))


def with_host(rows: DataFrame, hosts: DataFrame, size) -> DataFrame:
    """`rows` with the columns of `hosts`(host, ...): broadcast if their summed `size` is found
    small, else by salted rows."""
    if (hosts.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(hosts), "host", "left")
    salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    host = host_path(F.col("url"))[0]
    src = small_batches(pages).select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))

    def trees(batches):
        for b in batches:
            total = Counter((h, tree_text(x)) for h, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            cols = list(zip(*((h, t, n) for (h, t), n in total.items()))) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()))], ["host", "tree", "n"])

    def tell(batches):
        for b in batches:
            got = [(h, *e) for h, x, t in zip(b.column(0).to_pylist(), b.column(1), b.column(2)) if (e := evidence(x.as_py(), tuple(t.as_py() or ())))]
            cols = list(zip(*got)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.list_(pa.int64())))], ["host", "sig", "items"])

    full = src.filter("html <> ''").select("host", "html")
    built = full.mapInArrow(trees, "host string, tree string, n long").groupBy("host", "tree").agg(F.sum("n").alias("n"))
    built = built.withColumn("k", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "tree"))).filter(F.col("k") <= SEEDS)
    seeds = saved(built.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "tree"))), lambda x: x["tree"]).alias("seeds")))
    weight = F.aggregate("seeds", F.lit(0), lambda a, t: a + F.octet_length(t)) + F.octet_length("host")
    told = with_host(full, seeds, weight).select("host", "html", "seeds").mapInArrow(tell, "host string, sig long, items array<long>")
    # copies are one page: any of their rows, chosen by content so that runs repeat
    told = saved(told.groupBy("host", "sig").agg(F.max("items").alias("items")))
    n = told.groupBy("host").agg(F.count("*").alias("n")).filter("n > 1")
    counts = told.select("host", F.explode("items").alias("item")).groupBy("host", "item").agg(F.count("*").alias("c")).filter(F.col("c") >= OUTSIDE)
    least = F.greatest(F.when(F.col("item") % 2 == 0, OUTSIDE).otherwise(INSIDE), F.col("n") * SHARE)
    known = counts.join(n, "host").filter(F.col("c") >= least).groupBy("host").agg(F.sort_array(F.collect_list("item")).alias("wrapper"))
    wrappers = n.join(known, "host", "left").select("host", F.coalesce("wrapper", F.array().cast("array<long>")).alias("wrapper"))
    wrappers = saved(wrappers.join(seeds, "host"))
    both = with_host(src, wrappers, 8 * F.size("wrapper") + weight)

    def run(batches):
        for b in batches:
            texts = [extract(h.as_py(), None if w.as_py() is None else (w.as_py(), tuple(t.as_py()))) for h, w, t in zip(b.column(2), b.column(3), b.column(4))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return both.select("page_id", "url", "html", "wrapper", "seeds").mapInArrow(run, "page_id long, url string, text string, n_chars long")
