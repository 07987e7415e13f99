"""Main-text extraction with removal of site templates.

A page becomes a tree of elements of any depth (implied end tags, unclosed and crossed tags,
raw text and truncated markup are handled). The text comes from the page's articles, else its
main element, else its body.

Site templates: every element has a hash of its subtree (names, classes and text). Spark counts
the different main texts of each (host, hash); a subtree that recurs in at least MIN_PAGES of
them, and in SHARE of the host's, is a template and is deleted from all pages of the host.
Menus, headers, notices and all else outside the main text are counted with the rest, before
any rule of names. In an article only containers can be templates, never its own paragraphs
and headings, and nothing that holds half of the page's text or more. Counting main texts, not
pages, keeps copies of a page or an article whole, however many there are.

Rules of names complete this where a host has too few pages, and for what differs from page
to page: elements whose name, role, class or id says menu, header, footer, sidebar, notice,
advert, form, script, style or reader comment go too (``names=False`` leaves these rules out).

Two passes parse the pages: the first keeps only hashes, the second gives the text, so no
text is stored in between. Templates of a host are few, as each recurs in SHARE of its pages;
they travel to the pages by a broadcast of checked size, else by a join on the host that
deals the pages of large hosts evenly.

Edge cases: a null or empty html gives the empty text; a null url has the empty host;
repeated rows give a row each and count once; texts of any length and elements at any depth
are treated alike; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bound_batches, join_skewed, materialize, release_memory

#: A template recurs on so many pages of one host, with different main texts, and on this share of them.
MIN_PAGES, SHARE = 10, 0.02
#: Hashes of templates that a broadcast may hold.
BROADCAST_HASHES = 2_000_000

# Fixed values of HTML and of common class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea select title head".split())
TEXT_RAW = frozenset("script style textarea title iframe noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split()
)
CONTAINERS = frozenset("div section ul ol dl table figure details fieldset blockquote center".split())
DROPPED = frozenset("nav footer aside form script style noscript template iframe object svg math button select textarea dialog menu head title input".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices notification alert newsletter subscribe subscription popup modal overlay comment comments commentlist reply replies "
    "respond disqus share sharing social related recommended widget toolbar pagination pager login signup skip masthead".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
#: End tags that a start tag implies: name -> (names that it closes, names that hold it back).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|([^\s=/>"']+)""")
_WORD = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in TEXT_RAW}


class Node:
    __slots__ = ("name", "kinds", "parts", "parent", "dropped", "within", "has", "size", "full", "hash")

    def __init__(self, name: str, kinds: str, parent: Node | None, dropped: bool):
        self.name, self.kinds, self.parent, self.dropped = name, kinds, parent, dropped
        self.parts: list[str | Node] = []
        self.within = parent is not None and (parent.within or parent.name in ("article", "main"))
        self.has = False  # an article or main element that isn't dropped lies within
        self.size = self.full = self.hash = 0  # characters that aren't dropped, and all


def _marks(name: str, rest: str) -> tuple[str, bool]:
    """Class words of a start tag, and whether its names say that it isn't main text."""
    if not rest or rest.isspace():
        return "", name in DROPPED
    found = {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
    kinds = found.get("class", "") + " " + found.get("id", "")
    words = {w.lower() for w in _WORD.findall(kinds)}
    dropped = name in DROPPED or "hidden" in found or bool(words & DROPPED_WORDS) or found.get("role", "").lower() in DROPPED_ROLES
    return kinds.strip(), dropped and name not in ("html", "body", "main")


def parse(page: str) -> list[Node]:
    """All elements of a page in the order of their start tags; the first is the root of the tree."""
    root = now = Node("#root", "", None, False)
    nodes, at, opened = [root], 0, Counter()

    def leave(node: Node) -> None:
        """End all elements up to ``node``."""
        nonlocal now
        while now is not node:
            opened[now.name] -= 1
            now = now.parent
        opened[node.name] -= 1
        now = node.parent

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            now.parts.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if opened[name] > 0:
                node = now
                while node.name != name:
                    node = node.parent
                leave(node)
            continue
        if name in VOID:
            now.parts.append(Node("hr", "", now, False) if name == "hr" else " ")
            continue
        if name in BLOCK:
            closes, holds = CLOSES.get(name, ((), ()))
            if opened["p"] > 0 or any(opened[c] > 0 for c in closes):
                node, found = now, None
                while node is not root and node.name not in holds:
                    if node.name in closes or node.name == "p" and not closes:
                        found = node
                    elif node.name in BLOCK and not closes:
                        break
                    node = node.parent
                if found:
                    leave(found)
        kinds, dropped = _marks(name, m[3] or "")
        node = Node(name, kinds, now, dropped)
        nodes.append(node)
        now.parts.append(node)
        if name in TEXT_RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
        elif not (m[3] or "").endswith("/") or name in BLOCK:
            now = node
            opened[name] += 1
    if at < len(page):
        now.parts.append(page[at:])
    return nodes


def _measure(nodes: list[Node], names: bool) -> None:
    """Sizes and hashes of all subtrees, children first."""
    import xxhash

    for node in reversed(nodes):
        if not names:
            node.dropped = node.name in RAW
        own = node.name in ("article", "main")
        node.has, line = own, [node.name, node.kinds]
        for x in node.parts:
            if isinstance(x, str):
                words = " ".join(x.split())
                node.size += len(words)
                node.full += len(words)
                line.append(words)
            else:
                node.has |= x.has and not x.dropped
                node.full += x.full
                if not x.dropped:
                    node.size += x.size
                line.append(str(x.hash))
        node.hash = xxhash.xxh64_intdigest("\x1f".join(line).encode("utf-8", "replace")) - (1 << 63)
        if node.dropped and node.has and not own and not node.within and node.name not in DROPPED and not COMMENT_WORDS & {w.lower() for w in _WORD.findall(node.kinds)}:
            node.dropped = False  # a wrapper around the article, whatever its class


class Page:
    """The tree of a page, the elements that hold its main text, and which elements may be templates."""

    def __init__(self, html: str | None, names: bool = True):
        self.nodes = parse(html or "")
        _measure(self.nodes, names)
        self.roots = self._named("article") or self._named("main")
        self.inside = bool(self.roots)
        self.roots = self.roots or self.nodes[:1]
        self.half = sum(r.size for r in self.roots) / 2

    def _named(self, name: str) -> list[Node]:
        """Outermost elements of the name that aren't dropped."""
        out, stack = [], [self.nodes[0]]
        while stack:
            for x in stack.pop().parts:
                if isinstance(x, Node) and not x.dropped:
                    (out if x.name == name else stack).append(x)
        order = {id(n): i for i, n in enumerate(self.nodes)} if len(out) > 1 else {}
        return sorted(out, key=lambda n: order.get(id(n), 0))

    def may_go(self, x: Node) -> bool:
        """Whether the element could be a template: all blocks outside the main text, lesser parts of it."""
        if x.name not in BLOCK or x.name in RAW or not x.full or x.has:
            return False
        if self.inside:
            return not x.within or x.dropped or x.name in CONTAINERS and x.size < self.half
        return x.size < self.half or x.dropped

    def hashes(self) -> list[int]:
        """Distinct hashes of the elements that may be templates."""
        return list({x.hash for x in self.nodes[1:] if self.may_go(x)})

    def text(self, gone: set[int] = frozenset()) -> str:
        """Main text, one block a line, without the elements whose hash is in ``gone``."""
        out: list[str] = []
        run: list[str] = []

        def close() -> None:
            if line := " ".join(entities.unescape("".join(run)).split()):
                out.append(line)
            run.clear()

        for r in self.roots:
            stack = [iter(r.parts)]
            blocks = [True]
            while stack:
                x = next(stack[-1], None)
                if x is None:
                    stack.pop()
                    if blocks.pop():
                        close()
                elif isinstance(x, str):
                    run.append(x)
                elif x.dropped or x.name in RAW or x.name == "header" and not self.inside or x.hash in gone and self.may_go(x):
                    continue
                else:
                    if x.name in BLOCK:
                        close()
                    stack.append(iter(x.parts))
                    blocks.append(x.name in BLOCK)
        return "\n".join(out)


def host_key(url: Column) -> Column:
    """A number for the host of a url."""
    return F.xxhash64(F.lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))))


def page_hashes(pages: DataFrame, names: bool = True) -> DataFrame:
    """``(host, content, hashes)`` of every row of ``pages(url, html)``: hash of the main text, hashes that may be templates."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            contents, found = [], []
            for h in batch.column("html"):
                page = Page(h.as_py(), names)
                contents.append(xxhash.xxh64_intdigest(page.text().encode("utf-8", "replace")) - (1 << 63))
                found.append(page.hashes())
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(contents, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["host", "content", "hashes"])
        release_memory()

    return pages.select(host_key(F.col("url")).alias("host"), "html").mapInArrow(run, "host long, content long, hashes array<long>")


def templates(found: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """``(host, hash, pages)`` of the subtrees that recur in enough different main texts of their host."""
    texts = found.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_pages)
    each = found.select("host", "content", F.explode("hashes").alias("hash")).distinct()
    counted = each.groupBy("host", "hash").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    return counted.join(texts, "host").where(F.col("pages") >= share * F.col("texts")).select("host", "hash", "pages")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, names: bool = True, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages(page_id, url, html)``."""
    found = materialize(page_hashes(pages, names), "html-hashes")
    repeated = materialize(templates(found, min_pages, share), "html-templates")
    gone = repeated.groupBy("host").agg(F.collect_list("hash").alias("gone"))
    own = pages.select(F.col("page_id").cast("long"), "url", "html", host_key(F.col("url")).alias("host"))
    if repeated.limit(broadcast_hashes + 1).count() <= broadcast_hashes:
        met = own.join(F.broadcast(gone), "host", "left")
    else:
        sizes = found.groupBy("host").agg(F.count("*").alias("n"))
        met = join_skewed(own, gone.join(sizes, "host"), "host", found.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(h.as_py(), names).text(set(g.as_py() or ())) for h, g in zip(batch.column("html"), batch.column("gone"))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])
        release_memory()

    return met.select("page_id", "url", "html", "gone").mapInArrow(run, "page_id long, url string, text string, n_chars long")
