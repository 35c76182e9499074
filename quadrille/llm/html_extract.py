"""Main text of web pages: site templates go, the article stays.

Pages are parsed to element trees. Block elements are hashed as subtrees (tag, class and id, text,
children); Spark counts, per host, on how many different pages a subtree stands. Containers (div, section, lists ...), inside
the article too, are template parts if they stand on at least `min_pages` pages; other blocks, outside the article only,
if these are `min_share` of the host's pages as well. Template parts are deleted. Pages with the same article count once, so
a text that is mirrored doesn't become a template; for a container with over half of an article's text only the longest
other piece of text counts, so neither does the body of an article whose copies differ a little. Elements whose kind says that they aren't content (nav, footer, forms,
scripts, adverts, notices, comments ...) are deleted on every page; for a class, an id or as a form only if they hold neither the article nor <main> nor most of the text. What is left of <article> (if it holds the bulk
of <main>'s or the page's text), or else <main> or else <body> without articles that are teasers is the text: white space inside a block becomes one space, blocks are joined by a newline in page order.

Defined results: null and empty html give the empty text; a null url, or one without a host, belongs to the host ''; repeated
rows give repeated rows; malformed markup is read as far as it goes, and an unclosed comment or script ends with the page; an
empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, written

MIN_PAGES, MIN_SHARE = 8, 0.1
#: Template subtrees up to this number are broadcast (8 bytes each); more are joined to their pages.
BROADCAST_TEMPLATES = 2_000_000

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'](?=[^>]*>))*+)>|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
#: Fixed values of the HTML standard: elements without an end tag, and those whose content is text up to their end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption title".split())
#: Blocks that can be template parts inside an article.
CONTAINERS = frozenset("div section ul ol dl dir table figure details fieldset center".split())
#: Elements whose start ends an open one of these, up to the nearest of the others.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"})}
#: Elements, roles and words of class or id that say: not the article.
DROP = frozenset("head nav footer header aside form script style noscript template iframe button select textarea input object embed svg canvas dialog menu search title link meta audio video map noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Attribute words count as whole tokens; a compound one counts if all its pieces are WORDS or PLAIN ones.
WORDS = frozenset("ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion nav navbar navigation menu menubar sidebar aside footer header masthead topbar banner cookie cookies consent gdpr notice notices notification popup modal overlay comment comments commentlist respond replies reply discussion disqus share sharing social related recommended recommendations subscribe subscription newsletter signup login search searchbox breadcrumb breadcrumbs pagination pager widget widgets toolbar skip copyright legal tags".split())
PLAIN = frozenset("site box bar list block container wrapper wrap area section panel form posts links link buttons button icons icon text message inner outer item items title top bottom left right main".split())
NO_ARTICLE = frozenset("comment comments reply ad advert sponsored promo related".split())
#: An element dropped for its class, id or as a form stays if it holds more than this share of the text; threads of comments often hold most.
MOST, MOST_THREAD = 0.5, 0.9
THREADS = frozenset("comment comments commentlist respond replies reply discussion disqus".split())
#: Words of an article's class or id that make it a teaser of another page.
TEASERS = frozenset("card cards teaser teasers tile preview promo related recommended".split())
_KEPT = frozenset(("html", "body", "article", "main"))
#: Elements of the text itself: their ids are often made of their words, so only a class that is an advert's whole word says anything against them.
SAID = frozenset("h1 h2 h3 h4 h5 h6 hgroup p blockquote pre code em strong b i a dt dd th td tr caption figcaption".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsored promo".split())


def _said(names: str, words: frozenset) -> frozenset:
    """The `words` that the tokens of a class or id stand for."""
    found = set()
    for token in names.split():
        if token.lower() in words:
            found.add(token.lower())
            continue
        pieces = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower())) - {""}
        if pieces <= words | PLAIN:
            found |= pieces & words
    return frozenset(found)


class Node:
    __slots__ = ("tag", "mark", "children", "drop", "article", "most", "teaser")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.mark, self.children = tag, "", []
        self.drop, self.article, self.teaser = tag in DROP, tag == "article", False
        self.most = MOST if tag == "form" else 0.0  # share of the text above which it isn't dropped after all; 0: always dropped
        if attributes and "=" in attributes or "hidden" in attributes:
            got = {}
            for m in _ATTRIBUTE.finditer(attributes):
                got.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
            self.mark = f"{got.get('class', '')}|{got.get('id', '')}|{got.get('role', '')}".lower()
            names = f"{got.get('class', '')} {got.get('id', '')}"
            words = ADVERTS & set(got.get("class", "").lower().split()) if tag in SAID else _said(names, WORDS) if tag not in _KEPT else _said(names, NO_ARTICLE) if tag == "article" else ()
            if "hidden" in got or got.get("aria-hidden") == "true" or got.get("role", "").lower() in ROLES - {"form"}:
                self.drop, self.most = True, 0.0
            elif (words or got.get("role", "").lower() == "form") and not self.drop:
                self.drop, self.most = True, MOST_THREAD if words and words <= THREADS else MOST
            if got.get("role", "").lower() == "article":
                self.article = True
            self.teaser = self.article and bool(_said(names, TEASERS))


def parse(page: str) -> Node:
    """A tree of Nodes and strings (decoded text)."""
    root = Node("#root")
    stack, at, end = [root], 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                stack[-1].children.append(entities.unescape(text))
            continue
        name = name.lower()
        if m[1]:
            _close(stack, name)
            continue
        if name in ENDS:
            ended, scope = ENDS[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    del stack[i:]
                    break
                if stack[i].tag in scope:
                    break
        elif name in BLOCKS and name not in ("option", "caption", "legend"):
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        node = Node(name, m[3])
        stack[-1].children.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if close is None:
                break
            if name in ("title", "textarea"):
                node.children.append(entities.unescape(page[at : close.start()]))
            at = close.start()
            stack.append(node)
        elif name not in VOID and not m[3].endswith("/"):
            stack.append(node)
        elif name not in VOID and name in BLOCKS:
            stack.append(node)  # the slash of a self-closing tag counts for nothing in HTML
    return root


def _close(stack: list[Node], name: str) -> None:
    """Ends the nearest open element of that name; the end tag of an inline element doesn't reach beyond its block."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == name:
            del stack[i:]
            return
        if name not in BLOCKS and stack[i].tag in BLOCKS or stack[i].tag == "table" and name not in ("table", "div", "section", "article", "main", "body", "html"):
            return


def _walk(root: Node) -> list[tuple[Node, int]]:
    """Nodes in page order with the index of their parent's line; no recursion, for deep pages."""
    out, todo = [], [(root, -1)]
    while todo:
        node, parent = todo.pop()
        at = len(out)
        out.append((node, parent))
        todo += [(c, at) for c in reversed(node.children) if isinstance(c, Node)]
    return out


def _sizes(lines: list[tuple[Node, int]], dropped) -> list[int]:
    """Characters of text in each subtree, without the dropped ones."""
    out = [0 if dropped(node) else sum(len(c.strip()) for c in node.children if isinstance(c, str)) for node, _ in lines]
    for at in range(len(lines) - 1, 0, -1):
        if not dropped(lines[at][0]):
            out[lines[at][1]] += out[at]
    return [0 if dropped(node) else n for (node, _), n in zip(lines, out)]


def _lift(lines: list[tuple[Node, int]]) -> None:
    """Takes back the drop of elements that go for class, id or as a form, but hold the article, <main> or most of the text."""
    soft = [at for at, (node, _) in enumerate(lines) if node.drop and node.most]
    if not soft:
        return
    hard, under, kinds, free = set(), set(), [], []
    for at, (node, parent) in enumerate(lines):
        if parent in hard or node.drop and not node.most:
            hard.add(at)
        elif parent in under or node.drop:
            under.add(at)
        if at not in hard and not node.drop and (node.article and not node.teaser or node.tag == "main"):
            kinds.append(at)
            if at not in under:
                free.append(at)
    holds = set()
    for at in kinds:
        if lines[at][0].tag == "main" or not free:
            while at >= 0 and at not in holds:
                holds.add(at)
                at = lines[at][1]
    sizes, inside = _sizes(lines, lambda n: n.drop and not n.most), {}
    for at, (_, parent) in enumerate(lines):  # beside a free article only what lies in it matters
        if parent in inside:
            inside[at] = inside[parent]
        elif at in free or not free and at == 0:
            inside[at] = sizes[at]
    for at in soft:
        node = lines[at][0]
        total = inside.get(at, 0)
        if at not in hard and (at in holds or total and sizes[at] > node.most * total):
            node.drop = False


def _outermost(lines: list[tuple[Node, int]], wanted) -> list[int]:
    """Lines of the wanted elements that lie neither in dropped ones nor in each other."""
    gone, found = set(), []
    for at, (node, parent) in enumerate(lines):
        if parent in gone or node.drop:
            gone.add(at)
        elif wanted(node):
            found.append(at)
            gone.add(at)
    return found


def _content(root: Node) -> list[Node]:
    """The elements that hold the text: the articles if they hold the bulk of it, else <main> or else the page without its
    teaser articles (which are marked as dropped). Nothing stands for the whole page."""
    lines = _walk(root)
    _lift(lines)
    articles = _outermost(lines, lambda n: n.article)
    mains = _outermost(lines, lambda n: n.tag == "main")
    if not articles:
        return [lines[at][0] for at in mains]
    sizes, under = _sizes(lines, lambda n: n.drop), set(mains)
    linked = _sizes(lines, lambda n: n.drop or n.tag == "a")
    for at, (_, parent) in enumerate(lines):
        if parent in under:
            under.add(at)
    teaser = {at for at in articles if lines[at][0].teaser or 2 * linked[at] < sizes[at]}
    scope, within = mains, [at for at in articles if at in under]
    if not sum(sizes[at] for at in mains) or max((sizes[at] for at in articles if at not in under and at not in teaser), default=0) > sum(sizes[at] for at in mains):
        scope, within = [0], articles  # articles that hold <main>, or are longer than it, stand beside or around it
    rest = sum(sizes[at] for at in scope) - sum(sizes[at] for at in within)
    plain, marked = [at for at in within if at not in teaser], [at for at in within if at in teaser]
    held, largest = sum(sizes[at] for at in plain), max((sizes[at] for at in plain), default=0)
    if plain and held >= rest and (len(plain) == 1 or largest >= rest):
        return [lines[at][0] for at in plain]
    if not rest or not plain and rest < max((sizes[at] for at in marked), default=0):
        return [lines[at][0] for at in within or scope]  # a list of articles
    # beside a longer text, several shorter articles are teasers too, unless they hold more together; a single one may be the story
    for at in marked + (plain if len(plain) > 1 and held < rest else []):
        lines[at][0].drop = True
    return [] if scope == [0] else [lines[at][0] for at in scope]


def subtree_hashes(root: Node) -> dict[int, int]:
    """Hash of every block element with text, by id of the node."""
    lines = _walk(root)
    feeds: list[list[str]] = [[] for _ in lines]
    place = {id(node): at for at, (node, _) in enumerate(lines)}
    out = {}
    for at in range(len(lines) - 1, -1, -1):
        node = lines[at][0]
        said = "\0".join(c.strip() if isinstance(c, str) else feeds[place[id(c)]][0] for c in node.children)
        value = xxhash.xxh3_64_intdigest(f"{node.tag}\1{node.mark}\1{said}")
        feeds[at].append(f"\2{value:x}")
        if node.tag in BLOCKS and said.strip("\0"):
            out[id(node)] = value
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _key(host: str, subtree: int, container: bool) -> int:
    """Odd for containers, even for other blocks; 0 is left to the page itself."""
    return (xxhash.xxh3_64_intdigest(f"{host}\0{subtree:x}") - 2**63 | 1) - (0 if container else 1) or 2


def _parts(root: Node, content: list[Node], digest: int) -> Iterator[tuple[Node, int, bool, int]]:
    """Block elements that may be template parts: those that neither are, hold nor lie in the main content, and containers
    in it; with their hashes, whether they're containers, and the digest of the page to count them by (the page's own, if there's no content)."""
    lines, hashes = _walk(root), subtree_hashes(root)
    kept, inside, holds = {id(n) for n in content}, set(), set()
    for at, (node, parent) in enumerate(lines):
        if parent in inside or id(node) in kept:
            inside.add(at)
            while id(node) in kept and parent >= 0 and parent not in holds:
                holds.add(parent)
                parent = lines[parent][1]
    if content:
        digest = xxhash.xxh3_64_intdigest("\0".join(f"{hashes.get(id(n), 0):x}" for n in content)) - 2**63
    others = None
    for at, (node, _) in enumerate(lines):
        if at in holds or id(node) in kept or id(node) not in hashes or node.tag in ("html", "body"):
            continue
        container = node.tag in CONTAINERS
        if at not in inside:
            yield node, hashes[id(node)], container, digest
        elif container:
            others = others or _Others(lines, inside)
            yield node, hashes[id(node)], True, others.longest(at) if others.most(at) else digest


class _Others:
    """Text of the lines `inside`, and the longest piece of it outside a subtree."""

    def __init__(self, lines: list[tuple[Node, int]], inside: set[int]):
        n = len(lines)
        self.sizes, self.ends = [0] * n, list(range(1, n + 1))
        best = [""] * n
        for at in range(n - 1, -1, -1):
            node, parent = lines[at]
            if at in inside and not node.drop:
                said = [c.strip() for c in node.children if isinstance(c, str)]
                best[at] = max(said, key=len, default="")
                self.sizes[at] += sum(map(len, said))
            elif node.drop:
                self.sizes[at] = 0
            if parent >= 0:
                self.sizes[parent] += self.sizes[at]
                self.ends[parent] = max(self.ends[parent], self.ends[at])
        longer = lambda a, b: b if len(b) > len(a) else a
        self.before = list(accumulate(best, longer, initial=""))
        self.after = list(accumulate(reversed(best), longer, initial=""))[::-1]

    def most(self, at: int) -> bool:
        return 2 * self.sizes[at] > self.sizes[0]

    def longest(self, at: int) -> int:
        return xxhash.xxh3_64_intdigest(max(self.before[at], self.after[self.ends[at]], key=len)) - 2**63


def extract(page: str | None, host: str = "", template=()) -> str:
    """Text of the page, without the subtrees whose keys are in `template`."""
    if not page:
        return ""
    root = parse(page)
    content = _content(root)
    gone = {id(node) for node, h, container, _ in _parts(root, content, 0) if _key(host, h, container) in template} if template else set()
    blocks: list[list[str]] = [[]]
    todo: list = list(reversed(content or [root]))
    first = {id(n) for n in todo}
    while todo:
        x = todo.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif id(x) in first or not x.drop and id(x) not in gone:
            if x.tag in BLOCKS or x.tag == "#root":
                blocks.append([])
                todo.append(None)
            elif x.tag == "br":
                blocks[-1].append(" ")
            todo += reversed(x.children)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def template_keys(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """key (of host and subtree) of all template parts, from columns page_id, url, html."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            hosts, keys, digests = [], [], []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not page:
                    continue
                host, digest = host_of(url), xxhash.xxh3_64_intdigest(page) - 2**63
                own = xxhash.xxh3_64_intdigest(host) - 2**63
                root = parse(page)
                for key, at in {(0, digest), *((_key(host, h, c), d) for _, h, c, d in _parts(root, _content(root), digest))}:
                    hosts.append(own)
                    keys.append(key)
                    digests.append(at)
            return pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(keys, pa.int64()), pa.array(digests, pa.int64())], ["host", "key", "digest"])

        return each

    seen = map_slices(pages, make, "host long, key long, digest long", 128).distinct()
    counts = seen.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    often = written(counts.filter((F.col("n") >= min_pages) | (F.col("key") == 0)))  # read twice below, but pages are parsed once for it
    totals = often.filter("key = 0").select("host", F.col("n").alias("pages"))
    return often.filter("key <> 0").join(totals, "host").filter((F.col("n") >= min_pages) & ((F.col("key") % 2 != 0) | (F.col("n") >= min_share * F.col("pages")))).select("key", "host")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text of every row."""
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    keys = written(template_keys(rows, min_pages, min_share))
    n = keys.count()
    schema = "page_id long, url string, text string"

    def texts(batch: pa.RecordBatch, template) -> pa.RecordBatch:
        out = [extract(page, host_of(url), template) for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    if n <= BROADCAST_TEMPLATES:
        found = spark_broadcast(rows, frozenset(r.key for r in keys.select("key").toLocalIterator()) if n else frozenset())
        return map_slices(rows, lambda: lambda batch: texts(batch, found.value), schema, 128)

    # too many for a broadcast: pages ask for the keys they hold, and get back those that are templates
    def asks():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            digests, wanted = [], []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if page:
                    digest = _page_key(url, page)
                    root = parse(page)
                    for key in {_key(host_of(url), h, c) for _, h, c, _ in _parts(root, _content(root), 0)}:
                        digests.append(digest)
                        wanted.append(key)
            return pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), pa.array(wanted, pa.int64())], ["page", "key"])

        return each

    held = map_slices(rows, asks, "page long, key long", 128).distinct().join(keys.select("key").distinct(), "key").groupBy("page").agg(F.collect_list("key").alias("keys"))

    def with_page():
        return lambda batch: pa.RecordBatch.from_arrays([*batch.columns, pa.array([_page_key(u, p) for u, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.int64())], ["page_id", "url", "html", "page"])

    joined = map_slices(rows, with_page, "page_id long, url string, html string, page long", 128).join(held, "page", "left").select("page_id", "url", "html", "keys")

    def finish():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [extract(page, host_of(url), frozenset(ks or ())) for url, page, ks in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

        return each

    return map_slices(joined, finish, schema, 128)


def _page_key(url: str | None, page: str | None) -> int:
    return xxhash.xxh3_64_intdigest(f"{url}\0{page}") - 2**63


def spark_broadcast(frame: DataFrame, value):
    return frame.sparkSession.sparkContext.broadcast(value)  # at most BROADCAST_TEMPLATES numbers
