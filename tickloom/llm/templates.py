"""Main text of pages: templates of hosts by equivalence classes of tokens, and what fills their slots."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import byte_bounded
from tickloom.session import scratch_table

#: Share of a host's different pages that a token of its template is on; and how many pages at least.
SUPPORT, LEAST_PAGES = 0.5, 2
#: Pages that must share a text before it counts as part of the template and not as a quotation.
TEXT_PAGES = 3
#: Templates of all hosts up to this size go to all tasks; larger ones are joined to the pages by host.
BROADCAST_BYTES = 8 << 20

# Fixed values of the language: elements by how they are read.
_VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript iframe noembed noframes xmp".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
_CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split()
)
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select", "datalist")}
_CONTAINERS = set("article aside body center div dl footer form header html main nav section table tbody td tr".split())

# What an element that is not part of an article is, says or is called.
_ASIDE_TAGS = set("head nav aside footer form button select datalist dialog menu svg math canvas audio video object template".split()) | _RAW
_ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
_ASIDE_NAMES = set(
    """ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsors sponsored promo promos promotion promotions
    menu menus nav navi navbar navigation breadcrumb breadcrumbs sidebar sidebars rail widget widgets masthead topbar toolbar footer footers foot copyright
    cookie cookies consent gdpr notice notices disclaimer popup popups modal overlay newsletter subscribe subscription signup login search
    share sharing social comment comments commentary reply replies respond disqus discussion related recommended recommendations pagination pager""".split()
)
_HEADER_NAMES = {"header", "headers", "banner", "banners"}
_NOT_ITSELF = {"has", "with", "no", "without", "non"}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CALLED = re.compile(r"class|id|role", re.I)
_NAME_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


@dataclass(slots=True)
class Node:
    name: str
    parent: Node | None
    key: int  # stands for the names, classes and ids from the outermost element down to this one
    aside: bool  # not part of an article
    article: bool
    main: bool
    within: tuple[int, ...]  # keys of the elements around it that hold blocks


_TOP = Node("", None, 0, False, False, False, (0,))


@dataclass(slots=True)
class Run:
    node: Node
    block: int
    text: str
    place: int


@dataclass(slots=True)
class Page:
    tags: list[tuple[int, int]] = field(default_factory=list)  # (place, key) of each element
    runs: list[Run] = field(default_factory=list)


def _label(name: str, attributes: str) -> tuple[str, str, set[str]]:
    """``(label, role, parts of its class and id)`` of an element."""
    if "=" not in attributes:
        return name, "", set()
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    called = f"{found.get('class', '')} {found.get('id', '')}".split()
    parts = {p.lower() for x in called for p in _NAME_PART.findall(x)}
    # an id or class with a number is that of one page
    fixed = sorted(x for x in called if not any(c.isdigit() for c in x))
    return ".".join([name, *fixed]), found.get("role", "").lower(), parts


#: Elements that were met, by the element around them, name and attributes.
_met: dict[tuple[int, str, str], Node] = {}


def _open(parent: Node, name: str, attributes: str) -> Node:
    """The element as a node; nodes of equal paths are shared between pages."""
    if attributes and not _CALLED.search(attributes):
        attributes = ""
    key = (id(parent), name, attributes)
    node = _met.get(key)
    if node is None or node.parent is not parent:
        if len(_met) > 20_000:
            _met.clear()
        node = _met[key] = _made(parent, name, attributes)
    return node


def _made(parent: Node, name: str, attributes: str) -> Node:
    label, role, parts = _label(name, attributes)
    itself = name not in ("html", "body") and not parts & _NOT_ITSELF
    aside = parent.aside or name in _ASIDE_TAGS or role in _ASIDE_ROLES or (itself and bool(parts & _ASIDE_NAMES))
    if not parent.article:  # an article's own heading is part of it
        aside = aside or name == "header" or (itself and bool(parts & _HEADER_NAMES))
    key = xxhash.xxh64_intdigest(f"{parent.key}>{label}")
    within = (*parent.within, key) if name in _CONTAINERS else parent.within
    return Node(name, parent, key, aside, parent.article or name == "article", parent.main or name == "main" or role == "main", within)


def parsed(html: str) -> Page:
    """Elements and runs of text in page order. Takes anything: what is left open ends with what is around it, what is not a tag is text."""
    page = Page()
    stack = [_TOP]
    at = block = place = 0

    def text(upto: int) -> None:
        nonlocal place
        if at < upto:
            page.runs.append(Run(stack[-1], block, html[at:upto], place))
            place += 1

    start = 0
    while (m := _TOKEN.search(html, start)) is not None:
        text(m.start())
        at = start = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name not in _INLINE:
            block += 1
        if m["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    del stack[depth:]
                    break
                if name in _INLINE and stack[depth].name not in _INLINE:
                    break
            continue
        if name == "br":
            page.runs.append(Run(stack[-1], block, "\n", place))
            continue
        if name in _CLOSES_P or name in _SIBLINGS:
            _close_open_ones(stack, name)
        node = _open(stack[-1], name, m["attributes"])
        page.tags.append((place, node.key))
        place += 1
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = start = end.end() if end else len(html)
        elif name not in _VOID and not m["attributes"].endswith("/"):
            stack.append(node)
        elif name not in _VOID and name not in ("path", "circle", "rect", "line", "use", "polygon", "g"):
            stack.append(node)  # a slash means nothing outside of drawings
    text(len(html))
    return page


def _close_open_ones(stack: list[Node], name: str) -> None:
    """A new block ends an open paragraph; a new item ends the item before it."""
    ends = _SIBLINGS.get(name, ()) + (("p",) if name in _CLOSES_P else ())
    scope = _SCOPE.get(name, ())
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].name in ends:
            del stack[depth:]
        elif stack[depth].name in scope or (not scope and stack[depth].name not in _INLINE):
            return


def plain(text: str) -> str:
    """A run as it is read: character references decoded, white space as one space."""
    return " ".join((entities.unescape(text) if "&" in text else text).split())


def token(run: Run) -> int | None:
    """The token of a text: its path and wording."""
    words = plain(run.text)
    return xxhash.xxh64_intdigest(words.encode("utf-8", "surrogatepass"), run.node.key) if words else None


def tokens_of(page: Page) -> list[int]:
    """Tokens in page order: an element by its path, a text by its path and wording."""
    texts = [(r.place, key) for r in page.runs if (key := token(r)) is not None]
    return [key for _, key in sorted(page.tags + texts)]


def host_of(url_col: str):
    """The host of an address; none for a null address."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def equivalence_classes(pages: DataFrame) -> DataFrame:
    """``(host, number, pages, total, tokens)``: tokens of a host that occur equally often on each of its pages.

    Copies of a page are one page. A token's vector of occurrences is known by its number of pages, its occurrences and the sum (exclusive or) of a hash of each page with its count,
    so vectors are compared by partial aggregates and never gathered; a token must be on half of the host's pages, which bounds what a host has by twice the tokens of a page.
    """

    def run(batches):
        for batch in batches:
            prints, tokens, counts = [], [], []
            for html in batch.column(1).to_pylist():
                found = Counter(tokens_of(parsed(html)))
                prints.append(_signed(xxhash.xxh64_intdigest(html.encode("utf-8", "surrogatepass"))))
                tokens.append([_signed(x) for x in found])
                counts.append(list(found.values()))
            columns = [batch.column(0), pa.array(prints, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "page", "tokens", "counts"])

    found = pages.where("host <> ''").select("host", "html").mapInArrow(run, "host string, page long, tokens array<long>, counts array<int>")
    each = scratch_table(found.groupBy("host", "page").agg(F.first(F.struct("tokens", "counts")).alias("x")))
    sizes = each.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("all"))
    rows = each.select("host", "page", F.explode(F.arrays_zip("x.tokens", "x.counts")).alias("t")).select("host", "page", F.col("t.tokens").alias("token"), F.col("t.counts").alias("n"))
    vectors = rows.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("page", "n")).alias("print"))
    common = vectors.join(sizes, F.col("host") == F.col("h")).where(f"pages >= {LEAST_PAGES} AND pages >= {SUPPORT} * all")
    classes = common.groupBy("host", "pages", "total", "print").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    return classes.where(F.size("tokens") > 1).select("host", F.xxhash64("print", "pages", "total").alias("number"), "pages", "total", "tokens")


def _with_templates(pages: DataFrame, templates: DataFrame, column: str, run, schema: str) -> DataFrame:
    """``run(template of the host, batch)`` over pages: small templates are sent to all tasks, others are joined by host."""
    size = templates.agg(F.sum(F.length(column))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: r[column] for r in templates.select("host", column).collect()})

        def mapped(batches):
            for batch in batches:
                yield from run([sent.value.get(h) for h in batch.column(0).to_pylist()], batch)

        return pages.mapInArrow(mapped, schema)
    joined = pages.join(templates.select(F.col("host").alias("h"), F.col(column).alias("template")), F.col("host") == F.col("h"), "left").select(*pages.columns, "template")

    def own(batches):
        for batch in batches:
            yield from run(batch.column(batch.num_columns - 1).to_pylist(), batch)

    return joined.mapInArrow(own, schema)


def _packed(classes: DataFrame) -> DataFrame:
    """One text a host: its classes, the one on most pages first, as numbers."""
    own = F.concat_ws(" ", F.col("number").cast("string"), F.col("pages").cast("string"), F.col("total").cast("string"), F.array_join(F.transform("tokens", lambda x: x.cast("string")), " "))
    order = F.struct((F.col("total") != F.col("pages")).alias("often"), (-F.col("pages")).alias("p"), (-F.size("tokens")).alias("s"), "number", own.alias("text"))
    return classes.groupBy("host").agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["text"]), ";").alias("classes"))


class Classes:
    """The classes of a host; the first, on most pages and once on each, is the root of the template."""

    _cache: dict[str, Classes] = {}

    def __init__(self, packed: str):
        rows = [[int(x) for x in part.split(" ")] for part in packed.split(";")]
        self.numbers = [r[0] for r in rows]
        self.of = {token: k for k, r in enumerate(rows) for token in r[3:]}
        self.root = 0 if rows[0][1] == rows[0][2] else None

    @classmethod
    def read(cls, packed: str) -> Classes:
        if packed not in cls._cache:
            if len(cls._cache) > 256:
                cls._cache.clear()
            cls._cache[packed] = cls(packed)
        return cls._cache[packed]

    def order(self, tokens: list[int]) -> list[tuple[int, int, int]]:
        """``(class, order, slot)`` for each class on a page: a hash of the order of its tokens, which must be the same in each of its turns, else none, and the slot of the root that it lies in."""
        inside: dict[int, list[int]] = {}
        slots: dict[int, set[int]] = {}
        slot = 0
        for token in tokens:
            k = self.of.get(token)
            if k is None:
                continue
            if k == self.root:
                slot = token
            inside.setdefault(k, []).append(token)
            slots.setdefault(k, set()).add(slot)
        out = []
        for k, found in inside.items():
            turn = found[: next((i for i in range(1, len(found)) if found[i] == found[0]), len(found))]
            ordered = len(found) % len(turn) == 0 and found == turn * (len(found) // len(turn)) and len(set(turn)) == len(turn)
            nested = k == self.root or len(slots[k]) == 1
            where = 0 if k == self.root else min(slots[k])
            out.append((self.numbers[k], _signed(xxhash.xxh64_intdigest(np.array(turn, np.int64).tobytes())) if ordered and nested else 0, where))
        return out


def templates(pages: DataFrame) -> DataFrame:
    """``(host, template)``: the texts that belong to a host's template, and the element that holds what differs most.

    A class is valid if its tokens come in one order on all pages and lie in one slot of the root class; valid classes make the template. The text
    of no valid class fills the slots; the container with most of it holds the articles of hosts that do not mark them.
    """
    classes = scratch_table(equivalence_classes(pages))

    def run(packed, batch):
        rows: list[list] = [[], [], [], [], []]
        for html, host, classes in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), packed):
            if classes is None:
                continue
            known, page = Classes.read(classes), parsed(html)
            for number, order, slot in known.order([_signed(x) for x in tokens_of(page)]):
                for column, value in zip(rows, (host, number, order, slot, 0)):
                    column.append(value)
            mass: Counter = Counter()
            for r in page.runs:
                if not r.node.aside and (own := token(r)) is not None and _signed(own) not in known.of:
                    mass[_signed(r.node.within[-1])] += len(r.text)
            for container, length in mass.items():
                for column, value in zip(rows, (host, container, None, None, length)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), *(pa.array(x, pa.int64()) for x in rows[1:])], names=["host", "number", "order", "slot", "mass"])

    seen = _with_templates(pages.select("host", "html"), _packed(classes), "classes", run, "host string, number long, order long, slot long, mass long")
    told = seen.groupBy("host", "number", F.col("order").isNull().alias("held")).agg(
        F.min("order").alias("o1"), F.max("order").alias("o2"), F.min("slot").alias("s1"), F.max("slot").alias("s2"), F.sum("mass").alias("mass")
    )
    told = scratch_table(told)
    valid = told.where("NOT held AND o1 = o2 AND o1 <> 0 AND s1 = s2").select("host", "number")
    texts = classes.where(f"pages >= {TEXT_PAGES}").join(valid, ["host", "number"]).groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    held = told.where("held").groupBy("host").agg(F.max(F.struct("mass", "number")).alias("m")).select("host", F.col("m.number").cast("string").alias("main"))
    both = held.join(texts, "host", "left")
    tokens = F.coalesce(F.array_join(F.transform("tokens", lambda x: x.cast("string")), " "), F.lit(""))
    return both.select("host", F.concat_ws(" ", "main", tokens).alias("template"))


_templates: dict[str, tuple[int, frozenset[int]]] = {}


def _template(packed: str | None) -> tuple[int, frozenset[int]]:
    if packed is None:
        return 0, frozenset()
    if packed not in _templates:
        if len(_templates) > 256:
            _templates.clear()
        main, *tokens = packed.split()
        _templates[packed] = (int(main), frozenset(map(int, tokens)))
    return _templates[packed]


def main_text(html: str, main: int = 0, template: frozenset[int] = frozenset()) -> str:
    """The blocks of the article: in marked articles, else in the marked main part, else what fills the slots of the host's main container, else all that is not beside the article."""
    page = parsed(html)
    runs = [r for r in page.runs if not r.node.aside]
    inside = [r for r in runs if r.node.article]
    if not any(plain(r.text) for r in inside):
        inside = [r for r in runs if r.node.main]
    if not any(plain(r.text) for r in inside):
        runs = [r for r in runs if _signed(token(r) or 0) not in template]
        inside = [r for r in runs if main in map(_signed, r.node.within)] if main else []
        inside = inside if any(plain(r.text) for r in inside) else runs
    blocks: dict[int, str] = {}
    for r in inside:
        blocks[r.block] = blocks.get(r.block, "") + entities.unescape(r.text)
    return "\n\n".join(x for text in blocks.values() if (x := " ".join(text.split())))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text, n_chars)`` for each page: its main text, blocks joined by an empty line.

    Templates are deduced for each host from all its pages. Null pages are empty, and an empty page has an empty text; a page with a null or odd
    address has no host and is read alone, and so is the only page of a host. Rows that repeat stay rows; an empty table gives none; further columns are not read.
    """
    rows = byte_bounded(pages).select(
        host_of(url_col).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url")).alias("row")
    )
    found = scratch_table(templates(rows))

    def run(packed, batch):
        texts = [main_text(html, *_template(own)) for html, own in zip(batch.column(1).to_pylist(), packed)]
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(texts, pa.string())], names=["row", "text"])

    out = _with_templates(rows, found, "template", run, f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return out.select(F.col("row.id").alias(id_col), F.col("row.url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
