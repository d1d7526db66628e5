"""Main text of web pages, by templates deduced from the pages of a host.

A token is an element's path (tags with ids and classes) or a text block at its path.
Tokens that occur equally often in each page of a host form an equivalence class; it
is valid if its tokens stand in one order everywhere. Valid classes nest by their
paths into the host's template. Text of the template is boilerplate if
pages of several contents have it and its element's path holds no other text anywhere
at the host; other text fills a slot, even if copies of a page share it.

The slots of the template are its elements that stand once in each page and group
others. Those with more than half of the host's text, whatever it is, nest in each other;
the innermost holds the article, and the main slot is it or the outermost article or main
element around it. A slot with a name of its own inside the main one that isn't one of these,
stands behind the better part of the article and has less than a third of its text is
another record (readers' comments, an author's box) and goes, whatever it is called.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style textarea title noscript template iframe object svg math select button canvas audio video".split())
DROPPED = frozenset("head nav footer aside form menu dialog fieldset".split())
MAIN = frozenset(("article", "main"))
GROUPS = frozenset("article body center div dl main ol section table tbody td tr ul".split())
CLOSED_BY = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section div body main".split())
NOT_IN_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words in an id, class or role that mark what isn't the article.
ROLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|sidebar|side|menu|nav\w*|breadcrumbs?|comments?|comment-?list|disqus|replies|respond|share\w*|social"
    r"|related|recommend\w*|newsletter|subscribe|signup|popup|modal|overlay|footer|masthead|site-header|widget|toolbar|pagination|search|login)(?:$|[\s_-])",
    re.I,
)
#: Fixed value: HTML's tag syntax. A quote permutes the states (outside, in double, in single quotes)
#: of tags tried from different places, and < outside ends a try; so three overlap at most and reading
#: takes time in proportion to the page, however long a tag or value is.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
#: What counts inside an article: a class whose parts are all such words, or words for a kind of box.
_ROLE_WORD = (
    r"(?:ads?|advert\w*?|sponsor\w*?|promos?|promotions?|banner|cookies?|consent|gdpr|notices?|alert|sidebar|menu|nav|navigation|breadcrumbs?|comments?|disqus|replies|respond|share|sharing|social"
    r"|related|recommend(?:ed|ations?)|newsletter|subscribe|signup|popup|modal|overlay|footer|masthead|widget|toolbar|pagination|search|login)"
)
_BOX_WORD = r"(?:bar|box|list|links?|buttons?|icons?|block|section|area|container|wrap|wrapper|panel|form|thread|unit|slot|tools?|posts?|articles?|stories|items?|[0-9]+)"
ROLE_ALONE = re.compile(rf"(?:{_BOX_WORD}[_-]+)*{_ROLE_WORD}(?:[_-]+(?:{_ROLE_WORD}|{_BOX_WORD}))*", re.I)
#: Of elements within a line only adverts go by their class.
ADVERT = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promos?)(?:[_-]+\w+)*", re.I)
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
#: Other attributes' quoted values are passed over; what they hold marks nothing.
MARKS = re.compile(r"(?:^|\s)(id|class|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*+\"|'[^']*+'", re.I)

#: Token of the page itself.
ROOT = 0


def token(parent: int, name: str) -> int:
    """Token of an element or of a text (after a line end) within the element of a token."""
    return xxhash.xxh64_intdigest(name.encode("utf-8", "replace"), seed=parent & ((1 << 64) - 1)) - (1 << 63)


#: Tags that a later one may close by itself.
CLOSABLE = frozenset(x for tags in CLOSED_BY.values() for x in tags)


class Open:
    """The open elements, innermost last, and where those stand that end a search or are closed by others."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.held: dict[str, int] = {}
        self.places: dict[str, list[int]] = {tag: [] for tag in CLOSABLE}
        self.scopes: list[int] = []

    def push(self, tag: str, element: int) -> None:
        if tag in CLOSABLE:
            self.places[tag].append(len(self.stack))
        elif tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, element))
        self.held[tag] = self.held.get(tag, 0) + 1

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        self.held[tag] -= 1
        if tag in CLOSABLE:
            self.places[tag].pop()
        elif tag in SCOPE:
            self.scopes.pop()
        return tag

    def close(self, tag: str) -> None:
        """Close the innermost element of a tag and what is open in it; nothing if there is none."""
        if self.held.get(tag):
            while self.pop() != tag:
                pass

    def give_way(self, tags: tuple[str, ...]) -> None:
        """Close the innermost element of one of the tags, unless an element that ends the search stands within it."""
        last = max((self.places[t][-1] for t in tags if self.places[t]), default=0)
        if last > (self.scopes[-1] if self.scopes else 0):
            while len(self.stack) > last:
                self.pop()


def _unseen(attributes: str) -> bool:
    """Is an element within a line hidden, or an advert?"""
    for m in MARKS.finditer(attributes):
        key, value = (m.group(1) or "").lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if key == "hidden" or key == "style" and UNSEEN.search(value) or key in ("id", "class") and any(map(ADVERT.fullmatch, value.split())):
            return True
    return False


class Page:
    """Elements (token of the path, depth, parent, dropped, main) and text blocks of one page, in page order."""

    def __init__(self, source: str):
        self.key, self.depth, self.parent, self.out, self.main, self.group = [ROOT], [0], [-1], [False], [False], [0]
        self.blocks: list[tuple[int, str]] = []  # element, text
        self._read(source)

    def _read(self, source: str) -> None:
        opened, buffer, at = Open(), [], 0
        # An unseen element within a line: its tag, how many of that tag are open, and how many elements were when it began.
        unseen, deep, below = "", 0, 0

        def flush() -> None:
            if buffer:
                text = " ".join("".join(buffer).split())
                if text:
                    self.blocks.append((opened.stack[-1][1], text))
                buffer.clear()

        def said(text: str) -> None:
            if not unseen:
                buffer.append(entities.unescape(text))  # a reference ends where a tag begins

        find, end = TOKEN.search, len(source)
        while at < end:
            m = find(source, at)
            if m is None:
                said(source[at:])
                break
            if m.start() > at:
                said(source[at : m.start()])
            at = m.end()
            close, tag, attributes = m.group(1), m.group(2), m.group(3)
            if tag is None:
                continue
            tag = tag.lower()
            if tag in INLINE:
                if unseen:
                    if tag == unseen and not attributes.endswith("/"):
                        deep += -1 if close else 1
                        unseen = unseen if deep else ""
                elif attributes and not close and not attributes.endswith("/") and _unseen(attributes):
                    unseen, deep, below = tag, 1, len(opened.stack)
                continue
            if tag in VOID:
                if tag == "br":
                    buffer.append(" ")
                elif tag == "hr":
                    flush()
                continue
            if tag in RAW:
                if close:
                    continue
                buffer.append(" ")
                if not attributes.rstrip().endswith("/"):
                    stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                    at = stop.end() if stop else end
                continue
            flush()
            if close:
                opened.close(tag)
            else:
                closed = CLOSED_BY.get(tag, ())
                if tag in NOT_IN_P:
                    closed = (*closed, "p")
                if closed:
                    opened.give_way(closed)
                if len(opened.stack) < below:
                    unseen, below = "", 0
                opened.push(tag, self._element(tag, attributes, opened.stack[-1][1], bool(unseen)))
                if attributes.endswith("/") and tag not in ("p", "div"):
                    opened.pop()
            if len(opened.stack) < below:  # what held the unseen element is closed
                unseen, below = "", 0
        flush()

    def _element(self, tag: str, attributes: str, parent: int, hidden: bool = False) -> int:
        name, marks, body = tag, [], False
        if attributes:
            for m in MARKS.finditer(attributes):
                if m.group(1) is None:
                    continue
                key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
                if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and UNSEEN.search(value):
                    hidden = True
                elif key == "style":
                    continue
                elif key == "itemprop" or key == "role":
                    body |= value.lower() in ("articlebody", "main")
                    if key == "role":
                        marks.append(value)
                else:
                    marks.append(value)
                    name += ("#" if key == "id" else ".") + re.sub(r"\d+", "0", ".".join(value.split()))
        # Within an article a word in a name is no proof, a name that says no more is.
        named = (lambda x: any(map(ROLE_ALONE.fullmatch, x.split()))) if self.main[parent] else ROLE.search
        role = bool(marks) and any(map(named, marks)) and tag not in ("html", "body", *MAIN)
        main = self.main[parent] or tag in MAIN or body
        out = self.out[parent] or hidden or role or tag in DROPPED or tag == "header" and not main
        self.key.append(token(self.key[parent], name))
        self.depth.append(self.depth[parent] + 1)
        self.parent.append(parent)
        self.out.append(out)
        self.main.append(main)
        self.group.append((tag in GROUPS) + (tag in GROUPS and name != tag))
        return len(self.key) - 1

    def content(self) -> int:
        """Hash of the blocks that aren't dropped."""
        return token(ROOT, "\n".join(text for e, text in self.blocks if not self.out[e]))

    def tokens(self) -> Iterator[tuple[int, int, bool, int, int, int, int, int]]:
        """(token, depth, in a main element, characters below it, characters before it, own text blocks, token of
        the element it stands in, 1 if it groups others and 2 if it also has a name) for each element in page
        order, then for each text block, with a depth of -1."""
        chars, before, own = [0] * len(self.key), [0] * len(self.key), [0] * len(self.key)
        last = at = 0
        for e, text in self.blocks:
            for x in range(last + 1, e + 1):  # opened since the block before
                before[x] = at
            last = max(last, e)
            own[e] += 1
            chars[e] += len(text)
            at += len(text)
        before[last + 1 :] = [at] * (len(before) - last - 1)
        for e in range(len(chars) - 1, 0, -1):
            chars[self.parent[e]] += chars[e]
        within = [ROOT, *(self.key[p] for p in self.parent[1:])]
        yield from zip(self.key, self.depth, self.main, chars, before, own, within, self.group, strict=True)
        for e, text in self.blocks:
            yield token(self.key[e], "\n" + text), -1, self.main[e], 0, 0, 1, self.key[e], 0

    def text(self, slot: int | None, boilerplate: frozenset[int], others: frozenset[int] = frozenset()) -> str:
        """Kept blocks of the main slot but for ``others`` in it; of the page's own main elements, or else all of it,
        without one."""
        inside, gone = [False] * len(self.key), self.out[:]
        for e in range(1, len(self.key)):
            inside[e] = inside[self.parent[e]] or self.key[e] == slot
            gone[e] = gone[e] or gone[self.parent[e]] or self.key[e] in others
        if not any(inside):
            inside = self.main if any(self.main) else [True] * len(self.key)
        return "\n".join(text for e, text in self.blocks if inside[e] and not gone[e] and token(self.key[e], "\n" + text) not in boilerplate)


def host(url: Column) -> Column:
    """Lower-case host of a URL; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


#: A class must be met in so many pages, and in this share of its host's pages, to be template.
LEAST_PAGES, LEAST_SHARE = 2, 0.5
#: Share of a host's text that the main slot holds more than, share of the main slot's text that another record
#: in it holds less than, and share that stands before such a record.
MAIN_SHARE, OTHER_SHARE, BEFORE_SHARE = 0.5, 1 / 3, 0.5
#: Templates are broadcast up to so many tokens; else joined to the pages by host.
BROADCAST_TOKENS = 200_000


def _pages(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    source = common.text_or_empty(df, html_col)
    url = common.column(df, url_col).cast("string")
    return df.select(common.column(df, id_col).alias("id"), url.alias("url"), source.alias("html"), F.xxhash64(host(url)).alias("host"), F.xxhash64(common.column(df, id_col), source).alias("page"))


_TOKENS = "host long, page long, token long, depth int, main boolean, n long, chars long, before long, own long, element long, group int, content long"
_TOKEN_NAMES = [x.split()[0] for x in _TOKENS.split(", ")]
_TOKEN_TYPES = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[x.split()[1]] for x in _TOKENS.split(", ")]


def templates(pages: DataFrame) -> DataFrame:
    """host, slot (token of the main slot, or null), boilerplate (tokens of template text), others (tokens of
    other records in the main slot).

    Vectors of occurrences are sums of hashes of (page, count), so no page's tokens and no
    host's pages are brought together, and a page that is there twice counts twice in all
    of its tokens; the tokens of one class are, which are no more than one page has.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 2):
                rows = []
                for h, p, source in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    seen: dict[int, list] = {}
                    read = Page(source)
                    content = read.content()
                    for t, depth, main, chars, before, own, element, group in read.tokens():
                        if (x := seen.get(t)) is None:
                            seen[t] = [h, p, t, depth, main, 1, chars, before, own, element, group, content]
                        else:
                            x[5] += 1
                            x[6] += chars
                            x[8] += own
                    rows += seen.values()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _TOKEN_TYPES, strict=True)], names=_TOKEN_NAMES)

    counted = pages.select("host", "page", "html").mapInArrow(count, _TOKENS)
    sign = F.xxhash64("page", "n")  # its halves are summed apart, so that no sum overflows
    vectors = counted.groupBy("host", "token").agg(
        F.max("depth").alias("depth"), F.max("main").alias("main"), F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("before").alias("before"),
        F.sum(sign.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(sign, 32)).alias("high"), F.max("n").alias("most"),
        F.sum("own").alias("own"), F.max("element").alias("element"), F.max("group").alias("group"), (F.min("content") < F.max("content")).alias("differ"),
        F.min("content").alias("least"), F.max("content").alias("last"), F.sum(F.col("content").cast("decimal(20,0)")).alias("total"),
    ).withColumn("vector", F.xxhash64("low", "high")).drop("low", "high")
    # Of two contents alone, the sum exceeds so many times the lesser by a multiple of what they differ in.
    rest = F.expr("(total - cast(pages as decimal(20,0)) * cast(least as decimal(20,0))) % (cast(last as decimal(20,0)) - cast(least as decimal(20,0)))")
    vectors = vectors.withColumn("three", F.when(F.col("differ"), rest != 0).otherwise(False)).drop("least", "last", "total")
    spark = pages.sparkSession
    vectors = common.written(vectors.where(F.col("pages") >= LEAST_PAGES), f"{common.scratch(spark)}/vectors")
    root = F.lit(ROOT)
    hosts = vectors.where(F.col("token") == root).select("host", F.col("pages").alias("all_pages"), F.col("chars").alias("all_chars"))
    often = vectors.join(hosts, "host").where(F.col("pages") >= LEAST_SHARE * F.col("all_pages"))
    members = often.drop("pages", "all_pages")
    valid = _valid(pages, members)
    kept = members.join(valid, ["host", "vector"], "left_semi")
    # Text of several contents' pages, in elements that hold no other.
    shared = kept.where((F.col("depth") < 0) & F.col("differ")).groupBy("host", "element").agg(F.sum("own").alias("shared"))
    constant = vectors.where("depth >= 0").select("host", F.col("token").alias("element"), F.col("own").alias("blocks")).join(shared, ["host", "element"]).where("shared = blocks")
    kept = kept.join(constant.select("host", "element", F.lit(True).alias("constant")), ["host", "element"], "left")
    # Near copies share a title: in an article, text is the template's if three contents have it.
    text = F.when((F.col("depth") < 0) & F.col("differ") & F.col("constant") & (~F.col("main") | F.col("three")), F.col("token"))
    # Slots with most of the text nest in each other; of these, the innermost or the outermost main one.
    slot = (F.col("group") > 0) & (F.col("most") == 1)
    wide = slot & (F.col("chars") > MAIN_SHARE * F.col("all_chars"))
    order = F.struct("main", F.when(F.col("main"), -F.col("depth")).otherwise(F.col("depth")).alias("rank"), "token", "depth", "chars", "before")
    found = kept.groupBy("host").agg(F.max(F.when(wide, order)).alias("s"), F.collect_list(text).alias("boilerplate"))
    # Named slots directly within one of the nest, at or below the main one.
    inner = kept.where(slot & ~wide & (F.col("group") == 2)).select("host", F.col("token").alias("other"), "element", F.col("chars").alias("c"), F.col("before").alias("b"), "differ")
    nest = kept.where(wide).select("host", F.col("token").alias("element"), F.col("depth").alias("d"))
    behind = (F.col("b") - F.col("s.before") >= BEFORE_SHARE * (F.col("s.chars") - F.col("c"))) & (F.col("c") < OTHER_SHARE * F.col("s.chars"))
    others = inner.where("differ").join(nest, ["host", "element"]).join(found.select("host", "s"), "host").where((F.col("d") >= F.col("s.depth")) & behind)
    others = others.groupBy("host").agg(F.collect_list("other").alias("others"))
    return found.join(others, "host", "left").select("host", F.col("s.token").alias("slot"), "boilerplate", F.coalesce("others", F.array().cast("array<bigint>")).alias("others"))


def _valid(pages: DataFrame, members: DataFrame) -> DataFrame:
    """host, vector of the classes whose tokens stand in the same order in all pages."""
    classes = members.groupBy("host").agg(F.collect_list(F.struct("token", "vector")).alias("classes"))
    met = _with_host_rows(pages.select("host", "html"), classes, members)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 1):
                rows = []
                for h, source, known in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    of = {x["token"]: x["vector"] for x in known or ()}
                    state: dict[int, xxhash.xxh64] = {}
                    for t, *_ in Page(source).tokens():
                        if (v := of.pop(t, None)) is not None:  # its first place
                            state.setdefault(v, xxhash.xxh64()).update(t.to_bytes(8, "little", signed=True))
                    rows += [(h, v, s.intdigest() - (1 << 63)) for v, s in state.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["host", "vector", "sign"])

    signs = met.select("host", "html", "classes").mapInArrow(order, "host long, vector long, sign long")
    return signs.groupBy("host", "vector").agg(F.min("sign").alias("a"), F.max("sign").alias("b")).where("a = b").select("host", "vector")


def _with_host_rows(pages: DataFrame, by_host: DataFrame, counted: DataFrame) -> DataFrame:
    small = counted.count() <= BROADCAST_TOKENS
    return pages.join(F.broadcast(by_host) if small else by_host, "host", "left")


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col`` and ``text`` (blocks joined by line ends) for each row.

    A null or empty page has the empty text. Pages without a host share the empty host.
    A page that is alone at its host, or lacks the host's main slot, is read by its own
    article or main element, or else whole but for menus, forms, notices and the like.
    Repeated pages and ids give a row each; extra columns are left aside; an empty table
    gives an empty result. Inside a block white space is one space; a character reference
    is the character it names.
    """
    common.bounded_batches(df.sparkSession)
    pages = _pages(df, id_col, url_col, html_col)
    found = common.written(templates(pages), f"{common.scratch(df.sparkSession)}/templates")
    joined = _with_host_rows(pages.select("id", "url", "host", "html"), found, found.select(F.explode_outer("boilerplate")))
    keep = joined.select("id", "url", "html", "slot", "boilerplate", "others")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 2):
                texts = [Page(s).text(slot, frozenset(known or ()), frozenset(more or ())) for s, slot, known, more in zip(*(part.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    kind = pages.schema["id"].dataType.simpleString()
    out = keep.mapInArrow(extract, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
