"""Main text of web pages by deducing the template that pages of a host share.

A page is a sequence of tokens: tags with the path of their elements, and text nodes with theirs. Tokens of a host with
the same occurrence vector (how often they stand on each page) form an equivalence class; vectors are compared by two sums of
hashes of (page, count), so a host with a third of all pages is summed like any other. A class is valid when it
is frequent (``SUPPORT`` distinct pages, told by a bit table of payload hashes) and large (``LARGE`` tokens). The most frequent class that stands at most
once on a page is the template's root. Every other valid class on at least half of the root's pages nests in it, on each page whose root is whole and has the class's tokens in
one gap. Text tokens of these classes are constant and go; the text between them fills the slots. Slots inside menus, headers,
footers, sidebars, notices, adverts, forms, comments and the like are boilerplate. The article's slots are the main
text; where a page marks no article, all slots under the main region are: the lowest container with its varying first-level heading and ``REGION`` of the characters of all slots.
Where constant text makes up more than half of a marked article it is what pages copy from each other, and stays; a template never empties a page.

Null html is empty; a page without main text gives an empty string. A host with fewer than ``SUPPORT`` pages has no
template, and its pages follow their marks alone; so do pages without the whole root. Pages without html count for no class. A null URL is a host of its own. Repeated page_ids give a row each.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainframe.llm.store import stored

SUPPORT, LARGE, REGION = 3, 3, 0.8
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|math|textarea|title|select|object|canvas|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_MARKS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOILERPLATE_TAGS = frozenset("nav header footer aside form button dialog menu head fieldset".split())
BOILERPLATE_MARKS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer"
    " header login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup promo promoted related reply replies responses"
    " search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget contentinfo complementary".split()
)
ARTICLE_MARKS = frozenset("article main".split())
CONTAINERS = frozenset("article body center div html main section table tbody td tr".split())


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class Page:
    """Tokens of a page: hash, the text if it is text, whether it is boilerplate, whether it is in an article, its innermost container; where blocks end; titles."""

    def __init__(self, source: str):
        self.tokens: list[tuple[int, str | None, bool, bool, int]] = []
        self.breaks: set[int] = set()
        self.parents = [0]  # of containers; 0 is the page
        self.titles: set[int] = set()
        stack: list[tuple[str, bool, bool, int]] = []  # element with its marks, boilerplate, article, innermost container
        for m in _TOKEN.finditer(source):
            closing, tag, rest, text = m.group(2), m.group(3), m.group(4), m.group(5)
            path = "/".join(s[0] for s in stack)
            holder = stack[-1][3] if stack else 0
            if text is not None:
                if stack and stack[-1][0].split(".")[0] == "h1":
                    self.titles.add(len(self.tokens))
                if not text.isspace():
                    self.tokens.append((_hash(path, " ".join(text.split())), text, any(s[1] for s in stack), any(s[2] for s in stack), holder))
                else:
                    self.tokens.append((0, text, any(s[1] for s in stack), any(s[2] for s in stack), holder))
                continue
            if tag is None:
                continue
            tag = tag.lower()
            if tag in INLINE:
                if not (closing or not rest or tag == "wbr") and self._boilerplate(tag, rest)[0]:
                    stack.append((tag + "*", True, False, holder))
                elif closing and stack and stack[-1][0] == tag + "*":
                    stack.pop()
                continue
            self.breaks.add(len(self.tokens))
            if tag in VOID:
                continue
            if closing:
                names = [s[0].split(".")[0] for s in stack]
                if tag in names:
                    del stack[len(names) - 1 - names[::-1].index(tag) :]
                self.tokens.append((_hash("/".join(s[0] for s in stack), "/" + tag), None, False, False, 0))
                continue
            bad, marks = self._boilerplate(tag, rest)
            good = not bad and (tag in ("article", "main") or bool(ARTICLE_MARKS & marks))
            if tag in CLOSES_P and stack and stack[-1][0].split(".")[0] == "p":
                stack.pop()
            elif tag in SIBLINGS and stack and stack[-1][0].split(".")[0] in SIBLINGS[tag]:
                stack.pop()
            if tag in ("article", "main") and not bad:  # a menu or header left open ends before the article
                names = [s[0].split(".")[0] for s in stack]
                while stack and stack[-1][1] and names[-1] in BOILERPLATE_TAGS and "article" not in names and "main" not in names:
                    stack.pop()
                    names.pop()
            name = tag + ("." + ".".join(sorted(marks)) if marks else "")
            self.tokens.append((_hash("/".join(s[0] for s in stack), name), None, False, False, 0))
            holder = stack[-1][3] if stack else 0
            if tag in CONTAINERS:
                self.parents.append(holder)
                holder = len(self.parents) - 1
            stack.append((name, bad, good, holder))
        self.breaks.add(len(self.tokens))

    @staticmethod
    def _boilerplate(tag: str, rest: str) -> tuple[bool, set[str]]:
        marks: set[str] = set()
        for a, b, c in _MARKS.findall(rest) if rest else ():
            marks.update(_WORDS.findall((a or b or c).lower()))
        hidden = "hidden" in rest.lower().split() if rest else False
        structural = tag in ("html", "body", "article", "main")
        return tag in BOILERPLATE_TAGS or hidden or (not structural and bool(marks & BOILERPLATE_MARKS)) or (tag == "article" and "comment" in marks), marks

    def constant(self, root: frozenset[int], nested: list[frozenset[int]]) -> frozenset[int]:
        """Tokens of the template on this page: its root, if it is whole, and the classes that lie in one gap of it."""
        at = [i for i, t in enumerate(self.tokens) if t[0] in root]
        if not root or len(at) != len(root):
            return frozenset()
        out = set(root)
        for members in nested:
            gaps = {bisect.bisect(at, i) for i, t in enumerate(self.tokens) if t[0] in members}
            if len(gaps) == 1:
                out |= members
        return frozenset(out)

    def region(self, used: list[int]) -> set[int]:
        """Containers of the main region, from the text tokens that are left."""
        size, total = [0] * len(self.parents), 0
        title = next((self.tokens[i][4] for i in used if i in self.titles), None)
        for i in used:
            size[self.tokens[i][4]] += len(self.tokens[i][1])
            total += len(self.tokens[i][1])
        for c in range(len(size) - 1, 0, -1):
            size[self.parents[c]] += size[c]
        above = set()
        while title:
            above.add(title)
            title = self.parents[title]
        top = 0
        for c in range(1, len(size)):  # children come after their parents
            if self.parents[c] == top and size[c] >= REGION * total and (c in above or not above):
                top = c
        inside = {top}
        for c in range(top + 1, len(size)):
            if self.parents[c] in inside:
                inside.add(c)
        return inside

    def text(self, root: frozenset[int] = frozenset(), nested: list[frozenset[int]] = ()) -> str:
        """Blocks of the main text, one a line."""
        constant = self.constant(root, nested)
        return self._lines(constant) or (self._lines(frozenset()) if constant else "")

    def _lines(self, constant: frozenset[int]) -> str:
        fine = [i for i, (token, text, bad, _, _) in enumerate(self.tokens) if text is not None and token and not bad]
        article = [i for i in fine if self.tokens[i][3]]
        if article:
            copied = sum(len(self.tokens[i][1]) for i in article if self.tokens[i][0] in constant)
            if 2 * copied > sum(len(self.tokens[i][1]) for i in article):
                constant = frozenset()
            inside = None
        else:
            inside = self.region([i for i in fine if self.tokens[i][0] not in constant])
        blocks, block = [], []

        def end_block() -> None:
            line = " ".join(entities.unescape("".join(block)).split())
            block.clear()
            if line:
                blocks.append(line)

        for i, (token, text, bad, good, holder) in enumerate(self.tokens):
            if i in self.breaks:
                end_block()
            if text is None:
                continue
            if bad or (token and token in constant) or not (good if inside is None else holder in inside):
                if token:
                    end_block()
            else:
                block.append(text)
        end_block()
        return "\n".join(blocks)


def host_of(url) -> object:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def templates(pages: DataFrame) -> DataFrame:
    """host, root and nested: the tokens of the root class and those of the classes that nest in it."""
    names = ["host", "token", "pages", "total", "v1", "v2", "bits"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, int], list[int]] = {}
            for host, page, payload, source in zip(*(batch.column(i) for i in range(4)), strict=True):
                host, key, bit = host.as_py(), page.as_py(), 1 << (payload.as_py() & 63)
                for token, n in Counter(t[0] for t in Page(source.as_py() or "").tokens if t[0]).items():
                    h = hash((key, n)) * 0x9E3779B97F4A7C15 % 2**64
                    row = seen.setdefault((host, token), [0, 0, 0, 0, 0])
                    row[0] += 1
                    row[1] += n
                    row[2] += h >> 33
                    row[3] += h & 0x7FFFFFFF
                    row[4] |= bit
            cols = [[k[0] for k in seen], [k[1] for k in seen], *([r[i] for r in seen.values()] for i in range(4)), [r[4] - (r[4] >> 63 << 64) for r in seen.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(cols)], names)

    read = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url").alias("page"), F.xxhash64("html").alias("payload"), "html")
    rows = read.mapInArrow(count, ", ".join(f"{n} {'string' if n == 'host' else 'long'}" for n in names))
    tokens = rows.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "total", "v1", "v2")], F.bit_or("bits").alias("bits"))
    frequent = tokens.where(F.bit_count("bits") >= SUPPORT)
    valid = frequent.groupBy("host", "pages", "v1", "v2").agg(F.collect_list("token").alias("members"), F.max(F.col("total") == F.col("pages")).alias("single")).where(F.size("members") >= LARGE)
    valid = stored(valid, "classes")
    first = F.struct("pages", F.size("members"), "v1", "v2")
    roots = valid.where("single").groupBy("host").agg(F.max_by("members", first).alias("root"), F.max(first).alias("top"))
    inner = valid.join(roots, "host").where("2 * pages >= top.pages and not (pages = top.pages and v1 = top.v1 and v2 = top.v2)")
    nested = inner.groupBy("host").agg(F.collect_list("members").alias("nested"))
    return stored(roots.join(nested, "host", "left").select("host", "root", "nested"), "templates")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", host_of(F.col("url")).alias("host"))
    joined = rows.join(templates(pages), "host", "left").select("page_id", "url", "html", "host", "root", "nested")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, tuple[frozenset[int], list[frozenset[int]]]] = {}
            texts = []
            for host, source, root, nested in zip(*(batch.column(c) for c in ("host", "html", "root", "nested")), strict=True):
                host = host.as_py()
                if host not in known:
                    known[host] = frozenset(root.as_py() or ()), [frozenset(c) for c in nested.as_py() or ()]
                texts.append(Page(source.as_py() or "").text(*known[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
