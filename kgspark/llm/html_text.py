"""Main text of web pages by consensus of the pages of a host.

1. Every page is read once and each of its containers is scored: how much running text it holds directly in its blocks, less what
   stands in links, and nothing for menus, headers, footers, sidebars, notices, adverts, forms and comments. These are known by their
   tags; words of an element's names only lower what it holds (``NAMED``). The best container's path (tags with their classes, digits
   generalised) is the page's vote. Of the chosen container, inner elements with such names are left out: those named as comments, adverts
   and the like (``FOREIGN``) always, others, which also name wrappers, if they hold less than half of its text outside links; neither if
   they hold an article or main (one inside another article is a comment and does not count), or if nothing else is in the container.
   Of an article's own header its headings stay.
2. Spark adds the votes per host and path. Votes are aggregated before they are shuffled, so a host with a third of all pages is no hot key.
   All paths with votes are kept.
3. The containers of a page meet the votes of their paths by (host, path), in ``SALTS`` parts. The path with the largest product of the
   page's own score and the logarithm of the votes is its main text, and the page is read again for it. Every page votes for a path of its
   own, so no page is without one unless it has no container at all.

A block ends at a block-level tag; ``br`` is white space inside it. Character references are decoded; white space inside a block
becomes one space; blocks are joined by a line break. Unclosed and stray tags are tolerated: an end tag closes the nearest open one
of its name, and is ignored if there is none; ``p``, ``li`` and the like close their own kind.

Defined results: a null or empty page, and one without text, give an empty text; a null url or one without host belongs to a common
nameless host; repeated rows vote again and are returned again; an empty table gives an empty result; other columns may have any
name; ties go to the smaller path.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .core import query, table

SALTS = 16  # parts that the pages of one host and path are dealt to
# fixed values: elements of the HTML standard by kind, and common names of parts that are not the article
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "math", "select", "textarea", "button", "title"}
RAW = {"script", "style", "textarea", "title"}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q",
          "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CONTAINER = {"article", "main", "section", "div", "body", "td", "center", "blockquote"}
NAMED = 0.3  # what text counts in elements whose names are of BOILERPLATE
CLOSES_ITSELF = {"p", "li", "dt", "dd", "option", "tr", "td", "th"}
BOILERPLATE = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|foot(?:er)?|form|head(?:er)?|legal|login|masthead|menu|meta|modal|nav\w*|"
                         r"newsletter|notice|pager|pagination|popup|promo\w*|recommend\w*|related|replies|respond|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[-_\s\d])", re.I)
FOREIGN = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|comments?|cookies?|consent|disqus|newsletter|popup|promo\w*|recommend\w*|related|replies|respond|share|sharing|social|sponsor\w*|subscribe)(?:$|[-_\s\d])", re.I)
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
DIGITS = re.compile(r"\d+")


class Page:
    """The blocks of a page in order: ``(path, text)``, where the path names the open containers, and boilerplate is left out."""

    def __init__(self, source: str):
        self.blocks: list[tuple[tuple[str, ...], str, int]] = []
        self.stack: list[tuple[str, str, int, int]] = []  # tag, step of the path, hides (-1: shows again), number of the element if its name is of BOILERPLATE (or -1)
        self.holds: list[float] = []  # per such element the text outside links that it holds; no bound if an article
        self.above: list[int] = []  # per such element the number of containers about it
        self.foreign: list[bool] = []  # per such element whether its name is of FOREIGN
        self.under: list[tuple[int, ...]] = []  # per block the elements with such a name about it
        self.parts: list[str] = []
        self.linked = 0
        at, hidden = 0, 0
        while m := TOKEN.search(source, at):
            if not hidden and m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            tag = (m[1] or "").lower()
            if not tag:
                continue
            if source.startswith("</", m.start()):
                hidden -= self._end(tag)
            elif tag not in VOID:
                hidden += self._start(tag, m[2])
                if tag in RAW:
                    end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
                    at = end.end() if end else len(source)
                    hidden -= self._end(tag)
            elif tag not in INLINE:
                self._break()
            elif tag == "br":
                self.parts.append(" ")
        if not hidden:
            self._text(source[at:])
        self._break()

    def _text(self, raw: str) -> None:
        self.parts.append(raw)
        if any(e[0] == "a" for e in self.stack[-4:]):
            self.linked += len(raw)

    def _break(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.blocks.append((tuple(e[1] for e in self.stack if e[1]), text, self.linked))
                names = tuple(e[3] for e in self.stack if e[3] >= 0)
                self.under.append(names)
                for i in names:
                    self.holds[i] += max(len(text) - self.linked, 0)
            self.parts, self.linked = [], 0

    def _start(self, tag: str, attributes: str) -> int:
        """1 if the element hides what it holds."""
        less = 0
        if tag not in INLINE:
            self._break()
            if tag in CLOSES_ITSELF:
                for i in range(len(self.stack) - 1, -1, -1):
                    if self.stack[i][0] == tag:
                        less = self._end(tag)
                        break
                    if self.stack[i][0] not in INLINE and self.stack[i][0] not in CLOSES_ITSELF:
                        break
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        names = " ".join(named.values())
        hides = int(tag in SILENT or tag in ASIDE)
        if tag in HEADING:
            hiding = [i for i, e in enumerate(self.stack) if e[2]]
            if len(hiding) == 1 and self.stack[hiding[0]][0] == "header" and any(e[0] in ("article", "main") for e in self.stack[: hiding[0]]):
                hides = -1
        number = -1
        if tag in ("article", "main") and not FOREIGN.search(names):
            if not any(e[2] or e[0] == "article" for e in self.stack):
                for e in self.stack:
                    if e[3] >= 0:
                        self.holds[e[3]] = float("inf")
        elif not hides and tag not in ("html", "body") and names and BOILERPLATE.search(names):
            number = len(self.holds)
            self.holds.append(0)
            self.above.append(sum(bool(e[1]) for e in self.stack))
            self.foreign.append(bool(FOREIGN.search(names)))
        step = ".".join([tag, *sorted(DIGITS.sub("#", named.get("class", "")).split())]) if tag in CONTAINER else ""
        self.stack.append((tag, step, hides, number))
        return hides - less

    def _end(self, tag: str) -> int:
        """How many hiding elements the end tag closes."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag not in INLINE:
                    self._break()
                    gone = self.stack[i:]
                    del self.stack[i:]
                else:
                    if any(e[0] not in INLINE for e in self.stack[i + 1 :]):
                        return 0
                    gone = [self.stack.pop(i)]
                return sum(e[2] for e in gone)
        return 0

    def scores(self) -> Counter:
        """Per path its running text: what stands in its blocks, and a part of what its inner containers hold."""
        found: Counter = Counter()
        for (path, text, linked), names in zip(self.blocks, self.under):
            worth = max(len(text) - 2 * linked, 0) * (1.5 if any(step.split(".")[0] in ("article", "main") for step in path) else 1.0)
            worth *= NAMED if any(self.holds[i] < float("inf") for i in names) else 1.0
            for depth in range(len(path), 0, -1):
                found[path[:depth]] += worth
                worth *= 0.9  # an outer container holds the same text and more that is not the article
        return found

    def best(self) -> tuple[str, ...] | None:
        found = self.scores()
        return min(found, key=lambda p: (-found[p], len(p), p)) if found else None

    def text(self, path: tuple[str, ...] | None) -> str:
        """All blocks below the path, without what is boilerplate by name in it."""
        path = path or ()
        own = [(t, n, names) for (p, t, n), names in zip(self.blocks, self.under) if p[: len(path)] == path]
        whole = sum(max(len(t) - n, 0) for t, n, _ in own)
        gone = lambda i: self.above[i] >= len(path) and self.holds[i] < float("inf") and (self.foreign[i] or 2 * self.holds[i] < whole)
        kept = [t for t, _, names in own if not any(map(gone, names))]
        return "\n".join(kept or [t for t, _, _ in own])


def candidates(pages: DataFrame, html_col: str = "html", host_col: str = "host") -> DataFrame:
    """``host, digest, path, score, best``: every container path of every page; the best one is its vote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "digest", "path", "score", "best"]
        kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_())
        for batch in batches:
            rows = []
            for host, source in zip(batch.column(0), batch.column(1)):
                text = source.as_py() or ""
                page = Page(text)
                found, best = page.scores(), page.best()
                digest = hashlib.sha256(text.encode()).hexdigest()
                rows += [(host.as_py(), digest, " ".join(p), float(n), p == best) for p, n in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return pages.select(F.col(host_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(run, "host string, digest string, path string, score double, best boolean")


def votes(found: DataFrame) -> DataFrame:
    """``host, path, pages``: how many pages of a host have the path as their best container."""
    return found.filter("best").groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"))


def chosen(found: DataFrame) -> DataFrame:
    """``host, digest, path``: one path per page, by votes and its own score."""
    salted = votes(found).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = found.select("host", "digest", "path", "score", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["host", "path", "salt"])
    worth = F.round(F.col("score") * F.log1p("pages"), 6)
    return each.groupBy("host", "digest").agg(F.min(F.struct((-worth).alias("worth"), (-F.col("pages")).alias("pages"), "path")).alias("first")).select("host", "digest", "first.path")


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``row`` (the other columns of ``pages``) and ``text``."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    known = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html_col]).alias("row"), F.col(html_col).alias("html"), host.alias("host"))
    paths = cut_lineage(chosen(cut_lineage(candidates(known))))
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    joined = known.withColumn("digest", digest).join(paths, ["host", "digest"], "left").select("row", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [Page(s.as_py() or "").text(tuple(p.as_py().split(" ")) if p.is_valid else None) for s, p in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "text"])

    return joined.mapInArrow(run, T.StructType([joined.schema["row"], T.StructField("text", T.StringType())]))


@query("op5_html_text")
def op5(spark, sf_dir):
    out = extract(table(spark, sf_dir, "pages"))
    return out.select(F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), "text", F.length("text").cast("long").alias("n_chars"))
