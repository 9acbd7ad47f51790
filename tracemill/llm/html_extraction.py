"""Main text of web pages: site templates are found by counting element subtrees per host.

First every container element of every page gets a hash of its subtree. Spark counts in how many
different pages of a host each hash occurs; subtrees that recur across many pages of the host are
its template and are deleted. What remains of the article, less elements that HTML itself marks as
furniture (navigation, forms, asides and the like), is the text.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import materialise, releasing

#: A subtree is template when it occurs in this share of a host's different pages, and in MIN_PAGES of them
#: or all, on a host of SITE different pages or more.
MIN_SHARE, MIN_PAGES, SITE = 0.3, 4, 3
#: Within an article, an element that holds more than this share of its text is no template, however often it recurs.
MOST_TEXT = 0.5

# Element names, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset(
    "head title script style noscript template iframe object embed svg math canvas audio video nav header footer aside form button select option "
    "textarea input label fieldset menu dialog search datalist noembed noframes xmp".split()
)
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot caption blockquote pre figcaption".split())
ROOTS = frozenset("html body article main".split())
CLOSES = {  # an opening tag ends these open elements, up to the nearest container
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "tbody": frozenset(["tbody", "thead", "tr", "td", "th"]), "tfoot": frozenset(["tbody", "thead", "tr", "td", "th"]),
}
HOLDS = frozenset("html body article main section div nav aside header footer form table ul ol dl blockquote fieldset details dialog figure".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names that mark furniture.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|"
    r"share|sharing|social|sidebar|aside|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|topbar|footer|colophon|comments?|commentlist|disqus|respond|replies|reply|"
    r"related-(?:posts?|articles?|links?|stories|news|content)|recommended|widget|login|search|toolbar|pagination|pager|copyright|skip|hidden)(?:$|[\s_-])",
    re.I,
)
#: Class names that tell of the article's own parts; beside one of them a name above doesn't count.
OWN = re.compile(r"(?:^|\s)(?:article|content|entry|post|story|body|text|main)(?:$|\s)", re.I)
#: The same within an article, where other words may name its parts: adverts, notices, reader comments, menus, sidebars, footers and calls to sign up or share.
ARTICLE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|adslot|sponsor\w*|promo|banner|notices?|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|signup|"
    r"share|sharing|social|sidebar|menu|footer|nav|navbar|navigation|breadcrumbs?|comments?|commentlist|disqus|respond|replies)(?:$|[\s_-])",
    re.I,
)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>")
#: The same without regard to quotes, for what follows a tag that never ends with them.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class Page:
    """The elements of a page in order of their opening tags, and its text runs."""

    __slots__ = ("tag", "attrs", "parent", "runs", "end", "_open_at", "_holds", "_in_article", "_roots")

    def __init__(self, source: str):
        self.tag, self.attrs, self.parent = ["#"], [""], [-1]
        self.end: list[int] = [0]  # one past the last descendant
        self.runs: list[tuple[int, str | None]] = []  # (element, text); None marks a block border
        # depths of the open elements by name, and of the open containers: no tag walks the whole stack
        self._open_at: dict[str, list[int]] = {}
        self._holds: list[int] = []
        self._in_article = [False]
        self._roots: list[int] | None = None
        stack, at, n, text = [0], 0, len(source), 0
        limit, tag = source.rfind(">") + 1, _TAG
        while (start := source.find("<", at)) >= 0:
            kind = source[start + 1 : start + 2]
            m, run = None, None
            if kind in ("!", "?"):
                comment, data = source.startswith("<!--", start), source.startswith("<![CDATA[", start)
                mark = "-->" if comment else "]]>" if data else ">"
                end = source.find(mark, start + (4 if comment else 9 if data else 2))
                if end < 0 and not comment and not data:
                    at = start + 1  # no more > at all
                    continue
                at = n if end < 0 else end + len(mark)
                run = html.escape(source[start + 9 : n if end < 0 else end]) if data else None
            else:
                m = tag.match(source, start, limit)
                if m is None and tag is _TAG and start < limit and _PLAIN_TAG.match(source, start, limit):
                    tag = _PLAIN_TAG  # a quote is never closed: from here on they count as any character
                    m = tag.match(source, start, limit)
                if m is None:
                    if start >= limit:
                        break
                    at = start + 1
                    continue
                at = m.end()
            if start > text:
                self.runs.append((stack[-1], source[text:start]))
            text = at
            if run is not None:
                self.runs.append((stack[-1], run))
            if m is None:
                continue
            name = m[2].lower()
            if m[1]:
                self._close(stack, name)
                continue
            self._open(stack, name, m[3])
            if name in RAW and not m[3].endswith("/"):
                close = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at, max(limit, at))
                text = at = close.end() if close else n
                self._close(stack, name)
        if text < n:
            self.runs.append((stack[-1], source[text:]))
        for e in stack:
            self.end[e] = len(self.tag)

    def _open(self, stack: list[int], name: str, attrs: str) -> None:
        if name in BLOCK:
            floor = self._holds[-1] if self._holds else 0
            ended = []
            for open_tag in ("p", *CLOSES.get(name, ())):
                at = self._open_at.get(open_tag, [])
                if (k := bisect_right(at, floor)) < len(at):
                    ended.append(at[k])
            if ended:
                self._pop(stack, min(ended))
            self.runs.append((stack[-1], None))
        elif name == "br":
            self.runs.append((stack[-1], " "))
        e = len(self.tag)
        self.tag.append(name)
        self.attrs.append(attrs)
        self.parent.append(stack[-1])
        self._in_article.append(self.tag[stack[-1]] == "article" or self._in_article[stack[-1]])
        self.end.append(e + 1)
        if name not in VOID:
            self._open_at.setdefault(name, []).append(len(stack))
            if name in HOLDS:
                self._holds.append(len(stack))
            stack.append(e)

    def _close(self, stack: list[int], name: str) -> None:
        at = self._open_at.get(name)
        # the end tag of something that isn't open in this container is passed over
        if at and (name in HOLDS or not self._holds or at[-1] > self._holds[-1]):
            self._pop(stack, at[-1])

    def _pop(self, stack: list[int], k: int) -> None:
        if any(self.tag[e] in BLOCK for e in stack[k:]):
            self.runs.append((stack[k - 1], None))
        for e in stack[k:]:
            self.end[e] = len(self.tag)
            self._open_at[self.tag[e]].pop()
            if self.tag[e] in HOLDS:
                self._holds.pop()
        del stack[k:]

    def furniture(self, e: int) -> bool:
        """Marked as no part of an article by its name, role, class, id or being hidden."""
        tag = self.tag[e]
        if tag in FURNITURE and not (tag == "header" and self._in_article[e]):  # an article's own header has its title
            return True
        raw = self.attrs[e]
        if not raw or tag in ROOTS and tag != "article":
            return False
        found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(raw)}
        if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
            return True
        names = f"{found.get('class', '')} {found.get('id', '')}"
        known = ARTICLE_NAMES if self._in_article[e] else NAMES
        return found.get("role", "").lower() in ROLES or not OWN.search(names) and bool(known.search(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names)))

    def sizes(self) -> list[int]:
        """Characters of text within each element, without those around it."""
        out = [0] * len(self.tag)
        for e, text in self.runs:
            if text is not None:
                out[e] += len(text.strip())
        for e in range(len(out) - 1, 0, -1):
            if self.tag[e] not in RAW:
                out[self.parent[e]] += out[e]
        return out

    def _teaser(self, e: int) -> bool:
        """Whether the first heading of an article leads elsewhere."""
        for x in range(e + 1, self.end[e]):
            if self.tag[x] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                return self.tag[self.parent[x]] == "a" or any(self.tag[y] == "a" and "href" in self.attrs[y].lower() for y in range(x + 1, self.end[x]))
        return False

    def region(self) -> list[int]:
        """The outermost elements that hold the article: articles with text, else main, else the whole page.

        Articles whose headings are links are teasers where another one has a heading of its own.
        """
        if self._roots is None:
            self._roots, marked, sizes = [0], {0: False}, self.sizes()
            for name in ("article", "main"):
                found, last = [], 0
                for e, t in enumerate(self.tag):
                    if t == name and e >= last and sizes[e] and not self._marked(e, marked):
                        found.append(e)
                        last = self.end[e]
                if found:
                    own = [e for e in found if not self._teaser(e)] if len(found) > 1 else found
                    self._roots = own or found
                    break
        return self._roots

    def _marked(self, e: int, known: dict[int, bool]) -> bool:
        """Whether an element or one that it is in is furniture; ``known`` is added to."""
        line = []
        while e not in known:
            line.append(e)
            e = self.parent[e]
        for x in reversed(line):
            known[x] = known[self.parent[x]] or self.furniture(x)
        return known[line[0] if line else e]

    def subtrees(self) -> dict[int, int]:
        """Hash of each element that may be template: containers, and outside articles text blocks too."""
        inside, sizes = {x: e for e in self.region() if self.tag[e] in ROOTS for x in range(e, self.end[e])}, self.sizes()
        own: dict[int, list[str]] = {}
        for e, text in self.runs:
            if text is not None and (t := text.strip()):
                own.setdefault(e, []).append(t)
        done, out = [0] * len(self.tag), {}
        children: dict[int, list[int]] = {}
        for e in range(len(self.tag) - 1, 0, -1):
            content = "\x1f".join([self.tag[e], " ".join(self.attrs[e].split()), *own.get(e, ()), *map(str, reversed(children.get(e, ())))])
            done[e] = _digest(content)
            children.setdefault(self.parent[e], []).append(done[e])
            tag = self.tag[e]
            if tag in BLOCK and tag not in ROOTS and not (e in inside and (tag in TEXTUAL or sizes[e] > MOST_TEXT * sizes[inside[e]])):
                out[e] = done[e]
        return out

    def text(self, template: Iterable[int] = ()) -> str:
        """The blocks of the article, joined by newlines."""
        template, gone = set(template), [False] * len(self.tag)
        by_hash = self.subtrees() if template else {}
        roots = set(self.region())
        kept = [False] * len(self.tag)
        kept[0] = 0 in roots
        for e in range(1, len(self.tag)):
            p = self.parent[e]
            gone[e] = gone[p] or self.furniture(e) or by_hash.get(e) in template
            kept[e] = kept[p] or e in roots
        blocks, piece = [], []
        for e, text in [*self.runs, (0, None)]:
            if text is None:
                if piece and (line := " ".join("".join(piece).split())):
                    blocks.append(line)
                piece = []
            elif kept[e] and not gone[e]:
                piece.append(html.unescape(text) if "&" in text else text)
        return "\n".join(blocks)


def _keyed(pages: DataFrame) -> DataFrame:
    """Pages with their lower-case host (empty where there is none) and a hash of their source."""
    source = F.coalesce("html", F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long"), "url", host.alias("host"), F.xxhash64(source).alias("digest"), source.alias("html"))


def subtree_hashes(pages: DataFrame) -> DataFrame:
    """``(host, digest, hash)`` for each distinct container subtree; digest is the page's own."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, digests, hashes = [], [], []
            for host, digest, source in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for h in set(Page(source).subtrees().values()):
                    hosts.append(host)
                    digests.append(digest)
                    hashes.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.int64()), pa.array(hashes, pa.int64())], ["host", "digest", "hash"])

    return _keyed(pages).select("host", "digest", "html").mapInArrow(run, "host string, digest long, hash long")


def site_templates(hashes: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``(host, hash, n_pages)`` of subtrees that recur across many pages of a host.

    Copies of one page count once, so that a page that was crawled often is no template.
    """
    seen = hashes.select("host", "hash", "digest").distinct()
    counts = seen.groupBy("host", "hash").agg(F.count("*").alias("n_pages"))
    sizes = hashes.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("host_pages")).where(F.col("host_pages") >= SITE)
    pages = F.col("host_pages")
    often = counts.where("n_pages > 1").join(sizes, "host")
    return often.where(F.col("n_pages") >= F.greatest(min_share * pages, F.least(pages, F.lit(min_pages)))).select("host", "hash", "n_pages")


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each page.

    A null or empty page has the empty text; a null url belongs to the host with the empty name.
    A page is known by its host and source, so a page_id may be null or occur on several hosts.
    Repeated rows stay repeated; columns besides page_id, url and html are not read; an empty
    table gives no rows. A host of fewer than SITE different pages has no template: two pages can't tell
    it from a story that both have. There the elements' own marks tell furniture from text.
    """
    hashes = materialise(subtree_hashes(pages), "subtrees")
    found = hashes.join(site_templates(hashes, min_pages, min_share), ["host", "hash"])
    per_page = found.groupBy("host", "digest").agg(F.collect_set("hash").alias("template"))
    rows = _keyed(pages).join(per_page, ["host", "digest"], "left")

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(s).text(t or ()) for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
