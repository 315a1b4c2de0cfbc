"""Main text of web pages by consensus: hosts vote on the paths of the containers that hold it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINNERS = 3  # paths of a host that are tried in turn
BROADCAST_HOSTS = 100_000

#: The elements of the markup language by what they do here.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title iframe noembed noframes xmp".split())
_DROPPED = set("nav header footer aside form noscript template button select svg canvas object audio video dialog menu head".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
    "section summary table tbody tfoot thead tr ul".split()
)
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_KEPT_WHATEVER = set("html body main article".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
_BOUNDARY = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}}
_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_NOISE = set(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer header masthead banner cookie cookies consent notice notices gdpr advert advertisement advertising ads ad adsense sponsor sponsored "
    "promo promotion popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations comment comments disqus replies respond pagination pager widget toolbar login "
    "signup search skip copyright legal disclaimer".split()
)
_HOSTING = set("with has no without main content article body wrapper wrap layout page container post entry story text".split())
_GOOD = set("article content entry main post story text body".split())

_NOT_A_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/><]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: Without regard to quotes, for what follows a quote that is never closed.
_LENIENT = re.compile(r"<(/?)([A-Za-z][^\s/><]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"(?<![A-Za-z-])([A-Za-z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))|\b(hidden)\b")
_PART = re.compile(r"[A-Za-z]+")


def _is_noise(tag: str, attributes: dict[str, str]) -> bool:
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in _ROLES:
        return True
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = set(_PART.findall(token))
        if parts & _NOISE and not parts & _HOSTING:
            return True
    return False


class Page:
    """The block elements of a page with their paths, and the blocks of text in page order."""

    def __init__(self, html: str) -> None:
        self.parent: list[int] = [-1]
        self.path: list[str] = [""]
        self.tags: list[str] = [""]
        self.good: list[bool] = [False]
        self.blocks: list[tuple[int, str, int, str]] = []  # element, text, characters in links, tag
        self._read(html)

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool, bool]] = []  # tag, element, dropped, in an article
        text: list[str] = []
        links = size = anchors = 0
        opened: dict[str, list[int]] = {}  # where in the stack each element is open
        blocks: list[int] = []  # and the block elements

        def flush() -> None:
            nonlocal links, size
            if text:
                whole = " ".join("".join(text).split())
                if whole:
                    self.blocks.append((stack[-1][1] if stack else 0, whole, links, stack[blocks[-1]][0] if blocks else ""))
                text.clear()
            links = size = 0

        def pop_to(depth: int) -> None:
            nonlocal anchors
            for tag, *_ in stack[depth:]:
                if tag in _BLOCK:
                    flush()
                anchors -= tag == "a"
                opened[tag].pop()
            del stack[depth:]
            while blocks and blocks[-1] >= depth:
                blocks.pop()

        def innermost(tags: set[str]) -> int:
            return max((opened[t][-1] for t in tags if opened.get(t)), default=-1)

        lenient, after_last = False, html.rfind(">") + 1
        at, end, seen = 0, len(html), 0
        while at < end:
            stop = html.find("<", seen)
            m = other = None
            if 0 <= stop < after_last:
                other = _NOT_A_TAG.match(html, stop)
                m = None if other else (_LENIENT if lenient else _TAG).match(html, stop)
                if not m and not other and not lenient and (m := _LENIENT.match(html, stop)):
                    lenient = True
            if stop >= 0 and not m and not other:
                if html.startswith(("<!", "<?"), stop):
                    other, after_last = _NOT_A_TAG.match(html, stop), stop
                elif stop < after_last or html.find("<", stop + 1) >= 0:
                    seen = stop + 1  # no tag: text
                    continue
            stop = stop if m or other else end
            if stop > at and not (stack and stack[-1][2]):
                piece = html[at:stop]
                text.append(unescape(piece) if "&" in piece else piece)
                if anchors:
                    links += len(piece.strip())
            if not m and not other:
                break
            at = seen = (m or other).end()
            if other:
                continue
            tag = m.group(2).lower()
            if m.group(1):
                if not opened.get(tag):
                    continue
                depth = opened[tag][-1]
                if tag in _BLOCK or not (blocks and blocks[-1] > depth):
                    pop_to(depth)
                continue
            if tag in _VOID:
                if tag == "hr":
                    flush()
                elif tag in ("br", "img", "wbr"):
                    text.append(" " if tag == "br" else "")
                continue
            if tag in _RAW:
                close = re.compile(rf"</{tag}\b", re.I).search(html, at)
                at = seen = (html.find(">", close.end()) + 1 if close else 0) or end
                continue
            if tag in _BLOCK and opened.get("p") and blocks[-1] == opened["p"][-1]:
                pop_to(blocks[-1])
            if tag in _CLOSED_BY and (closer := innermost(_CLOSED_BY[tag])) > innermost(_BOUNDARY[tag]):
                pop_to(closer)
            attributes = {(a or f).lower(): b or c or d or "" for a, b, c, d, f in _ATTRIBUTE.findall(m.group(3))}
            element, dropped, inside = (stack[-1][1], stack[-1][2], stack[-1][3]) if stack else (0, False, False)
            if not dropped:
                if tag in _DROPPED:
                    dropped = not (tag == "header" and inside)
                elif tag not in _KEPT_WHATEVER:
                    dropped = _is_noise(tag, attributes)
                if stack and stack[-1][0] == "header" and inside and tag not in _HEADINGS | {"hgroup", "div"}:
                    dropped = True
            if tag in _BLOCK:
                flush()
                classes = sorted(re.sub(r"\d+", "#", c) for c in attributes.get("class", "").lower().split())
                self.parent.append(element)
                self.tags.append(tag)
                path = f"{self.path[element]}/{tag}" + "".join(f".{c}" for c in classes)
                # a deep path is named by its hash, so that nesting costs no more than its depth
                self.path.append(path if len(path) <= 512 else f"#{hashlib.blake2b(path.encode('utf-8', 'replace'), digest_size=16).hexdigest()}")
                words = set(_PART.findall(" ".join([*classes, attributes.get("id", "").lower(), attributes.get("role", "").lower()])))
                self.good.append(tag in ("article", "main") or bool(words & _GOOD))
                element = len(self.parent) - 1
            elif tag in ("td", "th"):
                text.append(" ")
            anchors += tag == "a"
            if m.group(3).endswith("/") and tag not in _BLOCK:
                anchors -= tag == "a"
                continue  # closed at once
            opened.setdefault(tag, []).append(len(stack))
            if tag in _BLOCK:
                blocks.append(len(stack))
            stack.append((tag, element, dropped, inside or tag in ("article", "main")))
        pop_to(0)
        flush()

    def scores(self) -> dict[int, float]:
        """Each container's score: its blocks' text beyond their links, and half of what its child containers have."""
        out: dict[int, float] = {}
        for element, text, links, tag in self.blocks:
            worth = max(0.0, len(text) - 2.0 * links)
            if not worth:
                continue
            own = self.parent[element] if tag in _HEADINGS or tag in ("p", "li", "pre", "blockquote", "tr", "dd", "dt") else element
            own = max(own, 0)
            share = worth
            while own >= 0 and share >= 1:
                out[own] = out.get(own, 0.0) + share * (1.5 if self.good[own] else 1.0)
                own, share = self.parent[own], share / 2
        return out

    def text_of(self, containers: set[int]) -> str:
        """The blocks within the containers, in page order."""
        within: list[bool] = []
        for element, parent in enumerate(self.parent):  # a parent comes before its children
            within.append(element in containers or (parent >= 0 and within[parent]))
        return "\n\n".join(t for e, t, _, _ in self.blocks if within[e])

    def _with_relatives(self, own: set[int], scores: dict[int, float]) -> set[int]:
        """Containers of one article together: the article or main element around them, or else those beside them that
        are named like content."""
        out: set[int] = set()
        for e in own:
            up = e
            while up > 0 and self.tags[up] not in ("article", "main"):
                up = self.parent[up]
            out.add(up if up > 0 else e)
        beside = {self.parent[e] for e in out if self.tags[e] not in ("article", "main")}
        return out | {e for e in scores if self.parent[e] in beside and self.good[e]}

    def extract(self, paths: list[str]) -> tuple[str, str]:
        """The text in the containers of the first of ``paths`` that this page has, or else in its best one."""
        scores = self.scores()
        if not scores:
            return "", ""
        best = max(scores.values())
        for path in paths:
            own = {e for e, s in scores.items() if self.path[e] == path}
            if own:
                return self.text_of(self._with_relatives(own, scores)), path
        top = min((e for e, s in scores.items() if s == best))
        return self.text_of(self._with_relatives({top}, scores)), self.path[top]


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, vote): on each page a path's vote is its score as a share of the best."""
    for batch in batches:
        sums: dict[tuple[str, str], float] = {}
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if not html:
                continue
            page = Page(html)
            scores = page.scores()
            best = max(scores.values(), default=0.0)
            on_page: dict[str, float] = {}
            for e, s in scores.items():
                on_page[page.path[e]] = max(on_page.get(page.path[e], 0.0), s / best)
            for path, vote in on_page.items():
                sums[host, path] = sums.get((host, path), 0.0) + vote
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums]), pa.array(list(sums.values()))], ["host", "path", "vote"])


def _extracted(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(h).extract(p or []) if h else ("", "") for h, p in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True)]
            new = {"text": pa.array([x[0] for x in found], pa.string()), "path": pa.array([x[1] for x in found], pa.string())}
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


def winners(pages: DataFrame) -> DataFrame:
    """(host, paths): the paths with the most votes of each host, the best first, ties by path."""
    voted = pages.select("host", "html").mapInArrow(_votes, "host string, path string, vote double")
    total = voted.groupBy("host", "path").agg(F.sum("vote").alias("votes"))
    order = Window.partitionBy("host").orderBy(F.round("votes", 6).desc(), "path")
    top = total.withColumn("place", F.row_number().over(order)).where(F.col("place") <= WINNERS)
    return top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, path) for each row of (page_id, url, html, ...).

    Every page's containers are scored; a host's pages vote on the paths of tags and classes, digits generalised,
    and the text is then taken from the winning path's containers, or on a page that hasn't one from its own best.
    Boilerplate elements are left out of both. Pages are parsed twice and never shuffled: votes are summed where the
    pages lie, so a host with a third of all pages is no larger a group than any; winners are broadcast up to a
    checked number of hosts and joined beyond it.

    Null or empty html gives the empty string; pages without a host are one host; repeated rows get equal texts;
    of equally good containers the first counts; very long pages are read whole, in time linear in their length,
    whatever their markup; other columns play no part. No rows give no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    from tessera.llm.store import cut, small_batches

    small_batches(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)), F.lit(""))
    read = pages.select("page_id", "url", "html", host.alias("host"))
    best = cut(winners(read))
    best = F.broadcast(best) if best.count() <= BROADCAST_HOSTS else best
    joined = read.join(best, "host", "left").select("page_id", "url", "html", "paths")
    out = joined.select("page_id", "url").schema.add("text", "string").add("path", "string")
    return joined.mapInArrow(_extracted(to_arrow_schema(out)), out)
