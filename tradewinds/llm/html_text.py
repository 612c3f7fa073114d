"""Main text of web pages by scoring the tree.

Every paragraph with enough text gets points for its length and its commas. They are passed on to its ancestors, less
the farther up, and an element's sum is discounted by the share of its text that stands in links. The element with the
most points is the container of the article; siblings with enough points of their own, or that are plain long
paragraphs, are kept with it. Elements that are no article by their tag, role, class or id are left out before. Class and id
are only believed where something with points is left: where nothing is, those around the container that has the most
points without them do not count.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)|</?\Z", re.DOTALL)
_SIMPLE = re.compile(r"[^<>\"']*+(?:(?:\"[^\"<>]*+\"|'[^'<>]*+')[^<>\"']*+)*+>")  # the rest of a tag without '<' or '>' in quotes
_UNQUOTED = re.compile(r"[^<>\"']*+")
_ANGLE = re.compile("[<>]")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_COMMA = re.compile("[,،、，]")
_NAME = re.compile("[a-z0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
_NEVER = frozenset(
    "nav footer aside script style noscript template iframe object embed svg canvas audio video map button select "
    "textarea input dialog menu head title".split()
)
_ARTICLE = frozenset(("article", "main"))
_NO_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar note".split())
_NO_NAME = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "submenu breadcrumb breadcrumbs sidebar footer masthead comment comments commentlist disqus respond replies reply "
    "cookie cookies consent gdpr notice notices notification newsletter subscribe subscription signup social share sharing "
    "related recommended recommendations widget popup modal overlay toolbar pagination pager login search skip toc "
    "discussion usercomments topbar rail adsense alert toast cookiebar cookiebanner".split()
)
_REMARKS = frozenset("comment comments commentlist disqus respond replies reply discussion usercomments".split())
_LAYOUT = frozenset("has with without no".split())  # "has-sidebar" is no sidebar
_GOOD_NAME = frozenset("article articlebody content main post entry story text body blog".split())
_PARAGRAPH = frozenset("p pre td blockquote li dd div section article main figcaption".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul".split()
)
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead"), "option": ("option",),
}
_SCOPE = frozenset("ul ol dl table div section article main body td th blockquote".split())
_LEAST, _LEVELS = 25, 5  # characters of a paragraph that gets points, ancestors that it passes them to
_BULK = 200  # characters of a container for which names do not count


def _tag_end(source: str, at: int, last: dict[str, int], open_ended: set[int]) -> int:
    """Where the tag ends whose name ends at ``at``: after the first '>' outside quotes, however long they are.

    If there is none before a '<' or the end, quotes don't count; -1 if a '<' comes first then, the end of the page if
    nothing does. ``last`` has the last place of each quote, ``open_ended`` those after a quote from where no end was
    found: every stretch of a page is looked at a bounded number of times.
    """
    if simple := _SIMPLE.match(source, at):
        return simple.end()
    met, k = [], at
    while k not in open_ended:
        met.append(k)
        k = _UNQUOTED.match(source, k).end()
        if k == len(source) or source[k] == "<":
            break
        if source[k] == ">":
            return k + 1
        if k >= last[source[k]]:
            break
        k = source.index(source[k], k + 1) + 1
    open_ended.update(met)
    angle = _ANGLE.search(source, at)
    return len(source) if not angle else angle.end() if angle[0] == ">" else -1


class Page:
    """A parsed page. Elements are numbered in the order of their start tags, so those below one follow it directly."""

    def __init__(self, source: str):
        self.tags, self.parents, self.names, self.out, self.end = ["#"], [0], [frozenset()], [False], [0]
        self.named = [False]  # left out by class, id or as a form, which may mean nothing
        self.runs: list[tuple[int, str]] = []  # (element, text); a block's edges are runs of white space
        self._open, self._articles = [0], 0
        self._opened: Counter[str] = Counter()
        self._parse(source)
        while self._open:
            self.end[self._open.pop()] = len(self.tags)

    def _parse(self, source: str) -> None:
        at = scan = 0
        last = {quote: source.rfind(quote) for quote in "\"'"}
        open_ended: set[int] = set()
        while m := _MARK.search(source, scan):
            tag, begin, end = m[2], m.start(), m.end()
            if tag:
                end = _tag_end(source, m.end(), last, open_ended)
                if end < 0:
                    scan = m.end()
                    continue
            if begin > at:
                self._text(source[at:begin])
            at = scan = end
            if not tag or source[end - 1] != ">":
                continue
            tag = tag.lower()
            if m[1]:
                self._close(tag)
                continue
            self._start(tag, source[m.end() : end - 1])
            if tag in _RAW:
                # inside script, style and the like only their own end tag counts
                ends = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).finditer(source, at)
                at = scan = next((e.start() for e in ends if _tag_end(source, e.end(), last, open_ended) >= 0), len(source))
        if at < len(source):
            self._text(source[at:])

    def _text(self, text: str) -> None:
        self.runs.append((self._open[-1], html.unescape(text) if "&" in text else text))

    def _start(self, tag: str, inside: str) -> None:
        if tag in _CLOSES_P:
            self._end_implied(("p",), _SCOPE)
        elif tag in _CLOSES:
            self._end_implied(_CLOSES[tag], frozenset(("ul", "ol", "dl", "table")))
        parent = self._open[-1]
        if tag not in _INLINE:
            self.runs.append((parent, " "))
        if tag in _VOID:
            return
        names, left_out, named = self._judge(tag, inside)
        self.tags.append(tag)
        self.parents.append(parent)
        self.names.append(names)
        self.out.append(left_out)
        self.named.append(named)
        self.end.append(0)
        self._open.append(len(self.tags) - 1)
        self._articles += tag in _ARTICLE
        self._opened[tag] += 1

    def _judge(self, tag: str, inside: str) -> tuple[frozenset[str], bool, bool]:
        """Words of class and id, whether the element is no part of an article, and whether it seems so by its names."""
        names, hidden, role = frozenset(), False, ""
        if inside.strip(" /\n\t\r"):
            given = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(inside)}
            names = frozenset(_NAME.findall(html.unescape(given.get("class", "") + " " + given.get("id", ""))))
            role = given.get("role", "").strip()
            style = given.get("style", "").replace(" ", "")
            hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        if tag in ("html", "body"):
            return names, False, False
        heading = not self._articles and "header" in names and not names & _GOOD_NAME
        named = bool(names & _NO_NAME) and not names & _LAYOUT
        out = hidden or (tag == "header" and not self._articles) or tag in _NEVER or role in _NO_ROLE
        return names, out, heading or named or tag == "form"

    def _end_implied(self, tags: tuple[str, ...], scope: frozenset[str]) -> None:
        if not any(self._opened[t] for t in tags):
            return
        for k in range(len(self._open) - 1, 0, -1):
            open_tag = self.tags[self._open[k]]
            if open_tag in tags:
                self._pop_to(k)
                if len(tags) == 1:
                    return
            elif open_tag in scope:
                return

    def _close(self, tag: str) -> None:
        if tag == "br":
            self.runs.append((self._open[-1], " "))
        if not self._opened[tag]:
            return
        for k in range(len(self._open) - 1, 0, -1):
            if self.tags[self._open[k]] == tag:
                self._pop_to(k)
                return
            if tag in _INLINE and self.tags[self._open[k]] in _SCOPE:
                return

    def _pop_to(self, k: int) -> None:
        while len(self._open) > k:
            gone = self._open.pop()
            self.end[gone] = len(self.tags)
            self._articles -= self.tags[gone] in _ARTICLE
            self._opened[self.tags[gone]] -= 1
            if self.tags[gone] not in _INLINE:
                self.runs.append((self._open[-1], " "))

    def main_text(self) -> str:
        """The article; its blocks, with white space as one space, joined by one space."""
        n = len(self.tags)
        own: list[list[str]] = [[] for _ in range(n)]
        for element, text in self.runs:
            own[element].append(text)
        texts = [" ".join("".join(t).split()) for t in own]
        cut = [a or b for a, b in zip(self.out, self.named, strict=True)]
        kept, length, links, anchors, score = self._measured(cut, texts)
        if any(self.named) and not any(s > 0 for s in score.values()) and not self._articles_of(kept, length):
            wrongly = self._wrongly_named(texts)
            if wrongly:
                cut = [a and k not in wrongly for k, a in enumerate(cut)]
                kept, length, links, anchors, score = self._measured(cut, texts)
        chosen = self._chosen(score, kept, length, links)
        for k in range(1, n):
            if self.tags[k] in ("ul", "ol", "div", "table", "section", "dl") and anchors[k] >= 3 and links[k] > 0.8 * length[k]:
                kept[k] = False  # a menu within the article
            kept[k] = kept[k] and kept[self.parents[k]]
        inside = [False] * n
        for k in chosen:
            inside[k : self.end[k]] = [True] * (self.end[k] - k)
        return " ".join("".join([text if inside[k] and kept[k] else " " for k, text in self.runs]).split())

    def _measured(self, cut, texts):
        """What is kept with ``cut`` elements left out; characters, those in links and links below each element; points."""
        n = len(self.tags)
        kept, linked = [True] * n, [False] * n
        for k in range(1, n):
            kept[k] = kept[self.parents[k]] and not cut[k]
            linked[k] = linked[self.parents[k]] or self.tags[k] == "a"
        length, links, paragraph, anchors = [0] * n, [0] * n, [0] * n, [0] * n
        commas = [0] * n
        for k in range(n - 1, -1, -1):
            if kept[k]:
                length[k] += len(texts[k])
                paragraph[k] += len(texts[k])
                commas[k] += len(_COMMA.findall(texts[k]))
                if linked[k]:
                    links[k] += len(texts[k])
                if k:
                    up = self.parents[k]
                    length[up] += length[k]
                    links[up] += links[k]
                    anchors[up] += anchors[k] + (self.tags[k] == "a")
                    if self.tags[k] in _INLINE:
                        paragraph[up] += paragraph[k]
                        commas[up] += commas[k]
        return kept, length, links, anchors, self._scores(kept, length, links, paragraph, commas)

    def _wrongly_named(self, texts) -> set[int]:
        """Elements around the container with the most points that only their names leave out; none of reader comments,
        unless they hold an article, and none around a container of little text."""
        kept, length, links, _, score = self._measured(self.out, texts)
        if not score:
            return set()
        best = min(score, key=lambda k: (-score[k], k))
        around, k = [], best
        while k:
            around.append(k)
            k = self.parents[k]
        article = any(self.tags[k] in _ARTICLE for k in around) or any(best < k < self.end[best] for k in self._articles_of(kept, length))
        if length[best] < _BULK or (not article and any(self.names[k] & _REMARKS for k in around)):
            return set()
        return {k for k in around if self.named[k]}

    def _articles_of(self, kept, length) -> list[int]:
        return [k for k in range(1, len(self.tags)) if kept[k] and self.tags[k] in _ARTICLE and length[k]]

    def _scores(self, kept, length, links, paragraph, commas) -> dict[int, float]:
        score: dict[int, float] = {}
        for k in range(1, len(self.tags)):
            if not kept[k] or self.tags[k] not in _PARAGRAPH or paragraph[k] < _LEAST:
                continue
            points = 1 + commas[k] + min(paragraph[k] / 100, 3)
            up = self.parents[k]
            for level in range(_LEVELS):
                if not up:
                    break
                if up not in score:
                    score[up] = self._start_score(up)
                score[up] += points / (1, 2, 6, 9, 12)[level]
                up = self.parents[up]
        return {k: s * (1 - links[k] / max(1, length[k])) for k, s in score.items() if self.tags[k] not in ("html",)}

    def _start_score(self, k: int) -> float:
        tag = self.tags[k]
        by_tag = 10 if tag in _ARTICLE else 5 if tag == "div" else 3 if tag in ("pre", "td", "blockquote") else -3 if tag in ("ul", "ol", "dl", "li", "dd", "th") else 0
        return by_tag + (25 if self.names[k] & _GOOD_NAME and tag != "body" else 0)

    def _chosen(self, score, kept, length, links) -> list[int]:
        articles = self._articles_of(kept, length)
        if not score:
            if articles:
                return [max(articles, key=lambda k: (length[k], -k))]
            return [0]
        best = min(score, key=lambda k: (-score[k], k))
        # the article element around the container, or the container within the only article element
        up = best
        while up and self.tags[up] not in _ARTICLE:
            up = self.parents[up]
        if up:
            best = up
        elif articles:
            within = [k for k in articles if best < k < self.end[best]]
            if within:
                best = max(within, key=lambda k: (length[k], -k))
        enough = max(10, 0.2 * score.get(best, 0))
        chosen = [best]
        for k in range(1, len(self.tags)):
            if k != best and self.parents[k] == self.parents[best] and kept[k] and length[k]:
                sparse = links[k] / length[k]
                if score.get(k, 0) >= enough or (self.tags[k] == "p" and length[k] > 80 and sparse < 0.25):
                    chosen.append(k)
        return sorted(chosen)


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def _extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            texts = [main_text(h) for h in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], "_text"])


def extract_main_text(pages: DataFrame, page_html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The main text of every page: the ``keep`` columns, text and n_chars (code points).

    A null or empty page has an empty text, as has one without any text outside menus, notices and the like. Pages are
    looked at one by one and whole; repeated rows and null ids stay as they are. Markup that is cut off at the end of
    a page is left out.
    """
    rows = pages.select(F.col(page_html).cast("string").alias("_html"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    done = rows.mapInArrow(_extracting, rows.drop("_html").schema.add("_text", "string"))
    return done.select(
        *[F.col(f"_keep_{c}").alias(c) for c in keep], F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars")
    )
