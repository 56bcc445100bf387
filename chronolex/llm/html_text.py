"""Main text of web pages by tree scoring.

The page is cut into tags and text by one regular expression and read into a tree (implied end tags
included). Parts that are no article by their element, role or class name go with all they hold, but
for wrappers that hold most of the page's text and for the headers of the article itself. Each block
with text of its own is a paragraph: it passes points for length and commas to its ancestors, less
the further up, and an ancestor's sum is discounted by the share of its text that is links. The best
container, widened to the article or main element around it, and its siblings that score or read like
text are kept. Lists of links go where they stand outside that container or open it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from chronolex.llm.common import slices

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z) | <[!?][^>]*>? | <(/?)([a-zA-Z][\w:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)> | <(/?)([a-zA-Z][\w:-]*)([^>]*)>""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([\w:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements whose content is no markup; it is dropped.
RAW = frozenset("script style textarea title noscript template iframe xmp svg".split())
#: Raw content that is shown as it stands.
SHOWN = frozenset({"xmp"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre xmp figure figcaption address hgroup details summary center fieldset hr".split()
)
DROPPED = frozenset("head nav footer button select option menu dialog canvas object applet audio video map label legend input".split())
#: Elements that go unless they wrap the article or, for a header, belong to it.
DOUBTFUL = frozenset("header aside form".split())
CONTAINERS = frozenset("html body main article section div td th table tbody tr ul ol dl blockquote figure center details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BONUS = {"article": 10.0, "main": 10.0, "section": 2.0, "div": 2.0}
#: An opening tag of the key ends open elements of the value, up to the nearest of the bounds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
BOUNDS = frozenset("ul ol dl table body html article section div main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: First or last words of class names and ids that mark what isn't the article.
BOILERPLATE = frozenset(
    "ad ads adsense advert adverts advertisement advertising adbox sponsor sponsored sponsors promo promos promotion promoted banner banners "
    "nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside rail footer foot footnav header masthead topbar "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts disclaimer warning popup popover modal overlay lightbox toast "
    "newsletter subscribe subscription signup signin login register social share sharing sharer follow related recommended recommendations recirc trending "
    "comment comments commentlist disqus reply replies respond discussion reactions pagination pager widget widgets toolbar skip copyright legal "
    "form search searchbox searchform hidden tagcloud taglist outbrain taboola paywall teaser".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion reactions".split())
ADVERTS = frozenset("ad ads adsense advert adverts advertisement advertising adbox sponsor sponsored sponsors promo promos promotion promoted banner banners outbrain taboola".split())
#: Elements of text: a name alone doesn't drop them, only if they are short or mostly links.
PLAIN = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 li dt dd figcaption".split())
PLAIN_CHARS = 25
#: Words that make the one before them a word of another meaning.
COMPOUNDS = frozenset({("follow", "up"), ("share", "price"), ("share", "prices"), ("share", "holders"), ("form", "factor"), ("legal", "aid")})
NEGATIONS = frozenset("no with has without".split())
TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
WORD_SPLIT = re.compile(r"[^a-z0-9]+")
HALVINGS = 3


def _mark(tag: str, attributes: str, in_article: bool) -> str:
    """What tells that an element is no part of the article: "gone" for good, "form", "header", "name" or "doubt" if other things can outweigh it, "" if nothing does."""
    if tag in DROPPED:
        return "gone"
    own = tag if tag in ("form", "header") else "name" if tag in DOUBTFUL else ""
    if not attributes.strip() or tag in ("html", "body"):
        return own
    named = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    if "hidden" in named or named.get("aria-hidden", "").lower() == "true":
        return "gone"
    if "style" in named and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", named["style"], re.I):
        return "gone"
    if (role := named.get("role", "").lower()) in ROLES:
        return "form" if role == "form" else "name"
    marks = COMMENTS if tag in ("article", "main") else ADVERTS if in_article and tag in TABLE else BOILERPLATE
    for name in f"{named.get('class', '')} {named.get('id', '')}".split():
        words = [w for w in WORD_SPLIT.split(CAMEL.sub("-", unescape(name)).lower()) if w and not w.isdigit()]
        if tuple(words[:2]) in COMPOUNDS:
            words = words[2:]
        if words and words[0] not in NEGATIONS and (words[0] in marks or words[-1] in marks):
            if tag in PLAIN:
                return "doubt"
            return "gone" if words[0] in COMMENTS or words[-1] in COMMENTS else "header" if words[-1] == "header" else "name"
    return own


class Tree:
    """Nodes in page order: tag ("" for text), parent, nearest block, text, mark; nothing of parts gone for good but their root."""

    def __init__(self, page: str):
        self.tag, self.parent, self.block, self.text, self.link, self.mark, self.article = ["body"], [-1], [0], [""], [False], [""], [False]
        self.page, self.stack, self.dropped = page, [0], -1  # dropped: stack height at which a dropped part began
        at = 0
        find, n = TOKEN.search, len(page)
        while at < n:
            m = find(page, at)
            if m is None:
                self._text(page[at:])
                break
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name:
                tag = name.lower()
                if m[1] or m[4]:
                    self._close(tag)
                else:
                    attributes = m[3] if m[2] else m[6]
                    if tag in RAW and not attributes.endswith("/"):
                        end = re.compile(f"</{re.escape(tag)}(?![\\w:-])[^>]*>?", re.I).search(page, at)
                        if tag in SHOWN:
                            self._open(tag, attributes)
                            self._raw(page[at : end.start() if end else n])
                            self._close(tag)
                        at = end.end() if end else n
                    else:
                        self._open(tag, attributes)

    def _add(self, tag: str, text: str = "") -> int:
        up = self.stack[-1]
        k = len(self.tag)
        self.tag.append(tag)
        self.parent.append(up)
        self.block.append(k if tag in BLOCKS else self.block[up])
        self.text.append(text)
        self.link.append(tag == "a" or self.link[up])
        self.mark.append("")
        self.article.append(tag in ("article", "main") or self.article[up])
        return k

    def _raw(self, text: str) -> None:
        if self.dropped < 0 and text:
            self._add("", text)

    def _text(self, raw: str) -> None:
        self._raw(unescape(raw) if "&" in raw else raw)

    def _open(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in BLOCKS or tag in DROPPED or tag in DOUBTFUL:
            self._end({"p"}, BLOCKS - {"p", *HEADINGS})
        if tag in ENDS:
            self._end(ENDS[tag], BOUNDS)
        if self.dropped >= 0:
            if tag not in VOID:
                self.stack.append(self._hollow(tag))
            return
        if tag in VOID:
            self._add(tag, " " if tag == "br" else "")
            return
        mark = _mark(tag, attributes, self.article[self.stack[-1]])
        if mark:
            self._add("hr")  # a break between what is before and after
        self.stack.append(self._add(tag))
        self.mark[-1] = mark
        if mark == "gone":
            self.dropped = len(self.stack) - 1
        if attributes.endswith("/") and tag not in BLOCKS:
            self._close(tag)

    def _hollow(self, tag: str) -> int:
        """A node of a dropped part: it only keeps the end tags matched."""
        return self._add(tag)

    def _end(self, tags: set, bounds) -> None:
        """Close up to the nearest open element among tags, unless a bound comes first."""
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[k]]
            if tag in tags:
                self._cut(k)
                return
            if tag in bounds:
                return

    def _close(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[k]] == tag:
                self._cut(k)
                return
            if tag not in BLOCKS and tag not in DROPPED and tag not in DOUBTFUL and self.tag[self.stack[k]] in BLOCKS:
                return  # an inline end tag doesn't close blocks around it

    def _cut(self, k: int) -> None:
        del self.stack[k:]
        if 0 <= self.dropped and len(self.stack) <= self.dropped:
            self.dropped = -1


def _add_up(t: Tree, *sums: list) -> None:
    """Make every node's number the sum of its subtree's."""
    for k in range(len(t.tag) - 1, 0, -1):
        for x in sums:
            x[t.parent[k]] += x[k]


class Parts:
    """Which nodes lie in marked parts (``out``); sums of text, links and headings with these parts included."""

    def __init__(self, t: Tree):
        self.t, n = t, len(t.tag)
        self.size = [len(x.strip()) for x in t.text]
        self.links = [a if b else 0 for a, b in zip(self.size, t.link, strict=True)]
        self.headings = [int(tag in HEADINGS) for tag in t.tag]
        centre = [int(tag in ("article", "main", "h1")) for tag in t.tag]
        _add_up(t, self.size, self.links, self.headings, centre)
        self.out = [False] * n
        for k in range(1, n):
            up, mark = t.parent[k], t.mark[k]
            self.out[k] = self.out[up]
            if mark and not self.out[up]:
                # A wrapper, as a form around the whole page: most of the text that is no link and, but for forms, an article or h1 if there is one.
                wraps = mark != "gone" and 2 * (self.size[k] - self.links[k]) > self.size[0] - self.links[0] and (mark == "form" or centre[k] > 0 or centre[0] == 0)
                plain = mark == "doubt" and self.size[k] >= PLAIN_CHARS and 2 * self.links[k] <= self.size[k]
                self.out[k] = not (wraps or plain or (t.article[up] and self.titles(k)))

    def titles(self, k: int) -> bool:
        """Whether a part is a header with a heading and more text than links."""
        return self.t.mark[k] == "header" and self.headings[k] > 0 and 2 * self.links[k] <= self.size[k]

    def end(self, k: int) -> int:
        """Where the subtree of a node ends: nodes are in page order."""
        e = k + 1
        while e < len(self.t.tag) and self.t.parent[e] >= k:
            e += 1
        return e

    def take_back(self, k: int) -> None:
        """Count a marked part as no longer left out, but for marked parts within it."""
        self.out[k] = False
        for x in range(k + 1, self.end(k)):
            self.out[x] = self.out[self.t.parent[x]] or self.t.mark[x] != ""


def main_text(page: str | None) -> str:
    """Blocks of the article in page order, joined by an empty line; empty if there is none."""
    if not page:
        return ""
    t = Tree(page)
    n = len(t.tag)
    parts = Parts(t)
    out = parts.out
    size, links, own, commas = [0] * n, [0] * n, [0] * n, [0] * n
    for k in range(n):
        if t.text[k] and not out[k]:
            long = len(t.text[k].strip())
            size[k], links[k] = long, long if t.link[k] else 0
            if not t.link[k]:
                own[t.block[k]] += long
                commas[t.block[k]] += t.text[k].count(",") + t.text[k].count("，") + t.text[k].count("、")
    _add_up(t, size, links)
    if not size[0]:
        return ""
    score = [BONUS.get(tag, 0.0) for tag in t.tag]
    for k in range(n):
        if own[k] and t.tag[k] not in HEADINGS:
            points = min(own[k] / 25, 1.0) + commas[k] + min(own[k] / 100, 3.0)
            up = k if t.tag[k] in CONTAINERS else t.parent[k]
            for level in range(HALVINGS):
                if up < 0:
                    break
                score[up] += points / (1 << level)
                up = t.parent[up]
    density = lambda k: links[k] / max(size[k], 1)
    final = [s * (1 - density(k)) if t.tag[k] in CONTAINERS and size[k] and not out[k] else 0.0 for k, s in enumerate(score)]
    best = max(range(n), key=lambda k: (final[k], -k))
    top, up = best, best
    while up > 0:
        if t.tag[up] in ("article", "main"):
            top = up
            if t.tag[up] == "article":
                break
        up = t.parent[up]
    best = top
    end = parts.end(best)
    kept = {best}
    if best > 0 and t.tag[best] not in ("article", "main"):
        prose = [int(t.tag[k] in ("p", "pre", "blockquote") and own[k] > 0) for k in range(n)]
        _add_up(t, prose)
        for k in range(1, n):
            beside = t.parent[k] == t.parent[best] and k != best
            if beside and size[k] and ((prose[k] and density(k) < 0.25) or t.tag[k] in HEADINGS or final[k] >= max(3.0, 0.2 * final[best])):
                kept.add(k)
            # A header in the container, or before it within the same part of the page, is the article's own.
            if out[k] and not out[t.parent[k]] and parts.titles(k) and (best < k < end or (beside and k < best and t.parent[k] > 0)):
                parts.take_back(k)
                kept.add(k)
    elif t.tag[best] == "article":  # an article in several parts
        kept.update(k for k in range(1, n) if t.parent[k] == t.parent[best] and t.tag[k] == "article" and final[k] >= 0.2 * final[best])
    if best > 0:  # titles over the containers around the best one
        around, up = set(), best
        while up > 0:
            up = t.parent[up]
            around.add(up)
        kept.update(k for k in range(1, best) if t.tag[k] == "h1" and t.parent[k] in around and not out[k])
    inside = [False] * n
    blocks: list[str] = []
    now: list[str] = []
    last = -1

    def flush() -> None:
        if text := " ".join("".join(now).split()):
            blocks.append(text)
        now.clear()

    for k in range(n):
        up = t.parent[k]
        inside[k] = (k in kept or (up >= 0 and inside[up])) and not out[k]
        if inside[k] and k not in kept and t.tag[k] in ("ul", "ol", "div", "section", "table", "p") and links[k] > 0 and 2 * links[k] > size[k] and not (t.tag[k] == "p" and own[k]):
            # Links: part of an article, or as a list or table of a container that has begun, but a menu elsewhere.
            inside[k] = best < k < end and best > 0 and (t.article[k] or (bool(blocks or now) and t.tag[k] not in ("div", "section")))
        if t.tag[k] in BLOCKS or (inside[k] and t.block[k] != last):
            flush()
        if inside[k] and t.text[k]:
            now.append(t.text[k])
            last = t.block[k]
        elif t.tag[k] in BLOCKS:
            last = t.block[k]
    flush()
    return "\n\n".join(blocks)


def extracted(pages: DataFrame, keep: str = "page_id long, url string") -> DataFrame:
    """The kept columns with text and n_chars; maps over partitions without a shuffle.

    Null and empty pages have an empty text; a very long page is read whole. Only the html decides: nulls
    elsewhere, repeated rows and clashing extra columns don't matter, of containers that tie the first in
    page order is taken, and an empty table gives no rows.
    """
    names = [c.split(" ")[0] for c in keep.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*names, "text", "n_chars"])

    return pages.select(*dict.fromkeys([*names, "html"])).mapInArrow(run, f"{keep}, text string, n_chars long")


def digest(pages: DataFrame) -> DataFrame:
    """Rows of the query: page_id, url, text, n_chars; null, empty and long pages, ties, repeated rows and empty tables as in ``extracted``."""
    return extracted(pages)
