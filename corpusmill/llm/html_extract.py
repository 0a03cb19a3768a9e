"""Main text of HTML pages by text-to-tag ratio over the events of the standard library's parser.

Pages are streamed into the parser tag by tag; what never ends (a tag, a comment, a script)
is left out, so broken pages cost no more than sound ones. Events make lines: a line is the
text between two block-level boundaries, with the number of tags that its block took and the
element it stands in. A line's text-to-tag ratio is its characters for each of these tags.
Ratios are smoothed along the page by a Gaussian, and lines are clustered into content and
other by a threshold, the standard deviation of the smoothed ratios (Weninger et al. 2010).
Lines belong to the region of their nearest sectioning element; the region with most text in
content lines is the content, and lines between its content lines stay, however short. Where
that region is no article or main element, lines before its first and after its last content
line go, but for headings.

Elements beside the article (menus, headers, footers, sidebars, notices, adverts, forms,
comments) have ratio 0: by their tag or role, or by the head noun of a class or id of a
container. A form or a container named for its layout that holds most of a page's text is
no such element.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import pieces, tidy

# Names of HTML elements by their part in a page.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button datalist title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav header footer aside form dialog menu".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
IN_HEAD = frozenset("head title meta link base style script noscript template".split())
REGION = frozenset("article main body section div td".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end an open paragraph, and elements of which one ends the one before.
ENDS_P = BLOCK - {"html", "body", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Elements whose class or id may say that they are beside the article.
NAMED = frozenset("div section ul ol dl table center details figure iframe ins span a form".split())
#: Last words of a class or id that name something beside the article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb "
    "breadcrumbs header masthead footer sidebar aside widget widgets related recommended recommendations share sharing social newsletter subscribe "
    "subscription signup login cookie cookies consent gdpr notice notices popup modal overlay comment comments disqus reply replies respond form search "
    "pagination pager toolbar skip".split()
)
#: Of these, such as may hold more text than the article.
VOICES = frozenset("comment comments disqus reply replies respond related recommended recommendations".split())
#: Words that may follow those above, and words that turn a name into something else.
HOLDS = frozenset("area bar block box bottom col column container content holder inner item items left link links list main outer panel placeholder right row section slot thread top unit wrap wrapper".split())
TURNS = frozenset("article entry has no of post story title with without".split())
#: Words of short lines at the edge of a page that are no article's.
NOTICE = re.compile(r"©|\bcopyright\b|\ball rights reserved\b|\bcookies?\b|\bprivacy policy\b|\bterms of (?:use|service)\b|\bsubscribe\b|\bsign up\b", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")


def named(value: str) -> str:
    """The word of a class or id that names something beside the article, or nothing."""
    for name in value.lower().split():
        parts = _PART.findall(name)
        if not TURNS.isdisjoint(parts):
            continue
        while len(parts) > 1 and parts[-1] in HOLDS:
            parts.pop()
        if parts and parts[-1] in BESIDE:
            return parts[-1]
    return ""


def beside(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
    """Whether an element is, by its names, no part of an article, and whether that holds however much text it has."""
    if tag in ASIDE:
        return True, tag not in ("form", "header", "dialog")
    for name, value in attrs:
        if name == "role" and (value or "").strip().lower() in ROLES:
            return True, value.strip().lower() != "form"
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True, True
        if name in ("class", "id") and value and tag in NAMED:
            word = named(value)
            if word:
                return True, word in VOICES
    return False, False


_TAG = re.compile(r"""</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>""")
_OPEN = re.compile(r"</?[a-zA-Z]|<[!?]")
_NAME = re.compile(r"<([a-zA-Z][^\s/>]*)")
#: Characters within which quotes of a tag must close to count.
TAG = 4096


def tokens(html: str) -> Iterator[str]:
    """The page in parts that each end with a whole tag; comments, declarations, raw text and what never ends left out."""
    at = begin = 0
    while True:
        found = _OPEN.search(html, at)
        if not found:
            break
        i = found.start()
        if html[i + 1] in "!?":
            end = html.find("-->", i + 4) if html.startswith("<!--", i) and not html.startswith(("<!-->", "<!--->"), i) else html.find(">", i)
            yield html[begin:i]
            if end < 0:
                return
            at = begin = end + (3 if html.startswith("-->", end) else 1)
            continue
        tag = _TAG.match(html, i, i + TAG)
        at = tag.end() if tag else html.find(">", i) + 1
        if not at:
            yield html[begin:i]
            return
        yield html[begin:at]
        begin = at
        name = _NAME.match(html, i)
        if name and name[1].lower() in RAW and html[at - 2] != "/":
            closing = re.compile(f"</{re.escape(name[1])}(?=[\\s/>])", re.IGNORECASE).search(html, at)
            if not closing:
                return
            at = begin = closing.start()
    yield html[begin:]


class Lines(HTMLParser):
    """``read`` a page; ``lines`` has [text, tags, region, beside element, link characters, heading] lists in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        #: Open elements: (tag, beside element, is hidden, region); how often each tag is open; open links.
        self.open: list[tuple[str, int, bool, int]] = []
        self.count: Counter = Counter()
        self.parts: list[str] = []
        self.linked = self.tags = 0
        self.regions = [("", 0)]
        #: Elements beside the article: (the one around, whether it is so whatever it holds).
        self.asides = [(0, False)]

    def read(self, html: str):
        parts, held = [], 0
        for part in tokens(html):
            parts.append(part)
            held += len(part)
            if held > TAG:
                self._some("".join(parts))
                parts, held = [], 0
        self._some("".join(parts))
        self.close()

    def _some(self, text: str):
        """Feeds some whole tags; what the parser takes for an unfinished one is left out, and what follows it is not."""
        self.feed(text)
        while self.rawdata.startswith("<"):
            left, self.rawdata = self.rawdata, ""
            first, *rest = tokens(left)
            self.feed(first)
            if self.rawdata.startswith("<"):
                self.rawdata = ""
            self.feed("".join(rest))

    def parse_marked_section(self, i, report=1):
        """Marked sections mean nothing in HTML: they end with the next ``>``."""
        return self.rawdata.find(">", i) + 1 or -1

    def unknown_decl(self, data):
        pass

    def _state(self):
        return self.open[-1] if self.open else ("", 0, False, 0)

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            tag, aside, _, region = self._state()
            self.lines.append([text, self.tags, region, aside, self.linked, tag in HEADS])
            self.tags = 0
        self.parts, self.linked = [], 0

    def _pop(self, at: int):
        for tag, *_ in self.open[at:]:
            if tag in BLOCK:
                self.flush()
                break
        self.count.subtract(tag for tag, *_ in self.open[at:])
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if self.count["head"] > 0 and tag not in IN_HEAD:
            self._pop(next(k for k, x in enumerate(self.open) if x[0] == "head"))
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self.flush()
            return
        if tag in BLOCK:
            self.flush()
            if tag in ENDS_P and self.count["p"] > 0:
                for at in range(len(self.open) - 1, -1, -1):
                    if self.open[at][0] == "p":
                        self._pop(at)
                        break
                    if self.open[at][0] in BLOCK:
                        break
        if tag in SAME and any(self.count[x] > 0 for x in SAME[tag]):
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] in SAME[tag]:
                    self._pop(at)
                    break
                if self.open[at][0] in STOPS[tag]:
                    break
        _, aside, hidden, region = self._state()
        if not (tag == "header" and (self.count["article"] > 0 or self.count["main"] > 0)):  # an article's own header holds its title
            is_beside, surely = beside(tag, attrs)
            if is_beside:
                self.asides.append((aside, surely))
                aside = len(self.asides) - 1
        if tag in REGION:
            self.regions.append((tag, region))
            region = len(self.regions) - 1
        self.open.append((tag, aside, hidden or tag in HIDDEN, region))
        self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math", "path") and self.open and self.open[-1][0] == tag:
            self._pop(len(self.open) - 1)

    def handle_endtag(self, tag):
        self.tags += 1
        if self.count[tag] <= 0:
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._pop(at)
                return
            if tag not in BLOCK and self.open[at][0] in BLOCK:
                return  # a stray end of an inline element

    def handle_data(self, data):
        if not self._state()[2]:
            self.parts.append(data)
            if self.count["a"] > 0:
                self.linked += len(data.strip())

    def close(self):
        super().close()
        self.flush()


def smoothed(ratios: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian mean over neighbours within two sigma; beyond the page's ends there is nothing."""
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        top = weight = 0.0
        for k, g in zip(range(i - reach, i + reach + 1), kernel, strict=True):
            if 0 <= k < len(ratios):
                top, weight = top + g * ratios[k], weight + g
        out.append(top / weight)
    return out


def _totals(weight: list[int], parent: list[int]) -> list[int]:
    """Each element's weight with those of the elements inside it, which come after it."""
    for k in range(len(weight) - 1, 0, -1):
        weight[parent[k]] += weight[k]
    return weight


def _beside(page: Lines) -> list[bool]:
    """Of each element beside the article, whether it is one, or is in one, given how much text it holds."""
    held = [0] * len(page.asides)
    for line in page.lines:
        held[line[3]] += len(line[0])
    held = _totals(held, [a for a, _ in page.asides])
    out = [False] * len(held)
    for k in range(1, len(held)):
        around, surely = page.asides[k]
        out[k] = out[around] or surely or 2 * held[k] <= held[0]
    return out


def main_text(html: str | None) -> str:
    """The page's article: blocks in page order, white space in a block made one space, joined by two line feeds.

    Null, empty and textless pages give an empty string.
    """
    if not html:
        return ""
    page = Lines()
    page.read(html)
    lines = page.lines
    if not lines:
        return ""
    gone = _beside(page)
    plain = [k for k, line in enumerate(lines) if not gone[line[3]]]
    smooth = smoothed([0.0 if gone[aside] else len(text) / max(1, tags) for text, tags, _, aside, _, _ in lines])
    mean = sum(smooth) / len(smooth)
    threshold = min(math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth)), max(smooth))
    content = {k for k in plain if smooth[k] >= threshold}
    if not content:
        return "\n\n".join(lines[k][0] for k in plain)
    # from the page inwards as long as one region holds most of the content's characters
    parent = [r for _, r in page.regions]
    weight = [0] * len(parent)
    for k in content:
        weight[lines[k][2]] += len(lines[k][0])
    direct = list(weight)
    weight = _totals(weight, parent)
    best: dict[int, tuple] = {}
    for r in range(1, len(parent)):
        if weight[r]:
            rank = (page.regions[r][0] in ("article", "main"), weight[r], -r)
            best[parent[r]] = max(best.get(parent[r], rank), rank)
    chosen = left = 0
    while chosen in best:
        sure, heavy, r = best[chosen]
        left += direct[chosen]  # content of the region itself, which goes with it
        if heavy <= (0.3 if sure else 0.8) * weight[chosen] or not sure and left > 0.02 * weight[0]:
            break
        chosen = -r
    inside = [r == 0 == chosen for r in range(len(parent))]
    sure = False
    for r in range(len(parent)):
        inside[r] = r == chosen or bool(r) and inside[parent[r]]
    r = chosen
    while r and not sure:
        sure, r = page.regions[r][0] in ("article", "main"), parent[r]
    kept = [k for k in plain if inside[lines[k][2]]]
    return "\n\n".join(lines[k][0] for k in (kept if sure else _trimmed(kept, lines, content)))


def _trimmed(kept: list[int], lines: list[list], content: set[int]) -> list[int]:
    """Lines without those at either edge that are menus or notices, or no content."""

    def edge(k: int) -> bool:
        text, _, _, _, linked, heading = lines[k]
        if 2 * linked > len(text) or len(text) < 100 and NOTICE.search(text):
            return True
        return not heading and k not in content

    whole = [k for k in kept if not edge(k)]
    return kept[kept.index(whole[0]) : kept.index(whole[-1]) + 1] if whole else kept


def _extractor(names: list[str]):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "html"):
                texts = [main_text(h) for h in piece.column("html").to_pylist()]
                made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), *made], [*names, "text", "n_chars"])

    return tidy(run)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of the whole html, and ``n_chars``, its code points, in place of the html.

    Pages are worked on one by one, so repeats and null keys need no care. Null pages are
    empty. Markup that is broken or cut off is read as far as it goes. Columns ``text`` and
    ``n_chars`` are replaced.
    """
    names = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    given = pages.select(F.col(html_col).alias("html"), *[F.col(f"`{c}`").alias(f"_x{k}") for k, c in enumerate(names)])
    schema = [f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[1:]]
    made = given.mapInArrow(_extractor([f"_x{k}" for k in range(len(names))]), ", ".join([*schema, "text string", "n_chars long"]))
    return made.select(*[F.col(f"_x{k}").alias(c) for k, c in enumerate(names)], "text", "n_chars")
