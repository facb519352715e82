"""Operator 13, HTML extraction: the main text of a page from text-to-tag ratios.

A page goes through the standard library's streaming parser in slices. Its events make lines: one line is the text between
two block borders, with the tags met since the last border, the containers it lies in, and whether it lies in an area that
is never content (menus, page headers and footers, sidebars, notices, adverts, forms, scripts, reader comments; told by the
element, its role, or a word of its class or id). A line's text-to-tag ratio is its characters per tag. The ratios are
smoothed by a Gaussian; lines whose smoothed ratio reaches the threshold, the standard deviation of all, are the
content cluster. The cluster selects the region: the innermost ``article``, ``main`` or the like that holds half of the
cluster's characters or more, else the innermost container that holds nine tenths. The region's lines make the text, also
the short ones (headings, list items), but for those in areas that are never content.

White space in a line becomes one space, lines are joined by an empty line. A null or empty page, and one without content,
has an empty text. Character references are decoded, an invalid one becomes U+FFFD. Broken markup ends with the element
around it. Very long pages are parsed whole, one at a time. Each row is judged alone, so repeated rows get equal results and
ties can't occur: of equal containers the innermost is taken. All other columns pass through, those named like a result are
replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import table

SLICE = 1 << 16
#: Standard deviation of the Gaussian in lines, its reach to each side, and the threshold in standard deviations of all ratios.
SMOOTH, REACH, THRESHOLD = 1.0, 3, 1.0
#: Share of the content cluster's characters that a region of its own kind, or any container, must hold.
OWN_SHARE, ANY_SHARE = 0.5, 0.9

#: Elements of HTML by what they do to the lines.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead title tr ul".split()
)
NEVER = set(
    "aside audio button canvas datalist dialog footer form head header iframe menu nav noscript object optgroup script search select style svg template textarea title video".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTENT, WHOLE = {"article", "main"}, {"html", "body", "article", "main"}
#: Elements that an article doesn't lie in; whose end or start is white space.
NEVER_AROUND, SPACES = {"header", "nav", "form", "button", "noscript", "select"}, {"br", "td", "th"}
ENDS_PARAGRAPH = BLOCKS - {"body", "caption", "head", "html", "legend", "optgroup", "option", "summary", "tbody", "tfoot", "thead", "title", "tr"}
#: Elements whose start ends an open one of the same group, if no element of the third group lies between.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WORDS = set(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus donate "
    "footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices outbrain pager pagination popup promo promotion promoted recommendations "
    "recommended related replies respond share sharing sidebar signup sitemap skip social sponsor sponsored sponsors subscribe subscription taboola toolbar widget widgets".split()
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


#: How far an element is content: all of it, its headings if it heads an article, nothing.
CONTENT_AREA, HEADER_AREA, NEVER_AREA = 0, 1, 2


def area(tag: str, values: dict[str, str]) -> int:
    """The area that an element opens, by its name, role, class, id and visibility."""
    if "hidden" in values or values.get("aria-hidden") == "true" or HIDDEN.search(values.get("style", "")):
        return NEVER_AREA
    if tag in NEVER:
        return HEADER_AREA if tag == "header" else NEVER_AREA
    if values.get("role", "").lower() in ROLES:
        return NEVER_AREA
    if tag in ("html", "body", "main"):  # their classes speak of the page's layout
        return CONTENT_AREA
    named = {w.lower() for w in PART.findall(f"{values.get('class', '')} {values.get('id', '')}")} & WORDS
    return CONTENT_AREA if not named else HEADER_AREA if named == {"header"} else NEVER_AREA


class Element(NamedTuple):
    tag: str
    number: int
    area: int
    content: bool  # lies in, or is, an element that says it holds the content
    dropped: bool  # lies in, or is, an inline element that is never content


class Line(NamedTuple):
    text: str
    tags: int
    containers: tuple[int, ...]
    never: bool


class Lines(HTMLParser):
    """Collects the lines of a page, and the numbers of the elements that say they hold the content."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Element("", 0, CONTENT_AREA, False, False)]
        self.own: set[int] = set()
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = self.number = 0

    def border(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.lines.append(Line(text, self.tags, tuple(e.number for e in self.open), self.open[-1].area != CONTENT_AREA))
            self.tags = 0
        self.text.clear()

    def leave(self, tags: set[str], within: set[str]) -> bool:
        """End the innermost open element of ``tags``, and all in it, unless one of ``within`` lies deeper."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return True
            if self.open[i].tag in within:
                break
        return False

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        if tag in BLOCKS:
            self.border()
        if tag in ENDS_PARAGRAPH:
            self.leave({"p"}, BLOCKS - {"p"} | {"button", "td", "th"})
        if tag in SIBLINGS:
            self.leave(*SIBLINGS[tag])
        if tag == "body":
            self.leave({"head"}, set())
        self.tags += 1
        if tag in SPACES:
            self.text.append(" ")
        if tag in VOID:
            return
        opened = area(tag, values)
        own = opened == CONTENT_AREA and (tag in CONTENT or values.get("role", "").lower() == "main" or "articlebody" in values.get("itemprop", "").lower())
        while own and self.leave(NEVER_AROUND, set()):  # one that was left open, or that holds the whole page
            pass
        self.number += 1
        above = self.open[-1]
        if tag in HEADINGS and above.content and max(opened, above.area) == HEADER_AREA:
            opened = CONTENT_AREA
        else:
            opened = max(opened, above.area)
        if own:
            self.own.add(self.number)
        self.open.append(Element(tag, self.number, opened, above.content or own, above.dropped or opened > above.area and tag not in BLOCKS))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as in HTML, the slash means nothing

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.border()
        self.leave({tag}, set() if tag in WHOLE else {"article", "main", "body"})

    def handle_data(self, data):
        if not self.open[-1].dropped:
            self.text.append(data)


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian means; at the ends the weights that are left are scaled up."""
    weights = [math.exp(-0.5 * (d / SMOOTH) ** 2) for d in range(-REACH, REACH + 1)]
    out = []
    for i in range(len(ratios)):
        low, high = max(0, i - REACH), min(len(ratios), i + REACH + 1)
        some = weights[low - i + REACH : high - i + REACH]
        out.append(sum(w * x for w, x in zip(some, ratios[low:high], strict=True)) / sum(some))
    return out


def region(lines: list[Line], own: set[int]) -> int | None:
    """The container that the content cluster selects, 0 for the page; None if nothing is content."""
    content = [line for line in lines if not line.never]
    if not content:
        return None
    ratios = smoothed([0.0 if line.never else len(line.text) / max(1, line.tags) for line in lines])
    mean = sum(ratios) / len(ratios)
    least = THRESHOLD * math.sqrt(sum((x - mean) ** 2 for x in ratios) / len(ratios))
    cluster = [line for line, x in zip(lines, ratios, strict=True) if x >= least and not line.never] or content
    total, held, depth = sum(len(line.text) for line in cluster), Counter(), {}
    for line in cluster:
        for d, c in enumerate(line.containers):
            held[c] += len(line.text)
            depth[c] = d
    by_kind = [c for c in held if c in own and held[c] >= OWN_SHARE * total]
    return max(by_kind or [c for c in held if held[c] >= ANY_SHARE * total], key=lambda c: (depth[c], c))


def main_text(html: str | None) -> str:
    parser = Lines()
    for at in range(0, len(html or ""), SLICE):
        parser.feed(html[at : at + SLICE])
    parser.close()
    parser.border()
    chosen = region(parser.lines, parser.own)
    if chosen is None:
        return ""
    return "\n\n".join(line.text for line in parser.lines if not line.never and chosen in line.containers)


@F.pandas_udf(StringType())
def texts(html: pd.Series) -> pd.Series:
    return html.map(main_text).astype(object)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages``, and ``text`` with its number of code points ``n_chars``."""
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    kept = [named(c) for c in pages.columns if c.lower() not in ("text", "n_chars")]
    return pages.select(*kept, texts(named(html)).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


#: For pages whose main text is one ``article`` of headings and paragraphs, as the given tables have: cut by patterns, without
#: a parser. The five references that such pages hold in their text are decoded, ``&amp;`` last and also without its semicolon.
OP13_SQL = r"""
WITH inside AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*)</article>', 1, 's') AS body FROM pages),
blocks AS (
    SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:h1|p)>'), lambda b:
        trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', ' ', 'g'),
            '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS lines
    FROM inside)
SELECT page_id, url, array_to_string(list_filter(lines, lambda b: b <> ''), chr(10) || chr(10)) AS text,
       CAST(length(array_to_string(list_filter(lines, lambda b: b <> ''), chr(10) || chr(10))) AS BIGINT) AS n_chars
FROM blocks
"""
