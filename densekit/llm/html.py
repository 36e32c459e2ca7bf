"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page as events. Block elements part it into lines; each has
its text, the number of tags met in it, and the element it stands in. A line's text-to-tag ratio is its
characters per tag. Ratios are smoothed by a Gaussian over neighbouring lines and cut at their standard
deviation (at the mean where that is lower): the lines above are seeds. They select content regions: the
`article` or `main` elements that hold seeds, or the stretch of what stands in none, from its first seed to its
last with the heading before it; whichever has more smoothed ratio in its seeds. A region's short lines count as
well, so that one-word paragraphs stay.

Text within elements that are never content (menus, forms, notices, adverts, comments ...: by tag, role,
class or id) is no line and no seed. Such an element ends where an `article` or `main` begins, as
pages forget to close elements. A class or id bars block elements only, and none that holds most of the page's seeds and of their text, counted with
what classes and ids bar; readers' words and links to other pages (`OTHERS`) may be longer than the page's own and
are freed only if no seed is left without them. A name after `with`, `no` ... tells of the page, not of the element. A class or id that says
something else as well (`related-work`, `share-price`) bars an element only if its ratios are low: if no more than half of its lines are seeds.

Character references are decoded, white space within a line becomes one space, `br` counts as white space.

Defined cases: a null or empty page gives the empty text, as does one without any content; text without
tags is one line and its own content; repeated rows give repeated results; an empty table gives an empty
result; an input column named like the output is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
    .split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NEVER = set(
    "head script style noscript template iframe object svg math canvas audio video map nav footer aside form button select"
    " textarea menu dialog fieldset title".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
REGIONS = {"article", "main"}
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies"
    " consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login nav navbar"
    " navigation menu breadcrumb breadcrumbs pagination sidebar footer masthead comment comments disqus respond reply replies"
    " related recommended promoted advertorial share sharing social widget toolbar skip".split()
)
OTHERS = set("comment comments disqus respond reply replies related recommended promoted".split())
READERS = set("comment comments disqus respond reply replies".split())
ABOUT = set("with without no has have".split())
#: Words that say where or in what form a named thing stands, and nothing about its content
FORMS = set(
    "area article articles bar blog body bottom box btn button buttons block card center column container content footer form global group"
    " header holder icon icons inner label layout left link links list main media module news outer page panel post posts primary reader"
    " right row section secondary side site slot space stories story text title to top topics unit user wide wrap wrapper".split()
)
SIGMA, RADIUS = 1.0, 2
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(RADIUS + 1)]


class Lines(HTMLParser):
    """The lines of a page: [text parts, tags, number of the region or 0, is it a heading]; a part is (text, the
    innermost element around it that its class or id bars, or 0)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.open: list[tuple[str, bool, int]] = []  # (tag, never content, number if barred by name)
        self.barred = 0  # open elements that are never content
        self.named = 0  # the innermost open element barred by name
        self.around = [0]  # of each element barred by name, the one around it
        self.others = [False]  # ... and is it of `OTHERS`
        self.weak = [False]  # ... and do its names say something else as well
        self.count: Counter[str] = Counter()  # open elements by tag
        self.region: list[int] = []
        self.regions = 0
        self._new_line("")

    def _new_line(self, tag: str) -> None:
        self.lines.append([[], 1, self.region[-1] if self.region else 0, tag in HEADINGS])

    def _barred(self, tag: str, attrs: list) -> tuple[bool, set[str], bool]:
        """Is the element never content; the names that bar it otherwise; and do they say something else as well."""
        if tag in NEVER:
            return True, set(), False
        if tag in REGIONS and not self.regions or tag in ("body", "html"):
            return False, set(), False
        if tag == "header" and not self.region:
            return True, set(), False
        names, weak = set(), True
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True, set(), False
            if name == "role" and value and value.lower() in ROLES:
                return True, set(), False
            if name in ("class", "id") and value and tag in BLOCKS:
                for one in value.split():
                    words = [w.lower() for w in _PARTS.findall(one)]
                    told = {w for before, w in zip(["", *words], words) if before not in ABOUT}
                    found = told & NAMES
                    if "header" in told and not self.region:
                        found.add("header")
                    if found and (found & READERS or told <= NAMES | FORMS):
                        weak = False
                    names |= found
        return False, names, weak

    def _pop(self, upto: int) -> None:
        for tag, barred, named in reversed(self.open[upto:]):
            self.count[tag] -= 1
            self.barred -= barred
            if named:
                self.named = self.around[named]
            if tag in REGIONS and self.region:
                self.region.pop()
        del self.open[upto:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.lines[-1][1] += 1
        if tag == "br":
            self.lines[-1][0].append((" ", 0))
        if tag in VOID:
            if tag == "hr":
                self._new_line("")
            return
        if tag in REGIONS and (self.barred or self.named) and not self.regions:
            self._pop(next(i for i, (_, barred, named) in enumerate(self.open) if barred or named))
        if tag in CLOSED_BY or tag in BLOCKS:
            # an open p ends where a block begins; an li, a cell ... where the next one does
            closes = CLOSED_BY.get(tag, set()) | {"p"}
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in closes:
                    self._pop(i)
                    break
                if self.open[i][0] in BLOCKS:
                    break
        barred, names, weak = self._barred(tag, attrs)
        if tag in BLOCKS or barred or names:
            if names:
                self.around.append(self.named)
                self.others.append(bool(names & OTHERS))
                self.weak.append(weak)
                self.named = len(self.around) - 1
            self.open.append((tag, barred, self.named if names else 0))
            self.count[tag] += 1
            self.barred += barred
            if tag in REGIONS:
                if not self.region:
                    self.regions += 1
                self.region.append(self.regions)
            if tag in BLOCKS:
                self._new_line(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do: only void elements end here

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1][1] += 1
        for i in range(len(self.open) - 1, -1, -1) if self.count[tag] else ():
            if self.open[i][0] == tag:
                self._pop(i)
                break
            if tag not in BLOCKS and self.open[i][0] in REGIONS:
                break
        if tag in BLOCKS:
            self._new_line("")

    def handle_data(self, data: str) -> None:
        if not self.barred:
            self.lines[-1][0].append((data, self.named))


def smooth(values: list[float]) -> list[float]:
    """Gaussian mean over the neighbours; at the ends over those that exist."""
    n, out = len(values), []
    for i in range(n):
        total = weight = 0.0
        for j in range(max(0, i - RADIUS), min(n, i + RADIUS + 1)):
            w = _KERNEL[abs(i - j)]
            total += w * values[j]
            weight += w
        out.append(total / weight)
    return out


def _lines(parser: Lines, free: list[bool]) -> list[tuple[str, int, int, bool, list]]:
    """The lines with text in no element that its name bars, unless it is free."""
    lines = []
    for parts, tags, region, heading in parser.lines:
        text = " ".join("".join(part for part, named in parts if free[named]).split())
        if text:
            lines.append((text, tags, region, heading, parts))
    return lines


def _seeds(lines: list) -> tuple[list[float], list[int]]:
    """Smoothed ratios, and the places of those above the cut."""
    ratios = smooth([len(line[0]) / line[1] for line in lines])
    mean = sum(ratios) / len(ratios)
    cut = min(mean, math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)))
    return ratios, [i for i, r in enumerate(ratios) if r >= cut]


def _freed(parser: Lines) -> list[bool]:
    """Of each element barred by name (and 0, none): is text in it content, as it and those around it hold most of the page."""
    around, n = parser.around, len(parser.around)
    free = [True] + [False] * (n - 1)
    lines = _lines(parser, [True] * n) if n > 1 else []
    if not lines:
        return free
    alone = [0] * n  # characters of seeds in an element and in none within it
    rows, of_all = [0] * n, [0] * n  # seeds, lines
    chief = [max(line[4], key=lambda p: len(p[0].strip()))[1] for line in lines]  # the element most of a line is in
    for k in chief:
        of_all[k] += 1
    for i in _seeds(lines)[1]:
        for part, named in lines[i][4]:
            alone[named] += len(part.strip())
        rows[chief[i]] += 1
    held = list(alone)
    for k in range(n - 1, 0, -1):
        for sums in (held, rows, of_all):
            sums[around[k]] += sums[k]

    def judged(others: bool) -> list[bool]:
        found = list(free)
        for k in range(1, n):
            most = 2 * held[k] > held[0] and 2 * rows[k] > rows[0] and (others or not parser.others[k])
            found[k] = found[around[k]] and (most or (parser.weak[k] and 2 * rows[k] > of_all[k]))
        return found

    strict = judged(False)
    return strict if any(a for a, is_free in zip(alone, strict) if is_free) else judged(True)


def main_text(page: str) -> str:
    parser = Lines()
    parser.feed(page)
    parser.close()
    lines = _lines(parser, _freed(parser))
    if not lines:
        return ""
    ratios, seeds = _seeds(lines)
    mass = {True: 0.0, False: 0.0}  # of seeds within regions and elsewhere
    for i in seeds:
        mass[lines[i][2] > 0] += ratios[i]
    if mass[True] and mass[True] >= mass[False]:
        regions = {lines[i][2] for i in seeds} - {0}
        return "\n".join(line[0] for line in lines if line[2] in regions)
    bare = [i for i in seeds if not lines[i][2]]
    first, last = bare[0], bare[-1]
    while first and lines[first - 1][3] and not lines[first - 1][2]:
        first -= 1
    return "\n".join(line[0] for line in lines[first : last + 1] if not line[2])


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """`pages` with the main text of the whole page."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(page.as_py() or "") for page in batch], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return pages.withColumn(text, F.arrow_udf(run, "string")(F.col(html)))
