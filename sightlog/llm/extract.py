"""Main text of web pages from parser events, text-to-tag ratios and smoothed thresholds.

The standard-library parser streams events; blocks (lines) collect text and count tags. Regions that never hold
main text (menus, headers, footers, sidebars, forms, scripts, styles, notices, adverts, comments, named by element, by role or by a whole
token of class or id) are left out by their markup. Over the other lines the text-to-tag ratio is smoothed with a Gaussian, split by
two-means clustering at the midpoint of both centres, and the lines above it select their container: the innermost article, main or
body around them. A selected article or main is kept whole, so a short paragraph or heading in it is not lost. Without
one, the region from the first to the last line above the threshold is kept.

Defined cases: null or empty html gives the empty text; repeated rows one row each; unclosed tags end with their
container; truncated markup is plain text as far as the parser sees it; other columns are not read.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightlog.llm.common import map_batches, query, table

#: Elements by their role in a page.
SKIP_TAGS = frozenset("nav header footer aside form script style noscript template head title button select textarea iframe svg canvas object dialog menu".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_TAGS = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset(("article", "main"))
SIBLINGS = frozenset("li dt dd tr td th option".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert alertdialog dialog".split())
SKIP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion promotions banner banners cookie cookies consent gdpr notice notices "
    "popup modal newsletter subscribe nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars side aside header footer foot masthead toolbar comment comments disqus replies "
    "respond related share sharing social widget widgets pagination pager".split()
)
#: Words beside such a name that leave its meaning: a site-header is one, an entry-header, a share-price or has-sidebar is not.
NEUTRAL = frozenset("site page main global top bottom left right primary secondary wrapper wrap container box area section block list inner outer bar slot unit links buttons form message overlay list wide".split())
SPACE = re.compile(r"\s+")
SIGMA = 1.0


@functools.lru_cache(maxsize=4096)
def names_region(value: str) -> bool:
    """Whether a class or id names a region without main text: a token all of whose words are such names or neutral."""
    for token in value.lower().split():
        words = [w for w in re.split(r"[-_]+", token) if w]
        if any(w in SKIP_NAMES for w in words) and all(w in SKIP_NAMES or w in NEUTRAL for w in words):
            return True
    return False


class Blocks(HTMLParser):
    """Events to blocks: (text, number of tags, container number). Text of skipped regions is not collected."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int]] = []
        self.stack: list[tuple[str, bool, int]] = []  # tag, skipped region, container
        # places in the stack, so that no event walks it: by tag, of blocks, and of regions that end tags inside do not leave
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks_at: list[int] = []
        self.edges: list[int] = []
        self.parts: list[str] = []
        self.tags = 0
        self.skipped = 0
        self.container = 0  # 0: outside of article and main
        self.made = 0

    def flush(self):
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.blocks.append((text, self.tags, self.container))
        self.parts, self.tags = [], 0

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE_TAGS:
            self.flush()
            self._end_implied(tag)
        elif tag == "br":
            self.parts.append(" ")
        self.tags += not self.skipped
        if tag in VOID_TAGS:
            return
        skip = tag in SKIP_TAGS and not (tag == "header" and self.container) or self._named(tag, attrs)
        at = len(self.stack)
        self.stack.append((tag, skip, self.container))
        self.places[tag].append(at)
        if tag not in INLINE_TAGS:
            self.blocks_at.append(at)
        if skip or tag in CONTAINERS:
            self.edges.append(at)
        self.skipped += skip
        if tag in CONTAINERS and not self.skipped:
            self.made += 1
            self.container = self.made

    def handle_startendtag(self, tag, attrs):
        if tag in VOID_TAGS or tag not in INLINE_TAGS:
            self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and tag not in INLINE_TAGS:
            self.handle_endtag(tag)

    def _end_implied(self, tag):
        """A block ends an open paragraph; an item or cell ends its open sibling."""
        if self.blocks_at:
            at = self.blocks_at[-1]
            if self.stack[at][0] == "p" or self.stack[at][0] == tag and tag in SIBLINGS:
                self._pop(at)

    def _pop(self, at):
        for tag, skip, container in reversed(self.stack[at:]):
            self.skipped -= skip
            self.container = container
            self.places[tag].pop()
        del self.stack[at:]
        for places in (self.blocks_at, self.edges):
            while places and places[-1] >= at:
                places.pop()

    def _named(self, tag, attrs):
        if tag in ("html", "body", "article", "main"):
            return False
        found = dict(attrs)
        if (found.get("role") or "").lower() in SKIP_ROLES or "hidden" in found or (found.get("aria-hidden") or "").lower() == "true":
            return True
        return any(names_region(found.get(k) or "") for k in ("class", "id"))

    def handle_endtag(self, tag):
        self.tags += not self.skipped
        if tag not in INLINE_TAGS:
            self.flush()
        places = self.places.get(tag)
        if not places:
            return
        # an end tag inside a region ends nothing outside of it
        leaves = tag in ("body", "html") or tag in CONTAINERS or tag in SKIP_TAGS
        if self.edges and self.edges[-1] > places[-1] and not leaves:
            return
        self._pop(places[-1])

    def handle_data(self, data):
        if not self.skipped:
            self.parts.append(data)


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing with the kernel renormalised at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d, k in enumerate(kernel, i - reach):
            if 0 <= d < len(values):
                total += k * values[d]
                weight += k
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """Midpoint between the centres of two clusters; one value (or equal values) is a cluster of its own and passes."""
    low, high = min(values), max(values)
    if high - low <= 1e-9 * high:
        return low
    for _ in range(100):
        if not high > low:
            break
        mid = (low + high) / 2
        below = [v for v in values if v < mid]
        above = [v for v in values if v >= mid]
        new_low, new_high = sum(below) / len(below), sum(above) / len(above)
        if (new_low, new_high) == (low, high):
            break
        low, high = new_low, new_high
    return (low + high) / 2


def main_text(html: str | None) -> str:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    lines = parser.blocks
    if not lines:
        return ""
    ratios = smooth([len(text) / max(tags, 1) for text, tags, _ in lines])
    cut = threshold(ratios)
    above = [i for i, r in enumerate(ratios) if r >= cut] or [0]
    chosen = {container for (_, _, container), r in zip(lines, ratios, strict=True) if r >= cut and container}
    kept = [text for i, (text, _, container) in enumerate(lines) if (container in chosen if chosen else above[0] <= i <= above[-1])]
    return "\n\n".join(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row; the html stays in its row, so nothing is shuffled."""

    def run(ids, urls, htmls):
        texts = [main_text(h) for h in htmls]
        return [ids, urls, texts, [len(t) for t in texts]]

    return map_batches(pages.select(F.col("page_id").cast("long"), "url", "html"), "page_id long, url string, text string, n_chars long", run)


@query("op6_extract")
def op6_extract(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))
