"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block. A line's weight is the length of its text outside links; empty lines, of
weight 0, stand for what is never the article (menus, headers, footers, sidebars, notices, adverts, forms, reader comments)
and for jumps between divisions that lie several levels apart. Sums over sliding windows of ``window`` lines are the
distribution. It surges where it rises from 0 on its way above ``threshold``, and dives where it falls to 0 again, that is
before ``window`` lines without weight; the text is every line between a surge and its dive. A run that never exceeds the
threshold isn't text; on a page without any that does, half of the largest sum is the threshold, so short articles are found.

What markup says counts as weight. On a page with text in <article> or <main>, lines outside of them have none, and empty
lines inside count once however many follow each other. Names of classes and ids come in two sorts: some always mean what
they say (advert, cookie, comments, sidebar); others (social, related, header) are judged by what they hold: inside an
article such a block loses its weight if links make up half of it or it is short; elsewhere it counts a quarter, and nothing
if a quarter of it doesn't exceed the threshold. Names that only tell a state (no-sidebar, comments-open) mean nothing.

Defined results: null or empty html, or a page without text, gives an empty text with 0 characters; repeated rows are
extracted each; other columns are ignored. Character references are decoded; white space in a block (<br> too) is one
space; blocks are joined by two line feeds. A tag that never ends takes the rest of the page, as in browsers. Time is
proportional to a page's length.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import common
from rosterloom.llm.markup import CLOSED, attributes, tokens

WINDOW = 3
THRESHOLD = 86

# Elements that start a block, elements without content, elements and names of zones that aren't the article.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ZONES = frozenset("nav footer aside form button select dialog menu noscript template iframe object svg canvas audio video script style textarea head title xmp noembed".split())
ZONE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog toolbar status".split())
SURE = re.compile(
    r"ads?|advert\w*|adsense|breadcrumbs?|captcha|comments?|commentlist|consent|cookies?|copyright|disclaimer|disqus|footer|gdpr|login|menu|modal|nav|navbar|navigation|newsletter|notices?|notification|pagination|popup|"
    r"promo\w*|replies|respond|sidebar|signup|sponsor\w*|subscribe"
)
DOUBTFUL = re.compile(r"banner|header|masthead|overlay|pager|recommend\w*|related|share|sharing|social|tags|toc|toolbar|widgets?")
#: Parts of a class name by which it names a state, or a part of the article.
STATE = frozenset("no not has with without is open closed off on none hide hidden enabled disabled".split())
CONTENT = frozenset("entry post article story content body text".split())
DIVISIONS = frozenset("div section td".split())


def _zone_of(name: str, raw: str, in_article: bool) -> int:
    """0: no zone, 1: a doubtful one, 2: a sure one."""
    if name in ZONES:
        return 2
    if name == "header":
        return 0 if in_article else 2
    if not raw or name in ("html", "body", "article", "main", "p", "h1"):
        return 0
    a = attributes(raw)
    if a.get("role", "").lower() in ZONE_ROLES or "hidden" in a or a.get("aria-hidden") == "true":
        return 2
    found = 0
    for token in f"{a.get('class', '')} {a.get('id', '')}".lower().replace("side-bar", "sidebar").split():
        parts = re.split(r"[-_]+", token)
        if STATE.isdisjoint(parts):
            if any(map(SURE.fullmatch, parts)):
                return 2
            if CONTENT.isdisjoint(parts) and any(map(DOUBTFUL.fullmatch, parts)):
                found = 1
    return found


@dataclass
class Line:
    text: str
    length: int  # outside links
    article: bool
    gap: int  # empty lines before it
    doubt: int  # number of the doubtful zone it is in, or 0


def lines_of(html: str) -> list[Line]:
    """A line for each block; one without text for each sure zone."""
    out: list[Line] = []
    open_divisions: list[str] = []
    counts: Counter[str] = Counter()
    highest = 0  # fewest open divisions since the last line
    last_depth = 0
    parts: list[str] = []
    linked = link = 0
    zone, depth = "", 0
    doubt, doubt_name, doubt_depth, doubts = 0, "", 0, 0
    stack: list[str] = []

    def flush():
        nonlocal linked, highest, last_depth
        text = " ".join("".join(parts).split())
        if text:
            gap = max(0, max(last_depth - highest, len(open_divisions) - highest) - 1) if out else 0
            out.append(Line(text, max(0, len(text) - linked), bool(stack), gap, doubt))
            highest = last_depth = len(open_divisions)
        parts.clear()
        linked = 0

    for kind, name, raw in tokens(html):
        if zone:
            if kind == "open" and name in ("article", "main") and not stack:
                zone = ""  # a zone that was never closed
            elif kind == "open" and name == zone and name not in VOID and not raw.endswith(CLOSED):
                depth += 1
                continue
            elif kind == "close" and name == zone:
                depth -= 1
                if not depth:
                    zone = ""
                continue
            elif (kind == "close" and (name in ("body", "html") or stack and stack[-1] == name)) or (kind == "open" and name == "body"):
                zone = ""
            else:
                continue
        if kind == "text":
            text = html_lib.unescape(name)
            parts.append(text)
            linked += len(text.strip()) if link else 0
        elif kind == "open":
            verdict = _zone_of(name, raw, bool(stack)) if name not in VOID else 0
            if verdict == 2:
                flush()
                if not raw.endswith(CLOSED):
                    zone, depth, link = name, 1, 0
                out.append(Line("", 0, bool(stack), 0, 0))
                continue
            if name in BLOCKS or verdict:
                flush()
                link = 0
            if doubt and name in ("article", "main"):
                doubt = 0
            elif doubt and name == doubt_name:
                doubt_depth += 1
            elif verdict and not doubt and not raw.endswith(CLOSED):
                doubts += 1
                doubt, doubt_name, doubt_depth = doubts, name, 1
            if name == "br":
                parts.append(" ")
            elif name in ("article", "main"):
                stack.append(name)
            elif name in DIVISIONS:
                open_divisions.append(name)
                counts[name] += 1
            elif name == "a":
                link = 1
        else:
            if name == "a":
                link = 0
            elif name in BLOCKS or doubt and name == doubt_name:
                flush()
                link = 0
            if doubt and (name in ("body", "html") or name == doubt_name):
                doubt_depth -= 1
                if name != doubt_name or not doubt_depth:
                    doubt = 0
            if name in ("article", "main") and name in stack:
                while stack.pop() != name:
                    pass
            elif counts[name]:
                while (popped := open_divisions.pop()) != name:
                    counts[popped] -= 1
                counts[name] -= 1
                highest = min(highest, len(open_divisions))
    flush()
    return out


def _weights(lines: list[Line], threshold: int) -> list[float]:
    """Each line's weight; 0 for lines that are never text."""
    plain, whole = Counter(), Counter()
    for x in lines:
        if x.doubt:
            plain[x.doubt] += x.length
            whole[x.doubt] += len(x.text)

    def doubtful(x: Line) -> float:
        held = plain[x.doubt]
        if x.article:
            return 0.0 if 2 * held <= whole[x.doubt] or 2 * held <= threshold else 1.0
        return 0.25 if held > 4 * threshold else 0.0

    inside = any(x.article and x.length and (not x.doubt or doubtful(x)) for x in lines)
    return [0.0 if inside and not x.article else x.length * (doubtful(x) if x.doubt else 1.0) for x in lines]


def main_text(html: str | None, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    lines = lines_of(html or "")
    weights = _weights(lines, threshold)
    inside = any(w and x.article for w, x in zip(weights, lines, strict=True))
    # the page's lines with empty ones between them: (weight, number of the line or -1)
    page: list[tuple[float, int]] = []
    for i, (x, w) in enumerate(zip(lines, weights, strict=True)):
        if not inside:
            page.extend([(0.0, -1)] * min(x.gap, window))
        kept = x.text and (w or not x.length and not x.doubt) and (x.article or not inside)
        if inside and x.article and not kept and page and not page[-1][0] and page[-1][1] < 0:
            continue  # empty lines inside an article count once
        page.append((w, i if kept else -1))
    sums, total = [0.0] * len(page), 0.0
    for i in range(len(page) - 1, -1, -1):
        total += page[i][0] - (page[i + window][0] if i + window < len(page) else 0.0)
        sums[i] = total
    level = max(sums, default=0.0)
    level = threshold if level > threshold else level / 2
    chosen: list[str] = []
    at = 0
    while at < len(page):
        surge = at
        while at < len(page) and sums[at] > 1e-6:
            at += 1
        if at > surge and max(sums[surge:at]) > level:
            chosen += [lines[i].text for _, i in page[surge:at] if i >= 0]
        at = max(at, surge + 1)
    return "\n\n".join(chosen)


def extract(pages: DataFrame, *, window: int = WINDOW, threshold: int = THRESHOLD) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text = [main_text(h, window, threshold) for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": text, "n_chars": [len(t) for t in text]})

    common.ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), F.col("url").cast("string"), "html")
    out = rows.mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages"))
