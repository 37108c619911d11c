"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one per block element, in page order. Lines of menus, headers, footers, sidebars, notices,
adverts, forms and reader comments keep their place but weigh nothing; linked text weighs nothing in its line. Inside an
article (or main) element every character, linked ones too, weighs `IN_ARTICLE`, and what is set apart leaves no gap; the
element decides nothing else. Over the weights goes a window of `WINDOW` lines. A surge is a line at which the window sum
rises to `surge` from a line that weighs something; the text lasts to the dive, where the window sum is zero. Lines between
surges and dives are kept, linked paragraphs too, unless they are set apart.

A box is set apart by a whole name among its classes, id or role, alone or with words for boxes (ad-box, site-footer), but
not if it holds a heading or article and half of the page's text. A link ends with the element it began in, and with its
line if nothing closes it; an anchor without href is none.

Where no window reaches `surge`, as on pages of one short line, the region with the largest sum is kept.

Defined cases: null, empty and markup-only pages give an empty text; unfinished comments, scripts and tags end with the
page; repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 40
#: Weight of a character in an article element; outside it is 1.
IN_ARTICLE = 4

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?/>"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|object|select|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never the article's.
APART = frozenset("nav footer aside form header menu dialog button fieldset head figcaption".split())
#: Elements inside which an advert, a menu or comments are told by class, id or role.
BOXES = frozenset("div section ul ol p span table td li article details".split())
APART_NAMES = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|gdpr|popup|modal|newsletter"
    r"|subscribe|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side|widget|related|recommend\w*|share|sharing|social"
    r"|comments?|disqus|replies|reply|respond|footer|header|masthead|toolbar|pagination|pager|copyright|login|signup"
    r"|search|complementary|contentinfo|form",
    re.I,
)
#: What else the name of such an element may hold: a class like has-sidebar, search-results or entry-header is another thing.
BOX_NAMES = re.compile(
    r"\d+|box|wrap|wrapper|container|list|links?|items?|area|areas|section|block|blocks|bar|site|main|global|top|bottom|left"
    r"|right|primary|secondary|inner|outer|buttons?|posts|articles|stories|thread|unit|slot|widgets",
    re.I,
)
#: Readers' comments may hold most of a page and its headings.
COMMENTS = re.compile(r"comment|disqus|repl(?:y|ies)|respond", re.I)
MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
#: Where a line that is one link may be text; in list items and boxes it is an entry of a menu.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote".split())
#: An open paragraph ends where one of these begins.
ENDS_P = BLOCKS - {"br", "button", "option", "summary", "caption", "tbody", "thead", "tfoot", "td", "th", "tr"}


def names_apart(value: str) -> bool:
    """Whether one of the names in a class, id or role is that of an element set apart, alone or with words for boxes."""
    for name in value.split():
        parts = [x for x in re.split("[_-]+", name) if x]
        known = [bool(APART_NAMES.fullmatch(x)) for x in parts]
        if any(known) and all(k or BOX_NAMES.fullmatch(x) for k, x in zip(known, parts, strict=True)):
            return True
    return False


def _closed_links(tokens: list[re.Match]) -> set[int]:
    """Places of the links that are followed by </a> before another <a>."""
    closed, end = set(), False
    for i in range(len(tokens) - 1, -1, -1):
        if (tokens[i]["name"] or "").lower() == "a":
            if not tokens[i]["end"] and end:
                closed.add(i)
            end = bool(tokens[i]["end"])
    return closed


def page_lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, weight, in an article, set apart) per line: block-wise text, white space collapsed, references decoded."""
    # text, linked characters, if a paragraph, open articles, set apart by an element, open boxes set apart by their names
    lines: list[tuple[str, int, bool, tuple[int, ...], bool, tuple[int, ...]]] = []
    # open elements that matter: (name, sets its text apart, place of its tag if an article, and if apart by name)
    stack: list[tuple[str, bool, int | None, int | None]] = []
    pieces: list[str] = []
    linked = 0
    # open elements when the link began
    anchor: int | None = None
    # boxes set apart by name that may be wrappers, and those with a heading or an article in them
    boxes: set[int] = set()
    headed: set[int] = set()

    def close_line() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            articles = tuple(x[2] for x in stack if x[2] is not None)
            named = tuple(x[3] for x in stack if x[3] is not None)
            paragraph = bool(stack) and stack[-1][0] in PARAGRAPHS
            lines.append((text, linked, paragraph, articles, any(x[1] for x in stack), named))
        linked = 0

    tokens = list(TOKEN.finditer(page))
    closed = _closed_links(tokens)
    open_link = False
    for at, m in enumerate(tokens):
        text = m["text"]
        if text is not None:
            pieces.append(text)
            if anchor is not None:
                linked += len(text.strip())
            continue
        name = (m["name"] or m["raw"] or "").lower()
        if not name:
            continue
        if m["raw"]:
            continue
        attrs = m["attrs"] or ""
        if name == "a":
            # an anchor without href is no link
            anchor = len(stack) if not m["end"] and HREF.search(attrs) else None
            open_link = at in closed
            continue
        if name in BLOCKS:
            close_line()
            # a link that nothing closes ends with its line
            if not open_link:
                anchor = None
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        elif name not in VOID and not attrs.rstrip().endswith("/"):
            if name in ENDS_P and stack and stack[-1][0] == "p":
                stack.pop()
            inside = any(x[2] is not None for x in stack)
            off = (name in APART and not (name in ("header", "figcaption") and inside)) or bool(HIDDEN.search(attrs))
            marks = [x.strip("\"'") for x in MARKS.findall(attrs)] if name in BOXES and attrs and not off else []
            named = at if any(map(names_apart, marks)) else None
            if named is not None and not any(COMMENTS.search(x) for x in marks):
                boxes.add(at)
            if name in ("h1", "main", "article"):
                headed.update(x[3] for x in stack if x[3] is not None)
            if name in BLOCKS or off or named is not None:
                article = name in ("article", "main") and not off and named is None and not any(x[1] for x in stack)
                stack.append((name, off, at if article else None, named))
        # a link does not outlast the element it began in
        if anchor is not None and len(stack) < anchor:
            anchor = None
    close_line()
    return _weighed(lines, boxes & headed)


def _weighed(lines: list, boxes: set[int]) -> list[tuple[str, int, bool, bool]]:
    """Weights; of the boxes set apart by name, those that hold half of the page's text or more are its wrappers."""
    held: Counter = Counter()
    total = 0
    for text, _, _, _, off, named in lines:
        if not off:
            total += len(text)
            for box in named:
                held[box] += len(text)
    wrappers = {box for box in boxes if 2 * held[box] >= total}
    out = []
    for text, linked, paragraph, articles, off, named in lines:
        apart = [box for box in named if box not in wrappers]
        # an article inside of what is set apart is none
        inside = any(not apart or article < apart[0] for article in articles)
        weight = max(0, len(text) - linked)
        off = off or bool(apart) or not (inside or paragraph or weight)
        out.append((text, 0 if off else weight, inside, off))
    return out


def kept_regions(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """[start, end) between surge and dive; the heaviest region where nothing surges."""
    n = len(weights)
    sums = [sum(weights[i : i + window]) for i in range(n)]
    regions, start, top = [], None, 0
    for i in range(n + 1):
        if i < n and sums[i] > 0:
            if start is None and weights[i] > 0:
                start, top = i, 0
            if start is not None:
                top = max(top, sums[i])
        elif start is not None:
            regions.append((start, i, top))
            start = None
    strong = [(a, b) for a, b, t in regions if t >= surge]
    if strong or not regions:
        return strong
    a, b, _ = max(regions, key=lambda r: r[2])
    return [(a, b)]


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    # what interrupts a marked article leaves no gap in it, and links are part of its text
    lines = [x for x in page_lines(page or "") if not (x[2] and x[3])]
    lines = [(t, IN_ARTICLE * len(t) if inside else w, inside, off) for t, w, inside, off in lines]
    regions = kept_regions([w for _, w, _, _ in lines], window, surge)
    return " ".join(t for a, b in regions for t, _, _, off in lines[a:b] if not off)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(x) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts})

    schema = "page_id long, url string, text string"
    return (
        pages.select("page_id", "url", "html")
        .mapInPandas(run, schema)
        .withColumn("n_chars", F.length("text").cast("long"))
    )
