"""Main text of web pages by the distribution of text over line blocks.

Mark-up is stripped, each block becomes a line, and text lengths are summed over sliding windows of
lines. Text lies between a surge of these sums and the dive after it; an article may have several
such stretches. A window counts the lines that the container of its middle line holds, so a line
beside the article doesn't rise with it. Headlines and short last lines would fall to the dive, so
the stretches are widened: to the text between them, and to the containers that hold nearly all of
one or of all of them. Elements that are never text (menus, forms, scripts, notices, comments) are
dropped before; no element is kept for its name.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriescope.llm.common import per_text

#: Lines of a window; share of the largest sum at which a surge begins and a dive ends.
LINES, SURGE = 3, 0.2
#: Share of the text that a container holds to be the article's.
NEARLY = 0.9

# Elements without article text, elements that end a line, elements without an end tag.
DROPPED = frozenset("head script style noscript template nav header footer aside form button select option textarea input label iframe object embed svg canvas audio video map menu dialog title".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCKS = frozenset("address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset("article main".split())
HEADLINES = frozenset("h1 h2 h3".split())
CONTAINERS = frozenset("article div main section td".split())
#: Words that, as the last but for details of form, make a name in class or id one of something else than the article.
_OTHER = re.compile(
    r"ad|ads|ad(?:box|slot|unit|banner|block|sense)|advert\w*|banner|breadcrumbs?|\w*comments?|cookie\w*|gdpr|consent|copyright|disclaimer|discussion|disqus|footer|footnav|form|header|legal|login|masthead|\w*menu|modal|\w*nav|navbar|navigation|newsletter|notice\w*|alert|pager|pagination|popup|promo\w*|related|recommend\w*|replies|reply|respond|responses|search|share|sharing|sidebar\w*|signup|skip|social|sponsor\w*|subscribe|tags|toolbar|topbar|widget\w*"
)
#: Words of form that may follow these.
_FORM = frozenset(
    "area articles author bar block body bottom box button buttons center col column container content control desktop dialog email entries facebook field fixed form group headline icon icons image img inline inner item items large left "
    "link links list main media mobile next overlay panel popup posts prev previous primary right row secondary section slot small sticky stories text thread title toggle top twitter unit wrap wrapper".split()
)
#: Words before them that make the name a statement on the layout or the topic: has-sidebar, no-ads, category-social.
_STATED = frozenset("has have no non not without with hide show category cat tag type format term status template layout".split())
#: Readers' comments often hold most of a page's text; other elements that do are taken for wrappers.
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:\w*comments?|discussion|disqus|replies|reply|respond|responses)(?:$|[\s_-])")
MOST, MOST_COMMENTS = 0.5, 0.9
#: Heads of articles, which hold their headlines.
_HEADLINE = re.compile(r"(?:^|\s)(?:article|entry|post|story|content)[_-]+(?:header|head|title)(?:$|\s)")
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/<>]*)([^<>]*)>", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")


@functools.lru_cache(4096)
def _names_other(names: str) -> bool:
    """Does one of the names of a class or id, as a whole, name something else than the article?"""
    for name in names.split():
        parts = [x for x in re.split("[_-]+", name) if x]
        at = max((i for i, x in enumerate(parts) if _OTHER.fullmatch(x)), default=-1)
        if at < 0 or not _STATED.isdisjoint(parts[:at]) or not all(x in _FORM or x[0].isdigit() for x in parts[at + 1 :]):
            continue
        # Columns side by side: content-sidebar, sidebar-content.
        if parts[at].startswith("sidebar") and "content" in parts[max(0, at - 1) : at + 2]:
            continue
        return True
    return False


def _kind(name: str, attrs: str, inside: bool) -> int:
    """0: an element may be part of the article; 1: it isn't; 2, 3: its class or id says that it
    isn't, 3 as comments. ``inside``: a marked article holds it."""
    if name in DROPPED:
        return int(not (name == "header" and inside))
    if name in ("html", "body") or not attrs.strip():
        return 0
    got = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTR.findall(attrs)}
    if "hidden" in got or got.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", got.get("style", "")):
        return 1
    if got.get("role", "") in _OTHER_ROLES:
        return 1
    names = [got.get(k, "") for k in ("class", "id")]
    if not any(map(_names_other, names)) or any(map(_HEADLINE.search, names)):
        return 0
    return 3 if any(map(_COMMENTS.search, names)) else 2


@dataclass
class _Named:
    """An element that its class or id names as another: what had been seen of the page when it
    began, and what it turned out to hold."""

    comments: bool
    size: int
    articles: int
    mains: int


@dataclass
class Line:
    """A block's text, the container that holds it (0: the page), how many of its characters are in
    links, and whether it is a headline."""

    text: str
    place: int
    linked: int
    headline: bool = False


@dataclass
class Page:
    """Lines in page order, and the container around each container, the page itself being 0. A
    container's number is larger than that of the one around it."""

    lines: list[Line]
    around: list[int]


def lines_of(html: str) -> Page:
    """The blocks that are kept.

    An element isn't dropped for its class or id if it is or holds the page's <main> or its only
    articles, or if it holds most of the text of a page that has no marked article elsewhere.
    """
    page, wrappers = _read(html, frozenset())
    return _read(html, wrappers)[0] if wrappers else page


def _read(html: str, wrappers: frozenset[int]) -> tuple[Page, frozenset[int]]:
    """The blocks outside dropped elements, ``wrappers`` (numbers of elements) excepted, and the
    elements that were dropped by their names but are wrappers. The time is linear in the page."""
    page = Page([], [0])
    text: list[str] = []
    stack: list[tuple[str, int, int]] = []
    opened: Counter = Counter()
    inside: list[int] = [0]
    open_named: dict[int, _Named] = {}
    held: dict[int, _Named] = {}
    hard = named = made = at = linked = seen = articles = mains = free = 0
    n = len(html)

    def end_line() -> None:
        nonlocal linked
        line = _SPACE.sub(" ", unescape("".join(text))).strip()
        text.clear()
        if line:
            page.lines.append(Line(line, inside[-1], linked, any(opened[x] for x in HEADLINES)))
        linked = 0

    def close(name: str) -> None:
        """End the innermost open element of that name and all within."""
        nonlocal hard, named
        while True:
            x, kind, k = stack.pop()
            opened[x] -= 1
            hard -= kind == 1
            named -= kind > 1
            if x in CONTAINERS:
                inside.pop()
            if kind > 1:
                began = open_named.pop(k)
                held[k] = _Named(began.comments, seen - began.size, articles - began.articles, mains - began.mains)
            if x == name:
                break

    while at < n:
        m = _TOKEN.search(html, at)
        if not hard:
            piece = html[at : m.start() if m else n]
            if opened["a"]:
                if not named:
                    linked += len(piece.strip())
            else:
                seen += len(piece.strip())
            if not named:
                text.append(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name in BLOCKS or name in DROPPED:
            end_line()
        if m[1] or m[4]:
            if opened[name]:
                close(name)
            continue
        attrs = m[3] or m[6] or ""
        if name in VOID or (attrs.endswith("/") and name not in BLOCKS):
            continue
        if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
            close(name)
        if name == "body" and opened["head"]:
            close("head")
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\b", re.I).search(html, at)
            at = html.find(">", stop.end()) + 1 if stop else 0
            if not at:
                break
            continue
        kind = _kind(name, attrs, bool(opened["article"] or opened["main"]))
        made += 1
        if kind > 1 and made in wrappers:
            kind = 0
        if kind > 1:
            open_named[made] = _Named(kind == 3, seen, articles, mains)
        stack.append((name, kind, made))
        opened[name] += 1
        hard += kind == 1
        named += kind > 1
        if name in CONTAINERS:
            page.around.append(inside[-1])
            inside.append(len(page.around) - 1)
        if name in ARTICLE and not hard:
            mains += name == "main"
            articles += kind != 3
            free += not named
    end_line()
    while stack:
        close(stack[-1][0])
    return page, frozenset(k for k, x in held.items() if _wraps(x, free > 0, seen))


def _wraps(x: _Named, free: bool, size: int) -> bool:
    """Is an element a wrapper of the article, whatever its name? ``free``: there is a marked article
    outside such elements."""
    if x.mains or (x.articles and not x.comments and not free):
        return True
    return x.size > (MOST_COMMENTS if x.comments else MOST) * size and (not free or (x.articles > 0 and not x.comments))


def _sums(page: Page, lines: int) -> list[int]:
    """For each line the characters outside links of the window around it, as far as the line's own
    container holds them."""
    last = _last_within(page.around)
    sizes, places = [max(0, len(x.text) - x.linked) for x in page.lines], [x.place for x in page.lines]
    reach = lines // 2
    return [sum(sizes[j] for j in range(max(0, i - reach), min(len(sizes), i + reach + 1)) if p <= places[j] <= last[p]) for i, p in enumerate(places)]


def _last_within(around: list[int]) -> list[int]:
    """The numbers of the containers within each container are from its own to this one."""
    last = list(range(len(around)))
    for k in range(len(around) - 1, 0, -1):
        last[around[k]] = max(last[around[k]], last[k])
    return last


def _is_links(line: Line) -> bool:
    return 2 * line.linked >= len(line.text)


def stretches(page: Page, lines: int = LINES, surge: float = SURGE) -> list[tuple[int, int]]:
    """First line and line after the last of each stretch of text: from the surge of the windowed sums
    to ``surge`` of the largest one up to the dive below it, or to a container beside the last line's.
    Lines of links at its ends that are in containers without other text of it don't belong to it:
    they are the ends of menus."""
    sums = _sums(page, lines)
    least = max(1, surge * max(sums, default=0))
    last = _last_within(page.around)
    found: list[list[int]] = []
    for i, x in enumerate(page.lines):
        if sums[i] >= least:
            low, high = sorted((x.place, page.lines[i - 1].place))
            if found and found[-1][1] == i and high <= last[low]:
                found[-1][1] = i + 1
            else:
                found.append([i, i + 1])
    out = []
    for i, j in found:
        places = {x.place for x in page.lines[i:j] if not _is_links(x)}
        ends = [k for k in range(i, j) if not _is_links(page.lines[k]) or page.lines[k].place in places]
        if ends:
            out.append((ends[0], ends[-1] + 1))
    return out


def _holder(page: Page, chosen: list[int]) -> int:
    """The innermost container that holds nearly all of the text of the ``chosen`` lines."""
    held = [0] * len(page.around)
    for i in chosen:
        held[page.lines[i].place] += len(page.lines[i].text)
    total = sum(held)
    for k in range(len(held) - 1, 0, -1):
        if held[k] >= NEARLY * total:
            return k
        held[page.around[k]] += held[k]
    return 0


def extract(html: str, lines: int = LINES, surge: float = SURGE) -> str:
    """The main text of a page; blocks are joined by a space.

    It is the stretches and what lies between them, the other lines of the containers that hold
    nearly all of a stretch or of all stretches, and headlines that stand directly before. Only the
    page's own lines count where no container but the page holds a stretch. Added lines aren't links.
    """
    page = lines_of(html)
    parts = stretches(page, lines, surge)
    if not parts:
        parts = [(0, len(page.lines))]
    kept = [False] * len(page.lines)
    for i, j in parts:
        kept[i:j] = [True] * (j - i)
    holders = {_holder(page, [k for i, j in parts for k in range(i, j)]), *(_holder(page, list(range(i, j))) for i, j in parts)}
    holds = [k in holders for k in range(len(page.around))]
    for k in range(1, len(holds)):
        holds[k] = holds[k] or (page.around[k] > 0 and holds[page.around[k]])
    for i, x in enumerate(page.lines):
        kept[i] = kept[i] or (not _is_links(x) and (parts[0][0] <= i < parts[-1][1] or holds[x.place]))
    for i in range(len(kept) - 2, -1, -1):
        kept[i] = kept[i] or (kept[i + 1] and page.lines[i].headline and not _is_links(page.lines[i]))
    return " ".join(x.text for x, k in zip(page.lines, kept, strict=True) if k)


def _extractor(lines: int, surge: float) -> Callable[[], Callable[[str], tuple[str, int]]]:
    def make() -> Callable[[str], tuple[str, int]]:
        def one(html: str) -> tuple[str, int]:
            text = extract(html, lines, surge)
            return text, len(text)

        return one

    return make


def extract_pages(pages: DataFrame, html: str = "html", id_col: str = "page_id", url: str = "url", lines: int = LINES, surge: float = SURGE) -> DataFrame:
    """One row (page_id, url, text, n_chars) for every row of ``pages``.

    A null or empty page has an empty text. Null ids and urls stay, repeated rows too; other columns
    aren't read; an empty table gives an empty result.
    """
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return per_text(source, "page_id long, url string, text string, n_chars long", _extractor(lines, surge), 2)
