"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page.  A line weighs as much as its text, or nothing
if it stands in a menu, header, footer, sidebar, notice, advert, form or among comments, or is mostly links.  Weights
are summed over sliding windows of lines; the text starts where the sum surges and ends where it dives to nothing.  It is then
widened to the element that holds it: all lines with weight there, and between them paragraphs of links.
Where a page marks its article (``article``, else ``main``), lines outside weigh nothing and any weight is a surge, unless
what it marks are cards or teasers beside a longer text.  Elements hidden by an attribute are no text for a reader.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80
TEXT = "page_id long, url string, text string, n_chars long"

# Elements by what they mean for a reader, and words of class and id that mark what is not the article.
DROPPED = frozenset("nav header footer aside form menu dialog button select noscript template iframe svg object canvas audio video".split())
RAW = frozenset("script style textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_ITSELF = frozenset("p li dt dd tr td th option".split())
HOLDERS = frozenset("ul ol dl table".split())
NOT_TEXT = frozenset(
    "ad ads advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " disclaimer discussion disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices"
    " notification overlay pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar"
    " signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
# Words that mean noise whatever stands beside them: 'user-comments', 'ad-300x250', 'google_ads_1'.
PLAIN = frozenset(
    "ad ads advert advertisement adverts advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr"
    " masthead nav navbar navigation newsletter pager pagination popup sidebar signup sponsor sponsored subscribe subscription".split()
)
# Words that tell of a state or a subject, so that the token names nothing: 'has-sidebar', 'comments-open', 'category-ads'.
STATES = frozenset("category closed disabled enabled fixed format free has hoc is no not open status tag theme topic type with without".split())
# Words that leave what a class or id names as it is, for the other words: 'share-links' are noise, 'share-prices' are none.
PLACES = frozenset(
    "area article articles bar block blog body bottom box button buttons card cards container content entry form global group inline inner"
    " item items left link links list local lower main outer page pages panel post posts primary right row secondary section site slot"
    " sticky stories top unit upper wrap wrapper".split()
)
COMMENTS = frozenset("comment comments discussion disqus replies reply respond".split())
TITLES = frozenset("disclaimer discussion notice notices related replies reply respond share sharing".split())  # ids of chapters, too
BLOCKS_OF_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
# All that an article may be other than the text.
ADVERTS = frozenset("ad ads advert advertisement adverts advertising promo promoted promotion sponsor sponsored".split())
ANSWERS = frozenset("comment comments related reply replies".split()) | ADVERTS
UNMARKED = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
REGIONS = {"main": 1, "article": 2}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)",
    re.S,
)
MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


def names(token: str) -> set[str]:
    """The marks that a whole class or id names; none if another word makes something else of them."""
    words = set(re.split(r"[^a-z]+", token.lower())) - {""}
    found = words & NOT_TEXT
    return found if found and not words & STATES and (found & PLAIN or not words - NOT_TEXT - PLACES) else set()


def marks_of(name: str, attributes: str, inside: bool = False) -> set[str]:
    """What an element's class, id or role says that it is other than the article; ``inside`` an article, ids may be of chapters."""
    found: set[str] = set()
    if not attributes or name in UNMARKED:
        return found
    for kind, *values in MARKS.findall(attributes):
        value, kind = "".join(values), kind.lower()
        if kind == "role":
            found |= ROLES.intersection(re.split(r"[^a-z]+", value.lower()))
            continue
        for token in value.split():
            found |= names(token) - (TITLES if kind == "id" and inside and name == "section" else set())
    return found & ANSWERS if name == "article" else found


def is_hidden(name: str, attributes: str) -> bool:
    return bool(attributes) and name not in ("html", "body", "main") and bool(HIDDEN.search(attributes))


def wrappers(page: str) -> set[int]:
    """Where elements begin that hold more than half of the page's text under a mark that names no noise for certain."""
    opened: dict[str, list[tuple[int, int, bool]]] = {}
    held: list[tuple[int, int]] = []
    at = total = 0
    for found in TOKEN.finditer(page):
        total += len(page[at : found.start()].strip())
        at, name = found.end(), (found[2] or "").lower()
        if not name or name in INLINE or name in VOID:
            continue
        if not found[1]:
            marks = marks_of(name, found[3])
            opened.setdefault(name, []).append((found.start(), total, bool(marks) and not marks & (PLAIN | COMMENTS)))
        elif opened.get(name):
            start, before, marked = opened[name].pop()
            if marked:
                held.append((start, total - before))
    return {start for start, size in held if 2 * size > total}


class Tree:
    """The block elements of a page in the order in which they begin, each with what holds it."""

    def __init__(self):
        self.names, self.above, self.open, self.count = [""], [0], [0], {}

    def _pop(self) -> None:
        self.count[self.names[self.open.pop()]] -= 1

    def begin(self, name: str) -> None:
        top = self.names[self.open[-1]]
        if top == "p" or top == name and name in ENDS_ITSELF:  # its end tag was left out
            self._pop()
        self.names.append(name)
        self.above.append(self.open[-1])
        self.open.append(len(self.names) - 1)
        self.count[name] = self.count.get(name, 0) + 1

    def end(self, name: str) -> None:
        if self.count.get(name):
            while self.names[self.open[-1]] != name:
                self._pop()
            self._pop()

    def holder(self, nodes: list[int]) -> int:
        """The element that holds all of ``nodes``: itself one of them only if it has other elements."""
        low, high = min(nodes), max(nodes)
        while low != high:  # what begins later is climbed from
            if low < high:
                high = self.above[high]
            else:
                low = self.above[low]
        return self.above[low] if len(set(nodes)) == 1 else low

    def within(self, holder: int) -> list[bool]:
        found = [False] * len(self.names)
        found[holder] = True
        for node in range(holder + 1, len(found)):
            found[node] = found[self.above[node]]
        return found


def lines_of(page: str, marks: bool = True, spared: frozenset[int] | set[int] = frozenset()) -> tuple[list[tuple[str, int, int, int]], Tree, bool]:
    """(text, characters outside links, region, element) of each block of a page that is not noise; noise is an empty line.

    Class, id and role say nothing without ``marks`` and at the places ``spared``.  Also: whether more text was left out by
    them than kept.
    """
    lines: list[tuple[str, int, int, int]] = []
    tree = Tree()
    parts: list[str] = []
    linked = region_1 = region_2 = links = 0
    skipped, depth, by_mark = "", 0, False
    at, lowered, left_out, kept = 0, None, 0, 0
    is_noise = lambda: is_hidden(name, found[3]) or (
        marks and found.start() not in spared and bool(marks_of(name, found[3], region_1 + region_2 > 0)))

    def end_line() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                lines.append((text, max(0, len(text) - linked), 2 if region_2 else 1 if region_1 else 0, tree.open[-1]))
        parts.clear()
        linked = 0

    while at < len(page):
        found = TOKEN.search(page, at)
        start = found.start() if found else len(page)
        if skipped and by_mark:
            left_out += start - at
        if start > at and not skipped:
            kept += start - at
            parts.append(page[at:start])
            if links:
                linked += len(page[at:start].strip())
        if not found:
            break
        at, name = found.end(), (found[2] or "").lower()
        if not name:
            continue
        closing = bool(found[1])
        if skipped and not closing and by_mark and name in REGIONS and not is_noise():
            skipped = ""
        if skipped:
            if skipped == "p":  # its end tag may be left out: any block ends it
                if name not in INLINE and (closing or name not in VOID):
                    skipped = ""
                    if closing and name == "p":
                        continue
            elif skipped in ENDS_ITSELF:  # the next of its kind ends it too, or the end of what holds it
                if name in HOLDERS:
                    depth += -1 if closing else 1
                if not depth or depth == 1 and name == skipped:
                    skipped = ""
                    if closing and depth:
                        continue
            elif name == skipped:
                depth += -1 if closing else 1
                if not depth:
                    skipped = ""
                    continue
            if skipped:
                if not closing and name in RAW:
                    lowered = lowered or page.lower()
                    end = lowered.find(f"</{name}", at)
                    at = len(page) if end < 0 else end
                continue
        if name not in INLINE:
            end_line()
        if closing:
            if name == "a":
                links = max(0, links - 1)
            elif name == "article":
                region_2 = max(0, region_2 - 1)
            elif name == "main":
                region_1 = max(0, region_1 - 1)
            if name not in INLINE:
                tree.end(name)
            continue
        if name == "br":
            parts.append(" ")
        if name in VOID:
            continue
        if name in RAW:
            lowered = lowered or page.lower()
            end = lowered.find(f"</{name}", at)
            at = len(page) if end < 0 else end
            continue
        marked = is_noise()
        if name in DROPPED or marked:
            lowered = lowered or page.lower()
            if name in ENDS_ITSELF or lowered.find(f"</{name}", at) >= 0:
                if name in INLINE:
                    end_line()
                lines.append(("", 0, 0, 0))
                skipped, depth, by_mark = name, 1, name == "form" or marked and name not in DROPPED
            continue
        if name not in INLINE:
            tree.begin(name)
        if name == "a":
            links += 1
        elif name == "article":
            region_2 += 1
        elif name == "main":
            region_1 += 1
    end_line()
    return lines, tree, left_out > kept


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The blocks between surge and dive of the line-block distribution, joined by line ends; empty if none."""
    if not page:
        return ""
    lines, tree, doubtful = lines_of(page)
    if doubtful and (spared := wrappers(page)):
        lines, tree, _ = lines_of(page, spared=spared)
    # If nothing but noise is found, the marks were wrong.
    return text_of(lines, tree, window, surge) or text_of(*lines_of(page, marks=False)[:2], window, surge)


def marked_region(lines: list[tuple[str, int, int, int]], tree: Tree, window: int, surge: int) -> list[str] | None:
    """The blocks of the articles, or of ``main`` without them if they are cards in it; None if the page marks neither, or only teasers.

    Articles win if they hold at least half of the text of ``main``, or a third of what surge and dive find outside and inside them.
    """
    weight = lambda test: sum(n for _, n, r, _ in lines if test(r))
    inside = weight(lambda r: r == 2)
    if any(r == 1 for *_, r, _ in lines) and (not inside or weight(lambda r: r == 1) > inside):
        return [text for text, _, r, _ in lines if text and r == 1]
    if not any(r == 2 for *_, r, _ in lines):
        return None
    if not any(r == 1 for *_, r, _ in lines):
        rest = [(text, n, 0, node) if not r else ("", 0, 0, 0) for text, n, r, node in lines]
        if weight(lambda r: not r) > inside and sum(map(len, blocks_of(rest, tree, window, surge))) > max(2 * inside, surge):
            return None
    return [text for text, _, r, _ in lines if text and r == 2]


def text_of(lines: list[tuple[str, int, int, int]], tree: Tree, window: int, surge: int) -> str:
    found = marked_region(lines, tree, window, surge)
    if found is None:
        found = blocks_of([(text, n, 0, node) if not r else ("", 0, 0, 0) for text, n, r, node in lines], tree, window, surge)
    return "\n".join(found)


def blocks_of(lines: list[tuple[str, int, int, int]], tree: Tree, window: int, surge: int) -> list[str]:
    """The blocks between surge and dive, widened to their element."""
    weights = [n if 2 * n >= len(text) else 0 for text, n, _, _ in lines]
    sums, total = [0] * len(lines), 0
    for i in range(len(lines) - 1, -1, -1):
        total += weights[i] - (weights[i + window] if i + window < len(lines) else 0)
        sums[i] = total
    kept, inside = [], False
    for i in range(len(lines)):
        inside = sums[i] > (0 if inside else surge)
        if inside and weights[i]:
            kept.append(i)
    if kept:
        within = tree.within(tree.holder([lines[i][3] for i in kept]))
        kept = [i for i, weight in enumerate(weights) if weight and within[lines[i][3]]]
    else:  # a page too short for any surge
        kept = [i for i, weight in enumerate(weights) if weight]
        within = [True] * len(tree.names)
    linked = [
        i for i in range(kept[0], kept[-1]) if lines[i][0] and not weights[i] and within[node := lines[i][3]]
        and (lines[i][1] or tree.names[node] in BLOCKS_OF_TEXT)
    ] if kept else []
    return [lines[i][0] for i in sorted(kept + linked)]


def _extract(batches):
    for batch in batches:
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html; other columns are ignored).

    White space inside a block becomes one space, blocks are joined by one line end, nothing is cut.  A null, empty or
    text-free page gives an empty text; null ids and urls are passed on; repeated rows stay; an empty table gives an
    empty result.  Rows are independent: nothing is shuffled.
    """
    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"]
    return pages.select(*columns).mapInArrow(_extract, TEXT)
