"""Text lines of a web page: one pass over the markup, with what the markup itself says about each line.

``page_lines`` keeps block elements on a stack; inline elements do not part lines. Start tags close open paragraphs and list items as browsers do,
end tags close the nearest element of their name, other end tags are ignored. Scripts, styles and comments end where browsers end them; one that
never ends takes the rest of the page.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: Kinds of lines, as bits.
CHROME, ARTICLE, LINK, HEADING = 1, 2, 4, 8

_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)|<[!?/][^>]*+>""", re.S)
_CUT = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in ("script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "svg", "select", "object")}

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr br picture source audio video track embed input param area base link meta col button".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that hold lines themselves; the others are boxes.
_HOLDERS = _HEADINGS | frozenset("p li dt dd td th tr pre blockquote figcaption caption summary address option legend tbody thead tfoot table ul ol dl figure".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu "
    "nav ol p pre search section summary table ul".split())
_ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "div", "nav"}), "dt": ({"dt", "dd"}, {"dl", "div"}), "dd": ({"dt", "dd"}, {"dl", "div"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"datalist"}),
}
_CHROME_TAGS = frozenset("nav footer aside form dialog menu search fieldset button head datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tooltip status".split())
_CHROME_NAMES = frozenset(
    "nav navbar navigation navi menu menus breadcrumb breadcrumbs crumbs header masthead banner topbar toolbar footer foot sidebar sidebars aside rail widget widgets ad "
    "ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promos promotion cookie cookies consent gdpr notice notices notification "
    "notifications alert popup modal overlay newsletter subscribe subscription signup login signin search searchbox form share sharing social related recommended "
    "recommendations teaser teasers comment comments commentlist disqus respond reply replies discussion feedback pagination pager copyright legal skip".split())
_COMMENT_NAMES = frozenset("comment comments reply replies".split())
_NEGATED = frozenset("no non without has with".split())
_MAIN_NAMES = frozenset(
    "content maincontent main-content main article article-body articlebody article-content article-text post post-body post-content post-text entry entry-content "
    "story story-body body-text page-content text".split())


class Line(NamedTuple):
    text: str
    kind: int
    box: int


class _Open(NamedTuple):
    name: str
    kind: int
    box: int
    header: bool
    article: bool


def _names(value: str) -> set[str]:
    return {x.lower() for x in _NAME.findall(value)}


def _mark(name: str, attributes: str, above: _Open) -> tuple[int, bool]:
    """(kind, whether only headings stay) of an element below ``above``."""
    kind, header = above.kind, above.header
    chrome, article, top = name in _CHROME_TAGS, name in ("article", "main"), name in ("html", "body")
    head = name == "header"
    nested = name == "article" and above.article  # what an article holds as articles are comments and teasers
    if attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next((v for v in values if v), "")
            if key in ("class", "id") and not top:
                names = _names(html.unescape(value))
                if names & _NEGATED:
                    continue
                if name in ("article", "main"):
                    chrome |= bool(names & _COMMENT_NAMES)
                elif names & {"header", "masthead"} and kind & ARTICLE:
                    head = True
                elif names & _CHROME_NAMES:
                    chrome = True
                elif not _MAIN_NAMES.isdisjoint(value.lower().split()):
                    article = True
            elif key == "role":
                chrome |= value.lower() in _ROLES
                article |= value.lower() in ("main", "article")
            elif key == "itemprop" and value.lower() == "articlebody":
                article = True
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                chrome = not top
    if chrome or nested:
        return kind | CHROME, header
    if head:
        return (kind, True) if kind & ARTICLE else (kind | CHROME, header)
    if article:  # a mark of its own counts for more than an element left open around it
        return (kind & ~CHROME if name in ("article", "main") and not kind & ARTICLE else kind) | ARTICLE, header
    return kind, header


def page_lines(page: str) -> list[Line]:
    """Lines in page order: text with white space as single spaces, kind bits, and the number of the box that holds it."""
    lines: list[Line] = []
    stack = [_Open("", 0, 0, False, False)]
    boxes = 1
    text: list[str] = []
    linked = plain = 0
    link_depth = 0

    def flush() -> None:
        nonlocal linked, plain
        if text:
            line = " ".join("".join(text).split())
            if line:
                top = stack[-1]
                heading = any(x.name in _HEADINGS for x in stack[-2:])
                kind = top.kind | (LINK if linked and not plain else 0) | (HEADING if heading else 0)
                lines.append(Line(line, kind | CHROME if top.header and not heading else kind, top.box))
            text.clear()
        linked = plain = 0

    def close(names: set[str] | frozenset[str], until: set[str]) -> None:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].name in names:
                del stack[at:]
                return
            if stack[at].name in until:
                return

    def say(piece: str) -> None:
        nonlocal linked, plain
        if piece:
            text.append(html.unescape(piece) if "&" in piece else piece)
            if not piece.isspace():
                if link_depth:
                    linked += 1
                else:
                    plain += 1

    at, n = 0, len(page)
    while at < n:
        found = _TAG.search(page, at)
        if found is None:
            cut = _CUT.search(page, at)  # a tag cut off at the end of the page
            say(page[at:cut.start() if cut else n])
            break
        say(page[at:found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            if name == "a":
                link_depth = max(0, link_depth - 1)
            elif name == "p" and not any(x.name == "p" for x in stack[-3:]) or name == "br":
                flush() if name == "p" else text.append(" ")
            elif name not in _INLINE:
                flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        del stack[k:]
                        break
            continue
        if name in _RAW:
            end = _RAW[name].search(page, at)
            at = end.end() if end else n
            continue
        if name in _INLINE:
            if name == "a":
                link_depth = 1
            elif name == "br":
                text.append(" ")
            elif name == "button":
                end = re.compile(r"</button(?=[\s/>])[^>]*+>", re.I).search(page, at)
                at = end.end() if end else at
            continue
        flush()
        if name in _CLOSES_P and stack[-1].name == "p":
            del stack[-1:]
        if name in _ENDED_BY:
            close(*_ENDED_BY[name])
        if name in _HEADINGS and stack[-1].name in _HEADINGS:
            del stack[-1:]
        if name == "hr":
            continue
        if name == "body":
            close({"head"}, set())
        above = stack[-1]
        kind, header = _mark(name, found[3][:-1], above)
        box = above.box
        if name not in _HOLDERS:
            box, boxes = boxes, boxes + 1
            link_depth = 0
        stack.append(_Open(name, kind, box, header, above.article or name == "article"))
    flush()
    return lines


def lcs(a: list, b: list) -> tuple[list[int], list[int]]:
    """Places in ``a`` and ``b`` of a longest common subsequence; big integers hold a row of the table each, long inputs are halved first."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    common = set(a[lead:len(a) - tail]) & set(b[lead:len(b) - tail])
    left = [i for i in range(lead, len(a) - tail) if a[i] in common]
    right = [j for j in range(lead, len(b) - tail) if b[j] in common]
    middle = _aligned([a[i] for i in left], [b[j] for j in right]) if left and right else []
    pairs = [(i, i) for i in range(lead)] + [(left[i], right[j]) for i, j in middle]
    pairs += [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)]
    return [i for i, _ in pairs], [j for _, j in pairs]


def _rows(a: list, b: list) -> list[int]:
    """Row i: bit j is 0 where the common length of a[:i + 1] grows from b[:j] to b[:j + 1]."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    whole = (1 << len(b)) - 1
    row, rows = whole, []
    for x in a:
        both = row & places.get(x, 0)
        row = ((row + both) | (row - both)) & whole
        rows.append(row)
    return rows


def _grown(row: int, n: int) -> list[int]:
    """Common lengths with the first 0 to n of the other side."""
    out, total = [0], 0
    for bit in reversed(format(row, f"0{n}b")):
        total += bit == "0"
        out.append(total)
    return out


def _aligned(a: list, b: list, limit: int = 1 << 28) -> list[tuple[int, int]]:
    if len(a) > 1 and len(a) * len(b) > limit:
        half = len(a) // 2
        before = _grown(_rows(a[:half], b)[-1], len(b))
        after = _grown(_rows(a[half:][::-1], b[::-1])[-1], len(b))
        cut = max(range(len(b) + 1), key=lambda j: before[j] + after[len(b) - j])
        return _aligned(a[:half], b[:cut], limit) + [(i + half, j + cut) for i, j in _aligned(a[half:], b[cut:], limit)]
    if not b:
        return []
    rows = _rows(a, b)
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                pairs.append((i, j))
    return pairs[::-1]
