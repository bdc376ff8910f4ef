"""Main text of web pages by two-pass rules on blocks."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements, attribute words and frequent words of four languages.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("script style noscript template svg math canvas iframe object embed audio video map head title textarea select button datalist".split())
RAW = frozenset("script style textarea title noscript iframe".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification paywall popup "
    "promo promoted recommended related replies reply responses share sharing sidebar signup social sponsor sponsored subscribe subscription "
    "taboola toolbar topbar widget".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry main post story text".split())
#: Parts of a name that turn it round or make it one of a page's layout: no-sidebar, has-sidebar, with_header, is-menu-open.
LAYOUT_WORDS = frozenset("no not without has with is hide hides show shows under near".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert form toolbar".split())
STOP_WORDS = frozenset(
    "the of and to a in is that it for as with was on be by this are from or an at not he she they we you his her its have has had but which "
    "der die das und ist nicht ein eine den dem von zu mit sich auf für im des als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des du et un une que qui dans est pour pas sur au aux avec par ce il elle son sa ses ne se plus ou mais "
    "el los las y en que del se por con una para es lo como más o pero sus su al son ha".split()
)

#: What names tell of a block, as evidence for (above 0) or against main text; it adds up over what holds the
#: block, between the ends, but evidence for what is outside of an element against does not count in it.
ELEMENT_EVIDENCE = {"article": 2.0, "main": 2.0, "nav": -3.0, "footer": -3.0, "aside": -3.0, "header": -2.0, "menu": -3.0, "dialog": -3.0, "search": -2.0, "form": -2.0}
NAME_EVIDENCE, PART_EVIDENCE, MAIN_EVIDENCE, ROLE_EVIDENCE, SIGN_EVIDENCE = -3.0, -1.0, 1.0, -3.0, -1.0
ENDS = (-6.0, 3.0)
#: Thresholds of the first pass without evidence: characters of a block that is not short, share of stop words, share of characters in
#: links; and how far a unit of evidence for, and against, moves the last two. Against, the length asked for grows by as much again.
LENGTH, STOP, LINKS, STOP_FOR, STOP_AGAINST, LINKS_FOR = 70, 0.22, 0.2, 0.04, 0.10, 0.12
#: Evidence from which a block in a textual element is likely main text, and evidence from which none is undecided.
LIKELY, AGAINST = 1.0, -2.0

# An attribute's value is quoted only right after its equals sign; other quotation marks are part of names and values.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")
_MENU = re.compile(r"[|»›·•/]")
_END = re.compile(r"</(" + "|".join(sorted(HIDDEN)) + r")(?=[\s>/])[^>]*>", re.I)


def name_evidence(name: str) -> float:
    """What one class or id tells: a word of the side as a whole name or at its end counts in full, elsewhere in part; names of layout, nothing."""
    parts = [p.lower() for p in _NAME.findall(name)]
    if not parts or parts[0] in LAYOUT_WORDS or any(p in LAYOUT_WORDS for p in parts[:-1]):
        return 0.0
    if parts[-1] in SIDE_WORDS:
        return NAME_EVIDENCE
    if any(p in SIDE_WORDS for p in parts):
        return PART_EVIDENCE
    return MAIN_EVIDENCE if parts[-1] in MAIN_WORDS else 0.0


def evidence(name: str, attributes: str, in_article: bool) -> tuple[float, bool]:
    """What an element's name and attributes tell of its text, and whether it is hidden. A header or heading of an article is the article's own."""
    total = 0.0 if in_article and name == "header" else ELEMENT_EVIDENCE.get(name, 0.0)
    if name in ("html", "body") or not attributes.strip():
        return total, False
    names = []
    for m in _ATTRIBUTE.finditer(attributes):
        what, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if what == "hidden" or what == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return total, True
        if what == "aria-hidden" and value.lower() == "true":
            total += ROLE_EVIDENCE
        elif what == "role" and value.lower() in SIDE_ROLES:
            total += ROLE_EVIDENCE
        elif what == "itemprop" and value.lower() == "articlebody":
            total += 2 * MAIN_EVIDENCE
        elif what in ("class", "id"):
            names += value.split()
    found = [e for e in map(name_evidence, names) if e]
    if in_article:  # the header of an entry, not of the page
        found = [e for e, n in zip(map(name_evidence, names), names) if e and _NAME.findall(n)[-1].lower() not in ("header", "banner", "masthead")]
    return total + min([e for e in found if e < 0], default=0.0) + (MAIN_EVIDENCE if any(e > 0 for e in found) else 0.0), False


def blocks(page: str) -> list[dict]:
    """Blocks of text in page order: text, chars in links, and where they stand.

    Inline elements join the text around them, as do line breaks; block elements part it, and so do inline
    ones whose names tell something. `evidence` is what all elements around tell, `article` the number of the article or
    main that holds the block (0: none), `element` the innermost block element. An end tag closes
    what was opened last under its name, and all within; one of an inline element does not reach out of a
    block. Text of hidden elements is left out. Takes time in proportion to the page.
    """
    out: list[dict] = []
    # Open elements: name, whether a block, evidence and hidden before it, whether an article; where each name, and each block, stands.
    stack: list[tuple[str, bool, float, bool, bool]] = []
    at: dict[str, list[int]] = {}
    block_at: list[int] = []
    text: list[str] = []
    linked = articles = 0
    in_link = hidden = False
    told, inside = 0.0, [0]
    ends: dict[str, list[int]] = {}
    for m in _END.finditer(page):
        ends.setdefault(m[1].lower(), []).append(m.start())

    def flush() -> None:
        nonlocal linked
        joined = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
        if joined:
            out.append({"text": joined, "linked": linked, "evidence": min(max(told, ENDS[0]), ENDS[1]), "article": inside[-1], "element": stack[block_at[-1]][0] if block_at else "body"})
        text.clear()
        linked = 0

    def add(part: str) -> None:
        nonlocal linked
        if part and not hidden:
            text.append(part)
            if in_link:
                linked += len(_SPACE.sub(" ", entities.unescape(part)))

    def close(to: int) -> None:
        nonlocal told, hidden
        while len(stack) > to:
            name, block, told, hidden, article = stack.pop()
            at[name].pop()
            if block:
                block_at.pop()
            if article:
                inside.pop()

    def open_(name: str, block: bool, e: float, hide: bool) -> None:
        nonlocal told, hidden, articles
        article = name in ("article", "main")
        stack.append((name, block, told, hidden, article))
        at.setdefault(name, []).append(len(stack) - 1)
        if block:
            block_at.append(len(stack) - 1)
        if article:
            articles += len(inside) == 1
            inside.append(articles)
        # What speaks for an article does not speak for what is set apart in it.
        told, hidden = (min(told, 0.0) if e < 0 else told) + e, hidden or hide

    pos = 0
    while pos < len(page):
        m = _TAG.search(page, pos)
        if not m:
            add(page[pos:])
            break
        add(page[pos : m.start()])
        pos = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in HIDDEN:
            if not closing and not m[3].endswith("/"):
                own = ends.get(name, ())
                i = bisect_left(own, pos)
                if i < len(own):
                    pos = page.index(">", own[i]) + 1
                elif name in RAW:
                    break
            if name in BLOCKS:
                flush()
            continue
        if name == "br":
            text.append(" ")
        elif name == "a":
            in_link = not closing
        elif name in BLOCKS:
            flush()
            in_link = False
            if closing:
                if at.get(name):
                    close(at[name][-1])
            else:
                if name == "p" and block_at and stack[block_at[-1]][0] == "p":
                    close(block_at[-1])
                if name not in VOID and not m[3].endswith("/"):
                    open_(name, True, *evidence(name, m[3], bool(inside[-1])))
        elif closing:
            if at.get(name) and at[name][-1] > (block_at[-1] if block_at else -1):
                to = at[name][-1]
                if (stack[to][2], stack[to][3]) != (told, hidden):
                    flush()
                close(to)
        elif name not in VOID and not m[3].endswith("/"):
            e, hide = evidence(name, m[3], bool(inside[-1]))
            if e or hide:
                flush()
            open_(name, False, e, hide)
    flush()
    return out


def first_pass(b: dict) -> str:
    """good, bad, near (undecided, likely) or short (undecided), by the block alone: its length, stop words and links, with thresholds that evidence moves."""
    words = _WORD.findall(b["text"].lower())
    dense = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    links, n = b["linked"] / max(1, len(b["text"])), len(b["text"])
    e = b["evidence"] + SIGN_EVIDENCE * (b["text"].lstrip().startswith("©") or "all rights reserved" in b["text"].lower())
    textual = b["element"] in TEXTUAL
    menu = len(_MENU.findall(b["text"])) * 2 >= max(1, len(words))
    if links > LINKS + LINKS_FOR * max(e, 0) and not (e >= LIKELY and b["element"] in HEADINGS) or menu and e < LIKELY:
        return "bad"
    if e <= AGAINST:
        # Only long running text stands up to what names tell against it.
        return "good" if n >= LENGTH * (1 - e) ** 2 and dense >= STOP - STOP_AGAINST * e else "bad"
    stop = STOP - (STOP_FOR if e > 0 else STOP_AGAINST) * e
    if n < LENGTH * (1 + max(-e, 0)):
        return "near" if e >= LIKELY and textual else "bad" if links > 0 or e < 0 else "short"
    if dense >= stop:
        return "good"
    return "near" if e >= LIKELY and textual or dense >= stop / 2 else "bad"


def classify(found: list[dict]) -> list[bool]:
    """Whether each block belongs to the main text.

    First pass: `first_pass` decides blocks by length, share of stop words and share of links; names of elements and classes
    move its thresholds. Short blocks, and those of a middling share, are undecided; likely ones are near. Second
    pass: an undecided block takes the label of its nearest decided neighbours. Where these differ, or one is the end of
    the page, the near are good and the short ones bad, but a heading goes with what follows it. For near blocks
    of an article only neighbours in it count, and without any they are good. Where no block of the page is
    good, the near are, or else the undecided in paragraphs and headings, or else all undecided.
    """
    label = [first_pass(b) for b in found]
    before, after = [0] * len(label), [0] * len(label)
    for nearest, order, end in ((before, range(len(label)), -1), (after, range(len(label) - 1, -1, -1), len(label))):
        last = end
        for i in order:
            nearest[i] = last
            last = i if label[i] in ("good", "bad") else last
    out = []
    for i, (b, x) in enumerate(zip(found, label)):
        if x in ("good", "bad"):
            out.append(x == "good")
            continue
        near = [j for j in (before[i], after[i]) if 0 <= j < len(label)]
        if x == "near" and b["article"] and b["element"] in TEXTUAL:
            own = [label[j] for j in near if found[j]["article"] == b["article"] and found[j]["evidence"] > AGAINST]
            out.append(not own or "good" in own)
        elif b["element"] in HEADINGS and b["evidence"] >= 0:
            out.append(after[i] < len(label) and label[after[i]] == "good")
        else:
            good = sum(label[j] == "good" for j in near)
            out.append(good == 2 or good == 1 and x == "near")
    if not any(out):
        for chosen in (lambda b, x: x == "near", lambda b, x: x == "short" and b["element"] in TEXTUAL, lambda b, x: x == "short"):
            out = [chosen(b, x) for b, x in zip(found, label)]
            if any(out):
                break
    return out


def main_text(page: str | None) -> str:
    """Texts of the good blocks, in page order, joined by one space."""
    if not page:
        return ""
    found = blocks(page)
    return " ".join(b["text"] for b, good in zip(found, classify(found)) if good)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Pages with their main text: the columns of `pages` but `html`, and _text.

    Whole pages are read; null or empty html, and pages without main text, give an empty string.
    Broken markup is read as far as it goes. Repeated rows give equal rows; empty table: no rows.
    A column of the name _text is replaced.
    """

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_ in batches:
            yield pages_.map(main_text)

    return pages.withColumn("_text", texts(F.coalesce(column, F.lit("")))).drop(column)
