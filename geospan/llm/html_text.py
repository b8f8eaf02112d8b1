"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classifies each
block by its place (menus, footers, notices, ... are out), link density,
length and stop-word density; the second lets short, undecided blocks inherit
the label of their nearest decided neighbours.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Frequent words of the languages of the tables.
STOP_WORDS = frozenset((
    "the of and to in a is that for it was on with as be by at this are from or an have not which "
    "der die das und zu den ist mit von für auf nicht ein eine dem des im sich als auch es an "
    "le la les de des du et un une est en que pour dans par sur au pas qui ce il "
    "el los las del y que en por con una se no su al lo para").split())
SKIPPED = frozenset("script style noscript template svg math head iframe object select button textarea option".split())
OUTSIDE = frozenset("nav footer aside form header menu dialog".split())
#: Elements that end an open one of their own name.
REPEATED = frozenset("p li dt dd tr td th".split())
INLINE = frozenset(("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span "
                    "strike strong sub sup time tt u var wbr br").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names, whole, of classes and ids: what they name is never main text, or only on a page that has no other.
NEVER = re.compile(
    r"(?:\w*comments?(?:list|area|form|box|section|thread|body|text|s)?|ads?|adverts?|advertis\w*|breadcrumbs?|consent|"
    r"cookies?\w*|disqus|footer|gdpr|nav|navbar|navigation|newsletter|popup|respond|\w*sidebar|sponsor\w*|subscribe)", re.I)
SELDOM = re.compile(r"(?:banner|header|masthead|menu|modal|notice|promo\w*|related|share|sharing|social|toolbar|widget)", re.I)
#: A part of a name that says that the page is laid out without or around what the next part names.
LAYOUT = re.compile(r"(?:no|non|not|without|with|has|have|hide|hides|hidden|show|shows|and)", re.I)
ROLE = re.compile(r"(?:navigation|banner|contentinfo|complementary|search|dialog|alert|form|menu)", re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)")
#: Attributes up to the end of a tag, without backtracking; quoted values hold no tag start in the first.
PLAIN, QUOTED = (re.compile(rf"(?:[^>\"'{less}]|\"[^\"{less}]*\"|'[^'{less}]*')*+>") for less in ("<", ""))
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")  # one after the other, values consumed
WORD = re.compile(r"\w+")


OUT, DOUBT = 2, 1


def named_after(names: str) -> int:
    """Whether a class or id names boilerplate: OUT (never main text), DOUBT (seldom) or 0.

    Names are told apart by white space and their parts by hyphens and
    underscores; ``no-sidebar`` or ``with-sidebar`` describe the page instead.
    """
    found = 0
    for name in names.split():
        parts = re.split(r"[-_]+", name)
        for before, part in zip(["", *parts], parts):
            if not LAYOUT.fullmatch(before):
                found = max(found, OUT if NEVER.fullmatch(part) else DOUBT if SELDOM.fullmatch(part) else 0)
    return found


def is_outside(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element is boilerplate: OUT by its element, role, being hidden or named so; DOUBT; or 0."""
    if tag in OUTSIDE and not (in_article and tag == "header"):
        return OUT
    if not attributes or tag in ("html", "body"):
        return 0
    found = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and ROLE.fullmatch(value):
            return OUT
        if name in ("class", "id") and tag not in ("main", "article"):
            found = max(found, named_after(value))
    return found


def word_count(text: str) -> int:
    return len(WORD.findall(text))


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """``text, tag, closing, attributes`` in page order, the text before each tag; time grows with the page's length.

    Comments, declarations and elements of ``SKIPPED`` are left out with their
    content. A tag that never ends stops at the next tag start.
    """
    at = start = 0
    n = len(page)
    endless: set[str] = set()  # what is known not to come any more: an end of a tag, of a quoted value, of an element
    while True:
        open_ = page.find("<", at)
        if open_ < 0:
            break
        if page.startswith(("<!", "<?"), open_):
            sign, end = next(((s, e) for s, e in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(s, open_)), ("<!", ">"))
            close = -1 if end in endless else page.find(end, open_ + len(sign))
            if close < 0:
                endless.add(end)
            # An unclosed comment takes the rest of the page, an unclosed declaration only itself.
            after = close + len(end) if close >= 0 else n if sign != "<!" else open_ + 2
            yield page[start:open_], "", False, ""
            at = start = after
            continue
        m = TAG.match(page, open_)
        if not m:
            at = open_ + 1
            continue
        end = PLAIN.match(page, m.end())
        if not end and "quoted" not in endless:
            end = QUOTED.match(page, m.end())
            if not end:
                endless.add("quoted")
        tag, closing = m.group(2).lower(), bool(m.group(1))
        if end:
            attributes, at = page[m.end():end.end() - 1], end.end()
        else:
            following = page.find("<", m.end())
            attributes, at = "", following if following >= 0 else n
        if tag in SKIPPED and not closing and not attributes.endswith("/"):
            close = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if close or tag in ("script", "style"):
                yield page[start:open_], "" if tag in INLINE else " ", False, ""
                at = start = close.end() if close else n
                continue
            endless.add(tag)
        yield page[start:open_], tag, closing, attributes
        start = at
    yield page[start:], "", False, ""


def blocks_of(page: str) -> list[tuple[str, int, int, bool]]:
    """Blocks in page order: text, words inside links, OUT or DOUBT or 0, lies in an article."""
    out: list[tuple[str, int, int, bool]] = []
    open_: list[tuple[str, int]] = []
    count = Counter()  # open elements by name
    depth = [0, 0, 0]  # open elements that are neither, in doubt, outside
    linked = 0
    held: list[str] = []

    def close_block():
        nonlocal linked
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            out.append((text, linked, OUT if depth[OUT] else DOUBT if depth[DOUBT] else 0,
                        count["article"] + count["main"] > 0))
        held.clear()
        linked = 0

    def pop():
        name, away = open_.pop()
        depth[away] -= 1
        count[name] -= 1

    for data, tag, closing, attributes in tokens(page):
        if data:
            held.append(data)
            if count["a"]:
                linked += len(WORD.findall(data))
        if not tag:
            continue
        if tag in INLINE or tag in VOID or tag == " ":
            if tag == "br" or tag not in INLINE and tag != "input":
                held.append(" ")
            if tag == "hr":
                close_block()
        else:
            close_block()
        if tag in VOID or tag == " ":
            continue
        if not closing:
            if tag in REPEATED and any(name == tag for name, _ in open_[-8:]):
                while open_ and (open_[-1][0] in INLINE or open_[-1][0] == tag) and any(name == tag for name, _ in open_[-8:]):
                    pop()
            away = is_outside(tag, attributes, count["article"] + count["main"] > 0)
            open_.append((tag, away))
            depth[away] += 1
            count[tag] += 1
        elif count[tag]:
            while open_[-1][0] != tag:
                pop()
            pop()
    close_block()
    return out


def main_text(page: str, short: int = 8, link_density: float = 0.4, stop_density: float = 0.08) -> str:
    """The main text's blocks, joined by line feeds.

    Elements that only their name puts in doubt (a banner, a widget) are looked
    at if the page has no main text without them.
    """
    blocks = blocks_of(page)
    for certain in (DOUBT, OUT):
        kept = _kept([(text, linked, away >= certain, article) for text, linked, away, article in blocks],
                     short, link_density, stop_density)
        if kept or all(away != DOUBT for _, _, away, _ in blocks):
            break
    return "\n".join(kept)


def _kept(blocks: list[tuple[str, int, bool, bool]], short: int, link_density: float, stop_density: float) -> list[str]:
    found = [WORD.findall(text) for text, *_ in blocks]
    # Articles speak for the page if they hold as many words as the rest of it; a teaser card does not.
    held = [0, 0]
    for words, (_, linked, away, article) in zip(found, blocks):
        if not away and linked <= link_density * max(len(words), 1) and (article or len(words) >= short):
            held[article] += len(words)
    has_article = any(a and not o for _, _, o, a in blocks) and held[1] >= held[0]
    labels: list[bool | None] = []
    for words, (_, linked, away, article) in zip(found, blocks):
        n = max(len(words), 1)
        stops = sum(w.lower() in STOP_WORDS for w in words) / n
        if away or linked / n > link_density or has_article and not article and n < 4 * short:
            labels.append(False)
        elif n >= short and (stops >= stop_density or article):
            labels.append(True)
        elif n >= 4 * short:
            labels.append(True)  # long and without links: text of a language whose stop words are unknown
        else:
            labels.append(None)
    before, after = nearest(labels), [len(labels) - 1 - i if i is not None else None for i in nearest(labels[::-1])][::-1]
    out = []
    for i, (text, _, _, article) in enumerate(blocks):
        keep, left, right = labels[i], before[i], after[i]
        if keep is None and article:  # neighbours outside the article don't speak for it
            near = [labels[j] for j in (left, right) if j is not None and blocks[j][3] and not blocks[j][2]]
            keep = any(near) or not near
        elif keep is None and left is None and right is None:
            keep = not has_article
        elif keep is None and (left is None or right is None or i - left != right - i):
            keep = labels[left if right is None or left is not None and i - left < right - i else right]
        elif keep is None:
            keep = labels[left] and labels[right]
        if keep:
            out.append(text)
    return out


def nearest(labels: list[bool | None]) -> list[int | None]:
    """For each place the last one before it that has a label."""
    out, last = [], None
    for i, label in enumerate(labels):
        out.append(last)
        if label is not None:
            last = i
    return out


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` (empty if none, or if the HTML is null or empty) and ``n_chars``, its code points.

    Columns of these two names are replaced, others stay; repeated rows are
    extracted each for itself. A very long page is read whole, in time that grows
    with its length, tags and quotes that never end included. A block as near to
    a kept neighbour as to a dropped one is dropped. An empty table gives an empty one.
    """
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def run(batches):
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages.fillna("")], dtype=object)
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    kept = pages.drop("text", "n_chars")
    return kept.withColumn("text", pandas_udf(run, "string")(F.col(html_col))).withColumn(
        "n_chars", F.char_length("text").cast("long"))
