"""Operator 2: main text of HTML pages by tag-path ratios.

A page is walked once. Every block of text has the path of open tags above it, without inline tags;
blocks of one path share statistics: characters per block, punctuation per block, and the share of
characters in links. Along the page, the logarithms of each block's two ratios are smoothed with a
Gaussian window over its neighbours (those of other paths count little) and fused into one score by
their product; a path's score is the mean over its blocks, less its share of links. Paths above the threshold (a part of the standard
deviation of the scores) are content. The main container is the deepest element that holds nearly
all content characters (sibling articles together, or a main element, where these do).

What is kept, in page order, are the container's blocks by the scores of their paths: those above the
threshold; paragraphs, list items and cells above a quarter of it unless most of the path is links; and
headings whose section has such a block. Logarithms keep one very long block from pushing short paragraphs under the threshold.

Elements whose tag or role is that of a menu, header, footer, sidebar, notice, form, script or style,
and hidden ones, are never read. Words in class and id cut nothing: an element marked by them has a
path of its own, with a lower score, and has to reach the whole threshold. A token that is all
marking words lowers most; an id or a token with a qualifying word (no-sidebar, widget-container)
little; parts of tokens not at all on headings and elements of prose. A factor that all paths share
changes nothing, and one over nearly all characters of the page is lifted, but for reader comments.

Null or empty html: empty text. Text without tags: one block. Unclosed and misnested tags end
where their container ends; an opening block ends an open paragraph. Depth and length are not
limited and work is linear in both: an element knows at its birth what an end of it or a tag after it
would close. Malformed declarations and marked sections (<![x]>) are comments up to the next >.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.words import chunks

# HTML element names by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head title noscript template iframe object svg canvas audio video map select option datalist textarea button form input fieldset nav footer aside menu dialog frameset frame applet".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mover mroot mrow ms msqrt mstyle msub msubsup msup mtext munder munderover nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p li dt dd td th caption pre blockquote figcaption".split())
ENDS_OWN = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
# Tags that end an open element by themselves: which element, and what shields it.
IMPLIED = ((("p",), ("table", "td", "th", "button", "object")), *((tuple(tags.split()), stops) for tags, stops in ENDS_OWN.values()), (("head",), ()))
CONCERNED = frozenset(x for rule in IMPLIED for tags in rule for x in tags)
RULE = {tag: i + 1 for i, tag in enumerate(ENDS_OWN)}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words in class and id that mark what is not the article.
MARKS = frozenset(
    """ad ads adbox adslot advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion
    nav navbar navigation menu submenu breadcrumb breadcrumbs masthead footer sidebar sidenav aside widget related
    recommended recommendations share sharing social comment comments commentlist disqus respond reply replies cookie cookies
    consent gdpr notice notices popup modal newsletter subscribe subscription signup login search searchbox
    pagination pager toolbar skip skiplink alert overlay""".split()
)
#: The part of the threshold that suffices for elements of prose in the main container; a neighbour's part where its path is another.
NEAR, OTHER = 0.25, 0.1
READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
QUALIFIERS = frozenset("no not non without with has hide hidden container wrapper wrap layout page".split())
#: What marking words leave of a score.
STRONG, WEAK = 0.1, 0.5
_WORD = re.compile(r"[A-Za-z]+")
_PUNCT = re.compile(r"[.,;:!?…。，；：！？、]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Element:
    __slots__ = ("article", "block", "closes", "depth", "heading", "held", "in_header", "inline", "link", "parent", "path", "prose", "silent", "tag")

    def __init__(self, tag, parent, path, silent, article):
        self.tag, self.parent, self.path, self.silent, self.article = tag, parent, path, silent, article
        self.depth = 0 if parent is None else parent.depth + 1
        self.held = 0  # content characters below, summed at the end
        self.link = tag == "a" or parent is not None and parent.link
        self.heading = int(tag[1]) if tag in HEADINGS else parent.heading if parent is not None else 0  # its level
        self.prose = tag in PROSE or tag in INLINE and parent.prose
        self.in_header = tag == "header" or parent is not None and parent.in_header
        # the open block around, and how many inline elements of each tag stand open in it
        self.block = parent.block if tag in INLINE else self
        self.inline = None if tag in INLINE else {}
        # the nearest open element that each rule of IMPLIED would close from here
        above = parent.closes if parent is not None else (None,) * len(IMPLIED)
        if tag in CONCERNED:
            above = tuple(self if tag in tags else None if tag in stops else x for (tags, stops), x in zip(IMPLIED, above, strict=True))
        self.closes = above


def _boilerplate(tag: str, attrs: list, inside_article: bool) -> bool:
    if tag in SILENT or tag == "header" and not inside_article:
        return True
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if not value:
            continue
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "style" and _HIDDEN.search(value):
            return True
    return False


def _factor(tag: str, attrs: list, inside_article: bool) -> tuple[float, bool]:
    """What class and id leave of the element's score, and whether they mark reader comments."""
    factor, readers = 1.0, False
    if tag in INLINE or tag in ("html", "body", "article", "main"):
        return factor, readers
    for name, value in attrs:
        if name not in ("class", "id") or not value:
            continue
        for token in value.lower().split():
            words = _WORD.findall(token)
            marking = MARKS.intersection(words)
            if token == "header" and not inside_article:
                factor = STRONG
            elif not marking:
                continue
            elif marking.issuperset(words):
                factor = STRONG
                readers = readers or not READERS.isdisjoint(words)
            elif tag not in PROSE and tag not in HEADINGS:
                factor = min(factor, WEAK if name == "id" or not QUALIFIERS.isdisjoint(words) else STRONG)
    return factor, readers


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.paths: dict[tuple[int, str, float, bool], int] = {}
        self.top = _Element("", None, -1, False, False)
        self.elements = [self.top]  # parents before children
        self.open: dict[str, int] = {}  # blocks that stand open, by tag
        self.blocks = 0
        self.leaves: list[tuple[int, int, str, bool, _Element]] = []  # path, block, text, in a link, element

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def parse_html_declaration(self, i):
        """<!DOCTYPE ...> and anything else after <! that is no comment."""
        return self.parse_comment(i) if self.rawdata[i : i + 4] == "<!--" else self.parse_bogus_comment(i)

    def _path(self, parent: int, tag: str, factor: float, readers: bool) -> int:
        return self.paths.setdefault((parent, tag, factor, readers), len(self.paths))

    def _new_block(self):
        self.blocks += 1

    def _pop(self, to: _Element):
        """Close everything below and including `to`."""
        e, ends = self.top, False
        while True:
            opened = e.block.inline if e.tag in INLINE else self.open
            opened[e.tag] -= 1
            ends |= e.tag not in INLINE
            if e is to:
                break
            e = e.parent
        if ends:
            self._new_block()
        self.top = to.parent

    def handle_starttag(self, tag, attrs):
        if tag == "br" or tag == "hr":
            self._new_block()
        if tag in CLOSES_P and (p := self.top.closes[0]) is not None:
            self._pop(p)
        if tag in RULE and (own := self.top.closes[RULE[tag]]) is not None:
            self._pop(own)
        if tag == "body" and (head := self.top.closes[-1]) is not None:
            self._pop(head)
        if tag in VOID:
            return
        top = self.top
        if tag not in INLINE:
            self._new_block()
        article = top.article or tag in ("article", "main")
        silent = top.silent or _boilerplate(tag, attrs, top.article)
        self.top = _Element(tag, top, top.path if tag in INLINE else self._path(top.path, tag, *_factor(tag, attrs, top.article)), silent, article)
        self.elements.append(self.top)
        opened = self.top.block.inline if tag in INLINE else self.open
        opened[tag] = opened.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if tag == "br":
            self._new_block()
            return
        # an inline end tag does not reach out of its block; a block's end closes what is open in it
        e = self.top
        if (e.block.inline if tag in INLINE else self.open).get(tag):
            while e.tag != tag:
                e = e.parent
            self._pop(e)
        elif tag == "p":
            self._new_block()

    def handle_data(self, data):
        top = self.top
        # of a header inside an article only its headings are text
        if not top.silent and (top.heading or not top.in_header):
            self.leaves.append((top.path, self.blocks, data, top.link, top))


def _smoothed(values: list[float], paths: list[int], sigma: float) -> list[float]:
    reach = max(1, math.ceil(2 * sigma))
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    n, out = len(values), []
    for i in range(n):
        total = weight = 0.0
        for k in range(max(0, i - reach), min(n, i + reach + 1)):
            w = weights[k - i + reach] * (1 if paths[k] == paths[i] else OTHER)
            total += w * values[k]
            weight += w
        out.append(total / weight)
    return out


def extract(html: str | None, sigma: float = 1.0, deviation: float = 0.8, share: float = 0.9) -> str:
    """The article's text: white space inside a block is one space, blocks are joined by one space."""
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    page.close()
    blocks: list[tuple[int, str, _Element]] = []  # path, text, element
    count: dict[int, int] = {}
    chars: dict[int, int] = {}
    marks: dict[int, int] = {}
    linked: dict[int, int] = {}
    for _, group in groupby(page.leaves, key=lambda x: x[1]):
        parts = list(group)
        text = " ".join("".join(x[2] for x in parts).split())
        if not text:
            continue
        path = parts[0][0]
        blocks.append((path, text, parts[0][4]))
        count[path] = count.get(path, 0) + 1
        chars[path] = chars.get(path, 0) + len(text)
        marks[path] = marks.get(path, 0) + len(_PUNCT.findall(text))
        linked[path] = linked.get(path, 0) + min(len(text), sum(len(x[2].strip()) for x in parts if x[3]))
    if not blocks:
        return ""
    weight = _weights(page.paths, chars, share)
    order = [x[0] for x in blocks]
    long = _smoothed([math.log1p(chars[p] / count[p]) * weight[p] for p in order], order, sigma)
    dotted = _smoothed([math.log1p(marks[p] / count[p]) * weight[p] for p in order], order, sigma)
    fused: dict[int, float] = {}
    for x, a, b in zip(blocks, long, dotted, strict=True):
        fused[x[0]] = fused.get(x[0], 0.0) + a * (1 + b)
    score = {p: weight[p] * s / count[p] * (1 - linked[p] / chars[p]) for p, s in fused.items()}
    values = [score[x[0]] for x in blocks]
    mean = sum(values) / len(values)
    spread = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    bar = min(deviation * spread, max(values))
    content = {p for p, s in score.items() if s >= bar and s > 0}
    near = content | {p for p, s in score.items() if s >= bar * NEAR and s > 0 and weight[p] > STRONG and 2 * linked[p] <= chars[p]}
    total = 0
    for path, text, element in blocks:
        if path in content:
            total += len(text)
            element.held += len(text)
    if not total:
        return ""
    for e in reversed(page.elements[1:]):
        e.parent.held += e.held
    together: dict[tuple[str, _Element], list[_Element]] = {}
    for e in page.elements:
        if e.held and e.tag in ("article", "main"):
            together.setdefault((e.tag, e.parent), []).append(e)
    roots, most = max(((x, sum(e.held for e in x)) for x in together.values()), key=lambda x: (x[1], x[0][0].tag == "article"), default=([], 0))
    if not roots or most < share * total:
        wide = (e for e in page.elements if e.held >= share * total and e.tag not in INLINE and e.tag not in CLOSES_P - {"div", "section", "table", "center", "article", "main"})
        roots = [max(wide, key=lambda e: e.depth)]
    out: list[str] = []
    begun, alive, deeper = False, False, 0  # from the end: any block, a kept one since a heading, level of the last kept heading
    for path, text, element in reversed(list(inside(blocks, set(roots)))):
        if level := element.heading:
            kept = alive or deeper > level or not begun and path in near
            alive = False
            if kept:
                deeper = level
        else:
            kept = path in near if element.prose else path in content
            alive |= kept
        begun = True
        if kept:
            out.append(text)
    return " ".join(reversed(out))


def _weights(paths: dict, chars: dict[int, int], share: float) -> dict[int, float]:
    """Each path's product of factors, without those over nearly all characters."""
    under = dict(chars)
    for (parent, *_), p in reversed(paths.items()):
        under[parent] = under.get(parent, 0) + under.get(p, 0)
    every, weight = sum(chars.values()), {-1: 1.0}
    for (parent, _, factor, readers), p in paths.items():
        weight[p] = weight[parent] * (1.0 if not readers and under.get(p, 0) >= share * every else factor)
    return weight


def inside(blocks, roots: set[_Element]):
    known: dict[_Element, bool] = {}

    def within(e) -> bool:
        seen = []
        while e is not None and e not in roots and e not in known:
            seen.append(e)
            e = e.parent
        found = e in roots or (e is not None and known[e])
        for x in seen:
            known[x] = found
        return found

    return (x for x in blocks if within(x[2]))


def main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Each row's `keep` columns with `text` and `n_chars` (code points of text). Row by row, no shuffle."""
    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_chars long"

    def run(batches):
        for part in chunks(batches, "h", 4 << 20):
            texts = [extract(x) for x in part.column("h").to_pylist()]
            columns = [part.column(f"k{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{html}`").alias("h")).mapInArrow(run, schema)
