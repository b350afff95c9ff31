"""Main text of web pages by two-pass block rules.

Tags cut a page into blocks; scripts, styles and the like hold none. The first pass decides a block by its length, its
density of stop words, its share of linked text and its place: what stands in menus, footers, forms and the like, by tag
or by a name that says nothing else (``sidebar``, ``ad-box``), is boilerplate, what stands under a name that may say so
(``related``, ``notice-period``) is text only if it is prose, and a name that says what is not there (``no-comments``)
says nothing. Short or unclear blocks stay open. In the
second pass an open block takes the label of its nearest decided neighbours: that of both if they agree,
else that of the closer one, of two equally close ones the later; with no decided neighbour it is text. Blocks that
their place decides give no label to others. Where names alone would leave a page without text although it has prose, they
are given up.
List items that are links are menus, wherever they stand, and give no label to others. An article is
evidence, no verdict. Inside, blocks of links are rejected, blocks poor in stop words stay open, and an open
block falls only between rejected ones. Outside, on a page that has one, only long blocks are text by
themselves, neighbours count on that side only, and open blocks without any are no text. Where a page's own text is poor
in the stop words, or a block is not in their script, length, ends of sentences and links decide, an ideograph as three letters.

Defined cases: a null or empty page has an empty text; broken and unclosed markup is read as far as it
goes; long pages are read whole; repeated rows are extracted each; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from logweave.llm.common import map_columns

#: Stop words of common languages: fixed values.
STOP_WORDS = frozenset(
    """the of and to in is that it for was on are as with be by this from at or an not have which but
    der die das und ist von mit den dem ein eine nicht auf für im zu sich auch es als an werden aus
    le la les de des et est un une que qui dans pour par sur pas au avec ce plus du il ne se sont
    el los las y en una por con para se no su al lo como más del sus
    il di che e per non sono una con si da della o os do da em um uma não com mais""".split()
)
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table
    tbody td tfoot th thead tr ul""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, or no text of the page.
RAW_TAGS = frozenset("script style noscript template textarea title iframe object svg math canvas select option button audio video noframes".split())
LEFT_OUT_TAGS = frozenset("nav header footer aside form menu dialog".split())
#: Words of class or id that mark what is left out, if nothing else is said beside them.
LEFT_OUT_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent
    cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices
    pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup skip social
    sponsor sponsored sponsors subscribe subscription toolbar widget""".split()
)
#: Those of them that are also names of text.
DOUBTFUL_WORDS = frozenset("header related social skip toolbar widget".split())
#: Words beside them that say where or in which form they are, and words before them that say they are not.
FORM_WORDS = frozenset(
    """area bar block bottom box btn button column container content fixed form foot global group head holder id inner item items js left
    link links list main mobile outer overlay page panel post posts primary rail right row secondary section side site
    slot small sticky thread top unit wrap wrapper zone""".split()
)
DENYING_WORDS = frozenset("has hide is no non not with without".split())
KEPT_TAGS = frozenset("html body article main".split())
#: How the place of a block speaks against it: by a name that may mean text, by a name, by a tag.
DOUBTFUL, NAMED_SO, TAGGED_SO = 1, 2, 3
#: Of the first pass: characters of a short and of a long block, stop-word densities, share of linked characters.
SHORT, LONG = 70, 200
FEW_STOPS, MANY_STOPS = 0.15, 0.30
LINKED = 0.5
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)", re.DOTALL)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: Attributes up to the end of a tag, where quotes are closed.
QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
#: Elements that may be left open by mistake around an article.
SOFT_TAGS = frozenset("div p span section ul li".split())
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD = re.compile(r"[^\W\d_]+")
#: Ends of sentences.
ENDS = tuple(".!?…。！？।။؟۔።")
LATIN = re.compile("[A-Za-z\u00aa\u00ba\u00c0-\u024f]")
#: Characters that stand for a syllable or a word.
IDEOGRAPH = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\U00020000-\U0003ffff]")


@dataclass
class Block:
    """A run of text between block tags."""

    article: bool
    tag: str
    place: int = 0
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _place(tag: str, attributes: str, in_article: bool) -> int:
    """How a tag and the names in class, id and role speak against what is inside."""
    if tag in KEPT_TAGS:
        return 0
    if tag in LEFT_OUT_TAGS and not (tag == "header" and in_article):
        return TAGGED_SO
    found = 0
    for names in NAMED.findall(attributes):
        for name in "".join(names).split():
            words = [word.lower() for word in NAME_WORD.findall(name)]
            if not words or words[0] in DENYING_WORDS:
                continue
            marks = {*words} & LEFT_OUT_WORDS
            if not marks or in_article and marks == {"header"}:
                continue
            plain = marks - DOUBTFUL_WORDS and {*words} <= LEFT_OUT_WORDS | FORM_WORDS
            found = max(found, NAMED_SO if plain else DOUBTFUL)
    return found


class _Scanner:
    """Cuts a page into text and tags in time linear in its length, however broken it is."""

    def __init__(self, page: str):
        self.page, self.size, self.at = page, len(page), 0
        self.closed = True  # whether a > is left
        self.patience = 4 * self.size  # characters to read in vain for the ends of quotes

    def _end(self, start: int) -> int:
        """The > that ends the tag whose attributes begin at ``start``, or -1: outside quotes, else the first."""
        page = self.page
        if self.patience > 0:
            end = QUOTED.match(page, start).end()
            if end < self.size and page[end] == ">":
                return end
            self.patience -= self.size - start
        return page.find(">", start)

    def __iter__(self):
        """(text, "", "", "") or ("", / or nothing, tag, attributes)."""
        page, size = self.page, self.size
        while self.at < size:
            at = self.at
            if page[at] != "<":
                end = page.find("<", at)
                self.at = size if end < 0 else end
                yield page[at : self.at], "", "", ""
                continue
            if page.startswith("<!", at) and (m := COMMENT.match(page, at)):
                self.at = m.end()
                continue
            m = TAG.match(page, at) if self.closed else None
            if m or self.closed and page[at + 1 : at + 2] in ("!", "?"):
                end = self._end(m.end()) if m else page.find(">", at)
                self.closed = end >= 0
                if self.closed:
                    self.at = end + 1
                    if m:
                        yield "", m[1], m[2].lower(), page[m.end() : end]
                    continue
            self.at = at + 1
            yield "<", "", "", ""

    def skip(self, tag: str) -> None:
        """Past the end of an element whose content is no markup."""
        closing = re.compile(f"</{tag}", re.IGNORECASE).search(self.page, self.at)
        close = self.page.find(">", closing.start()) if closing else -1
        self.at = close + 1 if close >= 0 else self.size


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page, in page order, each with what its place says."""
    found: list[Block] = []
    open_: list[tuple[str, str]] = []  # tags, each with the block tag that it is or is in
    often: Counter[str] = Counter()
    leaving: list[tuple[int, int]] = []  # (place in open_, what it says) of the tags that speak against their content
    hard = articles = links = 0  # hard: how many of these no article can end
    block: Block | None = None
    scanner = _Scanner(page)
    for text, slash, tag, attributes in scanner:
        if text:
            if block is None:
                block = Block(articles > 0, open_[-1][1] if open_ else "", leaving[-1][1] if leaving else 0)
                found.append(block)
            text = html.unescape(text)
            block.parts.append(text)
            if links:
                block.linked += len(text.strip())
            continue
        if slash:
            if tag in BLOCK_TAGS:
                block = None
            while often[tag]:
                name = open_.pop()[0]
                often[name] -= 1
                articles -= name in ("article", "main")
                links -= name == "a"
                if leaving and leaving[-1][0] == len(open_):
                    leaving.pop()
                    block = None
                    hard -= name not in SOFT_TAGS
                if name == tag:
                    break
            continue
        if tag in RAW_TAGS:
            if not attributes.endswith("/"):
                scanner.skip(tag)
            continue
        if tag == "br":
            if block is not None:
                block.parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            block = None
        if tag in VOID_TAGS:
            continue
        if tag in ("article", "main") and not hard:
            leaving.clear()  # an unclosed advert or notice does not swallow the article
        if place := _place(tag, attributes, articles > 0):
            leaving.append((len(open_), max(place, leaving[-1][1] if leaving else 0)))
            hard += tag not in SOFT_TAGS
            block = None
        open_.append((tag, tag if tag in BLOCK_TAGS else open_[-1][1] if open_ else ""))
        often[tag] += 1
        articles += tag in ("article", "main")
        links += tag == "a"
    return found


def _linked(block: Block, text: str) -> bool:
    return block.linked > LINKED * max(1, len(text))


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text) + 2 * len(IDEOGRAPH.findall(text))


def _density(text: str) -> tuple[float, int]:
    """The density of stop words, and the number of words."""
    words = [word.lower() for word in WORD.findall(text)]
    return sum(word in STOP_WORDS for word in words) / max(1, len(words)), len(words)


def _latin(text: str) -> bool:
    """Whether half of the letters are of the script of the stop words."""
    return text.isascii() or 2 * len(LATIN.findall(text)) >= sum(map(len, WORD.findall(text)))


def in_known_language(blocks: list[tuple[float, int]]) -> bool:
    """Whether a quarter of the words of (density, words) of a page stand in blocks rich in stop words."""
    return 4 * sum(n for density, n in blocks if density >= MANY_STOPS) >= sum(n for _, n in blocks)


def first_pass(block: Block, text: str, density: float, known: bool, has_article: bool) -> bool | None:
    """True for text, False for boilerplate, None if open."""
    if _linked(block, text) or block.place >= NAMED_SO:
        return False
    if block.place == DOUBTFUL:
        return _size(text) >= SHORT and (density >= MANY_STOPS if known else text.endswith(ENDS))
    if _size(text) < SHORT:
        return None
    if not known and not block.linked and text.endswith(ENDS):
        return True
    if _size(text) >= LONG and (density >= FEW_STOPS or not known):
        return True
    if density >= MANY_STOPS:
        return True if block.article or not has_article else None
    return None if block.article or density >= FEW_STOPS or not known else False


def second_pass(labels: list[bool | None], default: bool = True, article: bool = False) -> list[bool]:
    """Open blocks take the label of their nearest decided neighbours, without any the ``default``; of an
    article only those between two rejected blocks are rejected."""
    before: list[int | None] = []
    last = None
    for i, label in enumerate(labels):
        last = i if label is not None else last
        before.append(last)
    out, after = list(labels), None
    for i in range(len(labels) - 1, -1, -1):
        if labels[i] is not None:
            after = i
        elif article:
            out[i] = before[i] is None or after is None or labels[before[i]] or labels[after]
        elif before[i] is None and after is None:
            out[i] = default
        elif before[i] is None or after is None:
            out[i] = labels[after if before[i] is None else before[i]]
        else:
            out[i] = labels[before[i] if i - before[i] < after - i else after]
    return out


def labels_of(pairs: list[tuple[Block, str]]) -> list[bool]:
    """Both passes over the blocks of a page, the second on each side of its articles."""
    free = [block.place == 0 for block, _ in pairs]
    has_article = any(block.article for block, _ in pairs if block.place < NAMED_SO)
    density = [_density(text) if block.place < NAMED_SO else (0.0, 0) for block, text in pairs]
    known = in_known_language([d for d, (block, text) in zip(density, pairs, strict=True) if block.place < NAMED_SO and _size(text) >= SHORT and not _linked(block, text)])
    first = [first_pass(block, text, d, known and _latin(text), has_article) for (block, text), (d, _) in zip(pairs, density, strict=True)]
    side = lambda article: [label for (block, _), label, own in zip(pairs, first, free, strict=True) if own and block.article is article]
    labels = {True: iter(second_pass(side(True), article=True)), False: iter(second_pass(side(False), not has_article))}
    return [next(labels[block.article]) if own else bool(label) for (block, _), label, own in zip(pairs, first, free, strict=True)]


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by line ends."""
    pairs = [(block, block.text()) for block in blocks_of(page or "")]
    pairs = [(block, text) for block, text in pairs if text and not (block.tag == "li" and _linked(block, text))]
    labels = labels_of(pairs)
    if not any(labels) and any(block.place in (DOUBTFUL, NAMED_SO) for block, _ in pairs):
        for block, _ in pairs:
            block.place = block.place if block.place == TAGGED_SO else 0
        again = labels_of(pairs)
        prose = [first_pass(block, text, _density(text)[0], True, False) is True for block, text in pairs]
        labels = again if any(a and b for a, b in zip(again, prose, strict=True)) else labels
    return "\n".join(text for (_, text), label in zip(pairs, labels, strict=True) if label)


def extract(pages: DataFrame, carry: list[str], html_col: str = "html") -> DataFrame:
    """``carry``, ``text`` and ``n_chars`` of every page."""

    def run(*columns: pa.Array) -> list[pa.Array]:
        texts = [main_text(page) for page in columns[-1].to_pylist()]
        return [*columns[:-1], pa.array(texts, pa.string()), pa.array([len(text) for text in texts], pa.int64())]

    kinds = ", ".join(f"`{name}` {pages.schema[name].dataType.simpleString()}" for name in carry)
    return map_columns(pages, [*carry, html_col], f"{kinds}, text string, n_chars long", run)
