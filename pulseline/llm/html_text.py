"""Main text of web pages by two passes of rules over their blocks.

A page is cut into blocks at its block tags. The first pass decides on each block by itself: blocks in places that are
marked as menus, notices, forms and the like are boilerplate, and so are those that are
mostly links; long blocks with many stop words are text, long ones without are not; inside an article
element any long block is text. What is left, short blocks and headings above all, is ambiguous. The second pass gives each ambiguous block the
label of the nearest decided block, looked for in its own section first and then in those around it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.llm.common import prepare

#: Characters from which a block is long enough to be decided by its words, and from which many stop words make it text
#: for sure.
SHORT, LONG = 70, 200
#: The share of stop words of a text, and of a text for sure; the share of linked characters of a menu.
STOP_LOW, STOP_HIGH, LINKED = 0.3, 0.32, 0.33
#: Elements within one another, at most; deeper ones count as part of the last, as in browsers.
DEEPEST = 512
#: A page whose words have a smaller share of stop words is in a language that the list does not know.
KNOWN = 0.05

#: Stop words by language.
STOP_WORDS = {
    "en": "the of and a to in is that it for was on are as with his they at be this from have or by not but what all were we when your can there an which their if will do how then about",
    "de": "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux cette ont mais comme on tout nous sa leur était elle",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay",
}

#: Tags by their part in a page.
BLOCK_TAGS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose place is boilerplate, even for an article in them or but for one; elements that are skipped; and
#: those whose content is no markup.
ASIDE_TAGS = set("nav aside footer menu dialog".split())
BOILERPLATE_TAGS = set("form fieldset search".split())
SKIPPED_TAGS = set("head button select datalist svg math canvas object audio video map template noscript label".split())
RAW_TAGS = "script style textarea title iframe noembed noframes xmp"
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are sections of a page.
SECTIONS = set("article aside center details dialog div footer form header main nav section".split())
#: Elements that end where a sibling of the same kind begins.
SIBLINGS = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
#: Words of class, id and role that mark boilerplate, those of reader comments and lists beside the article, and those of its own frame.
MARKED = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs masthead header footer topbar sidebar aside widget cookie "
    "cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social pagination pager toolbar skip copyright disclaimer alert alertdialog dialog search form "
    "contentinfo complementary".split()
)
ASIDE = set("comment comments disqus replies respond reviews related recommended recommendations".split())
FRAME = set("article content main post entry story body page wrapper container text".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)"
    r"(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)"
    r"|</[^a-zA-Z][^>]*(?:>|\Z)",
    re.DOTALL,
)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.IGNORECASE) for t in RAW_TAGS.split()}
_ATTRIBUTE = re.compile(
    r"""(?:^|(?<=[\s"'/]))(class|id|role|hidden|style|aria-hidden|href)(?=[\s=/]|\Z)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""",
    re.IGNORECASE,
)
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

GOOD, BAD, OPEN = 1, 0, -1


@dataclass
class Element:
    """An open element: its tag, its section, and what its place says of the text in it."""

    tag: str
    section: int
    bad: bool
    skipped: bool
    article: bool
    #: In a place in which even an article is not the page's own.
    aside: bool


@dataclass
class Block:
    """A run of text between block tags."""

    section: int
    bad: bool
    article: bool
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: int = OPEN


def _attributes(rest: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(rest)} if rest.strip() else {}


class Cutter:
    """Cuts one page into blocks."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.stack = [Element("", 0, False, False, False, False)]
        #: The section around each section; that of the page is its own.
        self.around = [0]
        self.block: Block | None = None
        self.link: int | None = None  # the depth of the stack at which the open link began
        self.breaks = 0
        self._cut(page)

    def _cut(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            found = _TOKEN.search(page, at)
            if found is None:
                self._text(page[at:])
                break
            self._text(page[at : found.start()])
            at = found.end()
            whole = found[0]
            if whole.startswith("<![CDATA["):
                self._text(html.escape(whole[9:].removesuffix("]]>"), quote=False))
            if not found["tag"]:
                continue
            tag = found["tag"].lower()
            if found["end"]:
                self._close(tag)
                continue
            if tag in _RAW_END:
                stop = _RAW_END[tag].search(page, at)
                after = page.find(">", stop.end()) if stop else -1
                at = after + 1 if after >= 0 else end
                continue
            self._open(tag, found["rest"])
        self.block = None

    def _text(self, raw: str) -> None:
        top = self.stack[-1]
        if not raw or top.skipped:
            return
        text = html.unescape(raw)
        if self.block is None:
            if text.isspace():
                return
            heading = any(e.tag in HEADINGS for e in self.stack)
            self.block = Block(top.section, top.bad, top.article, heading)
            self.blocks.append(self.block)
        self.block.parts.append(text)
        if not text.isspace():
            self.breaks = 0
        if self.link is not None:
            self.block.linked += len("".join(text.split()))

    def _open(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.breaks += 1
            if self.breaks > 1:
                self.block = None
            elif self.block is not None:
                self.block.parts.append(" ")
            return
        if tag in BLOCK_TAGS:
            self.block, self.breaks = None, 0
        if tag in VOID_TAGS:
            return
        if tag == "body" and any(e.skipped for e in self.stack):
            # The head ends where the body begins.
            del self.stack[1:]
        if tag in SIBLINGS:
            self._end_sibling(SIBLINGS[tag])
        elif tag in BLOCK_TAGS and self.stack[-1].tag == "p":
            self._pop(len(self.stack) - 1)
        if tag == "a":
            self.link = len(self.stack) if _attributes(rest).get("href") else None
            return
        known = tag in BLOCK_TAGS or tag in SKIPPED_TAGS
        marks = _attributes(rest)
        if (known or marks) and len(self.stack) < DEEPEST:
            self.stack.append(self._element(tag, marks))

    def _element(self, tag: str, marks: dict[str, str]) -> Element:
        above = self.stack[-1]
        words = {
            w.lower() for k in ("class", "id", "role") if k in marks for w in _NAME.findall(marks[k])
        }
        hidden = "hidden" in marks or marks.get("aria-hidden", "").lower() == "true"
        hidden |= bool(_HIDDEN.search(marks.get("style", "")))
        aside = above.aside or hidden or tag in ASIDE_TAGS or bool(words & ASIDE)
        bad = above.bad or aside or tag in BOILERPLATE_TAGS
        if tag not in ("html", "body", "main", "article"):
            bad |= bool(words & MARKED) and not words & FRAME
        # A page's header is boilerplate, an article's has its title.
        bad |= tag == "header" and not above.article
        article = above.article
        if tag in ("article", "main") and not aside:
            article, bad = True, False
        section = above.section
        if tag in SECTIONS:
            self.around.append(section)
            section = len(self.around) - 1
        return Element(tag, section, bad, above.skipped or tag in SKIPPED_TAGS, article, aside)

    def _close(self, tag: str) -> None:
        if tag in BLOCK_TAGS or tag == "br":
            self.block = None
        if tag == "a":
            self.link = None
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            held = self.stack[depth].tag
            if held == tag:
                self._pop(depth)
                return
            # An inline end tag does not end the blocks around it.
            if tag not in BLOCK_TAGS and tag not in SKIPPED_TAGS and held in BLOCK_TAGS:
                return

    def _end_sibling(self, kinds: set[str]) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            held = self.stack[depth].tag
            if held in kinds:
                self._pop(depth)
                return
            if held in BLOCK_TAGS:
                return

    def _pop(self, depth: int) -> None:
        del self.stack[depth:]
        # A link that began inside ends here.
        if self.link is not None and self.link > depth:
            self.link = None


class Classifier:
    """Labels the blocks of a page."""

    def __init__(self, stop_words: dict[str, str] = STOP_WORDS):
        self.stop = {w for words in stop_words.values() for w in words.split()}

    def label(self, blocks: list[Block], around: list[int]) -> None:
        """Label the blocks, given the section around each section."""
        counts = []
        for b in blocks:
            words = _WORD.findall(b.text.lower())
            counts.append((sum(w in self.stop for w in words), len(words)))
        known = sum(s for s, _ in counts) >= KNOWN * sum(n for _, n in counts)
        for b, (stop, n) in zip(blocks, counts):
            b.label = self._first(b, stop / max(1, n) if known else 1.0)
        self._second(blocks, around)

    @staticmethod
    def _first(b: Block, stop: float) -> int:
        """The label that a block has by itself."""
        if b.bad or b.linked > LINKED * len("".join(b.text.split())):
            return BAD
        if len(b.text) < SHORT or b.heading:
            return OPEN
        if b.article or stop >= (STOP_LOW if len(b.text) >= LONG else STOP_HIGH):
            return GOOD
        return BAD if stop < STOP_LOW else OPEN

    @staticmethod
    def _second(blocks: list[Block], around: list[int]) -> None:
        """Labels for those that have none, from the nearest decided ones."""
        firsts = [*(b.label for b in blocks), BAD, BAD]  # the last two for either side of the page
        every = _decided(firsts[:-2])
        # A marked place within a section interrupts its text, it doesn't end it.
        own = _decided([OPEN if b.bad else b.label for b in blocks])
        spans = _spans(blocks, around)
        for i, b in enumerate(blocks):
            if firsts[i] != OPEN:
                continue
            # Sections hold runs of blocks: the innermost one with a decided neighbour says which count.
            section, near = b.section, []
            while True:
                low, high = spans[section]
                near = [j for j in (own if section == b.section else every)[i] if low <= j <= high]
                if near and section != b.section:
                    # What surrounds a page, beyond the section around it, is no text.
                    near += [-1] * (low == 0) + [len(blocks)] * (high == len(blocks) - 1)
                if near or section == 0:
                    break
                section = around[section]
            labels = {firsts[j] for j in near}
            if b.heading and firsts[every[i][1]] == GOOD:
                b.label = GOOD  # it belongs to what follows
            elif b.article:
                # Only what stands between links or marked places is not an article's text.
                b.label = BAD if section == b.section and len(near) == 2 and labels == {BAD} else GOOD
            elif near:
                b.label = min((abs(i - j), firsts[j]) for j in near)[1]
            else:
                b.label = GOOD
        if GOOD not in (b.label for b in blocks):
            # A page of short blocks alone: its text is what nothing by itself speaks against.
            for b, first in zip(blocks, firsts):
                b.label = GOOD if first == OPEN else BAD


def _decided(labels: list[int]) -> list[tuple[int, int]]:
    """For each place the nearest decided ones before and behind it; -1 and the length if there are none."""
    n = len(labels)
    before, behind = [-1] * n, [n] * n
    for i in range(1, n):
        before[i] = i - 1 if labels[i - 1] != OPEN else before[i - 1]
    for i in range(n - 2, -1, -1):
        behind[i] = i + 1 if labels[i + 1] != OPEN else behind[i + 1]
    return list(zip(before, behind))


def _spans(blocks: list[Block], around: list[int]) -> list[tuple[int, int]]:
    """The first and the last block in each section, in those it holds too."""
    low, high = [len(blocks)] * len(around), [-1] * len(around)
    for i, b in enumerate(blocks):
        low[b.section] = min(low[b.section], i)
        high[b.section] = i
    # A section is numbered behind the one around it.
    for s in range(len(around) - 1, 0, -1):
        low[around[s]] = min(low[around[s]], low[s])
        high[around[s]] = max(high[around[s]], high[s])
    return list(zip(low, high))


def extract(page: str | None, classifier: Classifier) -> str:
    """The main text of a page, one line per block; empty if it has none."""
    if not page:
        return ""
    cut = Cutter(page)
    for b in cut.blocks:
        b.text = " ".join("".join(b.parts).split())
    blocks = [b for b in cut.blocks if b.text]
    classifier.label(blocks, cut.around)
    return "\n".join(b.text for b in blocks if b.label == GOOD)


def main_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    stop_words: dict[str, str] = STOP_WORDS,
) -> DataFrame:
    """page_id, url, text and n_chars (code points of the text) of every page.

    Character references are decoded, white space inside a block becomes one blank, blocks are joined by one
    line feed in page order. A null or empty page, and one of markup and boilerplate only, has the empty text. A text without any
    tag is one block, and text as such unless it is long and without stop words. Ids and addresses may be null or
    repeated: every row is returned. An empty table gives no rows; other columns are ignored.
    """
    prepare(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(stop_words)
        for batch in batches:
            texts = [extract(x.as_py(), classifier) for x in batch.column("html")]
            arrays = [
                batch.column("page_id"),
                batch.column("url"),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
