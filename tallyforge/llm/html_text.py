"""Main text of web pages by block rules in two passes.

Menus, forms, notices, adverts and comments that their elements or names mark are left out first. Pass 1 looks at each other block alone: the
share of its characters inside links, its length, and the share of its words that are stop words make it good, bad, near good,
weak (long enough, but few stop words) or short. Pass 2 decides the ambiguous ones by their nearest decided neighbours in the same
region, inside or outside the article: a short block takes the nearest one's label, a near-good one needs one good neighbour,
a weak one only good ones (outside an article on both sides). One scan of the page's tags feeds both; nothing is cut off.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import read

#: Frequent function words of the languages in the corpus.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so what up said its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made",
    "de": "der die das und in zu den ist nicht von mit sich des auf für als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man dem ein eine ich",
    "fr": "le la les de des et en un une du que qui dans est pour pas sur au par plus se ne ce sont avec il elle on nous vous mais ou où sa son ses leur cette aux être tout comme",
    "es": "el la los las de que y en un una por con no para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde",
}
#: Names in class, id and role that mark what isn't the article.
BAD_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog discussion disqus footer footnav form gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related recommended replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
BAD_TAGS = frozenset("nav footer aside form dialog menu head select button fieldset".split())
MAIN_TAGS = frozenset(("article", "main"))
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that contain others, so their end tags matter.
HOLDERS = frozenset("address article aside blockquote body center details dialog div dl fieldset figure footer form head header html main menu nav ol section select button table tbody td th tr ul".split())
#: Elements that are left out whole.
WHOLE = frozenset("script style noscript template textarea title iframe object svg math canvas audio video".split())
#: Of these, the two whose content is code to the end of the page if no end tag comes; of the others the tag alone is left out then.
CODE = frozenset(("script", "style"))
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|</?([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S,
)
#: The tag of a link that comes next: its end, or the start of another, which shows that the link before has no end.
NEXT_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in WHOLE}
#: A slash that an unquoted value ends with is part of the value.
UNQUOTED = re.compile(r"=\s*[^\s\"'=]*/\Z")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
#: Parts of a name that say how a page is laid out, not what an element is: with-sidebar, comments-open.
STATES = frozenset("with has have no not without is are hide hides hidden show shows open opened closed close enabled disabled on off active inactive allowed left right".split())
WORDS = re.compile(r"[^\W\d_]+")
STOPS = frozenset(w for words in STOP_WORDS.values() for w in words.split())
#: Thresholds of pass 1: short and long blocks in characters, stop-word share of good and of near-good blocks, share of characters in links.
SHORT, LONG, STOP_GOOD, STOP_NEAR, LINKS = 70, 200, 0.2, 0.12, 0.33


class Block:
    __slots__ = ("parts", "linked", "bad", "main", "heading", "text", "label", "share")

    def __init__(self, bad: int, main: bool, heading: bool):
        self.parts, self.linked, self.bad, self.main, self.heading, self.text, self.label, self.share = [], [], bad, main, heading, "", "", 0.0


def marks_bad(tag: str, attributes: str) -> int:
    """How an element's attributes mark it: 0 not; 1 by a part of a name only (site-footer), which may be wrong; 2 by a whole name, or as hidden.

    Pages as a whole, body and html, are never marked, main only as hidden, and article only by whole names.
    """
    if not attributes or tag in ("body", "html") or "=" not in attributes and "hidden" not in attributes.lower():
        return 0
    out = 0
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and NO_DISPLAY.search(value)):
            return 2
        if name.rsplit("-")[-1] in ("class", "id", "role") and tag != "main":
            for token in value.split():
                if token in BAD_NAMES:
                    out = 2
                elif not out and tag != "article":
                    parts = re.split(r"[^a-z0-9]+", token)
                    out = int(bool(BAD_NAMES.intersection(parts)) and not STATES.intersection(parts))
    return out


def end_of(page: str, m: re.Match, name: str, unended: set[str]) -> int:
    """Where the element of WHOLE ends whose tag is m. unended: names without a further end tag in the page, so that each is looked for once."""
    attributes = m[3] or ""
    if m[0].startswith("</") or (attributes.endswith("/") and not UNQUOTED.search(attributes)):
        return m.end()
    end = None if name in unended else ENDS[name].search(page, m.end())
    if end:
        return end.end()
    unended.add(name)
    return len(page) if name in CODE else m.end()


def blocks_of(page: str, least: int = 1) -> list[Block]:
    """The page's blocks in order, with the region that each stands in; marks below least don't count."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # tag, bad, main: of each and all above it
    block, links = Block(0, False, False), 0  # links: 1 in a link without an end, up to the block's end; 2 in one with an end

    def close(heading: bool = False, own: int = 0) -> Block:
        if block.parts:
            block.text = " ".join(html.unescape("".join(block.parts)).split())
            if block.text:
                out.append(block)
        return Block(max(own, stack[-1][1] if stack else 0), bool(stack and stack[-1][2]), heading)

    at, unended = 0, set()
    while m := TAG.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            block.parts.append(piece)
            if links:
                block.linked.append(piece)
        at = m.end()
        name = (m[2] or m[4] or "").lower()
        if name in WHOLE:
            at = end_of(page, m, name, unended)
            continue
        if not m[2]:
            continue
        if name == "a":
            after = None if m[1] else NEXT_LINK.search(page, at)
            links = 0 if m[1] else 2 if after and after[1] else 1
        elif name == "br":
            block.parts.append(" ")
        elif name in INLINE:
            pass
        elif m[1]:
            if name in HOLDERS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            block, links = close(), links & 2
        else:
            bad, main = (stack[-1][1], stack[-1][2]) if stack else (0, False)
            marked = marks_bad(name, m[3])
            marked = marked if marked >= least else 0
            if name in HOLDERS and name not in VOID:
                if name in MAIN_TAGS and bad == 1:
                    bad = 0  # an article is stronger than a part of a name around it
                bad = max(bad, marked, 2 * (name in BAD_TAGS or (name == "header" and not main)))
                stack.append((name, bad, main or (name in MAIN_TAGS and not bad)))
                block = close()
            else:
                block = close(name in ("h1", "h2", "h3", "h4", "h5", "h6"), marked)
            links &= 2
    if at < len(page):
        block.parts.append(page[at:])
    close()
    return out


def first_pass(block: Block, has_main: bool) -> str:
    """left (not looked at: marked, or outside the article), bad, short, good, near or weak."""
    if block.bad or (has_main and not block.main):
        return "left"
    n = len(block.text)
    linked = len(" ".join(html.unescape(" ".join(block.linked)).split())) if block.linked else 0
    if linked > LINKS * n:
        return "bad"
    words = WORDS.findall(block.text.lower())
    block.share = sum(w in STOPS for w in words) / max(1, len(words))
    if n < SHORT:
        return "short" if block.main or not linked else "bad"
    if block.share >= STOP_GOOD:
        return "good" if n > LONG else "near"
    return "near" if block.share >= STOP_NEAR else "weak"


def by_language(found: list[Block]) -> None:
    """If weak blocks hold more text than good and near-good ones, the page is in a language without stop words here, and length and link density decide."""
    weak = sum(len(b.text) for b in found if b.label == "weak")
    if weak > sum(len(b.text) for b in found if b.label in ("good", "near")):
        for b in found:
            if b.label == "weak":
                b.label = "good" if len(b.text) > LONG else "near"


def second_pass(found: list[Block]) -> None:
    """Decides short, near-good and weak blocks by the decided blocks before and after them in their region (the earlier, if two are as near).

    What pass 1 left out is no neighbour, and in the article links are none either: they say nothing about the paragraphs around them. A heading
    goes with what follows. In a region without decided blocks those of the article, near-good ones, and short ones with as
    many stop words as good ones, are good.
    """
    for main in (True, False):
        own = [b for b in found if b.main == main and b.label != "left"]
        decided = [b.label if b.label == "good" or (b.label == "bad" and not main) else "" for b in own]
        before, after = [None] * len(own), [None] * len(own)
        last = None
        for i, x in enumerate(decided):
            last = i if x else last
            before[i] = last
        last = None
        for i in range(len(own) - 1, -1, -1):
            last = i if decided[i] else last
            after[i] = last
        for i, b in enumerate(own):
            if b.label not in ("short", "near", "weak"):
                continue
            p, q = before[i], after[i]
            sides = [decided[x] for x in (p, q) if x is not None]
            if not sides:
                good = main or b.label == "near" or (b.label == "short" and b.share >= STOP_GOOD)
            elif b.label == "near":
                good = "good" in sides
            elif b.label == "weak":
                good = "bad" not in sides and (main or len(sides) == 2)
            elif p is None or (q is not None and (q - i < i - p or b.heading)):
                good = decided[q] == "good"
            else:
                good = decided[p] == "good"
            b.label = "good" if good else "bad"


def judged(page: str, least: int, whole: bool) -> tuple[list[Block], bool]:
    """The blocks of a page with their last labels, and whether it has an article; whole: the article's tags count for nothing."""
    found = blocks_of(page, least)
    has_main = any(b.main and not b.bad for b in found)
    for b in found:
        b.main = b.main and not whole
        b.label = first_pass(b, has_main and not whole)
    by_language(found)
    first = [b.label for b in found]
    second_pass(found)
    if not any(b.label == "good" for b in found):
        # a page of a few short paragraphs and nothing else: what no rule has called bad by itself
        for b, label in zip(found, first, strict=True):
            b.label = "good" if label in ("short", "near", "weak") else b.label
    return found, has_main


def good_length(found: list[Block]) -> int:
    return sum(len(b.text) for b in found if b.label == "good")


def extract(page: str) -> str:
    """The main text of a page: its good blocks, one to a line.

    The article's tags are a hint: if the rules find more text outside than in it, it is a teaser, and the page is read without them. If marks by
    parts of names leave no text, the page is read without those.
    """
    text = ""
    for least in (1, 2):
        found, has_main = judged(page, least, False)
        marked = any(b.bad == 1 for b in found)
        if has_main and sum(len(b.text) for b in found if not b.bad and not b.main) > good_length(found):
            every, _ = judged(page, least, True)
            inside = [b.main and not b.bad for b in found]
            outside = sum(len(b.text) for b, own in zip(every, inside, strict=True) if b.label == "good" and not own)
            if outside > good_length(found):
                found = every
        text = "\n".join(b.text for b in found if b.label == "good")
        if text or not marked:
            break
    return text


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each page.

    Null or empty html gives an empty text. Repeated rows give a row each, an empty table none. Pages are worked on whole, each for itself.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(x) if x else "" for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
