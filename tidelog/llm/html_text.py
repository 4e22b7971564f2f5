"""HTML extraction by two passes of block rules.

The page is cut into blocks at block-level tags. The first pass decides each
block from its length, link density and share of stop words, or leaves it
ambiguous; what stands in menus, forms or marked boilerplate is bad at once.
The second pass gives ambiguous blocks the label of the nearest decided
neighbours. An article element is evidence only: blocks inside it are judged
by looser values of the same rules and by neighbours inside it, and lean to
good where none is decided; blocks outside lean to bad.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import in_slices, table

#: Very frequent words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and are as at be been but by can could do for from had has have he her his how i if
    in into is it its more no not of on one only or other our out she so some than that the their them there these
    they this to up was we were what when which who will with would you your
    au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas pour
    qu que qui sa se ses son sont sur un une vous
    aber als am auch auf aus bei bin bis das dass dem den der die doch ein eine einem einen einer er es für haben hat
    ich ihr im ist mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war wenn wie wird zu zum zur
    al como con del desde donde el ella ellos entre era esta este fue hay las lo los más muy nos o para pero por porque
    se si sin sobre su sus también todo tu una y ya""".split()
)
#: Elements whose content is never text of the page.
RAW = "script|style|title|textarea|noscript|iframe|template|svg|select|object|canvas"
#: Elements that hold menus, forms and other matter around the article.
AROUND = frozenset("nav footer aside form button menu dialog fieldset label".split())
#: Of those, elements that some sites put around the whole page.
WRAPPERS = frozenset("form fieldset label".split())
#: Whole tokens of a class, id or role that mark such matter.
MARKED = frozenset(
    """ad ads advert adverts advertisement advertisements advertising ad-banner ad-container banner-ad sponsor sponsored
    sponsored-content promo promotion cookie cookies cookie-notice cookie-banner cookie-bar cookie-consent consent gdpr
    newsletter newsletter-signup subscribe signup login modal overlay popup sidebar widget menu menus nav navbar
    navigation breadcrumb breadcrumbs pagination pager footer site-footer page-footer copyright comments comment-list
    respond replies disqus disqus_thread share sharing share-buttons social-share social-links related related-posts
    related-articles recommended complementary contentinfo toolbar skip-link""".split()
)
HEADERS = frozenset("header masthead topbar".split())
ARTICLE = frozenset("article main".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary
    table tbody tfoot thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

#: Shorter blocks are ambiguous; from LONG characters a block needs no neighbours.
SHORT, LONG = 70, 200
#: The most of a good block's characters in links, and the least shares of stop words of ambiguous and good blocks.
MOST_LINKED, STOP_LOW, STOP_HIGH = 0.33, 0.18, 0.25
#: The same inside an article, where a block is bad only if it is long, all but links, and without stop words.
MOST_LINKED_INSIDE, STOP_LOW_INSIDE, STOP_HIGH_INSIDE = 0.8, 0.06, 0.18
#: An article with less than this part of the page's text isn't what the page is about.
LEAST_ARTICLE = 0.2
#: A marked element with more than this part of the page's text isn't around it, but holds it.
MOST_TEXT = 0.5
#: Letters of scripts without spaces, each of which says as much as about three letters of the others.
_DENSE = re.compile("[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0e7f]")

_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^<>]*+>"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/><]*+)(?P<rest>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORDS = re.compile(r"\w+")
GOOD, BAD, NEAR, UNSURE = "good", "bad", "near", "short"


@dataclass
class Block:
    """Text between two block-level tags and what is known of it."""

    text: str
    linked: int
    around: bool
    inside: bool
    heading: bool
    exact: bool = False
    label: str = field(default=UNSURE)


@dataclass
class Mark:
    """An element that its class, id or role, or a wrapping tag, sets apart, and the text in it: sums where it ends less those where it begins."""

    inside: bool
    outer: Mark | None
    chars: int
    linked: int
    ended: bool = False
    apart: bool = False


def _is_around(tag: str, inside: bool) -> bool:
    return (tag in AROUND and tag not in WRAPPERS) or (tag in HEADERS and not inside)


def _is_marked(tag: str, rest: str, inside: bool) -> bool:
    if tag in WRAPPERS:
        return True
    if not rest or tag in ARTICLE or tag in ("body", "html"):
        return False
    words = {w for groups in _NAMED.findall(rest) for part in groups for w in part.lower().split()}
    return bool(words & MARKED) or (not inside and bool(words & HEADERS))


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, empty ones left out."""
    found: list[Block] = []
    places: dict[str, list[int]] = defaultdict(list)  # where in `opened` each tag is
    opened: list[tuple[str, bool, bool, Mark | None, bool, bool]] = []  # tag, around the article, in an article, innermost mark, table or code, marked itself
    within: list[tuple[Block, Mark | None]] = []
    marks: list[Mark] = []  # outer ones first
    sums = {"chars": 0, "linked": 0}  # over what is not around the article
    texts: list[str] = []
    links = {"depth": 0, "chars": 0}
    heading = ""

    def close() -> None:
        nonlocal heading
        text = " ".join(html.unescape("".join(texts)).split())
        if text:
            _, around, inside, mark, exact, _ = opened[-1] if opened else ("", False, False, None, False, False)
            found.append(Block(text, min(len(text), links["chars"]), around, inside, bool(heading), exact))
            within.append((found[-1], mark))
            if not around:
                sums["chars"] += len(text)
                sums["linked"] += found[-1].linked
        texts.clear()
        links["chars"] = 0

    def say(text: str) -> None:
        texts.append(text)
        if links["depth"]:
            links["chars"] += len(" ".join(html.unescape(text).split()))

    def end(mark: Mark) -> None:
        mark.chars, mark.linked, mark.ended = sums["chars"] - mark.chars, sums["linked"] - mark.linked, True

    def drop() -> None:
        tag, _, _, mark, _, marked = opened.pop()
        places[tag].pop()
        if marked and mark:
            end(mark)

    last = 0
    for token in _TOKEN.finditer(page):
        if token.start() > last:
            say(page[last : token.start()])
        last = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if tag == "a":
            links["depth"] = 0 if token["end"] else 1
            continue
        if tag in ("br", "td", "th"):
            texts.append(" ")
            continue
        if tag not in BLOCKS and (tag in VOID or not _NAMED.search(token["rest"] or "") and tag not in AROUND and not token["end"]):
            continue
        if tag in BLOCKS or (not token["end"] and (_is_around(tag, False) or _is_marked(tag, token["rest"], False))):
            close()
            heading = tag if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and not token["end"] else ""
        if tag in VOID:
            continue
        if token["end"]:
            links["depth"] = 0  # a link left open ends with the block around it
            if places[tag]:
                i = places[tag][-1]
                if any(x[1] or x[3] for x in opened[i:]):
                    close()
                while len(opened) > i:
                    drop()
            continue
        # a paragraph ends where another block begins, a list item at the next one
        if opened and tag in BLOCKS and opened[-1][0] == "p":
            drop()
        if opened and opened[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "option"):
            drop()
        _, around, inside, mark, exact, _ = opened[-1] if opened else ("", False, False, None, False, False)
        marked = _is_marked(tag, token["rest"], inside)
        if marked:
            mark = Mark(inside, mark, sums["chars"], sums["linked"])
            marks.append(mark)
        article = tag in ARTICLE or bool(re.search(r"""role\s*=\s*["']?main\b""", token["rest"]))
        places[tag].append(len(opened))
        opened.append((tag, around or _is_around(tag, inside), inside or article, mark, exact or tag in ("pre", "table"), marked))
    if last < len(page):
        rest = page[last:]
        say(re.sub(r"<(?:/?[a-zA-Z][^<>]*|!-*)?\Z", "", rest))
    close()
    for mark in marks:
        if not mark.ended:
            end(mark)
        mark.apart = _stands_apart(mark, sums["chars"]) or bool(mark.outer and mark.outer.apart)
    for block, mark in within:
        block.around = block.around or bool(mark and mark.apart)
    return found


def _stands_apart(mark: Mark, whole: int) -> bool:
    """Whether a marked element is matter around the article; inside one it must be short or mostly links, too."""
    if mark.inside:
        return mark.chars < SHORT or mark.linked > MOST_LINKED * mark.chars
    return mark.chars <= MOST_TEXT * whole or mark.linked > MOST_LINKED * mark.chars


def _share(words: list[str]) -> float:
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def decide(block: Block, fits: bool = True) -> str:
    """First pass: the label of one block by itself; where no list of stop words fits, by length and links."""
    length = len(block.text) if fits else len(block.text) + 2 * len(_DENSE.findall(block.text))
    linked = block.linked / len(block.text)
    share = _share(_WORDS.findall(block.text.lower()))
    if block.around:
        return BAD
    if block.inside:
        if linked > MOST_LINKED_INSIDE:
            return BAD if length > LONG and share < STOP_LOW_INSIDE else UNSURE
        if length < SHORT:
            return UNSURE
        if not fits or block.exact or share >= STOP_HIGH_INSIDE:
            return GOOD
        return NEAR
    if linked > MOST_LINKED or block.text.startswith("©"):
        return BAD
    if length < SHORT:
        return BAD if block.linked else UNSURE
    if not fits:
        return GOOD if length > LONG else NEAR
    if share >= STOP_HIGH:
        return GOOD if length > LONG else NEAR
    return NEAR if share >= STOP_LOW or block.exact else BAD


def inherit(blocks: list[Block], first: list[str]) -> list[str]:
    """Second pass over the blocks of one region, in page order: NEAR ones first, then UNSURE ones.

    A NEAR block is long enough to stand where either nearest decided
    neighbour is good, or where no block is. An UNSURE one needs good
    neighbours on both sides; a heading, only one after it. Inside an article a
    side without a decided block counts as good.
    """
    lean = [GOOD if b.inside else BAD for b in blocks]

    def nearest(labels: list[str], ordered: range) -> list[str]:
        """For each place the last decided label before it in this order."""
        seen, out = None, [BAD] * len(labels)
        for i in ordered:
            out[i] = seen or lean[i]
            if labels[i] in (GOOD, BAD):
                seen = labels[i]
        return out

    forth, back = range(len(blocks)), range(len(blocks) - 1, -1, -1)
    before, after = nearest(first, forth), nearest(first, back)
    good = GOOD in first
    second = [(GOOD if GOOD in (before[i], after[i]) or not good else BAD) if first[i] == NEAR else first[i] for i in forth]
    before, after = nearest(second, forth), nearest(second, back)
    return [(GOOD if after[i] == GOOD and (blocks[i].heading or before[i] == GOOD) else BAD) if second[i] == UNSURE else second[i] for i in forth]


def label(found: list[Block]) -> None:
    """Both passes over the blocks of a page.

    Inside and outside an article neighbours are looked for apart, and what is
    set apart within an article says nothing of the blocks beside it. Where a
    page has an article with a fair part of its text, what is outside is bad.
    """
    own = [b for b in found if not b.around]
    inside = sum(len(b.text) for b in own if b.inside)
    article = inside > 0 and inside >= LEAST_ARTICLE * sum(len(b.text) for b in own)
    if not article:
        for block in own:
            block.inside = False
    # where a page as a whole has too few stop words, no list fits its language
    judged = [b for b in own if b.inside == article]
    fits = _share(_WORDS.findall(" ".join(b.text for b in judged if not b.exact).lower())) >= (STOP_LOW_INSIDE if article else STOP_LOW)
    for block in found:
        block.label = BAD
    region = judged if article else found
    for block, decided in zip(region, inherit(region, [decide(b, fits) for b in region]), strict=True):
        block.label = decided


def extract(page: str) -> str:
    """The main text of one page: its good blocks, one a line."""
    found = blocks(page)
    label(found)
    return "\n".join(b.text for b in found if b.label == GOOD)


def extract_pages(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """`id, url, text, n_chars` for every page; other columns are ignored.

    A null html counts as an empty page; a page without good blocks has an
    empty text. Pages are read whole, repeated rows each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, 2):
                texts = [extract(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    url = F.col("url").cast("string") if "url" in df.columns else F.lit(None).cast("string")
    own = df.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return own.mapInArrow(run, "id long, url string, text string, n_chars long")


def op7_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of `pages`."""
    return extract_pages(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
