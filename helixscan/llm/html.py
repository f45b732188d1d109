"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block tags.  Pass 1 decides blocks by what encloses them (menus and
the like are bad), by link density, length and stop-word density; blocks too short to tell, headings, and long ones without
stop words stay open.  Pass 2 gives an open block the label of its nearest decided neighbours in the same
region; the page's own article element, and what stands inside it that is no article, are regions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import as_texts, restored, set_aside, slices

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; what they hold is not text of the page.
RAW = frozenset("script style noscript template textarea select svg iframe object title head audio video canvas".split())
#: Of these, the ones that hold what is shown in their place: inside the article's own element that is text like any.
FALLBACK = frozenset("noscript object audio video canvas".split())
#: Of these, the ones that end with the page if they aren't closed; the others are then markup like any.
TO_END = frozenset("script style template textarea iframe title".split())
OUTSIDE = frozenset("nav footer aside form menu dialog header fieldset".split())
MAIN = frozenset("article main".split())
#: Words in a class, an id or a role that name what is not the article.
OUTSIDE_WORD = re.compile(
    r"^(ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|overlay|modal|newsletter|subscri\w*|signup|signin|login|register|"
    r"sidebar|side|aside|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar|comments?|replies|reply|respond|discussion|disqus|related|recommend\w*|"
    r"share|sharing|social|widget|pagination|pager|search|skip|complementary|contentinfo|form|disclaimer|copyright|tags)$"
)
#: Of these, the ones that other names may also be made of: they count if no other kind of word stands beside them.
WEAK_WORD = re.compile(r"^(form|side|search|alert|register|skip|tags)$")
MAIN_WORD = re.compile(r"^(article|main|post|entry|story|articlebody|maincontent)$")
#: Words that say where or how a part stands, not what it is.
NEUTRAL_WORD = re.compile(
    r"^(|[0-9]+(x[0-9]+)?|wrap(per)?|container|holder|box|block|section|area|panel|bar|list|items?|unit|slot|body|content|inner|outer|text|group|row|col(umn)?|left|right|top|bottom|"
    r"site|page|global|primary|secondary|js|the|my|buttons?|links?|module|component|region)$"
)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\"']*)([^<>\"']*)>")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HREF = re.compile(r"\bhref\b", re.I)
WITH = re.compile(r"(^|[_\-])(has|no|with|without)[_\-].*$", re.I | re.S)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"\w+")
#: Frequent words of the languages that the pages are in (fixed values).
STOP = frozenset(
    "a about all an and are as at be been but by can could do for from had has have he her his how i if in into is it its more my no not of on one or our out said she so some "
    "than that the their them then there they this to up was we were what when which who will with would you your "
    "au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tu un une vos votre vous "
    "aber als am auch auf aus bei bin bis da das dass dem den der die dies du durch ein eine einem einen einer es für hat hatte ich ihr im ist ja kann mein mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur "
    "al como con cuando del desde donde dos el ella ellos entre era es esa ese eso esta este esto fue ha hasta hay la las le lo los más mi muy ni nos o para pero por porque que quien se ser si sin sobre su sus también todo un una uno y ya".split()
)
#: Share of linked characters above which a block is a menu; stop-word densities of good blocks, and of good blocks
#: that are long; least characters of a long block and of one that is not too short to tell.
LINKED, DENSE, SPARSE, LONG, SHORT = 0.33, 0.25, 0.1, 140, 60
#: So many linked list items one after the other are a menu, but for those inside the article's own element, such as its sources.
LINK_RUN = 3
#: The page's own element counts if it has at least this share of what is good outside of it.
TEASER = 0.125
GOOD, BAD, OPEN = 1, 0, -1


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    outside: bool  # enclosed by a menu, header, footer, sidebar, notice, advert, form or comments
    main: bool  # enclosed by the article's own element
    heading: bool
    item: bool = False  # of a list
    region: int = 0  # number of the innermost element that is main or outside

    def link_density(self) -> float:
        return self.linked / max(1, len(self.text))

    def stop_density(self) -> float:
        words = WORD.findall(self.text.lower())
        return sum(w in STOP for w in words) / max(1, len(words))


def tag_end(html: str, at: int, open_quotes: dict[str, bool]) -> int:
    """The place after the tag that begins at ``at``, with ``>`` inside quotes skipped."""
    i = at + 1
    while True:
        end = html.find(">", i)
        if end < 0:
            return len(html)
        quote = min((q for q in (html.find('"', i, end), html.find("'", i, end)) if q >= 0), default=-1)
        if quote < 0:
            return end + 1
        mark = html[quote]
        close = -1 if open_quotes.get(mark) else html.find(mark, quote + 1)
        if close < 0:  # none follows: the mark is an ordinary character from here on
            open_quotes[mark] = True
            return end + 1
        i = close + 1


def kind_of(name: str) -> str:
    """``outside``, ``main`` or nothing, by the words of a class, an id or a role.

    What stands after has, no, with or without only tells what is near.  The last word that says what
    something is decides: comments of a post are comments, a form of a post is a post's."""
    words = [w for w in re.split(r"[_\-]+", WITH.sub("", name.lower())) if not NEUTRAL_WORD.match(w)]
    if words and OUTSIDE_WORD.match(words[-1]) and (not WEAK_WORD.match(words[-1]) or all(map(OUTSIDE_WORD.match, words))):
        return "outside"
    return "main" if words and all(map(MAIN_WORD.match, words)) else ""


def kinds_of(attributes: str) -> set[str]:
    return {kind_of(name) for m in NAMED.finditer(attributes) for value in m.groups() if value for name in value.split()}


def page_blocks(html: str) -> list[Block]:
    """Blocks with text, in page order.  Unclosed and stray tags are allowed."""
    blocks: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool, bool, bool, int]] = []  # open elements: name, what they add to outside, main, solid, classed, region before
    unclosed: set[str] = set()
    opened: Counter = Counter()
    outside = main = solid = classed = links = linked = 0
    heading = item = False
    region = regions = 0
    quotes: dict[str, bool] = {}

    def flush() -> None:
        nonlocal linked, links
        if parts and (text := SPACE.sub(" ", "".join(parts)).strip()):
            blocks.append(Block(text, min(linked, len(text)), outside > 0, main > 0, heading, item, region))
        parts.clear()
        if linked:  # a link around blocks goes on, one with text of its own ends with its block
            links = 0
        linked = 0

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        lt = n if lt < 0 else lt
        if lt > at:
            text = unescape(html[at:lt])
            parts.append(text)
            if links:
                linked += len(text.strip())
            at = lt
            continue
        m = TAG.match(html, at)
        if m:
            closing, name, rest, end = m[1], m[2].lower(), m[3], m.end()
        elif html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        elif html.startswith(("<!", "<?"), at):
            at = tag_end(html, at, quotes)
            continue
        elif m := NAME.match(html, at):
            end = tag_end(html, at, quotes)
            closing, name, rest = "/" * (html[at + 1] == "/"), m[1].lower(), html[m.end() : end - 1]
        else:
            parts.append("<")
            at += 1
            continue
        at = end
        if name in RAW and not closing and not (main and name in FALLBACK):
            if not rest.rstrip().endswith("/"):
                close = None if name in unclosed else re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
                if close:
                    at = close.start()
                elif name in TO_END:
                    at = n
                else:
                    unclosed.add(name)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            flush()
        if name == "a":
            links = int(not closing and bool(HREF.search(rest)))  # without an address it is a mark in the text
            continue
        if name == "li":
            item = not closing
        if name in VOID or rest.rstrip().endswith("/") and not closing:
            continue
        if closing:
            if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = False
            if opened[name]:
                while True:
                    top, a, b, c, d, region = stack.pop()
                    opened[top] -= 1
                    outside -= a
                    main -= b
                    solid -= c
                    classed -= d
                    if top == name:
                        break
        elif name in BLOCK and name not in ("p", "html", "body") or name in ("span", "section"):
            if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = True
            named = kinds_of(rest) if "=" in rest else set()
            d = "outside" in named
            c = name in OUTSIDE and name != "form" and not (name == "header" and main)
            a = int(c or d or name == "form")
            if not a and not solid and (name == "main" or name == "article" and not classed):
                a = -outside  # the page's own element inside a form, and main inside a wrapper named otherwise
            b = name in MAIN or "main" in named
            stack.append((name, a, b, c, d, region))
            if a or b:
                regions += 1
                region = regions
            opened[name] += 1
            outside += a
            main += b
            solid += c
            classed += d
    flush()
    return blocks


def decided(blocks: list[Block]) -> list[int]:
    """Pass 1."""
    out = []
    for b in blocks:
        dense = b.stop_density()
        if b.outside:
            out.append(BAD)
        elif b.link_density() > LINKED:
            out.append(OPEN if b.main else BAD)  # a linked paragraph of the article, or a menu
        elif b.text.startswith(("©", "(c)")):
            out.append(OPEN if b.main else BAD)
        elif len(b.text) < SHORT or b.heading:
            out.append(OPEN)
        else:
            out.append(GOOD if dense >= (SPARSE if len(b.text) >= LONG else DENSE) else OPEN)
    run: list[int] = []
    for i, b in enumerate([*blocks, Block("", 0, False, False, False)]):
        if b.item and b.link_density() > 0.9:
            run.append(i)
            continue
        if len(run) >= LINK_RUN:
            for k in run:
                out[k] = out[k] if blocks[k].main else BAD
        run = []
    own = sum(len(b.text) for b, label in zip(blocks, out, strict=True) if b.main and label != BAD)
    others = sum(len(b.text) for b, label in zip(blocks, out, strict=True) if not b.main and label == GOOD)
    if own and own >= TEASER * others:  # the page says itself where its article is
        out = [label if b.main else BAD for b, label in zip(blocks, out, strict=True)]
    return out


def nearest_decided(labels: list[int], places: list[int]) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """For each of ``places`` the label of the decided one before and its distance, and the same after; OPEN if there is none."""
    out: list[list[tuple[int, int]]] = []
    for order in (places, places[::-1]):
        last, side = (OPEN, len(labels)), []
        for i in order:
            last = (labels[i], 0) if labels[i] != OPEN else (last[0], last[1] + 1)
            side.append(last)
        out.append(side)
    return list(zip(out[0], out[1][::-1], strict=True))


def inherited(blocks: list[Block], labels: list[int]) -> list[int]:
    """Pass 2: an open block gets the label that its nearest decided neighbours of the same region share; where they differ a
    heading follows the block after it, and any other block the nearer one, the one before on a tie.
    In a region where nothing is decided, open blocks of the article's own element are good, others follow the whole page's
    neighbours.  A page where nothing is decided consists of open blocks alone; they are its text."""
    if all(label == OPEN for label in labels):
        return [GOOD] * len(labels)
    regions: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        regions.setdefault(b.region, []).append(i)
    everywhere = nearest_decided(labels, list(range(len(labels))))
    out = list(labels)
    for places in regions.values():
        for i, near in zip(places, nearest_decided(labels, places), strict=True):
            if labels[i] != OPEN:
                continue
            if near[0][0] == near[1][0] == OPEN:
                if blocks[i].main:
                    out[i] = GOOD
                    continue
                near = everywhere[i]
            (a, da), (b, db) = near
            out[i] = b if a == OPEN else a if b == OPEN or a == b else b if blocks[i].heading else a if da <= db else b
    return out


def main_text(html: str) -> str:
    blocks = page_blocks(html)
    labels = inherited(blocks, decided(blocks))
    return "\n".join(b.text for b, label in zip(blocks, labels, strict=True) if label == GOOD)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``text`` (the main text; empty if there is none) and ``n_chars`` (its code points) to the
    rows and leaves the html out.  A null html counts as empty; of neighbours equally near the one before decides.  Repeated rows repeat, an empty table
    gives an empty table, and columns named like the new ones are replaced."""
    df = set_aside(pages, html).withColumnRenamed(html, "_html")
    schema = StructType([*(f for f in df.schema.fields if f.name != "_html"), StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_html"):
                texts = [main_text(x) if x else "" for x in as_texts(batch.column("_html"))]
                kept = [c for c in batch.schema.names if c != "_html"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return restored(df.mapInArrow(run, schema), [c for c in pages.columns if c != html], "text", "n_chars")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
