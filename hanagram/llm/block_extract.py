"""Main text of web pages by two passes of block rules.

The first pass labels each block by itself: its place (navigation, forms, adverts, comments), its link density, its length
and its share of stop words. Blocks that stay open (short ones, headings, those of middling density) take in the second
pass the label of the nearest decided blocks, within an article those of the article.

Pages are read front to back by a scanner that never goes back, so that broken markup costs no more than any other.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, with raw text, that end a block, that hold no article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "noframes", "xmp")
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
BOILER = frozenset("nav footer aside form select option button menu dialog search fieldset head label datalist".split())
#: Words in class, id or role that name what isn't the article.
HINTS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer foot header masthead cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist disqus reply replies discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login widget toolbar pagination pager skip copyright legal disclaimer search form complementary contentinfo hidden tags".split())
#: Frequent words of four languages.
STOPWORDS = frozenset("the of and to in a is that it for on was be with as by at are this from or an not der die das und in zu den von mit ist des sich auf für als dem ein eine le la les de des et un une du en que qui dans pour par est sur au el los las y del se no con por su para una es lo al como".split())

#: Elements that an end tag of an inner element doesn't close.
SECTIONS = frozenset("article main section div body nav aside footer header form td table".split())
#: End tags that reach past such elements.
REACHING = frozenset("article main body html section div nav aside footer header form table".split())

_ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))")
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_TAG_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[>\"']")
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"&#(?:0*([0-9]*)|[xX]0*([0-9a-fA-F]*));?")


def decoded(text: str) -> str:
    """Character references as characters; a number beyond all characters, however long, is the replacement character."""
    if "&" not in text:
        return text
    return _html.unescape(_NUMBER.sub(lambda m: "\ufffd" if len(m[1] or m[2] or "") > 7 else m[0], text))


def scanned(page: str):
    """(text before it, closing, name, attributes) of each tag; name is empty for comments, declarations and the end. Raw elements
    have no content. A tag that never ends takes the rest of the page with it."""
    at = look = 0
    size, last = len(page), page.rfind(">")
    quotes = True  # until a quoted value runs to the end of the page: then a tag ends at the next >
    while (lt := page.find("<", look)) >= 0:
        m = _TAG_NAME.match(page, lt + 1 + page.startswith("/", lt + 1))
        if not m and not page.startswith(("!", "?", "/"), lt + 1):
            look = lt + 1  # a sign of its own
            continue
        if not m:
            end = page.find("-->", lt + 4) + 2 if page.startswith("<!--", lt) else page.find(">", lt)
            end = end if end > lt + 1 else size - 1
            yield page[at:lt], False, "", ""
            at = look = end + 1
            continue
        if lt > last:
            yield page[at:lt], False, "", ""
            return
        end = -1
        if quotes:
            look = m.end()
            while (q := _STOP.search(page, look)) and q[0] != ">":
                look = page.find(q[0], q.end()) + 1
                if not look:
                    q = None
                    break
            quotes = q is not None
            end = q.start() if q else -1
        if end < 0:
            end = page.find(">", m.end())
        name = m[0].lower()
        closing = page[lt + 1] == "/"
        yield page[at:lt], closing, name, page[m.end() : end]
        at = look = end + 1
        if name in _END and not closing:
            stop = _END[name].search(page, at)
            end = page.find(">", stop.end()) if stop else -1
            at = look = end + 1 if end >= 0 else size
    yield page[at:], False, "", ""


@dataclass
class Container:
    tag: str
    up: Container | None
    boiler: bool
    article: Container | None  # the outermost article or main element around it


@dataclass
class Block:
    container: Container
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    text: str = ""
    label: str = ""


def _hinted(attrs: str) -> bool:
    """Whether class, id or role names boilerplate, or the element isn't shown."""
    if "=" not in attrs:
        return bool(re.search(r"\bhidden\b", attrs))
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role") and not HINTS.isdisjoint(_NAME.findall(value)):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "aria-hidden" and value == "true":
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, with character references decoded and white space turned into single blanks."""
    out: list[Block] = []
    root = Container("", None, False, None)
    stack = [root]
    spots: dict[str, list[int]] = {}  # where in the stack each tag stands
    sections: list[int] = []
    links = False
    block = Block(root)

    def close() -> None:
        nonlocal block
        block.text = " ".join(decoded("".join(block.parts)).split())
        if block.text:
            out.append(block)
        block = Block(stack[-1], heading=stack[-1].tag[:1] == "h" and stack[-1].tag[1:].isdigit())

    def pop(to: int) -> None:
        while len(stack) > to:
            gone = stack.pop()
            spots[gone.tag].pop()
            if sections and sections[-1] == len(stack):
                sections.pop()

    for text, closing, tag, attrs in scanned(page):
        if text:
            block.parts.append(text)
            if links:
                block.linked += len("".join(decoded(text).split()))
        if tag == "br":
            block.parts.append("\n")
        elif tag == "a":
            links = not closing
        elif not tag or tag in _END and not closing:
            continue
        elif tag in VOID:
            if tag in BLOCK:
                close()
        elif closing:
            # An end tag closes what is open up to its element, but nothing outside a section for an inner tag's sake.
            if (at := spots.get(tag)) and (tag in REACHING or not sections or sections[-1] <= at[-1]):
                pop(at[-1])
            if tag in BLOCK:
                close()
        else:
            edge = tag in BLOCK
            if edge and stack[-1].tag == "p" or tag in ("li", "dd", "dt", "option", "tr", "td", "th") and stack[-1].tag == tag:
                pop(len(stack) - 1)  # it ends where another block begins
            if edge or tag in BOILER or _hinted(attrs):
                up = stack[-1]
                boiler = up.boiler or tag in BOILER or tag not in ("html", "body", "main", "article") and _hinted(attrs) or tag == "header" and not up.article
                new = Container(tag, up, boiler, up.article)
                if tag in ("article", "main") and not up.article:
                    new.article = new
                spots.setdefault(tag, []).append(len(stack))
                if tag in SECTIONS:
                    sections.append(len(stack))
                stack.append(new)
                if edge and tag != "p":
                    links = False
                if edge or boiler:
                    close()
    close()
    return out


def first_pass(block: Block, max_link_density: float, long: int, stop_high: float, stop_low: float) -> str:
    """good, bad or open for a block by itself."""
    n = len(block.text.replace(" ", ""))
    article = block.container.article is not None
    if block.container.boiler:
        return "bad"
    if block.linked > max_link_density * n:
        return "open" if article and n >= long else "bad"
    if not article and re.match(r"(?:©|\(c\)|copyright\b)", block.text, re.I):
        return "bad"
    if n < long or block.heading:
        return "open"
    words = _WORD.findall(block.text.lower())
    share = sum(w in STOPWORDS for w in words) / max(1, len(words))
    return "good" if share >= stop_high else "open" if article or share >= stop_low else "bad"


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Whether each block is kept: an open one inherits from the nearest decided blocks, a heading from the one that follows.

    Within an article (or main element) its own blocks count, without those of adverts, forms and the like in it; an open
    block goes only if all that it sees is bad, and where nothing is decided the article itself is evidence. Elsewhere a
    block stays if all decided blocks of its container are good, or the nearest ones on both sides.
    """
    own: dict[int, set[str]] = {}
    for b, label in zip(found, labels):
        if label != "open":
            own.setdefault(id(b.container.up or b.container), set()).add(label)
            own.setdefault(id(b.container), set()).add(label)
    # near[side][k]: the label of the nearest decided block before or after k, in its article or on the page.
    near: list[list[str | None]] = [[None] * len(found), [None] * len(found)]
    for side, order in enumerate((range(len(found)), range(len(found) - 1, -1, -1))):
        last: dict[int | None, str] = {}
        for k in order:
            b = found[k]
            place = id(b.container.article) if b.container.article else None
            near[side][k] = last.get(place)
            if labels[k] != "open":
                last[None] = labels[k]
                if place and not b.container.boiler:
                    last[place] = labels[k]
    kept = []
    for k, (b, label) in enumerate(zip(found, labels)):
        sides = [near[s][k] for s in (0, 1)]
        if label != "open":
            kept.append(label == "good")
        elif b.container.article:
            seen = [x for x in (sides[:0:-1] if b.heading and sides[1] else sides) if x]
            kept.append(not seen or "good" in seen)
        else:
            mine = own.get(id(b.container)) or own.get(id(b.container.up or b.container)) or set()
            kept.append(mine == {"good"} or (sides[1] == "good" if b.heading else sides == ["good", "good"]))
    return kept


def main_text(page: str | None, max_link_density: float = 0.5, long: int = 60, stop_high: float = 0.2, stop_low: float = 0.08) -> str:
    """The article's blocks joined by two newlines; empty for a null or empty page."""
    found = blocks(page or "")
    labels = [first_pass(b, max_link_density, long, stop_high, stop_low) for b in found]
    return "\n\n".join(b.text for b, k in zip(found, second_pass(found, labels)) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text, n_chars of each row of ``pages``; a null page has an empty text, repeated rows stay,
    other columns are not read. Row by row, so no shuffle."""

    def run(batches):
        for b in batches:
            text = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("h")).mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
