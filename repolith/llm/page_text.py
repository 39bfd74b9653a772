"""Main text of web pages: blocks are classified by rules, then ambiguous ones take the label of their neighbours."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm.common import in_python, quoted, schema_of

# Frequent function words of English, French, Spanish and German.
STOP_WORDS = frozenset((
    "a an and are as at be but by for from had has have he his i in is it its not of on or that the their this they to was were which will with you "
    "au aux avec ce dans des du elle en est et il je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con de del el es ha las lo los más muy no o para pero por se si sin su sus también una y ya "
    "aber als am auch auf aus bei bin das dass dem den der des die du ein eine einen einer er es für hat ich im ist mit nach nicht oder sein sich sie sind so um und von war wie wir zu zum zur"
).split())
#: Shorter blocks (in characters) are ambiguous; from LONG on, a block of many stop words is good at once.
SHORT, LONG = 70, 200
#: Least share of stop words among the words of prose; largest share of characters in links.
STOPS, LINKED = 0.2, 0.5

# Elements of HTML by what they do to the text around them.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_ARTICLE = frozenset(("article", "main"))
_OUTSIDE = frozenset("nav footer aside menu dialog noscript template svg canvas audio video object map button select datalist fieldset".split())
#: These hold a page's article now and then; inside them an article counts all the same.
_AROUND = frozenset(("header", "form"))
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_HINTS = frozenset((
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside "
    "footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations comment comments respond disqus pagination pager copyright disclaimer"
).split())
_TURNED = frozenset(("has", "no", "with", "without", "is", "not", "hide", "off"))

_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOPPING = re.compile(r"""[>"']""")
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_PARTS = re.compile(r"[^a-z0-9]+")
GOOD, BAD, AMBIGUOUS = "good", "bad", "ambiguous"


@dataclass
class Block:
    """A run of text between block elements. inside: within an article; outside: within a menu, footer, advert and so on."""

    text: str
    heading: bool
    linked: int
    inside: bool
    outside: bool
    words: int = 0
    stops: int = 0
    label: str = AMBIGUOUS


def tokens(html: str):
    """(tag, attributes, closing) of tags and (None, text, False) of texts, in order, in linear time.

    Comments, declarations, and elements whose content is no markup (scripts, styles, titles) give nothing. A quote that
    is never closed is a sign like any other.
    """
    at, size, absent = 0, len(html), set()
    while at < size:
        start = html.find("<", at)
        if start < 0:
            yield None, html[at:], False
            return
        closing = html.startswith("/", start + 1)
        name = _NAME.match(html, start + 1 + closing)
        if not name:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                end = size if end < 0 else end + 3
            elif html[start + 1 : start + 2] in ("!", "?", "/"):
                end = html.find(">", start)
                end = size if end < 0 else end + 1
            else:  # a sign in the text
                end = html.find("<", start + 1)
                end = size if end < 0 else end
                yield None, html[at:end], False
                at = end
                continue
            if start > at:
                yield None, html[at:start], False
            at = end
            continue
        if start > at:
            yield None, html[at:start], False
        begin = end = name.end()
        while True:
            sign = _STOPPING.search(html, end)
            if not sign or sign[0] == ">":
                break
            end = sign.end()
            if sign[0] not in absent:
                after = html.find(sign[0], end)
                if after < 0:
                    absent.add(sign[0])
                else:
                    end = after + 1
        last = sign.start() if sign else size
        at, tag = last + 1, name[0].lower()
        if not sign:
            return  # a tag that the page's end cuts off
        yield tag, html[begin:last], closing
        if tag in _RAW and not closing:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            at = end.start() if end else size


def hinted(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element's attributes make it an article, or something outside one."""
    if not attributes or tag in ("html", "body"):
        return False, False
    article = outside = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "role":
            article |= value.lower() in ("main", "article")
            outside |= value.lower() in _ROLES
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            outside = True
        elif name in ("class", "id") and tag not in _ARTICLE:
            for one in value.split():
                parts = _PARTS.split(_CAMEL.sub("-", one).lower())
                outside |= parts[0] not in _TURNED and not _HINTS.isdisjoint(parts)
    return article, outside


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order: white space is one blank, character references are decoded, markup is gone."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []
    inside = outside = heading = False
    pieces: list[str] = []
    anchors = linked = 0
    broken = 0

    def flush():
        nonlocal linked
        if text := " ".join("".join(pieces).split()):
            found.append(Block(text, heading, min(linked, len(text)), inside, outside))
        pieces.clear()
        linked = 0

    for tag, said, closing in tokens(html):
        if tag is None:
            text = unescape(said) if "&" in said else said
            pieces.append(text)
            if anchors:
                linked += len(" ".join(text.split()))
            broken = 0 if broken and not text.isspace() else broken
        elif tag == "br":
            broken += 1
            pieces.append(" ")
            if broken > 1:
                flush()
        elif tag == "a":
            anchors = 0 if closing else 1
        elif tag in _RAW:
            continue
        elif tag in _INLINE:
            article, out = (False, False) if closing or not said else hinted(tag, said)
            if out and not closing:  # an inline advert or button: as a block of its own
                flush()
                stack.append((tag, inside, outside))
                outside = True
            elif closing and stack and stack[-1][0] == tag:
                flush()
                _, inside, outside = stack.pop()
        else:
            flush()
            broken = 0
            heading = tag in _HEADINGS and not closing
            if tag in _VOID or tag in _HEADINGS or tag == "p" and not said:
                continue
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        _, inside, outside = stack[k]
                        del stack[k:]
                        break
                anchors = 0
                continue
            article, out = hinted(tag, said)
            if tag == "p":
                if stack and stack[-1][0] == "p":  # a paragraph ends the one before
                    _, inside, outside = stack.pop()
                if not out:
                    continue
            stack.append((tag, inside, outside))
            if tag in _ARTICLE or article:
                if not outside or any(t in _AROUND for t, *_ in stack) and not any(t in _OUTSIDE for t, *_ in stack):
                    inside, outside = True, False
            elif tag in _OUTSIDE or out or tag == "form" or tag == "header" and not inside:
                outside = True
    flush()
    return found


def classify(found: list[Block], stop_words: frozenset[str] = STOP_WORDS) -> None:
    """Label the blocks, in two passes.

    First, blocks outside articles by their element are bad, and so are those mostly of links. Shorter ones than SHORT are
    ambiguous. Of the others, many stop words make LONG ones good, the rest stay ambiguous; few stop words make them
    bad, but in an article ambiguous. If no block has enough stop words (another language), length alone decides.
    Where the articles of a page hold at least as much text as the good blocks elsewhere, only headings elsewhere
    can still become good.

    Then ambiguous blocks take the label of the nearest decided block before or after. The page's edges are bad, an
    article's are good, and what an article holds of adverts and the like is no neighbour. Ties are good for
    headings, for prose and within articles.
    """
    for b in found:
        if b.outside or b.linked > LINKED * len(b.text) and not (b.heading and b.inside):
            b.label = BAD
        elif len(b.text) >= SHORT:
            words = _WORD.findall(b.text.lower())
            b.words, b.stops = len(words), sum(map(stop_words.__contains__, words))
    prose = lambda b: b.stops >= STOPS * b.words and b.words > 0
    open_ = [b for b in found if b.label != BAD]
    covered = any(prose(b) for b in open_)
    for b in open_:
        if len(b.text) >= SHORT:
            if prose(b) or not covered:
                b.label = GOOD if len(b.text) >= LONG or not covered else AMBIGUOUS
            elif not b.inside:
                b.label = BAD
    held = sum(len(b.text) for b in open_ if b.inside)
    trusted = held > 0 and held >= sum(len(b.text) for b in open_ if b.label == GOOD and not b.inside)
    if trusted:
        for b in open_:
            if not b.inside and not b.heading:
                b.label = BAD
    nearest = [[(BAD, 0)] * len(found), [(BAD, 0)] * len(found)]
    for side, order in enumerate((range(len(found)), range(len(found) - 1, -1, -1))):
        last, steps, within = BAD, 0, False
        for i in order:
            b = found[i]
            zone = trusted and b.inside
            if zone and b.outside:
                nearest[side][i] = last, steps + 1
                continue
            if zone != within:
                last, steps, within = GOOD, 0, zone
            steps += 1
            nearest[side][i] = last, steps
            if b.label != AMBIGUOUS:
                last, steps = b.label, 0
    for i, b in enumerate(found):
        if b.label == AMBIGUOUS:
            (one, near), (other, far) = nearest[0][i], nearest[1][i]
            if one == other or near == far:
                b.label = one if one == other else GOOD if b.heading or b.inside and trusted or prose(b) else BAD
            else:
                b.label = one if near < far else other


_BLOCK = "struct<text: string, label: string, heading: boolean, linked: int, words: int, stops: int>"


def _labelled(html: str, out: str, stop_words: frozenset[str]):
    def run(batches):
        for batch in batches:
            rows = []
            for page in batch.column(html):
                found = blocks(page.as_py() or "")
                classify(found, stop_words)
                rows.append([{"text": b.text, "label": b.label, "heading": b.heading, "linked": b.linked, "words": b.words, "stops": b.stops} for b in found])
            kept = [n for n in batch.schema.names if n != html]
            kind = pa.list_(pa.struct([("text", pa.string()), ("label", pa.string()), ("heading", pa.bool_()), ("linked", pa.int32()), ("words", pa.int32()), ("stops", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(rows, kind)], [*kept, out])

    return run


def labelled_blocks(pages: DataFrame, carry: list[str], stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """``carry`` columns of each page and _blocks: its blocks in order, with text, label and what the label rests on.

    A page's html is read whole, once, by one pass over its tags; nothing is shuffled. Null and empty pages have no blocks.
    """
    rows = pages.select(*quoted(carry), F.col("html").alias("_html"))
    return in_python(rows, _labelled("_html", "_blocks", stop_words), f"{schema_of(rows.drop('_html'))}, _blocks array<{_BLOCK}>")


def main_text(pages: DataFrame, stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """page_id, url, text (the good blocks, a line each; empty if none), n_chars of every page.

    Repeated rows each get a row; null page_id and url stay null; other columns are ignored; an empty table gives an empty
    result.
    """
    kept = F.filter("_blocks", lambda b: b["label"] == GOOD)
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    out = labelled_blocks(pages, ["page_id", "url"], stop_words).select("page_id", "url", text.alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
