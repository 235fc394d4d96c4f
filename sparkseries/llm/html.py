"""Main text of web pages by consensus: pages of a host vote on the path of the container that holds the article."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, in_short_batches, join_checked, table

#: Element names and class words (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed".split())
#: Skipped with all in them up to their own closing tag; one without a closing tag is only a tag.
NESTED = frozenset("template svg math canvas".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body center div html main section table tbody td tr".split())
DROPPED = frozenset("head nav footer aside menu button select option input dialog object audio video".split())
CLOSES_P = BLOCK - {"body", "html"}
_HIDES_P = CONTAINER | {"li", "td", "th", "blockquote"}
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside rail widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus respond reply pagination pager search toolbar form skip".split()
)
#: Of these, words of what readers wrote, however much of it there is.
COMMENT_WORDS = frozenset("comment comments disqus respond reply".split())
#: Of all, words that also have another use, and words that tell no use: "related-posts" stands beside the text, "related-work" may not.
WEAK_WORDS = frozenset("related header form notice notices alert search social aside skip widget reply respond banner rail pager toolbar login share sharing menu".split())
PLACE_WORDS = frozenset("area articles bar block body bottom box btn button buttons col column container content global group holder inner item items left line link links list main module outer page panel post posts primary region right row secondary section site slot stories sub top user wrap wrapper reader".split())
#: "has-sidebar" is no sidebar.
OTHERWISE = frozenset("has have is hide no non not with without".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu".split())
#: Words that name a heading's place, not something beside the text.
HEADING_WORDS, HEADINGS = frozenset("header masthead banner".split()), frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element with a class word of a layout and at least this share of the page's text is no box beside the text.
WHOLE = 0.8
#: The best container holds at least this share of the text of each element around it.
MOST = 0.8
#: Elements that end when another of them begins inside the same parent.
SIBLINGS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
_HIDES = {tag: of | {"table", "div", "article"} for tag, of in SIBLINGS.items()}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_END_OR_VALUE = re.compile(r"[>=]")
_SPACE = re.compile(r"\s*")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


@dataclass(slots=True)
class Element:
    """An open or closed element: its parent, generalised path, whether its text is left out, its place among containers, whether its text may be left out, its innermost block, whether it is in an article, and whether it is what readers wrote."""

    tag: str
    parent: int
    path: str
    dropped: bool
    container: bool
    suspect: bool = False
    block: int = 0
    article: bool = False
    comment: bool = False


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text else {}


def _is_dropped(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside_article:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    return attributes.get("role", "").lower() in DROPPED_ROLES or tag not in BLOCK and _is_suspect(tag, attributes)


def _names_a_box(token: str) -> bool:
    """Whether a class or id word says that its element is beside the text."""
    parts = set(_WORD.findall(token))
    found = parts & DROPPED_WORDS
    if not found or parts & OTHERWISE:
        return False
    return bool(found - WEAK_WORDS) or parts <= DROPPED_WORDS | PLACE_WORDS


def _tokens(tag: str, attributes: dict[str, str]) -> list[str]:
    tokens = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    return [t for t in tokens if not set(_WORD.findall(t)) & HEADING_WORDS] if tag in HEADINGS else tokens


def _is_comment(tag: str, attributes: dict[str, str]) -> bool:
    """Whether a class or id word says that readers wrote it."""
    return tag not in ("html", "body", "main") and "-" not in tag and any(set(_WORD.findall(t)) & COMMENT_WORDS and _names_a_box(t) for t in _tokens(tag, attributes))


def _is_suspect(tag: str, attributes: dict[str, str]) -> bool:
    """A form, or a class or id word says that it is beside the text; ``_kept`` decides for blocks."""
    return tag == "form" or attributes.get("role", "").lower() == "form" or tag not in ("html", "body", "article", "main") and "-" not in tag and any(map(_names_a_box, _tokens(tag, attributes)))


def _kept(elements: list[Element], blocks: list[tuple[int, str, float]]) -> list[tuple[int, str, float]]:
    """The blocks outside suspect elements; all blocks if none is left.

    An element that holds main, h1 or an article of most of the page's text is no suspect. Nor is a layout (not comments) that holds nearly all of the text,
    unless an article, main or h1 lies beside it.
    """
    if not any(e.suspect or e.comment for e in elements):
        return blocks
    inside = _weights(elements, blocks)
    holds, gone, beside = [False] * len(elements), [False] * len(elements), [False] * len(elements)
    marks = [0] * len(elements)  # articles, mains and h1 with text in the element, outside comments
    for k, e in enumerate(elements[1:], 1):
        beside[k] = beside[e.parent] or e.suspect or e.comment or e.dropped
        marks[k] = int(inside[k] > 0 and not e.comment and (e.tag in ("main", "article") or e.tag == "h1" and not beside[k]))
    for k in range(len(elements) - 1, 0, -1):
        e = elements[k]
        holds[k] |= not e.dropped and (e.tag in ("main", "h1") or e.tag == "article" and not e.comment and inside[k] > 0.5 * inside[0])
        holds[e.parent] |= holds[k]
        marks[e.parent] += marks[k]
    for k, e in enumerate(elements[1:], 1):
        whole = not e.comment and inside[k] >= WHOLE * inside[0] > 0 and marks[k] == marks[0]
        gone[k] = gone[e.parent] or (e.suspect or e.comment) and not holds[k] and not whole
    return [b for b in blocks if not gone[b[0]]] or blocks


def _ends(tag: str, html: str) -> dict[int, int]:
    """Where each element of a tag of ``NESTED`` ends, by the end of its opening tag; a self-closed svg or math ends there."""
    out, opened = {}, []
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])([^>]*)>", re.IGNORECASE).finditer(html, 0, html.rfind(">") + 1):
        if not m[1] and tag in ("svg", "math") and m[2].endswith("/"):
            out[m.end()] = m.end()
        elif not m[1]:
            opened.append(m.end())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """The tags of a page in order: begin, end, whether it closes, name in small letters (empty for comments and the like), attributes.

    Each character is looked at a bounded number of times. A value whose quote is not closed ends like one without quotes; behind
    the last tag that ends all is text. ``send`` a place to go on from there.
    """
    at, unclosed = 0, set()
    while (begin := html.find("<", at)) >= 0:
        closes = html.startswith("/", begin + 1)
        name = _NAME.match(html, begin + 1 + closes)
        attributes = ""
        if name:
            end = name.end()
            while (m := _END_OR_VALUE.search(html, end)) and m[0] == "=":
                end = _SPACE.match(html, m.end()).end()
                quote = html[end : end + 1]
                if quote in ("'", '"') and quote not in unclosed:
                    close = html.find(quote, end + 1)
                    if close < 0:
                        unclosed.add(quote)
                    end = max(end, close) + 1
            if not m:
                return
            end = m.end()
            attributes = html[name.end() : end - 1]
        elif html.startswith("<!--", begin):
            end = html.find("-->", begin + 4) + 3
            end = end if end >= 3 else len(html)
        elif html.startswith(("<!", "<?"), begin):
            end = html.find(">", begin) + 1
            if not end:
                return
        else:
            at = begin + 1
            continue
        at = (yield begin, end, closes, name[0].lower() if name else "", attributes) or end


def parse(html: str | None) -> tuple[list[Element], list[tuple[int, str, float]]]:
    """The elements in page order, and the blocks of text: (element, text, share of it in links)."""
    html = html or ""
    elements = [Element("", -1, "", False, True)]
    blocks: list[tuple[int, str, float]] = []
    stack: list[int] = [0]
    places: dict[str, list[int]] = {}  # of each tag, the places in the stack where it is open
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                blocks.append((elements[stack[-1]].block, text, min(1.0, linked / len(text))))
            held.clear()
        linked = 0

    def close(upto: int) -> None:
        """Close the element at this place of the stack and all in it."""
        if elements[stack[-1]].block >= stack[upto]:
            flush()
        for i in stack[upto:]:
            places[elements[i].tag].pop()
        del stack[upto:]

    def innermost(tag: str, within: Iterable[str] = ()) -> int:
        """The place of the last open ``tag`` that no element of ``within`` hides, or 0."""
        own = places.get(tag)
        if not own or any(name != tag and places.get(name) and places[name][-1] > own[-1] for name in within):
            return 0
        return own[-1]

    def text(part: str) -> None:
        nonlocal linked
        if part and not elements[stack[-1]].dropped:
            part = entities.unescape(part) if "&" in part else part
            held.append(part)
            if places.get("a"):
                linked += len(part)

    at, ends = 0, {}
    scan = tags(html)
    found = next(scan, None)
    while found:
        begin, end, closes, tag, raw = found
        text(html[at:begin])
        at = end
        if not tag:
            pass
        elif closes:
            if tag == "br" or tag == "p" and not innermost("p"):
                flush() if tag == "p" else text(" ")
            elif place := innermost(tag, CONTAINER if tag not in BLOCK else ()):
                close(place)
        elif tag in RAW:
            over = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(html, at)
            at = over.end() if over else len(html)
        elif tag in NESTED:
            if tag not in ends:
                ends[tag] = _ends(tag, html)
            at = ends[tag].get(at, at)
        elif tag in ("br", "wbr"):
            text(" " if tag == "br" else "")
        else:
            if tag in CLOSES_P and (place := innermost("p", _HIDES_P)):
                close(place)
            if tag in SIBLINGS and (place := innermost(tag, _HIDES[tag])):
                close(place)
            if tag in BLOCK:
                flush()
            if tag not in VOID:
                attributes, parent, path = _attributes(raw), elements[stack[-1]], ""
                dropped = parent.dropped or _is_dropped(tag, attributes, parent.article)
                if tag in BLOCK and tag not in ("html", "body"):
                    # the path by its hash, or deep pages would take the square of their depth
                    classes = ".".join(sorted(_DIGITS.sub("#", attributes.get("class", "").lower()).split()))
                    path = f"{tag}:{hashlib.blake2b(f'{parent.path}>{tag}.{classes}'.encode('utf-8', 'replace'), digest_size=12).hexdigest()}"
                elements.append(Element(tag, stack[-1], path or parent.path, dropped, tag in CONTAINER, tag in BLOCK and _is_suspect(tag, attributes), len(elements) if tag in BLOCK else parent.block, parent.article or tag in ("article", "main"), tag in BLOCK and _is_comment(tag, attributes)))
                places.setdefault(tag, []).append(len(stack))
                stack.append(len(elements) - 1)
        try:
            found = scan.send(at)
        except StopIteration:
            break
    text(html[at:])
    flush()
    return elements, _kept(elements, blocks)


def _weights(elements: list[Element], blocks: list[tuple[int, str, float]]) -> list[float]:
    """For each element the characters of text in it that are not links."""
    inside = [0.0] * len(elements)
    for element, text, links in blocks:
        inside[element] += len(text) * (1 - links)
    for k in range(len(elements) - 1, 0, -1):
        inside[elements[k].parent] += inside[k]
    return inside


def best_container(elements: list[Element], blocks: list[tuple[int, str, float]]) -> int:
    """Down from the page to the container that still holds ``MOST`` of the text of each element around it.

    Nothing goes on below an article or main, or past the page's h1: of two elements of which only the outer one holds it, the outer one is the
    container, unless that holds an article beside the inner one.
    """
    inside, at = _weights(elements, blocks), 0
    children: dict[int, list[int]] = {}
    for k, e in enumerate(elements[1:], 1):
        children.setdefault(e.parent, []).append(k)
    down = [0]
    while elements[at].tag not in ("article", "main"):
        below = [k for k in children.get(at, ()) if inside[k] >= MOST * inside[at] > 0]
        if not below or not elements[below[0]].container:
            break
        at = below[0]
        down.append(at)
    written = {e for e, _, _ in blocks}
    title = next((k for k, e in enumerate(elements) if e.tag == "h1" and k in written), None)
    if title is None:
        return at
    around = {title}
    while title > 0:
        title = elements[title].parent
        around.add(title)
    common = next(k for k in reversed(down) if k in around)
    within = [False] * len(elements)
    for k, e in enumerate(elements):
        within[k] = k == at or (e.parent >= 0 and within[e.parent])
    others = any(e.tag == "article" and not e.comment and not within[k] and inside[k] > 0 and k not in down and k not in around for k, e in enumerate(elements))
    return at if others else common


def vote(html: str | None) -> tuple[str, float] | None:
    """The path of the page's best container and its share of the page's text."""
    elements, blocks = parse(html)
    if not blocks:
        return None
    best, inside = best_container(elements, blocks), _weights(elements, blocks)
    return elements[best].path, inside[best] / inside[0] if inside[0] else 0.0


def extract(html: str | None, path: str | None) -> str:
    """The blocks inside the elements of this path (the page's own best container if there is none), joined by two line feeds."""
    elements, blocks = parse(html)
    within = [False] * len(elements)
    for k, e in enumerate(elements):
        within[k] = (path is not None and e.container and e.path == path) or (e.parent >= 0 and within[e.parent])
    found = [t for e, t, _ in blocks if within[e]]
    if not found and blocks:
        best = best_container(elements, blocks)
        within = [False] * len(elements)
        for k, e in enumerate(elements):
            within[k] = k == best or (e.parent >= 0 and within[e.parent])
        found = [t for e, t, _ in blocks if within[e]]
    return "\n\n".join(found)


def host_of(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        votes = [vote(h) for h in batch["html"]]
        kept = [k for k, v in enumerate(votes) if v]
        frame = pd.DataFrame({"host": batch["host"].to_numpy()[kept], "path": [votes[k][0] for k in kept], "votes": [votes[k][1] for k in kept]})
        yield frame.groupby(["host", "path"], as_index=False)["votes"].agg("sum") if len(frame) else pd.DataFrame(columns=["host", "path", "votes"])


def host_paths(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """``host, path``: the container path with the most votes of the host's pages; ties go to the path first in order."""
    held = pages.select(host_of(url).alias("host"), F.col(html).alias("html"))
    votes = held.mapInPandas(_votes, "host string, path string, votes double").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    # rounded, so that the order in which the votes are summed does not decide
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.round("votes", 6), "path")).alias("path"))


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [c for c in batch.schema.names if c not in ("_html", "_path")]
        pages, paths = (batch.column(batch.schema.get_field_index(c)) for c in ("_html", "_path"))
        for k in range(0, len(batch), 1000):
            texts = [extract(h.as_py(), p.as_py()) for h, p in zip(pages[k : k + 1000], paths[k : k + 1000], strict=True)]
            part = batch.slice(k, len(texts))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(texts, pa.string())], names=[*columns, "text"])


def extract_pages(pages: DataFrame, keep: list[str], *, url: str = "url", html: str = "html") -> DataFrame:
    """Columns ``keep`` of ``pages`` with ``text``, the main text of each page by its host's winning path.

    Null or empty pages, and pages without text, give an empty text. Null or odd addresses are one host of their
    own. A page that lacks the winning path is read by its own best container. Repeated rows are
    extracted each; an empty table gives no rows.
    """
    winners = cut(host_paths(pages, url=url, html=html)).withColumnsRenamed({"host": "_host", "path": "_path"})
    rows = in_short_batches(pages).select(*[F.col(c) for c in keep], host_of(url).alias("_host"), F.col(html).alias("_html"))
    joined = join_checked(rows, winners, ["_host"], "left").select(*keep, "_html", "_path")
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType())])
    return joined.mapInArrow(_extract, schema)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
