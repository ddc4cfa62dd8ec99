"""Main text of web pages by two-pass block rules.

Markup cuts a page into blocks. The first pass decides blocks by where they stand (menus, forms,
comments and the like are out), by link density, and by length and stop-word density. Density is
taken relative to the page's own, so that a page whose words are in none of the lists is judged by
length. Blocks too short to tell are left open; in the second pass they take the label of the nearest
decided neighbours, and stay (if they have a letter or digit) where no block was found good. Where a page marks its article, blocks
outside it are out, and both passes run over those inside.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscan.llm.common import Columns, map_batches

#: Frequent words of four languages.
STOP_WORDS = frozenset("""
the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were
we when your can said there use an each which she do how their if will up other about out many then them these so some
der die das und ist in den von zu mit sich auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
le la les de des et un une est en que qui dans pour pas sur au avec il ce elle plus par son se du
el los las y que en un una es por con para del se no su al lo como más pero sus mi ha
""".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead
tr ul""".split())
RAW = frozenset("script style noscript template textarea select svg iframe object title head button canvas math".split())
OUT = frozenset("nav aside footer form menu dialog".split())
ARTICLE = frozenset(("article", "main"))
VOID = frozenset("hr".split())
#: Parts of class and id names, and roles, that mark what is not the article.
OUT_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies
consent gdpr notice notices alert menu nav navbar navigation sidebar breadcrumb breadcrumbs comment comments respond replies
disqus related recommended share sharing social subscribe newsletter popup modal login signup search widget pagination pager
masthead toolbar copyright""".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
#: Names that mark page furniture only outside an article.
OUTSIDE_NAMES = frozenset(("header", "footer"))
LONG, MEDIUM = 140, 70
MOST_LINKS = 0.5
STOPS_LONG, STOPS_MEDIUM = 0.15, 0.3
#: The stop-word share of running text; a page with less needs less in its blocks, and none below LEAST_STOPS.
USUAL_STOPS, LEAST_STOPS = 0.3, 0.075

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
                 r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
NAMED = re.compile(r"(class|id|role|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    text: str
    linked: int
    out: bool
    inside: bool
    heading: bool


def _marks(attributes: str, inside: bool) -> bool:
    """Whether an element's attributes mark page furniture."""
    for name, *values in NAMED.findall(attributes):
        value = next((v for v in values if v), "").lower()
        name = name.lower()
        if name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name == "role" and value in OUT_ROLES:
            return True
        if name in ("class", "id"):
            parts = set(PARTS.split(value))
            if parts & OUT_NAMES or not inside and parts & OUTSIDE_NAMES:
                return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with what their place says about them."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # element, out, inside an article
    parts: list[str] = []
    linked, in_link, heading = 0, False, False

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out, inside = stack[-1][1:] if stack else (False, False)
            found.append(Block(text, linked, out, inside, heading))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if in_link:
            linked += len(SPACE.sub(" ", text).strip())

    at, size = 0, len(page)
    while at < size:
        tag = TAG.search(page, at)
        if tag is None:
            add(page[at:])
            break
        if tag.start() > at:
            add(page[at:tag.start()])
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(tag[1] or tag[4]), tag[3] or tag[6] or ""
        if name in RAW and not closing:
            if name not in ("svg", "math") and attributes.endswith("/"):
                continue
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else (at if name == "head" else size)
            parts.append(" ")
        elif name == "a":
            in_link = not closing
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            flush()
            heading = not closing and name in ("h1", "h2", "h3", "h4", "h5", "h6")
            in_link = in_link and name not in ("p", "li") and not closing
            if name == "p" or name in VOID:
                while not closing and stack and stack[-1][0] == "p":
                    stack.pop()
            elif not closing and stack and stack[-1][0] == "p":
                stack.pop()
            if closing:
                if any(element == name for element, _, _ in stack):
                    while stack.pop()[0] != name:
                        pass
            elif name not in VOID and not (name == "p" and not attributes):
                above_out, inside = stack[-1][1:] if stack else (False, False)
                out = above_out or name in OUT or name == "header" and not inside or _marks(attributes, inside)
                stack.append((name, out, inside or name in ARTICLE))
    flush()
    return found


def _stops(text: str) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words), len(words)


def labels(found: list[Block]) -> list[bool]:
    """Which blocks belong to the main text."""
    article = any(b.inside and not b.out for b in found)
    stops = [_stops(b.text) for b in found]
    linked = [b.linked > MOST_LINKS * len(b.text) for b in found]
    open_blocks = [i for i, b in enumerate(found) if not (b.out or article and not b.inside)]
    prose = [stops[i] for i in open_blocks if not linked[i]]
    page = sum(n for n, _ in prose) / max(sum(words for _, words in prose), 1)
    scale = min(1.0, page / USUAL_STOPS) if page >= LEAST_STOPS else 0.0
    decided: list[bool | None] = []
    for i in open_blocks:
        size, share = len(found[i].text), stops[i][0] / max(stops[i][1], 1)
        if linked[i]:
            decided.append(False)
        elif size >= LONG and share >= scale * STOPS_LONG or size >= MEDIUM and share >= scale * STOPS_MEDIUM:
            decided.append(True)
        else:
            decided.append(None)
    result = [False] * len(found)
    some = any(decided)
    before, ahead = _nearest(decided), _nearest(decided[::-1])[::-1]
    for i, own, left, right in zip(open_blocks, decided, before, ahead, strict=True):
        if own is not None:
            result[i] = own
        elif not some:
            result[i] = any(map(str.isalnum, found[i].text))
        elif found[i].heading and right and right[1]:
            result[i] = True
        elif left and right and left[1] != right[1]:
            result[i] = left[1] if left[0] < right[0] else right[1] if right[0] < left[0] else article
        else:
            result[i] = bool((left or right or (0, False))[1])
    return result


def _nearest(decided: list[bool | None]) -> list[tuple[int, bool] | None]:
    """Distance and label of the last decided block before each."""
    last: tuple[int, bool] | None = None
    out = []
    for label in decided:
        last = (last[0] + 1, last[1]) if last else None
        out.append(last)
        if label is not None:
            last = (0, label)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, good in zip(found, labels(found), strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html).

    Null and empty pages, and pages of nothing but furniture and links, give an empty text. Unclosed and unknown
    elements are allowed; nothing is cut. One row per input row; an empty table gives no rows.
    """
    def batch(rows: Columns) -> Columns:
        texts = [main_text(page) for page in rows["html"]]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": list(map(len, texts))}

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html")),
                       "page_id long, url string, text string, n_chars long", batch)
