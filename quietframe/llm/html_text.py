"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score by the place they stand in
(kind of element around them, whether the page marks its article, whether they
are a link), tags score negatively; the weights are log ratios counted on labelled pages.  One linear
scan finds the contiguous region of the largest sum; the blocks it touches, without what
stands in menus, adverts, forms and the like, are the text.

An element counts as such by its name, or by a class, id or role of which every
part is known: ``site-footer`` and ``cookieBanner`` are, ``search-results`` and
``comment-on-law`` are not.  A page marks its article by ``article`` or ``main``
elements outside comments and scripts that hold words, other than those of links,
in a block of their own or in a sentence.

Tags are read by one pass from left to right.  An attribute's quoted value runs to
its closing quote, whatever it holds and however long it is; a quote without one
is a character like others, and a tag with quoted values that meets a "<" ends
there, so that nothing is read twice.

The labelled pages are the ``LABELLED`` set below, in which ``[[`` and ``]]``
enclose the content, or any others given to ``train``.

Defined cases: null and empty html, pages without words and pages whose words
all score negatively have the empty text; an unfinished tag or comment at the
end is dropped, an unclosed script or style runs to the end; formulas and the
content of ``object`` are text, that of ``textarea`` and other form controls is
not; an end tag closes the innermost open element of its name, within its article
or main element, or nothing; an unknown character reference stays as it is; of regions with equal sums
the first is taken; repeated rows get a row each.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import small_batches

#: Elements that begin and end a block (fixed values of HTML).
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead title tr ul".split())
SPACED = frozenset("br td th".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is not text and not markup either, up to their end tag.
RAW = "script style"
#: Elements without text for readers of the page.
SILENT = frozenset("noscript template iframe svg".split())
#: Elements that never hold main text.
APART = frozenset("head title nav footer aside form button select textarea menu dialog".split())
#: Words in a class, id or role that mark what is not main text, and words that may stand beside them.
HINTS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification pagination paywall popup promo promoted promotion recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget".split())
BESIDE = frozenset("app area article articles bar block cc cta el embed fixed floating frame holder inline js layer mod overlay plugin row search strip ui view window wp body bottom box button buttons container content contentinfo inner item items left link links list main form global header icons module outer page panel post posts primary region right secondary section site slot sticky stories story text thread top unit wrap wrapper".split())
#: Words beside which ``search`` is a field to search in, and not what a page is about.
FIELDS = frozenset("bar box button field form global header top".split())
NAME = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
#: Attributes up to the end of a tag: each quoted value is taken whole, and what is taken is not given back.
ATTRIBUTES = re.compile(r"(?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+")
#: What ends a sentence.
SENTENCE = re.compile(r"\w[.!?\u3002]")
QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")
#: Comments and declarations.
SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
CLOSED = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW.split()}
MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")

LABELLED = (
    "<html><head><title>A title</title></head><body><nav><ul><li><a>Home</a></li><li><a>News of the day</a></li></ul></nav><div class='ad'>Buy this now and save</div><article><h1>[[A title</h1><p>Some words of the first paragraph stand here.</p><p>And some more <a>with a link</a> in the second one.</p><div class='share'>Share this page</div><p>The end of it all.]]</p></article><aside>Related pages to read</aside><footer>Copyright of the owner</footer></body></html>",
    "<html><body><header><h2>Name of the site</h2><a>Log in</a></header><main><h1>[[Another title</h1><p>This page marks its main part, with quite a few words in it.</p><blockquote>A quotation that belongs to it.</blockquote><ul><li>one point of a list</li><li>one more point</li></ul><p>A last word.]]</p></main><section class='comments'><p>A reader says something long about this page here.</p><form><label>Your comment</label></form></section><div>All rights reserved</div></body></html>",
    "<html><body><div id='menu'><a>one</a><a>two</a><a>three</a></div><div><h1>[[No marks here</h1><p>This page has its words in plain blocks, one after the other, and no marks.</p><p>A second paragraph makes it longer.</p><p>A third one ends it.]]</p></div><div class='sidebar'><p>Sign up for more</p></div><div id='footer'>Contact and privacy</div></body></html>",
    "<html><body><div><a>Home</a> <a>Products and prices</a> <a>About us</a> <a>How to find us</a></div><div><h1>[[Heading of a plain page</h1><p>This page has links beside its text, and <a>one link</a> in it, as many pages do.</p><p>There is a second paragraph with some more words.]]</p></div><div><a>Imprint</a> <a>Privacy</a> <a>Terms of use</a> <a>Site map</a></div></body></html>",
    "<body><div class='cookie notice'>We use cookies on this site</div><div><a>Back</a> <a>Next</a></div><article><header><h1>[[Title in a header</h1></header><section><p>Words in a section of the article.</p><table><tr><td>a cell</td><td>and a cell</td></tr></table></section>]]</article><div><p>Read our other stories as well</p></div></body>",
)


def hinted(attributes: str) -> bool:
    """Whether a class, id or role says that the element holds no main text."""
    for value in MARK.findall(attributes):
        for name in "".join(value).split():
            parts = [p.lower() for p in SPLIT.split(name) if p]
            known = any(p in HINTS for p in parts) or ("search" in parts and any(p in FIELDS for p in parts))
            if known and all(p in HINTS or p in BESIDE or p in FIELDS for p in parts):
                return True
    return False


def tokens(html: str):
    """(text, None, False) of text, (None, None, False) of what is skipped, and (attributes, name, whether it is an end tag) of tags, in one pass."""
    at, end = 0, len(html)
    while at < end:
        opened = html.find("<", at)
        if opened != at:
            opened = end if opened < 0 else opened
            yield html[at:opened], None, False
            at = opened
            continue
        m = NAME.match(html, at)
        skipped = SKIPPED.match(html, at) if m is None else None
        if skipped is not None:
            yield None, None, False
            at = skipped.end()
            continue
        if m is not None and not m.group(1) and m.group(2).lower() in CLOSED:
            inside = html.find(">", at)
            if inside < 0:
                return
            yield None, None, False
            closing = CLOSED[m.group(2).lower()].search(html, inside)
            at = closing.end() if closing else end
            continue
        if m is not None:
            stop = ATTRIBUTES.match(html, m.end()).end()
            attributes = html[m.end() : stop]
            if stop < end and html[stop] == ">":
                yield attributes, m.group(2).lower(), bool(m.group(1))
                at = stop + 1
                continue
            if QUOTED.search(attributes) and stop < end:
                yield attributes, m.group(2).lower(), bool(m.group(1))
                at = stop
                continue
            if stop == end:
                return
        yield "<", None, False
        at += 1


def _placed(html: str):
    """Events with the zone 'beside' for what is outside of article and main."""
    stack: list[tuple[str, str]] = []
    places: dict[str, list[int]] = {}  # where elements of a name stand in the stack
    regions: list[int] = []  # where article, main and body do
    zone, linked = "beside", False

    def close(down: int) -> None:
        while len(stack) > down:
            gone = stack.pop()[0]
            places[gone].pop()
            if regions and regions[-1] == len(stack):
                regions.pop()

    for value, name, is_end in tokens(html):
        if name is None:
            yield ("s", zone, "") if value is None else ("l" if linked else "t", zone, value)
            continue
        if name == "a":
            linked = not is_end
        elif name in BLOCKS:
            linked = False  # an unclosed link ends with its block
        kind = "b" if name in BLOCKS else "s" if name in SPACED else "i"
        if is_end:
            yield kind, zone, name
            own = places.get(name)
            # a stray end tag closes nothing outside its region
            if own and (name in ("article", "main", "body", "html") or not regions or own[-1] > regions[-1]):
                zone = stack[own[-1]][1]
                close(own[-1])
            continue
        if name in ("html", "body"):
            yield kind, zone, name
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            zone = stack[-1][1]
            close(len(stack) - 1)
        before = zone
        within = zone in ("article", "main")
        if zone not in ("apart", "dropped"):
            if name in APART or name in SILENT or (name not in ("body", "main") and hinted(value)) or (name == "header" and not within):
                zone = "dropped" if within else "apart"
            elif name in ("article", "main"):
                zone = name
        closed = name in VOID or (name in ("svg", "math") and value.rstrip().endswith("/"))
        yield kind, zone, name
        if closed:
            zone = before
        else:
            places.setdefault(name, []).append(len(stack))
            if name in ("article", "main"):
                regions.append(len(stack))
            stack.append((name, before))


def events(html: str) -> list[tuple[str, str, str]]:
    """(kind, zone, value) of a page: kind 't' for text, 'l' for text of a link, 'b' for a block's limit, 's' for a space, 'i' for an inline tag.

    Zones: 'article' or 'main' inside such an element, 'outside' elsewhere on a
    page that has one, 'plain' on a page that has none, 'apart' in what never
    holds main text, 'dropped' for the same inside an article.
    """
    found = list(_placed(html))
    block, marked = False, False
    for kind, zone, value in found:
        if kind == "b" and value not in ("article", "main"):
            block = zone in ("article", "main")
        elif kind == "t" and zone in ("article", "main") and value.strip():
            marked = marked or block or SENTENCE.search(value) is not None
    new = {"beside": "outside"} if marked else {"beside": "plain", "article": "plain", "main": "plain"}
    return [(kind, new.get(zone, zone), value) for kind, zone, value in found]


def train(pages=LABELLED) -> dict[tuple[str, str], float]:
    """Weight of a word and of a tag in each zone, from pages whose content is enclosed in ``[[`` and ``]]``."""
    inside: dict[tuple[str, str], float] = {}
    outside: dict[tuple[str, str], float] = {}
    for page in pages:
        content = False
        for kind, zone, value in events(page):
            if kind not in "tl":
                count = inside if content else outside
                count["tag", zone] = count.get(("tag", zone), 0) + 1
                continue
            for word in value.replace("[[", " [[ ").replace("]]", " ]] ").split():
                if word in ("[[", "]]"):
                    content = word == "[["
                    continue
                count = inside if content else outside
                what = ("word" if kind == "t" else "link", zone)
                count[what] = count.get(what, 0) + 1
    out = {}
    for zone in ("article", "main", "outside", "plain", "apart", "dropped"):
        for what in ("word", "link"):
            yes, no = inside.get((what, zone), 0), outside.get((what, zone), 0)
            out[what, zone] = max(-2.0, min(2.0, math.log((yes + 0.5) / (no + 0.5))))
        tags = inside.get(("tag", zone), 0) + 0.5, outside.get(("tag", zone), 0) + 0.5
        out["tag", zone] = -0.02 * tags[1] / tags[0] if zone in ("article", "main") else -max(0.1, min(1.0, 0.2 * tags[1] / tags[0]))
    out["word", "dropped"] = out["link", "dropped"] = out["tag", "dropped"] = 0.0  # it stands inside the region and is left out of the text
    return out


def extract(html: str | None, weights: dict[tuple[str, str], float]) -> str:
    """The blocks of the best region, joined by empty lines."""
    if not html:
        return ""
    sequence = events(html)
    best, best_range, total, begin = 0.0, (0, 0), 0.0, 0
    for i, (kind, zone, value) in enumerate(sequence):
        score = weights["word" if kind == "t" else "link", zone] * len(value.split()) if kind in "tl" else weights["tag", zone]
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, best_range = total, (begin, i + 1)
    if best <= 0:
        return ""
    first, last = best_range
    while first > 0 and sequence[first - 1][0] != "b":  # whole blocks
        first -= 1
    while last < len(sequence) and sequence[last][0] != "b":
        last += 1
    blocks, current = [], []
    for kind, zone, value in sequence[first:last]:
        if kind == "b":
            blocks.append("".join(current))
            current = []
        elif zone in ("apart", "dropped") or (zone == "outside" and weights["word", zone] < 0):
            continue
        elif kind in "tl":
            current.append(value)
        elif kind == "s":
            current.append(" ")
    blocks.append("".join(current))
    clean = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def main_text(df: DataFrame, weights: dict[tuple[str, str], float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page; no shuffle."""
    known = weights or train()

    def emit(batches):
        for batch in batches:
            texts = [extract(h.as_py(), known) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages = small_batches(df).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return pages.mapInArrow(emit, "page_id long, url string, text string, n_chars long")
