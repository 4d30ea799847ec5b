"""Main text of web pages with a site style tree.

The DOMs of a host's pages are merged into one tree of style nodes: a node is the chain of
elements, with their class and id, that leads to it. Two entropies make a node's importance,
both to the base of the number of pages that have the node. Content: a text that most pages
repeat under a node tells nothing, a text of one page tells much; a node gathers all texts below
it. Presentation: how the children of the node vary from page to page; variety raises the
importance of what is said in many ways, and never lowers it, as entropy to that base sinks
with the size of a host. Branches of low importance go from every page, before anything else
is decided; where a page marks its article, those below the mark. Only what a mark holds as a
whole is protected: where the marked element itself, or the body, is of low importance, as on a
host of copies, nothing in it is judged.

Of what the tree leaves, elements whose kind or role says that they are no part of the article
go, and containers whose name says so if they hold the lesser part of the text.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import cut

#: Fixed values of HTML: elements whose content is no text, elements without end, elements that
#: break a line of text, elements that an equal one ends, and elements that are no article.
RAW = "script style noscript template textarea title iframe xmp noembed noframes object svg math canvas audio video".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button".split()
)
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
NO_P = BLOCK - frozenset("button option optgroup select legend caption td th tr tbody thead tfoot".split())
NOT_MAIN = frozenset("nav aside footer form button select dialog menu head search fieldset".split())
NAMES = (
    r"ads?|adv|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|sidebar\w*|side|nav\w*|menu\w*|breadcrumbs?|footer\w*|foot|masthead|topbar|cookies?\w*|consent|gdpr|notices?|"
    r"notifications?|alert|popup|modal|overlay|newsletter|subscri\w+|sign-?up|log-?in|search\w*|share|sharing|social\w*|comments?|commentlist|disqus|replies|respond|related|recommend\w*|"
    r"widgets?|toolbar|pagination|pager|paywall|disclaimer|copyright|legal|outbrain|taboola"
)
#: Words beside a name in a class or id that don't change what it says; "has", "no", "with" and all others do.
BESIDE = r"site|page|main|global|top|bottom|left|right|primary|secondary|first|last|post|posts|entry|article|articles|story|stories|box|bar|block|section|area|container|wrapper|wrap|inner|list|items?|links?|text|title|form|buttons?|icons?|unit|slot|header|content|\d+"
NOT_MAIN_NAME = re.compile(rf"(?:(?:{BESIDE})[_-]+)*(?:{NAMES})(?:[_-]+(?:{NAMES}|{BESIDE}))*", re.I)
HEADER_NAME = re.compile(r"(?:^|\s)(?:(?:site|page|main|global|top|web)[_-]?)?header(?=$|[\s_-])", re.I)
MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article|story|post|entry)[\s_-]?(?:body|content|text)(?=$|[\s_-])", re.I)
NOT_MAIN_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*+)>|<[!?/][^>]*+>",
    re.S,
)
CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=\s|/|$)", re.I)
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", re.I)

#: A form, or an element that only its name bars, with more than this share of a page's text is a wrapper of the whole.
WRAPPER = 0.75
LOOSE = frozenset("form fieldset".split())
#: Nodes of fewer pages aren't judged, and branches below this importance go.
PAGES, LEAST = 8, 0.3
#: What one more layout leaves of the weight of content in a node's importance.
GAMMA = 0.9
#: Elements nested deeper than this hang on the last of this depth, as in browsers.
DEEP = 512
#: Names bar containers only, not headings, paragraphs or other elements of running text.
RUNNING = frozenset("address article blockquote body caption center dd details dt figcaption h1 h2 h3 h4 h5 h6 hgroup html legend li main p pre summary td th tr tbody".split())
#: Tasks that a host's pages are dealt to where the lists of low branches are too long to broadcast.
SALTS = 32


@functools.lru_cache(1 << 16)
def node_id(up: int, name: str) -> int:
    """The style node below another that elements of this name belong to; numbers in names don't count."""
    said = f"{up}/{re.sub('[0-9]+', '0', name)}".encode("utf-8", "replace")
    return int.from_bytes(hashlib.blake2b(said, digest_size=8).digest(), "big", signed=True)


class Element:
    """main is 2 within an article, 1 within another element that marks the page's content, else 0; root is the outermost of these.

    barred says that an element's kind or role bars it or one around it, loose has those around it, and
    itself, that a form or a name bars: content() decides on these. low says that it is in a branch of low
    importance, safe that what holds it is low as a whole.
    """

    __slots__ = ("tag", "node", "up", "depth", "kids", "barred", "loose", "main", "root", "low", "safe")

    def __init__(self, tag: str, rest: str, up: Element | None, low=frozenset()):
        named = {k.lower(): (a or b or c) for k, a, b, c in ATTRIBUTE.findall(rest)} if rest else {}
        label = f"{named.get('class', '')} {named.get('id', '')}"
        self.tag, self.up, self.depth, self.kids = tag, up, up.depth + 1 if up else 0, []
        self.node = node_id(up.node if up else 0, tag + "".join(f".{x}" for x in sorted(named.get("class", "").split())) + (f"#{named['id']}" if named.get("id") else ""))
        if up:
            up.kids.append(self.node)
        inside = up.main if up is not None else 0
        plain = tag in ("html", "body")
        barred = not plain and (
            (tag in NOT_MAIN and tag not in LOOSE)
            or (tag == "header" and not inside)
            or named.get("role", "").lower() in NOT_MAIN_ROLE
            or "hidden" in named
            or named.get("aria-hidden", "").lower() == "true"
            or (tag == "article" and bool(re.search(r"(?:^|[\s_-])(?:comments?|related|teaser|promo)(?=$|[\s])", label, re.I)))
        )
        said = tag not in RUNNING and any(NOT_MAIN_NAME.fullmatch(x) for x in label.split())
        loose = not plain and (tag in LOOSE or said or (not inside and tag not in RUNNING and bool(HEADER_NAME.search(label))))
        self.barred = barred or (up.barred if up else False)
        self.loose = (up.loose if up else ()) + ((self,) if loose else ())
        article = tag == "article" or named.get("role", "").lower() == "article" or named.get("itemprop", "").lower() == "articlebody"
        marked = tag == "main" or named.get("role", "").lower() == "main" or (not plain and bool(MAIN_NAME.search(label)))
        self.main = max(inside, 2 * article, int(marked))
        self.root = up.root if inside else self if self.main else None
        hit = self.node in low
        if plain or self.root is self:
            self.low, self.safe = False, hit
        else:
            self.safe = up.safe if up else False
            self.low = (up.low if up else False) or (hit and not self.safe)


def parsed(page: str, low=frozenset()) -> tuple[list[Element], list[tuple[Element | None, str]]]:
    """The block elements of a page, and (element, text) of each block of text, in page order; the element is the innermost that breaks lines.

    Raw elements are skipped with what they hold. One that is never closed hides no more than the text up to
    the next tag (a script or style) or its own tag (any other); a self-closing svg or math holds nothing.
    """
    stack: list[Element] = []
    held: list[str] = []
    every, out = [], []
    open_ended = set()
    at = 0

    def flush():
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((stack[-1] if stack else None, text))

    while m := TAG.search(page, at):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, ends_here, rest = tag.lower(), m["end"] or m["end2"], m["rest"] or m["rest2"] or ""
        if tag in CLOSE:
            if tag not in ("script", "style"):
                held.append(" ")
            if ends_here or (tag in ("svg", "math") and rest.rstrip().endswith("/")):
                continue
            close = None if tag in open_ended else CLOSE[tag].search(page, at)
            if close:
                at = close.end()
            else:
                open_ended.add(tag)
                if tag in ("script", "style"):
                    after = page.find("<", at)
                    at = after if after >= 0 else len(page)
            continue
        if tag == "br":
            held.append(" ")
        if tag not in BLOCK:
            continue
        flush()
        if ends_here:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
        elif tag not in VOID:
            if tag in NO_P and stack and stack[-1].tag == "p":
                stack.pop()
            ends = ENDS.get(tag)
            while ends and stack and stack[-1].tag in ends:
                stack.pop()
            up = stack[-1] if stack else None
            while up and up.depth >= DEEP:
                up = up.up
            stack.append(Element(tag, rest, up, low))
            every.append(stack[-1])
    if at < len(page):
        held.append(page[at:])
    flush()
    return every, out


def content(page: str, low=frozenset()):
    """The blocks that neither the tree nor their elements bar.

    A loosely barred element with most of the text that the tree leaves is a wrapper and bars nothing. Of articles
    and other marked contents in loosely barred elements the longest stays, if it is longer than all
    that is marked outside of them: others are teasers or comments.
    """
    found = [(e, t) for e, t in parsed(page, low)[1] if not (e and e.low)]
    total, held, marks, roots = 0, {}, 0, {}
    for e, t in found:
        total += len(t)
        for x in e.loose if e else ():
            held[x] = held.get(x, 0) + len(t)
    if not held:
        return [(e, t) for e, t in found if not (e and e.barred)]
    bars = {x for x, n in held.items() if n <= WRAPPER * total}
    out = []
    for e, t in found:
        root = e.root if e else None
        if e and (e.barred or any(x in bars for x in e.loose)):
            if root and not e.barred and not any(x in bars for x in e.loose if x.root is root and x is not root):
                roots[root] = roots.get(root, 0) + len(t)
            continue
        marks += len(t) if root else 0
    best = max(roots, key=roots.get, default=None)
    if best is not None and roots[best] <= marks:
        best = None
    for e, t in found:
        if e and (e.barred or any(x in bars and not (best is not None and e.root is best and (x.root is not best or x is best)) for x in e.loose)):
            continue
        out.append((e, t))
    return out


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def main_text(page: str | None, low: frozenset[int] = frozenset()) -> str:
    """The article's blocks, joined by line ends. low holds the style nodes of low importance."""
    found = content(page or "", low)
    marked = [(e, t) for e, t in found if e and e.main]
    if marked:
        article = [(e, t) for e, t in marked if e.main == 2]
        # articles beside a longer marked content are teasers of others
        whole = 2 * sum(len(t) for _, t in article) >= sum(len(t) for _, t in marked)
        # content that is marked without its headline gets it back
        found = article if whole else [(e, t) for e, t in found if e and (e.main or e.tag == "h1")]
    return "\n".join(t for _, t in found)


#: What a row of style_nodes() counts the pages of: the node, a text in it (not deeper), a layout of its children.
NODE, TEXT, LAYOUT = 0, 1, 2


def style_nodes(pages: DataFrame) -> DataFrame:
    """(host, node, kind, feature, pages, above): in how many pages of a host a style node, a text in it or a layout of
    its children occurs; above has the nodes above a node and itself, in its NODE row."""

    def run(batches):
        for batch in batches:
            seen: dict = {}
            above: dict = {}
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host = host_of(url)
                every, texts = parsed(page or "")
                layout: dict = {}
                for e in every:
                    layout.setdefault(e.node, []).extend((*e.kids, 0))
                    if (host, e.node) not in above:
                        above[host, e.node] = (above[host, e.up.node] if e.up else []) + [e.node]
                mine = {(host, n, NODE, 0) for n in layout}
                mine.update((host, n, LAYOUT, hash(tuple(k))) for n, k in layout.items())
                mine.update((host, e.node, TEXT, int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)) for e, t in texts if e)
                for k in mine:
                    seen[k] = seen.get(k, 0) + 1
            if seen:
                host, node, kind, feature = zip(*seen)
                chain = [above[h, n] if k == NODE else None for h, n, k in zip(host, node, kind)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(host), pa.array(node, pa.int64()), pa.array(kind, pa.int32()), pa.array(feature, pa.int64()), pa.array(list(seen.values()), pa.int64()), pa.array(chain, pa.list_(pa.int64()))],
                    ["host", "node", "kind", "feature", "pages", "above"],
                )

    found = pages.select("url", "html").mapInArrow(run, "host string, node long, kind int, feature long, pages long, above array<long>")
    return found.groupBy("host", "node", "kind", "feature").agg(F.sum("pages").alias("pages"), F.first("above").alias("above"))


def importance(nodes: DataFrame) -> DataFrame:
    """(host, node, pages, content, presentation, importance) of the style tree.

    A text on k of a node's m pages has entropy log_m k; content is one less the mean entropy of the
    appearances of all texts in and below the node, 1 where there are none. presentation is the
    entropy to base m of the node's l layouts over its pages. importance = content + (1 - content) *
    (1 - GAMMA ** (l - 1)) * presentation; all three are 1 for a node of one page.
    Sums run over features before any shuffle, so a host or node with very many is no hot key.
    """
    k, is_text, is_layout = F.col("pages"), F.col("kind") == TEXT, F.col("kind") == LAYOUT
    sums = nodes.groupBy("host", "node").agg(
        F.max(F.when(F.col("kind") == NODE, k)).alias("m"),
        F.max(F.when(F.col("kind") == NODE, F.col("above"))).alias("above"),
        F.sum(F.when(is_text, k * F.log(k)).otherwise(0.0)).alias("text"),
        F.sum(F.when(is_text, k).otherwise(0)).alias("texts"),
        F.sum(F.when(is_layout, k * F.log(k)).otherwise(0.0)).alias("layout"),
        F.sum(F.when(is_layout, 1).otherwise(0)).alias("layouts"),
    )
    of_one = F.col("m") == 1
    base = F.log("m")
    sums = sums.withColumn("text", F.when(of_one, 0.0).otherwise(F.col("text") / base)).withColumn("presentation", F.when(of_one, 1.0).otherwise(1 - F.col("layout") / (F.col("m") * base)))
    up = sums.filter("texts > 0").select("host", F.explode("above").alias("node"), "text", "texts").groupBy("host", "node").agg(F.sum("text").alias("text"), F.sum("texts").alias("texts"))
    out = sums.select("host", "node", "m", "presentation", "layouts").join(up, ["host", "node"], "left")
    content = F.when(of_one | F.col("texts").isNull(), 1.0).otherwise(1 - F.col("text") / F.col("texts"))
    out = out.select("host", "node", F.col("m").alias("pages"), content.alias("content"), "presentation", "layouts")
    return out.select("host", "node", "pages", "content", "presentation", (F.col("content") + (1 - F.col("content")) * (1 - F.pow(F.lit(GAMMA), F.col("layouts") - 1)) * F.col("presentation")).alias("importance"))


def low_branches(pages: DataFrame, least: float = LEAST, at_least: int = PAGES) -> DataFrame:
    """(host, low): the style nodes of each host whose importance is below least, of those on at_least pages or more."""
    low = importance(style_nodes(pages)).filter((F.col("importance") < least) & (F.col("pages") >= at_least))
    return low.groupBy("host").agg(F.collect_set("node").alias("low"))


def extract(pages: DataFrame, *, least: float = LEAST, at_least: int = PAGES, bound: int = 1 << 20) -> DataFrame:
    """One row for each row of pages (page_id, url, html): page_id, url, text, n_chars.

    Character references are decoded, white space within a block is one space, blocks are joined
    by a line end. A null, empty or purely boilerplate page has the empty text. Pages with a
    null or odd url share the host "". Malformed markup is read as far as it goes; very long or deep
    pages are read whole. Repeated rows give repeated rows, other columns are ignored, an empty
    table gives none. The hosts' lists of low branches are broadcast if they have fewer than
    `bound` nodes in all, and joined by host and salt otherwise.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    low = cut(low_branches(pages, least, at_least))
    size = low.agg(F.sum(F.size("low"))).first()[0] or 0

    def run(batches):
        for batch in batches:
            text = [main_text(batch.column(2)[at].as_py(), frozenset(batch.column(3)[at].as_py() or ())) for at in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if size:
        host = F.coalesce(F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
        pages = pages.withColumn("host", host)
        if size < bound:
            pages = pages.join(F.broadcast(low), "host", "left")
        else:
            low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            pages = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(low, ["host", "salt"], "left")
    else:
        pages = pages.withColumn("low", F.array().cast("array<long>"))
    return pages.select("page_id", "url", "html", "low").mapInArrow(run, "page_id long, url string, text string, n_chars long")
