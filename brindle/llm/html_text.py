"""Main text of web pages, by site template removal.

A page is read once, as a tree of elements (forgiving of unclosed and misnested tags; a tag cut off by the end of the page is
dropped). Every block-level subtree with text is hashed from its tags and text, whatever its element or class. Spark counts on how
many pages of its host each subtree occurs; a subtree that recurs on many of them is template and is deleted. Subtrees that hold
a marked article, or half of a page's text where none is marked, are never deleted; inside an article the recurrence must be
much stronger, since copied articles share paragraphs too, and so for single paragraphs and headings anywhere.

After that, what HTML itself says isn't article goes: scripts, styles, forms, menus, headers, footers and asides by element or
role, hidden elements, and where a page marks an article, all that lies outside it. Of classes and ids only words that can't
mean article text count (``_NAMES``: adverts, cookie notices, reader comments, menus), on containers alone, so that what a template
count can't tell on a host of few pages goes too.

The rest is cut into blocks at block-level elements; white space inside a block becomes one space (a line break is white space),
blocks are joined by an empty line. Blocks and subtrees of a page are written once; deleting and joining need no second reading
of the html. Per host only recurring subtrees are kept: those on a share s of the pages are at most 1/s times a page's subtrees.
Hosts with very many pages are never a join key of a shuffle.

Null or empty html gives the empty text; a null or odd url has no host and loses no template; a page that occurs twice counts
twice and is returned twice; ids pass through as they are, null or not; ties can't arise; other columns are ignored, also where
their names clash; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import BROADCAST_KEYS, join_hot, materialize, per_slice

#: Subtrees outside an article are template from so many pages and so large a share of the host's pages on; inside one, and
#: single paragraphs and headings: the second pair.
OUTSIDE, INSIDE = (5, 0.005), (20, 0.6)
#: So many (host, subtree) rows at most are broadcast.
BROADCAST_ROWS = 400_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul head noscript caption".split())
#: Never text of a page: their subtrees aren't counted either.
_UNSEEN = frozenset("head script style noscript iframe svg template object applet canvas audio video math title noembed noframes datalist".split())
#: Not article by element.
_GONE = frozenset("nav footer aside form button select dialog textarea input menu search fieldset".split())
_ROLES = re.compile(r"\brole\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|dialog|alert|alertdialog|form|menu|menubar)\b", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Classes and ids, whole words of them, that can't mean article text; and the elements on which they count.
_NAMES = re.compile(r"(?<!\S)(?:ads?|advert|adverts|advertisement|adsbygoogle|sponsored|cookie-?(?:banner|notice|consent|bar)|gdpr|comments?|comment-?list|disqus_thread|sidebar|navbar|breadcrumbs?|site-?(?:header|footer|nav)|newsletter)(?!\S)", re.I)
_CONTAINERS = frozenset("div section ul ol table ins center dl".split())
_CLOSES_P = _BLOCK - {"html", "body", "head", "option", "optgroup", "caption", "legend"}
_SAME = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select datalist")}
_SAME = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _SAME.items()}
#: Elements of prose: judged as strictly outside an article as in it, since paragraphs are quoted.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre figcaption summary dd dt caption".split())
#: Elements that an end tag of an inline element doesn't reach through.
_SCOPES = _BLOCK | {"td", "th"}
_IDS = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_MAIN = re.compile(r"\brole\s*=\s*[\"']?(?:main|article)\b", re.I)
_TOKEN = re.compile(r"<!--.*?(?:--!?>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|$))|<[!?][^>]*(?:>|$)|</[^>]*(?:>|$)", re.S)

#: Kinds of blocks: left out by HTML's signs, plain, in an article.
GONE, PLAIN, ARTICLE = 0, 1, 2


class _Node:
    __slots__ = ("article", "at", "block", "first", "gone", "holds_main", "parts", "tag", "unseen")

    def __init__(self, tag, unseen, gone, article, first, at, block):
        self.tag, self.unseen, self.gone, self.article, self.first, self.at, self.block = tag, unseen, gone, article, first, at, block
        self.holds_main, self.parts = False, [tag]


def _not_article(tag: str, attrs: str, article: bool) -> bool:
    if tag in _GONE or tag == "header" and not article:
        return True
    if len(attrs) < 5 or tag in ("html", "body"):
        return False
    if _ROLES.search(attrs) or _HIDDEN.search(attrs):
        return True
    return tag in _CONTAINERS and any(_NAMES.search(a or b or c) for a, b, c in _IDS.findall(attrs))


def read_page(page: str) -> tuple[list[str], list[int], list[tuple[int, int, int]]]:
    """Blocks of text, their kinds, and subtrees that may be template: (hash, first block, end block). The lowest bit
    of a hash tells whether the subtree lies in an article or is prose."""
    import xxhash

    blocks: list[str] = []
    kinds: list[int] = []
    before = [0]  # characters before each block
    subtrees: list[tuple[int, int, int]] = []
    stack = [_Node("", False, False, False, 0, 0, True)]
    scopes = [0]  # places in the stack of the elements in _SCOPES
    inline: list[dict[str, int]] = [{}]  # open inline elements within each of them
    opened: dict[str, int] = {}  # open elements of each tag
    buffer: list[str] = []
    at, end = 0, len(page)

    def flush():
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                top = stack[-1]
                blocks.append(text)
                kinds.append(GONE if top.gone else ARTICLE if top.article else PLAIN)
                before.append(before[-1] + len(text))

    def text_to(stop: int):
        if stop > at:
            top, piece = stack[-1], page[at:stop]
            top.parts.append(piece)
            if not top.unseen:
                buffer.append(_html.unescape(piece) if "&" in piece else piece)

    def close():
        node = stack[-1]
        if node.block or node.gone and not stack[-2].gone:
            flush()
        stack.pop()
        opened[node.tag] -= 1
        if scopes[-1] == len(stack):
            scopes.pop()
            inline.pop()
        else:
            inline[-1][node.tag] -= 1
        parent = stack[-1]
        digest = xxhash.xxh64_intdigest("\x1f".join(node.parts).encode("utf-8", "surrogatepass"))
        parent.parts.append(f"\x1e{digest:x}")
        parent.holds_main |= node.holds_main
        if node.block and not node.unseen and not node.holds_main and len(blocks) > node.first:
            inside = node.article or node.tag in _PROSE
            digest = digest & ~1 | inside
            subtrees.append((digest - (1 << 64) if digest >> 63 else digest, node.first, len(blocks)))

    def close_to(depth: int):
        while len(stack) > depth:
            close()

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text_to(end)
            break
        text_to(m.start())
        at = m.end()
        closing, tag, attrs = m.group(1), m.group(2), m.group(3)
        if tag is None:
            continue
        if attrs[-1:] != ">":  # cut off by the end of the page
            break
        tag = tag.lower()
        if closing:
            if tag == "br":
                buffer.append(" ")
            if tag in _SCOPES:
                if opened.get(tag):
                    k = len(scopes) - 1
                    while stack[scopes[k]].tag != tag:
                        k -= 1
                    close_to(scopes[k])
            elif inline[-1].get(tag):
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and not stack[-1].unseen:
                buffer.append(" ")
            stack[-1].parts.append(f"<{tag}>")
            continue
        if tag in _CLOSES_P and stack[scopes[-1]].tag == "p":
            close_to(scopes[-1])
        if tag in _SAME:
            ends, stops = _SAME[tag]
            if any(opened.get(t) for t in ends):
                k = len(scopes) - 1
                while k > 0 and stack[scopes[k]].tag not in ends and stack[scopes[k]].tag not in stops:
                    k -= 1
                if stack[scopes[k]].tag in ends:
                    while k > 1 and stack[scopes[k - 1]].tag in ends:
                        k -= 1
                    close_to(scopes[k])
        top = stack[-1]
        block = tag in _BLOCK
        gone = top.gone or not top.unseen and _not_article(tag, attrs, top.article)
        if block or gone and not top.gone:
            flush()
        elif tag in ("td", "th"):
            buffer.append(" ")
        unseen = top.unseen or tag in _UNSEEN
        main = not gone and not unseen and (tag in ("article", "main") or "role" in attrs and _MAIN.search(attrs) is not None)
        node = _Node(tag, unseen, gone, top.article or main, len(blocks), len(stack), block)
        node.holds_main = main
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
        if tag in _SCOPES:
            scopes.append(node.at)
            inline.append({})
        else:
            inline[-1][tag] = inline[-1].get(tag, 0) + 1
        if tag in _RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stop = stop.start() if stop else end
            text_to(stop)
            at = stop
        elif attrs.endswith("/>") and tag in ("path", "g", "use", "circle", "rect"):
            close()
    flush()
    close_to(1)
    if ARTICLE not in kinds:
        half = before[-1] / 2
        subtrees = [s for s in subtrees if before[s[2]] - before[s[1]] < half]
    return blocks, kinds, subtrees


def parsed_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, blocks, kinds, subtrees of each page; written. A page's subtrees are distinct by hash and place."""

    def make():
        def work(texts):
            out = {"blocks": [], "kinds": [], "subtrees": []}
            for t in texts:
                blocks, kinds, subtrees = read_page(t or "")
                out["blocks"].append(blocks)
                out["kinds"].append(kinds)
                out["subtrees"].append([{"hash": h, "first": a, "last": b - 1} for h, a, b in subtrees])
            return None, out

        return work

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    held = pages.select("page_id", "url", "html", host.alias("host"))
    schema = "blocks array<string>, kinds array<int>, subtrees array<struct<hash: bigint, first: int, last: int>>"
    return materialize(per_slice(held, ["page_id", "url", "host"], "html", make, schema, limit=4_000_000))


def site_templates(parsed: DataFrame) -> DataFrame:
    """(host, pages, template: array of hashes, size) of the subtrees that recur on a host."""
    seen = parsed.filter("host <> ''")
    once = F.array_distinct(F.transform("subtrees", lambda s: s.hash))
    counts = materialize(seen.select("host", F.explode(once).alias("hash")).groupBy("host", "hash").count().filter(f"count >= {OUTSIDE[0]}"))
    totals = materialize(seen.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    totals = F.broadcast(totals) if totals.count() <= BROADCAST_KEYS else totals
    (n0, s0), (n1, s1) = OUTSIDE, INSIDE
    often = counts.join(totals, "host").filter(F.expr(f"IF(hash & 1 = 1, count >= {n1} AND count >= {s1} * pages, count >= {n0} AND count >= {s0} * pages)"))
    return materialize(often.groupBy("host").agg(F.first("pages").alias("pages"), F.collect_list("hash").alias("template"), F.count(F.lit(1)).alias("size")))


def main_text(parsed: DataFrame) -> DataFrame:
    """``parsed`` with text, from its blocks; the column template holds its host's (null: none)."""
    # An intersection looks the hashes up; a test of each against the list would compare them all.
    parsed = parsed.withColumn("both", F.array_intersect(F.transform("subtrees", lambda s: s.hash), "template"))
    dropped = F.filter("subtrees", lambda s: F.array_contains("both", s.hash))
    gone = F.array_distinct(F.flatten(F.transform(dropped, lambda s: F.sequence(s["first"], s["last"]))))
    parsed = parsed.withColumn("gone", F.when(F.col("template").isNotNull(), gone))
    least = F.when(F.array_contains("kinds", ARTICLE), ARTICLE).otherwise(PLAIN)
    parsed = parsed.withColumn("least", least)
    stays = lambda k, i: (k >= F.col("least")) & ~F.coalesce(F.array_contains("gone", i), F.lit(False))
    held = F.transform("kinds", lambda k, i: F.when(stays(k, i), F.get("blocks", i)))
    return parsed.withColumn("text", F.array_join(held, "\n\n"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, url, text, n_chars, and n_template, its blocks that lay in template subtrees."""
    parsed = parsed_pages(pages)
    templates = site_templates(parsed)
    sums = templates.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("hosts")).first()
    if sums["rows"] <= BROADCAST_ROWS and sums["hosts"] <= BROADCAST_KEYS:
        held = parsed.join(F.broadcast(templates.select("host", "template")), "host", "left")
    else:
        known = templates.select("host")
        held = join_hot(parsed, templates, ["host"], "pages").unionByName(parsed.join(known, "host", "left_anti"), allowMissingColumns=True)
    out = main_text(held)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_template"))
