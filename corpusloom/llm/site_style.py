"""Main text of web pages by a site style tree.

Pages of one host are merged: an element is the same on two pages if all
elements above it have the same sequence of children (their style) there and
it stands at the same place of the last. Spark counts, over the distinct pages
of a host, how many hold each element, each style of it and each text of it.

* Presentation: an element whose pages choose among many styles is worth
  keeping, by the entropy of its styles to the base of its pages.
* Content: a text that every page repeats at the same place is worth nothing,
  one that no other page has there is worth 1: one less the mean entropy of the
  texts over the pages, to the base of the pages.

An element on fewer than ``LEAST_PAGES`` distinct pages is worth 1. A branch of
a page is worth ``(1 - DECAY**styles)`` of its own presentation and for the
rest the mean of its children on the page; branches under ``NOISE`` are cut
out, largest first. Only elements seen on enough pages are joined with the
pages, so the join holds what the template repeats, not the articles.

Before that, what a page itself marks as no part of the article goes (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments, by
element, role, class or id), and what it marks as its article or main part
stays, whatever other pages repeat: exact copies of an article on one host are
no template. Entropy decides on all that is unmarked.

Defined results: a null or empty html has an empty text and 0 characters. Pages
without a host are not merged with others. Markup that is never closed ends
with the page; a page with equal columns twice has two rows. White space is
that of Unicode, so no-break spaces count.
"""

from __future__ import annotations

import hashlib
import html as H
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_tasks, met, perhaps_in, stored

LEAST_PAGES = 4
DECAY = 0.9
NOISE = 0.3

_TAG = r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)>"
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</(?![a-zA-Z])[^>]*+>?|" + _TAG, re.S)
_CUT_OFF = re.compile(r"</?[a-zA-Z][^<>]*\Z|<[!?].*\Z", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")

#: Elements whose contents are no text of the page; those of RAW hold no markup.
RAW = frozenset("script style textarea title iframe noframes noscript xmp noembed".split())
UNSEEN = frozenset("template object svg math canvas audio video select button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a block's line; all others begin and end blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose end may be left out: what opens closes the outermost of these within the list or table.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
WITHIN = frozenset("ul ol dl table".split())
PARTS_AWAY = frozenset("nav header footer aside form dialog menu".split())
ROLES_AWAY = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
WORDS_AWAY = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets related recommended "
    "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus reply replies respond form search pagination pager".split()
)
WORDS_KEPT = frozenset("article post entry content main body story".split())


class Node:
    """A block of a page: its look and the blocks in it, or (look #line) the pieces of a line of text. away, kept: marked as no part, as part of the article."""

    __slots__ = ("look", "tag", "away", "kept", "holds", "kids", "pieces", "nested", "key", "style", "worth")

    def __init__(self, look: str, tag: str, away: bool, kept: bool) -> None:
        self.look, self.tag, self.away, self.kept, self.holds = look, tag, away, kept, kept
        self.kids, self.pieces, self.nested, self.key, self.style, self.worth = [], [], 0, 0, 0, 1.0


def _attributes(raw: str) -> dict:
    out: dict = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), H.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _away(a: dict) -> bool:
    """Whether attributes mark a part as none of the article."""
    if a.get("role", "").lower() in ROLES_AWAY:
        return True
    marks = [[w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+", x)] for x in (*a.get("class", "").split(), a.get("id", ""))]
    return any(not WORDS_AWAY.isdisjoint(words) and WORDS_KEPT.isdisjoint(words) for words in marks)


def _is_main(tag: str, a: dict) -> bool:
    return tag in ("article", "main") or a.get("role", "").lower() in ("main", "article") or a.get("itemprop", "").lower() == "articlebody"


def parse(page: str) -> Node:
    """The tree of a page's blocks and lines, those marked away left out. Elements that are not block-level belong to their line."""
    root = Node("html", "html", False, False)
    stack, still_open, line, at = [root], Counter(), None, 0

    def text(piece: str) -> None:
        nonlocal line
        block = stack[-1]
        if block.away or not piece or (line is None and not piece.strip()):
            return
        if line is None:
            line = Node("#line", "", False, block.kept)
            block.kids.append(line)
        line.pieces.append(piece)

    def close(height: int) -> None:
        for node in stack[height:]:
            still_open[node.tag] -= 1
        del stack[height:]

    last = page.rfind(">")  # no markup ends after it
    while at <= last and (m := _TOKEN.search(page, at)):
        text(H.unescape(page[at : m.start()]))
        at, name = m.end(), (m["name"] or "").lower()
        if not name:
            continue
        block = stack[-1]
        if m["end"]:
            if name in INLINE and not (block.tag == name and block.away):
                continue
            if block.tag == name and block.nested:
                block.nested -= 1
            else:
                line = None
                if still_open[name]:
                    close(max(h for h, node in enumerate(stack) if node.tag == name))
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            line = line if name in INLINE else None  # br, hr and the like part lines
            continue
        if name in ("html", "head", "body"):
            continue
        a = _attributes(m["attrs"]) if "=" in m["attrs"] else {}
        away = block.away or name in UNSEEN or name in PARTS_AWAY or (bool(a) and _away(a))
        if name in INLINE and (block.away or not away):
            block.nested += block.away and block.tag == name
            continue
        if name not in INLINE:
            if block.tag == "p":
                close(len(stack) - 1)
            if name in CLOSES:
                floor = max((h for h, node in enumerate(stack) if node.tag in WITHIN), default=0)
                if outermost := [h for h in range(floor + 1, len(stack)) if stack[h].tag in CLOSES[name]]:
                    close(outermost[0])
        line, block = None, stack[-1]
        if away and name == "header" and block.kept and not _away(a):
            away = block.away  # the heading of the article itself
        look = f"{name}.{'.'.join(sorted(a['class'].split()))}" if "class" in a else name
        node = Node(look, name, away, not away and (block.kept or _is_main(name, a)))
        if not away:
            block.kids.append(node)
        stack.append(node)
        still_open[name] += 1
    text(H.unescape(_CUT_OFF.sub("", page[at:])))
    return root


def shown(node: Node) -> str:
    return " ".join("".join(node.pieces).split())


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def judged_nodes(root: Node, host: str) -> list[Node]:
    """From the top down, the nodes that are neither in nor around a marked article; key: the element in its host's tree, style: its style (for a line: its text)."""
    root.key = _hash("site", host)
    out = [root]
    for node in out:  # grows as it is walked
        if node.look == "#line":
            node.style = _hash("text", node.key, shown(node))
        elif node.kids:
            node.style = _hash(node.key, *[k.look for k in node.kids])
            for i, kid in enumerate(node.kids):
                if not kid.kept:
                    kid.key = _hash(node.style, i)
                    out.append(kid)
    for node in reversed(out):
        node.holds = any(k.holds for k in node.kids)
    return [n for n in out[1:] if not n.holds]


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def text_of(root: Node, judged: list[Node], found: dict) -> str:
    """The lines that are left when branches of low worth are cut. found: (styles, presentation, content) by element."""
    for node in reversed(judged):
        styles, presentation, content = found.get(node.key, (1, 1.0, 1.0))
        if node.look == "#line":
            node.worth = content
        else:
            inner = sum(k.worth for k in node.kids) / len(node.kids) if node.kids else 1.0
            fade = DECAY**styles
            node.worth = (1 - fade) * presentation + fade * inner
    lines, left = [], [root]
    while left:
        node = left.pop()
        if node.worth >= NOISE:
            if node.look == "#line":
                lines.append(shown(node))
            left += reversed(node.kids)
    return " ".join(x for x in lines if x)


def _rows(pages: DataFrame) -> DataFrame:
    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    rows = pages.select(*columns)
    return rows.withColumn("page", F.xxhash64(*[x for c in ("page_id", "url", "html") for x in (F.col(c), F.col(c).isNull())]))


def elements(rows: DataFrame) -> DataFrame:
    """page, body (a hash of host and all of the page's texts), and (element, style, line) of its blocks that are neither in nor around a marked article, which is never judged."""

    def run(batches):
        for batch in batches:
            page, body, found = [], [], []
            for key, url, html in zip(batch.column("page").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                host = host_of(url)
                if not host or not html:
                    continue
                root = parse(html)
                judged = judged_nodes(root, host)
                if judged:
                    page.append(key)
                    body.append(_hash(host, text_of(root, [], {})))
                    found.append([{"element": n.key, "style": n.style, "line": n.look == "#line"} for n in judged])
            kind = pa.list_(pa.struct([("element", pa.int64()), ("style", pa.int64()), ("line", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(body, pa.int64()), pa.array(found, kind)], ["page", "body", "found"])

    return in_tasks(rows.select("page", "url", "html"), run, "page long, body long, found array<struct<element: long, style: long, line: boolean>>")


def importance(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """element, styles, presentation, content of the elements on at least that many distinct pages."""
    one = pages.groupBy("body").agg(F.min("page").alias("page"))  # distinct pages
    chosen = perhaps_in(pages, one, "page").join(one.select("page"), "page", "left_semi").dropDuplicates(["page"])
    counts = chosen.select(F.inline("found")).groupBy("element", "style", "line").agg(F.count("*").alias("n"))
    log = F.ln(F.col("n").cast("double"))
    by = counts.groupBy("element").agg(F.sum("n").alias("m"), F.count("*").alias("styles"), F.sum(F.col("n") * log).alias("held"), F.sum(log).alias("spread"), F.bool_or("line").alias("line")).where(F.col("m") >= least_pages)
    base = F.ln(F.col("m").cast("double"))
    presentation = (base - F.col("held") / F.col("m")) / base
    content = 1 - F.col("spread") / (F.col("styles") * base)
    return by.select("element", F.col("styles").cast("int").alias("styles"), F.when(F.col("line"), 1.0).otherwise(presentation).alias("presentation"), F.when(F.col("line"), content).otherwise(1.0).alias("content"))


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages."""
    rows = _rows(pages)
    trees = stored(elements(rows), "page-trees")
    worth = stored(importance(trees, least_pages), "site-style")
    lines = trees.select("page", F.inline("found"))
    judged = perhaps_in(lines.select("page", "element").distinct(), worth, "element").join(worth, "element")
    verdicts = judged.groupBy("page").agg(F.collect_list(F.struct("element", "styles", "presentation", "content")).alias("found"))
    verdicts = stored(verdicts, "page-verdicts")
    marked = met(rows, verdicts, "page")  # other pages need not be sent to any verdict
    judged = marked.where("met").join(verdicts, "page", "left").select("url", "html", "page_id", "found")
    joined = judged.unionByName(marked.where("NOT met").select("url", "html", "page_id"), allowMissingColumns=True)

    def run(batches):
        for batch in batches:
            texts = []
            for url, html, found in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), batch.column("found").to_pylist()):
                if not html:
                    texts.append("")
                    continue
                root = parse(html)
                texts.append(text_of(root, judged_nodes(root, host_of(url)) if found else [], {f["element"]: (f["styles"], f["presentation"], f["content"]) for f in found or ()}))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return in_tasks(joined, run, "page_id long, url string, text string, n_chars long")
