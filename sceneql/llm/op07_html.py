"""Main text of web pages by consensus host paths.

Every page scores its containers (text that isn't links, without boilerplate subtrees) and names the best few by their
generalised path: tags with their classes, digits replaced. Hosts vote on these paths in Spark, and each page is read
again inside the elements on its host's winning path; a page without such an element uses its own best container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneql.llm.common import prepared, table

#: Rows of (host, path) that may be sent to all tasks.
MOST_HOSTS = 200_000
#: Fixed values of HTML: elements without content, with raw content, and those that part blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript template svg math iframe noembed noframes select object canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div td body blockquote dd li center form aside nav header footer".split())
#: Elements, roles and words of a class or id that mark what isn't main text.
DROP_TAGS = frozenset("nav footer aside form button menu dialog head input label fieldset".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner adsbygoogle sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside widget footer masthead "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations "
    "comment comments disqus reply replies respond form search login toolbar pagination pager skip".split()
)
HEADS = frozenset("header topbar".split())
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)>", re.S)
#: The same without regard to quotes, from the first tag on whose quotes don't end.
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
#: Classes that say something about the page, not what their element is.
_STATE = re.compile(r"(?:has|no|with|without|is|hide|show)[-_]|.*[-_](?:open|closed|enabled|disabled|free|layout|hidden)$", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "up", "path", "drop", "inside", "link", "number")

    def __init__(self, tag: str, up: "Node | None", path: str, drop: bool, inside: bool, link: bool, number: int):
        self.tag, self.up, self.path, self.drop, self.inside, self.link, self.number = tag, up, path, drop, inside, link, number


def _opened(tag: str, attributes: str, up: Node, number: int, marks: bool) -> Node:
    names = ""
    drop = up.drop or tag in DROP_TAGS
    inside = up.inside or tag in ("article", "main")
    head = tag == "header"
    if attributes:
        for m in _ATTR.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role":
                drop = drop or (value.lower() in DROP_ROLES and not (up.inside and value.lower() == "banner"))
                inside = inside or value.lower() in ("main", "article")
            elif key in ("hidden", "aria-hidden"):
                drop = drop or (key == "hidden" and value.lower() != "until-found") or value.lower() == "true"
            else:
                words = {w.lower() for x in value.split() if not _STATE.match(x) for w in _WORD.findall(x)} if marks else set()
                drop = drop or (tag not in ("body", "html", "article", "main") and not DROP_WORDS.isdisjoint(words))
                head = head or not HEADS.isdisjoint(words)
                if key == "class" and value.strip():
                    names = "." + ".".join(sorted(_DIGITS.sub("#", value).split()))
    drop = drop or (head and not up.inside)
    return Node(tag, up, f"{up.path}/{tag}{names}" if tag in CONTAINERS else up.path, drop, inside, up.link or tag == "a", number)


def blocks(page: str, marks: bool = True) -> Iterator[tuple[Node, str, int]]:
    """(innermost block element, text with white space made one, characters of it in links), in page order; dropped elements'
    text is left out. marks: whether classes and ids drop elements, too."""
    root = Node("", None, "", False, False, False, 0)
    at, here, owner, number = 0, root, root, 0
    text: list[str] = []
    linked = 0

    def done() -> tuple[Node, str, int] | None:
        s = " ".join(html.unescape("".join(text)).split())
        return (owner, s, linked) if s else None

    last, tags = page.rfind(">"), _TAG
    while at < len(page):
        lt = page.find("<", at)
        m = None
        if 0 <= lt <= last:
            m = tags.match(page, lt)
            if not m and page[lt + 1].isalpha():
                tags = _LOOSE
                m = tags.match(page, lt)
        elif lt >= 0 and page.startswith("<!--", lt):
            m = _LOOSE.match(page, lt)
        upto = lt if m else lt + 1 if 0 <= lt <= last else len(page)
        if upto > at and not here.drop:
            text.append(page[at:upto])
            if here.link:
                linked += upto - at
        if not m:
            at = upto
            continue
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            node = here
            while node.up and node.tag != tag:
                node = node.up
                if node.tag in ("article", "main", "body", "td", "table") and tag not in (node.tag, "body", "html", "article", "main", "table"):
                    break
            if not node.up or node.tag != tag:
                if tag == "p" and (x := done()):  # a stray end of a paragraph still parts blocks
                    yield x
                    text, linked = [], 0
                continue
            if tag in BLOCK or (node.drop and not node.up.drop):
                if x := done():
                    yield x
                text, linked = [], 0
            here = node.up
            owner = here
            while owner.up and owner.tag not in BLOCK:
                owner = owner.up
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK:
            if x := done():
                yield x
            text, linked = [], 0
            node = here
            if tag in CLOSES_P:
                while node.up and node.tag not in BLOCK:
                    node = node.up
                if node.tag == "p":
                    here = node.up
            elif tag in ("li", "dt", "dd", "tr", "td", "th") and node.tag == tag:
                here = node.up
        if tag in VOID:
            continue
        if tag in RAW:
            if not (m[3] or "").endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        number += 1
        here = _opened(tag, m[3], here, number, marks)
        if tag in BLOCK:
            owner = here
    if x := done():
        yield x


def said(page: str) -> list[tuple[Node, str, int]]:
    """The blocks of a page; where classes and ids would drop them all, those that elements alone leave."""
    return list(blocks(page)) or list(blocks(page, marks=False))


def containers(found: list[tuple[Node, str, int]]) -> list[tuple[str, float]]:
    """(path, score) of the containers on a page, best first, and the page's own choice as the first."""
    score: dict[str, float] = {}
    for node, text, linked in found:
        gain, share, chain = max(0, len(text) - 2 * linked), 1.0, node
        while chain.up and share > 0.1:
            if chain.tag in CONTAINERS:
                more = 1.5 if chain.tag in ("article", "main") else 1.0
                score[chain.path] = score.get(chain.path, 0) + gain * share * more
                share *= 0.5
            chain = chain.up
    return sorted(score.items(), key=lambda x: (-x[1], len(x[0]), x[0]))


def within(node: Node, path: str) -> bool:
    while node.up:
        if node.path == path and node.tag in CONTAINERS:
            return True
        node = node.up
    return False


def extract(page: str, winner: str | None) -> str:
    found = said(page)
    inner = [t for n, t, _ in found if within(n, winner)] if winner else []
    if not inner:
        own = containers(found)
        inner = [t for n, t, _ in found if within(n, own[0][0])] if own else []
    return "\n".join(inner or [t for _, t, _ in found])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        votes: dict[tuple[str, str], list[float]] = {}
        for host, page in zip(b.column(0).to_pylist(), b.column(1)):
            best = containers(said(page.as_py() or ""))
            total = sum(s for _, s in best)
            for path, s in best:
                if total:
                    v = votes.setdefault((host, path), [0, 0.0])
                    v[0], v[1] = v[0] + 1, v[1] + s / total
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array([v[0] for v in votes.values()], pa.int64()), pa.array([round(v[1] * 1e6) for v in votes.values()], pa.int64())], names=["host", "path", "pages", "votes"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(p.as_py() or "", w) for p, w in zip(b.column(2), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, pages): each host's winning container path. Pages vote with all of theirs. Votes are shares of a page's scores, as whole millionths."""
    prepared(pages.sparkSession)
    d = pages.select(_host(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    votes = d.mapInArrow(_vote, "host string, path string, pages long, votes long").groupBy("host", "path").agg(F.sum("pages").alias("pages"), F.sum("votes").alias("votes"))
    best = votes.groupBy("host").agg(F.max_by(F.struct("path", "pages"), F.struct("votes", "path")).alias("best"))
    return best.select("host", "best.path", "best.pages")


def _host(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s]*)", 1), F.lit("")))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages.

    Null and empty html gives an empty text; rows without a host in their url vote together. Repeated rows give repeated
    results. Other columns are ignored. An empty table gives an empty result.
    """
    winners = host_paths(pages, url_col, html_col).select("host", "path").checkpoint()
    # few enough hosts go to every task, and pages stay where they are; else both sides are dealt out by host, and Spark
    # splits the partitions of hot ones
    winners = F.broadcast(winners) if winners.count() <= MOST_HOSTS else winners
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), _host(url_col).alias("host"))
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    return d.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInArrow(_read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(prepared(spark), sf_dir, "pages"))
