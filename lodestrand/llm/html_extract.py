"""Main text of web pages, with each site's template taken out.

Every page's element subtrees are hashed; Spark counts on how many pages of a host, different in their own text, each
hash lies, and subtrees that recur across many of these are deleted before the text is read, besides elements that are never article text.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, only, ready, rows_by_chars, stored

MIN_PAGES, MIN_SHARE, MANY_PAGES, LEAST_CHARS = 5, 0.3, 100, 20
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*)>?|[^<]+|<""", re.S)
_ATTR = re.compile(r"""([^\s=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_MARKS = {"class", "id", "role", "hidden"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_DROP = _RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "option", "svg", "canvas", "object", "video", "audio", "menu", "dialog", "input", "math"}
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_SCOPE = {"article", "main", "table", "td", "th", "section", "div", "aside", "form", "body", "html", "caption", "button", "object"}
_CHROME = re.compile(r"(?:^|[\s_-])(?:ads?|adbox|adslot|advert\w*|sponsor\w*|promos?|promotion|banners?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|footers?|cookies?|consent|gdpr|notices?|notifications?|alerts?|newsletter|subscribe|subscription|popups?|modal|overlay|share|sharing|social|related|recommend\w*|comments?|respond|replies|disqus|login|signup|signin|search|toolbar|pagination|pager|skip|complementary|contentinfo|masthead|topbar)(?:$|[\s_-])", re.I)
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|banner|masthead)(?:$|[\s_-])", re.I)
_TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "td", "th", "dt", "dd"}


class Node:
    __slots__ = ("children", "marks", "tag")

    def __init__(self, tag: str, marks: str = ""):
        self.tag, self.marks, self.children = tag, marks, []


def parse(page: str) -> Node:
    """A tree of elements and decoded text, forgiving about end tags that are missing or wrong."""
    root = Node("#root")
    stack = [root]
    at, n = 0, len(page)
    low = None
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            s = m[0]
            if s[0] != "<" or s == "<":
                stack[-1].children.append(html.unescape(s))
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "td", "th") and tag in _INLINE | {"p"}:
                    break
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _SCOPE:
                    break
        if tag in _SAME:
            ends, scope = _SAME[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    del stack[k:]
                    if tag != "tr":
                        break
                elif stack[k].tag in scope:
                    break
        marks = " ".join((v or k).strip("\"'") if k.lower() != "hidden" else "hidden" for k, v in _ATTR.findall(m[3]) if k.lower() in _MARKS) if m[3] else ""
        node = Node(tag, marks)
        stack[-1].children.append(node)
        if tag in _RAW:
            low = low or page.lower()
            end = low.find("</" + tag, at) if len(low) == n else next((x.start() for x in [re.compile("</" + tag, re.I).search(page, at)] if x), -1)
            if end < 0:
                end = n
            at = end
            if at < n:
                at = page.find(">", at) + 1 or n
        elif tag not in _VOID and not m[0].endswith("/>"):
            stack.append(node)
    return root


def _chrome(node: Node, inside: bool) -> bool:
    if node.tag in _DROP or (node.tag == "header" and not inside):
        return True
    if not node.marks or node.tag in ("html", "body", "article", "main"):
        return node.tag == "article" and bool(re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", node.marks, re.I))
    return bool(_CHROME.search(node.marks) or "hidden" in node.marks.split() or (not inside and _HEADER.search(node.marks)))


def _roots(top: Node) -> list[Node]:
    """The articles of a page, else its main elements, else all of it."""
    for wanted in ("article", "main"):
        found, todo = [], [top]
        while todo:
            x = todo.pop()
            if x.tag == wanted or (wanted == "main" and x.marks == "main"):
                if not _chrome(x, False):
                    found.append(x)
            elif x is top or not _chrome(x, False):
                todo.extend(c for c in reversed(x.children) if not isinstance(c, str))
        if found:
            return found
    return [top]


def _hashed(root: Node) -> dict[int, int]:
    """The hash of every element subtree that may be a site's template, by id(node). Iterative, as trees may be deep.

    A paragraph, heading, list item or cell needs LEAST_CHARS of text: shorter ones are alike by chance.
    """
    import xxhash

    order, todo, by, out = [], [root], {}, {}
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(c for c in x.children if not isinstance(c, str))
    for x in reversed(order):
        h, n = xxhash.xxh3_64(f"{x.tag} {x.marks}"), 0
        for c in x.children:
            if isinstance(c, str):
                t = " ".join(c.split())
                h.update(t)
                n += len(t)
            else:
                d, m = by[id(c)]
                h.update(d)
                n += m
        by[id(x)] = d, _ = h.digest(), n
        if x is not root and x.tag not in ("html", "body") and x.tag not in _INLINE and x.tag not in _DROP and (n >= LEAST_CHARS or x.tag not in _TEXTUAL and n):
            out[id(x)] = int.from_bytes(d, "little", signed=True)
    return out


def template_hashes(page: str) -> set[int]:
    """Hashes of a page's subtrees that could be template, inside its articles too."""
    return {h for r in _roots(parse(page)) for h in _hashed(r).values()}


def main_text(page: str | None, template: set[int] = frozenset()) -> str:
    """The article's blocks joined by line feeds, without chrome and without the given subtrees. Empty if there is none."""
    if not page:
        return ""
    top = parse(page)
    blocks, run = [], []

    def flush():
        s = " ".join("".join(run).split())
        run.clear()
        if s:
            blocks.append(s)

    for root in _roots(top):
        inside = root is not top
        hashes = _hashed(root) if template else {}
        todo: list = [root]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                run.append(x)
            elif x.tag == "br":
                run.append(" ")
            elif x is root or not (hashes.get(id(x)) in template or _chrome(x, inside)):
                if x.tag not in _INLINE:
                    flush()
                    todo.append(None)
                todo.extend(reversed(x.children))
        flush()
    return "\n".join(blocks)


def host(url) -> F.Column:
    """The lower-cased host of a URL; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def _hash_rows(batches):
    import pyarrow as pa
    import xxhash

    for b in rows_by_chars(batches, 1):
        hosts, own, hashes = [], [], []
        for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            hosts.append(h)
            own.append(xxhash.xxh3_64_intdigest(main_text(page)) - (1 << 63))
            hashes.append(sorted(template_hashes(page)) if page else [])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(own, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["host", "own", "hashes"])


def _extract(batches):
    import pyarrow as pa

    for b in rows_by_chars(batches, 2):
        text, last, drop = [], None, frozenset()
        for page, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if t != last:
                last, drop = t, frozenset(t or ())
            text.append(main_text(page, drop))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many: int = MANY_PAGES) -> DataFrame:
    """(host, template): hashes of subtrees on at least min_pages pages and min_share of a host's pages, or on `many`.

    Pages of a host with the same own text (the main text before templates are known) count as one, and a page counts a
    subtree once. Html and body are never template. Pages without a host have no site and no template.
    """
    rows = stored(only(pages, "url", "html").select(host(F.col("url")).alias("host"), "html").where("host <> '' and html is not null").mapInArrow(_hash_rows, "host string, own bigint, hashes array<bigint>"), "subtrees")
    total = rows.select("host", "own").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    often = rows.select("host", "own", F.explode("hashes").alias("h")).distinct().groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    kept = often.join(total, "host").where((F.col("n") >= min_share * F.col("pages")) | (F.col("n") >= many))
    templates = stored(kept.groupBy("host").agg(F.collect_list("h").alias("template")), "templates")
    drop_stored(rows)
    return templates


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every page. Null or empty html gives an empty text.

    What recurs on a site goes first; elements that are never article text by their tag, class or id go as well, since
    most hosts have too few pages to tell. Rows that repeat a page give a row each and count as one page.
    """
    ready(pages.sparkSession)
    templates = site_templates(pages)
    rows = only(pages, "page_id", "url", "html").withColumn("host", host(F.col("url"))).join(templates, "host", "left")
    return rows.select("page_id", "url", "html", "template").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
