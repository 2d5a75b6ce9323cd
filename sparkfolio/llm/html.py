"""Main text of web pages, with the templates of their sites removed.

Every element's subtree (tags and text) is hashed; Spark counts on how many
pages of its host each subtree stands, and those on many pages are the site's
template: they are deleted before the text is read.  What a page marks as not
its main text (navigation, footers, forms, adverts, comments and so on, by tag,
role, class or id) goes as well; by role, class or id only if it holds half of the
page's text at most, reader comments at any length.  Main text are the page's
mains, else its articles, that no such part holds: an article in a sidebar, in an
aside or among the comments is a part of those.  What holds main text stays.  On
a page without main text tags mark by the same size, so a form around the whole
page stays.  A name marks as a whole or with hyphens if all its parts
are such names, so ``has-sidebar`` and ``share-price`` mark nothing.  Where a page
marks its article, paragraphs within are text even if other pages repeat them:
only containers of an article can be template.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: A subtree on this many pages of a host, and on this share of them, is template.
LEAST_PAGES, LEAST_SHARE = 4, 0.3
#: Template subtrees of all hosts are broadcast up to this many, else joined by host.
BROADCAST_MOST = 50_000
#: Into how many parts a host's pages are dealt for that join.
SALTS = 16

#: Elements of HTML by their role in text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|iframe|xmp|noembed|noframes"
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("aside details dialog div dl fieldset figure footer form header menu nav ol section table ul".split())
NEVER = frozenset("script style textarea title noscript iframe xmp noembed noframes head template svg math canvas object audio video nav footer aside form button select dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe "
    "signup nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars widget widgets related share sharing social masthead comment comments reply replies disqus respond".split()
)
OUTER_NAMES = frozenset("header footer".split())
COMMENT_NAMES = frozenset("comment comments reply replies disqus respond".split())
#: What a name with hyphens may hold beside such names.
FILLER = frozenset("site page main top bottom left right box bar block area wrapper wrap container list section inner outer links buttons button slot unit form bottom text message thread body content item items author meta posts articles stories entries".split())
MAIN = ("article", "main")
#: What an opening tag closes, if it is open since the last border.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(" + RAW + r""")\b[^>]*>(.*?)(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<[a-zA-Z/!?][^>]*(?:>|\Z)|[^<]+|<""", re.S | re.I)
ATTRIBUTE = re.compile(r"""(?<![^\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\W_]+")


class Node:
    """An element: ``marked`` tells how its page marks it; ``size`` counts its text."""

    __slots__ = ("tag", "marked", "parts", "digest", "size")

    def __init__(self, tag: str, marked: int):
        self.tag, self.marked, self.parts, self.digest, self.size = tag, marked, [], 0, 0


#: Marks: none; by a tag that never holds text; by tag; by name; a name of comments.
NONE, RAW_TAG, TAG, NAME, COMMENTS = range(5)
UNSEEN = frozenset("script style textarea title noscript iframe xmp noembed noframes head template svg math canvas object audio video select button".split())


def _named(value: str, in_article: bool) -> int:
    """What a class or an id says about an element."""
    found = NONE
    for token in value.split():
        parts = [p.lower() for p in PART.findall(token)]
        names = [p for p in parts if p in NAMES or (not in_article and p in OUTER_NAMES)]
        if names and all(p in NAMES or p in OUTER_NAMES or p in FILLER or p.isdigit() for p in parts):
            found = max(found, COMMENTS if COMMENT_NAMES.intersection(names) else NAME)
    return found


def _marked(tag: str, attributes: str, in_article: bool) -> int:
    """How a page marks the element as something else than main text."""
    if tag in UNSEEN:
        return RAW_TAG
    if tag in NEVER or (tag == "header" and not in_article):
        return TAG
    if "=" not in attributes or tag in ("html", "body", "main", "header"):
        return NONE
    found = NONE
    for m in ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            if value.strip().lower() in ROLES:
                found = max(found, NAME)
        else:
            named = _named(value, in_article)
            if tag != "article" or named == COMMENTS or {"ad", "advert"}.intersection(value.lower().split()):
                found = max(found, named)
    return found


def parsed(page: str) -> Node:
    """The page as a tree; broken markup is closed as browsers do, near enough for text."""
    root = Node("", NONE)
    stack, inside = [root], 0

    def close(to: int) -> None:
        nonlocal inside
        while len(stack) > to:
            node = stack.pop()
            inside -= node.tag in MAIN
            if node.marked != RAW_TAG:
                own = [p for p in node.parts if p.__class__ is Node]
                node.size = sum([p.size for p in own]) + sum([len(p) for p in node.parts if p.__class__ is str and not p.isspace()])
            node.digest = xxhash.xxh3_64_intdigest(b"".join([node.tag.encode(), *(p.digest.to_bytes(8, "little") if p.__class__ is Node else xxhash.xxh3_64_digest(" ".join(p.split()).encode("utf-8", "replace")) for p in node.parts)]))

    for m in TOKEN.finditer(page):
        raw = m[0]
        if raw[0] != "<" or raw == "<":
            stack[-1].parts.append(html.unescape(raw) if "&" in raw else raw)
            continue
        if m[4] is None:  # raw text of a script and the like, a comment, a declaration, a broken tag
            continue
        tag = m[4].lower()
        if m[3]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in CLOSES:
            ends, borders = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    close(i)
                    if tag != "tr":
                        break
                elif stack[i].tag in borders:
                    break
        if tag == "br":
            stack[-1].parts.append(" ")
            continue
        node = Node(tag, _marked(tag, m[5], inside > 0))
        stack[-1].parts.append(node)
        if tag not in VOID and not m[5].endswith("/"):
            stack.append(node)
            inside += tag in MAIN
    close(1)
    root.size = sum([p.size if p.__class__ is Node else len(p) for p in root.parts])
    return root


def subtrees(root: Node) -> set[int]:
    """Digests of the subtrees that could be template."""
    out, todo = set(), [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag in MAIN
        for part in node.parts:
            if part.__class__ is Node:
                if part.parts and (part.tag in CONTAINER if inside else part.tag in BLOCK and part.tag not in ("html", "body", "head", "article", "main")):
                    out.add(part.digest)
                todo.append((part, inside))
    return out


def main_text(root: Node, template: frozenset[int] = frozenset()) -> str:
    """The text of what is left: blocks in the order of the page, one a line."""

    def deleted(n: Node, inside: bool) -> bool:
        return n.marked == RAW_TAG or (n.digest in template and (n.tag in CONTAINER if inside else n.tag not in ("html", "body", *MAIN)))

    def small(n: Node) -> bool:
        return n.marked != NONE and (n.marked == COMMENTS or 2 * n.size <= root.size)

    # the outermost mains or else articles that no marked part holds, in the order of the page, and all that holds them
    found: dict[str, list[tuple]] = {"main": [], "article": []}
    todo: list[tuple] = [(root, None)]  # a node and the same of its parent
    while todo:
        path = todo.pop()
        node = path[0]
        if node.tag in found:
            found[node.tag].append(path)
        if node.tag not in MAIN:  # what is inside belongs to it
            todo.extend((part, path) for part in reversed(node.parts) if part.__class__ is Node and not deleted(part, False) and not small(part))
    paths = found["main"] or found["article"]
    tops, holders = [p[0] for p in paths] or [root], set()
    for path in paths:
        while (path := path[1]) and id(path[0]) not in holders:
            holders.add(id(path[0]))

    def gone(n: Node, inside: bool) -> bool:
        if deleted(n, inside):
            return True
        if n.marked == NONE or id(n) in holders:
            return False
        return small(n) or (n.marked == TAG and bool(paths))

    lines: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if now:
            if text := " ".join("".join(now).split()):
                lines.append(text)
            now.clear()

    for top in tops:
        inside = top is not root
        walk: list = [top]
        while walk:
            node = walk.pop()
            if node is None:
                flush()
            elif node.__class__ is str:
                now.append(node)
            elif node is top or not gone(node, inside):
                if node.tag in BLOCK:
                    flush()
                    walk.append(None)
                walk.extend(reversed(node.parts))
            elif node.tag in BLOCK:
                flush()
        flush()
    return "\n".join(lines)


def host_of(url_col: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """``host`` and ``template`` (digests of the subtrees on many of its pages); hosts without any have no row.

    A page counts a subtree once.  Counts are combined before they are shuffled,
    so a host of a third of all pages is no more rows than its distinct subtrees;
    a host has at most (subtrees a page) / ``least_share`` templates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[d - (1 << 63) for d in subtrees(parsed(h or ""))] for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.list_(pa.int64()))], names=["host", "subtrees"])

    own = pages.select(host_of(url_col).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    found = common.mapped(own, run, "host string, subtrees array<long>")
    # one pass: a null digest counts the host's pages
    each = found.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "subtrees")).alias("digest"))
    counted = common.written(each.groupBy("host", "digest").agg(F.count("*").alias("n")).where((F.col("n") >= least_pages) | F.col("digest").isNull()), "subtrees")
    hosts = counted.where("digest IS NULL").select("host", F.col("n").alias("pages"))
    many = counted.where("digest IS NOT NULL").join(hosts, "host").where(F.col("n") >= F.col("pages") * least_share)
    return many.groupBy("host").agg(F.collect_set("digest").alias("template"))


def extracted(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, name: str = "main_text") -> DataFrame:
    """``pages`` with ``main_text``; a null or empty page has an empty text.

    Pages without a host (null or odd urls) share one template count.  Repeated
    pages are rows of their own and each counts as a page.  ``name`` gets
    underscores in front while another column has it.
    """
    name = common.free(name, pages.columns)
    at, host, own_template, salt, other = (common.free(n, pages.columns) for n in ("_at", "_host", "_template", "_salt", "_other"))
    spark = pages.sparkSession
    common.small_batches(spark)
    found = common.written(templates(pages, url_col, html_col, least_pages, least_share), "templates").select(F.col("host").alias(host), F.col("template").alias(own_template))
    size = found.agg(F.sum(F.size(own_template))).first()[0] or 0
    own = pages.withColumn(at, host_of(url_col))
    columns, known = pages.columns, None
    if size <= BROADCAST_MOST:
        rows = found.collect()  # that many numbers at most
        known = spark.sparkContext.broadcast({r[0]: frozenset(d + (1 << 63) for d in r[1]) for r in rows})
        joined = own
    else:  # a host's pages are many tasks
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        own = own.withColumn(salt, F.pmod(F.xxhash64(F.col(f"`{url_col}`"), F.col(f"`{html_col}`")), F.lit(SALTS)).cast("int"))
        found = found.withColumn(other, salts)
        joined = own.join(found, (F.col(at) == F.col(host)) & (F.col(salt) == F.col(other)), "left").select(*[F.col(f"`{c}`") for c in columns], at, own_template)
    schema = T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple, frozenset] = {}

        def of(host: str, template: list | None) -> frozenset:
            if known is not None:
                return known.value.get(host, frozenset())
            key = tuple(template or ())
            if key not in sets:
                if len(sets) > 1000:
                    sets.clear()
                sets[key] = frozenset(d + (1 << 63) for d in key)
            return sets[key]

        for batch in batches:
            hosts = batch.column(len(columns)).to_pylist()
            own = [None] * len(hosts) if known is not None else batch.column(len(columns) + 1).to_pylist()
            texts = [main_text(parsed(page or ""), of(h, t)) for page, h, t in zip(batch.column(columns.index(html_col)).to_pylist(), hosts, own, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(texts, pa.string())], names=[*columns, name])

    return common.mapped(joined, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the main text of every page."""
    out = extracted(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
