"""Main text of web pages by wrapper induction.

Every page is parsed and its tree aligned with reference trees of its host by simple tree
matching.  How often a text stands at a node is counted over all different pages of the host.  A
text that recurs there is the host's template; other text varies.  The wrapper of a host is the set
of its constant texts and the container that holds most of the varying text, and it chooses the
content of each page of the host.  Menus, headers, footers, sidebars, notices, adverts, forms and
comments are left out by tag or class before that.

A text is constant if at least a twentieth of the host's pages have it and it is on half of the
pages that have its path or, outside articles, that align with its node; or on ten pages, however
many have the node (a template variant).  Two pages are needed, inside an article three.

A page without a wrapper (a null url, a host with one page), or of which the wrapper leaves
nothing, is read by tags and classes alone: an article, where there is one, is its content.  Null
and empty html give an empty text.  Repeated rows give repeated results.  Pages are read and
aligned whole, however long or broken.  Further columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boardsift.llm.common import stored, table

#: Trees of a host that all its pages are aligned with; pages up to this length are taken first.
REFERENCES = 3
LENGTH = 1 << 16
#: Containers nested deeper are one node with a long name.
DEPTH = 200
#: References and wrappers are sent to all tasks up to this size; larger sets are joined by host.
BROADCAST_BYTES = 8 << 20

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# The roles of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg xmp noembed noframes".split())
DROPPED = RAW | set("head nav footer aside form button select dialog menu object canvas audio video map".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small "
             "span strike strong sub sup time tt u var wbr td th".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
ARTICLE = {"article", "main"}
CONTAINERS = set("html body div section center table tbody".split()) | ARTICLE
ASIDE = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|footer|sidebar|aside|ads?|advert|adverts|advertisement|"
    r"banner|promo|promoted|sponsor|sponsored|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|"
    r"subscribe|signup|login|share|sharing|social|related|recommended|comments?|disqus|replies|widget|toolbar|"
    r"pagination|pager|search|complementary|contentinfo|dialog)(?:$|[\s_-])", re.I)
HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar|top-bar)(?:$|[\s_-])", re.I)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def blocks(page: str) -> list[tuple[str, bool, str]]:
    """(path of open containers, whether in an article, text) of each block that may be content."""
    out: list[tuple[str, bool, str]] = []
    stack: list[tuple[str, bool]] = []  # open elements: name, whether left out
    path: list[str] = []
    buffer: list[str] = []
    hidden = in_article = at = 0

    def flush() -> None:
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append(("/".join(path), in_article > 0, text))

    def close() -> None:
        nonlocal hidden, in_article
        name, left_out = stack.pop()
        if name not in INLINE:
            flush()
            path.pop()
        hidden -= left_out
        in_article -= name in ARTICLE

    while (found := TAG.search(page, at)) is not None:
        if not hidden and found.start() > at:
            buffer.append(page[at:found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            if found[0].startswith("<![CDATA[") and not hidden:
                buffer.append(found[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if found[1]:
            if name == "p" and not any(n == "p" for n, _ in stack):
                flush()
            if any(n == name for n, _ in stack):
                while stack[-1][0] != name:
                    close()
                close()
            continue
        if name in VOID:
            if name == "br" and not hidden:
                buffer.append(" ")
            elif name == "hr":
                flush()
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name not in INLINE:
            flush()
            for shut in CLOSES.get(name, ()):
                if stack and stack[-1][0] == shut:
                    close()
            if stack and any(n == "p" for n, _ in stack) and name not in CLOSES.get("li"):
                while any(n == "p" for n, _ in stack):
                    close()
        elif name in ("td", "th") and not hidden:
            buffer.append(" ")
        marks = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(found[3])) if found[3] else ""
        left_out = name in DROPPED or name == "header" and not in_article
        if marks and name not in ("html", "body") and name not in ARTICLE:
            left_out |= bool(ASIDE.search(marks)) or not in_article and bool(HEADER.search(marks))
        stack.append((name, left_out))
        if name not in INLINE:
            path.append(name + ("." + ".".join(marks.split()) if marks else ""))
        if left_out and not hidden:
            buffer.clear()
        hidden += left_out
        in_article += name in ARTICLE
    if not hidden and at < len(page):
        buffer.append(re.sub(r"<[/!a-zA-Z][^>]*\Z", "", page[at:]))
    flush()
    return out


def tree(parts: list[tuple[str, bool, str]]) -> dict:
    """Blocks as a tree of containers; leaves are texts, with their place among the blocks."""
    root: dict = {"name": "", "text": None, "at": -1, "kids": []}
    open_path: list[str] = []
    nodes = [root]
    for at, (path, _, text) in enumerate(parts):
        names = path.split("/", DEPTH) if path else []
        k = 0
        # the innermost element of a block is its own, the ones around it are shared
        while k < min(len(names) - 1, len(open_path)) and names[k] == open_path[k]:
            k += 1
        del nodes[k + 1:]
        for name in names[k:]:
            node = {"name": name, "text": None, "at": -1, "kids": []}
            nodes[-1]["kids"].append(node)
            nodes.append(node)
        open_path = names
        nodes[-1]["kids"].append({"name": "#", "text": text, "at": at, "kids": []})
    return root


_PAIR = 1 << 32


def _only_text(node: dict) -> str | None:
    """The text of a container that holds nothing else."""
    return node["kids"][0]["text"] if len(node["kids"]) == 1 else None


def _score(a: dict, b: dict, steps: dict) -> int:
    """Size of the largest match of two trees times ``_PAIR``, plus the equal texts in it."""
    if a["name"] != b["name"]:
        return 0
    one, two = a["kids"], b["kids"]
    if not one or not two:
        return _PAIR + (a["text"] is not None and a["text"] == b["text"])
    if len(one) == len(two) == 1:
        return _PAIR + _score(one[0], two[0], steps)
    known = steps.get((id(a), id(b)))
    if known is None:
        above, taken = [0] * (len(two) + 1), []
        flat = [(y["name"], _only_text(y), y) for y in two]
        for x in one:
            last, row, step, name, text = 0, [0], bytearray(len(two)), x["name"], _only_text(x)
            for j, (other, words, y) in enumerate(flat):
                best = above[j + 1]
                if last > best:
                    best, step[j] = last, 1
                if name == other:
                    both = above[j] + (_score(x, y, steps) if text is None or words is None else
                                       _PAIR * 2 + (text == words))
                    if both >= best:
                        best, step[j] = both, 2
                last = best
                row.append(best)
            above = row
            taken.append(step)
        known = steps[id(a), id(b)] = (_PAIR + above[-1], taken)
    return known[0]


def match(a: dict, b: dict) -> tuple[int, list]:
    """Simple tree matching: the size of the largest order-keeping match of two trees, and its pairs.

    Among the largest matches it is one with the most equal texts.
    """
    steps: dict = {}
    size = _score(a, b, steps) // _PAIR
    found, todo = [], [(a, b)] if size else []
    while todo:
        x, y = todo.pop()
        found.append((x, y))
        i, j = len(x["kids"]), len(y["kids"])
        if i == j == 1:
            if x["kids"][0]["name"] == y["kids"][0]["name"]:
                todo.append((x["kids"][0], y["kids"][0]))
            continue
        while i and j:
            step = steps[id(x), id(y)][1][i - 1][j - 1]
            if step == 2:
                todo.append((x["kids"][i - 1], y["kids"][j - 1]))
            i, j = i - (step != 1), j - (step != 0)
    return size, found


def key_of(path: str, text: str) -> int:
    return int.from_bytes(blake2b(f"{path}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(),
                          "big", signed=True)


def aligned(page: str, references: list[dict]) -> list[tuple[int, str, bool, str]]:
    """(node, path, whether in an article, text) of each block; the node is the one of the reference
    that matches best, or -1 where nothing aligns."""
    parts = blocks(page)
    nodes = [-1] * len(parts)
    if parts and references:
        own = tree(parts)
        k, (_, pairs) = max(((k, match(own, r)) for k, r in enumerate(references)), key=lambda m: (m[1][0], -m[0]))
        for a, b in pairs:
            if a["text"] is not None:
                nodes[a["at"]] = b["at"] * REFERENCES + k
    return [(node, *part) for node, part in zip(nodes, parts)]


def recurs(n, having, pages, inside):
    """Whether a text on ``n`` of the pages ``having`` its place is constant; numbers or columns.

    Inside an article only what most of these pages have there is, as a sentence that several articles share is content.
    """
    often, most, outside = (20 * n >= pages) & (n >= 2), 2 * n >= having, inside == False  # noqa: E712
    return often & ((most & (n >= 3)) | (outside & (most | (n >= 10))))


def container(weight: dict[str, int]) -> str:
    """The innermost container with most of the varying text, given by path."""
    within: Counter = Counter()
    for path, w in weight.items():
        names = path.split("/", DEPTH)[:DEPTH] if path else []
        for k in range(len(names) + 1):
            within["/".join(names[:k])] += w
    deep = [p for p, w in within.items() if w >= 0.8 * within[""] and (
        not p or p.rpartition("/")[2].partition(".")[0] in CONTAINERS)]
    return max(deep, key=lambda p: (p.count("/") if p else -1, p), default="")


def wrapper(pages: list[str]) -> tuple[str | None, list[str]]:
    """(container of the varying text, constant texts) of a list of pages; equal pages count once.

    The rule of ``wrappers`` in one process; no container without two pages.
    """
    pages = [p for p in dict.fromkeys(pages) if blocks(p)]
    if len(pages) < 2:
        return None, []
    references = [tree(blocks(p)) for p in pages[:REFERENCES]]
    at_path, at_node = defaultdict(set), defaultdict(set)
    of_path, of_node = defaultdict(set), defaultdict(set)
    for k, page in enumerate(pages):
        for node, path, inside, text in aligned(page, references):
            at_path[path, inside, text].add(k)
            of_path[path].add(k)
            if node >= 0 and not inside:
                at_node[node, path, text].add(k)
                of_node[node].add(k)
    constant = {(path, text) for (path, inside, text), at in at_path.items()
                if recurs(len(at), len(of_path[path]), len(pages), inside)}
    constant |= {(path, text) for (node, path, text), at in at_node.items()
                 if recurs(len(at), len(of_node[node]), len(pages), False)}
    weight: Counter = Counter()
    for (path, _, text), at in at_path.items():
        weight[path] += 0 if (path, text) in constant else len(text) * len(at)
    return container(weight), sorted({text for _, text in constant})


def extract(page: str | None, root: str | None = None, constants: frozenset[int] = frozenset()) -> str:
    """The blocks of content, joined by empty lines: what varies inside the wrapper's container.

    A page with most of its varying text outside the container is read whole.
    """
    parts = blocks(page or "")
    if root is not None:
        kept = [p for p in parts if key_of(p[0], p[2]) not in constants]
        held = [p for p in kept if not root or p[0] == root or p[0].startswith(root + "/")]
        if 2 * sum(len(p[2]) for p in held) >= sum(len(p[2]) for p in kept):
            kept = held
        if kept:
            return "\n\n".join(text for _, _, text in kept)
    if any(inside for _, inside, _ in parts):
        parts = [p for p in parts if p[1]]
    return "\n\n".join(text for _, _, text in parts)


def references(pages: DataFrame) -> DataFrame:
    """(host, refs): some pages of each host, cut per task before the shuffle."""
    order = Window.partitionBy("host").orderBy(F.length("html") > LENGTH, F.xxhash64("html"), "html")
    return pages.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= REFERENCES).groupBy("host").agg(
        F.collect_set("html").alias("refs"))


def aligned_blocks(pages: DataFrame) -> DataFrame:
    """(host, page, node, path, inside, key, chars) of all blocks of all different pages of (host, html)."""
    found = stored(references(pages), "wrapper-references")
    schema = "host string, page long, node int, path string, inside boolean, key long, chars long"
    size = found.agg(F.sum(F.length(F.array_join("refs", "")))).first()[0] or 0
    small = size <= BROADCAST_BYTES
    sent = pages.sparkSession.sparkContext.broadcast(
        {r.host: sorted(r.refs) for r in found.collect()}) if small else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees: dict[str, list[dict]] = {}
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                if row.host not in trees:
                    if not small and len(trees) > 100:
                        trees.clear()
                    trees[row.host] = [tree(blocks(r)) for r in (sent.value[row.host] if small else sorted(row.refs))]
                rows += [(row.host, row.page, node, path, inside, key_of(path, text), len(text))
                         for node, path, inside, text in aligned(row.html, trees[row.host])]
            yield pd.DataFrame(rows, columns=["host", "page", "node", "path", "inside", "key", "chars"])

    hashed = pages.withColumn("page", F.xxhash64("html"))
    return (hashed if small else hashed.join(found, "host")).mapInPandas(read, schema).distinct()


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, root, constants) of every host with two different pages; constants are keys of path and text."""
    pages = pages.filter(F.col("host").isNotNull() & F.col("html").isNotNull()).select("host", "html")
    rows = stored(aligned_blocks(pages), "wrapper-blocks")

    def counted(*keys: str, name: str) -> DataFrame:
        return rows.select(*keys, "page").distinct().groupBy(*keys).agg(F.count("*").alias(name))

    hosts = counted("host", name="pages").filter("pages > 1")
    at_path = rows.groupBy("host", "path", "inside", "key", "page").agg(F.max("chars").alias("chars")).groupBy(
        "host", "path", "inside", "key").agg(F.count("*").alias("n"), F.max("chars").alias("chars")).filter("n > 1")
    at_path = stored(at_path, "wrapper-texts")
    # a node holds one text of a page, so its rows are its pages
    nodes = rows.filter("node >= 0 AND NOT inside")
    at_node = nodes.groupBy("host", "node", "key").agg(F.count("*").alias("n")).filter("n > 1")
    of_node = nodes.groupBy("host", "node").agg(F.count("*").alias("having"))
    told = at_path.join(counted("host", "path", name="having"), ["host", "path"]).join(hosts, "host").filter(
        recurs(F.col("n"), F.col("having"), F.col("pages"), F.col("inside"))).select("host", "key")
    told = told.union(at_node.join(of_node, ["host", "node"]).join(hosts, "host").filter(
        recurs(F.col("n"), F.col("having"), F.col("pages"), F.lit(False))).select("host", "key")).distinct()
    constant = stored(at_path.join(told, ["host", "key"]), "wrapper-constants")
    fixed = constant.groupBy("host", "path").agg(F.sum(F.col("n") * F.col("chars")).alias("fixed"))
    every = rows.select("host", "path", "key", "page", "chars").distinct().groupBy("host", "path").agg(
        F.sum("chars").alias("every"))
    weights = every.join(hosts, "host").join(fixed, ["host", "path"], "left").select(
        "host", "path", (F.col("every") - F.coalesce("fixed", F.lit(0))).alias("w"))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": group["host"][:1], "root": [container(dict(zip(group["path"], group["w"])))]})

    roots = weights.groupBy("host").applyInPandas(choose, "host string, root string")
    return roots.join(constant.groupBy("host").agg(F.collect_set("key").alias("constants")), "host", "left")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of (page_id, url, html)."""
    hosted = pages.select("page_id", "url", "html", F.nullif(F.lower(F.regexp_extract(
        F.col("url"), HOST, 1)), F.lit("")).alias("host"))
    found = stored(wrappers(hosted), "wrappers")
    size = found.agg(F.sum(F.length("host") + F.length("root") + 8 * F.coalesce(
        F.size("constants"), F.lit(0)))).first()[0] or 0
    joined = hosted.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left")

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages, roots, constants in batches:
            yield pd.Series([extract(h, r, frozenset(c) if c is not None else frozenset())
                             for h, r, c in zip(pages, roots, constants)])

    return joined.select("page_id", "url", read("html", "root", "constants").alias("text"))


def op8_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))
