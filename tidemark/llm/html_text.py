"""Main text of web pages by site style trees (operator 3)."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.cluster import cut, lookup, small
from tidemark.llm.texts import bounded, slices

#: Distinct pages of a host that must have a branch or block before its importance says anything, and the importance below
#: which it goes (relative to that of the host's whole tree): where markup says nothing, and in an article or main element.
PAGES, LOW = 4, 0.4
ARTICLE_PAGES, ARTICLE_LOW = 8, 0.1
#: Relative importance from which a branch outside of the article is known to be important.
HIGH = 0.7
#: Ancestors of a node down to this depth are branches that may go as a whole, and of the deeper ones those at powers of two.
DEPTH = 32

MAIN, OPEN, FORM, NOISE = 2, 1, 0, -1  # what a branch is: article, not known, form (an article may stand in it), noise

# Elements that make blocks, those that a new block of their kind closes, and those whose content is no text.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul button label".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOISE_TAGS = set("head nav header footer aside menu dialog button select label".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
SKIPPED = "script|style|noscript|template|iframe|svg|math|canvas|object|textarea|title|audio|video"
NOISE_WORDS = (
    r"(?:ads?|adsense|adbox|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|share|sharing|social|sidebar|widget|related|recommend\w*"
    r"|comments?|commentlist|respond|disqus|replies|reply|breadcrumbs?|menu|navbar|nav|navigation|pagination|pager|footer|masthead|topbar|toolbar|login|search|skip)"
)
# Parts of a class that tell a state or what else is on the page, not what the element is.
STATES = "has no not with without is are hide hidden show shown enable enabled disable disabled open opened close closed active inactive collapsed expanded visible on off".split()
NOISE_NAME = re.compile(rf"{NOISE_WORDS}(?:[_-]\w+)*|(?:\w+[_-])+{NOISE_WORDS}|(?:(?:site|page|top|main|global)[_-])?header")
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({SKIPPED})\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<(/?)([a-z][a-z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-z][a-z0-9:-]*+)([^>]*+)>|<[!?/][^>]*+>",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-z][a-z0-9-]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.IGNORECASE)


REMARKS = re.compile(r"[._-](?:comments?|commentlist|respond|disqus|replies|reply)(?![a-z])")
#: Words of paragraphs that make the text of a page whose names all say noise.
ENOUGH = 20
#: Names of low and high branches and blocks of all hosts together, of 8 bytes each, up to which they are sent to the tasks by host.
NAMES = 200_000


class Block(NamedTuple):
    """A text, where it stands, what tags and roles say it is, the elements above it (by their numbers) whose names say noise, and those that are articles."""

    node: int
    branches: bytes
    kind: int
    text: str
    named: tuple[int, ...] = ()
    mains: tuple[int, ...] = ()
    tag: str = ""


class Low(NamedTuple):
    """What of a host is of little importance, where markup says nothing and in articles, and what of much: branches and blocks by name."""

    branches: frozenset[bytes] = frozenset()
    blocks: frozenset[int] = frozenset()
    article_branches: frozenset[bytes] = frozenset()
    article_blocks: frozenset[int] = frozenset()
    high: frozenset[bytes] = frozenset()


def _hash(data: str | bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


@lru_cache(maxsize=200_000)
def child(node: int, branches: bytes, label: str, depth: int) -> tuple[int, bytes]:
    """Name of the node that ``label`` names below ``node``, and its branches: those above it and itself, 8 bytes each."""
    own = _hash(node.to_bytes(8, "little", signed=True) + label.encode("utf-8", "surrogatepass"))
    return own, branches + own.to_bytes(8, "little", signed=True) if depth <= DEPTH or depth & (depth - 1) == 0 else branches


def is_noise(names: str) -> bool:
    """Whether one of the names (an id, classes) says that the element itself is a menu, an advert and the like. Names with a part of STATES do not."""
    return any(NOISE_NAME.fullmatch(x) and not set(re.split("[_-]", x)) & STATE_PARTS for x in names.split())


STATE_PARTS = frozenset(STATES)


@lru_cache(maxsize=50_000)
def label_of(name: str, attributes: str) -> tuple[str, int, bool]:
    """A node's label (tag, id and classes without their digits), what its tag and role say it is, and whether its names say noise."""
    values = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
    names = f"{values.get('id', '')} {values.get('class', '')}".strip()
    label = name + "".join(f".{x}" for x in sorted(re.sub(r"\d+", "", names).replace("/", "_").split()))
    hidden = "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""))
    role = values.get("role", "")
    named = name not in ("html", "body", "main") and is_noise(names)
    if hidden or name in NOISE_TAGS or role in NOISE_ROLES:
        return label, NOISE, named
    if name in ("article", "main") or role in ("main", "article") or values.get("itemprop") == "articlebody":
        return label, MAIN, named
    return label, FORM if name in ("form", "fieldset") or role == "form" else OPEN, named


def judged(blocks: list[Block], chains: dict[int, tuple[int, ...]], remarks: set[int]) -> list[Block]:
    """The blocks with kind NOISE where a name above them says noise and is believed. chains: the elements with such names at and above each article; remarks: those with names of
    reader comments.

    Names of layouts and states often stand around an article or on it. If every article stands under a name that says noise, the names at and above the one with the most
    text are not believed (those of reader comments only count if there are no others); on a page without articles whose names leave nothing, neither is the
    outermost name above most words of paragraphs, if these are ENOUGH.
    """
    trusted: set[int] = {x for b in blocks for x in b.named}
    texts = [b for b in blocks if b.kind in (MAIN, OPEN)]
    if any(b.kind == MAIN for b in texts):
        if not any(b.kind == MAIN and not b.named for b in texts):
            length: dict[int, int] = {}
            for b in texts:
                for m in b.mains:
                    if set(b.named) <= set(chains[m]):
                        length[m] = length.get(m, 0) + len(b.text)
            own = [m for m in length if not remarks & set(chains[m])] or list(length)
            if own:
                trusted -= set(chains[max(own, key=lambda m: (length[m], -m))])
    elif texts and all(b.named for b in texts):
        length = {}
        for b in texts:
            if b.tag == "p":
                length[b.named[0]] = length.get(b.named[0], 0) + b.text.count(" ") + 1
        most = max(length, key=lambda x: (length[x], -x), default=0)
        if length.get(most, 0) >= ENOUGH:
            trusted.discard(most)
    return [b._replace(kind=NOISE) if trusted & set(b.named) else b for b in blocks]


def parse(page: str) -> tuple[list[Block], list[tuple[int, bytes, str]]]:
    """The blocks of text of a page in order, and the style (labels of the children) of each inner node with its branches.

    Markup need not be sound: end tags close what is open in them or nothing, a new paragraph, item or cell
    closes the one before, and all else is closed by the end of the page.
    """
    blocks: list[Block] = []
    styles: list[tuple[int, bytes, str]] = []
    stack: list[tuple[str, int, bytes, int, list[str], tuple[int, ...], tuple[int, ...]]] = [("", 0, b"", OPEN, [], (), ())]
    run: list[str] = []
    chains: dict[int, tuple[int, ...]] = {}
    remarks: set[int] = set()
    at = number = 0

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                name, node, branches, kind, _, named, mains = stack[-1]
                blocks.append(Block(node, branches, kind, text, named, mains, name))
            run.clear()

    def close(to: int) -> None:
        while len(stack) > to:
            _, node, branches, _, children, _, _ = stack.pop()
            if children:
                styles.append((node, branches, ",".join(children)))

    for m in TOKEN.finditer(page):
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        name, ending = (m[3] or m[6] or "").lower(), m[2] or m[5]
        if name == "br":
            run.append(" ")
        elif name in BLOCKS:
            flush()
            if ending:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
            elif name != "hr":
                ends = CLOSES.get(name, {"p"})
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in ends:
                        close(i)
                        break
                    if stack[i][0] != "p" and not (name in CLOSES and stack[i][0] in ("b", "i")):
                        break
                label, kind, noise = label_of(name, m[4] or m[7] or "")
                _, node, branches, above, children, named, mains = stack[-1]
                children.append(label)
                number += 1
                named = (*named, number) if noise else named
                if noise and REMARKS.search(label):
                    remarks.add(number)
                if kind == MAIN and above != NOISE:
                    mains, chains[number] = (*mains, number), named
                if above == NOISE or kind == NOISE:
                    kind = NOISE
                elif kind != MAIN:
                    kind = above if kind == OPEN or above == MAIN and kind != FORM else kind
                    if above == FORM:
                        kind = FORM
                stack.append((name, *child(node, branches, label, len(stack)), kind, [], named, mains))
    if at < len(page):
        run.append(page[at:])
    flush()
    close(0)
    return judged(blocks, chains, remarks), styles


def host(url: str) -> Column:
    """The host of a URL in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.trim(F.coalesce(F.col(url), F.lit(""))), r"^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def place(host: str, node: int) -> int:
    """The name of a node of a host."""
    return _hash(host.encode("utf-8", "surrogatepass") + b"\n" + node.to_bytes(8, "little", signed=True))


def block_name(node_place: int, text: str) -> int:
    """The name of a text in the blocks of a node of a host."""
    return node_place ^ _hash(text)


def tree_rows(hosts: list[str], pages: list[str]) -> set[tuple]:
    """What each page adds to the tree of its host: (place, kind, value, host, branches, page) for each of its nodes ("n", with
    its host and branches), of their styles ("s") and of its blocks ("c"). Pages of one main content are one page."""
    rows: set[tuple] = set()
    for host, page in zip(hosts, pages, strict=True):
        blocks, styles = parse(page)
        same = _hash("\n".join(b.text for b in blocks if b.kind in (MAIN, OPEN)))
        places = {node: (place(host, node), branches) for node, branches in {(b.node, b.branches) for b in blocks} | {x[:2] for x in styles}}
        rows.update((at, "n", 0, host, branches, same) for at, branches in places.values())
        rows.update((places[b.node][0], "c", block_name(places[b.node][0], b.text), None, None, same) for b in blocks)
        rows.update((places[node][0], "s", _hash(style), None, None, same) for node, _, style in styles)
    return rows


def style_names(pages: DataFrame) -> DataFrame:
    """What of ``Low`` each branch and block of a host is: rows (host, branches, blocks, article_branches, article_blocks, high), one for each
    name, which stands in the fields that it belongs to (the others are null), from the merged pages (host, html).

    A node's presentation importance is the entropy, to base m, of its styles over the m distinct pages that have it; its
    content importance is the mean over its blocks of 1 - log k / log m for a text that stands on k of these pages. A
    branch's importance is the greater of both, as means over the nodes in it weighted by pages; a block's is its content
    importance. Importance is relative to that of the host's whole tree. Counts of distinct pages are aggregated by
    (node, kind, value), so a host of any size is spread; what remains is a row for each node.
    """
    columns = {"place": pa.int64(), "kind": pa.string(), "value": pa.int64(), "host": pa.string(), "branches": pa.binary(), "page": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            rows = list(tree_rows(batch.column("host").to_pylist(), batch.column("html").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(columns.values())], list(columns))

    rows = pages.select("host", "html").mapInArrow(run, "place bigint, kind string, value bigint, host string, branches binary, page bigint")
    counts = cut(rows.groupBy("place", "kind", "value", "host", "branches").agg(F.count_distinct("page").alias("k")))

    def total(kind: str, value: Column) -> Column:
        return F.sum(F.when(F.col("kind") == kind, value).otherwise(0))

    k = F.col("k").cast("double")
    nodes = counts.groupBy("place").agg(F.max("host").alias("host"), F.max("branches").alias("branches"), total("n", k).alias("m"), *[total(x, v).alias(f"{name}_{x}") for x in "sc" for name, v in (("n", k), ("w", k * F.log(k)))])
    nodes = cut(nodes.where("m > 1"))
    # with n = sum of k and w = sum of k log k: the entropy of the styles is log n - w / n; the mean of log k over the blocks is w / n
    shape = F.greatest(F.lit(0.0), (F.log("n_s") - F.col("w_s") / F.col("n_s")) / F.log("m"))
    content = F.greatest(F.lit(0.0), 1 - F.col("w_c") / F.col("n_c") / F.log("m"))
    above = F.transform(F.sequence(F.lit(0), F.floor(F.octet_length("branches") / 8).cast("int")), lambda i: F.when(i == 0, F.lit(b"")).otherwise(F.substring("branches", i * 8 - 7, F.lit(8))))
    ups = nodes.select("host", F.explode(above).alias("branch"), "m", "n_s", "n_c", F.when(F.col("n_s") > 0, F.col("n_s") * shape).alias("shape"), F.when(F.col("n_c") > 0, F.col("n_c") * content).alias("content"))
    branch = ups.groupBy("host", "branch").agg(F.max("m").alias("m"), (F.sum("shape") / F.sum("n_s")).alias("shape"), (F.sum("content") / F.sum("n_c")).alias("content")).where("content IS NOT NULL")
    branch = cut(branch.select("host", "branch", "m", F.greatest("content", F.coalesce("shape", F.lit(0.0))).alias("importance")))
    root = small(branch.where(F.octet_length("branch") == 0).select(F.col("host").alias("root_host"), F.col("importance").alias("root")))

    def named(rows: DataFrame, name: str) -> list[Column]:
        low = (F.col("m") >= PAGES) & (F.col("importance") < LOW * F.col("root"))
        lower = (F.col("m") >= ARTICLE_PAGES) & (F.col("importance") < ARTICLE_LOW * F.col("root"))
        return [F.when(low, F.col(name)), F.when(lower, F.col(name))]

    found = branch.where(F.octet_length("branch") > 0).join(root, F.col("host") == F.col("root_host"))
    high = F.when((F.col("m") >= ARTICLE_PAGES) & (F.col("importance") >= HIGH * F.col("root")), F.col("branch"))
    found = found.select("host", *[c.alias(x) for c, x in zip(named(found, "branch"), ("branches", "article_branches"), strict=True)], high.alias("high")).where("branches IS NOT NULL OR article_branches IS NOT NULL OR high IS NOT NULL")
    texts = counts.where((F.col("kind") == "c") & (F.col("k") >= 2)).join(small(nodes).select(F.col("place").alias("at"), F.col("host").alias("of"), "m"), F.col("place") == F.col("at"))
    texts = texts.withColumn("importance", 1 - F.log(k) / F.log("m")).join(root, F.col("of") == F.col("root_host"))
    texts = texts.select(F.col("of").alias("host"), *[c.alias(x) for c, x in zip(named(texts, "value"), ("blocks", "article_blocks"), strict=True)]).where("blocks IS NOT NULL OR article_blocks IS NOT NULL")
    return found.unionByName(texts, allowMissingColumns=True).select("host", *Low._fields)


def low_by_host(names: DataFrame) -> DataFrame:
    """Rows (tree_host, the fields of ``Low``): ``names`` gathered by host. For at most NAMES names."""
    return names.groupBy(F.col("host").alias("tree_host")).agg(*[F.collect_set(x).alias(x) for x in Low._fields])


def names_of(host: str, page: str) -> set[bytes]:
    """The names, as bytes, of the branches and blocks of a page that its text may come from."""
    found: set[bytes] = set()
    for b in parse(page)[0]:
        if b.kind in (MAIN, OPEN):
            found.update(b.branches[i : i + 8] for i in range(0, len(b.branches), 8))
            found.add(block_name(place(host, b.node), b.text).to_bytes(8, "big", signed=True))
    return found


def low_by_page(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (row, the fields of ``Low``): of the ``names`` (cut) those that a page itself has, for the pages ``rows`` (row, host, html; cut) that have some.

    Each page asks for its own names, so what is gathered in one row grows with one page, never with its host.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            asked = [sorted(names_of(h, p)) for h, p in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)]
            of = pa.array([i for i, x in enumerate(asked) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(of), batch.column("host").take(of), pa.array([n for x in asked for n in x], pa.binary())], ["row", "host", "name"])

    asked = cut(rows.select("row", "host", "html").mapInArrow(run, "row bigint, host string, name binary"))
    block = F.coalesce("blocks", "article_blocks")
    name = F.coalesce("branches", "article_branches", "high", F.unhex(F.lpad(F.hex(block), 16, "0")))
    found = lookup(asked, cut(names.withColumn("name", name).dropDuplicates(["host", "name"])), ["host", "name"])
    return found.groupBy("row").agg(*[F.collect_set(x).alias(x) for x in Low._fields])


def main_text(page: str, host: str = "", low: Low = Low()) -> tuple[str, int]:
    """The main text of one page without its branches and blocks of low importance, and the number of its blocks.

    Blocks that markup names as menus, forms and the like are no candidates. In an article or main element, importance
    must be lower than elsewhere for a block to go, and the greater part of the article must stay, else all of it
    does. Where a page has such an element, other blocks stay only if they are known to be important and are
    more than what it holds (which is then but a teaser).
    """
    blocks = [b for b in parse(page)[0] if b.kind in (MAIN, OPEN)]
    names: dict[int, int] = {}

    def stays(b: Block) -> bool:
        branches, texts = (low.article_branches, low.article_blocks) if b.kind == MAIN else (low.branches, low.blocks)
        if branches and any(b.branches[i : i + 8] in branches for i in range(0, len(b.branches), 8)):
            return False
        if not texts:
            return True
        if b.node not in names:
            names[b.node] = place(host, b.node)
        return block_name(names[b.node], b.text) not in texts

    good = [stays(b) for b in blocks]
    length = lambda kind, some: sum(len(b.text) for b, x in zip(blocks, some, strict=True) if x and b.kind == kind)
    if 2 * length(MAIN, good) < length(MAIN, [True] * len(blocks)):
        good = [x or b.kind == MAIN for b, x in zip(blocks, good, strict=True)]
    if any(b.kind == MAIN for b in blocks):
        good = [x and (b.kind == MAIN or b.branches[-8:] in low.high) for b, x in zip(blocks, good, strict=True)]
        if length(OPEN, good) <= length(MAIN, good):
            good = [x and b.kind == MAIN for b, x in zip(blocks, good, strict=True)]
    kept = [b.text for b, x in zip(blocks, good, strict=True) if x]
    return "\n".join(kept), len(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, host, text, n_chars (code points), n_blocks.

    Pass one merges the pages of each host into a style tree and finds the branches and blocks of low importance; pass
    two reads every page again and removes these, and what markup names as menus, headers, footers, sidebars,
    notices, adverts, forms or comments. See ``main_text`` for what an article element changes. What is low is sent to
    the tasks by host if it is at most NAMES names in all; beyond that each page looks up its own names, so no host is gathered.

    Nulls: null html is an empty page, null urls share one nameless host. Repeated rows are extracted each; extra
    columns are ignored; an empty table gives an empty result. Very long pages are read whole.
    """
    narrow = bounded(pages).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html")).withColumn("host", host("url"))
    names = cut(style_names(narrow))
    if names.count() <= NAMES:
        rows = narrow.join(F.broadcast(low_by_host(names)), F.col("host") == F.col("tree_host"), "left").drop("tree_host")
    else:
        pages = cut(narrow.withColumn("row", F.monotonically_increasing_id()))
        low = low_by_page(pages, names).withColumnRenamed("row", "_row")
        rows = pages.join(low, F.col("row") == F.col("_row"), "left").drop("_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, Low] = {}
        for batch in slices(batches, "html"):
            hosts, got = batch.column("host").to_pylist(), []
            for i, page in enumerate(batch.column("html").to_pylist()):
                if "row" in batch.schema.names:
                    trees.clear()  # what is low is told for each page apart
                if hosts[i] not in trees:
                    if len(trees) > 1000:
                        trees.clear()
                    trees[hosts[i]] = Low(*[frozenset(batch.column(x)[i].as_py() or ()) for x in Low._fields])
                got.append(main_text(page, hosts[i], trees[hosts[i]]))
            text = pa.array([x[0] for x in got], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), batch.column("host"), text, pc.utf8_length(text).cast(pa.int64()), pa.array([x[1] for x in got], pa.int64())], ["id", "url", "host", "text", "n_chars", "n_blocks"])

    kind = narrow.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, url string, host string, text string, n_chars bigint, n_blocks bigint").withColumnRenamed("id", id_col)
