"""Main text of web pages by wrapper induction over the pages of a host.

A page becomes a tree of its block elements in which equal neighbours are one
repeated node. Per host the commonest tree is the wrapper; every other tree is
aligned to it by simple tree matching, so that each text of a page stands at a
node of the wrapper. A node whose texts come back on pages of different content
is constant: it is template and goes, whatever it is called (menus, headers,
footers, rotating notices). A node whose texts vary with the content is a slot,
and slots are content. What a page itself declares to be no part of an article
(adverts, comments, forms and so on) goes as well, as it may vary from page to
page like an article.

Only distinct trees are aligned, and the counts behind the template run over
all pages as pre-aggregated rows.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import written

#: A node is template where at least this share of the contents that fill it have texts there that come back,
#: which means on so many different contents.
SHARE, TIMES = 0.5, 3
BROADCAST_ROWS = 100_000
#: Cells of a table of matches, and weights of pairs, that are held at once; beyond that they are found again.
CELLS = 1 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|select|title)\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<(/?)([a-z][a-z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)/?>|<[!?/a-z][^>]*+>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_BLOCKS = frozenset("html head body main article section div nav header footer aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary dialog center menu".split())
_BOILER = frozenset("head nav footer aside form fieldset dialog menu button".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Names (class or id) of what a reader or an advertiser has added.
_ADDED = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored comment comments commentlist disqus".split())
#: Names of what is no part of an article on any page, and names that an article can have as well.
_SURE = _ADDED | frozenset("sidebar nav navbar navigation breadcrumb breadcrumbs cookie cookies newsletter related recommended".split())
_DOUBTFUL = frozenset("menu header footer notice notices consent popup modal promo share sharing replies".split())
#: Parts beside a name that leave its meaning ("site-sidebar", "user-comments-list").
_FRAME = frozenset("site page main global user reader readers top bottom left right inner outer primary secondary area block box container wrapper wrap slot unit list links section bar banner widget panel".split())
_ARTICLE = frozenset(["article", "main"])
#: How a block is declared: not at all, by a name that an article can have too, surely.
FREE, DOUBTFUL, SURE = 0, 1, 2


def _attributes(marks: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(marks)}


def _named(name: str, inside: bool, have: dict[str, str]) -> int:
    """What the class and id of an element say: a name has to be whole, but for
    parts that leave its meaning, so "has-sidebar" or "share-price" say nothing."""
    found = FREE
    for whole in f"{have.get('class', '')} {have.get('id', '')}".lower().split():
        parts = set(re.split("[-_]+", whole.strip("-_")))
        if parts <= _FRAME:
            continue
        if name == "article":  # one that is none has the name alone
            found = max(found, SURE if whole in _ADDED else FREE)
        elif parts <= _SURE | _FRAME:
            return SURE
        elif parts <= _SURE | _DOUBTFUL | _FRAME and not (inside and "header" in parts):
            found = DOUBTFUL
    return found


def _declared(name: str, inside: bool, have: dict[str, str]) -> int:
    """Whether an element says that it is no part of an article."""
    if name in _BOILER or name == "header" and not inside:
        return SURE
    if "hidden" in have or have.get("aria-hidden", "").lower() == "true" or _NO_DISPLAY.search(have.get("style", "")):
        return SURE
    if name in ("html", "body"):
        return FREE
    if name not in _ARTICLE and not _ROLES.isdisjoint(have.get("role", "").lower().split()):
        return SURE
    return FREE if name == "main" or not have else _named(name, inside, have)


def parse(page: str) -> tuple[str, list[tuple[int, int, bool, str]]]:
    """The signature of a page's tree and all its blocks (node, how far it is
    declared to be no part of the article, inside an article or main element,
    text). A doubtful name doesn't reach into an article or main element."""
    labels, parents, lasts = ["#"], [0], [{}]
    stack = [("#", 0, FREE, False)]  # tag, node, declared, inside an article
    blocks: list[tuple[int, int, bool, str]] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            _, node, boiler, inside = stack[-1]
            blocks.append((node, boiler, inside, text))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            held.append(html.unescape(text) if "&" in text else text)
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            held.append(" ")
        if name not in _BLOCKS and name != "button":
            if name == "hr":
                flush()
            continue
        if m[2]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if depth:
                flush()
                del stack[depth:]
            elif name == "p":
                flush()
            continue
        flush()
        if stack[-1][0] == "p" or name in ("li", "tr", "td", "th", "dt", "dd") and stack[-1][0] == name:
            stack.pop()
        _, parent, boiler, inside = stack[-1]
        have = _attributes(m[4]) if m[4] and not m[4].isspace() else {}
        marks = sorted({w for w in re.split(r"[^a-z0-9]+", " ".join(have.get(x, "") for x in ("class", "id", "role")).lower()) if w and not w.isdigit()})
        label = f"{name}.{xxhash.xxh64_hexdigest(' '.join(marks).encode())}" if marks else name
        if boiler == DOUBTFUL and name in _ARTICLE:
            boiler = FREE
        boiler = max(boiler, _declared(name, inside, have))
        node = lasts[parent].get(label)
        if node is None:
            node = len(labels)
            labels.append(label)
            parents.append(parent)
            lasts.append({})
            lasts[parent].clear()
            lasts[parent][label] = node
        stack.append((name, node, boiler, inside or name in _ARTICLE))
    if at < len(page):
        held.append(html.unescape(page[at:]))
    flush()
    return " ".join(f"{p}:{x}" for p, x in zip(parents[1:], labels[1:], strict=True)), blocks


def _tree(signature: str) -> tuple[list[str], list[list[int]]]:
    labels, children = ["#"], [[]]
    for part in signature.split(" ") if signature else []:
        parent, _, label = part.partition(":")
        children[int(parent)].append(len(labels))
        labels.append(label)
        children.append([])
    return labels, children


def _classes(trees: list[tuple[list[str], list[list[int]]]]) -> tuple[list[str], list[list[int]], list[list[int]]]:
    """Equal subtrees as one class: the label and the children's classes of each
    class, and for each tree the class of each node. Children have higher numbers
    than their parents, and lower classes."""
    known: dict[tuple, int] = {}
    labels, inner, out = [], [], []
    for names, children in trees:
        own = [0] * len(names)
        for n in range(len(names) - 1, -1, -1):
            key = (names[n], tuple(own[c] for c in children[n]))
            if key not in known:
                known[key] = len(labels)
                labels.append(key[0])
                inner.append(list(key[1]))
            own[n] = known[key]
        out.append(own)
    return labels, inner, out


class _Matching:
    """The heaviest order-preserving match of any two classes of subtrees.

    Exact for lists of any length: a table of matches is kept row by row, and
    where it is to be read back, in as many rows as need be between kept ones.
    Weights of pairs are remembered up to ``CELLS`` of them and found again
    beyond that, so long lists cost time, not memory."""

    def __init__(self, labels: list[str], inner: list[list[int]], cells: int = 0) -> None:
        self.labels, self.inner, self.cells = labels, inner, cells or CELLS
        self.known: dict[tuple[int, int], int] = {}

    def weight(self, a: int, b: int) -> int:
        """The size of the match of two classes of one label. Pairs that wait
        for those below them are a stack, so deep trees need no recursion."""
        waiting, value = [self._weigh(a, b)], None
        while waiting:
            try:
                pair = waiting[-1].send(value)
            except StopIteration as done:
                waiting.pop()
                value = done.value
            else:
                waiting.append(self._weigh(*pair))
                value = None
        return value

    def _weigh(self, a: int, b: int):
        if not self.inner[a] or not self.inner[b]:
            return 1
        if (a, b) not in self.known:
            last = None
            rows = self._rows(a, b, None, 0, len(self.inner[a]))
            value = None
            while True:
                try:
                    got = rows.send(value)
                except StopIteration:
                    break
                value = None
                if isinstance(got, tuple):
                    value = yield got
                else:
                    last = got
            if len(self.known) >= self.cells:
                self.known.clear()
            self.known[a, b] = int(last[-1]) + 1
            return int(last[-1]) + 1
        return self.known[a, b]

    def _rows(self, a: int, b: int, row: np.ndarray | None, start: int, end: int):
        """The rows of the table after each of the children ``start`` to ``end``
        of ``a``; pairs whose weight it needs come as tuples."""
        y, column = np.unique(np.array(self.inner[b]), return_inverse=True)
        y, by_class = y.tolist(), {}
        row = np.zeros(len(column) + 1, np.int32) if row is None else row
        for u in self.inner[a][start:end]:
            if u not in by_class:
                if len(by_class) * len(y) >= self.cells:
                    by_class.clear()
                found = np.zeros(len(y), np.int32)
                for n, v in enumerate(y):
                    if self.labels[u] == self.labels[v]:
                        found[n] = yield (u, v)
                by_class[u] = found
            new = np.zeros_like(row)
            np.maximum.accumulate(np.maximum(row[1:], row[:-1] + by_class[u][column]), out=new[1:])
            row = new
            yield row

    def _table(self, a: int, b: int, row: np.ndarray, start: int, end: int) -> Iterator[np.ndarray]:
        rows, value = self._rows(a, b, row, start, end), None
        while True:
            try:
                got = rows.send(value)
            except StopIteration:
                return
            value = self.weight(*got) if isinstance(got, tuple) else None
            if value is None:
                yield got

    def pairs(self, a: int, b: int) -> list[tuple[int, int]]:
        """The places of the matched children of two classes, last ones first."""
        n, m = len(self.inner[a]), len(self.inner[b])
        if not n or not m:
            return []
        step = max(self.cells // (m + 1), math.isqrt(n) + 1)
        kept = [np.zeros(m + 1, np.int32)]
        for i, row in enumerate(self._table(a, b, kept[0], 0, (n - 1) // step * step), 1):
            if i % step == 0:
                kept.append(row)
        out, i, j = [], n, m
        for start in range((n - 1) // step * step, -1, -step):
            best = [kept[start // step], *self._table(a, b, kept[start // step], start, i)]
            while i > start and j:
                if best[i - start][j] == best[i - start - 1][j]:
                    i -= 1
                elif best[i - start][j] == best[i - start][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((i, j))
            i = start
        return out


def align(page: str, wrapper: str) -> list[int]:
    """Simple tree matching: for each node of ``page`` its partner in
    ``wrapper`` (-1: none) in a largest order-preserving match of both trees,
    whatever their size."""
    trees = [_tree(page), _tree(wrapper)]
    (la, ca), (_, cb) = trees
    if page == wrapper:
        return list(range(len(la)))
    labels, inner, (a_class, b_class) = _classes(trees)
    matching = _Matching(labels, inner)
    out, todo = [-1] * len(la), [(0, 0)]
    while todo:
        a, b = todo.pop()
        out[a] = b
        todo += [(ca[a][i], cb[b][j]) for i, j in matching.pairs(a_class[a], b_class[b])]
    return out


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


#: Kinds of slots of a node: all its texts, the first of several, the last of several.
WHOLE, FIRST, LAST = 0, 1, 2


def slots(blocks: list[tuple[int, int, bool, str]]) -> tuple[list[int], list[int], list[int]]:
    """(node * 4 + kind, digest) of the texts that stand at each node, and for
    each block the kind that it is (3: one in the middle)."""
    texts: dict[int, list[int]] = {}
    for n, (node, *_) in enumerate(blocks):
        texts.setdefault(node, []).append(n)
    keys, digests, kinds = [], [], [3] * len(blocks)
    for node, at in texts.items():
        keys.append(node * 4 + WHOLE)
        digests.append(_digest("\n".join(blocks[n][3] for n in at)))
        kinds[at[0]] = WHOLE
        if len(at) > 1:
            for n, kind in ((at[0], FIRST), (at[-1], LAST)):
                keys.append(node * 4 + kind)
                digests.append(_digest(blocks[n][3]))
                kinds[n] = kind
    return keys, digests, kinds


def _voices(texts: list[str]) -> np.ndarray:
    """The least hash of the three-word shingles of each text, so that copies
    and near copies of one content mostly have one voice."""
    words = W.split_words(pa.array(texts, pa.large_string()))
    h, ptr = W.shingles(words.hashes(), words.ptr, 3)
    out, has = np.zeros(len(texts), np.uint64), np.flatnonzero(np.diff(ptr))
    if len(has):
        out[has] = np.minimum.reduceat(h, ptr[:-1][has])
    return out.view(np.int64)


def _parsed(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "html"):
            signatures, found, own, voices = [], [], [], []
            for page in b.column("html").to_pylist():
                signature, blocks = parse(page or "")
                signatures.append(signature)
                found.append(blocks)
                own.append(slots(blocks))
                most = FREE if any(d == FREE for _, d, _, _ in blocks) else DOUBTFUL
                only = any(i and d <= most for _, d, i, _ in blocks)
                voices.append("\n".join(t for _, d, i, t in blocks if d <= most and (i or not only)))
            whole, small = pa.list_(pa.int64()), pa.list_(pa.int32())
            flags = [[kind | d << 2 | i << 4 for kind, (_, d, i, _) in zip(kinds, blocks, strict=True)] for blocks, (*_, kinds) in zip(found, own, strict=True)]
            yield pa.record_batch(
                [
                    *b.columns[:-1],
                    pa.array(signatures),
                    pa.array(_voices(voices)),
                    pa.array([k for k, *_ in own], small),
                    pa.array([d for _, d, _ in own], whole),
                    pa.array([[n for n, *_ in x] for x in found], small),
                    pa.array(flags, small),
                    pa.array([[t for *_, t in x] for x in found], pa.list_(pa.string())),
                ],
                [*b.schema.names[:-1], "tree", "content", "slots", "digests", "nodes", "flags", "texts"],
            )

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    frame = pages.select(F.col("page_id"), F.col("url"), host.alias("host"), F.col("html"))
    kind = frame.schema["page_id"].dataType.simpleString()
    return frame.mapInArrow(run, f"page_id {kind}, url string, host string, tree string, content long, slots array<int>, digests array<long>, nodes array<int>, flags array<int>, texts array<string>")


def _alignments(trees: DataFrame) -> DataFrame:
    """(host, tree, wrapper) to (host, tree, partners)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            partners = [align(x, y) for x, y in zip(b.column("tree").to_pylist(), b.column("wrapper").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("host"), b.column("tree"), pa.array(partners, pa.list_(pa.int32()))], ["host", "tree", "partners"])

    return trees.select("host", "tree", "wrapper").mapInArrow(run, "host string, tree string, partners array<int>")


def _beside(big: DataFrame, small: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join that broadcasts ``small`` only where its checked size is low."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, keys, how)


def extract(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """``(page_id, url, text, n_chars, n_template, n_declared)`` of every row of
    ``pages`` (page_id, url, html): the article's blocks joined by a line feed,
    and how many blocks went as template and, of the others, by what the page
    declares (where it has an article or main element: all outside those).

    A wrapper node, or the first or last text of several at one, is template if
    on ``share`` or more of the contents that fill it the text is one that comes
    back: three or more contents of the host have it there, none of them on over
    half of its pages. A block goes if its element or one around it is declared
    to be no part of an article: by its tag, its role, by being hidden or by a
    whole name for it. Names that an article can have too (``_DOUBTFUL``) count
    only where no other pages judge: a block under one stays in an article or
    main element below it, where three contents or more fill its wrapper node
    and that is no template, or where else nothing of its page would be left. If
    a page has an article or main element with such text, all outside goes.
    Lists of children of any length are matched exactly. Copies of a page are
    one content, so a host of one page, or of copies only, has no template, and
    so has the empty host of pages without one. Of equally common trees the
    greatest string is the wrapper. Null html is empty; repeated rows stay; an
    empty table gives an empty result; extra columns are ignored."""
    parsed = written(_parsed(pages), "pages")
    trees = parsed.where("host <> ''").groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n"))
    wrappers = trees.groupBy("host").agg(F.max(F.struct("n", "tree"))["tree"].alias("wrapper"))
    partners = written(_alignments(trees.join(wrappers, "host")), "trees")

    # (host, slot of the wrapper, digest) with the number of contents that have it, then slots by the share that comes back
    rows = _beside(parsed.where("host <> ''").select("host", "tree", "content", "slots", "digests"), partners, ["host", "tree"], "inner")
    placed = rows.select("host", "content", "partners", F.explode(F.arrays_zip("slots", "digests")).alias("b"))
    node = F.element_at("partners", F.shiftright("b.slots", 2) + 1)
    placed = placed.select("host", "content", (node * 4 + F.col("b.slots").bitwiseAND(3)).alias("slot"), F.col("b.digests").alias("digest")).where("slot >= 0")
    pages_of = placed.groupBy("host", "slot", "digest", "content").agg(F.count(F.lit(1)).alias("p"))
    texts = pages_of.groupBy("host", "slot", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("most"), F.sum("p").alias("p"))
    again = F.when((F.col("n") >= TIMES) & (2 * F.col("most") <= F.col("p")), F.col("n")).otherwise(0)
    back = texts.groupBy("host", "slot").agg(F.sum("n").alias("all"), F.sum(again).alias("again"))
    is_template = F.col("again") >= F.greatest(F.lit(share) * F.col("all"), F.lit(1))
    judged = back.select("host", "slot", is_template.alias("t"), (~is_template & (F.col("all") >= TIMES) & (F.col("slot").bitwiseAND(3) == WHOLE)).alias("v")).where("t or v")
    judged = written(judged.groupBy("host").agg(F.collect_list(F.when(F.col("t"), F.col("slot"))).alias("template"), F.collect_list(F.when(F.col("v"), F.col("slot"))).alias("content_at")), "template")  # at most three slots a wrapper node

    kept = _beside(_beside(parsed.select("page_id", "url", "host", "tree", "nodes", "flags", "texts"), judged, ["host"], "left"), partners, ["host", "tree"], "left")
    template, content_at = (F.coalesce(x, F.expr("cast(array() as array<int>)")) for x in ("template", "content_at"))
    blocks = F.transform(F.arrays_zip("nodes", "flags", "texts"), lambda b: F.struct(
        b["texts"].alias("text"),
        (F.coalesce(F.element_at("partners", b["nodes"] + 1), F.lit(-1)) * 4).alias("slot"),
        b["flags"].bitwiseAND(3).alias("kind"),
        F.shiftright(b["flags"], 2).bitwiseAND(3).alias("declared"),
        (b["flags"].bitwiseAND(16) > 0).alias("inside"),
    ))
    kept = kept.select("page_id", "url", template.alias("template"), content_at.alias("content_at"), blocks.alias("blocks"))
    varying = F.filter("blocks", lambda b: ~(F.array_contains("template", b["slot"]) | (b["kind"].isin(FIRST, LAST) & F.array_contains("template", b["slot"] + b["kind"]))))
    varying = F.transform(varying, lambda b: F.struct(b["text"].alias("text"), b["inside"].alias("inside"), F.when((b["declared"] == DOUBTFUL) & F.array_contains("content_at", b["slot"]), FREE).otherwise(b["declared"]).alias("declared")))
    kept = kept.select("page_id", "url", F.size("blocks").alias("n"), varying.alias("varying"))
    kept = kept.withColumn("most", F.when(F.exists("varying", lambda b: b["declared"] == FREE), FREE).otherwise(DOUBTFUL))
    kept = kept.withColumn("only", F.exists("varying", lambda b: b["inside"] & (b["declared"] <= F.col("most"))))
    kept = kept.withColumn("article", F.filter("varying", lambda b: (b["declared"] <= F.col("most")) & (b["inside"] | ~F.col("only"))))
    return kept.select("page_id", "url", F.array_join(F.transform("article", lambda b: b["text"]), "\n").alias("text"), (F.col("n") - F.size("varying")).cast("long").alias("n_template"), (F.size("varying") - F.size("article")).cast("long").alias("n_declared")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_template", "n_declared"
    )
