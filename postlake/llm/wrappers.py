"""Main text of web pages with wrappers inferred from pages of the same host.

A wrapper is a union-free regular expression over block tags and texts: a sequence of tags, constant texts,
text slots, repeated groups and optional parts. Pages of a host are told apart by template, a signature of the
elements and classes of their layout, and each template's wrapper is inferred from a bounded sample of its distinct
pages by alignment. Templates of fewer than LEAST distinct pages share one wrapper of their host. Neighbouring equal tag sequences of a page are first folded into repeated groups; a sequence that
repeats on one page counts as a group on all of them. Then the pages are aligned with the wrapper one after
the other: texts that differ become slots, what only one side has becomes optional.

Texts are aligned only with texts in the same containers and blocks. Every place of the expression is inside the
article or not: a vote of the sample's pages, whose evidence are the elements and names of menus, headers, footers,
sidebars, notices, adverts, forms and comments, and the article's mark or, for pages without one, the container that
holds most of the varying text, each page counting the same. A page's text is what its alignment puts into the
article's places, headings that all pages share included; a template's own constants are those outside the article.
Parts of a page that match nothing are kept on the page's own evidence; one that
has nothing in the container falls back to its own largest one.

Null and empty pages have an empty text, pages without a host share the host ''. Repeated rows each give a
row. No rows: none. Other columns are ignored.
"""

from __future__ import annotations

import difflib
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.pagetokens import AROUND_NAMES, MAIN_TAGS, Text, tokens
from postlake.session import materialize

#: Distinct pages of a template that its wrapper is inferred from at most, chosen by a hash of the page.
SAMPLE = 12
#: Distinct pages that a template needs for a wrapper of its own.
LEAST = 3
#: Nested layout elements that tell templates apart.
LAYOUT_DEPTH = 4
#: Pairs of places of a gap that is aligned by its longest common blocks, and rounds of anchors.
SMALL_GAP = 4_096
DEPTH = 12
#: Tags of a repeated group at most.
PERIOD = 24
#: Bytes of wrappers that are sent to every executor at most; more are joined in a shuffle.
BROADCAST_BYTES = 8_000_000
#: Share of the varying text that the article's container holds at least, where no page marks it.
MOST = 0.6

SLOT = "#"

# Elements that pages are laid out with.
_LAYOUT = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(/?)(div|section|article|main|table|center)\b([^>]*)>", re.I | re.S)
_CLASS = re.compile(r"""(?:^|\s)class\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z][a-z0-9]*")


def signature(source: str | None) -> str:
    """Template of a page: its outer layout elements by class, without boilerplate and what is in a marked article."""
    found: set[str] = set()
    depth = inside = 0
    for m in _LAYOUT.finditer(source or ""):
        if m[3] is None:
            continue
        if m[2]:
            depth = max(0, depth - 1)
            if depth < inside:
                inside = 0
            continue
        depth += 1
        if inside or depth > LAYOUT_DEPTH:
            continue
        tag, held = m[3].lower(), _CLASS.search(m[4])
        names = _WORD.findall(held[1].lower()) if held else []
        if (names or tag in MAIN_TAGS) and not AROUND_NAMES.intersection(names):
            found.add(".".join((tag, *names)))
        if tag in MAIN_TAGS:
            inside = depth
    return " ".join(sorted(found))


def template(html: Column) -> Column:
    def signatures(sources: pd.Series) -> pd.Series:
        return sources.map(lambda source: signature(source if isinstance(source, str) else None))

    return F.xxhash64(F.pandas_udf(signatures, "string")(html)).cast("string")


class Item:
    """Part of a stream: a symbol and the texts below it. Groups are tuples of symbols."""

    __slots__ = ("symbol", "texts")

    def __init__(self, symbol: str | tuple, texts: list[Text]):
        self.symbol, self.texts = symbol, texts


def _flat(symbol: str | tuple) -> tuple:
    return symbol if isinstance(symbol, tuple) else (symbol,)


def fold(items: list[Item], groups: frozenset[tuple] = frozenset()) -> list[Item]:
    """Neighbouring repetitions as groups, the shortest first; single occurrences of `groups` as well."""
    out: list[Item] = []
    i = 0
    symbols = [x.symbol for x in items]
    while i < len(items):
        for p in range(1, min(PERIOD, len(items) - i) + 1):
            body = tuple(symbols[i : i + p])
            end = i + p
            while tuple(symbols[end : end + p]) == body:
                end += p
            if (end > i + p or body in groups) and body[0] != SLOT and not (p == 1 and isinstance(body[0], tuple)):
                out.append(Item(body, [t for x in items[i:end] for t in x.texts]))
                i = end
                break
        else:
            out.append(items[i])
            i += 1
    return out


def stream(source: str | None) -> list[Item]:
    return [Item(SLOT, [t]) if isinstance(t, Text) else Item(t, []) for t in tokens(source)]


def folded(source: str | None, groups: frozenset[tuple]) -> list[Item]:
    items = stream(source)
    for _ in range(3):
        n = len(items)
        items = fold(items, groups)
        if len(items) == n:
            break
    return items


def _key(symbol: str | tuple) -> str:
    return symbol if isinstance(symbol, str) else json.dumps(symbol)


def _general(path: tuple[str, ...], known: frozenset[str]) -> tuple[str, ...]:
    """A path by tag alone where class and id are not of the template."""
    return tuple(s if s in known else s.partition(".")[0] for s in path)


def container(pages: list[list[Text]], known: frozenset[str]) -> tuple[str, ...]:
    """The longest path that holds MOST of the text, each page counting the same."""
    mass: Counter = Counter()
    for texts in pages:
        total = sum(len(t.text) for t in texts)
        for t in texts:
            path = _general(t.path, known)
            for depth in range(1, len(path) + 1):
                mass[path[:depth]] += len(t.text) / total
    large = [p for p, n in mass.items() if n >= MOST * len(pages) - 1e-9]
    return max(large, key=lambda p: (len(p), p)) if large else ()


def _place(t: Text, known: frozenset[str]) -> int:
    """Containers and block of a text as one number."""
    return zlib.crc32("\0".join(_general((*t.path, t.block), known)).encode())


def _aligned(items: list[Item], known: frozenset[str]) -> list[str]:
    """What items are aligned by: the symbol, and where the first text stands."""
    return [f"{_key(x.symbol)}@{_place(x.texts[0], known)}" if x.texts else _key(x.symbol) for x in items]


def evidence(texts: list[Text], own: list[bool], known: frozenset[str], main: tuple[str, ...]) -> list[bool]:
    """Which texts of a page are its article by elements and names, or by the container.

    Constants (`own`) find no container, but what stands in it is of the article, constant or not.
    """
    if any(t.in_main and not t.around for t in texts):
        return [t.in_main and not t.around for t in texts]
    inside = [not t.around and bool(main) and _general(t.path, known)[: len(main)] == main for t in texts]
    varying = [t for t, o in zip(texts, own, strict=True) if not t.around and not o]
    if any(inside) or not varying:
        return inside
    widest = container([varying], frozenset(x for t in varying for x in t.path))
    return [not t.around and t.path[: len(widest)] == widest for t in texts]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, ascending in the first place, that ascends in the second one too."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        before.append(ends[k - 1] if k else -1)
        tails[k : k + 1] = [j]
        ends[k : k + 1] = [n]
    out = []
    n = ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (i, j) with a[i] = b[j], ascending in both.

    Common ends are matched first, then symbols that stand once on either side, in order, and the gaps between them
    likewise. Small gaps are matched by their longest common blocks; in a large gap without such symbols, or after DEPTH
    rounds, the n-th occurrence of a symbol is matched with the n-th one. Every round looks at each place once.
    """
    found: list[tuple[int, int]] = []
    open_gaps = [(0, len(a), 0, len(b), 0)]
    while open_gaps:
        i, ia, j, jb, depth = open_gaps.pop()
        while i < ia and j < jb and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < ia and j < jb and a[ia - 1] == b[jb - 1]:
            ia, jb = ia - 1, jb - 1
            found.append((ia, jb))
        if i == ia or j == jb:
            continue
        if (ia - i) * (jb - j) <= SMALL_GAP:
            match = difflib.SequenceMatcher(None, a[i:ia], b[j:jb], autojunk=False)
            found += [(i + x + k, j + y + k) for x, y, n in match.get_matching_blocks() for k in range(n)]
            continue
        often_a, often_b = Counter(a[i:ia]), Counter(b[j:jb])
        place = {b[y]: y for y in range(j, jb) if often_b[b[y]] == 1}
        anchors = _increasing([(x, place[a[x]]) for x in range(i, ia) if often_a[a[x]] == 1 and a[x] in place])
        if not anchors or depth == DEPTH:
            numbers: Counter = Counter()
            places: dict[tuple[str, int], int] = {}
            for y in range(j, jb):
                places[b[y], numbers[b[y]]] = y
                numbers[b[y]] += 1
            numbers.clear()
            pairs = []
            for x in range(i, ia):
                y = places.get((a[x], numbers[a[x]]))
                numbers[a[x]] += 1
                if y is not None:
                    pairs.append((x, y))
            found += _increasing(pairs)
            continue
        found += anchors
        for (x, y), (xb, yb) in zip([(i - 1, j - 1), *anchors], [*anchors, (ia, jb)], strict=True):
            open_gaps.append((x + 1, xb, y + 1, yb, depth + 1))
    return sorted(found)


def infer(pages: list[str | None]) -> dict:
    """Wrapper of some pages: the expression, its groups, the constant texts and the article's container.

    A part of the expression is its symbol, whether it is optional, its constant text, what it is aligned by,
    and for each place of its texts whether it is inside the article.
    """
    pages = list(dict.fromkeys(pages))
    groups: set[tuple] = set()
    for page in pages:
        items = stream(page)
        for _ in range(3):
            n = len(items)
            items = fold(items)
            groups.update(x.symbol for x in items if isinstance(x.symbol, tuple))
            if len(items) == n:
                break
    held = frozenset(groups)
    read = [folded(page, held) for page in pages]
    said = [[t for x in items for t in x.texts] for items in read]
    common = Counter(x for texts in said for x in {x for t in texts for x in (*t.path, t.block)})
    known = frozenset(x for x, n in common.items() if n >= min(2, len(pages)))
    wrapper: list[list] = []  # symbol, optional, constant text or None, what it is aligned by, texts by page
    for number, items in enumerate(read):
        if not items:
            continue
        parts = [
            [_key(x.symbol), number > 0, x.texts[0].text if x.symbol == SLOT else None, by, [(number, t) for t in x.texts]]
            for x, by in zip(items, _aligned(items, known), strict=True)
        ]
        if not wrapper:
            wrapper = [[w[0], number > 0, *w[2:]] for w in parts]
            continue
        merged: list[list] = []
        a = c = 0
        for b, d in [*align([w[3] for w in wrapper], [w[3] for w in parts]), (len(wrapper), len(parts))]:
            merged += [[w[0], True, *w[2:]] for w in wrapper[a:b]]
            merged += parts[c:d]
            if b < len(wrapper):
                w, x = wrapper[b], parts[d]
                merged.append([w[0], w[1], w[2] if w[2] == x[2] else None, w[3], w[4] + x[4]])
            a, c = b + 1, d + 1
        wrapper = merged
    constants = {w[2] for w in wrapper if w[2] is not None and not w[1]} if len(pages) > 2 else set()
    unmarked = [[t for t in texts if not t.around and t.text not in constants] for texts in said if not any(t.in_main and not t.around for t in texts)]
    main = container([texts for texts in unmarked if texts], known)
    inside: set[int] = set()
    for texts in said:
        kept = evidence(texts, [t.text in constants for t in texts], known, main)
        inside.update(id(t) for t, yes in zip(texts, kept, strict=True) if yes)
    expression = []
    for symbol, optional, text, by, texts in wrapper:
        votes: dict[int, list[bool]] = {}
        for _, t in texts:
            votes.setdefault(_place(t, known), []).append(id(t) in inside)
        places = [[p, 2 * sum(v) >= len(v)] for p, v in sorted(votes.items())]
        expression.append([symbol, optional, text if text in constants else None, by, places])
    return {
        "expression": expression,
        "groups": sorted(_key(g) for g in held),
        "constants": sorted({x[2] for x in expression if x[2] is not None}),
        "known": sorted(known),
        "main": list(main),
    }


def _symbol(x: object) -> str | tuple:
    return tuple(_symbol(y) for y in x) if isinstance(x, list) else x


class Wrapper:
    """A host's wrapper, ready to be applied."""

    def __init__(self, held: dict):
        self.by = [w[3] for w in held["expression"]]
        self.fixed = [w[2] for w in held["expression"]]
        self.places = [dict(w[4]) for w in held["expression"]]
        self.groups = frozenset(_symbol(json.loads(g)) for g in held["groups"])
        self.known = frozenset(held["known"])
        self.main = tuple(held["main"])

    def texts(self, source: str | None) -> list[str]:
        """Texts of the article's blocks, in page order."""
        items = folded(source, self.groups)
        if not items:
            return []
        part = {c: a for a, c in align(self.by, _aligned(items, self.known))}
        found = [(part.get(k), t) for k, x in enumerate(items) for t in x.texts]
        own = [a is not None and self.fixed[a] == t.text for a, t in found]
        shown = evidence([t for _, t in found], own, self.known, self.main)
        out = []
        for (a, t), yes in zip(found, shown, strict=True):
            if a is not None:
                yes = self.places[a].get(_place(t, self.known), yes)
            if yes:
                out.append(t.text)
        return out


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def wrappers(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(host, template, wrapper): one row per template, and one with template '' for a host's rare templates.

    Samples are drawn among hashes of all distinct pages; only pages that were drawn are shuffled.
    """
    rows = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).filter("html <> ''")
    rows = rows.withColumn("copy", F.xxhash64("html"))
    kind = Window.partitionBy("host", "template")
    drawn = rows.select("host", "copy", template(F.col("html")).alias("template")).distinct()
    drawn = drawn.withColumn("n", F.row_number().over(kind.orderBy("copy"))).filter(F.col("n") <= sample)
    drawn = drawn.withColumn("size", F.count(F.lit(1)).over(kind))
    drawn = drawn.withColumn("template", F.when(F.col("size") >= min(LEAST, sample), F.col("template")).otherwise("")).drop("n", "size")
    drawn = drawn.withColumn("n", F.row_number().over(kind.orderBy("copy"))).filter(F.col("n") <= sample)
    held = rows.join(materialize(drawn, "drawn"), ["host", "copy"])
    once = Window.partitionBy("host", "template", "copy").orderBy("n")
    held = held.withColumn("_once", F.row_number().over(once)).filter("_once = 1")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("n")
        found = json.dumps(infer(rows["html"].tolist()))
        return pd.DataFrame({"host": [rows["host"].iat[0]], "template": [rows["template"].iat[0]], "wrapper": [found]})

    return held.groupBy("host", "template").applyInPandas(run, "host string, template string, wrapper string")


def extracted(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page, with the wrapper of its template from `found`."""
    keys = found.filter("template <> ''").select("host", "template", F.col("template").alias("own"))
    size, slim = found.agg(
        F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.sum(F.octet_length("host") + F.octet_length("template"))
    ).first()
    if (size or 0) <= BROADCAST_BYTES:
        found = F.broadcast(found)
    if (slim or 0) <= BROADCAST_BYTES:
        keys = F.broadcast(keys)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    rows = rows.withColumn("template", template(F.col("html"))).join(keys, ["host", "template"], "left")
    rows = rows.withColumn("template", F.coalesce("own", F.lit("")))
    joined = rows.join(found, ["host", "template"], "left").select("page_id", "url", "html", "wrapper")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str | None, Wrapper] = {}
        for whole in batches:
            for b in range(0, whole.num_rows, 200):
                batch = whole.slice(b, 200)
                out = []
                for source, held in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                    if held not in ready:
                        if len(ready) >= 1_000:
                            ready.clear()
                        ready[held] = Wrapper(json.loads(held) if held else infer([]))
                    out.append("\n\n".join(ready[held].texts(source)))
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string")


def digest(texts: DataFrame) -> DataFrame:
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
