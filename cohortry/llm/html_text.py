"""HTML extraction by nearest-URL page differencing.

Pages are sorted by host and URL path over the whole cluster, and each page is paired with the nearest pages before and
after it on its host whose lines differ from its own; the one whose path begins most like its own comes first. The text
lines (blocks) of both are aligned by a longest common subsequence, and lines that they share are deleted as template
text: menus, notices and footers repeat from page to page, articles don't. If nothing is left, or only lines without a
letter, the page and its neighbour hold the same article, and the other neighbour is taken; if that leaves nothing
either, nothing is deleted. Elements that are template by name or class (navigation, header, footer, aside, form, adverts,
notices, comments, scripts, styles) never give text.

Marks of an article (``article``, ``main``) check what differencing left. Differencing says which marked elements hold the
article: those with a line that is left. Their shared lines are restored, as two articles may quote the same line, and what
is left outside them is deleted. Marked elements of which nothing is left (teasers, cards and boxes that the neighbour has
too) are deleted as template text. An ``article`` inside a ``main`` is an element of its own. On a page with marks a neighbour
counts as one with another article only if at least half of the marked lines, without the wholly shared elements, are the
page's own: a near copy tells nothing about what is template.

Line hashes are moved, and of the lines only those that can be text, compressed. Sorting is by range over (host, path,
url, page_id), so a host with a third of all pages spreads over many tasks; rows are paired while a task streams through
its range, and only the first and the last run of equal pages of each range are paired afterwards, by one row a range
that tells its ends.

Defined results: NULL or empty html gives an empty text. Pages without a URL or host have no neighbour. Character
references are decoded, white space inside a block becomes one space, blocks without text are left out, ``br`` is white
space. Repeated pages each get their row.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import stored, work_folder

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "title", "select", "object"}
_TEMPLATE = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
_TEMPLATE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent",
    "notice", "notices", "alert", "popup", "modal", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "aside",
    "footer", "masthead", "comment", "comments", "reply", "replies", "share", "sharing", "social", "related", "newsletter",
    "subscribe", "pagination", "contentinfo", "complementary", "search",
}
#: Words that beside those above name a part of the template: its place, or the box that holds it.
_TEMPLATE_PARTS = {
    "site", "page", "main", "top", "bottom", "left", "right", "global", "primary", "secondary", "sticky", "fixed", "mobile", "desktop",
    "slot", "box", "bar", "list", "widget", "wrapper", "wrap", "container", "button", "buttons", "block", "unit", "section", "area",
    "panel", "links", "posts", "form", "inner", "outer", "header", "body", "title", "item", "items",
}
_TEMPLATE_NAMES = _TEMPLATE_WORDS | _TEMPLATE_PARTS
_BLOCKS = {
    "address", "article", "blockquote", "body", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table",
    "tbody", "thead", "tr", "ul", "aside", "caption", "head", "menu", "fieldset",
}

#: Kinds of lines. ``MAIN`` is the first element that marks an article; further ones of the page are 3, 4 and so on.
BODY, MAIN, TEMPLATE = 0, 1, 2


def _names_template(name: str) -> bool:
    """Whether one class or id names template text: by its last word, or by nothing but such words and their parts.

    So ``cookie-notice`` and ``ad-slot`` do, ``share-price`` and ``search-results`` don't.
    """
    words = [w for w in _WORDS.findall(name) if len(w) > 1]
    return bool(words) and (words[-1] in _TEMPLATE_WORDS or not _TEMPLATE_WORDS.isdisjoint(words) and _TEMPLATE_NAMES.issuperset(words))


def _kind_of(name: str, attributes: str, parent: int, in_main: bool) -> int:
    """Whether an element is template text, marks the main text, or is of its parent's kind."""
    if parent == TEMPLATE or name in _TEMPLATE or name == "header" and not in_main:
        return TEMPLATE
    words: set[str] = set()
    if "=" in attributes:
        names = " ".join(m[1] or m[2] or m[3] or "" for m in _NAMES.finditer(attributes)).lower().split()
        words.update(*map(_WORDS.findall, names))
        if any(map(_names_template, names)) and name not in ("html", "body", "article", "main") or {"comment", "comments", "reply"} & words:
            return TEMPLATE
    return MAIN if in_main or name in ("article", "main") or name != "body" and "main" in words and "role" in attributes else BODY


def _is_mark(kind: int) -> bool:
    return kind not in (BODY, TEMPLATE)


def text_lines(page: str) -> list[tuple[str, int]]:
    """The text blocks of a page in order, each with its kind."""
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = [("", BODY)]
    marks: list[str] = []  # the element names of MAIN, 3, 4, ...
    at = 0

    def close() -> None:
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                lines.append((text, stack[-1][1]))
            parts.clear()

    while True:
        m = _TAG.search(page, at)
        piece = page[at:m.start()] if m else page[at:]
        if piece:
            parts.append(html.unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in _BLOCKS:
                close()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close() if stack[k][1] != stack[k - 1][1] else None
                    del stack[k:]
                    break
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in ("td", "th"):
            parts.append(" ")
        if name in _BLOCKS:
            close()
            if name == "p" or name in ("li", "dt", "dd", "tr"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] in _BLOCKS:
                        break
        if name not in _VOID and not (m[3] or m[6] or "").endswith("/"):
            parent = stack[-1][1]
            kind = _kind_of(name, m[3] or m[6] or "", parent, _is_mark(parent))
            if kind == MAIN and _is_mark(parent) and (name != "article" or marks[max(parent - 2, 0)] == "article"):
                kind = parent
            elif kind == MAIN:
                marks.append(name)
                kind = MAIN if len(marks) == 1 else TEMPLATE + len(marks) - 1
            if kind != parent:
                close()
            stack.append((name, kind))
    close()
    return lines


def aligned(a: list, b: list) -> set[int]:
    """The positions of ``a`` in a longest common subsequence with ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = {*range(head), *range(len(a) - tail, len(a))}
    both = set(a[head:len(a) - tail]) & set(b[head:len(b) - tail])
    x = [i for i in range(head, len(a) - tail) if a[i] in both]
    y = [s for s in b[head:len(b) - tail] if s in both]
    places: dict = {}
    for j, s in enumerate(y):
        places[s] = places.get(s, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows = [full]  # a zero bit at j: one line more in common with y[:j + 1] than with y[:j]
    for i in x:
        v = rows[-1]
        hit = v & places[a[i]]
        rows.append(((v + hit) | (v - hit)) & full)

    def common(i: int, j: int) -> int:
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    i, j = len(x), len(y)
    while i and j:
        if a[x[i - 1]] == y[j - 1]:
            out.add(x[i - 1])
            i, j = i - 1, j - 1
        elif common(i - 1, j) >= common(i, j - 1):
            i -= 1
        else:
            j -= 1
    return out


def _other_article(kinds: list[int], left: list[int], wanted: set[int]) -> bool:
    """Whether the lines left beside a neighbour tell that it holds another article.

    ``wanted`` are the lines that can be text and have a letter. Some must be left; where elements are marked, half of the
    lines of those that are not wholly shared.
    """
    own = Counter(kinds[i] for i in left if i in wanted)
    return bool(own) and (BODY in own or 2 * own.total() >= sum(kinds[i] in own for i in wanted))


def own_lines(kinds: list[int], lines: list, neighbours: list[list], trivial: set[int]) -> list[int]:
    """Differencing: the positions of the body and article lines that the first neighbour with another article doesn't share.

    ``trivial`` lines don't count as left. Without such a neighbour all lines are left.
    """
    text = [i for i, kind in enumerate(kinds) if kind != TEMPLATE]
    wanted = {i for i in _possible(kinds) if i not in trivial}
    for neighbour in neighbours:
        gone = aligned(lines, neighbour)
        left = [i for i in text if i not in gone]
        if _other_article(kinds, left, wanted):
            return left
    return text


def kept_lines(kinds: list[int], lines: list, neighbours: list[list], trivial: set[int]) -> list[int]:
    """The positions of the lines (texts or their hashes) that are left of a page beside its neighbours' lines.

    The marked elements in which differencing left a line are the article: their shared lines are restored, and all else
    is deleted, other marked elements too.
    """
    left = own_lines(kinds, lines, neighbours, trivial)
    articles = {kinds[i] for i in left if _is_mark(kinds[i])}
    return [i for i, kind in enumerate(kinds) if kind in articles] if articles else left


def _trivial(text: str) -> bool:
    return not any(c.isalpha() for c in text)


def main_text(lines: list[tuple[str, int]], *neighbours: list[str] | None) -> str:
    """The text that is left of a page beside its neighbours' lines, the nearest first."""
    texts = [s for s, _ in lines]
    trivial = {i for i, s in enumerate(texts) if _trivial(s)}
    return "\n".join(texts[i] for i in kept_lines([kind for _, kind in lines], texts, [n for n in neighbours if n], trivial))


def _nearest(path: str, before: dict | None, after: dict | None) -> list[list[int]]:
    """The lines of the neighbours, those of the one whose path begins most like this one first; the one before on ties."""
    def alike(other: dict) -> int:
        return next((i for i, (x, y) in enumerate(zip(path, other["path"])) if x != y), min(len(path), len(other["path"])))

    return [x["hashes"] for x in sorted((x for x in (before, after) if x is not None), key=alike, reverse=True)]


def _line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_ROW = "page_id long, url string, host string, path string, content long, hashes array<long>, lines binary, kinds array<int>"
_SIDE_SQL = "struct<host: string, path: string, hashes: array<long>>"
_SIDE = pa.struct([("host", pa.string()), ("path", pa.string()), ("hashes", pa.list_(pa.int64()))])
_ROW_FIELDS = [
    ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("content", pa.int64()),
    ("hashes", pa.list_(pa.int64())), ("lines", pa.binary()), ("kinds", pa.list_(pa.int32())),
]
#: What a row of the paired pages is: a page with its text, a page at an end of its range, or the ends of a range.
DONE, OPEN, ENDS = 0, 1, 2
_PAIRED = pa.schema([
    *_ROW_FIELDS, ("text", pa.string()), ("state", pa.int32()), ("range", pa.int32()), ("head", pa.bool_()), ("tail", pa.bool_()),
    ("before", _SIDE), ("after", _SIDE), ("first", _SIDE), ("last", _SIDE)])
_PAIRED_SQL = (f"{_ROW}, text string, state int, range int, head boolean, tail boolean, "
               f"before {_SIDE_SQL}, after {_SIDE_SQL}, first {_SIDE_SQL}, last {_SIDE_SQL}")
_BESIDE = pa.schema([("range", pa.int32()), ("range_before", _SIDE), ("range_after", _SIDE)])


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What pairing needs of every page: the hashes and kinds of its lines, and the lines that can be text."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            out = []
            for row in batch.slice(start, 256).to_pylist():
                lines = text_lines(row.pop("html") or "")
                kinds = [kind for _, kind in lines]
                held = "\n".join(lines[i][0] for i in _possible(kinds)).encode("utf-8", "surrogatepass")
                out.append(row | {"hashes": [_line_hash(s) for s, _ in lines], "lines": press.compress(held), "kinds": kinds})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema(_ROW_FIELDS))


def _possible(kinds: list[int]) -> list[int]:
    """The positions of the lines that can be text: those of marked elements, or else of the body."""
    return [i for i, kind in enumerate(kinds) if _is_mark(kind)] or [i for i, kind in enumerate(kinds) if kind == BODY]


def _side(row: dict | None) -> dict | None:
    return None if row is None else {k: row[k] for k in ("host", "path", "hashes")}


def _on_host(host: str, side: dict | None) -> dict | None:
    """A page as a neighbour of pages of a host, if it is on that host."""
    return side if side is not None and host and side["host"] == host else None


def _decide(row: dict, before: dict | None, after: dict | None) -> str:
    """The text of a row, given the nearest pages before and after on its host whose lines differ."""
    held = zstandard.ZstdDecompressor().decompress(row["lines"]).decode("utf-8", "surrogatepass")
    texts = dict(zip(_possible(row["kinds"]), held.split("\n")))
    trivial = {i for i, s in texts.items() if _trivial(s)}
    return "\n".join(texts[i] for i in kept_lines(row["kinds"], row["hashes"], _nearest(row["path"], before, after), trivial))


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream through a sorted range in runs of pages with equal lines; pages of its first and last run come out open."""
    ends = {"state": ENDS, "range": TaskContext.get().partitionId(), "first": None}
    before: dict | None = None
    run: list[dict] = []

    def rows(after: dict | None) -> Iterator[dict]:
        """The rows of the run; a range ends with it if no row comes after."""
        host, head = run[0]["host"], before is None
        sides = {"before": _on_host(host, _side(before)), "after": _on_host(host, _side(after))}
        for row in run:
            if head or after is None:
                yield row | sides | {"state": OPEN, "range": ends["range"], "head": head, "tail": after is None}
            else:
                yield {"page_id": row["page_id"], "url": row["url"], "text": _decide(row, **sides), "state": DONE}
        if head:
            ends.update(first=_side(run[0]), after=_side(after))
        if after is None:
            ends.update(last=_side(run[-1]), before=_side(before))
            yield ends

    def made(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        while part := list(islice(found, 256)):
            yield pa.RecordBatch.from_pylist([{name: r.get(name) for name in _PAIRED.names} for r in part], _PAIRED)

    def streamed() -> Iterator[dict]:
        nonlocal before, run
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    if run and (row["host"], row["hashes"]) != (run[0]["host"], run[0]["hashes"]):
                        yield from rows(row)
                        before, run = run[-1], []
                    if run:  # equal pages share what they hold
                        row |= {name: run[0][name] for name in ("host", "hashes", "kinds", "lines") if row[name] == run[0][name]}
                    run.append(row)
        if run:
            yield from rows(None)

    return made(streamed())


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range, in order, the nearest pages with other lines before its first and after its last run."""
    ranges = [row for batch in batches for row in batch.to_pylist()]

    def walk(order: list[dict], near: str, far: str, inner: str) -> dict[int, dict | None]:
        """From range to range: ``far`` is the end that the last range has towards this one, ``inner`` the page behind its run."""
        out: dict[int, dict | None] = {}
        last = behind = None
        for r in order:
            own = r[near]
            side = _on_host(own["host"], last)
            if side is not None and side["hashes"] == own["hashes"]:
                side = _on_host(own["host"], behind)
            out[r["range"]] = side
            last, behind = r[far], r[inner] if r[inner] is not None else side
        return out

    before, after = walk(ranges, "first", "last", "before"), walk(ranges[::-1], "last", "first", "after")
    yield pa.RecordBatch.from_pylist([{"range": k, "range_before": before[k], "range_after": after[k]} for k in before], _BESIDE)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page (columns page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    lines = rows.select("page_id", "url", host.alias("host"), path.alias("path"), F.xxhash64("html").alias("content"), "html")
    order = ["host", "path", "url", "page_id", "content"]
    paired = stored(
        lines.mapInArrow(_line_rows, _ROW).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pair, _PAIRED_SQL),
        f"{work_folder(pages.sparkSession)}/paired", "zstd")
    # the ends of the ranges: one row of each task, whatever the number of pages
    ends = paired.where(f"state = {ENDS}").select("range", "before", "after", "first", "last")
    beside = ends.repartition(1).sortWithinPartitions("range").mapInArrow(_beside, f"range int, range_before {_SIDE_SQL}, range_after {_SIDE_SQL}")
    edges = paired.where(f"state = {OPEN}").join(beside, "range").select(
        "page_id", "url", "path", "hashes", "lines", "kinds",
        F.when(F.col("head"), F.col("range_before")).otherwise(F.col("before")).alias("before"),
        F.when(F.col("tail"), F.col("range_after")).otherwise(F.col("after")).alias("after"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_decide(r, r["before"], r["after"]) for r in batch.to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    done = paired.where(f"state = {DONE}").select("page_id", "url", "text")
    out = done.union(edges.mapInArrow(finish, "page_id long, url string, text string"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
