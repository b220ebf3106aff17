"""Main text of HTML pages: nearest-URL differencing, then a rescue by page structure.

A page is cut into block lines, each in a zone: article (inside article, main or
role=main), furniture (navigation, headers and footers of the site, sidebars, notices,
adverts, forms, reader comments) or plain.  Pages are sorted by host and URL path over
range partitions, so a hot host is spread; the last and first page of a partition also
go to the next and the previous one.  Each page is aligned with its neighbour on the
same host (its predecessor; the first of a host takes its successor) by longest common
subsequence of lines, and shared lines are deleted, whatever their zone.

Differencing alone loses passages that an article has in common with its neighbour, and
keeps adverts that differ from page to page.  So structure has a say after it: deleted
lines of the article are rescued, and furniture goes even if no neighbour has it.  If a
page has an article, nothing else of it counts; on pages without one differencing decides.
``report`` tells for a table how many lines each of the three touched.

Defined cases: a null or empty page gives an empty text; a null or odd URL has an empty
host or path and is compared among its like; a page alone on its host is compared with
none; repeated rows are aligned with each other (only plain lines can vanish by that) and
are spread over partitions like others; a page may be as long as a row can be; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestral.llm import shared, text

#: Zones; SOFT is furniture that an article inside opens again.
PLAIN, ARTICLE, FURNITURE, SOFT = 0, 1, 2, 3

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|</?[a-zA-Z][^>]*\Z|<!\[CDATA\[.*?\]\]>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
# Element names by kind, and words of class, id and role that mark furniture.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img picture source".split())
DROPPED = frozenset("head svg math canvas audio video object select button".split())
NOT_MAIN = frozenset("nav footer aside dialog menu search".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre figure figcaption table".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notification alert nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer masthead share sharing social related recommended newsletter subscribe signup login popup modal overlay widget toolbar pagination pager skip".split())
#: Reader comments hold articles of their own.
COMMENTS = frozenset("comment comments disqus replies respond".split())
#: Words that turn a mark into something else: layouts that have a sidebar, sections on related work.
UNMARK = frozenset("has with without no is main content layout page work works effect effects by".split())
#: Marks of a paragraph or heading: what the text is about may be a notice or a side.
STRONG = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie share sharing newsletter pagination pager breadcrumb breadcrumbs".split()) | COMMENTS
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
_BLANK = re.compile(r"\s+")


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)}


_PARTS = re.compile(r"[A-Za-z]+")


def _marked(name: str, attributes: str, inside: bool) -> int:
    """Zone that an element's role, class and id ask for, or PLAIN.

    Inside an article ids don't count, and text elements need a strong mark.
    """
    if not attributes or attributes.isspace():
        return PLAIN
    a = _attributes(attributes)
    if a.get("role", "").lower() in ROLES or a.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|$)", _ATTRIBUTE.sub("", attributes)):
        return FURNITURE
    tokens = (a.get("class") or "").split() + ([] if inside else (a.get("id") or "").split())
    marks = STRONG if name in TEXT else MARKS | COMMENTS
    found = PLAIN
    for token in tokens:
        parts = {p.lower() for p in _PARTS.findall(token)}
        if parts & marks and not parts & UNMARK:
            if parts & COMMENTS:
                return FURNITURE
            found = SOFT
    return found


def lines(html: str) -> list[tuple[int, str]]:
    """(zone, text) of each block of a page."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements with a zone to go back to
    zone, dropped, held, at = PLAIN, 0, [], 0

    def flush() -> None:
        if held:
            line = _BLANK.sub(" ", unescape("".join(held))).strip()
            held.clear()
            if line:
                out.append((zone, line))

    n = len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            if not dropped:
                held.append(html[at:])
            break
        if m.start() > at and not dropped:
            held.append(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    flush()
                    zone = stack[i][1] & 3
                    dropped = stack[i][1] >> 2
                    del stack[i:]
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if name == "br" or name == "hr":
            held.append(" ") if name == "br" else flush()
            continue
        if name not in INLINE:
            flush()
            while stack and stack[-1][0] == "p" and name not in VOID:  # a block ends an open paragraph
                zone, dropped = stack[-1][1] & 3, stack[-1][1] >> 2
                stack.pop()
        if name in VOID or m[3].endswith("/") and name not in INLINE and name != "p" and name != "div":
            continue
        before = zone | dropped << 2
        if name in DROPPED:
            dropped = 1
        elif zone != FURNITURE:
            role = _attributes(m[3]).get("role", "").lower() if m[3] and "role" in m[3] else ""
            main = name in ("article", "main") or role in ("main", "article")
            asked = FURNITURE if name in NOT_MAIN or (name == "header" and zone != ARTICLE) else SOFT if name == "form" else PLAIN
            if asked == PLAIN and name not in ("html", "body", "main"):
                asked = _marked(name, m[3], zone == ARTICLE)
            if asked == FURNITURE or asked == SOFT and not main:
                flush()
                zone = asked
            elif main:
                zone = ARTICLE
        if name not in INLINE or zone | dropped << 2 != before or any(s[0] == name for s in stack[-8:]):
            stack.append((name, before))
    flush()
    return out


#: Bytes of the table of an alignment; beyond it the longer part is halved first.
ROOM = 1 << 26


def _rows(a: list[str], b: list[str]) -> list[int]:
    """Bit vectors of the alignment after each line of ``a``: a zero where another line of ``b`` is matched."""
    places: dict[str, int] = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, out = full, []
    for line in a:
        u = v & places.get(line, 0)
        v = (v + u | v - u) & full
        out.append(v)
    return out


def _zeros(v: int, n: int) -> np.ndarray:
    """Zeros among the first 0, 1, ..., n bits: the length of the alignment with that much of ``b``."""
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-n // 8) or 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _aligned(a: list[str], b: list[str]) -> set[int]:
    if not a or not b:
        return set()
    if len(a) > 1 and len(a) * len(b) > 8 * ROOM:
        half = len(a) // 2
        left, right = _last(a[:half], b), _last(a[half:][::-1], b[::-1])
        cut = int(np.argmax(_zeros(left, len(b)) + _zeros(right, len(b))[::-1]))
        return _aligned(a[:half], b[:cut]) | {half + i for i in _aligned(a[half:], b[cut:])}
    rows = _rows(a, b)
    found, i, j = set(), len(a), len(b)
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> j - 1 & 1:
            found.add(i)
            j -= 1
    return found


def _last(a: list[str], b: list[str]) -> int:
    """The last of ``_rows``, without keeping the others."""
    places: dict[str, int] = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for line in a:
        u = v & places.get(line, 0)
        v = (v + u | v - u) & full
    return v


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Whole rows of the table are one number each, so the work is the product of the
    lengths over the bits of a machine word, however often lines repeat.
    """
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    middle = _aligned(a[lead : len(a) - tail], b[lead : len(b) - tail])
    return set(range(lead)) | {lead + i for i in middle} | set(range(len(a) - tail, len(a)))


def _kept(page: list[tuple[int, str]], neighbour: list[tuple[int, str]] | None) -> tuple[list[bool], dict[str, int]]:
    """Which lines stay, and how many differencing deleted, structure rescued and structure removed."""
    gone = shared_lines([x for _, x in page], [x for _, x in neighbour]) if neighbour else set()
    article = any(z == ARTICLE for z, _ in page)
    keep = [i not in gone for i in range(len(page))]
    counts = {"lines": len(page), "deleted": len(gone), "rescued": 0, "removed": 0}
    for i, (zone, _) in enumerate(page):
        if zone == ARTICLE:
            counts["rescued"] += not keep[i]
            keep[i] = True
        elif keep[i] and (article or zone != PLAIN):
            counts["removed"] += 1
            keep[i] = False
    return keep, counts


def main_text(page: list[tuple[int, str]], neighbour: list[tuple[int, str]] | None) -> str:
    return "\n\n".join(x for (_, x), k in zip(page, _kept(page, neighbour)[0]) if k)


BEFORE, OWN, AFTER = range(3)


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(page_id, url, page, neighbour) of each page: its predecessor of one host, or its successor if it is the first."""
    before = first = None  # before: range, host and lines; first: a page that waits for its successor
    for batch in text.slices(batches, "html"):
        rows = []
        for r in batch.to_pylist():
            page = lines(r["html"] or "")
            range_, part = divmod(r["place"], 4)
            same = before is not None and before[0] == (range_, r["host"])
            if first is not None:
                rows.append((*first, page if same else None))
                first = None
            if part == OWN and same:
                rows.append((r["page_id"], r["url"], page, before[1]))
            elif part == OWN:
                first = (r["page_id"], r["url"], page)
            before = ((range_, r["host"]), page)
        yield rows
    if first is not None:
        yield [(*first, None)]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _differenced(batches):
        found = [main_text(page, neighbour) for _, _, page, neighbour in rows]
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("lines", "deleted", "rescued", "removed")
    for rows in _differenced(batches):
        counts = [_kept(page, neighbour)[1] for _, _, page, neighbour in rows]
        yield pa.RecordBatch.from_arrays([pa.array([c[n] for c in counts], pa.int64()) for n in names], names=names)


def _dealt(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, host, place), sorted by host and path; a range of them in each partition."""
    url = F.coalesce("url", F.lit(""))
    keyed = pages.select(
        F.col("page_id").cast("long"), "url", "html", F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)).alias("host"), F.regexp_extract(url, r"^(?:[^:/?#]+://[^/?#]*)?([^?#]*)", 1).alias("path")
    )
    # Rows that are equal in all else are told apart by their place in the scan, so that many of them are spread.
    order = ["host", "path", "key_url", "key_id", "key_row"]
    keyed = keyed.withColumn("key_url", url).withColumn("key_id", F.coalesce("page_id", F.lit(-(1 << 63)))).withColumn("key_row", F.monotonically_increasing_id())
    n = shared.partitions(pages.sparkSession)
    key = F.struct(*order)
    ranges = keyed.select(*order).repartitionByRange(n, *order).groupBy(F.spark_partition_id()).agg(F.min(key).alias("a"), F.max(key).alias("b")).collect()  # one row per range
    ranges = sorted((tuple(r["a"]), tuple(r["b"])) for r in ranges)
    starts, ends = [a for a, _ in ranges], [b for _, b in ranges]

    @F.pandas_udf("array<long>")
    def places(host: pd.Series, path: pd.Series, url: pd.Series, page_id: pd.Series, row: pd.Series) -> pd.Series:
        out = []
        for k in zip(host, path, url, page_id, row):
            at = max(0, bisect_right(starts, k) - 1)
            out.append([4 * at + OWN] + ([4 * (at + 1) + BEFORE] if k == ends[at] and at + 1 < len(starts) else []) + ([4 * (at - 1) + AFTER] if k == starts[at] and at else []))
        return pd.Series(out)

    shared.ship(pages.sparkSession)
    numbered = keyed.withColumn("place", F.explode(places(*order)))
    # The number of a range is that of its partition; ranges needn't be looked for again.
    dealt = numbered.repartitionById(max(1, len(starts)), F.floor(F.col("place") / 4).cast("int")).sortWithinPartitions("place", *order)
    return dealt.select("page_id", "url", "html", "host", "place")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    return shared.arrow(_dealt(pages), _texts, "page_id long, url string, text string, n_chars long")


def report(pages: DataFrame) -> DataFrame:
    """One row: lines, deleted by differencing, rescued (deleted lines of articles), removed (left by differencing, but furniture or beside an article)."""
    rows = shared.arrow(_dealt(pages), _counts, "lines long, deleted long, rescued long, removed long")
    return rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns))
