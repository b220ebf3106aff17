"""Paragraph chunks for the index and lossless byte-budget chunks for prompts.

Both find places in the text first, as offsets, and then choose the places where chunks
end by binary search over them.  Nothing is copied before a chunk is cut out, so the
work grows in proportion to the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The solid part of a line; a line ends at any Unicode line boundary.
_LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_STRETCH = re.compile(rf"\S(?:[^{_LINE_ENDS}]*\S)?")
_SOLID = re.compile(r"\S")
GAP = "\n\n"


def _spans(text: str, limit: int) -> Iterator[tuple[int, int]]:
    """Places of trimmed lines; a line beyond ``limit`` ends at the last space that fits, else after ``limit``."""
    for line in _STRETCH.finditer(text):
        here, stop = line.span()
        while stop - here > limit:
            space = text.rfind(" ", here + 1, here + limit + 1)
            there = space if space > here else here + limit
            solid = there
            while text[solid - 1].isspace():
                solid -= 1
            yield here, solid
            here = _SOLID.search(text, there).start()
        yield here, stop


def paragraphs(text: str, limit: int = 1200) -> list[str]:
    """Chunks of at most ``limit`` characters: as many neighbouring lines as fit, a blank line between them."""
    if limit < 1:
        raise ValueError("limit must be positive")
    spans = list(_spans(text, limit))
    ends = list(accumulate(b - a + len(GAP) for a, b in spans))  # room taken, with a gap after each
    out, first, used = [], 0, 0
    while first < len(spans):
        beyond = bisect_right(ends, used + limit + len(GAP), first)
        out.append(GAP.join(text[a:b] for a, b in spans[first:beyond]))
        first, used = beyond, ends[beyond - 1]
    return out


_BREAK = re.compile(rb"\n[ \t]*\n")
_LAST_SPACE = re.compile(r"\s\S*\Z")


def _places(data: bytes, limit: int) -> Iterator[int]:
    """Where a chunk may end: after blank lines, and inside longer pieces after the last white space that fits."""
    here = 0
    for piece in (*(m.end() for m in _BREAK.finditer(data)), len(data)):
        while piece - here > limit:
            there = here + limit
            while data[there] & 0xC0 == 0x80:  # not inside a character
                there -= 1
            if there <= here:
                raise ValueError("limit is below one character")
            head = data[here:there].decode()
            if space := _LAST_SPACE.search(head):
                there = here + len(head[: space.start() + 1].encode())
            yield there
            here = there
        if piece > here:
            yield piece
            here = piece


def by_bytes(text: str, limit: int) -> list[str]:
    """Chunks of at most ``limit`` UTF-8 bytes whose concatenation is the text; of an empty text one empty chunk."""
    data = text.encode()
    places = list(_places(data, limit))
    out, here = [], 0
    while here < len(data):
        there = places[bisect_right(places, here + limit) - 1]
        out.append(data[here:there].decode())
        here = there
    return out or [""]


def _exploded(table: DataFrame, text: str, cut: Callable[[str], list[str]]) -> DataFrame:
    """The other columns with (position, chunk) of each text, batch by batch."""
    kept = [c for c in table.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(text)):
                chunks = cut(value.as_py() or "")
                same = pa.array([i] * len(chunks), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(same) for c in kept), pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.string())], names=[*kept, "position", "chunk"]
                )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name != text]
    return table.mapInArrow(run, ", ".join([*fields, "position int", "chunk string"]))


def chunk_documents(documents: DataFrame, limit: int = 1200) -> DataFrame:
    """Chunks of active documents: id = document:position, with the document's columns."""
    columns = [c for c in ("source_id", "url", "title", "published_at", "content_hash") if c in documents.columns]
    active = documents.filter("status = 'active'").select(F.col("id").alias("document_id"), *columns, "text")
    chunks = _exploded(active, "text", lambda t: paragraphs(t, limit)).withColumnRenamed("chunk", "text")
    return chunks.select(F.concat_ws(":", "document_id", "position").alias("id"), "*", F.sha2("text", 256).alias("chunk_hash"))


def byte_chunks(documents: DataFrame, limit: int, most: int | None = 20, key: str = "id") -> DataFrame:
    """(key, position, chunk, failure): over ``most`` chunks (None: no bound) the document fails as a whole."""

    def cut(text: str) -> list[str]:
        chunks = by_bytes(text, limit)
        return chunks if most is None or len(chunks) <= most else [None]

    made = _exploded(documents.select(key, "text"), "text", cut)
    return made.select(key, "position", "chunk", F.when(F.col("chunk").isNull(), "document_too_large").alias("failure"))


def prompt_budget(max_bytes: int, system: str, user: str) -> int:
    """Bytes left for a document beside the prompts."""
    left = max_bytes - len(system.encode()) - len(user.encode())
    if left < 1:
        raise ValueError("input_budget")
    return left
