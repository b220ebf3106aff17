"""Text of PDF files: enough of the format for files that carry plain or deflated page contents.

Objects are found by their headers, so damaged cross-reference tables don't matter.  Page
contents are read in page order; strings shown by Tj, TJ, ' and " become text, moves to
another line become line ends.  Fonts with their own code tables, encryption and object
streams are beyond it: such files give no text and so count as not extractable.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?\d*\.?\d+|[A-Za-z'\"*]+\d?|/[^\s/\[\]()<>]+", re.S)
# Escapes of literal strings.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)


class PdfError(ValueError):
    pass


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in (b"\n", b"\r\n", b"\r") else _ESCAPES.get(m[1], m[1]), token[1:-1])
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def _shown(content: bytes) -> str:
    """Text that a page's content shows."""
    out: list[str] = []
    held: list[bytes] = []
    for m in _TOKEN.finditer(content):
        token = m[0]
        if token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                out.append("\n")
            for k, t in enumerate(held):
                if t[:1] in (b"(", b"<"):
                    out.append(_string(t))
                elif token == b"TJ" and k and _number(t) < -200:  # a gap as wide as a blank
                    out.append(" ")
        elif token in (b"Td", b"TD"):
            if len(held) >= 2 and _number(held[-1]):
                out.append("\n")
        elif token in (b"T*", b"Tm", b"ET"):
            out.append("\n")
        if token[:1].isalpha() or token in (b"'", b'"', b"T*"):
            held.clear()
        else:
            held.append(token)
    return "\n".join(line for x in "".join(out).split("\n") if (line := x.strip()))


def _number(token: bytes) -> float:
    try:
        return float(token)
    except ValueError:
        return 0.0


class Pdf:
    def __init__(self, body: bytes):
        if not body.lstrip()[:5] == b"%PDF-":
            raise PdfError("not a PDF")
        self.objects = {int(m[1]): m[3] for m in _OBJECT.finditer(body)}  # a later version of an object counts
        roots = [o for o in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", o)]
        if b"/Encrypt" in body or not roots:
            raise PdfError("no readable catalog")
        info = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", body)
        title = info and re.search(rb"/Title\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", self.objects.get(int(info[1]), b""))
        self.title = _string(title[1]).strip() if title else ""
        self.pages = self._pages(self._refer(roots[-1], rb"Pages"), set())

    def _refer(self, source: bytes, key: bytes) -> list[int]:
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", source)
        return [int(r) for r in _REFERENCE.findall(m[1])] if m else []

    def _pages(self, ids: list[int], seen: set[int]) -> list[int]:
        out, todo = [], ids[::-1]
        while todo:
            i = todo.pop()
            if i in seen or i not in self.objects:
                continue
            seen.add(i)
            kids = self._refer(self.objects[i], rb"Kids")
            if kids:
                todo += kids[::-1]
            else:
                out.append(i)
        return out

    def text(self, page: int) -> str:
        parts = []
        for i in self._refer(self.objects[page], rb"Contents"):
            m = _STREAM.search(self.objects.get(i, b""))
            if m is None:
                continue
            head = self.objects[i][: m.start()]
            if b"/FlateDecode" in head:
                try:
                    parts.append(zlib.decompressobj().decompress(m[1]))
                except zlib.error as e:
                    raise PdfError(str(e)) from e
            elif b"/Filter" not in head:
                parts.append(m[1])
        return _shown(b"\n".join(parts))
