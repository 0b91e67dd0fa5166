"""Large JSON documents cut into small ones, in blocks of bytes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import BinaryIO

BLOCK = 1 << 20
# Strings that end in the buffer, brackets and separators; a lone quote opens a string that goes on.
TOKEN = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],:]|"', re.DOTALL)
OPEN, CLOSE = (b"{", b"["), (b"}", b"]")
SPACE = b" \t\r\n"


def _tokens(file: BinaryIO, at: int, end: int | None, block_bytes: int) -> Iterator[tuple[int, bytes, bytes]]:
    """``place, token, bytes since the token before`` from a place on; at the end a token of no bytes."""
    file.seek(at)
    buffer, done = b"", 0  # ``at`` is the place of the buffer, ``done`` what is dealt with of it
    while True:
        size = max(block_bytes, len(buffer) - done)
        block = file.read(size if end is None else min(size, end - at - len(buffer)))
        at, buffer, done = at + done, buffer[done:] + block, 0
        for m in TOKEN.finditer(buffer):
            token = m.group()
            if token == b'"' and block:
                break
            yield at + m.start(), token, buffer[done : m.start()]
            done = m.end()
        if not block:
            yield at + len(buffer), b"", buffer[done:]
            return


class _Document:
    """Where the parts of one document are."""

    def __init__(self) -> None:
        self.end, self.head, self.id = None, bytearray(), b"null"
        self.sections: dict[tuple, tuple[int, int]] = {}


def _measured(file: BinaryIO, start: int, places: list[str], block: int) -> _Document:
    """The document that starts at a place: its text without the rows of its sections, its id and where the
    sections are. Of a name that comes twice the last value counts. ``end`` is None if it does not end."""
    cut = {tuple(p.split(".")) for p in places}
    deepest = max(map(len, cut), default=0)
    # of each open bracket its kind and the name of the value that it is at; the open section and how deep in it
    doc, kinds, names, section, inner = _Document(), [], [], None, 0
    key_next, value = False, 0
    for place, token, before in _tokens(file, start, None, block):
        if section is None:
            doc.head += before
        elif token in CLOSE and inner == 0:
            doc.sections[section[0]] = (section[1], place)
            section = None
        elif token:
            inner += (token in OPEN) - (token in CLOSE)
            continue
        if names[:1] == ["id"] and len(kinds) == 1 and (token in CLOSE or token == b","):
            doc.id = bytes(doc.head[value:])
        doc.head += token
        if not token:
            return doc
        if token in OPEN:
            if token == b"[" and tuple(names) in cut:
                section, inner = (tuple(names), place + 1), 0
            kinds.append(token)
            names.append(None)
            key_next = token == b"{"
        elif token in CLOSE:
            kinds.pop()
            names.pop()
            if not kinds:
                doc.end = place + 1
                return doc
        elif token == b",":
            key_next = kinds[-1] == b"{"
        elif token == b":":
            value = len(doc.head) if len(kinds) == 1 else value
        elif key_next:
            names[-1], key_next = _name(token), False
            if len(names) <= deepest:  # an earlier value of the name counts no more
                path = tuple(names)
                doc.sections = {p: s for p, s in doc.sections.items() if p[: len(path)] != path}
    return doc


def _name(token: bytes) -> str:
    try:
        return json.loads(token)
    except ValueError:
        return ""


def _rows(file: BinaryIO, start: int, end: int, block: int) -> Iterator[bytes]:
    """The values of an array, from behind its bracket to the closing one."""
    depth, row = 0, bytearray()
    for _, token, before in _tokens(file, start, end, block):
        row += before
        if token == b"" or (token == b"," and depth == 0):
            if token or row.strip(SPACE):
                yield bytes(row.strip(SPACE))
            row = bytearray()
            continue
        depth += (token in OPEN) - (token in CLOSE)
        row += token


def sliced(
    file: BinaryIO, places: list[str], size: int, block: int = BLOCK
) -> Iterator[tuple[bytes | None, int | None]]:
    """The documents of a file as ``json, offset``.

    One of up to ``size`` bytes is a row. Of a larger one the arrays at ``places`` (``name`` or ``outer.name``)
    are cut out: a row holds all else, with empty arrays, and rows of about ``size`` bytes hold the id and
    values of one array after the first ``offset``. A large text that does not end is a null; other texts that
    are no object stay whole.
    """
    start, found = 0, False
    while True:
        file.seek(start)
        head = file.read(block)
        while head and not head.strip(SPACE):
            start += len(head)
            head = file.read(block)
        blank = len(head) - len(head.lstrip(SPACE))
        if found and not head[blank:].startswith(b"{"):
            return  # as a parser does, what follows a document is left
        if not head[blank:].startswith(b"{"):
            file.seek(0)
            yield file.read(), None
            return
        start += blank
        doc = _measured(file, start, places, block)
        if doc.end is None or doc.end - start <= size:
            file.seek(start)
            text = file.read(size + 1 if doc.end is None else doc.end - start)
            yield (None if len(text) > size else text), None
            if doc.end is None:
                return
        else:
            yield bytes(doc.head), None
            for path, span in doc.sections.items():
                yield from _slices(file, path, span, doc.id, size, block)
        start, found = doc.end, True


def _slices(
    file: BinaryIO, path: tuple, span: tuple[int, int], key: bytes, size: int, block: int
) -> Iterator[tuple[bytes, int]]:
    *outer, name = path
    start = b'{"id":' + key + b"," + b"".join(f'"{o}":{{'.encode() for o in outer) + f'"{name}":['.encode()
    end = b"]" + b"}" * (len(outer) + 1)
    held, length, offset = [], 0, 0
    for row in _rows(file, *span, block):
        if held and length + len(row) > size:
            yield start + b",".join(held) + end, offset
            held, length, offset = [], 0, offset + len(held)
        held.append(row)
        length += len(row)
    if held:
        yield start + b",".join(held) + end, offset
