"""Secret scans: fixed patterns over texts and over everything that is encoded in them."""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import byte_bounded, utf8

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex")
#: Bytes of a decompressed layer that are scanned together, and bytes that neighbouring blocks share.
BLOCK_BYTES, SHARED_BYTES = 16 << 20, 1 << 20
#: Bytes that a decompressor gives at a time; bytes that one without such a limit is given.
PIECE_BYTES, ZSTD_BYTES = 1 << 20, 256

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&\#x[0-9A-Fa-f]{1,6};|&\#[0-9]{1,7};)+")
_ESCAPE = re.compile(r"\\u\{?([0-9A-Fa-f]+)\}?|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&\#x([0-9A-Fa-f]+);|&\#([0-9]+);")
_ALPHABETS = ("A-Za-z0-9+/_-", "A-Za-z0-9+/", "A-Za-z0-9_-")
_BASE64 = [re.compile(x) for x in (r"[A-Za-z0-9+/]{16,}|[A-Za-z0-9_-]{16,}", *(f"[{x}]{{16,}}" for x in _ALPHABETS))]
_WRAPPED = [re.compile(rf"(?<![{x}])[{x}]++(?:\r?\n[{x}]++)+") for x in _ALPHABETS]
_READABLE = re.compile(rb"[\x20-\x7e]{12,}")
_HINTS = (b"passw", b"secret", b"token", b"api")
_HEX_BYTES = re.compile(_HEX.pattern.encode())
_SPACES = re.compile(rb"\x20{2,}")
_RUN = re.compile(rb"[A-Za-z0-9+/_\r\n-]++")

Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap, without those that are too short."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Same:
    """One place for all characters of a layer: what was compressed comes from its whole run."""

    def __init__(self, place: int):
        self.place = place

    def __getitem__(self, at):
        return self if isinstance(at, slice) else self.place


class Layer:
    """A text and, for each of its characters, where it comes from in the outermost text."""

    def __init__(self, text: str, lo: Sequence[int] | Same, hi: Sequence[int] | Same):
        self.text, self.lo, self.hi = text, lo, hi

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.lo[start], self.hi[end - 1]


def all_spans(text: str, block_bytes: int = BLOCK_BYTES) -> tuple[list[Span], list[Span]]:
    """Spans of the text itself, and spans of all its layers.

    A worklist holds layers whose insides are still to be decoded. Each way to decode a layer that changes something
    gives another one, which is scanned and put on the list, until none is new; a large layer comes in blocks, one after another. A layer is known by its content and its place, so equal tokens at
    two places are both followed, and content that unpacks to itself is followed once.
    """
    base = base_spans(text)
    spans = set(base)
    work = [decoded(Layer(text, range(len(text)), range(1, len(text) + 1)), block_bytes)]
    seen: set[bytes] = set()
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        place = f"{layer.lo[0]}:{layer.hi[-1]}:".encode()
        key = hashlib.blake2b(place + layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        for start, kind, end in base_spans(layer.text):
            first, last = layer.span(start, end)
            spans.add((first, kind, last))
        work.append(decoded(layer, block_bytes))
    return base, sorted(spans)


def decoded(layer: Layer, block_bytes: int = BLOCK_BYTES) -> Iterator[Layer]:
    """The layers one step inside."""
    for pattern, decode in ((_URL, _url), (_UNICODE, _unicode)):
        if (inner := _replaced(layer, pattern, decode)) is not None:
            yield inner
    for run, places in _runs(layer.text):
        for shift in range(4):
            if (raw := _base64(run[shift:])) is None:
                continue
            if (stream := unpacked(raw)) is not None:
                lo, hi = layer.span(places[shift], places[-1] + 1)
                for block in blocks(stream, block_bytes):
                    if text := _text(block):
                        yield Layer(text, Same(lo), Same(hi))
            elif text := _text(raw):
                if isinstance(layer.lo, Same):
                    yield Layer(text, layer.lo, layer.hi)
                    continue
                starts, ends, at = [], [], 0
                for char in text:
                    size = len(char.encode("utf-8", "surrogateescape"))
                    first, last = shift + at * 4 // 3, shift + ((at + size) * 4 + 2) // 3
                    a, b = layer.span(places[first], places[min(last, len(places)) - 1] + 1)
                    starts.append(a), ends.append(b)
                    at += size
                yield Layer(text, starts, ends)


def _runs(text: str) -> Iterator[tuple[str, Sequence[int]]]:
    """Runs that may be base64, each with the places of its characters.

    Runs of both alphabets together and of each alone, within a line and over single line ends. A run over line ends
    is also given from each line on that begins like compressed bytes: the word before it may not belong to it.
    """
    known = set()
    for pattern in _BASE64:
        for m in pattern.finditer(text):
            if m.span() not in known:
                known.add(m.span())
                yield m.group(), range(*m.span())
    if "\n" not in text:
        return
    for pattern in _WRAPPED:
        for m in pattern.finditer(text):
            if m.end() - m.start() <= 16 or m.span() in known:
                continue
            known.add(m.span())
            lines = m.group().replace("\r", "").split("\n")
            run = "".join(lines)
            if len(run) < 16:
                continue
            places = [i for i, x in enumerate(m.group(), m.start()) if x not in "\r\n"]
            yield run, places
            at = 0
            for line in lines[:-1]:
                at += len(line)
                if (raw := _base64(run[at : at + 16])) is not None and _is_packed(raw):
                    yield run[at:], places[at:]


def _is_packed(raw: bytes) -> bool:
    zlib_ = raw[:1] == b"\x78" and len(raw) > 2 and int.from_bytes(raw[:2], "big") % 31 == 0
    return zlib_ or raw.startswith((b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd"))


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each run of the pattern decoded; None if nothing changes."""
    out, lo, hi, at, changed = [], [], [], 0, False
    for m in pattern.finditer(layer.text):
        parts = decode(m.group())
        if parts is None:
            continue
        changed = True
        out.append(layer.text[at : m.start()])
        if isinstance(layer.lo, Same):
            out += [char for char, _, _ in parts]
            at = m.end()
            continue
        lo += layer.lo[at : m.start()]
        hi += layer.hi[at : m.start()]
        for char, first, last in parts:
            a, b = layer.span(m.start() + first, m.start() + last)
            out.append(char), lo.append(a), hi.append(b)
        at = m.end()
    if not changed:
        return None
    out.append(layer.text[at:])
    if isinstance(layer.lo, Same):
        return Layer("".join(out), layer.lo, layer.hi)
    lo += layer.lo[at:]
    hi += layer.hi[at:]
    return Layer("".join(out), lo, hi)


def _url(run: str) -> list[tuple[str, int, int]] | None:
    try:
        text = bytes.fromhex(run.replace("%", "")).decode()
    except UnicodeDecodeError:
        return None
    out, at = [], 0
    for char in text:
        size = 3 * len(char.encode())
        out.append((char, at, at + size))
        at += size
    return out


def _unicode(run: str) -> list[tuple[str, int, int]] | None:
    units = []
    for m in _ESCAPE.finditer(run):
        digits, base = next((x, 10 if i == 5 else 16) for i, x in enumerate(m.groups(), 1) if x)
        units.append((int(digits, base), m.start(), m.end()))
    out, i = [], 0
    while i < len(units):
        code, first, last = units[i]
        if 0xD800 <= code < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1][0] < 0xE000:
            code, last, i = 0x10000 + ((code - 0xD800) << 10) + units[i + 1][0] - 0xDC00, units[i + 1][2], i + 1
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            return None
        out.append((chr(code), first, last))
        i += 1
    return out


def _base64(token: str) -> bytes | None:
    """Bytes of a run of either alphabet; what is left over of four characters is padded or dropped."""
    rest = len(token) % 4
    token = token[: len(token) - (rest == 1)]
    if len(token) < 12:
        return None
    if "-" in token or "_" in token:
        token = token.replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(token + "=" * (-len(token) % 4))
    except (binascii.Error, ValueError):
        return None


def _text(raw: bytes) -> str | None:
    """Text of a decoded run. Where the run has more than the encoded part, other bytes stand as lone surrogates."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("utf-8", "surrogateescape") if _READABLE.search(raw) else None


def unpacked(raw: bytes, block_bytes: int = BLOCK_BYTES) -> Iterator[bytes] | None:
    """The decompressed bytes in pieces, through as many formats as follow one another; None if it is not compressed.

    What is small enough is compared with what it was made of, so that bytes that unpack to themselves come to an end.
    """
    stream, seen, begun = iter([raw]), {raw}, False
    while (inner := _decompressed(stream)) is not None:
        begun = True
        pieces, size = [], 0
        for piece in inner:
            pieces.append(piece)
            size += len(piece)
            if size > block_bytes:
                break
        else:
            whole = b"".join(pieces)
            if whole in seen:
                return iter([whole])
            seen.add(whole)
        stream = chain(pieces, inner)
        if not _is_packed(b"".join(pieces[:2])):
            break
    return stream if begun else None


def _opener(head: bytes):
    """What starts a decompressor of the format that the bytes begin like."""
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and _is_packed(head):
        return _Deflated
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return _Zstd
    return None


class _Deflated:
    """zlib's decompressor with the interface of the others."""

    def __init__(self):
        self.inner, self.rest, self.needs_input = zlib.decompressobj(47), b"", True

    def decompress(self, data: bytes, most: int) -> bytes:
        out = self.inner.decompress(self.rest + data, most)
        self.rest = self.inner.unconsumed_tail
        self.needs_input = not self.rest and len(out) < most
        return out

    @property
    def eof(self) -> bool:
        return self.inner.eof

    @property
    def unused_data(self) -> bytes:
        return self.inner.unused_data


class _Zstd:
    """zstandard's decompressor with the interface of the others; it can't be told how much to give, so it is fed in small parts."""

    def __init__(self):
        import zstandard

        self.inner, self.rest = zstandard.ZstdDecompressor().decompressobj(), b""

    def decompress(self, data: bytes, most: int) -> bytes:
        data = self.rest + data
        self.rest = data[ZSTD_BYTES:]
        return self.inner.decompress(data[:ZSTD_BYTES])

    @property
    def needs_input(self) -> bool:
        return not self.rest

    @property
    def eof(self) -> bool:
        return self.inner.eof

    @property
    def unused_data(self) -> bytes:
        return self.inner.unused_data + self.rest


def _decompressed(stream: Iterator[bytes]) -> Iterator[bytes] | None:
    """The bytes of all members of a compressed stream, as far as they are sound; None if there are none."""
    stream = iter(stream)
    head = b""
    for piece in stream:
        head += piece
        if len(head) >= 6:
            break
    found = _members(head, stream) if _opener(head) else iter(())
    first = next(found, None)
    return None if first is None else chain([first], found)


def _members(data: bytes, stream: Iterator[bytes]) -> Iterator[bytes]:
    while (opener := _opener(data)) is not None:
        unpack = opener()
        try:
            while not unpack.eof:
                if unpack.needs_input and not data and not (data := next(stream, b"")):
                    return
                out, data = unpack.decompress(data, PIECE_BYTES), b""
                if out:
                    yield out
        except Exception as ex:
            if isinstance(ex, (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError)) or type(ex).__name__ == "ZstdError":
                return  # the rest is damaged
            raise
        data = unpack.unused_data
        while len(data) < 6 and (piece := next(stream, b"")):
            data += piece


def blocks(stream: Iterator[bytes], block_bytes: int = BLOCK_BYTES) -> Iterator[bytes]:
    """The bytes of a stream in blocks that share their ends. Runs of spaces are one space, which changes no match; a run that may be base64 is never cut."""
    held, fresh = b"", 0
    for piece in stream:
        held += _SPACES.sub(b" ", piece)
        fresh += len(piece)
        if fresh < block_bytes:
            continue
        held = _SPACES.sub(b" ", held)
        if _RUN.fullmatch(held, max(0, len(held) - SHARED_BYTES)):
            continue  # a run longer than what blocks share: wait for its end
        yield held
        held, fresh = held[-SHARED_BYTES:], 0
    if fresh:
        yield held


def may_hold(raw: bytes) -> bool:
    """False only for texts in which neither a pattern nor an encoded layer can match."""
    if b"AKIA" in raw or b"%" in raw and _URL.search(raw.decode()) or b"\\" in raw or b"&#" in raw or _HEX_BYTES.search(raw):
        return True
    low = raw.lower()
    if any(x in low for x in _HINTS):
        return True
    for run, _ in _runs(raw.decode()):
        for shift in range(4):
            inner = _base64(run[shift:])
            if inner is not None and (_text(inner) is not None or _decompressed([inner]) is not None):
                return True
    return False


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each stretch of spans that touch replaced by one mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at or not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


_FOUND = "base array<struct<kind: string, start: long, end: long>>, spans array<struct<kind: string, start: long, end: long>>, listed_base string, listed_spans string, redacted string"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` as ``(id_col, base, spans, listed_base, listed_spans, redacted)``.

    ``base`` are the spans found in the text as it stands, ``spans`` these and the ones found in its layers, mapped to
    the text: percent runs, Unicode escapes and references, base64 of both alphabets at any alignment, in one line or
    over single line ends, and gzip, zlib,
    bzip2, xz and zstd inside base64, all members of them, nested in any way. Places are code points, ends exclusive; what was compressed has the place of its whole run. ``redacted`` is the
    text with all spans replaced. A null text is the empty text; rows that repeat and null ids stay; an empty table gives
    an empty result; further columns are not read. Texts and layers are scanned whole: a decompressed layer passes in blocks, so its size takes time but no memory;
    only a run of base64 inside one is held whole.
    """

    def run(batches):
        for batch in batches:
            base, spans, texts = [], [], []
            for raw in utf8(batch.column(1)):
                text = raw.decode()
                a, b = all_spans(text) if may_hold(raw) else ([], [])
                base.append(a), spans.append(b), texts.append(redact(text, b))
            rows = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in column], _SPANS) for column in (base, spans)]
            strings = [pa.array(map(listed, x), pa.string()) for x in (base, spans)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *rows, *strings, pa.array(texts, pa.string())],
                names=["id", "base", "spans", "listed_base", "listed_spans", "redacted"],
            )

    rows = byte_bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {_FOUND}").withColumnRenamed("id", id_col)
