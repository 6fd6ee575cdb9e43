"""Secret scans with a recursive decoding worklist.

The text is layer 0.  Every layer is scanned with the same three patterns and
then asked for further layers:

* ``%XX`` escapes: the whole layer with its escapes decoded (as UTF-8);
* ``\\uXXXX``, ``\\UXXXXXXXX``, ``\\xXX`` and ``&#N;`` escapes: likewise;
* each base64 run (standard or URL alphabet), also one wrapped over lines, read from each of
  its first four characters, so that a path or word before it does no harm: its bytes;
* bytes, out of base64 or of escapes that are no text: the stretches in them that are text, and
  every zlib, gzip, bzip2, xz or Zstandard stream that begins anywhere in them, with the
  members that follow it.

New layers join a worklist until it is empty.  A layer whose content was seen
before over the same ranges of the text is not opened again, which ends cycles; equal
content from another place is, so every copy of a secret is found.  Each character of
a layer remembers the range of the text it came from, so a find in any layer is
reported as a span of the text: exact through escapes and base64, from the stream's first
byte to the end of its run through compression.

Streams are inflated to their end, ``WINDOW`` bytes at a time, each beginning with the last
``OVERLAP`` bytes of the one before; layers are made when their turn comes, so memory stays
bounded against decompression bombs.  What is longer than the overlap (a find, or a layer
within the stream) and lies across the end of a window is seen in parts.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import urllib.parse
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import pieces

KINDS = ("assign", "access", "hex")


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([_either("password"), _either("passwd"), _either("secret"), _either("token"), _either("api") + "_?" + _either("key")])
ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
_HEX_RUN = re.compile(r"[0-9a-f]{32}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]{4,}+)++={0,2}")
PERCENT_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~+*'()!/=:;,@$&-])++")
MIN_ASSIGN, MIN_ACCESS = 8, 16
#: No find of any kind is shorter, nor the layer that one is wrapped in.
MIN_FIND = 14
#: UTF-8 without control characters but white space.
PLAIN = re.compile(rb"(?:[\x09-\x0d\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}"
                   rb"|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){%d,}+"
                   % MIN_FIND)
#: First bytes of gzip, zlib, bzip2, xz and Zstandard streams (fixed values).
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: Bytes of a stream that are inflated at a time, what two windows share, and what a decoder is given in one call.
WINDOW, OVERLAP, FEED = 16 << 20, 1 << 20, 256
_BROKEN = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError)


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the finds of one layer."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return out


class Layer:
    """Text and the base text behind it: of each character (``starts``, ``ends``), or one range of all (``whole``)."""

    __slots__ = ("text", "starts", "ends", "whole")

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None,
                 whole: tuple[int, int] | None = None):
        self.text, self.starts, self.ends, self.whole = text, starts, ends, whole

    def base(self, s: int, e: int) -> tuple[int, int]:
        if self.whole is not None:
            return self.whole
        if self.starts is None:
            return s, e
        return int(self.starts[s:e].min()), int(self.ends[s:e].max())

    def ranges(self, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            return np.arange(s, e), np.arange(s + 1, e + 1)
        return self.starts[s:e], self.ends[s:e]

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            return places, places + 1
        return self.starts[places], self.ends[places]


def _utf8(raw: bytes) -> tuple[str, list[int], list[int]]:
    """Characters with the byte range of each; bytes that are no UTF-8 become U+FFFD."""
    text = raw.decode("utf-8", "replace")
    starts, ends, at = [], [], 0
    for c in text:
        width = len(c.encode("utf-8"))
        if c == "�" and raw[at:at + 3] != b"\xef\xbf\xbd":
            width = _bad_width(raw, at)
        starts.append(at)
        ends.append(min(at + width, len(raw)))
        at += width
    return text, starts, ends


def _bad_width(raw: bytes, at: int) -> int:
    """Bytes that one replacement character stands for."""
    for width in (3, 2):
        part = raw[at:at + width]
        if len(part) == width and part.decode("utf-8", "replace") == "�":
            return width
    return 1


def _substitute(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match replaced by ``decode(match)``: (text, starts, ends)."""
    text, parts, at = layer.text, [], 0
    if layer.whole is not None:
        new, n = pattern.subn(lambda m: decode(m.group())[0], text)
        return Layer(new, whole=layer.whole) if n else None
    starts, ends = [], []
    for m in pattern.finditer(text):
        new, s, e = decode(m.group())
        for piece in ((text[at:m.start()], None), (new, (s, e))):
            parts.append(piece[0])
        a, b = layer.ranges(at, m.start())
        starts.append(a)
        ends.append(b)
        a, b = layer.ranges(m.start(), m.end())
        starts.append(a[np.array(s, dtype=np.int64)])
        ends.append(b[np.array(e, dtype=np.int64) - 1])
        at = m.end()
    if not parts:
        return None
    parts.append(text[at:])
    a, b = layer.ranges(at, len(text))
    return Layer("".join(parts), np.concatenate([*starts, a]), np.concatenate([*ends, b]))


def _percent(run: str):
    text, s, e = _utf8(bytes.fromhex(run.replace("%", "")))
    return text, [3 * x for x in s], [3 * x for x in e]


def _escape(run: str):
    if run.startswith("&#"):
        body = run[2:-1]
        code = int(body[1:], 16) if body[0] in "xX" else int(body)
        return _char(code), [0], [len(run)]
    if run.startswith("\\U"):
        return _char(int(run[2:], 16)), [0], [len(run)]
    if run.startswith("\\x"):
        text, s, e = _utf8(bytes.fromhex(run.replace("\\x", "")))
        return text, [4 * x for x in s], [4 * x for x in e]
    units = [int(x, 16) for x in run.split("\\u")[1:]]
    text, starts, ends, k = [], [], [], 0
    while k < len(units):
        pair = 0xD800 <= units[k] < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1] < 0xE000
        code = 0x10000 + ((units[k] - 0xD800) << 10) + (units[k + 1] - 0xDC00) if pair else units[k]
        text.append(_char(code))
        starts.append(6 * k)
        k += 2 if pair else 1
        ends.append(6 * k)
    return "".join(text), starts, ends


def _char(code: int) -> str:
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def _decoder(head: bytes):
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78":
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:1] == b"\xfd":
        return lzma.LZMADecompressor()
    return zstandard.ZstdDecompressor().decompressobj()


def _inflated(raw: bytes, at: int) -> Iterator[bytes]:
    """Content of the stream at ``at`` and of the members right behind it, up to the first fault; returns where it ends.

    A decoder is given few bytes in a call, so that what it gives back is bounded.
    """
    while MAGIC.match(raw, at):
        decoder, begin = _decoder(raw[at:at + 8]), at
        try:
            while at < len(raw) and not decoder.eof:
                part = raw[at:at + FEED]
                at += len(part)
                if out := decoder.decompress(part):
                    yield out
        except _BROKEN:
            return begin + 1
        if not decoder.eof:
            break
        at -= len(decoder.unused_data)
    return at


def _windows(raw: bytes, at: int) -> Iterator[tuple[bytes, bool]]:
    """The inflated content in windows, each with whether another came before it; returns where the stream ends."""
    parts, size, later = [], 0, False
    stream = _inflated(raw, at)
    while True:
        try:
            part = next(stream)
        except StopIteration as end:
            if parts:
                yield b"".join(parts), later
            return end.value
        parts.append(part)
        size += len(part)
        if size >= WINDOW:
            window = b"".join(parts)
            yield window, later
            parts, later = [window[-OVERLAP:]], True
            size = len(parts[0])


class Bytes:
    """Bytes that came out of a stream, and the range of the base text behind them."""

    __slots__ = ("raw", "whole", "later")

    def __init__(self, raw: bytes, whole: tuple[int, int], later: bool):
        self.raw, self.whole, self.later = raw, whole, later


def _streams(raw: bytes, whole) -> Iterator[Bytes]:
    """Windows of all streams in the bytes; ``whole(k)`` is the range of a stream at byte k."""
    at = 0
    while m := MAGIC.search(raw, at):
        windows = _windows(raw, m.start())
        while True:
            try:
                window, later = next(windows)
            except StopIteration as end:
                at = max(end.value, m.start() + 1)
                break
            yield Bytes(window, whole(m.start()), later)


def _texts(raw: bytes) -> tuple[str, np.ndarray, np.ndarray] | None:
    """The stretches that are text, with a zero character between two, and the byte range of each character."""
    found = list(PLAIN.finditer(raw))
    if not found:
        return None
    data, starts, ends = np.frombuffer(raw, dtype=np.uint8), [], []
    for m in found:
        first = np.flatnonzero((data[m.start():m.end()] & 0xC0) != 0x80) + m.start()
        starts += [first, [m.end() - 1]]
        ends += [first[1:], [m.end(), m.end()]]
    text = "\0".join(m.group().decode("utf-8") for m in found)
    return text, np.concatenate(starts)[:len(text)].astype(np.int64), np.concatenate(ends)[:len(text)].astype(np.int64)


def _from_base64(layer: Layer, m: re.Match) -> Iterator[Layer | Bytes]:
    """What a run holds, read from each of its first four characters; line ends within it are skipped."""
    run = m.group().rstrip("=")
    places = None
    if "\n" in run:
        places = np.array([k for k, c in enumerate(run) if c not in "\r\n\t "], dtype=np.int64) + m.start()
        run = re.sub(r"[\r\n\t ]", "", run)
    run = run.replace("-", "+").replace("_", "/")
    for skip in range(4):
        body = run[skip:len(run) - ((len(run) - skip) % 4 == 1)]
        raw = base64.b64decode(body + "=" * (-len(body) % 4))

        def place(k: int) -> int:
            return int(places[skip + k]) if places is not None else m.start() + skip + k

        if (plain := _texts(raw)) is not None:
            text, first, last = plain
            if layer.whole is not None:
                yield Layer(text, whole=layer.whole)
            else:
                a, b = first * 4 // 3 + skip, np.minimum(-(-last * 4 // 3), len(body)) - 1 + skip
                a, b = (places[a], places[b]) if places is not None else (a + m.start(), b + m.start())
                yield Layer(text, layer.at(a)[0], layer.at(b)[1])
        yield from _streams(raw, lambda k: layer.base(place(k * 4 // 3), m.end()))


def _escaped_bytes(layer: Layer) -> Iterator[Bytes]:
    """Streams whose bytes are written as escapes: ``%XX`` among plain characters, or ``\\xXX`` alone."""
    if "%" in layer.text:
        for m in PERCENT_RUN.finditer(layer.text):
            run = m.group()
            if "%" not in run:
                continue
            for space in ("+", " ") if "+" in run else ("+",):
                raw = urllib.parse.unquote_to_bytes(run.replace("+", space))
                if MAGIC.search(raw):
                    place = np.array([x.start() for x in re.finditer(r"%[0-9A-Fa-f]{2}|.", run)]) + m.start()
                    yield from _streams(raw, lambda k: layer.base(int(place[k]), m.end()))
    if "\\x" in layer.text:
        for m in re.finditer(r"(?:\\x[0-9A-Fa-f]{2})++", layer.text):
            raw = bytes.fromhex(m.group().replace("\\x", ""))
            yield from _streams(raw, lambda k: layer.base(m.start() + 4 * k, m.end()))


def _inside(layer: Layer | Bytes) -> Iterator[Layer | Bytes]:
    """The layers one step further in, each made when it is asked for."""
    if isinstance(layer, Bytes):
        if found := PLAIN.findall(layer.raw):
            yield Layer(b"\0".join(found).decode("utf-8"), whole=layer.whole)
        yield from _streams(layer.raw, lambda k: layer.whole)
        return
    if "%" in layer.text:
        if (new := _substitute(layer, PERCENT, _percent)) is not None:
            yield new
    if "\\" in layer.text or "&#" in layer.text:
        if (new := _substitute(layer, UNICODE, _escape)) is not None:
            yield new
    yield from _escaped_bytes(layer)
    for m in BASE64.finditer(layer.text):
        yield from _from_base64(layer, m)
    if "\n" in layer.text:
        for m in WRAPPED.finditer(layer.text):
            yield from _from_base64(layer, m)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """(base spans, all spans, layers opened, streams longer than a window) of a text (null: empty).

    Spans are (start, end, kind number), by start, then kind, then end.
    """
    text = text or ""
    base = sorted(find(text), key=lambda x: (x[0], x[2], x[1]))
    top = Layer(text)
    spans, seen, opened, long = set(base), {_key(top)}, 0, 0
    work = [_inside(top)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if (key := _key(layer)) in seen:
            continue
        seen.add(key)
        if isinstance(layer, Bytes):
            long += layer.later
        elif layer.text:
            opened += 1
            spans.update((*layer.base(s, e), k) for s, e, k in find(layer.text))
        work.append(_inside(layer))
    return base, sorted(spans, key=lambda x: (x[0], x[2], x[1])), opened, long


def _key(layer: Layer | Bytes) -> bytes:
    """Digest of a layer's content and of where it came from."""
    if isinstance(layer, Bytes):
        return hashlib.sha256(layer.raw + b"bytes%d:%d" % layer.whole).digest()
    key = hashlib.sha256(layer.text.encode("utf-8", "surrogatepass"))
    if layer.whole is not None:
        key.update(b"whole%d:%d" % layer.whole)
    if layer.starts is not None:
        key.update(np.ascontiguousarray(layer.starts, dtype=np.int64).tobytes())
        key.update(np.ascontiguousarray(layer.ends, dtype=np.int64).tobytes())
    return key.digest()


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every maximal covered range replaced by ``[kind]`` of its first span."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, e, k in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    for s, e, k in merged:
        out += [text[at:s], f"[{KINDS[k]}]"]
        at = e
    return "".join([*out, text[at:]])


_SPANS = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
          "n_layers long, n_long long")


def find_secrets(docs: DataFrame) -> DataFrame:
    """Spans of every document: counts and digest of the base finds, then all spans.

    Null texts are empty; a text without finds has zero counts, the digest of the
    empty string and empty spans.  Repeated rows each give a row.
    """

    def run(batches):
        for rb in pieces(batches):
            rows = []
            for doc, text in zip(rb.column("doc_id").to_pylist(), rb.column("text").to_pylist()):
                base, spans, opened, long = scan(text)
                kinds = [k for *_, k in base]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows.append((doc, kinds.count(0), kinds.count(1), kinds.count(2), digest, written(spans), opened, long))
            cols = list(zip(*rows))
            kinds_of = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_of)],
                                             [x.split()[0] for x in _SPANS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, _SPANS)


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with all spans of their texts redacted; null texts stay null."""

    def run(batches):
        for rb in pieces(batches):
            texts = [t if not t or not (spans := scan(t)[1]) else redact(t, spans) for t in rb.column("text").to_pylist()]
            at = rb.schema.get_field_index("text")
            yield rb.set_column(at, rb.schema.field(at), pa.array(texts, rb.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
