"""Secret scans through nested encodings.

A worklist starts with the text itself. Every layer is scanned for secrets, and its encoded parts are decoded into
new layers: URL and Unicode escapes (character by character), base64 of text, and base64 of gzip or zlib data.
A layer that was seen at the same place is not decoded again, so the list ends when nothing new appears, cycles
included. Each character of a layer knows the part of the text it came from, and a secret found in a layer is
reported as that part.

Base64 is a run of 16 characters or more of the plain or the URL-safe alphabet; where a run of both mixes them, the
longest parts in either are tried. A run at a line's end goes on in the next line, after blanks, if that line holds a
run that is not longer and no other word; an equally long one goes on too. Wrapped lines are one part, unless each of
them has the secret alone; a last line that may be a word of its own counts if a kind is found only with it.
Below base64 all places are the same, so those layers are bytes, and only the kinds found in them matter.

``KINDS`` are found in the text itself at depth 0 exactly as stated; deeper layers add spans, and never remove one.
Compressed parts are inflated to their end, further members included, and a damaged one up to the damage; layers
above ``MOST_HELD`` bytes lie in a temporary file, so memory stays bounded. Every layer is scanned, whatever its bytes.

Defined cases: null texts are empty; an empty text has no spans; repeated rows are scanned alike; an empty table
gives no rows. Spans count code points; ends are exclusive. Other columns are ignored.
"""

from __future__ import annotations

import binascii
import hashlib
import mmap
import re
import tempfile
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, ids_and_text, release, rows, short_batches

# fixed values: patterns and least lengths of the kinds
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 6, "access": 20, "hex": 24}

MOST_HELD = 4 << 20
_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(r"[0-9a-f]{24,}")
_URL_CODES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2}))")
_RUN = re.compile(rb"[A-Za-z0-9+/_-]{16,}")
# a run of one alphabet, and the run of it that a next line begins with
_ALPHABETS = [(re.compile(rb"[%b]{16,}" % c), re.compile(rb"[ \t]*(?:\r\n|\n|\r)[ \t]*([%b]+)" % c)) for c in (rb"A-Za-z0-9+/", rb"A-Za-z0-9_-")]
_PAD = re.compile(rb"={0,2}")
_FILLED = re.compile(rb"={0,2}(?![ \t]+[^ \t\r\n])")     # nothing but marks after the run in its line
_SAFE = bytes.maketrans(b"-_", b"+/")
# the patterns on bytes, for layers below base64
_IN_BYTES = {"assign": re.compile(ASSIGN.encode(), re.I), "access": re.compile(ACCESS.encode()), "hex": re.compile(rb"[0-9a-f]{24,}")}
_CODES = re.compile(rb"(?:%[0-9A-Fa-f]{2}){1,65536}")
_ESCAPE_BYTES = re.compile(_ESCAPE.pattern.encode())
_SPACE = re.compile(rb"\s")
_SPACE_IN_TEXT = re.compile(r"\s")
PART = 1 << 20
SPANS = "array<struct<kind: string, start: int, stop: int, depth: int>>"


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Secrets of one layer as (kind, start, end)."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    # a maximal run of 24 or more is what the greedy pattern finds and keeps
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def _encoded_words(layer: str, codes: re.Pattern, sign: str):
    """(start, end) of the words with a code, from after an earlier sign that begins none; every character is read once."""
    at = 0
    while m := codes.search(layer, at):
        before = layer[at:m.start()]
        word = before.rsplit(None, 1)[-1] if before and not before[-1].isspace() else ""
        start = m.start() - len(word) + word.rfind(sign) + 1
        stop = _SPACE_IN_TEXT.search(layer, m.end())
        at = stop.start() if stop else len(layer)
        yield start, at


def _substituted(part: str, at: int, codes: re.Pattern, decode) -> tuple[str, array, array]:
    """A part with its codes decoded, and the place in the layer of each character of the result."""
    out, starts, ends, last = [], array("q"), array("q"), 0
    for m in codes.finditer(part):
        out.append(part[last:m.start()])
        starts.extend(range(at + last, at + m.start()))
        ends.extend(range(at + last + 1, at + m.start() + 1))
        for s, a, b in decode(m):
            out.append(s)
            starts.extend([at + m.start() + a] * len(s))
            ends.extend([at + m.start() + b] * len(s))
        last = m.end()
    out.append(part[last:])
    starts.extend(range(at + last, at + len(part)))
    ends.extend(range(at + last + 1, at + len(part) + 1))
    return "".join(out), starts, ends


def _url_decoded(m: re.Match):
    """Characters of a run of %XX with their places in it; bytes that are not UTF-8 stay as they are written."""
    raw, i = binascii.unhexlify(m[0].replace("%", "")), 0
    while i < len(raw):
        n = 1 if raw[i] < 0x80 else 2 if raw[i] >> 5 == 6 else 3 if raw[i] >> 4 == 14 else 4 if raw[i] >> 3 == 30 else 1
        try:
            yield raw[i:i + n].decode(), 3 * i, 3 * (i + n)
        except UnicodeDecodeError:
            n = 1
            yield m[0][3 * i:3 * i + 3], 3 * i, 3 * i + 3
        i += n


def _escape_decoded(m: re.Match):
    code = int(m[1] or m[2], 16)
    yield ("�" if 0xD800 <= code < 0xE000 else chr(code)), 0, len(m[0])


def _runs(data):
    """(start, end, wrapped, before) of the base64 parts of a layer, line ends included and padding not.

    before is the end without a last line that may be a word of its own, or 0.
    """
    done = [0] * len(_ALPHABETS)
    for run in _RUN.finditer(data):
        found = {}
        for i, (piece, following) in enumerate(_ALPHABETS):
            for m in piece.finditer(data, *run.span()):
                start, end = m.span()
                if start < done[i]:
                    continue
                full, size, lines, before = end - start, end - start, 1, 0
                while (n := following.match(data, end)) and n.end(1) - n.start(1) <= full and _FILLED.match(data, n.end(1)):
                    size, lines = size + n.end(1) - n.start(1), lines + 1
                    padded = _PAD.match(data, n.end(1)).end() > n.end(1)
                    before = 0 if padded or lines > 2 and size % 4 == 0 else end
                    end = n.end(1)
                    if n.end(1) - n.start(1) < full:
                        break
                done[i] = end
                found[start, end] = lines > 1, before
        for (start, end), (wrapped, before) in found.items():
            yield start, end, wrapped, before


def _lines(data, start: int, end: int):
    return (m.span() for m in _RUN.finditer(data, start, end))


def _bytes(data, start: int, end: int):
    """What base64 characters stand for, a part at a time; line ends are skipped."""
    rest = b""
    for at in range(start, end, PART):
        rest += data[at:min(end, at + PART)].translate(_SAFE, b" \t\r\n")
        whole = len(rest) // 4 * 4
        yield binascii.a2b_base64(rest[:whole])
        rest = rest[whole:]
    if len(rest) > 1:
        yield binascii.a2b_base64(rest + b"=" * (4 - len(rest)))


def _inflated(parts, bits: int):
    """The members of compressed data, a part at a time; what follows the last one is given as it is."""
    member = zlib.decompressobj(bits)
    for part in parts:
        while part:
            if member.eof:
                member = zlib.decompressobj(bits)
            try:
                data = member.decompress(part, PART)
                while data:
                    yield data
                    data = b"" if member.eof else member.decompress(member.unconsumed_tail, PART)
            except zlib.error:
                yield b"\0" + part
                yield from parts
                return
            part = member.unused_data if member.eof else b""


def _stored(parts):
    """The parts as one, in a file of its own if they are long."""
    held, size, file = [], 0, None
    for part in parts:
        held.append(part)
        size += len(part)
        if size > MOST_HELD and file is None:
            file = tempfile.TemporaryFile()
        if file is not None:
            file.write(b"".join(held))
            held = []
    if file is None:
        return b"".join(held)
    with file:
        file.flush()
        return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)


def _opened(data, start: int, end: int):
    """The layers in a base64 part."""
    head = next(_bytes(data, start, min(end, start + 32)), b"")
    for sign, bits in ((b"\x1f\x8b", 31), (b"\x78", 15)):
        if head.startswith(sign):
            yield _stored(_inflated(_bytes(data, start, end), bits))
    yield _stored(_bytes(data, start, end))


def _url_bytes(data, start: int, end: int):
    for m in _CODES.finditer(data, start, end):
        yield from (data[at:min(m.start(), at + PART)] for at in range(start, m.start(), PART))
        yield binascii.unhexlify(m[0].replace(b"%", b""))
        start = m.end()
    yield from (data[at:min(end, at + PART)] for at in range(start, end, PART))


def _escape_bytes(data, start: int, end: int):
    for m in _ESCAPE_BYTES.finditer(data, start, end):
        yield from (data[at:min(m.start(), at + PART)] for at in range(start, m.start(), PART))
        yield chr(int(m[1] or m[2], 16)).encode("utf-8", "replace")
        start = m.end()
    yield from (data[at:min(end, at + PART)] for at in range(start, end, PART))


def _inner_layers(data):
    """The layers in the encoded parts of a layer of bytes."""
    for codes, decode in ((_CODES, _url_bytes), (_ESCAPE_BYTES, _escape_bytes)):
        at = 0
        while m := codes.search(data, at):
            start = max(at, *(data.rfind(c, at, m.start()) + 1 for c in (b" ", b"\t", b"\n", b"\r", b"\f", b"\v")))
            stop = _SPACE.search(data, m.end())
            at = stop.start() if stop else len(data)
            yield _stored(decode(data, start, at))
    for start, end, wrapped, _ in _runs(data):
        yield from _opened(data, start, end)
        for a, b in _lines(data, start, end) if wrapped else ():
            # lines of whole fours say the same alone, unless compressed data begin in them
            if (b - a) % 4 or data[a:a + 1] in (b"H", b"e"):
                yield from _opened(data, a, b)


def _kinds_inside(data, start: int, end: int, depth: int) -> dict[str, int]:
    """The kinds of secrets in a base64 part, each with the least depth of a layer that has it."""
    best: dict[str, int] = {}
    seen: dict[bytes, int] = {}
    stack = [(None, 0, _opened(data, start, end))]
    while stack:
        layer, at = next(stack[-1][2], None), depth + len(stack) - 1
        if layer is None or all(best.get(k, at + 1) <= at for k in KINDS):
            mark, parents, _ = stack.pop()
            if mark and parents == len(seen):       # nothing in it was opened: reading it again costs no more than once
                seen.pop(mark, None)
            continue
        mark = hashlib.blake2b(layer, digest_size=16).digest()
        if seen.get(mark, at + 1) <= at:
            continue
        for kind in KINDS:
            if best.get(kind, at + 1) > at and any(
                    m.end(m.lastindex or 0) - m.start(m.lastindex or 0) >= LEAST[kind] for m in _IN_BYTES[kind].finditer(layer)):
                best[kind] = at
        seen[mark] = at
        stack.append((mark, len(seen), _inner_layers(layer)))
    return best


def _whole(data, start: int, end: int) -> bool:
    """Whether a base64 part is compressed data or UTF-8 as a whole."""
    raw = b"".join(_bytes(data, start, end))
    try:
        return raw.startswith((b"\x1f\x8b", b"\x78")) or raw.decode() is not None
    except UnicodeDecodeError:
        return False


def _base64_kinds(layer: str, depth: int, fresh):
    """(start, end, kinds) of the base64 parts of a text that have secrets."""
    data = layer.encode("ascii", "replace")         # a byte for each character
    parts = []
    for start, end, wrapped, before in _runs(data):
        if not fresh(data[start:end], start, end):
            continue
        kinds = _kinds_inside(data, start, end, depth)
        alone = [(a, b, _kinds_inside(data, a, b, depth)) for a, b in _lines(data, start, end)] if wrapped else []
        if before:
            less = _kinds_inside(data, start, before, depth)
            if less.keys() >= kinds.keys():
                end, kinds = before, less
        # lines that all have a secret alone are no wrapped part
        within = [k for _, b, k in alone if b <= end]
        parts += alone
        parts.append((start, end, {k: d for k, d in kinds.items() if len(within) < 2 or not all(k in x for x in within)}))
    parts = [p for p in parts if p[2]]
    for i, (start, end, kinds) in enumerate(parts):
        # a part with other bytes in it took in what stands beside one that has the secret alone
        inner = [k for a, b, k in parts if start <= a and b <= end and b - a < end - start]
        if inner and not _whole(data, start, end):
            parts[i] = start, end, {k: d for k, d in kinds.items() if not any(k in x for x in inner)}
    told: dict[str, int] = {}
    for start, end, kinds in sorted(parts, key=lambda p: (p[0], -p[1])):
        kinds = {k: d for k, d in kinds.items() if told.get(k, 0) < end}    # not again within a part that has it
        told.update(dict.fromkeys(kinds, end))
        if kinds:
            yield start, _PAD.match(data, end).end(), kinds


def scan_text(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, depth) of every secret; a span found again deeper is given once, at its least depth."""
    found: dict[tuple[str, int, int], int] = {}
    work, seen = [(text, None, None, 0)], set()
    while work:
        layer, starts, ends, depth = work.pop(0)
        for kind, a, b in plain_spans(layer):
            span = (kind, a, b) if starts is None else (kind, starts[a], ends[b - 1])
            found[span] = min(found.get(span, depth), depth)

        def fresh(part, a, b):
            mark = (part, a if starts is None else starts[a], b if ends is None else ends[b - 1])
            return not (mark in seen or seen.add(mark))

        def add(decoded, first, last, a, b):
            if not decoded or decoded == layer[a:b]:
                return
            if starts is not None:
                first, last = array("q", (starts[i] for i in first)), array("q", (ends[i - 1] for i in last))
            mark = (decoded, first[0], last[-1])
            if mark not in seen:
                seen.add(mark)
                work.append((decoded, first, last, depth + 1))

        if "%" in layer:
            for a, b in _encoded_words(layer, _URL_CODES, "%"):
                add(*_substituted(layer[a:b], a, _URL_CODES, _url_decoded), a, b)
        if "\\" in layer:
            for a, b in _encoded_words(layer, _ESCAPE, "\\"):
                add(*_substituted(layer[a:b], a, _ESCAPE, _escape_decoded), a, b)
        for a, b, kinds in _base64_kinds(layer, depth + 1, fresh):
            for kind, deep in kinds.items():
                span = (kind, a, b) if starts is None else (kind, starts[a], ends[b - 1])
                found[span] = min(found.get(span, deep), deep)
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(((k, a, b, d) for (k, a, b), d in found.items()), key=lambda s: (s[1], rank[s[0]], s[2]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans of every row, in order of start, kind and end; read where the rows lie."""
    def task(batches):
        for doc, text in rows(batches):
            yield doc, [dict(zip(("kind", "start", "stop", "depth"), s)) for s in scan_text(text)]
    return arrow_map(ids_and_text(docs, id_col, text_col), task, f"doc_id bigint, spans {SPANS}")


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redacted(text: str) -> str:
    """A text with each secret, or run of overlapping ones, replaced by a mark."""
    out, last = [], 0
    for kind, a, b, _ in scan_text(text):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows and columns, with secrets replaced in the text, and a column of lengths set anew where it changed."""
    def task(batches):
        release(None)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                place = part.schema.get_field_index(text_col)
                old = part.column(place).to_pylist()
                new = [t if t is None else redacted(t) for t in old]
                columns = list(part.columns)
                columns[place] = pa.array(new, part.schema.field(place).type)
                if length_col is not None and (k := part.schema.get_field_index(length_col)) >= 0:
                    sizes = [n if a == b else len(b) for n, a, b in zip(columns[k].to_pylist(), old, new)]
                    columns[k] = pa.array(sizes, part.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)
    short_batches(docs.sparkSession)
    return docs.mapInArrow(task, docs.schema)
