"""Media columns: what a value's bytes are, whatever its declared type says, and what media they carry inside.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a value. At each place the format's
validator follows the structure (chunks and their CRCs, boxes, pages, segments, directories) to its end, which gives the
length; what doesn't hold up is no finding. The finding at the value's beginning corrects the declared type; those further
in are carved, outermost first: a finding within a carved one is part of it. Base64 data URIs in text are decoded and sniffed
too, as are those in what they decode to; what is found inside one has the place of its base64 in the value.

Defined results: a null value has one row without detected type; so has an empty one, with length 0. A value that no
signature fits is HTML, SVG or XML by its first tag, after any comments, processing instructions and declarations; else
text/plain if it is UTF-8 without control characters, and else application/octet-stream. FLAC's last frame has no length: it ends
with the value if its checksum does, and else where its checksum first holds. Values of any length are read whole; repeated rows have their own results; other columns don't matter.
"""

from __future__ import annotations

import base64
import binascii
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.common import trim


def _png(d: bytes, a: int) -> int | None:
    at, first = a + 8, True
    while at + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, at)
        if at + 12 + n > len(d) or first and (kind != b"IHDR" or n != 13) or zlib.crc32(d[at + 4:at + 8 + n]) != struct.unpack_from(">I", d, at + 8 + n)[0]:
            return None
        at, first = at + 12 + n, False
        if kind == b"IEND":
            return at - a
    return None


def _jpeg(d: bytes, a: int) -> int | None:
    at, scans = a + 2, 0
    while at + 4 <= len(d):
        if d[at] != 0xFF:
            return None
        kind = d[at + 1]
        if kind == 0xFF:
            at += 1
        elif kind == 0xD9:
            return at + 2 - a if scans else None
        elif kind == 0x01 or 0xD0 <= kind <= 0xD7:
            at += 2
        else:
            n = struct.unpack_from(">H", d, at + 2)[0]
            if kind < 0xC0 or n < 2 or at + 2 + n > len(d):
                return None
            at += 2 + n
            if kind == 0xDA:
                scans += 1
                while True:
                    at = d.find(b"\xff", at)
                    if at < 0 or at + 1 >= len(d):
                        return None
                    if d[at + 1] and not 0xD0 <= d[at + 1] <= 0xD7 and d[at + 1] != 0xFF:
                        break
                    at += 1
    return at + 2 - a if at + 2 <= len(d) and d[at:at + 2] == b"\xff\xd9" and scans else None


def _gif(d: bytes, a: int) -> int | None:
    if a + 13 > len(d):
        return None
    flags = d[a + 10]
    at, images = a + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), 0

    def blocks(at: int) -> int:
        while at < len(d) and d[at]:
            at += d[at] + 1
        return at + 1

    while at < len(d):
        if d[at] == 0x3B:
            return at + 1 - a if images else None
        if d[at] == 0x21:
            at = blocks(at + 2)
        elif d[at] == 0x2C and at + 10 <= len(d):
            flags, images = d[at + 9], images + 1
            at = blocks(at + 10 + (3 << (flags & 7) + 1 if flags & 0x80 else 0) + 1)
        else:
            return None
    return None


def _bmp(d: bytes, a: int) -> int | None:
    if a + 30 > len(d):
        return None
    size, zero, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", d, a + 2)
    ok = header in (40, 52, 56, 108, 124) and not zero and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + header <= offset < size <= len(d) - a and width > 0 and height
    return size if ok and (bits < 16 or (width * bits + 31) // 32 * 4 * abs(height) <= size - offset) else None


def _riff(kinds: dict[bytes, str]) -> Callable:
    def check(d: bytes, a: int) -> tuple[int, str] | None:
        if a + 12 > len(d):
            return None
        n, form = struct.unpack_from("<I4s", d, a + 4)
        end = a + 8 + n
        if form not in kinds or n < 4 or end > len(d):
            return None
        at = a + 12
        while at + 8 <= end:
            k = struct.unpack_from("<I", d, at + 4)[0]
            at += 8 + k + k % 2
        return (min(end + n % 2, len(d)) - a, kinds[form]) if end <= at <= end + 1 and at > a + 12 else None

    return check


def _mp4(d: bytes, a: int) -> int | None:
    known = {b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"uuid", b"moof", b"mfra", b"sidx", b"meta", b"styp", b"pdin"}
    a, seen = a - 4, set()
    if a < 0:
        return None
    at = a
    while at + 8 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, at)
        if kind not in known:
            break
        if n == 1 and at + 16 <= len(d):
            n = struct.unpack_from(">Q", d, at + 8)[0]
        elif n == 0:
            n = len(d) - at
        if n < 8 or at + n > len(d):
            return None
        seen.add(kind)
        at += n
    return at - a if seen & {b"moov", b"moof", b"mdat", b"meta"} else None


def _pdf(d: bytes, a: int) -> int | None:
    if not re.match(rb"%PDF-[12]\.\d", d[a:a + 8]):
        return None
    nxt = d.find(b"%PDF-", a + 5)
    end = d.rfind(b"%%EOF", a, nxt if nxt > 0 else len(d))
    if end < 0 or b"startxref" not in d[a:end]:
        return None
    end += 5
    while end < len(d) and d[end] in b"\r\n":
        end += 1
    return end - a


def _zip_ends(d: bytes) -> dict[int, int]:
    """For each place at which an archive begins, its end: that of the first end record whose directory is where it says."""
    out, at = {}, -1
    while (at := d.find(b"PK\x05\x06", at + 1)) >= 0 and at + 22 <= len(d):
        total, size, offset, note = struct.unpack_from("<HIIH", d, at + 10)
        a = at - size - offset
        if a >= 0 and total and d[a + offset:a + offset + 4] == b"PK\x01\x02" and at + 22 + note <= len(d):
            out.setdefault(a, at + 22 + note)
    return out


def _zip(d: bytes, a: int, ends: dict[int, int] | None = None) -> int | None:
    end = (_zip_ends(d) if ends is None else ends).get(a)
    return None if end is None else end - a


def _gzip(d: bytes, a: int) -> int | None:
    if a + 18 > len(d) or d[a + 3] & 0xE0:
        return None
    z, at = zlib.decompressobj(31), a
    try:
        while not z.eof:
            part = d[at:at + 65536]
            if not part:
                return None
            z.decompress(part)
            at += len(part)
    except zlib.error:
        return None
    return at - len(z.unused_data) - a


def _mp3(d: bytes, a: int) -> int | None:
    if a + 10 > len(d) or any(x & 0x80 for x in d[a + 6:a + 10]) or d[a + 3] > 4:
        return None
    at = a + 10 + (d[a + 6] << 21 | d[a + 7] << 14 | d[a + 8] << 7 | d[a + 9])
    rates, frames = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 0
    while at + 4 <= len(d) and d[at] == 0xFF and d[at + 1] & 0xFE == 0xFA:
        b, s = d[at + 2] >> 4, d[at + 2] >> 2 & 3
        if not 0 < b < 15 or s == 3:
            break
        at += 144000 * rates[b] // (44100, 48000, 32000)[s] + (d[at + 2] >> 1 & 1)
        frames += 1
    return min(at, len(d)) - a if frames else None


def _ogg(d: bytes, a: int) -> int | None:
    at, pages, last = a, 0, False
    while at + 27 <= len(d) and d[at:at + 5] == b"OggS\0" and not last:
        k = d[at + 26]
        if at + 27 + k > len(d):
            break
        n = 27 + k + sum(d[at + 27:at + 27 + k])
        if at + n > len(d) or not pages and not d[at + 5] & 2:
            return None
        last, at, pages = bool(d[at + 5] & 4), at + n, pages + 1
    return at - a if pages else None


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for k in range(256):
        k <<= bits - 8
        for _ in range(8):
            k = (k << 1 ^ poly if k >> bits - 1 else k << 1) & (1 << bits) - 1
        out.append(k)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_frame(d: bytes, a: int) -> tuple[int, int, int] | None:
    """(number, samples, length of the header) of the frame that begins at a, if its header's checksum holds; the number is of the
    frame, or of its first sample."""
    if a + 6 > len(d) or d[a] != 0xFF or d[a + 1] & 0xFE != 0xF8 or d[a + 3] & 1:
        return None
    block, rate, lead = d[a + 2] >> 4, d[a + 2] & 15, d[a + 4]
    more = 0 if lead < 0x80 else next((k for k, x in enumerate((0xE0, 0xF0, 0xF8, 0xFC, 0xFE, 0xFF), 1) if lead < x), 6)
    if not block or rate == 15 or 0x80 <= lead < 0xC0 or lead == 0xFF or (d[a + 3] >> 4) > 10:
        return None
    number, at = lead & (0x7F if not more else 0x3F >> more), a + 5
    for x in d[at:at + more]:
        number = number << 6 | x & 0x3F
    at += more
    size = {1: 192, **{k: 576 << k - 2 for k in range(2, 6)}, **{k: 256 << k - 8 for k in range(8, 16)}}.get(block)
    if size is None:
        n = 1 if block == 6 else 2
        size = int.from_bytes(d[at:at + n], "big") + 1
        at += n
    at += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if at >= len(d):
        return None
    crc = 0
    for x in d[a:at]:
        crc = _CRC8[crc ^ x]
    return (number, size, at + 1 - a) if crc == d[at] else None


def _flac(d: bytes, a: int) -> int | None:
    at, first, total, least = a + 4, True, 0, 0
    while True:
        if at + 4 > len(d):
            return None
        kind, n = d[at], int.from_bytes(d[at + 1:at + 4], "big")
        if first and (kind & 0x7F or n != 34) or at + 4 + n > len(d):
            return None
        if first:
            least, total = int.from_bytes(d[at + 8:at + 11], "big"), int.from_bytes(d[at + 17:at + 22], "big") & (1 << 36) - 1
        at, first = at + 4 + n, False
        if kind & 0x80:
            break
    head = _flac_frame(d, at)
    if head is None:
        return None
    seen, by_sample = head[1], d[at + 1] & 1
    while not total or seen < total:
        # The next frame is where a header says that it is: by number, or by its first sample.
        want, k = seen if by_sample else head[0] + 1, at + max(head[2], least)
        while (k := d.find(d[at:at + 2], k)) >= 0:
            nxt = _flac_frame(d, k)
            if nxt and nxt[0] == want:
                break
            k += 1
        if k < 0:
            break
        at, head, seen = k, nxt, seen + nxt[1]
    crc, end = 0, None
    for k in range(at, len(d)):
        crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ d[k]]
        if not crc and k + 1 - at >= max(head[2] + 2, least):
            end = k + 1 if end is None or k + 1 == len(d) else end
    return None if end is None else end - a


def _tiff(d: bytes, a: int) -> int | None:
    o = "<" if d[a:a + 2] == b"II" else ">"
    sizes, end, seen = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}, 8, set()
    if a + 8 > len(d):
        return None
    at = struct.unpack_from(o + "I", d, a + 4)[0]
    while at:
        if at in seen or at < 8 or a + at + 2 > len(d):
            return None
        seen.add(at)
        n = struct.unpack_from(o + "H", d, a + at)[0]
        if not n or a + at + 6 + 12 * n > len(d):
            return None
        strips: dict[int, list[int]] = {}
        for k in range(n):
            tag, kind, count, value = struct.unpack_from(o + "HHII", d, a + at + 2 + 12 * k)
            if kind not in sizes:
                return None
            size = sizes[kind] * count
            where = value if size > 4 else at + 10 + 12 * k
            if a + where + size > len(d):
                return None
            end = max(end, where + size)
            if tag in (273, 279, 324, 325) and kind in (3, 4):
                strips[tag] = list(struct.unpack_from(f"{o}{count}{'H' if kind == 3 else 'I'}", d, a + where))
        for x, y in ((273, 279), (324, 325)):
            for offset, size in zip(strips.get(x, []), strips.get(y, [])):
                if a + offset + size > len(d):
                    return None
                end = max(end, offset + size)
        end = max(end, at + 6 + 12 * n)
        at = struct.unpack_from(o + "I", d, a + at + 2 + 12 * n)[0]
    return end if seen else None


#: magic bytes: (type, validator). A validator gives the length, or the length and the type, or None.
FORMATS: dict[bytes, tuple[str, Callable]] = {
    b"\x89PNG\r\n\x1a\n": ("image/png", _png), b"\xff\xd8\xff": ("image/jpeg", _jpeg), b"GIF87a": ("image/gif", _gif), b"GIF89a": ("image/gif", _gif), b"BM": ("image/bmp", _bmp),
    b"RIFF": ("", _riff({b"WEBP": "image/webp", b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo"})), b"ftyp": ("video/mp4", _mp4), b"%PDF-": ("application/pdf", _pdf), b"PK\x03\x04": ("application/zip", _zip),
    b"\x1f\x8b\x08": ("application/gzip", _gzip), b"ID3": ("audio/mpeg", _mp3), b"OggS": ("audio/ogg", _ogg), b"fLaC": ("audio/flac", _flac), b"II*\0": ("image/tiff", _tiff), b"MM\0*": ("image/tiff", _tiff),
}
_URI = re.compile(r"data:([\w.+/-]*)(?:;[\w.+=-]+)*;base64,\s*([A-Za-z0-9+/\s]{8,}={0,2})", re.I)
_CONTROL = re.compile("[\x00-\x08\x0e-\x1a\x1c-\x1f\x7f]")
ALIASES = {"image/jpg": "image/jpeg", "image/pjpeg": "image/jpeg", "audio/x-wav": "audio/wav", "audio/wave": "audio/wav", "audio/mp3": "audio/mpeg", "application/x-gzip": "application/gzip", "image/x-ms-bmp": "image/bmp", "application/x-zip-compressed": "application/zip", "application/xhtml+xml": "text/html", "video/avi": "video/x-msvideo", "image/x-png": "image/png"}


def automaton() -> ahocorasick.Automaton:
    """All magic bytes, as Latin-1 characters, and the mark of a data URI."""
    a = ahocorasick.Automaton()
    for m in (*FORMATS, b";base64,"):
        a.add_word(m.decode("latin-1"), m)
    a.make_automaton()
    return a


_BLANK, _TAG, _NAME = re.compile(rb"\s*"), re.compile(rb"<(?:[A-Za-z][\w.-]*:)?([A-Za-z][A-Za-z0-9]*)(?=[\s/>])"), re.compile(rb"<!doctype\s+([A-Za-z]+)", re.I)
_HTML = set(b"html head body title script style iframe div font table a b p br h1 h2 h3 h4 h5 h6 meta link span ul ol img article section main header footer nav form".split())


def text_type(data: bytes) -> str:
    """The type of what no signature fits."""
    at, xml = 3 * data.startswith(b"\xef\xbb\xbf"), False
    while True:
        at = _BLANK.match(data, at).end()
        if data.startswith((b"<!--", b"<?"), at):
            end = data.find(b"-->" if data.startswith(b"<!--", at) else b"?>", at + 2)
            if end < 0:
                break
            xml |= data[at:at + 5].lower() == b"<?xml"
            at = end + (3 if data.startswith(b"<!--", at) else 2)
        elif m := _NAME.match(data, at):
            if m.group(1).lower() in (b"html", b"svg"):
                return "text/html" if m.group(1).lower() == b"html" else "image/svg+xml"
            xml, end = True, data.find(b">", m.end())
            inner = data.find(b"[", m.end(), max(end, m.end()))
            end = data.find(b"]>", inner) + 1 if inner >= 0 else end
            if end <= 0:
                break
            at = end + 1
        else:
            break
    if m := _TAG.match(data, at):
        tag = m.group(1).lower()
        if tag == b"svg":
            return "image/svg+xml"
        if tag in _HTML and (not xml or tag == b"html"):
            return "text/html"
    if xml:
        return "text/xml"
    try:
        return "application/octet-stream" if _CONTROL.search(data.decode()) else "text/plain"
    except UnicodeDecodeError:
        return "application/octet-stream"


def findings(data: bytes, magic: ahocorasick.Automaton) -> list[tuple[int, int, str, str | None]]:
    """(offset, length, type, declared) of what is in a value: first the value itself, then what is carved, by place."""
    main, inner, taken, uris, ends = None, [], 0, False, None
    for end, m in magic.iter(data.decode("latin-1")):
        at = end + 1 - len(m)
        if m == b";base64,":
            uris = True
            continue
        if at < taken:
            continue
        kind, check = FORMATS[m]
        if check is _zip:
            ends = _zip_ends(data) if ends is None else ends
            got = _zip(data, at, ends)
        else:
            got = check(data, at)
        if got is None:
            continue
        n, kind = got if isinstance(got, tuple) else (got, kind)
        at -= 4 * (m == b"ftyp")
        if at == 0 and main is None:
            main = (0, n, kind, None)
        else:
            inner.append((at, n, kind, None))
            taken = at + n
    if uris:
        text = data.decode("latin-1")
        for u in _URI.finditer(text):
            body = re.sub(r"\s+", "", u.group(2)).rstrip("=")
            try:
                raw = base64.b64decode(body + "=" * (-len(body) % 4))
            except (binascii.Error, ValueError):
                continue
            # Each level is a quarter shorter, so this ends.
            for k, (_, _, kind, own) in enumerate(findings(raw, magic)):
                inner.append((u.start(2), u.end(2) - u.start(2), kind, own if k else u.group(1).lower() or "text/plain"))
    return [main or (0, len(data), text_type(data), None), *sorted(inner, key=lambda x: x[:2])]


def sniff_media(table: DataFrame, id_column: str, content: str, declared: str | None = None) -> DataFrame:
    """(id, offset, length, declared, detected, corrected, embedded): a row for each value and for each medium carved from it.

    Values travel in batches of as many rows as spark.sql.execution.arrow.maxRecordsPerBatch says, and are taken one at a time.

    content: a binary or string column; declared: a column of media types, if there is one. corrected: a type was declared, and
    it isn't the detected one, however it is spelt. No shuffle.
    """
    kind = table.select(F.col(f"`{id_column}`").alias("id")).schema["id"].dataType.simpleString()
    x = table.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{content}`").cast("binary").alias("content"), (F.lower(F.trim(F.substring_index(F.col(f"`{declared}`").cast("string"), ";", 1))) if declared else F.lit(None).cast("string")).alias("declared"))
    schema = f"id {kind}, offset bigint, length bigint, declared string, detected string, corrected boolean, embedded boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magic = automaton()
        for batch in batches:
            whose, rows = [], []
            for i in range(len(batch)):
                data, said = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                if data is None:
                    whose.append(i), rows.append((None, None, said, None, None, False))
                    continue
                for k, (at, n, kind, own) in enumerate(findings(data, magic) if data else [(0, 0, None, None)]):
                    told = own if k else said
                    rows.append((at, n, told, kind, None if told is None or kind is None else ALIASES.get(told, told) != kind, k > 0))
                    whose.append(i)
            cols = list(zip(*rows)) if rows else [()] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], ["id", "offset", "length", "declared", "detected", "corrected", "embedded"])
            del batch
            trim()

    return x.mapInArrow(run, schema)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; its address' ending is what it declares, HTML where it has none."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ending = F.lower(F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), r"^[a-z]+://[^/]+/.*\.([A-Za-z0-9]{1,5})$", 1))
    kinds = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "pdf": "application/pdf", "svg": "image/svg+xml", "xml": "text/xml", "txt": "text/plain", "zip": "application/zip", "mp4": "video/mp4", "mp3": "audio/mpeg", "webp": "image/webp"}
    told = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), ending), F.lit("text/html"))
    return sniff_media(pages.withColumn("declared", told), "page_id", "html", "declared").withColumnRenamed("id", "page_id")


QUERIES = {"op5_media": op5_media}
ORACLES: dict[str, str] = {}
