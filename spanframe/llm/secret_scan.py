"""Secret scans through nested encodings.

A worklist begins with a document's text. A layer is scanned by the rules; then each encoded run in it (URL escapes,
Unicode escapes and character references, base64, and what is compressed within any of them, all its members) is decoded to a layer of its own
and put on the list, until nothing new comes. A layer that was there before, by its digest and by where each character comes from,
isn't taken again, so cycles end; the same text from another place is a layer of its own, with findings of its own.
Every character of a layer knows the piece of the original text it comes from, so a finding in any depth has a span there.

A run of base64 symbols is decoded from each of its first four symbols on, as what stands before it (a path, a name) may end
in symbols too. Bytes that aren't all text are a layer if any SHORTEST characters in a row are: no rule fits fewer, in
whatever encoding. UTF-16 within bytes is one too. Base64 in lines of under 60 symbols is one run a line.

Defined results: null and empty texts have no findings; the same secret found through several layers at the same span is
one finding, with the shallowest path; rows that repeat are each scanned. A compressed layer that would grow beyond
max_layer is reported under the rule 'oversized_layer' over its whole span, so it isn't passed over in silence.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import math
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.common import text_bytes, text_chunks, trim

MAX_LAYER = 64 << 20
#: Characters that a finding has at least: a://b:cde@ without the part before the scheme's last letter.
SHORTEST = 10
#: Shortest run of base64 symbols that is tried: 14 of them hold 10 bytes.
MIN_BASE64 = 14
#: Compressed layers within each other that are opened without a text between them; more are reported as oversized.
MAX_DEPTH = 100
#: Bits a character that an assigned value must have.
MIN_ENTROPY = 2.5

#: (name, words of which a text must have one, pattern); the group 1, if any, is the secret.
RULES = [
    ("aws_access_key", ("AKIA", "ASIA"), re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])")),
    ("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})")),
    ("slack_token", ("xox",), re.compile(r"(?<![A-Za-z0-9])xox[abeprs]-[A-Za-z0-9-]{10,}")),
    ("google_api_key", ("AIza",), re.compile(r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{35}")),
    ("stripe_key", ("k_live_", "k_test_"), re.compile(r"(?<![A-Za-z0-9])[rs]k_(?:live|test)_[0-9A-Za-z]{16,}")),
    ("jwt", ("eyJ",), re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("private_key", ("PRIVATE KEY",), re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----(?:[\s\S]*?-----END (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----)?")),
    ("url_password", ("://",), re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]{0,30}://[^\s:/@]{1,256}:([^\s:/@]{3,256})@")),
    ("assigned", ("token", "secret", "passw", "pwd", "key", "credential", "bearer", "authorization"), re.compile(r"(?i)(?<![a-z0-9])(?:[a-z0-9]{1,32}[_.-]){0,4}(?:token|secret|password|passwd|passwort|pwd|api[_-]?key|apikey|access[_-]?key|secret[_-]?key|auth[_-]?key|credential|bearer)(?:[_-][a-z0-9]{1,32}){0,3}[\"']?(?:\s{0,8}(?:=>|:=|[:=])\s{0,8}|\s+)[\"']?([A-Za-z0-9+/_.~=-]{12,})")),
]
_LOW = {"assigned"}
_PERCENT = re.compile(r"[^\s\"'<>]*%[0-9A-Fa-f]{2}[^\s\"'<>]*")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{60,}\r?\n)*[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_BASE64)
_TEXTUAL = re.compile("[^\t\n\r\x20-\x7e\u00a0-\ud7ff\ue000-\U0010ffff]")


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values())


def _matches(text: str) -> Iterator[tuple[str, int, int]]:
    low = None
    for name, words, pattern in RULES:
        where = text
        if name in _LOW:
            low = text.lower() if low is None else low
            where = low
        if any(w in where for w in words):
            for m in pattern.finditer(text):
                g = 1 if pattern.groups and m.group(1) is not None else 0
                if name == "assigned" and not _plausible(m):
                    continue
                yield name, *m.span(g)


def _plausible(m: re.Match) -> bool:
    """Whether an assigned value looks drawn at random rather than written: it has digits, or both cases inside, and enough entropy."""
    v = m.group(1)
    joint = m.string[m.end(0) - len(v) - 2:m.start(1)]
    told = "=" in joint or ":" in joint
    mixed = any(c.isdigit() for c in v) and (any(c.isalpha() for c in v) or len(v) >= 16)
    cases = sum(a.islower() and b.isupper() for a, b in zip(v, v[1:])) >= 2
    return (mixed or told and cases) and _entropy(v) >= MIN_ENTROPY


_MAGIC = re.compile(rb"\A[\x08\x18\x28\x38\x48\x58\x68\x78]|\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\0|\x5d\0\0|\x28\xb5\x2f\xfd")
_ERRORS = (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError)


def _kind(head: bytes) -> tuple[str, object] | None:
    if head[:2] == b"\x1f\x8b":
        return "gzip", lambda: zlib.decompressobj(31)
    if len(head) > 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0:
        return "zlib", zlib.decompressobj
    if head[:3] == b"BZh":
        return "bz2", bz2.BZ2Decompressor
    if head[:6] == b"\xfd7zXZ\0" or head[:3] == b"\x5d\0\0":
        return "xz", lzma.LZMADecompressor
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd", lambda: zstandard.ZstdDecompressor().decompressobj()
    return None


def _inflate(data: bytes, limit: int) -> tuple[str, bytes, int] | None:
    """(kind, content, bytes read) of compressed data, all members one after another; content is longer than limit where it
    would be. None: not compressed, or broken in its first member; of one broken later, the members before it."""
    view, at, out, size, first = memoryview(data), 0, [], 0, None
    while size <= limit and (found := _kind(bytes(view[at:at + 6]))) and first in (None, found[0]):
        kind, make = found
        d, k, part, room = make(), at, [], limit + 1 - size
        try:
            while k < len(view) and room > 0 and not d.eof:
                # zstd has no limit of its own: so few bytes at once are some megabytes at most.
                x = view[k:k + (256 if kind == "zstd" else 1 << 16)]
                got = d.decompress(x) if kind == "zstd" else d.decompress(x, room)
                k += len(x)
                room -= len(got)
                part.append(got)
        except _ERRORS:
            break
        first = kind
        out += part
        size = limit + 1 - room
        at = k
        if not d.eof:
            break
        at = k - len(d.unused_data)
        while kind in ("gzip", "xz") and at < len(view) and not view[at]:
            at += 1  # padding between members
    return None if first is None else (first, b"".join(out), at)


def _as_text(data: bytes) -> str | None:
    try:
        t = data.decode()
    except UnicodeDecodeError:
        return None
    return t if t and len(_TEXTUAL.findall(t)) * 20 <= len(t) else None


Layer = tuple[str, np.ndarray, np.ndarray, tuple[str, ...]]  # text; where each character begins and ends in the document; path


def _percent(layer: Layer, limit: int) -> Iterator[Layer | tuple[int, int, tuple[str, ...]]]:
    text, start, end, path = layer
    if "%" not in text:
        return
    for m in _PERCENT.finditer(text):
        out, at, marks = bytearray(), m.start(), []
        run = m.group()
        i = 0
        while i < len(run):
            if run[i] == "%" and re.fullmatch(r"[0-9A-Fa-f]{2}", run[i + 1:i + 3]):
                out.append(int(run[i + 1:i + 3], 16))
                marks.append((at + i, at + i + 3))
                i += 3
            else:
                raw = run[i].encode("utf-8", "surrogatepass")
                out += raw
                marks += [(at + i, at + i + 1)] * len(raw)
                i += 1
        yield from _decoded(bytes(out), np.array(marks), layer, ("url",), limit)


_STRETCH = re.compile("[\t\n\r\x20-\x7e\u00a0-\ud7ff\ue000-\U0010ffff]{%d,}" % SHORTEST)
#: What has no such run of bytes has no such text either, and no UTF-16.
_MAYBE = re.compile(rb"[\t\n\r\x20-\x7e\x80-\xf4]{%d,}|(?:[\t\n\r\x20-\x7e]\0){%d,}|(?:\0[\t\n\r\x20-\x7e]){%d,}" % (SHORTEST, SHORTEST, SHORTEST))
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){%d,}|(?:\0[\t\n\r\x20-\x7e]){%d,}" % (SHORTEST, SHORTEST))


def _decoded(data: bytes, marks: np.ndarray, layer: Layer, steps: tuple[str, ...], limit: int, text: bool = True, above: frozenset[bytes] = frozenset()) -> Iterator[Layer | tuple[int, int, tuple[str, ...]]]:
    """Layers of bytes that each come from characters [marks[:, 0], marks[:, 1]) of the layer before: their text, and what is
    compressed in them. text: False leaves out the bytes' own text. above: digests of the compressed contents that these are in."""
    _, start, end, path = layer
    t = _as_text(data)
    if text and t is not None:
        first = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        yield _piece(t, first, np.append(first[1:], len(data)), marks, layer, steps)
    elif text and _MAYBE.search(data):
        # A byte that isn't UTF-8 is one character that no rule takes.
        loose = data.decode("utf-8", "surrogateescape")
        found = list(_STRETCH.finditer(loose))
        if found:
            c = np.frombuffer(loose.encode("utf-32-le", "surrogatepass"), np.uint32)
            size = np.where((c < 0x80) | (c >= 0xDC80) & (c <= 0xDCFF), 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4)))
            stop = np.cumsum(size)
            a, b = found[0].start(), found[-1].end()
            yield _piece(loose[a:b], (stop - size)[a:b], stop[a:b], marks, layer, steps)
        for m in _WIDE.finditer(data):
            first = np.arange(m.start(), m.end(), 2)
            yield _piece(m.group().replace(b"\0", b"").decode(), first, first + 2, marks, layer, (*steps, "utf16"))
    at = 0
    for m in _MAGIC.finditer(data):
        if m.start() < at or t is not None and m.start() and text or not (inner := _inflate(data[m.start():], limit)):
            continue
        kind, got, n = inner
        to, key, way = m.start() + n, hashlib.blake2b(got, digest_size=16).digest(), (*steps, kind)
        a, b = marks[m.start(), 0], marks[to - 1, 1]
        if len(got) > limit or len(above) >= MAX_DEPTH:
            at = to
            yield int(start[a]), int(end[b - 1]), (*path, *way)
        elif key not in above:
            inside = list(_decoded(got, np.broadcast_to((a, b), (len(got), 2)), (layer[0], start, end, path), way, limit, above=above | {key})) if got else []
            # What only looks compressed doesn't hide what follows.
            at = to if inside else at
            yield from inside


def _piece(t: str, first: np.ndarray, stop: np.ndarray, marks: np.ndarray, layer: Layer, steps: tuple[str, ...]) -> Layer:
    """The layer of a text whose characters are in the bytes [first, stop)."""
    _, start, end, path = layer
    return t, start[marks[first, 0]], end[marks[stop - 1, 1] - 1], (*path, *steps)


#: Bytes as escapes and printable characters, as in literals of C, Python and JSON.
_BYTE = re.compile(r"\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|&#x0{0,4}([0-9A-Fa-f]{1,2});|\\([0-3]?[0-7]{1,2})|\\([abfnrtv\\'\"/])|([\x20-\x5b\x5d-\x7e])")
_SINGLE = dict(zip("abfnrtv", b"\a\b\f\n\r\t\v"))


def _byte_escapes(layer: Layer, limit: int) -> Iterator[Layer | tuple[int, int, tuple[str, ...]]]:
    """What is compressed in bytes that are written as escapes; _escapes has the text."""
    text = layer[0]
    if not any(x in text for x in ("\\x", "\\u00", "&#x", "\\0", "\\2", "\\3")):
        return
    out, marks = bytearray(), []
    for m in _BYTE.finditer(text):
        if marks and marks[-1][1] != m.start():
            yield from _decoded(bytes(out), np.array(marks), layer, ("unicode",), limit, text=False)
            out, marks = bytearray(), []
        g = m.group(m.lastindex)
        out.append(int(g, 16) if m.lastindex < 4 else int(g, 8) if m.lastindex == 4 else _SINGLE.get(g, ord(g)) if m.lastindex == 5 else ord(g))
        marks.append(m.span())
    if marks:
        yield from _decoded(bytes(out), np.array(marks), layer, ("unicode",), limit, text=False)


def _escapes(layer: Layer) -> Iterator[Layer]:
    """The whole layer with its escapes replaced: what they stand for may begin or end outside them."""
    text, start, end, path = layer
    if "\\" not in text and "&#" not in text:
        return
    parts, s, e, at = [], [], [], 0
    for m in _ESCAPE.finditer(text):
        k = int(m.group(m.lastindex), 10 if m.lastindex == 6 else 16)
        if k > 0x10FFFF:
            continue
        parts += [text[at:m.start()], chr(k)]
        s += [start[at:m.start()], start[m.start():m.start() + 1]]
        e += [end[at:m.start()], end[m.end() - 1:m.end()]]
        at = m.end()
    if not parts:
        return
    parts.append(text[at:]), s.append(start[at:]), e.append(end[at:])
    t, s, e = "".join(parts), np.concatenate(s), np.concatenate(e)
    if any(0xD800 <= ord(c) < 0xE000 for c in t):
        # Pairs of surrogates are one character; one alone is replaced.
        high = np.array([0xD800 <= ord(c) < 0xDC00 for c in t])
        low = np.array([0xDC00 <= ord(c) < 0xE000 for c in t])
        pair = np.flatnonzero(high[:-1] & low[1:])
        e[pair] = e[pair + 1]
        keep = np.ones(len(t), bool)
        keep[pair + 1] = False
        t = t.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
        s, e = s[keep], e[keep]
    yield t, s, e, (*path, "unicode")


def _base64(layer: Layer, limit: int) -> Iterator[Layer | tuple[int, int, tuple[str, ...]]]:
    text = layer[0]
    for m in _BASE64.finditer(text):
        run = m.group()
        whole = run.replace("\r", "").replace("\n", "").rstrip("=").translate({45: 43, 95: 47})
        sym = None
        for skip in range(4):
            body = whole[skip:]
            if len(body) % 4 == 1:
                body = body[:-1]
            if len(body) < MIN_BASE64:
                break
            data = binascii.a2b_base64(body + "=" * (-len(body) % 4))
            if not _MAYBE.search(data) and not _MAGIC.search(data):
                continue
            if sym is None:
                sym = np.array([i for i, c in enumerate(run) if c not in "\r\n="]) + m.start()
            k = np.arange(len(data))
            # Byte k is in the symbols from 4k/3 to 4k/3 + 1.
            lo = k // 3 * 4 + k % 3 + skip
            yield from _decoded(data, np.stack([sym[lo], sym[np.minimum(lo + 1, len(sym) - 1)] + 1], 1), layer, ("base64",), limit)


def scan(text: str, max_layer: int = MAX_LAYER) -> list[tuple[str, int, int, str, str]]:
    """(rule, start, end, path, secret) of every finding, by position; the path's steps are joined by '>'."""
    at = np.arange(len(text))
    todo, seen, known, found = deque([(text, at, at + 1, ())]), set(), {}, {}
    while todo:
        layer = todo.popleft()
        t, start, end, path = layer
        key = hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if path:
            # A text that comes from one compressed run is in one place however it is cut, so even a layer that holds itself ends.
            place = hashlib.blake2b(np.ascontiguousarray(start), digest_size=16)
            place.update(np.ascontiguousarray(end))
            if (key, place.digest()) in seen:
                continue
            seen.add((key, place.digest()))
        if key not in known:
            known[key] = list(_matches(t))
        for rule, a, b in known[key]:
            found.setdefault((rule, int(start[a:b].min()), int(end[a:b].max()), t[a:b]), path)
        todo.extend(_escapes(layer))
        for x in chain(_percent(layer, max_layer), _byte_escapes(layer, max_layer), _base64(layer, max_layer)):
            if len(x) == 3:
                found.setdefault(("oversized_layer", x[0], x[1], ""), x[2])
            else:
                todo.append(x)
    return sorted((rule, a, b, ">".join(path), secret) for (rule, a, b, secret), path in found.items())


_B64 = np.zeros(256, bool)
_B64[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True


def suspects(texts: pa.Array) -> np.ndarray:
    """Indices of the texts in which scan() can find anything: those with a word of a rule, an escape, or a run of base64 symbols long enough."""
    out = []
    for first, part in text_chunks(texts):
        data, offs = text_bytes(part)
        n = len(part)
        flag = np.zeros(n, bool)
        if len(data):
            inside = _B64[data]
            border = np.zeros(len(data) + 1, bool)
            border[offs] = True
            # A text's end ends a run: one over a border would flag only the texts that hold its ends.
            a = np.flatnonzero(inside & ~(np.concatenate([[False], inside[:-1]]) & ~border[:-1]))
            b = np.flatnonzero(inside & ~(np.concatenate([inside[1:], [False]]) & ~border[1:])) + 1
            at = a[b - a >= MIN_BASE64]
            k = np.flatnonzero(data == 37)
            k = k[k + 2 < len(data)]
            at = np.concatenate([at, k[_HEX[data[k + 1]] & _HEX[data[k + 2]]], np.flatnonzero(data == 92)])
            k = np.flatnonzero(data == 38)
            k = k[k + 1 < len(data)]
            at = np.concatenate([at, k[data[k + 1] == 35]])
            flag[np.searchsorted(offs, at, "right") - 1] = True
        for i in np.flatnonzero(~flag):
            if offs[i + 1] > offs[i]:
                raw = data[offs[i]:offs[i + 1]].tobytes()
                if _any_word(raw):
                    flag[i] = True
        out.append(np.flatnonzero(flag) + first)
    return np.concatenate(out) if out else np.zeros(0, int)


_WORDS = [w.encode() for name, words, _ in RULES if name not in _LOW for w in words]
_LOW_WORDS = [w.encode() for name, words, _ in RULES if name in _LOW for w in words]


def _any_word(raw: bytes) -> bool:
    if any(w in raw for w in _WORDS):
        return True
    low = raw.lower()
    return any(w in low for w in _LOW_WORDS) or (not raw.isascii() and ("ſ" in (t := raw.decode()) or "K" in t or any(w.decode() in t.lower() for w in _LOW_WORDS)))


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_layer: int = MAX_LAYER) -> DataFrame:
    """A row for each finding: doc_id, rule, start_char, end_char (of the document's text), depth, path, and the secret's SHA-256, not the secret."""
    table = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows = []
            for i in suspects(texts):
                for rule, a, b, path, secret in scan(texts[int(i)].as_py(), max_layer):
                    rows.append((ids[int(i)].as_py(), rule, a, b, path.count(">") + 1 if path else 0, path, hashlib.sha256(secret.encode("utf-8", "surrogatepass")).hexdigest()))
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()))], ["doc_id", "rule", "start_char", "end_char", "depth", "path", "sha256"])
            del batch, texts
            trim()

    return table.mapInArrow(run, "doc_id bigint, rule string, start_char int, end_char int, depth int, path string, sha256 string")


def redacted(text: str, max_layer: int = MAX_LAYER) -> str:
    """The text with the span of every finding replaced by [SECRET]; spans that touch are one."""
    out, at, spans = [], 0, []
    for a, b in sorted((a, b) for _, a, b, _, _ in scan(text, max_layer)):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    for a, b in spans:
        out += [text[at:a], "[SECRET]"]
        at = b
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text: str = "text", length: str | None = "n_chars", max_layer: int = MAX_LAYER) -> DataFrame:
    """All rows of docs, the secrets in their texts replaced; length: a column that is set to the new number of characters where a text changed."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            new = {}
            for i in suspects(texts):
                t = texts[int(i)].as_py()
                r = redacted(t, max_layer)
                if r != t:
                    new[int(i)] = r
            yield pa.array([new.get(i) for i in range(len(texts))], pa.string())
            del texts, new
            trim()

    own = F.col(f"`{text}`")
    name = next(n for n in ("new_text" + "_" * k for k in range(99)) if n not in {c.lower() for c in docs.columns})
    x = docs.withColumn(name, F.arrow_udf(run, "string")(own.cast("string")))
    if length and length in docs.columns:
        kind = docs.schema[length].dataType
        x = x.withColumn(length, F.when(F.col(f"`{name}`").isNotNull(), F.length(F.col(f"`{name}`")).cast(kind)).otherwise(F.col(f"`{length}`")))
    return x.withColumn(text, F.coalesce(F.col(f"`{name}`"), own)).drop(name).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_secret_scan": op9_secret_scan}
ORACLES: dict[str, str] = {}
