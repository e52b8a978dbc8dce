import base64
import bz2
import gzip
import hashlib
import io
import random
import re
import struct
import time
import urllib.parse
import wave
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spanframe.llm import ann as A
from spanframe.llm import media as M
from spanframe.llm import secret_scan as S

KEY = "ghp_aB3dE5gH7jK9mN1pQ3rS5tU7vW9xY1zA3bC5dE"
b64 = lambda s: base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()
LAYERS = {
    "": lambda s: s, "url": lambda s: "".join(f"%{x:02x}" for x in s.encode()), "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s), "base64": lambda s: b64("some words before " + s + " and after"),
    "base64>gzip": lambda s: b64(gzip.compress(s.encode())), "base64>zlib": lambda s: b64(zlib.compress(s.encode())), "base64>bz2": lambda s: b64(bz2.compress(s.encode())),
}


@pytest.mark.parametrize("outer", LAYERS)
@pytest.mark.parametrize("inner", LAYERS)
def test_nested_layers(outer, inner):
    text = "é 😀 lead " + LAYERS[outer](LAYERS[inner](KEY)) + " tail"
    found = [f for f in S.scan(text) if f[0] == "github_token"]
    assert found and all(f[4] == KEY for f in found)
    a, b = found[0][1:3]
    assert 9 <= a < b <= len(text) - 5
    assert KEY not in S.redacted(text) and [f for f in S.scan(S.redacted(text)) if f[4] == KEY] == []
    assert list(S.suspects(pa.array([text]))) == [0]
    path = ">".join(x for x in (outer, inner) if x)
    assert found[0][3] == path


def test_spans_are_tight():
    text = "x " + urllib.parse.quote("k: '" + KEY + "'", safe="").replace("g", "%67") + " y"
    (f,) = [f for f in S.scan(text) if f[0] == "github_token"]
    assert urllib.parse.unquote(text[f[1]:f[2]]) == KEY


def test_cycles_and_bombs_end():
    assert S.scan("%2525252525252525") == []
    bomb = b64(gzip.compress(b"a" * 100_000))
    assert [f[0] for f in S.scan("x " + bomb, max_layer=1000)] == ["oversized_layer"]


@pytest.mark.parametrize("layer", [x for x in LAYERS if x])
def test_each_copy_of_an_encoded_secret_is_found(layer):
    blob = LAYERS[layer](KEY)
    text = f"a: {blob}\nb: {blob}\nc: {blob} end"
    spans = {f[1:3] for f in S.scan(text) if f[0] == "github_token"}
    assert len(spans) == 3 and all(any(m <= a < b <= m + len(blob) for a, b in spans) for m in (3, 7 + len(blob), 11 + 2 * len(blob)))
    assert all(f[4] != KEY for f in S.scan(S.redacted(text)))


def test_a_secret_encoded_two_ways_is_found_in_both_places():
    text = f"{LAYERS['base64>gzip'](KEY)} and {LAYERS['base64>zlib'](KEY)} and {LAYERS['url'](KEY)} and {b64(KEY)}"
    assert len({f[1:3] for f in S.scan(text) if f[0] == "github_token"}) == 4
    assert all(f[4] != KEY for f in S.scan(S.redacted(text)))


PACK = {"gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "xz": S.lzma.compress, "zstd": lambda d: S.zstandard.ZstdCompressor().compress(d)}
BYTES = {"base64": b64, "url": lambda d: "data=" + "".join(f"%{x:02x}" for x in d), "quoted": urllib.parse.quote, "python": repr, "hex": lambda d: "".join(f"\\x{x:02x}" for x in d)}


@pytest.mark.parametrize("pack", PACK)
@pytest.mark.parametrize("written", BYTES)
def test_later_members_and_compressed_bytes_of_any_layer(pack, written):
    data = PACK[pack](b"first part, no more than words ") + PACK[pack](b"and then ") + PACK[pack](KEY.encode())
    text = "lead " + BYTES[written](data) + " tail"
    assert [f for f in S.scan(text) if f[0] == "github_token" and f[4] == KEY]
    assert all(f[4] != KEY for f in S.scan(S.redacted(text)))


def brute(text, depth=0):
    """Secrets by decoding everything from everywhere, without spans, worklist, magic bytes or prefilter."""
    found = {t[2] for t in ((r, None, text[a:b]) for r, a, b in S._matches(text))}
    if depth > 5:
        return found
    blobs = [urllib.parse.unquote_to_bytes(w) for w in re.split("[\\s\"'<>]+", text) if "%" in w]
    for run in re.findall("[A-Za-z0-9+/_-]{14,}", text):
        for k in range(min(4, len(run))):
            body = run[k:].replace("-", "+").replace("_", "/")
            body = body[:-1] if len(body) % 4 == 1 else body
            blobs.append(base64.b64decode(body + "=" * (-len(body) % 4)))
    texts = [re.sub(r"\\u([0-9A-Fa-f]{4})|&#([0-9]{1,7});", lambda m: chr(int(m[1], 16) if m[1] else int(m[2])), text)]
    for blob in blobs:
        texts += [blob.decode(errors="replace"), blob.replace(b"\0", b"").decode(errors="replace")]
        for i in range(len(blob)) if len(blob) < 3000 else ():
            for z in (zlib.decompressobj(31), zlib.decompressobj(15), bz2.BZ2Decompressor()):
                try:
                    more = z.decompress(blob[i:])
                except (zlib.error, OSError, ValueError):
                    continue
                texts += [base64.b64encode(more).decode(), more.decode(errors="replace")] if len(more) >= 10 else []
    for t in texts:
        if t != text and len(t) >= 10 and re.search("[ -~]{10}", t):
            found |= brute(t, depth + 1)
    return found


WRAPS = [
    lambda r, s: "https://host/download/" + b64(s), lambda r, s: "/data/x" + b64(s) + "/tail", lambda r, s: "k" * r.randrange(4) + b64(s), lambda r, s: b64(s.encode("utf-16")), lambda r, s: b64(s.encode("utf-16-be")),
    lambda r, s: b64(bytes([0, 255, 1, 254] * r.randrange(1, 9)) + s.encode() + b"\xff\0"), lambda r, s: "a%FFb%20" + s.replace("g", "%67"), lambda r, s: b64(gzip.compress(b"\0\xff" * 20 + b" " + s.encode())),
    lambda r, s: b64(gzip.compress(b"head ") + gzip.compress(s.encode())), lambda r, s: "".join(f"\\u{ord(c):04x}" for c in s), lambda r, s: urllib.parse.quote(s, safe="").replace("p", "%70"), lambda r, s: b64(b"\0\1" + gzip.compress(b"\0" + zlib.compress(s.encode()))),
]


@pytest.mark.parametrize("seed", range(24))
def test_scan_finds_what_brute_force_decoding_finds(seed):
    r = random.Random(seed)
    key = "ghp_" + "".join(r.choice("abcdefgh0123456789XYZ") for _ in range(36))
    text = key
    for _ in range(r.randrange(1, 3)):
        text = r.choice(WRAPS)(r, "say " + text + " end")
    text = f"intro {text} middle {text} outro"
    got = {f[4] for f in S.scan(text)}
    assert key in got and got == brute(text)
    assert key not in brute(S.redacted(text)) and S.suspects(pa.array(["", text])).tolist() == [1]


def test_registered_query_finds_what_brute_force_finds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {}
    for f in S.op9_secret_scan(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(f.doc_id, set()).add(f.sha256)
    want = {}
    for d in docs:
        if d.text and (found := brute(d.text)):
            want.setdefault(d.doc_id, set()).update(hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in found)
    assert got == want and got


def test_compressed_data_without_end_is_reported():
    data = b"hi"
    for _ in range(S.MAX_DEPTH + 5):
        data = gzip.compress(data)
    assert [f[0] for f in S.scan(b64(data))] == ["oversized_layer"]


def test_plain_words_are_no_secrets():
    assert S.scan("the token of appreciation, password protected; keyboard internationalization responsibilities secretarial") == []


def test_suspects_miss_nothing():
    r = random.Random(1)
    texts = ["".join(r.choice(["token", " ", "=", "A", "b", "9", "%41", "\\u0041", "&#65;", "AKIA", "é"]) for _ in range(r.randrange(60))) for _ in range(400)]
    hit = {i for i, t in enumerate(texts) if S.scan(t)}
    assert hit <= set(S.suspects(pa.array(texts)).tolist())


def test_a_text_of_base64_symbols_alone_is_a_suspect_between_words():
    blob = b64("key " + KEY).rstrip("=")
    for texts in (["word", blob, "word"], ["word", None, blob, "", "word"], ["a b", blob, "c d"], [blob, blob, blob], ["x" * 13, "y"]):
        want = [i for i, t in enumerate(texts) if t == blob]
        assert S.suspects(pa.array(texts)).tolist() == want and all(S.scan(texts[i]) for i in want)
        assert S.suspects(pa.array(["zz", *texts]).slice(1)).tolist() == want


def test_secret_table(nasty, spark):
    assert S.secret_scan(nasty).count() == 0 and S.secret_scan(nasty.limit(0)).count() == 0
    x = spark.createDataFrame([(None, f"a {KEY}"), (1, f"a {KEY}"), (1, f"a {KEY}"), (2, None)], "doc_id int, text string")
    assert sorted((r.doc_id or 0, r.start_char, r.end_char, r.depth) for r in S.secret_scan(x).collect()) == [(0, 2, 44, 0), (1, 2, 44, 0), (1, 2, 44, 0)]
    y = S.redact_secrets(nasty)
    assert y.columns == nasty.columns and sorted(y.collect(), key=str) == sorted(nasty.collect(), key=str)


def png(n=3):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", n, n, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (n * n + n))) + chunk(b"IEND", b"")


def wav():
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(b"\1\2" * 50)
    return f.getvalue()


def zipped():
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("a.txt", "hello"), z.writestr("b.txt", "world" * 50)
    return f.getvalue()


GIF = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff!\xf9\4\0\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0" + b"\xff\xda\0\x08\1\1\0\0\x3f\0" + b"\x12\xff\0\x34\xff\xd0\x56" + b"\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj<<>>endobj\nxref\n0 1\ntrailer<<>>\nstartxref\n9\n%%EOF\n"
MP4 = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 12, b"moov") + b"abcd" + struct.pack(">I4s", 20, b"mdat") + b"x" * 12
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + 16, 0, 54, 40, 2, 2, 1, 24, 0, 16, 0, 0, 0, 0) + b"p" * 16
TIFF = b"II*\0" + struct.pack("<IHHHII", 8, 1, 256, 3, 1, 5) + struct.pack("<I", 0)
OGG = b"OggS\0\6" + b"\0" * 20 + b"\1\5hello"
MEDIA = {"image/png": png(), "audio/wav": wav(), "application/zip": zipped(), "image/gif": GIF, "image/jpeg": JPEG, "application/pdf": PDF, "video/mp4": MP4, "image/bmp": BMP, "image/tiff": TIFF, "audio/ogg": OGG, "application/gzip": gzip.compress(b"hello" * 20)}


def flac(frames=3, extra=b""):
    """A FLAC stream of constant subframes: header, 8 bits of silence and the checksum."""
    total = 192 * frames
    info = struct.pack(">HH", 192, 192) + b"\0" * 6 + ((44100 << 44) | (0 << 41) | (15 << 36) | total).to_bytes(8, "big") + b"\0" * 16
    out = b"fLaC\x80" + (34).to_bytes(3, "big") + info
    for k in range(frames):
        head = bytes([0xFF, 0xF8, 0x19, 0x08, k])
        crc = 0
        for x in head:
            crc = M._CRC8[crc ^ x]
        frame, crc16 = head + bytes([crc]) + b"\0\0" + bytes([k]), 0
        for x in frame:
            crc16 = (crc16 << 8 & 0xFFFF) ^ M._CRC16[crc16 >> 8 ^ x]
        out += frame + crc16.to_bytes(2, "big")
    return out + extra


MEDIA["audio/flac"] = flac()


def test_text_types_are_sniffed_whole():
    long = b"<!-- " + b"x" * 5000 + b" -->"
    for text, kind in [
        (b"<?xml version='1.0'?>" + long + b"<svg xmlns='a'/>", "image/svg+xml"), (long + b"<html>", "text/html"), (b" \n<!-- hello --><html>", "text/html"), (b"\xef\xbb\xbf<!DOCTYPE html><p>", "text/html"), (b"<?xml?><!DOCTYPE note [<!ENTITY a 'b>'>]><note/>", "text/xml"),
        (b"<?xml version='1.0'?><html>", "text/html"), (b"<?xml?><note>", "text/xml"), (b"<div>x</div>", "text/html"), (b"a <svg> later", "text/plain"), (b"<!-- never closed", "text/plain"), (b"<unknown>", "text/plain"), (b"\0\1", "application/octet-stream"),
    ]:
        assert M.text_type(text) == kind, text


def test_media_within_data_uris_within_data_uris():
    inner = b"<svg><image href='data:image/jpeg;base64," + base64.b64encode(png()) + b"'/></svg>"
    value = b"<html><img src='data:text/plain;base64," + base64.b64encode(inner) + b"'></html>"
    got = M.findings(value, M.automaton())
    assert [(k, d) for _, _, k, d in got] == [("text/html", None), ("image/svg+xml", "text/plain"), ("image/png", "image/jpeg")]
    assert got[1][:2] == got[2][:2] and base64.b64decode(value[got[1][0]:got[1][0] + got[1][1]]) == inner


def test_many_headers_without_end_take_no_time():
    began = time.monotonic()
    assert [f[2] for f in M.findings(b"PK\3\4" * 200_000 + zipped(), M.automaton())][1:] == ["application/zip"]
    assert time.monotonic() - began < 20


def brute_media(data):
    """Every signature tried at every place, without automaton."""
    found, taken = [], 0
    for at in range(len(data)):
        for m, (kind, check) in M.FORMATS.items():
            if at >= taken and data.startswith(m, at) and (got := check(data, at)) is not None:
                n, kind = got if isinstance(got, tuple) else (got, kind)
                a = at - 4 * (m == b"ftyp")
                found.append((a, n, kind))
                taken = a + n if a else taken
    whole = [f for f in found if f[0] == 0][:1] or [(0, len(data), M.text_type(data))]
    return whole + [f for f in found if f[0]]


def test_registered_query_finds_what_brute_force_finds_in_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = {}
    for r in sorted(M.op5_media(spark, "/root/testdata/sf0.001").collect(), key=lambda r: (r.page_id, r.embedded, r.offset)):
        got.setdefault(r.page_id, []).append((r.offset, r.length, r.detected))
    assert got == {i: brute_media(t.encode()) for i, t in pages.items()}
    r = random.Random(4)
    for _ in range(20):
        value = b"".join(r.choice([b"text ", b"\0\1", b"PK\3\4", b"BM", *MEDIA.values()]) for _ in range(r.randrange(1, 8)))
        assert [f[:3] for f in M.findings(value, M.automaton())] == brute_media(value)


@pytest.mark.parametrize("kind", MEDIA)
def test_formats(kind):
    magic, data = M.automaton(), MEDIA[kind]
    assert M.findings(data, magic) == [(0, len(data), kind, None)]
    junk = b"junk \xff" + data + b" more"
    assert M.findings(junk, magic)[1:] == [(6, len(data), kind, None)]
    assert M.findings(data[:-3], magic)[0][2] != kind or kind in ("application/pdf",)
    uri = f'<html><img src="data:image/x-none;base64,{b64(data)}"></html>'.encode()
    assert [f[2:] for f in M.findings(uri, magic)] == [("text/html", None), (kind, "image/x-none")]


def test_broken_structure_is_not_carved():
    bad = bytearray(png())
    bad[20] ^= 1
    assert [f[2] for f in M.findings(b"  " + bytes(bad), M.automaton())] == ["application/octet-stream"]
    assert M.findings(b"RIFF BM ID3 PK\3\4 %PDF-1.4", M.automaton())[1:] == []


def test_carving_keeps_order_and_skips_what_is_inside():
    data = b"\0" + png() + b"xx" + zipped() + GIF
    assert [f[2] for f in M.findings(data, M.automaton())][1:] == ["image/png", "application/zip", "image/gif"]


def test_media_table(spark):
    x = spark.createDataFrame([(1, png(), "image/jpg", "z"), (2, None, "image/png", "z"), (3, b"", None, "z"), (3, b"", None, "z"), (None, b"plain text", "TEXT/plain; charset=x", "z"), (4, JPEG, "image/pjpeg", "z")], "id int, content binary, declared string, offset string")
    out = sorted(((r.id or 0, r.length, r.detected, r.corrected) for r in M.sniff_media(x, "id", "content", "declared").collect()), key=str)
    assert out == sorted([(1, len(png()), "image/png", True), (2, None, None, None), (3, 0, None, None), (3, 0, None, None), (0, 10, "text/plain", False), (4, len(JPEG), "image/jpeg", False)], key=str)
    assert M.sniff_media(x.limit(0), "id", "content", "declared").count() == 0


def test_recall_against_brute_force(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.standard_normal((700, 24)), r.standard_normal((1, 24)) + 0.1 * r.standard_normal((100, 24))]).astype(np.float32)
    out = A.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>"), k=5).collect()
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:5]}
    got = {(q.vec_id, q.neighbor_id) for q in out}
    assert len(want & got) >= 0.9 * len(want)
    for q in out:
        assert abs(q.distance - np.sqrt(d[q.vec_id, q.neighbor_id])) < 1e-4


def test_groups_cut_small_find_the_same(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((300, 8)))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    whole = sorted(A.nearest(table).collect())
    monkeypatch.setattr(A, "SHARD", 40)
    monkeypatch.setattr(A, "SHARDS", 1)
    monkeypatch.setattr(A, "AT_ONCE", 70)
    assert sorted(A.nearest(table).collect()) == whole
    monkeypatch.setattr(A, "SHARD", 7)
    assert sorted(A.nearest(table).collect()) == whole


def test_a_hot_bucket_is_cut_and_finds_the_same(spark, monkeypatch):
    """A third of all vectors are equal, and one row is repeated as often."""
    r = np.random.default_rng(5)
    x = r.standard_normal((400, 6)).astype(np.float32)
    x[:130] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(399, x[399].tolist())] * 200
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    whole = [(r.vec_id, r["rank"], r.distance) for r in sorted(A.nearest(table, k=4).collect())]
    monkeypatch.setattr(A, "SHARD", 30)
    cut = A.nearest(table, k=4).collect()
    assert [(r.vec_id, r["rank"], r.distance) for r in sorted(cut)] == whole
    assert all(r.neighbor_id != r.vec_id for r in cut) and {r.neighbor_id for r in cut if r.vec_id == 7} == {0, 1, 2, 3}


def test_registered_query_asks_every_50th_of_all(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = t["vec_id"].to_numpy(), np.stack(t["embedding"].to_numpy()).astype(np.float64)
    out = A.op3_ann(spark, "/root/testdata/sf0.1").collect()
    asked = ids % A.EVERY == 0
    assert {r.vec_id for r in out} == set(ids[asked].tolist()) and len(out) == A.K * asked.sum()
    d = ((x[asked][:, None] - x[None]) ** 2).sum(2)
    d[ids[asked][:, None] == ids[None]] = np.inf
    want = {(int(i), int(j)) for i, row in zip(ids[asked], d) for j in ids[np.argsort(row, kind="stable")[:A.K]]}
    assert len(want & {(r.vec_id, r.neighbor_id) for r in out}) >= 0.9 * len(want)


def test_probes_are_in_the_order_of_their_chance_and_reach_the_target():
    r = np.random.default_rng(2)
    x = r.standard_normal((2000, 16)).astype(np.float32)
    h = A.Hash(x, 5000, 10, 1, 0.9)
    q, sets = h.probes(x[:50], 0)
    keys = h.visited(x[:50], 0, q, sets)
    assert len(set(zip(q.tolist(), keys.tolist()))) == len(q)
    # Neighbours at distance r fall in the visited buckets about as often as estimated.
    hit = 0
    for i in range(50):
        step = r.standard_normal((200, 16))
        y = x[i] + h.r * step / np.linalg.norm(step, axis=1, keepdims=True)
        hit += np.isin(h.keys(h.cells(y, 0)[0]), keys[q == i]).mean() / 50
    assert hit > 0.86


def test_queries_beyond_the_probes_are_compared_with_all(spark, monkeypatch):
    """As at millions of vectors, the perturbations that are weighed are too few for the chance that is needed."""
    r = np.random.default_rng(3)
    x = r.standard_normal((600, 12)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:5]}
    monkeypatch.setattr(A, "BUCKET", 2)
    monkeypatch.setattr(A, "PROBES", 8)
    monkeypatch.setattr(A, "SHARD", 100)
    monkeypatch.setattr(A, "AT_ONCE", 250)
    got = [(q.vec_id, q.neighbor_id) for q in A.nearest(table, k=5).collect()]
    assert len(got) == len(set(got)) == 3000 and len(want & set(got)) >= 0.965 * len(want)
    h = A.Hash(x, len(x), 5, 2, 0.965)
    plan, whole = h.plan(x)
    assert whole.any() and not any(whole[q].any() for q, _ in plan)


def test_ann_edges(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (None, [1.0, 1.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [1.0]), (8, [])]
    out = A.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), k=2).collect()
    assert {r.vec_id for r in out} <= {1, 2, 3}
    assert [(r.neighbor_id, r.distance) for r in sorted(out, key=lambda r: (r.vec_id, r["rank"])) if r.vec_id == 1][0] == (2, 0.0)
    assert A.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    clash = spark.createDataFrame([(i, [float(i), 1.0], "a", 1, "b", "c") for i in range(6)], "vec_id bigint, embedding array<float>, id string, shard int, v string, kind string")
    assert len(A.nearest(clash, k=2).collect()) == 12 and len(A.nearest(clash, k=2, queries=clash.where("vec_id < 2")).collect()) == 4
    assert A.nearest(clash, queries=clash.limit(0)).count() == 0
