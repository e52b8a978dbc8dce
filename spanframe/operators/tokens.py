"""Token tables: one row for each token (flat), or one array for each document (nested); spans and offsets in code points.

A token is text, has_space (one space follows and belongs to no token) and idx, its offset. The flat form is made after the
documents are partitioned by doc_id, once: windows, groups and joins by doc_id that come later need no further exchange.
The nested form is cut from a document's text within its row, without any exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.kernels import let

WS = r"\p{IsWhite_Space}"
PIECES = rf"[^{WS}]+ ?|{WS}+"


def by_doc():
    """A document's tokens in order."""
    return Window.partitionBy("doc_id").orderBy("i")


def before():
    """The tokens before this one."""
    return by_doc().rowsBetween(Window.unboundedPreceding, -1)


def pieces(text: Column) -> Column:
    """A text cut into runs with and without white space; a run without takes one following space with it."""
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def flat(docs: DataFrame, *keep: str, offsets: bool = True) -> DataFrame:
    """(doc_id, kept columns, i, text, has_space, idx). offsets: without idx no order within documents is needed."""
    x = docs.select("doc_id", *keep, "text")
    if offsets:
        x = x.repartition("doc_id")
    x = x.select("doc_id", *keep, F.posexplode(pieces(F.col("text"))).alias("i", "piece"))
    spaced = F.col("piece").endswith(" ") & ~F.col("piece").rlike(rf"\A{WS}")
    x = x.withColumn("has_space", spaced)
    x = x.withColumn("text", F.when(F.col("has_space"), F.expr("left(piece, length(piece) - 1)")).otherwise(F.col("piece")))
    if offsets:
        x = x.withColumn("idx", F.coalesce(F.sum(F.length("piece")).over(before()), F.lit(0)).cast("int"))
    return x.drop("piece").select("doc_id", *keep, "i", "text", "has_space", *(["idx"] if offsets else []))


def from_words(words: DataFrame) -> DataFrame:
    """(doc_id, words, spaces) to a flat table; another number of spaces than of words is an error."""
    x = words.withColumn("spaces", F.when(F.size("words") == F.size("spaces"), F.col("spaces")).otherwise(F.raise_error(F.lit("words and spaces differ in number")).cast("array<boolean>")))
    x = x.repartition("doc_id").select("doc_id", F.posexplode(F.arrays_zip("words", "spaces")).alias("i", "w")).select("doc_id", "i", F.col("w.words").alias("text"), F.col("w.spaces").alias("has_space"))
    return x.withColumn("idx", F.coalesce(F.sum(F.length("text") + F.col("has_space").cast("int")).over(before()), F.lit(0)).cast("int"))


#: Bytes of text that are cut at a time; it bounds memory only.
CUT_BYTES = 2 << 20
TOKEN = "struct<i:int,text:string,has_space:boolean,idx:int>"
_ASCII_WS = np.zeros(256, bool)
_ASCII_WS[[*range(9, 14), 32]] = True
_WIDE_WS = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])


def parts(texts: pa.Array, most: int = CUT_BYTES) -> Iterator[pa.Array]:
    """The array in slices of about so many bytes, at least one row each."""
    if not len(texts):
        return
    size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)), dtype=np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, end - at)
        at = end


def cut(texts: pa.Array) -> pa.Array:
    """The tokens of each text as flat() makes them, by whole arrays of bytes; null stays null."""
    a = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(a.buffers()[1], np.int64, len(a) + a.offset + 1)[a.offset:]
    b = np.frombuffer(a.buffers()[2], np.uint8)[bounds[0]:bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    space = _ASCII_WS[b]
    two = np.flatnonzero(b == 0xC2)
    two = two[np.isin(b[two + 1], (0x85, 0xA0))]
    wide = np.flatnonzero((b >= 0xE1) & (b <= 0xE3))
    wide = wide[np.isin((b[wide].astype(np.int32) << 16) | (b[wide + 1].astype(np.int32) << 8) | b[wide + 2], _WIDE_WS)]
    for at in (two, two + 1, wide, wide + 1, wide + 2):
        space[at] = True
    start = np.zeros(len(b) + 1, bool)
    start[bounds[:-1]] = True
    after = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    after = after[~start[after]]
    one = b[after] == 32
    taken = np.zeros(len(b), bool)
    taken[after[one]] = True
    start[after[~one]] = start[after[one] + 1] = True
    start[np.flatnonzero(~space[1:] & space[:-1]) + 1] = True
    starts = np.flatnonzero(start[:-1])
    spaced = taken[np.append(starts[1:], len(b)) - 1] if len(starts) else np.zeros(0, bool)
    offsets = np.concatenate([starts, [len(b)]]) - np.concatenate([[0], np.cumsum(spaced)])
    first = np.searchsorted(starts, bounds)
    many = np.diff(first)
    chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    idx = chars[starts] - np.repeat(chars[bounds[:-1]], many)
    i = np.arange(len(starts)) - np.repeat(first[:-1], many)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(b[~taken].tobytes())).cast(pa.string())
    rows = pa.StructArray.from_arrays([pa.array(i.astype(np.int32)), words, pa.array(spaced), pa.array(idx.astype(np.int32))], ["i", "text", "has_space", "idx"])
    return pa.compute.if_else(texts.is_null(), None, pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), rows))


def token_array(text: Column) -> Column:
    """ARRAY of a text's tokens, a few megabytes of text at a time."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from map(cut, parts(batch))

    return F.arrow_udf(run, f"array<{TOKEN}>")(text)


def nested(docs: DataFrame, *keep: str, empty: bool = False) -> DataFrame:
    """(doc_id, kept columns, tokens): nest(flat(docs)), made in each document's row. empty: also documents without tokens."""
    x = docs if empty else docs.where("text <> ''")
    return x.select("doc_id", *keep, token_array(F.col("text")).alias("tokens"))


def nest(tokens: DataFrame) -> DataFrame:
    """(doc_id, tokens): the flat table's columns as an array in the order of i. Tokens are sorted for it; nested() makes
    the same of texts without."""
    names = [c for c in tokens.columns if c not in ("doc_id", "i")]
    return tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", *names))).alias("tokens"))


def flatten(docs: DataFrame) -> DataFrame:
    """nest()'s inverse."""
    return docs.select("doc_id", F.inline("tokens"))


def mark(tokens: DataFrame, spans: DataFrame, into: str = "mark") -> DataFrame:
    """tokens with the span (a struct of its columns) that covers each, or null. spans: (doc_id, start, end, ..) that don't overlap
    within a document.

    A document's spans are one row, with the number of the span that each token has as an array: a hash join by doc_id, for
    which a table that is partitioned by it is neither moved nor sorted.
    """
    names = [c for c in spans.columns if c not in ("doc_id", "start")]
    own = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", *names))).alias("_spans"))
    gap = lambda s, k: s["start"] - F.when(k > 0, F.get("_spans", k - 1)["end"]).otherwise(0)
    runs = F.transform("_spans", lambda s, k: F.concat(F.array_repeat(F.lit(0), gap(s, k)), F.array_repeat(k + 1, s["end"] - s["start"])))
    own = own.withColumn("_numbers", F.flatten(runs)).hint("shuffle_hash")
    n = F.coalesce(F.get("_numbers", F.col("i")), F.lit(0))
    x = tokens.join(own, "doc_id", "left")
    return x.select(*tokens.columns, F.when(n > 0, F.get("_spans", n - 1)).alias(into))


def text_of(tokens: Column) -> Column:
    """The text of nested tokens, the last one's space included."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(t["text"], F.when(t["has_space"], F.lit(" ")).otherwise(F.lit("")))), "")


def doc_text(tokens: DataFrame) -> DataFrame:
    """(doc_id, text) rebuilt from a flat table."""
    return nest(tokens.select("doc_id", "i", "text", "has_space")).select("doc_id", text_of(F.col("tokens")).alias("text"))


def char_len(tokens: Column) -> Column:
    """Characters of a document, the last token's space included."""
    last = F.try_element_at(tokens, F.lit(-1))
    return F.coalesce(last["idx"] + F.length(last["text"]) + last["has_space"].cast("int"), F.lit(0))


def span(tokens: Column, start: Column, end: Column) -> Column:
    """STRUCT(start, end, start_char, end_char, text) of a half-open token range; one out of bounds or reversed is an error."""
    bad = (start < 0) | (start > end) | (end > F.size(tokens))
    part = F.slice(tokens, start + 1, end - start)
    first, last = F.get(tokens, start), F.get(tokens, end - 1)
    at = F.coalesce(first["idx"], char_len(tokens))
    stop = F.when(start == end, at).otherwise(last["idx"] + F.length(last["text"]))
    text = F.regexp_replace(text_of(part), r"(?s) \z", "")
    text = F.when(F.coalesce(last["has_space"], F.lit(False)) & (start < end), text).otherwise(text_of(part))
    return F.when(bad, F.raise_error(F.lit("span out of bounds")).cast("struct<start:int,end:int,start_char:int,end_char:int,text:string>")).otherwise(F.struct(start.alias("start"), end.alias("end"), at.alias("start_char"), stop.alias("end_char"), text.alias("text")))


def char_span(tokens: Column, a: Column, b: Column, mode: str) -> Column:
    """The token range of a character range, or null. strict: both ends are token borders; contract: the tokens inside;
    expand: the tokens touched, or an empty range at an anchor where none is."""
    n, size = F.size(tokens), char_len(tokens)
    kind = "struct<start:int,end:int>"
    sane = (n > 0) & (a <= b) & (b <= size) & (a >= 0)

    def where(test) -> Column:
        """The tokens that fit, in order: one pass, each token knowing its own number."""
        return F.filter(tokens, lambda t: test(t["idx"], t["idx"] + F.length(t["text"]), t["i"]))

    def number(found: Column, at: int) -> Column:
        return F.try_element_at(found, F.lit(at))["i"]

    def pair(x: Column, y: Column) -> Column:
        return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.cast("int").alias("start"), y.cast("int").alias("end")))

    if mode == "strict":
        def ends(both: Column) -> Column:
            first = number(F.filter(both, lambda t: t["idx"] == a), 1)
            return pair(first, number(F.filter(both, lambda t: (t["idx"] + F.length(t["text"]) == b) & (t["idx"] >= a)), 1) + 1)

        return F.when(sane & (a != b), let(where(lambda s, e, i: (s == a) | (e == b)), ends)).otherwise(F.lit(None).cast(kind))
    # What a pass over the tokens finds is named by let(), as else each mention of it would be a pass.
    if mode == "contract":
        inside = let(where(lambda s, e, i: (s >= a) & (e <= b)), lambda hit: pair(number(hit, 1), number(hit, -1) + 1))
        return F.when(sane & (a != b), inside).otherwise(F.lit(None).cast(kind))
    if mode != "expand":
        raise ValueError(f"no such alignment: {mode}")

    def empty(after: Column) -> Column:
        anchor, at = F.coalesce(after["i"], n), F.coalesce(after["idx"], size)
        prior = F.try_element_at(tokens, F.greatest(anchor, F.lit(1)))
        ended = F.when(anchor == 0, 0).otherwise(prior["idx"] + F.length(prior["text"]))
        none = ((anchor == 0) & (b == 0)) | (a < ended) | (b > at) | ((anchor == n) & (a == size))
        return F.when(~none, pair(anchor, anchor))

    def touched(hit: Column) -> Column:
        after = F.try_element_at(where(lambda s, e, i: s >= b), F.lit(1))
        return F.when(F.size(hit) > 0, pair(number(hit, 1), number(hit, -1) + 1)).otherwise(let(after, empty))

    hit = where(lambda s, e, i: F.when(a == b, (s < a) & (e > a)).otherwise((e > a) & (s < b)))
    return F.when(sane, let(hit, touched)).otherwise(F.lit(None).cast(kind))


def byte_offset(text: Column, n: Column) -> Column:
    """Bytes before the n-th code point; null outside the text."""
    return F.when((n >= 0) & (n <= F.length(text)), F.octet_length(F.substring(text, F.lit(1), n)))


def morph_features(m: Column) -> Column:
    """A|B|A to its sorted distinct features."""
    return F.array_sort(F.array_distinct(F.filter(F.split(m, r"\|"), lambda x: x != "")))
