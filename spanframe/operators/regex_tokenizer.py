"""The rule tokenizer: white-space pieces, whole-piece exceptions, affixes, infixes and phrase exceptions, exactly and in order.

The loops depend on what they found before, so they run in an Arrow UDF, compiled once a task. Where a configuration has no
rules, spanframe.operators.tokens does the same in the JVM.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.ids import string_id_of
from spanframe.operators.tokens import parts

FORMAT = 1
TOKEN = "struct<text:string,has_space:boolean,idx:int,norm:string>"
_SPACE = regex.compile(r"\p{White_Space}")
_PIECES = regex.compile(r"\P{White_Space}+ ?|\p{White_Space}+")
#: Pieces whose tokens a task remembers; it bounds memory only.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Config:
    """exceptions: a surface's (text, norm) tokens; norms: a text's norm, norm_ids: by its string id; the patterns are optional."""

    exceptions: dict[str, list[tuple[str, str | None]]] = field(default_factory=dict)
    norms: dict[str, str] = field(default_factory=dict)
    prefix: str | None = None
    suffix: str | None = None
    infix: str | None = None
    token_match: str | None = None
    url_match: str | None = None
    norm_ids: dict[int, str] = field(default_factory=dict)
    language: str = ""
    format: int = FORMAT

    def __post_init__(self):
        if self.format != FORMAT:
            raise ValueError(f"unsupported tokenizer format {self.format}")
        for key, parts in self.exceptions.items():
            if not key or "".join(t for t, _ in parts) != key:
                raise ValueError(f"the tokens of the exception {key!r} don't make it up")
        _ = self.patterns

    @cached_property
    def patterns(self) -> dict:
        return {k: regex.compile(getattr(self, k)) if getattr(self, k) else None for k in ("prefix", "suffix", "infix", "token_match", "url_match")}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "patterns"}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.exceptions), default=0)

    def norm(self, text: str) -> str:
        own = self.norms.get(text) or (self.norm_ids.get(string_id_of(text)) if self.norm_ids else None)
        return own or text.lower()

    @staticmethod
    def load(text: str | bytes) -> Config:
        """A tokenizer file: format_version, language, the patterns, exceptions of {orth, norm}, and norm_overrides by id."""
        raw = json.loads(text)
        if not isinstance(raw, dict) or not isinstance(raw.get("exceptions"), dict):
            raise ValueError("a tokenizer file has exceptions")
        made = {k: [(p["orth"], p.get("norm")) for p in v] for k, v in raw["exceptions"].items()}
        names = ("prefix", "suffix", "infix", "token_match", "url_match")
        return Config(made, {}, *(raw.get(k) for k in names), {int(k): v for k, v in raw.get("norm_overrides", {}).items()}, raw.get("language", ""), raw.get("format_version"))

    def dump(self) -> dict:
        """load()'s inverse."""
        by_id = {str(string_id_of(k)): v for k, v in self.norms.items()} | {str(k): v for k, v in self.norm_ids.items()}
        own = {k: getattr(self, k) for k in ("prefix", "suffix", "infix", "token_match", "url_match")}
        return {"format_version": self.format, "language": self.language, **own, "exceptions": {k: [{"orth": t, "norm": n} for t, n in v] for k, v in self.exceptions.items()}, "norm_overrides": by_id}


def pieces(text: str) -> list[tuple[str, bool]]:
    """Runs with and without white space; one space after a run without is its has_space."""
    out = []
    for p in _PIECES.findall(text):
        spaced = len(p) > 1 and p[-1] == " " and not _SPACE.match(p)
        out.append((p[:-1] if spaced else p, spaced))
    return out


def _cut_infixes(text: str, infix) -> list[str]:
    """Parts between the matches and the matches themselves; a match at the very start cuts nothing."""
    out, at = [], 0
    for m in infix.finditer(text):
        if m.start() == 0:
            continue
        if m.start() > at:
            out.append(text[at:m.start()])
        if m.end() > m.start():
            out.append(m.group())
        at = m.end()
    if at < len(text):
        out.append(text[at:])
    return out


def split_piece(piece: str, c: Config) -> list[str]:
    """A piece's tokens: affixes go one after another until nothing changes, then the core is an exception, whole, or cut at infixes."""
    if piece in c.exceptions:
        return [t for t, _ in c.exceptions[piece]]
    p = c.patterns

    def whole(s: str) -> bool:
        return bool(p["token_match"] and p["token_match"].match(s))

    def front(s: str) -> int:
        m = p["prefix"].match(s) if p["prefix"] and s else None
        return m.end() if m else 0

    def back(s: str) -> int:
        m = p["suffix"].search(s) if p["suffix"] and s else None
        return len(s) - m.start() if m and m.end() == len(s) else 0

    core, before, after = piece, [], []
    while core and core not in c.exceptions and not whole(core):
        a = front(core)
        if a and core[a:] in c.exceptions:
            before.append(core[:a])
            core = core[a:]
            break
        z = back(core[a:])
        if z and core[:len(core) - z] in c.exceptions:
            after.append(core[len(core) - z:])
            core = core[:len(core) - z]
            break
        if a and z and a + z <= len(core):
            before.append(core[:a]), after.append(core[len(core) - z:])
            core = core[a:len(core) - z]
        elif a:
            before.append(core[:a])
            core = core[a:]
        elif z:
            after.append(core[len(core) - z:])
            core = core[:len(core) - z]
        else:
            break
    if not core:
        middle = []
    elif core in c.exceptions:
        middle = [t for t, _ in c.exceptions[core]]
    elif whole(core) or p["url_match"] and p["url_match"].match(core) or not p["infix"]:
        middle = [core]
    else:
        middle = _cut_infixes(core, p["infix"])
    return before + middle + after[::-1]


def _phrases(flat: list[tuple[str, bool]], c: Config) -> list[tuple[str, bool, str]]:
    """(text, has_space, norm) with phrase exceptions: from each token on, the longest run whose surface is an exception."""
    out, k = [], 0
    while k < len(flat):
        surface, best, end = "", None, k
        while c.longest and end < len(flat) and len(surface) < c.longest:
            surface += flat[end][0]
            end += 1
            if surface in c.exceptions:
                best = surface, end
            if flat[end - 1][1]:
                surface += " "
        if best:
            surface, end = best
            parts, last = c.exceptions[surface], flat[end - 1][1]
            out += [(t, last and j == len(parts) - 1, norm or c.norm(t)) for j, (t, norm) in enumerate(parts)]
            k = end
        else:
            t, spaced = flat[k]
            out.append((t, spaced, c.norm(t)))
            k += 1
    return out


def _parts(piece: str, spaced: bool, c: Config) -> list[tuple[str, bool]]:
    parts = [piece] if _SPACE.match(piece) else split_piece(piece, c)
    return [(t, spaced and k == len(parts) - 1) for k, t in enumerate(parts)]


def tokenize(text: str, c: Config) -> list[tuple[str, bool, int, str]]:
    """(text, has_space, idx, norm) of each token."""
    out, at = [], 0
    for t, spaced, norm in _phrases([x for piece, spaced in pieces(text) for x in _parts(piece, spaced, c)], c):
        out.append((t, spaced, at, norm))
        at += len(t) + spaced
    return out


class _Pieces(dict):
    """The number of a piece (with its space); the tokens of each are made when it comes first."""

    def __init__(self, c: Config):
        self.c, self.many, self.texts, self.norms, self.spaces = c, [], [], [], []

    def __missing__(self, piece: str) -> int:
        spaced = len(piece) > 1 and piece[-1] == " " and not _SPACE.match(piece)
        tokens = _phrases(_parts(piece[:-1] if spaced else piece, spaced, self.c), self.c)
        self.add(tokens)
        n = self[piece] = len(self.many) - 1
        return n

    def add(self, tokens: list[tuple[str, bool, str]]) -> int:
        """The number of tokens that stand for themselves."""
        self.many.append(len(tokens))
        for t, s, norm in tokens:
            self.texts.append(t), self.spaces.append(s), self.norms.append(norm)
        return len(self.many) - 1


def token_array(text: Column, config: Config) -> Column:
    """ARRAY of tokens; null stays null.

    Texts go by a few megabytes at a time, however large the batches are.
    A document is the numbers of its pieces, each of which is cut once; the tokens' columns are gathered from the pieces' by
    arrays. Only where an exception with white space in it may be in a text are its tokens looked through together.
    """
    wide = [k for k in config.exceptions if _SPACE.search(k)]
    across = regex.compile("|".join(map(regex.escape, sorted(wide, key=len, reverse=True)))) if wide else None

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Pieces(config)
        for batch in (p for b in it for p in parts(b)):
            if len(known.texts) > REMEMBERED:
                known = _Pieces(config)
            number, flow, ends = known.__getitem__, array("q"), []
            for t in batch.to_pylist():
                if t and across and across.search(t):
                    flow.append(known.add(_phrases([x for piece, spaced in pieces(t) for x in _parts(piece, spaced, config)], config)))
                elif t:
                    flow.extend(map(number, _PIECES.findall(t)))
                ends.append(len(flow))
            flow, many = np.frombuffer(flow, np.int64) if flow else np.zeros(0, np.int64), np.array(known.many, np.int64)
            size = many[flow]
            first = (np.cumsum(many) - many)[flow]
            before = np.cumsum(size) - size
            at = np.arange(size.sum()) + np.repeat(first - before, size)
            spaces = np.array(known.spaces, bool)
            length = np.fromiter(map(len, known.texts), np.int64, len(known.texts)) + spaces
            steps = np.concatenate([[0], np.cumsum(length[at])])
            offsets = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends]).astype(np.int64)]
            idx = steps[:-1] - np.repeat(steps[offsets[:-1]], np.diff(offsets))
            take = pa.array(at)
            rows = pa.StructArray.from_arrays([pa.array(known.texts, pa.string()).take(take), pa.array(spaces).take(take), pa.array(idx.astype(np.int32)), pa.array(known.norms, pa.string()).take(take)], ["text", "has_space", "idx", "norm"])
            yield pc.if_else(batch.is_null(), None, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows))

    return F.arrow_udf(run, f"array<{TOKEN}>")(text)


def flat(docs: DataFrame, config: Config, *keep: str) -> DataFrame:
    x = docs.select("doc_id", *keep, F.posexplode(token_array(F.col("text"), config)).alias("i", "t"))
    return x.select("doc_id", *keep, "i", "t.text", "t.has_space", "t.idx", "t.norm")


#: Tokenizers by name; an application registers its own: a function of (docs, *keep) to a flat token table.
TOKENIZERS: dict = {}


def register(name: str, build) -> None:
    TOKENIZERS[name] = build


def tokenizer(name: str, config: Config | None = None):
    """The tokenizer of a bundle's kind. Dictionary analysers aren't part of this; one can be registered under their names."""
    if name in TOKENIZERS:
        return TOKENIZERS[name]
    if name == "regex":
        return lambda docs, *keep: flat(docs, config or Config(), *keep)
    if name == "whitespace":
        from spanframe.operators import tokens

        return tokens.flat
    raise ValueError(f"tokenizer backend disabled: {name}")


def is_safe_path(path: str) -> bool:
    """Relative, with only plain components."""
    return bool(path) and not path.startswith("/") and all(p not in ("", ".", "..") for p in re.split(r"[/\\]", path))
