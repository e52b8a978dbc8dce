"""Language identification by a blended-spectrum string kernel.

A text's features are the presence of its character n-grams of the orders 1 to 3, over an alphabet learnt from the
training rows (other characters share one symbol, digits another; ends and runs of what isn't a letter or digit are one
space; n-grams of spaces and digits alone say nothing of a language and don't count). The kernel of two texts is the number of n-grams they share over the geometric mean of their own numbers.
Nystroem landmarks map a text to its kernel values with them, whitened by the landmarks' own kernel; on that map a kernel
ridge regression is fitted one-versus-rest. Scores of a batch are one presence matrix times one weight matrix.

A text is rejected if it shares no n-gram with what was learnt, or if its best score is under what a text of so many letters
reaches at least: held-out labelled rows, and pieces of them of 4, 8, 16, .. letters, give that for every length alike.

Defined results: a null text, or one without a letter, has no language, score and margin, and is rejected. Of equal scores
the language that sorts first wins. A text of any length is read whole. All labelled texts count, each once; hashes of texts choose
landmarks and what is held out, so null, equal or repeated doc_ids and repeated rows don't matter; without labelled text all is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.common import trim

ORDERS = 3
#: Symbols of the alphabet: 0 space, 1 digits, 2 any other character, and the most frequent letters.
SYMBOLS = 64
SPACE_OF = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
#: Up to so many different texts of each language are fitted on the driver, more by tasks.
TRAIN_ROWS = 200
#: Landmarks of a language, and of all together if tasks fit them.
LANDMARKS, MARKS = 64, 512
#: A kernel value of 1 as a whole number.
UNIT = 1 << 15
RIDGE = 1e-2
#: Languages that are told apart, at most: the labels with the most different texts.
LANGUAGES = 512
#: The least score is this share of the best score that all but one in a hundred held-out pieces reach, where that is positive, and
#: SLACK times that score elsewhere, and never over that of a longer text; every HELD-th row is held out for it.
SCORE_SHARE, SLACK, HELD = 0.05, 2, 5
#: Letters of the pieces; a length needs so many pieces to count.
LENGTHS, PIECES = tuple(4 << k for k in range(15)), 20
#: Share of characters outside the alphabet in a language's letters from which on they are a feature like letters.
OTHERS = 0.05


#: Codes of the n-grams of spaces and digits alone, and of those without a letter of the alphabet.
NO_LETTER, UNKNOWN = (np.array([sum(SYMBOLS**k for k in range(1, n)) + sum(c * SYMBOLS**(n - 1 - i) for i, c in enumerate(g)) for n in range(1, ORDERS + 1) for g in product(range(k), repeat=n)]) for k in (2, 3))


class Alphabet:
    def __init__(self, texts: list[str], seen: Counter | None = None):
        """seen: how often each letter comes, if it has been counted already."""
        seen = Counter(c for t in texts for c in t.lower() if c.isalpha()) if seen is None else seen
        self.letters = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:SYMBOLS - 3]]

    def table(self) -> np.ndarray:
        """The symbol of each code point, made where it is used: 1 MB that isn't sent."""
        t = np.zeros(0x110000, np.uint8)
        for c in range(0x3000):
            t[c] = 2 if chr(c).isalpha() else 1 if chr(c).isdecimal() else 0
        t[0x3000:] = 2
        for k, c in enumerate(self.letters):
            t[ord(c)] = k + 3
            if len(c.upper()) == 1 and ord(c.upper()) != ord(c):
                t[ord(c.upper())] = k + 3
        return t


def spectrum(text: str, table: np.ndarray, flags: np.ndarray) -> int:
    """Set the flags of a text's n-grams; the number of its letters."""
    sym = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    sym = np.concatenate([[0], sym, [0]]).astype(np.int32)
    sym = sym[np.concatenate([[True], (sym[1:] != 0) | (sym[:-1] != 0)])]
    flags[:] = False
    code, at = sym, 0
    for n in range(1, ORDERS + 1):
        if n > 1:
            if len(sym) < n:
                break
            code = code[:-1] * SYMBOLS + sym[n - 1:]
        flags[at + code] = True
        at += SYMBOLS**n
    flags[NO_LETTER] = False
    return int((sym > 1).sum())


class Model:
    """What scoring needs: the landmarks' n-grams, and for each its weight by language."""

    def __init__(self, texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, seed: int = 0):
        self.languages, self.curve = sorted(set(labels)), (np.zeros(1), np.full(1, -np.inf))
        table = Alphabet(texts)
        self.letters = table
        lut, flags = table.table(), np.zeros(SPACE_OF, bool)
        found = []
        for t in texts:
            spectrum(t, lut, flags)
            found.append(np.flatnonzero(flags).astype(np.int32))
        rng, chosen = np.random.default_rng(seed), []
        for g in self.languages:
            own = [i for i, x in enumerate(labels) if x == g]
            chosen += [own[i] for i in rng.permutation(len(own))[:landmarks]]
        self.grams = np.unique(np.concatenate([found[i] for i in chosen])).astype(np.int32)
        # Where few letters are outside the alphabet, texts that share those alone are as likely of different scripts.
        letters, others = Counter(), Counter()
        for t, x in zip(texts, labels):
            sym = lut[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)]
            letters[x] += int((sym > 1).sum())
            others[x] += int((sym == 2).sum())
        if all(others[x] < OTHERS * letters[x] for x in letters if letters[x]):
            self.grams = np.setdiff1d(self.grams, UNKNOWN.astype(np.int32))
        marks = self._presence([found[i] for i in chosen]) / np.sqrt([max(1, len(found[i])) for i in chosen])[:, None].astype(np.float32)
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        good = values > 1e-8 * values.max()
        white = vectors[:, good] / np.sqrt(values[good])
        # No intercept: a text that shares nothing with the landmarks scores 0 everywhere.
        phi = np.empty((len(texts), good.sum()))
        for at in range(0, len(texts), 128):
            part = found[at:at + 128]
            k = self._presence(part) @ marks.T / np.sqrt([max(1, len(x)) for x in part])[:, None]
            phi[at:at + 128] = k @ white
        y = np.where(np.array(labels)[:, None] == np.array(self.languages)[None, :], 1.0, -1.0)
        # A language with few rows counts as much as one with many.
        weight = np.array([1 / Counter(labels)[x] for x in labels])[:, None] * len(labels) / len(self.languages)
        w = np.linalg.solve(phi.T @ (phi * weight) + ridge * np.eye(phi.shape[1]), phi.T @ (y * weight))
        self.weights = (marks.T @ (white @ w)).astype(np.float32)

    def _presence(self, found: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(found), len(self.grams)), np.float32)
        for i, x in enumerate(found):
            k = np.searchsorted(self.grams, x)
            k = k[(k < len(self.grams)) & (self.grams[np.minimum(k, len(self.grams) - 1)] == x)]
            out[i, k] = 1
        return out

    def score(self, texts: list[str], lut: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) scores, and the letters of each text."""
        scores, letters = np.empty((len(texts), len(self.languages)), np.float32), np.zeros(len(texts), np.int64)
        for at in range(0, len(texts), 64):
            part = texts[at:at + 64]
            seen, own = np.empty((len(part), len(self.grams)), np.float32), np.empty(len(part), np.float32)
            for i, t in enumerate(part):
                letters[at + i] = spectrum(t, lut, flags)
                seen[i] = flags[self.grams]
                own[i] = max(1, np.count_nonzero(flags))
            scores[at:at + 64] = seen @ self.weights / np.sqrt(own)[:, None]
        return scores, letters


    def least(self, letters: np.ndarray) -> np.ndarray:
        """The least score to keep a text of so many letters for."""
        return np.interp(np.log2(np.maximum(letters, 1)), *self.curve)


def train(docs: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on all different labelled texts of at most LANGUAGES languages; None without labelled text. Where no language has over
    `rows` of them the driver does it."""
    x = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{label}`").cast("string").alias("lang")).where("text is not null and lang is not null").withColumn("h", F.xxhash64("text", F.lit(29)))
    counts = {r.lang: r.n for r in x.groupBy("lang").agg(F.countDistinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    # A share of each language's different texts, some more than needed; their hashes decide which.
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.3 * rows / max(n, 1)))])
    some = x.where((F.pmod("h", F.lit(1 << 30)) / (1 << 30)) < share[F.col("lang")]).dropDuplicates(["lang", "h"]).collect()
    some.sort(key=lambda r: (r.lang, r.h % (1 << 30), r.text))
    some = [r for r in some if any(c.isalpha() for c in r.text)]
    if not some:
        return None
    if max(counts.values()) > rows:
        return fit_whole(x.where(F.col("lang").isin(*counts)), some)
    m = Model([r.text for r in some], [r.lang for r in some])
    m.curve = held_out_scores(some)
    return m


def _held(h: int) -> bool:
    """Whether a text of this hash is held out; of other bits than those that choose landmarks."""
    return (h >> 40) % HELD == 0


def _marks(some: list, letters: Alphabet, unknown: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The landmarks' n-grams, their (landmarks x n-grams) presence, and the number of each one's n-grams. None is a held-out text."""
    most, seen, lut, flags, found = max(1, min(LANDMARKS, MARKS // len({r.lang for r in some}))), Counter(), letters.table(), np.zeros(SPACE_OF, bool), []
    for r in some:
        if seen[r.lang] < most and not _held(r.h):
            seen[r.lang] += 1
            spectrum(r.text, lut, flags)
            found.append(np.flatnonzero(flags).astype(np.int32))
    grams = np.unique(np.concatenate([np.zeros(0, np.int32), *found]))
    if not unknown:
        grams = np.setdiff1d(grams, UNKNOWN.astype(np.int32))
    shown = np.zeros((len(found), len(grams)), np.float32)
    for i, x in enumerate(found):
        shown[i] = np.isin(grams, x)
    return grams, shown, np.array([max(1, len(x)) for x in found])


def fit_whole(x: DataFrame, some: list) -> Model | None:
    """The model of all different texts of x (text, lang, h); of `some`, in their order, only landmarks are taken.

    A landmark is a dimension of the map; letters, weights and the least scores come from all texts. Each text's share is made where
    the text is and is shuffled by its hash, a few hundred bytes, so that it counts once. The shares are whole numbers,
    whose sums are exact in any order.
    """
    spark = x.sparkSession

    def letters_of(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in it:
            out = []
            for t in batch.to_pylist():
                code, n = np.unique(np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
                out.append(np.stack([code, n.astype(np.uint32)]).tobytes())
            yield pa.array(out, pa.binary())

    def count(batches):
        seen = Counter()
        for batch in batches:
            for g, b in zip(batch["lang"].to_pylist(), batch["own"].to_pylist()):
                for c, n in np.frombuffer(b, np.uint32).reshape(2, -1).T.tolist():
                    seen[g, c] += n
        keys = [k for k in seen if k[1] >= 0x3000 or chr(k[1]).isalpha()]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())], ["lang", "code", "n"])

    once = x.select("lang", "h", F.arrow_udf(letters_of, "binary")("text").alias("own")).dropDuplicates(["lang", "h"])
    seen = once.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).collect()
    total = Counter()
    for r in seen:
        if chr(r.code).isalpha():
            total[chr(r.code)] += r.n
    letters = Alphabet([], total)
    alphabet, own, others = set(letters.letters), Counter(), Counter()
    for r in seen:
        own[r.lang] += r.n
        others[r.lang] += r.n * (chr(r.code) not in alphabet)
    # Where few letters are outside the alphabet, texts that share those alone are as likely of different scripts.
    grams, shown, size = _marks(some, letters, any(others[g] >= OTHERS * own[g] for g in own))
    if not len(size):
        return None
    sent = spark.sparkContext.broadcast((letters, grams, shown, size))

    def kernels(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters, grams, shown, size = sent.value
        lut, flags = letters.table(), np.zeros(SPACE_OF, bool)
        for batch in it:
            out, texts = [], batch.to_pylist()
            for at in range(0, len(texts), 64):
                part = texts[at:at + 64]
                has, n = np.empty((len(part), len(grams)), np.float32), np.empty(len(part))
                for i, t in enumerate(part):
                    some = spectrum(t, lut, flags)
                    has[i] = flags[grams]
                    n[i] = max(1, np.count_nonzero(flags)) if some else 0
                shared = has @ shown.T
                # Empty for a text without letters.
                k = np.rint(shared * (UNIT / np.sqrt(np.maximum(n, 1)[:, None] * size))).astype(np.uint16)
                out += [r.tobytes() if c else b"" for r, c in zip(k, n)]
            yield pa.array(out, pa.binary())
            del batch, texts
            trim()

    def partial(batches):
        sums = {}
        for batch in batches:
            lang, held = (np.array(batch[c].to_pylist(), object) for c in ("lang", "held"))
            k = np.frombuffer(b"".join(batch["own"].to_pylist()), np.uint16).reshape(len(batch), -1).astype(np.float64)
            for g in set(zip(lang, held)):
                own = k[(lang == g[0]) & (held == g[1])]
                if len(sums) >= 16 and g not in sums:
                    yield rows(sums)
                    sums = {}
                n, v, m = sums.get(g, (0, 0, 0))
                sums[g] = n + len(own), v + own.sum(0).astype(np.int64), m + (own.T @ own).astype(np.int64)
        yield rows(sums)

    def rows(sums: dict) -> pa.RecordBatch:
        cols = [[g for g, _ in sums], [h for _, h in sums], [n for n, _, _ in sums.values()], *([z[c].tobytes() for z in sums.values()] for c in (1, 2))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()))], ["lang", "held", "n", "v", "m"])

    def add(t: pa.Table) -> pa.Table:
        v, m = (sum(np.frombuffer(x, np.int64) for x in t[c].to_pylist()) for c in ("v", "m"))
        return pa.Table.from_batches([rows({(t["lang"][0].as_py(), t["held"][0].as_py()): (sum(t["n"].to_pylist()), v, m)})])

    held = (F.pmod(F.shiftright("h", 40), F.lit(HELD)) == 0).alias("held")
    kind = "lang string, held boolean, n bigint, v binary, m binary"
    own = x.select("lang", "h", held, F.arrow_udf(kernels, "binary")("text").alias("own")).where("length(own) > 0").dropDuplicates(["lang", "h"])
    sums = own.select("lang", "held", "own").mapInArrow(partial, kind).groupBy("lang", "held").applyInArrow(add, kind).orderBy("lang", "held")
    fits = [_Sums(len(size)), _Sums(len(size))]
    for r in sums.toLocalIterator():
        one = r.n, np.frombuffer(r.v, np.int64), np.frombuffer(r.m, np.int64).reshape(len(size), -1)
        fits[0].add(r.lang, *one)
        if not r.held:
            fits[1].add(r.lang, *one)
    model, other = (f.solve(letters, grams, shown, size) for f in fits)
    if other is not None:
        model.curve = _whole_curve(x.where(held), other)
    return model


class _Sums:
    """The normal equations of a fit, language by language: what a language's texts add, over their number."""

    def __init__(self, marks: int):
        self.matrix, self.means, self.total, self.last = np.zeros((marks, marks)), {}, 0, None

    def add(self, lang: str, n: int, v: np.ndarray, m: np.ndarray) -> None:
        if self.last and self.last[0] == lang:
            n, v, m = n + self.last[1], v + self.last[2], m + self.last[3]
        else:
            self.end()
        self.last = lang, n, v, m

    def end(self) -> None:
        if self.last:
            lang, n, v, m = self.last
            self.matrix += m / (n * UNIT**2)
            self.means[lang], self.total, self.last = v / (n * UNIT), self.total + n, None

    def solve(self, letters: Alphabet, grams: np.ndarray, shown: np.ndarray, size: np.ndarray) -> Model | None:
        self.end()
        if not self.means:
            return None
        model = Model.__new__(Model)
        model.languages, model.letters, model.grams, model.curve = sorted(self.means), letters, grams, (np.zeros(1), np.full(1, -np.inf))
        marks = shown / np.sqrt(size)[:, None]
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        good = values > 1e-8 * values.max()
        white = vectors[:, good] / np.sqrt(values[good])
        # A language with few rows counts as much as one with many.
        weight = self.total / len(self.means)
        means = np.stack([self.means[g] for g in model.languages])
        y = weight * (2 * means - means.sum(0)).T
        w = np.linalg.solve(white.T @ self.matrix @ white * weight + RIDGE * np.eye(white.shape[1]), white.T @ y)
        model.weights = (marks.T @ (white @ w)).astype(np.float32)
        return model


def _whole_curve(x: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """held_out_scores() of all rows of x (text, lang, h) by a model of others; a text's hash draws its pieces."""
    sent = x.sparkSession.sparkContext.broadcast(model)

    def scores(batches):
        m = sent.value
        lut, flags, known = m.letters.table(), np.zeros(SPACE_OF, bool), set(m.languages)
        for batch in batches:
            lang, h, at, best = [], [], [], []
            for t, g, k in zip(*(batch[c].to_pylist() for c in ("text", "lang", "h"))):
                if g in known and (own := _pieces(t, np.random.default_rng(k % (1 << 63)))):
                    s = m.score([p for _, p in own], lut, flags)[0].max(1)
                    lang += [g] * len(own)
                    h += [k] * len(own)
                    at += [n for n, _ in own]
                    best += s.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(h, pa.int64()), pa.array(at, pa.int64()), pa.array(best, pa.float32())], ["lang", "h", "at", "best"])
            trim()

    found = x.select("text", "lang", "h").mapInArrow(scores, "lang string, h bigint, at bigint, best float").dropDuplicates(["lang", "h", "at"])
    least = {r["at"]: r.q for r in found.groupBy("at").agg(F.count("*").alias("n"), F.percentile("best", 0.01).alias("q")).where(F.col("n") >= PIECES).collect()}
    at = sorted(least)
    if not at:
        return np.zeros(1), np.full(1, -np.inf)
    q = np.array([least[n] * (SCORE_SHARE if least[n] > 0 else SLACK) for n in at])
    return np.log2(at), np.minimum.accumulate(q[::-1])[::-1]


def _pieces(text: str, rng: np.random.Generator) -> list[tuple[int, str]]:
    """(letters, piece) for each of LENGTHS that the text has; any word from which enough letters follow can begin it."""
    out, ws = [], text.split()
    size = np.cumsum([sum(map(str.isalpha, w)) for w in ws])
    for n in LENGTHS:
        if not len(ws) or size[-1] < n:
            break
        a = int(rng.integers(0, int(np.searchsorted(size, size[-1] - n, "right")) + 1))
        before = size[a - 1] if a else 0
        out.append((n, " ".join(ws[a:int(np.searchsorted(size, before + n)) + 1])))
    return out


def held_out_scores(rows: list, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(log2 of letters, least score to keep a text for), from pieces of rows that a model of the other rows hasn't seen."""
    fit, held = [r for k, r in enumerate(rows) if k % HELD], rows[::HELD]
    known = {r.lang for r in fit}
    held = [r.text for r in held if r.lang in known]
    none = np.zeros(1), np.full(1, -np.inf)
    if not held:
        return none
    m, rng = Model([r.text for r in fit], [r.lang for r in fit]), np.random.default_rng(seed)
    lut, flags, at, least = m.letters.table(), np.zeros(SPACE_OF, bool), [], []
    for n in LENGTHS:
        pieces = []
        for t in held:
            ws = t.split()
            size = np.cumsum([sum(map(str.isalpha, w)) for w in ws])
            # Any word from which enough letters follow can begin the piece.
            last = int(np.searchsorted(size, size[-1] - n, "right")) if len(ws) and size[-1] >= n else -1
            if last >= 0:
                a = int(rng.integers(0, last + 1))
                before = size[a - 1] if a else 0
                pieces.append(" ".join(ws[a:int(np.searchsorted(size, before + n)) + 1]))
        if len(pieces) >= min(PIECES, len(held)):
            q = float(np.quantile(m.score(pieces, lut, flags)[0].max(1), 0.01))
            at.append(np.log2(n)), least.append(q * (SCORE_SHARE if q > 0 else SLACK))
    return (np.array(at), np.minimum.accumulate(least[::-1])[::-1]) if at else none


def identify(docs: DataFrame, model: Model | None, text: str = "text", min_score: float | None = None):
    """A column: struct(language, score, margin, keep)."""
    kind = "struct<language: string, score: float, margin: float, keep: boolean>"
    if model is None:
        return F.lit(None).cast(kind)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        lut, flags = m.letters.table(), np.zeros(SPACE_OF, bool)
        names = np.array(m.languages, object)
        for batch in it:
            cols = []
            for at in range(0, len(batch), 256):
                texts = [t or "" for t in batch.slice(at, 256).to_pylist()]
                s, letters = m.score(texts, lut, flags)
                best = s.argmax(1)
                top = s.max(1)
                second = np.partition(s, -2, 1)[:, -2] if s.shape[1] > 1 else np.full(len(s), -1, np.float32)
                none = letters == 0
                least = m.least(letters) if min_score is None else min_score
                cols.append(pa.StructArray.from_arrays([pa.array(names[best], pa.string(), mask=none), pa.array(top, mask=none), pa.array(top - second, mask=none), pa.array(~none & (top >= least) & s.any(1))], ["language", "score", "margin", "keep"]))
            yield pa.concat_arrays(cols) if cols else pa.StructArray.from_arrays([pa.array([], x) for x in (pa.string(), pa.float32(), pa.float32(), pa.bool_())], ["language", "score", "margin", "keep"])
            del batch, cols
            trim()

    return F.arrow_udf(run, kind)(F.col(f"`{text}`"))


def language_id(docs: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", min_score: float | None = None) -> DataFrame:
    """(doc_id, declared, language, score, margin, keep) of every row; texts aren't shuffled, only these columns are read."""
    m = train(docs, text, label, doc_id)
    x = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").alias("declared"), F.col(f"`{text}`").alias("text"))
    x = x.select("doc_id", "declared", identify(x, m, "text", min_score).alias("r"))
    return x.select("doc_id", "declared", "r.language", "r.score", "r.margin", F.coalesce("r.keep", F.lit(False)).alias("keep"))


def keep_identified(docs: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", min_score: float | None = None) -> DataFrame:
    """The rows of docs in which a language was identified; their columns are those of docs."""
    m = train(docs, text, label, doc_id)
    return docs.where(F.coalesce(identify(docs, m, text, min_score)["keep"], F.lit(False)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_language_id": op8_language_id}
ORACLES: dict[str, str] = {}
