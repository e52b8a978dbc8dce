"""Personal data by weak supervision.

Wide patterns propose spans, each of a kind; for names that is any run of capitalised words. Six labelers (regex, gazetteer and
context) vote on a span: 2 for, 1 against, 0 nothing to say. Expectation-maximisation over the counts of all vote patterns in
the corpus estimates each labeler's reliability and each kind's share of true spans, without labels. The estimates then are the
targets of a logistic span classifier, which decides: over votes, kind and form, and over what no labeler sees, the span's shape,
its ending and the words beside it, hashed. It is fitted on a sample of at most about FIT_SPANS different spans of each kind, drawn by hash
and weighted by how often they come. The tables that go to the driver are that sample and a row for each pattern of votes and
form, of which there are at most KINDS x 3^6 x 12, whatever the corpus's size; texts are read once.

Defined results: null and empty texts have no spans; spans of a kind don't overlap, and where accepted spans of different
kinds do, the likelier one stays, of equal ones the longer, then the first; repeated rows are each read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.llm.common import cut, text_bytes, text_chunks, trim

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SSN", "IBAN", "NAME")
LABELERS = ("form", "check", "gazetteer", "context", "against", "border")
THRESHOLD = 0.5
#: Pseudo-counts of EM as a share of a kind's spans, and how many more of them say that a true span's checksum holds.
PRIOR, CHECKED = 0.005, 60
#: Different spans of a kind that the classifier is fitted on, about; and what its features of the text are hashed to.
FIT_SPANS, HASHED = 3000, 256

_TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)"
_CAPITAL = rf"(?!{_TITLE}\b)(?:[OD]['’])?[A-ZÀ-Þ][a-zß-ÿ]+(?:['-][A-ZÀ-Þ][a-zß-ÿ]+)?"
_WIDE = {
    "EMAIL": re.compile(r"[^\s@<>()\[\]\"',;:]+@[^\s@<>()\[\]\"',;:]+"),
    "PHONE": re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]?\d{3,4}(?!\d)|\+\d{8,15}(?!\d)|(?<![\w.])[+(]{0,2}\d(?:[ ./()-]{0,2}\d){6,14}(?![ .-]?\d)"),
    "IP": re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d)(?!\.\d)"),
    "CARD": re.compile(r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"),
    "SSN": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "IBAN": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"),
    "NAME": re.compile(rf"(?<![\w.])(?:{_TITLE}\.? {_CAPITAL}(?: (?:[A-Z]\. )?{_CAPITAL}){{0,3}}|{_CAPITAL}(?: (?:[A-Z]\. )?{_CAPITAL}){{1,3}})(?!\w)"),
}
_STRICT = {
    "EMAIL": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"),
    "PHONE": re.compile(r"(?:\+\d{1,3}[ .-]?)(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]?\d{3,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4}|\+\d{8,15}|0\d(?:([ .-])\d{2})(?:\1\d{2}){3}|[6-9]\d{2}(?:([ .-])\d{2})(?:\2\d{2}){2}|\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,5}"),
    "IP": re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"),
    "CARD": re.compile(r"\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}|\d{4}([ -]?)\d{6}\2\d{5}"),
    "SSN": re.compile(r"(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"),
    "IBAN": re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?"),
    "NAME": re.compile(rf"{_TITLE}\.? .+"),
}
_TLDS = set("com net org edu gov mil int info biz io ai co me tv app dev us uk de fr es it nl be ch at eu pt pl se no dk fi ie cz ru ua jp cn kr in br mx ar cl ca au nz za example test".split())
_COUNTRIES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 420 421 971 972".split())
_IBANS = set("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LT LU LV MT NL NO PL PT RO SA SE SI SK TR".split())
GIVEN_NAMES = set("James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth George Joshua Kevin Brian Edward Ronald Timothy Jason Nancy Lisa Betty Margaret Sandra Ashley Emily Kimberly Donna Michelle Laura Peter Hans Klaus Jürgen Wolfgang Ursula Monika Petra Sabine Stefan Andreas Pierre Jean Michel Philippe Nicolas Marie Nathalie Isabelle Sophie Catherine Juan Carlos José Luis Antonio Miguel Javier María Carmen Isabel Pilar Lucía Alice Bob".split())
_CONTEXT = {
    "EMAIL": ("mail", "contact", "write to", "schreib", "correo", "courriel", "adresse", "@"),
    "PHONE": ("phone", "tel", "call", "fax", "mobile", "cell", "telefon", "téléphone", "teléfono", "appel", "llama", "handy", "contact"),
    "IP": ("ip", "host", "server", "address", "adresse", "login", "logged", "client", "dirección", "from"),
    "CARD": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta", "payment"),
    "SSN": ("ssn", "social", "security", "sozial", "sécurité", "seguro"),
    "IBAN": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "NAME": ("name", "mr", "mrs", "dr", "dear", "by ", "signed", "author", "herr", "frau", "señor", "nom", "nombre"),
}
_NEAR = {kind: re.compile("|".join(r"\b" + re.escape(w) if w[0].isalpha() else re.escape(w) for w in words)) for kind, words in _CONTEXT.items()}
_AGAINST = ("version", "isbn", "issn", "doi", "sha", "build", "release", "serial", "order no", "invoice", "figure", "section", "chapter", "rev.", "id:")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _check(kind: str, v: str) -> int:
    digits = re.sub(r"\D", "", v)
    if kind == "CARD":
        return 2 if _luhn(digits) else 1
    if kind == "IBAN":
        s = v.replace(" ", "")
        return 2 if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else 1
    if kind == "IP":
        return 2 if all(int(x) < 256 and (x == "0" or x[0] != "0") for x in v.split(".")) else 1
    if kind == "PHONE":
        return 2 if 9 <= len(digits) <= 15 else 1
    if kind == "EMAIL":
        local, _, host = v.partition("@")
        return 1 if ".." in v or local[-1:] == "." or "." not in host else 2
    return 0


def _gazetteer(kind: str, v: str) -> int:
    if kind == "EMAIL":
        return 2 if v.rpartition(".")[2].lower() in _TLDS else 1
    if kind == "PHONE":
        m = re.match(r"\+(\d{1,3})", v)
        return 0 if not m else 2 if any(m[1][:k] in _COUNTRIES for k in (1, 2, 3)) else 1
    if kind == "CARD":
        return 2 if re.match(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35", v) else 1
    if kind == "IBAN":
        return 2 if v[:2] in _IBANS else 1
    if kind == "NAME":
        return 2 if set(v.split()) & GIVEN_NAMES else 1
    if kind == "IP":
        a, b = (int(x) for x in v.split(".")[:2])
        return 1 if a in (0, 127) else 0 if a == 10 or a > 223 or (a, b) == (192, 168) else 2
    return 0


def votes(text: str, kind: str, a: int, b: int) -> tuple[int, ...]:
    """The labelers' votes on a span."""
    v, left, right = text[a:b], text[max(0, a - 48):a].lower(), text[b:b + 24].lower()
    near = left + " " + right
    before, after = text[a - 1:a], text[b:b + 1]
    return (
        2 if _STRICT[kind].fullmatch(v) else 1,
        _check(kind, v),
        _gazetteer(kind, v),
        2 if _NEAR[kind].search(near) else 0,
        1 if any(w in left[-20:] for w in _AGAINST) else 0,
        1 if before.isalnum() or after.isalnum() or before == "@" or before and before in "=/_" else 2,
    )


def propose(text: str) -> list[tuple[str, int, int, tuple[int, ...], int]]:
    """(kind, start, end, votes, form) of the spans that the wide patterns find; form: a class of length and of being split by spaces."""
    out = []
    digits, at = any(c in text for c in "0123456789"), "@" in text
    for kind, pattern in _WIDE.items():
        if kind == "EMAIL" and not at or kind not in ("EMAIL", "NAME") and not digits:
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == "EMAIL":
                # Junk and punctuation around an address aren't part of it.
                s = _STRICT[kind].search(m.group())
                if s:
                    a, b = a + s.start(), a + s.end()
            if kind == "NAME":
                # A run that holds a given name begins with it: what stands before is a sentence's first word.
                words = m.group().split()
                k = next((k for k, w in enumerate(words) if w in GIVEN_NAMES), 0) if not _STRICT["NAME"].fullmatch(m.group()) else 0
                a += sum(len(w) + 1 for w in words[:k]) if k < len(words) - 1 else 0
            n = b - a
            out.append((kind, a, b, votes(text, kind, a, b), 2 * min(5, n // 6) + (" " in text[a:b])))
    return out


def text_features(text: str, kind: str, a: int, b: int) -> list[int]:
    """Hashed features of a span that the labelers don't look at: the words beside it, its shape and its ending."""
    v, before, after = text[a:b], _WORD.findall(text[max(0, a - 32):a]), _WORD.findall(text[b:b + 32])
    shape = _RUNS.sub(r"\1", "".join("d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in v))
    parts = (f"p|{before[-1].lower() if before else ''}", f"n|{after[0].lower() if after else ''}", f"s|{shape}", f"e|{v.rpartition('.')[2][-6:].lower()}")
    return [zlib.crc32(f"{kind}|{x}".encode()) % HASHED for x in parts]


_WORD, _RUNS = re.compile(r"\w+"), re.compile(r"(.)\1+")


def reliabilities(kinds: np.ndarray, v: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over vote patterns: (patterns x labelers) votes with their kinds and counts. Gives each pattern's probability, the
    labelers' P(vote | true, labeler) of each kind as (kinds x 2 x labelers x 3), and the kinds' shares. Pseudo-counts, a share of
    the kind's spans, say that labelers are better than chance, and that true spans hardly ever fail a checksum. A labeler that has
    nothing to say of any span of a kind doesn't count there."""
    prior = np.zeros((2, v.shape[1], 3)) + 1.0
    prior[1, :, 2] += 4
    prior[0, :, 1] += 4
    if v.shape[1] == len(LABELERS):
        prior[1, LABELERS.index("check"), 2] += CHECKED
    onehot = np.stack([v == k for k in range(3)], 2).astype(float)
    p = 1 / (1 + np.exp(-((v == 2).sum(1) - 1.5 * (v == 1).sum(1) - 0.5)))
    theta, share = np.zeros((len(KINDS), *prior.shape)), np.zeros(len(KINDS))
    for _ in range(rounds):
        old = p.copy()
        for kind in np.unique(kinds):
            k = kinds == kind
            weight = max(1.0, PRIOR * n[k].sum())
            own = np.stack([np.einsum("i,ilk->lk", n[k] * (1 - p[k]), onehot[k]), np.einsum("i,ilk->lk", n[k] * p[k], onehot[k])]) + prior * weight
            own[:, (v[k] == 0).all(0)] = 1
            theta[kind] = own = own / own.sum(2, keepdims=True)
            share[kind] = (n[k] @ p[k] + weight) / (n[k].sum() + 2 * weight)
            logit = np.log(share[kind] / (1 - share[kind])) + np.einsum("ilk,lk->i", onehot[k], np.log(own[1]) - np.log(own[0]))
            p[k] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(p - old).max() < 1e-9:
            break
    return p, theta, share


def features(kinds: np.ndarray, v: np.ndarray, form: np.ndarray) -> np.ndarray:
    """One-hot votes, kinds and forms."""
    cols = [np.ones(len(kinds))] + [kinds == k for k in range(len(KINDS))] + [form == k for k in range(12)] + [v[:, j] == k for j in range(v.shape[1]) for k in (1, 2)]
    return np.stack(cols, 1).astype(float)


def fit_classifier(x: np.ndarray, target: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression of soft targets by Newton steps."""
    w = np.zeros(x.shape[1])
    n = n / n.sum() * min(n.sum(), 1e5)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (target - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def hashed(feats: list[list[int]]) -> np.ndarray:
    """(spans x HASHED) how often each hashed feature is there."""
    out = np.zeros((len(feats), HASHED))
    for i, f in enumerate(feats):
        np.add.at(out[i], f, 1)
    return out


def _suspects(texts: pa.Array) -> np.ndarray:
    """Texts with a digit, an @, or a capital after a letter and a space."""
    out = []
    for first, part in text_chunks(texts):
        data, offs = text_bytes(part)
        hit = (data == 64) | ((data >= 48) & (data <= 57))
        if len(data) > 2:
            up = ((data[2:] >= 65) & (data[2:] <= 90)) | (data[2:] == 0xC3)
            hit[2:] |= up & (data[1:-1] == 32) & ((data[:-2] >= 97) | (data[:-2] == 46))
        out.append(np.unique(np.searchsorted(offs, np.flatnonzero(hit), "right") - 1) + first)
    return np.concatenate(out) if out else np.zeros(0, int)


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, kind, start_char, end_char, pattern, feats): proposed spans, the votes and form as a number, and the text's
    features; row tells repeated rows apart."""
    table = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in _suspects(batch.column(1)):
                d, t, r = (batch.column(k)[int(i)].as_py() for k in range(3))
                for kind, a, b, v, form in propose(t):
                    code = form
                    for x in v:
                        code = code * 3 + x
                    rows.append((d, r, KINDS.index(kind), a, b, code, text_features(t, kind, a, b)))
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.list_(pa.int16())))], ["doc_id", "row", "kind", "start_char", "end_char", "pattern", "feats"])
            del batch
            trim()

    return table.mapInArrow(run, "doc_id bigint, row bigint, kind int, start_char int, end_char int, pattern int, feats array<smallint>")


def _unpacked(pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = np.stack([pattern // 3 ** (len(LABELERS) - 1 - j) % 3 for j in range(len(LABELERS))], 1)
    return v, pattern // 3 ** len(LABELERS)


def fit(kind: np.ndarray, pattern: np.ndarray, n: np.ndarray, spans: list[tuple[int, int, list[int], int]]) -> tuple[np.ndarray, np.ndarray]:
    """(the log odds that each pattern adds, the log odds of each hashed feature). spans: (kind, pattern, features, number), the sample."""
    v, form = _unpacked(pattern)
    p, _, _ = reliabilities(kind, v, n.astype(float))
    x, at = features(kind, v, form), {k: i for i, k in enumerate(zip(kind.tolist(), pattern.tolist()))}
    spans = sorted(spans)
    which = np.array([at[k, q] for k, q, _, _ in spans])
    w = fit_classifier(np.concatenate([x[which], hashed([f for _, _, f, _ in spans])], 1), p[which], np.array([c for *_, c in spans], float))
    return x @ w[:x.shape[1]], w[x.shape[1]:]


def classify(found: DataFrame) -> DataFrame:
    """found with each span's probability: EM over all patterns' counts, then the span classifier."""
    spark = found.sparkSession
    counts = found.groupBy("kind", "pattern").agg(F.count("*").alias("n")).toArrow().sort_by([("kind", "ascending"), ("pattern", "ascending")])
    kind, pattern, n = (counts[c].to_numpy() for c in ("kind", "pattern", "n"))
    if not len(n):
        return found.withColumn("probability", F.lit(None).cast("double"))
    one = F.xxhash64("kind", "pattern", "feats", F.lit(5))
    many = {r.kind: r.m for r in found.groupBy("kind").agg(F.approx_count_distinct(one).alias("m")).collect()}
    share = F.create_map(*[F.lit(x) for k, m in many.items() for x in (k, min(1.0, FIT_SPANS / max(m, 1)))])
    some = found.where(F.pmod(one, F.lit(1 << 30)) / (1 << 30) < share[F.col("kind")]).groupBy("kind", "pattern", "feats").agg(F.count("*").alias("n")).collect()
    odds, own = fit(kind, pattern, n, [(r.kind, r.pattern, r.feats, r.n) for r in some] or [(int(kind[0]), int(pattern[0]), [], 1)])
    table = spark.createDataFrame(pa.table({"kind": kind, "pattern": pattern, "odds": odds}))
    # A row for each pattern of votes and form: at most len(KINDS) * 3 ** 6 * 12.
    out, weight = found.join(F.broadcast(table), ["kind", "pattern"]), F.array(*map(F.lit, own.tolist()))
    score = F.col("odds") + F.aggregate("feats", F.lit(0.0), lambda a, f: a + F.get(weight, f.cast("int")))
    return out.withColumn("probability", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score))))).drop("odds", "feats")


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kind, start_char, end_char, probability) of the spans that the classifier accepts."""
    scored = classify(cut(candidates(docs, doc_id, text))).where(F.col("probability") >= threshold)
    span = F.struct("probability", (F.col("end_char") - F.col("start_char")).alias("size"), (-F.col("start_char")).alias("first"), (-F.col("kind")).alias("k"))
    # A span goes if one that overlaps it in the same text is before it by likelihood, length, place and kind.
    spans = scored.withColumn("rank", span)
    # Runs of spans that overlap in a chain; nearly all have one.
    order = Window.partitionBy("row").orderBy("start_char", "end_char", "kind")
    spans = spans.withColumn("new", (F.col("start_char") >= F.coalesce(F.max("end_char").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("int"))
    spans = spans.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.withColumn("all", F.collect_list(F.struct("start_char", "end_char", "rank")).over(Window.partitionBy("row", "run")))
    spans = spans.where(~F.exists("all", lambda o: (o["start_char"] < F.col("end_char")) & (o["end_char"] > F.col("start_char")) & (o["rank"] > F.col("rank"))))
    names = F.array(*map(F.lit, KINDS))
    return spans.select("doc_id", F.element_at(names, F.col("kind") + 1).alias("kind"), "start_char", "end_char", F.round("probability", 6).alias("probability"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_pii": op1_pii}
ORACLES: dict[str, str] = {}
