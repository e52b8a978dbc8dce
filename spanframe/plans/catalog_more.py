"""Queries on spans, tokenizer rules, morphemes, ids, word pieces, listings and loaded bundles, each with its SQL."""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from spanframe.functions import ids, kernels, lexical
from spanframe.operators import constraints as C
from spanframe.operators import encoder as N
from spanframe.operators import entities as E
from spanframe.operators import morphemes as M
from spanframe.operators import patterns as P
from spanframe.operators import regex_tokenizer as X
from spanframe.operators import sentences as S
from spanframe.operators import tokens as T
from spanframe.operators import wordpiece as W
from spanframe.plans import catalog_rules, load, parity
from spanframe.plans.catalog_lexical import STARTS_SQL, TOKENS, WORDS, WS_SQL, _sentence_tokens, distinct_words, documents
from spanframe.plans.catalog_rules import RULED_SQL, ruled, tokens
from spanframe.plans.pipeline import Pipeline
from spanframe.sources import bundle, lines

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


# Spans


@query(f"""WITH {TOKENS}, n AS (SELECT doc_id, count(*)::INT AS n, max(idx + length(text) + has_space::INT) AS size FROM tok GROUP BY doc_id),
r AS (SELECT doc_id, n, size, (doc_id % n)::INT AS s, least((doc_id % n)::INT + (doc_id % 4)::INT, n) AS e FROM n)
SELECT r.doc_id, s AS start, e AS "end", a.idx AS start_char, CASE WHEN s = e THEN a.idx ELSE b.idx + length(b.text) END::INT AS end_char, CASE WHEN s = e THEN '' ELSE substring(d.text, a.idx + 1, b.idx + length(b.text) - a.idx) END AS text
FROM r JOIN documents d ON d.doc_id = r.doc_id JOIN tok a ON a.doc_id = r.doc_id AND a.i = s LEFT JOIN tok b ON b.doc_id = r.doc_id AND b.i = e - 1""")
def span_slices(spark, sf_dir):
    """A span of up to three tokens of each document, some of them empty."""
    x = T.nested(documents(spark, sf_dir)).withColumn("n", F.size("tokens"))
    start = (F.col("doc_id") % F.col("n")).cast("int")
    x = x.withColumn("s", start).withColumn("e", F.least(start + (F.col("doc_id") % 4).cast("int"), F.col("n")))
    return x.select("doc_id", T.span(F.col("tokens"), F.col("s"), F.col("e")).alias("x")).select("doc_id", "x.start", "x.end", "x.start_char", "x.end_char", "x.text")


@query(f"""WITH {TOKENS} SELECT doc_id, max(CASE WHEN i = 0 THEN text END) AS first, max_by(text, i) AS last, max_by(has_space, i) AS spaced, max_by(idx, i) AS at FROM tok GROUP BY doc_id""")
def token_access(spark, sf_dir):
    x = T.nested(documents(spark, sf_dir))
    last = F.element_at("tokens", -1)
    return x.select("doc_id", F.element_at("tokens", 1)["text"].alias("first"), last["text"].alias("last"), last["has_space"].alias("spaced"), last["idx"].alias("at"))


# Lexical attributes and predicates


@query(rf"{WORDS}, w AS (SELECT text FROM words UNION ALL SELECT unnest(['', ' ', chr(160), ' x'])) SELECT text, regexp_matches(text, '^[{WS_SQL}]*$') AND NOT regexp_matches(text, '[^{WS_SQL}]') AS encoder, regexp_matches(text, '^[{WS_SQL}]+$') AND NOT regexp_matches(text, '[^{WS_SQL}]') AS ruler FROM w")
def space_flags(spark, sf_dir):
    """White space for the encoder, where the empty token counts, and for rules, where it doesn't."""
    w = distinct_words(spark, sf_dir).select("text").unionByName(spark.createDataFrame([("",), (" ",), (" ",), (" x",)], "text string"))
    return w.select("text", lexical.is_space_or_empty(F.col("text")).alias("encoder"), lexical.is_space(F.col("text")).alias("ruler"))


@query("""SELECT o_orderkey, CASE v WHEN '' THEN 0 WHEN 'I' THEN 1 WHEN 'O' THEN 2 WHEN 'B' THEN 3 WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 END AS code
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 1 THEN (o_orderkey % 5)::VARCHAR ELSE ['', 'I', 'B', 'x'][(o_orderkey % 4)::INT + 1] END AS v FROM orders)""")
def iob_codes(spark, sf_dir):
    k = F.col("o_orderkey")
    v = F.when(k % 3 == 0, F.col("o_orderstatus")).when(k % 3 == 1, (k % 5).cast("string")).otherwise(F.element_at(F.array(*map(F.lit, ["", "I", "B", "x"])), (k % 4).cast("int") + 1))
    return orders(spark, sf_dir).select("o_orderkey", lexical.iob_code(v).alias("code"))


@query(f"{STARTS_SQL} SELECT doc_id, count(*) AS n, sum((sent_start = 1 OR idx = 0)::INT)::BIGINT AS starts FROM st GROUP BY doc_id")
def sentence_start_predicate(spark, sf_dir):
    t = S.sentence_starts(_sentence_tokens(spark, sf_dir))
    return t.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(P.compile_test({"SENT_START": True}).cast("int")).alias("starts"))


@query(f"""{RULED_SQL}, p AS (SELECT doc_id, count(*) FILTER (label IS NOT NULL) AS b, 2 * count(*) FILTER (label = 'PHONE') AS i, count(*) AS n FROM (SELECT doc_id, label FROM ents) GROUP BY doc_id)
SELECT doc_id, b::BIGINT AS begins, (b + i)::BIGINT AS inside, (n - b - i)::BIGINT AS outside, (n - i)::BIGINT AS not_inner FROM p""")
def iob_predicates(spark, sf_dir):
    t = ruled(spark, sf_dir)
    tests = {"begins": {"ENT_IOB": "B"}, "inside": {"ENT_IOB": {"IN": ["I", 3]}}, "outside": {"ENT_IOB": {"NOT_IN": [1, "B"]}}, "not_inner": {"ENT_IOB": {"NOT_IN": ["I"]}}}
    return t.groupBy("doc_id").agg(*[F.sum(P.compile_test(x).cast("int")).alias(k) for k, x in tests.items()])


# String ids

_64 = "18446744073709551616::UHUGEINT"


def _mul(x: str, m: int) -> str:
    """(x * m) mod 2^64 of numbers under 2^64, which never leaves 128 bits."""
    return f"((({x})::UHUGEINT * {m}::UHUGEINT) % {_64})"


def _xor(x: str, y: str) -> str:
    return f"xor(({x})::UBIGINT, ({y})::UBIGINT)::UHUGEINT"


def _shift(x: str, n: int) -> str:
    return _xor(x, f"(({x})::UHUGEINT >> {n}::UHUGEINT)")


def _little(first: str, size: str) -> str:
    """The number that `size` bytes from byte `first` on are, the lowest first."""
    return f"('0x' || array_to_string(list_transform(range({size}), lambda b: substr(hx, (2 * ({first} + ({size}) - 1 - b) + 1)::INT, 2)), ''))::UBIGINT::UHUGEINT"


_M = 0xC6A4A7935BD1E995


def hash_sql(source: str) -> str:
    """CTEs up to hashed (text, h): the hash of each text of a query, of any length."""
    step = _mul(_xor("h", "k"), _M)
    return f"""bytes AS (SELECT text, hex(encode(text)) AS hx, strlen(text)::BIGINT AS n FROM ({source})),
blocks AS (SELECT text, hx, n, list_transform(range(n // 8), lambda j: {_little('8 * j', '8')}) AS ks, CASE WHEN n % 8 > 0 THEN {_little('n - n % 8', 'n % 8')} END AS tail FROM bytes),
mixed AS (SELECT text, tail, list_prepend({_xor('1', _mul('n', _M))}, list_transform(list_transform(list_transform(ks, lambda k: {_mul('k', _M)}), lambda k: {_shift('k', 47)}), lambda k: {_mul('k', _M)})) AS l FROM blocks),
body AS (SELECT text, tail, list_reduce(l, lambda h, k: {step}) AS h FROM mixed),
ended AS (SELECT text, CASE WHEN tail IS NULL THEN h ELSE {_mul(_xor('h', 'tail'), _M)} END AS h FROM body),
shifted AS (SELECT text, {_mul(_shift('h', 47), _M)} AS h FROM ended), hashed AS (SELECT text, {_shift('h', 47)} AS h FROM shifted)"""


ORACLES["string_hashes_whole"] = f"{WORDS}, {hash_sql('SELECT DISTINCT lower(text) AS text FROM words')} SELECT text, h::VARCHAR AS id FROM hashed"
_SYMBOLS_SQL = f"symbols AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {v}::UHUGEINT)' for k, v in ids.SYMBOLS.items())}) v(text, id))"


def ids_sql(source: str) -> str:
    return f"{hash_sql(source)}, {_SYMBOLS_SQL}, ided AS (SELECT text, CASE WHEN text = '' THEN 0::UHUGEINT ELSE coalesce(symbols.id, h) END AS id FROM hashed LEFT JOIN symbols USING (text))"


ORACLES["string_ids"] = f"{WORDS}, {ids_sql('SELECT text FROM words')} SELECT id::DECIMAL(20,0) AS id, text FROM ided"


@query(f"""WITH n AS (SELECT n_name AS text FROM nation UNION ALL SELECT unnest(['', 'NOUN', 'nsubj', 'FLAG19', 'IS_ALPHA', '_', 'DET', 'Zoë', '日本語']) AS text), {ids_sql('SELECT text FROM n')}
SELECT text, (CASE WHEN text = 'FLAG19' THEN 19 ELSE id END)::VARCHAR AS id FROM ided""")
def symbol_ids(spark, sf_dir):
    """Built-in symbols, the empty string and names that are none."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("text"))
    n = n.unionByName(spark.createDataFrame([(x,) for x in ("", "NOUN", "nsubj", "FLAG19", "IS_ALPHA", "_", "DET", "Zoë", "日本語")], "text string"))
    return n.select("text", ids.unsigned(ids.string_id(F.col("text"))).cast("string").alias("id"))


def buckets_sql(id_: str, seed: int, source: str) -> str:
    """CTE bucketed (text, b): the four buckets of each id."""
    add = lambda x, y: f"((({x})::UHUGEINT + ({y})::UHUGEINT) % {_64})"
    rot = f"(((m::UHUGEINT * {1 << 31}::UHUGEINT) % {_64}) + (m::UHUGEINT >> 33::UHUGEINT))"
    fmix = lambda x: _shift(_mul(_shift(_mul(_shift(x, 33), 0xFF51AFD7ED558CCD), 33), 0xC4CEB9FE1A85EC53), 33)
    a0 = _xor(_xor(_mul(rot, 0x4CF5AD432745937F), str(seed)), "8")
    low = lambda x: f"({x} % 4294967296::UHUGEINT)::BIGINT"
    high = lambda x: f"({x} >> 32::UHUGEINT)::BIGINT"
    return f"""b0 AS (SELECT text, {_mul(id_, 0x87C37B91114253D5)} AS m FROM {source}), b1 AS (SELECT text, {a0} AS a, {_xor(str(seed), '8')} AS b FROM b0), b2 AS (SELECT text, {add('a', 'b')} AS a, b FROM b1),
b3 AS (SELECT text, a, {add('b', 'a')} AS b FROM b2), b4 AS (SELECT text, {_shift('a', 33)} AS a, {_shift('b', 33)} AS b FROM b3), b5 AS (SELECT text, {_shift(_mul('a', 0xFF51AFD7ED558CCD), 33)} AS a, {_shift(_mul('b', 0xFF51AFD7ED558CCD), 33)} AS b FROM b4),
b6 AS (SELECT text, {_shift(_mul('a', 0xC4CEB9FE1A85EC53), 33)} AS a, {_shift(_mul('b', 0xC4CEB9FE1A85EC53), 33)} AS b FROM b5), b7 AS (SELECT text, {add('a', 'b')} AS a, b FROM b6), b8 AS (SELECT text, a, {add('b', 'a')} AS b FROM b7),
bucketed AS (SELECT text, [{low('a')}, {high('a')}, {low('b')}, {high('b')}] AS b FROM b8)"""


ORACLES["hash_buckets"] = f"""{WORDS}, low AS (SELECT text, lower(text) AS l FROM words), {ids_sql('SELECT DISTINCT l AS text FROM low')}, {buckets_sql('id', 7, 'ided')} SELECT low.text, b AS buckets FROM low JOIN bucketed ON bucketed.text = l"""


@query(f"""{WORDS}, {ids_sql('SELECT text FROM words')}, {buckets_sql('id', 11, 'ided')}
SELECT text, [list_sum(list_transform(b, lambda x: x % 50))::DOUBLE, list_sum(list_transform(b, lambda x: (x % 50) * (x % 50) % 97))::DOUBLE] AS vector FROM bucketed""")
def hash_embedding(spark, sf_dir):
    """Each token's vector: the sum of the four rows of a table that its id's buckets choose."""
    k = np.arange(50)
    v = kernels.hash_embed(ids.string_id(F.col("text")), 11, np.stack([k, k * k % 97], 1))
    return distinct_words(spark, sf_dir).select("text", F.transform(v, lambda x: x.cast("double")).alias("vector"))


# Tokenizer rules


def _counted(spark, sf_dir, config):
    return X.flat(documents(spark, sf_dir), config).groupBy("doc_id")


@query(rf"WITH {TOKENS}, c AS (SELECT doc_id, regexp_extract(text, '^[(]*') AS lead, text FROM tok) SELECT doc_id, sum(length(lead) + (length(text) > length(lead))::INT)::BIGINT AS n FROM c GROUP BY doc_id")
def tokenize_prefixes(spark, sf_dir):
    """Each bracket at the beginning of a token is a token of its own."""
    return _counted(spark, sf_dir, X.Config(prefix=r"\(")).agg(F.count("*").alias("n"))


@query(rf"""WITH {TOKENS}, c AS (SELECT doc_id, CASE WHEN starts_with(text, '-') THEN 'x' || substr(text, 2) ELSE text END AS text FROM tok)
SELECT doc_id, sum(CASE WHEN contains(text, '-') THEN len(list_filter(string_split(text, '-'), lambda s: s <> '')) + length(text) - length(replace(text, '-', '')) ELSE 1 END)::BIGINT AS n FROM c GROUP BY doc_id""")
def tokenize_infixes(spark, sf_dir):
    """Hyphens within tokens cut them; one at the very beginning doesn't."""
    return _counted(spark, sf_dir, X.Config(infix="-")).agg(F.count("*").alias("n"))


@query(rf"""WITH {TOKENS}, c AS (SELECT doc_id, regexp_extract(text, '^[(]*') AS lead, text FROM tok), d AS (SELECT doc_id, length(lead) AS a, substr(text, length(lead) + 1) AS rest FROM c),
e AS (SELECT doc_id, a, rest, length(regexp_extract(rest, '[).,]*$')) AS z FROM d) SELECT doc_id, sum(a + z + (length(rest) > z)::INT)::BIGINT AS n FROM e GROUP BY doc_id""")
def tokenize_both_ends(spark, sf_dir):
    """Brackets before and marks after, taken together as long as there are some, the latter in their order."""
    return _counted(spark, sf_dir, X.Config(prefix=r"\(", suffix=r"[).,]$")).agg(F.count("*").alias("n"))


@query(f"""WITH {TOKENS} SELECT doc_id, sum(CASE WHEN text IN ('the', 'and') THEN 2 ELSE 1 END)::BIGINT AS n, sum((text = 'the')::INT)::BIGINT AS normed, sum((text = 'of')::INT)::BIGINT AS overridden FROM tok GROUP BY doc_id""")
def tokenize_exceptions(spark, sf_dir):
    """Whole tokens that are exceptions have tokens and norms of their own; another text has a norm by its id."""
    c = X.Config(exceptions={"the": [("t", None), ("he", "HE")], "and": [("a", None), ("nd", None)]}, norm_ids={ids.string_id_of("of"): "OF"})
    return _counted(spark, sf_dir, c).agg(F.count("*").alias("n"), F.sum((F.col("norm") == "HE").cast("int")).alias("normed"), F.sum((F.col("norm") == "OF").cast("int")).alias("overridden"))


@query(f"""WITH {TOKENS}, p AS (SELECT doc_id, text = 'of' AND has_space AND lead(text) OVER w = 'the' AS hit FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY i)) SELECT doc_id, (count(*) - count(*) FILTER (hit))::BIGINT AS n, count(*) FILTER (hit) AS phrases FROM p GROUP BY doc_id""")
def tokenize_phrase_exceptions(spark, sf_dir):
    """Two tokens with a space between them that are one exception."""
    c = X.Config(exceptions={"of the": [("of the", "OFTHE")]})
    return _counted(spark, sf_dir, c).agg(F.count("*").alias("n"), F.sum((F.col("norm") == "OFTHE").cast("int")).alias("phrases"))


@query(rf"""WITH {TOKENS} SELECT doc_id, sum(CASE WHEN regexp_matches(text, '^[0-9]+-[0-9]+$') OR NOT contains(text, '-') OR starts_with(text, 'a') THEN 1 ELSE len(list_filter(string_split(t, '-'), lambda s: s <> '')) + length(t) - length(replace(t, '-', '')) END)::BIGINT AS n
FROM (SELECT *, CASE WHEN starts_with(text, '-') THEN 'x' || substr(text, 2) ELSE text END AS t FROM tok) GROUP BY doc_id""")
def tokenize_whole_matches(spark, sf_dir):
    """What the patterns for whole tokens and addresses fit isn't cut at infixes."""
    return _counted(spark, sf_dir, X.Config(infix="-", token_match="[0-9]+-[0-9]+$", url_match="a")).agg(F.count("*").alias("n"))


@query(rf"""WITH {TOKENS}, n AS (SELECT doc_id, count(*) AS n, bool_or(regexp_matches(text, '[^.,!?][.,!?]$')) AS cut FROM tok GROUP BY doc_id) SELECT count(*) AS documents, sum(n)::BIGINT AS tokens, count(*) FILTER (cut) AS mismatches, count(*) FILTER (cut) = 0 AS passed FROM n""")
def token_parity(spark, sf_dir):
    """Two tokenizers compared document by document."""
    return parity.token_summary(tokens(spark, sf_dir), X.flat(documents(spark, sf_dir), X.Config(suffix=r"(?<=[^.,!?])[.,!?]$")))


# Morphemes

_FEATURES = [("名詞,固有名詞,人名,姓,*,*,田中,タナカ", "名詞-固有名詞-人名-姓", "", "田中", "タナカ"), ("名詞,数,*,*,*,*,三,サン", "名詞-数詞", "", "三", "サン"), ("動詞,自立,*,*,五段・ラ行,基本形,走る,ハシル", "動詞-一般", "五段・ラ行;基本形", "走る", "ハシル"), ("助詞,係助詞,*,*,*,*,は,ハ", "助詞-係助詞", "", "は", "ハ"), ("記号,句点,*,*,*,*,。,。", "補助記号-句点", "", "。", "。"), ("名詞,接尾,助数詞,*,*,*,*,", "接尾辞-名詞的-助数詞", "", "", "")]


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"""SELECT o_orderkey, {_listed(t for _, t, *_ in _FEATURES)}[k] AS tag, {_listed(x[2] for x in _FEATURES)}[k] AS inflection, {_listed(x[3] for x in _FEATURES)}[k] AS lemma, {_listed(x[4] for x in _FEATURES)}[k] AS reading FROM (SELECT o_orderkey, (o_orderkey % 6)::INT + 1 AS k FROM orders)""")
def morpheme_features(spark, sf_dir):
    """Feature rows of an analyser parsed and mapped to tags."""
    o = orders(spark, sf_dir).select("o_orderkey", F.element_at(F.array(*[F.lit(x[0]) for x in _FEATURES]), (F.col("o_orderkey") % 6).cast("int") + 1).alias("f")).select("o_orderkey", M.parse_feature(F.col("f")).alias("f"))
    return o.select("o_orderkey", M.unidic_tag(F.col("f")).alias("tag"), *[F.coalesce(F.col(f"f.{c}"), F.lit("")).alias(c) for c in ("inflection", "lemma", "reading")])


@query("""SELECT o_orderkey, array_to_string(list_filter([o_orderpriority, '*', o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN '*' ELSE 'x' END], lambda x: x <> '*'), '-') AS tag,
CASE WHEN o_orderkey % 3 = 0 THEN 'Reading=' || translate(o_orderpriority || '=|', '=|', '__') ELSE 'Inflection=' || o_orderstatus || '|Reading=' || translate(o_orderpriority || '=|', '=|', '__') END AS morph FROM orders""")
def morpheme_attributes(spark, sf_dir):
    k = F.col("o_orderkey")
    parts = F.array("o_orderpriority", F.lit("*"), "o_orderstatus", F.when(k % 2 == 0, "*").otherwise("x"), F.lit("more"))
    return orders(spark, sf_dir).select("o_orderkey", M.morpheme_tag(parts).alias("tag"), M.morph_string(F.when(k % 3 == 0, "").otherwise(F.col("o_orderstatus")), F.concat("o_orderpriority", F.lit("=|"))).alias("morph"))


def _rows(spark, sf_dir, parts: list[tuple[str, str]], gap=None):
    """Morphemes (doc_id, k, surface, start, end, tag, norm) of each order: the parts one after another; gap: (before which, when)."""
    o, at, rows = orders(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id")), F.lit(0), []
    for k, (surface, tag) in enumerate(parts):
        if gap and gap[0] == k:
            at = at + F.when(gap[1], 1).otherwise(0)
        rows.append(F.struct(F.lit(k).alias("k"), F.lit(surface).alias("surface"), at.alias("start"), (at + len(surface)).alias("end"), F.lit(tag).alias("tag"), F.lit(surface).alias("norm")))
        at = at + len(surface)
    return o.select("doc_id", F.inline(F.array(*rows)))


_TOWN = [("本", "名詞-固有名詞-地名-一般"), ("町", "名詞-普通名詞-一般"), ("12", "名詞-数詞"), ("丁目", "名詞-普通名詞-一般")]


@query("SELECT o_orderkey AS doc_id, unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['本町', '12', '丁目'] ELSE ['本', '町', '12', '丁目'] END) AS surface FROM orders")
def merge_towns(spark, sf_dir):
    """A town's name and its sign become one before a number and its sign, but not over a gap."""
    return M.merge_towns(_rows(spark, sf_dir, _TOWN, (2, F.col("doc_id") % 2 == 1))).select("doc_id", "surface")


@query("""SELECT o_orderkey AS doc_id, unnest(CASE o_orderkey % 3 WHEN 0 THEN [0, 1, 2] WHEN 1 THEN [0, 1] ELSE [0] END)::INT AS i, unnest(CASE o_orderkey % 3 WHEN 0 THEN ['ab', '  ', 'c'] WHEN 1 THEN ['ab', 'c'] ELSE [' x '] END) AS text,
unnest(CASE o_orderkey % 3 WHEN 0 THEN [FALSE, FALSE, FALSE] WHEN 1 THEN [TRUE, FALSE] ELSE [FALSE] END) AS has_space, unnest(CASE o_orderkey % 3 WHEN 0 THEN [0, 2, 4] WHEN 1 THEN [0, 3] ELSE [0] END)::INT AS idx FROM orders""")
def gap_tokens(spark, sf_dir):
    """What lies between morphemes: two spaces are a token, one is the token's before; a text without morphemes is one."""
    k = F.col("o_orderkey") % 3
    o = orders(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), k.alias("k3"), F.when(k == 0, "ab  c").when(k == 1, "ab c").otherwise(" x ").alias("text"))
    row = lambda n, s, a: F.struct(F.lit(n).alias("k"), F.lit(s).alias("surface"), a.alias("start"), (a + len(s)).alias("end"), F.lit("t").alias("tag"))
    rows = o.where("k3 < 2").select("doc_id", F.inline(F.array(row(0, "ab", F.lit(0)), row(1, "c", F.when(F.col("k3") == 0, 4).otherwise(3)))))
    return M.with_gaps(rows, o.select("doc_id", "text")).select("doc_id", F.col("i").cast("int").alias("i"), "text", "has_space", "idx")


@query("SELECT o_orderkey AS doc_id, unnest(['a', ' ', 'b', ' ', 'c']) AS surface, unnest([0, 1, 3, 4, 5])::INT AS k FROM orders")
def space_collapse(spark, sf_dir):
    """A white-space morpheme after another one goes."""
    s = M.SPACE_TAG
    return M.collapse_spaces(_rows(spark, sf_dir, [("a", "t"), (" ", s), (" ", s), ("b", "t"), (" ", s), ("c", "t"), ("x", s)])).where("surface <> 'x'").select("doc_id", "surface", "k")


@query("""SELECT o_orderkey AS doc_id, unnest([0, 1, 2, 3])::INT AS k, unnest(['o', 'p', 'q', 'r']) AS surface, unnest(['ORTH', 'ONE', 'TWO', 'PLAIN']) AS pos FROM orders""")
def pos_resolution(spark, sf_dir):
    """By tag and text, else by tag and next tag, which says both, else by tag."""
    rows = _rows(spark, sf_dir, [("o", "a"), ("p", "a"), ("q", "b"), ("r", "b")])
    return M.resolve_pos_table(rows, {("a", "o"): "ORTH"}, {("a", "b"): ("ONE", "TWO")}, {"b": "PLAIN", "a": "NEVER"}).select("doc_id", "k", "surface", "pos")


@query("""SELECT o_orderkey AS doc_id, unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['ab', 'c', 'de'] ELSE ['a', 'bc', 'd', 'e'] END) AS surface, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [0, 2, 3] ELSE [0, 1, 4, 5] END)::INT AS start FROM orders""")
def compatibility_rules(spark, sf_dir):
    """Contiguous tokens that make up a rule's text give way to the rule's own; the longer rule counts, and none fires over a gap."""
    rows = _rows(spark, sf_dir, [("a", "t"), ("bc", "t"), ("d", "t"), ("e", "t")], (2, F.col("doc_id") % 2 == 1))
    part = lambda *x: [{"surface": s, "tag": "n"} for s in x]
    rules = [{"text": "abcde", "tokens": part("ab", "c", "de")}, {"text": "abcd", "tokens": part("abcd")}]
    return M.apply_rules_table(rows, rules).select("doc_id", "surface", "start")


@query("""SELECT o_orderkey AS doc_id, unnest([0, 1, 2, 3])::INT AS i, unnest(['ab', ' / ', 'c', 'd']) AS text, unnest([FALSE, FALSE, TRUE, FALSE]) AS has_space, unnest([0, 2, 5, 7])::INT AS idx FROM orders""")
def aligned_morphemes(spark, sf_dir):
    """Surfaces found in the text one after another; what is between them is a token, but for a single space."""
    rows = _rows(spark, sf_dir, [("ab", "t"), ("c", "t"), (" ", "t"), ("d", "t")])
    texts = orders(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), F.lit("ab / c d").alias("text"))
    return M.align_table(rows, texts)


# Word pieces

_PIECES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz", *("##" + c for c in "abcdefghijklmnopqrstuvwxyz")]


@query(f"""{WORDS}, w AS (SELECT text, lower(text) AS l FROM words), c AS (SELECT text, l, regexp_matches(l, '^[a-z]+$') AND NOT contains(l, chr(10)) AND length(l) <= 100 AS ok FROM w)
SELECT text, CASE WHEN ok THEN list_transform(range(1, length(l) + 1), lambda k: (ord(l[k]) - 97 + CASE WHEN k = 1 THEN 4 ELSE 30 END)::INT) WHEN regexp_matches(l, '^[{WS_SQL}]*$') THEN []::INT[] ELSE [1]::INT[] END AS ids, ok AS aligned FROM c""")
def word_pieces(spark, sf_dir):
    """The longest pieces from the left; a word with a character that no piece has is unknown."""
    v = W.word_ids(F.col("text"), W.load_vocabulary("\n".join(_PIECES)), nfkc=False)
    return distinct_words(spark, sf_dir).select("text", v.alias("v")).select("text", "v.ids", "v.aligned")


# Sentences and constraints


@query(f"WITH {TOKENS} SELECT doc_id, sum((i % 5 = 0)::INT)::BIGINT AS by_heads, sum((length(text) % 2 = 1)::INT)::BIGINT AS by_classes FROM tok GROUP BY doc_id")
def sentence_starts_otherwise(spark, sf_dir):
    """Starts from heads, each fifth token being a root of those after it in a chain, and from a classifier's classes."""
    t = S.starts_from_heads(tokens(spark, sf_dir).withColumn("head", F.when(F.col("i") % 5 == 0, 0).otherwise(-1))).withColumnRenamed("sent_start", "parsed")
    t = S.starts_from_classes(t.withColumn("class", F.length("text") % 2), "class")
    return t.groupBy("doc_id").agg(F.sum((F.col("parsed") == 1).cast("int")).alias("by_heads"), F.sum((F.col("sent_start") == 1).cast("int")).alias("by_classes"))


@query(f"""WITH spans AS ({catalog_rules.ORACLES['char_span_expand']}), toks AS (WITH {TOKENS} SELECT * FROM tok)
SELECT t.doc_id, sum((s.start IS NOT NULL)::INT)::BIGINT AS outside, count(*) AS n FROM toks t LEFT JOIN spans s ON s.doc_id = t.doc_id AND t.i >= s.start AND t.i < s."end" GROUP BY t.doc_id""")
def character_constraints(spark, sf_dir):
    """A character range of each document, grown to whole tokens, is outside of any entity; ranges that touch no token are passed over."""
    x = catalog_rules._ranges(spark, sf_dir)
    s = T.char_span(F.col("tokens"), F.col("a"), F.col("b"), "expand")
    w = x.where(kernels.let(s, lambda s: s.isNotNull() & (s["start"] < s["end"]))).select("doc_id", F.lit("char_outside").alias("kind"), F.col("a").alias("start"), F.col("b").alias("end"), F.lit(None).cast("string").alias("label"), F.lit("expand").alias("alignment"))
    t = C.apply(tokens(spark, sf_dir), w)
    return t.groupBy("doc_id").agg(F.sum((F.col("ent_iob") == 2).cast("int")).alias("outside"), F.count("*").alias("n"))


@query("""SELECT o_orderkey AS doc_id, CASE l WHEN '-' THEN 'blocked' WHEN '?' THEN 'missing' WHEN 'O' THEN 'outside' ELSE 'entity' END AS kind, (o_orderkey % 9)::INT AS start, (o_orderkey % 9 + 2)::INT AS "end", CASE WHEN l NOT IN ('-', '?', 'O') THEN l END AS label
FROM (SELECT o_orderkey, ['-', '?', 'O', 'PERSON', 'a:b'][(o_orderkey % 5)::INT + 1] AS l FROM orders)""")
def parsed_constraints(spark, sf_dir):
    """START:END:LABEL as constraints."""
    k = F.col("o_orderkey")
    label = F.element_at(F.array(*map(F.lit, ["-", "?", "O", "PERSON", "a:b"])), (k % 5).cast("int") + 1)
    o = orders(spark, sf_dir).select(k.alias("doc_id"), F.concat_ws(":", (k % 9).cast("string"), (k % 9 + 2).cast("string"), label).alias("constraint"))
    return C.parse_table(o).drop("alignment")


# Entities and listings


@query("""WITH l AS (SELECT o_orderkey, ['PERSON', 'ORG', 'TITLE_AFFIX', 'DATE', 'City', 'FAC', 'other'][(o_orderkey % 7)::INT + 1] AS label FROM orders)
SELECT o_orderkey, label, CASE WHEN label IN ('PERSON', 'ORG', 'DATE', 'FAC') THEN label END AS ontonotes, label = 'PERSON' AS person, label IN ('PERSON', 'ORG', 'FAC', 'TITLE_AFFIX') AS signature FROM l""")
def label_classes(spark, sf_dir):
    """The labels that have a meaning of their own: of the public scheme, people, and what signatures are made of."""
    label = F.element_at(F.array(*map(F.lit, ["PERSON", "ORG", "TITLE_AFFIX", "DATE", "City", "FAC", "other"])), (F.col("o_orderkey") % 7).cast("int") + 1)
    o = orders(spark, sf_dir).select("o_orderkey", label.alias("label"))
    p, s = (f(o).select("o_orderkey", F.lit(True).alias(n)) for f, n in ((E.people, "person"), (E.signature, "signature")))
    x = o.join(p, "o_orderkey", "left").join(s, "o_orderkey", "left")
    return x.select("o_orderkey", "label", E.ontonotes_label(F.col("label")).alias("ontonotes"), F.coalesce("person", F.lit(False)).alias("person"), F.coalesce("signature", F.lit(False)).alias("signature"))


@query(f"""{RULED_SQL} SELECT label || chr(9) || text || chr(9) || start_token || '..' || end_token || chr(9) || start_char || '..' || (start_char + length(text)) AS value FROM ents WHERE label IS NOT NULL""")
def entity_tsv(spark, sf_dir):
    return lines.entity_tsv(E.collect(ruled(spark, sf_dir)))


@query(f"""{STARTS_SQL} SELECT doc_id, i AS index, idx AS start, (idx + length(text))::INT AS "end", text, sent_start FROM st""")
def sentence_listing(spark, sf_dir):
    t = S.sentence_starts(_sentence_tokens(spark, sf_dir))
    return lines.sentence_listing(t).select("doc_id", "index", "start", "end", "text", "sent_start")


@query(f"""WITH {TOKENS} SELECT doc_id, md5('{{"tokens":' || to_json(list({{'text': text, 'idx': idx, 'ent_iob': 0, 'ent_type': ''}} ORDER BY i))::VARCHAR || '}}') AS digest FROM tok GROUP BY doc_id""")
def token_lines(spark, sf_dir):
    """The tokens of each document as a line of JSON."""
    fresh = F.transform("tokens", lambda t: F.struct(*[t[c].alias(c) for c in ("i", "text", "has_space", "idx")], F.lit(0).alias("ent_iob"), F.lit("").alias("ent_type")))
    t = T.nested(documents(spark, sf_dir)).select("doc_id", fresh.alias("tokens"))
    return lines.nested_token_lines(t).select("doc_id", F.md5("value").alias("digest"))


@query("SELECT CASE WHEN conv_id % 3 = 0 THEN 'line-' || k ELSE 'c' || conv_id || '-' || turn END AS id, text FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) * 2 AS k FROM conversations WHERE text <> '')")
def corpus_lines(spark, sf_dir):
    """Conversations written as lines of JSON with blank ones between them, some without id, and read back by their line numbers."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text <> ''")
    value = F.to_json(F.struct(F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn")).alias("id"), "text"))
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that all executors share")
    shared = shared or f"file://{tempfile.gettempdir()}"
    at = f"{shared}/corpus-lines-{abs(hash(sf_dir))}"
    c.orderBy("conv_id", "turn").select(F.concat(F.lit("\n"), value)).coalesce(1).write.mode("overwrite").text(at)
    return lines.corpus(spark, at)


# A loaded bundle


@query(f"WITH {TOKENS} SELECT doc_id, text, 'EMAIL' AS label, idx AS start_char FROM tok WHERE regexp_matches(text, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+')")
def bundle_pipeline(spark, sf_dir):
    """A bundle written, read, checked and run: its weights say that nothing is an entity, its rules after that find addresses."""
    m = N.synthetic(width=4, rows=20, depth=1)
    for k in ("ner.upper.W", "ner.upper.b", "ner.lower.W", "ner.lower.b", "ner.lower.pad"):
        m.w[k] = np.zeros_like(m.w[k])
    settings = {"overwrite_ents": True, "phrase_matcher_attr": "ORTH", "patterns": [], "token_patterns": [{"label": "EMAIL", "tokens": [{"op": "1", "constraints": [{"attribute": "LIKE_EMAIL", "kind": "boolean", "value": True}]}]}]}
    rules = [{"name": "marks", "factory": "sentencizer", "settings": {"punct_chars": [".", "!"], "overwrite": False}, "before": "ner"}, {"name": "ruler", "factory": "entity_ruler", "settings": settings}]
    with tempfile.TemporaryDirectory() as at:
        # Read and checked on the driver; what runs is sent with the plan.
        load.save_model(Path(at), m, ("ner",), rules=rules)
        p = Pipeline.load(bundle.load(at))
    return p.extract(documents(spark, sf_dir)).select("doc_id", "text", "label", "start_char")


@query(f"WITH {TOKENS}, n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id) SELECT doc_id, n, 3.0::DOUBLE AS first, 0.0::DOUBLE AS last FROM n")
def encoder_by_hand(spark, sf_dir):
    """Whole-number weights: the table's rows are all 1, the first layer says 4 and 0 whatever comes, normalized and doubled."""
    one = np.float32
    w = {"embed.0": np.ones((8, 2), one), "mix.W": np.zeros((2, 1, 2), one), "mix.b": np.array([[4], [0]], one), "mix.gain": np.full(2, 1.5, one), "mix.shift": np.full(2, 1.5, one)}
    v = N.vectors(tokens(spark, sf_dir), N.Model(w, [3], columns=["ORTH"]))
    return v.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("vector")[0].cast("double")), 3).alias("first"), F.abs(F.round(F.avg(F.col("vector")[1].cast("double")), 3)).alias("last"))


