"""Queries on tokens, offsets, lexical attributes and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.functions import ids, lexical
from spanframe.operators import sentences as S
from spanframe.operators import tokens as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: The token table in SQL; WS_SQL lists Unicode's white space for RE2.
WS_SQL = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
TOKENS = rf"""pieces AS (SELECT doc_id, lang, regexp_extract_all(text, '[^{WS_SQL}]+ ?|[{WS_SQL}]+') AS l FROM documents),
cut AS (SELECT doc_id, lang, unnest(l) AS piece, (generate_subscripts(l, 1) - 1)::INT AS i FROM pieces),
tok AS (SELECT doc_id, lang, i, suffix(piece, ' ') AND NOT regexp_matches(piece, '^[{WS_SQL}]') AS has_space,
  CASE WHEN suffix(piece, ' ') AND NOT regexp_matches(piece, '^[{WS_SQL}]') THEN left(piece, length(piece) - 1) ELSE piece END AS text,
  coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS idx FROM cut)"""
WORDS = f"WITH {TOKENS}, words AS (SELECT text, count(*) AS n FROM tok GROUP BY text)"


def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text, n): attributes are computed once for each distinct token."""
    return T.flat(documents(spark, sf_dir), offsets=False).groupBy("text").agg(F.count("*").alias("n"))


def _words(spark, sf_dir, **attributes) -> DataFrame:
    return distinct_words(spark, sf_dir).select("text", "n", *[f.alias(k) for k, f in attributes.items()])


@query(f"WITH {TOKENS} SELECT doc_id, i, text, idx AS start_char, (idx + length(text))::INT AS end_char, has_space FROM tok")
def tokens_basic(spark, sf_dir):
    t = T.flat(documents(spark, sf_dir))
    return t.select("doc_id", "i", "text", F.col("idx").alias("start_char"), (F.col("idx") + F.length("text")).alias("end_char"), "has_space")


@query("SELECT doc_id, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM documents")
def doc_text_roundtrip(spark, sf_dir):
    """The texts put together from their tokens again; a text without tokens is one, too."""
    d = T.nested(documents(spark, sf_dir), empty=True).select("doc_id", T.text_of(F.col("tokens")).alias("text"))
    return d.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query(f"WITH {TOKENS} SELECT lang, count(*) AS n, sum(has_space::INT)::BIGINT AS spaced FROM tok GROUP BY lang")
def token_whitespace_flags(spark, sf_dir):
    return T.flat(documents(spark, sf_dir), "lang", offsets=False).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.col("has_space").cast("int")).alias("spaced"))


@query(f"{WORDS} SELECT text, n, lower(text) AS lower, left(text, 1) AS prefix, right(text, 3) AS suffix, length(text)::INT AS size FROM words")
def attr_lower_prefix_suffix_length(spark, sf_dir):
    t = F.col("text")
    return _words(spark, sf_dir, lower=lexical.lower(t), prefix=lexical.prefix(t), suffix=lexical.suffix(t), size=lexical.length(t))


def _shape_sql(digit: str) -> str:
    # RE2 has no backreferences: a run's characters from the fifth on are left out by position.
    cls = rf"CASE WHEN regexp_matches(c, '^\p{{Lu}}$') THEN 'X' WHEN regexp_matches(c, '^[\p{{L}}\p{{Nl}}]$') THEN 'x' WHEN regexp_matches(c, '^{digit}$') THEN 'd' ELSE c END"
    return rf"""{WORDS}, s AS (SELECT text, n, list_transform(regexp_extract_all(text, '(?s).'), lambda c: {cls}) AS l FROM words)
SELECT text, n, CASE WHEN length(text) >= 100 THEN 'LONG' ELSE array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda k: NOT (k > 4 AND l[k] = l[k-1] AND l[k] = l[k-2] AND l[k] = l[k-3] AND l[k] = l[k-4])), lambda k: l[k]), '') END AS shape FROM s"""


@query(_shape_sql(r"\p{Nd}"))
def attr_shape_ruler(spark, sf_dir):
    return _words(spark, sf_dir, shape=lexical.shape(F.col("text")))


@query(_shape_sql("[0-9]"))
def attr_shape_encoder(spark, sf_dir):
    return _words(spark, sf_dir, shape=lexical.encoder_shape(F.col("text")))


@query(rf"""{WORDS} SELECT text, n, regexp_matches(text, '^[\p{{L}}\p{{Nl}}]+$') AS is_alpha, regexp_matches(text, '^[\x00-\x7F]*$') AS is_ascii,
regexp_matches(text, '^\p{{Nd}}+$') AS is_digit, regexp_matches(text, '^\p{{P}}+$') AS is_punct, regexp_matches(text, '^\p{{Sc}}+$') AS is_currency, regexp_matches(text, '^[{WS_SQL}]+$') AS is_space FROM words""")
def attr_flags(spark, sf_dir):
    t = F.col("text")
    return _words(spark, sf_dir, is_alpha=lexical.is_alpha(t), is_ascii=lexical.is_ascii(t), is_digit=lexical.is_digit(t), is_punct=lexical.is_punct(t), is_currency=lexical.is_currency(t), is_space=lexical.is_space(t))


@query(rf"""{WORDS} SELECT text, n, regexp_matches(text, '\p{{Ll}}') AND NOT regexp_matches(text, '\p{{Lu}}') AS is_lower, regexp_matches(text, '\p{{Lu}}') AND NOT regexp_matches(text, '\p{{Ll}}') AS is_upper,
regexp_matches(text, '[\p{{Lu}}\p{{Ll}}]') AND NOT regexp_matches(text, '\p{{Lu}}\p{{Lu}}|\p{{Ll}}\p{{Lu}}|(?:^|[^\p{{Lu}}\p{{Ll}}])\p{{Ll}}') AS is_title FROM words""")
def attr_case(spark, sf_dir):
    t = F.col("text")
    return _words(spark, sf_dir, is_lower=lexical.is_lower(t), is_upper=lexical.is_upper(t), is_title=lexical.is_title(t))


def _sql_in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


@query(f"""{WORDS}, c AS (SELECT unnest(regexp_extract_all(text, '.')) AS c, n FROM words)
SELECT c AS text, sum(n)::BIGINT AS n, bool_or(c IN {_sql_in(lexical.BRACKETS)}) AS is_bracket, bool_or(c IN {_sql_in(lexical.LEFT_PUNCT)}) AS is_left, bool_or(c IN {_sql_in(lexical.RIGHT_PUNCT)}) AS is_right, bool_or(c IN {_sql_in(lexical.QUOTES)}) AS is_quote FROM c GROUP BY c""")
def attr_brackets_quotes(spark, sf_dir):
    t = F.col("text")
    c = distinct_words(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("."), F.lit(0))).alias("text"), "n").groupBy("text").agg(F.sum("n").alias("n"))
    return c.select("text", "n", lexical.is_bracket(t).alias("is_bracket"), lexical.is_left_punct(t).alias("is_left"), lexical.is_right_punct(t).alias("is_right"), lexical.is_quote(t).alias("is_quote"))


NUM_SQL = rf"""regexp_matches(k, '^\p{{Nd}}+$') OR regexp_matches(k, '^\p{{Nd}}+/\p{{Nd}}+$') OR lower(k) IN {_sql_in(lexical.CARDINALS + lexical.ORDINALS)} OR regexp_matches(lower(k), '^\p{{Nd}}+(st|nd|rd|th)$')"""


@query(rf"""{WORDS}, k AS (SELECT text, n, regexp_replace(regexp_replace(text, '^[+\-±~]', ''), '[,.]', '', 'g') AS k FROM words)
SELECT text, n, {NUM_SQL} AS like_num FROM k""")
def like_num(spark, sf_dir):
    return _words(spark, sf_dir, like_num=lexical.like_num(F.col("text")))


@query(rf"{WORDS} SELECT text, n, regexp_matches(text, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+') AS like_email FROM words")
def like_email(spark, sf_dir):
    return _words(spark, sf_dir, like_email=lexical.like_email(F.col("text")))


IPV4_SQL = r"""(regexp_matches(t, '^[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]{2,5})?([/?#].*)?$') AND a <= 255 AND b <= 255 AND c <= 255 AND d <= 255 AND a BETWEEN 1 AND 223 AND d NOT IN (0, 255) AND a NOT IN (10, 127)
AND NOT (a = 169 AND b = 254) AND NOT (a = 192 AND b = 168) AND NOT (a = 172 AND b BETWEEN 16 AND 31))"""
OCTETS_SQL = ", ".join(rf"try_cast(regexp_extract(t, '^([0-9]{{1,3}})\.([0-9]{{1,3}})\.([0-9]{{1,3}})\.([0-9]{{1,3}})', {k}) AS INT) AS {c}" for k, c in enumerate("abcd", 1))


@query(rf"{WORDS}, o AS (SELECT text, n, text AS t, {OCTETS_SQL.replace('(t,', '(text,')} FROM words) SELECT text, n, coalesce({IPV4_SQL}, FALSE) AS public_ipv4 FROM o")
def public_ipv4(spark, sf_dir):
    return _words(spark, sf_dir, public_ipv4=lexical.is_public_ipv4(F.col("text")))


URL_SQL = r"""(starts_with(t, 'http://') OR starts_with(t, 'https://') OR (starts_with(t, 'www.') AND length(t) >= 5) OR (t <> '' AND NOT starts_with(t, '.') AND NOT suffix(t, '.') AND NOT contains(t, '@') AND (coalesce(%s, FALSE)
OR regexp_matches(t, '^([\p{L}\p{M}\p{Nd}\p{Pc}+.-]{2,}://)?([A-Za-z0-9\x{a1}-\x{ffff}][A-Za-z0-9\x{a1}-\x{ffff}_-]{0,62}\.)+[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]{2,63}(:[0-9]{2,5})?([/?#]\S*)?$'))))""" % IPV4_SQL


@query(rf"""WITH u AS (SELECT page_id, url AS t FROM pages UNION ALL SELECT page_id, regexp_replace(url, '^[a-z]+://', '') FROM pages), o AS (SELECT page_id, t, {OCTETS_SQL} FROM u)
SELECT page_id, t AS text, {URL_SQL} AS like_url FROM o""")
def like_url(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    u = p.select("page_id", F.col("url").alias("text")).unionAll(p.select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("text")))
    return u.withColumn("like_url", lexical.like_url(F.col("text")))


@query(rf"{WORDS}, o AS (SELECT text, n, text AS t, {OCTETS_SQL.replace('(t,', '(text,')} FROM words) SELECT text, n, {URL_SQL} AS like_url FROM o")
def like_url_tokens(spark, sf_dir):
    return _words(spark, sf_dir, like_url=lexical.like_url(F.col("text")))


STOP = ("the", "and", "of", "la", "le", "de", "der", "die", "el", "que")


@query(f"{WORDS} SELECT text, n, lower(text) IN {_sql_in(STOP)} AS is_stop FROM words")
def stop_words_flag(spark, sf_dir):
    return _words(spark, sf_dir, is_stop=lexical.is_stop(F.col("text"), STOP))


@query("""SELECT p_partkey, p_name, word, e AS edits FROM (SELECT p_partkey, p_name, word, levenshtein(word, 'widget') AS e, greatest(2, round_even(0.3 * length('widget'), 0))::INT AS most
FROM (SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS word FROM part)) WHERE e <= most""")
def fuzzy_match_terms(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", F.explode(F.split("p_name", " ")).alias("word"))
    w = "widget"
    return p.where(lexical.fuzzy_match(F.col("word"), w)).withColumn("edits", lexical.within_edits(F.col("word"), F.lit(w), lexical.default_edits(w)).cast("bigint"))


@query("""SELECT n_name, c.n_name_2, greatest(2, round_even(0.3 * length(n_name), 0))::INT AS most, levenshtein(n_name, n_name_2)::INT AS edits FROM nation, (SELECT n_name AS n_name_2 FROM nation) c""")
def fuzzy_default_edits(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name")
    return n.crossJoin(n.withColumnRenamed("n_name", "n_name_2")).select("n_name", "n_name_2", lexical.default_edits_of(F.col("n_name")).alias("most"), F.levenshtein("n_name", "n_name_2").alias("edits"))


@query("SELECT doc_id, i::INT AS i, strlen(substring(text, 1, i))::INT AS byte FROM (SELECT doc_id, text, unnest([0, length(text) // 2, length(text), length(text) + 1]) AS i FROM documents) WHERE i <= length(text) UNION ALL SELECT doc_id, (length(text) + 1)::INT, NULL FROM documents")
def byte_offsets(spark, sf_dir):
    n = F.length("text")
    d = documents(spark, sf_dir).select("doc_id", "text", F.explode(F.array(F.lit(0), F.floor(n / 2).cast("int"), n, n + 1)).alias("i"))
    return d.select("doc_id", "i", T.byte_offset(F.col("text"), F.col("i")).alias("byte"))


TERMINALS = _sql_in(S.PUNCT_CHARS)


def _sentence_tokens(spark, sf_dir) -> DataFrame:
    """Tokens with their last sentence mark split off, so that terminals are tokens."""
    d = documents(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"([.!?])(?=\s|\z)", "\n$1"))
    return T.flat(d)


SPLIT = TOKENS.replace("FROM documents", r"FROM (SELECT doc_id, lang, regexp_replace(text, '([.!?])(\s|$)', chr(10) || '\1\2', 'g') AS text FROM documents)")
STARTS_SQL = rf"""WITH {SPLIT},
f AS (SELECT *, text IN {TERMINALS} AS term, regexp_matches(text, '^\p{{P}}+$') AS punct FROM tok),
g AS (SELECT *, max(CASE WHEN term THEN i END) OVER b AS ended, max(CASE WHEN NOT term AND NOT punct THEN i END) OVER b AS said FROM f WINDOW b AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
st AS (SELECT doc_id, i, text, idx, CASE WHEN i = 0 OR (NOT term AND NOT punct AND ended IS NOT NULL AND ended > coalesce(said, -1)) THEN 1 ELSE -1 END AS sent_start FROM g)"""


@query(f"{STARTS_SQL} SELECT doc_id, i, idx, sent_start FROM st WHERE sent_start = 1")
def sentence_starts(spark, sf_dir):
    return S.sentence_starts(_sentence_tokens(spark, sf_dir)).where("sent_start = 1").select("doc_id", "i", "idx", "sent_start")


@query(f"{STARTS_SQL}, p AS (SELECT *, CASE WHEN i % 7 = 3 THEN -1 WHEN i % 11 = 5 THEN 1 ELSE 0 END AS said FROM st) SELECT doc_id, sum((CASE WHEN said = 0 THEN sent_start ELSE said END = 1)::INT)::BIGINT AS kept, sum((sent_start = 1)::INT)::BIGINT AS overwritten FROM p GROUP BY doc_id")
def sentence_overwrite(spark, sf_dir):
    t = _sentence_tokens(spark, sf_dir).withColumn("sent_start", F.when(F.col("i") % 7 == 3, -1).when(F.col("i") % 11 == 5, 1).otherwise(0))
    t = S.sentence_starts(t.withColumn("before", F.col("sent_start"))).withColumnRenamed("sent_start", "kept")
    t = S.sentence_starts(t, overwrite=True).groupBy("doc_id")
    return t.agg(F.sum((F.col("kept") == 1).cast("int")).alias("kept"), F.sum((F.col("sent_start") == 1).cast("int")).alias("overwritten"))


@query(f"""{STARTS_SQL}, s AS (SELECT *, sum((sent_start = 1)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sentence FROM st)
SELECT doc_id, sentence::BIGINT AS sentence, min(i) AS start, max(i) + 1 AS "end", min(idx) AS start_char, max(idx + length(text))::INT AS end_char FROM s GROUP BY doc_id, sentence""")
def sentence_spans(spark, sf_dir):
    return S.sentences(S.sentence_starts(_sentence_tokens(spark, sf_dir)))


@query(f"WITH {TOKENS} SELECT doc_id, count(*) AS n, sum((i = 0)::INT)::BIGINT AS starts FROM tok GROUP BY doc_id")
def sentence_fallback(spark, sf_dir):
    t = S.document_start(T.flat(documents(spark, sf_dir), offsets=False))
    return t.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("sent_start").alias("starts"))


MURMUR_SQL = r"""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[a-zA-Z]+'))) AS text FROM documents),
b AS (SELECT text, strlen(text) AS n, encode(text) AS raw FROM w WHERE strlen(text) < 16),
c AS (SELECT text, n, CASE WHEN n >= 8 THEN list_reduce(list_transform(range(8), lambda k: ord(text[k + 1])::UHUGEINT * (1::UHUGEINT << (8 * k)::UHUGEINT)), lambda x, y: x + y) END AS block,
  CASE WHEN n % 8 > 0 THEN list_reduce(list_transform(range(n % 8), lambda k: ord(text[(n // 8) * 8 + k + 1])::UHUGEINT * (1::UHUGEINT << (8 * k)::UHUGEINT)), lambda x, y: x + y) END AS tail FROM b)"""


def mul(x: str) -> str:
    """(x * m) mod 2^64 without leaving 128 bits: x is under 2^64, and so is m."""
    m = 0xC6A4A7935BD1E995
    return f"(({x}) * {m}::UHUGEINT % 18446744073709551616::UHUGEINT)"


def shift(x: str) -> str:
    return f"xor(({x})::UBIGINT, (({x}) >> 47::UHUGEINT)::UBIGINT)::UHUGEINT"


MURMUR_SQL += f""", h0 AS (SELECT *, xor(1::UBIGINT, {mul('n::UHUGEINT')}::UBIGINT)::UHUGEINT AS h, {mul('block')} AS k1 FROM c),
h1 AS (SELECT text, n, tail, h, CASE WHEN k1 IS NOT NULL THEN {mul(shift('k1'))} END AS k2 FROM h0),
h2 AS (SELECT text, n, tail, CASE WHEN k2 IS NULL THEN h ELSE {mul('xor(h::UBIGINT, k2::UBIGINT)::UHUGEINT')} END AS h FROM h1),
h3 AS (SELECT text, CASE WHEN tail IS NULL THEN h ELSE {mul('xor(h::UBIGINT, tail::UBIGINT)::UHUGEINT')} END AS h FROM h2),
h4 AS (SELECT text, {mul(shift('h'))} AS h FROM h3)
SELECT text, ({shift('h')})::VARCHAR AS id FROM h4"""


@query(MURMUR_SQL)
def string_hashes(spark, sf_dir):
    w = documents(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("text")).distinct().where("octet_length(text) < 16")
    return w.select("text", ids.unsigned(ids.string_hash(F.col("text"))).cast("string").alias("id"))


@query()
def string_hashes_whole(spark, sf_dir):
    """All tokens, of any length and script; string_hashes has those that its SQL can hash."""
    w = distinct_words(spark, sf_dir).select(F.lower("text").alias("text")).distinct()
    return w.select("text", ids.unsigned(ids.string_hash(F.col("text"))).cast("string").alias("id"))


@query()
def string_ids(spark, sf_dir):
    return ids.intern(spark, distinct_words(spark, sf_dir), "text").select(ids.unsigned(F.col("id")).alias("id"), "text")


@query()
def hash_buckets(spark, sf_dir):
    w = distinct_words(spark, sf_dir).withColumn("id", ids.string_id(F.lower("text")))
    return w.select("text", ids.hash_buckets(F.col("id"), 7).alias("buckets"))


@query("SELECT o_orderkey, list_sort(list_distinct(list_filter(string_split(m, '|'), lambda x: x <> ''))) AS features FROM (SELECT o_orderkey, o_orderpriority || '|' || o_orderstatus || '||' || o_orderpriority AS m FROM orders)")
def morph_features(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", T.morph_features(F.concat("o_orderpriority", F.lit("|"), "o_orderstatus", F.lit("||"), "o_orderpriority")).alias("features"))
