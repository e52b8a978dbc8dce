"""From analysed Japanese morphemes to tokens: tags, number and address merging, gaps, spaces, parts of speech.

The lattice analysers are external; their rows come in as (doc_id, k, surface, start, feature) and text by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE_TAG = "空白"
NUMERAL = "名詞-数詞"
# pos, sub1, sub2, sub3 (None: anything; several split by |) and the tag; the first that fits counts.
_NOUNS = """固有名詞 人名 姓 > 固有名詞-人名-姓; 固有名詞 人名 名 > 固有名詞-人名-名; 固有名詞 人名 > 固有名詞-人名-一般; 固有名詞 地域 国 > 固有名詞-地名-国; 固有名詞 地域 > 固有名詞-地名-一般; 固有名詞 > 固有名詞-一般;
代名詞 > !代名詞; 数 > 数詞; サ変接続 > 普通名詞-サ変可能; 形容動詞語幹 > 普通名詞-形状詞可能; 副詞可能 > 普通名詞-副詞可能; ナイ形容詞語幹 > !形状詞-助動詞語幹; 接尾 助数詞 > !接尾辞-名詞的-助数詞; 接尾 副詞可能 > !接尾辞-名詞的-副詞可能;
接尾 サ変接続 > !接尾辞-名詞的-サ変可能; 接尾 > !接尾辞-名詞的-一般; 非自立 助動詞語幹 > 助動詞語幹; 非自立 形容動詞語幹 > 普通名詞-形状詞可能; 非自立 副詞可能 > 普通名詞-副詞可能; 一般|非自立 > 普通名詞-一般"""
_OTHERS = """動詞: 自立 > 動詞-一般; 非自立|接尾 > 動詞-非自立可能 / 形容詞: 自立 > 形容詞-一般; 非自立|接尾 > 形容詞-非自立可能
/ 助詞: 格助詞|連体化|並立助詞 > 助詞-格助詞; 係助詞 > 助詞-係助詞; 終助詞|特殊 > 助詞-終助詞; 接続助詞 > 助詞-接続助詞; 副助詞|副助詞／並立助詞／終助詞|副詞化 > 助詞-副助詞
/ 記号: 空白 > 空白; 句点 > 補助記号-句点; 読点 > 補助記号-読点; 括弧開 > 補助記号-括弧開; 括弧閉 > 補助記号-括弧閉; アルファベット > 記号-文字; > 補助記号-一般
/ 感動詞: > 感動詞-一般 / フィラー: > 感動詞-フィラー / 接頭詞: > 接頭辞 / 副詞: > 副詞 / 助動詞: > 助動詞 / 接続詞: > 接続詞 / 連体詞: > 連体詞"""


def tag_rules() -> list[tuple[str, list[list[str]], str]]:
    out = []

    def add(pos: str, body: str, lead: str) -> None:
        for rule in body.split(";"):
            subs, _, tag = rule.rpartition(">")
            tag = tag.strip()
            out.append((pos, [s.split("|") for s in subs.split()], tag[1:] if tag.startswith("!") else lead + tag))

    add("名詞", _NOUNS, "名詞-")
    for part in " ".join(_OTHERS.split()).split(" / "):
        pos, _, body = part.partition(":")
        add(pos.strip(), body, "")
    return out


def parse_feature(feature: Column) -> Column:
    """STRUCT of an IPADIC feature row: * and nothing are null, inflection is kind;form."""
    part = F.split(feature, ",")
    get = lambda k: F.nullif(F.nullif(F.get(part, F.lit(k)), F.lit("*")), F.lit(""))
    inflection = F.nullif(F.concat_ws(";", get(4), get(5)), F.lit(""))
    return F.struct(get(0).alias("pos"), get(1).alias("sub1"), get(2).alias("sub2"), get(3).alias("sub3"), inflection.alias("inflection"), get(6).alias("lemma"), get(7).alias("reading"))


def unidic_tag(f: Column) -> Column:
    out = F
    for pos, subs, tag in tag_rules():
        test = reduce(lambda a, b: a & b, [f[f"sub{k}"].isin(*s) for k, s in enumerate(subs, 1)], f["pos"] == pos)
        out = out.when(F.coalesce(test, F.lit(False)), tag)
    return out


def morpheme_tag(parts: Column) -> Column:
    """The first four parts of speech of an array, without *, joined."""
    return F.array_join(F.filter(F.slice(parts, 1, 4), lambda x: x != "*"), "-")


def morph_string(inflection: Column, reading: Column) -> Column:
    return F.concat_ws("|", F.concat(F.lit("Inflection="), F.nullif(inflection, F.lit(""))), F.concat(F.lit("Reading="), F.nullif(F.translate(reading, "=|", "__"), F.lit(""))))


def _merge(rows: DataFrame, group: Column, norm=None) -> DataFrame:
    """Rows of a doc_id that share a group become one: texts joined, other values of the first."""
    other = [c for c in rows.columns if c not in ("doc_id", "k", "surface", "norm")]
    g = rows.withColumn("g", group).groupBy("doc_id", "g").agg(F.min("k").alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "surface"))), lambda x: x["surface"]), "").alias("surface"), *[F.min_by(c, "k").alias(c) for c in other if c != "end"], *([F.max("end").alias("end")] if "end" in other else []), *([F.min_by("norm", "k").alias("norm")] if "norm" in rows.columns else []), F.count("*").alias("merged"))
    return g.drop("g")


def merge_numbers(rows: DataFrame) -> DataFrame:
    """(doc_id, k, surface, start, end, tag, norm ..): digits with points and thousands' commas become one numeral whose norm has no commas."""
    w = Window.partitionBy("doc_id").orderBy("k")
    digits = F.col("surface").rlike(r"\A[0-9０-９]+\z") & (F.col("tag") == NUMERAL)
    x = rows.withColumn("digits", digits).withColumn("sep", F.col("surface").isin(".", ","))
    joined = F.lag("end").over(w) == F.col("start")
    three = F.length("surface") == 3
    # A separator joins if it stands between digits without gaps, and after a comma there are three of them.
    nxt = F.lead("digits").over(w) & (F.lead("start").over(w) == F.col("end")) & ((F.col("surface") == ".") | (F.lead(three).over(w)))
    x = x.withColumn("glue", F.coalesce(F.col("sep") & F.lag("digits").over(w) & joined & nxt, F.lit(False)))
    x = x.withColumn("on", F.coalesce(F.col("glue") | (F.col("digits") & F.lag("glue").over(w)), F.lit(False)))
    x = x.withColumn("grp", F.sum((~F.col("on")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    m = _merge(x.drop("digits", "sep", "glue", "on"), F.col("grp"))
    one = F.col("merged") > 1
    return m.withColumn("norm", F.when(one, F.replace("surface", F.lit(","), F.lit(""))).otherwise(F.col("norm"))).withColumn("tag", F.when(one, F.lit(NUMERAL)).otherwise(F.col("tag"))).drop("grp", "merged")


def merge_towns(rows: DataFrame) -> DataFrame:
    """A proper noun, 町, digits and 丁目 without gaps: the first two become one."""
    w = Window.partitionBy("doc_id").orderBy("k")
    near = lambda n: F.lead("start", n).over(w) == F.lead("end", n - 1).over(w)
    hit = F.col("tag").startswith("名詞-固有名詞") & (F.lead("surface").over(w) == "町") & F.lead("surface", 2).over(w).rlike(r"\A[0-9０-９]+\z") & (F.lead("surface", 3).over(w) == "丁目") & near(1) & near(2) & near(3)
    x = rows.withColumn("hit", F.coalesce(hit, F.lit(False)))
    x = x.withColumn("grp", F.sum((~F.coalesce(F.lag("hit").over(w), F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _merge(x.drop("hit"), F.col("grp")).drop("grp", "merged")


def with_gaps(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Tokens (doc_id, i, text, has_space, idx, tag): what lies between morphemes is a token of its own, but for a single space,
    which is the has_space of the one before. A text without morphemes is one gap."""
    w = Window.partitionBy("doc_id").orderBy("k")
    x = rows.withColumn("stop", F.coalesce(F.lag("end").over(w), F.lit(0)))
    x = x.join(texts.select("doc_id", F.col("text").alias("whole")), "doc_id")
    gap = F.substring("whole", F.col("stop") + 1, F.col("start") - F.col("stop"))
    x = x.withColumn("gap", gap).withColumn("first", F.row_number().over(w) == 1)
    own = F.struct(F.col("start").alias("idx"), F.col("surface").alias("text"), F.col("tag").alias("tag"))
    loose = F.when((F.col("gap") != "") & ~((F.col("gap") == " ") & ~F.col("first")), F.struct(F.col("stop").alias("idx"), F.col("gap").alias("text"), F.lit(SPACE_TAG).alias("tag")))
    size = F.length("whole")
    x = x.withColumn("last", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("k"))) == 1)
    tail = F.expr("substring(whole, end + 1)")
    ending = F.when(F.col("last") & (F.col("end") < size) & (tail != " "), F.struct(F.col("end").alias("idx"), tail.alias("text"), F.lit(SPACE_TAG).alias("tag")))
    t = x.select("doc_id", "whole", F.inline(F.array_compact(F.array(loose, own, ending))))
    bare = texts.join(rows.select("doc_id").distinct(), "doc_id", "left_anti").where("text <> ''").select("doc_id", F.col("text").alias("whole"), F.lit(0).alias("idx"), "text", F.lit(SPACE_TAG).alias("tag"))
    t = t.unionByName(bare)
    by = Window.partitionBy("doc_id").orderBy("idx")
    after = F.col("idx") + F.length("text")
    following = F.coalesce(F.lead("idx").over(by), F.length("whole"))
    t = t.withColumn("has_space", (following == after + 1) & (F.substring("whole", after + 1, F.lit(1)) == " "))
    return t.select("doc_id", (F.row_number().over(by) - 1).alias("i"), "text", "has_space", "idx", "tag")


def collapse_spaces(rows: DataFrame) -> DataFrame:
    """Without white-space morphemes that follow another one."""
    w = Window.partitionBy("doc_id").orderBy("k")
    blank = (F.col("tag") == SPACE_TAG) & F.col("surface").rlike(r"\A\p{IsWhite_Space}+\z")
    return rows.withColumn("blank", blank).withColumn("again", F.coalesce(F.col("blank") & F.lag("blank").over(w), F.lit(False))).where("not again").drop("blank", "again")


def resolve_pos(tags: list[tuple[str, str]], by_orth: dict, bigrams: dict, unigrams: dict) -> list[str]:
    """Parts of speech of (tag, text) pairs: by tag and text, else by tag and the next tag, which says both, else by tag."""
    out, k = [], 0
    while k < len(tags):
        tag, text = tags[k]
        nxt = tags[k + 1][0] if k + 1 < len(tags) else None
        if (tag, text) in by_orth:
            out.append(by_orth[tag, text])
        elif (tag, nxt) in bigrams:
            out += bigrams[tag, nxt]
            k += 1
        elif tag in unigrams:
            out.append(unigrams[tag])
        else:
            raise ValueError(f"missing tokenizer pos: {tag}")
        k += 1
    return out


def apply_rules(tokens: list[dict], rules: list[dict]) -> list[dict]:
    """Compatibility rules: where contiguous tokens exactly make up a rule's text, its own tokens take their place; the longest rule counts."""
    by_first: dict[str, list[dict]] = {}
    for r in sorted(rules, key=lambda r: -len(r["text"].encode())):
        if not r["text"] or "".join(t["surface"] for t in r["tokens"]) != r["text"]:
            raise ValueError(f"the tokens of the rule {r['text']!r} don't make it up")
        by_first.setdefault(r["text"][0], []).append(r)
    out, k = [], 0
    while k < len(tokens):
        for r in by_first.get(tokens[k]["surface"][:1], ()):
            end, at, stop = k, tokens[k]["start"], tokens[k]["start"] + len(r["text"])
            while end < len(tokens) and tokens[end]["start"] == at and at + len(tokens[end]["surface"]) <= stop:
                at += len(tokens[end]["surface"])
                end += 1
            if at == stop and "".join(t["surface"] for t in tokens[k:end]) == r["text"]:
                at = tokens[k]["start"]
                for t in r["tokens"]:
                    out.append({**t, "start": at})
                    at += len(t["surface"])
                k = end
                break
        else:
            out.append(tokens[k])
            k += 1
    return out


def align(text: str, surfaces: list[str]) -> list[tuple[str, int, bool]]:
    """(text, idx, has_space) of surfaces found one after another; white-space ones are skipped, gaps are tokens, and a
    surface that isn't found is an error. A text of nothing but white space is one token."""
    if text and text.isspace():
        return [(text, 0, False)]
    out, at = [], 0
    for k, s in enumerate(surfaces):
        if not s or s.isspace():
            continue
        found = text.find(s, at)
        if found < 0:
            raise ValueError(f"{s!r} isn't in the rest of the text")
        if found > at and not (out and text[at:found] == " "):
            out.append((text[at:found], at, False))
        spaced = k + 1 < len(surfaces) and surfaces[k + 1] == " "
        out.append((s, found, spaced))
        at = found + len(s)
    if at < len(text) and not (out and text[at:] == " "):
        out.append((text[at:], at, False))
    return out


def _by_doc(rows: DataFrame, schema: str, run) -> DataFrame:
    """run(doc_id, the document's rows in the order of k) gives rows of the schema; documents stream by, one held at a time."""
    names = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    kind = pa.schema([(n, names[k]) for n, k in (f.split() for f in schema.split(", "))])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(kind)], schema=kind)

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if held and held[0]["doc_id"] != r["doc_id"]:
                    out += run(held[0]["doc_id"], held)
                    held = []
                held.append(r)
            yield made(out)
        if held:
            yield made(run(held[0]["doc_id"], held))

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "k").mapInArrow(stream, schema)


def apply_rules_table(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """apply_rules() on (doc_id, k, surface, start, tag), each document by itself; k is numbered anew."""
    apply_rules([], rules)
    return _by_doc(rows.select("doc_id", "k", "surface", "start", "tag"), "doc_id bigint, k int, surface string, start int, tag string", lambda d, x: [(d, k, t["surface"], t["start"], t["tag"]) for k, t in enumerate(apply_rules(x, rules))])


def resolve_pos_table(rows: DataFrame, by_orth: dict, bigrams: dict, unigrams: dict) -> DataFrame:
    """(doc_id, k, surface, tag, pos) by resolve_pos()."""
    own = rows.select("doc_id", "k", "surface", "tag")
    return _by_doc(own, "doc_id bigint, k int, surface string, tag string, pos string", lambda d, x: [(d, t["k"], t["surface"], t["tag"], p) for t, p in zip(x, resolve_pos([(t["tag"], t["surface"]) for t in x], by_orth, bigrams, unigrams))])


def align_table(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Tokens (doc_id, i, text, has_space, idx) of align(): rows (doc_id, k, surface) of texts (doc_id, text)."""
    x = rows.select("doc_id", "k", "surface").join(texts.select("doc_id", F.col("text").alias("whole")), "doc_id")
    return _by_doc(x, "doc_id bigint, i int, text string, has_space boolean, idx int", lambda d, x: [(d, i, t, s, at) for i, (t, at, s) in enumerate(align(x[0]["whole"], [t["surface"] for t in x]))])
