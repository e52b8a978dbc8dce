"""Rule matching over the flat token table, and the resolution of what overlaps.

Candidates come from joins by (doc_id, position), so a document's tokens never meet each other without a key. Which of
them stay is decided within a document: longest first, then the first, then the earlier pattern.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.ids import string_id
from spanframe.operators.patterns import BOOLEANS as _BOOLEANS
from spanframe.operators.patterns import Pattern, apart, attribute, attribute_id, compile_test, flag, normalize, signed
from spanframe.operators.tokens import by_doc, mark

#: Attributes that phrases can be compared by.
PHRASE_ATTRIBUTES = ("ORTH", "LOWER", "NORM", "SHAPE", "LENGTH", "LEMMA", "POS", "TAG", "DEP", "ENT_IOB", "ENT_TYPE", "ENT_ID", "ENT_KB_ID", "MORPH", *_BOOLEANS)

#: Phrases with no more characters than this in all are broadcast.
BROADCAST_CHARACTERS = 1 << 20


@dataclass
class Ruler:
    """Patterns with how they are written: those of a bundle's component."""

    patterns: list
    overwrite: bool = False
    attr: str = "ORTH"
    stop_ids: tuple[int, ...] = ()

    def annotate(self, tokens: DataFrame) -> DataFrame:
        t = tokens
        if self.stop_ids:
            t = t.withColumn("is_stop", string_id(F.lower("text")).isin(*map(signed, self.stop_ids)))
        elif "is_stop" not in t.columns:
            t = t.withColumn("is_stop", F.lit(False))
        return annotate(t, self.patterns, self.overwrite, self.attr)


def labels(patterns: list[dict]) -> list[str]:
    """Distinct labels in the order of declaration."""
    return list(dict.fromkeys(normalize(p).label for p in patterns))


def ids(patterns: list[dict]) -> list[str]:
    return list(dict.fromkeys(p.ent_id for p in map(normalize, patterns) if p.ent_id))


def _phrase_value(attr: str) -> Column:
    if attr not in PHRASE_ATTRIBUTES:
        raise ValueError(f"phrases can't be compared by {attr}")
    return (flag(attr) if attr in _BOOLEANS else attribute(attr)).cast("string")


def phrase_matches(tokens: DataFrame, phrases: DataFrame, attr: str = "ORTH", sizes: list[int] | None = None, value: Column | None = None) -> DataFrame:
    """(doc_id, start, end, label, ent_id, priority): a hash join of n-grams with a table (words array, label, ent_id, priority).

    There is one join for each length of phrases, and lengths are few. An n-gram is the n values from a token on; windows
    over doc_id make it. Phrases are compared by the same attribute of their words. The table's size decides how it is joined.
    sizes: the lengths that there are, where they are known; else a job finds them. value: what words are compared by, if not attr.
    """
    keyed = tokens.withColumn("value", _phrase_value(attr) if value is None else value)
    sizes = sizes or [r.n for r in phrases.select(F.size("words").alias("n")).distinct().orderBy("n").collect()]
    out = None
    for n in sizes:
        w = by_doc().rowsBetween(0, n - 1)
        grams = keyed.select("doc_id", F.col("i").alias("start"), F.collect_list("value").over(w).alias("words")).where(F.size("words") == n)
        own = phrases.where(F.size("words") == n)
        hit = grams.join(own, "words").select("doc_id", "start", (F.col("start") + n).alias("end"), "label", "ent_id", "priority")
        out = hit if out is None else out.unionByName(hit)
    if out is None:
        return tokens.sparkSession.createDataFrame([], "doc_id bigint, start int, end int, label string, ent_id string, priority int")
    # Of the same label and range the first pattern counts.
    return out.groupBy("doc_id", "start", "end", "label").agg(F.min(F.struct("priority", "ent_id")).alias("p")).select("doc_id", "start", "end", "label", "p.ent_id", "p.priority")


def token_matches(tokens: DataFrame, pattern: Pattern, priority: int = 0) -> DataFrame:
    """All (start, end) that a token pattern can match.

    For a step, a run is how many tokens from a position on fulfil it. The frontier, pairs of a start and a position, moves
    step by step: an equi-join with the runs at (doc_id, position), an explosion into the counts that the step allows, and
    a distinct. Only starts whose first tokens fit enter it.
    """
    names = [f"m{k}" for k in range(len(pattern.steps))]
    marked = tokens.select("doc_id", "i", *[(compile_test(s.test) if k else apart(compile_test(s.test))).alias(m) for k, (m, s) in enumerate(zip(names, pattern.steps))])
    # From the last token backwards, as a frame that only grows is kept, not computed again for each row.
    ahead = Window.partitionBy("doc_id").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    size = Window.partitionBy("doc_id")
    runs = marked.select("doc_id", F.col("i").alias("pos"), *[(F.coalesce(F.min(F.when(~F.col(m), F.col("i"))).over(ahead), F.max("i").over(size) + 1) - F.col("i")).alias(m) for m in names])
    first = pattern.steps[0]
    front = runs.where((F.col("m0") == 0) if first.negated else F.col("m0") >= first.least).select("doc_id", F.col("pos").alias("start"), "pos")
    for k, step in enumerate(pattern.steps):
        here = runs.select("doc_id", "pos", F.col(f"m{k}").alias("run"))
        if step.negated:
            front = front.join(here, ["doc_id", "pos"]).where("run = 0").select("doc_id", "start", (F.col("pos") + 1).alias("pos"))
            continue
        front = front.join(here, ["doc_id", "pos"], "left").withColumn("run", F.least(F.coalesce("run", F.lit(0)), F.lit(step.most)))
        if step.least == step.most:
            front = front.where(F.col("run") >= step.least).select("doc_id", "start", (F.col("pos") + step.least).alias("pos"))
        else:
            front = front.where(F.col("run") >= step.least).select("doc_id", "start", F.explode(F.sequence(F.col("pos") + step.least, F.col("pos") + F.col("run"))).alias("pos")).distinct()
    return front.where("pos > start").distinct().select("doc_id", F.col("start").cast("int"), F.col("pos").cast("int").alias("end"), F.lit(pattern.label).alias("label"), F.lit(pattern.ent_id).alias("ent_id"), F.lit(priority).alias("priority"))


def fixed_matches(tokens: DataFrame, patterns: list[tuple[int, Pattern]]) -> DataFrame:
    """Matches of patterns in which every step takes one token, all in one pass: a step's test looks ahead by its place."""
    w, each = by_doc(), []
    marks = {}
    for priority, p in patterns:
        for k, step in enumerate(p.steps):
            marks[f"p{priority}_{k}"] = ~compile_test(step.test) if step.negated else compile_test(step.test)
    marks = {n: c if k else apart(c) for k, (n, c) in enumerate(marks.items())}
    # A match is a run of tokens that each fulfil some step: only these are ordered, and in a run the k-th row on is the k-th token.
    t = tokens.select("doc_id", "i", *[c.alias(n) for n, c in marks.items()]).where(reduce(or_, map(F.col, marks)))
    ahead = sorted({k for _, p in patterns for k in range(1, len(p.steps))})
    t = t.select("*", *[F.coalesce(F.lead("i", k).over(w) == F.col("i") + k, F.lit(False)).alias(f"next_{k}") for k in ahead])
    t = t.select("doc_id", "i", *[(F.col(f"next_{n.split('_')[1]}") & F.lead(n, int(n.split("_")[1]), False).over(w) if not n.endswith("_0") else F.col(n)).alias(n) for n in marks])
    for priority, p in patterns:
        test = F.col(f"p{priority}_0")
        for k in range(1, len(p.steps)):
            test = test & F.col(f"p{priority}_{k}")
        each.append(F.when(test, F.struct((F.col("i") + len(p.steps)).alias("end"), F.lit(p.label).alias("label"), F.lit(p.ent_id).alias("ent_id"), F.lit(priority).alias("priority"))))
    hits = F.array_compact(F.array(*each))
    return t.where(F.size(hits) > 0).select("doc_id", F.col("i").alias("start"), F.inline(hits)).select("doc_id", "start", "end", "label", "ent_id", "priority")


def candidates(tokens: DataFrame, patterns: list[dict], attr: str = "ORTH") -> DataFrame:
    """All matches of all patterns; phrases come before token patterns in priority."""
    made = [normalize(p) for p in patterns]
    coded = [p for p in made if p.by_id]
    phrases = [*coded, *(p for p in made if p.phrase is not None and not p.by_id)]
    out = []
    if coded:
        rows = tokens.sparkSession.createDataFrame([([str(signed(int(x))) for x in p.phrase], p.label, p.ent_id, k) for k, p in enumerate(coded)], "words array<string>, label string, ent_id string, priority int")
        small = sum(20 * len(p.phrase) for p in coded) <= BROADCAST_CHARACTERS
        out.append(phrase_matches(tokens, F.broadcast(rows) if small else rows, attr, sorted({len(p.phrase) for p in coded}), attribute_id(attr).cast("string")))
    if len(phrases) > len(coded):
        spark = tokens.sparkSession
        rows = spark.createDataFrame([(list(p.phrase), p.label, p.ent_id, k) for k, p in enumerate(phrases) if not p.by_id], "w array<string>, label string, ent_id string, priority int")
        if attr not in ("ORTH", "LOWER", "SHAPE", "LENGTH", *[b for b in _BOOLEANS if b not in ("SPACY", "SENT_START", "IS_STOP")]):
            raise ValueError(f"phrases of words can't be written by {attr}; give phrase_matches() a table of its values")
        words = rows.select("label", "ent_id", "priority", F.posexplode("w").alias("k", "text"))
        words = words.withColumn("value", _phrase_value(attr)).groupBy("label", "ent_id", "priority").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("words"))
        # Small lists are sent, larger ones are joined by shuffle.
        small = sum(len(x) for p in phrases if not p.by_id for x in p.phrase) <= BROADCAST_CHARACTERS
        out.append(phrase_matches(tokens, F.broadcast(words) if small else words, attr, sorted({len(p.phrase) for p in phrases if not p.by_id})))
    rest = [(len(phrases) + k, p) for k, p in enumerate(p for p in made if p.phrase is None)]
    fixed = [(k, p) for k, p in rest if all(s.negated or s.least == s.most == 1 for s in p.steps)]
    if fixed:
        out.append(fixed_matches(tokens, fixed))
    out += [token_matches(tokens, p, k) for k, p in rest if (k, p) not in fixed]
    if not out:
        return tokens.sparkSession.createDataFrame([], "doc_id bigint, start int, end int, label string, ent_id string, priority int")
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return all_


def resolve(found: DataFrame) -> DataFrame:
    """The candidates that stay: longest first, then by start, then by priority and label; what overlaps one that stays goes.

    A partition's candidates stream by in that order, and a document's taken ranges are kept sorted: each candidate is one
    binary search, and only one document's ranges are held.
    """
    names = ["doc_id", "start", "end", "label", "ent_id", "priority"]
    kind = "doc_id bigint, start int, end int, label string, ent_id string, priority int"
    x = found.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label", "ent_id", F.col("priority").cast("int").alias("priority"))
    x = x.repartition("doc_id").sortWithinPartitions("doc_id", F.col("start") - F.col("end"), "start", "priority", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, starts, ends = None, [], []
        for batch in batches:
            keep = []
            for n, (d, a, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                if d != doc:
                    doc, starts, ends = d, [], []
                k = bisect_right(starts, a)
                # Taken ranges don't overlap: only the one before and the one after can touch this one.
                if (not k or ends[k - 1] <= a) and (k == len(starts) or starts[k] >= b):
                    starts.insert(k, a), ends.insert(k, b)
                    keep.append(n)
            yield batch.take(pa.array(keep, pa.int64()))

    return x.select(*names).mapInArrow(run, kind)


def extract(tokens: DataFrame, patterns: list[dict], attr: str = "ORTH", labels: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """collect(annotate(tokens, patterns)) for tokens without entities, and the columns `keep` of an entity's first token.

    Matches are few, so they are joined to their tokens, and the token table isn't written anew. keep: columns of the documents.
    """
    from spanframe.operators.entities import compile_labels

    if "ent_type" in tokens.columns:
        raise ValueError("these tokens have entities; annotate() writes beside them")
    stay = resolve(candidates(with_entities(tokens), patterns, attr))
    if labels is not None:
        own = compile_labels(labels)
        stay = stay.where(F.col("label").isin(*own)) if own else stay.where(F.lit(False))
    places = stay.select("doc_id", "start", "end", F.col("start").alias("start_token"), F.col("end").alias("end_token"), "label", F.nullif(F.col("ent_id"), F.lit("")).alias("ent_id"))
    # Only documents with matches are tokenized again: the semi-join goes below the tokens' windows, to the texts.
    x = tokens.select("doc_id", "i", "text", "has_space", "idx", *keep).join(stay.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    x = mark(x, places).where("mark is not null").select("*", "mark.start_token", "mark.end_token", "mark.label", "mark.ent_id")
    part = F.struct("i", "idx", "text", "has_space", *keep)
    g = x.groupBy("doc_id", "start_token", "end_token", "label", "ent_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    first, last = F.element_at("p", 1), F.element_at("p", -1)
    body = F.array_join(F.transform(F.slice("p", 1, F.size("p") - 1), lambda t: F.concat(t["text"], F.when(t["has_space"], " ").otherwise(""))), "")
    return g.select("doc_id", F.concat(body, last["text"]).alias("text"), "label", "ent_id", "start_token", "end_token", first["idx"].alias("start_char"), (last["idx"] + F.length(last["text"])).alias("end_char"), *[first[c].alias(c) for c in keep])


def existing(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, end, label) of entities that are there: a B with a type and the I of the same type after it."""
    from spanframe.operators.entities import islands

    return islands(tokens).groupBy("doc_id", "island").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"), F.first("ent_type").alias("label")).drop("island")


def annotate(tokens: DataFrame, patterns: list[dict], overwrite: bool = False, attr: str = "ORTH") -> DataFrame:
    """tokens with ent_iob, ent_type and ent_id of the patterns' matches.

    Without overwrite a match that touches a token with a type is passed over; blocked tokens have none, so they don't hinder.
    With overwrite every entity that a match touches is cleared as a whole, also where the match doesn't reach.
    """
    t = with_entities(tokens)
    # Where no entity can be yet, none has to be looked for.
    return write(t, candidates(t, patterns, attr), overwrite, "ent_type" in tokens.columns)


def with_entities(tokens: DataFrame) -> DataFrame:
    for name, value in (("ent_iob", F.lit(0)), ("ent_type", F.lit("")), ("ent_id", F.lit("")), ("ent_kb_id", F.lit(""))):
        if name not in tokens.columns:
            tokens = tokens.withColumn(name, value)
    return tokens


def write(tokens: DataFrame, found: DataFrame, overwrite: bool = False, typed_before: bool = True) -> DataFrame:
    if typed_before and not overwrite:
        typed = tokens.where("ent_type <> ''").select("doc_id", F.col("i").alias("k"))
        keys = ["doc_id", "start", "end", "label", "priority"]
        touched = found.select(*keys, F.explode(F.sequence("start", F.col("end") - 1)).alias("k")).join(typed, ["doc_id", "k"], "left_semi").select(*keys).distinct()
        found = found.join(touched, keys, "left_anti")
    stay = resolve(found)
    t = mark(tokens, stay.select("doc_id", "start", "end", "label", "ent_id"), "new")
    own, new = [c for c in tokens.columns], F.col("new").isNotNull()
    clear = F.lit(False)
    if overwrite and typed_before:
        # Both are few: entities that there were, and the tokens of the new ones.
        places = stay.select("doc_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("i"))
        hit = existing(tokens).select("doc_id", "start", "end", F.explode(F.sequence("start", F.col("end") - 1)).alias("i")).join(places, ["doc_id", "i"]).select("doc_id", "start", "end").distinct()
        t = mark(t, hit, "gone")
        clear = F.col("gone").isNotNull()
    values = {
        "ent_iob": F.when(new, F.when(F.col("i") == F.col("new.start"), 3).otherwise(1)).when(clear, 2).otherwise(F.col("ent_iob")),
        "ent_type": F.when(new, F.col("new.label")).when(clear, "").otherwise(F.col("ent_type")),
        "ent_id": F.when(new, F.col("new.ent_id")).when(clear, "").otherwise(F.col("ent_id")),
        "ent_kb_id": F.when(new | clear, "").otherwise(F.col("ent_kb_id")),
    }
    return t.select(*[values[c].alias(c) if c in values else F.col(c) for c in own])
