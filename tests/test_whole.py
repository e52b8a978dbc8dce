"""Queries on odd documents, and the steps that large tables go through against plain definitions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanframe.functions import ids, lexical
from spanframe.operators import constraints as C
from spanframe.operators import patterns
from spanframe.operators import regex_tokenizer as X
from spanframe.operators import tokens as T
from spanframe.plans import catalog
from spanframe.sources import docbin

TEXTS = ["", "a b c d e", "12 x", " ", None]


@pytest.fixture
def run(spark, tmp_path):
    """A query by name over a few documents."""

    def over(name, texts=TEXTS):
        rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return sorted((tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()), key=str)

    return over


def test_constraint_errors_of_documents_with_tokens(run):
    short, both = "invalid constraint range", "overlapping constraint"
    assert run("constraints_errors") == [(1, both), (2, short), (3, short)]


def test_texts_without_tokens_come_back(run):
    got = run("doc_text_roundtrip")
    assert [r[:2] for r in got] == [(0, 0), (1, 9), (2, 4), (3, 1), (4, None)] and got[0][2] == "d41d8cd98f00b204e9800998ecf8427e"


def test_tokens_cut_by_bytes_are_those_of_the_definition(spark):
    r = random.Random(1)
    letters = "ab é 日　  \u0085 \n\t \U0001F600.ſ‐"
    texts = [None, ""] + ["".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 5, 30]))) for _ in range(300)]
    want = [None if t is None else [(i, *x[:3]) for i, x in enumerate(X.tokenize(t, X.Config()))] for t in texts]
    for most in (1, 40, 1 << 20):
        got = [x for p in T.parts(pa.array(["left out", *texts])[1:], most) for x in T.cut(p).to_pylist()]
        assert [None if x is None else [tuple(t.values()) for t in x] for x in got] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    a, b = T.nested(docs), T.nest(T.flat(docs))
    assert a.dtypes == b.dtypes and sorted(a.collect()) == sorted(b.collect()) and T.nested(docs, empty=True).count() == len(texts)


def test_entity_lines_of_documents_with_tokens(run):
    assert run("jsonl_entities") == [(1, "en", 0), (2, "en", 1), (3, "en", 0)]


def test_containers_stay_within_their_limits(spark):
    r, limits = random.Random(2), docbin.Limits(tokens=60, documents=4, decompressed=5000)
    docs = [(k % 2, k, [[r.randrange(1 << 40), k] for _ in range(r.choice([0, 3, 20, 40]))]) for k in range(40)]
    table = spark.createDataFrame([(p, k, t, [True] * len(t)) for p, k, t in docs], "part bigint, doc_id bigint, tokens array<array<bigint>>, spaces array<boolean>")
    packed = docbin.pack_documents(docbin.in_order(table), [65, 71], limits=limits).collect()
    got = {0: [], 1: []}
    for p, content in packed:
        got[p] += [d["tokens"].tolist() for d in docbin.decode(bytes(content), limits)[1]]
    assert len(packed) > 12 and {p: sorted(x) for p, x in got.items()} == {p: sorted(t for q, _, t in docs if q == p) for p in (0, 1)}
    with pytest.raises(Exception, match="over the limit"):
        docbin.pack_documents(table.where("doc_id < 0").unionByName(spark.createDataFrame([(0, 1, [[1, 1]] * 61, [True] * 61)], table.schema)), [65, 71], limits=limits).collect()


def test_ids_of_arrays(spark):
    words = ["", "NOUN", "FLAG19", "FLAG7", "DEPRECATED005", "word", "word", "Zoë", "x" * 30]
    a = spark.createDataFrame([(words,), ([],), (None,), (words[:2],)], "w array<string>").select(ids.string_ids(F.col("w")).alias("k")).collect()
    want = [int(np.uint64(ids.string_id_of(w)).astype(np.int64)) for w in words]
    assert [r.k for r in a] == [want, [], None, want[:2]]


def test_marks_are_those_of_a_join(spark):
    texts = ["a b c d e f", "g h", "", "k l m"]
    t = T.flat(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    spans = spark.createDataFrame([(0, 4, 5, "z"), (0, 1, 3, "y"), (1, 0, 2, "x"), (3, 9, 11, "w")], "doc_id bigint, start int, end int, label string")
    got = {(r.doc_id, r.i): r.mark and r.mark.label for r in T.mark(t, spans).collect()}
    assert len(got) == 11 and {k: v for k, v in got.items() if v} == {(0, 1): "y", (0, 2): "y", (0, 4): "z", (1, 0): "x", (1, 1): "x"}
    plan = T.mark(t, spans)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_guards_of_shapes_and_numbers_change_nothing(spark):
    r = random.Random(5)
    words = ["".join(r.choice("(1a-Z)é²9") for _ in range(r.randrange(1, 10))) for _ in range(400)] + ["x" * 100, "+One", "THIRD", "tw,o.", "3RD", "±1,000.5", "1/2", "Kth"]
    t = spark.createDataFrame([(w,) for w in words], "text string")
    shapes = ["(d)", "xXd", "d", "LONG", "XX", "dddd", "x-x"]
    c = F.col("text")
    x = t.select("text", lexical.shape(c).alias("s"), *[lexical.has_shape(c, v).alias(f"h{k}") for k, v in enumerate(shapes)], patterns.apart(lexical.like_num(c)).alias("n"), lexical.like_num(c).alias("m")).collect()
    assert all([r[f"h{k}"] for k in range(len(shapes))] == [r.s == v for v in shapes] and r.n == r.m for r in x)
    assert {r.text for r in x if r.m} >= {"+One", "THIRD", "tw,o.", "3RD", "±1,000.5", "1/2"} and not {r.text for r in x if r.m} & {"Kth", "x" * 100}


def test_rules_over_several_tokens_next_to_others(run):
    got = run("pipeline_entities_end_to_end", ["12 +1 (555) 123-4567", "+1 x (555) 123-456"])
    assert {r[:6] for r in got} == {(0, "12", "NUMBER", None, 0, 1), (0, "+1 (555) 123-4567", "PHONE", None, 1, 4), (1, "+1", "NUMBER", None, 0, 1)}


def test_a_batch_of_texts_is_cut_in_parts():
    seen = []
    texts = pa.array(["abcdef", None, "", "ghi jkl mno pqr", "s"])
    for p in T.parts(texts, 10):
        seen += [p.to_pylist()]
    assert sum(seen, []) == texts.to_pylist() and len(seen) == 3


def test_documents_within_their_rows(run):
    assert run("token_access", ["", "a b ", None, "c"]) == [(1, "a", "b", True, 2), (3, "c", "c", False, 0)]
    assert [r[0] for r in run("span_slices", ["", "a b ", None, "c"])] == [1, 3] and [r[0] for r in run("token_lines", ["", "a b ", None, "c"])] == [1, 3]


def test_constraints_leave_tokens_where_they_are(spark):
    t = T.flat(spark.createDataFrame([(1, "a b c d"), (2, "e f")], "doc_id bigint, text string"))
    wanted = spark.createDataFrame([(1, "entity", 1, 3, "X", None), (1, "default", 0, 0, "outside", None)], C.SCHEMA)
    out = C.apply(t, wanted)
    assert {(r.doc_id, r.i): (r.ent_iob, r.ent_type) for r in out.collect()} == {(1, 0): (2, ""), (1, 1): (3, "X"), (1, 2): (1, "X"), (1, 3): (2, ""), (2, 0): (0, ""), (2, 1): (0, "")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("SortMergeJoin" in x and "[doc_id" in x and ", i#" in x for x in plan.splitlines())
