"""Rules, constraints and entities against a direct transcription of their definition."""

import random

import pytest
from pyspark.sql import functions as F

from spanframe.operators import constraints as C
from spanframe.operators import entities as E
from spanframe.operators import patterns as P
from spanframe.operators import regex_tokenizer as X
from spanframe.operators import ruler as R
from spanframe.operators import sentences as S
from spanframe.operators import tokens as T
from spanframe.plans import parity
from spanframe.plans.pipeline import Pipeline, select_components
from spanframe.sources import lines
from spanframe.sources.bundle import BundleError


def table(spark, docs):
    return T.from_words(spark.createDataFrame([(k, w, [True] * len(w)) for k, w in enumerate(docs)], "doc_id bigint, words array<string>, spaces array<boolean>"))


def spans(tokens):
    return sorted((r.doc_id, r.start_token, r.end_token, r.label) for r in E.collect(tokens).collect())


def matches(words, steps):
    """Frontier of positions, step by step."""
    out = set()
    for start in range(len(words)):
        front = {start}
        for test, least, most, negated in steps:
            new = set()
            for p in front:
                run = 0
                while p + run < len(words) and test(words[p + run]):
                    run += 1
                if negated:
                    new |= {p + 1} if p < len(words) and run == 0 else set()
                else:
                    new |= {p + k for k in range(least, min(most, run) + 1)}
            front = new
        out |= {(start, e) for e in front if e > start}
    return out


def test_token_patterns_are_the_frontier(spark):
    r = random.Random(4)
    docs = [[r.choice("abcd") for _ in range(r.randrange(0, 14))] for _ in range(60)]
    t = table(spark, docs)
    for ops in (["1"], ["?", "1"], ["+", "!", "*"], ["{1,3}", "?", "1"], ["!", "{2}"], ["*", "1", "{,2}"]):
        letters = [r.choice("abcd") for _ in ops]
        p = P.normalize({"label": "X", "pattern": [{"ORTH": a, "OP": o} for a, o in zip(letters, ops)]})
        got = {(x.doc_id, x.start, x.end) for x in R.candidates(t, [{"label": "X", "pattern": [{"ORTH": a, "OP": o} for a, o in zip(letters, ops)]}]).collect()}
        steps = [((lambda w, a=a: w == a), s.least, s.most, s.negated) for a, s in zip(letters, p.steps)]
        assert got == {(k, a, b) for k, d in enumerate(docs) for a, b in matches(d, steps)}, (ops, letters)


def test_overlaps_overwriting_and_blocking(spark):
    t = R.with_entities(table(spark, [["a", "b", "c", "d"]]))
    t = t.withColumn("ent_iob", F.when(F.col("i") == 1, 3).when(F.col("i") == 2, 1).otherwise(0)).withColumn("ent_type", F.when(F.col("i").between(1, 2), "GPE").otherwise(""))
    rule = [{"label": "ORG", "pattern": ["a", "b"]}]
    assert spans(R.annotate(t, rule)) == [(0, 1, 3, "GPE")]
    out = R.annotate(t, rule, overwrite=True)
    assert spans(out) == [(0, 0, 2, "ORG")] and [r.ent_iob for r in out.orderBy("i").collect()] == [3, 1, 2, 0]
    blocked = t.withColumn("ent_type", F.lit("")).withColumn("ent_iob", F.when(F.col("i") == 0, 3).otherwise(0))
    assert spans(R.annotate(blocked, rule)) == [(0, 0, 2, "ORG")]
    long_first = [{"label": "S", "pattern": ["b"]}, {"label": "L", "pattern": ["a", "b", "c"]}, {"label": "M", "pattern": ["c", "d"]}, {"label": "D", "pattern": ["d"], "id": "dee"}]
    out = R.annotate(table(spark, [["a", "b", "c", "d"]]), long_first)
    assert spans(out) == [(0, 0, 3, "L"), (0, 3, 4, "D")]
    assert [r.ent_id for r in E.collect(out).orderBy("start_token").collect()] == [None, "dee"]
    assert R.labels(long_first) == ["S", "L", "M", "D"] and R.ids(long_first) == ["dee"]
    ties = [{"label": "TOKEN", "pattern": [{"ORTH": "a"}]}, {"label": "PHRASE", "pattern": "a"}]
    assert spans(R.annotate(table(spark, [["a"]]), ties)) == [(0, 0, 1, "PHRASE")]
    assert spans(R.annotate(table(spark, [["A", "b"]]), [{"label": "P", "pattern": ["a", "B"]}], attr="LOWER")) == [(0, 0, 2, "P")]


@pytest.mark.parametrize("bad", [{"pattern": "a"}, {"label": "", "pattern": "a"}, {"label": "X", "pattern": []}, {"label": "X", "pattern": [{"NOPE": "a"}]}, {"label": "X", "pattern": [{"ORTH": "a", "OP": "{3,1}"}]}, {"label": "X", "pattern": [{"LENGTH": True}]}, {"label": "X", "pattern": [{"IS_ALPHA": "yes"}]}, {"label": "X", "pattern": [{"ORTH": {"IN": "a"}}]}, {"label": "X", "id": 5, "pattern": "a"}, {"label": "X", "pattern": [{"ORTH": "a", "TEXT": "b"}]}])
def test_bad_patterns(spark, bad):
    with pytest.raises(ValueError):
        P.normalize(bad)


def test_quantifiers():
    assert [P.quantifier(o)[:2] for o in ("1", "?", "*", "+", "{2}", "{1,3}", "{2,}", "{,4}")] == [(1, 1), (0, 1), (0, P.MORE), (1, P.MORE), (2, 2), (1, 3), (2, P.MORE), (0, 4)]
    with pytest.raises(ValueError):
        P.quantifier("{,}")


def test_islands(spark):
    r = random.Random(2)
    rows, want = [], set()
    for d in range(60):
        tags = [(r.choice([0, 1, 2, 3]), r.choice(["", "X", "Y"])) for _ in range(r.randrange(1, 12))]
        k = 0
        while k < len(tags):
            iob, kind = tags[k]
            e = k + 1
            if iob == 3 and kind:
                while e < len(tags) and tags[e] == (1, kind):
                    e += 1
                want.add((d, k, e, kind))
            k = e if iob == 3 and kind else k + 1
        rows += [(d, i, "w", True, 2 * i, a, b, "", "") for i, (a, b) in enumerate(tags)]
    t = spark.createDataFrame(rows, "doc_id bigint, i int, text string, has_space boolean, idx int, ent_iob int, ent_type string, ent_id string, ent_kb_id string")
    assert set(spans(t)) == want
    assert E.collect(t, []).count() == 0 and {x.label for x in E.collect(t, ["Y", ""]).collect()} == {"Y"}


def test_constraints(spark):
    t = table(spark, [["ab", "cd", "ef", "gh"], ["ab"]])
    make = lambda *rows: spark.createDataFrame(list(rows), C.SCHEMA)
    out = C.apply(t, make(C.parse("0:2:ORG"), C.parse("2:3:-"), (0, "default", 0, 0, "outside", None))).orderBy("doc_id", "i").collect()
    assert [(r.ent_iob, r.ent_type) for r in out] == [(3, "ORG"), (1, "ORG"), (3, ""), (2, ""), (0, "")]
    assert C.parse("1:2:?")[1] == "missing" and C.parse("1:2:O")[1] == "outside"
    out = C.apply(t, make((0, "char_entity", 1, 4, "X", "expand"))).orderBy("doc_id", "i").collect()
    assert [(r.ent_iob, r.ent_type) for r in out][:3] == [(3, "X"), (1, "X"), (0, "")]
    for rows, want in (([(0, "entity", 0, 2, "A", None), (0, "outside", 1, 2, None, None)], "overlapping constraint"), ([(0, "entity", 3, 9, "A", None)], "invalid constraint range"), ([(0, "entity", 0, 1, "", None)], "empty constraint label"), ([(0, "char_entity", 1, 2, "A", "strict")], "unaligned character constraint"), ([(0, "default", 0, 0, "outside", None)] * 2, "multiple constraint defaults")):
        assert [r.error for r in C.errors(t, make(*rows)).collect()] == [want]
        with pytest.raises(Exception, match=want):
            C.apply(t, make(*rows)).collect()
        assert C.apply(t, make(*rows), strict=False).count() == 5


def test_labels(spark):
    assert E.select_labels(["B", "", "A", "B", "C"], ["A", "B"]) == (["B", "A"], ["C"]) and E.compile_labels(["b", "", "a", "b"]) == ["a", "b"]
    for m, ls in (({"A": ""}, ["A"]), ({}, ["A"]), ({"A": "x", "Z": "y"}, ["A"])):
        with pytest.raises(ValueError):
            E.check_mapping(m, ls)
    e = spark.createDataFrame([("City",), ("Other",)], "label string")
    assert sorted(r.coarse_label or "" for r in E.fine_to_coarse(e, {"Other": "OTHERS"}).collect()) == ["", "GPE"]
    with pytest.raises(Exception, match="no mapping"):
        E.map_labels(e, {"City": "GPE"}).collect()


def test_components():
    full = [{"name": n, "factory": f} for n, f in (("t", "tok2vec"), ("p", "parser"), ("s", "senter"), ("r", "entity_ruler"), ("n", "ner"), ("q", "entity_ruler"), ("x", "lemmatizer"))]
    heads, rules, early, late = select_components(full)
    assert set(heads) == {"parse", "ner"} and rules is None and [c["name"] for c in early] == ["r"] and [c["name"] for c in late] == ["q"]
    marks = {"name": "m", "factory": "sentencizer"}
    assert select_components([full[4], marks])[1] == marks and select_components([full[2]], recognizer=False)[0] == {"senter": full[2]}
    for bad in ([], [full[0]], [full[0], full[4], full[4]], [full[2], marks, full[4]], [full[1], full[1], full[4]]):
        with pytest.raises(BundleError):
            select_components(bad)
    assert Pipeline(before=[{"label": "A", "pattern": "a"}]).stages() == ["tokenize", "sentences", "rules before", "constraints", "collect"]
    with pytest.raises(ValueError):
        Pipeline(heads=("ner",))


def test_parity(spark):
    kind = "doc_id bigint, text string, label string, start_token int, end_token int, start_char int, end_char int"
    a = spark.createDataFrame([(1, "x", "A", 0, 1, 0, 1), (1, "y", "A", 1, 2, 2, 3), (2, "z", "B", 0, 1, 0, 1), (3, "q", "B", 0, 1, 0, 1)], kind)
    b = spark.createDataFrame([(1, "x", "A", 0, 1, 0, 1), (1, "y", "A", 2, 3, 2, 3), (2, "z", "C", 0, 1, 0, 1)], kind)
    assert tuple(parity.summary(a, b).first()) == (3, 4, 3, 2, 1, False) and parity.summary(a, a).first().passed
    assert parity.differences(a, b).count() == 5


def test_lines_and_stream(spark, tmp_path):
    from spanframe.streaming import entity_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("write to a@b.co now\n\n   \nnothing here\n")
    p = Pipeline(after=[{"label": "EMAIL", "pattern": [{"LIKE_EMAIL": True}]}])
    q = entity_stream.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), p)
    q.awaitTermination(120)
    out = spark.read.text(str(tmp_path / "out")).select(F.from_json("value", "text string, language string, entities array<struct<text:string,label:string,start_char:int>>").alias("j")).select("j.*").collect()
    assert sorted((r.text, [(e.text, e.label, e.start_char) for e in r.entities]) for r in out) == [("nothing here", []), ("write to a@b.co now", [("a@b.co", "EMAIL", 9)])]
    (tmp_path / "c.jsonl").write_text('{"id": "k", "text": "x"}\n\n{"text": "y"}\n')
    assert sorted(tuple(r) for r in lines.corpus(spark, str(tmp_path / "c.jsonl")).collect()) == [("k", "x"), ("line-3", "y")]
    x = spark.createDataFrame([('"a\\nb"',), ("",)], "value string")
    assert [r.text for r in lines.texts(x, json_input=True).collect()] == ["a\nb"]


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _murmur(raw, seed=1):
    m, mask = 0xC6A4A7935BD1E995, (1 << 64) - 1
    h = seed ^ len(raw) * m & mask
    for k in range(0, len(raw) // 8 * 8, 8):
        x = int.from_bytes(raw[k:k + 8], "little") * m & mask
        h = (h ^ (x ^ x >> 47) * m & mask) * m & mask
    if len(raw) % 8:
        h = (h ^ int.from_bytes(raw[len(raw) // 8 * 8:], "little")) * m & mask
    h = (h ^ h >> 47) * m & mask
    return h ^ h >> 47


def test_whole_queries_take_all_tokens_and_passages(spark, tmp_path):
    from spanframe.plans import catalog

    docs = ["Donaudampfschifffahrtsgesellschaft ätion nátion été the", "z alpha beta gamma delta epsilon\nzeta eta theta", "short one here", "delta epsilon\nzeta and nation"]
    items = ["alpha beta gamma delta epsilon\nzeta eta", "short one", "beta gamma delta epsilon"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    cut = lambda t: [x for x in t.replace("\n", " \n ").split(" ") if x]
    words = {w for t in docs for w in cut(t)}
    assert {r.text: int(r.id) for r in run("string_hashes_whole")} == {w.lower(): _murmur(w.lower().encode()) for w in words}
    fuzzy = {r.text: (r.near, r.nearer, r.either) for r in run("fuzzy_predicates_whole")}
    assert fuzzy == {w: (_levenshtein(w, "ation") <= 2, _levenshtein(w, "ation") <= 1, _levenshtein(w, "the") <= 2 or _levenshtein(w, "tion") <= 2) for w in words}
    assert fuzzy["ätion"][1]
    label = {}
    for k, t in enumerate(map(cut, items)):
        for a in range(max(1, len(t) - 3)):
            label.setdefault(tuple(t[a:a + 4]), f"item{k}")
    want = {(d, a, a + n, label[g]) for d, t in enumerate(map(cut, docs)) for a in range(len(t)) for n in range(1, 5) if a + n <= len(t) and (g := tuple(t[a:a + n])) in label}
    got = [tuple(r) for r in run("phrase_match_candidates_whole")]
    assert len(got) == len(set(got)) and set(got) == want and (2, 0, 2, "item1") in want


def test_tokens_by_pieces_are_those_of_each_text(spark):
    r = random.Random(3)
    c = X.Config(exceptions={"don't": [("do", None), ("n't", "not")], "New York": [("New", None), (" York", "york")], "a\nb": [("a\nb", None)], "U.S.": [("U.S.", "us")]}, norms={"x": "y"}, prefix=r"[(]+", suffix=r"[).,]$", infix=r"-", token_match=r"\d+\.\d+$")
    parts = ["don't", "New York", "New", "York", "a\nb", "a", "b", "(x)", "x-y,", "U.S.", "1.5", "1.5.", " ", "  ", "\n", "é", "(don't)."]
    texts = ["", None] + ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randrange(1, 12))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2)
    got = {x.doc_id: None if x.t is None else [tuple(t) for t in x.t] for x in docs.select("doc_id", X.token_array(F.col("text"), c).alias("t")).collect()}
    assert got == {k: None if t is None else X.tokenize(t, c) for k, t in enumerate(texts)}


def test_resolution_is_that_of_the_definition(spark):
    r = random.Random(4)
    rows = []
    for d in range(12):
        for _ in range(r.choice([1, 5, 60])):
            a = r.randrange(40)
            rows.append((d, a, a + r.randrange(1, 7), r.choice("XY"), "", r.randrange(3)))
    rows += rows[:20]
    want = set()
    for d in range(12):
        taken = []
        for x in sorted((x for x in rows if x[0] == d), key=lambda x: (x[1] - x[2], x[1], x[5], x[3])):
            if all(x[2] <= y[1] or y[2] <= x[1] for y in taken):
                taken.append(x)
        want |= set(taken)
    found = spark.createDataFrame(rows, "doc_id int, start int, end int, label string, ent_id string, priority int")
    got = [tuple(x) for x in R.resolve(found).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_heads_of_a_long_chain_and_bad_heads(spark):
    n = 3000
    chain = spark.createDataFrame([(1, i, -1 if i else 0) for i in range(n)] + [(2, 0, 0)], "doc_id int, i int, head int")
    assert [(x.doc_id, x.i) for x in S.starts_from_heads(chain).where("sent_start = 1").collect()] in ([(1, 0), (2, 0)], [(2, 0), (1, 0)])
    for bad in ([(1, 0, 1)], [(1, 0, 1), (1, 1, -1)]):
        with pytest.raises(Exception, match="head"):
            S.starts_from_heads(spark.createDataFrame(bad, "doc_id int, i int, head int")).collect()
