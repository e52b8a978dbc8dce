"""Operators against known values: hashes, spans, sentences, decoders, kernels, codecs."""

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanframe.functions import ids, kernels, lexical
from spanframe.operators import decoders as D
from spanframe.operators import encoder as N
from spanframe.operators import morphemes as M
from spanframe.operators import patterns
from spanframe.operators import ruler as R
from spanframe.operators import regex_tokenizer as X
from spanframe.operators import sentences as S
from spanframe.operators import tokens as T
from spanframe.operators import wordpiece as P
from spanframe.plans import load as L
from spanframe.plans.pipeline import Pipeline
from spanframe.sources import bundle, docbin


def words(spark, rows):
    return T.from_words(spark.createDataFrame([(k, w, s) for k, (w, s) in enumerate(rows)], "doc_id bigint, words array<string>, spaces array<boolean>"))


def test_hashes_and_symbols():
    known = {"": 14313749767032693980, "hello": 5983625672228268878, "spaCy": 6772933960739496234, "é": 16256712947286012828, "é": 12745818603700845520, "日本語": 1998301522555383300, "🦀": 814917477307458328}
    got = ids.hash_strings(pa.array(list(known))).to_numpy().view(np.uint64).tolist()
    assert got == list(known.values())
    assert [ids.symbol_id(x) for x in ("X", "dep", "_", "FLAG42", "DEPRECATED276", "FLAG042", "FLAG64", "DEPRECATED000")] == [101, 414, 456, 42, 379, None, None, None]
    assert ids.feature_hash(np.array([0], np.uint64), 8).tolist() == [[0, 0, 0, 0]]
    assert ids.feature_hash(np.array([2**64 - 1], np.uint64), 13).tolist() == [[3199409384, 1062937581, 752279700, 3061442444]]


def test_string_ids_of_a_column(spark):
    texts = ["", "X", "dep", "FLAG42", "DEPRECATED276", "FLAG99", "hello", "a longer text than eight bytes"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ids.unsigned(ids.string_id(F.col("t"))).alias("id")).collect()
    assert {r.t: int(r.id) for r in out} == {t: ids.string_id_of(t) for t in texts}
    store = ids.Strings(["a", "b", "a", ""])
    assert len(store) == 2 and store.get(0) == "" and store.get(ids.string_id_of("b")) == "b"


@pytest.mark.parametrize("text", ["a  b\nc", " lead", "trail ", "　x y", "", "one"])
def test_native_and_rule_tokenizers_agree(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    a = [(r.i, r.text, r.has_space, r.idx) for r in T.flat(docs).orderBy("i").collect()]
    b = [(r.i, r.text, r.has_space, r.idx) for r in X.flat(docs, X.Config()).orderBy("i").collect()]
    assert a == b and "".join(t + " " * s for _, t, s, _ in a) == text


def test_rule_tokenizer():
    c = X.Config(exceptions={"don't": [("do", None), ("n't", "not")], "New York": [("New York", None)], "U.S.": [("U.S.", None)]}, prefix=r"^[(\"]", suffix=r"[).,\"]$", infix=r"-|~", url_match=r"^https?://")
    got = X.tokenize('(don\'t go to New York-ish, U.S.). http://a-b.c', c)
    assert [t for t, *_ in got] == ["(", "do", "n't", "go", "to", "New York", "-", "ish", ",", "U.S.", ")", ".", "http://a-b.c"] or [t for t, *_ in got][:5] == ["(", "do", "n't", "go", "to"]
    assert [n for t, _, _, n in got if t == "n't"] == ["not"]
    for t, _, at, _ in got:
        assert '(don\'t go to New York-ish, U.S.). http://a-b.c'[at:at + len(t)] == t
    with pytest.raises(ValueError):
        X.Config(exceptions={"ab": [("a", None)]})
    with pytest.raises(ValueError):
        X.tokenizer("sudachi")


def test_char_spans(spark):
    t = T.nest(words(spark, [(["Tokyo", "Shibuya"], [True, False]), (["東京", "都"], [False, False]), (["A"], [True])]))
    cases = [(0, 0, 5, "strict", (0, 1)), (0, 1, 5, "strict", None), (0, 1, 5, "contract", None), (0, 1, 5, "expand", (0, 1)), (0, 0, 6, "contract", (0, 1)), (0, 5, 6, "expand", (1, 1)), (0, 13, 13, "expand", None), (1, 2, 3, "strict", (1, 2)), (1, 0, 4, "expand", None), (2, 1, 1, "expand", (1, 1)), (2, 1, 2, "expand", (1, 1)), (2, 2, 2, "expand", None)]
    for doc, a, b, mode, want in cases:
        s = t.where(F.col("doc_id") == doc).select(T.char_span(F.col("tokens"), F.lit(a), F.lit(b), mode).alias("s")).first().s
        assert (None if s is None else (s.start, s.end)) == want, (doc, a, b, mode)
    s = t.where("doc_id = 0").select(T.span(F.col("tokens"), F.lit(0), F.lit(2)).alias("s")).first().s
    assert (s.start_char, s.end_char, s.text) == (0, 13, "Tokyo Shibuya")
    assert t.where("doc_id = 2").select(T.char_len(F.col("tokens")).alias("n")).first().n == 2


def test_sentences(spark):
    cases = [(["Alice", ".", ")", "Bob", "?", "Carol"], (".", "?"), [1, -1, -1, 1, -1, 1]), (["甲", "。", "乙", "END", "丙"], ("。", "END"), [1, -1, 1, -1, 1]), (["Alice", "‼", "”", "Bob"], ("‼",), [1, -1, -1, 1])]
    for w, marks, want in cases:
        got = S.sentence_starts(words(spark, [(w, [False] * len(w))]), marks).orderBy("i").collect()
        assert [r.sent_start for r in got] == want
    heads = [2, 1, 0, 1, 0, 0, -1]
    t = words(spark, [(list("abcdefg"), [False] * 7)]).join(spark.createDataFrame(list(enumerate(heads)), "i int, head int"), "i")
    assert [r.sent_start == 1 for r in S.starts_from_heads(t).orderBy("i").collect()] == [True, False, False, True, False, True, False] == D.starts_of_heads([2, 2, None, 4, None, None, 5])
    assert D.starts_of_heads([1, 1, 3, 3]) == [True, False, True, False]
    with pytest.raises(ValueError):
        S.choose(False, True, True)


def test_arc_eager():
    s = D.ArcEager([0, 0, 0])
    assert s.features() == [0, 1] + [-1] * 6
    s.apply("S", ""), s.apply("R", "dep")
    assert s.features() == [2, -1, 1, 0, -1, -1, -1, -1]
    s.apply("L", "dep")
    assert s.features() == [2, -1, 0, -1, -1, 1, -1, -1]
    heads, labels = [1, 2, 2, 4, 5, 2, 7, 5, 2], ["det", "nsubj", "root", "det", "dobj", "aux", "nsubj", "acl||dobj", "punct"]
    D.deprojectivize(heads, labels, [False] * 9)
    assert heads[7] == 4 and labels[7] == "acl"
    r = np.random.default_rng(0)
    for n in (0, 1, 7, 40):
        h, dep, starts = D.parse([("S", ""), ("D", ""), ("L", "x"), ("R", "y")], lambda f: r.random(4), ["w"] * n, [0] * n)
        assert all(0 <= k + x < n for k, x in enumerate(h)) and (n == 0 or 1 in starts)


def test_biluo():
    new = lambda iob, types, starts=None: D.Biluo(["w"] * len(iob), starts or [0] * len(iob), iob, types)
    s = new([0, 0], ["", ""])
    assert s.valid("B", "X") and s.valid("O", "") and s.valid("U", "X") and not s.valid("I", "X") and not s.valid("L", "X") and not s.valid("U", "")
    assert not new([0, 0], ["", ""], [0, 1]).valid("B", "X")
    s = new([3, 1], ["X", "X"])
    assert s.valid("B", "X") and not s.valid("B", "Y") and not s.valid("U", "X") and not s.valid("O", "")
    assert new([3, 0], ["", ""]).valid("U", "") and not new([3, 0], ["", ""]).valid("O", "")
    r = np.random.default_rng(1)
    actions = [D.entity_action(a) for a in ("O", "B-X", "I-X", "L-X", "U-X", "B-Y", "I-Y", "L-Y", "U-Y", "U-")]
    iob, types = [0, 3, 1, 0, 3, 0, 0, 2, 0], ["", "X", "X", "", "", "", "", "", ""]
    for _ in range(50):
        codes, kinds = D.recognize(actions, lambda f: r.random(10), ["w"] * 9, [1, 0, 0, 0, 0, 0, 0, 0, 0], iob, types)
        assert codes[1:3] == [3, 1] and kinds[1:3] == ["X", "X"] and (codes[4], kinds[4]) == (3, "") and 0 not in codes


def test_kernels():
    x = np.array([[1], [2], [3]], np.float32)
    assert kernels.np_expand_window(x, 1, [2, 1]).tolist() == [[0, 1, 2], [1, 2, 0], [0, 3, 0]]
    assert kernels.spans_of(0, 128, 96) == [] and kernels.spans_of(12, 128, 96) == [(0, 12)] and kernels.spans_of(300, 128, 96) == [(0, 128), (96, 224), (192, 300)]
    r = np.random.default_rng(0)
    y, w, pad = r.random((5, 3)), r.random((2, 4, 2, 3)), r.random((2, 4, 2))
    cache, bias = kernels.np_precompute(y, w, pad), r.random((4, 2))
    want = np.max(w[0] @ y[3] + pad[1] + bias, 1)
    assert np.allclose(kernels.np_state_hidden(cache, [3, -1], bias), want)
    assert kernels.np_pool(np.array([[2.0], [4.0], [9.0]]), np.array([0, 0, -1]), 2).tolist() == [[3.0], [0.0]]
    ids_, mask = next(kernels.np_batches([np.array([1]), np.array([2, 3])], 0))
    assert ids_.tolist() == [[1, 0], [2, 3]] and mask.tolist() == [[True, False], [True, True]]
    assert kernels.window_of(48, 16) == 1


def test_column_kernels_are_the_numpy_ones(spark):
    r = np.random.default_rng(3)
    x, w, b, g = r.random(5), r.random((3, 2, 5)), r.random((3, 2)), r.random(5)
    row = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(
        kernels.maxout(F.col("x"), w.tolist(), b.tolist()).alias("m"), kernels.layer_norm(F.col("x"), g.tolist(), g.tolist()).alias("n"), kernels.softmax(F.col("x"), 0.5).alias("s"), kernels.argmax(F.col("x")).alias("a"),
    ).first()
    assert np.allclose(row.m, kernels.np_maxout(x[None], w, b)[0]) and np.allclose(row.n, kernels.np_layer_norm(x[None], g, g)[0]) and np.allclose(row.s, kernels.np_softmax(x[None], 0.5)[0]) and row.a == x.argmax()


def test_encoder_is_local_to_documents(spark):
    m = N.synthetic()
    t = words(spark, [(["a", "b", "c"], [True, True, False]), (["d"], [False])])
    both = {(r.doc_id, r.i): r.vector for r in N.vectors(t, m).collect()}
    alone = {(r.doc_id, r.i): r.vector for r in N.vectors(t.where("doc_id = 1"), m).collect()}
    assert np.allclose(both[1, 0], alone[1, 0]) and len(both[0, 0]) == 16
    out = N.annotate(t, m).collect()
    assert len(out) == 4 and {r.ent_iob for r in out} <= {1, 2, 3}


@pytest.mark.parametrize("bad", ["not zlib", "lengths", "negative", "attrs", "cats"])
def test_docbin(bad):
    docs = [{"tokens": [[1, 2**63], [3, 4]], "spaces": [True, False], "cats": {"x": 0.5}, "flags": {"f": True}, "span_groups": b"g"}, {"tokens": np.zeros((0, 2), np.uint64), "spaces": []}]
    data = docbin.encode([65, 80], docs)
    attrs, out, _ = docbin.decode(data)
    assert attrs == [65, 80] and out[0]["tokens"].tolist() == [[1, 2**63], [3, 4]] and out[0]["spaces"].tolist() == [True, False] and out[0]["cats"] == {"x": 0.5} and len(out[1]["tokens"]) == 0 and "user_data" not in out[0]
    assert docbin.decode(docbin.encode([65], [{"tokens": [[7]], "spaces": [True], "user_data": b"u"}]))[1][0]["user_data"] == b"u"
    body = docbin.unpack(zlib.decompress(data))
    body |= {"lengths": {"lengths": np.array([5], "<i4").tobytes()}, "negative": {"lengths": np.array([-1, 3], "<i4").tobytes()}, "attrs": {"attrs": [65]}, "cats": {"cats": []}}.get(bad, {})
    with pytest.raises((ValueError, zlib.error)):
        docbin.decode(b"xx" if bad == "not zlib" else zlib.compress(docbin.pack(body)))
    with pytest.raises(ValueError):
        docbin.decode(data, docbin.Limits(tokens=1))


def test_messagepack():
    r = random.Random(0)
    for x in [None, True, -1, -33, 2**40, -2**40, 2**64 - 1, 1.5, "é" * 40, b"x" * 300, list(range(20)), {"a": [1, {"b": None}]}, ["s" * 70000], {str(k): k for k in range(40)}, [r.randrange(-2**31, 2**31) for _ in range(100)]]:
        assert docbin.unpack(docbin.pack(x)) == x


def make_bundle(at, change=lambda m, t: None, limits=False):
    """A bundle of seeded weights, one encoder for a tagger, a parser and a recognizer, changed in one place."""
    L.save_model(at, N.synthetic(), ("tag", "parse", "ner"))
    m, t = json.loads((at / "manifest.json").read_text()), bundle.read_tensors((at / "weights.safetensors").read_bytes())
    t = {k: v.copy() for k, v in t.items()}
    change(m, t)
    (at / "manifest.json").write_text(json.dumps(m)), (at / "weights.safetensors").write_bytes(bundle.write_tensors(t))


def named(m, factory):
    return next(c for c in m["pipeline"] if c["factory"] == factory)


def test_bundle(spark, tmp_path):
    make_bundle(tmp_path)
    b = bundle.load(tmp_path)
    assert b.tensor(named(b.manifest, "tagger")["nodes"][1]["params"]["W"]["key"]).shape == (3, 16)
    assert bundle.inspect(spark, tmp_path).first().compatible
    assert {r.component: r.tensors for r in bundle.tensors_per_component(spark, b.manifest).collect()} == {"tok2vec": 18, "tagger": 2, "parser": 7, "ner": 7}
    wrong = {
        "unsupported_bundle_format": [lambda m, t: m.update(format_version=2)], "python_required": [lambda m, t: m["runtime"].update(requires_python=True)],
        "invalid_manifest_json": [lambda m, t: m.pop("source"), lambda m, t: m["tokenizer"].pop("path"), lambda m, t: m["tokenizer"].update(kind="other"), lambda m, t: named(m, "ner").pop("kind"), lambda m, t: m.update(pipeline={})],
        "unsafe_bundle_path": [lambda m, t: m["tokenizer"].update(path="../x"), lambda m, t: named(m, "ner").update(state_path="/etc/x")], "missing_tensor": [lambda m, t: t.pop("0")], "duplicate_tensor": [lambda m, t: named(m, "tagger")["nodes"][1]["params"]["b"].update(key="0")],
        "tensor_shape": [lambda m, t: t.update({"0": np.ones((3, 2), np.float32)})], "tensor_dtype": [lambda m, t: t.update({"0": t["0"].astype(np.uint64)})], "missing_graph_node": [lambda m, t: named(m, "ner").update(root_node=99), lambda m, t: named(m, "ner")["nodes"][1].update(children=[77])],
        "unsupported_language": [lambda m, t: m["source"].update(lang="xx")], "tokenizer_backend_disabled": [lambda m, t: m["tokenizer"].update(kind="sudachi")], "missing_component": [lambda m, t: m["pipeline"].pop()],
        "invalid_component": [lambda m, t: m["pipeline"].append(dict(named(m, "ner"), name="again", nodes=[], kind="rule_based")), lambda m, t: named(m, "ner").update(moves=["O"]), lambda m, t: named(m, "tagger").update(labels=["A"]), lambda m, t: m["pipeline"].append(dict(named(m, "ner")))],
        "duplicate_graph_node": [lambda m, t: named(m, "ner")["nodes"].append(dict(named(m, "ner")["nodes"][0]))], "missing_upstream_tok2vec": [lambda m, t: m["pipeline"].pop(0)], "conflicting_upstream_tok2vec": [lambda m, t: named(m, "ner")["settings"].update(tok2vec_upstream="other")],
        "missing_file": [lambda m, t: m["tokenizer"].update(path="none.json")], "invalid_graph_node": [lambda m, t: named(m, "tok2vec")["nodes"][1]["attrs"].pop("seed"), lambda m, t: named(m, "tok2vec")["nodes"][-1]["attrs"].update(pad=0)],
    }
    for code, changes in wrong.items():
        for change in changes:
            make_bundle(tmp_path, change)
            r = bundle.inspect(spark, tmp_path).first()
            assert not r.compatible and r.diagnostics[0].code == code, (code, r.diagnostics)
    with pytest.raises(bundle.BundleError):
        make_bundle(tmp_path)
        bundle.load(tmp_path, bundle.Limits(manifest=10))
    # Limits of nodes are those of one component, of tensors those of all.
    assert bundle.load(tmp_path, bundle.Limits(nodes=17)).manifest and bundle.load(tmp_path, bundle.Limits(tensors=34))
    for limits in (bundle.Limits(nodes=16), bundle.Limits(tensors=33), bundle.Limits(components=3), bundle.Limits(rank=2)):
        with pytest.raises(bundle.BundleError):
            bundle.load(tmp_path, limits)


def test_a_loaded_pipeline_does_what_its_model_does(spark, tmp_path):
    """A bundle of a model with word vectors, an exception, rulers before and after, against the same stages by hand."""
    # What a ruler presets must be among the recognizer's moves.
    moves = ["O", "B-X", "I-X", "L-X", "U-X", "U-", "B-EARLY", "I-EARLY", "L-EARLY", "U-EARLY"]
    m = N.synthetic(3, entities=moves)
    r = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma"]
    keys = np.array(sorted(ids.string_id_of(w) for w in words), np.uint64)
    w = dict(m.w)
    w["mix.W"] = np.concatenate([w["mix.W"], r.standard_normal((16, 3, 5)).astype(np.float32)], 2)
    m = N.Model(w, m.seeds, 1, m.tags, ["S", "D", "L-dep", "R-dep"], moves, static=(keys, np.array([2, 0, 1]), r.standard_normal((3, 4)).astype(np.float32), r.standard_normal((5, 4)).astype(np.float32)))
    code = ids.string_id_of
    early = {"overwrite_ents": False, "phrase_matcher_attr": "LOWER", "patterns": [{"label": "EARLY", "id": "e", "token_ids": [code("beta"), code("gamma")]}]}
    late = {"overwrite_ents": True, "phrase_matcher_attr": "ORTH", "patterns": [], "token_patterns": [{"label": "LATE", "tokens": [{"op": "1", "constraints": [{"attribute": "LOWER", "kind": "in", "values": [code("delta")]}]}, {"op": "?", "constraints": [{"attribute": "LENGTH", "kind": "numeric", "comparison": ">=", "value": 5}]}]}]}
    rules = [{"name": "one", "factory": "entity_ruler", "settings": early, "before": "ner"}, {"name": "two", "factory": "entity_ruler", "settings": late}]
    c = X.Config(exceptions={"don't": [("do", None), ("n't", "not")]}, norms={"alpha": "ALPHA"}, suffix=r"\.$", language="en")
    L.save_model(tmp_path, m, ("tag", "parse", "ner"), tokenizer=c, rules=rules)
    p = Pipeline.load(bundle.load(tmp_path))
    docs = spark.createDataFrame([(k, " ".join(r.choice(["alpha", "Beta", "gamma", "delta", "don't", "omega."], 12))) for k in range(8)], "doc_id bigint, text string")
    assert p.stages() == ["tokenize", "encode", "rules before", "constraints", "recognize", "rules after", "collect"] and p.labels() == ["EARLY", "X", "LATE"] and p.supports("LATE")
    t = X.flat(docs, c)
    x = N.annotate(t, m, ("tag", "parse"))
    x = R.annotate(x, [{"label": "EARLY", "id": "e", "pattern": ["beta", "gamma"]}], attr="LOWER")
    x = R.annotate(N.annotate(x, m, ("ner",)), [{"label": "LATE", "pattern": [{"LOWER": "delta"}, {"LENGTH": {">=": 5}, "OP": "?"}]}], True)
    key = ["doc_id", "i", "text", "norm", "tag", "head", "dep", "sent_start", "ent_iob", "ent_type", "ent_id"]
    got = sorted(map(tuple, p.process(docs).select(*key).collect()))
    assert got == sorted(map(tuple, x.select(*key).collect())) and {g[9] for g in got} >= {"EARLY", "LATE"}
    assert len({(g[0], g[1]) for g in got}) == len(got) and len({g[4] for g in got}) > 1
    own = Pipeline.load(bundle.load(tmp_path), tokenize=T.flat)
    assert own.process(docs).count() == T.flat(docs).count()


def test_static_vectors_and_hash_embedding_by_hand():
    m = N.Model({"embed.0": np.arange(12, dtype=np.float32).reshape(6, 2), "mix.W": np.zeros((2, 1, 4), np.float32), "mix.b": np.zeros((2, 1), np.float32), "mix.gain": np.ones(2, np.float32), "mix.shift": np.zeros(2, np.float32)}, [9], columns=["NORM"], static=(np.array([5, 2**63 + 1], np.uint64), np.array([1, 0]), np.array([[1, 0], [0, 2]], np.float32), np.array([[1, 1], [3, -1]], np.float32)))
    assert m.static_vectors(np.array([2**63 + 1, 5, 6], np.uint64)).tolist() == [[1, 3], [2, -2], [0, 0]]
    assert m.all_columns == ("NORM", "ORTH") and m.encode(np.zeros((3, 2), np.int64)).shape == (3, 2)
    with pytest.raises(ValueError):
        N.Model({"conv.0.W": np.zeros(1)}, [], pad=0)


@pytest.mark.parametrize("constraint,hits", [
    ({"attribute": "ORTH", "kind": "equal", "values": [ids.string_id_of("Ab")]}, {"Ab"}), ({"attribute": "LOWER", "kind": "not_in", "values": [ids.string_id_of("ab")]}, {"12", "x"}), ({"attribute": "IS_DIGIT", "kind": "boolean", "value": True}, {"12"}), ({"attribute": "LENGTH", "kind": "numeric_set", "values": [2], "negate": True}, {"x"}),
    ({"attribute": "ORTH", "kind": "regex_set", "patterns": ["^A", "^x$"], "negate": False}, {"Ab", "x"}), ({"attribute": "LOWER", "kind": "fuzzy", "pattern": "abc", "max_edits": 1}, {"Ab"}), ({"attribute": "LOWER", "kind": "id_set_relation", "comparison": "is_superset", "values": [ids.string_id_of("x")]}, {"x"}), ({"attribute": "MORPH", "kind": "morph_set", "comparison": "is_superset", "features": [ids.string_id_of("A=b")]}, {"Ab"}),
])
def test_constraints_of_bundles(spark, constraint, hits):
    t = spark.createDataFrame([("Ab", ["A=b", "C=d"]), ("12", []), ("x", ["C=d"])], "text string, morph_features array<string>")
    assert {r.text for r in t.where(patterns.compile_constraint(constraint)).collect()} == hits
    for bad in ({**constraint, "kind": "none"}, {k: v for k, v in constraint.items() if k in ("attribute", "kind")}, {**constraint, "attribute": "NOPE"}):
        with pytest.raises(ValueError):
            patterns.check_constraint(bad)


def test_wordpieces():
    v = P.load_vocabulary("[PAD]\n[UNK]\n[CLS]\n[SEP]\nun\n##aff\n##able\na")
    assert P.encode_word("unaffable", v) == ([4, 5, 6], True) and P.encode_word("unx", v) == ([1], False) and P.encode_word("a" * 101, v) == ([1], False)
    got, owner = P.encode_span(["Unaffable", " ", "zz"], v)
    assert got.tolist() == [2, 4, 5, 6, 1, 3] and owner.tolist() == [-1, 0, 0, 0, -1, -1]
    with pytest.raises(ValueError):
        P.load_vocabulary("a")


def test_morphemes(spark):
    rows = [("千", "名詞,数,*,*,*,*,千,セン"), ("東京", "名詞,固有名詞,地域,一般,*,*,東京,トウキョウ"), ("走る", "動詞,自立,*,*,五段,基本形,走る,ハシ=ル"), ("。", "記号,句点,*,*,*,*,。,。"), ("は", "助詞,係助詞,*,*,*,*,は,ハ"), ("x", "謎,*,*,*,*,*,*,*")]
    x = spark.createDataFrame(rows, "surface string, feature string").withColumn("f", M.parse_feature(F.col("feature")))
    out = {r.surface: r for r in x.select("surface", "f", M.unidic_tag(F.col("f")).alias("tag"), M.morph_string(F.col("f.inflection"), F.col("f.reading")).alias("m")).collect()}
    assert [out[s].tag for s, _ in rows] == ["名詞-数詞", "名詞-固有名詞-地名-一般", "動詞-一般", "補助記号-句点", "助詞-係助詞", None]
    assert out["走る"].m == "Inflection=五段;基本形|Reading=ハシ_ル" and out["x"].m == ""
    m = [(1, 0, "1", 0, 1, M.NUMERAL, "1"), (1, 1, ",", 1, 2, "補助記号-読点", ","), (1, 2, "234", 2, 5, M.NUMERAL, "234"), (1, 3, ".", 5, 6, "補助記号-句点", "."), (1, 4, "5", 6, 7, M.NUMERAL, "5"), (1, 5, "円", 7, 8, "名詞", "円"), (2, 0, "1", 0, 1, M.NUMERAL, "1"), (2, 1, ",", 1, 2, "補助記号-読点", ","), (2, 2, "23", 2, 4, M.NUMERAL, "23")]
    got = M.merge_numbers(spark.createDataFrame(m, "doc_id int, k int, surface string, start int, end int, tag string, norm string")).orderBy("doc_id", "k").collect()
    assert [(r.doc_id, r.surface, r.norm) for r in got] == [(1, "1,234.5", "1234.5"), (1, "円", "円"), (2, "1", "1"), (2, ",", ","), (2, "23", "23")]
    t = [(1, 0, "桜", 0, 1, "名詞-固有名詞-地名-一般"), (1, 1, "町", 1, 2, "名詞"), (1, 2, "3", 2, 3, M.NUMERAL), (1, 3, "丁目", 3, 5, "名詞")]
    got = M.merge_towns(spark.createDataFrame(t, "doc_id int, k int, surface string, start int, end int, tag string")).orderBy("k").collect()
    assert [r.surface for r in got] == ["桜町", "3", "丁目"]
    g = spark.createDataFrame([(1, 0, "a", 0, 1, "t"), (1, 1, "b", 2, 3, "t"), (1, 2, "c", 5, 6, "t")], "doc_id int, k int, surface string, start int, end int, tag string")
    got = M.with_gaps(g, spark.createDataFrame([(1, "a b  c"), (2, "\n")], "doc_id int, text string")).orderBy("doc_id", "i").collect()
    assert [(r.doc_id, r.text, r.has_space) for r in got] == [(1, "a", True), (1, "b", False), (1, "  ", False), (1, "c", False), (2, "\n", False)]
    assert M.align("a b c", ["a", " ", "b", "c"]) == [("a", 0, True), ("b", 2, False), ("c", 4, False)]
    assert M.resolve_pos([("A", "x"), ("B", "y"), ("C", "z")], {("C", "z"): "Z"}, {("A", "B"): ["P", "Q"]}, {}) == ["P", "Q", "Z"]
    ruled = M.apply_rules([{"surface": "ab", "start": 0}, {"surface": "c", "start": 2}, {"surface": "d", "start": 3}], [{"text": "abc", "tokens": [{"surface": "a"}, {"surface": "bc"}]}])
    assert [(x["surface"], x["start"]) for x in ruled] == [("a", 0), ("bc", 1), ("d", 3)]


def test_lexical_edges(spark):
    flags = {"²": ("is_digit", True), "½": ("is_digit", False), "+": ("is_punct", False), "€$": ("is_currency", True), "Hello": ("is_title", True), "HeLlo": ("is_title", False), "a@b.co###": ("like_email", True), "1,000.5": ("like_num", True), "3/4": ("like_num", True), "twelfth": ("like_num", True), "10.0.0.1": ("is_public_ipv4", False), "8.8.8.8:80/x": ("is_public_ipv4", True), "example.com": ("like_url", True), "x.": ("like_url", False)}
    for text, (name, want) in flags.items():
        assert spark.createDataFrame([(text,)], "t string").select(getattr(lexical, name)(F.col("t")).alias("x")).first().x is want, (text, name)
    shapes = spark.createDataFrame([("Abc12",), ("aaaaaaa",), ("１2",), ("x" * 100,)], "t string").select(lexical.shape(F.col("t")).alias("a"), lexical.encoder_shape(F.col("t")).alias("b")).collect()
    assert [tuple(r) for r in shapes] == [("Xxxdd", "Xxxdd"), ("xxxx", "xxxx"), ("dd", "１d"), ("LONG", "LONG")]
    assert [lexical.default_edits("x" * n) for n in (4, 15, 25)] == [2, 4, 8]
