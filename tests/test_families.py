"""Families of bundles, settings of transformers and dictionaries, the gate, and pipelines of some heads."""

import hashlib

import pytest

from spanframe.operators import encoder as N
from spanframe.operators import tokens as T
from spanframe.plans import load as L
from spanframe.plans.pipeline import Pipeline
from spanframe.sources import bundle
from spanframe.sources import families as Y


def code(f, *args):
    with pytest.raises(bundle.BundleError) as e:
        f(*args)
    return e.value.code


def manifest(lang="ja", name="ja-ginza", factories=("ner",), kind="sudachi"):
    return {"source": {"lang": lang, "model_name": name}, "tokenizer": {"kind": kind}, "pipeline": [{"name": f, "factory": f, "settings": {}} for f in factories]}


def test_family_is_told_by_language_name_and_components():
    assert Y.model_family(manifest()) == "standard"
    assert Y.model_family(manifest(name="ja_ginza_electra")) == "electra"
    assert Y.model_family(manifest(factories=("curated_transformer",))) == "electra"
    assert code(Y.model_family, manifest("en")) == "unsupported_language"
    assert code(Y.model_family, manifest(name="ja_core")) == "unsupported_model"
    assert code(Y.check_family, manifest(name="ja_ginza_electra")) == "transformers_required"
    assert code(Y.check_family, manifest(), True) == "transformers_required"
    assert code(Y.check_family, manifest(kind="regex")) == "unsupported_tokenizer"
    Y.check_family(manifest())


def test_exported_labels():
    m = manifest()
    m["pipeline"][0]["settings"] = {"label_mappings": {"ontonotes": {"City": "LOC", "Star": "LOC", "Odd": "OTHERS", "Bad": 3}}}
    assert Y.exported_labels(m) == {"City": "GPE", "Star": "LOC"}
    assert Y.exported_labels(manifest()) == {}


def test_split_modes():
    assert [Y.split_mode(x) for x in (None, "a", "B", "c")] == ["A", "A", "B", "C"]
    assert code(Y.split_mode, "D") == code(Y.split_mode, "") == "invalid_split_mode"


SPEC = {"architecture": "electra", "model": "m", "hidden_width": 8, "window": 4, "stride": 2, "max_wordpieces": 16, "config_path": "c", "weights_path": "w", "vocab_path": "v"}
WORDS = {"kind": "sudachitra_wordpiece", "split_mode": "A", "word_form_type": "dictionary_and_surface", "do_lower_case": False, "do_nfkc": True, "cls_token": "[CLS]", "sep_token": "[SEP]", "unk_token": "[UNK]", "pad_token": "[PAD]"}


def test_transformer_settings(tmp_path):
    good = SPEC | {"tokenizer": WORDS}
    assert code(Y.TransformerSpec.read, tmp_path, good) == "missing_file"
    for x in "cwv":
        (tmp_path / x).write_bytes(b"")
    assert Y.TransformerSpec.read(tmp_path, good | {"more": 1}).stride == 2
    for k, v in {"architecture": "bert", "model": "", "hidden_width": 0, "window": 0, "stride": 5, "max_wordpieces": 1, "tokenizer": WORDS | {"split_mode": "C"}}.items():
        assert code(Y.TransformerSpec.read, tmp_path, good | {k: v}) == "invalid_transformer", k
    for k, v in {"stride": "2", "window": -1, "hidden_width": True, "tokenizer": None}.items():
        assert code(Y.TransformerSpec.read, tmp_path, good | {k: v}) == "invalid_setting", k
    assert code(Y.TransformerSpec.read, tmp_path, good | {"vocab_path": "../v"}) == "unsafe_path"
    m = manifest(factories=("transformer",))
    m["pipeline"][0]["settings"] = good
    assert Y.TransformerSpec.load(tmp_path, m).tokenizer.do_nfkc
    assert code(Y.TransformerSpec.load, tmp_path, manifest()) == "missing_component"
    assert code(Y.TransformerSpec.load, tmp_path, manifest(factories=("transformer", "x_transformer"))) == "invalid_component"


def test_dictionary_settings(tmp_path):
    (tmp_path / "d").write_bytes(b"abc")
    rule = {"text": "ab", "tokens": [{"surface": "a"}, {"surface": "b"}]}
    good = {"format_version": 1, "language": "ja", "max_grouping_len": 24, "compatibility_rules": [rule], "dictionary_path": "d", "dictionary_sha256": hashlib.sha256(b"abc").hexdigest().upper(), "tag_map": {"空白": "SPACE"}}
    assert Y.check_dictionary(tmp_path, good) == tmp_path / "d"
    wrong = {
        "unsupported_format": {"format_version": 2}, "invalid_language": {"language": "en"}, "invalid_max_grouping_len": {"max_grouping_len": 0}, "invalid_compatibility_rule": {"compatibility_rules": [rule | {"text": "abc"}]},
        "unsafe_path": {"dictionary_path": "/d"}, "missing_file": {"dictionary_path": "e"}, "dictionary_checksum": {"dictionary_sha256": "00"}, "missing_pos": {"tag_map": {}},
    }
    for k, v in wrong.items():
        assert code(Y.check_dictionary, tmp_path, good | v) == k
    (tmp_path / "out").symlink_to(tmp_path.parent)
    assert code(Y.inside, tmp_path, "out/x") == "unsafe_path"


def test_gate_and_heads_of_an_english_bundle(spark, tmp_path):
    L.save_model(tmp_path, N.synthetic(), ("tag", "parse", "ner"))
    assert Y.gate(spark, tmp_path)["compatible"] is True
    assert code(Y.gate, spark, tmp_path / "none") == "missing_file"
    assert code(Y.gate, spark, tmp_path, 2) == "unsupported_report"
    b = bundle.load(tmp_path)
    docs = spark.createDataFrame([(1, "One two three. Four"), (2, "")], "doc_id int, text string")
    tagger = Pipeline.english(b, ("tag",), T.flat)
    assert tagger.heads == ("tag",) and "recognize" not in tagger.stages()
    whole = Pipeline.load(b, T.flat)
    tags = lambda p: {(r.doc_id, r.i): r.tag for r in p.process(docs).collect()}
    assert tags(tagger) == tags(whole) == tags(Pipeline.english(b, tokenize=T.flat))
    b.manifest["pipeline"] = [c for c in b.manifest["pipeline"] if c["factory"] != "parser"]
    assert code(Pipeline.english, b, ("tag", "parse", "ner"), T.flat) == "missing_component"
    b.manifest["source"]["lang"] = "ja"
    assert code(Pipeline.english, b) == "unsupported_language"
    assert code(Pipeline.japanese, b, T.flat) == "unsupported_model"
