import random

import pyarrow as pa
import pytest
import tiktoken

from spanframe.llm import bpe
from spanframe.llm.bpe import PATTERN, Vocabulary, default_vocabulary, pretoken_starts, pretokens
from spanframe.llm.bpe_codec import _Block, encode_decode
from spanframe.llm.common import text_bytes
from spanframe.llm.token_counts import count_texts, token_counts


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(default_vocabulary())


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(vocabulary.tokens)}, special_tokens={})


def texts():
    r = random.Random(5)
    return ["", "a", "hello world", "  two  spaces\n\n", "it's we'll", "a" * 3000, "ab" * 1000, "日本語のテキスト😀", "½²³ ١٢٣ x\x1cy\x85z", " nbsp em", *("".join(r.choice("abcdethe ,.!'\n0129éßñ日") for _ in range(r.randint(1, 200))) for _ in range(200))]


def test_encode_is_the_reference_encoding(vocabulary, reference):
    for t in texts():
        assert "".join(pretokens(t)) == t
        ids, _ = vocabulary.encode_words(pretokens(t))
        assert ids.tolist() == reference.encode_ordinary(t)


def starts(texts):
    out, at = [], 0
    for t in texts:
        for w in pretokens(t):
            out.append(at)
            at += len(w.encode())
    return out


def test_starts_are_those_of_the_pretokens():
    r = random.Random(7)
    letters = ["abst're lvm'd \n\t!é0", "' srevlmtd", "ab 1.\n é×÷ɏɐ'", "日本 a's　½\x1c\x85", "ab  \t\r\n'", "aé_'9 s\x7f\x0b\xa0"]
    some = [["".join(r.choice(r.choice(letters) if r.random() < 0.1 else own) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 6))] for own in letters for _ in range(500)]
    for t in [*some, texts(), ["'r", "e", "x'", "s", " ", " a"], [chr(c) + "a" + chr(c) for c in range(0x2100)], [""], []]:
        assert pretoken_starts(*text_bytes(pa.array(t, pa.string()))).tolist() == starts(t)


def test_plain_words_are_numbered_without_being_objects(monkeypatch):
    # One object a pre-token was most of what the codec took.
    monkeypatch.setattr(bpe, "pretokens", None)
    t = ["it's  a déjà vu\n", None, "", "it's all"] * 300
    b = _Block()
    b.add(pa.record_batch({"k": range(len(t))}), pa.array(t))
    out = list(b.pieces(0, 0, 5))
    assert b.bytes == sum(len(x.encode()) for x in t if x) and out[0][2] == -1
    assert sorted(k for _, _, k, _ in out[1:]) == sorted({k for _, _, k, _ in out[1:]})


def test_counts(vocabulary, reference):
    n, p = count_texts(pa.array([*texts(), None]), vocabulary, {})
    assert n.tolist() == [len(reference.encode_ordinary(t)) for t in texts()] + [0]


def test_counts_of_a_table(nasty, reference):
    out = token_counts(nasty).collect()
    assert len(out) == nasty.count()
    want = {(r.doc_id, None if r.text is None else len(reference.encode_ordinary(r.text))) for r in nasty.collect()}
    assert {(r.doc_id, r.n_tokens) for r in out} == want
    assert token_counts(nasty.limit(0)).count() == 0


@pytest.mark.parametrize("buckets", [1, 7, None])
def test_codec_round_trip(nasty, reference, buckets):
    out = encode_decode(nasty, keep=("doc_id", "n_chars", "whole_text"), buckets=buckets).collect()
    want = sorted(((r.doc_id or -1, r.text) for r in nasty.collect()), key=str)
    assert sorted(((r.doc_id or -1, r.decoded) for r in out), key=str) == want
    for r in out:
        assert (r.token_ids is None) == (r.decoded is None) == (r.n_tokens is None)
        if r.decoded is not None:
            assert list(r.token_ids) == reference.encode_ordinary(r.decoded)


def test_codec_of_nothing(nasty):
    assert encode_decode(nasty.limit(0)).columns == ["doc_id", "n_tokens", "token_ids", "decoded"]
    assert encode_decode(nasty.limit(0)).count() == 0


def test_codec_keeps_columns_named_like_results(spark):
    x = spark.createDataFrame([(1, "a b", "kept")], "doc_id int, text string, decoded string")
    r = encode_decode(x, keep=("doc_id", "decoded")).first()
    assert r.decoded_ == "kept" and r.decoded == "a b"
