import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from spanframe.llm import bpe, common, registry
from spanframe.llm import language_id as L
from spanframe.llm import mixing as M
from spanframe.llm import secret_scan as S
from spanframe.llm import simhash_dedup as H
from tests.llm.conftest import prose

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def brute(docs, reference):
    """The stages' definitions, row by row: one score a text, all pairs of fingerprints, the plan of sources in SQL, a public encoder."""
    m, rows = L.train(docs), [tuple(r[c] for c in COLUMNS) for r in docs.collect()]
    if m is None:
        return []
    lut, flags, kept = m.letters.table(), np.zeros(L.SPACE_OF, bool), []
    for r in rows:
        s, letters = m.score([r[1] or ""], lut, flags)
        if letters[0] and s.max() >= m.least(letters)[0] and s.any():
            kept.append(r)
    f, n = H.fingerprints(pa.array([r[1] for r in kept], pa.string()))
    part = [k for k, r in enumerate(kept) if r[0] is not None and n[k]]
    group = {k: k for k in part}
    for i in part:
        for j in part:
            if i < j and np.bitwise_count(f[i] ^ f[j]).sum() <= H.RADIUS and group[i] != group[j]:
                a, b = group[i], group[j]
                group = {k: a if g == b else g for k, g in group.items()}
    best = {}
    for k in part:
        key = (kept[k][0], tuple(f[k].view(np.int64).tolist()), k)
        best[group[k]] = min(best.get(group[k], key), key)
    kept = [r for k, r in enumerate(kept) if k not in group or best[group[k]][2] == k]
    clean = [(r[0], S.redacted(r[1]), *r[2:]) for r in kept]
    clean = [(*x[:4], len(x[1]) if x[1] != r[1] else x[4]) for x, r in zip(clean, kept)]
    con = duckdb.connect()
    documents = pa.table({c: pa.array([r[k] for r in clean], pa.int64() if k in (0, 4) else pa.string()) for k, c in enumerate(COLUMNS)})  # noqa: F841
    sampled = con.sql(M.SQL.replace("SELECT doc_id, d.source,", "SELECT d.rn AS doc_id, d.source,").replace("FROM documents", "FROM (SELECT *, row_number() OVER () - 1 AS rn FROM documents)").replace("coalesce(doc_id::VARCHAR", "coalesce(d.doc_id::VARCHAR")).fetchall()
    out = [clean[k] for k, _, _ in sampled]
    return [(r[0], r[2], r[3], r[4], len(ids := reference.encode_ordinary(r[1])), ids, r[1]) for r in out]


@pytest.fixture(scope="module")
def reference():
    tokens = bpe.Vocabulary(bpe.default_vocabulary()).tokens
    return tiktoken.Encoding("brute", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def run_on(spark, docs, at):
    docs.write.mode("overwrite").parquet(f"{at}/documents.parquet")
    return sorted((tuple(r[c] for c in ("doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids", "decoded")) for r in corpus_pipeline.run(spark, str(at)).collect()), key=str)


def test_run_is_what_brute_force_gives(spark, nasty, tmp_path, reference):
    key = "ghp_aB3dE5gH7jK9mN1pQ3rS5tU7vW9xY1zA3bC5dE"
    more = spark.createDataFrame([(100 + k, f"{prose(70 + k, 90)} {key} end", "aa", f"s{k % 2}", 5, "g", "w", 1, "d", "k") for k in range(4)] + [(100, prose(90, 90), "aa", None, 5, "g", "w", 1, "d", "k")] * 2, nasty.schema)
    for name, docs in (("nasty", nasty.unionByName(more)), ("empty", nasty.limit(0)), ("unlabelled", nasty.withColumn("lang", L.F.lit(None).cast("string")))):
        got = run_on(spark, docs, tmp_path / name)
        assert got == sorted(brute(docs, reference), key=str)
        assert (len(got) > 8 and not any(key in r[6] for r in got)) == (name == "nasty")


def test_a_shared_folder_is_asked_for_on_a_cluster():
    class Session:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda k, d: d)}), type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_columns(spark, nasty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (nasty, nasty.limit(0)):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.collect()


def test_run(spark, tmp_path):
    text = prose(1, 150)
    rows = [(i, f"{prose(i, 80)} token = \"9f86d081884c7d659a2feaa0c55ad015\" end", "aa", "s1", 1) for i in range(6)] + [(10, text, "aa", "s2", 1), (11, text, "aa", "s2", 1), (12, "12 34", "aa", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert 11 not in ids and 12 not in ids and 10 in ids
    for r in out:
        assert "9f86d081" not in r.decoded and r.n_chars == (len(r.decoded) if r.doc_id < 10 else 1)
        assert len(r.token_ids) == r.n_tokens
