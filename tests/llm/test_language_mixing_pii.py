import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from spanframe.llm import language_id as L
from spanframe.llm import mixing as M
from spanframe.llm import pii as P

TONGUES = {"aa": ("ta", "ri", "no", "ke", "lu"), "bb": ("sch", "ung", "eit", "ver", "ach"), "cc": ("eau", "ou", "ç", "oi", "ment")}


def sentence(lang, r):
    return " ".join("".join(r.choice(TONGUES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(40))


def test_held_out_accuracy(spark):
    r = random.Random(1)
    rows = [(i, sentence(g, r), g) for i, g in enumerate(r.choice("aa bb cc".split()) for _ in range(120))]
    m = L.train(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    held = [(i, sentence(g, r), g) for i, g in enumerate(r.choice("aa bb cc".split()) for _ in range(100))]
    out = spark.createDataFrame(held, "doc_id int, text string, lang string").select("lang", L.identify(spark.createDataFrame(held, "doc_id int, text string, lang string"), m).alias("r")).collect()
    assert np.mean([x.lang == x.r.language for x in out]) > 0.97 and all(x.r.keep for x in out)


def test_scores_are_those_of_the_kernel(spark):
    """The folded weights against the kernel computed pair by pair."""
    r = random.Random(2)
    texts = [sentence(g, r) for g in "aa bb cc aa bb cc".split()]
    m = L.Model(texts, "aa bb cc aa bb cc".split(), landmarks=2)
    lut, flags = m.letters.table(), np.zeros(L.SPACE_OF, bool)
    s, _ = m.score(texts, lut, flags)
    grams = []
    for t in texts:
        L.spectrum(t, lut, flags)
        grams.append(set(np.flatnonzero(flags).tolist()))
    k = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    y = np.where(np.array("aa bb cc aa bb cc".split())[:, None] == np.array(m.languages), 1.0, -1.0)
    # With every text a landmark, the map's inner product is the kernel itself.
    want = k @ np.linalg.solve(k + L.RIDGE * np.eye(6), y)
    assert np.abs(s - want).max() < 1e-2


def test_language_edges(nasty):
    out = {r.doc_id: r for r in L.language_id(nasty).collect()}
    assert not out[5].keep and out[5].language is None and not out[6].keep and not out[7].keep and out[8].keep
    assert L.keep_identified(nasty).columns == nasty.columns
    assert L.language_id(nasty.limit(0)).count() == 0
    once = {(r.text, r.language, r.score) for r in L.language_id(nasty).join(nasty.select("doc_id", "text"), "doc_id").collect()}
    for same in (None, 7):
        # Neither ids nor repeated rows decide what is learnt.
        other = nasty.union(nasty).withColumn("doc_id", L.F.lit(same).cast("bigint"))
        m = L.train(other)
        assert {(r.text, r.r.language, r.r.score) for r in other.select("text", L.identify(other, m).alias("r")).where("text is not null").collect()} >= {x for x in once if x[0]}
    assert not any(r.keep for r in L.language_id(nasty.withColumn("lang", L.F.lit(None).cast("string"))).collect())


def test_all_labelled_texts_are_learnt_from(spark):
    """Letters, weights and least scores are those of all texts, each once, however they are spread over rows and partitions."""
    r = random.Random(5)
    rows = [(i, sentence(g, r), g) for i, g in enumerate(r.choice("aa aa bb cc".split()) for _ in range(500))]
    # What most texts of a language hold, but no landmark need.
    rows += [(1000 + i, "zu " + sentence("bb", r), "bb") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    m = L.train(docs, rows=60)
    again = L.train(docs.union(docs).repartition(5), rows=60)
    assert (m.grams == again.grams).all() and (m.weights == again.weights).all() and all((a == b).all() for a, b in zip(m.curve, again.curve))
    # The same fit by hand: kernel values of all texts with the landmarks, one ridge regression.
    seen = Counter(c for _, t, _ in rows for c in t.lower() if c.isalpha())
    assert m.letters.letters == [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:L.SYMBOLS - 3]]
    got = docs.select("lang", L.F.col("text"), L.F.xxhash64("text", L.F.lit(29)).alias("h")).collect()
    some = sorted((x for x in got if x.h % (1 << 30) / (1 << 30) < 1.3 * 60 / sum(y.lang == x.lang for y in got)), key=lambda x: (x.lang, x.h % (1 << 30), x.text))
    grams, shown, size = L._marks(some, m.letters, False)
    lut, flags, k = m.letters.table(), np.zeros(L.SPACE_OF, bool), []
    for x in got:
        L.spectrum(x.text, lut, flags)
        k.append(shown @ flags[grams] / np.sqrt(size * flags.sum()))
    marks = shown / np.sqrt(size)[:, None]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    white = vectors[:, values > 1e-8 * values.max()] / np.sqrt(values[values > 1e-8 * values.max()])
    phi, labels = np.array(k) @ white, np.array([x.lang for x in got])
    y = np.where(labels[:, None] == np.array(m.languages), 1.0, -1.0)
    weight = np.array([len(got) / 3 / (labels == g).sum() for g in labels])[:, None]
    w = np.linalg.solve(phi.T @ (phi * weight) + L.RIDGE * np.eye(phi.shape[1]), phi.T @ (y * weight))
    s, _ = m.score([x.text for x in got], lut, flags)
    assert np.abs(s - phi @ w).max() < 0.05 and (m.curve[1] > 0).all() and len(m.curve[0]) > 3


UNSEEN = {
    "ru": "Все люди рождаются свободными и равными в своём достоинстве и правах, 10 декабря 1948 года. ", "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. ",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا. ", "zh": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。人人生而自由。 ",
}


@pytest.mark.parametrize("seed", range(4))
def test_unseen_scripts_go_and_clean_documents_stay(spark, seed):
    r = random.Random(seed)
    # Of three languages of unlike sizes and lengths, one with a few letters outside the alphabet.
    rows = [(i, sentence(g, r)[:r.randrange(60, 300)] + " 12, 1999. " * r.randrange(3) + ("\u0416" if i == 0 else ""), g) for i, g in enumerate(r.choice("aa aa aa bb cc".split()) for _ in range(150))]
    kind = "doc_id int, text string, lang string"
    m = L.train(spark.createDataFrame(rows, kind))
    assert (m.curve[1][-3:] > 0).all()
    texts = [(k, t * n, None) for k, t in enumerate(UNSEEN.values()) for n in (1, 9)]
    lut, flags = m.letters.table(), np.zeros(L.SPACE_OF, bool)
    s, letters = m.score([t for _, t, _ in texts], lut, flags)
    assert ((s.max(1) < m.least(letters)) | ~s.any(1)).all()
    texts += [(90 + k, t.split()[0], None) for k, t in enumerate(UNSEEN.values())]
    foreign = spark.createDataFrame(texts, kind)
    assert not any(x.r.keep for x in foreign.select(L.identify(foreign, m).alias("r")).collect())
    clean = spark.createDataFrame([(k, sentence(g, r), g) for k, g in enumerate("aa bb cc".split() * 20)], kind)
    assert all(x.r.keep and x.r.language == x.lang for x in clean.select("lang", L.identify(clean, m).alias("r")).collect())


def waterfill(sizes, weights, budget, most):
    """The definition, round by round."""
    capped, target = set(), {}
    while True:
        left = budget - sum(most * sizes[s] for s in capped)
        free = sum(w for s, w in weights.items() if s not in capped and sizes[s])
        target = {s: most * sizes[s] if s in capped else left * w / free for s, w in weights.items() if sizes[s]}
        over = {s for s, t in target.items() if s not in capped and t > most * sizes[s]}
        if not over:
            return {s: t / sizes[s] for s, t in target.items()}
        capped |= over
        if len(capped) == sum(1 for s in sizes if sizes[s]):
            return {s: most for s in capped}


@pytest.mark.parametrize("seed", range(6))
def test_epochs_are_those_of_water_filling(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{k}": r.choice([1, 5, 20, 300, 1000]) for k in range(7)}
    weights = {s: r.choice([0.5, 1, 2, 5]) for s in sizes}
    budget = r.choice([100, 1000, 5000, 100000])
    docs = spark.createDataFrame([(i, "x" * n, s) for i, (s, n) in enumerate(sizes.items())], "doc_id int, text string, source string")
    got = {x.source: x.epochs for x in M.source_epochs(docs, weights, budget, 3.0).collect()}
    want = waterfill(sizes, weights, budget, 3.0)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_sampling_is_seeded_whole_and_fractional(spark):
    docs = spark.createDataFrame([(i, "x" * 10, "a" if i < 900 else "b") for i in range(1000)], "doc_id int, text string, source string")
    out = M.mix_sources(docs, {"a": 1, "b": 1}, copy="copy")
    n = {s: k for s, k in out.groupBy("source").count().collect()}
    assert n["b"] == 400 and abs(n["a"] - 600) < 60
    assert sorted(out.collect()) == sorted(M.mix_sources(docs.repartition(7), {"a": 1, "b": 1}, copy="copy").collect())
    assert sorted(out.collect()) != sorted(M.mix_sources(docs, {"a": 1, "b": 1}, seed=1, copy="copy").collect())


def test_mixing_edges_and_sql(nasty):
    assert M.mix_sources(nasty).columns == nasty.columns
    assert M.mix_sources(nasty.limit(0)).count() == 0
    con = duckdb.connect()
    documents = nasty.select("doc_id", "source", "text").toArrow()  # noqa: F841
    want = sorted(con.sql(M.SQL).fetchall(), key=str)
    assert sorted([tuple(r) for r in M.mix_sources(nasty, copy="copy").select("doc_id", "source", "copy").collect()], key=str) == want


def personal(n):
    r = random.Random(9)
    rows, truth = [], set()
    for i in range(n):
        kind = r.choice(["EMAIL", "IP", "CARD", "PHONE", "decoy", "none"])
        digits = [r.randrange(10) for _ in range(14)]
        body = "4" + "".join(map(str, digits))
        good = next(str(c) for c in range(10) if P._luhn(body + str(c)))
        v = {"EMAIL": f"joe.{i}@mail{i % 9}.example.com", "IP": f"{r.randrange(11, 120)}.{r.randrange(256)}.3.{r.randrange(256)}", "CARD": body + good, "PHONE": f"+1 (202) 555-{r.randrange(1000, 9999)}", "decoy": "9" + "".join(map(str, digits)) + str((int(good) + 3) % 10), "none": "nothing"}[kind]
        if kind == "decoy" and P._luhn(v):
            v = v[:-1] + str((int(v[-1]) + 1) % 10)
        text = f"tarin keris {v} dorsta é. mugel"
        rows.append((i, text))
        if kind not in ("decoy", "none"):
            a = text.index(v)
            truth.add((i, kind, a, a + len(v)))
    return rows, truth


def test_pii_finds_what_is_planted_and_no_decoys(spark):
    rows, truth = personal(600)
    got = {(r.doc_id, r.kind, r.start_char, r.end_char) for r in P.detect(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(got & truth) >= 0.99 * len(truth) and len(got - truth) <= 0.01 * len(truth)


def test_registered_query_finds_what_brute_force_finds(spark):
    """Span by span in plain Python: every proposed span counts once in EM, and every pair of accepted spans is compared."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    spans = [(d.doc_id, t) for d in docs if d.text for t in P.propose(d.text)]
    text = {d.doc_id: d.text for d in docs}
    code = [(P.KINDS.index(kind), int("".join(map(str, v)), 3) + form * 3 ** len(v)) for _, (kind, _, _, v, form) in spans]
    feats = [P.text_features(text[d], kind, a, b) for d, (kind, a, b, _, _) in spans]
    keys = sorted(set(code))
    odds, own = P.fit(np.array([k for k, _ in keys]), np.array([q for _, q in keys]), np.array([code.count(k) for k in keys]), [(*c, f, 1) for c, f in zip(code, feats)])
    seen = [(d, kind, a, b, 1 / (1 + np.exp(-np.clip(odds[keys.index(c)] + own[f].sum(), -30, 30)))) for (d, (kind, a, b, _, _)), c, f in zip(spans, code, feats)]
    seen = [x for x in seen if x[4] >= P.THRESHOLD]
    rank = lambda x: (x[4], x[3] - x[2], -x[2], -P.KINDS.index(x[1]))
    want = {x[:4] for x in seen if not any(y[0] == x[0] and y[2] < x[3] and y[3] > x[2] and rank(y) > rank(x) for y in seen)}
    got = {(r.doc_id, r.kind, r.start_char, r.end_char) for r in P.op1_pii(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and got


def test_titled_and_unlisted_names_are_proposed():
    text = "Contact Mr Anders Holm or Priya Raman or John Smith. Then Mary Ann O'Neil left; Frau Möller-Voss too."
    assert [text[a:b] for kind, a, b, _, _ in P.propose(text) if kind == "NAME"] == ["Mr Anders Holm", "Priya Raman", "John Smith", "Mary Ann O'Neil", "Frau Möller-Voss"]


def test_em_recovers_reliabilities():
    r = np.random.default_rng(0)
    y = r.random(20000) < 0.4
    good = [0.95, 0.9, 0.8, 0.7, 0.85, 0.6]
    v = np.stack([np.where(r.random(len(y)) < g, np.where(y, 2, 1), np.where(y, 1, 2)) for g in good], 1)
    code, n = np.unique(v, axis=0, return_counts=True)
    p, theta, share = P.reliabilities(np.zeros(len(code), int), code, n.astype(float))
    assert np.abs(theta[0, 1, :, 2] - good).max() < 0.06 and abs(share[0] - 0.4) < 0.05


def test_pii_edges(nasty, spark):
    assert P.detect(nasty).count() == 0
    assert P.detect(nasty.limit(0)).count() == 0
    x = spark.createDataFrame([(None, "mail a.b@c.example.com x"), (1, "mail a.b@c.example.com x"), (1, "mail a.b@c.example.com x")] * 2, "doc_id int, text string")
    assert P.detect(x).count() == 6


@pytest.mark.parametrize("phone", ["06 12 34 56 78", "+33 6 12 34 56 78", "01.23.45.67.89", "912 34 56 78", "(984)555-5227", "9845555227", "+1 (984) 555-5227", "030/1234567"])
def test_phones_of_any_grouping_are_proposed(phone):
    text = f"please call {phone} today"
    assert (12, 12 + len(phone)) in [(a, b) for kind, a, b, _, _ in P.propose(text) if kind == "PHONE"]


@pytest.mark.parametrize("text,name", [("my name is Xavier Dupont, hello", "Xavier Dupont"), ("signed Oluwaseun Adeyemi", "Oluwaseun Adeyemi"), ("we met Mary Miller", "Mary Miller")])
def test_names_are_proposed_by_context_too(text, name):
    assert name in [text[a:b] for kind, a, b, _, _ in P.propose(text) if kind == "NAME"]
    assert [x[3][2:4] for x in P.propose("they saw Xavier Dupont there") if x[0] == "NAME"] == [(1, 0)]
