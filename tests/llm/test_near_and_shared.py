import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from spanframe.llm import simhash_dedup as S
from spanframe.llm import substring_dedup as B
from spanframe.llm.components import components
from tests.llm.conftest import prose


def brute_groups(rows):
    t = [(i, x) for i, x in rows if i is not None and x is not None and x.strip()]
    f, n = S.fingerprints(pa.array([x for _, x in t]))
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    d = S.distances(f, f)
    for i, j in zip(*np.nonzero((d <= S.RADIUS) & (n > 0)[:, None] & (n > 0)[None, :])):
        a, b = find(t[i][0]), find(t[j][0])
        if a != b:
            parent[max(a, b)] = min(a, b)
    size = defaultdict(int)
    for a in list(parent):
        size[find(a)] += 1
    return {a: find(a) for a in parent if size[find(a)] > 1}


def test_groups_are_those_of_brute_force(spark, nasty):
    got = {r.doc_id: r.group_id for r in S.near_duplicates(nasty).collect()}
    assert got == brute_groups([(r.doc_id, r.text) for r in nasty.collect()])
    assert got[1] == got[2] == got[3] == 1


def test_a_doc_id_with_several_texts(spark):
    a, b, c = prose(1, 100), prose(2, 100), prose(3, 100)
    rows = [(5, a), (5, b), (6, a), (7, b), (8, c)]
    got = {r.doc_id: r.group_id for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {5: 5, 6: 5, 7: 5}


def test_links_count_every_near_document(spark, nasty):
    rows = list({(r.doc_id, r.text) for r in nasty.collect() if r.doc_id is not None and r.text and r.text.split()})
    f, n = S.fingerprints(pa.array([t for _, t in rows]))
    links = (S.distances(f, f) <= S.RADIUS).sum(1) - 1
    assert {r.doc_id: r.links for r in S.near_duplicates(nasty).collect()} == {i: k for (i, _), k in zip(rows, links.tolist()) if k}


def test_rows_that_share_a_doc_id_keep_their_different_texts(spark):
    """Whatever the partitions; a text without words isn't lost either."""
    a, b, c = (prose(k, 80) for k in (1, 2, 3))
    rows = [(4, a, "x"), (4, b, "x"), (4, a, "x"), (4, None, "x"), (4, "", "x"), (5, b, "x"), (6, c, "x"), (6, c + " end", "x"), (7, c, "x"), (None, a, "x")]
    for parts in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id int, text string, finger string").repartition(parts)
        out = sorted(((r.doc_id, r.text) for r in S.drop_near_duplicates(docs).collect()), key=str)
        assert [r for r in out if r[0] != 6] == sorted([(4, a), (4, b), (4, None), (4, ""), (None, a)], key=str)
        assert len([r for r in out if r[0] == 6]) == 1


def test_many_shards_and_blocks_find_all_pairs(spark, monkeypatch):
    r = random.Random(7)
    rows = []
    for g in range(60):
        words = prose(100 + g, r.choice([5, 40, 90, 300, 900])).split()
        for c in range(r.choice([1, 1, 2, 4])):
            w = list(words)
            for k in range(len(w) * c // 90):
                w[r.randrange(len(w))] = "edit"
            rows.append((len(rows), " ".join(w)))
    monkeypatch.setattr(S, "BLOCK", 16)
    f, n = S.fingerprints(pa.array([t for _, t in rows]))
    d = S.distances(f, f)
    first = {}
    same = [first.setdefault(tuple(x), i) for i, x in enumerate(f.tolist())]
    want = {(i, j, round(float(d[i, j]), 6)) for i, j in zip(*np.nonzero(np.triu(d <= S.RADIUS, 1))) if same[i] == i and same[j] == j}
    prints = S.fingerprint_table(spark.createDataFrame(rows, "doc_id bigint, text string")).groupBy(*S.FINGER).agg(S.F.min("doc_id").alias("rep"), S.F.count("*").alias("copies"))
    got = [(r.a, r.b, round(r.distance, 6)) for r in S.close_pairs(prints).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    found = S.close_pairs(prints, forest=True).collect()
    edges, links = {(r.a, r.b) for r in found if r.a != r.b}, defaultdict(int)
    for r in found:
        links[r.a] += r.links
    near = (d <= S.RADIUS).sum(1) - np.array([same.count(i) for i in same])
    assert {k: v for k, v in links.items() if v} == {i: int(k) for i, k in enumerate(near) if k and same[i] == i}
    whole = {(r.id, r.group) for r in components(spark.createDataFrame([(int(a), int(b)) for a, b, _ in want], "a bigint, b bigint")).collect()}
    assert {(r.id, r.group) for r in components(spark.createDataFrame(list(edges), "a bigint, b bigint")).collect()} == whole


def test_near_copies_of_other_lengths_are_found(spark):
    rows = []
    for g, more in enumerate((45, 60, 75, 90)):
        base = prose(500 + g, 300)
        rows += [(2 * g, base), (2 * g + 1, base + " " + prose(600 + g, more))]
    f, n = S.fingerprints(pa.array([t for _, t in rows]))
    ham = np.bitwise_count(f[::2] ^ f[1::2]).sum(1)
    assert (n[1::2] >= 1.15 * n[::2]).all() and (ham <= S.RADIUS).all()
    got = {r.doc_id: r.group_id for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i // 2 * 2 for i in range(8)}


def test_many_copies_are_connected_with_few_edges():
    r = np.random.default_rng(0)
    f = np.repeat(r.integers(0, 1 << 63, (3, S.WORDS)).astype(np.uint64), 40, 0)
    f[:, 2] ^= np.uint64(1) << r.integers(0, 60, 120).astype(np.uint64)
    pairs = {(min(i, j), max(i, j)) for x, y, d in S.near(f, f, 2, same=True) for i, j in zip(x, y)}
    assert pairs == {(i, j) for i in range(120) for j in range(i + 1, 120) if i // 40 == j // 40}
    apart = {(i, j) for x, y, d in S.near(f[:50], f[50:], 2) for i, j in zip(x, y)}
    assert apart == {(i, j) for i in range(50) for j in range(70) if i // 40 == (j + 50) // 40}


def test_near_is_exact_and_compares_few_pairs(monkeypatch):
    """Random rows with copies at every distance about the radius, and rows that crowd in one bucket; blocks apart and one block."""
    r = np.random.default_rng(1)
    f = r.integers(0, 1 << 64, (4000, S.WORDS), dtype=np.uint64)
    f[1:200:2, 0] = f[0, 0]
    for k in range(2000, 2600):
        f[k] = f[k - 600]
        for b in r.choice(S.BITS, 30 + k % 15, replace=False):
            f[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    compared, dense = [], S._dense
    monkeypatch.setattr(S, "CALL", 0)
    monkeypatch.setattr(S, "_dense", lambda a, b, *more, **kw: compared.append(a.shape[1] * b.shape[1]) or dense(a, b, *more, **kw))
    d = S.distances(f, f)
    for same, x, y, want in ((True, f, f, np.triu(d <= S.RADIUS, 1)), (False, f[:2300], f[2300:], d[:2300, 2300:] <= S.RADIUS)):
        shared = [z for k in range(3) for z in S.near(x, y, S.RADIUS, same, k, 3)]
        assert sorted((i, j) for p, q, _ in shared for i, j in zip(p, q)) == sorted((i, j) for p, q, _ in S.near(x, y, S.RADIUS, same) for i, j in zip(p, q))
        compared.clear()
        got = [(min(i, j), max(i, j), k) if same else (i, j, k) for p, q, e in S.near(x, y, S.RADIUS, same=same) for i, j, k in zip(p.tolist(), q.tolist(), e.tolist())]
        far = d if same else d[:2300, 2300:]
        assert sorted(got) == sorted((i, j, int(far[i, j])) for i, j in zip(*(z.tolist() for z in np.nonzero(want)))) and len(got) > 200
        assert sum(compared) < 0.35 * len(x) * len(y)


def test_dropping_keeps_one_of_each_group_and_repeated_rows_once(nasty):
    out = S.drop_near_duplicates(nasty)
    assert out.columns == nasty.columns
    ids = sorted((r.doc_id for r in out.collect()), key=str)
    assert ids == sorted([1, 4, 5, 6, 7, 8, 9, 10, 11, None, 12, 13, 14], key=str)
    assert S.drop_near_duplicates(nasty.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 40) if k % 10 != 9] + [(100, 100), (200, 150), (150, 200)] + [(300, 300 + r.randrange(1, 50)) for _ in range(80)]
    got = {x.id: x.group for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {k: k // 10 * 10 for k in range(40)} | {150: 150, 200: 150} | {b: 300 for a, b in edges if a == 300} | {300: 300}
    assert got == want


def brute_spans(rows, n=50):
    rows = list({(i, t) for i, t in rows if i is not None and t is not None})
    seen = defaultdict(set)
    split = [t.split() for _, t in rows]
    for k, w in enumerate(split):
        for a in range(len(w) - n + 1):
            seen[tuple(w[a:a + n])].add(k)
    out = set()
    for k, w in enumerate(split):
        hit = np.zeros(len(w) + 2, bool)
        for a in range(len(w) - n + 1):
            if len(seen[tuple(w[a:a + n])]) > 1:
                hit[a + 1:a + n + 1] = True
        edge = np.flatnonzero(np.diff(hit.astype(int)))
        out |= {(rows[k][0], int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])}
    return out


def merged(out):
    return {(r.doc_id, r.start_word, r.n_words) for r in out}


def test_shared_passages_are_those_of_brute_force(spark, nasty):
    text = {r.doc_id: r.text for r in nasty.collect()}
    for group in (B.GROUP, 2):
        out = B.shared_passages(nasty, group=group).collect()
        assert merged(out) == brute_spans([(r.doc_id, r.text) for r in nasty.collect()])
        for r in out:
            assert text[r.doc_id][r.start_char:r.end_char].split() == text[r.doc_id].split()[r.start_word:r.start_word + r.n_words]
    assert B.shared_passages(nasty.limit(0)).count() == 0


def check_repeats(out, rows, n=50):
    """Passages with an id in common share n words, and n_docs counts the documents of the most frequent stretch."""
    words = {i: t.split() for i, t in rows if i is not None and t is not None}
    seen = defaultdict(set)
    for i, w in words.items():
        for a in range(len(w) - n + 1):
            seen[tuple(w[a:a + n])].add(i)
    own = [({tuple(words[r.doc_id][a:a + n]) for a in range(r.start_word, r.start_word + r.n_words - n + 1)}, r) for r in out]
    for x, r in own:
        assert r.n_docs == max(len(seen[w]) for w in x) > 1 and r.repeats
        for y, q in own:
            if r.doc_id != q.doc_id:
                assert x & y or not set(r.repeats) & set(q.repeats)


def test_repeats_within_a_document_are_found_if_asked_for(spark):
    p = prose(1, 60)
    rows = [(1, f"{p} {prose(2, 30)} {p}"), (2, prose(3, 200)), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert B.shared_passages(docs).count() == 0
    assert merged(B.shared_passages(docs, within=True).collect()) == {(1, 0, 60), (1, 90, 60)}


def test_random_overlaps(spark):
    r = random.Random(11)
    parts = [prose(k, r.randrange(20, 120)) for k in range(12)]
    rows = [(k, " ".join(r.choice(parts) for _ in range(r.randrange(1, 6)))) for k in range(40)]
    rows += [(100, "la " * 200), (101, "x " + "la " * 120), (102, prose(50, 49)), (103, prose(50, 49)), (104, prose(51, 50)), (105, "é " + prose(51, 50))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for group in (B.GROUP, 3):
        out = B.shared_passages(docs, group=group).collect()
        assert merged(out) == brute_spans(rows)
        check_repeats(out, rows)
