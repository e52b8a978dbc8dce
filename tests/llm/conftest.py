import random

import pytest

WORDS = [a + b + c for a in ("ta", "ro", "mi", "ke", "su", "lan", "dor", "ve") for b in ("ri", "no", "sta", "gel", "mu") for c in ("", "n", "ka", "ris", "to")]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, gone_id string, whole_text string, rank int, `a.b` string, KEY string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def rows():
    base = prose(1, 300)
    near = base.split()
    for k in (20, 120, 250):
        near[k] = "changed"
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, prose(2, 200)), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, prose(3, 30000)), (10, prose(4, 120) + " " + prose(5, 60)),
        (11, prose(6, 90) + "\n" + prose(5, 60) + " " + prose(7, 10)), (None, prose(8, 80)), (12, "x" * 40000), (13, "日本語 のテキスト é ß 😀 " * 5), (14, "same same same " * 40), (4, prose(2, 200)),
    ]
    return [(i, t, None if i == 4 else "aa", None if i == 8 else f"s{(i or 0) % 3}", None if t is None else len(t), "g", "w", 1, "dot", "k") for i, t in texts]


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns whose names clash with those used inside."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)
