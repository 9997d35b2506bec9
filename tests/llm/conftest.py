import random

import pytest

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, kept string, _row string, _text string"


def texts(seed=7):
    """Small texts with copies, near copies, shared passages, repeated words and odd characters."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Ünï", "é", "漢字", "Don't", "x-y", "A", "it."]
    some = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, other = some(60), some(35)
    base = some(120)
    out = [base, base, base.replace("w3 ", "w4 ", 1), some(30) + "\n" + passage + " " + some(20), some(10) + " " + passage, passage]
    out += [f"{other}\n{other}", "", None, " \t\n ", "one", "la " * 300, "ab" * 400, "ab" * 390, other + "\x0b" + some(3) + "\x1c" + other]
    out += [some(rng.randint(1, 80)) for _ in range(12)]
    out += [some(4000), "x" * 3000 + " " + base, base]
    return out


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, repeated rows, empty and long texts, extra columns with clashing names."""
    rows = [(i * 3 % 97, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else "src0", len(t or ""), "n", "k", "r", "t") for i, t in enumerate(texts())]
    rows += [rows[3], (None, texts()[0], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DDL)
