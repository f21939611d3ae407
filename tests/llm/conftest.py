import random

import pytest

from twinsieve.session import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, n string, _rid long, label string, key double"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_documents():
    """Ordinary texts, near and exact copies, and everything odd: nulls, blanks, one word, one very long text, repeated rows."""
    rng = random.Random(11)
    base = [sentence(rng, 120) for _ in range(12)]
    rows = list(enumerate(base))
    for k in range(6):
        w = base[0].split(" ")
        w[10 + 7 * k] = "changed"
        rows.append((20 + k, " ".join(w)))
    rows += [(30, base[1]), (31, base[1].replace(" ", "\n  ", 3)), (32, base[2].upper())]
    passage = sentence(rng, 60)
    rows += [(40 + k, sentence(rng, 30) + " " + passage + " " + sentence(rng, 30)) for k in range(4)]
    rows += [(50, None), (51, ""), (52, " \t\n"), (53, "one"), (54, "one two three"), (55, "one two three"), (56, "ab" * 400), (57, "é" * 130 + " ünï 字 " + "é" * 130)]
    rows += [(60, " ".join(sentence(rng, 1) for _ in range(40_000))), (61, "a  b   c  double  spaces"), (62, "a  b   c  double  spaces")]
    rows += [(30, base[1]), (None, base[3]), (None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return odd_documents()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    ship(spark)
    path = str(tmp_path_factory.mktemp("documents")) + "/documents.parquet"
    full = [(d, t, ("en", "de", None)[k % 3], ("hot", "hot", "a", None)[k % 4], len(t or ""), k, "x", k, "l", 0.5) for k, (d, t) in enumerate(rows)]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("doc_id = -1")
