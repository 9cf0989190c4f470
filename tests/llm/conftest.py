import random

import pytest

WORDS = "the of and to in that house water river stone light under every great small people never always".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "", ",", ".")) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(3)
    long = prose(rng, 30_000)
    rows = [(1, prose(rng, 90), "en", "a", 5), (2, None, "en", "a", 0), (3, "", "de", "b", 0), (4, long, "en", "b", None),
            (None, prose(rng, 70), None, None, 3), (None, None, None, None, None), (7, "word", "fr", "a", 4),
            (8, "two words", "xx", "c", 9), (8, "two words", "xx", "c", 9), (9, " \n\t ", "en", "c", 4),
            (10, prose(rng, 60) + ' token = "0a1b2c3d4e5f60718293a4b5c6d7e8f9" ok', "en", "a", 1),
            (11, "Licensed under CC BY-NC 4.0.\nmail ann.b@x1.example.com", "en", "a", 2)]
    base = prose(rng, 120)
    rows += [(20 + i, base, "en", "hot", 1) for i in range(6)] + [(30, base + " extra", "en", "hot", 1)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The same with further columns whose names operators use themselves."""
    extra = ("row key n label node chunk spans _spans _found kept size target block from to print boxes row_no words rows "
             "counts classes common units digest rank n_words url").split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in edge_rows], schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def edge_vectors(spark):
    """Vectors with nulls, empties, zeros, odd lengths, huge numbers, repeated and tied rows, and clashing column names."""
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(64)]) for i in range(1, 40)]
    rows += [(50 * i, list(rows[i][1])) for i in range(1, 9)] + [rows[3], rows[3], (100, rows[5][1]), (None, rows[6][1])]
    rows += [(None, None), (150, None), (200, []), (250, [0.0] * 64), (251, [0.5, None]), (252, [float("nan")] * 64), (300, [float("inf")] * 64),
             (350, [1.0, 2.0]), (351, [2.0, 4.0]), (352, [-1.0, -2.0]), (353, [2.0, 4.0]), (400, [0.1] * 63 + [None])]
    rows += [(450, [1e30] + [0.0] * 63), (451, [3e38] * 64), (452, [-3e38, 1e-38] * 32)]
    extra = "row key n label x item dims vector rows rank score no cluster mark numbers second kind row_no deviation".split()
    schema = "vec_id long, embedding array<float>, " + ", ".join(f"`{c}` string" for c in extra)
    frame = spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], schema).repartition(4)
    return frame, [(r["vec_id"], r["embedding"]) for r in frame.select("vec_id", "embedding").collect()]
