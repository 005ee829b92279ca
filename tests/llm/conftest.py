import random

import pytest

WORDS = "the of and river stone walks under bright hollow maple quiet engine turns seven lantern copper garden winter paper signal".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append(r.choice(WORDS) + (str(r.randrange(40)) if r.random() < 0.7 else ""))
        if i % 12 == 11:
            out.append("\n")
    return " ".join(out).replace(" \n ", "\n")


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, copies, near copies, shared passages, repeated rows and ids."""
    passage = prose(900, 80)
    made = [(i, prose(i, 60 + 7 * i), f"src{i % 3}") for i in range(12)]
    made += [(100 + i, prose(3, 81), "src0") for i in range(4)]  # copies of one text
    made += [(200 + i, prose(5, 95) + f" tail{i}", "src1") for i in range(4)]  # near copies
    made += [(300 + i, prose(40 + i, 30) + "\n" + passage + "\n" + prose(60 + i, 25), "src2") for i in range(4)]
    made += [(400, None, None), (401, "", "src0"), (402, " \t\n ", "src1"), (None, prose(77, 40), "src0"), (None, None, "src1"), (403, "One word", None), (404, "x" * 30_000, "src2")]
    made += [(405, prose(88, 5000), "src1"), (406, prose(88, 5000), "src2")]  # long, equal
    made += [(407, prose(99, 70), "src0")] * 2  # a row twice
    made += [(408, "Äpfel ÜBER straße 東京 éa " * 9, "src1"), (409, "line that is long enough to count\n" * 3 + "short\n\n", "src0"), (410, "  LINE that is long enough to COUNT\t\nother", "src1"), (411, "a line that is long enough\nline that is long enough to count", "src2")]
    return made


CLASHES = ("__hits", "__row", "__quality", "__copies", "__id", "size", "bin", "u", "mark", "print", "spans", "n_words", "quality", "hits", "root", "k1", "sig", "bucket", "shard", "copies", "start", "rank", "sort_id", "packed")


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    from brickyard.session import kept

    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return kept(df.select("*", *[F.lit("kept").alias(c) for c in CLASHES]))  # columns, not literals, to the optimizer


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
