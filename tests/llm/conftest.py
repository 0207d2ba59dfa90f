"""Tables with what real ones have: nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""

import pytest

WORDS = "the cat of sat and mat to dog in bird a fish with tree that stone for river on hill".split()
LONG = " ".join(WORDS[(i * i + i // 7) % len(WORDS)] + str(i % 97) for i in range(20_000))


def prose(seed: int, n: int = 60) -> str:
    return " ".join(WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)] + ("" if i % 3 else str((seed + i) % 11)) for i in range(n)) + "."


ROWS = [
    (1, prose(1), "en", "src0", 10),
    (2, prose(1), "en", "src0", 10),
    (2, prose(1), "en", "src0", 10),
    (3, prose(3), None, "src1", None),
    (4, None, "en", "src0", 0),
    (5, "", "fr", None, 0),
    (6, LONG, "en", "src0", len(LONG)),
    (None, prose(8), "de", "src2", 5),
    (None, None, None, None, None),
    (7, "Word", "en", "src0", 4),
    (8, " \t\n ", "en", "src0", 4),
    (9, prose(9) + " password = hunter22x Ünïcode 😀 <|endoftext|>", "es", "src3", 9),
    (9, prose(10), "es", "src3", 9),
]
CLASH = "shard int, slot long, score double, fp long, n long, h long, id string, node long, size int, task int, piece int, length int, secrets string, copies int, part int, own boolean, leaf string, epoch int, n_tokens int, label string, links int, `__h` int, `__w` string, `__l` string, `__id` string, `__rows` int, `__row` int, `__score` int, `__bucket` int, `__copies` int, `__hash` int, `__times` int, `__time` int, `__n` int, `__quality` int"


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(messy):
    from pyspark.sql import functions as F

    df = messy
    for column in CLASH.split(", "):
        name, kind = column.split()
        df = df.withColumn(name.strip("`"), F.lit(None).cast(kind))
    return df


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)
