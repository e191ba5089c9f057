from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

WORDS = "corn meal stone mill water wheel grain flour sack miller river bread oven loaf crust salt yeast dough rise bake".split()


def prose(seed: int, n: int) -> str:
    """Words in no order that repeats, the same for the same seed."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x >> 16 & 15] + str(x >> 8 & 255))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple[int, str | None]]:
    """Copies, near copies, shared passages, repeats within a text, odd and empty texts, a long one."""
    a, b, c = prose(1, 120), prose(2, 90), prose(3, 60)
    near = a.split()
    near[60] = "changed"
    again = "same line of words that comes back again and again in this one text till it ends here now"
    return [
        (0, a), (1, a), (2, " ".join(near)), (3, None), (4, ""), (5, " \t\n\x0b\x0c\r "), (6, "One"), (7, "one"), (8, "two words"),
        (9, b + " " + c), (10, prose(4, 30) + " " + c + " " + prose(5, 30)), (11, " ".join([again] * 6)), (12, "a a a " * 40), (13, "é" * 120),
        (14, "ÀÉÎ ǅ Σας x y \x00 z\u0085 İ ﬁ 中文字符 🙂 é don't we'll I'M"), (15, "é" * 120 + "tail"), (16, "<|endoftext|> in the text <|startoftext|>x"),
        (17, prose(6, 4000)), (18, prose(7, 20) + " " + prose(6, 4000)[500:3000] + " end"), (19, a.upper()), (20, a + " more"), (21, "x" * 3000), (-4, b), (1 << 40, b + "."),
    ]


@pytest.fixture(scope="session")
def odd(spark: SparkSession, odd_rows: list) -> DataFrame:
    """The rows with further columns, whose names the operators use themselves."""
    rows = [(d, t, "k", 7, True) for d, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, token int, copy boolean").repartition(3)


@pytest.fixture(scope="session")
def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def supplied(spark: SparkSession, sf: str) -> list[tuple[int, str | None]]:
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
