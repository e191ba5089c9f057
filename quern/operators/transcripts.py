"""Word and character error rates over rows ``ref, hyp``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quern.functions.numbers import ratio, rounded
from quern.functions.text import blank_trimmed, blank_words


def sequence_distance(a: list, b: list) -> int:
    """The edit distance of two sequences, a row of the table at a time as the bits of whole numbers (Myers, Hyyro)."""
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    mask, top, out = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = mask, 0  # where a cell is one more, or one less, than the cell above it
    for x in b:
        same = places.get(x, 0)
        flat = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | ~(across | up) & mask, up & across
        out += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & mask, less << 1 & mask
        up, down = (less | ~(flat | more)) & mask, more & flat
    return out


@F.pandas_udf(IntegerType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """The edit distance of two word arrays of any length."""
    return pd.Series([sequence_distance(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def error_rate(pairs: DataFrame, level: str = "wer") -> DataFrame:
    """``rate, errors, total_tokens`` over all pairs; rate 0 without reference tokens. Null texts count as empty."""
    if level not in ("wer", "cer"):
        raise ValueError(f"level is wer or cer, not {level!r}")
    ref, hyp = (blank_trimmed(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("ref", "hyp"))
    if level == "wer":
        each = pairs.select(blank_words(ref).alias("r"), blank_words(hyp).alias("h")).select(word_distance(F.col("r"), F.col("h")).alias("e"), F.size("r").alias("n"))
    else:
        each = pairs.select(F.levenshtein(ref, hyp).alias("e"), F.char_length(ref).alias("n"))
    total = each.agg(F.coalesce(F.sum("e"), F.lit(0)).cast("long").alias("errors"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_tokens"))
    return total.select(rounded(ratio("errors", "total_tokens")).alias("rate"), "errors", "total_tokens")
