"""Scalar functions as Column expressions, and small relational checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Digits of base 62, and the clip of logits.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CLIP = 80


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-CLIP)), F.lit(CLIP))))


def softmax_foreground(background: Column, foreground: Column) -> Column:
    """Foreground probability of two logits."""
    return sigmoid(foreground - background)


def failed_gates(*gates: tuple[str, Column]) -> Column:
    """Names of the gates that do not hold; an unknown one does not."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates]))


def ratio_at_least(positive: Column, total: Column, numerator: int, denominator: int) -> Column:
    """positive / total >= numerator / denominator in whole numbers."""
    return positive * denominator >= total * numerator


def bounded_name(name: Column, limit: int) -> Column:
    """A name of ``limit`` characters at most: longer ones end in a digest."""
    return F.when(F.length(name) <= limit, name).otherwise(F.concat(F.substring(name, 1, limit - 9), F.lit("-"), F.substring(F.sha2(name, 256), 1, 8)))


def _base62(digest: pd.Series) -> pd.Series:
    def spell(text: str) -> str:
        number, out = int(text, 16), ""
        while number:
            number, digit = divmod(number, 62)
            out = DIGITS[digit] + out
        return out.rjust(43, "0")

    return digest.map(spell, na_action="ignore")


def base62_tag(digest: Column, length: int) -> Column:
    """Last ``length`` digits of a digest in base 62; the number has 256 bits, hence the UDF."""
    return F.right(pandas_udf(_base62, "string")(digest), F.lit(length))


def angle_name(angle: Column) -> Column:
    """``a12p5`` for 12.5: the shortest text of the angle, p for the point."""
    text = F.regexp_replace(F.format_string("%.6f", angle.cast("double")), "\\.?0+$", "")
    return F.concat(F.lit("a"), F.replace(F.replace(text, F.lit("."), F.lit("p")), F.lit("-"), F.lit("m")))


def inventory_differences(expected: DataFrame, observed: DataFrame, key: str, content: str) -> DataFrame:
    """(key, status) of what is missing, extra or changed."""
    both = expected.select(key, F.col(content).alias("e"), F.lit(1).alias("in_e")).join(
        observed.select(key, F.col(content).alias("o"), F.lit(1).alias("in_o")), key, "full_outer"
    )
    status = F.when(F.col("in_o").isNull(), "missing").when(F.col("in_e").isNull(), "extra").otherwise("changed")
    return both.where(~F.col("e").eqNullSafe(F.col("o"))).select(key, status.alias("status"))
