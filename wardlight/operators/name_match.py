"""Substring matching of many needles against many names by their rarest trigram.

A name that contains a needle contains every trigram of it, also the one that the fewest names have.
So each needle asks for that trigram alone, and only the names that have it are compared. Needles of
one or two characters ask for themselves. The rows that are exchanged follow the matches; no name emits
all its substrings and no needle meets all names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct substrings of the given sizes."""
    def of(n: int) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda p: text.substr(p, F.lit(n)))) \
            .otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def containing(needles: DataFrame, names: DataFrame) -> DataFrame:
    """Every (scope, needle, name, …) with ``name`` containing ``needle``, both as they are.

    ``needles`` has (scope, needle), ``names`` has (scope, name) and any columns to carry. Matches stay
    within a scope. Null or empty needles match nothing; repeated needles are one.
    """
    wanted = needles.select("scope", "needle").where("needle is not null and needle <> ''").distinct()
    parts = wanted.select("scope", "needle", F.explode(
        F.when(F.length("needle") < GRAM, F.array("needle")).otherwise(_grams(F.col("needle"), (GRAM,)))).alias("gram"))
    asked = parts.select(F.col("scope").alias("s"), F.col("gram").alias("g")).distinct()
    grams = (names.withColumn("gram", F.explode(_grams(F.col("name"), tuple(range(1, GRAM + 1)))))
             .join(asked, (F.col("scope") == F.col("s")) & (F.col("gram") == F.col("g")), "left_semi"))
    counts = grams.groupBy(F.col("scope").alias("s"), F.col("gram").alias("g")).agg(F.count("*").alias("n"))
    # a gram that no name has leaves its needle without a match
    rare = (parts.join(counts, (F.col("scope") == F.col("s")) & (F.col("gram") == F.col("g")), "left")
            .groupBy(F.col("scope").alias("s"), "needle")
            .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("g"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
            .where("n > 0").drop("n"))
    # needles grow with the input, grams hardly: only the latter may be broadcast
    return (grams.join(rare.hint("merge"), (F.col("scope") == F.col("s")) & (F.col("gram") == F.col("g")))
            .where(F.contains("name", "needle")).drop("s", "g", "gram"))
