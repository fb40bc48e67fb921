"""Feature rows from key strings: a user hook, token fingerprints and view vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def featurize(
    df: DataFrame, row_id: str, text: str, fn: Callable[[str], list[float]], names: list[str]
) -> DataFrame:
    """A user function from string to feature values; a failure gives a row of NULLs."""
    id_type = dict(df.dtypes)[row_id]
    schema = f"{row_id} {id_type}, " + ", ".join(f"{n} double" for n in names)
    width = len(names)

    def one(value):
        try:
            return [float(x) for x in fn(value)]
        except Exception:
            return [None] * width

    def run(batches):
        for pdf in batches:
            out = pd.DataFrame([one(t) for t in pdf[text]], columns=names, dtype="float64")
            out.insert(0, row_id, pdf[row_id].to_numpy())
            yield out

    return df.select(row_id, text).mapInPandas(run, schema)


def hashed_fingerprint(
    df: DataFrame, tokens: str, radius: int = 2, bits: int = 2048, name: str = "fingerprint"
) -> DataFrame:
    """Set bits, sorted, of a fixed-length fingerprint of all token runs up to radius + 1 tokens.

    A run's bit is the first eight digits of its md5 modulo ``bits``, so that any engine can
    make it again. A row without tokens has no bits; a null list gives null.
    """
    t = F.col(tokens)

    def runs_of(n: int) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))

    def bit(run: Column) -> Column:
        return (F.conv(F.substring(F.md5(run), 1, 8), 16, 10).cast("long") % bits).cast("int")

    made = F.array_sort(F.array_distinct(F.transform(F.concat(*[runs_of(n) for n in range(1, radius + 2)]), bit)))
    return df.withColumn(name, F.when(t.isNotNull(), made))


def set_bits(fingerprint: str = "fingerprint") -> Column:
    return F.size(fingerprint)


def fingerprint_vector(fingerprint: str = "fingerprint", bits: int = 2048) -> Column:
    """The fingerprint as a vector of 0 and 1 for a model."""

    @F.pandas_udf("array<double>")
    def dense(batch: pd.Series) -> pd.Series:
        out = np.zeros((len(batch), bits))
        for i, ones in enumerate(batch):
            out[i, np.asarray(ones, dtype=int)] = 1.0
        return pd.Series(list(out))

    return array_to_vector(dense(F.coalesce(F.col(fingerprint), F.array().cast("array<int>"))))


def view_vectors(df: DataFrame, first: list[str], second: list[str]) -> DataFrame:
    out = VectorAssembler(inputCols=first, outputCol="view_1", handleInvalid="keep").transform(df)
    return VectorAssembler(inputCols=second, outputCol="view_2", handleInvalid="keep").transform(
        out
    )


def row_rule(df: DataFrame, rule: Column | Callable, name: str, inputs: list[str]) -> DataFrame:
    """A rule per row: a column expression, or an opaque vectorised function of the inputs."""
    if isinstance(rule, Column):
        return df.withColumn(name, rule)
    udf = F.pandas_udf(rule, "boolean")
    return df.withColumn(name, udf(*[F.col(c) for c in inputs]))
