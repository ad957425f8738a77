"""Dictionary encoding of repeated values and link prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.ranking import with_row_number


def _is_list(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() == "array"


def dictionary_encode(df: DataFrame, cols: Sequence[str], key: str = "person_id") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Replace values of text and list columns by ids from 0 in value order.

    -> encoded rows and one (id, value) table per column. Cuts one checkpoint per column.
    """
    dictionaries, out = {}, df
    for c in cols:
        values = df.select((F.explode(c) if _is_list(df, c) else F.col(c)).alias("value")).where("value IS NOT NULL").distinct()
        numbered = with_row_number(values, [F.col("value").asc()], "_n").select((F.col("_n") - 1).alias("id"), "value")
        dictionaries[c] = numbered
        out = _replace(out, c, numbered.select(F.col("value").alias("_from"), F.col("id").alias("_to")), key)
    return out, dictionaries


def dictionary_decode(df: DataFrame, dictionaries: dict[str, DataFrame], key: str = "person_id") -> DataFrame:
    """Ids back to values; the round trip loses nothing."""
    for c, table in dictionaries.items():
        df = _replace(df, c, table.select(F.col("id").alias("_from"), F.col("value").alias("_to")), key)
    return df


def _replace(df: DataFrame, c: str, table: DataFrame, key: str) -> DataFrame:
    if not _is_list(df, c):
        return df.join(table, df[c] == table["_from"], "left").withColumn(c, F.col("_to")).drop("_from", "_to").select(*df.columns)
    places = df.select(key, F.posexplode(c).alias("_i", "_v"))
    lists = (
        places.join(table, F.col("_v") == F.col("_from"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("_i", "_to"))).alias("_l"))
        .select(key, F.col("_l._to").alias("_list"))
    )
    to = table.schema["_to"].dataType.simpleString()
    empty = F.when(F.col(c).isNotNull(), F.array().cast(f"array<{to}>"))
    return df.join(lists, key, "left").withColumn(c, F.coalesce("_list", empty)).drop("_list").select(*df.columns)


def encode_url(c: Column) -> Column:
    """Known link prefixes as `<n>|rest`."""
    out = c
    for n, prefix in enumerate(V.URL_PREFIXES):
        out = F.when(c.startswith(prefix), F.concat(F.lit(f"{n}|"), c.substr(F.lit(len(prefix) + 1), F.length(c)))).otherwise(out)
    return out


def decode_url(c: Column) -> Column:
    out = c
    for n, prefix in enumerate(V.URL_PREFIXES):
        out = F.when(c.startswith(f"{n}|"), F.concat(F.lit(prefix), c.substr(F.lit(len(str(n)) + 2), F.length(c)))).otherwise(out)
    return out
