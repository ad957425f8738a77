"""The stored keyword index of a build: words with their places, sorted by word, kept up by deltas.

`keyword_index` has rows (token, person_id, pos, institution_id, generation). A full build writes it whole, in ranges of
words, so that a search for beginnings of words reads only the files and row groups that hold them. An update adds the
rows of the institutions that it touches and notes in `keyword_retired` (institution_id, generation) that earlier rows of
these institutions no longer count. After `MOST_DELTAS` updates the index is written whole again, from the rows that count.
Both tables belong to the build's version: they change together with the records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.concepts import token_index
from . import versions
from .versions import Draft

INDEX, RETIRED = "keyword_index", "keyword_retired"
MOST_DELTAS = 16
# A beginning of a word reads whole row groups; small ones keep that little.
ROW_GROUP = {"parquet.block.size": str(16 << 20)}


def put_keyword_index(draft: Draft, records: DataFrame, changed: Sequence | None = None) -> None:
    """Index the words of `records`(person_id, institution_id, name, title, recent_publications or publication_titles).

    Without `changed` the index is written whole. With it, only the records of these institutions are indexed and their earlier rows
    retire; a build that has no index yet gets a whole one.
    """
    generation = draft.base.version + 1
    whole = changed is None or INDEX not in draft.tables
    if not whole and len(draft.tables[INDEX]) > MOST_DELTAS:
        others = _live(draft.read(INDEX), draft.read(RETIRED)).where(~_of(changed))
        _put_whole(draft, others.unionByName(_rows(records.where(_of(changed)), generation)))
    elif whole:
        _put_whole(draft, _rows(records, generation))
    elif changed:
        kind = records.schema["institution_id"].dataType
        retired = draft.spark.createDataFrame([(x, generation) for x in changed], _retired_schema(kind))
        draft.add(INDEX, _by_word(_rows(records.where(_of(changed)), generation)), f"g{generation}", ROW_GROUP)
        draft.add(RETIRED, retired.coalesce(1), f"g{generation}")


def read_keyword_index(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The index as `keyword_search` takes it: token, person_id, pos. A condition on `token` reaches the files."""
    manifest = versions.current(spark, root, version)
    rows = versions.read_table(spark, root, INDEX, manifest=manifest)
    if manifest.tables[RETIRED]:
        rows = _live(rows, versions.read_table(spark, root, RETIRED, manifest=manifest))
    return rows.select("token", "person_id", "pos")


def _rows(records: DataFrame, generation: int) -> DataFrame:
    if "publication_titles" not in records.columns and "recent_publications" in records.columns:
        records = records.withColumn("publication_titles", F.col("recent_publications.title"))
    return token_index(records, "institution_id").withColumn("generation", F.lit(generation))


def _live(rows: DataFrame, retired: DataFrame) -> DataFrame:
    """Rows that no later update has replaced. `retired` has a line per institution and update, at most MOST_DELTAS updates."""
    since = retired.groupBy("institution_id").agg(F.max("generation").alias("_since"))
    return rows.join(since, "institution_id", "left").where(F.coalesce("_since", F.lit(0)) <= F.col("generation")).drop("_since")


def _of(institutions: Sequence):
    return F.coalesce(F.col("institution_id").isin(list(institutions)), F.lit(False))


def _by_word(rows: DataFrame) -> DataFrame:
    # People are part of the range, so that a word of very many people is several tasks and files.
    return rows.repartitionByRange("token", "person_id", "pos").sortWithinPartitions("token", "person_id", "pos")


def _retired_schema(institution: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("institution_id", institution), T.StructField("generation", T.IntegerType())])


def _put_whole(draft: Draft, rows: DataFrame) -> None:
    columns = ["token", "person_id", "pos", "institution_id", "generation"]
    draft.put(INDEX, _by_word(rows.select(*columns)), options=ROW_GROUP)
    draft.clear(RETIRED, _retired_schema(rows.schema["institution_id"].dataType))
