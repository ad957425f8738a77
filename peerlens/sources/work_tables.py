"""Works, authorships and work institutions stored side by side, so that an update neither scans nor shuffles all of time.

Under `root`/by_work_<buckets> lie three Parquet tables, each in folders by `month` of the work and in buckets by work_id.
A date window opens the folders of its months only, and the tables join on work_id bucket by bucket without an exchange.
Authorships and work institutions carry the month of their work for that. Works without a date are in the month `none`,
which no window opens.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import _names

WORKS, AUTHORSHIPS, INSTITUTIONS = "works", "authorships", "work_institutions"
BUCKETS = 512


def write_work_tables(works: DataFrame, authorships: DataFrame, work_institutions: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Write the three tables anew. works(work_id, date, ...), the others (work_id, ...); rows of unknown works are left out.

    A bucket of a month is one file. `buckets` should make those of the busiest month 100 MB or so. The three are written one after
    the other; a job that dies between is to be run again.
    """
    if _buckets(works.sparkSession, root) not in (None, buckets):
        raise ValueError(f"{root} has tables with another number of buckets")
    _write(works, authorships, work_institutions, root, buckets, "overwrite")


def add_works(works: DataFrame, authorships: DataFrame, work_institutions: DataFrame, root: str) -> None:
    """Append the works that are not stored yet, with their rows. A stored work that changes needs the tables written anew."""
    spark = works.sparkSession
    buckets = _buckets(spark, root)
    if buckets is None:
        raise ValueError(f"no work tables under {root}")
    new = works.join(_open(spark, root, WORKS).select("work_id"), "work_id", "left_anti")
    # Works go last: until they are there, a second attempt appends the rows of a failed one again, so those are left out too.
    who = authorships.join(_open(spark, root, AUTHORSHIPS).select("work_id"), "work_id", "left_anti")
    where = work_institutions.join(_open(spark, root, INSTITUTIONS).select("work_id"), "work_id", "left_anti")
    _write(new, who, where, root, buckets, "append")


def open_window(spark: SparkSession, root: str, window: tuple[dt.date, dt.date]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Works, authorships and work institutions of the window's months; the works of its days only."""
    since, until = window
    # A literal range of folder names: other months are not listed, let alone read.
    inside = F.col("month").between(since.strftime("%Y-%m"), until.strftime("%Y-%m"))
    works, who, where = (_open(spark, root, name).where(inside).drop("month") for name in (WORKS, AUTHORSHIPS, INSTITUTIONS))
    return works.where(F.col("date").between(since, until)), who, where


def _month(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit("none"))


def _write(works: DataFrame, authorships: DataFrame, work_institutions: DataFrame, root: str, buckets: int, mode: str) -> None:
    months = works.select("work_id", _month(F.col("date")).alias("month"))
    tables = {
        AUTHORSHIPS: authorships.join(months, "work_id"),
        INSTITUTIONS: work_institutions.join(months, "work_id"),
        WORKS: works.withColumn("month", _month(F.col("date"))),
    }
    spark = works.sparkSession
    for name, rows in tables.items():
        if mode == "append":  # one order of columns in all files
            _open(spark, root, name)
        (
            rows.repartition(buckets, "work_id").write.mode(mode).format("parquet").partitionBy("month").bucketBy(buckets, "work_id").sortBy("work_id")
            .option("path", _path(root, buckets, name)).saveAsTable(_registered(root, name))
        )


def _path(root: str, buckets: int, name: str) -> str:
    return f"{root}/by_work_{buckets}/{name}"


def _registered(root: str, name: str) -> str:
    """The session catalog's name of a table; the files are the truth, and a session that does not know them registers them again."""
    return f"peerlens_{hashlib.md5(root.encode()).hexdigest()}_{name}"


def _buckets(spark: SparkSession, root: str) -> int | None:
    found = [n for n in _names(spark, root) if n.startswith("by_work_")]
    return int(found[0][len("by_work_") :]) if found else None


def _open(spark: SparkSession, root: str, name: str) -> DataFrame:
    buckets, table = _buckets(spark, root), _registered(root, name)
    if buckets is None:
        raise ValueError(f"no work tables under {root}")
    path = _path(root, buckets, name)
    if not spark.catalog.tableExists(table):
        # Months are names: read back as such, not as dates.
        schema = spark.read.option("basePath", path).parquet(path).drop("month").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(
            f"CREATE TABLE {table} ({columns}, month STRING) USING parquet PARTITIONED BY (month)"
            f" CLUSTERED BY (work_id) SORTED BY (work_id) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    return spark.table(table)
