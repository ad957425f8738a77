"""The synthetic tables seen as people, works, topics and institutions.

Suppliers are people, orders are works, a line item makes its supplier an author
of the order, parts are topics, nations are institutions, regions countries.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import spread
from ..operators import works as W

AS_OF = dt.date(2001, 8, 1)


class Tables:
    """The scholarly tables derived from one directory of parquet files. Every property is a lazy plan."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def texts(self, name: str) -> DataFrame:
        """A table whose rows cost much work each, over all cores."""
        return spread(self.raw(name))

    @property
    def institutions(self) -> DataFrame:
        host = F.concat(F.lit("www."), F.lower(F.regexp_replace("n_name", "_", "")), F.lit(".ac.uk"))
        return (
            self.raw("nation")
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("n_nationkey").alias("institution_id"),
                F.col("n_name").alias("institution_name"),
                F.col("r_name").alias("country_code"),
                (F.col("n_nationkey") + 1).alias("rank"),
                F.concat(F.lit("https://"), host, F.lit("/home")).alias("homepage_url"),
                F.when(F.col("n_nationkey") < 5, F.array(F.col("n_nationkey") + 20)).alias("extra_ids"),
            )
        )

    @property
    def authorship_lines(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .select("l_orderkey", "l_suppkey", "l_linenumber")
            .repartition("l_orderkey")  # the one exchange for the lines, their ends and the works
            .groupBy(F.col("l_orderkey").alias("work_id"), F.col("l_suppkey").alias("person_id"))
            .agg(F.min("l_linenumber").alias("place"))
        )

    @property
    def authorships(self) -> DataFrame:
        return W.author_positions(self.authorship_lines)

    @property
    def works(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("work_id"),
            F.concat_ws(" ", F.lit("Study"), F.col("o_orderkey"), F.lit("of"), F.col("o_orderpriority")).alias("title"),
            F.year("o_orderdate").alias("year"),
            F.to_date("o_orderdate").alias("date"),
        )

    @property
    def publications(self) -> DataFrame:
        return self.authorships.join(self.works, "work_id")

    @property
    def recent(self) -> DataFrame:
        return W.recent_works(self.publications, AS_OF)

    @property
    def metrics(self) -> DataFrame:
        """Works and citations per person, in one pass over the lines."""
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_suppkey").alias("person_id"))
            .agg(
                F.sum("l_quantity").cast("long").alias("citation_count"),
                F.count_distinct("l_orderkey").alias("works_count"),
            )
        )

    @property
    def authors(self) -> DataFrame:
        s = self.raw("supplier").select(
            F.col("s_suppkey").alias("person_id"),
            F.col("s_name").alias("name"),
            F.col("s_nationkey").alias("institution_id"),
            F.greatest(F.lit(0), F.floor(F.col("s_acctbal") / 200)).cast("int").alias("h_index"),
        )
        return s.join(self.metrics, "person_id", "left").fillna(0, ["citation_count", "works_count"])

    @property
    def year_counts(self) -> DataFrame:
        return (
            self.authorship_lines.join(self.works.select("work_id", "year"), "work_id")
            .groupBy("person_id", "year")
            .agg(F.count("*").alias("works"))
        )

    @property
    def author_topics(self) -> DataFrame:
        parts = self.raw("part").select("p_partkey", "p_name", "p_type", "p_brand")
        return (
            self.raw("lineitem")
            .select("l_suppkey", "l_partkey")
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(
                F.col("l_suppkey").alias("person_id"),
                F.col("p_name").alias("topic"),
                F.col("p_type").alias("subfield"),
                F.col("p_brand").alias("field"),
            )
            .agg(F.count("*").alias("n"))
        )

    @property
    def work_keywords(self) -> DataFrame:
        return self.keywords_of()

    def keywords_of(self, works: DataFrame | None = None) -> DataFrame:
        """Keywords of a work: the brand of each line's part, scored by quantity. Only those of `works`(work_id) when given."""
        parts = self.raw("part").select("p_partkey", F.concat(F.lit("K "), "p_brand").alias("keyword"))
        lines = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        if works is not None:  # before the lines meet the parts
            lines = lines.join(works.select(F.col("work_id").alias("l_orderkey")).distinct(), "l_orderkey", "left_semi")
        return (
            lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("l_orderkey").alias("work_id"), "keyword")
            .agg((F.max("l_quantity") / 50).alias("score"))
        )

    @property
    def work_funders(self) -> DataFrame:
        customers = self.raw("customer").select("c_custkey", "c_mktsegment")
        return (
            self.raw("orders")
            .select("o_orderkey", "o_custkey")
            .join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("o_orderkey").alias("work_id"), F.lit(0).alias("pos"), F.col("c_mktsegment").alias("funder"))
        )

    @property
    def topics(self) -> DataFrame:
        """Topic list: subfield and keywords (the brands sold under the name)."""
        return (
            self.raw("part")
            .groupBy(F.col("p_name").alias("topic"))
            .agg(
                F.min("p_type").alias("subfield"),
                F.array_sort(F.collect_set(F.lower("p_type"))).alias("keywords"),
            )
        )

    @property
    def contacts(self) -> DataFrame:
        """Contact details derived from the supplier row."""
        k = F.col("s_suppkey")
        host = F.concat(F.lit("nation"), F.col("s_nationkey"), F.lit(".ac.uk"))
        title = (
            F.when(k % 7 == 0, "Associate Professor of Widgets")
            .when(k % 7 == 1, "PhD Student")
            .when(k % 7 == 2, "Postdoctoral Fellow")
            .when(k % 7 == 3, "Emeritus Professor")
            .when(k % 7 == 4, "Research Scientist")
            .when(k % 7 == 5, "Lecturer")
        )
        return self.raw("supplier").select(
            k.alias("person_id"),
            title.alias("title"),
            F.when(k % 3 == 0, F.concat(F.lit("s"), k, F.lit("@"), host)).alias("email"),
            F.when(k % 5 != 4, F.concat(F.lit("https://"), host, F.lit("/p/"), k)).alias("profile_url"),
            F.when(k % 5 < 2, "directory").when(k % 5 == 2, "orcid").when(k % 5 == 3, "openalex").alias("profile_source"),
        )
