"""Batch evaluation of matching against known people.

runs(profile_id, path, reference, document_chars, vector): one row per person
and way of building the profile. `reference` is the id or document the profile
comes from; without it the run is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.ranking import side_by_side
from .vectors import own_ranks, rank_cosine


def self_rank(matches: DataFrame, identities: DataFrame) -> DataFrame:
    """Best rank at which a person meets their own record among given matches (W9); see `own_ranks` for all people. identities(profile_id, person_id)"""
    return matches.join(identities, ["profile_id", "person_id"], "left_semi").groupBy("profile_id").agg(F.min("rank").alias("self_rank"))


def run_status(runs: DataFrame, matches: DataFrame) -> DataFrame:
    """Skipped, failed or passed for every run, with the reason.

    A run without a reference is skipped, one whose document is too short or
    whose best score is too low failed; one bad run never touches another.
    """
    best = matches.where(F.col("rank") == 1).select("profile_id", F.col("score").alias("top_score"))
    out = runs.join(best, "profile_id", "left")
    short = F.coalesce(F.col("document_chars") < V.MIN_DOCUMENT_CHARS, F.lit(False))
    top = F.coalesce("top_score", F.lit(0.0))
    status = F.when(F.col("reference").isNull(), "skipped").when(short, "failed").when(top >= V.MIN_TOP_SCORE, "passed").otherwise("failed")
    reason = (
        F.when(F.col("reference").isNull(), "no reference")
        .when(short, "too little text")
        .when(top < V.MIN_TOP_SCORE, "best match below threshold")
    )
    scored = F.col("reference").isNotNull() & ~short
    return out.withColumn("status", status).withColumn("reason", reason).withColumn("top_score", F.when(scored, F.col("top_score")))


def evaluate(runs: DataFrame, vectors: DataFrame, identities: DataFrame) -> DataFrame:
    """Rank every attempted run and judge it (E1). -> runs with status, reason, top_score, self_rank

    `self_rank` is the place among all of `vectors`; null only for who is not among them.
    """
    attempted = runs.where(F.col("reference").isNotNull() & F.col("vector").isNotNull())
    asked = attempted.select("profile_id", "vector")
    judged = run_status(runs, rank_cosine(asked, vectors, 1))
    return judged.join(own_ranks(asked, vectors, identities), "profile_id", "left").drop("vector")


def showcase(runs: DataFrame, min_score: float = V.SHOWCASE_MIN_SCORE) -> DataFrame:
    """People with a passing run of a clearly good score and a usable profile (P10).

    runs(ref_id, status, top_score, interests, text)
    """
    usable = (F.coalesce(F.size("interests"), F.lit(0)) > 0) | (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    good = runs.where((F.col("status") == "passed") & (F.col("top_score") >= min_score) & usable)
    return good.select("ref_id").distinct()


def summarize_runs(runs: DataFrame, people: DataFrame | None = None, ratio: float = V.PASS_RATIO) -> DataFrame:
    """Attempted, passed and skipped runs, pass ratio and status of the whole evaluation.

    people(ref_id, person_id) adds how many stayed unresolved.
    """
    c = runs.agg(
        F.count_if(F.col("status").isin("passed", "failed")).alias("runs_attempted"),
        F.count_if(F.col("status") == "passed").alias("runs_passed"),
        F.count_if(F.col("status") == "skipped").alias("runs_skipped"),
    )
    share = F.try_divide("runs_passed", "runs_attempted")
    c = c.withColumn("pass_ratio", F.round(share, 3)).withColumn(
        "status", F.when(F.col("runs_attempted") == 0, "not_run").when(share >= ratio, "passing").otherwise("failing")
    )
    if people is None:
        return c
    unresolved = people.agg(F.count("*").alias("people"), F.count_if(F.col("person_id").isNull()).alias("people_unresolved"))
    return side_by_side(c, unresolved)
