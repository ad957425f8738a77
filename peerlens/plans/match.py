"""Matching profiles to people end to end: vectors, tags, evidence (section 3.3 of the blueprint)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import concepts, vectors
from ..operators.people import pick_scope


def match_people(
    profiles: DataFrame,
    people_vectors: DataFrame,
    centroids: DataFrame | None = None,
    institutions: Sequence | None = None,
    sizes: DataFrame | None = None,
    k: int = V.MAX_MATCHES,
    cap: int | None = None,
    dim: int | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Rank exactly, over picked institutions or everyone, unless the caller asks for less.

    `approximate` searches the clustered index of `centroids` and may miss matches. `cap` people, the best-ranked
    institutions by `sizes(institution_id, rank, people)`, limit the scope where a caller wants that.
    """
    if approximate and (centroids is None or "cluster" not in people_vectors.columns):
        raise ValueError("an approximate search needs centroids and clustered vectors")
    if cap is not None and sizes is None:
        raise ValueError("a cap needs the sizes of institutions")
    if institutions is not None:
        picked = people_vectors.where(F.col("institution_id").isin(list(institutions)))
        return exact(profiles, picked, k, dim)
    if approximate:
        return vectors.search_ivf(profiles, people_vectors, centroids, k, dim=dim)
    if cap is not None:
        scope = pick_scope(sizes, cap).select("institution_id")
        people_vectors = people_vectors.join(scope, "institution_id", "left_semi")
    return exact(profiles, people_vectors, k, dim)


def exact(profiles: DataFrame, people_vectors: DataFrame, k: int, dim: int | None = None) -> DataFrame:
    """Exact ranking over whichever form the vectors are stored in."""
    for value in ("vector", "q"):
        if value in people_vectors.columns:
            return vectors.rank_cosine(profiles, people_vectors, k, value=value)
    return vectors.rank_bits(profiles, people_vectors, dim, k)


def hybrid_matches(
    profiles: DataFrame,
    matches: DataFrame,
    vocabulary: DataFrame,
    synonyms: DataFrame | None,
    person_tags: DataFrame,
    catalog: DataFrame,
    tag_limit: int | None = 12,
    tag_share: float | None = 0.2,
) -> DataFrame:
    """Matches with the tag overlap blended in, limited to people in the catalog (V11). `tag_limit`, `tag_share`: see `profile_tags`."""
    tags = concepts.profile_tags(profiles, vocabulary, synonyms, limit=tag_limit, share=tag_share)
    listed = matches.join(catalog.select("person_id"), "person_id", "left_semi")
    overlap = concepts.profile_overlap(tags, person_tags, listed)
    return vectors.hybrid_scores(listed, overlap)
