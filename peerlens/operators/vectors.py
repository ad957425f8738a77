"""Vectors: embedding, quantising, exact and clustered ranking, evidence.

Tables: vectors(person_id, institution_id, vector), with `cluster` in an index;
profiles(profile_id, vector); centroids(cluster, vector).

Scoring is a matrix product per Arrow batch against a broadcast block of
profiles. Blocks are cut to a fixed size, one pass over the vectors per block,
and every task keeps `k` rows per profile before the shuffle. Beyond a few
blocks both sides are shuffled into a grid of bounded blocks instead.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..functions.ranking import cut_lineage, top_per_group
from ..functions.text import evidence_words

BLOCK_BYTES = 32 << 20
BLOCK_RESULTS = 4_000_000
MERGE_WIDTH = 32
MAX_ROUNDS = 8
GRID_PROFILES = 2_000
GRID_VECTORS = 50_000
CENTROID_BLOCK_BYTES = 128 << 20
DIGITS = 6


# --- embedding ----------------------------------------------------------------------------------------

def hashed_words(dim: int = 384) -> Callable[[list[str]], np.ndarray]:
    """Offline encoder: signed bag of words on stable hashes, unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                out[row, h % dim] += 1.0 if h & 0x80000000 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def embed_texts(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray] | None = None, out: str = "vector", batch: int = 64) -> DataFrame:
    """Embed a text column in batches with any encoder of lists of texts (V1)."""
    encode = encoder or hashed_words()

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = []
            for start in range(0, len(texts), batch):
                rows.extend(np.asarray(encode(list(texts.iloc[start : start + batch])), dtype=np.float32))
            yield pd.Series(rows)

    return df.withColumn(out, embed(F.coalesce(text, F.lit(""))))


# --- number formats ---------------------------------------------------------------------------------------

def with_unit(df: DataFrame, col: str = "vector", out: str | None = None) -> DataFrame:
    """Unit-length doubles; a zero vector stays zero (V2)."""
    v = F.col(col).cast("array<double>")
    unit = F.aggregate(
        v, F.lit(0.0), lambda s, x: s + x * x, lambda s: F.transform(v, lambda x: x / F.when(s > 0, F.sqrt(s)).otherwise(1.0))
    )
    return df.withColumn(out or col, unit)


def quantize(df: DataFrame, col: str = "vector", out: str = "q") -> DataFrame:
    """127 levels per sign, rounded half to even and clipped (V3)."""
    return df.withColumn(
        out, F.transform(col, lambda x: F.least(F.lit(127.0), F.greatest(F.lit(-127.0), F.rint(x.cast("double") * 127))).cast("tinyint"))
    )


def dequantize(df: DataFrame, col: str = "q", out: str = "vector") -> DataFrame:
    """Quantised rows as unit doubles: each times its own inverse norm (V3)."""
    return with_unit(df, col, out)


@F.pandas_udf(T.BinaryType())
def _pack(rows: pd.Series) -> pd.Series:
    return rows.map(lambda v: None if v is None else np.packbits(np.asarray(v) > 0).tobytes())


def pack_bits(df: DataFrame, col: str = "q", out: str = "bits") -> DataFrame:
    """One bit per dimension, set for values above zero: byte i // 8, mask 0x80 >> (i % 8) (V5)."""
    return df.withColumn(out, _pack(F.col(col)))


def check_vectors_shape(df: DataFrame, dim: int, col: str = "vector", bits: str | None = None, model: str | None = None) -> DataFrame:
    """Rows whose vector is missing, has the wrong length, holds no number or comes from another model."""
    checks = [
        F.when(F.col(col).isNull(), "missing"),
        F.when(F.size(col) != dim, "wrong length"),
        F.when(F.exists(col, lambda x: x.isNull() | F.isnan(x.cast("double"))), "not a number"),
    ]
    if bits:
        checks.append(F.when(F.col(bits).isNull() | (F.octet_length(bits) != (dim + 7) // 8), "wrong byte count"))
    if model:
        checks.append(F.when(F.col("model") != model, "wrong model"))
    return df.withColumn("problem", F.coalesce(*checks)).where(F.col("problem").isNotNull())


# --- ranking ------------------------------------------------------------------------------------------------

def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Vectors as rows of a matrix; null vectors and vectors of different lengths raise (`check_vectors` finds them)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column)
    span = pc.min_max(lengths).as_py()
    if lengths.null_count or span["min"] != span["max"]:
        raise ValueError("vectors are missing or differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _signs(column: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)
    return np.unpackbits(raw, axis=1).astype(np.float32) * 2 - 1


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms > 0, norms, 1.0)


class _Best:
    """The `k` best (score, id) per profile seen so far; ties go to the smaller id."""

    def __init__(self, profiles: int, k: int):
        self.k = k
        self.scores = [np.empty(0)] * profiles
        self.rows = [np.empty(0, dtype=object)] * profiles

    def add(self, profile: int, scores: np.ndarray, ids: np.ndarray, extra: np.ndarray):
        if len(self.scores[profile]) >= self.k:
            keep = scores >= self.scores[profile].min()
            scores, ids, extra = scores[keep], ids[keep], extra[keep]
            if not len(scores):
                return
        if len(scores) > self.k:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= cut
            scores, ids, extra = scores[keep], ids[keep], extra[keep]
        old = self.rows[profile]
        if len(old):
            scores = np.concatenate([self.scores[profile], scores])
            ids, extra = np.concatenate([old[0], ids]), np.concatenate([old[1], extra])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[profile], self.rows[profile] = scores[order], (ids[order], extra[order])


def _block_count(profiles: DataFrame, k: int) -> int:
    size = profiles.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    per_block = max(1, min(BLOCK_BYTES // (8 * max(size["d"] or 1, 1)), BLOCK_RESULTS // max(k, 1)))
    return math.ceil(size["n"] / per_block)


def _blocks(profiles: DataFrame, blocks: int, columns: Sequence[str]) -> Iterator[list]:
    """Profiles in blocks small enough to broadcast; each block is one bounded collect."""
    for i in range(blocks):
        part = profiles.where(F.pmod(F.xxhash64("profile_id"), F.lit(blocks)) == i) if blocks > 1 else profiles
        rows = part.select(*columns).collect()
        if rows:
            yield rows


def _rank(profiles: DataFrame, vectors: DataFrame, k: int, value: str, clip: bool, scale: float, probed: bool = False) -> DataFrame:
    spark = vectors.sparkSession
    bits = vectors.schema[value].dataType.typeName() == "binary"
    id_type, inst_type = (vectors.schema[c].dataType.simpleString() for c in ("person_id", "institution_id"))
    profile_type = profiles.schema["profile_id"].dataType.simpleString()
    schema = f"profile_id {profile_type}, person_id {id_type}, institution_id {inst_type}, score double"
    columns = ["person_id", "institution_id", value] + (["cluster"] if probed else [])
    best_first = [F.col("score").desc(), F.col("person_id").asc()]
    blocks = _block_count(profiles, k)
    if blocks > MAX_ROUNDS:
        grid = _rank_grid(profiles, vectors.select(*columns), k, value, clip, scale, probed, schema)
        return top_per_group(grid, ["profile_id"], best_first, k, "rank")
    out = None
    for rows in _blocks(profiles, blocks, ["profile_id", "vector"] + (["clusters"] if probed else [])):
        matrix = _unit_rows(np.array([r["vector"] for r in rows], dtype=np.float64))
        by_cluster: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            for c in r["clusters"] if probed else ():
                by_cluster.setdefault(c, []).append(i)
        shared = spark.sparkContext.broadcast(([r["profile_id"] for r in rows], matrix, by_cluster))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, queries, lists = shared.value
            best = _Best(len(names), k)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _signs(batch.column(2)) if bits else _matrix(batch.column(2))
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                extra = np.array(batch.column(1).to_pylist(), dtype=object)
                if not bits:
                    x = _unit_rows(x)
                groups = [(slice(None), range(len(names)))]
                if probed:
                    cluster = batch.column(3).to_numpy()
                    groups = [(np.flatnonzero(cluster == c), lists.get(int(c), ())) for c in np.unique(cluster)]
                for rows_, wanted in groups:
                    xs, some, others = x[rows_], ids[rows_], extra[rows_]
                    for start in range(0, len(wanted), 256):
                        part = list(wanted[start : start + 256])
                        scores = queries[part] @ xs.T * scale
                        scores = np.round(np.minimum(scores, 1.0) if clip else scores, DIGITS)
                        for j, p in enumerate(part):
                            best.add(p, scores[j], some, others)
            for p, name in enumerate(names):
                if len(best.scores[p]):
                    ids, extra = best.rows[p]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(ids), type=types[0]), pa.array(ids.tolist(), type=types[1]),
                            pa.array(extra.tolist(), type=types[2]), pa.array(best.scores[p]),
                        ],
                        names=["profile_id", "person_id", "institution_id", "score"],
                    )

        types = [_arrow_type(t) for t in (profile_type, id_type, inst_type)]
        part = vectors
        if probed and len(by_cluster) <= 10_000:
            part = vectors.where(F.col("cluster").isin([int(c) for c in by_cluster]))
        scored = part.select(*columns).where(F.col(value).isNotNull()).mapInArrow(score, schema)
        # Every task sends up to k rows per profile; a first cut per group of tasks keeps the last one small.
        scored = top_per_group(scored.withColumn("_tasks", F.pmod(F.spark_partition_id(), F.lit(MERGE_WIDTH))), ["profile_id", "_tasks"], best_first, k)
        scored = scored.drop("_tasks")
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        return spark.createDataFrame([], schema + ", rank int")
    return top_per_group(out, ["profile_id"], best_first, k, "rank")


def _rank_grid(profiles: DataFrame, vectors: DataFrame, k: int, value: str, clip: bool, scale: float, probed: bool, schema: str) -> DataFrame:
    """Ranking for more profiles than broadcasts can carry: blocks of profiles meet blocks of vectors.

    Both sides are dealt into blocks of bounded size within each cluster (one
    cluster when there are none), so a large cluster is a larger grid, not a
    larger task. Every cell returns `k` rows per profile.
    """
    bits = vectors.schema[value].dataType.typeName() == "binary"
    rows = vectors.where(F.col(value).isNotNull())
    asked = profiles.select("profile_id", F.col("vector").cast("array<double>").alias("vector"), *(["clusters"] if probed else []))
    if probed:
        asked = asked.select("profile_id", "vector", F.explode("clusters").alias("cluster"))
    else:
        rows, asked = rows.withColumn("cluster", F.lit(0)), asked.withColumn("cluster", F.lit(0))
    tall = rows.groupBy("cluster").agg(F.ceil(F.count("*") / GRID_VECTORS).cast("int").alias("_across"))
    wide = asked.groupBy("cluster").agg(F.ceil(F.count("*") / GRID_PROFILES).cast("int").alias("_down"))
    grid = tall.join(wide, "cluster")  # one row per cluster
    left = asked.join(grid, "cluster").select(
        "profile_id", "vector", "cluster", F.pmod(F.xxhash64("profile_id"), F.col("_down")).cast("int").alias("_d"),
        F.explode(F.sequence(F.lit(0), F.col("_across") - 1)).alias("_a"),
    )
    right = rows.join(grid, "cluster").select(
        "person_id", "institution_id", value, "cluster", F.pmod(F.xxhash64("person_id"), F.col("_across")).cast("int").alias("_a"),
        F.explode(F.sequence(F.lit(0), F.col("_down") - 1)).alias("_d"),
    )

    def cell(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        columns = ["profile_id", "person_id", "institution_id", "score"]
        if not len(asked) or not len(rows):
            return pd.DataFrame(columns=columns)
        queries = _unit_rows(np.stack(asked["vector"].to_numpy()).astype(np.float64))
        if bits:
            x = np.unpackbits(np.frombuffer(b"".join(rows[value]), dtype=np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32) * 2 - 1
        else:
            x = _unit_rows(np.stack(rows[value].to_numpy()).astype(np.float64))
        ids, extra = rows["person_id"].to_numpy(), rows["institution_id"].to_numpy(dtype=object)
        best = _Best(len(asked), k)
        for start in range(0, len(asked), 64):
            scores = queries[start : start + 64] @ x.T * scale
            scores = np.round(np.minimum(scores, 1.0) if clip else scores, DIGITS)
            for j, row in enumerate(scores):
                best.add(start + j, row, ids, extra)
        found = []
        for name, scores, kept in zip(asked["profile_id"], best.scores, best.rows):
            found.append(pd.DataFrame({"profile_id": [name] * len(scores), "person_id": kept[0], "institution_id": kept[1], "score": scores}))
        return pd.concat(found, ignore_index=True)[columns]

    keys = ["cluster", "_d", "_a"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, schema)


def _arrow_type(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}[name]


def _with_institution(vectors: DataFrame, allowed: DataFrame | None) -> DataFrame:
    if "institution_id" not in vectors.columns:
        vectors = vectors.withColumn("institution_id", F.lit(None).cast("int"))
    return vectors if allowed is None else vectors.join(allowed.select("person_id"), "person_id", "left_semi")


def rank_cosine(profiles: DataFrame, vectors: DataFrame, k: int = V.MAX_MATCHES, allowed: DataFrame | None = None, value: str = "vector") -> DataFrame:
    """The `k` people closest to every profile by cosine, over floats or int8 rows (V4, K7).

    Scores are rounded to 6 digits and ties go to the smaller id.
    -> profile_id, person_id, institution_id, score, rank
    """
    return _rank(profiles, _with_institution(vectors, allowed), k, value, clip=False, scale=1.0)


def own_ranks(profiles: DataFrame, vectors: DataFrame, identities: DataFrame, value: str = "vector") -> DataFrame:
    """Place of a profile's own person among all of `vectors` by cosine, however far down it is.

    identities(profile_id, person_id); of several own people the best counts, profiles without one in `vectors` are left
    out. Scores and ties are those of `rank_cosine`. One pass over the vectors per block of profiles counts who comes
    before; a task sends one number per profile. Cuts a checkpoint. -> profile_id, self_rank
    """
    spark = vectors.sparkSession
    profile_type, id_type = profiles.schema["profile_id"].dataType, vectors.schema["person_id"].dataType

    @F.pandas_udf("double")
    def closeness(asked: pd.Series, own: pd.Series) -> pd.Series:
        a, b = (_unit_rows(np.stack(x.to_numpy()).astype(np.float64)) for x in (asked, own))
        return pd.Series(np.round((a * b).sum(axis=1), DIGITS))

    rows = vectors.where(F.col(value).isNotNull()).select("person_id", F.col(value).alias("_row"))
    own = profiles.select("profile_id", "vector").join(identities.select("profile_id", F.col("person_id").cast(id_type)), "profile_id")
    own = own.join(rows, "person_id").select("profile_id", "vector", "person_id", closeness("vector", "_row").alias("score"))
    best = cut_lineage(top_per_group(own, ["profile_id"], [F.col("score").desc(), F.col("person_id").asc()], 1))
    out = None
    for block in _blocks(best, _block_count(best, 1), ["profile_id", "vector", "person_id", "score"]):
        matrix = _unit_rows(np.array([r["vector"] for r in block], dtype=np.float64))
        people = np.array([r["person_id"] for r in block])
        shared = spark.sparkContext.broadcast(([r["profile_id"] for r in block], matrix, people, np.array([r["score"] for r in block])))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, queries, people, scores = shared.value
            before = np.zeros(len(names), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, ids = _unit_rows(_matrix(batch.column(1))), batch.column(0).to_numpy(zero_copy_only=False)
                for start in range(0, len(names), 256):
                    mine, score = people[start : start + 256], scores[start : start + 256]
                    found = np.round(queries[start : start + 256] @ x.T, DIGITS)
                    at, who = np.nonzero(found >= score[:, None])
                    ahead = ((found[at, who] > score[at]) | (ids[who] < mine[at])) & (ids[who] != mine[at])
                    before[start : start + 256] += np.bincount(at[ahead], minlength=len(mine))
            yield pa.RecordBatch.from_arrays([pa.array(names, type=name_type), pa.array(before)], names=["profile_id", "n"])

        name_type = _arrow_type(profile_type.simpleString())
        counted = rows.mapInArrow(count, f"profile_id {profile_type.simpleString()}, n long")
        out = counted if out is None else out.unionByName(counted)
    if out is None:
        return best.select("profile_id", F.lit(1).alias("self_rank"))
    ahead = out.groupBy("profile_id").agg((F.sum("n") + 1).cast("int").alias("self_rank"))
    return best.select("profile_id").join(ahead, "profile_id")


def bit_scale(dim: int) -> float:
    """Brings sign products to the scale of the cosine: 1 / (sqrt(dim) * sqrt(2 / pi))."""
    return 1 / (math.sqrt(dim) * math.sqrt(2 / math.pi))


def rank_bits(profiles: DataFrame, vectors: DataFrame, dim: int, k: int = V.MAX_MATCHES, allowed: DataFrame | None = None, value: str = "bits") -> DataFrame:
    """Ranking of 1-bit rows against full-precision profiles, scores clipped at 1 (V6)."""
    return _rank(profiles, _with_institution(vectors, allowed), k, value, clip=True, scale=bit_scale(dim))


# --- clustered index -----------------------------------------------------------------------------------------

def cluster_count(n: int) -> int:
    return max(1, min(n, round(math.sqrt(n))))


def train_centroids(vectors: DataFrame, k: int | None = None, seed: int = 0, sample: int | None = None) -> DataFrame:
    """Unit centroids by cosine k-means on all rows, or on about `sample` of them where the caller says so (V7).

    A sample is taken by a hash of the id, so it does not depend on partitioning.
    """
    n = vectors.count()
    k = k or cluster_count(n)
    rows = with_unit(vectors, "vector").select("person_id", "vector")
    if sample is not None:
        buckets = 1 << 20
        rows = rows.where(F.pmod(F.xxhash64("person_id", F.lit(seed)), F.lit(buckets)) < int(buckets * min(1.0, sample / max(1, n))))
    training = rows.where(F.exists("vector", lambda x: x != 0)).select(array_to_vector("vector").alias("features"))
    model = KMeans(k=k, maxIter=V.KMEANS_ITERATIONS, distanceMeasure="cosine", seed=seed).fit(training)
    centers = _unit_rows(np.array(model.clusterCenters(), dtype=np.float64))
    return vectors.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cluster int, vector array<double>"
    )


def assign_clusters(vectors: DataFrame, centroids: DataFrame, value: str = "vector") -> DataFrame:
    """Nearest centroid by dot product for every row, as `cluster` (V8).

    Centroids are broadcast in blocks of checked size; with several blocks the
    best so far is carried along, still without a shuffle.
    """
    spark = vectors.sparkSession
    size = centroids.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    blocks = max(1, math.ceil(size["n"] * size["d"] * 8 / CENTROID_BLOCK_BYTES))
    out = vectors.withColumn("cluster", F.lit(None).cast("int")).withColumn("_best", F.lit(None).cast("double"))
    for i in range(blocks):
        part = centroids.where(F.pmod("cluster", F.lit(blocks)) == i).orderBy("cluster").collect()
        shared = spark.sparkContext.broadcast(
            (np.array([r["cluster"] for r in part]), np.array([r["vector"] for r in part], dtype=np.float64))
        )

        def assign(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            step = max(1, 4_000_000 // len(names))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _unit_rows(_matrix(batch.column(batch.schema.get_field_index(value))))
                found, best = np.empty(len(x), dtype=np.int64), np.empty(len(x))
                for s in range(0, len(x), step):
                    scores = np.round(x[s : s + step] @ matrix.T, 9)
                    near = scores.argmax(axis=1)
                    found[s : s + step] = names[near]
                    best[s : s + step] = scores[np.arange(len(near)), near]
                ci, bi = batch.schema.get_field_index("cluster"), batch.schema.get_field_index("_best")
                old = pd.to_numeric(batch.column(bi).to_pandas()).to_numpy(dtype=float)
                old_c = batch.column(ci).to_pandas().fillna(2**31 - 1).to_numpy(dtype=np.int64)
                wins = np.isnan(old) | (best > old) | ((best == old) & (found < old_c))
                columns = list(batch.columns)
                columns[ci] = pa.array(np.where(wins, found, old_c).astype(np.int32))
                columns[bi] = pa.array(np.where(wins, best, old))
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        out = out.mapInArrow(assign, out.schema)
    return out.drop("_best")


# --- tree of centroids ------------------------------------------------------------------------------------------

TREE_SAMPLE = 256  # rows that a centroid is fitted on, on average and at most
TREE_LEAST = 64  # rows that a node is fitted on at least, if it has them
TREE_LEAVES = 4  # a cell with more than this times sqrt(k) leaves is split once more
TREE_SCHEMA = "node int, parent int, cluster int, vector array<double>"


def _spherical_means(x: np.ndarray, k: int, seed: int, rounds: int = V.KMEANS_ITERATIONS) -> np.ndarray:
    """`k` unit centroids of unit rows by cosine; first ones drawn far apart, an empty one keeps its place."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    near = x @ x[chosen[0]]
    while len(chosen) < k:
        gap = np.maximum(1 - near, 0) ** 2
        gap[chosen] = 0
        total = gap.sum()
        chosen.append(int(np.searchsorted(np.cumsum(gap), rng.random() * total)) if total > 0 else int(rng.integers(len(x))))
        chosen[-1] = min(chosen[-1], len(x) - 1)
        near = np.maximum(near, x @ x[chosen[-1]])
    centers = x[chosen].copy()
    for _ in range(rounds):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        met = np.linalg.norm(sums, axis=1) > 0
        centers[met] = _unit_rows(sums[met])
    return centers


def _fit_children(rows: DataFrame, wanted: dict[int, int], sizes: dict[int, int], seed: int, per_centroid: int) -> DataFrame:
    """(node, place, vector): for each node its `wanted` centroids, each node in a task of its own on at most about `per_centroid` rows per centroid.

    `rows` (person_id, vector, node). Which rows are learned from is settled by a hash of the id.
    """
    parts = 1 << 30
    ask = [(n, k, int(parts * min(1.0, max(TREE_LEAST, per_centroid * k) / max(1, sizes[n])))) for n, k in wanted.items()]
    asked = F.broadcast(rows.sparkSession.createDataFrame(ask, "node int, wanted int, _share long"))  # one line per node
    sample = rows.join(asked, "node").where(F.pmod(F.xxhash64("person_id", F.lit(seed)), F.lit(parts)) < F.col("_share"))

    def fit(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("person_id")
        x, k, node = np.stack(table["vector"].to_numpy()), int(table["wanted"].iloc[0]), int(table["node"].iloc[0])
        centers = _spherical_means(x, min(k, len(x)), seed + node + 1)
        return pd.DataFrame({"node": node, "place": range(len(centers)), "vector": list(centers)})

    return sample.drop("_share").groupBy("node").applyInPandas(fit, "node int, place int, vector array<double>")


def train_centroid_tree(vectors: DataFrame, k: int | None = None, seed: int = 0, per_centroid: int = TREE_SAMPLE) -> DataFrame:
    """Centroids in levels: about sqrt(k) coarse ones, below each its share of the `k` fine ones (V7).

    Coarse centroids are fitted on a sample, every row is dealt to its nearest, and each cell's fine centroids are fitted in parallel on a
    sample of the cell, in proportion to its rows; a cell with a large share of all rows is split once more. What a task fits is bounded by
    `per_centroid` rows times 4 * sqrt(k) centroids. Rows without direction are left out. Unlike one k-means over
    everything, n * sqrt(k) products are made, not n * k * iterations. Cuts checkpoints.
    -> node, parent (null below the root), cluster (of a leaf, 0 .. k - 1), vector
    """
    spark = vectors.sparkSession
    rows = with_unit(vectors, "vector").select("person_id", "vector").where(F.exists("vector", lambda x: x != 0))
    rows = cut_lineage(rows.withColumn("node", F.lit(-1)))
    sizes = {-1: rows.count()}
    if not sizes[-1]:
        return spark.createDataFrame([], TREE_SCHEMA)
    k = k or cluster_count(sizes[-1])
    wide = max(1, round(math.sqrt(k)))
    shares, levels, nodes, leaves = {-1: k}, [], 0, 0
    while shares:
        last = {n: s for n, s in shares.items() if n >= 0 and s <= TREE_LEAVES * wide}
        wanted = last | {n: min(s, TREE_LEAVES * wide, max(2, round(math.sqrt(s)))) if s > 1 else 1 for n, s in shares.items() if n not in last}
        fitted = cut_lineage(_fit_children(rows, wanted, sizes, seed, per_centroid))
        # Two numbers per centroid settle the names; the vectors stay where they are.
        found = [(r["node"], r["place"]) for r in fitted.select("node", "place").orderBy("node", "place").toLocalIterator()]
        names, inner = [], set()
        for parent, place in found:
            leaf = parent in last or wanted[parent] == 1
            names.append((parent, place, nodes, leaves if leaf else None))
            inner |= set() if leaf else {nodes}
            nodes, leaves = nodes + 1, leaves + leaf
        named = spark.createDataFrame(names, "node int, place int, name int, cluster int")
        level = cut_lineage(fitted.join(named, ["node", "place"]).select(F.col("name").alias("node"), F.col("node").alias("parent"), "cluster", "vector"))
        levels.append(level)
        shares = {}
        if inner:
            below = level.where("cluster is null").select(F.col("parent").alias("_of"), F.col("node").alias("cluster"), "vector")
            rows = cut_lineage(_deal(rows, below))
            sizes = {r["node"]: r["count"] for r in rows.groupBy("node").count().collect()}  # one line per inner node
            total = sum(sizes.values())
            shares = {n: max(1, round((k - leaves) * size / total)) for n, size in sizes.items()}
    tree = levels[0]
    for level in levels[1:]:
        tree = tree.unionByName(level)
    return tree.withColumn("parent", F.when(F.col("parent") >= 0, F.col("parent")))


def _deal(rows: DataFrame, below: DataFrame) -> DataFrame:
    """Rows whose node has children in `below` (_of, cluster, vector), each at its nearest child; rows of other nodes are done."""
    tree = below.select(F.col("cluster").alias("node"), F.when(F.col("_of") >= 0, F.col("_of")).alias("parent"), "cluster", "vector")
    parents = [r[0] for r in below.select("_of").distinct().collect()]
    mine = rows.where(F.col("node").isin(parents))
    return _descend(mine.withColumn("cluster", F.lit(None).cast("int")), tree, 1, "vector", start="node").select("person_id", "vector", F.col("cluster").alias("node"))


class _Tree:
    """Centroids by parent, as single-precision matrices."""

    def __init__(self, rows):
        self.cluster = {r["node"]: r["cluster"] for r in rows}
        children: dict = {}
        for r in sorted(rows, key=lambda r: r["node"]):
            children.setdefault(-1 if r["parent"] is None else r["parent"], []).append(r)
        self.names = {p: np.array([r["node"] for r in c]) for p, c in children.items()}
        self.vectors = {p: np.array([r["vector"] for r in c], np.float32) for p, c in children.items()}

    def nearest(self, x: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, score) of the nearest leaf that `beam` nodes per level lead to; -1 where there is none."""
        rows, nodes = np.arange(len(x)), start
        met = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        while len(rows):
            found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
            for node in np.unique(nodes).tolist():
                if node not in self.names:
                    continue
                here = rows[nodes == node]
                close = np.round(x[here] @ self.vectors[node].astype(np.float64).T, 9)
                keep = np.argsort(-close, axis=1, kind="stable")[:, :beam]
                found.append((np.repeat(here, keep.shape[1]), self.names[node][keep].ravel(), np.take_along_axis(close, keep, 1).ravel()))
            row, node, close = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((node, -close, row))
            row, node, close = row[order], node[order], close[order]
            ahead = np.arange(len(row)) - np.searchsorted(row, row) < beam
            row, node, close = row[ahead], node[ahead], close[ahead]
            leaf = np.array([-1 if self.cluster[n] is None else self.cluster[n] for n in node.tolist()], int)
            met.append((row[leaf >= 0], leaf[leaf >= 0], close[leaf >= 0]))
            rows, nodes = row[leaf < 0], node[leaf < 0]
        row, leaf, close = (np.concatenate(c) for c in zip(*met, strict=True))
        order = np.lexsort((leaf, -close, row))
        row, leaf, close = row[order], leaf[order], close[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        best, score = np.full(len(x), -1), np.full(len(x), -np.inf)
        best[row[first]], score[row[first]] = leaf[first], close[first]
        return best, score


def _descend(vectors: DataFrame, tree: DataFrame, beam: int, value: str, start: str | None = None) -> DataFrame:
    """Fill `cluster` with the nearest leaf; with `start`, a column of nodes, below that node only."""
    rows = tree.collect()  # bounded by the caller
    shared = vectors.sparkSession.sparkContext.broadcast([r.asDict() for r in rows])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Tree(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit_rows(_matrix(batch.column(batch.schema.get_field_index(value))))
            begin = batch.column(batch.schema.get_field_index(start)).to_numpy(zero_copy_only=False).astype(int) if start else np.full(len(x), -1)
            cluster, score = known.nearest(x, begin, beam)
            columns = list(batch.columns)
            columns[batch.schema.get_field_index("cluster")] = pa.array(cluster.astype(np.int32), mask=cluster < 0)
            if "_score" in batch.schema.names:
                columns[batch.schema.get_field_index("_score")] = pa.array(score)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return vectors.mapInArrow(walk, vectors.schema)


def assign_in_tree(vectors: DataFrame, tree: DataFrame, beam: int = 2, value: str = "vector") -> DataFrame:
    """The nearest leaf that `beam` nodes on each level lead to, as `cluster`: about (1 + beam) * sqrt(k) products a row (V8).

    Every row gets one cluster. The tree is broadcast if it is below CENTROID_BLOCK_BYTES in single precision; a larger one
    goes out in blocks of coarse cells, one pass over the rows for each, which the best leaf so far is carried through. No shuffle.
    """
    size = tree.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    if not size["n"]:
        return vectors.withColumn("cluster", F.lit(0))
    blocks = max(1, math.ceil(size["n"] * size["d"] * 4 / CENTROID_BLOCK_BYTES))
    out = vectors.withColumn("cluster", F.lit(None).cast("int"))
    if blocks == 1:
        return _descend(out, tree, beam, value)
    tops = [r[0] for r in tree.where("parent is null").select("node").orderBy("node").collect()]  # about sqrt(k)
    above = tree.select("node", "parent").collect()  # two numbers per centroid
    parent = {r["node"]: r["parent"] for r in above}

    def top(node):
        while parent[node] is not None:
            node = parent[node]
        return node

    block_of = {t: i % blocks for i, t in enumerate(tops)}
    part = vectors.sparkSession.createDataFrame([(n, block_of[top(n)]) for n in parent], "node int, _block int")
    parts = cut_lineage(tree.join(part, "node"))
    out = out.withColumn("_kept", F.lit(None).cast("int")).withColumn("_best", F.lit(None).cast("double")).withColumn("_score", F.lit(None).cast("double"))
    for i in range(blocks):
        # The coarse level is whole in every block, so that a row follows the same cells whichever block they are in.
        out = _descend(out, parts.where((F.col("_block") == i) | F.col("parent").isNull()).drop("_block"), beam, value)
        wins = F.col("cluster").isNotNull() & (F.col("_best").isNull() | (F.col("_score") > F.col("_best")) | ((F.col("_score") == F.col("_best")) & (F.col("cluster") < F.col("_kept"))))
        out = out.withColumns({"_kept": F.when(wins, F.col("cluster")).otherwise(F.col("_kept")), "_best": F.when(wins, F.col("_score")).otherwise(F.col("_best"))})
    return out.withColumn("cluster", F.col("_kept")).drop("_kept", "_best", "_score")


def leaf_centroids(tree: DataFrame) -> DataFrame:
    """centroids(cluster, vector) of a tree."""
    return tree.where("cluster is not null").select("cluster", "vector")


def probe_lists(profiles: DataFrame, centroids: DataFrame, sizes: DataFrame, enough: int, start: int = V.PROBE_START, most: int = V.PROBE_MAX) -> DataFrame:
    """Clusters every profile has to read: the nearest `start`, doubled while they hold too few people (V9).

    sizes(cluster, people) counts allowed people only. -> profile_id, clusters
    """
    near = rank_cosine(profiles, centroids.select(F.col("cluster").alias("person_id"), "vector"), most)
    sized = near.join(sizes.select(F.col("cluster").alias("person_id"), "people"), "person_id", "left")
    widths = [start]
    while widths[-1] < most:
        widths.append(min(widths[-1] * 2, most))
    held = sized.groupBy("profile_id").agg(
        *[F.sum(F.when(F.col("rank") <= w, F.coalesce("people", F.lit(0)))).alias(f"_{w}") for w in widths],
        F.array_sort(F.collect_list(F.struct("rank", F.col("person_id").alias("cluster")))).alias("_near"),
    )
    width = F.lit(widths[-1])
    for w in reversed(widths[:-1]):
        width = F.when(F.col(f"_{w}") >= enough, w).otherwise(width)
    return held.select("profile_id", F.slice(F.col("_near.cluster"), F.lit(1), width).alias("clusters"))


def search_ivf(
    profiles: DataFrame,
    vectors: DataFrame,
    centroids: DataFrame,
    k: int = V.MAX_MATCHES,
    allowed: DataFrame | None = None,
    dim: int | None = None,
    probe_start: int = V.PROBE_START,
    probe_max: int = V.PROBE_MAX,
) -> DataFrame:
    """The `k` closest people from the nearest clusters only (V9).

    `vectors` carries `cluster` and either `vector`, `q` or `bits`; on disk it is
    partitioned by cluster, so only the probed partitions are read. How wide each
    profile searches follows from cluster sizes, without a loop.
    """
    rows = _with_institution(vectors, allowed)
    value = next(c for c in ("vector", "q", "bits") if c in vectors.columns)
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("people"))
    enough = k if allowed is None else min(k, V.ENOUGH_FILTERED)
    lists = probe_lists(profiles, centroids, sizes, enough, probe_start, probe_max)
    with_lists = profiles.select("profile_id", "vector").join(lists, "profile_id")
    bits = value == "bits"
    return _rank(with_lists, rows, k, value, clip=bits, scale=bit_scale(dim) if bits else 1.0, probed=True)


def hybrid_scores(matches: DataFrame, overlap: DataFrame) -> DataFrame:
    """Cosine plus a share of the tag overlap, between 0 and 1."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + V.TAG_BOOST * F.coalesce("overlap", F.lit(0.0))))
    return matches.join(overlap, ["profile_id", "person_id"], "left").withColumn("match_score", F.round(score, DIGITS))


def recall_at(exact: DataFrame, approximate: DataFrame, k: int = 10, within: int = 50) -> DataFrame:
    """Share of the exact top `k` found in the approximate top `within`, per profile."""
    near = approximate.where(F.col("rank") <= within).select("profile_id", "person_id", F.lit(1).alias("_hit"))
    return (
        exact.where(F.col("rank") <= k)
        .join(near, ["profile_id", "person_id"], "left")
        .groupBy("profile_id")
        .agg(F.count("_hit").alias("found"), F.count("*").alias("wanted"))
        .withColumn("recall", F.round(F.col("found") / F.col("wanted"), DIGITS))
    )


# --- evidence ---------------------------------------------------------------------------------------------------

@F.pandas_udf(T.DoubleType())
def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of two vector columns; 0 when one is zero."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = np.stack(a.to_numpy()).astype(np.float64), np.stack(b.to_numpy()).astype(np.float64)
    norms = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    return pd.Series(np.round(np.where(norms > 0, (x * y).sum(axis=1) / np.where(norms > 0, norms, 1), 0.0), DIGITS))


def match_evidence(matches: DataFrame, profiles: DataFrame, pieces: DataFrame, n: int = 3, max_rank: int | None = None) -> DataFrame:
    """The areas and papers of a match closest to the profile, `n` of each kind.

    pieces(person_id, kind, pos, text, vector): a person's areas and papers.
    """
    shown = matches if max_rank is None else matches.where(F.col("rank") <= max_rank)
    joined = shown.select("profile_id", "person_id").join(profiles.select("profile_id", F.col("vector").alias("_p")), "profile_id")
    scored = joined.join(pieces, "person_id").withColumn("closeness", cosine("_p", "vector")).drop("_p", "vector")
    order = [F.col("closeness").desc(), F.col("pos").asc(), F.col("text").asc()]
    return top_per_group(scored, ["profile_id", "person_id", "kind"], order, n, "place")


def shared_interests(interests: DataFrame, matches: DataFrame, pieces: DataFrame) -> DataFrame:
    """Interests whose every significant word occurs in the match's areas or titles.

    interests(profile_id, pos, interest)
    """
    spoken = pieces.select("person_id", F.explode(evidence_words(F.col("text"))).alias("_w")).distinct()
    needed = F.filter(evidence_words(F.col("interest")), lambda w: ~w.isin(V.EVIDENCE_STOP))
    wanted = interests.withColumn("_needed", needed).where(F.size("_needed") > 0)
    words = wanted.select("profile_id", "pos", "interest", F.size("_needed").alias("_n"), F.explode("_needed").alias("_w"))
    pairs = matches.select("profile_id", "person_id").join(words, "profile_id")
    met = pairs.join(spoken, ["person_id", "_w"])
    return (
        met.groupBy("profile_id", "person_id", "pos", "interest", "_n")
        .agg(F.count("*").alias("_met"))
        .where(F.col("_met") == F.col("_n"))
        .select("profile_id", "person_id", "pos", "interest")
    )
