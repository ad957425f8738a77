"""SimHash near-duplicates: a binary trie of fingerprints joined with itself.

Two nodes of the trie are visited together with the number of bits in which
their prefixes differ; their four pairs of children follow, and a pair is
dropped as soon as the differing bits exceed the budget. Of two fingerprints
that differ in `k` bits or fewer one half differs in `k // 2` or fewer, so the
trie is built twice, once with each half on top, and the budget is `k // 2`
for the upper half and `k` for the whole. That keeps the visited pairs near
n * depth instead of n * depth**k.

On the cluster the top of the trie is a join of the nodes of one depth, where a
node meets those at `k // 2` bits or fewer. Heavy node pairs are opened a few
levels more, again by joins, until each pair is small or is a pair of single
fingerprints; each remaining pair of subtrees is one group, traversed with
numpy. A group returns a spanning forest of its links, never all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import cut_lineage
from .common import fresh, join_null_safe
from .components import components

K = 3
SHINGLE = 3
LEAF = 4096  # fingerprints of a node that one task takes whole
STRIDE = 4
FRONTIER = 1 << 20  # node pairs that a task opens at a time


def text_fingerprint(text: str | None) -> int:
    """64 bits as an unsigned int; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) < SHINGLE:
        begins, stops = [0], [len(joined)]
    else:
        begins = [0, *(ends[: len(words) - SHINGLE] + 1).tolist()]
        stops = ends[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(begins, stops, strict=True)), np.uint64, len(begins))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint_column(text: Column) -> Column:
    """Fingerprint of a text as a signed long; a null or wordless text gives 0."""

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([text_fingerprint(t) for t in texts], np.uint64).astype(np.int64))

    return F.pandas_udf(of, "long")(text)


def _split(sorted_values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """Where in each range of equal upper bits the given bit turns to 1."""
    upper = sorted_values[low] >> np.uint64(bit + 1) if bit < 63 else np.zeros(len(low), np.uint64)
    border = ((upper << np.uint64(1)) | np.uint64(1)) << np.uint64(bit)
    return np.clip(np.searchsorted(sorted_values, border), low, high)


def subtree_links(left: np.ndarray, right: np.ndarray | None, k: int = K):
    """Pairs of positions (in `left`, in `right` or `left`) at `k` bits or fewer: two subtrees traversed together.

    Values are sorted, distinct uint64. With `right` None the subtree meets itself and each pair comes once.
    Yields arrays of at most about FRONTIER pairs, so that memory is bounded; deeper pairs go before wider ones.
    """
    same, other = right is None, left if right is None else right
    if not len(left) or not len(other):
        return
    one = np.array([0])
    stack = [(63, one, np.array([len(left)]), one, np.array([len(other)]), np.array([0]))]
    while stack:
        bit, alo, ahi, blo, bhi, off = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(bit, *(x[half:] for x in (alo, ahi, blo, bhi, off))), (bit, *(x[:half] for x in (alo, ahi, blo, bhi, off)))]
            continue
        single = ((ahi - alo == 1) & (bhi - blo == 1)) if bit >= 0 else np.ones(len(alo), bool)
        if single.any():
            a, b = alo[single], blo[single]
            near = np.bitwise_count(left[a] ^ other[b]) <= k
            if same:
                near &= a < b
            if near.any():
                yield a[near], b[near]
        go = ~single
        if bit < 0 or not go.any():
            continue
        alo, ahi, blo, bhi, off = alo[go], ahi[go], blo[go], bhi[go], off[go]
        amid, bmid = _split(left, alo, ahi, bit), _split(other, blo, bhi, bit)
        budget = k // 2 if bit >= 32 else k
        children = []
        for al, ah, bl, bh, more in ((alo, amid, blo, bmid, 0), (amid, ahi, bmid, bhi, 0), (alo, amid, bmid, bhi, 1), (amid, ahi, blo, bmid, 1)):
            fit = (ah > al) & (bh > bl) & (off + more <= budget)
            if same:
                fit &= al <= bl  # each pair of nodes once
            children.append([x[fit] for x in (al, ah, bl, bh, off + more)])
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*children, strict=True))))


def _forest(n: int, links) -> np.ndarray:
    """Smallest position that each of n positions is linked with, from batches of links."""
    root = np.arange(n)
    for a, b in links:
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                break
            np.minimum.at(root, np.maximum(ra[open_], rb[open_]), np.minimum(ra[open_], rb[open_]))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _group_links(table: pa.Table) -> pa.Table:
    """One node pair: fingerprints of side 0 and, unless the node meets itself, of side 1; gives a spanning forest."""
    side = table["side"].to_numpy()
    value = table["fp"].to_numpy().view(np.uint64)
    left, right = np.unique(value[side == 0]), np.unique(value[side == 1])
    same = table["p"][0] == table["q"][0]
    if same:
        values, links = left, subtree_links(left, None)
    else:
        values = np.concatenate([left, right])
        links = ((a, b + len(left)) for a, b in subtree_links(left, right))
    root = _forest(len(values), links)
    linked = np.flatnonzero(root != np.arange(len(values)))
    return pa.table({"a": values[linked].view(np.int64), "b": values[root[linked]].view(np.int64)})


def _prefix(value: Column, depth: int) -> Column:
    return F.shiftrightunsigned(value, 64 - depth) if depth else F.lit(0).cast("long")


def _nodes(values: DataFrame, depth: int) -> DataFrame:
    return values.groupBy(_prefix(F.col("fp"), depth).alias("p")).agg(F.count("*").alias("n"))


def fingerprint_links(values: DataFrame, k: int = K, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) that connect what links of `k` bits or fewer connect. `values`: distinct fingerprints `fp` (long)."""
    values = cut_lineage(values.select("fp"))
    total = values.count()
    start = min(20, max(0, STRIDE * math.ceil(math.log2(max(1, total) / leaf) / STRIDE)))
    edges = None
    for turned in (False, True):
        turn = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32)) if turned else F.col("fp")
        found = _trie_links(values.select(turn.alias("fp")), k, leaf, start)
        back = [F.shiftleft(c, 32).bitwiseOR(F.shiftrightunsigned(c, 32)).alias(c) if turned else F.col(c) for c in ("a", "b")]
        found = found.select(*back)
        edges = found if edges is None else edges.union(found)
    return edges


def _budget(depth: int, k: int) -> int:
    return k // 2 if depth <= 32 else k


def _frontier(values: DataFrame, depth: int, k: int) -> DataFrame:
    """Node pairs (p, q, n, m, off) at a depth, p <= q, at the budget or fewer bits; found by flipping single bits (k // 2 is 1 or 0)."""
    nodes = _nodes(values, depth)
    flips = [F.lit(0)] + ([F.lit(1 << i) for i in range(depth)] if k // 2 else [])
    near = nodes.withColumn("_x", F.explode(F.array(*[x.cast("long") for x in flips]))).select(
        "p", "n", F.col("p").bitwiseXOR(F.col("_x")).alias("q"), (F.col("_x") != 0).cast("int").alias("off")
    )
    other = nodes.select(F.col("p").alias("q"), F.col("n").alias("m"))
    return near.where("p <= q").join(other, "q").select("p", "q", "n", "m", "off")


def _opened(pairs: DataFrame, values: DataFrame, depth: int, k: int) -> DataFrame:
    """Children of node pairs, STRIDE levels down (2**STRIDE at most of each node), without those beyond the budget."""
    below = _nodes(values, depth + STRIDE).withColumn("up", F.shiftrightunsigned("p", STRIDE))
    a = below.select(F.col("up").alias("p"), F.col("p").alias("cp"), F.col("n").alias("cn"))
    b = below.select(F.col("up").alias("q"), F.col("p").alias("cq"), F.col("n").alias("cm"))
    low = F.lit((1 << STRIDE) - 1).cast("long")
    more = F.bit_count(F.col("cp").bitwiseXOR(F.col("cq")).bitwiseAND(low))
    children = pairs.select("p", "q", "off").join(a, "p").join(b, "q").withColumn("off", F.col("off") + more)
    return children.where((F.col("off") <= _budget(depth + STRIDE, k)) & (F.col("cp") <= F.col("cq"))).select(
        F.col("cp").alias("p"), F.col("cq").alias("q"), F.col("cn").alias("n"), F.col("cm").alias("m"), "off"
    )


def _trie_links(values: DataFrame, k: int, leaf: int, start: int) -> DataFrame:
    if k not in (2, 3):
        raise ValueError("the two-halves budget is written for 2 or 3 bits")
    depth, edges = start, None
    pairs = cut_lineage(_frontier(values, depth, k))
    while True:
        heavy = (F.col("n") > 4 * leaf) | (F.col("m") > 4 * leaf)
        if depth < 64:
            light = pairs.where(~heavy)
            found = _leaf_links(light, values, depth)
        else:  # nodes are single fingerprints here, and their pairs are links
            found = pairs.where("p < q").select(F.col("p").alias("a"), F.col("q").alias("b"))
        edges = found if edges is None else edges.union(found)
        if depth >= 64 or not pairs.where(heavy).take(1):
            return edges
        step = pairs.where(heavy)
        pairs = cut_lineage(_opened(step, values, depth, k))
        depth += STRIDE


def _leaf_links(pairs: DataFrame, values: DataFrame, depth: int) -> DataFrame:
    keyed = values.withColumn("_node", _prefix(F.col("fp"), depth))
    # Each node pair gets the fingerprints below both nodes, at most 4 * leaf of each.
    ends = pairs.select("p", "q", F.col("p").alias("_node"), F.lit(0).alias("side")).union(
        pairs.where("p <> q").select("p", "q", F.col("q"), F.lit(1))
    )
    rows = keyed.join(ends, "_node").select("p", "q", "side", "fp")
    return rows.groupBy("p", "q").applyInArrow(_group_links, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, root, component_id) for every row of `docs`; component_id is the smallest id that links of `k` bits reach.

    Texts without words (null, empty) have fingerprint 0 and link like any other. Null ids are ignored for the
    smallest id, unless a component has no other; `root`, a fingerprint, names the component in any case. Repeated rows
    come back as often. No rows give no rows.
    """
    rows = cut_lineage(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col)).alias("fp")))
    values = rows.groupBy("fp").agg(F.min("id").alias("first"))
    groups = components(fingerprint_links(values, k))
    named = values.join(groups.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.select("fp", "root").join(smallest, "root")
    return rows.join(classes, "fp").select("id", "fp", "root", "component_id")


def _in_fixed_order(df: DataFrame) -> Column:
    """Something to order rows by that depends on their values alone; maps and variants, which Spark cannot hash, are left out."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])


def without_near_duplicates(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays: that of the smallest id; of rows repeated under that id one of the component stays.

    Where an id stands on different texts, each component of that smallest id keeps a row of its own. A component whose
    rows all lack an id keeps one of them. Among equal candidates a hash of the row decides, so the choice is
    repeatable. Columns of `docs` come back as they were.
    """
    near = cut_lineage(near_duplicates(docs, k, id_col, text_col))
    # Of the rows that a component may keep, those of one fingerprint.
    classes = near.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root", "id").agg(F.min("fp").alias("_near_fp"))
    mixed = near.where("id is not null").groupBy("id").agg((F.min("fp") != F.max("fp")).alias("_mixed"))
    classes = cut_lineage(classes.join(mixed, "id", "left").select(F.col("id").alias("_near_id"), "_near_fp", "_mixed"))
    rows = fresh(docs, "_near_id", "_near_fp", "_near_row", "_near_order", "_mixed")
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_near_row")
    keyed = rows.select(F.col(id_col).alias("_near_id"), F.col(text_col).alias("_near_text"), whole, _in_fixed_order(rows).alias("_near_order"))
    first = F.min_by("_near_row", "_near_order").alias("_near_row")
    # An id on one fingerprint is in one component: no need to look at its text again.
    named = keyed.join(classes.where("not _mixed").select("_near_id"), "_near_id", "left_semi").groupBy("_near_id").agg(first).select("_near_row")
    bare = keyed.where("_near_id is null")
    several = classes.where("_mixed").select("_near_id").distinct()
    if several.take(1):
        bare = bare.unionByName(keyed.join(several, "_near_id", "left_semi"))
    bare = bare.withColumn("_near_fp", fingerprint_column(F.col("_near_text")))
    wanted = classes.where("_near_id is null or _mixed").select("_near_id", "_near_fp")
    kept = named.unionByName(join_null_safe(bare, wanted, ["_near_id", "_near_fp"]).groupBy("_near_id", "_near_fp").agg(first).select("_near_row"))
    return kept.select(*[F.col(f"_near_row.`{c}`") for c in docs.columns])
