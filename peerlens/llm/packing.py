"""Pack documents into training sequences of several permitted lengths: variable-capacity best-fit.

Pieces go longest first into the open bin with the least room that takes them.
When none does, a bin of the size with the least cost per token that it can be
expected to hold is opened; in the end each bin shrinks to the smallest permitted
length that holds its contents.

Pieces of one length are interchangeable, so the decisions need only the number
of pieces of each length, at most the largest capacity many numbers. The driver
makes the plan from that histogram, as runs: the r-th piece of a length, r from a
to b, goes to bin x + (r - a) // t. On the cluster every piece is numbered within
its length and looks up its run. No piece passes through the driver.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import with_row_number
from .common import seeded, word_count

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 16  # tokens that opening a sequence costs, whatever its length


def sequence_cost(capacity: int) -> float:
    return capacity + OVERHEAD


@dataclass
class Plan:
    """Runs (length, first rank, pieces, first bin, pieces a bin, offset in the bin) and bins (first, number, used)."""

    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    bins: list[tuple[int, int, int]] = field(default_factory=list)


def cheapest(length: int, capacities: tuple[int, ...], cost: Callable[[int], float], filler: int) -> int:
    """Capacity with the least cost per token; room beyond whole pieces of this length counts if shorter pieces can fill it."""

    def per_token(c):
        spare = c % length
        return cost(c) / (c - spare + (spare if filler >= spare else 0))

    return min((c for c in capacities if c >= length), key=lambda c: (per_token(c), c))


def plan_bins(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> Plan:
    """Best-fit decreasing over (length: pieces), many equal bins at a time."""
    plan, next_bin = Plan(), 0
    rooms: dict[int, list[tuple[int, int, int]]] = {}  # room: runs of open bins (first, number, used)
    order: list[int] = []  # rooms that have bins, ascending
    open_room = 0
    shorter = sum(length * n for length, n in histogram.items())

    def put(room, first, number, used):
        nonlocal open_room
        if room == 0:
            plan.bins.append((first, number, used))
            return
        open_room += room * number
        if room not in rooms:
            rooms[room] = []
            bisect.insort(order, room)
        rooms[room].append((first, number, used))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        shorter -= length * left

        def place(first, number, each, used, room):
            """`number` bins take `each` pieces; then one more takes what is left, if it is less."""
            nonlocal left, rank
            if number:
                plan.runs.append((length, rank, number * each, first, each, used))
                rank += number * each
                left -= number * each
                put(room - each * length, first, number, used + each * length)

        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                room = order[at]
                first, number, used = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
                open_room -= room * number
                each = min(room // length, left)
                took = min(number, left // each)
                if took < number:
                    put(room, first + took, number - took, used)
                place(first, took, each, used, room)
                continue
            filler = shorter - open_room
            capacity = cheapest(length, capacities, cost, filler)
            each = min(capacity // length, left)
            spare = capacity % length
            number = left // each  # as many as the shorter pieces can fill up; the choice is made again for the rest
            if spare and filler >= spare:
                number = min(number, filler // spare)
            place(next_bin, number, each, 0, capacity)
            next_bin += number
    for runs in rooms.values():
        plan.bins.extend(runs)
    plan.bins.sort()
    plan.runs.sort()
    return plan


def pieces_of(docs: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, first_word, length): texts cut at `most` tokens; a text's tokens are its words and one end mark.

    A null or empty text is its end mark alone. Rows repeated with one id are pieces of their own.
    """
    sized = docs.select(F.col(id_col).alias("id"), (word_count(F.col(text_col)) + 1).alias("_n"))
    parts = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {most}"))))
    return parts.select("id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * most).alias("first_word"), F.least(F.lit(most), F.col("_n") - F.col("piece") * most).cast("int").alias("length"))


def pack(
    docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = sequence_cost, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, piece, first_word, length, bin, offset, capacity, used): where each piece of each document stands.

    Pieces of one length are ordered by a seeded hash, so neighbours in the corpus do not share a bin by order. Every token is
    placed once, no bin holds more than its capacity, bins are numbered from 0. No rows give no rows.
    """
    capacities = tuple(sorted(set(capacities)))
    if not capacities or capacities[0] < 1:
        raise ValueError("capacities must be positive")
    pieces = pieces_of(docs, capacities[-1], id_col, text_col)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row per length
    plan = plan_bins(histogram, capacities, cost)
    shared = docs.sparkSession.sparkContext.broadcast((np.array(plan.runs or [[0] * 6], np.int64), np.array(plan.bins or [[0] * 3], np.int64), np.array(capacities)))

    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        runs, bins, sizes = shared.value
        key = length.to_numpy(np.int64) << 44 | rank.to_numpy(np.int64)
        run = runs[np.searchsorted(runs[:, 0] << 44 | runs[:, 1], key, side="right") - 1]
        along = rank.to_numpy(np.int64) - run[:, 1]
        number = run[:, 3] + along // run[:, 4]
        used = bins[np.searchsorted(bins[:, 0], number, side="right") - 1, 2]
        capacity = sizes[np.searchsorted(sizes, used)]
        return pd.DataFrame({"bin": number, "offset": run[:, 5] + along % run[:, 4] * run[:, 0], "capacity": capacity, "used": used})

    numbered = with_row_number(pieces, [seeded(seed, "id", "piece"), F.col("id"), F.col("piece")], "_rank", keys=["length"])
    found = F.pandas_udf(look_up, "bin long, offset long, capacity long, used long")("length", F.col("_rank") - 1)
    return numbered.withColumn("_at", found).select("id", "piece", "first_word", "length", "_at.bin", "_at.offset", "_at.capacity", "_at.used")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per bin: (bin, capacity, used, parts), parts in order. A bin has no more parts than its capacity."""
    part = F.struct("offset", "id", "piece", "first_word", "length")
    return packed.groupBy("bin", "capacity", "used").agg(F.sort_array(F.collect_list(part)).alias("parts"))
