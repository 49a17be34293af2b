"""A seeded permutation of places as a column, so a draw is a filter.

The places from 0 to n - 1 lie in a grid of a rows of b, hardly larger than n. A
Feistel network adds a hash of the column to the row and a hash of the row to
the column in turns, which can be undone and so is one to one on the grid. A
place that leaves the range goes on until it is back. Any task computes a
place's image by itself: no list of places, no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Turns of the network; steps after which a place is back in range. At most a
#: rows of the grid lie outside, so up to 4,096 places no walk is longer, and
#: beyond the chance of one is under 64 ** -64.
TURNS, STEPS = 8, 64


def grid(n: int) -> tuple[int, int]:
    """Rows and columns of the least near-square grid of n places or more."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permuted(place: Column | str, n: int, seed: int) -> Column:
    """The place (0 to n - 1) to which a seeded permutation of n places sends
    ``place``; null stays null."""
    if n < 1:
        return F.lit(None).cast("long")
    a, b = grid(n)
    x = (F.col(place) if isinstance(place, str) else place).cast("long")

    def h(value: Column, turn: Column) -> Column:
        text = F.concat(F.lit(f"{seed}|"), turn.cast("string"), F.lit("|"), value.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        row = F.when(i % 2 == 0, (s["l"] + h(s["r"], i)) % a).otherwise(s["l"])
        column = F.when(i % 2 == 1, (s["r"] + h(s["l"], i)) % b).otherwise(s["r"])
        return F.struct(row.alias("l"), column.alias("r"))

    def step(v: Column, _: Column) -> Column:
        start = F.struct(F.floor(v / b).cast("long").alias("l"), (v % b).alias("r"))
        moved = F.aggregate(F.sequence(F.lit(0), F.lit(TURNS - 1)), start, turn, lambda s: s["l"] * b + s["r"])
        return moved

    # The first step is made in any case, the others only from outside.
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), step(x, x), lambda v, i: F.when(v < n, v).otherwise(step(v, i)))
