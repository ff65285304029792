"""Which rows of a sheet belong to its sample, decided row by row from the row number."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_WIDTH = 1 << 31


def _noise(i: str, seed: int) -> str:
    """An even number in 0..2^31-1 that looks random but depends on ``i`` and ``seed`` only."""

    def mix(x: str) -> str:
        return f"(({x} * 1103515245 + 12345) % {_WIDTH})"

    once = mix(f"({i} + {seed * 69069}L)")
    return mix(f"({once} ^ shiftright({once}, 16))")


def sample_count(last_row: Column, n: int) -> Column:
    return F.least(last_row - 1, F.lit(n))


def in_sample(n: int, seed: int = 0) -> Column:
    """Data rows (2 to ``last_row``) if there are at most ``n``; else the first 40 %, the last
    40 % and, for the rest, one random row from each equal slice of the middle.

    No sort and no shuffle: the slice of a row and the pick of that slice are arithmetic.
    """
    if n <= 0:
        return F.lit(False)
    edge = int(n * 0.4)
    picks = n - 2 * edge
    place = f"(cast(row AS bigint) - {2 + edge})"
    size = f"(cast(last_row AS bigint) - {1 + 2 * edge})"
    slice_no = f"((({place} + 1) * {picks} - 1) div greatest({size}, 1L))"
    low, high = f"({slice_no} * {size} div {picks})", f"(({slice_no} + 1) * {size} div {picks})"
    pick = f"({low} + {_noise(slice_no, seed)} * ({high} - {low}) div {_WIDTH})"
    middle = f"({place} >= 0 AND {place} < {size} AND {place} = {pick})"
    return F.expr(
        f"row >= 2 AND (last_row - 1 <= {n} OR row < {2 + edge} OR row > last_row - {edge} OR {middle})"
    )
