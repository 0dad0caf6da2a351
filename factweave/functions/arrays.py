"""Arrays as Column functions: values bound once, running sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_starts(sizes: Column) -> Column:
    """Exclusive running sums of an array of longs.

    Summed in blocks of about the root of its length, so that a row with very many entries costs n^1.5
    cheap steps instead of copying an array per entry.
    """
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    block = lambda i, width: F.floor(i / width).cast("int")

    def sums(of: Column, width: Column) -> Column:
        last = block(F.greatest(F.size(of) - 1, F.lit(0)), width)
        return F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(of, b * width + 1, width)))

    def starts(of: Column, width: Column, blocks: Column) -> Column:
        before = F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b)))
        return let(before, lambda known: F.transform(of, lambda _, i: F.get(known, block(i, width)) + total(F.slice(of, block(i, width) * width + 1, i % width))))

    return let(sizes, lambda of: let(F.ceil(F.sqrt(F.greatest(F.size(of), F.lit(1)))).cast("int"), lambda width: let(sums(of, width), lambda blocks: starts(of, width, blocks))))
