"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, even where ``use`` reads it per element.

    The optimizer may move an expression into the lambda that reads it and then compute it again
    for every element; a bound lambda variable cannot be moved.
    """
    return F.transform(F.array(value), use)[0]


def counted(items: Column) -> Column:
    """``array<struct<item, n>>``: how often each item occurs in an array, linear after a sort."""

    def runs(arr: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(arr) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(arr, i) != F.get(arr, i - 1)))

        def sized(begin: Column) -> Column:
            ends = F.concat(F.slice(begin, 2, F.size(begin)), F.array(F.size(arr)))
            return F.zip_with(
                begin, ends, lambda a, b: F.struct(F.get(arr, a).alias("item"), (b - a).cast("bigint").alias("n"))
            )

        return let(starts, sized)

    return let(F.filter(items, lambda x: x.isNotNull()), lambda kept: F.when(
        F.size(kept) > 0, let(F.sort_array(kept), runs)
    ))
