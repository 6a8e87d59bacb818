"""Positions of regular-expression matches, and other array work, in built-in Spark expressions.

A column that is used inside a lambda is computed again for every element, unless it is bound with `let`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose running sum is taken one by one; sums of whole runs of that many are kept.
_RUN = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def long(x: int) -> Column:
    return F.lit(x).cast("long")


def _sum(values: Column) -> Column:
    return F.aggregate(values, long(0), lambda a, x: a + x)


def running(values: Column) -> Column:
    """For each element of an array of longs, the sum of those before it; work in proportion to the elements."""

    def whole(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _RUN).cast("int")), lambda b: _sum(F.slice(v, b * _RUN + 1, _RUN)))
        return F.aggregate(runs, F.array(long(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def each(v: Column) -> Column:
        return let(whole(v), lambda firsts: F.transform(v, lambda _, i: firsts[F.floor(i / _RUN).cast("int")] + _sum(F.slice(v, F.floor(i / _RUN).cast("int") * _RUN + 1, i % _RUN))))

    return let(values, lambda v: F.when(F.size(v) > 0, each(v)).otherwise(v))


def matches(text: Column, pattern: str, near: int = 0) -> Column:
    """The leftmost non-overlapping matches of a pattern that matches nothing empty: (start, end, found, before, after).

    Places are in code points, end exclusive. before and after are up to `near` characters beside the match, no further
    than the next match: taken from what lies between matches, so that many matches in a long text stay cheap.
    """

    def place(gaps: Column, found: Column) -> Column:
        lengths = F.transform(found, lambda m, i: F.length(gaps[i]).cast("long") + F.length(m))

        def ends(starts: Column) -> Column:
            start = lambda i: starts[i] + F.length(gaps[i])
            beside = lambda i: (F.right(gaps[i], F.lit(near)).alias("before"), F.left(gaps[i + 1], F.lit(near)).alias("after"))
            return F.transform(found, lambda m, i: F.struct(start(i).alias("start"), (start(i) + F.length(m)).alias("end"), m.alias("found"), *beside(i)))

        return let(running(lengths), ends)

    return let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: place(gaps, found)))


def no_matches() -> Column:
    return F.array().cast("array<struct<start:bigint,end:bigint,found:string,before:string,after:string>>")
