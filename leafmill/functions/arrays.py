"""Expressions over arrays whose work grows nearly in proportion to their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running join (sum, maximum) of an array of integers, by doubling: each round joins what is 1, 2, 4, .. places apart."""

    def all_rounds(v: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            apart = F.least(F.pow(F.lit(2), k).cast("int"), F.size(acc))
            later = F.concat(F.array_repeat(F.lit(None).cast("int"), apart), F.slice(acc, F.lit(1), F.size(acc) - apart))
            return F.zip_with(acc, later, lambda x, y: F.when(y.isNull(), x).otherwise(join(x, y)))

        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(v), F.lit(1)))).cast("int"))
        return F.aggregate(rounds, v, step)

    return let(values, all_rounds)
