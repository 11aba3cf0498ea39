"""Host lists with any number of brackets in a name."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .scalars import expand_hostlist


def names(text: str):
    """The names of ``r[1-2]n[01-03,7],d9`` in order: brackets multiply, leading zeros stay, commas inside brackets part ranges only.

    A range that runs backwards is empty; what is no range of numbers stands for itself, and
    a bracket that is never closed is part of its name.
    """
    depth, start = 0, 0
    for i, c in enumerate([*text, ","]):
        depth += (c == "[") - (c == "]" and depth > 0)
        if c == "," and (depth == 0 or i == len(text)):
            if part := text[start:i].strip():
                yield from _multiplied(part)
            start = i + 1


def _multiplied(name: str):
    pieces, at = [], 0
    while (a := name.find("[", at)) >= 0 and (z := name.find("]", a)) >= 0:
        pieces += [[name[at:a]], [n for part in name[a + 1 : z].split(",") for n in _numbers(part.strip())]]
        at = z + 1
    yield from map("".join, product(*pieces, [name[at:]]))


def _numbers(part: str) -> list[str]:
    low, dash, high = part.partition("-")
    if not dash or not (low.isdigit() and high.isdigit()):
        return [part]
    return [str(i).zfill(len(low)) for i in range(int(low), int(high) + 1)]


@udtf(returnType="host string")
class Expand:
    def eval(self, text: str):
        if text:
            yield from ((n,) for n in names(text))


def _parted(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose names have one bracket at most, and the others."""
    several = F.coalesce(F.col(column).rlike(r"\[[^\]]*\][^,\[]*\["), F.lit(False))
    return df.where(~several), df.where(several)


def expanded(df: DataFrame, column: str) -> DataFrame:
    """A row with ``host`` for each name of a host list; lists without names give no row.

    Lists whose names have one bracket at most stay with Spark's functions, only the others
    go through the table function.
    """
    one, more = _parted(df, column)
    return one.withColumn("host", F.explode(expand_hostlist(F.col(column)))).unionByName(more.lateralJoin(Expand(F.col(column).outer())))


def with_host_list(df: DataFrame, column: str, name: str = "host_list") -> DataFrame:
    """The same as an array of names in each row."""
    one, more = _parted(df, column)
    arrays = F.udf(lambda text: list(names(text or "")), "array<string>", useArrow=True)
    return one.withColumn(name, expand_hostlist(F.col(column))).unionByName(more.withColumn(name, arrays(F.col(column))))
