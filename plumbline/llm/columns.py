"""Columns of the caller's tables under names that an operator's own can't meet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame, list[str]], DataFrame]]:
    """docs with its columns as in_0, in_1, ...; these by the caller's names (the first of equal ones); and what puts the names back.

    back(out, added) returns out's in_ columns under their own names, followed
    by the added ones. A column of docs with the name of an added one gets _in
    behind its name.
    """
    plain = [f"in_{i}" for i in range(len(docs.columns))]
    names = {c: p for c, p in reversed(list(zip(docs.columns, plain, strict=True)))}

    def back(out: DataFrame, added: list[str]) -> DataFrame:
        taken = set(added)
        own = [c + "_in" if c in taken else c for c in docs.columns]
        return out.select(*plain, *[F.col(f"`{c}`") for c in added]).toDF(*own, *added)

    return docs.toDF(*plain), names, back
