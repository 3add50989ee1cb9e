"""Shared pieces: the word rule, rows packed away from name clashes, task-side helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order, as an array."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def packed(df: DataFrame) -> DataFrame:
    """The rows as one struct column ``row``; working columns then clash with nothing."""
    quoted = [f"`{c.replace('`', '``')}`" for c in df.columns]
    return df.select(F.struct(*[F.col(c) for c in quoted]).alias("row"))


def unpacked(df: DataFrame, like: DataFrame, *more: Column) -> DataFrame:
    """The columns of ``like`` back from ``row``."""
    return df.select(*[F.col("row")[c].alias(c) for c in like.columns], *more)


def in_pieces(batches: Iterator[pa.RecordBatch], text: int = 1,
              limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into runs of about ``limit`` bytes of the string column ``text``.

    A batch has a fixed number of rows, whatever their length; work on it should
    not take memory in proportion to that. One row is never cut.
    """
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
