"""The journal as a stream: chain checks with state per book, and a census by time window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def chain_breaks(receipts: DataFrame) -> DataFrame:
    """Receipts of a stream (book, line_no, rev, base_hash, result_hash) that don't follow the one before in their book."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = state.getOption
        out = []
        for r in pd.concat(list(frames)).sort_values("line_no").itertuples():
            if past and not (r.base_hash == past[1] and r.rev > past[0]):
                out.append((key[0], r.line_no, past[1], r.base_hash))
            past = (int(r.rev), r.result_hash)
        state.update(past)
        yield pd.DataFrame(out, columns=["book", "line_no", "expected", "found"])

    return receipts.groupBy("book").applyInPandasWithState(
        run, "book string, line_no long, expected string, found string", "rev long, hash string", "append", GroupStateTimeout.NoTimeout
    )


def tumbling_census(cells: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Cells per sheet and kind in windows of `width`; rows later than `late` are left out."""
    windowed = cells.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "sheet", "kind")
    return windowed.agg(F.count("*").alias("cells")).select("w.start", "w.end", "sheet", "kind", "cells")
