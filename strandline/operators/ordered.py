"""Groups read in order by Python, many at a time: a call for each group would cost more than the work on its rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_order(df: DataFrame, key: str, order: str) -> DataFrame:
    """The rows so that a task has its groups one after another, each in order and whole; nulls of the order come last."""
    return df.repartition(key).sortWithinPartitions(key, F.col(order).asc_nulls_last())


def whole_groups(batches: Iterable[pd.DataFrame], key: str) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """(rows of whole groups, where each begins, and the end) of a task of :func:`in_order`: what is held is a batch and the group that it ends in."""

    def starts(pdf: pd.DataFrame) -> list[int]:
        ids = pdf[key].to_numpy()
        return [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist()]

    held: list[pd.DataFrame] = []  # pieces of one group, which may go on in the next batch
    for pdf in batches:
        if pdf.empty:
            continue
        at = starts(pdf)
        if held and (len(at) > 1 or held[0][key].iloc[0] != pdf[key].iloc[0]):
            pdf = pd.concat([*held, pdf], ignore_index=True)
            held, at = [], starts(pdf)
        held.append(pdf.iloc[at[-1] :])
        if at[-1]:
            yield pdf.iloc[: at[-1]], at
    if held:
        last = pd.concat(held, ignore_index=True)
        yield last, [0, len(last)]
