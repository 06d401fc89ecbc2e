"""Tables that cut lineage, in the folder that the cluster's machines share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.runtime import drop, drop_at_end, hadoop, materialise, new_path, shared_dir

__all__ = ["drop", "drop_at_end", "hadoop", "materialise", "new_path", "shared_dir", "join_counted", "free_names"]

#: A key that more than a MOST_HOT-th of all rows have is joined by broadcast; there are at most MOST_HOT of them.
MOST_HOT = 100_000
#: Keys of fewer rows are never hot.
LEAST_HOT = 64


def join_counted(rows: DataFrame, table: DataFrame, key: str, copies: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per key and the number of ``rows`` that have it in ``copies``.

    Hot keys' rows stay where they are and meet a broadcast of the hot keys,
    whose number has a proven bound; all other rows are joined as usual, and no
    task gets a hot key. Null keys join nothing. ``copies`` is not returned.
    """
    total = table.agg(F.sum(copies)).first()[0] or 0
    bound = max(LEAST_HOT, total // MOST_HOT)
    hot = table.filter(F.col(copies) > bound).drop(copies)
    cold = table.filter(F.col(copies) <= bound).drop(copies)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return near.unionByName(far)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of ``df`` has, whatever its case."""
    have = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        name = f"__{w}"
        while name in have:
            name = f"_{name}"
        out.append(name)
    return out
