"""Best rows of each group, for results that a task keeps while it reads on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def best_rows(table: pa.Table, group: str, order: list[tuple[str, str]], k: int) -> pa.Table:
    """The first ``k`` rows of each (integer) ``group`` by ``order``; nulls come last."""
    if not table.num_rows:
        return table
    table = table.take(pc.sort_indices(table, [(group, "ascending"), *order], null_placement="at_end"))
    groups = np.asarray(table.column(group))
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    place = np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))
    return table.filter(pa.array(place < k))
