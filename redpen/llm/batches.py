"""Arrow batches of sorted rows, cut where keys end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows are handed on when they weigh this much, always whole keys.
CHUNK_BYTES = 16 << 20


def whole_keys(batches, key: int, weigh, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Sorted batches joined and cut so that no value of column ``key`` is in two of them."""
    held, weight = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        weight += weigh(batch)
        if weight < most:
            continue
        whole = pa.concat_batches(held)
        keys = whole.column(key).to_numpy()
        cut = int(np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[-1])
        if cut:
            yield whole.slice(0, cut)
        rest = whole.slice(cut)
        held, weight = [rest], weigh(rest)
    if held:
        yield pa.concat_batches(held)
