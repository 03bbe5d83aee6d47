"""A count-min sketch that every partition fills by itself and whose shards are merged by addition.

Keys are 64-bit hashes. Their upper bits name a shard, the lower 32 a cell of the shard's wide row; a partition's
sketch is sparse, the cells that it filled once and those that it filled more often, cut by shard. The task of a
shard adds the partitions' sketches up in two dense rows, as wide as the cells that were sent ask for, so the
sketch grows with the input and neither the driver nor a broadcast holds any of it. The smaller of a key's two
counters is never below the number of its places.
"""

from __future__ import annotations

import numpy as np

from skeinworks.llm.words import U, mix

#: Counters to a filled cell.
SPARSE = 6


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return (key >> U(36)) % U(shards)


def cell_of(key: np.ndarray) -> np.ndarray:
    return key.astype(np.uint32)


def repeated(once: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Which cells of `once` (each filled once by one partition) are estimated to be filled twice or more in all; `more` were filled twice or more by one."""
    width = 1 << int(np.ceil(np.log2(max(16, SPARSE * (len(once) + len(more))))))
    out = np.ones(len(once), bool)
    for row in (0, 1):
        at = [(mix(x.astype(np.uint64) + U(row << 40)) >> U(24)).astype(np.int64) & (width - 1) for x in (once, more)]
        counts = np.bincount(at[0], minlength=width)
        counts[at[1]] += 2
        out &= counts[at[0]] >= 2
    return out
