"""Groups of rows that lie side by side in a sorted partition, seen one block at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Rows that a task looks at together.
BLOCK = 65_536
#: What a piece of a partition is: whole groups, the first rows of a group above the limit, more rows of it.
WHOLE, FIRST, MORE = 0, 1, 2


def sorted_groups(batches, key: str, limit: int, block: int = BLOCK) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(kind, columns) of the pieces of a partition that is sorted by `key`.

    WHOLE pieces hold complete groups of at most `limit` rows. The rows of a larger group come in several pieces,
    FIRST and then MORE, in their order. No more than a block and a group of `limit` rows are held at a time.
    """
    held: list[dict[str, np.ndarray]] = []
    n, open_key = 0, None

    def pieces(last: bool):
        nonlocal held, n, open_key
        t = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        k = t[key]
        start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        end = np.concatenate((start[1:], [len(k)]))
        tail = len(k) if last else start[-1]
        whole = np.ones(len(k), dtype=bool)
        big = np.flatnonzero(end - start > limit).tolist()
        if open_key is not None and k[0] == open_key and 0 not in big:
            big.insert(0, 0)
        for g in big:
            s, e = start[g], end[g]
            whole[s:e] = False
            yield (MORE if k[s] == open_key else FIRST), {c: x[s:e] for c, x in t.items()}
            open_key = k[s]
            if e == len(k):
                tail = e
        whole[tail:] = False
        if whole.any():
            yield WHOLE, {c: x[whole] for c, x in t.items()}
        held = [{c: x[tail:] for c, x in t.items()}] if tail < len(k) else []
        n = len(k) - tail

    grown = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append({c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(b.schema.names)})
        n += b.num_rows
        grown += b.num_rows
        if n >= block and grown >= min(block, limit + 1):
            grown = 0
            yield from pieces(False)
    if held:
        yield from pieces(True)
