"""The budget fold over one campaign's requests, in numpy (runs inside tasks).

Rule: in order, a request is admitted iff its cost fits the room left, and
an admitted request uses up its cost. Between two "breaks" (a fitting
request that no longer fits once the ones before it are admitted) every
fitting request is admitted, so one cumulative sum decides a whole stretch.
A step that decides little hands the next requests to a plain loop (more of
them each time it happens again), so an adversarial order costs about what
the loop would.
"""

from __future__ import annotations

import numpy as np

WINDOW = 8192      # requests per vectorized pass
SMALL_STEP = 64    # a step deciding fewer requests than this ...
SCALAR_RUN = 256   # ... is followed by this many requests decided one by one,
MAX_SCALAR_RUN = 1 << 16  # doubling while steps stay small


def fold_costs(costs: np.ndarray, room: int) -> tuple[np.ndarray, int]:
    """Decide ``costs`` (int64 cents, in order) against ``room``.

    Returns (admitted mask, room left). Costs must be non-negative.
    """
    costs = np.asarray(costs, dtype=np.int64)
    n = len(costs)
    ok = np.zeros(n, dtype=bool)
    i, run = 0, SCALAR_RUN
    while i < n:
        rest = costs[i:min(n, i + WINDOW)]
        fits = rest <= room
        cum = np.cumsum(np.where(fits, rest, 0))
        over = np.flatnonzero(fits & (cum > room))
        if over.size == 0:                       # the whole window fits in order
            ok[i:i + len(rest)] = fits
            room -= int(cum[-1]) if len(cum) else 0
            i += len(rest)
            continue
        b = int(over[0])
        ok[i:i + b] = fits[:b]
        room -= int(cum[b] - rest[b])            # request b itself no longer fits
        i += b + 1
        if b >= SMALL_STEP:
            run = SCALAR_RUN
            continue
        end = min(n, i + run)
        for k, c in enumerate(costs[i:end].tolist(), start=i):
            if c <= room:
                ok[k] = True
                room -= c
        i = end
        run = min(2 * run, MAX_SCALAR_RUN)     # keeps failing: lean on the loop
    return ok, room


def fold_costs_loop(costs, room: int) -> tuple[np.ndarray, int]:
    """The same rule one request at a time (reference for tests)."""
    ok = np.zeros(len(costs), dtype=bool)
    for k, c in enumerate(costs):
        if c <= room:
            ok[k] = True
            room -= int(c)
    return ok, room
