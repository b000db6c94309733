"""The admission rule of one client, as a step from state to state that the stream takes, and in leaps over a block of
requests, which the batch replay takes."""

from __future__ import annotations

from bisect import bisect_left
from typing import NamedTuple

import numpy as np

#: In microseconds.
MINUTE, DAY = 60_000_000, 86_400_000_000


class Admitted(NamedTuple):
    """What of a client's past matters: the accepted times of the last minute, in order, and its quota's period."""

    recent: tuple[int, ...] = ()
    opened: int | None = None
    used: int = 0


def admit(state: Admitted, now: int, per_minute: int, daily: int) -> tuple[Admitted, bool]:
    """The state after a request at `now`, and whether it is accepted; one that isn't leaves no trace."""
    recent = state.recent[bisect_left(state.recent, now - MINUTE) :]
    opened, used = (state.opened, state.used) if state.opened is not None and now - state.opened <= DAY else (now, 0)
    if len(recent) < per_minute and used < daily:
        return Admitted((*recent, now), opened, used + 1), True
    return state._replace(recent=recent), False


def leaps(state: Admitted, times: np.ndarray, per_minute: int, daily: int) -> tuple[Admitted, list[int]]:
    """The state after ordered times and the places of the accepted ones, as `admit` would find them one by one. Each step goes to the next
    time that may be accepted, over all that may not."""
    if per_minute <= 0 or daily <= 0:
        return state, []
    recent, opened, used = list(state.recent), state.opened, state.used
    accepted, at = [], 0
    while at < len(times):
        now = int(times[at])
        if opened is not None and now - opened > DAY:
            opened, used = None, 0
        barred = None
        if used >= daily:
            barred = opened + DAY
        elif len(recent) >= per_minute and recent[-per_minute] >= now - MINUTE:
            barred = recent[-per_minute] + MINUTE
        if barred is not None:
            at += int(np.searchsorted(times[at:], barred, side="right"))
            continue
        opened, used = (now if opened is None else opened), used + 1
        recent = [*recent[-(per_minute - 1) :], now] if per_minute > 1 else [now]
        accepted.append(at)
        at += 1
    return Admitted(tuple(recent), opened, used), accepted
