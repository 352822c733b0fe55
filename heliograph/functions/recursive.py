"""Recursions that are no window expressions: each is a first state and a step from a state and a row to the next state and the row's outputs."""

from __future__ import annotations

from heliograph.operators.scan import Recursion


def ewm(alpha: float, least: int = 1) -> Recursion:
    """Exponential mean from the first value on; null before ``least`` values."""

    def step(state: tuple, x: float | None) -> tuple[tuple, tuple]:
        y, k = state
        if x is not None:
            y, k = x if y is None else y + alpha * (x - y), min(k + 1, least)
        return (y, k), (y if k >= least else None,)

    return Recursion((None, 0), step)


def seeded(n: int) -> Recursion:
    """Wilder's mean, seeded with the plain mean of the first ``n`` values."""

    def step(state: tuple, x: float | None) -> tuple[tuple, tuple]:
        total, k = state
        if x is not None:
            total, k = total + x / n if k < n else (total * (n - 1) + x) / n, min(k + 1, n)
        return (total, k), (total if k >= n else None,)

    return Recursion((0.0, 0), step)


def adaptive(fast: int = 2, slow: int = 30) -> Recursion:
    """Adaptive mean: the efficiency ratio sets how fast it follows. Starts where there is a ratio."""
    f, s = 2 / (fast + 1), 2 / (slow + 1)

    def step(state: tuple, close: float, ratio: float | None) -> tuple[tuple, tuple]:
        (y,) = state
        if y is None:
            y = None if ratio is None else close
        else:
            y += ((ratio or 0.0) * (f - s) + s) ** 2 * (close - y)
        return (y,), (y,)

    return Recursion((None,), step)


def trend_bands(width: float) -> Recursion:
    """1 or -1: the side of two bands around the middle that only tighten while the close stays inside."""

    def step(state: tuple, high: float, low: float, close: float, atr: float) -> tuple[tuple, tuple]:
        upper, lower, last, side = state
        up, down = (high + low) / 2 + width * atr, (high + low) / 2 - width * atr
        if upper is not None:
            side = 1 if close > upper else -1 if close < lower else side
            up, down = min(up, upper) if last <= upper else up, max(down, lower) if last >= lower else down
        return (up, down, close, side), (side,)

    return Recursion((None, None, None, 1), step)


def parabolic(step_size: float = 0.02, most: float = 0.2) -> Recursion:
    """1 or -1, and the level: the side of a stop that speeds up with every new extreme."""

    def step(state: tuple, high: float, low: float) -> tuple[tuple, tuple]:
        level, extreme, side, speed = state
        if level is None:
            return (low, high, side, speed), (side, low)
        level += speed * (extreme - level)
        crossed, beyond, turned = (low < level, high > extreme, low) if side > 0 else (high > level, low < extreme, high)
        if crossed:
            side, level, extreme, speed = -side, extreme, turned, step_size
        elif beyond:
            extreme, speed = (high if side > 0 else low), min(speed + step_size, most)
        return (level, extreme, side, speed), (side, level)

    return Recursion((None, None, 1, step_size), step)


def rule_walk(stop_width: float = 2.5, most: int = 30) -> Recursion:
    """``rule_walk_sides``, long only, without target and cost."""
    walk = rule_walk_sides(stop_width, most)

    def step(state: tuple, open_: float, low: float, entry: bool | None, exit_: bool | None, atr: float | None) -> tuple[tuple, tuple]:
        return walk.step(state, open_, open_, low, entry, exit_, atr)

    return Recursion(walk.start, step)


def rule_walk_sides(stop_width: float = 2.5, most: int = 30, side: int = 1, target_width: float | None = None, cost: float = 0.0) -> Recursion:
    """One position at a time: ``at_open`` and ``in_bar``, results in risk units, less cost, where a position ends.

    In at the open after an entry; out at the open after an exit or ``most``
    rows, or in the bar at the stop, or at the open beyond it, else at the target
    (never beyond it). ``side``: 1 long, -1 short. Widths are in ranges ``atr``; cost in price.
    """
    flat = (None, 0.0, 0.0, None)

    def step(state: tuple, open_: float, high: float, low: float, entry: bool | None, exit_: bool | None, atr: float | None) -> tuple[tuple, tuple]:
        held, price, risk, take = state
        first = second = None
        if held is not None and (exit_ or held >= most):
            first, held = (side * (open_ - price) - cost) / risk, None
        if held is None and entry and atr:
            held, price, risk = 0, open_, stop_width * atr
            take = None if target_width is None else price + side * target_width * atr
        elif held is not None:
            held += 1
        if held is None:
            return flat, (first, second)
        stop = price - side * risk
        worst, best = (low, high) if side > 0 else (high, low)
        if side * (worst - stop) <= 0:
            out = min(open_, stop) if side > 0 else max(open_, stop)
            return flat, (first, (side * (out - price) - cost) / risk)
        if take is not None and side * (best - take) >= 0:
            return flat, (first, (side * (take - price) - cost) / risk)
        return (held, price, risk, take), (first, second)

    return Recursion(flat, step)


def reversal_literal(stop_width: float = 2.5, most: int = 30, high: float = 0.8) -> Recursion:
    """The reversal walk in its older cadence: ``closed`` and ``same_bar``, results in risk units.

    Exits are judged at a bar's own close and made at the next open (the last bar's close if there is
    none), stops inside the bar; only then may the same bar be entered, at its open, and stopped at once.
    """
    flat = (None, 0.0, 0.0)

    def step(state: tuple, open_: float, low: float, close: float, ibs: float | None, entry: bool | None, atr: float | None, after: float | None) -> tuple[tuple, tuple]:
        held, price, risk = state
        closed = same = None
        if held is not None:
            held += 1
            stop = price - risk
            if low <= stop:
                closed = (min(open_, stop) - price) / risk
            elif (ibs is not None and ibs > high) or held >= most:
                closed = ((close if after is None else after) - price) / risk
            if closed is not None:
                held = None
        if held is None and entry and atr:
            held, price, risk = 0, open_, stop_width * atr
            if low <= price - risk:
                same, held = -1.0, None
        return (flat if held is None else (held, price, risk)), (closed, same)

    return Recursion(flat, step)
