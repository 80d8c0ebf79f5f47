"""`guards.tidy` by numpy: the same values, without a decimal number for each."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np

WIDE = Context(prec=400)


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as Spark's `round` of doubles: by the shortest decimal of each where the scaled value is too near a half, or too large, to tell."""
    with np.errstate(all="ignore"):
        y = x * 10.0 ** digits
        near = np.floor(y + 0.5)
        clear = (np.abs(y) < 2.0 ** 48) & (np.abs(y - near) < 0.5 - np.abs(y) * 2.0 ** -50)
        out = near / 10.0 ** digits
    for i in np.flatnonzero(~clear & np.isfinite(x)):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, WIDE)) + 0.0
    return out


def tidied(x: np.ndarray, digits: int = 6) -> np.ndarray:
    return half_up(x + 10.0 ** -(digits + 3), digits)
