"""Exponentially weighted means (normalised weights) by doubling, in one sort.

With decay g = 1 - alpha the mean at row t is sum(g^i x[t-i]) / sum(g^i). The sum over the newest 2m values is the one over m plus g^m times the one
over m that ended m values ago, so a few lags on the (symbol, ts) order reach B values back with g^B below double precision; anything older is
smaller than one rounding error.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.windows import over


def alpha_of(span: float | None = None, com: float | None = None) -> float:
    return 2.0 / (span + 1.0) if span is not None else 1.0 / (1.0 + com)


def ewm_mean(df: DataFrame, x: str, out: str, span: float | None = None, com: float | None = None) -> DataFrame:
    """Add `out`, the decayed mean of `x`; NULLs of `x` are skipped and stay NULL."""
    return ewm_means(df, {out: (x, alpha_of(span, com))})


def ewm_means(df: DataFrame, means: dict[str, tuple[str, float]]) -> DataFrame:
    """Several decayed means {out: (x, alpha)} side by side: each doubling is one step over the rows for all of them."""
    s = over(df)
    keys, order = (", ".join(f"`{c}`" for c in columns) for columns in (s.by, s.order))
    decay = {out: 1.0 - alpha for out, (_, alpha) in means.items()}
    reach = {out: math.ceil(-37.0 / math.log(g)) for out, g in decay.items()}
    names = {out: f"_s_{out}" for out in means}
    done = df.withColumns({names[out]: F.col(x).cast("double") for out, (x, _) in means.items()}
                          | {f"_n_{out}": F.count(x).over(s.running) for out, (x, _) in means.items()})
    m, power = 1, dict(decay)
    while m < max(reach.values()):
        # values, not rows, are counted back
        back = lambda out, m=m: F.expr(f"lag(`{names[out]}`, {m}) IGNORE NULLS OVER (PARTITION BY {keys} ORDER BY {order})")
        done = done.withColumns({names[out]: F.col(names[out]) + g * F.coalesce(back(out), F.lit(0.0)) for out, g in power.items() if m < reach[out]})
        m, power = 2 * m, {out: g * g for out, g in power.items()}
    mean = {out: F.col(names[out]) / ((1.0 - F.pow(F.lit(g), F.col(f"_n_{out}"))) / (1.0 - g)) for out, g in decay.items()}
    return done.withColumns(mean).drop(*names.values(), *[f"_n_{out}" for out in means])
