import pandas as pd
import pytest
from toys import bars, column, walk

from candlewick.operators import indicators as ind
from candlewick.schemas import require_columns


def test_full_window_rule_and_gap(spark):
    got = column(ind.sma(bars(spark, {"A": [1.0, 2.0, None, 4.0, 5.0, 6.0]}), (2,)), "sma_2")
    assert got == [None, 1.5, None, None, 4.5, 5.5]


@pytest.mark.parametrize("op,name,rising,first", [(ind.rsi, "rsi", 100.0, 13), (ind.rsi_strict, "rsi_strict", None, None), (ind.rsi_inf, "rsi_inf", 0.0, 13)])
def test_rsi_variants_on_rising_series(spark, op, name, rising, first):
    got = column(op(bars(spark, {"A": [float(i) for i in range(1, 31)]})), name)
    assert got[-1] == rising
    if first is not None:
        assert got[first - 1] is None and got[first] == rising


def test_rsi_flat_series_is_null(spark):
    assert column(ind.rsi(bars(spark, {"A": [5.0] * 20})), "rsi")[-1] is None


@pytest.mark.parametrize("kw", [{"span": 12}, {"span": 3}, {"com": 14}])
def test_decay_matches_pandas(spark, kw):
    from candlewick.functions.decay import ewm_mean
    a, b = walk(700, 1), walk(40, 2)
    out = ewm_mean(bars(spark, {"A": a, "B": b}), "close", "e", **kw)
    for symbol, values in (("A", a), ("B", b)):
        want = pd.Series(values).ewm(**kw).mean().tolist()
        assert column(out, "e", symbol) == pytest.approx(want, rel=1e-12)


def test_true_range_first_row(spark):
    b = bars(spark, {"A": [10.0, 12.0]}, spread=1.0)
    assert column(ind.true_range(b), "true_range") == [None, 3.0]
    assert column(ind.true_range(b, "range"), "true_range") == [2.0, 3.0]


def test_zero_range_gives_null_not_error(spark):
    b = bars(spark, {"A": [5.0] * 30})
    assert column(ind.stochastic(b), "stoch_k")[-1] is None
    assert column(ind.ad_line(b), "ad_line")[-1] is None
    assert column(ind.bollinger(b), "bb_position")[-1] is None


def test_obv(spark):
    b = bars(spark, {"A": [1.0, 2.0, 2.0, 1.0]}, {"A": [5, 7, 11, 13]})
    assert column(ind.obv(b), "obv") == [5.0, 12.0, 12.0, -1.0]


def test_missing_column_is_reported(spark):
    with pytest.raises(ValueError, match="close"):
        require_columns(spark.range(1), ["close"])
