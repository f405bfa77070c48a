import math

import pytest

from sparkrules.functions import exprs as E
from sparkrules.functions.exprs import ExprError, col, lit


def one(spark, expr, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string' if isinstance(v, str) else 'double'}" for k, v in row.items()))
    return E.with_columns(df, out=expr).first()["out"]


@pytest.mark.parametrize("expr, row, want", [
    (col("a") / col("b"), {"a": 1.0, "b": 0.0}, math.inf),
    (col("a") / col("b"), {"a": 1.0, "b": -0.0}, -math.inf),
    (col("a") / 0, {"a": -1}, -math.inf),
    (col("a") // -2, {"a": 7}, -3),
    (col("a") % 3, {"a": -7}, -1),
    (col("a") % -1, {"a": -(2**63)}, 0),
    (col("a").cast("i64"), {"a": 2.5}, 2),
    (col("a").cast("i64"), {"a": 3.5}, 4),
    (col("a").round(2), {"a": 2.675}, 2.68),
    (col("a").round(0), {"a": -2.5}, -3.0),
    (col("a").floor(), {"a": -1.5}, -2.0),
    (col("a").ceil(), {"a": 1e300}, 1e300),
    (col("a").str_len(), {"a": "é"}, 2),
    (col("a").regexp_full_match("a+"), {"a": "aa\n"}, False),
    (col("a") == col("a"), {"a": math.nan}, False),
    (col("a") != col("a"), {"a": math.nan}, True),
    (col("a") > 1, {"a": math.nan}, False),
    (E.if_else(col("a") > 1, "x", "y"), {"a": 0}, "y"),
    (2 ** col("a"), {"a": 3}, 8.0),
])
def test_values(spark, expr, row, want):
    assert one(spark, expr, **row) == want


def test_zero_by_zero_is_nan(spark):
    assert math.isnan(one(spark, col("a") / col("a"), a=0.0))
    assert math.isnan(one(spark, col("a") % 0.0, a=1.0))


@pytest.mark.parametrize("expr, row", [
    (col("a") + 1, {"a": 2**63 - 1}), (-col("a"), {"a": -(2**63)}), (col("a") // 0, {"a": 1}), (col("a") % 0, {"a": 1}), (col("a") // -1, {"a": -(2**63)}),
    (col("a").sqrt(), {"a": -1.0}), (col("a").ln(), {"a": 0.0}), (col("a").asin(), {"a": 2.0}), (col("a").sin(), {"a": math.inf}), (col("a").cast("i64"), {"a": math.nan}), (col("a").cast("i64"), {"a": 1e300}),
])
def test_loud_errors(spark, expr, row):
    with pytest.raises(Exception, match="ARITHMETIC|DIVIDE|domain|overflow|OVERFLOW|ZERO"):
        one(spark, expr, **row)


def test_types_are_checked_before_running(spark):
    df = spark.range(1).selectExpr("id a", "'x' s", "true b", "cast(1 as decimal(5,2)) d")
    for bad in (col("a") + col("s"), col("b") < col("b"), col("zz") + 1, col("s").sqrt(), col("d") + 1, col("a").cast("str"), col("s").regexp_matches("(?=a)"), col("s").regexp_matches(r"(a)\1")):
        with pytest.raises(ExprError):
            E.with_columns(df, out=bad)
    for name in ("a", "handle"):
        with pytest.raises(ExprError):
            E.with_columns(df, **{name: col("a")})
    with pytest.raises(ExprError):
        lit(math.nan)
    with pytest.raises(ExprError):
        E.with_columns(df, x=col("a") + 1, y=col("x") + 1)  # siblings are not seen
    with pytest.raises(ExprError):
        E.filter(df, col("a"))
