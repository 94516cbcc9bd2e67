"""Band expressions as SQL text.

Expressions over bands are Spark SQL: its grammar, precedence, CASE and IF are
Spark's own. What the language of band expressions adds is put into the session
as SQL functions, which Catalyst inlines, so a text costs what Columns cost.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..product import Product

_INF = "double('Infinity')"
# Name, arguments and body; a and b are doubles. By zero a quotient is infinite, with the zero's sign, or not a number, of a missing sample it is missing, whole numbers wrap, and nothing compares with NaN.
FUNCTIONS = {
    "bm_div": ("a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN b = 0 THEN a * pow(b, -1) ELSE try_divide(a, b) END"),
    "bm_idiv": ("a INT, b INT", "INT", "CASE WHEN b = -1 THEN CASE WHEN a = -2147483648 THEN a ELSE -a END ELSE CAST(try_divide(CAST(a AS DOUBLE), b) AS INT) END"),
    "bm_lt": ("a DOUBLE, b DOUBLE", "BOOLEAN", "NOT isnan(a) AND NOT isnan(b) AND a < b"),
    "bm_le": ("a DOUBLE, b DOUBLE", "BOOLEAN", "NOT isnan(a) AND NOT isnan(b) AND a <= b"),
    "bm_gt": ("a DOUBLE, b DOUBLE", "BOOLEAN", "NOT isnan(a) AND NOT isnan(b) AND a > b"),
    "bm_ge": ("a DOUBLE, b DOUBLE", "BOOLEAN", "NOT isnan(a) AND NOT isnan(b) AND a >= b"),
    "bm_eq": ("a DOUBLE, b DOUBLE", "BOOLEAN", "NOT isnan(a) AND NOT isnan(b) AND a = b"),
    "feq": ("a DOUBLE, b DOUBLE, eps DOUBLE", "BOOLEAN", "NOT isnan(a) AND NOT isnan(b) AND (a = b OR abs(a - b) <= eps)"),
    "fneq": ("a DOUBLE, b DOUBLE, eps DOUBLE", "BOOLEAN", "isnan(a) OR isnan(b) OR NOT (a = b OR abs(a - b) <= eps)"),
    "sqr": ("a DOUBLE", "DOUBLE", "a * a"),
    "exp10": ("a DOUBLE", "DOUBLE", "pow(10, a)"),
    "ampl": ("a DOUBLE, b DOUBLE", "DOUBLE", "sqrt(a * a + b * b)"),
    "phase": ("a DOUBLE, b DOUBLE", "DOUBLE", "atan2(b, a)"),
    "sech": ("a DOUBLE", "DOUBLE", "2 / (exp(a) + exp(-a))"),
    "inf": ("a DOUBLE", "BOOLEAN", f"abs(a) = {_INF}"),
    "inrange": ("v DOUBLE, low DOUBLE, high DOUBLE", "BOOLEAN", "isnan(v) OR (v >= low AND v <= high)"),
    "flag": ("bits BIGINT, mask BIGINT", "BOOLEAN", "(bits & mask) = mask"),
    "bit_set": ("bits BIGINT, n INT", "BOOLEAN", "(shiftright(bits, n) & 1) = 1"),
}


def register(spark: SparkSession) -> None:
    """Put FUNCTIONS into the session. X and Y, the place of a pixel's centre, are written x + 0.5 and y + 0.5."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")


def band_maths(p: Product, valid: str | None = None, no_data: float | None = None, **texts: str) -> Product:
    """Bands from SQL texts over p's bands; where `valid` doesn't hold the result is missing, or no_data."""
    register(p.pixels.sparkSession)
    keep = F.lit(True) if valid is None else F.coalesce(F.expr(valid), F.lit(False))
    return p.select(*[F.when(keep, F.expr(t)).otherwise(F.lit(no_data)).alias(n) for n, t in texts.items()])
