"""The last values of EMA, MACD and RSI as SQL functions over arrays in date order, with their windows as arguments."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (parameters, result, body); a body may use the functions before it.
FUNCTIONS = {
    "candela_mean": ("a ARRAY<DOUBLE>", "DOUBLE", "aggregate(a, 0D, (s, x) -> s + x) / size(a)"),
    "candela_after": ("a ARRAY<DOUBLE>, n INT", "ARRAY<DOUBLE>", "slice(a, n + 1, greatest(size(a) - n, 0))"),
    "candela_smooth": ("a ARRAY<DOUBLE>, n INT, alpha DOUBLE", "DOUBLE", "IF(size(a) >= n, aggregate(candela_after(a, n), candela_mean(slice(a, 1, n)), (s, x) -> s + alpha * (x - s)), NULL)"),
    "candela_ema": ("a ARRAY<DOUBLE>, n INT", "DOUBLE", "candela_smooth(a, n, 2D / (n + 1))"),
    "candela_wilder": ("a ARRAY<DOUBLE>, n INT", "DOUBLE", "candela_smooth(a, n, 1D / n)"),
    "candela_moves": ("a ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "zip_with(candela_after(a, 1), slice(a, 1, greatest(size(a) - 1, 0)), (x, y) -> x - y)"),
    "candela_rsi_of": ("up DOUBLE, down DOUBLE", "DOUBLE", "CASE WHEN down = 0 THEN IF(up > 0, 100D, 50D) ELSE 100 - 100 / (1 + up / down) END"),
    "candela_rsi": (
        "a ARRAY<DOUBLE>, n INT", "DOUBLE",
        "candela_rsi_of(candela_wilder(transform(candela_moves(a), x -> greatest(x, 0D)), n), candela_wilder(transform(candela_moves(a), x -> greatest(-x, 0D)), n))",
    ),
    # one pass: the means of both windows, and the mean of their difference from its own seed on
    "candela_macd": (
        "a ARRAY<DOUBLE>, fast INT, slow INT, signal INT", "STRUCT<macd: DOUBLE, signal: DOUBLE, histogram: DOUBLE>",
        """aggregate(
          candela_after(a, slow),
          named_struct('n', 1, 'f', candela_ema(slice(a, 1, slow), fast), 's', candela_ema(slice(a, 1, slow), slow), 'sum', candela_ema(slice(a, 1, slow), fast) - candela_ema(slice(a, 1, slow), slow), 'g', CAST(NULL AS DOUBLE)),
          (p, x) -> transform(array(named_struct('f', p.f + 2D / (fast + 1) * (x - p.f), 's', p.s + 2D / (slow + 1) * (x - p.s))), m -> named_struct(
            'n', p.n + 1, 'f', m.f, 's', m.s, 'sum', p.sum + m.f - m.s,
            'g', CASE WHEN p.n + 1 < signal THEN NULL WHEN p.n + 1 = signal THEN (p.sum + m.f - m.s) / signal ELSE p.g + 2D / (signal + 1) * (m.f - m.s - p.g) END))[0],
          p -> IF(size(a) >= slow + signal - 1, named_struct('macd', p.f - p.s, 'signal', p.g, 'histogram', p.f - p.s - p.g), NULL))""",
    ),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to this session's SQL; they are plain SQL expressions, evaluated in the JVM."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
