"""Normal and skew-normal probabilities as expression text.

Neither Spark nor other SQL engines ship an error function, so the CDF is written once as plain
arithmetic text. The text is valid Spark SQL and ANSI SQL, hence usable in ``F.expr``, in temporary
SQL functions and in a verification query elsewhere.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brierworks.params import DEFAULTS, Params

# The published rational approximation of the normal tail (West 2005, after Hart 1968),
# highest power first.
TAIL_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
TAIL_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
TAIL_SWITCH = 7.07106781186547
NODES = 20


def number(v: float) -> str:
    """A literal both engines read as a double."""
    return f"{v:.17e}"


def _horner(coeffs: tuple[float, ...], x: str) -> str:
    text = number(coeffs[0])
    for c in coeffs[1:]:
        text = f"({text} * {x} + {number(c)})"
    return text


def norm_tail_text(a: str) -> str:
    """Upper tail of the standard normal at ``a`` >= 0."""
    body = f"exp(-{a} * {a} / 2.0e0)"
    near = f"{body} * {_horner(TAIL_NUMERATOR, a)} / {_horner(TAIL_DENOMINATOR, a)}"
    chain = f"({a} + 0.65e0)"
    for k in (4, 3, 2, 1):
        chain = f"({a} + {k}.0e0 / {chain})"
    far = f"{body} / {chain} / {number(math.sqrt(2 * math.pi))}"
    return f"(CASE WHEN {a} < {number(TAIL_SWITCH)} THEN {near} ELSE {far} END)"


def norm_cdf_text(z: str) -> str:
    """Standard normal CDF of ``z`` (a name, or a short expression: it is repeated)."""
    return f"(CASE WHEN {z} > 0 THEN 1.0e0 - {norm_tail_text(f'abs({z})')} ELSE {norm_tail_text(f'abs({z})')} END)"


def _owen_small_text(h: str, a: str) -> str:
    """Owen's T for 0 <= a <= 1 by Gauss-Legendre quadrature."""
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    terms = []
    for t, w in zip(nodes, weights):
        x2 = f"({a} * {a} * {number(((1 + t) / 2) ** 2)})"
        terms.append(f"{number(w)} * exp(-{h} * {h} * (1.0e0 + {x2}) / 2.0e0) / (1.0e0 + {x2})")
    return f"({a} * {number(1 / (4 * math.pi))} * ({' + '.join(terms)}))"


def skew_cdf_steps(z: str, alpha: str) -> list[tuple[str, str]]:
    """Named expressions whose last one, ``_cdf``, is the skew-normal CDF at ``z``.

    Steps are projections one after another, so no costly sub-expression is written twice.
    Shapes beyond 1 use the reflection T(h,a) = (F(h)+F(ah))/2 - F(h)F(ah) - T(ah,1/a), which in
    upper tails u, v of h and ah reads (u+v)/2 - u*v - T(ah,1/a).
    """
    return [
        ("_h", f"abs({z})"),
        ("_g", f"abs({alpha} * {z})"),
        ("_u", norm_tail_text("_h")),
        ("_v", f"CASE WHEN abs({alpha}) > 1.0e0 THEN {norm_tail_text('_g')} ELSE 0.0e0 END"),
        ("_hh", f"CASE WHEN abs({alpha}) > 1.0e0 THEN _g ELSE _h END"),
        ("_aa", f"CASE WHEN abs({alpha}) > 1.0e0 THEN 1.0e0 / abs({alpha}) ELSE abs({alpha}) END"),
        ("_t", _owen_small_text("_hh", "_aa")),
        (
            "_cdf",
            f"(CASE WHEN {z} > 0 THEN 1.0e0 - _u ELSE _u END) - 2.0e0 * sign({alpha}) * "
            f"(CASE WHEN abs({alpha}) > 1.0e0 THEN (_u + _v) / 2.0e0 - _u * _v - _t ELSE _t END)",
        ),
    ]


def norm_tail(a: Column) -> Column:
    """Upper tail of the standard normal at ``a`` >= 0, as a column (cheaper to build than to parse)."""

    def horner(coeffs: tuple[float, ...]) -> Column:
        acc = F.lit(coeffs[0])
        for c in coeffs[1:]:
            acc = acc * a + c
        return acc

    chain = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        chain = a + k / chain
    body = F.exp(-a * a / 2.0)
    near = body * horner(TAIL_NUMERATOR) / horner(TAIL_DENOMINATOR)
    return F.when(a < TAIL_SWITCH, near).otherwise(body / chain / math.sqrt(2 * math.pi))


def norm_cdf(z: str) -> Column:
    """Standard normal CDF of a named column."""
    tail = norm_tail(F.abs(F.col(z)))
    return F.when(F.col(z) > 0, 1.0 - tail).otherwise(tail)


def _owen_small(h: str, a2: str, a: str) -> Column:
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    total = None
    half_h2 = -(F.col(h) * F.col(h)) / 2.0
    for t, w in zip(nodes, weights):
        one = F.col(a2) * float(((1 + t) / 2) ** 2) + 1.0
        term = F.exp(half_h2 * one) / one * float(w)
        total = term if total is None else total + term
    return F.col(a) * (total * (1 / (4 * math.pi)))


def with_skew_cdf(df: DataFrame, z: str, alpha: str, name: str) -> DataFrame:
    """Add the skew-normal CDF of column ``z`` with shape ``alpha``: three projections (arguments,
    tails and quadrature, result), the formula of :func:`skew_cdf_steps`."""
    keep = df.columns
    shape, big = F.abs(F.col(alpha)), F.abs(F.col(alpha)) > 1.0
    aa = F.when(big, 1.0 / shape).otherwise(shape)
    args = df.select(
        "*", F.abs(F.col(z)).alias("_h"), F.abs(F.col(alpha) * F.col(z)).alias("_g"), aa.alias("_aa"), (aa * aa).alias("_a2"),
        F.when(big, F.abs(F.col(alpha) * F.col(z))).otherwise(F.abs(F.col(z))).alias("_hh"),
    )
    parts = args.select(
        *keep, norm_tail(F.col("_h")).alias("_u"), F.when(big, norm_tail(F.col("_g"))).otherwise(0.0).alias("_v"),
        _owen_small("_hh", "_a2", "_aa").alias("_t"),
    )
    u, v, t = F.col("_u"), F.col("_v"), F.col("_t")
    owen = F.when(big, (u + v) / 2.0 - u * v - t).otherwise(t)
    cdf = F.when(F.col(z) > 0, 1.0 - u).otherwise(u) - 2.0 * F.signum(F.col(alpha)) * owen
    return parts.select(*keep, cdf.alias(name))


def skew_params(mu: Column, sigma: Column, g1: Column, p: Params = DEFAULTS) -> dict[str, Column]:
    """DST-01: location, scale and shape of the skew-normal with the given first three moments."""
    plain = F.abs(g1) < 1e-6
    g = F.greatest(F.lit(-0.9952), F.least(F.lit(0.9952), g1))
    k = F.pow(F.abs(g) * 2.0 / (4.0 - math.pi), F.lit(2.0 / 3.0))
    d2 = F.least(k * (math.pi / 2.0) / (1.0 + k), F.lit(0.999))
    delta = F.signum(g) * F.sqrt(d2)
    shape = delta / F.sqrt(1.0 - d2)
    omega = F.greatest(sigma / F.sqrt(1.0 - 2.0 * d2 / math.pi), F.lit(0.01))
    return {
        "alpha": F.when(plain, 0.0).otherwise(F.greatest(F.lit(-p.alpha_cap), F.least(F.lit(p.alpha_cap), shape))),
        "omega": F.when(plain, sigma).otherwise(omega),
        "xi": F.when(plain, mu).otherwise(mu - omega * delta * math.sqrt(2.0 / math.pi)),
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    """UDF-03: the CDFs as temporary SQL functions (pure SQL bodies, no Python worker)."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION bw_norm_cdf(z DOUBLE) RETURNS DOUBLE "
        f"RETURN {norm_cdf_text('z')}"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION bw_owen_small(h DOUBLE, a DOUBLE) RETURNS DOUBLE "
        f"RETURN {_owen_small_text('h', 'a')}"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION bw_skew_cdf(z DOUBLE, alpha DOUBLE) RETURNS DOUBLE RETURN "
        "bw_norm_cdf(z) - 2.0e0 * sign(alpha) * (CASE WHEN abs(alpha) > 1.0e0 THEN "
        "(bw_norm_cdf(abs(z)) + bw_norm_cdf(abs(alpha * z))) / 2.0e0 "
        "- bw_norm_cdf(abs(z)) * bw_norm_cdf(abs(alpha * z)) "
        "- bw_owen_small(abs(alpha * z), 1.0e0 / nullif(abs(alpha), 0.0e0)) "
        "ELSE bw_owen_small(abs(z), abs(alpha)) END)"
    )
    return ["bw_norm_cdf", "bw_owen_small", "bw_skew_cdf"]
