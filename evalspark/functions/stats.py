"""Ratios, kappa, and tests on 2x2 counts."""

from __future__ import annotations

# Coefficients of a published rational approximation of erfc
# (Numerical Recipes, "erfcc"; relative error below 1.2e-7).
ERFC_COEFFICIENTS = (
    -1.26551223,
    1.00002368,
    0.37409196,
    0.09678418,
    -0.18628806,
    0.27886807,
    -1.13520398,
    1.48851587,
    -0.82215223,
    0.17087277,
)


def ratio(num: str, den: str) -> str:
    """num / den as a double, NULL for an empty denominator."""
    return f"try_divide(double({num}), double({den}))"


def percent(num: str, den: str) -> str:
    """num / den in percent, NULL for an empty denominator; not rounded."""
    return f"try_divide(double({num}) * 100.0D, double({den}))"


def erfc(x: str) -> str:
    """Complementary error function for x >= 0."""
    t = f"(1.0D / (1.0D + {x} * 0.5D))"
    series = f"{ERFC_COEFFICIENTS[-1]}D"
    for coefficient in reversed(ERFC_COEFFICIENTS[:-1]):
        series = f"({series} * {t} + ({coefficient}D))"
    return f"({t} * exp({series} - {x} * {x}))"


def yates_chi_square(a: str, b: str, c: str, d: str) -> str:
    """Continuity-corrected chi-square of [[a, b], [c, d]]; NULL if a margin is empty."""
    a, b, c, d = (f"double({v})" for v in (a, b, c, d))
    n = f"({a} + {b} + {c} + {d})"
    off = f"greatest(0.0D, abs({a} * {d} - {b} * {c}) - {n} / 2)"
    margins = f"(({a} + {b}) * ({c} + {d}) * ({a} + {c}) * ({b} + {d}))"
    return f"try_divide({n} * {off} * {off}, {margins})"


def chi_square_p(chi_square: str) -> str:
    """Upper tail of chi-square with one degree of freedom."""
    return erfc(f"sqrt({chi_square} / 2)")


def _stirling_rest(z: str) -> str:
    return f"(1 / (12 * {z}) - 1 / (360 * pow({z}, 3)) + 1 / (1260 * pow({z}, 5)))"


def log_factorial_change(x: str, step: str) -> str:
    """ln((x + step)!) - ln(x!) - step ln(x + 9), from differences that stay small.

    Stirling's series, moved up by 9 so that small x are exact to 1e-10; the part that is
    left out cancels between the cells of a table (see ``log_weight_change``).
    """
    z = f"({x} + 9)"
    shifted = " * ".join(f"(({x} + {step} + {i}) / ({x} + {i}))" for i in range(1, 9))
    return (
        f"(({z} + {step} - 0.5D) * log1p({step} / {z}) - {step}"
        f" + {_stirling_rest(f'({z} + {step})')} - {_stirling_rest(z)} - ln({shifted}))"
    )


def log_weight_change(cells: tuple[str, str, str, str], step: str) -> str:
    """ln of the weight of a 2x2 table with ``step`` moved along its diagonals, relative to
    that of ``cells`` (a, b, c, d as doubles), for tables with the same margins."""
    signs = (f"({step})", f"(-({step}))", f"(-({step}))", f"({step})")
    changes = " + ".join(log_factorial_change(x, s) for x, s in zip(cells, signs, strict=True))
    a, b, c, d = (f"({x} + 9)" for x in cells)
    return f"(-({changes}) - ({step}) * ln(({a} / {b}) * ({d} / {c})))"


def kappa(tt: str, tf: str, ft: str, ff: str) -> str:
    """Cohen's kappa of a 2x2 table; NULL if either rater used one label only."""
    both_used = f"({tt} + {tf}) > 0 AND ({ft} + {ff}) > 0 AND ({tt} + {ft}) > 0 AND ({tf} + {ff}) > 0"
    tt, tf, ft, ff = (f"double({v})" for v in (tt, tf, ft, ff))
    n = f"({tt} + {tf} + {ft} + {ff})"
    observed = f"try_divide({tt} + {ff}, {n})"
    chance = f"(({tt} + {tf}) * ({tt} + {ft}) + ({ff} + {ft}) * ({ff} + {tf}))"
    expected = f"try_divide({chance}, {n} * {n})"
    return f"CASE WHEN {both_used} THEN try_divide({observed} - {expected}, 1 - {expected}) END"
