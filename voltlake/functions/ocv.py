"""Open-circuit-voltage model of plateaus, its derivatives and inverse, and cell formulas, as column expressions.

SOC(E) = sum of dx / (1 + exp((E - e0) a z e / (k T))) over plateaus (e0, a, dx).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elementary charge / Boltzmann constant in K/V, Faraday and gas constant.
E_OVER_KB, FARADAY, GAS = 11604.518121550082, 96485.33212331001, 8.31446261815324
Plateau = tuple[float, float, float]


def slope_unit(z: float = 1.0, temperature: float = 298.15) -> float:
    return z * E_OVER_KB / temperature


def _terms(e: Column, plateaus: Sequence[Plateau], unit: float) -> list[tuple[Column, float, float]]:
    """exp(u), k, dx per plateau; the exponent is held within 700, where the term no longer changes."""
    return [(F.exp(F.greatest(F.least((e - e0) * (a * unit), F.lit(700.0)), F.lit(-700.0))), a * unit, dx) for e0, a, dx in plateaus]


def _sum(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def complete(plateaus: Sequence[tuple]) -> list[Plateau]:
    """The last share may be left out: the shares add up to 1."""
    if len(plateaus[-1]) == 3:
        return list(plateaus)
    return [*plateaus[:-1], (*plateaus[-1], 1 - sum(p[2] for p in plateaus[:-1]))]


def ocv_model_soc(e: Column, plateaus: Sequence[Plateau], start: float = 0.0, end: float = 1.0, unit: float | None = None) -> Column:
    return F.lit(start) + _sum([dx / (1 + x) for x, _, dx in _terms(e, plateaus, unit or slope_unit())]) * (end - start)


def ocv_model_terms(e: Column, plateaus: Sequence[Plateau], start: float = 0.0, end: float = 1.0) -> Column:
    """Array of the plateaus' shares of the SOC."""
    n = len(plateaus)
    return F.array(*[start / n + dx / (1 + x) * (end - start) for x, _, dx in _terms(e, plateaus, slope_unit())])


def ocv_model_d1(e: Column, plateaus: Sequence[Plateau]) -> Column:
    return _sum([-dx * k * x / ((1 + x) * (1 + x)) for x, k, dx in _terms(e, plateaus, slope_unit())])


def ocv_model_d2(e: Column, plateaus: Sequence[Plateau]) -> Column:
    return _sum([dx * k * k * x * (x - 1) / ((1 + x) * (1 + x) * (1 + x)) for x, k, dx in _terms(e, plateaus, slope_unit())])


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body's value for a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bisect(f: Callable[[Column], Column], low: float, high: float, steps: int = 50) -> Column:
    """Where f, falling from above 0 to below, crosses 0 between low and high; null if it doesn't."""
    start = F.struct(F.lit(low).alias("a"), F.lit(high).alias("b"))

    def step(s: Column, _: Column) -> Column:
        def halved(mid: Column) -> Column:
            return F.when(f(mid) > 0, F.struct(mid.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), mid.alias("b")))

        return _once((s["a"] + s["b"]) / 2, halved)

    root = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: (s["a"] + s["b"]) / 2)
    return F.when((f(F.lit(low)) >= 0) & (f(F.lit(high)) <= 0), root)


def ocv_model_inverse(soc: Column, plateaus: Sequence[Plateau], low: float, high: float) -> Column:
    """The voltage of an SOC, by halving in the row; null outside the range that [low, high] covers. SOC falls with voltage."""
    return bisect(lambda e: ocv_model_soc(e, plateaus) - soc, low, high)


def ocv_inverse_d1(soc: Column, plateaus: Sequence[Plateau], low: float, high: float) -> Column:
    return 1 / _once(ocv_model_inverse(soc, plateaus, low, high), lambda e: ocv_model_d1(e, plateaus))


def ocv_inverse_d2(soc: Column, plateaus: Sequence[Plateau], low: float, high: float) -> Column:
    rise = lambda e: _once(ocv_model_d1(e, plateaus), lambda d1: -ocv_model_d2(e, plateaus) / (d1 * d1 * d1))
    return _once(ocv_model_inverse(soc, plateaus, low, high), rise)


def ocv_a_from_gamma(gamma: Column) -> Column:
    """Fixed values of the published relation."""
    return 0.0789207 / (gamma - 0.08048093)


def soc_adjust(x: Column, start: Column | float, end: Column | float) -> Column:
    return F.lit(start) + x * (F.lit(end) - F.lit(start)) if not isinstance(start, Column) else start + x * (end - start)


def soc_other(x: Column, offset: float, scale: float) -> Column:
    return offset - scale * x


def soc_from_ocv(voltage: Column, positive: Callable[[Column], Column], negative: Callable[[Column], Column], low: float = 0.0, high: float = 1.0) -> Column:
    """The cell SOC at which positive minus negative OCV (falling with it) is the voltage."""
    return bisect(lambda s: positive(s) - negative(s) - voltage, low, high)


def piecewise_curve(x: Column, pieces: Sequence[tuple[float, float, Sequence[float]]], tanhs: Sequence[tuple[float, float, float]] = ()) -> Column:
    """Polynomials (highest power first, Horner) on [low, high) plus sums of height * tanh(steepness * (x - centre)); null elsewhere."""
    value = F.lit(None).cast("double")
    for low, high, coefficients in reversed(pieces):
        poly = F.lit(float(coefficients[0]))
        for c in coefficients[1:]:
            poly = poly * x + c
        value = F.when((x >= low) & (x < high), poly).otherwise(value)
    for height, steepness, centre in tanhs:
        value = value + height * F.tanh(steepness * (x - centre))
    return value


def cell_capacity(fraction: Column, length: Column, width: Column, height: Column, c_max: Column) -> Column:
    return fraction * length * width * height * c_max * FARADAY


def exchange_current(k: Column, c_e: Column, c_s: Column, c_max: Column, alpha: float = 0.5) -> Column:
    return k * F.pow(c_e, 1 - alpha) * F.pow(c_s, alpha) * F.pow(c_max - c_s, 1 - alpha)


def exchange_current_d(k: Column, c_e: Column, c_s: Column, c_max: Column, alpha: float = 0.5) -> Column:
    """Derivative by the electrolyte concentration."""
    return (1 - alpha) * k * F.pow(c_e, -alpha) * F.pow(c_s, alpha) * F.pow(c_max - c_s, 1 - alpha)


def excitation_signal(t: Column, constant: float, sines: Sequence[tuple[float, float]]) -> Column:
    """constant + sum of amplitude * sin(2 pi f t)."""
    return F.lit(constant) + _sum([a * F.sin(6.283185307179586 * f * t) for a, f in sines])


def gitt_diffusivity(i: Column, tau: Column, d_soc: Column, d_us: Column, d_ut: Column, scale: float) -> Column:
    """scale * I^2 tau / dSOC^2 * (dUs / dUt)^2."""
    return scale * i * i * tau / (d_soc * d_soc) * F.pow(d_us / d_ut, 2)


def gitt_bounds(d_us: Column, d_ut: Column, resolution: float) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """The pairs (dUs, dUt) for the lower and upper bound: moved by the voltage resolution towards and away from zero."""
    towards = lambda c: F.signum(c) * (F.abs(c) - resolution)
    away = lambda c: F.signum(c) * (F.abs(c) + resolution)
    return (towards(d_us), away(d_ut)), (away(d_us), towards(d_ut))


def gitt_diffusivity_slope(i: Column, d_ocv: Column, root_slope: Column, scale: float) -> Column:
    """scale * I^2 * (dOCV/dSOC / (dU/dsqrt(t)))^2."""
    return scale * i * i * F.pow(d_ocv / root_slope, 2)


def joint_resistance(rows: Sequence[tuple[float, float, float, Column]], area: float, temperature: float = 298.15) -> Column:
    """RT/(F A) * sum of 1 / (z a L i0)."""
    return GAS * temperature / (FARADAY * area) * _sum([1 / (z * a * length * i0) for z, a, length, i0 in rows])
