"""Complex numbers as pairs of columns, and impedances of circuit elements and named circuits over omega."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Z:
    """re + j im; division by zero gives null."""

    re: Column
    im: Column

    def __add__(self, o: Z) -> Z:
        return Z(self.re + o.re, self.im + o.im)

    def __sub__(self, o: Z) -> Z:
        return Z(self.re - o.re, self.im - o.im)

    def __mul__(self, o: Z) -> Z:
        return Z(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    def __truediv__(self, o: Z) -> Z:
        d = F.nullif(o.re * o.re + o.im * o.im, F.lit(0.0))
        return Z((self.re * o.re + self.im * o.im) / d, (self.im * o.re - self.re * o.im) / d)

    def abs(self) -> Column:
        return F.hypot(self.re, self.im)

    def phase(self) -> Column:
        return F.atan2(self.im, self.re)

    def struct(self) -> Column:
        return F.struct(self.re.alias("re"), self.im.alias("im"))



def real(c: Column | float) -> Z:
    return Z(c if isinstance(c, Column) else F.lit(float(c)), F.lit(0.0))


def polar(size: Column, angle: float) -> Z:
    return Z(size * F.cos(F.lit(angle)), size * F.sin(F.lit(angle)))


def resistor(r: Column) -> Z:
    return real(r)


def capacitor(c: Column, omega: Column) -> Z:
    return Z(F.lit(0.0), -1 / F.nullif(omega * c, F.lit(0.0)))


def inductor(l_: Column, omega: Column) -> Z:
    return Z(F.lit(0.0), omega * l_)


def constant_phase(q: Column, alpha: float, omega: Column) -> Z:
    """1 / (Q s)^alpha, in polar form."""
    return polar(F.pow(F.nullif(q * omega, F.lit(0.0)), F.lit(-alpha)), -alpha * pi / 2)


def warburg(q: Column, omega: Column) -> Z:
    return constant_phase(q, 0.5, omega)


def _tanh(x: Column, y: Column) -> Z:
    """tanh(x + j y) by real functions; x is held where tanh is 1."""
    double = F.least(2 * x, F.lit(300.0))
    d = F.cosh(double) + F.cos(2 * y)
    return Z(F.sinh(double) / d, F.sin(2 * y) / d)


def warburg_short(sigma: Column, tau: Column, omega: Column) -> Z:
    """sigma tanh(tau sqrt(s)) / sqrt(s)."""
    half = F.sqrt(omega / 2)
    return real(sigma) * _tanh(tau * half, tau * half) / Z(half, half)


def warburg_open(sigma: Column, tau: Column, omega: Column) -> Z:
    """sigma coth(tau sqrt(s)) / sqrt(s)."""
    half = F.sqrt(omega / 2)
    return real(sigma) / (_tanh(tau * half, tau * half) * Z(half, half))


def series(*parts: Z) -> Z:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def parallel(*parts: Z) -> Z:
    return real(1.0) / series(*[real(1.0) / p for p in parts])


def rc_chain(r0: Column, pairs: list[tuple[Column, Column]], omega: Column) -> Z:
    return series(resistor(r0), *[parallel(resistor(r), capacitor(c, omega)) for r, c in pairs])


def debye(r0: Column, r1: Column, q: Column, alpha: float, omega: Column) -> Z:
    """A resistor with a depressed semicircle."""
    return series(resistor(r0), parallel(resistor(r1), constant_phase(q, alpha, omega)))


def randles(r0: Column, r1: Column, c: Column, w: Z, omega: Column) -> Z:
    """A capacitor beside a resistor in series with a diffusion element."""
    return series(resistor(r0), parallel(capacitor(c, omega), series(resistor(r1), w)))


def drt_semicircle(r0: Column, r: Column, f_tau: Column) -> Z:
    """R0 + R / (1 + j f tau)."""
    return real(r0) + real(r) / Z(F.lit(1.0), f_tau)


#: A tree of a circuit: ("series" or "parallel", parts ...), or an element and the names of its parameters: ("R", r), ("C", c), ("L", l),
#: ("Q", q, alpha), ("W", q) of infinite, ("Wo", sigma, tau) of open and ("Ws", sigma, tau) of short diffusion.
Tree = tuple
PARTS = ("series", "parallel")


def _diffusing(end: str) -> Tree:
    return ("series", ("R", "R_CT"), (end, "sigma", "tau"))


def named_circuits(end: str = "Wo") -> dict[str, Tree]:
    """The known circuits with open (Wo) or short (Ws) diffusion."""
    interface = ("parallel", ("C", "C_DL"), _diffusing(end))
    plain = ("parallel", ("C", "C_DL"), ("R", "R_CT"))
    film = ("parallel", ("C", "C_F"), ("series", interface, ("R", "R_F")))
    return {
        "two_rc": ("series", ("R", "R_0"), ("parallel", ("R", "R_1"), ("C", "C_1")), ("parallel", ("R", "R_2"), ("C", "C_2"))),
        "debye": ("series", ("parallel", ("R", "R_B"), ("C", "C_D")), ("C", "C_DL")),
        "debye_variant": ("parallel", ("series", ("R", "R_B"), ("C", "C_DL")), ("C", "C_D")),
        "randles": ("series", ("R", "R_U"), interface),
        "randles_blocked": ("series", ("R", "R_U"), interface, ("C", "C_X")),
        "randles_serial": ("series", ("R", "R_U"), plain, (end, "sigma", "tau"), ("Q", "Q_X", "alpha")),
        "scr": ("series", ("R", "R_B"), ("parallel", ("C", "C_D"), ("series", ("R", "R_C"), interface))),
        "scrf": ("series", ("R", "R_B"), ("parallel", ("C", "C_D"), ("series", ("R", "R_C"), film))),
        "aluminium": ("series", ("R", "R_s"), ("parallel", ("C", "C_1"), ("R", "R_1"), ("series", ("L", "L_1"), ("R", "R_2"))), ("parallel", ("C", "C"), ("R", "R_3"))),
        "aluminium_variant": ("series", ("R", "R_s"), ("parallel", ("C", "C_1"), ("series", ("R", "R_1"), ("parallel", ("L", "L_1"), ("R", "R_2")))), ("parallel", ("C", "C"), ("R", "R_3"))),
    }


def _element(kind: str, a: list[Column], omega: Column) -> Z:
    if kind == "Q":
        size = F.pow(F.nullif(a[0] * omega, F.lit(0.0)), -a[1])
        return Z(size * F.cos(a[1] * pi / 2), -size * F.sin(a[1] * pi / 2))
    if kind in ("Wo", "Ws"):
        return (warburg_open if kind == "Wo" else warburg_short)(a[0], a[1], omega)
    return {"R": lambda: resistor(a[0]), "C": lambda: capacitor(a[0], omega), "L": lambda: inductor(a[0], omega), "W": lambda: warburg(a[0], omega)}[kind]()


def impedance(tree: Tree, value: Callable[[str], Column], omega: Column) -> Column:
    """struct<re, im> of a tree whose parameters ``value`` gives; each node is computed once, and null where it has none (a blocking element at omega 0)."""
    kind, *rest = tree
    if kind not in PARTS:
        return _element(kind, [value(name) for name in rest], omega).struct()

    def inverse(z: Column) -> Column:
        return (real(1.0) / Z(z["re"], z["im"])).struct()

    parts = F.array(*[impedance(x, value, omega) for x in rest])
    added = lambda zs: F.aggregate(zs, F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im")), lambda a, z: F.struct((a["re"] + z["re"]).alias("re"), (a["im"] + z["im"]).alias("im")))
    if kind == "series":
        return added(parts)
    return F.get(F.transform(F.array(added(F.transform(parts, inverse))), inverse), F.lit(0))


NODES = "circuit string, node int, parent int, kind string, names array<string>"


def tree_rows(circuit: str, tree: Tree) -> list[tuple]:
    """Rows of NODES: a node's parent has the smaller number, siblings are in order."""
    out: list[tuple] = []

    def add(t: Tree, parent: int | None) -> None:
        node, (kind, *rest) = len(out), t
        out.append((circuit, node, parent, kind, [] if kind in PARTS else list(rest)))
        for x in rest if kind in PARTS else ():
            add(x, node)

    add(tree, None)
    return out


def trees_of(rows: Iterable[tuple]) -> dict[str, Tree]:
    """The trees of such rows."""
    held: dict[str, list] = {}
    for circuit, node, parent, kind, names in rows:
        held.setdefault(circuit, []).append((node, parent, kind, names))

    def build(nodes: list, at: int) -> Tree:
        _, _, kind, names = next(n for n in nodes if n[0] == at)
        return (kind, *([build(nodes, n[0]) for n in nodes if n[1] == at] if kind in PARTS else names))

    return {c: build(sorted(nodes), min(n[0] for n in nodes)) for c, nodes in held.items()}


def _names(tree: Tree) -> list[str]:
    return [n for x in tree[1:] for n in (_names(x) if tree[0] in PARTS else [x])]


def _held(a: np.ndarray) -> np.ndarray:
    """NaN, which becomes null, instead of a zero that is divided by."""
    return np.where(a == 0, np.nan, a)


def _inverses(re: np.ndarray, im: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = _held(re * re + im * im)
    return re / d, -im / d


def _values(tree: Tree, value: Callable[[str], np.ndarray], omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """re and im of a tree over rows of parameters and frequencies: ``impedance`` on arrays."""
    kind, *rest = tree
    if kind in PARTS:
        parts = [_values(x, value, omega) for x in rest]
        if kind == "parallel":
            parts = [_inverses(*z) for z in parts]
        re, im = sum(z[0] for z in parts), sum(z[1] for z in parts)
        return _inverses(re, im) if kind == "parallel" else (re, im)
    a, none = [value(name) for name in rest], np.zeros(len(omega))
    if kind == "R":
        return a[0], none
    if kind == "C":
        return none, -1 / _held(omega * a[0])
    if kind == "L":
        return none, omega * a[0]
    if kind in ("Q", "W"):
        alpha = a[1] if kind == "Q" else 0.5
        size = _held(a[0] * omega) ** -alpha
        return size * np.cos(alpha * pi / 2), -size * np.sin(alpha * pi / 2)
    half = np.sqrt(omega / 2)
    double = 2 * a[1] * half
    d = np.cosh(np.minimum(double, 300.0)) + np.cos(double)
    re, im = np.sinh(np.minimum(double, 300.0)) / d, np.sin(double) / d
    if kind == "Wo":
        re, im = _inverses(re * half - im * half, re * half + im * half)
        return a[0] * re, a[0] * im
    back = _held(2 * half * half)
    return a[0] * (re + im) * half / back, a[0] * (im - re) * half / back


def circuit_impedance(df: DataFrame, nodes: DataFrame, circuit: str = "circuit", params: str = "params", omega: str = "omega") -> DataFrame:
    """Adds re and im to rows of a circuit's name, a map of its parameters and a frequency: each tree over a batch's rows of it, in arrays.

    ``nodes`` (NODES) is the circuits as a table, metadata of some rows for each; a name that isn't in it, or a parameter that isn't in the map
    (or is NaN), gives nulls. A row's parameters are looked up once, whatever its tree.
    """
    trees = trees_of(tuple(r) for r in nodes.select("circuit", "node", "parent", "kind", "names").collect())
    names = sorted({n for t in trees.values() for n in _names(t)})

    def evaluate(which: pd.Series, w: pd.Series, *found: pd.Series) -> pd.DataFrame:
        frequency, held = w.to_numpy(float), {n: x.to_numpy(float) for n, x in zip(names, found)}
        re, im = np.full(len(which), np.nan), np.full(len(which), np.nan)
        with np.errstate(all="ignore"):
            for name, at in which.groupby(which).indices.items():
                if name in trees:
                    re[at], im[at] = _values(trees[name], lambda n, at=at: held[n][at], frequency[at])
        return pd.DataFrame({"re": re, "im": im})

    z = F.pandas_udf(evaluate, "re double, im double")
    looked = [F.try_element_at(F.col(params), F.lit(n)).cast("double") for n in names]
    return df.withColumn("_z", z(F.col(circuit), F.col(omega).cast("double"), *looked)).withColumn("re", F.col("_z.re")).withColumn("im", F.col("_z.im")).drop("_z")
