"""Feature transforms as Column expressions (poly, log, arcsin; t1/t2/t3; O/Y blend)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from equilens.spec import ALPHA_O


def poly(x: Column, beta: float) -> Column:
    """sign(x) * |x|^beta."""
    return F.signum(x) * F.pow(F.abs(x), F.lit(float(beta)))


def log_t(x: Column, beta: float) -> Column:
    """|ln(|x| + 1e-5) / ln(beta)| * sign(x)."""
    return F.abs(F.log(F.abs(x) + F.lit(1e-5)) / F.lit(math.log(beta))) * F.signum(x)


def arcsin_t(x: Column, beta: float, amax: float, amin: float) -> Column:
    """With M = max|x| and m = min|x| of the column: x' = 2(x - m)/(M - m) - 1,
    result asin(|x'| / M)^beta * sign(x').  Outside the asin domain gives NaN (invalid)."""
    xs = F.lit(2.0) * (x - F.lit(amin)) / F.lit(amax - amin) - F.lit(1.0) if amax != amin \
        else F.lit(float("nan"))
    return F.pow(F.asin(F.abs(xs) / F.lit(amax)), F.lit(float(beta))) * F.signum(xs)


def base_transform(x: Column, beta: float, method: str = "poly", stats: dict | None = None) -> Column:
    if method == "poly":
        return poly(x, beta)
    if method == "log":
        return log_t(x, beta)
    if method == "arcsin":
        return arcsin_t(x, beta, stats["amax"], stats["amin"])
    raise ValueError(f"invalid transform method: {method}")


def multi_transform(x: Column, stream: list, index: int, method: str = "poly", multi: str = "t1",
                    stats: dict | None = None) -> Column:
    """t1: beta = s[i]; t2: beta = prod(s[0..i]); t3: sum over j <= i of f(x, s[j])."""
    if not isinstance(index, int) or not 0 <= index < len(stream):
        raise ValueError(f"invalid beta index: {index}")
    if multi == "t1":
        return base_transform(x, stream[index], method, stats)
    if multi == "t2":
        return base_transform(x, math.prod(stream[: index + 1]), method, stats)
    if multi == "t3":
        out = base_transform(x, stream[0], method, stats)
        for b in stream[1: index + 1]:
            out = out + base_transform(x, b, method, stats)
        return out
    raise ValueError(f"invalid multi transform: {multi}")


def numeric_change(x: Column, change: dict, stream: list, method: str = "poly", multi: str = "t1",
                   alpha: float = ALPHA_O, stats: dict | None = None) -> Column:
    """Blend of the protected-side (beta_O) and target-side (beta_Y) transforms.

    Both: alpha * f_O + (1 - alpha) * f_Y; one only: that one; index < 0: constant 1;
    neither: x unchanged.  alpha outside (0, 1) falls back to 0.8.
    """
    alpha = alpha if 0 < alpha < 1 else ALPHA_O

    def side(key):
        i = change[key]
        return F.lit(1.0) if i < 0 else multi_transform(x, stream, i, method, multi, stats)

    has_o, has_y = "beta_O" in change, "beta_Y" in change
    if has_o and has_y:
        return F.lit(alpha) * side("beta_O") + F.lit(1 - alpha) * side("beta_Y")
    if has_o:
        return side("beta_O")
    if has_y:
        return side("beta_Y")
    return x


def compose_rebin(mapping: dict) -> dict:
    """Fold an ordered re-bin map applied entry by entry (so chains cascade) into one map."""
    items = list(mapping.items())
    out = {}
    for v in mapping:
        cur = v
        for old, new in items:
            if cur == old:
                cur = new
        out[v] = cur
    return out


def rebin(x: Column, mapping: dict, dtype=None) -> Column:
    """Apply an ordered re-bin map as one lookup: coalesce(map[x], x).

    With ``dtype`` (the column's type) the map's entries are read as text and cast to it, so
    the column keeps its type whatever type the map was built in.
    """
    if dtype is not None:
        mapping = {str(k): str(v) for k, v in mapping.items()}
    final = compose_rebin(mapping)
    if not final:
        return x
    lit = (lambda v: F.lit(v).cast(dtype)) if dtype is not None else F.lit
    m = F.create_map(*[lit(k) for kv in final.items() for k in kv])
    return F.coalesce(m[x], x)
