"""Geometry columns: extents, comparison, morphing, texture transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_extents(x: Column, y: Column, z: Column, up_axis: Column, metres: Column) -> Column:
    """struct(x, y, z) in metres with Z up: Y-up swaps y and z, X-up swaps x and z."""
    ax = F.when(up_axis == "X", z).otherwise(x)
    ay = F.when(up_axis == "Y", z).otherwise(y)
    az = F.when(up_axis == "Y", y).when(up_axis == "X", x).otherwise(z)
    return F.struct((ax * metres).alias("x"), (ay * metres).alias("y"), (az * metres).alias("z"))


def approx_eq(a: Column, b: Column) -> Column:
    """Within 1e-3, or within a hundredth of the larger."""
    diff = F.abs(a - b)
    return (diff < 1e-3) | (diff < 1e-2 * F.greatest(F.abs(a), F.abs(b)))


def morph(position: Column, deltas: Column, weights: Column) -> Column:
    """position + sum of weight * delta; deltas array<array<double>> of the position's length."""
    weighted = F.arrays_zip(deltas.alias("d"), weights.alias("w"))
    return F.aggregate(weighted, position, lambda acc, t: F.zip_with(acc, t["d"], lambda a, d: a + d * t["w"]))


def uv_transform(u: Column, v: Column, offset_u: float, offset_v: float, rotation: float, scale_u: float, scale_v: float) -> Column:
    """struct(u, v): scaled, then rotated, then moved."""
    su, sv = u * scale_u, v * scale_v
    c, s = F.cos(F.lit(rotation)), F.sin(F.lit(rotation))
    return F.struct((c * su + s * sv + offset_u).alias("u"), (-s * su + c * sv + offset_v).alias("v"))


def fbx_metres(properties: Column) -> Column:
    """Metres per unit from array<struct<name, value>>: the unit scale factor, 1 if there is none, over 100."""
    named = F.filter(properties, lambda p: p["name"] == "UnitScaleFactor")
    return F.coalesce(F.get(named, 0)["value"].cast("double"), F.lit(1.0)) / 100


def morph_weights(node: Column, mesh: Column) -> Column:
    """A node's own weights override its mesh's."""
    return F.coalesce(node, mesh)


def slerp(a: Column, b: Column, t: Column) -> Column:
    """The shorter arc between two unit quaternions (arrays of 4); a line where they nearly coincide."""
    inner = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.array(inner), lambda d: _along(a, b, d, t))[0]


def _along(a: Column, b: Column, inner: Column, t: Column) -> Column:
    sign, near = F.when(inner < 0, -1.0).otherwise(1.0), F.abs(inner)
    angle = F.acos(F.least(near, F.lit(1.0)))
    close = near > 0.9995
    wa = F.when(close, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
    wb = F.when(close, t).otherwise(F.sin(t * angle) / F.sin(angle))
    return F.zip_with(a, b, lambda x, y: x * wa + y * sign * wb)
