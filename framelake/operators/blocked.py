"""Running aggregates over streams too long for one task.

A stream is cut into blocks of its order; each block gives one partial result, the
partial results are added up along the stream (one row a block), and every block
then runs by itself from what came before it.  Blocks follow from the values alone,
so both readings of the rows agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ordinals of a block, and microseconds of one.
ORDINALS, MICROS = 1 << 16, 3_600_000_000


def running(rows: DataFrame, by: str | list[str], order: str | list[str], width: float, **wanted: tuple[str, Column]) -> DataFrame:
    """rows with the wanted columns: name = (kind, value).

    Kinds: count, sum, max, min, last (the last that is not null) from the stream's
    start to the row; with ``_before`` behind, to the row before; lag, the value of
    the row before.  The first order column is numeric; blocks are ``width`` of it.
    """
    by, order = [by] if isinstance(by, str) else by, [order] if isinstance(order, str) else order
    whole = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    place = F.struct(*order)
    part = {"count": lambda c: F.sum(c), "sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place))}
    kinds = {name: ("last_before" if kind == "lag" else kind) for name, (kind, _) in wanted.items()}
    value = {name: F.struct(v.alias("v")) if kind == "lag" else F.lit(1).cast("long") if kind.startswith("count") else v for name, (kind, v) in wanted.items()}
    rows = rows.withColumn("_block", F.floor(F.col(order[0]) / width)).withColumns({f"_v_{name}": v for name, v in value.items()})
    base = {name: kind.removesuffix("_before") for name, kind in kinds.items()}
    parts = rows.groupBy(*by, "_block").agg(*(part[base[name]](f"_v_{name}").alias(f"_p_{name}") for name in wanted))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_block"])), *(whole[base[name]](f"_p_{name}").over(earlier).alias(f"_c_{name}") for name in wanted))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, "_block"])]
    met = rows.join(carried, same, "left")
    here = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = {name: whole[base[name]](f"_v_{name}").over(before if kinds[name] != base[name] else here) for name in wanted}
    met = met.withColumns({f"_l_{name}": c for name, c in local.items()})

    def joined(name: str) -> Column:
        inside, carry = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if base[name] in ("count", "sum"):
            total = F.coalesce(inside + carry, inside, carry)
            return F.coalesce(total, F.lit(0)) if base[name] == "count" else total
        if base[name] in ("max", "min"):
            return (F.greatest if base[name] == "max" else F.least)(inside, carry)
        found = F.coalesce(inside, carry)
        return found["v"] if wanted[name][0] == "lag" else found

    out = met.withColumns({name: joined(name) for name in wanted})
    return out.drop("_block", *(f"_k{i}" for i in range(len(by) + 1)), *(f"_{x}_{name}" for x in "vcl" for name in wanted))


def with_halo(rows: DataFrame, n: str, before: int, width: int = ORDINALS) -> DataFrame:
    """rows numbered without gaps by n, with _block and _own: each block also has the ``before`` rows ahead of it."""
    if before > width:
        raise ValueError("a halo is no longer than a block")
    block = F.floor(F.col(n) / width)
    also = F.when(F.pmod(F.col(n), F.lit(width)) >= width - before, F.array(block, block + 1)).otherwise(F.array(block))
    return rows.withColumn("_block", F.explode(also)).withColumn("_own", F.col("_block") == F.floor(F.col(n) / width))
