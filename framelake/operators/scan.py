"""State machines over streams too long for one task: a parallel scan over the effects of blocks.

What a run of samples does to a machine's state is an effect, a short array of
numbers, and effects of neighbouring runs compose.  Three passes:

1. every block of samples gives its effect;
2. FAN blocks at a time are composed to groups, the groups of a stream are walked
   in order, and each group walks its blocks: the state before every block;
3. every block runs from its state.

No task holds more than a block, FAN effects, or the groups of one stream (2^12 of
them for 2^40 samples).  Within a block effects are composed by doubling, array
against array, never sample by sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .blocked import ORDINALS

#: Blocks of a group.
FAN = 1 << 12
#: Magnitudes below this are written as 0, so that no filter's tail ends in denormal numbers.
TINY = 1e-30


class Machine:
    """A state of fixed size, and what samples do to it."""

    #: The state before a stream's first sample.
    start: np.ndarray
    #: Output columns.
    outputs: tuple[str, ...] = ("value",)

    def effect(self, x: np.ndarray) -> np.ndarray:
        """The effect of the samples x, one or more."""
        raise NotImplementedError

    def compose(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def after(self, effect: np.ndarray, state: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def run(self, x: np.ndarray, state: np.ndarray) -> list[np.ndarray]:
        """An array for each output column."""
        raise NotImplementedError


@dataclass(frozen=True, eq=False)
class Linear(Machine):
    """s' = A s + B x, one output C[k] s + D[k] x a column.  An effect is (samples, state that they make of 0)."""

    A: np.ndarray
    B: np.ndarray
    C: np.ndarray
    D: np.ndarray
    outputs: tuple[str, ...] = ("value",)

    @property
    def start(self) -> np.ndarray:
        return np.zeros(len(self.A))

    def _ends(self, x: np.ndarray) -> np.ndarray:
        """The state after each sample, from 0: sums over the last 1, 2, 4, ... samples."""
        states, power, reach = np.outer(x, self.B), self.A, 1
        while reach < len(x):
            states[reach:] = states[reach:] + states[:-reach] @ power.T
            power, reach = power @ power, 2 * reach
        return states

    def effect(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], self._ends(x)[-1]])

    def compose(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        return np.concatenate([[first[0] + then[0]], np.linalg.matrix_power(self.A, int(then[0])) @ first[1:] + then[1:]])

    def after(self, effect: np.ndarray, state: np.ndarray) -> np.ndarray:
        return np.linalg.matrix_power(self.A, int(effect[0])) @ state + effect[1:]

    def run(self, x: np.ndarray, state: np.ndarray) -> list[np.ndarray]:
        before = np.zeros((len(x), len(state)))
        before[1:] = self._ends(x)[:-1]
        carried = np.zeros_like(before)  # A^i state, by doubling
        if len(x):
            carried[0], power, done = state, self.A, 1
            while done < len(x):
                step = min(done, len(x) - done)
                carried[done : done + step] = carried[:step] @ power.T
                power, done = power @ power, 2 * done
        out = (before + carried) @ self.C.T + np.outer(x, self.D)
        return [np.where(np.abs(column) < TINY, 0.0, column) for column in out.T]

    def then(self, other: Linear) -> Linear:
        """A cascade: the first output of self goes into other."""
        m, n = len(self.A), len(other.A)
        A = np.block([[self.A, np.zeros((m, n))], [np.outer(other.B, self.C[0]), other.A]])
        return Linear(A, np.concatenate([self.B, other.B * self.D[0]]), np.hstack([np.outer(other.D, self.C[0]), other.C]), other.D * self.D[0], other.outputs)

    def beside(self, other: Linear, outputs: tuple[str, ...]) -> Linear:
        """Both on one input, the outputs of self first."""
        m, n = len(self.A), len(other.A)
        A = np.block([[self.A, np.zeros((m, n))], [np.zeros((n, m)), other.A]])
        C = np.block([[self.C, np.zeros((len(self.C), n))], [np.zeros((len(other.C), m)), other.C]])
        return Linear(A, np.concatenate([self.B, other.B]), C, np.concatenate([self.D, other.D]), outputs)


def section(b: np.ndarray, a: np.ndarray) -> Linear:
    """A second-order section in its transposed direct form, a[0] = 1."""
    A = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    return Linear(A, np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]]), np.array([[1.0, 0.0]]), np.array([float(b[0])]))


def one_pole(feedback: float) -> Linear:
    """y = x + feedback * the last y."""
    return Linear(np.array([[feedback]]), np.array([1.0]), np.array([[feedback]]), np.array([1.0]))


@dataclass(frozen=True, eq=False)
class Gate(Machine):
    """Opens over ``attack`` samples above the threshold, stays ``hold``, closes over ``release``.

    The state is (gain, samples left to hold), the gain in steps of 1 / (attack *
    release), so that it is a whole number.  A run of samples holds or closes up to its first loud one,
    and what follows from there on raises, lowers and limits the gain: g to
    min(high, max(low, g + shift)).  An effect is (quiet samples before the first
    loud one, whether there is one, shift, low, high, samples left to hold).
    """

    threshold: float
    attack: int
    hold: int
    release: int

    @property
    def start(self) -> np.ndarray:
        return np.zeros(2)

    @property
    def top(self) -> int:
        return max(self.attack, 1) * max(self.release, 1)

    def _steps(self, x: np.ndarray, held: float) -> tuple[np.ndarray, float]:
        """(change of the gain at every sample, samples left to hold after them)."""
        loud = np.abs(x) >= self.threshold
        last = np.maximum.accumulate(np.where(loud, np.arange(len(x)), held - self.hold - 1))
        left = self.hold - (np.arange(len(x)) - last)
        change = np.where(loud, max(self.release, 1), np.where(left >= 0, 0, -max(self.attack, 1)))
        return change, float(max(left[-1], 0)) if len(x) else held

    def _limited(self, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shift, low, high) of the changes up to and with each sample."""
        shift, low, high = change.astype(np.int64), np.zeros(len(change), np.int64), np.full(len(change), self.top)
        reach = 1
        while reach < len(change):
            moved_low, moved_high = (np.clip(v[:-reach] + shift[reach:], low[reach:], high[reach:]) for v in (low, high))
            total = shift[:-reach] + shift[reach:]
            shift, low, high = (np.concatenate([a[:reach], b]) for a, b in ((shift, total), (low, moved_low), (high, moved_high)))
            reach *= 2
        return shift, low, high

    def effect(self, x: np.ndarray) -> np.ndarray:
        loud = np.flatnonzero(np.abs(x) >= self.threshold)
        if not len(loud):
            return np.array([len(x), 0, 0, 0, self.top, 0], float)
        change, held = self._steps(x[loud[0] :], 0.0)
        shift, low, high = self._limited(change)
        return np.array([loud[0], 1, shift[-1], low[-1], high[-1], held], float)

    def _closing(self, quiet: float, held: float) -> float:
        return -max(self.attack, 1) * max(quiet - held, 0.0)

    def compose(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        if not first[1]:
            return np.concatenate([[first[0] + then[0]], then[1:]])
        closing = self._closing(then[0], first[5])
        low, high = (np.clip(np.clip(v + closing, 0, self.top) + then[2], then[3], then[4]) for v in first[3:5])
        return np.array([first[0], 1, first[2] + closing + then[2], low, high, then[5] if then[1] else max(first[5] - then[0], 0.0)])

    def after(self, effect: np.ndarray, state: np.ndarray) -> np.ndarray:
        gain = np.clip(state[0] + self._closing(effect[0], state[1]), 0, self.top)
        gain = np.clip(gain + effect[2], effect[3], effect[4])
        return np.array([gain, effect[5] if effect[1] else max(state[1] - effect[0], 0.0)])

    def run(self, x: np.ndarray, state: np.ndarray) -> list[np.ndarray]:
        shift, low, high = self._limited(self._steps(x, state[1])[0])
        return [x * (np.clip(state[0] + shift, low, high) / self.top)]


def run(samples: DataFrame, by: str | list[str], order: str, machine: Machine, value: str = "value", width: int = ORDINALS, fan: int = FAN) -> DataFrame:
    """samples (by, order long, value) with the machine's outputs in place of the value, whatever the width of the blocks.

    A null or empty value is 0 to the machine and in its output; ``order`` is unique in
    a stream, so a block holds ``width`` samples at most; other columns are dropped.
    """
    by = [by] if isinstance(by, str) else by
    at = len(by)
    rows = samples.select(*by, F.col(order).cast("long").alias(order), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_x"))
    rows = rows.withColumn("_block", F.floor(F.col(order) / width)).withColumn("_group", F.floor(F.col("_block") / fan))
    kinds = [rows.schema[c] for c in by]
    number = lambda name: StructField(name, rows.schema["_block"].dataType)
    numbers = lambda name: StructField(name, ArrayType(DoubleType()))
    key_columns = lambda key, names: {name: pa.array([k.as_py()], k.type) for name, k in zip(names, key)}

    def effect(key: tuple, table: pa.Table) -> pa.Table:
        found = machine.effect(table.sort_by(order).column("_x").to_numpy())
        return pa.table({**key_columns(key, [*by, "_group", "_block"]), "_effect": pa.array([found.tolist()], pa.list_(pa.float64()))})

    effects = rows.groupBy(*by, "_group", "_block").applyInArrow(effect, StructType([*kinds, number("_group"), number("_block"), numbers("_effect")]))

    def compose(key: tuple, table: pa.Table) -> pa.Table:
        found = None
        for e in table.sort_by("_block").column("_effect").to_pylist():
            found = np.array(e) if found is None else machine.compose(found, np.array(e))
        return pa.table({**key_columns(key, [*by, "_group"]), "_effect": pa.array([found.tolist()], pa.list_(pa.float64()))})

    groups = effects.groupBy(*by, "_group").applyInArrow(compose, StructType([*kinds, number("_group"), numbers("_effect")]))

    def states(table: pa.Table, name: str, state: np.ndarray) -> pa.Table:
        """The state before each row of effects in the order of ``name``."""
        table, out = table.sort_by(name), []
        for e in table.column("_effect").to_pylist():
            out.append(state.tolist())
            state = machine.after(np.array(e), state)
        return table.select([*by, name]).append_column("_state", pa.array(out, pa.list_(pa.float64())))

    def walk(key: tuple, table: pa.Table) -> pa.Table:
        return states(table, "_group", machine.start)

    def walk_on(key: tuple, table: pa.Table, start: pa.Table) -> pa.Table:
        return states(table, "_block", np.array(start.column("_state")[0].as_py()))

    before_groups = groups.groupBy(*by).applyInArrow(walk, StructType([*kinds, number("_group"), numbers("_state")]))
    before_blocks = effects.groupBy(*by, "_group").cogroup(before_groups.groupBy(*by, "_group")).applyInArrow(walk_on, StructType([*kinds, number("_block"), numbers("_state")]))

    def finish(key: tuple, table: pa.Table, start: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        found = machine.run(table.column("_x").to_numpy(), np.array(start.column("_state")[0].as_py()))
        return pa.table([*(table.column(i) for i in range(at + 1)), *map(pa.array, found)], names=[*by, order, *machine.outputs])

    out = StructType([*kinds, rows.schema[order], *(StructField(name, DoubleType()) for name in machine.outputs)])
    return rows.drop("_group").groupBy(*by, "_block").cogroup(before_blocks.groupBy(*by, "_block")).applyInArrow(finish, out)
