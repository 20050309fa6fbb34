"""Block scans against serial machines: any width of block, any group, the same numbers."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.operators import filters, scan

RNG = np.random.default_rng(4)


def serial_section(b, a, x):
    out, s1, s2 = [], 0.0, 0.0
    for v in x:
        y = b[0] * v + s1
        s1, s2 = b[1] * v - a[1] * y + s2, b[2] * v - a[2] * y
        out.append(y)
    return np.array(out)


def serial_gate(x, threshold, attack, hold, release):
    out, gain, held = [], 0, 0
    for v in x:
        if abs(v) >= threshold:
            gain, held = min(attack * release, gain + release), hold
        elif held:
            held -= 1
        else:
            gain = max(0, gain - attack)
        out.append(v * gain / (attack * release))
    return np.array(out)


def in_blocks(machine, x, cuts):
    """Effects composed from the left in pairs of neighbours, then every block from its state."""
    blocks = np.split(x, sorted(cuts))
    state, whole, out = machine.start, None, []
    for block in blocks:
        if len(block):
            out.append(np.stack(machine.run(block, state)))
            e = machine.effect(block)
            whole = e if whole is None else machine.compose(whole, e)
            state = machine.after(e, state)
            assert machine.after(whole, machine.start) == pytest.approx(state, rel=1e-9, abs=1e-12)
    return np.concatenate(out, 1)


SECTIONS = [("lowpass", 300, 0.7, 0), ("highpass", 5000, 0.5, 0), ("bandpass", 900, 4, 0), ("notch", 50, 30, 0), ("allpass", 700, 1, 0), ("peak", 2000, 2, 9), ("lowshelf", 200, 0.7, -6), ("highshelf", 4000, 0.7, 6)]


@pytest.mark.parametrize("kind, freq, q, gain", SECTIONS)
@settings(max_examples=25, deadline=None)
@given(cuts=st.lists(st.integers(0, 300), max_size=6))
def test_sections_in_blocks(kind, freq, q, gain, cuts):
    b, a = filters.biquad_coefficients(kind, freq, 48_000, q, gain)
    x = np.random.default_rng(len(cuts)).normal(size=300)
    assert in_blocks(scan.section(b, a), x, cuts)[0] == pytest.approx(serial_section(b, a, x), abs=1e-9)


def gain_at(kind, freq, q, gain, at):
    b, a = filters.biquad_coefficients(kind, freq, 48_000, q, gain)
    z = np.exp(-2j * np.pi * at / 48_000 * np.arange(3))
    return 20 * np.log10(abs((b @ z) / (a @ z)) + 1e-12)


def test_responses():
    """Shelves and peaks reach their gain where they should, an all-pass changes nothing."""
    assert gain_at("lowshelf", 500, 0.7, 6, 1) == pytest.approx(6, abs=0.01) and gain_at("lowshelf", 500, 0.7, 6, 20_000) == pytest.approx(0, abs=0.1)
    assert gain_at("highshelf", 500, 0.7, 6, 23_900) == pytest.approx(6, abs=0.01) and gain_at("highshelf", 500, 0.7, 6, 1) == pytest.approx(0, abs=0.01)
    assert gain_at("peak", 1000, 1, -9, 1000) == pytest.approx(-9, abs=0.01)
    assert all(gain_at("allpass", 1000, 1, 0, f) == pytest.approx(0, abs=1e-9) for f in (10, 1000, 9000))


@settings(max_examples=150, deadline=None)
@given(loud=st.lists(st.booleans(), min_size=1, max_size=60), cuts=st.lists(st.integers(0, 60), max_size=6), shape=st.tuples(st.integers(1, 5), st.integers(0, 6), st.integers(1, 5)))
def test_gates_in_blocks(loud, cuts, shape):
    x = np.where(loud, 0.75, 0.125)
    got = in_blocks(scan.Gate(0.5, *shape), x, cuts)[0]
    assert got == pytest.approx(serial_gate(x, 0.5, *shape), abs=1e-15)


def test_silence_ends_in_zeros():
    """Impulse responses are cut before they become denormal."""
    x = np.zeros(20_000)
    x[0] = 1.0
    y = scan.section(*filters.biquad_coefficients("lowpass", 1000, 48_000)).run(x, np.zeros(2))[0]
    assert y[0] > 0 and (y[-1000:] == 0).all() and not ((y != 0) & (np.abs(y) < scan.TINY)).any()


def frame(spark, streams):
    return spark.createDataFrame([(k, i, float(v)) for k, x in streams.items() for i, v in enumerate(x)], "s string, n long, value double").repartition(3)


def of(out, k, column="value"):
    return [r[column] for r in out.where(f"s = '{k}'").orderBy("n").collect()]


@pytest.mark.parametrize("width, fan", [(1 << 16, 1 << 12), (16, 3), (7, 2), (1, 5)])
def test_streams_do_not_depend_on_blocks(spark, width, fan):
    streams = {"a": RNG.normal(size=150), "b": RNG.normal(size=3), "c": [1.0]}
    b, a = filters.biquad_coefficients("bandpass", 900, 48_000, 3)
    out = scan.run(frame(spark, streams), "s", "n", scan.section(b, a), width=width, fan=fan).cache()
    for k, x in streams.items():
        assert of(out, k) == pytest.approx(serial_section(b, a, x).tolist(), abs=1e-12)
    gated = scan.run(frame(spark, streams), "s", "n", scan.Gate(1.0, 2, 3, 4), width=width, fan=fan)
    assert of(gated, "a") == pytest.approx(serial_gate(streams["a"], 1.0, 2, 3, 4).tolist())


def test_nulls_gaps_and_negative_places(spark):
    rows = [("a", -9, 1.0), ("a", -2, None), ("a", 40, 0.5), (None, 3, 2.0), (None, 9, 1.0)]
    out = scan.run(spark.createDataFrame(rows, "s string, n long, value double"), "s", "n", scan.one_pole(0.5), width=4, fan=2)
    assert [(r.s, r.n, r.value) for r in out.orderBy("s", "n").collect()] == [(None, 3, 2.0), (None, 9, 2.0), ("a", -9, 1.0), ("a", -2, 0.5), ("a", 40, 0.75)]
    assert scan.run(spark.createDataFrame([], "s string, n long, value double"), "s", "n", scan.one_pole(0.5)).count() == 0


def test_equalizer_crossover_and_state_variable(spark):
    x = RNG.normal(size=120)
    samples = frame(spark, {"a": x})
    bands = [("lowshelf", 200.0, 0.7, 3.0), ("peak", 3000.0, 2.0, -6.0), ("highpass", 40.0, 0.7, 0.0)]
    want = x
    for kind, freq, q, gain in bands:
        want = serial_section(*filters.biquad_coefficients(kind, freq, 48_000, q, gain), want)
    assert of(filters.equalizer(samples, "s", "n", 48_000, bands, width=32), "a") == pytest.approx(want.tolist(), abs=1e-10)
    split = filters.crossover(samples, "s", "n", 2000, 48_000, width=32).cache()
    low = filters.biquad_coefficients("lowpass", 2000, 48_000, np.sqrt(0.5))
    high = filters.biquad_coefficients("highpass", 2000, 48_000, np.sqrt(0.5))
    assert of(split, "a", "low") == pytest.approx(serial_section(*low, serial_section(*low, x)).tolist(), abs=1e-10)
    assert of(split, "a", "high") == pytest.approx(serial_section(*high, serial_section(*high, x)).tolist(), abs=1e-10)
    both = np.array(of(split, "a", "low")) + np.array(of(split, "a", "high"))
    assert both == pytest.approx(serial_section(*filters.biquad_coefficients("allpass", 2000, 48_000, np.sqrt(0.5)), x), abs=1e-9)
    sv = filters.state_variable(samples, "s", "n", 1500, 48_000, 0.8, width=32).cache()
    assert of(sv, "a", "low") == pytest.approx(serial_section(*filters.biquad_coefficients("lowpass", 1500, 48_000, 0.8), x).tolist(), abs=1e-9)
    assert of(sv, "a", "high") == pytest.approx(serial_section(*filters.biquad_coefficients("highpass", 1500, 48_000, 0.8), x).tolist(), abs=1e-9)


@pytest.mark.parametrize("feedback", [0.0, 0.6])
@pytest.mark.parametrize("width", [1 << 16, 5])
def test_echo_over_blocks_and_gaps(spark, feedback, width):
    x = RNG.normal(size=40)
    rows = spark.createDataFrame([("a", 3 * i + i % 2, float(v)) for i, v in enumerate(x)], "s string, n long, value double").repartition(3)
    line = x.copy()
    for i in range(4, 40):
        line[i] += feedback * line[i - 4]
    want = x.copy()
    want[4:] += 0.5 * line[:-4]
    assert of(filters.echo(rows, "s", "n", 4, 0.5, feedback, width), "a") == pytest.approx(want.tolist(), abs=1e-12)
