"""Audio and picture filters over ordered samples and pixel grids.

Filters with a finite reach are windows over blocks; those with feedback are state
machines, scanned in parallel block by block (:mod:`.scan`).
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocked, scan

def noise_gate(samples: DataFrame, by: str, order: str, threshold: float = 0.05, attack: int = 4, hold: int = 16, release: int = 16, width: int = blocked.ORDINALS) -> DataFrame:
    """Opens over ``attack`` samples above the threshold, stays ``hold``, closes over ``release``."""
    return scan.run(samples, by, order, scan.Gate(threshold, attack, hold, release), width=width)


def echo(samples: DataFrame, by: str, order: str, delay: int, mix: float, feedback: float = 0.0, width: int = blocked.ORDINALS) -> DataFrame:
    """Delayed copies: without feedback a window over blocks, with it a recurrence.

    Samples ``delay`` apart are a stream of their own, in which the delay line is the
    last sample and what came back to it.
    """
    rows = blocked.running(samples, by, order, width, _n=("count_before", F.lit(1)))
    if feedback == 0:
        block = max(width, delay)
        w = Window.partitionBy(by, "_block").orderBy("_n")
        late = F.coalesce(F.lag("value", delay).over(w), F.lit(0.0))
        return blocked.with_halo(rows, "_n", delay, block).withColumn("value", F.col("value") + mix * late).where("_own").drop("_n", "_block", "_own")
    line = scan.Linear(np.array([[feedback]]), np.array([1.0]), np.array([[mix]]), np.array([1.0]))
    dealt = rows.select(by, order, "value", F.floor(F.col("_n") / delay).alias("_turn"), F.pmod("_n", F.lit(delay)).alias("_voice"))
    heard = scan.run(dealt, [by, "_voice"], "_turn", line, width=width)
    return dealt.drop("value").join(heard, [by, "_voice", "_turn"]).select(by, order, "value")


def biquad_coefficients(kind: str, freq: float, rate: float, q: float = 0.7071, gain_db: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of the usual second-order sections, a[0] = 1."""
    w, amp = 2 * np.pi * freq / rate, 10 ** (gain_db / 40)
    c, alpha = np.cos(w), np.sin(w) / (2 * q)
    if kind == "lowpass":
        b, a = [(1 - c) / 2, 1 - c, (1 - c) / 2], [1 + alpha, -2 * c, 1 - alpha]
    elif kind == "highpass":
        b, a = [(1 + c) / 2, -1 - c, (1 + c) / 2], [1 + alpha, -2 * c, 1 - alpha]
    elif kind == "bandpass":
        b, a = [alpha, 0, -alpha], [1 + alpha, -2 * c, 1 - alpha]
    elif kind == "notch":
        b, a = [1, -2 * c, 1], [1 + alpha, -2 * c, 1 - alpha]
    elif kind == "allpass":
        b, a = [1 - alpha, -2 * c, 1 + alpha], [1 + alpha, -2 * c, 1 - alpha]
    elif kind == "peak":
        b, a = [1 + alpha * amp, -2 * c, 1 - alpha * amp], [1 + alpha / amp, -2 * c, 1 - alpha / amp]
    elif kind in ("lowshelf", "highshelf"):
        s, root = 1 if kind == "lowshelf" else -1, 2 * np.sqrt(amp) * alpha
        b = [amp * (amp + 1 - s * (amp - 1) * c + root), s * 2 * amp * (amp - 1 - s * (amp + 1) * c), amp * (amp + 1 - s * (amp - 1) * c - root)]
        a = [amp + 1 + s * (amp - 1) * c + root, -s * 2 * (amp - 1 + s * (amp + 1) * c), amp + 1 + s * (amp - 1) * c - root]
    else:
        raise ValueError(f"unknown section {kind}")
    return np.array(b) / a[0], np.array(a) / a[0]


def biquad(samples: DataFrame, by: str, order: str, kind: str, freq: float, rate: float, q: float = 0.7071, gain_db: float = 0.0, width: int = blocked.ORDINALS) -> DataFrame:
    return scan.run(samples, by, order, scan.section(*biquad_coefficients(kind, freq, rate, q, gain_db)), width=width)


def equalizer(samples: DataFrame, by: str, order: str, rate: float, bands: list[tuple[str, float, float, float]], width: int = blocked.ORDINALS) -> DataFrame:
    """Second-order sections (kind, freq, q, gain_db) one after another, in one reading of the samples."""
    machine = None
    for kind, freq, q, gain_db in bands:
        one = scan.section(*biquad_coefficients(kind, freq, rate, q, gain_db))
        machine = one if machine is None else machine.then(one)
    return samples if machine is None else scan.run(samples, by, order, machine, width=width)


def state_variable(samples: DataFrame, by: str, order: str, freq: float, rate: float, q: float = 0.7071, width: int = blocked.ORDINALS) -> DataFrame:
    """(by, order, low, band, high): three outputs of one state-variable filter with trapezoidal integrators."""
    g, k = np.tan(np.pi * freq / rate), 1 / q
    a1 = 1 / (1 + g * (g + k))
    a2, a3 = g * a1, g * g * a1
    A = np.array([[2 * a1 - 1, -2 * a2], [2 * a2, 1 - 2 * a3]])
    C = np.array([[a2, 1 - a3], [a1, -a2], [-k * a1 - a2, k * a2 - 1 + a3]])
    machine = scan.Linear(A, np.array([2 * a2, 2 * a3]), C, np.array([a3, a2, 1 - k * a2 - a3]), ("low", "band", "high"))
    return scan.run(samples, by, order, machine, width=width)


def crossover(samples: DataFrame, by: str, order: str, freq: float, rate: float, width: int = blocked.ORDINALS) -> DataFrame:
    """(by, order, low, high): two bands of fourth order, each two equal sections, which add up to an all-pass."""
    low, high = (scan.section(*biquad_coefficients(kind, freq, rate, np.sqrt(0.5))) for kind in ("lowpass", "highpass"))
    return scan.run(samples, by, order, low.then(low).beside(high.then(high), ("low", "high")), width=width)


def spectrogram(samples: DataFrame, by: str, order: str, width: int = 256, hop: int = 128) -> DataFrame:
    """(by, frame, bin, power): windowed magnitudes of overlapping frames.

    Samples are dealt to the frames that hold them before grouping, so a frame, not
    a stream, is the unit of work.
    """
    window = np.hanning(width)
    last = F.floor(F.col(order) / hop)
    first = F.greatest(F.ceil((F.col(order) - (width - 1)) / hop), F.lit(0))
    dealt = samples.select(by, order, F.col("value").cast("double").alias("value"), F.explode(F.sequence(first, last)).alias("frame"))

    def transform(key: tuple, rows: pa.Table) -> pa.Table:
        block = np.zeros(width)
        at = rows.column(order).to_numpy() - key[1].as_py() * hop
        block[at] = rows.column("value").to_numpy()
        power = np.abs(np.fft.rfft(block * window)) ** 2
        n = len(power)
        return pa.table({by: pa.array([key[0].as_py()] * n), "frame": pa.array([key[1].as_py()] * n), "bin": pa.array(range(n), pa.int32()), "power": pa.array(power)})

    kind = samples.select(by).schema[0].dataType.simpleString()
    return dealt.groupBy(by, "frame").applyInArrow(transform, f"{by} {kind}, frame long, bin int, power double")


def _inside(sent: DataFrame, size: tuple[int, int] | None) -> DataFrame:
    """What is sent to places of a picture of ``size`` (width, height); all of it where that is unknown."""
    return sent if size is None else sent.where(F.col("x").between(0, size[0] - 1) & F.col("y").between(0, size[1] - 1))


def convolve(pixels: DataFrame, by: str, kernel: list[list[float]], edge: str = "zero", size: tuple[int, int] | None = None) -> DataFrame:
    """(by, x, y, value): a small kernel by scattering every pixel to its neighbours, one grouped sum.

    With the pictures' ``size``, no sum is begun for places beyond their edges.
    """
    ry, rx = len(kernel) // 2, len(kernel[0]) // 2
    taps = F.array(*(F.struct(F.lit(j - rx).alias("dx"), F.lit(i - ry).alias("dy"), F.lit(float(k)).alias("k")) for i, row in enumerate(kernel) for j, k in enumerate(row) if k))
    spread = pixels.select(by, "x", "y", "value", F.explode(taps).alias("t"))
    moved = spread.select(by, (F.col("x") - F.col("t.dx")).alias("x"), (F.col("y") - F.col("t.dy")).alias("y"), (F.col("value") * F.col("t.k")).alias("v"), F.when((F.col("t.dx") == 0) & (F.col("t.dy") == 0), True).alias("here"))
    sums = _inside(moved, size).groupBy(by, "x", "y").agg(F.sum("v").alias("value"), F.max("here").alias("here"))
    return sums.where("here").select(by, "x", "y", "value") if kernel[ry][rx] else sums.join(pixels.select(by, "x", "y"), [by, "x", "y"]).select(by, "x", "y", "value")


BOX_BLUR = [[1 / 9] * 3] * 3


def gaussian(sigma: float) -> list[float]:
    """Weights of a bell curve out to three times its width."""
    reach = max(1, int(np.ceil(3 * sigma)))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return (weights / weights.sum()).tolist()


EDGE_X, EDGE_Y = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]


def _neighbours(pixels: DataFrame, by: str, reach: int, weights: dict[str, list[list[float]]] | None = None) -> DataFrame:
    """Every pixel sent to those within ``reach``: (by, x, y, value, here, and a weight column for each kernel)."""
    steps = range(-reach, reach + 1)
    taps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), *(F.lit(float(k[dy + reach][dx + reach])).alias(name) for name, k in (weights or {}).items())) for dy in steps for dx in steps))
    spread = pixels.select(by, "x", "y", "value", F.explode(taps).alias("t"))
    return spread.select(by, (F.col("x") - F.col("t.dx")).alias("x"), (F.col("y") - F.col("t.dy")).alias("y"), "value", ((F.col("t.dx") == 0) & (F.col("t.dy") == 0)).alias("here"), *(F.col(f"t.{name}").alias(name) for name in weights or {}))


def edges(pixels: DataFrame, by: str, size: tuple[int, int] | None = None) -> DataFrame:
    """Gradient magnitude of two 3 x 3 derivatives, both from one grouped sum; ``size`` as for convolve()."""
    sent = _inside(_neighbours(pixels, by, 1, {"kx": EDGE_X, "ky": EDGE_Y}), size)
    sums = sent.groupBy(by, "x", "y").agg(F.sum(F.col("value") * F.col("kx")).alias("gx"), F.sum(F.col("value") * F.col("ky")).alias("gy"), F.bool_or("here").alias("here"))
    return sums.where("here").select(by, "x", "y", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2).alias("value"))


def gabor(wavelength: float, theta: float, sigma: float, phase: float = 0.0) -> list[list[float]]:
    """A wave of one direction under a bell, for convolve(): it answers stripes of this width and slope."""
    reach = max(1, int(np.ceil(2.5 * sigma)))
    y, x = np.mgrid[-reach : reach + 1, -reach : reach + 1]
    along = x * np.cos(theta) + y * np.sin(theta)
    return (np.exp(-(x * x + y * y) / (2 * sigma * sigma)) * np.cos(2 * np.pi * along / wavelength + phase)).tolist()


def niblack(pixels: DataFrame, by: str, reach: int = 1, k: float = -0.2) -> DataFrame:
    """1 where a pixel exceeds the mean of its neighbourhood by k deviations or more, else 0; edges take the neighbours that exist."""
    sent = _neighbours(pixels, by, reach)
    stats = sent.groupBy(by, "x", "y").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.max(F.when(F.col("here"), F.col("value"))).alias("v"), F.bool_or("here").alias("here"))
    return stats.where("here").select(by, "x", "y", (F.col("v") >= F.col("m") + k * F.col("s")).cast("double").alias("value"))


def _cubic(b: float, c: float) -> Callable[[float], float]:
    """The two-parameter family of cubic kernels."""

    def weight(d: float) -> float:
        x = abs(d)
        if x < 1:
            return ((12 - 9 * b - 6 * c) * x * x * x + (-18 + 12 * b + 6 * c) * x * x + (6 - 2 * b)) / 6
        return ((-b - 6 * c) * x * x * x + (6 * b + 30 * c) * x * x + (-12 * b - 48 * c) * x + (8 * b + 24 * c)) / 6 if x < 2 else 0.0

    return weight


def _lanczos(d: float) -> float:
    x = abs(d) * np.pi
    if x < 1e-9:
        return 1.0
    return float(3 * np.sin(x) * np.sin(x / 3) / (x * x)) if abs(d) < 3 else 0.0


#: Pixels on either side, and the weight of one at a distance.
KERNELS: dict[str, tuple[int, Callable[[float], float]]] = {
    "box": (1, lambda d: float(-0.5 <= d < 0.5)),
    "bilinear": (1, lambda d: max(1 - abs(d), 0.0)),
    "hermite": (1, lambda d: max((2 * abs(d) - 3) * d * d + 1, 0.0)),
    "catmull": (2, _cubic(0.0, 0.5)),
    "mitchell": (2, _cubic(1 / 3, 1 / 3)),
    "lanczos3": (3, _lanczos),
}


def _taps(n: int, new_n: int, kind: str) -> F.Column:
    """For each of n places of a line the ones of new_n that take it: array<array<struct<at, k>>>, weights of repeated edges added up."""
    taken: list[dict[int, float]] = [{} for _ in range(n)]
    for at in range(new_n):
        f = (at + 0.5) * (n / new_n) - 0.5
        if kind == "nearest":
            near = [((2 * at + 1) * n // (2 * new_n), 1.0)]
        else:
            reach, weight = KERNELS[kind]
            low = int(np.floor(f))
            near = [(low + i, weight(f - low - i)) for i in range(1 - reach, reach + 1)]
        for old, k in near:
            place = taken[min(max(old, 0), n - 1)]
            place[at] = place.get(at, 0.0) + k
    text = json.dumps([[{"at": at, "k": k} for at, k in place.items()] for place in taken])
    return F.from_json(F.lit(text), "array<array<struct<at:int,k:double>>>")  # a constant of the plan


def resize(pixels: DataFrame, by: str, w: int, h: int, new_w: int, new_h: int, kind: str = "nearest") -> DataFrame:
    """Each old pixel is sent to the new ones under whose kernel it lies, one grouped sum: nearest, or one of KERNELS.

    Beyond the edges the outermost pixels repeat; when a picture shrinks the kernel
    is not widened.  Sums begin in the tasks that read the pixels, and nothing is
    joined, so nothing is broadcast however many pictures there are.
    """
    if kind != "nearest" and kind not in KERNELS:
        raise ValueError(f"unknown kernel {kind}")
    sent = pixels.select(by, "y", "value", F.explode(F.get(_taps(w, new_w, kind), F.col("x").cast("int"))).alias("tx"))
    sent = sent.select(by, "value", "tx", F.explode(F.get(_taps(h, new_h, kind), F.col("y").cast("int"))).alias("ty"))
    sent = sent.select(by, F.col("tx.at").alias("x"), F.col("ty.at").alias("y"), "value", (F.col("tx.k") * F.col("ty.k")).alias("k"))
    return sent.groupBy(by, "x", "y").agg((F.sum(F.col("k") * F.col("value")) / F.sum("k")).alias("value"))


def resample_chroma(pixels: DataFrame, by: str, fx: int, fy: int) -> DataFrame:
    """Mean of fx x fy blocks: 4:4:4 to 4:2:0 with (2, 2), to 4:2:2 with (2, 1)."""
    return pixels.groupBy(by, F.floor(F.col("x") / fx).alias("x"), F.floor(F.col("y") / fy).alias("y")).agg(F.avg("value").alias("value"))


def uniform_palette(level: F.Column, steps: int) -> F.Column:
    """Index of the nearest of ``steps`` even levels of a value from 0 to 1."""
    return F.least(F.lit(steps - 1), F.greatest(F.lit(0), F.round(level * (steps - 1)).cast("int")))


def median_cut(colours: DataFrame, by: str, size: int) -> DataFrame:
    """(by, slot, r, g, b): a palette from a picture's distinct colours and their counts.

    Counting comes first, so a group holds at most the colours of one picture.
    """
    counted = colours.groupBy(by, "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))

    def cut(key: tuple, rows: pa.Table) -> pa.Table:
        points = np.stack([rows.column(c).to_numpy() for c in "rgb"], 1).astype(float)
        weight = rows.column("n").to_numpy().astype(float)
        order = np.lexsort(points.T[::-1])
        boxes = [order]
        while len(boxes) < size:
            spans = [np.ptp(points[b], axis=0).max() * (len(b) > 1) for b in boxes]
            i = int(np.argmax(spans))
            if not spans[i]:
                break
            box = boxes.pop(i)
            axis = int(np.argmax(np.ptp(points[box], axis=0)))
            box = box[np.argsort(points[box, axis], kind="stable")]
            half = int(np.searchsorted(np.cumsum(weight[box]), weight[box].sum() / 2)) + 1
            half = min(max(half, 1), len(box) - 1)
            boxes += [box[:half], box[half:]]
        means = np.array([np.average(points[b], axis=0, weights=weight[b]) for b in boxes])
        n = len(means)
        return pa.table({by: pa.array([key[0].as_py()] * n), "slot": pa.array(range(n), pa.int32()), **{c: pa.array(means[:, i].copy()) for i, c in enumerate("rgb")}})

    kind = colours.select(by).schema[0].dataType.simpleString()
    return counted.groupBy(by).applyInArrow(cut, f"{by} {kind}, slot int, r double, g double, b double")


def sinc_taps(source_rate: int, target_rate: int, half: int = 16) -> tuple[np.ndarray, int, int]:
    """(taps by phase, up, down) of a windowed-sinc resampler with 2 * half taps a phase."""
    g = int(np.gcd(source_rate, target_rate))
    up, down = target_rate // g, source_rate // g
    cutoff = min(1.0, up / down)
    offset = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    window = np.cos(np.pi * offset / (2 * (half + 1))) ** 2
    taps = cutoff * np.sinc(cutoff * offset) * window
    return taps / taps.sum(1, keepdims=True), up, down


def resample(samples: DataFrame, by: str, order: str, source_rate: int, target_rate: int, half: int = 16, block: int = 4096) -> DataFrame:
    """(by, order, value) at the target rate, by polyphase windowed sinc; the input is silent outside its samples.

    An output block needs the input under it and ``half`` samples more on each side,
    so samples are dealt to the blocks that need them: the result depends neither on
    partitions nor on the block size.
    """
    taps, up, down = sinc_taps(source_rate, target_rate, half)
    last_out = lambda c: F.floor((c + half) * up / down)
    first_out = lambda c: F.greatest(F.floor((c - half) * up / down), F.lit(0))
    n = F.col(order)
    ends = samples.groupBy(by).agg((F.max(order) + 1).alias("_n"))
    dealt = samples.select(by, order, F.col("value").cast("double").alias("value"), F.explode(F.sequence(F.floor(first_out(n) / block), F.floor(last_out(n) / block))).alias("_block"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        start = key[1].as_py() * block
        at = np.arange(start, min(start + block, -(-int(rows.column("_n")[0].as_py()) * up // down)))
        base, phase = at * down // up, at * down % up
        low = int(base[0]) - half + 1 if len(at) else 0
        line = np.zeros((int(base[-1]) + half + 1 - low) if len(at) else 0)
        where = rows.column(order).to_numpy() - low
        inside = (where >= 0) & (where < len(line))
        line[where[inside]] = rows.column("value").to_numpy()[inside]
        reach = np.arange(2 * half)
        out = (line[(base - low - half + 1)[:, None] + reach] * taps[phase]).sum(1) if len(at) else np.empty(0)
        return pa.table({by: pa.array([key[0].as_py()] * len(at), key[0].type), order: pa.array(at), "value": pa.array(out)})

    kind = samples.select(by).schema[0].dataType.simpleString()
    return dealt.join(ends, by).groupBy(by, "_block").applyInArrow(run, f"{by} {kind}, {order} long, value double")


def true_peaks(samples: DataFrame, by: str, order: str, block: int = 4096, half: int = 12) -> DataFrame:
    """(by, block long, true_peak, sample_peak): the highest level between samples, by fourfold oversampling, and at them.

    Blocks are of ``block`` samples of a stream in its order; each has ``half`` more on
    either side for the interpolation, and is silent beyond the stream's ends.
    """
    taps, _, _ = sinc_taps(1, 4, half)
    rows = blocked.running(samples.select(by, order, F.col("value").cast("double").alias("value")), by, order, blocked.ORDINALS, _n=("count_before", F.lit(1)))
    n = F.col("_n")
    dealt = rows.select(by, n, "value", F.explode(F.sequence(F.greatest(F.floor((n - half) / block), F.lit(0)), F.floor((n + half - 1) / block))).alias("block"))

    def meter(key: tuple, table: pa.Table) -> pa.Table:
        low = key[1].as_py() * block
        at, x = table.column("_n").to_numpy() - low, table.column("value").to_numpy()
        own = (at >= 0) & (at < block)
        size = int(own.sum())  # the stream has no gaps, so these are the first ones of the block
        line = np.zeros(size + 2 * half - 1)
        where = at + half - 1
        inside = (where >= 0) & (where < len(line))
        line[where[inside]] = x[inside]
        peaks = [[float(np.abs(np.lib.stride_tricks.sliding_window_view(line, 2 * half) @ taps.T).max())], [float(np.abs(x[own]).max())]] if size else [[], []]
        return pa.table({by: pa.array([key[0].as_py()] * bool(size), key[0].type), "block": pa.array([key[1].as_py()] * bool(size), pa.int64()), "true_peak": pa.array(peaks[0], pa.float64()), "sample_peak": pa.array(peaks[1], pa.float64())})

    return dealt.groupBy(by, "block").applyInArrow(meter, f"{by} {samples.select(by).schema[0].dataType.simpleString()}, block long, true_peak double, sample_peak double")


def morphology(pixels: DataFrame, by: str, kind: str, reach: int = 1) -> DataFrame:
    """dilate (maximum) or erode (minimum) over the neighbours within ``reach`` that exist."""
    best = {"dilate": F.max, "erode": F.min}[kind]
    sums = _neighbours(pixels, by, reach).groupBy(by, "x", "y").agg(best("value").alias("value"), F.bool_or("here").alias("here"))
    return sums.where("here").select(by, "x", "y", "value")


def tone_map(level: F.Column, kind: str = "reinhard", white: float = 4.0) -> F.Column:
    """Light of any size as a level from 0 to 1."""
    if kind == "reinhard":
        return level * (1 + level / (white * white)) / (1 + level)
    if kind == "gamma":
        return F.pow(F.least(F.greatest(level, F.lit(0.0)), F.lit(1.0)), F.lit(1 / 2.2))
    raise ValueError(f"unknown tone map {kind}")
