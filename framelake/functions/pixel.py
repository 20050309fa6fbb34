"""Pixel arithmetic: colour conversion, letterboxing, dithering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed luma weights (red, blue) of the usual matrices.
MATRICES = {"bt601": (0.299, 0.114), "bt709": (0.2126, 0.0722), "bt2020": (0.2627, 0.0593)}
PIXEL_FORMATS = ("yuv420p", "yuv422p", "yuv440p", "yuv444p", "yuv420p10le", "yuv422p10le", "yuv444p10le", "yuv444p16le", "p010le", "nv12", "nv16", "nv21", "nv24", "rgb24", "bgr24", "rgba", "bgra", "rgba64le", "gray8", "gray10le", "gray12le", "gray16le", "pal8", "rgb48le", "bgr48le")


def yuv_to_rgb_709(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """Full-range BT.709 with chroma centred at 0.5."""
    cu, cv = u - 0.5, v - 0.5
    return y + 1.5748 * cv, y - 0.1873 * cu - 0.4681 * cv, y + 1.8556 * cu


def rgb_to_yuv(r: Column, g: Column, b: Column, matrix: str = "bt709") -> tuple[Column, Column, Column]:
    kr, kb = MATRICES[matrix]
    y = kr * r + (1 - kr - kb) * g + kb * b
    return y, (b - y) / (2 * (1 - kb)) + 0.5, (r - y) / (2 * (1 - kr)) + 0.5


def gray_of(r: Column, g: Column, b: Column, matrix: str = "bt709") -> Column:
    kr, kb = MATRICES[matrix]
    return kr * r + (1 - kr - kb) * g + kb * b


#: Order of a pixel's stored values: red, green, blue, alpha; luma and chroma; gray.
STORED = {
    **{name: "rgb" for name in ("rgb24", "rgb48le")},
    **{name: "bgr" for name in ("bgr24", "bgr48le")},
    **{name: "rgba" for name in ("rgba", "rgba64le")},
    "bgra": "bgra",
    **{name: "yuv" for name in ("yuv420p", "yuv422p", "yuv440p", "yuv444p", "nv12", "nv16", "nv24", "yuv420p10le", "yuv422p10le", "yuv444p10le", "yuv444p16le", "p010le")},
    "nv21": "yvu",
    **{name: "g" for name in ("gray8", "gray10le", "gray12le", "gray16le")},
}
#: Chroma samples of formats that share them: columns and rows of pixels.
SHARED_CHROMA = {"yuv420p": (2, 2), "nv12": (2, 2), "nv21": (2, 2), "yuv420p10le": (2, 2), "p010le": (2, 2), "yuv422p": (2, 1), "yuv422p10le": (2, 1), "nv16": (2, 1), "yuv440p": (1, 2)}
#: Bits of a stored value where they are not 8, and the place of its lowest bit where that is not 0.
BITS = {"rgb48le": 16, "bgr48le": 16, "rgba64le": 16, "gray16le": 16, "yuv444p16le": 16, "yuv420p10le": 10, "yuv422p10le": 10, "yuv444p10le": 10, "p010le": 10, "gray10le": 10, "gray12le": 12}
SHIFTED = {"p010le": 6}


def value_step(name: str) -> int:
    """How far two neighbouring stored values lie apart."""
    return 1 << SHIFTED.get(name, 0)


def top_value(name: str) -> int:
    """The largest stored value of a format, in its steps."""
    return (1 << BITS.get(name, 8)) - 1


def _by_format(name: Column, values: dict[str, object]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), name)


def unit_values(stored: Column, name: Column, limited: bool = False) -> Column:
    """A pixel's stored values as struct(order, v): 0 to 1 each, luma and chroma of a limited range spread out; null for a format that is not known."""
    values = F.transform(stored, lambda v: v / _by_format(name, {f: float(top_value(f) * value_step(f)) for f in STORED}))
    order = _by_format(name, STORED)
    if limited:
        unit = _by_format(name, {f: (top_value(f) + 1) / 256 / top_value(f) for f in STORED})
        spread = F.transform(values, lambda v, i: F.when(i == 0, (v - 16 * unit) / (219 * unit)).otherwise((v - 128 * unit) / (224 * unit) + 0.5))
        values = F.when(F.contains(order, F.lit("y")), spread).otherwise(values)
    return F.when(order.isNotNull(), F.struct(order.alias("order"), values.alias("v")))


def rgb_of(unit: Column, matrix: str = "bt709", exact: bool = False) -> Column:
    """struct(r, g, b, a) of unit_values(): one branch an order of values, however many formats have it.

    exact: the matrix by its weights; else full-range BT.709 by its usual coefficients.
    """
    v = lambda i: F.get(unit["v"], i)
    kr, kb = MATRICES[matrix]

    def colours(order: str) -> Column:
        part = {c: v(i) for i, c in enumerate(order)}
        if "y" in part and exact:
            red, blue = part["y"] + 2 * (1 - kr) * (part["v"] - 0.5), part["y"] + 2 * (1 - kb) * (part["u"] - 0.5)
            green = (part["y"] - kr * red - kb * blue) / (1 - kr - kb)
        elif "y" in part:
            red, green, blue = yuv_to_rgb_709(part["y"], part["u"], part["v"])
        else:
            red, green, blue = (part.get(c, part.get("g")) for c in "rgb")
        return F.struct(red.alias("r"), green.alias("g"), blue.alias("b"), part.get("a", F.lit(1.0)).alias("a"))

    return F.coalesce(*(F.when(unit["order"] == order, colours(order)) for order in dict.fromkeys(STORED.values())))


def stored_of(rgba: list[Column], name: str, matrix: str = "bt709", limited: bool = False) -> Column:
    """A pixel's stored values, rounded to the format's steps and held to its range."""
    red, green, blue, alpha = rgba
    order, top, step = STORED[name], top_value(name), value_step(name)
    if "y" in order and limited:
        # in steps from the start: a fraction of the top would be rounded once more, which moves halves
        (kr, kb), scale, luma = MATRICES[matrix], (top + 1) // 256, rgb_to_yuv(red, green, blue, matrix)[0]
        part = {"y": 16 * scale + 219 * scale * luma, "u": 128 * scale + 224 * scale * (blue - luma) / (2 * (1 - kb)), "v": 128 * scale + 224 * scale * (red - luma) / (2 * (1 - kr))}
    elif "y" in order:
        part = dict(zip("yuv", rgb_to_yuv(red, green, blue, matrix)))
    elif order == "g":
        part = {"g": gray_of(red, green, blue)}
    else:
        part = {"r": red, "g": green, "b": blue, "a": alpha}
    steps = part if "y" in order and limited else {c: v * top for c, v in part.items()}
    return F.array(*(F.least(F.lit(top), F.greatest(F.lit(0), F.round(steps[c]).cast("int"))) * step for c in order))


#: Red, green and blue of two colour maps as polynomials of the level, constant first.
COLOUR_MAPS = {
    "viridis": (
        (0.2777273272, 0.1050930431, -0.3308618287, -4.6342304990, 6.2282699363, 4.7763849977, -5.4354558559),
        (0.0054073445, 1.4046135299, 0.2148475595, -5.7991009734, 14.1799333668, -13.7451453777, 4.6458526122),
        (0.3340998053, 1.3845901626, 0.0950951630, -19.3324409563, 56.6905526007, -65.3530326334, 26.3124352495),
    ),
    "magma": (
        (-0.0021364851, 0.2516605407, 8.3537172792, -27.6687330858, 52.1761398123, -50.7685253647, 18.6557050659),
        (-0.0007496551, 0.6775232437, -3.5777195150, 14.2647307810, -27.9436060717, 29.0465828213, -11.4897735200),
        (-0.0053861279, 2.4940265993, 0.3144679030, -13.6492131881, 12.9441694424, 4.2341529938, -5.6019615087),
    ),
}


def colour_of(level: Column, colours: str = "viridis") -> list[Column]:
    """Red, green and blue of 0 to 1 for a level of 0 to 1."""
    out = []
    for coefficients in COLOUR_MAPS[colours]:
        value = F.lit(0.0)
        for c in reversed(coefficients):
            value = value * level + c
        out.append(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))
    return out


def pixel_format(name: Column) -> Column:
    """The known format of a name in any case, or null."""
    low = F.lower(name)
    return F.when(low.isin(*PIXEL_FORMATS), low)


def fit_rect(w: Column, h: Column, out_w: Column, out_h: Column) -> Column:
    """struct(x, y, w, h): the largest centred rectangle of the picture's aspect; all of it if degenerate."""
    wide = w * out_h > h * out_w
    new_h = F.round(out_w * h / w).cast("int")
    new_w = F.round(out_h * w / h).cast("int")
    bad = (w <= 0) | (h <= 0) | (out_w <= 0) | (out_h <= 0)
    fw = F.when(bad | wide, out_w).otherwise(new_w).cast("int")
    fh = F.when(bad, out_h).when(wide, new_h).otherwise(out_h).cast("int")
    half = lambda full, part: F.floor((full - part) / 2).cast("int")
    return F.struct(half(out_w, fw).alias("x"), half(out_h, fh).alias("y"), fw.alias("w"), fh.alias("h"))


def bayer_rank(x: Column, y: Column, bits: int = 3) -> Column:
    """Rank of a pixel in the ordered-dither matrix of side 2 ** bits, by interleaving the bits of x ^ y and y."""
    out = F.lit(0)
    for i in range(bits):
        a, b = F.shiftright(x.bitwiseXOR(y), i).bitwiseAND(F.lit(1)), F.shiftright(y, i).bitwiseAND(F.lit(1))
        out = out + a * (1 << (2 * (bits - 1 - i) + 1)) + b * (1 << (2 * (bits - 1 - i)))
    return out


def bayer_level(value: Column, x: Column, y: Column, levels: int) -> Column:
    """A value of 0 to 1 as one of ``levels`` steps, dithered."""
    return F.least(F.lit(levels - 1), F.floor(value * (levels - 1) + (bayer_rank(x, y) + 0.5) / 64).cast("int"))


def pq_to_linear(e: Column) -> Column:
    """SMPTE ST 2084: nonlinear signal to light, 1 = 10,000 nits."""
    m1, m2, c1, c2, c3 = 2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
    p = F.pow(e, F.lit(1 / m2))
    return F.pow(F.greatest(p - c1, F.lit(0.0)) / (c2 - c3 * p), F.lit(1 / m1))


def linear_to_pq(light: Column) -> Column:
    """The way back."""
    m1, m2, c1, c2, c3 = 2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
    p = F.pow(light, F.lit(m1))
    return F.pow((c1 + c2 * p) / (1 + c3 * p), F.lit(m2))


def hlg_to_linear(e: Column) -> Column:
    """ARIB STD-B67, inverse of the camera curve: signal to scene light of 0 to 1."""
    a, b, c = 0.17883277, 0.28466892, 0.55991073
    return F.when(e <= 0.5, e * e / 3).otherwise((F.exp((e - c) / a) + b) / 12)


def linear_to_hlg(light: Column) -> Column:
    a, b, c = 0.17883277, 0.28466892, 0.55991073
    return F.when(light <= 1 / 12, F.sqrt(3 * light)).otherwise(a * F.log(F.greatest(12 * light - b, F.lit(1e-12))) + c)


def bt1886_to_linear(v: Column, black: float = 0.0, white: float = 1.0) -> Column:
    """The reference display curve of exponent 2.4 between a black and a white luminance."""
    lo, hi = black ** (1 / 2.4), white ** (1 / 2.4)
    return F.pow(F.greatest(v * (hi - lo) + lo, F.lit(0.0)), F.lit(2.4))


def over(src: Column, src_alpha: Column, dst: Column, dst_alpha: Column) -> Column:
    """Porter-Duff source over destination, straight alpha: struct(value, alpha)."""
    alpha = src_alpha + dst_alpha * (1 - src_alpha)
    value = F.when(alpha > 0, (src * src_alpha + dst * dst_alpha * (1 - src_alpha)) / alpha).otherwise(0.0)
    return F.struct(value.alias("value"), alpha.alias("alpha"))


def letterbox_fractions(w: Column, h: Column, out_w: Column, out_h: Column) -> Column:
    """struct(sx, sy, ox, oy) of struct(num, den): the exact fractions of letterbox_uniform(), all sizes whole."""
    at_least_one = lambda c: F.greatest(c.cast("long"), F.lit(1).cast("long"))
    content, surface = w.cast("long") * at_least_one(out_h), out_w.cast("long") * at_least_one(h)
    wide = content > surface
    small, large = F.least(content, surface), F.greatest(content, surface)
    fraction = lambda num, den: F.struct(num.cast("long").alias("num"), den.cast("long").alias("den"))
    one, none = fraction(F.lit(1), F.lit(1)), fraction(F.lit(0), F.lit(1))
    grown, rest = fraction(large, small), fraction(large - small, 2 * large)
    return F.struct(
        F.when(wide, one).otherwise(grown).alias("sx"),
        F.when(wide, grown).otherwise(one).alias("sy"),
        F.when(wide, none).otherwise(rest).alias("ox"),
        F.when(wide, rest).otherwise(none).alias("oy"),
    )


def letterbox_uniform(w: Column, h: Column, out_w: Column, out_h: Column) -> Column:
    """struct(sx, sy, ox, oy): scale and offset that fit a picture's aspect into a surface; null for a side of a size of 0."""
    exact = letterbox_fractions(w, h, out_w, out_h)
    return F.struct(*((exact[c]["num"] / F.nullif(exact[c]["den"], F.lit(0))).alias(c) for c in ("sx", "sy", "ox", "oy")))


def plane_tight(data: Column, stride: Column, w: Column, h: Column) -> Column:
    """A plane without the padding of its rows; rows that the data does not hold are left out."""
    whole = F.least(h, F.when(F.octet_length(data) >= w, F.floor((F.octet_length(data) - w) / F.greatest(stride, F.lit(1))) + 1).otherwise(0)).cast("int")
    rows = F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda r: F.substring(data, r * stride + 1, w))).otherwise(F.array().cast("array<binary>"))
    return F.aggregate(rows, F.lit(b""), lambda a, x: F.concat(a, x))


def planes_or_gray(planes: Column, w: Column, h: Column) -> Column:
    """The three planes of 4:2:0, or mid-gray ones where a conversion failed (null)."""
    gray = lambda n: F.unhex(F.repeat(F.lit("80"), n.cast("int")))
    chroma = F.floor(w / 2) * F.floor(h / 2)
    return F.coalesce(planes, F.array(gray(w * h), gray(chroma), gray(chroma)))
