"""The codec registry and the built-in codecs."""

import numpy as np
import pytest

from framelake.operators import registry as op
from framelake.sources import codecs
from framelake.sources.codecs import Codec, Registry, register_all


def test_resolution():
    r = Registry()
    r.register(Codec("x", "Video", decode=len, backend="hw", priority=10, hardware=True))
    r.register(Codec("x", "Video", decode=len, backend="sw", priority=100))
    r.register(Codec("x", "Video", decode=len, backend="sw2", priority=100))
    pick = lambda **k: r.resolve("x", "decode", **k).backend
    assert pick() == "hw" and pick(no_hardware=True) == "sw" and pick(require_hardware=True) == "hw"
    assert pick(usable=lambda c: c.backend not in ("hw", "sw")) == "sw2" and pick(no_hardware=True, usable=lambda c: c.hardware) == "hw"
    for bad in ({"require_hardware": True, "usable": lambda c: False}, {"usable": lambda c: False}):
        with pytest.raises(LookupError):
            pick(**bad)
    with pytest.raises(LookupError):
        r.resolve("x", "encode")


def test_rows(spark):
    r = register_all()
    rows = r.rows(spark)
    best = {x.codec: x.backend for x in op.resolve(rows.where("decode")).collect()}
    assert best["pcm_s16le"] == "builtin" and "h264" not in best
    shown = codecs.listing(rows).collect()
    assert len(shown) == len({c.codec for c in r.impls}) and shown[0].media_type == "Video" and not shown[0].decode
    assert len({c.codec for c in r.impls}) == len(r.impls)


@pytest.mark.parametrize(("codec", "step"), [("pcm_u8", 1 / 128), ("pcm_s8", 1 / 128), ("pcm_s16le", 1 / 32768), ("slin", 1 / 32768), ("pcm_s24le", 1e-6), ("pcm_s32le", 1e-6), ("pcm_f32le", 1e-6), ("pcm_f64le", 1e-6)])
def test_pcm_round_trips(spark, codec, step):
    x = np.sin(np.arange(300) / 7).astype(np.float64).tolist()
    frames = spark.createDataFrame([("u", 0, 0, x), ("u", 0, 300, [1.0, -1.0]), ("u", 0, 302, None)], "uri string, stream_index int, pts long, samples array<float>")
    r = register_all()
    back = codecs.decode_packets(codecs.encode_packets(frames, r, codec), r, codec).orderBy("pts").collect()
    assert np.abs(np.array(back[0].samples) - x).max() <= step and np.abs(np.array(back[1].samples) - [1, -1]).max() <= step and back[2].samples is None


def test_difference_codecs(spark):
    from framelake.sources import adpcm

    def by_hand(block):
        value, at = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        out = [value]
        for code in (c for b in block[4:] for c in (b % 16, b // 16)):
            step = int(adpcm.STEPS[at])
            move = step // 8 + (step if code & 4 else 0) + (step // 2 if code & 2 else 0) + (step // 4 if code & 1 else 0)
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            at = max(0, min(88, at + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(value)
        return out

    rng = np.random.default_rng(4)
    blocks = [rng.integers(0, 256, n, np.uint8).tobytes() for n in (4, 5, 256, 77)] + [b"\xff\x7f\x58\0" + b"\x77" * 40, b"\0\x80\xff\0" + b"\xff" * 40]
    assert [d.tolist() for d in adpcm.decode_ima(blocks)] == [by_hand(b) for b in blocks] and adpcm.decode_ima([]) == []
    waves = [np.round(9000 * np.sin(np.arange(n) / 9)).astype(int) for n in (1, 2, 505, 1000)]
    for wave, back in zip(waves, adpcm.decode_ima(adpcm.encode_ima(waves))):
        assert len(back) == len(wave) + (len(wave) - 1) % 2 and np.sqrt(np.mean((back[40 : len(wave)] - wave[40:]) ** 2.0)) < 400 if len(wave) > 40 else len(back) >= len(wave)
    assert adpcm.decode_delta8(bytes([0, 127, 0x9F, 0x07])).tolist() == [-128, -107, 115, 114]
    for bad in (lambda: adpcm.decode_ima([b"abc"]), lambda: adpcm.encode_ima([np.array([], int)]), lambda: adpcm.decode_delta8(b"a")):
        with pytest.raises(ValueError):
            bad()
    r = register_all()
    frames = spark.createDataFrame([("u", 0, 0, (waves[2] / 32768).tolist()), ("u", 0, 1, None), ("u", 0, 2, [0.25])], "uri string, stream_index int, pts long, samples array<float>")
    back = {x.pts: x.samples for x in codecs.decode_packets(codecs.encode_packets(frames, r, "adpcm_ima_wav"), r, "adpcm_ima_wav").collect()}
    assert back[1] is None and back[2] == [0.25] and len(back[0]) == 505


def test_packets_are_decoded_in_slices(spark):
    """No more packets at once than PACKET_ROWS, whatever the session's batches hold."""
    most = 256

    def many(blocks):
        if len(blocks) > most:
            raise ValueError(f"{len(blocks)} packets at once")
        return [np.frombuffer(b, np.uint8) for b in blocks]

    r = Registry()
    r.register(Codec("x", "Audio", decode=len, decode_many=many))
    packets = spark.range(0, 3000, 1, 2).selectExpr("'a' AS uri", "0 AS stream_index", "id AS pts", "IF(id % 7 = 0, NULL, CAST(string(id) AS BINARY)) AS data")
    got = {row.pts: row.samples for row in codecs.decode_packets(packets, r, "x").collect()}
    assert got == {n: None if n % 7 == 0 else [float(b) for b in str(n).encode()] for n in range(3000)}
