"""Difference codecs: many blocks at once, one step of all of them at a time.

A block starts with its own state, so blocks of a batch are decoded side by side;
only the samples inside a block depend on each other.
"""

from __future__ import annotations

import numpy as np

#: Quantiser steps, and how a code's low three bits move along them.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
    2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8])
#: Differences by code of the 8-bit delta codec.
DELTAS = np.array([-34, -21, -13, -8, -5, -3, -2, -1, 0, 1, 2, 3, 5, 8, 13, 21])


def _advance(codes: np.ndarray, value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sample values and step positions after one code of every block."""
    step = STEPS[at]
    move = (step >> 3) + np.where(codes & 4, step, 0) + np.where(codes & 2, step >> 1, 0) + np.where(codes & 1, step >> 2, 0)
    return np.clip(value + np.where(codes & 8, -move, move), -32768, 32767), np.clip(at + MOVES[codes & 7], 0, 88)


def decode_ima(blocks: list[bytes]) -> list[np.ndarray]:
    """16-bit samples of mono blocks: first sample, step position, a spare byte, then two codes a byte, low one first."""
    if any(len(b) < 4 for b in blocks):
        raise ValueError("a block is shorter than its header")
    counts = np.array([2 * (len(b) - 4) for b in blocks], np.int64)
    codes = np.zeros((len(blocks), int(counts.max(initial=0))), np.int64)
    value, at = np.zeros(len(blocks), np.int64), np.zeros(len(blocks), np.int64)
    for i, b in enumerate(blocks):
        value[i], at[i] = int.from_bytes(b[:2], "little", signed=True), min(b[2], 88)
        packed = np.frombuffer(b, np.uint8, offset=4)
        codes[i, : counts[i]] = np.stack([packed & 15, packed >> 4], 1).ravel()
    out = np.empty((len(blocks), codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for n in range(codes.shape[1]):
        value, at = _advance(codes[:, n], value, at)
        out[:, n + 1] = value
    return [row[: n + 1] for row, n in zip(out, counts)]


def encode_ima(blocks: list[np.ndarray]) -> list[bytes]:
    """The way back, each block from step position 0; a block of an even number of samples repeats its last one."""
    if any(len(b) == 0 for b in blocks):
        raise ValueError("a block needs a sample")
    counts = np.array([(len(b) - 1 + 1) // 2 * 2 for b in blocks], np.int64)
    wanted = np.zeros((len(blocks), int(counts.max(initial=0)) + 1), np.int64)
    for i, b in enumerate(blocks):
        wanted[i, : len(b)], wanted[i, len(b) :] = b, b[-1]
    value, at = wanted[:, 0].copy(), np.zeros(len(blocks), np.int64)
    codes = np.zeros((len(blocks), wanted.shape[1] - 1), np.uint8)
    for n in range(codes.shape[1]):
        step, away = STEPS[at], wanted[:, n + 1] - value
        size = np.minimum((np.abs(away) << 2) // step, 7)
        code = size | np.where(away < 0, 8, 0)
        codes[:, n] = code
        value, at = _advance(code, value, at)
    head = [int(b[0]).to_bytes(2, "little", signed=True) + b"\0\0" for b in blocks]
    return [h + (row[:n:2] | row[1:n:2] << 4).astype(np.uint8).tobytes() for h, row, n in zip(head, codes, counts)]


def decode_delta8(data: bytes) -> np.ndarray:
    """8-bit samples: a spare byte, the first value, then two codes a byte, high one first, summed up modulo 256."""
    if len(data) < 2:
        raise ValueError("a delta payload is shorter than its header")
    packed = np.frombuffer(data, np.uint8, offset=2)
    steps = DELTAS[np.stack([packed >> 4, packed & 15], 1).ravel()]
    return (np.frombuffer(data, np.int8, 1, 1).astype(np.int64) + np.cumsum(steps)).astype(np.int8)
