"""The quality classifier against a plain Python version that shares no code with it but the word hashes."""

import math
import random
import re

import pytest

from framelake.llm import quality_classifier as q
from framelake.llm.kernels import TextChunk, mix64


def features(text):
    """Words are runs of letters, digits and anything beyond ASCII, or runs of other signs."""
    import numpy as np

    data = (text or "").encode()
    spans = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+", data)]
    if not spans:
        return []
    raw = np.frombuffer(data, np.uint8)
    starts, ends = (np.array(x) for x in zip(*spans))
    hashes = [int(h) for h in TextChunk(raw, np.array([0, len(raw)])).span_hash(starts, ends)]
    pairs = [(a * 0xC2B2AE3D27D4EB4F + b) % 2**64 for a, b in zip(hashes, hashes[1:])]
    return [h >> 46 for h in hashes] + [int(mix64(np.array([p], np.uint64))[0]) >> 46 for p in pairs]


def shares(buckets):
    out = {b: q.SCALE * buckets.count(b) / len(buckets) for b in set(buckets)}
    return out | {q.BUCKETS: 1.0}


def learn_by_hand(rows):
    """Weights by slot after EPOCHS of proximal updates, row by row, slot by slot."""
    z, n = {}, {}

    def weight(i):
        a, b = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(a) <= q.L1 else -math.copysign(abs(a) - q.L1, a) / ((q.BETA + math.sqrt(b)) / q.ALPHA + q.L2)

    ready = [(shares(b), y) for b, y in rows]
    for _ in range(q.EPOCHS):
        for x, y in ready:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / q.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return weight


def test_scores_by_hand(spark):
    rng = random.Random(3)
    good, bad = "calm plain words of a good page that reads well".split(), "buy!! now## cheap $$$ click win %%% ünï".split()
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) if rng.random() < 0.8 else rng.choice(good + bad) for _ in range(rng.randint(0, 25))), i % 2) for i in range(120)]
    rows += [(200, None, 1), (201, "", 0), (202, " \t\n", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = {r.doc_id: r for r in q.quality_classifier(frame.drop("quality").repartition(4), frame.drop("text")).collect()}
    order = {r.doc_id: r.o for r in frame.selectExpr("doc_id", "xxhash64(doc_id, 'order') AS o").collect()}
    learnt = sorted((r for r in rows if not got[r[0]].held_out), key=lambda r: order[r[0]])
    weight = learn_by_hand([(features(t), y) for _, t, y in learnt])
    assert 0 < len(learnt) < len(rows)
    for i, text, _ in rows:
        margin = sum(weight(at) * v for at, v in shares(features(text)).items())
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-margin)), abs=2e-6)
        assert got[i].predicted == int(got[i].score >= 0.3)
