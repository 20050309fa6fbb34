"""The pipeline against a plain Python version of every stage."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from .test_language import identify_by_hand
from .test_operators import SPACE, WORD, components_of, key, shingles


def accepted_by_hand(rows):
    found = identify_by_hand([(r.text, r.source, None) for r in rows], [(r.lang, r.text) for r in rows])
    return [r for r, f in zip(rows, found) if f.accepted or r.doc_id is None]


def mixed_by_hand(rows):
    size = {id(r): len(re.findall(WORD, r.text or "")) for r in rows}
    hashed = {id(r): int(hashlib.md5(str(r.doc_id).encode() if r.doc_id is not None else b"").hexdigest()[:15], 16) for r in rows}
    totals = Counter()
    for r in rows:
        totals[r.source] += size[id(r)]
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, rest, free = {}, sum(totals.values()), set(order)
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * totals[s]]
        target |= {s: 3.0 * totals[s] for s in over} if over else share
        rest -= sum(3 * totals[s] for s in over)
        free = free - set(over) if over else set()
    out = []
    for s in order:
        mine = [r for r in rows if r.source == s and size[id(r)]]
        if not mine:
            continue
        times = min(math.floor(target[s] / totals[s] + 1e-12), 3)
        room, extra = math.floor(target[s] - times * totals[s] + 1e-9) if times < 3 else 0, set()
        for step in range(3):
            left = sorted({hashed[id(r)] for r in mine if id(r) not in extra and (step == 0 or size[id(r)] <= room)})
            budget = room
            for h in left:
                these = [r for r in mine if hashed[id(r)] == h and id(r) not in extra and (step == 0 or size[id(r)] <= budget)]
                if sum(size[id(r)] for r in these) > room:
                    break
                room -= sum(size[id(r)] for r in these)
                extra |= {id(r) for r in these}
        out += [r for r in mine for _ in range(times + (id(r) in extra))]
    return out


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    return path


def ids(rows):
    return Counter((key(r.doc_id), r.text) for r in rows)


def test_every_stage(spark, folder):
    import corpus_pipeline as p

    from framelake.llm import packing

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in p.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"] and p.ORACLE_SQL is None
    for name, stage in p.STAGES:
        before = docs.collect()
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        got = docs.collect()
        if name == "language_id":
            want = accepted_by_hand(before)
            assert len(want) < len(before)
        elif name == "exact_dedup":
            first = {}
            for r in before:
                t = re.sub(SPACE, " ", r.text or "")
                if r.doc_id is not None:
                    first[t] = min(first.get(t, r.doc_id), r.doc_id)
            want = [r for r in before if r.doc_id is None or first[re.sub(SPACE, " ", r.text or "")] == r.doc_id]
            assert len(want) < len(before)
        elif name == "near_dedup":
            root = components_of({r.doc_id: shingles(r.text) for r in before if r.doc_id is not None})
            want = [r for r in before if r.doc_id is None or root[r.doc_id] == r.doc_id]
            assert len(want) < len(before)
        elif name == "mixing":
            want = mixed_by_hand(before)
        else:
            tokenizer = packing.TextTokenizer()
            want = Counter((key(r.doc_id), piece, start, length) for r in before for piece, (start, length) in enumerate(packing.cuts(len(tokenizer.ids(r.text or "")))))
            assert Counter((key(r.doc_id), r.piece, r.start, r.length) for r in got) == want
            continue
        assert ids(got) == ids(want) and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_gives_the_last_stage(spark, folder):
    import corpus_pipeline as p

    rows = p.run(spark, folder).collect()
    again = spark.read.parquet(f"{folder}/packing").collect()
    pick = lambda r: (key(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(pick, rows)) == Counter(map(pick, again)) and len(rows) > 0


def test_run_on_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline as p

    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_crc_is_of_little_endian_ids():
    from framelake.llm.packing import TextTokenizer

    ids = TextTokenizer().ids("hello")
    assert zlib.crc32(ids.tobytes()) == zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids)) and ids[-1] == 2
