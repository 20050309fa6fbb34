"""Filter audit, WARC archives and tokenizer alignment against plain Python."""

import base64
import gzip
import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from .conftest import words

WORD = r"[^\x20\x09-\x0D]+"


def audit_by_hand(rows, labels):
    """rows: (doc_id, text, source); labels: doc_id -> (quality, toxic)."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = defaultdict(list)
    for i, text, source in rows:
        t = text or ""
        w = re.findall(WORD, t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and first[t] < i,
        }
        parts[source or ""].append((frozenset(f for f in fails if fails[f]), *labels.get(i, (0, 0))))
    out = {}
    for part, docs in parts.items():
        found, total = {}, Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[0]]
                failing = sum(f in d[0] for d in docs)
                left = [d for d in left if f not in d[0]]
                total[f] += len(removed)
                found["".join(order), step] = (f, len(left), len(removed), failing - len(removed), sum(d[0] == {f} for d in docs), sum(d[1] for d in removed), sum(d[2] for d in removed))
        for (order, step), (f, *numbers) in found.items():
            out[part, order, step] = (*numbers, total[f])
    return out


def test_filter_audit(spark, docs, empty):
    from framelake.llm import filter_audit as f

    rng = random.Random(4)
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    for i in range(150):
        text = words(rng, rng.choice([5, 49, 50, 51, 80])) + rng.choice(["", " A" * rng.randint(1, 12), " $", "%", " x" * 60, " É 漢"])
        rows.append((1000 + i, text, rng.choice(["a", "b", None, ""])))
        if i % 3 == 0:
            rows.append((rng.randint(900, 1300), text, rng.choice(["a", "z"])))
    labels = {i: (rng.randint(0, 1), rng.randint(0, 1)) for i in {i for i, _, _ in rows} - {None}}
    known = spark.createDataFrame([(i, *v) for i, v in labels.items()] + [(1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).withColumns({n: F.lit(7) for n in ("part", "mask", "_id", "best", "n", "step")})
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in f.audit(frame, known).collect()}
    assert got == audit_by_hand(rows, labels)
    assert f.audit(empty, known).count() == 0 and len(got) == 600 * len({s or "" for _, _, s in rows})
    assert f.audit(frame, known.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)


def test_distinct_words_are_verified():
    """Hashes that say too much: every word has the same one."""
    from framelake.llm.filter_audit import distinct_words
    from framelake.llm.kernels import TextChunk

    texts = [b"a b a b c", b"", b"dd dd dd", b"ab cd ab", b"x", b"a"]
    chunk = TextChunk(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    want = [len(set(t.split())) for t in texts]
    assert distinct_words(chunk).tolist() == want
    assert distinct_words(chunk, np.zeros(len(chunk.starts), np.uint64)).tolist() == want
    assert distinct_words(chunk, (chunk.ends - chunk.starts).astype(np.uint64)).tolist() == want


PAGES = [
    (1, "http://www.b.com/x", "<p>same</p>"),
    (2, "http://a.com", "<p>same</p>"),
    (3, "https://u@sub.A.com:8080/Q?y#z", "ends\r\n"),
    (4, "http://a.com", "holds\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n\r\n"),
    (5, "http://a.com", "\r\n\r\n" * 50),
    (6, "http://b.com/a\r\nWARC-Type: evil", ""),
    (7, None, None),
    (8, "", "ünï 漢字 \U0001f600"),
    (9, "http://a.com", "\r" * 9 + "\n\r\n\r"),
    (10, "http://a.com/", "x" * 3_000_000),
    (None, "http://a.com", "<p>same</p>"),
    (None, "http://c.com", "alone"),
    (2, "http://a.com", "<p>same</p>"),
    (11, "not an address", "<p>same</p>"),
]


def warc_by_hand(pages, least=0):
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        ids = [j for j, _, h in pages if (h or "") == (html or "") and j is not None]
        last = max(ids, default=None)
        revisit = len(raw) >= least and last is not None and (i is None or i < last)
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def captures(spark, pages, parts=3):
    from framelake.llm import warc

    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(parts).withColumns({n: F.lit(7) for n in ("digest", "record", "best", "bytes", "refers_to")})
    return warc.page_captures(frame)


@pytest.mark.parametrize("least", [0, 8])
def test_warc_round_trip(spark, tmp_path, least):
    from framelake.llm import warc

    path = str(tmp_path / "w")
    index = warc.archived(captures(spark, PAGES), path, least).collect()
    number = lambda x: None if x in (None, "none") else int(x)
    assert sorted(((number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in index), key=str) == warc_by_hand(PAGES, least)
    ordered = sorted(index, key=lambda r: r.position)
    assert [r.position for r in ordered] == list(range(len(PAGES)))
    keys = [(r.url_key, r.captured, -1 if r.record_id == "none" else int(r.record_id)) for r in ordered]
    assert keys == sorted(keys) and ordered[0].url_key == "" and "com,a)/" in {r.url_key for r in ordered} and "com,a,sub)/q?y" in {r.url_key for r in ordered}
    texts = Counter(h or "" for _, _, h in PAGES)
    back = warc.read_archives(spark, path).where("record_type = 'response'").collect()
    assert {bytes(r.payload).decode() for r in back} == set(texts)
    # every archive is a chain of records that another reader can walk
    for file in (tmp_path / "w").glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            n = int(re.search(rb"(?m)^Content-Length: (\d+)\r?$", head)[1])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
            data = rest[n + 4 :]


def test_empty_archives(spark, tmp_path):
    from framelake.llm import warc

    assert warc.archived(captures(spark, PAGES[:1]).limit(0), str(tmp_path / "none")).count() == 0


def test_changed_archives_are_refused():
    from framelake.llm import warc

    stream = warc.RecordStream("f")
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:capture:1>\r\nWARC-Date: x\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 22"
    found = [x for piece in (head, b"Content-Length: 1", b"y") for x in stream.feed(piece)]
    assert len(found) == 1
    with pytest.raises(ValueError, match="not the one"):
        warc._row("f", *found[0], True)
    with pytest.raises(ValueError, match="no record"):
        list(warc.RecordStream("f").feed(b"HTTP/1.1 200 OK"))
    cut_off = warc.RecordStream("f")
    list(cut_off.feed(head))
    with pytest.raises(ValueError, match="inside"):
        cut_off.close()


def test_loser_tree():
    from framelake.llm.warc import LoserTree

    rng = random.Random(8)
    for k in [*range(12), 40]:
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        assert list(LoserTree(runs)) == sorted(itertools.chain(*runs))


def test_a_hot_address_is_split(spark, tmp_path):
    """A third of all captures are of one address; ranges of five rows."""
    from framelake.llm import warc

    pages = [(i, "http://hot.com/" if i % 3 == 0 else f"http://h{i % 7}.org/{i}", f"t{i % 50}") for i in range(300)]
    warc.write_archives(captures(spark, pages, 6), str(tmp_path / "w"))
    read = warc.cut(warc.read_archives(spark, str(tmp_path / "w"), payloads=False))
    index = sorted(warc.merged_index(read, 5).collect(), key=lambda r: r.position)
    keys = [(r.url_key, r.captured) for r in index]
    assert len(index) == 300 and keys == sorted(keys)


def align_by_hand(texts):
    """The label-free definition: byte offsets where both end, and every link counted one by one."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    # the byte-level alphabet, taken from the tokenizer itself
    from tokenizers.pre_tokenizers import ByteLevel

    alphabet = {}
    for point in [*range(0x800), 0x800, *range(0x1000, 0x10000, 0x1000), 0x10000, 0x40000, 0x80000, 0xC0000, 0x100000]:
        for c, b in zip(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(point))[0][0], chr(point).encode()):
            alphabet[c] = b
    docs = []
    for text in texts:
        found = None
        if text:
            want = (" " + text).encode()
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            bytes_a = [bytes(alphabet.get(c, ord("?")) for c in first.id_to_token(i)) for i in a]
            pieces = [second.id_to_piece(i) for i in b]
            bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
            if b"".join(bytes_a) == want == b"".join(bytes_b):
                ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b))
                groups, i, j = [], 0, 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    k, m = i, j
                    while k < len(a) and ends_a[k] <= end:
                        k += 1
                    while m < len(b) and ends_b[m] <= end:
                        m += 1
                    groups.append((a[i:k], b[j:m]))
                    i, j = k, m
                found = (len(a), len(b), groups)
        docs.append(found)
    count = Counter()
    for found in docs:
        count.update({(x, y) for left, right in (found[2] if found else []) for x in left for y in right})
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for found in docs:
        if found is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for left, right in found[2] for x in left for y in right]
        shown = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in found[2])
        out.append((found[0], found[1], len(found[2]), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(shown.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    odd = [None, "", " ", "\n", "a", "▁x", "\x00a\x01", "<s> </s> <unk> <0x41> <|endoftext|>", "漢字かな交じり文と English", "\U0001f600\U0001f601 emoji 👩‍👩‍👧", "é́ Å ﬁ", "  two  spaces ", "\t\n\r\x0b\x0c", "don't I'll 12345 --- !!!", "x" * 5000, "Ж" * 700, "naïve café", "नमस्ते दुनिया"]
    return odd + [words(rng, rng.randint(1, 60)) for _ in range(40)] + [" ".join(rng.choice(["the", "tokenization", "house", "2024", "Zürich", "漢", "\U0001f600"]) for _ in range(rng.randint(1, 30))) for _ in range(40)] + ["the house"] * 3


@pytest.mark.parametrize("most_pairs", [1 << 21, 40, 0])
def test_alignment(spark, texts, most_pairs):
    """All counts by broadcast, the highest forty, and none."""
    from framelake.llm import alignment

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).withColumns({n: F.lit(7) for n in ("_uid", "n", "code", "n_a", "_codes")})
    got = {r.doc_id: tuple(r)[1:] for r in alignment.link_counts(frame, most_pairs=most_pairs).collect()}
    want = align_by_hand(texts)
    for i, text in enumerate(texts):
        assert got[i] == want[i], text
    assert sum(w[0] == 0 for w in want) == 3


def test_alignment_of_the_shared_rows(spark, docs, empty):
    from framelake.llm import alignment

    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = Counter((i, *w) for (i, _), w in zip(rows, align_by_hand([t for _, t in rows])))
    assert Counter(map(tuple, alignment.link_counts(docs).collect())) == want
    assert alignment.link_counts(empty).count() == 0


def test_wide_groups_and_slices(monkeypatch):
    """Links laid out in slices, and by distinct ids, against all pairs one by one."""
    from framelake.llm import alignment as al

    rng = np.random.default_rng(1)
    na, nb = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    a, b = rng.integers(0, 20, na.sum()), rng.integers(0, 30, nb.sum())
    want, i, j = Counter(), 0, 0
    for m, n in zip(na, nb):
        want.update(int(x) * 30 + int(y) for x in a[i : i + m] for y in b[j : j + n])
        i, j = i + m, j + n
    for wide, most in ((1 << 14, 1 << 20), (10, 1 << 20), (0, 50), (1 << 14, 7)):
        monkeypatch.setattr(al, "WIDE_GROUP", wide)
        monkeypatch.setattr(al, "MOST_LINKS", most)
        codes, times = al.linked_pairs(a, b, na, nb, 30)
        assert dict(zip(codes.tolist(), times.tolist())) == want and (np.diff(codes) > 0).all()


def test_task_sums_do_not_change_counts(spark, texts, monkeypatch):
    from framelake.llm import alignment as al

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = al.cut(al.aligned(frame))
    want = {r.code: r.n for r in al.pair_counts(rows, False).collect()}
    monkeypatch.setattr(al, "TASK_PAIRS", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {r.code: r.n for r in al.pair_counts(rows, False).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
