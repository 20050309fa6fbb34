"""Language identification against plain Python: all evidence, on documents and pages, and its accuracy."""

import math
import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import language_id as l


def trigram_buckets(text):
    data = (text or "").encode()
    fold = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in data)
    return [(int.from_bytes(fold[i : i + 3], "big") * 2654435761 & 0xFFFFFFFF) >> 18 for i in range(len(fold) - 2) if sum(c != 32 for c in fold[i : i + 3]) >= 2]


def identify_by_hand(rows, labelled):
    """rows: (text, host, declared); labelled: (language, text)."""
    table = defaultdict(lambda: np.zeros(l.BUCKETS))
    for lang, text in labelled:
        grams = trigram_buckets(text)
        if lang is not None and grams:
            np.add.at(table[lang], grams, 1)
    languages = sorted(table)
    k = len(languages)
    logs = {lang: np.log((1 - l.UNSEEN) * table[lang] / table[lang].sum() + l.UNSEEN / l.BUCKETS) for lang in languages}
    seen = []
    for text, host, declared in rows:
        grams = trigram_buckets(text)
        n = min(len(grams), l.EFFECTIVE_GRAMS)
        sums = [logs[lang][grams].sum() * n / max(len(grams), 1) for lang in languages]
        clear = len(grams) >= l.LEAST_GRAMS and max(sums) > n * l.UNKNOWN_LOG
        vote = int(np.argmax(sums)) if clear else None
        said = None if declared is None else declared if declared in languages else "other"
        seen.append((len(grams), n * l.UNKNOWN_LOG, sums, vote, said, host))
    base = np.array([sum(v == i for _, _, _, v, _, _ in seen) + 1.0 for i in range(k)])
    base /= base.sum()
    confusion = Counter((said, vote) for _, _, _, vote, said, _ in seen)
    counts = {level: defaultdict(lambda: np.zeros(k)) for level in ("host", "domain", "suffix")}

    def levels(host):
        labels = host.split(".")
        out = [("host", host)]
        if len(labels) > 2:
            out.append(("domain", ".".join(labels[-2:])))
        if len(labels) > 1:
            out.append(("suffix", labels[-1]))
        return out

    for _, _, _, vote, _, host in seen:
        if host is not None and vote is not None:
            for level, name in levels(host):
                counts[level][name][vote] += 1
    out = []
    for n, unknown, sums, vote, said, host in seen:
        prior = base
        if host is not None and host in counts["host"]:
            for level, name in reversed(levels(host)):
                c = counts[level][name]
                prior = (c + l.PARENT_ROWS * prior) / (c.sum() + l.PARENT_ROWS)
        total = np.array(sums) + np.log(prior)
        if said is not None:
            total += [math.log((confusion[said, i] + 0.5) / (sum(confusion[x, i] for x in [*languages, "other"]) + 0.5 * (k + 1))) for i in range(k)]
        best = int(np.argmax(total))
        posterior = round(1 / np.exp(total - total.max()).sum(), 6)
        accepted = n >= l.LEAST_GRAMS and posterior >= l.MIN_POSTERIOR and sums[best] > unknown
        out.append(SimpleNamespace(language=languages[best], posterior=posterior, accepted=accepted, vote=None if vote is None else languages[vote]))
    return out


def plain(html):
    if html is None:
        return None
    out, at = "", 0
    while at < len(html):
        closed = re.compile(r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>").match(html, at)
        if closed:
            end = closed.end()
        elif re.compile(r"(?i)<!--|<(script|style)\b").match(html, at):
            end = len(html)
        elif re.compile(r"(?i)<[a-z/!?]").match(html, at):
            end = html.find(">", at) + 1 or len(html)
        elif entity := re.compile(r"&[a-zA-Z#0-9]{1,8};").match(html, at):
            end = entity.end()
        else:
            out, at = out + html[at], at + 1
            continue
        out, at = out + " ", end
    return out


def declared(html):
    root = re.search(r"(?i)<html\b[^>]*", html or "")
    found = re.search(r"(?i)\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", root[0]) if root else None
    return found[1].lower() if found else None


def host(url):
    found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", url or "")
    return found[1].lower() if found else None


WORDS = {"en": "the cat and dog are in this house with that man of", "fr": "le chat et chien sont dans la maison avec cet homme du", "de": "die katze und der hund sind in dem haus mit diesem mann"}


def test_pages_by_hand(spark):
    """Declared languages, known and other, addresses of one to four labels, none, nulls."""
    labelled = [(i, lang, text) for i, (lang, text) in enumerate(list(WORDS.items()) * 30)] + [(900, None, "zzz"), (901, "xx", None)]
    hosts = ["www.a.fr", "b.fr", "intranet", "x.y.co.uk", "c.com", None]
    pages = []
    for i in range(300):
        lang = ["en", "fr", "de"][i * i % 3]
        words = WORDS[lang].split()
        said = [lang, "en", "sv", None][i % 4]
        body = " ".join(words[(i * j) % len(words)] for j in range(1, 2 + i % 9))
        head = "<html>" if said is None else f"<html class=x lang='{said}-XX'>"
        name = hosts[i % len(hosts)]
        pages.append((i, f"{head}<script>var the = 1</script><p>{body}&nbsp;</p>", None if name is None else f"https://u@{name}:8080/p?q"))
    pages += [(300, None, None), (301, "", "nonsense"), (302, "<html lang=fr>", "http://b.fr"), (303, "<p>съешь ещё этих мягких булок", "http://b.fr"), (300, None, None)]
    model = l.TextModel.learn(spark.createDataFrame(labelled, "doc_id long, lang string, text string"), "lang", "doc_id", "text")
    got = sorted(l.identify(l.page_rows(spark.createDataFrame(pages, "page_id long, html string, url string")), model).collect(), key=lambda r: r.page_id)
    want = identify_by_hand([(plain(h), host(u), declared(h)) for _, h, u in sorted(pages, key=lambda p: p[0])], [x[1:] for x in labelled])
    assert [(r.language, r.text_language, r.accepted) for r in got] == [(w.language, w.vote, w.accepted) for w in want]
    assert [r.posterior for r in got] == pytest.approx([w.posterior for w in want], abs=2e-6)
    assert 0 < sum(r.accepted for r in got) < len(got)


OPENERS = ["<!--", "<script>", "<script ", "<style>", "<html ", "<html lang ", "<a ", "<", "</", "<!", "&", "&a", "</script", "<script></script ", "<html lang=", "<a href='"]


def test_markup_by_hand(spark):
    """Random mixtures of openers and closers, and whether they are closed or not."""
    rng = random.Random(2)
    parts = [*OPENERS, ">", "-->", "</script>", "</STYLE >", "&amp;", "word ", "3 < 5 ", "'de'", "lang='fr'", "\n"]
    pages = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(2000)]
    frame = spark.createDataFrame(pages, "i int, html string").select("i", l.plain_text(F.col("html")).alias("text"), l.declared_language(F.col("html")).alias("declared"))
    for r in frame.collect():
        assert (r.text, r.declared) == (plain(pages[r.i][1]), declared(pages[r.i][1])), pages[r.i][1]


@pytest.mark.parametrize("opener", OPENERS)
def test_a_page_of_openers_takes_linear_time(spark, opener):
    size = 1 << 20
    page = spark.createDataFrame([(opener * (size // len(opener)),)], "html string").cache()
    page.count()
    read = page.select(F.length(l.plain_text(F.col("html"))).alias("n"), l.declared_language(F.col("html")).alias("lang"))
    read.collect()
    start = time.monotonic()
    read.collect()
    assert time.monotonic() - start < 1
    page.unpersist()


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the driver's tables")
def test_accuracy_on_labels_that_were_not_learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learnt = docs.where("crc32(cast(doc_id AS string)) % 5 <> 0")
    found = l.identify(l.document_rows(docs), l.TextModel.learn(learnt, "lang", "doc_id", "text"))
    rows = found.join(docs.where("crc32(cast(doc_id AS string)) % 5 = 0").select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").collect()
    assert len(rows) > 100 and sum(r.language == r.lang for r in rows) > 0.97 * len(rows)
    assert sum(r.accepted for r in rows) > 0.97 * len(rows)
