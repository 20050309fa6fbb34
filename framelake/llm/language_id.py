"""Language identification by Bayesian fusion of evidence.

Text gives a likelihood per language under hashed trigram multinomials, learnt from
a bounded sample of labelled rows.  The markup's declared language gives another,
through a confusion table counted on all rows.  The prior comes from the address:
counts of text decisions, grouped by host, are smoothed towards those of its
domain, these towards the address suffix and these towards the whole corpus.  The
three are multiplied and normalised.  A row is accepted when it has enough text,
its best language a posterior of MIN_POSTERIOR, and its trigrams are likelier under
that language than under an unknown one, in which all buckets are equally likely.
Text of no learnt language has no vote in the priors and no text_language.

A row without an address may give any other origin as its host (a source name);
a row without either falls back on the corpus.  Hot hosts join by broadcast, of
which there are fewer than 1,000; other hosts by shuffle.

Cases: a null or empty text, or one with fewer than LEAST_GRAMS trigrams of
letters or of no learnt language, is not accepted and its language comes from the other evidence; a null
declared language or host is no evidence; repeated rows give repeated results;
a comment, script, style or tag that is not closed runs to the end of its page; a
page is read in time linear in its length, whatever it holds;
other columns are ignored; with no labelled rows every language is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import cut, join_with_hot_keys, schema_with, small_batches
from .kernels import chunks, row_sums

BUCKETS, MOST_ROWS = 1 << 14, 20_000
#: A task sends its counts of a language in pieces of CHUNK buckets, which are added up in two steps.
CHUNK, SALTS = 1 << 12, 64
#: Trigrams that count as independent evidence, at most; trigrams a text needs; the prior rows of a parent level.
EFFECTIVE_GRAMS, LEAST_GRAMS, PARENT_ROWS, MIN_POSTERIOR = 60.0, 1, 10.0, 0.5
#: Share of each language's mass spread evenly over the buckets, so that an unseen trigram weighs the same in all; the log probability of a trigram in an unknown language.
UNSEEN, UNKNOWN_LOG = 0.01, -math.log(BUCKETS)
_FOLD = np.full(256, 32, np.uint8)  # letters as they are, A-Z lower-cased, the rest a space
_FOLD[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]
_FOLD[65:91] = np.arange(97, 123)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every byte trigram with two letters or more, row bounds)."""
    if len(data) < 3:
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    folded = _FOLD[data]
    letter = (folded != 32).astype(np.int8)
    code = folded[:-2].astype(np.uint32) << np.uint32(16) | folded[1:-1].astype(np.uint32) << np.uint32(8) | folded[2:]
    ok = letter[:-2] + letter[1:-1] + letter[2:] >= 2
    for back in (1, 2):
        last = offsets[1:] - back
        last = last[(last >= offsets[:-1]) & (last < len(ok))]
        ok[last] = False
    at = np.flatnonzero(ok)
    return ((code[at] * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64), np.searchsorted(at, offsets)


#: One pass, no step of which is taken back: what opens a comment, script, style or tag and is not closed runs to the end.
_MARKUP = r"(?is)<!--(?:.*?-->|.*)|<(script|style)\b[^>]*+(?:>(?:.*?</\1\s*+>|.*)|\z)|<[a-z/!?][^>]*+(?:>|\z)|&[a-z#0-9]{1,8}+;"


def plain_text(html: Column) -> Column:
    """The text between tags, without scripts, styles and comments, in time linear in its length."""
    return F.regexp_replace(html, _MARKUP, " ")


def declared_language(html: Column) -> Column:
    """Primary subtag of the lang attribute in the first html tag, or null."""
    root = F.regexp_extract(html, r"(?i)<html\b([^>]*+)", 1)
    found = F.lower(F.regexp_extract(root, r"(?i)\blang\s*+=\s*+[\"']?([A-Za-z]{2,3})\b", 1))
    return F.when(found != "", found)


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


class TextModel:
    """Languages and the log probability of each trigram bucket under each."""

    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs

    @classmethod
    def learn(cls, rows: DataFrame, language: str, key: str, text: str, most_rows: int = MOST_ROWS) -> TextModel:
        """From labelled rows, or a hash sample of about most_rows of them."""
        labelled = small_batches(rows).where(F.col(language).isNotNull()).select(F.col(language).alias("lang"), F.col(text).alias("_text"), F.xxhash64(F.col(key), F.lit("sample")).alias("_h"))
        share = min(1.0, most_rows / max(1, labelled.count()))
        sample = labelled.where(F.pmod("_h", F.lit(1 << 30)) < int(share * (1 << 30)))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                names = np.array(batch.column(0).to_pylist(), object)
                for first, data, offsets in chunks(batch.column(1)):
                    buckets, bounds = grams(data, offsets)
                    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)) + first
                    for name in set(names[first : first + len(offsets) - 1]):
                        mine = buckets[names[owner] == name] if len(owner) else buckets
                        total[name] = total.get(name, 0) + np.bincount(mine, minlength=BUCKETS)
            salt = TaskContext.get().partitionId() % SALTS
            for name, n in total.items():
                pieces = n.astype(np.int64).reshape(-1, CHUNK)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(pieces), pa.string()), pa.array(range(len(pieces)), pa.int32()), pa.array([salt] * len(pieces), pa.int32()), pa.array([x.tobytes() for x in pieces], pa.binary())], names=["lang", "chunk", "salt", "n"])

        def add(rows: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in rows.column("n"))
            return rows.slice(0, 1).set_column(3, "n", pa.array([total.tobytes()], pa.binary()))

        schema = "lang string, chunk int, salt int, n binary"
        counted = sample.select("lang", "_text").mapInArrow(count, schema).groupBy("lang", "chunk", "salt").applyInArrow(add, schema).groupBy("lang", "chunk").applyInArrow(add, schema).collect()  # an array of BUCKETS counts a language
        languages = sorted({r.lang for r in counted})
        table = np.zeros((BUCKETS, len(languages)))
        for lang, chunk, _, n in counted:
            table[chunk * CHUNK : (chunk + 1) * CHUNK, languages.index(lang)] = np.frombuffer(bytes(n), np.int64)
        found = table.sum(0) > 0
        languages, table = [x for x, ok in zip(languages, found) if ok], table[:, found]
        return cls(languages, np.log((1 - UNSEEN) * table / table.sum(0) + UNSEEN / BUCKETS))


def text_evidence(rows: DataFrame, model: TextModel, text: str = "text") -> DataFrame:
    """rows without their text, with grams long and loglik array<double>, tempered to EFFECTIVE_GRAMS."""
    shared = rows.sparkSession.sparkContext.broadcast(model.logs)
    source = small_batches(rows).select(*[c for c in rows.columns if c != text], F.col(text).alias("_text"))
    schema = schema_with(source.drop("_text"), "grams long, loglik array<double>")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        columns = [np.ascontiguousarray(logs[:, i]) for i in range(logs.shape[1])]
        for batch in batches:
            counts, sums = [], []
            for _, data, offsets in chunks(batch.column(batch.num_columns - 1)):
                buckets, bounds = grams(data, offsets)
                counts.append(np.diff(bounds))
                sums.append(np.stack([row_sums(c[buckets], bounds) for c in columns], 1) if columns else np.zeros((len(offsets) - 1, 0)))
            n = np.concatenate(counts) if counts else np.empty(0, np.int64)
            total = np.concatenate(sums) if sums else np.zeros((0, len(columns)))
            scaled = total * (np.minimum(n, EFFECTIVE_GRAMS) / np.maximum(n, 1))[:, None]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n.astype(np.int64)), pa.array(scaled.tolist(), pa.list_(pa.float64()))], names=schema.names)

    return source.mapInArrow(weigh, schema)


def _counts(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    """Text decisions by language, as array n and their total."""
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)), *(F.sum((F.col("_vote") == i).cast("long")).alias(f"_n{i}") for i in range(size)))
    return sums.select(*by, F.array(*(F.col(f"_n{i}") for i in range(size))).alias("n"))


def _smoothed(parent: Column) -> Column:
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.zip_with("n", parent, lambda n, p: n + p * PARENT_ROWS), lambda x: x / (total + PARENT_ROWS))


def host_priors(voted: DataFrame, base: list[float]) -> DataFrame:
    """(host, hits, prior array<double>) by grouped aggregation, smoothed host < domain < suffix < corpus.

    A host of one label has no suffix and one of two is its own domain, so no count enters twice.
    """
    k = len(base)
    labels = F.split("host", r"\.")
    addressed = voted.where("host IS NOT NULL AND _vote IS NOT NULL")
    above = {"suffix": F.when(F.size(labels) > 1, F.element_at(labels, -1)), "domain": F.when(F.size(labels) > 2, F.concat_ws(".", F.slice(labels, -2, 2)))}
    hosts = cut(_counts(addressed, ["host"], k).withColumns(above))
    add_up = lambda by: hosts.where(F.col(by[0]).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)), *(F.sum(F.col("n")[i]).alias(f"_n{i}") for i in range(k))).select(*by, F.array(*(F.col(f"_n{i}") for i in range(k))).alias("n"))
    corpus = F.array(*map(F.lit, base)) if k else F.array().cast("array<double>")
    suffixes = add_up(["suffix"]).select("suffix", _smoothed(corpus).alias("_suffix_prior"))
    domains = add_up(["domain", "suffix"]).join(suffixes, "suffix").select("domain", _smoothed(F.col("_suffix_prior")).alias("_domain_prior"))
    known = hosts.join(suffixes, "suffix", "left").join(domains, "domain", "left").withColumn("_above", F.coalesce("_domain_prior", "_suffix_prior", corpus))
    return known.select("host", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("hits"), _smoothed(F.col("_above")).alias("prior"))


def identify(rows: DataFrame, model: TextModel, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """rows (any key columns, text, host, declared) with language, posterior, text_language, grams, accepted in place of text."""
    languages, k = model.languages, len(model.languages)
    weighed = text_evidence(rows, model)
    unknown = F.least("grams", F.lit(EFFECTIVE_GRAMS)) * UNKNOWN_LOG
    vote = F.when((F.col("grams") >= LEAST_GRAMS) & (F.array_max("loglik") > unknown), F.array_position("loglik", F.array_max("loglik")).cast("int") - 1)
    weighed = cut(weighed.withColumn("_vote", vote))
    names = F.array(*map(F.lit, languages)) if k else F.array().cast("array<string>")
    known = F.when(F.col("declared").isin(*languages), F.col("declared")) if k else F.lit(None).cast("string")
    weighed = weighed.withColumn("_declared", F.when(F.col("declared").isNotNull(), F.coalesce(known, F.lit("other"))))
    votes = {(r[0], r[1]): r[2] for r in weighed.groupBy("_declared", "_vote").count().collect()}  # languages ** 2 rows at most
    base = [sum(n for (_, v), n in votes.items() if v == i) + 1.0 for i in range(k)]
    base = [x / sum(base) for x in base]
    joined = join_with_hot_keys(weighed, cut(host_priors(weighed, base)), ["host"], "hits", weighed.count())
    said = F.array(*[F.lit(0.0)] * k) if k else F.array().cast("array<double>")
    for d in [*languages, "other"]:
        seen = [(votes.get((d, i), 0) + 0.5) / (sum(votes.get((x, i), 0) for x in [*languages, "other"]) + 0.5 * (k + 1)) for i in range(k)]
        said = F.when(F.col("_declared") == d, F.array(*(F.lit(math.log(p)) for p in seen))).otherwise(said)
    corpus = F.array(*map(F.lit, base)) if k else F.array().cast("array<double>")
    total = F.zip_with(F.zip_with("loglik", said, lambda a, b: a + b), F.transform(F.coalesce("prior", corpus), lambda x: F.log(x)), lambda a, b: a + b)
    fused = joined.withColumn("_sum", total).withColumn("_top", F.array_max("_sum"))
    fused = fused.withColumn("_mass", F.aggregate("_sum", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top"))))
    posterior = F.round(F.when(F.col("_mass") > 0, 1 / F.col("_mass")), 6)
    best = (F.array_position("_sum", F.col("_top")) - 1).cast("int")
    out = fused.select(
        *[c for c in rows.columns if c not in ("text", "host", "declared")],
        F.get(names, best).alias("language"),
        posterior.alias("posterior"),
        F.get(names, F.col("_vote")).alias("text_language"),
        "grams",
        F.coalesce((F.col("grams") >= LEAST_GRAMS) & (posterior >= min_posterior) & (F.get("loglik", best) > unknown), F.lit(False)).alias("accepted"),
    )
    return out


def document_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents as rows for identify(): the source stands for the host, nothing is declared."""
    return docs.select(key, "text", F.col("source").alias("host"), F.lit(None).cast("string").alias("declared"))


def page_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    return pages.select(key, plain_text(F.col("html")).alias("text"), host_of(F.col("url")).alias("host"), declared_language(F.col("html")).alias("declared"))
