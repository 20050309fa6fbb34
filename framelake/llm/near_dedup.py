"""MinHash near-duplicate groups by a signature-coordinate inverted join.

1. One pass gives each document its set size, a 128-bit print of its shingle set
   and COORDINATES MinHash values.  Documents of one print form a class, and only
   the class's smallest doc_id goes on, so copies are never paired.
2. Representatives are posted under each (coordinate, value) pair.  Postings move
   as sorted arrays per block of keys; the block answers each origin with the
   counts of the keys that more than one representative has.
3. Two signatures that agree in LEAST_MATCHES coordinates share a key among the
   c - LEAST_MATCHES + 1 rarest of the c keys that either shares with anyone
   (prefix filter).  Documents with c < LEAST_MATCHES are skipped altogether.
4. Candidates: first every posting is compared with two members of its list, the
   most central one and one chosen by a hash (stars, linear in the postings).
   After their links are merged, only documents whose prefix keys several
   components post remain.  The shingles that a document has in common with other
   components bound the size of what it can be linked with; where that leaves no
   size it leaves.  Of the rest, pairs are tried that share one of their rarest such
   shingles (a prefix filter on the full sets, without loss), the smaller one being
   posted under the classes of size that its bound reaches, the larger one under its
   own.  Signatures are counted against LEAST_MATCHES, and what is left is confirmed
   on full sets.  Keys of many postings, whether one component or several have them,
   go by broadcast or are dealt to squares of SQUARE_ROWS a side, and a document of
   many pairs meets its signature and its set in shares of about HUB_PAIRS of them, so
   no key of a join has more than max(HOT_ROWS, rows / HOT_SHARE) rows in a task, no
   document more than max(HUB_PAIRS, pairs / HOT_SHARE) pairs.
5. Components of the links, and the result back to every document.

Families whose members all share more of their text with each other than a link
needs, but not the same parts of it, are compared pair by pair.

With 96 coordinates and 52 matches a pair of similarity 0.75 is missed with a
probability of about 3e-6; more similar pairs less.

Cases: words are lower-cased in A-Z only; a text of fewer than five words has one
shingle, its whole word sequence; an empty or null text has none, is linked with
nothing and kept; rows that share a doc_id are one node of the graph; a row with
a null doc_id is linked with nothing, kept, and has a null component; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_bound, join_with_hot_keys, only, small_batches
from .components import components
from .kernels import TextChunk, chunks, mix64, seeded, windows

WIDTH, COORDINATES, LEAST_MATCHES = 5, 96, 52
#: Similarity in hundredths: a link needs 100 * intersection >= SIMILAR * union.
SIMILAR = 75
#: Representatives of an origin, keys of a block, keys of a document in the first, linear comparison.
ORIGIN_ROWS, BLOCK_KEYS, STAR_KEYS = 512, 1 << 20, 8
KEY_BITS = 48
#: Candidates dealt to a task.
PART_ROWS = 1000
#: Postings of one key that meet in a task, on either side.
SQUARE_ROWS = 1000
#: Pairs of one document that meet its signature or set in a task, about.
HUB_PAIRS = 1000
#: Each class of sizes ends at this multiple of where it begins.
SIZE_STEP = 1.05
_A, _B = seeded(COORDINATES, 11) | np.uint64(1), seeded(COORDINATES, 12)
_COORDINATE = seeded(COORDINATES, 13)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted 64-bit shingle hashes of each row."""
    chunk = TextChunk(data, offsets, lower=True)
    hashes, bounds = chunk.word_hashes(), chunk.word_bounds
    first, grams = windows(hashes, bounds, WIDTH)
    at = np.searchsorted(first, bounds)
    out = []
    for row in range(chunk.rows):
        n = bounds[row + 1] - bounds[row]
        if n >= WIDTH or n == 0:
            out.append(np.unique(grams[at[row] : at[row + 1]]))
        else:
            code = np.uint64(n)
            for h in hashes[bounds[row] : bounds[row + 1]]:
                code = mix64(np.array([code], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + h)[0]
            out.append(np.array([code], np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row a set; rows of empty sets are 0."""
    out = np.zeros((len(sets), COORDINATES), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        joined = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        values = np.empty_like(joined)
        for k in range(COORDINATES):
            np.multiply(joined, _A[k], out=values)
            np.add(values, _B[k], out=values)
            out[full, k] = np.minimum.reduceat(values, starts)
    return out


def _keys(signature: np.ndarray) -> np.ndarray:
    """KEY_BITS-bit keys of (coordinate, value) pairs; two pairs of one key only look shared where they are not."""
    return (mix64((signature + _COORDINATE[None, :]).ravel()) >> np.uint64(64 - KEY_BITS)).reshape(signature.shape)


def _packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    short = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BITS // 8)
    out = np.zeros((len(short), 8), np.uint8)
    out[:, : KEY_BITS // 8] = short
    return out.view("<u8").ravel().astype(np.uint64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), COORDINATES)


def _signed(docs: DataFrame) -> DataFrame:
    """(_id, n_shingles, p0, p1, signature): signature is null for empty sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids = batch.column(0)
            for first, data, offsets in chunks(batch.column(1)):
                sets = shingle_sets(data, offsets)
                marks = signatures(sets)
                prints = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
                raw = [m.tobytes() if len(s) else None for m, s in zip(marks, sets)]
                columns = [ids.slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "n_shingles", "p0", "p1", "signature"])

    return docs.mapInArrow(sign, "_id long, n_shingles long, p0 long, p1 long, signature binary")


def _post(bits: int):
    """Keys of an origin's representatives, as sorted arrays per block."""

    def post(origin: tuple, rows: pa.Table, reps: pa.Table) -> pa.Table:
        mine = rows.filter(np.isin(rows.column("_id").to_numpy(), reps.column("rep").to_numpy())) if len(reps) else rows.slice(0, 0)
        if not len(mine):
            return pa.table({"block": pa.array([], pa.int32()), "origin": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})
        keys, counts = np.unique(_keys(_matrix(mine.column("signature"))), return_counts=True)
        block = (keys >> np.uint64(KEY_BITS - bits)).astype(np.int64)
        bounds = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        spans = list(zip(bounds[:-1], bounds[1:]))
        return pa.table(
            {
                "block": pa.array(block[bounds[:-1]], pa.int32()),
                "origin": pa.array([origin[0].as_py()] * len(spans), pa.int64()),
                "keys": pa.array([_packed(keys[a:b]) for a, b in spans], pa.binary()),
                "counts": pa.array([np.minimum(counts[a:b], 255).astype(np.uint8).tobytes() for a, b in spans], pa.binary()),
            }
        )

    return post


def _answer(block: tuple, posted: pa.Table) -> pa.Table:
    """To each origin, its keys that more than one representative has, with their counts.

    Counts only order keys by rarity, alike for all, so an origin's part above 255 may be cut.
    """
    keys = [_unpacked(x) for x in posted.column("keys").to_pylist()]
    lengths = [len(k) for k in keys]
    joined = np.concatenate(keys)
    counts = np.concatenate([np.frombuffer(x, np.uint8) for x in posted.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(joined, kind="stable")
    ordered = joined[order]
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sums = np.add.reduceat(counts[order], at)
    total = np.empty(len(joined), np.int64)
    total[order] = np.repeat(sums, np.diff(np.concatenate([at, [len(joined)]])))
    ends = np.cumsum(lengths)
    out: dict[str, list] = {"origin": [], "keys": [], "counts": []}
    for origin, a, b in zip(posted.column("origin").to_pylist(), ends - lengths, ends):
        more = total[a:b] > 1
        if more.any():
            out["origin"].append(origin)
            out["keys"].append(_packed(joined[a:b][more]))
            out["counts"].append(np.minimum(total[a:b][more], 2**32 - 1).astype(np.uint32).tobytes())
    return pa.table({"origin": pa.array(out["origin"], pa.int64()), "keys": pa.array(out["keys"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})


def _prefixes(origin: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
    """Representatives that may have a partner, with their prefix keys, rarest first."""
    reps = answers.column("rep").drop_null().to_numpy()
    blobs = answers.filter(answers.column("keys").is_valid())
    mine = rows.filter(np.isin(rows.column("_id").to_numpy(), reps)) if len(reps) else rows.slice(0, 0)
    out: dict[str, list] = {"rep": [], "n": [], "central": [], "signature": [], "prefix": []}
    if len(mine) and len(blobs):
        known = np.concatenate([_unpacked(x) for x in blobs.column("keys").to_pylist()])
        total = np.concatenate([np.frombuffer(x, np.uint32) for x in blobs.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(known)
        known, total = known[order], total[order]
        keys = _keys(_matrix(mine.column("signature")))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        counts = np.where(known[at] == keys, total[at], 0)
        ids, sizes, marks = mine.column("_id").to_pylist(), mine.column("n_shingles").to_pylist(), mine.column("signature").to_pylist()
        for i in np.flatnonzero((counts > 0).sum(1) >= LEAST_MATCHES):
            shared = np.flatnonzero(counts[i])
            rare = shared[np.lexsort((keys[i, shared], counts[i, shared]))][: len(shared) - LEAST_MATCHES + 1]
            out["rep"].append(ids[i])
            out["n"].append(sizes[i])
            out["central"].append(float(np.log1p(counts[i]).sum().round(6)))
            out["signature"].append(marks[i])
            out["prefix"].append(keys[i, rare].view(np.int64).tolist())
    return pa.table({"rep": pa.array(out["rep"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "central": pa.array(out["central"], pa.float64()), "signature": pa.array(out["signature"], pa.binary()), "prefix": pa.array(out["prefix"], pa.list_(pa.int64()))})


def _count_matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            same = (_matrix(table.column("sx")) == _matrix(table.column("sy"))).sum(1)
            keep = same >= LEAST_MATCHES
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(same[keep].astype(np.int32))], names=["x", "y", "matches"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("vx"), batch.column("vy")):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, component, n, v binary) to a row a shingle."""
    for batch in batches:
        for i in range(batch.num_rows):
            codes = np.frombuffer(batch.column(3)[i].as_buffer(), np.int64)
            same = lambda c: pa.array(np.full(len(codes), batch.column(c)[i].as_py(), np.int64))  # noqa: E731,B023
            yield pa.RecordBatch.from_arrays([same(0), same(1), pa.array(codes)], names=["rep", "component", "code"])


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, v): the shingle sets of the wanted documents only."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column(1)):
                raw = [s.tobytes() for s in shingle_sets(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(raw)), pa.array(raw, pa.binary())], names=["rep", "v"])

    found = only(docs, wanted.select(F.col("rep").alias("_id")), "_id")
    return found.select("_id", "_text").mapInArrow(sets, "rep long, v binary")


def _wanted_or_hot(groups: DataFrame, wanted: Column, verdict: str, size: str, total: int) -> DataFrame:
    """The wanted groups, and every hot one with a null verdict, so that join_with_hot_keys() drops its rows where they are."""
    return groups.withColumn(verdict, F.when(wanted, F.col(verdict))).where(F.col(verdict).isNotNull() | (F.col(size) > hot_bound(total)))


def _with_ends(pairs: DataFrame, values: DataFrame, value: str, at_x: str, at_y: str) -> DataFrame:
    """pairs (x, y, checkpointed) with the values of both ends from (rep, value).

    The pairs of a hub, an end of more than HUB_PAIRS of them, are dealt by a hash
    of the other end to shares of about HUB_PAIRS, each with a copy of the hub's value.
    """
    total, dealt, copies = pairs.count(), pairs.select("x", "y"), {}
    for end, other, name in (("x", "y", at_x), ("y", "x", at_y)):
        hubs = cut(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("_pairs")).where(F.col("_pairs") > HUB_PAIRS))
        found = values.select(F.col("rep").alias(end), F.col(value).alias(name))
        if hubs.isEmpty():
            copies[end] = found.withColumn(f"_share_{end}", F.lit(0).cast("long"))
            dealt = dealt.withColumn(f"_share_{end}", F.lit(0).cast("long"))
            continue
        last = F.floor(F.coalesce("_pairs", F.lit(0)) / HUB_PAIRS)
        copies[end] = found.join(hubs, end, "left").select(end, name, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias(f"_share_{end}"))
        dealt = join_with_hot_keys(dealt, hubs, [end], "_pairs", total).withColumn(f"_share_{end}", F.pmod(F.xxhash64(other), last + 1)).drop("_pairs")
    return dealt.join(copies["y"], ["y", "_share_y"]).join(copies["x"], ["x", "_share_x"]).select("x", "y", at_x, at_y)


def _pairs_of_sizes(alive: DataFrame) -> DataFrame:
    """(x, y), x < y, of documents of different components that share a rare code and fit in size.

    alive: rep, n, component, u codes in common with others, the largest partner
    ``most``, and ``rare``, the prefix of its codes in ascending order of (f, code).
    """
    size_class = lambda n: F.floor(F.log(n) / float(np.log(SIZE_STEP)))
    # The lists are spelt out once: what follows reads the postings of all of them up to nine times, at larger sizes more often.
    posted = cut(alive.select("rep", "n", "component", "u", "most", F.posexplode("rare").alias("at", "k")))
    # Under each code the members of its largest component are compared with the others only, never among themselves.
    members = posted.groupBy("k", "component").agg(F.count(F.lit(1)).alias("m"))
    rows = posted.count()
    known = members.groupBy("k").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count(F.lit(1)).alias("c"), F.sum("m").alias("m"))
    known = _wanted_or_hot(known, F.col("c") > 1, "main", "m", rows).select("k", "main", "m")
    placed = join_with_hot_keys(posted, known, ["k"], "m", rows).where("main IS NOT NULL").withColumn("major", F.col("component") == F.col("main"))
    # Postings of a code are dealt to squares: the larger documents by row, the smaller ones by column.
    placed = cut(placed.withColumn("squares", F.floor(F.col("m") / SQUARE_ROWS)).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("squares") + 1)).drop("main", "m"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("squares")))
    named = lambda a: (F.col(c).alias(f"{c}{a}") for c in ("rep", "n", "component", "u", "most", "at", "major"))
    larger = placed.select("k", size_class(F.col("n")).alias("size"), F.col("own").alias("row"), every.alias("column"), *named("x"))
    smaller = placed.where("most >= n").select("k", F.explode(F.sequence(size_class(F.col("n")), size_class(F.col("most")))).alias("size"), F.col("own").alias("column"), "squares", *named("y"))
    smaller = smaller.select("*", every.alias("row")).drop("squares")
    keys = ["k", "size", "row", "column"]
    met = larger.join(smaller.where("NOT majory"), keys).unionByName(larger.where("NOT majorx").join(smaller.where("majory"), keys))
    right = "(nx > ny OR nx = ny AND repx > repy) AND componentx <> componenty AND nx <= mosty AND ny <= mostx"
    # what follows a common code in either list bounds the intersection, if no code before it is common too; a pair passes at its first one
    fits = f"{100 + SIMILAR} * least(ux - atx, uy - aty) >= {SIMILAR} * (nx + ny)"
    return met.where(right).where(fits).select(F.least("repx", "repy").alias("x"), F.greatest("repx", "repy").alias("y")).distinct()


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles long, component_id, kept boolean) of every row."""
    plain = small_batches(docs).select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    signed = cut(_signed(plain))
    small = signed.select("_id", "n_shingles", "p0", "p1")
    usable = signed.where("n_shingles > 0 AND _id IS NOT NULL")
    total = small.count()
    origin = lambda c: F.pmod(F.xxhash64(c), F.lit(max(8, total // ORIGIN_ROWS)))
    classes = cut(small.where("n_shingles > 0 AND _id IS NOT NULL").groupBy("p0", "p1").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("size")))

    bits = max(6, (total * COORDINATES // BLOCK_KEYS).bit_length())
    rows = usable.select(origin("_id").alias("origin"), "_id", "n_shingles", "signature").groupBy("origin")
    reps = classes.select(origin("rep").alias("origin"), "rep")
    posted = rows.cogroup(reps.groupBy("origin")).applyInArrow(_post(bits), "block int, origin long, keys binary, counts binary")
    answers = posted.groupBy("block").applyInArrow(_answer, "origin long, keys binary, counts binary")
    both = reps.select("origin", "rep", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("counts")).unionByName(answers.withColumn("rep", F.lit(None).cast("long")))
    found = cut(rows.cogroup(both.groupBy("origin")).applyInArrow(_prefixes, "rep long, n long, central double, signature binary, prefix array<long>"))

    # From here on there are candidates only: few rows for the tasks that all documents took.
    parts = max(8, found.count() // PART_ROWS)
    found = found.coalesce(parts)
    marks = found.select("rep", "signature")
    sets = cut(_full_sets(plain, found).coalesce(parts))
    close = f"100 * least(nx, ny) >= {SIMILAR} * greatest(nx, ny)"

    def scored(pairs: DataFrame) -> DataFrame:
        sided = _with_ends(cut(pairs.select("x", "y")), marks, "signature", "sx", "sy")
        return sided.mapInArrow(_count_matches, "x long, y long, matches int").coalesce(parts)

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        return _with_ends(pairs, sets, "v", "vx", "vy").mapInArrow(_confirm, "a long, b long").coalesce(parts)

    # The stars: each posting against the most central member of its list, and the rarest also against one by a hash.
    posts = found.select(F.posexplode("prefix").alias("i", "k"), "rep", "n", "central")
    sizes = (F.size("prefix"), F.least(F.size("prefix"), F.lit(STAR_KEYS)))
    postings, first_postings = found.agg(*(F.coalesce(F.sum(n), F.lit(0)) for n in sizes)).first()
    hashed = F.min_by(F.struct("rep", "n"), F.xxhash64("k", "rep")).alias("c")
    central = F.max_by(F.struct("rep", "n"), F.struct("central", F.negative("rep"))).alias("c")

    def stars(rows: DataFrame, total: int, centre: Column) -> DataFrame:
        middle = rows.groupBy("k").agg(centre, F.count(F.lit(1)).alias("m")).where("m > 1")
        paired = join_with_hot_keys(rows, middle, ["k"], "m", total).where("rep <> c.rep").select(F.least("rep", "c.rep").alias("x"), F.greatest("rep", "c.rep").alias("y"), F.col("n").alias("nx"), F.col("c.n").alias("ny"))
        return paired.where(close).select("x", "y").coalesce(parts).distinct().coalesce(parts)

    tried = cut(scored(stars(posts, postings, central).unionByName(stars(posts.where(f"i < {STAR_KEYS}"), first_postings, hashed)).distinct()))
    links = cut(confirmed(tried, sets))
    joined = components(links, parts).select(F.col("id").alias("rep"), "component")
    label = cut(found.join(joined, "rep", "left").select("rep", "n", "prefix", F.coalesce("component", "rep").alias("component")).coalesce(parts))

    # What remains: pairs that share any prefix key and lie in different components.
    posted_by = label.select(F.explode("prefix").alias("k"), "rep", "n", "component")
    mixed = posted_by.groupBy("k").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least"), F.count(F.lit(1)).alias("m"))
    mixed = _wanted_or_hot(mixed, F.expr("lo <> hi"), "least", "m", postings).select("k", "least", "m")
    rest = cut(join_with_hot_keys(posted_by, mixed, ["k"], "m", postings).where("least IS NOT NULL").groupBy("rep", "n", "component").agg(F.min("least").alias("least")).coalesce(parts))
    codes = cut(rest.join(sets, "rep").select("rep", "component", "n", "v").mapInArrow(_exploded, "rep long, component long, code long").coalesce(parts))
    shown = codes.count()
    common = codes.groupBy("code").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).withColumn("f", F.col("m"))
    common = _wanted_or_hot(common, F.expr("lo <> hi"), "f", "m", shown).select("code", "f", "m")
    ordered = join_with_hot_keys(codes, common, ["code"], "m", shown).where("f IS NOT NULL").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("f", "code"))).alias("codes"))
    # similarity >= s needs an intersection >= s / (1 + s) * (nx + ny); u shingles are common with others
    needed = F.ceil((F.col("n") + F.greatest(F.col("least"), F.ceil(SIMILAR * F.col("n") / 100))) * SIMILAR / (100 + SIMILAR)).cast("int")
    alive = rest.join(ordered, "rep").withColumns({"u": F.size("codes"), "needed": needed}).where("u >= needed")
    alive = alive.withColumn("most", F.floor(F.least((100 + SIMILAR) * F.col("u") / SIMILAR - F.col("n"), 100 * F.col("n") / SIMILAR)))
    alive = cut(alive.select("rep", "n", "component", "u", "most", F.slice("codes", 1, F.col("u") - F.col("needed") + 1).alias("rare")).coalesce(parts))
    left = _pairs_of_sizes(alive).join(tried.select("x", "y"), ["x", "y"], "left_anti")
    last = cut(scored(left.coalesce(parts)))  # few pairs, so few of the sets are moved for them
    ends = last.select(F.col("x").alias("rep")).unionByName(last.select(F.col("y").alias("rep")))
    links = links.unionByName(confirmed(last, only(sets, ends, "rep")))

    named = classes.join(components(links, parts).select(F.col("id").alias("rep"), "component"), "rep", "left")
    named = cut(named.select("p0", "p1", "size", F.coalesce("component", "rep").alias("component")))
    out = join_with_hot_keys(small, named, ["p0", "p1"], "size", total)
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component", "_id"))
    return out.select(F.col("_id").cast(docs.schema[key].dataType).alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))
