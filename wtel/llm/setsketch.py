"""Near-duplicate documents by SetSketch registers.

A register is the truncated, exponentially spaced minimum of an exponential value per shingle, so
that a union's register is the greater of two. Equal registers are as likely as shingles are
shared, which makes bands of registers a search for similar sets; the joint likelihood of two
register arrays estimates the similarity, and the sets themselves decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wtel.llm.common import chained, join_small, mixed, runs, slices, staged, word_hashes
from wtel.llm.components import components

#: A band is found equal with probability J ** BAND_ROWS; at J = 0.8 all bands differ in 3 of a million pairs.
BANDS, BAND_ROWS = 42, 6
REGISTERS = BANDS * BAND_ROWS
#: Spacing of the registers, rate of the exponential values, greatest register.
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 1
#: Percent of the union that two sets share to be linked, and words of a shingle.
PERCENT, WORDS = 80, 2
#: Estimated similarity below which a pair is not verified: six standard deviations below 0.8.
ESTIMATE = 0.65
#: Rows with registers up to which a side is broadcast.
SKETCH_ROWS = 20_000
#: Classes and shingles of a block, and shared shingles that are counted at once.
BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 20, 4096
#: Shingles that go through the registers at once.
BLOCK = 2048
#: Rows and pairs whose registers are compared at once, and the share of equal ones below which a pair is not estimated.
SKETCH_BLOCK, SKETCH_PAIRS, SAME = 256, 1 << 15, 0.55

_RANDOM = np.random.default_rng(20)
_FACTORS = (_RANDOM.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADDED = _RANDOM.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; of all its words where it has fewer."""
    hashes, offsets = word_hashes(texts)
    grams = chained(*(hashes[i : len(hashes) - words + 1 + i] for i in range(words))) if len(hashes) >= words else None
    out = []
    for start, stop in zip(offsets[:-1], offsets[1:], strict=True):
        if stop - start >= words:
            out.append(np.unique(grams[start : stop - words + 1]))
        elif stop > start:
            out.append(chained(np.full(1, stop - start, np.uint64), *hashes[start:stop].reshape(-1, 1)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit shingles; ``np.maximum`` merges those of two sets."""
    low = (mixed(shingles) >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(low), BLOCK):
        values = np.multiply.outer(low[at : at + BLOCK], _FACTORS)
        values += _ADDED
        np.minimum(least, values.min(axis=0), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """A key for each band of each row of registers; equal only within a band."""
    wide = rows.reshape(len(rows), BANDS, BAND_ROWS).astype(np.uint64)
    return chained(
        np.broadcast_to(np.arange(BANDS, dtype=np.uint64), wide.shape[:2]), *(wide[:, :, i] for i in range(BAND_ROWS))
    ).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each row pair of registers, given the sets' sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u

    def likelihood(j: np.ndarray) -> np.ndarray:
        p = [-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE) for x in (u - v * j, v - u * j)]
        tiny = 1e-12
        return (
            more * np.log(np.maximum(p[0], tiny))
            + less * np.log(np.maximum(p[1], tiny))
            + same * np.log(np.maximum(1 - p[0] - p[1], tiny))
        )

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(30):
        c, d = high - golden * (high - low), low + golden * (high - low)
        better = likelihood(c) >= likelihood(d)
        low, high = np.where(better, low, c), np.where(better, d, high)
    return (low + high) / 2


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, digest of the set and its registers; both null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), words)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest", "registers"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {_kind(docs, 'doc_id')}, n_shingles long, digest binary, registers binary"
    )


def _with_bands(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            keys = band_keys(rows).reshape(-1) if len(rows) else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("n"), lists], ["c", "n", "bands"])

    return classes.select("c", "n", "registers").mapInArrow(run, "c long, n long, bands array<long>")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose registers make a similarity of ``ESTIMATE`` or more likely."""
    side = classes.select("c", "n", "registers")
    here = staged(pairs, "pairs")
    ids = staged(here.select(F.col("a").alias("c")).unionByName(here.select(F.col("b").alias("c"))).distinct(), "ids")
    side = staged(join_small(side, ids, "c", "inner"), "sides")
    rows = join_small(here, side.toDF("a", "n_a", "r_a"), "a", "inner", SKETCH_ROWS)
    rows = join_small(rows, side.toDF("b", "n_b", "r_b"), "b", "inner", SKETCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("r_a", "r_b")
            )
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            good = pa.array(estimate(a, b, n_a, n_b) >= ESTIMATE) if len(a) else pa.array([], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    return rows.mapInArrow(run, "a long, b long")


def _sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """c and shingles of the classes ``ids`` (c), read again from the text of one document of each."""
    needed = staged(join_small(classes.select("c", "digest", "rep"), staged(ids, "ids"), "c", "inner"), "needed")
    reps = staged(needed.select(F.col("rep").alias("_rep")).distinct(), "reps")
    texts = docs.select("doc_id", "text")
    texts = join_small(texts, reps, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s for s in shingle_sets(part.column("text"), words) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["digest", "shingles"],
                )

    found = texts.mapInArrow(read, "digest binary, shingles binary")
    found = join_small(found, needed.select("digest", "c"), "digest", "inner")
    return staged(found.dropDuplicates(["c"]).select("c", "shingles"), "sets")


def _linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs whose full sets are similar."""
    pairs = staged(_likely(pairs, classes), "likely")
    ids = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    sets = _sets(ids, classes, docs, words)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    rows = join_small(pairs, sets.toDF("b", "s_b"), "b", "inner", SKETCH_ROWS // 10)
    rows = join_small(rows, sets.toDF("a", "s_a"), "a", "inner", SKETCH_ROWS // 10)
    return staged(rows.mapInArrow(verify, "a long, b long"), "links")


def similar(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of the left and right sides share ``percent`` of their union, by counting shared shingles.

    Shingles of one side only are left out; those of both are the columns of two incidence matrices,
    a few thousand at a time, whose product counts.
    """
    sides = [np.concatenate(s) for s in (left, right)]
    columns = np.intersect1d(*(np.unique(s) for s in sides), assume_unique=True)
    sizes = [np.array([len(x) for x in s]) for s in (left, right)]
    places = []
    for side, n in zip(sides, sizes, strict=True):
        row = np.repeat(np.arange(len(n)), n)
        at = np.searchsorted(columns, side)
        known = np.append(columns, 0)[at] == side if len(columns) else np.zeros(len(side), bool)
        known &= at < len(columns)
        order = np.argsort(at[known], kind="stable")
        places.append((row[known][order], at[known][order]))
    both = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(columns), COLUMNS):
        parts = []
        for (row, at), n in zip(places, sizes, strict=True):
            a, b = np.searchsorted(at, (start, start + COLUMNS))
            part = np.zeros((len(n), min(COLUMNS, len(columns) - start)), np.float32)
            part[row[a:b], at[a:b] - start] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    return 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)


def _dealt(members: DataFrame) -> DataFrame:
    """Members of buckets (key, root, n and more) for each pair of blocks in which they meet members of other roots.

    Most of a bucket often has one root already: these are its main part and need no comparison among
    themselves. The others meet each other and the main part, both cut into blocks of bounded size.
    """
    counts = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"))
    main = counts.groupBy("key").agg(F.max(F.struct("k", "root")).alias("m"), F.count(F.lit(1)).alias("roots"))
    main = staged(main.where("roots > 1").select("key", F.col("m.root").alias("main")), "main")
    rows = join_small(members, main, "key", "inner").withColumn("is_main", F.col("root") == F.col("main"))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = rows.groupBy("key", "is_main").agg(parts.alias("parts"))
    sizes = sizes.groupBy("key").agg(
        F.max(F.when(F.col("is_main"), F.col("parts"))).alias("mains"), F.max(F.when(~F.col("is_main"), F.col("parts"))).alias("others")
    )
    rows = join_small(rows, staged(sizes, "sizes"), "key", "inner")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("c"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    task = lambda main, i, j: F.struct(F.lit(main).alias("with_main"), i.alias("i"), j.alias("j"))
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    part = F.col("part")
    of_main = F.transform(up_to("others"), lambda i: task(True, i, part))
    of_others = F.concat(
        F.transform(up_to("mains"), lambda j: task(True, part, j)),
        F.transform(up_to("others"), lambda j: task(False, F.least(part, j), F.greatest(part, j))),
    )
    tasks = rows.withColumn("task", F.explode(F.when(F.col("is_main"), of_main).otherwise(of_others)))
    return tasks.select(*members.columns, "is_main", "part", "task.*")


_TASK = ["key", "with_main", "i", "j"]


def _sides(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two blocks that meet in a task."""
    is_main, part = (group.column(c).to_numpy(zero_copy_only=False) for c in ("is_main", "part"))
    if group.column("with_main")[0].as_py():
        return np.flatnonzero(~is_main), np.flatnonzero(is_main)
    return np.flatnonzero(part == group.column("i")[0].as_py()), np.flatnonzero(part == group.column("j")[0].as_py())


def _likely_pairs(group: pa.RecordBatch, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, one of each side, of different roots whose registers make a similarity of ``ESTIMATE`` or more likely.

    A pair that an earlier band shows too is left to that band.
    """
    rows = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    root, n = group.column("root").to_numpy(), group.column("n").to_numpy().astype(float)
    band = group.column("band")[0].as_py()
    out = []
    for at in range(0, len(left), SKETCH_BLOCK):
        own = left[at : at + SKETCH_BLOCK]
        good = root[own][:, None] != root[right][None, :]
        good &= 100 * np.minimum(n[own][:, None], n[right][None, :]) >= 100 * ESTIMATE * np.maximum(n[own][:, None], n[right][None, :])
        x, y = np.nonzero(good)
        for start in range(0, len(x), SKETCH_PAIRS):
            i, j = own[x[start : start + SKETCH_PAIRS]], right[y[start : start + SKETCH_PAIRS]]
            near = (rows[i] == rows[j]).sum(axis=1) >= SAME * REGISTERS
            i, j = i[near], j[near]
            near = estimate(rows[i], rows[j], n[i], n[j]) >= ESTIMATE
            i, j = i[near], j[near]
            if band:
                before = (rows[i] == rows[j])[:, : band * BAND_ROWS].reshape(len(i), band, BAND_ROWS)
                fresh = ~before.all(axis=2).any(axis=1)
                i, j = i[fresh], j[fresh]
            out.append((i, j))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(side) for side in zip(*out, strict=True))


def marked_members(members: DataFrame) -> DataFrame:
    """key, c of the members of buckets whose registers are like those of a member with another root.

    Only they have their sets read: candidates that the sketch rules out cost no more than their registers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, _TASK):
            left, right = _sides(group)
            if len(left) and len(right):
                i, j = _likely_pairs(group, left, right)
                c = group.column("c").to_numpy()[np.unique(np.concatenate([i, j]))]
                if len(c):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), group.column("key")[0].as_py())), pa.array(c)], ["key", "c"])

    rows = _dealt(members).repartition(*_TASK).sortWithinPartitions(*_TASK)
    return rows.mapInArrow(run, "key long, c long").distinct()


def _rest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members (key, band, c, n, root, registers) of a bucket that have different roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, _TASK):
            left, right = _sides(group)
            if not len(left) or not len(right):
                continue
            i, j = _likely_pairs(group, left, right)
            c, root = (group.column(x).to_numpy() for x in ("c", "root"))
            raw = group.column("shingles")
            sets = {k: np.frombuffer(raw[int(k)].as_py(), np.uint64) for k in np.unique(np.concatenate([i, j]))}
            for own in np.array_split(np.unique(i), max(1, len(np.unique(i)) * 4 // BLOCK_ROWS)):
                here = np.isin(i, own)
                others = np.unique(j[here])
                if not len(others):
                    continue
                good = similar([sets[k] for k in own], [sets[k] for k in others], percent)
                x, y = np.searchsorted(own, i[here]), np.searchsorted(others, j[here])
                linked = good[x, y]
                a, b = own[x[linked]], others[y[linked]]
                # one link for each class and root is enough
                first = np.unique(np.stack([a, root[b]], axis=1), axis=0, return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(c[a[first]]), pa.array(c[b[first]])], ["a", "b"])

    rows = _dealt(members).join(sets, "c").repartition(*_TASK).sortWithinPartitions(*_TASK)
    return rows.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Rows doc_id, n_shingles, digest; and digest, component_id, chosen, chosen_id of shared groups.

    Documents with one set are one class, which the search sees once. In each bucket of a band the
    members are compared with the bucket's first; the links found make components. In buckets whose members still are in
    different components these meet by blocks: first their registers, and the sets of those that the
    registers make likely. So every pair that shares a bucket is either compared or already connected, and
    a large group of near copies costs little more than a comparison per member.

    ``chosen`` marks the digest and ``chosen_id`` the id of the one document that a group keeps.
    """
    seen = staged(sketches(docs, words), "sketches")
    classes = seen.where("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"),
        F.first("n_shingles").alias("n"), F.first("registers").alias("registers"),
    )
    classes = staged(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    bands = staged(_with_bands(classes), "bands").select("c", "n", F.posexplode("bands").alias("band", "key"))
    firsts = bands.groupBy("key").agg(F.min("c").alias("center"), F.count(F.lit(1)).alias("k"))
    firsts = staged(firsts.where("k > 1").select("key", "center"), "buckets")
    shared = staged(join_small(bands, firsts, "key", "inner"), "shared")
    stars = shared.where("c <> center").select(F.col("c").alias("b"), F.col("center").alias("a")).distinct()
    links = _linked(stars, classes, docs, percent, words)
    root = components(links).toDF("c", "root")
    members = join_small(shared.drop("center"), root, "c").withColumn("root", F.coalesce("root", "c"))
    several = members.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    members = join_small(members, staged(several.select("key"), "open"), "key", "left_semi")
    members = staged(join_small(members, classes.select("c", "registers"), "c", "inner"), "members")
    marked = staged(marked_members(members), "marked")
    if not marked.isEmpty():
        sets = _sets(marked.select("c").distinct(), classes, docs, words)
        members = staged(join_small(members, marked, ["key", "c"], "left_semi"), "likely-members")
        more = staged(_rest(members, sets, percent), "more")
        root = components(staged(links.unionByName(more), "all-links")).toDF("c", "root")
    known = join_small(classes.select("c", "digest", "rep", "size"), root, "c").withColumn("root", F.coalesce("root", "c"))
    linked = staged(root.select("root").distinct(), "roots").toDF("r")
    known = join_small(known, linked, F.col("root") == F.col("r")).where("size > 1 OR r IS NOT NULL")
    known = staged(known.select("root", "digest", "rep"), "known")
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "digest"))
    best = known.groupBy("root").agg(first.alias("first")).select("root", "first.rep", F.col("first.digest").alias("at"))
    out = join_small(known.select("root", "digest"), staged(best.toDF("root", "component_id", "at"), "best"), "root", "inner")
    shared_groups = out.select("digest", "component_id", (F.col("digest") == F.col("at")).alias("chosen"))
    return seen.select("doc_id", "n_shingles", "digest"), staged(shared_groups, "groups")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the group) and kept of every document.

    Two documents are linked if 100 * shared shingles >= ``percent`` * all shingles of both; a group
    is what links connect. A text with fewer words than a shingle has its whole word sequence as
    the only one. A null, empty or blank text has none, links with nothing and is its own group.

    A null id takes part in linking; a group's id is the smallest that is not null, and null only
    if all are, when nothing is marked kept. Rows that repeat an id are all marked alike. Only
    doc_id and text are read, so other columns cannot clash. An empty table gives an empty result.
    """
    rows, shared = groups(docs, percent, words)
    out = join_small(rows, shared.select("digest", "component_id", F.lit(True).alias("_in")), "digest")
    component = F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The documents without all but one of each group; all columns are kept.

    The document with the smallest id stays (null last, then by digest); of rows that repeat it, one. Texts without
    words are in no group and all stay.
    """
    _, shared = groups(docs, percent, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                digests = [_digest(s) if len(s) else None for s in shingle_sets(part.column("text"), words)]
                yield part.append_column("_digest", pa.array(digests, pa.binary()))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    marked = docs.mapInArrow(run, ", ".join([*fields, "_digest binary"]))
    side = shared.toDF("_digest", "_component", "_chosen")
    found = join_small(marked, side, "_digest").where("_chosen IS NULL OR _chosen")
    own = found.where("_chosen IS NULL")
    one = found.where(F.col("_chosen") & F.col("doc_id").eqNullSafe(F.col("_component"))).dropDuplicates(["_digest"])
    return own.unionByName(one).select(*docs.columns)
