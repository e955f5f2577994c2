"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosine, components.

Vectors of a label meet where all signs of a table agree. The signs of a table grow with the logarithm of the
label's vectors, so buckets of unlike vectors stay small, and the tables grow so that the chance to miss a pair stays
the same. Only ids and a signature go through the buckets; vectors are sent to the buckets in which they have a
partner with a similar signature.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wtel.llm.common import join_small, runs, staged
from wtel.llm.components import components

THRESHOLD = 0.93
#: Two vectors of cosine 0.93 agree in one sign with this probability.
AGREE = 1 - math.acos(THRESHOLD) / math.pi
#: Unlike vectors that a bucket holds on average, least and most signs of a table, chance to miss a pair of cosine 0.93.
BUCKET, LEAST_BITS, MOST_BITS, MISSED = 16, 6, 32, 6e-5
#: Signs of the signature, and how many may differ: at cosine 0.93 the mean is 31 and the standard deviation 5.2,
#: so a pair differs in more with a chance below one in a hundred million.
SIGNATURE, DIFFER = 256, 64
#: Vectors of a bucket that are compared at once; a larger bucket is cut into blocks.
BLOCK = 1500
SEED = 93


def bits_for(count: int) -> int:
    """Signs of a table for so many vectors of a label."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(count, 1) / BUCKET))))


def tables_for(bits: int) -> int:
    """Tables that leave ``MISSED`` of the pairs at the threshold in no common bucket."""
    return math.ceil(math.log(MISSED) / math.log1p(-(AGREE**bits)))


@lru_cache(maxsize=64)
def _planes(dim: int, first: int, count: int) -> np.ndarray:
    """``count`` hyperplanes from the ``first`` on; the same ones whoever asks."""
    return np.random.default_rng((SEED, dim, first)).standard_normal((dim, count))


def signatures(vectors: np.ndarray) -> np.ndarray:
    """Bytes with the signs of each vector's signature."""
    return np.packbits(vectors @ _planes(vectors.shape[1], 0, SIGNATURE) >= 0, axis=1)


def codes(vectors: np.ndarray, bits: int) -> np.ndarray:
    """The sign pattern of each vector in each table."""
    out = []
    for table in range(tables_for(bits)):
        signs = vectors @ _planes(vectors.shape[1], 1 + table, bits) >= 0
        out.append((signs.astype(np.int64) << np.arange(bits)).sum(axis=1))
    return np.stack(out, axis=1)


def _usable(batch: pa.RecordBatch) -> list[np.ndarray | None]:
    """Each row's vector as doubles; None for a null or zero one, or null or non-finite components."""
    lists = batch.column("embedding")
    out: list[np.ndarray | None] = [None] * batch.num_rows
    flat = pc.cast(lists.flatten(), pa.float64())
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False) + 0.0  # no negative zero
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    labels = batch.column("label").is_valid().to_numpy(zero_copy_only=False)
    start = 0
    for i, end in enumerate(ends):
        row, start = values[start:end], end
        if labels[i] and len(row) and np.isfinite(row).all() and row.any():
            out[i] = row
    return out


def _digests(vectors: DataFrame) -> DataFrame:
    """vec_id, label, digest of label and vector, and the vector's bytes; both null if unusable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _usable(batch)
            labels = batch.column("label").cast(pa.string()).to_pylist()
            raw = [r.tobytes() if r is not None else None for r in rows]
            own = [
                hashlib.blake2b(r + b"|" + str(label).encode(), digest_size=16).digest() if r is not None else None
                for r, label in zip(raw, labels, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(labels, pa.string()), pa.array(own, pa.binary()), pa.array(raw, pa.binary())],
                ["vec_id", "label", "digest", "vector"],
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "label", "embedding").mapInArrow(
        run, f"vec_id {kind}, label string, digest binary, vector binary"
    )


def _coded(classes: DataFrame) -> DataFrame:
    """c, label, dim, size, bits, signature and codes of each class; ``bits`` says how many signs a table has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bits = batch.column("vector").to_pylist(), batch.column("bits").to_numpy()
            shape = np.array([len(r) for r in raw]) * 64 + bits
            signs: list = [None] * len(raw)
            tables: list = [None] * len(raw)
            for kind in np.unique(shape):
                at = np.flatnonzero(shape == kind)
                vectors = np.frombuffer(b"".join(raw[i] for i in at)).reshape(len(at), -1)
                made = codes(vectors, int(kind) % 64)
                for i, s, m in zip(at, signatures(vectors), made, strict=True):
                    signs[i], tables[i] = s.tobytes(), m
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("c", "label", "size", "bits")),
                    pa.array([len(r) // 8 for r in raw], pa.int32()),
                    pa.array(signs, pa.binary()),
                    pa.array(tables, pa.list_(pa.int64())),
                ],
                ["c", "label", "size", "bits", "dim", "signature", "codes"],
            )

    return classes.select("c", "label", "size", "bits", "vector").mapInArrow(
        run, "c long, label string, size long, bits int, dim int, signature binary, codes array<long>"
    )


#: What names a bucket.
_KEY = ["t", "code", "label", "dim"]


def _in_blocks(members: DataFrame) -> DataFrame:
    """Members of a bucket for each pair of blocks that meet."""
    sizes = staged(members.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("count")).where("count > 1"), "buckets")
    rows = join_small(members, sizes, _KEY, "inner")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select(*members.columns, "block", other)
    return rows.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")).drop("other")


_PAIR = [*_KEY, "first", "second"]
#: How many signs are set in a byte.
_SET = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, bool]]:
    """Block pairs of a sorted partition: the rows, those of either side, and whether these are the same."""
    for group in runs(batches, _PAIR):
        first, second = (group.column(c)[0].as_py() for c in ("first", "second"))
        block = group.column("block").to_numpy()
        a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
        if len(a) and len(b) and group.num_rows > 1:
            yield group, a, b, first == second


def _similar(group: pa.RecordBatch, a: np.ndarray, b: np.ndarray, same: bool) -> np.ndarray:
    """Which rows of the sides have similar signatures."""
    signs = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(group.num_rows, -1)
    spread = np.unpackbits(signs, axis=1).astype(np.float32)
    x, y = spread[a], spread[b]
    differ = x.sum(axis=1)[:, None] + y.sum(axis=1)[None, :] - 2 * (x @ y.T)
    near = differ <= DIFFER
    if same:
        np.fill_diagonal(near, False)
    return near


def similar_members(members: DataFrame) -> DataFrame:
    """Bucket and c of the members of buckets that have a partner there with a similar signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, a, b, same in _groups(batches):
            near = _similar(group, a, b, same)
            c = group.column("c").to_numpy()
            found = np.unique(np.concatenate([c[a[near.any(axis=1)]], c[b[near.any(axis=0)]]]))
            if len(found):
                first = pa.array(np.zeros(len(found), np.int64))
                yield pa.RecordBatch.from_arrays([*(group.column(k).take(first) for k in _KEY), pa.array(found)], [*_KEY, "c"])

    dealt = _in_blocks(members).repartition(*_PAIR).sortWithinPartitions(*_PAIR)
    return dealt.mapInArrow(run, "t int, code long, label string, dim int, c long").distinct()


def _compare(a: dict, b: dict, table: int, same: bool, threshold: float) -> tuple:
    """Links of one block pair: for each side the linked vectors that no earlier table shows, and a spanning root."""
    x, y = a["vector"], b["vector"]
    cosine = (x @ y.T) / np.outer(a["norm"], b["norm"])
    linked = cosine >= threshold
    if same:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return None, None, None
    i, j = np.nonzero(linked)
    fresh = np.ones(len(i), bool)
    for t in range(table):
        fresh &= a["codes"][i, t] != b["codes"][j, t]
    i, j = i[fresh], j[fresh]
    here = np.bincount(i, b["size"][j], len(x))
    there = None if same else np.bincount(j, a["size"][i], len(y))
    if same:
        root = np.arange(len(x))
        while True:
            least = np.minimum(root, np.where(linked, root[None, :], len(x)).min(axis=1))
            least = least[least]
            if (least == root).all():
                return here, there, a["c"][root]
            root = least
    # sides are joined through each other: rows 0..x-1, then columns
    root, other = np.arange(len(x)), np.full(len(y), len(x))
    while True:
        other = np.where(linked, root[:, None], len(x)).min(axis=0)
        least = np.minimum(root, np.where(linked, other[None, :], len(x)).min(axis=1))
        if (least == root).all():
            names = np.append(a["c"], -1)
            return here, there, (names[root], names[other])
        root = least


def _links(members: DataFrame, coded: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """c, n (links found first here), root (a class of the same component) from the marked members of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, left, right, same in _groups(batches):

            def side(at: np.ndarray, group: pa.RecordBatch = group) -> dict:
                part = group.take(pa.array(at))
                vector = np.frombuffer(b"".join(part.column("vector").to_pylist())).reshape(len(at), -1)
                return {
                    "c": part.column("c").to_numpy(), "size": part.column("size").to_numpy(), "vector": vector,
                    "norm": np.sqrt((vector * vector).sum(axis=1)),
                    "codes": part.column("codes").flatten().to_numpy().reshape(len(at), -1),
                }

            a = side(left)
            b = a if same else side(right)
            here, there, root = _compare(a, b, group.column("t")[0].as_py(), same, threshold)
            if here is None:
                continue
            sides = [(a["c"], here, root)] if same else [(a["c"], here, root[0]), (b["c"], there, root[1])]
            for c, n, r in sides:
                r = np.where(r < 0, c, r)
                used = (n > 0) | (r != c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[used]), pa.array(n[used].astype(np.int64)), pa.array(r[used])], ["c", "n", "root"]
                )

    rows = _in_blocks(members).join(coded.select("c", "codes"), "c").join(classes.select("c", "size", "vector"), "c")
    dealt = rows.repartition(*_PAIR).sortWithinPartitions(*_PAIR)
    return dealt.mapInArrow(run, "c long, n long, root long")


def links(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vec_id, embedding, label.

    Vectors of one label are linked if their cosine, in double precision, is ``threshold`` (0.93, for which the tables
    are made) or more.
    ``n_links`` counts the other vectors linked directly, ``component_id`` is the smallest vec_id
    reachable, ``kept`` is vec_id = component_id.

    Equal vectors of a label are one class and compared once. The number of signs follows from the label's classes. A
    bucket of more than ``BLOCK`` classes is cut into blocks, and each pair of blocks is a group of its own. A pair is
    counted in the first table that shows it.

    A row with null label or vector, a zero vector, or null or non-finite components links with
    nothing and is its own component. Vectors of different lengths are not compared. A null vec_id
    takes part in linking; a component of such rows alone has a null id, and they are never kept. Rows that
    repeat are other vectors. Other columns are not read. An empty table gives an empty result.
    """
    seen = staged(_digests(vectors), "vectors")
    classes = seen.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    classes = staged(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    counts = classes.groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    levels = F.ceil(F.log2(F.col("k") / BUCKET)).cast("int")
    bits = F.least(F.lit(MOST_BITS), F.greatest(F.lit(LEAST_BITS), levels)).alias("bits")
    sized = join_small(classes, staged(counts.select("label", bits), "bits"), "label", "inner")
    coded = staged(_coded(sized), "coded")
    members = coded.select("c", "label", "dim", "signature", F.posexplode("codes").alias("t", "code"))
    marked = staged(similar_members(members), "marked")
    found = staged(_links(marked, coded, classes, threshold), "found")
    counts = found.groupBy("c").agg(F.sum("n").alias("n"))
    edges = found.where("root <> c").select(F.col("root").alias("a"), F.col("c").alias("b")).distinct()
    root = components(staged(edges, "edges")).toDF("c", "root")
    linked = staged(counts.join(root, "c", "left"), "linked")
    known = join_small(classes.select("c", "digest", "rep", "size"), linked, "c").where("size > 1 OR n IS NOT NULL")
    known = staged(known.withColumn("root", F.coalesce("root", "c")), "known")
    least = staged(known.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    shared = join_small(known, least, "root").select(
        "digest", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id", F.lit(True).alias("_in")
    )
    out = join_small(seen.select("vec_id", "digest"), staged(shared, "shared"), "digest")
    component = F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
