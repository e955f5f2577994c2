"""Packing of archives: one pass, joins, and a plain model must agree."""

import random

import numpy as np
import pytest

from wtel.operators import archive

SCHEMA = "path string, size long, timestamp long, day string"


def entries(seed, n=250):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        day = "2013/12/03" if r.random() < 0.5 else f"2013/12/{4 + r.randrange(5):02d}"
        size = r.choice([0, 0, 1, 5, 10, 40, 99, 100, 101, 500])
        rows.append((f"p{i:04d}", size, r.randrange(40) * 30_000, day))
    return rows


def model(rows, cap):
    out, state = {}, {}
    for path, size, ts, day in sorted(rows, key=lambda x: (x[3], x[2], x[0])):
        number, filled = state.get(day, (0, None))
        if filled is None or filled + size >= cap:
            number, filled = number + 1, size
        else:
            filled += size
        state[day] = (number, filled)
        out[path] = number
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("by_joins", [False, True])
def test_packing(spark, seed, by_joins):
    rows = entries(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    packed = archive.pack_archives(df, 200, by_joins=by_joins)
    assert {r.path: r.archive_no for r in packed.collect()} == model(rows, 100)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_blocks_of_any_size(spark, monkeypatch, parts):
    """Blocks smaller than an archive, and more blocks of a day than one task follows."""
    monkeypatch.setattr(archive, "FAN", 4)
    rows = entries(parts, 400)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.path: r.archive_no for r in archive._pack_by_blocks(df, 100, parts).collect()}
    assert got == model(rows, 100)


def test_summaries_compose():
    """The summary of two runs is that of the whole, for every fill on entry."""
    r = random.Random(3)
    for _ in range(300):
        cap = r.choice([1, 7, 50])
        sizes = np.array([r.choice([0, 1, 2, 5, 20, 60]) for _ in range(r.randrange(1, 14))])
        cut = r.randrange(len(sizes) + 1)
        fills = np.arange(0, cap + 70)
        parts = [archive.Summary.of(x, cap) for x in (sizes[:cut], sizes[cut:]) if len(x)]
        whole = parts[0] if len(parts) == 1 else parts[0].then(parts[1])
        for fill, closed, left in zip(fills, *whole.after(fills), strict=True):
            n, f = 0, int(fill)
            for size in sizes.tolist():
                if f + size >= cap:
                    n, f = n + 1, size
                else:
                    f += size
            assert (closed, left) == (n, f)


def test_oversize_and_exact_cap(spark):
    rows = [("a", 300, 0, "d"), ("b", 60, 1, "d"), ("c", 40, 2, "d"), ("e", 39, 3, "d")]
    df = spark.createDataFrame(rows, SCHEMA)
    for by_joins in (False, True):
        got = {r.path: r.archive_no for r in archive.pack_archives(df, 200, by_joins).collect()}
        assert got == {"a": 1, "b": 2, "c": 3, "e": 3}


def test_only_entries_from_today(spark):
    df = spark.createDataFrame([("a", 1, 1_386_100_000_000)], "path string, size long, timestamp long")
    past = archive.exclude_today(df, 1_386_100_500_000)
    assert archive.pack_archives(past, 200).count() == 0


def test_day_changes_at_midnight_in_the_archive_zone(spark):
    # 2013-12-04 07:59 and 08:00 UTC are 23:59 and 00:00 in the archive zone
    df = spark.createDataFrame(
        [("a", 1, 1_386_143_940_000), ("b", 1, 1_386_144_000_000)],
        "path string, size long, timestamp long",
    )
    days = {r.path: r.day for r in archive.exclude_today(df, 1_400_000_000_000).collect()}
    assert days == {"a": "2013/12/03", "b": "2013/12/04"}
    packed = archive.pack_archives(archive.exclude_today(df, 1_400_000_000_000), 10**6)
    names = sorted(r.dest_path for r in archive.archive_manifest(packed).collect())
    assert names == [
        "/archive/2013/12/03/2013_12_03T2359-2013_12_03T2359.tar.xz",
        "/archive/2013/12/04/2013_12_04T0000-2013_12_04T0000.tar.xz",
    ]
