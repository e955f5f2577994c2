"""Mixing sources to target weights: a min-cost flow of token capacity, then seeded documents.

Documents are grouped by the set of sources they belong to. Each group (a membership pattern) can
give its tokens several times, at a cost that rises with each repetition; the flow fills the
sources' quotas at the least cost. A group's amount is then turned into documents: whole copies of
all, and for the rest a seeded selection.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wtel.functions.ordered import number_all
from wtel.llm.common import WORD, join_small, staged

#: Patterns that share a source with another one and that the driver plans at most; more raise an error. Sources that
#: only one pattern has are planned in Spark, however many there are.
MAX_PATTERNS = 200_000
WEIGHTS = (3, 1, 2)
#: Tokens asked for, as a share of all tokens, and the most a source is asked for of its own.
TOTAL, MOST = 1.5, 2
#: Parts of one copy that the flow prices separately, so that patterns of equal cost share a load.
STEPS = 4
SEED = "mix-1"
#: Units of a pattern that fill what the seeded prefix leaves open.
FILLS = 3
#: Hex digits of the seeded order that cut a pattern into slices (16 ** digits).
DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight; no share is above ``most`` times its size.

    What is above is shared again by weight, until none is above. That ends at shares min(cap,
    level x weight): sources are capped in the order of cap / weight, until the level that the
    others then have is below the next cap.
    """
    caps = [most * s for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: caps[i] / weights[i])
    capped, left, level = 0, sum(weights), 0.0
    for i in order:
        level = (total - capped) / left
        if level <= caps[i] / weights[i]:
            break
        capped, left = capped + caps[i], left - weights[i]
    return [float(min(c, level * w)) for c, w in zip(caps, weights, strict=True)]


def _augment(graph: list[list[list]], source: int, sink: int) -> None:
    """Raise the flow as far as it goes; an edge is [to, capacity left, index of its reverse]."""
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for to, room, _ in graph[u]:
                if room and to not in level:
                    level[to] = level[u] + 1
                    queue.append(to)
        if sink not in level:
            return
        at, path = [0] * len(graph), []
        u = source
        while True:
            if u == sink:
                room = min(e[1] for e in path)
                for e in path:
                    e[1] -= room
                    graph[e[0]][e[2]][1] += room
                path, u = [], source
                continue
            while at[u] < len(graph[u]):
                e = graph[u][at[u]]
                if e[1] and level.get(e[0]) == level[u] + 1:
                    break
                at[u] += 1
            else:
                if u == source:
                    break
                back = path.pop()
                u = graph[back[0]][back[2]][0]
                at[u] += 1
                continue
            path.append(e)
            u = e[0]


def flow(
    patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], repeats: int = MOST, steps: int = STEPS
) -> list[int]:
    """Tokens that each pattern (its sources, its size) gives; the quotas are met as far as possible.

    The cost of a pattern's token lies on the way into the pattern alone and rises from one part of
    a copy to the next. The cheapest path thus always starts with the cheapest open part, and
    opening the parts in that order is the successive-shortest-path method.
    """
    n, m = len(patterns), len(quotas)
    source, sink = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, room: int) -> list:
        graph[a].append([b, room, len(graph[b])])
        graph[b].append([a, 0, len(graph[a]) - 1])
        return graph[a][-1]

    ways = [edge(source, p, 0) for p in range(n)]
    for p, (members, size) in enumerate(patterns):
        for s in members:
            edge(p, n + s, size * repeats)
    for s, quota in enumerate(quotas):
        edge(n + s, sink, quota)
    for part in range(repeats * steps):
        for way, (_, size) in zip(ways, patterns, strict=True):
            way[1] += size * (part + 1) // steps - size * part // steps
        _augment(graph, source, sink)
    return [graph[p][way[2]][1] for p, way in enumerate(ways)]


def _weighed(summed: DataFrame, weights: Sequence[float]) -> DataFrame:
    """source, size, patterns (how many have it) and weight of every source; nulls come last."""
    each = summed.select(F.explode("members").alias("source"), "size")
    sizes = each.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("patterns"))
    order = sizes.withColumns({"_none": F.col("source").isNull().cast("int"), "_name": F.coalesce("source", F.lit(""))})
    numbered = number_all(staged(order, "sources"), ["_none", "_name"], "_rank")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights)).cast("int"))
    return staged(numbered.select("source", "size", "patterns", weight.alias("weight")), "weighed")


def _level(sources: DataFrame, total: float, most: int) -> float:
    """The level at which shares min(cap, level x weight) add up to ``total``, as in ``targets``.

    Each round caps the sources that the level before is too high for; that raises the level, until no more are capped.
    """
    cap = F.col("size") * most
    capped, level = -1, 0.0
    while True:
        over = cap / F.col("weight") < level
        n, fixed, left = sources.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if n == capped or not left:
            return level if left else float("inf")
        capped, level = n, (total - fixed) / left


def _plan(summed: DataFrame, weights: Sequence[float], total: float, most: int) -> tuple[DataFrame, DataFrame]:
    """Sources (source, source_size, target), and patterns (members, copies, rest).

    A pattern whose only source no other one has gives that source's target. Only patterns that share sources go
    through the flow on the driver.
    """
    spark = summed.sparkSession
    sources = _weighed(summed, weights)
    everything = summed.where(F.size("members") > 0).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    level = F.lit(_level(sources, total * everything, most))
    target = F.least((F.col("size") * most).cast("double"), level * F.col("weight"))
    target = F.when(F.col("size") == 0, F.lit(0.0)).otherwise(target)
    aimed = staged(sources.select("source", F.col("size").alias("source_size"), target.alias("target"), "patterns"), "targets")

    own = summed.where(F.size("members") == 1).withColumn("source", F.get("members", F.lit(0))).drop("members")
    alone = aimed.where("patterns = 1").drop("source_size").withColumnRenamed("source", "_source")
    own = join_small(own, staged(alone, "alone"), F.col("source").eqNullSafe(F.col("_source")), "inner")
    given, size = F.floor("target").cast("long"), F.col("size")
    some = lambda x: F.when(size > 0, x).otherwise(F.lit(0)).cast("long")
    private = own.select(
        F.array("source").alias("members"), some(F.call_function("div", given, size)).alias("copies"), some(given % size).alias("rest")
    )

    shared = staged(aimed.where("patterns > 1"), "shared")
    mixed_ = summed.where(F.size("members") > 0).withColumn("source", F.explode("members"))
    mixed_ = join_small(mixed_, shared.select(F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s")), "left_semi")
    more = summed.where(F.size("members") > 1).select("members", "size").unionByName(mixed_.select("members", "size"))
    totals = more.distinct().orderBy("members").limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} combinations of sources overlap; merge rare sources first")
    rows = []
    if totals:
        names = sorted({s for r in totals for s in r["members"]}, key=lambda s: (s is None, s or ""))
        place = {s: i for i, s in enumerate(names)}
        asked = spark.createDataFrame([(n,) for n in names], "_s string")
        found = aimed.join(F.broadcast(asked), F.col("source").eqNullSafe(F.col("_s")), "left_semi").collect()
        wanted = [0] * len(names)
        for r in found:
            wanted[place[r["source"]]] = int(r["target"])
        patterns = [([place[s] for s in r["members"]], r["size"]) for r in totals]
        for r, g in zip(totals, flow(patterns, wanted, most), strict=True):
            rows.append((r["members"], *(divmod(g, r["size"]) if r["size"] else (0, 0))))
    without = summed.where(F.size("members") == 0).select("members", F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("rest"))
    planned = spark.createDataFrame(rows, "members array<string>, copies long, rest long")
    return aimed.drop("patterns"), staged(private.unionByName(planned).unionByName(without), "patterns")


def _chosen(units: DataFrame, patterns: DataFrame) -> DataFrame:
    """Units with ``copies``. The rest of a pattern goes to a prefix of its seeded order and to a few
    more units, each the one that fits best what is left open.

    The prefix is found by slices: sums of whole slices first, rows only in the slice that holds
    the cut. So the window over rows sees one of 4096 slices of a pattern.
    """
    key, by = ["members"], Window.partitionBy("members")
    sums = units.groupBy("members", "slice").agg(F.sum("tokens").alias("in_slice"))
    until = F.sum("in_slice").over(by.orderBy("slice"))
    places = join_small(sums.withColumn("before", until - F.col("in_slice")), patterns, key, "inner")
    places = places.select("members", "slice", "copies", "rest", "before", "in_slice")
    placed = staged(join_small(units, staged(places, "slices"), ["members", "slice"], "inner"), "placed")
    whole = F.col("before") + F.col("in_slice") <= F.col("rest")
    cut = ~whole & (F.col("before") <= F.col("rest"))
    order = Window.partitionBy("members", "slice").orderBy("order", F.col("doc_id").asc_nulls_last(), "size")
    first = placed.where(cut).withColumn("until", F.col("before") + F.sum("tokens").over(order))
    marked = (
        first.withColumn("taken", (F.col("until") <= F.col("rest")).cast("int"))
        .drop("until")
        .unionByName(placed.where(~cut).withColumn("taken", whole.cast("int")))
    )
    for _ in range(FILLS):
        marked = _filled(staged(marked, "marked"))
    copies = F.when(F.col("tokens") > 0, F.col("copies") + F.col("taken")).otherwise(0)
    return marked.select("doc_id", "members", "size", copies.alias("copies"))


def _filled(marked: DataFrame) -> DataFrame:
    """Take the unit of each pattern that fits best what its taken units leave open."""
    had = staged(_open(marked), "open")
    gap = F.abs(F.col("open") - F.col("tokens"))
    best = F.min(F.struct(gap.alias("gap"), "order", F.struct("doc_id", "size").alias("unit"))).alias("best")
    more = (
        join_small(marked.where("taken = 0 AND tokens > 0"), had, "members", "inner")
        .where(gap < F.col("open"))
        .groupBy("members")
        .agg(best)
        .select("members", F.col("best.order").alias("order"), F.col("best.unit").alias("unit"), F.lit(1).alias("more"))
    )
    found = join_small(marked.withColumn("unit", F.struct("doc_id", "size")), staged(more, "more"), ["members", "order", "unit"])
    return found.withColumn("taken", F.col("taken") + F.coalesce("more", F.lit(0))).select(*marked.columns)


def _open(marked: DataFrame) -> DataFrame:
    """What the taken units of each pattern leave open."""
    return marked.groupBy("members").agg((F.first("rest") - F.sum(F.col("taken") * F.col("tokens"))).alias("open"))


def mix(
    docs: DataFrame,
    members: Column,
    size: Column,
    weights: Sequence[float] = WEIGHTS,
    total: float = TOTAL,
    most: int = MOST,
    seed: str = SEED,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, members, size), their copies, and the sources with size and target.

    ``members`` is an array of a document's sources, ``size`` its tokens. Sources in code-point
    order, null last, have ``weights``, repeated as needed, and share ``total`` times all tokens; a
    source is asked for ``most`` times its size at most. The second result has one row per
    distinct (doc_id, members, size) with the number of copies, 0 to ``most``; the third has
    source, source_size and target.

    Rows that agree in all three are one unit and get the same copies. A null source is a source;
    a document without members is never taken. A null id takes part like any other, null and
    blank texts have size 0 and are not needed. Equal places in the seeded order are resolved by
    id and size. All results are the same in each run. An empty table gives empty results. Only
    the sums of patterns that share sources, at most ``MAX_PATTERNS``, reach the driver.
    """
    rows = staged(
        docs.select("doc_id", F.array_sort(F.array_distinct(members)).alias("members"), size.cast("long").alias("size")),
        "sizes",
    )
    order = F.md5(
        F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    )
    units = staged(
        rows.groupBy("doc_id", "members", "size")
        .agg((F.count(F.lit(1)) * F.col("size")).alias("tokens"))
        .withColumn("order", order)
        .withColumn("slice", F.substring("order", 1, DIGITS)),
        "units",
    )
    summed = staged(units.groupBy("members").agg(F.sum("tokens").alias("size")), "totals")
    sources, patterns = _plan(summed, weights, total, most)
    return rows, _chosen(units, patterns), sources


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as many times as it is taken, all columns kept.

    Rows that agree in id, source and size are taken alike. Null ids and sources take part, null and blank texts are
    never taken, texts of any length count whole, and columns beside doc_id, text and source are passed on whatever
    their names. Equal places are resolved as in ``mix``. An empty table gives an empty result.
    """
    members, size = F.array("source"), n_words(F.col("text"))
    _, units, _ = mix(docs, members, size, **options)
    taken = staged(units.where("copies > 0").select("doc_id", "members", "size", "copies"), "taken")
    renamed = taken.toDF("_id", "_members", "_size", "_copies")
    here = F.struct(F.col("doc_id"), members.alias("m"), size.alias("s"))
    on = F.xxhash64(here).eqNullSafe(F.col("_at")) & here["doc_id"].eqNullSafe(F.col("_id"))
    on = on & here["m"].eqNullSafe(F.col("_members")) & (here["s"] == F.col("_size"))
    at = renamed.withColumn("_at", F.xxhash64(F.struct(F.col("_id"), F.col("_members"), F.col("_size"))))
    joined = join_small(docs, at, on, "inner")
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")
    return joined.select(*[F.col(c) for c in docs.columns], copies).drop("_copy")
