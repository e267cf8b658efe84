"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow network
routes each pattern's words to the quotas of its sources: a first pass over a document is cheap and
each repetition dearer (convex costs), so words are repeated only where quotas need it. The flow of
a pattern is then given to its documents in a seeded order.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textvec
from .common import Scratch, components, gathered, hot_keys, partitions, split_join

#: Buckets of the seeded order: a pattern's documents are cut at a bucket, and ordered in that one only.
BUCKETS = 4096
#: Rows of a plan that is broadcast, one a pattern; a longer one is joined with hot patterns dealt to parts.
FEW = 10_000


def min_cost_flow(edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flows of (from, to, capacity, cost) edges in a maximum flow of least cost (successive shortest paths with potentials)."""
    graph: dict[int, list[int]] = defaultdict(list)
    to, cap, cost = [], [], []
    for a, b, c, w in edges:
        for x, y, room, price in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            cap.append(room)
            cost.append(price)
    potential: dict[int, int] = defaultdict(int)  # costs are not negative at first
    while True:
        best, by, heap = {source: 0}, {}, [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > best[x]:
                continue
            for e in graph[x]:
                y, reduced = to[e], d + cost[e] + potential[x] - potential[to[e]]
                if cap[e] > 0 and reduced < best.get(y, 1 << 62):
                    best[y], by[y] = reduced, e
                    heapq.heappush(heap, (reduced, y))
        if sink not in best:
            return [cap[2 * i + 1] for i in range(len(edges))]
        far = max(best.values())
        for x in set(graph):
            potential[x] += best.get(x, far)
        path, x = [], sink
        while x != source:
            path.append(by[x])
            x = to[by[x] ^ 1]
        room = min(cap[e] for e in path)
        for e in path:
            cap[e] -= room
            cap[e ^ 1] += room


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: Sequence[int], most: int) -> list[int]:
    """Words to take of each (sources, words) pattern; quotas by source; at most ``most`` passes over a document."""
    n, edges = len(patterns), []
    source, sink = -1, -2
    for p, (members, words) in enumerate(patterns):
        edges += [(source, p, words, 2 * k + 1) for k in range(most)]  # the k-th repetition costs more than the last
        edges += [(p, n + s, most * words, 0) for s in members]
    edges += [(n + s, sink, q, 0) for s, q in enumerate(quotas)]
    flows, taken = min_cost_flow(edges, source, sink), [0] * n
    for (a, b, _, _), f in zip(edges, flows):
        if a == source:
            taken[b] += f
    return taken


def sizes(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """``keep`` columns and ``size``, the number of words [^\\x20\\x09-\\x0D]+ of the text (null: 0)."""
    chosen = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = chosen.drop("__text").schema.add("size", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(textvec.word_counts(batch.column(batch.num_columns - 1)), pa.int64())], schema.names)

    return chosen.mapInArrow(run, schema)


def unit_of(classes, weights: Sequence[float], total: float, most: float) -> float:
    """The words that a weight of 1 gets, so that shares of min(weight * unit, most * size) add up to ``total``.

    classes(unit) gives, for each weight, how many sources are not full at a unit and the words of
    those that are. Units only rise from round to round, as full sources leave more to the others.
    """
    unit, before = 0.0, None
    while True:
        now = classes(unit)
        if now == before or not any(n for n, _ in now):
            return unit if any(n for n, _ in now) else float("inf")
        unit = (total - most * sum(words for _, words in now)) / sum(n * w for (n, _), w in zip(now, weights))
        before = now


def _ranked(names: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, words, place) with places 0, 1, ... in the order of code points, null last: ranges are sorted apart and numbered by the sizes of those before."""
    ordered = names.withColumn("none", F.col("source").isNull()).repartitionByRange(partitions(names.sparkSession), "none", "source").sortWithinPartitions("none", "source")
    ordered = scratch.write(ordered.withColumn("at", F.monotonically_increasing_id()))
    at, sizes_, first = F.shiftright("at", 33), {}, 0
    for r in sorted(ordered.groupBy(at.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a partition
        sizes_[r["part"]], first = first, first + r["n"]
    if not sizes_:
        return ordered.select("source", "words", F.lit(0).cast("long").alias("place"))
    before = F.create_map(*[F.lit(x).cast("long") for kv in sizes_.items() for x in kv])
    return ordered.select("source", "words", (before[at] + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def _routed(patterns: DataFrame, parts: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """(pattern, taken): the words to take of each pattern, by a flow for each component of overlapping sources.

    patterns: pattern, words, n_sources; parts: pattern, place, quota (a row for each of a pattern's
    sources). A source that no pattern shares has a flow of one edge, which needs no search.
    """
    shared = patterns.where("n_sources > 1").select("pattern")
    alone = parts.join(patterns.select("pattern", "words"), "pattern").groupBy("pattern").agg(F.least(F.max("quota"), most * F.max("words")).alias("taken"))
    none = patterns.where("n_sources = 0").select("pattern", F.lit(0).cast("long").alias("taken"))
    if shared.isEmpty():
        return alone.unionByName(none)
    edges = parts.select((2 * F.col("pattern") + 1).alias("u"), (2 * F.col("place")).alias("v"))
    component = components(edges, scratch).where("node % 2 = 1").select(((F.col("node") - 1) / 2).cast("long").alias("pattern"), "component")
    wide = component.join(shared, "pattern").select("component").distinct()
    component = scratch.write(component.join(wide, "component"))

    def flow(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["pattern", "words", "place", "quota"]).to_pylist(), key=lambda r: (r["pattern"], r["place"]))
        at = {s: i for i, s in enumerate(sorted({r["place"] for r in rows}))}
        quotas = [0] * len(at)
        words, members = {}, defaultdict(list)
        for r in rows:
            words[r["pattern"]], quotas[at[r["place"]]] = r["words"], r["quota"]
            members[r["pattern"]].append(at[r["place"]])
        taken = route([(tuple(members[p]), w) for p, w in words.items()], quotas, most)
        return pa.table({"pattern": pa.array(list(words), pa.int64()), "taken": pa.array(taken, pa.int64())})

    joined = parts.join(patterns.select("pattern", "words"), "pattern").join(component, "pattern")
    flows = joined.groupBy("component").applyInArrow(flow, "pattern bigint, taken bigint")
    return flows.unionByName(alone.join(component, "pattern", "left_anti")).unionByName(none)


def mix(docs: DataFrame, members: Column, weights: Sequence[float], total: float, most: int = 2, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), scratch: Scratch | None = None) -> DataFrame:
    """How many words of each document a mix takes: id, sources, size, source_size, target, taken, plus ``passes`` and the columns in ``keep``.

    members: array<string> of the sources a document belongs to (a null in it is a source too; an
    empty or null array: none, nothing is taken). Sources are ordered by code point, null last, and
    weigh ``weights``, repeating; they share ``total`` times the words of all documents, none more
    than ``most`` times its own; no document more than ``most`` times its size.
    ``source_size`` and ``target`` are sums over the document's sources. A source's taken words are
    its target, rounded, as far as overlapping sources allow: whole passes in a seeded order, and
    the words that still lack from one last document of a pattern.

    Reruns agree, also on other partitionings; rows with the same id share their order and are cut
    together in an order of their size and text. Rows without an id are ordered by their texts. Null
    texts have size 0. An empty table gives an empty result. Only the named columns are read.

    Sources and patterns stay distributed, however many they are; the driver gets a row for each
    weight, and one for each partition. Patterns whose sources overlap are routed together, a task
    for each component of overlapping sources: such a component must fit in one.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    canonical = F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>"))), lambda a, b: F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), 1).when(b.isNull(), -1).when(a < b, -1).when(a > b, 1).otherwise(0))
    rank = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.col(text_col)))
    bucket_of = F.pmod(F.shiftrightunsigned("__rank", 40), F.lit(BUCKETS)).cast("int")
    chosen = [F.col(id_col), canonical.alias("sources"), rank.alias("__rank")]
    counted = sizes(docs, text_col, chosen).withColumn("__bucket", bucket_of)
    rows = sizes(docs, text_col, [*chosen, F.xxhash64(text_col).alias("__tie"), *(F.col(c) for c in keep)]).withColumn("__bucket", bucket_of)
    cells = scratch.write(counted.groupBy("sources", "__bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")))  # BUCKETS rows a pattern at most

    patterns = cells.groupBy("sources").agg(F.sum("words").alias("words"), F.sum("n").alias("n")).withColumn("n_sources", F.size("sources"))
    patterns = scratch.write(patterns.withColumn("pattern", F.monotonically_increasing_id()))
    parts = patterns.select("pattern", "words", F.explode("sources").alias("source"))
    names = scratch.write(_ranked(parts.groupBy("source").agg(F.sum("words").alias("words")), scratch))
    everything = patterns.agg(F.sum("words").alias("words"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("patterns")).first()
    cls = F.pmod(F.col("place"), F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), cls + 1)

    def classes(unit: float) -> list[tuple[int, int]]:
        full = weight * unit >= most * F.col("words")
        got = names.where("words > 0").groupBy(cls.alias("c")).agg(F.count_if(~full).alias("n"), F.coalesce(F.sum(F.when(full, F.col("words"))), F.lit(0)).alias("words")).collect()  # a row for each weight
        of = {r["c"]: (r["n"], r["words"]) for r in got}
        return [of.get(k, (0, 0)) for k in range(len(weights))]

    own = names.agg(F.sum("words").alias("w")).first()["w"] or 0
    unit = unit_of(classes, [float(w) for w in weights], min(total * (everything["words"] or 0), most * own), most)
    target = F.least(weight * unit, (most * F.col("words")).cast("double"))
    names = names.select("source", "place", F.col("words").alias("source_size"), target.alias("target"))
    met = F.col("source").eqNullSafe(F.col("name"))
    parts = scratch.write(parts.join(names.withColumnRenamed("source", "name"), met).select("pattern", "place", "source_size", "target", F.rint("target").cast("long").alias("quota")))

    taken = _routed(patterns, parts.select("pattern", "place", "quota"), most, scratch)
    in_order = F.array_sort(F.collect_list(F.struct("place", "target")))
    sums = parts.groupBy("pattern").agg(F.sum("source_size").alias("source_size"), F.aggregate(in_order, F.lit(0.0), lambda a, x: a + x["target"]).alias("target"))
    whole = F.col("words") > 0
    plan = patterns.join(taken, "pattern").join(sums, "pattern", "left").select(
        "pattern", "sources", "words", "n", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"),
        F.when(whole, F.floor(F.col("taken") / F.col("words"))).otherwise(0).cast("long").alias("__base"), F.when(whole, F.pmod("taken", "words")).otherwise(0).cast("long").alias("left"),
    )
    so_far = Window.partitionBy("pattern").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = cells.select("sources", "__bucket", F.col("words").alias("here")).join(plan.select("pattern", "sources", "left"), "sources").withColumn("upto", F.sum("here").over(so_far))
    cut = upto.where(F.col("upto") > F.col("left")).groupBy("pattern").agg(F.min("__bucket").alias("__cut"), F.min_by(F.col("left") - F.col("upto") + F.col("here"), "__bucket").alias("__left"))  # where the last pass ends
    plan = scratch.write(plan.join(cut, "pattern", "left").select(F.col("pattern").alias("__pattern"), "sources", "source_size", "target", "__base", F.coalesce("__cut", F.lit(BUCKETS)).alias("__cut"), F.coalesce("__left", F.lit(0)).cast("long").alias("__left")))
    if everything["patterns"] <= FEW:
        planned = rows.join(F.broadcast(plan), "sources")
    else:
        planned = split_join(rows, plan, ["sources"], gathered(hot_keys(patterns, ["sources"], everything["n"])), ["__rank"])
    order = Window.partitionBy("__pattern").orderBy("__rank", "size", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    last = planned.where(F.col("__bucket") == F.col("__cut")).withColumn("__before", F.sum("size").over(order) - F.col("size"))
    rest = planned.where(F.col("__bucket") != F.col("__cut")).withColumn("__before", F.when(F.col("__bucket") < F.col("__cut"), F.lit(None)).otherwise(F.col("__left")))
    extra = F.coalesce(F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("__left") - F.col("__before"))), F.col("size"))
    out = last.unionByName(rest).withColumn("taken", F.col("__base") * F.col("size") + extra)
    passes = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(F.lit(0)).cast("int")
    return out.select(id_col, "sources", "size", "source_size", "target", "taken", passes.alias("passes"), *keep)
