"""Mixing sources to target weights by minimum-cost flow.

Documents are added up by membership pattern (the set of sources that they belong to), so that the flow's network has a
node for each pattern and source, not for each document. A pattern's tokens can be taken once for nothing and again at a
cost that grows with each repetition; they flow to the quotas of its sources. A document larger than what its pattern is to
give is left out, and the others repeat the more. Those that fill a pattern's last, partial repetition are taken in a
seeded order up to the first that does not fit; the gap is filled by documents that do, large ones first.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import broadcast_if_small, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the seeded order that make a bucket: 4096 of them for each pattern.
BUCKET_DIGITS = 3


def target_sizes(sizes: dict[str | None, int], weights: list[float], max_repeat: int) -> dict[str | None, float]:
    """Shares of the whole size by weight, none above max_repeat times its source's; what is above goes to the others.

    Sources are ordered by code point, null last; weights repeat along them.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, shared, out = sum(sizes.values()), sum(weight.values()), {}
    for s in sorted(order, key=lambda s: (max_repeat * sizes[s] / weight[s], s is None, s or "")):
        most = max_repeat * sizes[s]
        if weight[s] * (left / shared) <= most:
            break
        out[s] = float(most)
        left, shared = left - most, shared - weight[s]
    return out | {s: weight[s] * (left / shared) for s in order if s not in out}


def route(patterns: dict[tuple, int], quotas: dict, max_repeat: int) -> dict[tuple, int]:
    """Tokens to take of each pattern: a flow of least cost from patterns (members: tokens) to quotas.

    Successive shortest paths with potentials; the n-th repetition of a pattern costs n for each token.
    """
    arcs: list[list] = []  # to, room, cost; arc ^ 1 is its reverse
    out_of = defaultdict(list)

    def arc(a: object, b: object, room: int, cost: int) -> None:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            out_of[x].append(len(arcs))
            arcs.append([y, r, c])

    for i, (members, tokens) in enumerate(sorted(patterns.items(), key=str)):
        for n in range(max_repeat):
            arc("from", ("p", members), tokens, n)
        for s in members:
            arc(("p", members), ("s", s), max_repeat * tokens, 0)
    for s, quota in quotas.items():
        arc(("s", s), "to", int(quota), 0)
    height: dict = defaultdict(int)
    while True:
        far, via, heap, k = {"from": 0}, {}, [(0, 0, "from")], 0
        while heap:
            d, _, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for i in out_of[x]:
                y, room, cost = arcs[i]
                if room and d + cost + height[x] - height[y] < far.get(y, 1 << 60):
                    far[y], via[y], k = d + cost + height[x] - height[y], i, k + 1
                    heapq.heappush(heap, (far[y], k, y))
        if "to" not in far:
            break
        for x, d in far.items():
            height[x] += min(d, far["to"])
        for x in [x for x in out_of if x not in far]:
            height[x] += far["to"]
        path, x = [], "to"
        while x != "from":
            path.append(via[x])
            x = arcs[via[x] ^ 1][0]
        push = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= push
            arcs[i ^ 1][1] += push
    return {m: sum(arcs[i ^ 1][1] for i in out_of["from"] if arcs[i][0] == ("p", m)) for m in patterns}


def fill(gap: int, sizes: list[tuple[int, int, int]], levels: int) -> list[tuple[int, int, int]]:
    """(size, level, documents) that fill a gap: sizes: (size, documents not taken again yet, all documents). Large ones go first; a
    document gets a second further copy (level 2) only when no other that would fit is left."""
    out = []
    for level in range(1, levels + 1):
        for size, fresh, n in sorted(sizes, reverse=True):
            take = min(fresh if level == 1 else n, gap // size)
            if take:
                out.append((size, level, take))
                gap -= take * size
    return out


def mix_sources(
    docs: DataFrame, sources: Column | None = None, weights: tuple[float, ...] = (1, 2, 3), max_repeat: int = 3, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """docs with ``mix_size`` (words of the text), ``mix_copies`` (how often the mix takes it), ``mix_members``,
    ``mix_source_sizes`` and ``mix_targets`` (the sources it belongs to, their sizes and targets).

    sources: array of the sources of a row (default: the column source alone); a null is a source of its own, and a null
    or empty array means no source, whose rows have no copy. Targets share the sum of all sizes by weight. A null or
    empty text has size 0; rows of equal id, size and sources are taken together. All rows and columns stay; columns of
    those names are replaced. An empty table gives an empty one. The driver holds a row for each membership pattern.
    What a pattern gives falls short of its part by less than the smallest document that may still be repeated. The same
    rows give the same mix again, in whatever order and partitions they come.
    """
    sources = F.array(F.col("source")) if sources is None else F.coalesce(sources, F.array().cast("array<string>"))
    members = F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("")))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    full = docs.withColumns({"mix_size": F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long"), "_members": members, "_key": key})
    units = full.groupBy("_members", "_key", F.col("mix_size").alias("_size")).agg(F.sum("mix_size").alias("_weight"))
    units = materialize(units)

    found = units.groupBy("_members").agg(F.sum("_weight").alias("n")).collect()
    name = lambda m: m[1:] if m else None
    patterns = {tuple(r["_members"]): r["n"] for r in found}
    sizes: dict[str | None, int] = defaultdict(int)
    for members_, n in patterns.items():
        for m in members_:
            sizes[name(m)] += n
    total = sum(n for m, n in patterns.items() if m)
    # overlapping sources count a document for each of them; their targets share the tokens that there are
    targets = target_sizes(dict(sizes), list(weights), max_repeat) if sizes else {}
    over = sum(sizes.values())
    if over > total > 0:
        targets = {s: t * total / over for s, t in targets.items()}
    flow = route({m: n for m, n in patterns.items() if m}, {m: targets[name(m)] for p in patterns for m in p}, max_repeat)

    spark = docs.sparkSession
    table = lambda rows, schema: materialize(spark.createDataFrame(rows, schema))
    wanted = broadcast_if_small(table([(list(m), flow.get(m, 0)) for m in patterns], "_members array<string>, _wanted long"))
    able = units.join(wanted, "_members").where("_weight <= _wanted").groupBy("_members").agg(F.sum("_weight").alias("n")).collect()
    able = {tuple(r["_members"]): r["n"] for r in able}
    whole = {m: min(flow.get(m, 0) // able[m], max_repeat) if able.get(m) else 0 for m in patterns}
    rest = {m: flow.get(m, 0) - whole[m] * able.get(m, 0) if m and whole[m] < max_repeat else 0 for m in patterns}
    plan = [(list(m), flow.get(m, 0), whole[m], rest[m], [name(x) for x in m], [sizes[name(x)] for x in m], [float(targets[name(x)]) for x in m]) for m in patterns]
    plan_df = table(plan, "_members array<string>, _wanted long, _whole long, _rest long, mix_members array<string>, mix_source_sizes array<long>, mix_targets array<double>")

    bucket = F.substring("_key", 1, BUCKET_DIGITS)
    fit = units.join(broadcast_if_small(plan_df).select("_members", "_rest"), "_members").where("_weight <= _rest").withColumn("_bucket", bucket)
    upto = Window.partitionBy("_members").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = fit.groupBy("_members", "_rest", "_bucket").agg(F.sum("_weight").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    edge = materialize(sums.where("_before <= _rest AND _before + n > _rest").select("_members", "_bucket", "_before"))
    upto = Window.partitionBy("_members").orderBy("_key", "_size").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = fit.join(broadcast_if_small(edge), ["_members", "_bucket"])
    first = materialize(at_edge.withColumn("_sum", F.sum("_weight").over(upto) + F.col("_before")).where("_sum <= _rest").select("_members", "_key", "_size", "_sum", F.lit(True).alias("_first")))
    reached = {tuple(r["_members"]): r["n"] for r in sums.where("_before + n <= _rest").groupBy("_members").agg(F.max(F.col("_before") + F.col("n")).alias("n")).collect()}
    reached |= {tuple(r["_members"]): r["n"] for r in first.groupBy("_members").agg(F.max("_sum").alias("n")).collect()}
    gaps = {m: rest[m] - reached.get(m, 0) for m in patterns}

    plan_df = materialize(plan_df.join(edge.drop("_before"), "_members", "left").join(table([(list(m), g) for m, g in gaps.items()], "_members array<string>, _gap long"), "_members"))
    taken = (F.col("_weight") <= F.col("_rest")) & (F.col("_rest") > 0) & (F.coalesce(bucket < F.col("_bucket"), F.col("_bucket").isNull()) | F.coalesce("_first", F.lit(False)))
    small = units.join(broadcast_if_small(plan_df).select("_members", "_rest", "_bucket", "_gap"), "_members").where("_weight > 0 AND _weight <= _gap")
    small = small.join(broadcast_if_small(first.drop("_sum")), ["_members", "_key", "_size"], "left").withColumn("_taken", taken)
    small = materialize(small.select("_members", "_key", "_size", "_weight", "_taken"))
    there = small.groupBy("_members", "_weight").agg(F.count_if(~F.col("_taken")).alias("fresh"), F.count("*").alias("n")).collect()  # sizes below a gap
    held = defaultdict(list)
    for r in there:
        held[tuple(r["_members"])].append((r["_weight"], r["fresh"], r["n"]))
    fills = [(list(m), w, level, n) for m, h in held.items() for w, level, n in fill(gaps[m], h, max_repeat - whole[m])]
    fills_df = table(fills, "_members array<string>, _weight long, level int, take long")
    ranked = small.join(broadcast_if_small(fills_df), ["_members", "_weight"]).where("level > 1 OR NOT _taken")
    order = Window.partitionBy("_members", "_weight", "level").orderBy("_key", "_size")
    most = max((f[3] for f in fills), default=0)
    ranked = ranked.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).where("rn <= take")  # the first of the two limits what is sorted
    more = materialize(ranked.groupBy("_members", "_key", "_size").agg(F.count("*").alias("_more")))

    repeated = materialize(units.where("_weight > _size").select("_members", "_key", "_size", "_weight"))
    on = ["_members", "_key", "_size"]
    out = full.withColumnRenamed("mix_size", "_size").join(broadcast_if_small(plan_df), "_members")
    for extra in (repeated, first.drop("_sum"), more):
        out = out.join(broadcast_if_small(extra), on, "left")
    out = out.withColumn("_weight", F.coalesce("_weight", "_size"))
    copies = F.when(F.col("_weight") <= F.col("_wanted"), F.col("_whole")).otherwise(0) + taken.cast("long") + F.coalesce("_more", F.lit(0))
    copies = F.when(F.size("_members") == 0, 0).otherwise(copies).cast("long")
    mixed = ["mix_size", "mix_copies", "mix_members", "mix_source_sizes", "mix_targets"]
    return out.withColumns({"mix_copies": copies, "mix_size": F.col("_size")}).select(*[c for c in docs.columns if c not in mixed], *mixed)
