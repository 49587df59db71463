"""Mixing overlapping sources to target weights by min-cost flow.

Documents are added up by *membership pattern*, the set of sources they belong
to. On this small graph tokens flow from patterns to the quotas of their
sources. A pattern gives each further copy of its tokens at a higher cost, so
the cheapest flow repeats nothing before everything unrepeated is used.
The flow into a pattern then says how many full copies of it are taken and how
many tokens of one more copy; that part goes to documents in the order of a
seeded digest, the last of them in part.

The order is never sorted as a whole: sizes are added up per pattern and
digest prefix, which finds the prefix that the part ends in, and only the
documents of that prefix are ordered. With ``PREFIX`` hexadecimal digits a
pattern is divided in 16 ** PREFIX parts, each a fair sample, however large the
pattern is.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a
source of its own, the last one; targets of sources without any words are 0.
Repeated rows of one id have the same digest; their order is then by size, and
rows equal in both share what is left for the first of them. An empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

PREFIX = 3
SEED = "mix-1"
#: Most patterns on the driver, where the flow is computed; more is an error,
#: as sources are a list that somebody writes weights for.
MOST_PATTERNS = 100_000


def word_count(text: Column) -> Column:
    """Runs of characters other than space and the controls 9 to 13; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """``share`` of all sizes by weight, no source above ``most`` times its size.

    What a stopped source leaves is shared among the others by weight, until
    none is above its stop.
    """
    left, open_ = share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0]
    result = [0.0] * len(sizes)
    while open_:
        each = left / sum(weights[i] for i in open_)
        stopped = [i for i in open_ if weights[i] * each > most * sizes[i]]
        if not stopped:
            for i in open_:
                result[i] = weights[i] * each
            break
        for i in stopped:
            result[i] = most * sizes[i]
            left -= result[i]
        open_ = [i for i in open_ if i not in set(stopped)]
    return result


def flow(supply: dict[tuple, int], quota: dict, copies: int) -> dict[tuple, dict]:
    """The cheapest flow from patterns to source quotas: pattern -> source -> tokens.

    Copy number ``c`` of a pattern's tokens costs ``c``. Successive shortest
    paths, each connected group of patterns and sources by itself.
    """
    result: dict[tuple, dict] = {}
    for patterns in _groups(supply):
        result |= _cheapest({p: supply[p] for p in patterns}, quota, copies)
    return result


def _groups(supply):
    """Patterns that share sources, directly or over others."""
    by_source = defaultdict(list)
    for pattern in supply:
        for source in pattern:
            by_source[source].append(pattern)
    seen = set()
    for first in supply:
        if first in seen:
            continue
        group, todo = [], [first]
        seen.add(first)
        while todo:
            pattern = todo.pop()
            group.append(pattern)
            for source in pattern:
                for other in by_source.pop(source, []):
                    if other not in seen:
                        seen.add(other)
                        todo.append(other)
        yield group


def _cheapest(supply, quota, copies):
    given = {p: dict.fromkeys(p, 0) for p in supply}
    used = dict.fromkeys(supply, 0)
    need = {s: quota.get(s, 0) for p in supply for s in p}
    takers = defaultdict(list)
    for pattern in supply:
        for source in pattern:
            takers[source].append(pattern)
    while True:
        # Dijkstra from the patterns with tokens left; moving tokens between
        # sources of a pattern is free, so a path costs what its first copy does
        heap = [(used[p] // supply[p], i, p) for i, p in enumerate(supply)
                if supply[p] and used[p] < copies * supply[p]]
        heapq.heapify(heap)
        came, at, number = {}, None, len(supply)
        reached = set()
        while heap and at is None:
            cost, _, pattern = heapq.heappop(heap)
            if pattern in reached:
                continue
            reached.add(pattern)
            for source in pattern:
                if ("s", source) in came:
                    continue
                came["s", source] = pattern
                if need[source] > 0:
                    at = source
                    break
                for other in takers[source]:
                    if other not in reached and given[other][source] > 0 \
                            and ("p", other) not in came:
                        came["p", other] = source
                        heapq.heappush(heap, (cost, number, other))
                        number += 1
        if at is None:
            return given
        path, source = [], at
        while True:
            pattern = came["s", source]
            path.append((pattern, source))
            if ("p", pattern) not in came:
                break
            source = came["p", pattern]
        first = path[-1][0]
        amount = min(need[at], supply[first] - used[first] % supply[first])
        for (giver, _), (_, freed) in zip(path, path[1:], strict=False):
            amount = min(amount, given[giver][freed])
        for i, (giver, to) in enumerate(path):
            given[giver][to] += amount
            if i + 1 < len(path):
                given[giver][path[i + 1][1]] -= amount
        used[first] += amount
        need[at] -= amount


def contract_weights(count: int) -> list[float]:
    """3, 1, 2, repeating."""
    return [float((3, 1, 2)[i % 3]) for i in range(count)]


def mix(docs: DataFrame, size: Column, sources: Column, weights=contract_weights,
        share: float = 1.5, most: int = 2, id_col: str = "doc_id",
        seed: str = SEED) -> DataFrame:
    """(id, size, sources, source_size, target, taken) of every row.

    ``sources`` is an array of names, in which null is a name too;
    ``source_size`` and ``target`` are sums over the row's sources. ``weights``
    maps the number of sources, in code point order and null last, to weights.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))
    rows = checkpointed(docs.select(
        F.col(id_col).alias("_id"), size.alias("size"),
        F.array_sort(F.array_distinct(sources)).alias("sources"), digest.alias("_digest")))
    sums = rows.groupBy("sources").agg(F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    plan = _plan([(tuple(r["sources"]), r["size"]) for r in sums], weights, share, most)
    spark = docs.sparkSession
    flows = spark.createDataFrame(
        [(i, list(p), *v) for i, (p, v) in enumerate(plan.items())],
        "_pattern int, sources array<string>, source_size long, target double, "
        "full long, part long")
    # a row a pattern; arrays with null names are equal too, and none is null
    known = rows.join(F.broadcast(flows), "sources")
    prefix = F.substring("_digest", 1, PREFIX)
    # where in the digest order each pattern's part ends, by prefix
    ends = known.filter(F.col("part") > 0).groupBy("_pattern", "part", prefix.alias("_prefix")).agg(
        F.sum("size").alias("n"))
    upto = Window.partitionBy("_pattern").orderBy("_prefix").rowsBetween(
        Window.unboundedPreceding, -1)
    ends = ends.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    ends = ends.filter((F.col("before") < F.col("part")) & (F.col("before") + F.col("n") >= F.col("part")))
    ends = {r["_pattern"]: (r["_prefix"], r["part"] - r["before"]) for r in ends.collect()}
    last = spark.createDataFrame(
        [(p, *v) for p, v in ends.items()], "_pattern int, _last string, _rest long")
    placed = known.join(F.broadcast(last), "_pattern", "left")
    base = F.col("full") * F.col("size")
    whole = F.when(prefix < F.col("_last"), F.col("size")).otherwise(F.lit(0))
    inside = F.col("_last").isNotNull() & (prefix == F.col("_last"))
    order = Window.partitionBy("_pattern").orderBy("_digest", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    outside = placed.filter(~inside | F.col("_last").isNull()).withColumn("taken", base + whole)
    ordered = placed.filter(inside).withColumn("_before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    room = F.least(F.greatest(F.col("_rest") - F.col("_before"), F.lit(0)), F.col("size"))
    ordered = ordered.withColumn("taken", base + room)
    columns = [F.col("_id").alias(id_col), "size", "sources", "source_size", "target", "taken"]
    return outside.select(*columns).union(ordered.select(*columns))


def _plan(sums, weights, share, most):
    """pattern -> (source_size, target, full copies, tokens of one more copy)."""
    names = {s for pattern, _ in sums for s in pattern}
    ordered = sorted(n for n in names if n is not None) + [None] * (None in names)
    size_of = dict.fromkeys(ordered, 0)
    for pattern, size in sums:
        for source in pattern:
            size_of[source] += size
    goal = dict(zip(ordered, targets([size_of[s] for s in ordered], weights(len(ordered)),
                                     share, most), strict=True))
    moved = flow(dict(sums), {s: round(t) for s, t in goal.items()}, most)
    plan = {}
    for pattern, size in sums:
        out = sum(moved[pattern].values())
        full, part = divmod(out, size) if size else (0, 0)
        plan[pattern] = (sum(size_of[s] for s in pattern), float(sum(goal[s] for s in pattern)),
                         full, part)
    return plan
