"""Transitive closure of a whole edge relation in a form no larger than it has to be, made into pairs only where it is read.

Nodes that reach one another are one component: its pairs are all pairs of its members, so only the members are kept, in blocks.
Where no node has two successors (or none two predecessors), what a node reaches is one list, made by doubling: no pair is found
twice, so none is compared with those known. Any other acyclic rest is closed by rounds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cinderlog.functions.scratch import stored, stored_counted
from cinderlog.operators.relation import Relation

#: Edges up to which components are found in the driver's memory (some 300 bytes an edge at most), and bytes of their names.
LOCAL_EDGES, LOCAL_BYTES = 2_000_000, 64_000_000
#: Members of a block, least and most; pairs that a task of the expansion makes.
BLOCK, TASK_PAIRS = (256, 4096), 16_000_000


def closed(spark: SparkSession, e: Relation, by_rounds: Callable[[Relation], Relation], least: int = 1) -> Relation | None:
    """The closure of distinct edges, or None where only rounds will do. by_rounds: closes acyclic edges. least: members of the largest
    component below which rounds are to do it."""
    if len(e.kinds) != 2 or e.kinds[0] != e.kinds[1] or e.kinds[0] not in ("long", "string") or e.n is None:
        return None
    size = F.greatest(*(F.octet_length(c) if e.kinds[0] == "string" else F.lit(8) for c in e.columns))
    nulls, most = e.df.select(F.count_if(F.col("c0").isNull() | F.col("c1").isNull()), F.coalesce(F.sum(size), F.lit(0))).first()
    if nulls:  # they equal nothing, so they are no nodes
        return None
    if e.n > LOCAL_EDGES or most > LOCAL_BYTES:
        return lists(e)
    found = condensed(spark, e, least)
    if found is None:
        return None if least > 1 else lists(e) or by_rounds(e)
    members, between = found
    rest = None if between is None else lists(between) or by_rounds(between)
    return Relation(expanded(members, rest and rest.df), e.kinds)


def _forks(df: DataFrame, c: str) -> bool:
    return not df.groupBy(c).count().filter("count > 1").isEmpty()


def lists(e: Relation) -> Relation | None:
    """The closure where no node has two successors, or none two predecessors; None elsewhere."""
    a, b = ("c0", "c1") if not _forks(e.df, "c0") else ("c1", "c0")
    if a == "c1" and _forks(e.df, "c1"):
        return None
    # after round k an open list has the next 2**k nodes; it is whole once it ends or comes to a node again
    now, n = e.df.select(F.col(a).alias("x"), F.array(b).alias("path"), F.lit(True).alias("open")), e.n
    whole: list[DataFrame] = []
    while n:
        known = now
        for part in whole:
            known = known.union(part)
        more = known.select(F.col("x").alias("y"), F.col("path").alias("more"), F.col("open").alias("on"))
        both = F.array_distinct(F.concat("path", "more"))
        longer = (
            now.filter("open").withColumn("y", F.element_at("path", -1)).join(more, "y", "left")
            .select("x", F.when(F.col("on").isNull(), F.col("path")).otherwise(both).alias("path"),
                    (F.coalesce("on", F.lit(False)) & (F.size(both) == F.size("path") + F.size("more"))).alias("open"))
        )
        whole.append(now.filter("NOT open"))
        seen = Observation()
        now = stored(longer.observe(seen, F.count_if("open").alias("n")), "lists")
        n = int(seen.get.get("n", 0))
    whole.append(now)
    out = None
    for part in whole:
        pairs = part.select(F.col("x").alias(a), F.explode("path").alias(b)).select("c0", "c1")
        out = pairs if out is None else out.union(pairs)
    return Relation(out, e.kinds)


def condensed(spark: SparkSession, e: Relation, least: int = 1) -> tuple[DataFrame, Relation | None] | None:
    """Members (r: a member that names its component, m: a list of members) of the components with pairs of their own, and the edges
    between components, where there are any; None where no such component has so many members."""
    table = e.df.toArrow().combine_chunks()
    ends = [pa.concat_arrays(c.chunks) if c.num_chunks != 1 else c.chunk(0) for c in (table["c0"], table["c1"])]
    coded = pa.concat_arrays(ends).dictionary_encode()
    names, (a, b) = coded.dictionary, np.split(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), 2)
    del table, ends, coded
    of = components(a, b, len(names))
    inside = of >= 0
    if np.bincount(of[inside], minlength=1).max() < least:
        return None
    order = np.flatnonzero(inside)[np.argsort(of[inside], kind="stable")]
    _, first, sizes = np.unique(of[order], return_index=True, return_counts=True)
    named = np.arange(len(names))
    named[order] = np.repeat(order[first], sizes)
    starts, owner = [], []
    for at, n, r in zip(first.tolist(), sizes.tolist(), order[first].tolist()):
        step = min(max(BLOCK[0], n // 64), BLOCK[1])
        starts += range(at, at + n, step)
        owner += [r] * -(-n // step)
    lists_ = pa.LargeListArray.from_arrays(pa.array([*starts, len(order)], pa.int64()), names.take(pa.array(order)))
    members = pa.table({"r": names.take(pa.array(owner, pa.int64())), "m": lists_})
    pairs = np.unique(np.stack([named[a], named[b]], 1)[named[a] != named[b]], axis=0)
    between = None
    if len(pairs):
        df, n = stored_counted(spark.createDataFrame(pa.table({f"c{i}": names.take(pa.array(pairs[:, i])) for i in (0, 1)})), "between")
        between = Relation(df, e.kinds, n=n)
    return stored(spark.createDataFrame(members), "members"), between


def components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The strongly connected component of each of n nodes, -1 for a node that doesn't reach itself."""
    of = np.full(n, -1)
    while len(a):  # what has no edge in or none out is in no cycle
        keep = (np.bincount(b, minlength=n) > 0)[a] & (np.bincount(a, minlength=n) > 0)[b]
        gone = len(a) - np.count_nonzero(keep)
        a, b = a[keep], b[keep]
        if gone * 100 <= len(a):
            break
    if not len(a):
        return of
    core, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = np.split(at, 2)
    by = np.argsort(a, kind="stable")
    succ, ends = b[by].tolist(), np.cumsum(np.bincount(a, minlength=len(core))).tolist()
    got = np.array(_tarjan(succ, ends))
    large = np.bincount(got)[got] > 1
    large[a[a == b]] = True
    of[core] = np.where(large, got, -1)
    return of


def _tarjan(succ: list[int], ends: list[int]) -> list[int]:
    n = len(ends)
    place, low, of, at = [0] * n, [0] * n, [-1] * n, [0, *ends[:-1]]
    stack, count, found = [], 0, 0
    for root in range(n):
        if place[root]:
            continue
        work = [root]
        while work:
            v = work[-1]
            if not place[v]:
                count += 1
                place[v] = low[v] = count
                stack.append(v)
            i, end, lo = at[v], ends[v], low[v]
            child = -1
            while i < end:
                w = succ[i]
                i += 1
                if not place[w]:
                    child = w
                    break
                if of[w] < 0 and place[w] < lo:
                    lo = place[w]
            at[v], low[v] = i, lo
            if child >= 0:
                work.append(child)
                continue
            work.pop()
            if lo == place[v]:
                while True:
                    w = stack.pop()
                    of[w] = found
                    if w == v:
                        break
                found += 1
            if work and lo < low[work[-1]]:
                low[work[-1]] = lo
    return of


def _gathered(df: DataFrame, by: str, what: str) -> DataFrame:
    """(r, l): the values of a column in lists of about BLOCK[1] at most, for each value of the other."""
    many = df.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / BLOCK[1]).alias("k"))
    return df.join(many, by).groupBy(F.col(by).alias("r"), F.pmod(F.xxhash64(what), "k").alias("k")).agg(F.collect_list(what).alias("l")).select("r", "l")


def expanded(members: DataFrame, rest: DataFrame | None) -> DataFrame:
    """All pairs. rest: the closure of the edges between components. Lists are joined, a pair of lists for up to millions of pairs, and
    dealt out; pairs are made of them in the task that reads them."""
    sources, targets, direct = members.select("r", F.col("m").alias("l")), members.select("r", F.col("m").alias("t")), None
    pairs = None
    if rest is not None:
        rest = stored(rest, "rest")
        names = members.select("r").distinct()
        out = rest.join(names.select(F.col("r").alias("c0")), "c0", "left_semi").select("c0", "c1")
        into = rest.join(names.select(F.col("r").alias("c0")), "c0", "left_anti").select("c0", "c1")
        ends = names.select(F.col("r").alias("c1"))
        direct = into.join(ends, "c1", "left_anti").select("c0", "c1")
        beyond = out.join(targets.withColumnRenamed("r", "c1"), "c1").select(F.col("c0").alias("r"), "t")
        beyond = beyond.union(_gathered(out.join(ends, "c1", "left_anti"), "c0", "c1").select("r", F.col("l").alias("t")))
        pairs = sources.join(beyond, "r").select("l", "t")
        sources = sources.union(_gathered(into.join(ends, "c1", "left_semi"), "c1", "c0"))
    own = sources.join(targets, "r").select("l", "t")
    pairs = own if pairs is None else pairs.union(own)
    seen = Observation()
    kept = stored(pairs.observe(seen, F.sum(F.size("l").cast("long") * F.size("t")).alias("n")), "pairs")
    tasks = -(-int(seen.get.get("n") or 1) // TASK_PAIRS)
    made = kept.repartition(tasks).select("l", F.explode("t").alias("c1")).select(F.explode("l").alias("c0"), "c1")
    return made if direct is None else made.union(direct)
