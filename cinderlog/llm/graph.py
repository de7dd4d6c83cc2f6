"""Connected components of a graph given by links, as rounds of equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.scratch import stored, stored_counted


FILE_ROWS = 1_000_000  # of a stored table


LOW = (1 << 32) - 1


def _half(x: Column, turn: int) -> Column:
    return F.xxhash64(x, F.lit(turn)).bitwiseAND(F.lit(LOW))


def shuffled(x: Column, turn: int) -> Column:
    """A bijection of longs, another one each turn, by two Feistel rounds on their halves. Turn 0 changes nothing."""
    if not turn:
        return x
    high, low = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(LOW))
    low = low.bitwiseXOR(_half(high, turn))
    return F.shiftleft(high.bitwiseXOR(_half(low, turn)), 32).bitwiseOR(low)


def unshuffled(x: Column, turn: int) -> Column:
    """The inverse of shuffled()."""
    if not turn:
        return x
    high, low = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(LOW))
    high = high.bitwiseXOR(_half(low, turn))
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseXOR(_half(high, turn)))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every end of a link; root is one node of its component. links: a, b (long).

    Each round every node takes the first of itself and its neighbours as parent, parents are followed one step
    further, and links are contracted to links between parents. First is by number in the first round and every
    other one after it, which takes in stars around a least node at once, and by a shuffled order, another each
    time, in the rounds between: there at most three quarters of the nodes are left in expectation, whatever the
    graph, so that long chains in order of their numbers take few rounds, too. Minima are aggregated before they
    are shuffled. Joins are from many rows to one row a key, both read from stored tables, so adaptive execution can
    split a node with very many links. Nothing of the graph goes to the driver.
    """
    edges, n = stored_counted(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots, most, rounds = None, 2 * n, 0
    while n:
        turn = rounds if rounds % 2 else 0
        rounds += 1
        files, root_files = 1 + 2 * n // FILE_ROWS, 1 + most // FILE_ROWS  # no table in more, and so tiny, files than its rows ask for
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        first = ends.groupBy("node").agg(F.min(shuffled(F.col("other"), turn)).alias("_m"))
        parents = stored(first.select("node", unshuffled(F.least(shuffled(F.col("node"), turn), "_m"), turn).alias("up")).coalesce(files), "parents")
        above = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parents = stored(parents.join(above, "up").select("node", F.col("top").alias("up")).coalesce(files), "parents")
        if roots is None:
            roots = parents.select("node", F.col("up").alias("root"))
        else:
            step = parents.select(F.col("node").alias("root"), F.col("up").alias("_up"))
            roots = stored(roots.join(step, "root", "left").select("node", F.coalesce("_up", "root").alias("root")).coalesce(root_files), "roots")
        of = lambda c: parents.select(F.col("node").alias(c), F.col("up").alias(f"_{c}"))
        moved = edges.join(of("a"), "a").join(of("b"), "b").filter("_a != _b")
        edges, n = stored_counted(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct().coalesce(files), "links")
    return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0) if roots is None else roots
