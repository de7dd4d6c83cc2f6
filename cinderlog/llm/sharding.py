"""Shuffled sharding without a shuffle of the data.

Rows get global numbers 0..N-1, a keyed Feistel permutation of those numbers gives each row its place in
the shuffled order, and the place gives shard and slot by arithmetic: place mod shards and place div shards.
Anyone who knows the key, N and a row's number can compute where the row goes, and back.

The Feistel network works on pairs (l, r) of [0, a) x [0, b) with a*b just above N; places beyond N are
walked along their cycle until they fall below N. At most a*b - N places lie outside, so a walk ends after
that many steps at the latest; the plan tries two steps in line and has the rest of that bound behind a CASE.

Defined results: null and empty texts count 0 bytes of text, texts of any length all of theirs; rows equal in the numbered columns are
interchangeable and get consecutive numbers; null ids are numbered like any others; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlog.llm.rows import numbers

ROUND_KEYS = (11, 23, 37, 41, 59, 61, 83, 97)  # the key of the permutation
BUCKETS = 4096  # of the numbering: bounds the table of offsets, whatever the input's size


def numbered(df: DataFrame, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows' columns with ``row_number`` (0..N-1 over the whole table) and ``n_rows`` (N).

    Numbers depend on the rows only, not on their partitions: rows are dealt into buckets by a hash, ordered
    within a bucket, and start at the bucket's offset. Equal rows are counted first and numbered together,
    so that many copies of a row are one row on the way. The offsets are one row a bucket: a broadcast of a
    fixed size.
    """
    bucket = F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")
    counted = df.select(*columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", bucket)
    whole = df.select(bucket.alias("_bucket")).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    order = F.expr("sum(_size) over (order by _bucket rows between unbounded preceding and current row)")
    offsets = whole.select("_bucket", (order - F.col("_size")).alias("_offset"), F.expr("sum(_size) over ()").alias("n_rows"))
    ends = F.expr(f"sum(_n) over (partition by _bucket order by {', '.join(f'`{c}`' for c in columns)} rows between unbounded preceding and current row)")
    placed = counted.withColumn("_end", ends).join(F.broadcast(offsets), "_bucket")
    end = F.col("_offset") + F.col("_end")
    return numbers(placed, end - F.col("_n"), end - 1, "row_number").select(*columns, "n_rows", "row_number")


def sides(n: Column) -> tuple[Column, Column]:
    """a and b with a*b >= n and a*b - n < a."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1).cast("long"))
    return a, F.greatest(F.ceil(n / a).cast("long"), F.lit(1).cast("long"))


def quotient(x: Column, y: Column) -> Column:
    """x div y, exact below 2**53."""
    return ((x - F.pmod(x, y)) / y).cast("long")


def feistel(x: Column, a: Column, b: Column, keys=ROUND_KEYS) -> Column:
    """A keyed permutation of [0, a*b)."""
    state = F.struct(quotient(x, b).alias("l"), F.pmod(x, b).alias("r"))
    rounds = F.array(*(F.struct(F.lit(i % 2 == 0).alias("even"), F.lit(k).cast("long").alias("k")) for i, k in enumerate(keys)))

    def step(s: Column, k: Column) -> Column:
        left = F.when(k["even"], F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], k["k"]), a), a)).otherwise(s["l"])
        right = F.when(k["even"], s["r"]).otherwise(F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], k["k"]), b), b))
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(rounds, state, step, lambda s: s["l"] * b + s["r"])


def shuffled_place(row_number: Column, n: Column, a: Column, b: Column) -> Column:
    """The row's place in the shuffled order, by cycle walking."""
    walk = lambda y: F.when(y < n, y).otherwise(feistel(y, a, b))
    steps = lambda last: F.sequence(F.lit(1).cast("long"), last)
    near = F.aggregate(steps(F.lit(2).cast("long")), feistel(row_number, a, b), lambda y, _: walk(y))
    far = F.aggregate(steps(F.greatest(a, F.lit(1))), feistel(row_number, a, b), lambda y, _: walk(y))
    return F.when(near < n, near).otherwise(far)


def assign_shards(df: DataFrame, columns: list[str], shards: int) -> DataFrame:
    """columns with ``row_number``, ``place``, ``shard`` and ``slot``; shard sizes differ by one at most."""
    if shards < 1:
        raise ValueError("at least one shard")
    a, b = sides(F.col("n_rows"))
    rows = numbered(df, columns).withColumns({"_a": a, "_b": b})
    rows = rows.withColumn("place", shuffled_place(F.col("row_number"), F.col("n_rows"), F.col("_a"), F.col("_b")))
    return rows.select(
        *columns, "row_number", "place",
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        quotient(F.col("place"), F.lit(shards)).alias("slot"),
    )


def op2_feistel_shards(spark, sf_dir: str, shards: int = 40) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
    )
    out = assign_shards(rows, ["doc_id", "size", "text_crc32"], shards)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"), "row_number",
    )
