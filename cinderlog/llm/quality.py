"""Quality rules: within-document measures, and lines that too many documents of a host share.

Cross-document part: every line with a word is normalised (lower case, white space collapsed) and hashed with
its host; a line on more than ``max_docs`` distinct documents of one host is boilerplate; a document of which
boilerplate leaves fewer than ``min_kept`` of its words is depleted and rejected.

without_boilerplate() takes the boilerplate lines out of the texts and rejects depleted documents; judge() says how much
that is. Both read the same marks: the numbers of a document's boilerplate lines.

All of it is built-in expressions. Line counts are aggregated before they are shuffled, and the frequent lines are
stored, so that the join on line keys deals out both sides and adaptive execution can split it where one line is hot. Marks are joined
back to documents by a hash of doc_id, text and host; judge() carries no texts there.

Defined results: null text has no words or lines; a null host is a host of its own; rows equal in doc_id, host
and text are judged alike and all returned; texts and lines of any length are read whole; of the lines on more documents than the limit
all go, whatever their order; documents without words fail the base rule; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.scratch import stored

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
MAX_DOCS = 100  # distinct documents of a host that may share a line
MIN_KEPT = 0.2  # share of its words that a document must keep


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: s.rlike(WORD))


def add_measures(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and _lines.

    Repeated 3-word windows: a window's hash and its place are packed in one long, high bits of the hash and as
    many low bits as the places need, and sorted; equal neighbours are repeats. Neighbours that agree in the high
    bits are compared in their full hash; if any differ there (a collision of the short hashes), the document
    is done again with unpacked pairs.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_words", words_of(F.col("text")))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    tail = lambda c, k: F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0)))
    head = lambda c, n: F.slice(c, 1, F.greatest(n, F.lit(0)))
    count = F.size("_h") - 2
    pairs = F.zip_with(head("_h", count), head(tail("_h", 1), count), lambda a, b: F.xxhash64(a, b))
    out = out.withColumn("_grams", F.zip_with(pairs, head(tail("_h", 2), count), lambda a, b: F.xxhash64(a, b)))
    out = out.withColumn("_repeats", F.size(F.array_distinct("_grams")) < F.size("_grams"))
    out = out.withColumn("_mask", F.expr("shiftleft(1L, length(bin(size(_grams)))) - 1"))
    out = out.withColumn("_sorted", F.expr("sort_array(transform(_grams, (g, i) -> (g & ~_mask) | cast(i as bigint)))"))
    # neighbours in the packed order: places a and b of two windows with equal short hashes
    out = out.withColumn(
        "_near",
        F.expr(
            "filter(zip_with(slice(_sorted, 1, greatest(size(_sorted) - 1, 0)), slice(_sorted, 2, greatest(size(_sorted) - 1, 0)),"
            " (a, b) -> if(((a ^ b) & ~_mask) = 0, named_struct('a', cast(a & _mask as int), 'b', cast(b & _mask as int)), null)), p -> p is not null)"
        ),
    )
    # the same with unpacked pairs, for a document in which two short hashes collide
    out = out.withColumn("_pairs", F.expr("if(exists(_near, p -> _grams[p.a] != _grams[p.b]), sort_array(transform(_grams, (g, i) -> named_struct('g', g, 'i', i))), null)"))
    out = out.withColumn(
        "_unpacked",
        F.expr(
            "flatten(filter(zip_with(slice(_pairs, 1, greatest(size(_pairs) - 1, 0)), slice(_pairs, 2, greatest(size(_pairs) - 1, 0)),"
            " (a, b) -> if(a.g = b.g, array(a.i, b.i), null)), p -> p is not null))"
        ),
    )
    places = F.expr(
        "coalesce(_unpacked, flatten(transform(_near, p -> array(p.a, p.b))))"
    )
    out = out.withColumn("_places", places)
    covered = F.expr("size(array_distinct(flatten(transform(_places, i -> array(i, i + 1, i + 2)))))")
    out = out.withColumn("n_repeat_words", F.when(F.col("_repeats"), covered).otherwise(0).cast("long"))
    out = out.withColumn("_lines", lines_of(F.col("text")))
    return out.withColumns(
        {
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    ).drop("_words", "_h", "_grams", "_repeats", "_mask", "_sorted", "_near", "_pairs", "_unpacked", "_places")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _all_lines(text: str, host: str) -> Column:
    """Of every line, also those without a word: number from 0, key of host and normalised line, number of words."""
    host_of = F.coalesce(F.col(host), F.lit("\x00"))
    words = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda s: words_of(F.lower(s)))
    return F.transform(words, lambda w, i: F.struct(i.alias("i"), F.xxhash64(host_of, F.array_join(w, " ")).alias("key"), F.size(w).cast("long").alias("words")))


def _marked(docs: DataFrame, host: str, max_docs: int, min_kept: float) -> DataFrame:
    """doc_id, text, _row (the row of docs), the measures, _cut (numbers of lines above the limit), n_boilerplate_words and kept."""
    lines = docs.select("doc_id", "text", F.col(host).cast("string").alias("_host"), F.struct("*").alias("_row"))
    split = lines.withColumn("_all", F.filter(_all_lines("text", "_host"), lambda x: x["words"] > 0))
    seen = split.select("doc_id", F.explode(F.transform("_all", lambda x: x["key"])).alias("key"))
    counted = seen.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("_docs"))
    frequent = stored(counted.filter(F.col("_docs") > max_docs).select("key"), "frequent")
    hashed = lambda df: df.withColumn("_hash", F.xxhash64("doc_id", "text", "_host"))
    placed = hashed(split).select("_hash", F.explode("_all").alias("_x")).select("_hash", "_x.*")
    cut = placed.join(frequent, "key").groupBy("_hash").agg(F.collect_set(F.struct("i", "words")).alias("_cut"))
    cut = stored(cut, "cut").withColumnRenamed("_hash", "_of")  # so that the next join can be split
    measured = hashed(add_measures(lines).drop("_lines"))
    out = measured.join(cut, F.col("_hash") == F.col("_of"), "left").drop("_hash", "_of", "_host")
    words = F.aggregate("_cut", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    out = out.withColumn("n_boilerplate_words", F.coalesce(words, F.lit(0).cast("long")))
    depleted = F.col("n_words") - F.col("n_boilerplate_words") < F.lit(min_kept) * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).withColumn("_cut", F.transform("_cut", lambda x: x["i"]))


def without_boilerplate(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_kept: float = MIN_KEPT) -> DataFrame:
    """The documents kept, without the lines above the limit; the other lines as they were. n_chars, if there, counts the new text."""
    kept = _marked(docs, host, max_docs, min_kept).filter("kept")
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda s, i: ~F.array_contains("_cut", i)), "\n")
    out = kept.withColumn("_text", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(rest))
    new = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns))


def judge(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_kept: float = MIN_KEPT) -> DataFrame:
    """doc_id, the measures, n_boilerplate_words and kept: what without_boilerplate() removes and rejects."""
    return _marked(docs, host, max_docs, min_kept).select("doc_id", *MEASURES, "n_boilerplate_words", "kept")


def op7_line_frequency(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *MEASURES, "kept", "n_boilerplate_words")


ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + d) AS n FROM r, (SELECT unnest([0, 1, 2]) AS d) GROUP BY rid),
l AS (SELECT rid, doc_id, source, unnest(ls) AS line FROM w),
k AS (SELECT rid, doc_id, source, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line,
  len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM l),
f AS (SELECT source, line FROM k GROUP BY source, line HAVING count(DISTINCT doc_id) > {MAX_DOCS}),
b AS (SELECT k.rid, CAST(sum(n) AS BIGINT) AS n FROM k JOIN f ON k.line = f.line AND k.source IS NOT DISTINCT FROM f.source GROUP BY k.rid),
m AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  len(regexp_extract_all(text, '{SYMBOLS}')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words, coalesce(b.n, 0) AS n_boilerplate_words FROM w LEFT JOIN c USING (rid) LEFT JOIN b USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_boilerplate_words >= {MIN_KEPT} * n_words AS kept, n_boilerplate_words FROM m
"""
