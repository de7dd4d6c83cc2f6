"""Benchmark decontamination with a broadcast set of test n-grams.

Words are runs of ASCII letters and digits, A-Z lower-cased, and of any other characters beyond ASCII. The windows of
``n`` consecutive words of every benchmark item (an item of fewer words is one window) go to the workers as
sorted hashes with the windows' words. Workers hash the windows of whole documents, look them up, and compare the
words of every hit, so hash collisions change nothing.

The set is built in blocks of items with at most BLOCK_WORDS words each, whatever the benchmark's size (an item of more
is cut into parts that overlap by a window less a word, so that each of its windows is in one part): one block is one narrow pass without a
shuffle; with more, each block is one pass over the documents, one after the other, of which only rows with hits are stored, and hits
are merged by (doc_id, hash of the text). A block leaves the workers before the next one comes.

Defined results: null and empty texts have no words; items without words hit nothing; items without an id mark
words and are not counted; repeated items count once, repeated documents are reported each; an empty benchmark
hits nothing; texts of any length are read whole, and a word between two windows that overlap is hit once; an empty table gives no rows;
extra columns are ignored by the report and kept by cleaned().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.scratch import stored
from cinderlog.llm import words as W
from cinderlog.llm.rows import numbers

WINDOW = 10
BLOCK_WORDS = 1_000_000

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased, on bytes
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True


def bytes_words(text: str | None) -> list[bytes]:
    """The normalised words of one text."""
    data, at = W.text_bytes(pa.array([text], pa.string()))
    starts, ends, _ = W.find_words(data, at, IS_WORD)
    low = LOWER[data].tobytes()
    return [low[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


@dataclass
class Block:
    """Windows by length: sorted hashes, and for each distinct hash the windows' words with the items that have them."""

    by_length: dict[int, tuple[np.ndarray, list[dict[bytes, frozenset]]]]

    @staticmethod
    def of(items: list[tuple[object, str | None]], n: int) -> Block:
        found: dict[int, dict[int, dict[bytes, set]]] = {}
        for item_id, text in items:
            ws = bytes_words(text)
            if not ws:
                continue
            data, at = W.text_bytes(pa.array([text], pa.string()))
            starts, ends, _ = W.find_words(data, at, IS_WORD)
            k = min(n, len(ws))
            hashes = W.run_hashes(W.word_hashes(data, starts, ends, LOWER), k).tolist()
            for i, h in enumerate(hashes):
                found.setdefault(k, {}).setdefault(h, {}).setdefault(b" ".join(ws[i : i + k]), set()).add(item_id)
        out = {}
        for k, table in found.items():
            order = sorted(table)
            out[k] = (np.array(order, np.uint64), [{w: frozenset(ids) for w, ids in table[h].items()} for h in order])
        return Block(out)


def hits(data: np.ndarray, at: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, list[set]]:
    """Which words of the texts are hit, the number of the first word of each text, and each text's items."""
    starts, ends, first = W.find_words(data, at, IS_WORD)
    hashes = W.word_hashes(data, starts, ends, LOWER)
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hit, items = np.zeros(len(starts), bool), [set() for _ in range(len(at) - 1)]
    low = None
    for k, (keys, tables) in block.by_length.items():
        runs = W.run_hashes(hashes, k)
        if not len(runs):
            continue
        small = np.zeros(1 << 16, bool)  # most windows fall out here
        small[(keys >> np.uint64(48)).astype(np.int64)] = True
        cand = np.flatnonzero(small[(runs >> np.uint64(48)).astype(np.int64)] & (text_of[: len(runs)] == text_of[k - 1 :]))
        place = np.searchsorted(keys, runs[cand])
        place[place == len(keys)] = 0
        good = keys[place] == runs[cand]
        marks = np.zeros(len(runs), bool)
        for i, p in zip(cand[good].tolist(), place[good].tolist()):
            if low is None:
                low = LOWER[data].tobytes()
            ids = tables[p].get(b" ".join([low[s:e] for s, e in zip(starts[i : i + k].tolist(), ends[i : i + k].tolist())]))
            if ids is not None:
                marks[i] = True
                items[text_of[i]] |= ids
        hit |= W.covered(marks, k)
    return hit, first, items


SPANS = "array<struct<start:bigint,end:bigint>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)]


def _scanner(block, only_hits: bool):
    """doc_id, text_hash, n_words, spans (of word numbers) and items of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b0 = block.value
        for batch in batches:
            for b in W.spans_of(batch, "text"):
                hit, first, items = hits(*W.text_bytes(b.column("text")), b0)
                n = np.diff(first)
                spans = [_runs(hit[s:e]) if hit[s:e].any() else [] for s, e in zip(first[:-1], first[1:])]
                ids = [sorted(str(i) for i in x if i is not None) for x in items]
                out = pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(spans, _SPAN), pa.array(ids, pa.list_(pa.string()))],
                    ["doc_id", "text_hash", "n_words", "spans", "items"],
                )
                yield out.filter(pa.array([bool(s) for s in spans])) if only_hits else out

    return run


def _parts(text: str | None, n: int, most: int) -> list[tuple[str | None, int]]:
    """The text in parts of at most so many words (n at least) that have its windows between them, with their numbers of words."""
    words, most = bytes_words(text), max(n, most)
    if len(words) <= most:
        return [(text, len(words))]
    cuts = [words[at : at + most] for at in range(0, len(words) - n + 1, most - n + 1)]
    return [(b" ".join(c).decode(), len(c)) for c in cuts]


def _blocks(benchmark: DataFrame, n: int, block_words: int):
    """Blocks of items, read one at a time."""
    items, size = [], 0
    for row in benchmark.select("item_id", "text").distinct().toLocalIterator():
        for text, own in _parts(row.text, n, block_words):
            if items and size + own > block_words:
                yield Block.of(items, n)
                items, size = [], 0
            items.append((row.item_id, text))
            size += own
    yield Block.of(items, n)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, spans of hit words (start and end numbers, merged) and items (ids as sorted strings) of each row."""
    context = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash bigint, n_words bigint, spans {SPANS}, items array<string>"
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    blocks = _blocks(benchmark, n, block_words)
    first, second = next(blocks), next(blocks, None)
    whole = rows.mapInArrow(_scanner(context.broadcast(first), False), schema)
    if second is None:
        return whole.drop("text_hash")
    parts = stored(whole.withColumn("every", F.lit(True)), "hits")  # a row for each row, unlike the others
    for block in chain([second], blocks):
        shared = context.broadcast(block)
        parts = parts.union(stored(rows.mapInArrow(_scanner(shared, True), schema).withColumn("every", F.lit(False)), "hits"))
        shared.destroy()  # one block in the workers at a time
    merged = parts.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.count_if("every").alias("copies"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    joined = F.expr(
        "aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (out, s) -> "
        "if(size(out) > 0 and element_at(out, -1).end >= s.start, "
        "concat(slice(out, 1, size(out) - 1), array(named_struct('start', element_at(out, -1).start, 'end', greatest(element_at(out, -1).end, s.end)))), "
        "concat(out, array(s))))"
    )
    return numbers(merged, F.lit(1), F.col("copies"), "_copy").select("doc_id", "n_words", joined.alias("spans"), "items")


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    found = contamination(docs, benchmark, n)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def _marker(block, spans_in: str):
    """Adds the words that a block hits to a column of spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b0 = block.value
        for batch in batches:
            for b in W.spans_of(batch, "text"):
                hit, first, _ = hits(*W.text_bytes(b.column("text")), b0)
                spans = b.column(spans_in).to_pylist()
                for i, (s, e) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    if hit[s:e].any():
                        for x in spans[i]:
                            hit[s + x["start"] : s + x["end"]] = True
                        spans[i] = _runs(hit[s:e])
                yield b.set_column(b.schema.get_field_index(spans_in), spans_in, pa.array(spans, _SPAN))

    return run


def _cutter(spans_in: str):
    """Takes the words in the spans out of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in W.spans_of(batch, "text"):
                k, texts = b.schema.get_field_index("text"), b.column("text").to_pylist()
                for i, spans in enumerate(b.column(spans_in).to_pylist()):
                    if spans:
                        data, at = W.text_bytes(pa.array([texts[i]], pa.string()))
                        starts, ends, _ = W.find_words(data, at, IS_WORD)
                        raw, pos, out = data.tobytes(), 0, []
                        for x in spans:
                            out.append(raw[pos : int(starts[x["start"]])])
                            pos = int(ends[x["end"] - 1])
                        texts[i] = b"".join([*out, raw[pos:]]).decode()
                yield b.set_column(k, b.schema.field(k), pa.array(texts, b.schema.field(k).type)).drop_columns([spans_in])

    return run


def cleaned(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, mode: str = "documents", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without what the benchmark hits: the hit documents (mode documents) or just the hit words (mode spans)."""
    if mode not in ("documents", "spans"):
        raise ValueError(mode)
    spans = W.unused(docs.columns, "_spans")
    marked, passes = docs.withColumn(spans, F.expr(f"cast(array() as {SPANS})")), 0
    for block in _blocks(benchmark, n, block_words):
        marked = stored(marked, "marked") if passes else marked  # one block in a worker at a time
        marked, passes = marked.mapInArrow(_marker(docs.sparkSession.sparkContext.broadcast(block), spans), marked.schema), passes + 1
    if mode == "documents":
        return marked.filter(F.size(spans) == 0).drop(spans)
    return marked.mapInArrow(_cutter(spans), docs.schema)


def op5_ngram_hash_set(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return report(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
bw AS (SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM bw WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM g),
w AS (SELECT rid, doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT rid, doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, ks WHERE len(ws) >= k)),
h AS (SELECT rid, i, k, item_id FROM w JOIN g USING (k, gram)),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, i, k FROM h)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
