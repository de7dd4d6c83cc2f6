"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints are 64 bits. Two that differ in 3 bits or fewer, cut into two segments of 32, differ in at most one bit
of some segment. Each distinct fingerprint is filed under both whole segments and under all their variants with
one bit blanked (66 keys); fingerprints that meet under a key are compared in full. Under a blanked bit only
buckets with both values of that bit are looked at, as the others meet under the whole segment.

Copies share a fingerprint and are one row from then on. A bucket yields links that connect what its pairs
connect, not all its pairs. A segment value held by more than CAP distinct fingerprints is dense: the
fingerprints in its buckets are filed again, with the other segment cut in two halves, of which one differs in one
bit at most, whole or with one bit blanked. Such a bucket's fingerprints agree in all but 18 known bits, so it
has at most 2**18: bounded whatever the input, and no pair is lost. Classes are connected components.

Defined results: null and empty texts and texts without words have fingerprint 0 and link like any others; repeated
rows get one class; rows without doc_id don't count for a class's least id (a class of such rows alone has
none); an empty table gives no rows; extra columns are ignored.

The above is op9. one_of_similar() is the pipeline's stage: texts whose sets of LONG-word shingles have a Jaccard similarity of
LEAST or more are linked, all of them and no others. At that similarity fingerprints differ by about 10 bits, which no
segments find, so fingerprints serve to link groups of near copies cheaply, and the other pairs are found by a
prefix filter: two sets that similar share one of their first n - ceil(LEAST n) + 1 shingles in any common order, and a certain
number of them. The order is by a sketch of how many texts have a shingle, rare ones first, so that texts with many words of their
own meet nobody. The sketch counts all texts in SKETCH slots; any order gives the same links, so its errors cost time only.
Before that, each common shingle of a prefix proposes a star: the text with the most common shingles and each other one. What stars and
fingerprints link is one class, and only texts of different classes still meet, where the places of the shingle in both leave room for
enough others, and in buckets of common shingles only where their parities (PARITY bits of each text) allow for it: parities differ in
no more bits than sets differ in shingles, so no similar pair is lost. Every candidate, of whichever kind, is
compared by all its shingles (as 64-bit hashes under a key drawn for each run); none is dropped for being one of many.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.scratch import stored
from cinderlog.llm import words as W
from cinderlog.llm.graph import components

SHINGLE = 3  # words
SEED = 42
DISTANCE = 3  # bits
CAP = 2000  # distinct fingerprints of a segment value beyond which its buckets are cut further
PART = 1 << 16  # shingles counted at once
LONG, LEAST = 5, 0.8  # words of a shingle and Jaccard similarity of near-duplicates in the pipeline
SKETCH, BLOCK = 1 << 22, 1 << 14  # slots of the sketch of shingle counts, slots of a block
COMMON = 32  # a shingle is common if its count is so far above four times the mean slot's
MARKS = 1 << 17  # rows of the bitmap that thins out texts before a join
PIECE = 1 << 19  # bytes of text that are hashed at once (one text at least)
PARITY = 512  # bits of a text's parities: bit i is whether an odd number of its shingles fall on i
EPS = 1e-9


def fingerprint(text: str | None) -> int:
    """64 bits, each set if it is set in over half the hashes of the text's shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    hash_of, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, PART):
        part = words[at : at + PART + SHINGLE - 1]
        shingles = map(b" ".join, zip(part, part[1:], part[2:])) if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.array([hash_of(s, SEED) for s in shingles], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def _segment(s: int) -> Column:
    return F.shiftrightunsigned("fp", 32 * s).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def first_keys() -> Column:
    """66 keys: which segment (1 bit), blanked bit or 32 (6 bits), the segment without it (32 bits)."""
    return F.expr(
        "flatten(transform(array(0, 1), s -> transform(sequence(0, 32), i -> "
        "shiftleft(cast(s * 64 + i as bigint), 32) | (shiftrightunsigned(fp, 32 * s) & 4294967295L & ~if(i < 32, shiftleft(1L, i), 0L)))))"
    )


def second_keys() -> Column:
    """34 keys below a first one: which half of the other segment (1 bit), blanked bit or 16 (5 bits), the half without it."""
    other = "shiftrightunsigned(fp, 32 * (1 - cast(shiftrightunsigned(key, 38) as int)))"
    return F.expr(
        "flatten(transform(array(0, 1), h -> transform(sequence(0, 16), j -> "
        f"shiftleft(key, 22) | shiftleft(cast(h * 32 + j as bigint), 16) | (shiftrightunsigned({other}, 16 * h) & 65535L & ~if(j < 16, shiftleft(1L, j), 0L)))))"
    )


def connect(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what pairs of these fingerprints within DISTANCE connect: a forest."""
    out, left = [], fps
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= DISTANCE
            if near.any():
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                todo += list(found)
                left = left[~near]
    return out


def _links(first: bool):
    """Streams rows sorted by key and yields each bucket's links. first: keys are first ones."""

    def buckets(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        ends = np.append(starts[1:], len(keys))
        if first:  # a bucket without both values of its blanked bit adds nothing
            i = (keys[starts] >> np.int64(32)) & np.int64(63)
            at = np.where(i < 32, i + 32 * (keys[starts] >> np.int64(38)), 0).astype(np.uint64)
            both = np.bitwise_or.reduceat(fps, starts) ^ np.bitwise_and.reduceat(fps, starts)
            look = (ends - starts > 1) & ((i == 32) | ((both >> at) & np.uint64(1) == 1))
        else:
            look = ends - starts > 1
        starts, ends = starts[look], ends[look]
        pairs = ends - starts == 2
        a, b = fps[starts[pairs]], fps[starts[pairs] + 1]
        near = np.bitwise_count(a ^ b) <= DISTANCE
        more = [x for s, e in zip(starts[~pairs].tolist(), ends[~pairs].tolist()) for x in connect(fps[s:e])]
        more = np.array(more, np.uint64).reshape(-1, 2)
        return np.concatenate([a[near], more[:, 0]]), np.concatenate([b[near], more[:, 1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = False
        batches = iter(batches)
        while not last:
            b = next(batches, None)
            last = b is None
            if not last:
                keys = np.concatenate([keys, b.column("key").to_numpy()])
                fps = np.concatenate([fps, b.column("fp").to_numpy().view(np.uint64)])
            cut = len(keys) if last else int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on
            x, y = buckets(keys[:cut], fps[:cut]) if cut else (np.zeros(0, np.uint64),) * 2
            keys, fps = keys[cut:], fps[cut:]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    return run


def links(nodes: DataFrame, cap: int = CAP) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp of nodes) that connect all that differ in 3 bits or fewer."""
    filed = nodes.select("fp", F.explode(first_keys()).alias("key"))
    sizes = nodes.select(F.explode(F.array(*(F.struct(F.lit(s).alias("s"), _segment(s).alias("v")) for s in (0, 1)))).alias("x"))
    dense = stored(sizes.groupBy("x.s", "x.v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap), "dense")
    out = lambda rows, first: rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links(first), "a long, b long")
    if dense.isEmpty():
        return out(filed, True)
    heavy = dense.select(  # stored, so that the joins with it can be split where a key is hot
        F.explode(F.expr("transform(sequence(0, 32), i -> shiftleft(cast(s * 64 + i as bigint), 32) | (v & ~if(i < 32, shiftleft(1L, i), 0L)))")).alias("key")
    ).distinct()
    heavy = stored(heavy, "heavy")
    light = filed.join(heavy, "key", "left_anti")
    deep = filed.join(heavy, "key", "left_semi").select("fp", F.explode(second_keys()).alias("key"))
    return out(light, True).union(out(deep, False))


def near_duplicates(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text)."""
    prints = stored(docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long"), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = components(links(nodes, cap)).select(F.col("node").alias("fp"), "root")
    placed = nodes.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = stored(placed.groupBy("root").agg(F.min("rep").alias("component_id")), "least")  # so that the next join can be split
    classes = placed.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z only
IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def shingles(text: str | None, size: int = LONG) -> list[bytes]:
    """A text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    return list(map(b" ".join, zip(*(words[i:] for i in range(size))))) if len(words) >= size else [b" ".join(words)]


def shingle_hashes(texts: pa.Array, size: int, key: int) -> list[np.ndarray]:
    """64-bit hashes of each text's shingles, repeats included, under a secret key."""
    data, at = W.text_bytes(texts)
    data = LOWER[data]
    starts, ends, first = W.find_words(data, at, IS_WORD)
    hashes = W.secret_hashes(data, starts, ends, key)
    runs, out = W.run_hashes(hashes, size), []
    for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
        few = np.full(1, max(0, size - (e - s)), np.uint64)  # a shingle of fewer words is another one
        out.append(runs[s : e - size + 1] if e - s >= size else W.mixed(W.run_hashes(hashes[s:e], e - s) ^ few) if e > s else few)
    return out


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PART):
        counts += np.unpackbits(hashes[at : at + PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def prefix_size(n: int, least: float) -> int:
    return n - int(np.ceil(least * n - EPS)) + 1


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SKETCH - 1)).astype(np.int64)


def _described(size: int, key: int):
    """th and fp of each text; at the end of a partition, in blocks, how many of its texts have a shingle of each slot of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, none = np.zeros(SKETCH, np.uint32), lambda k, t: pa.nulls(k, t)
        names = ["th", "fp", "block", "places", "counts"]
        for batch in batches:
            for b in W.spans_of(batch, "text", PIECE):
                hashes = shingle_hashes(b.column("text"), size, key)
                slots, counts = np.unique(np.concatenate([np.unique(_slots(h)) for h in hashes]), return_counts=True)
                sketch[slots] += counts.astype(np.uint32)
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column("th"), pa.array([_majority(h) for h in hashes], pa.int64()), none(n, pa.int32()), none(n, pa.binary()), none(n, pa.binary())], names)
        blocks = []
        for k in range(SKETCH // BLOCK):  # what isn't zero
            x = sketch[k * BLOCK : (k + 1) * BLOCK]
            places = np.flatnonzero(x)
            if len(places):
                blocks.append((k, places.astype(np.uint16).tobytes(), x[places].tobytes()))
        if blocks:
            numbers, places, counts = zip(*blocks)
            n = len(blocks)
            cols = [pa.array(numbers, pa.int32()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays([none(n, pa.int64()), none(n, pa.int64()), *cols], names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block, of rows sorted by block."""
    last, total = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])
    for b in batches:
        for k, places, counts in zip(b.column("block").to_pylist(), b.column("places"), b.column("counts")):
            if k != last:
                if last is not None:
                    yield out()
                last, total = k, np.zeros(BLOCK, np.uint32)
            total[np.frombuffer(places.as_buffer(), np.uint16)] += np.frombuffer(counts.as_buffer(), np.uint32)
    if last is not None:
        yield out()


def parities(distinct: np.ndarray) -> bytes:
    """Two texts' parities differ in no more bits than there are shingles that one of them has and the other hasn't."""
    slots = (distinct >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=PARITY) & 1).astype(np.uint8)).tobytes()


def _prefixes(size: int, least: float, key: int, shared):
    """n (distinct shingles), prefix in the order of the sketch's counts, the prefix's common shingles (which are its last ones), how common the text's
    shingles are, and the parities of a text with common ones in its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        common = COMMON + 4 * float(sketch.mean())
        lists = lambda xs: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, xs)]).astype(np.int32)), pa.array(np.concatenate([*xs, np.zeros(0, np.int64)])))
        for batch in batches:
            for b in W.spans_of(batch, "text", PIECE):
                ns, prefixes, often, ranks, bits = [], [], [], [], []
                for hashes in shingle_hashes(b.column("text"), size, key):
                    distinct = np.unique(hashes)
                    counts = sketch[_slots(distinct)]
                    first = np.argsort(counts, kind="stable")[: prefix_size(len(distinct), least)]
                    ns.append(len(distinct))
                    prefixes.append(distinct[first].view(np.int64))
                    often.append(distinct[first][counts[first] >= common].view(np.int64))
                    ranks.append(float(np.log2(counts + 1.0).mean()))
                    bits.append(parities(distinct) if len(often[-1]) else None)
                cols = [b.column("th"), pa.array(ns, pa.int64()), lists(prefixes), lists(often), pa.array(ranks, pa.float64()), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["th", "n", "prefix", "often", "rank", "bits"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Columns of whole buckets (rows with one key, by which the rows are sorted), with the buckets' starts and ends."""
    held, last, batches = None, False, iter(batches)
    while not last:
        b = next(batches, None)
        last = b is None
        if not last:
            new = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
            held = [np.concatenate([h, x]) for h, x in zip(held, new)] if held else new
        if not held or not len(held[0]):
            continue
        cut = len(held[0]) if last else int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on
        if cut:
            columns, held = [h[:cut] for h in held], [h[cut:] for h in held]
            starts = np.flatnonzero(np.concatenate(([True], columns[0][1:] != columns[0][:-1])))
            yield columns, starts, np.append(starts[1:], cut)


def _stars(least: float):
    """Of each bucket the text whose shingles are the most common, with each other that is not too unlike in size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, ths, ns, ranks), starts, ends in _buckets(batches, ("key", "th", "n", "rank")):
            found = []
            for s, e in zip(starts.tolist(), ends.tolist()):
                p = s + int(np.lexsort((ths[s:e], -ranks[s:e]))[0])
                j = np.arange(s, e)
                j = j[(j != p) & (np.minimum(ns[s:e], ns[p]) >= least * np.maximum(ns[s:e], ns[p]) - EPS)]
                found.append((np.full(len(j), ths[p]), ths[j]))
            a, b = map(np.concatenate, zip(*found))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def _meetings(least: float):
    """Pairs of a bucket that are of two classes and may be similar by size and by place: of what two sets have in common, what comes before a
    common shingle is at most the lesser of its places, and what comes after at most the lesser of the rests. In a bucket of a common shingle
    their parities must not differ in more bits than similar sets do in shingles: that no similar pair fails. Rows of a bucket are sorted by class."""

    def out(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(most)], ["a", "b", "need"])

    def need(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Shingles that two similar sets of x and y have in common in their prefixes at least: what the rest can't give."""
        rest = np.ceil(least * np.maximum(x, y) - EPS) - 1
        return (np.ceil(least / (1 + least) * (x + y) - EPS) - rest).astype(np.int64)

    def may(x, y, at_x, at_y) -> np.ndarray:
        return np.minimum(at_x, at_y) + np.minimum(x - at_x, y - at_y) >= least / (1 + least) * (x + y) - EPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, classes, ths, ns, at_, bits), starts, ends in _buckets(batches, ("key", "class", "th", "n", "at", "bits")):
            look = classes[starts] != classes[ends - 1]
            starts, ends = starts[look], ends[look]
            two = ends - starts == 2
            x, y = starts[two], starts[two] + 1
            near = may(ns[x], ns[y], at_[x], at_[y])
            x, y = x[near], y[near]
            yield out(ths[x], ths[y], need(ns[x], ns[y]))
            found, size = [], 0
            for s, e in zip(starts[~two].tolist(), ends[~two].tolist()):
                at = s + np.searchsorted(classes[s:e], classes[s:e], "right")
                odd = None if any(x is None for x in bits[s:e]) else np.frombuffer(b"".join(bits[s:e]), np.uint64).reshape(e - s, -1)
                for i in range(s, int(at.searchsorted(e)) + s):
                    j = np.arange(at[i - s], e)
                    j = j[may(ns[j], ns[i], at_[j], at_[i])]
                    if odd is not None:
                        unlike = np.bitwise_count(odd[j - s] ^ odd[i - s]).sum(1, dtype=np.int64)
                        j = j[unlike <= (1 - least) / (1 + least) * (ns[j] + ns[i]) + EPS]
                    found.append((np.full(len(j), ths[i]), ths[j], need(ns[i], ns[j])))
                    size += len(j)
                    if size > PART:
                        yield out(*map(np.concatenate, zip(*found)))
                        found, size = [], 0
            if size:
                yield out(*map(np.concatenate, zip(*found)))

    return run


def _alike(size: int, least: float, key: int):
    """Pairs whose sets of shingles are similar. Rows with the same b mostly follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.spans_of(batch, "text_a", PIECE, 256):
                bs = part.column("b").to_numpy()
                news = np.flatnonzero(np.concatenate(([True], bs[1:] != bs[:-1])))
                of_b = [np.unique(h) for h in shingle_hashes(part.column("text_b").take(pa.array(news)), size, key)]
                which, keep = np.searchsorted(news, np.arange(len(bs)), "right") - 1, []
                for i, h in zip(which.tolist(), shingle_hashes(part.column("text_a"), size, key)):
                    mine, its = np.unique(h), of_b[i]
                    both = len(np.intersect1d(mine, its, assume_unique=True))
                    keep.append(both >= least * (len(mine) + len(its) - both) - EPS)
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(mask), part.column("b").filter(mask)], ["a", "b"])

    return run


def _needed(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct texts whose th is in nodes, and perhaps a few others: a bitmap of MARKS rows at most, whatever the input, is broadcast, so
    that few texts are shuffled that need not be."""
    place, bit = F.expr(f"pmod(shiftrightunsigned(th, 6), {MARKS})"), F.expr("shiftleft(1L, cast(th & 63 as int))")
    bits = nodes.select(place.alias("_w"), bit.alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_bits"))
    return texts.join(F.broadcast(bits), place == F.col("_w")).filter(F.col("_bits").bitwiseAND(bit) != 0).select("th", "text").dropDuplicates(["th"])


def address(text: Column) -> Column:
    """64 bits of a text's SHA-256: nobody can easily make two texts that share it."""
    return F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16), 16, -10).cast("long")


def similar_texts(texts: DataFrame, size: int = LONG, least: float = LEAST, key: int | None = None) -> DataFrame:
    """(node, root) for every text that is similar to another; root is one node of its class. texts: th (an address), text.

    key: the secret of the hashes, drawn if not given. The result doesn't depend on it.
    """
    key = secrets.randbits(127) if key is None else key
    texts = texts.select("th", "text")
    every = stored(texts.mapInArrow(_described(size, key), "th long, fp long, block int, places binary, counts binary"), "described")
    blocks = every.filter("block is not null").select("block", "places", "counts").repartition("block").sortWithinPartitions("block").mapInArrow(_summed, "block int, counts binary")
    sketch = np.zeros(SKETCH, np.uint32)
    for r in blocks.toLocalIterator():  # SKETCH numbers in all
        sketch[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.uint32)
    shared = texts.sparkSession.sparkContext.broadcast(sketch)
    described = texts.mapInArrow(_prefixes(size, least, key, shared), "th long, n long, prefix array<long>, often array<long>, rank double, bits binary")
    base = stored(described.groupBy("th").agg(*(F.any_value(c).alias(c) for c in ("n", "prefix", "often", "rank", "bits"))), "base")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = stored(pairs, "candidates")
        needed = stored(_needed(texts, pairs.select(F.col("a").alias("th")).union(pairs.select(F.col("b").alias("th")))), "needed")
        of = lambda c: needed.select(F.col("th").alias(c), F.col("text").alias(f"text_{c}"))
        return stored(pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(_alike(size, least, key), "a long, b long"), name)

    prints = stored(every.filter("th is not null").select("th", "fp").distinct(), "prints")
    reps = stored(prints.groupBy("fp").agg(F.min("th").alias("rep")), "reps")
    rep = lambda c: reps.select(F.col("fp").alias(c), F.col("rep").alias(f"th_{c}"))
    bits = links(reps.select("fp")).filter("a != b").distinct().join(rep("a"), "a").join(rep("b"), "b").select(F.least("th_a", "th_b").alias("a"), F.greatest("th_a", "th_b").alias("b"))
    same = prints.join(reps, "fp").filter("th != rep").select(F.col("rep").alias("a"), F.col("th").alias("b"))
    common = base.select(F.explode("often").alias("key"), "th", "n", "rank")
    stars = common.repartition("key").sortWithinPartitions("key", "th").mapInArrow(_stars(least), "a long, b long")
    close = verified(bits.union(same).union(stars).distinct(), "close")

    classes = components(close).select(F.col("node").alias("th"), F.col("root").alias("_root"))
    rows = base.select("th", "n", "prefix", "bits", (F.size("prefix") - F.size("often")).alias("rare")).join(classes, "th", "left").withColumn("class", F.coalesce("_root", "th"))
    filed = rows.select(F.posexplode("prefix").alias("at", "key"), "class", "th", "n", "bits", "rare")
    filed = filed.select("key", "class", "th", "n", F.col("at").cast("long").alias("at"), F.when(F.col("at") >= F.col("rare"), F.col("bits")).alias("bits"))
    met = filed.repartition("key").sortWithinPartitions("key", "class").mapInArrow(_meetings(least), "a long, b long, need long")
    pairs = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"), F.max("need").alias("need")).filter("both >= need").select("a", "b")
    return components(close.union(verified(pairs, "alike")))


def one_of_similar(docs: DataFrame, size: int = LONG, least: float = LEAST, **how) -> DataFrame:
    """docs without near-duplicates by shingle similarity: of each class one row stays, the least by id (none last), then address of the text.

    Rows are told apart by id and text together, so different texts under one id are judged each.
    """
    th, root = W.unused(docs.columns, "_th"), W.unused(docs.columns, "_root")
    text = F.coalesce("text", F.lit(""))
    roots = similar_texts(docs.select(address(text).alias("th"), text.alias("text")), size, least, **how)
    rows = docs.select("doc_id", address(text).alias(th))
    placed = rows.join(roots.select(F.col("node").alias(th), F.col("root").alias(root)), th, "left").withColumn(root, F.coalesce(root, th))
    first = placed.groupBy(root).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("_of"), F.col(th).alias("_is"))).alias("x"))
    first = first.select("x._of", "x._is")
    marked = docs.withColumn(th, address(text))
    kept = marked.join(first, (F.col(th) == F.col("_is")) & marked["doc_id"].eqNullSafe(F.col("_of")), "left_semi")
    return kept.dropDuplicates(["doc_id", th]).select(*docs.columns)


def op9_deletion_variants(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
