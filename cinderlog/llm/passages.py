"""Repeated passages, located word for word by sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words of one document; it goes from a document if its words also start in a document with a
smaller doc_id. The steps, all keyed, none of them all pairs:

1. Every document is described: its words counted, its seeds listed. A window's seed is the run of CORE words in it with the least
   hash, the same wherever the window stands. A seed in two texts or more recurs. Equal texts are one from then on.
2. Recurring passages are confirmed: windows with a recurring seed, of texts that have one, are grouped by a 128-bit hash under a key
   that is drawn anew for each run, so that nobody can make windows that collide. The least document of a group is its
   owner. Consecutive windows of one owner (the first time they stand in it) are a passage of the dictionary.
3. The dictionary is cut into shards by owner, bounded by SHARD windows but for a single document's own. A shard's automaton holds an
   anchor of ANCHOR words at every (WINDOW - ANCHOR + 1)th place of each passage, so that each window holds one. It
   is compiled once where the shard is, and the stretches of all documents that may hold passages of the shard are
   streamed through it. An anchor's occurrence is extended in both directions as long as the words are the passage's, compared
   as bytes; what is WINDOW words or longer, and of a smaller doc_id, is removed. Nothing else removes words: hashes
   only say which documents to stream where.

Documents without a recurring seed have no recurring window, so no automaton need see them. Stretches are streamed, not whole documents: from
the first to the last window that the shard's owner may have. A shard with many stretches (a passage that a third of all documents
share) is compiled in several tasks, each for a part of the stretches, by a count made before. Counts and minima
are aggregated before they are shuffled; joins are from many rows to one row a key, read from stored tables, which adaptive execution splits
where a key is hot. A copy of an earlier text loses all its windows, so nothing of copies is moved but their keys.

Defined results: null and empty texts have no words; texts of fewer than WINDOW words lose nothing; rows without doc_id
lose nothing and are nobody's earlier document; rows equal in doc_id and text are judged alike; texts and words of any length are
read whole; an empty table gives no rows; extra columns are ignored by removals() and kept by without_repeats().
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.scratch import stored, stored_counted
from cinderlog.llm import words as W

WINDOW = 50
CORE = 12  # words of a seed
ANCHOR = 8  # words of an automaton's phrase
SHARD = 100_000  # windows of a shard
STREAM = 250_000  # words that one task streams through a shard
MARKS = 1 << 17  # rows of the bitmap that thins out texts before they are shuffled
SYMBOLS, BITS = 4, 6  # an automaton reads a word as four symbols: 24 bits of its hash

IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    if len(x) < width:
        return x[:0]
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out, have = np.minimum(out[: len(out) - step], out[step:]), have + step
    return out


class Texts:
    """The words of some texts, hashed under the run's key."""

    def __init__(self, texts: pa.Array, key: int):
        self.data, self.at = W.text_bytes(texts)
        self.starts, self.ends, self.first = W.find_words(self.data, self.at, IS_WORD)
        self.hashes = W.secret_hashes(self.data, self.starts, self.ends, key)

    def seeds(self, window: int, core: int) -> tuple[np.ndarray, np.ndarray]:
        """The seed of the window that starts at each word, and whether that window lies in one text."""
        text_of = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        seeds = sliding_min(W.run_hashes(self.hashes, core), window - core + 1)
        return seeds, text_of[: len(seeds)] == text_of[window - 1 :][: len(seeds)]

    def windows(self, at: np.ndarray, window: int, key: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window that starts at these words: sums of its words' hashes, each times a secret number of its place."""
        factors = np.random.default_rng(key + 1).integers(0, 2**63, (2, window), np.uint64) * np.uint64(2) + np.uint64(1)
        out = np.zeros((2, len(at)), np.uint64)
        for k in range(window):
            h = self.hashes[at + k]
            out[0] += h * factors[0, k]
            out[1] += h * factors[1, k]
        return W.mixed(out[0]), W.mixed(out[1])

    def joined(self, start: int, end: int) -> bytes:
        """Words start to end with one space between them."""
        if start >= end:
            return b""
        return b" ".join(self.data[self.starts[start] : self.ends[end - 1]].tobytes().split())


def _described(window: int, core: int, key: int):
    """Number of words, digest of all words and distinct seeds of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in W.spans_of(batch, "text"):
                t = Texts(b.column("text"), key)
                seeds, whole = t.seeds(window, core)
                sha, own = [], []
                for s, e in zip(t.first[:-1].tolist(), t.first[1:].tolist()):
                    sha.append(hashlib.sha256(t.joined(s, e)).digest())
                    own.append(np.unique(seeds[s : max(s, e - window + 1)]).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]).astype(np.int32)), pa.array(np.concatenate([*own, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("t1"), b.column("t2"), pa.array(np.diff(t.first), pa.int64()), pa.array(sha, pa.binary()), lists],
                    ["doc_id", "t1", "t2", "n_words", "full", "seeds"],
                )

    return run


def _candidates(t: Texts, own_seeds: pa.Array, window: int, core: int) -> np.ndarray:
    """Where windows with a seed among those of their text start."""
    seeds, _ = t.seeds(window, core)
    out = [np.zeros(0, np.int64)]
    for own, s, e in zip(own_seeds, t.first[:-1].tolist(), t.first[1:].tolist()):
        out.append(s + np.flatnonzero(np.isin(seeds[s : max(s, e - window + 1)], own.values.to_numpy().view(np.uint64))))
    return np.concatenate(out)


def _windows(window: int, core: int, key: int):
    """(w1, w2, doc, i) of every window with a recurring seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in W.spans_of(batch, "text"):
                t = Texts(b.column("text"), key)
                at = _candidates(t, b.column("seeds"), window, core)
                text = np.searchsorted(t.first, at, "right") - 1
                w1, w2 = t.windows(at, window, key)
                cols = [pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), b.column("doc").take(pa.array(text)), pa.array(at - t.first[text], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["w1", "w2", "doc", "i"])

    return run


def passages_of(t: Texts, text: int, owned: np.ndarray, window: int, key: int) -> list[tuple[int, int]]:
    """Stretches of words (of all texts' words) that consist of windows which the text owns, each where it stands first."""
    s, e = int(t.first[text]), int(t.first[text + 1])
    at = np.arange(s, max(s, e - window + 1))
    w1, _ = t.windows(at, window, key)
    hits = np.flatnonzero(np.isin(w1, owned))
    _, firsts = np.unique(w1[hits], return_index=True)
    starts = at[hits[np.sort(firsts)]]
    breaks = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate(([0], breaks + 1))].tolist(), (starts[np.append(breaks, len(starts) - 1)] + window).tolist())) if len(starts) else []


_ROW = ["shard", "salt", "kind", "doc", "t1", "t2", "lo", "words"]


def _dealt(window: int, key: int):
    """What goes where: passages (kind 0) to each part of their shard, stretches (kind 1) to one part of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in W.spans_of(batch, "text"):
                t, rows, texts = Texts(b.column("text"), key), [], []
                docs, shards, salts, owned, spans = (b.column(c) for c in ("doc", "shard", "salts", "owned", "spans"))
                for i in range(b.num_rows):
                    if owned[i].is_valid:
                        own = owned[i].values.to_numpy().view(np.uint64)
                        for s, e in passages_of(t, i, own, window, key):
                            rows += [(shards[i].as_py(), salt, 0, i, 0, t.joined(s, e)) for salt in range(salts[i].as_py())]
                    if spans[i].is_valid:
                        n, of = int(t.first[i + 1] - t.first[i]), {}
                        for x in spans[i].as_py():
                            of.setdefault((x["shard"], x["salt"]), []).append((x["lo"], min(n, x["hi"] + window)))
                        for (shard, salt), found in of.items():
                            end = -1
                            for lo, hi in [*sorted(found), (n + 1, n + 1)]:  # those that overlap are one
                                if end >= 0 and lo > end:
                                    rows.append((shard, salt, 1, i, start, t.joined(int(t.first[i]) + start, int(t.first[i]) + end)))
                                if lo > end:
                                    start, end = lo, hi
                                end = max(end, hi)
                if rows:
                    shard, salt, kind, of_text, lo, texts = zip(*rows)
                    take = pa.array(of_text)
                    cols = [pa.array(shard, pa.int64()), pa.array(salt, pa.int64()), pa.array(kind, pa.int32()), docs.take(take), b.column("t1").take(take), b.column("t2").take(take)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(lo, pa.int64()), pa.array([x.decode() for x in texts], pa.string())], _ROW)

    return run


def symbols(hashes: np.ndarray) -> str:
    """SYMBOLS characters for each word."""
    shifts = (np.arange(SYMBOLS) * BITS + 64 - SYMBOLS * BITS).astype(np.uint64)
    return (((hashes[:, None] >> shifts) & np.uint64((1 << BITS) - 1)) + np.uint64(48)).astype(np.uint8).tobytes().decode("ascii")


class Shard:
    """Passages, with an automaton of their anchors."""

    def __init__(self, owners: list, passages: list[str], window: int, anchor: int, key: int):
        self.owners, self.window, self.anchor, self.key = owners, window, anchor, key
        self.t = Texts(pa.array(passages, pa.string()), key)
        self.padded = np.concatenate([np.zeros(window, np.uint64), self.t.hashes, np.zeros(window, np.uint64)])
        text, self.places, number = symbols(self.t.hashes), [], {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for s, e in zip(self.t.first[:-1].tolist(), self.t.first[1:].tolist()):
            for o in range(s, e - anchor + 1, window - anchor + 1):
                phrase = text[o * SYMBOLS : (o + anchor) * SYMBOLS]
                if phrase not in number:
                    number[phrase] = len(self.places)
                    self.places.append([])
                    self.automaton.add_word(phrase, number[phrase])
                self.places[number[phrase]].append(o)
        if self.places:
            self.automaton.make_automaton()
        self.places = [np.array(p) for p in self.places]

    def occurrences(self, stretch: str) -> list[tuple[int, int]]:
        """(word, anchor) of all anchors that the automaton finds in a stretch, given in symbols."""
        return [((end + 1) // SYMBOLS - self.anchor, p) for end, p in self.automaton.iter(stretch) if (end + 1) % SYMBOLS == 0] if self.places else []

    def likely(self, places: np.ndarray, r: np.ndarray, j: int) -> np.ndarray:
        """Of many places of an anchor those where half the rest of a window goes on as at word j of the padded hashes r, to one side."""
        half = -(-(self.window - self.anchor) // 2)
        at = self.window + places[:, None] + np.arange(-half, self.anchor + half)
        same = self.padded[at] == r[self.window + j - half : self.window + j + self.anchor + half]
        return places[same[:, :half].all(1) | same[:, -half:].all(1)]

    def removed(self, doc, r: Texts, i: int, text: str, padded: np.ndarray) -> np.ndarray:
        """Which words of stretch i of r lie in windows that a passage of a smaller doc_id has, word for word. text, padded: r's symbols and hashes."""
        s, e = int(r.first[i]), int(r.first[i + 1])
        marks, seen = np.zeros(max(0, e - s - self.window + 1), bool), {}
        step = self.window - self.anchor
        for j, p in self.occurrences(text[s * SYMBOLS : e * SYMBOLS]):
            if marks[max(0, j - step) : j + 1].all():
                continue  # every window with this occurrence is settled
            places = self.places[p]
            if len(places) > 8:
                places = self.likely(places, padded, s + j)
            for o in places.tolist():
                q = int(np.searchsorted(self.t.first, o, "right")) - 1
                if not self.owners[q] < doc or seen.get(o - j, -1) > j:
                    continue
                for a, b in self.agreement(r, s, e, s + j, q, o, seen):
                    marks[a - s : b - s - self.window + 1] = True
        return W.covered(marks, self.window) if len(marks) else np.zeros(e - s, bool)

    def agreement(self, r: Texts, s: int, e: int, j: int, q: int, o: int, seen: dict) -> list[tuple[int, int]]:
        """Runs of WINDOW words or more around word j of r that are those around word o of passage q."""
        ps, pe = int(self.t.first[q]), int(self.t.first[q + 1])
        left, right = min(j - s, o - ps), min(e - j, pe - o)
        other = np.flatnonzero(r.hashes[j - left : j] != self.t.hashes[o - left : o])
        left = left - 1 - int(other[-1]) if len(other) else left
        other = np.flatnonzero(r.hashes[j : j + right] != self.t.hashes[o : o + right])
        right = int(other[0]) if len(other) else right
        seen[o - (j - s)] = j - s + max(1, right)
        if left + right < self.window:
            return []
        mine, its = r.joined(j - left, j + right), self.t.joined(o - left, o + right)
        if mine == its:
            return [(j - left, j + right)]
        same = np.array([x == y for x, y in zip(mine.split(), its.split())], np.int8)  # words with equal hashes that differ
        edges = np.flatnonzero(np.diff(np.concatenate(([0], same, [0])))).reshape(-1, 2)
        return [(j - left + int(a), j - left + int(b)) for a, b in edges if b - a >= self.window]


def _located(window: int, anchor: int, key: int):
    """Streams rows sorted by shard, part and kind: a part's passages are compiled, then its stretches are searched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, owners, passages, shard = None, [], [], None
        for batch in batches:
            for b in W.spans_of(batch, "words"):
                keys = list(zip(b.column("shard").to_pylist(), b.column("salt").to_pylist(), b.column("kind").to_pylist()))
                at, out = 0, []
                while at < b.num_rows:
                    upto = at
                    while upto < b.num_rows and keys[upto] == keys[at]:
                        upto += 1
                    part = b.slice(at, upto - at)
                    if keys[at][:2] != group:
                        group, owners, passages, shard = keys[at][:2], [], [], None
                    if keys[at][2] == 0:
                        owners += part.column("doc").to_pylist()
                        passages += part.column("words").to_pylist()
                    else:
                        shard = shard or Shard(owners, passages, window, anchor, key)
                        r = Texts(part.column("words"), key)
                        text, padded = symbols(r.hashes), np.concatenate([np.zeros(window, np.uint64), r.hashes, np.zeros(window, np.uint64)])
                        for i, (doc, lo) in enumerate(zip(part.column("doc").to_pylist(), part.column("lo").to_pylist())):
                            gone = shard.removed(doc, r, i, text, padded)
                            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2)
                            out += [(at + i, lo + int(x), lo + int(y)) for x, y in edges]
                    at = upto
                if out:
                    rows, starts, ends = zip(*out)
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([b.column("t1").take(take), b.column("t2").take(take), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["t1", "t2", "start", "end"])

    return run


SPANS = "array<struct<start:bigint,end:bigint>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for x in sorted(spans, key=lambda x: x["start"]):
        if out and x["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], x["end"])
        else:
            out.append(dict(x))
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans merged, the number of words in them, and the digest of the others."""
    for batch in batches:
        for b in W.spans_of(batch, "text"):
            n, sha, spans = [], [], [merged(x) for x in b.column("spans").to_pylist()]
            for text, own in zip(b.column("text").to_pylist(), spans):
                words = text.encode().split()
                cuts = [0, *(x[k] for x in own for k in ("start", "end")), len(words)]
                kept = [w for s, e in zip(cuts[::2], cuts[1::2]) for w in words[s:e]]
                n.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).digest())
            yield pa.RecordBatch.from_arrays([b.column("t1"), b.column("t2"), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(spans, _SPAN)], ["t1", "t2", "n_gone", "kept", "spans"])


def address(text: Column) -> list[Column]:
    """128 bits of a text's SHA-256, as two numbers."""
    sha = F.sha2(F.coalesce(text, F.lit("")), 256)
    return [F.conv(F.substring(sha, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "t1"), (17, "t2"))]


def _thinned(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose t1 is in keys, and perhaps some others: a bitmap of MARKS rows at most, whatever the input, is broadcast, so that few
    texts are shuffled that need not be."""
    place, bit = F.expr(f"pmod(shiftrightunsigned(t1, 6), {MARKS})"), F.expr("shiftleft(1L, cast(t1 & 63 as int))")
    bits = keys.select(place.alias("_w"), bit.alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_bits"))
    return texts.join(F.broadcast(bits), place == F.col("_w")).filter((F.col("_bits").bitwiseAND(bit)) != 0).drop("_w", "_bits")


def repeats(docs: DataFrame, window: int = WINDOW, core: int = CORE, anchor: int = ANCHOR, shard: int = SHARD, stream: int = STREAM, key: int | None = None) -> DataFrame:
    """Every row's doc_id, t1, t2 (its text's address), n_words, full (digest of its words), n_removed, kept (digest of the words left) and spans of removed words.

    key: the secret of the hashes, drawn if not given. The result doesn't depend on it.
    """
    kind, key = docs.schema["doc_id"].dataType.simpleString(), secrets.randbits(127) if key is None else key
    keyed = docs.select("doc_id", "text", *address(F.col("text")))
    described = stored(keyed.mapInArrow(_described(window, core, key), f"doc_id {kind}, t1 long, t2 long, n_words long, full binary, seeds array<long>"), "described")
    firsts = stored(described.groupBy("t1", "t2").agg(F.min("doc_id").alias("first_doc")), "firsts")

    # texts with a recurring seed, one row each. Tables of one row a key are stored, so that a join with them can be split where a key is hot.
    seeds = described.select(F.explode("seeds").alias("seed"), "t1", "t2")
    several = (F.col("a") < F.col("b")) | (F.col("c") < F.col("d"))
    counted = seeds.groupBy("seed").agg(F.min("t1").alias("a"), F.max("t1").alias("b"), F.min("t2").alias("c"), F.max("t2").alias("d"))
    recurring = stored(counted.filter(several).select("seed"), "seeds")
    once = described.filter(F.size("seeds") > 0).join(firsts, ["t1", "t2"]).filter("doc_id = first_doc")
    of_text = stored(once.select(F.explode("seeds").alias("seed"), "t1", "t2").join(recurring, "seed").groupBy("t1", "t2").agg(F.collect_set("seed").alias("seeds")), "of-text")
    texts = _thinned(keyed.filter("doc_id is not null"), of_text).groupBy("t1", "t2").agg(F.min("doc_id").alias("doc"), F.first("text").alias("text"))
    hot = stored(texts.join(of_text, ["t1", "t2"]), "hot")

    # windows and their owners
    windows = hot.select("doc", "text", "seeds").mapInArrow(_windows(window, core, key), f"w1 long, w2 long, doc {kind}, i long")
    grouped = windows.groupBy("w1", "w2").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).filter("owner < last")
    owners, n = stored_counted(grouped.select("w1", "w2", "owner"), "owners")
    shard_of = F.pmod(F.xxhash64("owner"), F.lit(1 + n // shard).cast("long")).alias("shard")

    # stretches of documents, and into how many parts each shard's are dealt
    spans = windows.join(owners, ["w1", "w2"]).filter("owner < doc").groupBy("doc", "owner").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    spans = stored(spans.select("doc", shard_of, "lo", "hi"), "spans")
    parts = stored(spans.groupBy("shard").agg((1 + F.sum(F.col("hi") - F.col("lo") + window) / stream).cast("long").alias("salts")), "parts")
    salt = F.pmod(F.xxhash64("doc"), F.col("salts")).alias("salt")
    of_doc = spans.join(parts, "shard").groupBy("doc").agg(F.collect_list(F.struct("shard", salt, "lo", "hi")).alias("spans"))
    owned = owners.groupBy("owner").agg(F.collect_list("w1").alias("owned")).select("owner", "owned", shard_of).join(parts, "shard").withColumnRenamed("owner", "doc")
    dealt = hot.select("doc", "t1", "t2", "text").join(owned.join(of_doc, "doc", "full"), "doc").select("doc", "t1", "t2", "text", "shard", "salts", "owned", "spans")
    dealt = dealt.mapInArrow(_dealt(window, key), f"shard long, salt long, kind int, doc {kind}, t1 long, t2 long, lo long, words string")

    # the automata
    streams = dealt.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    found = streams.mapInArrow(_located(window, anchor, key), "t1 long, t2 long, start long, end long")
    found = found.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    judged = hot.select("t1", "t2", "text").join(found, ["t1", "t2"]).mapInArrow(_kept, f"t1 long, t2 long, n_gone long, kept binary, spans {SPANS}")

    verdicts = stored(firsts.join(judged, ["t1", "t2"], "left"), "verdicts")
    rows = described.drop("seeds").join(verdicts, ["t1", "t2"])
    copy, none = F.col("doc_id") > F.col("first_doc"), F.lit(0).cast("long")  # all its windows stand in an earlier row
    long_copy = copy & (F.col("n_words") >= window)
    whole = F.array(F.struct(none.alias("start"), F.col("n_words").alias("end")))
    pick = lambda all_, own, nothing: F.when(long_copy, all_).when(copy | F.col("doc_id").isNull(), nothing).otherwise(F.coalesce(own, nothing))
    return rows.select(
        "doc_id", "t1", "t2", "n_words", "full", pick(F.col("n_words"), F.col("n_gone"), none).alias("n_removed"),
        pick(F.unhex(F.sha2(F.lit(""), 256)), F.col("kept"), F.col("full")).alias("kept"), pick(whole, F.col("spans"), F.expr(f"cast(array() as {SPANS})")).alias("spans"),
    )


def removals(docs: DataFrame, window: int = WINDOW, core: int = CORE, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans (of removed words, by number) of every row of docs (doc_id, text)."""
    return repeats(docs, window, core, **how).select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"), "spans")


def _cut(spans: str):
    """Takes the words in the spans, and the white space after them, out of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in W.spans_of(batch, "text"):
                k, texts = b.schema.get_field_index("text"), b.column("text").to_pylist()
                for i, own in enumerate(b.column(spans).to_pylist()):
                    if own:
                        data, at = W.text_bytes(pa.array([texts[i]], pa.string()))
                        starts, _, _ = W.find_words(data, at, IS_WORD)
                        starts, raw = [*starts.tolist(), len(data)], data.tobytes()
                        cuts = [0, *(starts[x[e]] for x in own for e in ("start", "end")), len(raw)]
                        texts[i] = b"".join(raw[s:e] for s, e in zip(cuts[::2], cuts[1::2])).decode()
                yield b.set_column(k, b.schema.field(k), pa.array(texts, b.schema.field(k).type)).drop_columns([spans])

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, **how) -> DataFrame:
    """docs with repeated windows taken out of the texts; rows and other columns stay."""
    spans, t1, t2, of = (W.unused(docs.columns, c) for c in ("_spans", "_t1", "_t2", "_of"))
    found = repeats(docs.select("doc_id", "text"), window, **how).filter("n_removed > 0").select(F.col("doc_id").alias(of), F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("spans").alias(spans))
    found = stored(found.groupBy(of, t1, t2).agg(F.first(spans).alias(spans)), "found")
    a, b = address(F.col("text"))
    marked = docs.join(found, (a == F.col(t1)) & (b == F.col(t2)) & (docs["doc_id"] == F.col(of)), "left").select(*(docs[c] for c in docs.columns), spans)
    return marked.mapInArrow(_cut(spans), docs.schema)


def op6_phrase_automata(spark, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT rid, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
o AS (SELECT h, min(doc_id) AS owner FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
p AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM w JOIN o USING (h) WHERE owner < doc_id),
r AS (SELECT rid, count(*) AS n FROM p GROUP BY rid),
k AS (SELECT x.rid, string_agg(word, ' ' ORDER BY j) AS kept FROM (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d) x
  ANTI JOIN p ON x.rid = p.rid AND x.j = p.p GROUP BY x.rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (rid) LEFT JOIN k USING (rid)
"""
