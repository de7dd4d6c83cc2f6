"""Byte-level BPE with a segment tree.

A piece of text (one match of the split pattern) starts as single bytes. A segment tree over the byte positions
holds, for each position that starts a live token, the rank of merging it with the next live token; its root
gives the leftmost position of the least rank. A merge changes the pairs at its own position and at its left
neighbour and kills its right neighbour: three point updates of logarithmic cost.

Pieces repeat, so workers keep the ids of recent ones in a table of bounded size; that changes no result. The new pieces of some texts are
merged side by side: many trees of one size are the rows of one array, and each step makes one merge in every row that has one left. Long
pieces, and sizes that few pieces have, are merged one by one (merge_piece).

Defined results: null text is the empty text, with no ids; texts of any length are encoded whole; repeated rows are
encoded each; ids of any type, null ones too, are returned as they are; an empty table gives no rows; extra columns are ignored by the
query and kept by the operator (a column named token_ids is replaced).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.words import spans_of

CACHED = 1 << 18  # pieces that a worker remembers before it starts anew, but for those of one batch
NONE = 1 << 30  # above any rank
SIDE_BY_SIDE, FEWEST, ROWS = 64, 8, 4096  # largest piece in bytes, fewest and most pieces that are merged at once

# Code points that became letters and numbers after Unicode 16, by whose tables texts are split.
LATER_LETTERS = (
    "558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD "
    "A7E2-A7E2 A7F1-A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A "
    "11DB0-11DDB 11DF1-11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 "
    "18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 "
    "1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF "
    "2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
).split()
LATER_NUMBERS = (
    "11DE0-11DE9 1246F-1246F 12475-1247F 12550-12686 16FF4-16FF6 "
).split()


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece.

    tree[1] is the least rank of all live pairs; tree[size + i] is the rank of the pair that starts at byte i.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, rank = len(piece), ranks.get
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (size + size)
    for i in range(n - 1):
        tree[size + i] = rank(piece[i : i + 2], NONE)
    for i in range(size - 1, 0, -1):
        x, y = tree[i + i], tree[i + i + 1]
        tree[i] = x if x <= y else y

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            if other < value:
                value = other
            i >>= 1
            if tree[i] == value:
                return
            tree[i] = value

    end = list(range(1, n + 1))  # of the live token that starts here
    before = list(range(-1, n - 1))  # start of the live token to the left
    while (least := tree[1]) < NONE:
        i = 1
        while i < size:  # to the leftmost place that has it
            i += i
            if tree[i] != least:
                i += 1
        i -= size
        j = end[i]  # start of the right neighbour, which dies
        k = end[i] = end[j]
        if tree[size + j] != NONE:
            put(j, NONE)
        if k < n:
            before[k] = i
            put(i, rank(piece[i : end[k]], NONE))
        else:
            put(i, NONE)
        h = before[i]
        if h >= 0:
            value = rank(piece[h:k], NONE)
            if tree[size + h] != value:
                put(h, value)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pairs:
    """Ranks of pairs of tokens whose bytes together are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.span, self.single = max(ranks.values(), default=0) + 1, np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        keys, values = [-1], [NONE]
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left * self.span + right)
                    values.append(rank)
        order = np.argsort(np.array(keys))
        self.keys, self.values = np.array(keys)[order], np.array(values, np.int64)[order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * self.span + right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.values[at], NONE)


def merge_rows(pieces: list[bytes], pairs: Pairs) -> list[list[int]]:
    """The ids of pieces of 2 to size bytes, none of them a token: one segment tree a row, one merge a row and step."""
    m, lengths = len(pieces), np.array([len(p) for p in pieces])
    size = 1 << int(lengths.max() - 1).bit_length()
    levels = size.bit_length() - 1
    inside = np.arange(size + 1) < lengths[:, None]
    token = np.zeros((m, size + 1), np.int32)
    token[inside] = pairs.single[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.tile(np.arange(1, size + 2, dtype=np.int16), (m, 1))  # start of the next live token, the length at the end
    before = np.tile(np.arange(-1, size, dtype=np.int16), (m, 1))
    live = inside.copy()
    tree = np.full((m, 2 * size), NONE, np.int32)
    linked = inside[:, 1:]  # byte i has a right neighbour
    tree[:, size:][linked] = pairs.ranks(token[:, :-1][linked], token[:, 1:][linked])
    for level in range(levels - 1, -1, -1):
        at = 1 << level
        tree[:, at : 2 * at] = np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2])

    row = np.flatnonzero(tree[:, 1] < NONE)
    while len(row):
        least, i = tree[row, 1], np.ones(len(row), np.int64)
        for _ in range(levels):  # to the leftmost place that has it
            i *= 2
            i += tree[row, i] != least
        i -= size
        j = after[row, i].astype(np.int64)  # the right neighbour, which dies
        k = after[row, j].astype(np.int64)
        token[row, i], after[row, i], live[row, j] = least, k, False
        tree[row, size + j] = NONE
        some = k < lengths[row]
        before[row[some], k[some]] = i[some]
        tree[row, size + i] = NONE
        tree[row[some], size + i[some]] = pairs.ranks(least[some], token[row[some], k[some]])
        h = before[row, i].astype(np.int64)
        left = h >= 0
        tree[row[left], size + h[left]] = pairs.ranks(token[row[left], h[left]], least[left])
        h = np.where(left, h, i)
        for x in (j, i, h):
            x += size
        for _ in range(levels):
            for x in (j, i, h):
                x >>= 1
                tree[row, x] = np.minimum(tree[row, 2 * x], tree[row, 2 * x + 1])
        row = row[tree[row, 1] < NONE]
    ids, ends = token[live].tolist(), np.cumsum(live.sum(1)).tolist()
    return [ids[s:e] for s, e in zip([0, *ends], ends)]


def merge_pieces(pieces: list[bytes], ranks: dict[bytes, int], pairs: Pairs) -> list[list[int]]:
    """The ids of each piece."""
    out: list = [None] * len(pieces)
    sized: dict[int, list[int]] = {}
    for n, piece in enumerate(pieces):
        whole = ranks.get(piece)
        if whole is not None:
            out[n] = [whole]
        elif 2 <= len(piece) <= SIDE_BY_SIDE:
            sized.setdefault((len(piece) - 1).bit_length(), []).append(n)
        else:
            out[n] = merge_piece(piece, ranks)
    for of_size in sized.values():
        for at in range(0, len(of_size), ROWS):
            some = of_size[at : at + ROWS]
            own = [pieces[n] for n in some]
            for n, ids in zip(some, merge_rows(own, pairs) if len(own) >= FEWEST else (merge_piece(p, ranks) for p in own)):
                out[n] = ids
    return out


def as_set(ranges: list[str]) -> str:
    """Ranges of hexadecimal code points as the inside of a character set."""
    return "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in ranges)


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = CACHED):
        import regex

        self.ranks, self.split, self.cached = ranks, regex.compile(pattern).findall, cached
        # for the rare texts with later letters or numbers: the same pattern without them
        older = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{as_set(LATER_LETTERS)}]]").replace(r"\p{N}", rf"[\p{{N}}--[{as_set(LATER_NUMBERS)}]]")
        self.split_older = regex.compile("(?V1)" + older).findall
        self.has_later = re.compile(f"[{as_set(LATER_LETTERS + LATER_NUMBERS)}]").search
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.pairs = Pairs(ranks)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}  # a remembered piece's number; its ids are held[start : start + length]
        self.held, self.start, self.length, self.used = np.zeros(1 << 16, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _remember(self, pieces: list[str]) -> None:
        ids = merge_pieces([p.encode() for p in pieces], self.ranks, self.pairs)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))
        if self.used + len(flat) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(self.used + len(flat), np.int32)])
        self.held[self.used : self.used + len(flat)] = flat
        self.slot.update(zip(pieces, range(len(self.start), len(self.start) + len(pieces))))
        self.start = np.concatenate([self.start, self.used + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.used += len(flat)

    def pieces(self, text: str) -> list[str]:
        plain = text.isascii()
        if not plain:
            try:
                plain = bool(text.encode("latin-1"))
            except UnicodeEncodeError:
                plain = not self.has_later(text)
        return (self.split if plain else self.split_older)(text)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's ids start (one more than there are texts)."""
        if len(self.slot) > self.cached or self.used > 16 * self.cached:
            self.forget()
        split = [self.pieces(t) for t in texts]
        every = list(chain.from_iterable(split))
        slots = np.fromiter(map(self.slot.get, every, repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(slots < 0).tolist()
        if missing:
            self._remember(list({every[i]: None for i in missing}))
            slots[missing] = [self.slot[every[i]] for i in missing]
        lengths = self.length[slots]
        ends = np.cumsum(lengths)
        ids = self.held[np.repeat(self.start[slots] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[np.cumsum([0, *map(len, split)])]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def vocabulary() -> tuple[str, str]:
    """The default rank file and split pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


BATCH = 1 << 20  # bytes of text that are encoded at once (one text at least)


def _encoder(path: str, pattern: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        digits = [str(i) for i in range(len(c.bytes_of))]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            for part in spans_of(b, "text", BATCH):
                ids, at = c.encode_all([t or "" for t in part.column("text").to_pylist()])
                if not digests:
                    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "token_ids"])
                    continue
                own = [ids[s:e].tolist() for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                cols = [pa.array(np.diff(at), pa.int64())]
                cols += [pa.array([sha(",".join([digits[i] for i in x]).encode()) for x in own], pa.string()), pa.array([sha(c.decode(x)) for x in own], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.forget()  # so that a worker that goes on with other things holds no pieces

    return run


def tokenized(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with ``token_ids``."""
    default = vocabulary() if path is None or pattern is None else (path, pattern)
    docs = docs.drop("token_ids")
    schema = docs.withColumn("token_ids", F.expr("cast(null as array<int>)")).schema
    return docs.mapInArrow(_encoder(path or default[0], pattern or default[1], False), schema)


def op8_segment_tree_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_encoder(*vocabulary(), True), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
