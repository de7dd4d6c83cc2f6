"""Language identification with error-correcting output codes.

Each language has a codeword; for each bit a binary classifier (logistic regression on hashed character 1- to 3-grams)
predicts which side a text is on. A text gets the language whose codeword is nearest by loss: the sum over bits
of the logistic loss of the margin against the codeword's bit, each weighted by how well that bit's classifier
does on that language. A text is ambiguous where the two nearest codewords are about as near, or none is near.

Training takes at most SAMPLE labelled documents of each language, those with the least hash, and IN_ALL of all
languages; features are made by the workers, and only those of the sample go to the driver, whatever the number of documents.
Prediction reads whole texts and only texts.

Defined results: null texts and texts without a letter are ``und`` with score 0; rows without doc_id are not held out;
without labelled texts every text is ``und``; languages as near as each other go in order of their names; texts of any length are
read whole, in chunks; repeated rows are judged each; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UND = "und"
SAMPLE = 250  # labelled documents of a language at most
LANGUAGES, IN_ALL = 500, 8000  # languages that are learned, those with the most labelled documents; documents of all of them at most
FEATURES = 4096
CHUNK = 1 << 18  # characters at once
ROUNDS = 200
RIDGE = 1e-4
LIKELY = 0.5  # least score of a document in identified(): its language is likelier than all others together
CLOSE = 0.2  # ambiguous below this lead of the best language over the next
_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of the roots of hashed 1- to 3-gram counts, letters lower-cased, all else a space; None without a letter."""
    counts, some = np.zeros(FEATURES), False
    low, tail = (text or "").lower(), np.zeros(0, np.uint64)
    for at in range(0, len(low), CHUNK):
        points = _points(low[at : at + CHUNK])
        letters = letter_table()[points]
        some = some or bool(letters.any())
        c = np.where(letters, points, 32).astype(np.uint64)
        keep = letters.copy()  # runs of others are one space
        keep[1:] |= letters[:-1]
        keep[0] |= not len(tail) or tail[-1] != 32
        c = np.concatenate([tail, c[keep]])
        h = c * np.uint64(0x9E3779B97F4A7C15)
        for n in (1, 2, 3):
            if n > 1:
                h = (h[: max(0, len(c) - n + 1)] ^ c[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            new = h[max(0, len(tail) - n + 1) :]  # grams that end in this chunk
            slots = (new + np.uint64(n * 0x632BE59BD9B4E019 % 2**64)) >> np.uint64(52)
            counts += np.bincount(slots.astype(np.int64), minlength=FEATURES)
        tail = c[-2:]
    if not some:
        return None
    x = np.sqrt(counts)
    return (x / np.linalg.norm(x)).astype(np.float32)


def codewords(k: int) -> np.ndarray:
    """k rows of -1 and 1. Up to five languages: every split into two sides. More: the best of some random codes."""
    if k <= 5:
        splits = [s for r in range(k) for s in combinations(range(1, k), r)]  # sides without language 0
        out = np.array([[1 if i in s else -1 for s in splits if s] for i in range(k)], np.int8)
        return out.reshape(k, -1)
    rng, bits, best = np.random.default_rng(7), max(15, math.ceil(10 * math.log2(k))), None
    for _ in range(60):
        code = rng.choice(np.array([-1, 1], np.int8), (k, bits))
        code[0, np.abs(code.sum(0)) == k] *= -1  # no bit is the same for all
        far = (bits - code.astype(int) @ code.T.astype(int)) // 2 + np.eye(k, dtype=int) * bits
        if best is None or far.min() > best[0]:
            best = (far.min(), code)
    return best[1]


def loss(margins: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -margins)


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # feature x bit
    bias: np.ndarray
    trust: np.ndarray  # language x bit, rows sum to 1

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of features to (languages by nearness, their probabilities)."""
        if len(self.langs) == 1:
            return np.zeros((len(x), 1), int), np.ones((len(x), 1))
        margins = x @ self.weights + self.bias
        far = np.einsum("nkb,kb->nk", loss(margins[:, None, :] * self.code[None]), self.trust)
        p = np.exp(-far * self.code.shape[1])
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        return order, np.take_along_axis(p, order, 1)


def fit(x: np.ndarray, langs: list[str]) -> Model | None:
    names = sorted(set(langs))
    if not names:
        return None
    y, code = np.array([names.index(v) for v in langs]), codewords(len(names))
    bits = code.shape[1]
    if not bits:
        return Model(names, code, np.zeros((x.shape[1], 0)), np.zeros(0), np.zeros((1, 0)))
    share = (1 / np.bincount(y, minlength=len(names)) / len(names))[y][:, None]  # every language weighs the same
    target = code[y].astype(np.float32)
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    vw, vb, rate = w.copy(), b.copy(), 8.0
    for i in range(ROUNDS):  # accelerated gradient steps on the mean logistic loss
        m = x @ vw + vb
        g = (-target / (1 + np.exp(target * m)) * share).astype(np.float32)
        nw, nb = vw - rate * (x.T @ g + RIDGE * vw), vb - g.sum(0)
        momentum = i / (i + 3)
        vw, vb, w, b = nw + momentum * (nw - w), nb + momentum * (nb - b), nw, nb
    right = (x @ w + b) * target > 0
    trust = np.array([right[y == k].mean(0) for k in range(len(names))]) + 1e-3
    return Model(names, code, w, b, trust / trust.sum(1, keepdims=True))


def some_letter(text):
    """Whether a text may have a letter: features() has the last word."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def remainder():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        xs = [features(t.as_py()) for t in b.column("text")]
        data = pa.array([None if x is None else x.tobytes() for x in xs], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), data], ["lang", "h", "x"])


def train(labelled: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> Model | None:
    """labelled: doc_id, text, lang. At most sample texts of each language, those with the least hashes, reach the driver's fit.

    Each partition keeps the least hashes of its own before anything is shuffled, so neither hot languages nor rows that repeat (which
    have one hash, and count once) make much of it; texts are read for the chosen hashes only.
    """
    known = labelled.filter(F.col("lang").isNotNull())
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang").collect()
    if not sizes:
        return None
    names = [r.lang for r in sizes]
    each = max(1, min(sample, IN_ALL // len(names)))
    hashed = known.filter(F.col("lang").isin(names) & some_letter(F.col("text"))).select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"))
    place = F.dense_rank().over(Window.partitionBy("lang").orderBy("h"))
    chosen = hashed.select("lang", "h").withColumn("place", place).filter(F.col("place") <= each).select("lang", "h").distinct()
    rows = hashed.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])  # IN_ALL rows are broadcast at most
    got = sorted((r.lang, r.h, bytes(r.x)) for r in rows.mapInArrow(_features, "lang string, h long, x binary").filter("x is not null").collect())
    if not got:
        return None
    return fit(np.stack([np.frombuffer(x, np.float32) for _, _, x in got]), [lang for lang, _, _ in got])


PREDICTED = "lang_pred string, score double, lang_second string, lead double, ambiguous boolean"


def _predictor(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                out = [(UND, 0.0, None, 0.0, True)] * b.num_rows
                xs = [features(t.as_py()) for t in b.column("text")] if model else []
                rows = [i for i, x in enumerate(xs) if x is not None]
                if rows:
                    order, p = model.decode(np.stack([xs[i] for i in rows]))
                    for i, o, q in zip(rows, order.tolist(), p.tolist()):
                        lead = q[0] - q[1] if len(q) > 1 else 1.0
                        out[i] = (model.langs[o[0]], q[0], model.langs[o[1]] if len(o) > 1 else None, lead, lead < CLOSE)
                cols = list(zip(*out))
                kinds = [pa.string(), pa.float64(), pa.string(), pa.float64(), pa.bool_()]
                names = [x.split()[0] for x in PREDICTED.split(", ")]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(c, t) for c, t in zip(cols, kinds))], [*keep, *names])

    return run


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns keep of docs with lang_pred, score, lang_second, lead and ambiguous. Only text is an input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = docs.select(*keep).schema
    for part in PREDICTED.split(", "):
        schema = schema.add(*part.split())
    return given.mapInArrow(_predictor(shared, keep), schema)


def op4_output_codes(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(remainder() != 1))
    out = predict(docs.withColumn("held_out", remainder() == 1), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "lang_second", "lead", "ambiguous")


def _sieve(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, least = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                if model is None:
                    yield b.filter(pa.array([bool(letter_table()[_points(t.as_py())].any()) for t in b.column("text")], pa.bool_()))
                    continue
                scores = np.full(b.num_rows, -1.0)
                xs = [features(t.as_py()) for t in b.column("text")]
                rows = [i for i, x in enumerate(xs) if x is not None]
                if rows:
                    scores[rows] = model.decode(np.stack([xs[i] for i in rows]))[1][:, 0]
                yield b.filter(pa.array(scores >= least))

    return run


def identified(docs: DataFrame, labelled: DataFrame | None = None, least: float = LIKELY) -> DataFrame:
    """docs without those that get no language: no letter, or no codeword near enough (a score below least). Columns stay.

    The model is learned from the labelled ones of docs, if no others are given; where none is labelled, no language is
    told from another and only documents without a letter go.
    """
    model = train((docs if labelled is None else labelled).select("doc_id", "text", "lang").filter(remainder() != 1))
    return docs.mapInArrow(_sieve(docs.sparkSession.sparkContext.broadcast((model, least))), docs.schema)
