"""Language identification: family first, then one-versus-one linear SVMs inside the family.

Features are relative frequencies of hashed byte trigrams of the folded text, so a linear
score is a sum over the text: each trigram looks up its weights, and the sums per document
are one segmented reduction.  Whole texts are scored; memory is bounded by the piece.

Training uses about `rows_per_language` labelled rows of each language with MIN_ROWS rows, picked
by a 64-bit hash of id and text, and about SAMPLE rows in all (documented bounds): more than
SAMPLE / rows_per_language languages get fewer rows each, down to LEAST_ROWS.  More languages than
SAMPLE / LEAST_ROWS raise an error; none is left out.  Executors send one histogram per row to
the driver.

Defined results: null texts and texts without a letter are `und` with score 0; with no
labelled row everything is `und`; a language with fewer than MIN_ROWS sampled rows is not
learned; repeated rows get equal results; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideledger.llm.shared import bare, small_batches
from tideledger.llm.words import pieces

BUCKETS = 4096
ROWS_PER_LANGUAGE = 500
MIN_ROWS = 5
SAMPLE = 100_000
#: So many expected rows that a hash picks fewer than MIN_ROWS of them in no practical case.
LEAST_ROWS = 40
#: Families of common languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "semitic": ("ar", "he"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "bn", "mr", "ur"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_fold = np.full(256, 32, np.uint8)
_fold[97:123] = _fold[65:91] = np.arange(97, 123)
_fold[128:] = np.arange(128, 256)


def trigrams(piece) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte, and whether its middle byte belongs to a letter.
    Whatever lies before and behind a row is blank, so neighbours do not change a row's trigrams."""
    data = _fold[piece.data]
    starts, ends = piece.bounds[:-1], piece.bounds[1:]
    starts, ends = starts[starts < len(data)], ends[ends > 0] - 1

    def beside() -> tuple[np.ndarray, np.ndarray]:
        before, after = np.roll(data, 1), np.roll(data, -1)
        before[starts], after[ends] = 32, 32
        return before, after

    before, _ = beside()
    data[(data >= 0x80) & (data <= 0x9E) & (before == 0xC3)] += 0x20  # capitals of Latin-1
    before, after = beside()
    code = (before.astype(np.uint32) << 16) | (data.astype(np.uint32) << 8) | after
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - 12)
    return bucket.astype(np.int64), data != 32


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[r]:bounds[r+1]] along the first axis; empty rows are zero."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0, dtype=np.float64)
    return out


def histograms(piece) -> np.ndarray:
    bucket, letter = trigrams(piece)
    out = np.zeros((piece.rows, BUCKETS), np.float32)
    for r in range(piece.rows):
        span = slice(piece.bounds[r], piece.bounds[r + 1])
        counts = np.bincount(bucket[span][letter[span]], minlength=BUCKETS)
        out[r] = counts / max(1, counts.sum())
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 150) -> np.ndarray:
    """Weights and bias (last) of a linear SVM with squared hinge loss, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c
    weight, y = weight.astype(x.dtype), y.astype(x.dtype)
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(20):  # largest curvature, by power iteration
        v = x.T @ (weight * (x @ v))
        size = float(np.linalg.norm(v))
        v /= size
    step = 1.0 / (1.0 + 2.2 * size)
    w = z = np.zeros(x.shape[1], x.dtype)
    momentum = 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (z - 2 * x.T @ (weight * y * slack))
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        z = new + (momentum - 1) / after * (new - w)
        w, momentum = new, after
    return w


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    of: list[int]  # the family of each language
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # BUCKETS x (families + pairs)
    bias: np.ndarray

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score of rows of margins."""
        n, f = len(margins), len(self.families)
        of = np.array(self.of)
        if f > 1:
            family = margins[:, :f].argmax(1)
            sure = _squash(margins[np.arange(n), family])
        else:
            family, sure = np.zeros(n, int), np.ones(n)
        votes = np.zeros((n, len(self.languages)))
        total = np.zeros_like(votes)
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, f + k]
            votes[:, a] += m > 0
            votes[:, b] += m <= 0
            total[:, a] += m
            total[:, b] -= m
        rank = np.where(of[None, :] == family[:, None], votes + 0.5 * np.tanh(total / 10), -np.inf)
        best = rank.argmax(1)
        others = np.array([sum(best_ in p for p in self.pairs) for best_ in range(len(self.languages))])[best]
        margin = np.where(others > 0, total[np.arange(n), best] / np.maximum(others, 1), 10.0)
        return best, sure * _squash(margin)


def _squash(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(4 * margin, -30, 30)))


def learn(x: np.ndarray, labels: list[str]) -> Model | None:
    names, counts = np.unique(np.array(labels, dtype=object).astype(str), return_counts=True) if labels else ([], [])
    languages = [str(n) for n, c in zip(names, counts, strict=True) if c >= MIN_ROWS]
    if not languages:
        return None
    families = sorted({_FAMILY.get(x, x) for x in languages})
    of = [families.index(_FAMILY.get(x, x)) for x in languages]
    scale = x.std(0) + 0.05 / BUCKETS
    x = x / scale / np.sqrt(x.shape[1]) * 8
    own = np.array([languages.index(v) if v in languages else -1 for v in labels])
    kin = np.array([of[v] if v >= 0 else -1 for v in own])
    tasks = [(np.flatnonzero(own >= 0), np.where(kin == k, 1.0, -1.0)) for k in range(len(families))] if len(families) > 1 else [(np.zeros(0, int), np.zeros(len(x)))]
    pairs = [(a, b) for a, b in combinations(range(len(languages)), 2) if of[a] == of[b]]
    tasks += [(np.flatnonzero((own == a) | (own == b)), np.where(own == a, 1.0, -1.0)) for a, b in pairs]
    weights, bias = np.zeros((BUCKETS, len(tasks)), np.float32), np.zeros(len(tasks))
    for k, (rows, y) in enumerate(tasks):
        if len(rows):
            w = linear_svm(x[rows].astype(np.float32), y[rows].astype(np.float32))
            weights[:, k] = w[:-1] / scale / np.sqrt(BUCKETS) * 8
            bias[k] = w[-1]
    return Model(languages, families, of, pairs, weights, bias)


def last_hash(n: int, rows: int) -> int:
    """The largest 64-bit hash that is picked, so that about `rows` of n rows are."""
    return min((1 << 63) - 1, (rows << 64) // n - (1 << 63))


def train(docs: DataFrame, key: str, text: str, lang: str, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """Learns from a sample of the rows given; the caller leaves held-out rows away."""
    labelled = bare(docs, key, text, lang).where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    most = SAMPLE // LEAST_ROWS
    counts = {r[lang]: r["count"] for r in labelled.groupBy(lang).count().where(F.col("count") >= MIN_ROWS).limit(most + 1).collect()}
    if not counts:
        return None
    if len(counts) > most:
        raise ValueError(f"more than {most} languages with {MIN_ROWS} rows or more")
    each = min(rows_per_language, max(LEAST_ROWS, SAMPLE // len(counts)))
    picked = docs.sparkSession.createDataFrame([(name, last_hash(n, each)) for name, n in counts.items()], "_picked string, _last long")
    lot = F.xxhash64(F.col(key), F.col(text), F.lit(11))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(0)):
                rows = [h.astype(np.float16).tobytes() for h in histograms(piece)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1).slice(piece.first, piece.rows)], ["h", "lang"])

    sample = labelled.join(F.broadcast(picked), (F.col(lang) == F.col("_picked")) & (lot <= F.col("_last")))
    sample = sample.select(text, F.col(lang).alias("lang")).mapInArrow(describe, "h binary, lang string")
    bound = each * len(counts)
    rows = sample.limit(2 * bound).collect()
    x = np.array([np.frombuffer(bytes(r["h"]), np.float16) for r in rows], np.float32).reshape(-1, BUCKETS)
    return learn(x, [r["lang"] for r in rows])


def predictor(spark, model: Model | None):
    """Column function text -> struct(lang, score), evaluated once per row."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        model = shared.value
        known = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False))
        names = np.full(len(known), "und", object)
        scores = np.zeros(len(known))
        for piece in pieces(texts) if model else ():
            bucket, letter = trigrams(piece)
            sums = segment_sums(np.where(letter[:, None], model.weights[bucket], np.float32(0)), piece.bounds)
            letters = segment_sums(letter, piece.bounds)
            best, score = model.decide(sums / np.maximum(letters, 1)[:, None] + model.bias)
            rows = slice(piece.first, piece.first + piece.rows)
            names[rows] = np.array(model.languages, object)[best]
            scores[rows] = score
        names[~known], scores[~known] = "und", 0.0
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang", "score"])

    return predict.asNondeterministic()


def identify(docs: DataFrame, model: Model | None, text: str = "text", into: str = "_language") -> DataFrame:
    """The rows with a struct (lang, score) of the prediction in column `into`."""
    small_batches(docs.sparkSession)
    return docs.withColumn(into, predictor(docs.sparkSession, model)(F.col(f"`{text}`")))


def identified(docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents with a language, which replaces the column `lang`; `und` ones go."""
    free = "_language" + "_" * max(map(len, docs.columns))  # no column of the input has this name
    found = identify(docs, model, text, free).where(F.col(free)["lang"] != "und")
    return found.withColumn(lang, F.col(free)["lang"]).select(*[f"`{c}`" for c in docs.columns])
