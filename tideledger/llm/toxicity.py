"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of whole texts: densities of lexicon terms by strength, closeness of terms to a
second-person word, capitals, punctuation, and obfuscation (terms that only show once the
text is normalised: look-alike digits and signs read as letters, marks inside words left out,
repeated letters as one, lone letters joined).

The lexicon is learned: words and word beginnings of PREFIXES bytes, of the normalised text,
that are far more frequent in documents labelled toxic.  Lexicon and trees see at most about
`rows` labelled documents (documented bound), picked by a hash of the id.  A fifth of them
only calibrates.  A document's terms are looked up in a bitmap first, so the cost per word
does not depend on the lexicon.

Defined results: null and empty texts have features and a score; with no labelled row of one
of the classes the score is the share of toxic labels, or 0; repeated documents get equal
scores; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideledger.llm import forest
from tideledger.llm.quality import matrix, sampled
from tideledger.llm.shared import Workspace, bare, small_batches
from tideledger.llm.statistics import NAMES, statistics
from tideledger.llm.words import ALNUM, LOWER, Piece, mix, pieces, word_hashes, words

ROWS = 20_000
PREFIXES = (4, 5, 6)
LEAST_DOCUMENTS = 4
EVIDENCE = 30
NEAR = 5
BITS = 1 << 20
_U = np.uint64

#: Signs that stand for letters, and second-person words.
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes tú ti contigo".split()

_b = np.arange(256)
_letter = ((_b >= 97) & (_b < 123)) | ((_b >= 65) & (_b < 91)) | (_b >= 0x80)
_read = LOWER.copy()
for _sign, _plain in LOOK_ALIKE.items():
    _read[ord(_sign)] = ord(_plain)
_inner = np.isin(_b, list(b".*-_'#~^+|/"))  # left out between letters
_sign_like = np.isin(_b, list(b"0134571@$!"))


def normalised(piece: Piece) -> Piece:
    """The piece with look-alikes read as letters (next to letters), marks inside words and
    repeats of a letter left out."""
    data = piece.data
    if len(data) < 2:
        return Piece(piece.first, LOWER[data], piece.bounds)
    letter = _letter[data]
    left, right = np.zeros_like(letter), np.zeros_like(letter)
    left[1:], right[:-1] = letter[:-1], letter[1:]
    edge = piece.bounds[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    left[edge], right[edge - 1] = False, False
    out = np.where(_sign_like[data] & (left | right) & ~((data == 33) & ~right), _read[data], LOWER[data])
    keep = ~(_inner[data] & left & right)
    same = np.zeros_like(letter)
    same[1:] = (out[1:] == out[:-1]) & letter[1:] & letter[:-1] & (data[1:] < 0x80)
    same[edge] = False
    keep &= ~same
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return Piece(piece.first, out[keep], kept[piece.bounds])


def terms(piece: Piece):
    """Words of a piece, their hashes, and the hashes of their beginnings (0 where shorter)."""
    found = words(piece, ALNUM)
    whole = word_hashes(piece, found, True)
    size = found.ends - found.starts
    heads = []
    for k in PREFIXES:
        cut = type(found)(found.starts, np.minimum(found.starts + k, found.ends), found.first)
        heads.append(np.where(size > k, mix(word_hashes(piece, cut, True) + _U(k)), _U(0)))
    return found, whole, heads


def _fixed(names: list[str]) -> np.ndarray:
    text = " ".join(names)
    piece = next(pieces(pa.array([text])))
    return np.sort(word_hashes(piece, words(piece, ALNUM), True))


def lexicon_counts(texts: DataFrame) -> DataFrame:
    """Rows (term, toxic, clean): documents of the sample (y, text) that hold each term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            held: list[list[np.ndarray]] = [[np.zeros(0, _U)], [np.zeros(0, _U)]]
            for piece in pieces(batch.column(1)):
                found, whole, heads = terms(normalised(piece))
                for r in range(piece.rows):
                    span = slice(found.first[r], found.first[r + 1])
                    own = np.unique(np.concatenate([x[span] for x in (whole, *heads)]))
                    held[int(labels[piece.first + r])].append(own[own != 0])
            clean, toxic = (np.unique(np.concatenate(x), return_counts=True) for x in held)
            every = np.union1d(clean[0], toxic[0])
            times = []
            for names, n in (toxic, clean):
                column = np.zeros(len(every), np.int64)
                column[np.searchsorted(every, names)] = n
                times.append(pa.array(column))
            yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), *times], ["term", "toxic", "clean"])

    return texts.mapInArrow(count, "term long, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@dataclass
class Lexicon:
    terms: np.ndarray  # sorted hashes
    strength: np.ndarray  # log odds
    bits: np.ndarray
    you: np.ndarray

    @classmethod
    def of(cls, names: np.ndarray, strength: np.ndarray) -> Lexicon:
        order = np.argsort(names)
        bits = np.zeros(BITS, bool)
        bits[(names >> _U(44)).astype(np.int64)] = True
        return cls(names[order], strength[order], bits, _fixed(SECOND_PERSON))

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Strength of each hash, 0 where it is no term."""
        out = np.zeros(len(hashes))
        at = np.flatnonzero(self.bits[(hashes >> _U(44)).astype(np.int64)])
        if len(at) and len(self.terms):
            place = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
            out[at] = np.where(self.terms[place] == hashes[at], self.strength[place], 0.0)
        return out


FEATURES = [*NAMES, "strong", "middle", "strongest", "mean_strength", "near_you", "you", "hidden", "hidden_share", "lone_letters", "look_alikes"]


def features(piece: Piece, lexicon: Lexicon) -> np.ndarray:
    plain = statistics(piece)
    read = normalised(piece)
    found, whole, heads = terms(read)
    strength = np.maximum.reduce([lexicon.look_up(x) for x in (whole, *heads)])
    seen, whole0, heads0 = terms(piece)
    open_strength = np.maximum.reduce([lexicon.look_up(x) for x in (whole0, *heads0)])
    you = np.isin(whole, lexicon.you)
    size = found.ends - found.starts
    lone = (size == 1) & _letter[read.data[found.starts]] if len(size) else np.zeros(0, bool)
    like = _sign_like[piece.data]
    out = np.zeros((piece.rows, len(FEATURES)))
    out[:, : len(NAMES)] = plain
    for r in range(piece.rows):
        i, j = int(found.first[r]), int(found.first[r + 1])
        n = j - i
        if not n:
            continue
        own = strength[i:j]
        hit = np.flatnonzero(own)
        open_hits = np.count_nonzero(open_strength[seen.first[r] : seen.first[r + 1]])
        hidden = _spelled(lone[i:j], read, found, i, lexicon) + max(0, len(hit) - open_hits)
        near = 0.0
        me = np.flatnonzero(you[i:j])
        if len(me) and len(hit):
            at = np.searchsorted(me, hit)
            gap = np.minimum(np.abs(hit - me[np.maximum(at - 1, 0)]), np.abs(me[np.minimum(at, len(me) - 1)] - hit))
            near = float((gap <= NEAR).mean())
        out[r, len(NAMES) :] = (
            100 * np.count_nonzero(own >= 4) / n, 100 * np.count_nonzero(own >= 2) / n, own.max(), own.sum() / n, near, len(me) / n,
            hidden, hidden / (len(hit) + hidden + 1), lone[i:j].mean(), like[piece.bounds[r] : piece.bounds[r + 1]].mean(),
        )
    return out


def _spelled(lone: np.ndarray, read: Piece, found, first: int, lexicon: Lexicon) -> int:
    """Terms spelled by runs of three or more lone letters."""
    edge = np.diff(np.concatenate(([0], lone.view(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    runs = [(a, b) for a, b in zip(begin.tolist(), end.tolist(), strict=True) if b - a >= 3]
    if not runs:
        return 0
    joined = [read.data[found.starts[first + a : first + b]].tobytes().decode("latin-1") for a, b in runs]
    piece = next(pieces(pa.array(joined)))
    _, whole, heads = terms(normalised(piece))
    return int(np.count_nonzero(np.maximum.reduce([lexicon.look_up(x) for x in (whole, *heads)])))


def learn_lexicon(counted: DataFrame, toxic: int, clean: int) -> Lexicon:
    """Terms of toxic documents with log odds of 2 or more that are no chance finds (documents
    times log odds of EVIDENCE or more); their number is bounded by the words of the sample."""
    odds = F.log((F.col("toxic") + 0.2) / F.lit(toxic + 1.0)) - F.log((F.col("clean") + 0.2) / F.lit(clean + 1.0))
    rows = counted.where(F.col("toxic") >= LEAST_DOCUMENTS).select("term", "toxic", odds.alias("odds")).where(f"odds >= 2 and toxic * odds >= {EVIDENCE}").select("term", "odds").collect()
    names = np.array([r["term"] for r in rows], np.int64).view(_U)
    return Lexicon.of(names, np.array([min(r["odds"], 8.0) for r in rows]))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = ROWS) -> DataFrame:
    """Per document row: id, score (0 to 1)."""
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark, "toxicity")
    own = bare(docs, key, text).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    picked = work.keep(sampled(labels, key, label, rows), "sample")
    # One text of each labelled id, however many rows the id has: at most 2 * rows.
    texts = work.keep(own.join(F.broadcast(picked.distinct()), "doc").groupBy("doc", "y").agg(F.min("text").alias("text")), "labelled")
    tally = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    # Terms are counted in half of the sample: their strengths look no better to the trees than they are.
    half = F.pmod(F.xxhash64("doc", F.lit(23)), F.lit(2)) == 0
    lexicon = spark.sparkContext.broadcast(learn_lexicon(lexicon_counts(texts.where(half).select("y", "text")), tally.get(1, 0) // 2, tally.get(0, 0) // 2))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                raw = [x.tobytes() for x in features(piece, lexicon.value).astype(np.float32)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.rows), pa.array(raw, pa.binary())], ["doc", "features"])

    sample = texts.groupBy("doc").agg(F.min("text").alias("text")).mapInArrow(describe, "doc long, features binary").join(picked.distinct(), "doc").collect()
    x, y = matrix(sample, len(FEATURES))
    lot = np.random.default_rng(5).random(len(x))
    fitting = lot < 0.8
    trees = forest.fit(x[fitting], y[fitting], trees=60, depth=3)
    curve = forest.isotonic(trees.margins(x[~fitting]), y[~fitting]) if (~fitting).any() and 0 < y.sum() < len(y) else None
    model = spark.sparkContext.broadcast((trees, curve, float(y.mean()) if len(y) else 0.0))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, curve, share = model.value
        for batch in batches:
            for piece in pieces(batch.column(1)):
                if curve is None:
                    scores = np.full(piece.rows, share)
                else:
                    x = features(piece, lexicon.value).astype(np.float32).astype(np.float64)
                    scores = np.interp(trees.margins(x), *curve)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.rows), pa.array(scores)], ["doc", "score"])

    return own.mapInArrow(predict, "doc long, score double").withColumnRenamed("doc", key)
