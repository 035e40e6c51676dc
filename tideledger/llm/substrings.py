"""Substring dedup by recompression.

A repeat is a window of `window` consecutive words that also starts in a document with a
smaller id; every word that such a window covers goes.

*Recompression.*  Each round names runs of one symbol and then pairs (left symbol, right
symbol), where a hash of the symbol says on which side it may stand.  A name is a hash of what
it stands for, so all documents on all executors give the same name to the same symbols, and
rounds need no exchange.  Every symbol knows the words that its existence depends on; two
equal windows hold the same symbols wherever those words lie inside the window.

*Reveal.*  A window's key is its least such symbol of the last round, named together with the
words that it depends on; a window without one (inside long runs) is its own key.  Neighbouring windows share keys, so a document has one
(key, first, last) row per dozen words or so.  Keys of two or more documents reveal possible
repeats.

*Verify.*  First whole ranges: a range whose key and hash of all its words are those of a
document with a smaller id holds repeats only.  Where ranges of one key differ (near an edit or
the end of a passage), the first one of each kind is taken apart, and its windows are compared
by 128-bit hashes of their words.  The least id of each hash comes from partial aggregation.
Texts are shuffled only for documents that a bitmap of fixed size names, which costs time,
never a result, when it fills up.

Defined results: null, empty and blank texts have no words; texts shorter than the window are
kept whole; rows of one id never count as repeats of each other, whatever their texts; other
columns are left alone; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideledger.llm.decontamination import bitmap
from tideledger.llm.shared import Workspace, bare, id_back, id_of, small_batches
from tideledger.llm.words import BASE, BASE_INVERSE, SOLID, Piece, mix, pieces, powers, run_hashes, word_hashes, words

WINDOW = 50
ROUNDS = 3
_U = np.uint64
_KEY = np.dtype([("key", "<i8"), ("span", "<i8"), ("first", "<i4"), ("last", "<i4")])


def _bounded(sym, row, low, high, edges):
    """Neighbours' dependencies; a missing neighbour puts the symbol beyond its text."""
    left, right = np.empty_like(low), np.empty_like(high)
    left[1:], right[:-1] = low[:-1], high[1:]
    start = np.ones(len(row), bool)
    start[1:] = row[1:] != row[:-1]
    end = np.ones(len(row), bool)
    end[:-1] = start[1:]
    left[start] = edges[row[start]] - 1
    right[end] = edges[row[end] + 1] + 1
    return left, right, start, end


def recompress(hashes: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after some rounds over rows of words (first[r]:first[r+1]), and the range of
    words low..high (exclusive) that each one depends on."""
    n = len(hashes)
    sym = hashes.copy()
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low, high = np.arange(n), np.arange(1, n + 1)
    for level in range(rounds):
        # Runs: blocks of equal symbols, as long as they go; each depends on both neighbours.
        left, right, start, _ = _bounded(sym, row, low, high, first)
        head = start.copy()
        head[1:] |= sym[1:] != sym[:-1]
        at = np.flatnonzero(head)
        last = np.append(at[1:], len(sym)) - 1
        times = (last - at + 1).astype(_U)
        sym = np.where(times > 1, mix(sym[at] + times * _U(0x9E3779B97F4A7C15)), sym[at])
        row, low, high = row[at], left[at], right[last]
        # Pairs of a left and a right symbol; a symbol left alone depends on one neighbour.
        left, right, start, end = _bounded(sym, row, low, high, first)
        second = (mix(sym + _U(level + 1)) & _U(1)).astype(bool)
        opens = np.zeros(len(sym), bool)
        opens[:-1] = ~second[:-1] & second[1:] & ~end[:-1]
        closes = np.zeros(len(sym), bool)
        closes[1:] = opens[:-1]
        alone = ~opens & ~closes
        low = np.where(alone & second, left, low)
        high = np.where(alone & ~second, right, high)
        nxt = np.append(sym[1:], _U(0))
        name = np.where(opens, mix(sym * _U(0xD6E8FEB86659FD93) + mix(nxt) + _U(level)), sym)
        high = np.where(opens, np.append(high[1:], 0), high)
        keep = ~closes
        sym, row, low, high = name[keep], row[keep], low[keep], high[keep]
    return sym, low, high


def _sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of which (sums[b] - sums[a]) * inverse[a] is a hash of words a..b."""
    sums = np.zeros(len(hashes) + 1, _U)
    np.cumsum(mix(hashes + _U(9)) * powers("up", BASE, len(hashes) + 1)[: len(hashes)], out=sums[1:])
    return sums, powers("down", BASE_INVERSE, len(hashes) + 1)


def window_keys(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows inside rows, and their keys."""
    counts = np.maximum(np.diff(first) - window + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    begin = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(total)
    sym, low, high = recompress(hashes, first)
    sums, inverse = _sums(hashes)
    at, end = np.maximum(low, 0), np.minimum(high, len(hashes))
    sym = mix(sym + (sums[end] - sums[at]) * inverse[at])  # with the words it depends on: far more telling
    a, b = np.searchsorted(low, begin, "left"), np.searchsorted(high, begin + window, "right")
    keys = mix(run_hashes(hashes, window)[begin] + _U(1))  # of windows without a whole symbol
    width = b - a
    tables, size = [sym], 1
    while 2 * size <= int(width.max(initial=0)):
        below = tables[-1]
        tables.append(np.minimum(below[: len(below) - size], below[size:]))
        size *= 2
    level = np.zeros(len(width), np.int64)
    full = width > 0
    level[full] = np.log2(width[full]).astype(np.int64)
    for k, table in enumerate(tables):
        at = np.flatnonzero(full & (level == k))
        keys[at] = np.minimum(table[a[at]], table[b[at] - (1 << k)])
    return begin, keys


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _joined(piece: Piece, found, r: int, keep: np.ndarray | None = None) -> bytes:
    """Words of row r joined by single spaces, all or those marked."""
    own = piece.row(r).split()
    return b" ".join(own if keep is None else [w for w, k in zip(own, keep.tolist(), strict=True) if k])


def keyed(docs: DataFrame, window: int) -> DataFrame:
    """Per row: id, mark, n_words, sha256 of its words, and its window keys with their ranges."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, keys = [], [], []
            for piece in pieces(batch.column(2)):
                found = words(piece, SOLID)
                hashes = word_hashes(piece, found, False)
                begin, key = window_keys(hashes, found.first, window)
                spans = np.searchsorted(begin, found.first)
                sums, inverse = _sums(hashes)
                counts.append(found.counts())
                for r in range(piece.rows):
                    digests.append(_sha(_joined(piece, found, r)))
                    i, j = int(spans[r]), int(spans[r + 1])
                    own = key[i:j]
                    cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if j > i else np.zeros(0, np.int64)
                    rows = np.empty(len(cut), _KEY)
                    rows["key"], rows["first"], rows["last"] = own[cut].view(np.int64), cut, np.append(cut[1:], j - i) - 1 if len(cut) else cut
                    a, b = found.first[r] + rows["first"], found.first[r] + rows["last"] + window
                    rows["span"] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(_U)).view(np.int64)
                    keys.append(rows.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(digests, pa.string()), pa.array(keys, pa.binary())],
                ["doc", "mark", "n_words", "sha", "keys"],
            )

    return docs.mapInArrow(name, "doc long, mark long, n_words long, sha string, keys binary")


def spread(rows: DataFrame) -> DataFrame:
    """One row per key and range of a document."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            own = np.frombuffer(b"".join(raw), _KEY)
            times = [len(x) // _KEY.itemsize for x in raw]
            ids = [pa.array(np.repeat(batch.column(k).to_numpy(zero_copy_only=False), times)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, *[pa.array(np.ascontiguousarray(own[c])) for c in _KEY.names]], ["doc", "mark", *_KEY.names])

    return rows.select("doc", "mark", "keys").mapInArrow(explode, "doc long, mark long, key long, span long, first int, last int")


def window_hashes(docs: DataFrame, window: int) -> DataFrame:
    """Rows (high, low, doc, mark, start) of the windows in the ranges of each document."""

    def hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, firsts, lasts = (batch.column(c).to_pylist() for c in ("doc", "mark", "firsts", "lasts"))
            for piece in pieces(batch.column("text")):
                found = words(piece, SOLID)
                both = [run_hashes(word_hashes(piece, found, False, t), window) for t in (0, 1)]
                at, own, mark, start = [], [], [], []
                for r in range(piece.rows):
                    a, b = np.array(firsts[piece.first + r]), np.array(lasts[piece.first + r])
                    step = np.zeros(int(found.first[r + 1] - found.first[r]) + 1, np.int64)
                    np.add.at(step, a, 1)
                    np.add.at(step, b + 1, -1)
                    begin = np.flatnonzero(np.cumsum(step) > 0)
                    start.append(begin)
                    at.append(begin + found.first[r])
                    own.append(np.full(len(begin), ids[piece.first + r]))
                    mark.append(np.full(len(begin), marks[piece.first + r]))
                at = np.concatenate(at)
                columns = [both[0][at].view(np.int64), both[1][at].view(np.int64), np.concatenate(own), np.concatenate(mark), np.concatenate(start).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["high", "low", "doc", "mark", "start"])

    return docs.mapInArrow(hash_windows, "high long, low long, doc long, mark long, start int")


def without(docs: DataFrame, window: int) -> DataFrame:
    """Documents with the ranges of their repeated windows: what is left of the words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column("ranges").to_pylist()
            removed, digests, texts = [], [], []
            for piece in pieces(batch.column("text")):
                found = words(piece, SOLID)
                for r in range(piece.rows):
                    n = int(found.first[r + 1] - found.first[r])
                    own = starts[piece.first + r]
                    step = np.zeros(n + window + 1, np.int64)
                    np.add.at(step, np.array([x["first"] for x in own]), 1)
                    np.add.at(step, np.array([x["last"] for x in own]) + window, -1)
                    gone = np.cumsum(step)[:n] > 0
                    kept = _joined(piece, found, r, ~gone)
                    removed.append(int(gone.sum()))
                    digests.append(_sha(kept))
                    texts.append(kept.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("mark"), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                ["doc", "mark", "n_removed", "kept_sha256", "kept"],
            )

    return docs.select("doc", "mark", "text", "ranges").mapInArrow(cut, "doc long, mark long, n_removed long, kept_sha256 string, kept string")


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows that may be of the named documents, by a bitmap of fixed size."""
    bits = rows.sparkSession.sparkContext.broadcast(np.packbits(bitmap(docs.select(F.xxhash64("doc", "mark").alias("token")))))

    @F.arrow_udf("boolean")
    def inside(hashes: pa.Array) -> pa.Array:
        return pa.array(np.unpackbits(bits.value).astype(bool)[(hashes.to_numpy().view(_U) >> _U(40)).astype(np.int64)])

    return rows.where(inside(F.xxhash64("doc", "mark")))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document row: id, n_words, n_removed, kept_sha256, and `kept`: the words left, joined
    by spaces, where some were removed and some were left (else null)."""
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark, "substrings")
    rows = bare(docs, key, text).select(id_of(key).alias("doc"), F.xxhash64(text).alias("mark"), F.coalesce(text, F.lit("")).alias("text"))
    named = work.keep(keyed(rows, window), "keys")

    # Ranges under keys of two or more ids; `mixed` where not all ranges of the key are alike.
    ranges = spread(named.where(F.length("keys") > 0))
    per_key = ranges.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.min("span").alias("s"), F.max("span").alias("t"))
    # Written first, so that the join below has plain exchanges, which Spark can split where a key is hot.
    shared = work.keep(per_key.where("a < b").select("key", F.expr("s <> t").alias("mixed")), "shared-keys")
    alike = work.keep(ranges.join(shared, "key"), "shared")
    work.free()
    least = work.keep(alike.groupBy("key", "span").agg(F.min("doc").alias("least")), "least")
    judged = alike.join(least, ["key", "span"]).where("mixed or doc > least")
    judged = work.keep(judged.select("doc", "mark", "first", "last", F.expr("doc > least").alias("repeat")), "judged")
    work.drop(alike, shared, least)

    apart = judged.where("not repeat").groupBy("doc", "mark").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    windows = work.keep(window_hashes(_named(rows, judged.where("not repeat")).join(apart, ["doc", "mark"]).select("doc", "mark", "text", "firsts", "lasts"), window), "windows")
    work.free()
    least = windows.groupBy("high", "low").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    least = work.keep(least, "least-windows")
    hits = windows.join(least, ["high", "low"]).where("doc > least").select("doc", "mark", F.col("start").alias("first"), F.col("start").alias("last"))
    hits = work.keep(judged.where("repeat").select("doc", "mark", "first", "last").unionByName(hits), "hits")
    work.drop(windows, judged, least)
    work.free()

    # A document of which every window is a repeat has no words left; its text is not needed.
    by_doc = hits.distinct().groupBy("doc", "mark").agg(F.sum(F.expr("last - first + 1")).alias("repeats"), F.collect_list(F.struct("first", "last")).alias("ranges"))
    cuts = named.select("doc", "mark", "n_words").distinct().join(by_doc, ["doc", "mark"])
    whole = F.col("repeats") >= F.col("n_words") - (window - 1)
    partial = work.keep(cuts.where(~whole).select("doc", "mark", "ranges"), "partial")
    cut = without(_named(rows, partial).join(partial, ["doc", "mark"]).dropDuplicates(["doc", "mark"]), window)
    none = cuts.where(whole).select("doc", "mark", F.col("n_words").alias("n_removed"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"), F.lit("").alias("kept"))
    cut = work.keep(cut.unionByName(none), "cut")

    found = named.select("doc", "mark", "n_words", "sha").join(cut, ["doc", "mark"], "left")
    return found.select(
        id_back("doc").alias(key), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept",
    )
