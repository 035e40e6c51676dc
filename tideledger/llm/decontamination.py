"""Benchmark decontamination by a prefix-filtered set join.

A window is `window` consecutive words of a benchmark item (a shorter item is one window).
A window is the set of its shingles of GRAM words; all of them must occur, so its necessary
prefix is one shingle: the rarest in the documents.

1. Count the benchmark's shingles over all documents (a bitmap of fixed size says which
   shingles to count).  A window with a shingle that never occurs is out.
2. Each other window is keyed by its rarest shingle and that shingle's offset.
3. A second pass over the documents emits the places of such shingles with the words around
   them, again through a bitmap of fixed size; they join the windows on the shingle.
4. Bounds (enough words before and after) and then the words themselves are compared.

Both bitmaps have BITS bits whatever the size of the benchmark; a full bitmap costs time,
never a result.  Defined results: null or empty texts have no words and are clean; an empty
benchmark or document table gives no hits; repeated rows are judged alike; rows of one id
with different texts are judged each by its own text; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideledger.llm.shared import Workspace, bare, id_back, id_of, small_batches
from tideledger.llm.words import ALNUM, LOWER, pieces, run_hashes, word_hashes, words

GRAM = 4
BITS = 1 << 24
_U = np.uint64


def _texts(piece, found, at: int, upto: int) -> list[str]:
    """Lower-cased words number at..upto of a piece."""
    low, high = int(found.starts[at]), int(found.ends[upto - 1])
    raw = LOWER[piece.data[low:high]].tobytes()
    return [raw[s - low : e - low].decode() for s, e in zip(found.starts[at:upto].tolist(), found.ends[at:upto].tolist(), strict=True)]


def item_windows(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """Rows (item, words, size, tokens): all windows of all items, words joined by a space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            out: dict[str, list] = {"item": [], "words": [], "size": [], "tokens": []}
            for piece in pieces(batch.column(1)):
                found = words(piece, ALNUM)
                hashes = word_hashes(piece, found, True)
                for r in range(piece.rows):
                    a, b = int(found.first[r]), int(found.first[r + 1])
                    if a == b:
                        continue
                    own = _texts(piece, found, a, b)
                    size = min(window, b - a)
                    tokens = run_hashes(hashes[a:b], min(GRAM, size)).view(np.int64)
                    for i in range(b - a - size + 1):
                        out["item"].append(names[piece.first + r])
                        out["words"].append(" ".join(own[i : i + size]))
                        out["size"].append(size)
                        out["tokens"].append(tokens[i : i + size - min(GRAM, size) + 1])
            yield pa.RecordBatch.from_pydict(
                {"item": pa.array(out["item"], pa.string()), "words": pa.array(out["words"], pa.string()), "size": pa.array(out["size"], pa.int32()), "tokens": pa.array(out["tokens"], pa.list_(pa.int64()))}
            )

    rows = items.select(F.col(key).cast("string").alias("item"), text)
    return rows.mapInArrow(cut, "item string, words string, size int, tokens array<long>")


def bitmap(tokens: DataFrame) -> np.ndarray:
    """BITS booleans, one for each hash class that holds one of the tokens."""
    per = BITS // 256

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(per, bool)
        bits[rows["bit"].to_numpy() % per] = True
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})

    bit = F.shiftrightunsigned("token", 40)
    chunks = tokens.select(bit.alias("bit")).distinct().withColumn("chunk", F.expr(f"cast(bit div {per} as int)"))
    out = np.zeros((256, per // 8), np.uint8)
    for row in chunks.groupBy("chunk").applyInPandas(fill, "chunk int, bits binary").collect():
        out[row["chunk"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return np.unpackbits(out.reshape(-1)).astype(bool)


def _occurrences(piece, found, hashes, widths, bits):
    """(token, word number) of the piece's shingles inside rows that are in the bitmap."""
    tokens, places = [], []
    row_end = np.repeat(found.first[1:], found.counts())
    for width in widths:
        runs = run_hashes(hashes, width)
        at = np.flatnonzero(bits[(runs >> _U(40)).astype(np.int64)])
        at = at[at + width <= row_end[at]]
        tokens.append(runs[at])
        places.append(at)
    return np.concatenate(tokens), np.concatenate(places)


def shingle_counts(docs: DataFrame, text: str, widths: list[int], bits) -> DataFrame:
    """Rows (token, times): occurrences in all documents of the shingles in the bitmap."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            seen = []
            for piece in pieces(batch.column(0)):
                found = words(piece, ALNUM)
                seen.append(_occurrences(piece, found, word_hashes(piece, found, True), widths, inside)[0])
            if seen:
                tokens, times = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(times)], ["token", "times"])

    rows = docs.select(text).mapInArrow(count, "token long, times long")
    return rows.groupBy("token").agg(F.sum("times").alias("times"))


PLACES = "doc long, mark long, n_words long, places array<struct<token: long, at: int, before: int, around: string>>"


def places(docs: DataFrame, widths: list[int], window: int, bits) -> DataFrame:
    """One row per document: its words, and every place of a key shingle with the words around it."""
    kind = pa.struct([("token", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("around", pa.string())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            n_words, offsets = [], [0]
            token, at, before, around = [], [], [], []
            for piece in pieces(batch.column(2)):
                found = words(piece, ALNUM)
                tokens, where = _occurrences(piece, found, word_hashes(piece, found, True), widths, inside)
                order = np.argsort(where, kind="stable")
                tokens, where = tokens[order], where[order]
                n_words.append(found.counts())
                ends = np.searchsorted(where, found.first[1:])
                offsets.extend((ends + offsets[-1]).tolist())
                row = np.searchsorted(found.first, where, "right") - 1
                for t, w, a, b in zip(tokens.view(np.int64).tolist(), where.tolist(), found.first[row].tolist(), found.first[row + 1].tolist(), strict=True):
                    low, high = max(a, w - window + 1), min(b, w + window)
                    token.append(t)
                    at.append(w - a)
                    before.append(w - low)
                    around.append(" ".join(_texts(piece, found, low, high)))
            hits = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((token, at, before, around), kind, strict=True)], fields=list(kind))
            counts = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), hits)],
                ["doc", "mark", "n_words", "places"],
            )

    return docs.mapInArrow(find, PLACES)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 13, one_in: int = 20) -> DataFrame:
    """Per document row: id, mark (hash of the text), n_words, n_hit, items (sorted texts of item
    ids), contaminated (some word hit, and one in `one_in` words or more)."""
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark, "decontamination")
    rows = bare(docs, key, text).select(id_of(key).alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    windows = work.keep(item_windows(bare(items, item_key, item_text), item_key, item_text, window), "windows")
    distinct = windows.groupBy("words", "size").agg(F.first("tokens").alias("tokens"))
    tokens = distinct.select("words", "size", F.posexplode("tokens").alias("offset", "token"))
    widths = sorted({min(GRAM, r["size"]) for r in windows.select("size").distinct().collect()}) or [GRAM]

    def shared(bits: np.ndarray):
        return spark.sparkContext.broadcast(np.packbits(bits))

    counts = shingle_counts(rows, "text", widths, shared(bitmap(tokens)))
    rarest = tokens.join(counts, "token", "left").groupBy("words", "size").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "token", "offset")).alias("key"))
    keyed = work.keep(rarest.where("key.times > 0").select("words", "size", "key.token", "key.offset"), "keyed")

    found = work.keep(places(rows, widths, window, shared(bitmap(keyed))), "places")
    near = found.select("doc", "mark", F.explode("places").alias("p")).select("doc", "mark", "p.*")
    fits = F.expr("before >= offset and size(split(around, ' ')) - before >= size - offset")
    same = F.expr("array_join(slice(split(around, ' '), before - offset + 1, size), ' ') = words")
    exact = work.keep(near.join(keyed, "token").where(fits).where(same).select("doc", "mark", F.expr("at - offset").alias("start"), "size", "words").distinct(), "exact")

    own = W.partitionBy("doc", "mark").orderBy("start", "size")
    end = F.col("start") + F.col("size")
    covered = F.max(end).over(own.rowsBetween(W.unboundedPreceding, -1))
    spans = exact.select("doc", "mark", "start", "size").distinct()
    hit = spans.select("doc", "mark", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(covered, F.lit(0)))).alias("new"))
    hits = hit.groupBy("doc", "mark").agg(F.sum("new").cast("long").alias("n_hit"))
    named = exact.select("doc", "mark", "words").distinct().join(windows.select("words", "item").distinct(), "words")
    items_of = named.groupBy("doc", "mark").agg(F.array_sort(F.collect_set("item")).alias("items"))
    judged = hits.join(items_of, ["doc", "mark"])
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return found.select("doc", "mark", "n_words").join(judged, ["doc", "mark"], "left").select(
        id_back("doc").alias(key), "mark", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = contamination(docs, items, key, text, **how).where("contaminated").select(F.col(key).alias("_bad"), "mark").distinct()
    same = docs[f"`{key}`"].cast("long").eqNullSafe(bad["_bad"]) & (F.xxhash64(docs[f"`{text}`"]) == bad["mark"])
    return docs.join(bad, same, "left_anti")
