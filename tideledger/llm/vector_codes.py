"""Vector code compression: product quantisation in exact integer arithmetic.

Each component x becomes floor(SCALE * x).  Vectors are cut into PARTS equal consecutive parts, and
each part position has a codebook of ENTRIES entries, which starts as that part of the vectors
with the smallest ids.  A round assigns every part to its nearest entry and moves each entry to
the floor of its parts' mean; after the rounds the parts are assigned once more.

Distances are exact.  |a - b|^2 = |a|^2 - 2 a.b + |b|^2, and the products a.b come from float64
BLAS: integers are split into limbs so small that no sum of limb products reaches 2^53, one
matrix product per pair of limbs, and the products are put together in int64.  The first least
distance wins.  Vectors too long for int64 (components of about 2^29 and more) are computed
with Python's integers; an error beyond a long raises OverflowError.

A round is one pass over the vectors: every task adds up its parts per entry, Spark adds the
tasks' sums, and the driver holds the codebooks alone (PARTS * ENTRIES parts of a vector).

Defined results: rows with a null vector or a null or non-finite component are dropped; vectors
shorter than the longest, or with a length that PARTS does not divide, count as filled up with
zeros; fewer vectors than entries give fewer entries; rows with equal ids start in the order of
their vectors, null ids come last; repeated rows each count; null labels are one label; other
columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideledger.llm.shared import Workspace, bare

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
ROWS = 4096


def fits(most: float, width: int) -> bool:
    """Whether squared distances of vectors with components up to `most` stay in int64."""
    return 4 * most * most * max(1, width) < 1 << 60


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 limbs of int64 values, the lowest first: values = sum of limb k * 2^(bits * k).
    All but the highest lie in [0, 2^bits)."""
    out = []
    while int(np.abs(values).max(initial=0)) >> bits:
        out.append((values & ((1 << bits) - 1)).astype(np.float64))
        values = values >> bits
    return [*out, values.astype(np.float64)]


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All dot products of the rows of two int64 matrices, exactly, while they fit in int64."""
    width = max(1, a.shape[1])
    bits = (52 - (width - 1).bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    others = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(others):
            out += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest row of b for each row of a, and the squared distance."""
    if a.dtype == object or b.dtype == object:
        a, b = a.astype(object), b.astype(object)
        far = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    else:
        far = dots(a, b)
        far *= -2
        far += (b * b).sum(1)[None, :]
        at = far.argmin(1)
        return at, far[np.arange(len(a)), at] + (a * a).sum(1)
    at = np.array([min(range(len(b)), key=row.__getitem__) for row in far], np.int64)
    return at, far[np.arange(len(a)), at] if len(a) else np.zeros(0, object)


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as int64, or as Python's integers where they or distances may not fit."""
    scaled = np.floor(vectors * SCALE)  # a power of two: exact while the product is finite
    most = float(np.abs(scaled).max(initial=0))
    if fits(most, vectors.shape[1]):
        return scaled.astype(np.int64)
    own = [int(x * SCALE) if np.isfinite(x * SCALE) else int(x) * SCALE for x in vectors.ravel().tolist()]
    own = [v - 1 if v > x * SCALE else v for v, x in zip(own, vectors.ravel().tolist(), strict=True)]
    return np.array(own, object).reshape(vectors.shape)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch as rows of `width` components; missing ones are zero."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Codebooks:
    """Per part position the entries, one row each."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books

    @classmethod
    def start(cls, vectors: np.ndarray) -> Codebooks:
        return cls(np.split(whole(vectors), PARTS, axis=1))

    @property
    def width(self) -> int:
        return PARTS * self.books[0].shape[1]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(rows x parts) entries, the integer parts, and the summed squared distances."""
        parts = np.split(whole(vectors), PARTS, axis=1)
        found = [nearest(a, b) for a, b in zip(parts, self.books, strict=True)]
        error = sum(far.astype(object) if far.dtype == object else far for _, far in found)
        return np.stack([at for at, _ in found], 1), parts, error

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """Entries at the floor of the mean of their parts; those without parts stay."""
        books = []
        for p, book in enumerate(self.books):
            rows = book.tolist()
            for e in range(len(rows)):
                if (p, e) in sums:
                    n, total = sums[p, e]
                    rows[e] = [v // n for v in total]
            most = max((abs(v) for row in rows for v in row), default=0)
            books.append(np.array(rows, np.int64 if fits(most, self.width) else object).reshape(book.shape))
        return Codebooks(books)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for book in self.books for v in book.ravel().tolist()).encode()).hexdigest()


def kept(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Rows (id, vector, label) whose vectors are whole; the id stays null where it is."""
    own = bare(rows, key, vector, label).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    fit = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return own.where(F.col("vector").isNotNull() & fit)


def _sums(vectors: DataFrame, books) -> DataFrame:
    """Per (part, entry, position) the sum of its components, and the number of its parts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Codebooks = books.value
        entries, width = len(own.books[0]), own.width // PARTS
        total = np.zeros((PARTS, entries, width), object)
        count = np.zeros((PARTS, entries), np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                at, parts, _ = own.assign(matrix(batch.slice(begin, ROWS).column(0), own.width))
                for p in range(PARTS):
                    if parts[p].dtype == object:
                        np.add.at(total[p], at[:, p], parts[p])
                    else:  # few enough rows for int64
                        chosen = np.zeros((entries, width), np.int64)
                        order = np.argsort(at[:, p], kind="stable")
                        cut = np.flatnonzero(np.diff(at[order, p], prepend=-1))
                        chosen[at[order[cut], p]] = np.add.reduceat(parts[p][order], cut, axis=0)
                        total[p] += chosen
                    count[p] += np.bincount(at[:, p], minlength=entries)
        rows = [(p, e, int(count[p, e]), [str(v) for v in total[p, e]]) for p, e in np.argwhere(count).tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["part", "entry", "n", "total"])

    told = vectors.select("vector").mapInArrow(add, "part long, entry long, n long, total array<string>")
    place = told.select("part", "entry", "n", F.posexplode("total").alias("place", "v"))
    summed = place.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    return summed


def train(vectors: DataFrame, width: int) -> Codebooks | None:
    """The codebooks after ROUNDS rounds; None without vectors."""
    spark = vectors.sparkSession
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(ENTRIES).collect()
    if not first:
        return None
    books = Codebooks.start(matrix(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), width))
    for _ in range(ROUNDS if width else 0):
        shared = spark.sparkContext.broadcast(books)
        sums: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for r in _sums(vectors, shared).orderBy("place").collect():  # at most ENTRIES * width rows
            sums.setdefault((r["part"], r["entry"]), (r["n"], []))[1].append(int(r["v"]))
        books = books.moved(sums)
        shared.unpersist()
    return books


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """Rows (id, label, codes, error) of all kept vectors, with `codes` the entries in part order
    (one byte each), and the codebooks."""
    spark = rows.sparkSession
    vectors = kept(rows, key, vector, label)
    longest = vectors.agg(F.max(F.size("vector")).alias("n")).first()["n"] or 0
    books = train(vectors, -(-longest // PARTS) * PARTS)
    shared = spark.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Codebooks = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                at, _, error = own.assign(matrix(part.column("vector"), own.width))
                codes = [x.tobytes() for x in at.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(codes, pa.binary()), pa.array(error.tolist(), pa.int64())], ["id", "label", "codes", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    told = vectors.select("id", "label", "vector").mapInArrow(assign, f"id {kinds['id']}, label {kinds['label']}, codes binary, error long")
    return told.select(F.col("id").alias(key), F.col("label").alias(label), "codes", "error"), books


def coded(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per kept vector: id, code (two hex digits a part), error, label_error (the error summed over
    rows of its label), codebooks_sha256.  The sums per label are written before they meet the
    rows, so a label on a third of all rows can be split."""
    work = Workspace(rows.sparkSession, "vectors")
    told, books = compress(rows, key, vector, label)
    told = work.keep(told.select(F.col(key).alias("id"), F.col(label).alias("label"), "codes", "error"), "codes")
    sums = work.keep(told.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    same = told["label"].eqNullSafe(sums["label"])
    joined = told.join(sums, same).select(told["id"].alias(key), F.lower(F.hex("codes")).alias("code"), "error", "label_error")
    return joined.withColumn("codebooks_sha256", F.lit(books.digest() if books else hashlib.sha256().hexdigest()))


def decoded(codes: DataFrame, books: Codebooks, key: str = "vec_id") -> DataFrame:
    """The vectors that the codes of `compress` stand for (id, vector): entries divided by SCALE."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [np.concatenate([book[e] for book, e in zip(shared.value.books, code, strict=True)]).astype(float) / SCALE for code in batch["codes"]]
            yield pd.DataFrame({"id": batch["id"], "vector": told})

    kind = codes.schema[key].dataType.simpleString()
    return codes.select(F.col(key).alias("id"), "codes").mapInPandas(look, f"id {kind}, vector array<double>").withColumnRenamed("id", key)
