"""Token ids of whole documents in files of range-coded blocks.

A file set is a folder of Parquet parts; each row holds (part, block, data), and `data` is a
self-contained block: a directory of its documents (ids and lengths) and their token ids coded
by `range_coder`, each with a checksum.  Blocks hold whole documents and about BLOCK_IDS ids.
Spark's own writer commits the parts, so retried tasks leave no double blocks and the files
can lie in any store that Spark reaches.

Encoding is exact but spares repeated work: no merge crosses white space, so each
white-space-free word is encoded once per worker by the tokenizers library and looked up from
then on.  Texts with "<|" (special tokens) go to the library whole.

Defined results: a null text is empty and gives the end id alone; repeated rows are written
as they come; an empty table gives an empty file set; documents are written in ascending
order of the given columns (ties in any order); a null id is stored as the smallest long and
read back as null; other columns are not stored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideledger.llm import range_coder
from tideledger.llm.shared import Workspace, id_back, id_of, small_batches
from tideledger.llm.words import ALNUM, LOWER, SOLID, pieces

BLOCK_IDS = 1 << 19
END_ID = 1
MEMO_WORDS = 2_000_000
_TAIL = np.isin(np.arange(256), list(b".,!?;:%*&#$"))
_ASCII = (ALNUM & (np.arange(256) < 0x80))[LOWER]
_HEAD = struct.Struct("<4sIII")
_MAGIC = b"TIDB"
#: Byte-level vocabularies write a printable byte as itself and the n-th other one as U+0100 + n.
_OTHER_BYTES = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTE_CHARACTERS = {b: 256 + n for n, b in enumerate(_OTHER_BYTES)}
_encoders: dict[str, WordEncoder] = {}


def _marks_apart(piece) -> tuple[np.ndarray, np.ndarray]:
    """The piece in lower case, with a space before marks that stand between an ASCII letter or
    digit and white space: such marks are tokens of their own.  Fewer distinct words are left."""
    data = LOWER[piece.data]
    mark = _TAIL[data]
    begin = np.flatnonzero(mark[1:] & _ASCII[data[:-1]]) + 1
    if not len(begin):
        return data, piece.bounds
    plain = np.append(np.flatnonzero(~mark), len(data))
    after = plain[np.searchsorted(plain, begin)]
    begin = begin[(after == len(data)) | ~SOLID[data[np.minimum(after, len(data) - 1)]]]
    return np.insert(data, begin, 32), piece.bounds + np.searchsorted(begin, piece.bounds)


def _letters(word: str) -> str | None:
    """What the model gets for a word of Latin letters: lower case, a character per UTF-8 byte.

    Letters below U+0250 are composed already, so normalising leaves them alone.  None for any
    other word, and where lower case brings a mark that is no letter.
    """
    if not word.isalpha() or max(word) >= "\u0250":
        return None
    if word.isascii():
        return word.lower()
    low = word.lower()
    return low.encode().decode("latin-1").translate(_BYTE_CHARACTERS) if low.isalpha() else None


class WordEncoder:
    """The library's ids of texts, by a memo of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.clear()

    def clear(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.begin = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)

    def _encode_new(self, new: list[bytes]) -> None:
        """Takes words up into the memo; those of Latin letters alone are one piece, as `_letters` gives it."""
        model, memo = self.tokenizer.model, self.memo
        ids: list[int] = []
        lengths: list[int] = []
        words: list[bytes] = []
        others: list[tuple[bytes, str]] = []
        for word in new:
            text = word.decode("utf-8", "replace")
            letters = _letters(text)
            if letters is None:
                others.append((word, text))
                continue
            own = model.tokenize(letters)
            ids += [x.id for x in own]
            lengths.append(len(own))
            words.append(word)
        for own in self.tokenizer.encode_batch_fast([text for _, text in others], add_special_tokens=False):
            own = own.ids
            ids += own
            lengths.append(len(own))
        words += [word for word, _ in others]
        memo.update(zip(words, range(len(memo), len(memo) + len(new)), strict=True))
        size = np.array(lengths, np.int64)
        self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(size) - size))
        self.length = np.concatenate((self.length, size))
        self.ids = np.concatenate((self.ids, np.array(ids, np.int32)))

    def encode(self, piece) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a piece, one after another, and their number per row."""
        counts = np.zeros(piece.rows, np.int64)
        special: dict[int, np.ndarray] = {}
        flow: list[bytes] = []
        data, bounds = _marks_apart(piece)
        raw = data.tobytes()
        for r, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
            if raw.find(b"<|", a, b) >= 0:
                special[r] = self.whole(piece.row(r).decode("utf-8", "replace"))
            else:
                before = len(flow)
                flow += raw[a:b].split()
                counts[r] = len(flow) - before
        if len(self.memo) > MEMO_WORDS:
            self.clear()
        at = np.fromiter(map(self.memo.get, flow, repeat(-1)), np.int64, len(flow))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [flow[i] for i in missing.tolist()]
            self._encode_new(list(dict.fromkeys(new)))
            at[missing] = [self.memo[w] for w in new]
        lengths = self.length[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.begin[at] - (ends - lengths), lengths) + np.arange(total)].astype(np.int64)
        word_end = np.cumsum(counts)
        sizes = np.diff(np.concatenate(([0], np.concatenate(([0], ends))[word_end])))
        if special:
            split = np.split(ids, np.cumsum(sizes)[:-1])
            for r, own in special.items():
                split[r] = own
                sizes[r] = len(own)
            ids = np.concatenate(split)
        return ids, sizes


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pack(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    directory = zlib.compress(np.diff(doc_ids, prepend=0).astype("<i8").tobytes() + sizes.astype("<u4").tobytes(), 1)
    return _HEAD.pack(_MAGIC, len(doc_ids), len(directory), zlib.crc32(directory)) + directory + range_coder.encode(ids, vocabulary)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their numbers of tokens, and all token ids of one block."""
    magic, docs, size, checksum = _HEAD.unpack_from(data)
    directory = data[_HEAD.size : _HEAD.size + size]
    if magic != _MAGIC or zlib.crc32(directory) != checksum:
        raise ValueError("damaged directory of a token block")
    raw = zlib.decompress(directory)
    return np.cumsum(np.frombuffer(raw, "<i8", docs)), np.frombuffer(raw, "<u4", docs, 8 * docs).astype(np.int64), range_coder.decode(data[_HEAD.size + size :])


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", order: tuple[str, ...] | None = None, end_id: int = END_ID) -> None:
    """Encodes all texts and writes them in ascending `order` (the key, if none is given)."""
    small_batches(docs.sparkSession)
    order = order or (key,)
    rows = docs.select(id_of(key).alias("_key"), F.col(f"`{text}`").alias("_text"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    by = [f"_o{i}" for i in range(len(order))]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("_key", "_text")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        words = encoder(tokenizer)
        number = 0
        docs_held, sizes_held, ids_held, held = [], [], [], 0

        def close():
            nonlocal number, docs_held, sizes_held, ids_held, held
            data = pack(np.array(docs_held, np.int64), np.array(sizes_held, np.int64), np.concatenate(ids_held), words.vocabulary)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()), "data": pa.array([data], pa.binary())})
            number += 1
            docs_held, sizes_held, ids_held, held = [], [], [], 0
            return row

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for piece in pieces(batch.column(1)):
                ids, sizes = words.encode(piece)
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id)
                ends += np.arange(1, piece.rows + 1)
                at = start = 0
                while at < piece.rows:
                    upto = int(np.searchsorted(ends, start + BLOCK_IDS - held, "right"))
                    upto = min(piece.rows, max(upto, at + (held == 0)))
                    if upto > at:
                        docs_held += keys[piece.first + at : piece.first + upto].tolist()
                        sizes_held += (sizes[at:upto] + 1).tolist()
                        ids_held.append(ids[start : ends[upto - 1]])
                        held += len(ids_held[-1])
                        at, start = upto, int(ends[upto - 1])
                    if at < piece.rows:
                        yield close()
        if held:
            yield close()

    rows.mapInArrow(code, "part int, block int, data binary").write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, in no order: part, block, its number there, id, tokens before it in the
    block, n_tokens, ids (array<int>)."""
    return _read(spark, path, True)


def _read(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    stored = spark.read.schema("part int, block int, data binary").parquet(path)

    def open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                keys, sizes, ids = unpack(data.as_py())
                n, ends = len(keys), np.cumsum(sizes)
                raw = ids.astype("<u4")
                checks = [zlib.crc32(raw[e - s : e].tobytes()) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = {
                    "part": pa.array(np.full(n, part, np.int32)), "block": pa.array(np.full(n, block, np.int32)), "number": pa.array(np.arange(n, dtype=np.int32)), "doc": pa.array(keys),
                    "before": pa.array(ends - sizes), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(checks, pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    kind = "part int, block int, number int, doc long, before long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return stored.mapInArrow(open_blocks, kind).withColumn("doc", id_back("doc"))


def directory(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per document: id, start (ids of all documents before it), n_tokens, ids_crc32.

    Starts are sums over blocks inside their part and over parts; the latter have a row each.
    """
    docs = Workspace(spark, "directory").keep(_read(spark, path, False), "documents")
    blocks = docs.groupBy("part", "block").agg(F.sum("n_tokens").alias("size"))
    inside = F.sum("size").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.withColumn("in_part", F.coalesce(inside, F.lit(0))).drop("size")
    parts = docs.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    ahead = F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("ahead", F.coalesce(ahead, F.lit(0))).drop("size")
    start = F.col("ahead") + F.col("in_part") + F.col("before")
    return docs.join(blocks.join(parts, "part"), ["part", "block"]).select(F.col("doc").alias(key), start.alias("start"), "n_tokens", "ids_crc32")
