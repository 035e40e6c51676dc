"""SentencePiece encoding and decoding of whole texts, for merge-type (BPE) models.

The library merges the best-scored neighbours first, the leftmost among equals.  The same
pieces are found here without that queue: a row of pieces is the library's result exactly
when every two neighbours, merged anew from their characters, give these two pieces again
(the first merge that crossed a border in the whole text would cross it between the two as
well).  So the encoder walks from left to right: an Aho-Corasick automaton names the longest
piece at each position, a piece is taken if it stands next to the last one, else its next
shorter prefix is tried.  A position with no way on is marked in a bitfield and never entered
again, since the pieces before a position are the same on every way to it.

No piece spans two characters that are neighbours in no piece, so texts are cut there, and
what lies between cuts is encoded once per worker and remembered (a bounded memo).

Defined results: null and empty texts have the begin and end ids alone and decode to the empty
text; a space and U+2581 are the same, as in the library; characters without a piece become
UTF-8 byte pieces; repeated rows are encoded as they come; other columns are left alone; an
empty table gives an empty result.  Models with another type, normalising, user-defined or
unused pieces or without byte pieces raise ValueError when they are opened.
"""

from __future__ import annotations

import codecs
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideledger.llm.shared import id_back, id_of, small_batches

SPACE = "▁"
PIECE_CHARS = 1 << 20
MEMO_UNITS = 1_000_000
MEMO_PAIRS = 1_000_000
LONGEST_KEPT = 64
# Fixed values of the model format: kinds of pieces, and the merge type.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_MERGE_TYPE = 2
_models: dict[str, PieceModel] = {}

# Each undecodable byte gives one replacement character, as in the library.
codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        head = number()
        kind = head & 7
        if kind == 0:
            yield head >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield head >> 3, data[at : at + size]
        at += size


class _Memo(dict):
    """Units of text with the ids of their pieces as bytes; new units are encoded on demand."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        found = self.encode(unit)
        if len(unit) <= LONGEST_KEPT:
            self[unit] = found
        return found


class PieceModel:
    """A merge-type model with byte pieces and no normalising.  Spaces stand for U+2581."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            message = list(_fields(file.read()))
        trainer = dict(next((v for k, v in message if k == 2), {}) and _fields(next(v for k, v in message if k == 2)))
        normalizer = dict(_fields(next((v for k, v in message if k == 3), b"")))
        if trainer.get(3, 1) != _MERGE_TYPE or not trainer.get(35, 0):
            raise ValueError("not a merge-type model with byte pieces")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("models that normalise text or place spaces otherwise are not supported")
        entries = [dict(_fields(v)) for k, v in message if k == 1]
        kinds = [e.get(3, _NORMAL) for e in entries]
        if set(kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("models with user-defined or unused pieces are not supported")
        names = [e[1].decode().replace(SPACE, " ") for e in entries]
        self.begin_id, self.end_id = trainer.get(41, 1), trainer.get(42, 2)
        self.score = {name: struct.unpack("<f", e.get(2, b"\0\0\0\0"))[0] for name, e, kind in zip(names, entries, kinds, strict=True) if kind == _NORMAL}
        ids = {name: k for k, (name, kind) in enumerate(zip(names, kinds, strict=True)) if kind == _NORMAL}
        self.packed = {name: struct.pack("<I", k) for name, k in ids.items()}
        self.byte = [b""] * 256
        self.surface = [b""] * len(names)
        self.silent = np.zeros(len(names), bool)
        for k, (name, kind) in enumerate(zip(names, kinds, strict=True)):
            if kind == _BYTE:
                value = int(name[3:5], 16)
                self.byte[value] = struct.pack("<I", k)
                self.surface[k] = bytes([value])
            elif kind == _UNKNOWN:
                self.surface[k] = trainer.get(44, " ⁇ ".encode())
            elif kind == _CONTROL:
                self.silent[k] = True
            else:
                self.surface[k] = name.encode()
        self.spaced = np.array([kind == _NORMAL and name.startswith(" ") for name, kind in zip(names, kinds, strict=True)])
        self._index()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo = _Memo(self._ids)

    def _index(self) -> None:
        import ahocorasick

        # A piece that its own characters do not merge into never appears in a result.
        reached = {name for name in self.score if len(name) == 1 or self.merge(name) == [name]}
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[str, str] = {}
        for name in reached:
            self.automaton.add_word(name, name)
            for size in range(len(name) - 1, 0, -1):
                if size == 1 or name[:size] in reached:
                    self.shorter[name] = name[:size]
                    break
        if reached:
            self.automaton.make_automaton()
        # Characters of longer pieces get a class each, all others class 0, which has no neighbours.
        inner = sorted({c for name in self.score if len(name) > 1 for c in name})
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        side = len(inner) + 1
        self.side = side
        self.apart = np.ones(side * side, bool)
        for name in self.score:
            for a, b in zip(name, name[1:], strict=False):
                self.apart[self.classes[ord(a)] * side + self.classes[ord(b)]] = False

    def merge(self, text: str) -> list[str]:
        """The pieces by plain merging, best score first, leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                own = score.get(parts[i] + parts[i + 1])
                if own is not None and (best is None or own > best):
                    best, at = own, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces can stand side by side: merging them anew gives them again."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = left + right not in self.score and self.merge(left + right) == [left, right]
        return known

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text by backtracking; linear memory, one bit per position for failures."""
        n = len(text)
        longest = list(text)
        for last, name in self.automaton.iter(text):
            longest[last - len(name) + 1] = name  # longer ones end later
        failed = bytearray(n // 8 + 1)
        path: list[str] = []
        at, piece = 0, longest[0] if n else None
        while at < n:
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (not path or self.fits(path[-1], piece)):
                    break
                piece = self.shorter.get(piece)
            if piece is None:  # no way on from here
                failed[at >> 3] |= 1 << (at & 7)
                piece = path.pop()
                at -= len(piece)
            else:
                path.append(piece)
                at = end
                piece = longest[at] if at < n else None
        return path

    def _ids(self, text: str) -> bytes:
        known, byte = self.packed, self.byte
        return b"".join([known[p] if p in known else b"".join([byte[x] for x in p.encode()]) for p in self.pieces(text)])

    def units(self, text: str) -> tuple[list[str], np.ndarray]:
        """The text cut between characters that are neighbours in no piece, and the cuts."""
        code = self.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        cuts = np.concatenate(([0], np.flatnonzero(self.apart[code[:-1] * self.side + code[1:]]) + 1, [len(text)]))
        at = cuts.tolist()
        return [text[a:b] for a, b in zip(at, at[1:], strict=False)], cuts

    def encode(self, texts: list[str], ends: bool = True) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers, with begin and end ids."""
        head, tail = (struct.pack("<I", self.begin_id), struct.pack("<I", self.end_id)) if ends else (b"", b"")
        if len(self.memo) > MEMO_UNITS:
            self.memo.clear()
        known, out = self.memo.__getitem__, []
        for text in texts:
            if not text:
                out.append(head + tail)
                continue
            body = []
            text = " " + text.replace(SPACE, " ")
            for at in range(0, len(text), PIECE_CHARS):  # units of a very long text go in turns
                upto = self._safe(text, at + PIECE_CHARS)
                at = self._safe(text, at)
                if upto > at:
                    body.append(b"".join(map(known, self.units(text[at:upto])[0])))
            out.append(head + b"".join(body) + tail)
        return out

    def _safe(self, text: str, at: int) -> int:
        """The first cut at or after a position."""
        while 0 < at < len(text) and not self.apart[self.classes[ord(text[at - 1])] * self.side + self.classes[ord(text[at])]]:
            at += 1
        return min(at, len(text))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control pieces are silent, a space that begins the text goes."""
        told = ids[~self.silent[ids]]
        raw = b"".join(map(self.surface.__getitem__, told.tolist()))
        if len(told) and self.spaced[told[0]]:
            raw = raw[1:]
        return raw.decode("utf-8", "each_byte")


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: id, ids (little-endian unsigned 32-bit integers, begin and end ids
    included).  `path` names the model file on every machine."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.encode(texts), pa.binary())], ["doc", "ids"])

    rows = docs.select(id_of(key).alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc long, ids binary").select(id_back("doc").alias(key), "ids")


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids", text: str = "text") -> DataFrame:
    """Per row: id, ids, and the text that the ids stand for; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            told = [own.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told, pa.string())], ["doc", "ids", "text"])

    rows = tokens.select(id_of(key).alias("doc"), F.col(f"`{ids}`").alias("ids"))
    return rows.mapInArrow(run, "doc long, ids binary, text string").select(id_back("doc").alias(key), F.col("ids").alias(ids), F.col("text").alias(text))
