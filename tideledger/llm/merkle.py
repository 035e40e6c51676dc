"""Document fingerprints: a Merkle tree over sections, paragraphs and short segments.

A text is cut at line breaks into paragraphs and inside them, after words chosen by their
hash (and at every eighth word of a run of one word), into segments of about eight words;
a word of more than 32 code points (scripts without blanks, encoded data) is also cut inside,
before code points chosen by the two before them, and every 32 where none is chosen for long.
Paragraphs form sections that end after a paragraph chosen by its digest.  Cuts depend on
nearby text only, so an edit changes the nodes on its own branch.  A leaf is the BLAKE2b
digest (16 bytes) of its segment, an inner node that of the digests below it, the root that of
the sections and the length.

The fingerprint holds all levels: root '.' sections '.' paragraphs '.' segments, in hex;
an inner node is the first 16 digits of its digest and 8 of the number of nodes below it, a
segment the first 8 digits.
Equal roots mean equal texts, as the root is built from whole digests; `likeness` descends
only where digests differ, and gives the share of segments that both trees hold.  `changes`
names the byte spans of differing branches.

Defined results: null counts as the empty text, which has a root and no nodes; blank texts
are one segment; rows of one id are ordered by a hash of their texts, equal rows in any
order; a null id comes first; a single row is its own next one; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideledger.llm.shared import bare, id_back, id_of, small_batches
from tideledger.llm.words import SOLID, Words, mix, pieces, word_hashes, words

SEGMENT_MASK = 7
SECTION_MASK = 7
RUN_STEP = 8
LONG_WORD = 32  # code points
LEAF, NODE = 16, 8  # bytes of a digest, and those of it that the fingerprint holds
POINT_MASK = 15
PART_BYTES = 128 << 20  # of text in a range of ids
_U = np.uint64


def _digest(data: bytes, size: int) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


@dataclass
class Tree:
    root: str
    sections: list[tuple[bytes, int]]  # digest, number of paragraphs
    paragraphs: list[tuple[bytes, int]]  # digest, number of segments
    segments: np.ndarray  # 32 bits each
    spans: np.ndarray  # bytes of each segment

    def text(self) -> str:
        nodes = ["".join(f"{d.hex()}{n:08x}" for d, n in level) for level in (self.sections, self.paragraphs)]
        return ".".join((self.root, *nodes, self.segments.astype(">u4").tobytes().hex()))

    def under(self) -> list[tuple[bytes, np.ndarray]]:
        out, at = [], 0
        for digest, n in self.paragraphs:
            out.append((digest, self.segments[at : at + n]))
            at += n
        return out


def _run_cuts(hashes: np.ndarray, found: Words) -> np.ndarray:
    """Repeats of one word: a cut after a run, and inside it at every RUN_STEP-th word."""
    n = len(hashes)
    fresh = np.ones(n, bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    fresh[found.first[:-1][found.counts() > 0]] = True
    at = np.arange(n)
    place = at - np.maximum.accumulate(np.where(fresh, at, 0)) if n else at
    cut = (place > 0) & (place % RUN_STEP == 0)
    cut[1:] |= fresh[1:] & (place[:-1] > 0)
    return cut


def _inner_cuts(data: np.ndarray, found: Words) -> np.ndarray:
    """Byte places inside long words where a segment starts.

    A code point is chosen by a hash of the two before it, unless the one before was chosen by
    the same hash (a run of one letter); a stretch of more than four times LONG_WORD code
    points without a chosen one is cut at every LONG_WORD-th.
    """
    if not (found.ends - found.starts > LONG_WORD).any():
        return np.zeros(0, np.int64)
    points = np.flatnonzero((data & 0xC0) != 0x80)
    first, last = np.searchsorted(points, found.starts), np.searchsorted(points, found.ends)
    long = last - first > LONG_WORD
    first, last = first[long], last[long]
    if not len(first):
        return np.zeros(0, np.int64)
    sizes = last - first
    own = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(sizes.sum()) - own  # of each code point in its word
    at = points[np.repeat(first, sizes) + place]
    value = np.zeros(len(at), _U)
    after = np.append(points, len(data))[np.repeat(first, sizes) + place + 1]
    for k in range(4):
        byte = at + k
        value = (value << _U(8)) | np.where(byte < after, data[np.minimum(byte, len(data) - 1)], 0).astype(_U)
    pair = np.zeros(len(at), _U)
    pair[2:] = mix(value[:-2] * _U(0x1_0000_0001) + mix(value[1:-1]))
    chosen = (place >= 2) & ((pair & _U(POINT_MASK)) == 0)
    again = np.zeros(len(at), bool)
    again[1:] = chosen[1:] & (pair[1:] == pair[:-1]) & (place[1:] >= 3)
    chosen &= ~again
    starts = chosen | (place == 0)
    stretch = np.cumsum(starts) - 1
    heads = np.flatnonzero(starts)
    inside = np.arange(len(at)) - heads[stretch]
    length = np.diff(np.append(heads, len(at)))[stretch]
    chosen |= (length > 4 * LONG_WORD) & (inside > 0) & (inside % LONG_WORD == 0)
    return at[chosen]


def trees(texts: pa.Array) -> Iterator[Tree]:
    for piece in pieces(texts):
        found = words(piece, SOLID)
        hashes = word_hashes(piece, found, False)
        lines = np.zeros(len(piece.data) + 1, np.int64)
        np.cumsum(piece.data == 10, out=lines[1:])
        later = np.ones(len(hashes), bool)  # words that are not the first of their row
        later[found.first[:-1][found.counts() > 0]] = False
        later = np.flatnonzero(later)
        paragraph = lines[found.starts[later]] > lines[found.ends[later - 1]]
        cut = paragraph | ((hashes[later - 1] & _U(SEGMENT_MASK)) == 0) | _run_cuts(hashes, found)[later]
        rows = piece.bounds[:-1][np.diff(piece.bounds) > 0]
        inner = _inner_cuts(piece.data, found)
        starts = np.concatenate((rows, found.starts[later[cut]], inner))
        heads = np.concatenate((np.ones(len(rows), bool), paragraph[cut], np.zeros(len(inner), bool)))
        order = np.argsort(starts, kind="stable")
        starts, heads = starts[order], heads[order]
        ends = np.append(starts[1:], len(piece.data)) if len(starts) else starts
        raw = piece.data.tobytes()
        leaves = b"".join([_digest(raw[i:j], LEAF) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)])
        short = np.frombuffer(leaves, ">u4")[:: LEAF // 4].astype(np.uint32)
        first = np.searchsorted(starts, piece.bounds)
        for r in range(piece.rows):
            a, b = int(first[r]), int(first[r + 1])
            at = [*(np.flatnonzero(heads[a:b]) + a).tolist(), b]
            whole = [_digest(leaves[LEAF * i : LEAF * j], LEAF) for i, j in zip(at, at[1:], strict=False)]
            paragraphs = [(d[:NODE], j - i) for d, i, j in zip(whole, at, at[1:], strict=False)]
            sections, held, above = [], [], []
            for k, digest in enumerate(whole):
                held.append(digest)
                if digest[7] & SECTION_MASK == 0 or k == len(whole) - 1:
                    above.append(_digest(b"".join(held), LEAF))
                    sections.append((above[-1][:NODE], len(held)))
                    held = []
            size = int(piece.bounds[r + 1] - piece.bounds[r])
            root = _digest(b"".join(above) + size.to_bytes(8, "little"), LEAF).hex()
            yield Tree(root, sections, paragraphs, short[a:b], (ends - starts)[a:b])


def parse(fingerprint: str) -> Tree:
    """The tree of a fingerprint (without spans)."""
    root, sections, paragraphs, segments = fingerprint.split(".")
    levels = []
    for level in (sections, paragraphs):
        levels.append([(bytes.fromhex(level[i : i + 16]), int(level[i + 16 : i + 24], 16)) for i in range(0, len(level), 24)])
    return Tree(root, *levels, np.frombuffer(bytes.fromhex(segments), ">u4").astype(np.uint32), np.zeros(0, np.int64))


def _common(a: list, b: list) -> Counter:
    return Counter(d for d, _ in a) & Counter(d for d, _ in b)


def _left(nodes: list, shared: Counter) -> tuple[list, int]:
    """Nodes that are not matched, and the segments of those that are."""
    shared, left, matched = Counter(shared), [], 0
    for digest, segments in nodes:
        if shared[digest] > 0:
            shared[digest] -= 1
            matched += len(segments)
        else:
            left.append((digest, segments))
    return left, matched


def likeness(a: Tree, b: Tree) -> float:
    """Twice the shared segments by all segments, 1 for equal roots; section by section,
    then paragraph by paragraph, then by segments, going down only where nodes differ."""
    if a.root == b.root:
        return 1.0
    total = len(a.segments) + len(b.segments)
    if not len(a.segments) or not len(b.segments):
        return 0.0
    own = []
    shared = _common(a.sections, b.sections)
    for tree in (a, b):
        below, at, left, spare = tree.under(), 0, [], Counter(shared)
        for digest, n in tree.sections:
            if spare[digest] > 0:
                spare[digest] -= 1
            else:
                left += below[at : at + n]
            at += n
        own.append(left)
    matched = len(a.segments) - sum(len(s) for _, s in own[0])
    shared = _common(*own)
    (left_a, more), (left_b, _) = _left(own[0], shared), _left(own[1], shared)
    matched += more
    if left_a and left_b:
        x, y = (np.unique(np.concatenate([s for _, s in side]), return_counts=True) for side in (left_a, left_b))
        _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
        matched += int(np.minimum(x[1][i], y[1][j]).sum())
    return min(1.0, 2 * matched / total)


def changes(old: Tree, new: Tree) -> list[tuple[int, int]]:
    """Byte spans of `new` whose segments `old` does not hold, neighbours joined."""
    have, at, out = Counter(old.segments.tolist()), 0, []
    for segment, size in zip(new.segments.tolist(), new.spans.tolist(), strict=True):
        if have[segment] > 0:
            have[segment] -= 1
        elif out and out[-1][1] == at:
            out[-1] = (out[-1][0], at + size)
        else:
            out.append((at, at + size))
        at += size
    return out


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (part, late, doc, home, text), sorted inside their part, where each home row is
    followed by its successor: the next document, or for the last one the first.

    Parts are ranges of ids with about PART_BYTES of text; the first document of a range also goes to the range before.
    The driver sees one id per range.
    """
    spark = docs.sparkSession
    own = docs.select(id_of(key).alias("doc"), F.col(text).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)
    cuts = own.agg(F.percentile_approx("doc", [i / parts for i in range(parts)], 100 * parts).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(np.array(cuts, np.int64), ids.to_numpy(zero_copy_only=False), "right").astype(np.int32))

    ranged = own.withColumn("part", range_of("doc"))
    starts = {r["part"]: r["doc"] for r in ranged.groupBy("part").agg(F.min("doc").alias("doc")).collect()}
    used = sorted(starts)
    before = {starts[p]: used[i - 1] for i, p in enumerate(used)}  # the first range is before none: it wraps to the last
    least = starts[used[0]] if used else 0
    ids = sorted(before)

    @F.arrow_udf("int")
    def also_to(docs: pa.Array) -> pa.Array:
        return pa.array([before[d] if (i := bisect_right(ids, d)) and ids[i - 1] == d else None for d in docs.to_pylist()], pa.int32())

    home = ranged.select("part", F.lit(0).alias("late"), "doc", F.lit(True).alias("home"), "text")
    away = own.withColumn("part", also_to("doc")).where("part is not null")
    away = away.select("part", (F.col("doc") == least).cast("int").alias("late"), "doc", F.lit(False).alias("home"), "text")
    return home.unionByName(away).repartition(max(1, len(used)), "part").sortWithinPartitions("part", "late", "doc", F.xxhash64("text"))


RESULT = "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_chars, the text's fingerprint, that of its edited text (last half replaced
    by the start of the next document), and its likeness to that and to the next document."""
    small_batches(docs.sparkSession)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose successor is still to come: part, doc, home, text
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "doc", "home", "text")]
            rows = [held] * (held is not None) + [(p, d, h, t or "") for p, d, h, t in zip(*columns, strict=True)]
            if not rows:
                continue
            held = rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and a[2]]
            edited, texts, sizes = [], [r[3] for r in rows], []
            for a, b in pairs:
                n = len(a[3])
                edited.append(a[3][: n - n // 2] + b[3][: n // 2])
                sizes.append(n)
            own = iter(trees(pa.array(texts, pa.large_string())))
            changed = trees(pa.array(edited, pa.large_string()))
            out: list[list] = [[] for _ in range(7)]
            last, k = next(own), 0
            for a, b in zip(rows, rows[1:], strict=False):
                following = next(own)
                if a[0] == b[0] and a[2]:
                    other = next(changed)
                    values = (a[1], sizes[k], hashlib.sha256(edited[k].encode()).hexdigest(), last.text(), other.text(), likeness(last, other), likeness(last, following))
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                    k += 1
                last = following
            if k:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], [f.split()[0] for f in RESULT.split(", ")])

    found = with_next(bare(docs, key, text), key, text).mapInArrow(walk, RESULT)
    return found.withColumn("doc", id_back("doc")).withColumnRenamed("doc", key)
