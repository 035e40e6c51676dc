"""Conversation structure: faults of chat rows and their cheapest repair.

Roles must read `(s?(ua)+)?` by their initials.  Edits are Keep (0), Rerole to user or assistant
(3), Delete (4, the only edit of a blank or duplicate row) and Insert of an empty user or
assistant row (3); a truncated row that stays costs 3 more.  Of the cheapest edit sequences the
ASCII-least one is taken.

The least cost from a row and a grammar state to the end is a backward recurrence over four
states, and a row is a 4 x 4 matrix of it in (min, +) arithmetic.  Vectors of it are stored only
at checkpoints, about the square root of the rows apart; between two checkpoints they are
computed again while the walk forward emits the least tight edit.

A conversation may be most of the table, so nothing here holds one.  Rows are ordered by a range
partitioning and written; what one part holds of a conversation is a segment.  Segments give
their matrices, a conversation's matrices give the vector at each segment's end (checkpoints
across segments), each segment walks from its four entry states, and the chain of
states picks one of the four walks.  A row is a duplicate unless it is the first of its (role,
text), found by a partial aggregation, so a very common row meets no hot join key.  Only the
hash of a repaired conversation reads its rows in turn: SHA-256 is a chain by definition, so one
task streams them, in batches, without holding them.

Defined results: null conversation ids are one conversation; a null role or text is one space,
a null turn is one space in the damage key and comes first; rows of one turn are taken by role,
then text; repeated rows are adjacent and each counts; a role without characters or with another
initial than s, u and a cannot be kept; a conversation without rows gives zeros, an empty audit
and the hash of nothing; other columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideledger.llm.shared import Workspace, id_back, id_of, small_batches

PLACE_BITS = 16
START, SYSTEM, ASKED, ANSWERED = range(4)
FAR = 1 << 40
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
BLANK, DUPLICATE, TRUNCATED = 1, 2, 4
#: The state after one more row of a role, -1 where the grammar forbids it.
STEP = {"s": (SYSTEM, -1, -1, -1), "u": (ASKED, ASKED, -1, ASKED), "a": (-1, -1, ANSWERED, -1)}
#: The state after a row of the one role that may follow (rerolled or inserted).
NEXT = (ASKED, ASKED, ANSWERED, ASKED)
INITIALS = "sua"
LEGAL = ("su", "ua", "au")


def _settle(cost: list[int]) -> list[int]:
    """Costs when rows may be inserted first.  Two in a row reach all states worth reaching."""
    for _ in range(3):
        cost = [min(own, INSERT + cost[NEXT[s]]) for s, own in enumerate(cost)]
    return cost


def _edits(kind: int, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, state after) of the edits of one row, in ASCII order."""
    initial, fixed = divmod(kind, 3)
    out = [("D", DELETE, state)]
    if fixed < 2:
        extra = CUT * fixed
        after = STEP[INITIALS[initial]][state] if initial < 3 else -1
        if after >= 0:
            out.append(("K", extra, after))
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


def _matrices() -> np.ndarray:
    """Per kind of row the costs from a state before it (inserts included) to the state after it."""
    out = np.full((12, 4, 4), FAR, np.int64)
    for kind in range(12):
        for after in range(4):
            cost = [min([c for _, c, to in _edits(kind, s) if to == after], default=FAR) for s in range(4)]
            out[kind, :, after] = np.minimum(_settle(cost), FAR)
    return out


MATRICES = _matrices()
#: What is left to pay after the last row: the grammar ends at the start or after an answer.
LAST = np.array(_settle([0, FAR, FAR, 0]), np.int64)
#: Edits (initial, cost, state after) of each (kind, state); the second table has inserts, too.
EDITS = [[_edits(kind, s) for s in range(4)] for kind in range(12)]
CHOICES = [[sorted([*own, ("I", INSERT, NEXT[s])]) for s, own in enumerate(states)] for states in EDITS]


def kinds(initials: list[str], faults: np.ndarray) -> np.ndarray:
    """Number of a row's kind: three times its role, plus 1 if truncated, 2 if it must go."""
    role = np.array([INITIALS.find(x) if x else 3 for x in initials], np.int64)
    role[role < 0] = 3
    return 3 * role + np.where(faults & (BLANK | DUPLICATE) > 0, 2, np.where(faults == TRUNCATED, 1, 0))


def product(run: np.ndarray) -> np.ndarray:
    """The matrix of consecutive rows, by pairwise (min, +) products."""
    m = MATRICES[run]
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        left, right = m[0 : len(m) - len(odd) : 2], m[1 : len(m) - len(odd) : 2]
        m = np.concatenate((np.minimum((left[:, :, :, None] + right[:, None, :, :]).min(2), FAR), odd))
    return m[0]


def applied(matrix: np.ndarray, end: np.ndarray) -> np.ndarray:
    return np.minimum((matrix + end).min(1), FAR)


def walk(run: np.ndarray, end: np.ndarray, states: list[int]) -> list[tuple[str, int]]:
    """(audit, last state) from each of the given states, for rows whose end costs `end`.

    Vectors are kept at the begin of each block of about the square root of the rows; those
    inside a block are computed again when the walk enters it.
    """
    n = len(run)
    size = max(1, int(n**0.5))
    begins = list(range(0, n, size))
    checkpoints = [end]
    for begin in reversed(begins):
        checkpoints.append(applied(product(run[begin : begin + size]), checkpoints[-1]))
    checkpoints.reverse()
    paths: dict[int, tuple[int, list[str]]] = {s: (s, []) for s in states}
    for k, begin in enumerate(begins):
        own = run[begin : begin + size].tolist()
        costs = [checkpoints[k + 1].tolist()]
        for kind in reversed(own):
            after = costs[-1]
            costs.append(_settle([min([price + after[to] for _, price, to in EDITS[kind][s]]) for s in range(4)]))
        costs.reverse()
        for entry, (state, told) in paths.items():
            for i, kind in enumerate(own):
                here, after = costs[i], costs[i + 1]
                letter = "I"
                while letter == "I":  # inserts before the row, then its own edit
                    letter, state = next((x, to) for x, price, to in CHOICES[kind][state] if here[state] == price + (here if x == "I" else after)[to])
                    told.append(letter)
            paths[entry] = (state, told)
    return [("".join(paths[s][1]), paths[s][0]) for s in states]


def closing(state: int) -> str:
    """The inserts after the last row."""
    return "I" * (int(LAST[state]) // INSERT)


# --- damage ------------------------------------------------------------------------------


def crc_of(conv: str, turn: str) -> Column:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return F.crc32(F.concat(part(conv), F.lit(":"), part(turn)).cast("binary"))


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", by: int = 20) -> DataFrame:
    """Rows (conv, turn, role, text) with seeded faults, chosen by crc32 of `conv:turn` modulo `by`:
    0 drops the row, 1 empties the text, 2 takes its end marks, 3 repeats it, 4 makes it the user's."""
    own = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    lot = crc_of("conv", "turn") % F.lit(by)
    filled = own.select("conv", "turn", lot.alias("lot"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).where("lot <> 0")
    changed = F.when(F.col("lot") == 1, F.lit("")).when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("lot") == 3, 2).otherwise(1)
    told = filled.select(
        id_of("conv").alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")
    )
    return told.drop("copy")


# --- segments ----------------------------------------------------------------------------


def _runs(*columns: list) -> Iterator[tuple[int, int]]:
    """Bounds of runs of equal keys."""
    keys = list(zip(*columns, strict=True))
    begin = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[begin]:
            yield begin, i
            begin = i


def numbered(rows: DataFrame, work: Workspace) -> DataFrame:
    """The rows in order, written: part and place ascend along a conversation, and a part has at
    most 2 ** PLACE_BITS rows, so that a turn repeated without end is many segments, too."""
    order = ("conv", F.col("turn").asc_nulls_first(), "role", "text")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id())
    part, place = F.shiftright("number", PLACE_BITS), F.col("number").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    solid = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    marks = (solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut")
    return work.keep(ordered.select("conv", part.alias("part"), place.alias("place"), "turn", "role", "text", *marks), "rows")


def light(rows: DataFrame) -> DataFrame:
    """Per row what the repair needs of it, without the text."""
    # The length keeps role "a" with text "bc" apart from role "ab" with text "c".
    name = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    firsts = rows.select("conv", "part", "place", F.unhex(name).alias("name")).groupBy("conv", "name").agg(F.min(F.struct("part", "place")).alias("first"))
    firsts = firsts.select("conv", "first.part", "first.place", F.lit(True).alias("fresh"))
    bare = rows.select("conv", "part", "place", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "cut")
    fault = F.when(F.col("blank"), BLANK).when(F.col("fresh").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(0)
    return bare.join(firsts, ["conv", "part", "place"], "left").select("conv", "part", "place", "turn", "initial", fault.cast("int").alias("fault"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_SEGMENT = pa.schema(
    [(c, pa.int64()) for c in ("conv", "part", "place", *_COUNTS)]
    + [("head", pa.string()), ("tail", pa.string())]
    + [(c, pa.int64()) for c in ("least", "most", "turns")]
    + [("matrix", pa.list_(pa.int64())), ("kinds", pa.binary())]
)
_SEGMENT_DDL = "conv long, part long, place long, blank long, duplicate long, truncated long, illegal long, head string, tail string, least long, most long, turns long, matrix array<long>, kinds binary"


class _Segment:
    """What is known of a segment after some of its rows; a row costs one byte."""

    def __init__(self, conv: int, part: int, place: int):
        self.kinds: list[np.ndarray] = []
        self.told = {"conv": conv, "part": part, "place": place, **dict.fromkeys(_COUNTS, 0), "head": None, "tail": None, "least": None, "most": None, "turns": 0}

    def add(self, turns: list, initials: list[str], faults: np.ndarray) -> None:
        told = self.told
        self.kinds.append(kinds(initials, faults).astype(np.uint8))
        for name, code in zip(_COUNTS, (BLANK, DUPLICATE, TRUNCATED), strict=False):
            told[name] += int((faults == code).sum())
        for turn, initial in zip(turns, initials, strict=True):
            if told["head"] is None:
                told["head"] = initial
            elif told["tail"] + initial not in LEGAL:
                told["illegal"] += 1
            told["tail"] = initial
            if turn is not None and turn != told["most"]:
                told["turns"] += 1
                told["most"] = turn
                told["least"] = turn if told["least"] is None else told["least"]

    def close(self) -> dict:
        run = np.concatenate(self.kinds)
        return {**self.told, "matrix": product(run).ravel().tolist(), "kinds": run.tobytes()}


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, key = None, None
    for batch in batches:
        conv, part, place, turn, initial = (batch.column(c).to_pylist() for c in ("conv", "part", "place", "turn", "initial"))
        fault = batch.column("fault").to_numpy()
        out = []
        for a, b in _runs(conv, part):
            if key != (conv[a], part[a]):
                if now is not None:
                    out.append(now.close())
                key = conv[a], part[a]
                now = _Segment(*key, place[a])
            now.add(turn[a:b], initial[a:b], fault[a:b])
        if out:
            yield pa.RecordBatch.from_pylist(out, _SEGMENT)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.close()], _SEGMENT)


def segments(rows: DataFrame) -> DataFrame:
    """Per (conversation, part) its counts, its matrix and the kinds of its rows."""
    parts = rows.repartition("conv", "part").sortWithinPartitions("conv", "part", "place")
    return parts.select("conv", "part", "place", "turn", "initial", "fault").mapInArrow(_segments, _SEGMENT_DDL)


# --- along a conversation ----------------------------------------------------------------


def _along(segments: DataFrame, *columns: str, backwards: bool = False) -> DataFrame:
    """Segments of a conversation one after another.  There are as many as its rows fill parts,
    and none of the columns holds a row's text."""
    part = F.col("part").desc() if backwards else F.col("part")
    return segments.select("conv", "part", *columns).repartition("conv").sortWithinPartitions("conv", part)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment, last one first: the costs at its end, and the cost of the start at its begin."""
    conv, vector, some = None, LAST, False
    for batch in batches:
        out = []
        for own, part, matrix in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            last = not some or own != conv
            if last:
                conv, vector, some = own, LAST, True
            ending = vector.tolist()
            vector = applied(np.array(matrix, np.int64).reshape(4, 4), vector)
            out.append({"conv": own, "part": part, "ending": ending, "last": last, "cost": int(vector[START])})
        if out:
            yield pa.RecordBatch.from_pylist(out, _ENDS)


_ENDS = pa.schema([("conv", pa.int64()), ("part", pa.int64()), ("ending", pa.list_(pa.int64())), ("last", pa.bool_()), ("cost", pa.int64())])
_ENDS_DDL = "conv long, part long, ending array<long>, last boolean, cost long"


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment the walks from its four entry states (one, if it is a conversation's first)."""
    for batch in batches:
        audits, exits = [], []
        for run, ending, last, lead in zip(*[batch.column(c).to_pylist() for c in ("kinds", "ending", "last", "lead")], strict=True):
            found = walk(np.frombuffer(run, np.uint8), np.array(ending, np.int64), [START] if lead else list(range(4)))
            audits.append([told + (closing(state) if last else "") for told, state in found])
            exits.append([state for _, state in found])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), pa.array(audits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int64()))], ["conv", "part", "audits", "exits"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment, in order, the state in which its conversation enters it."""
    conv, state, some = None, START, False
    for batch in batches:
        entry = []
        for own, exits in zip(batch.column("conv").to_pylist(), batch.column("exits").to_pylist(), strict=True):
            if not some or own != conv:
                conv, state, some = own, START, True
            entry.append(state)
            state = exits[state]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), pa.array(entry, pa.int64())], ["conv", "part", "entry"])


def edits(found: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The edits of each segment (conv, part, place, audit), and the costs (conv, part, cost)."""
    ends = work.keep(_along(found, "matrix", backwards=True).mapInArrow(_ends, _ENDS_DDL), "ends")
    leads = found.groupBy("conv").agg(F.min("part").alias("first"))
    told = found.select("conv", "part", "kinds").join(ends, ["conv", "part"]).join(leads, "conv")
    told = told.select("conv", "part", "kinds", "ending", "last", (F.col("part") == F.col("first")).alias("lead"))
    walked = work.keep(told.mapInArrow(_walks, "conv long, part long, audits array<string>, exits array<long>"), "walks")
    entries = _along(walked, "exits").mapInArrow(_entries, "conv long, part long, entry long")
    chosen = walked.select("conv", "part", "audits").join(entries, ["conv", "part"]).join(found.select("conv", "part", "place"), ["conv", "part"])
    return chosen.select("conv", "part", "place", F.get("audits", F.col("entry").cast("int")).alias("audit")), ends.select("conv", "part", "cost")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation the sums over its segments in order, with what happens at their borders."""
    now: dict | None = None

    def closed() -> dict:
        gaps = 0 if now["most"] is None else now["most"] - now["least"] + 1 - now["turns"]
        return {"gaps": gaps, **{c: now[c] for c in ("conv", *_COUNTS, "cost")}}

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if now is None or row["conv"] != now["conv"]:
                if now is not None:
                    out.append(closed())
                now = row
                continue
            for c in _COUNTS:
                now[c] += row[c]
            now["illegal"] += now["tail"] + row["head"] not in LEGAL
            now["tail"] = row["tail"]
            if row["turns"]:
                now["turns"] += row["turns"] - (now["most"] == row["least"])
                now["least"] = row["least"] if now["least"] is None else now["least"]
                now["most"] = row["most"]
        if out:
            yield pa.RecordBatch.from_pylist(out, _TOTALS)
    if now is not None:
        yield pa.RecordBatch.from_pylist([closed()], _TOTALS)


_TOTALS = pa.schema([(c, pa.int64()) for c in ("conv", "gaps", *_COUNTS, "cost")])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, with the edits on the first row of each segment: one row per edit."""
    conv, audit, state, nth, some = None, "", START, 0, False
    follow = {ASKED: "user", ANSWERED: "assistant"}
    out: list[tuple] = []

    def inserted() -> None:
        nonlocal state, nth
        while nth < len(audit) and audit[nth] == "I":
            state = NEXT[state]
            nth += 1
            out.append((conv, "I", follow[state], ""))

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.string()) for c in columns[1:]]], ["conv", "edit", "role", "text"])

    for batch in batches:
        for own, role, text, told in zip(*[batch.column(c).to_pylist() for c in ("conv", "role", "text", "audit")], strict=True):
            if told is not None:  # a segment begins; the one before may end with inserts
                inserted()
                audit, nth = told, 0
                if not some or own != conv:
                    conv, state, some = own, START, True
            inserted()
            edit = audit[nth]
            nth += 1
            if edit == "D":
                role = text = None
            else:
                state = STEP[role[0]][state] if edit == "K" else NEXT[state]
                role = role if edit == "K" else follow[state]
            out.append((own, edit, role, text))
        if out:
            yield flushed()
    inserted()
    if out:
        yield flushed()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation of repaired rows in order: its edits, and the hash of its lines."""
    conv, digest, audit, lines, some = None, hashlib.sha256(), [], 0, False
    for batch in batches:
        out = []
        for a, b in _runs(ids := batch.column("conv").to_pylist()):
            if not some or ids[a] != conv:
                if some:
                    out.append((conv, "".join(audit), digest.hexdigest()))
                conv, digest, audit, lines, some = ids[a], hashlib.sha256(), [], 0, True
            own = batch.slice(a, b - a)
            audit.append("".join(own.column("edit").to_pylist()))
            for role, text in zip(own.column("role").to_pylist(), own.column("text").to_pylist(), strict=True):
                if role is not None:
                    digest.update((b"\n" if lines else b"") + role.encode() + b":" + text.encode())
                    lines += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["conv", "audit", "repaired_sha256"])
    if some:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["conv", "audit", "repaired_sha256"])


@dataclass
class Repair:
    """`totals` has a row per conversation (conv, gaps, blank, duplicate, truncated, illegal, cost).
    `rows` has a row per edit (conv, edit, role, text) in the order of the repaired conversation,
    conversations in one piece; deleted rows have a null role and text."""

    totals: DataFrame
    rows: DataFrame

    def digests(self) -> DataFrame:
        return self.rows.mapInArrow(_digests, "conv long, audit string, repaired_sha256 string")


def repair(rows: DataFrame) -> Repair:
    """Repairs the conversations of rows (conv, turn, role, text), such as `damage` returns."""
    work = Workspace(rows.sparkSession, "conversations")
    small_batches(rows.sparkSession)
    placed = numbered(rows, work)
    found = work.keep(segments(light(placed)), "segments")
    chosen, costs = edits(found, work)
    summed = found.drop("place", "matrix", "kinds").join(costs, ["conv", "part"])
    totals = _along(summed, *_COUNTS, "head", "tail", "least", "most", "turns", "cost").mapInArrow(_totals, "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")
    flow = placed.select("conv", "part", "place", "role", "text").join(chosen, ["conv", "part", "place"], "left")
    flow = flow.repartition("conv").sortWithinPartitions("conv", "part", "place").select("conv", "role", "text", "audit")
    return Repair(totals, flow.mapInArrow(_repaired, "conv long, edit string, role string, text string"))


def audit(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damages and repairs the conversations: one row per conversation id of the input."""
    done = repair(damage(rows, conv, turn, role, text))
    every = rows.select(id_of(conv).alias("conv")).distinct()
    found = every.join(done.totals, "conv", "left").join(done.digests(), "conv", "left")
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *_COUNTS, "cost")]
    return found.select(id_back("conv").alias(conv), *counts, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in none.items()])
