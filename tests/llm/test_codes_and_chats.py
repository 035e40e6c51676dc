"""SentencePiece codes, conversation repair and vector codes, against the library or brute force."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import samples

from tideledger.llm import conversations, queries, sentence_pieces, vector_codes


def sha(data):
    return hashlib.sha256(data).hexdigest()


# --- SentencePiece


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.model(queries.piece_model())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


def odd_texts(pieces, n=4000):
    r = random.Random(5)
    names = sorted(pieces.score)
    letters = ["abcdefgh ", "aeinrst ", "  =-_*/<>()\n\t▁", "日本語漢字😀é ", "".join(chr(r.randrange(32, 0x2600)) for _ in range(300))]
    for k in range(n):
        if k % 2:
            yield "".join(r.choice(names) for _ in range(r.randrange(1, 12)))
        else:
            yield "".join(r.choice(r.choice(letters)) for _ in range(r.randrange(1, 40)))
    yield from ("", " ", " " * 77, "a" * 3000, "ab " * 500, "<s> </s><unk>", "\x00", "=" * 99 + "-" * 99)


def test_pieces_equal_the_library(pieces, library):
    for text in odd_texts(pieces):
        want = library.encode(text, add_bos=True, add_eos=True)
        ids = np.frombuffer(pieces.encode([text])[0], "<u4")
        assert ids.tolist() == want, text
        assert pieces.decode(ids) == library.decode(want), text


def test_backtracking_equals_plain_merging(pieces):
    r = random.Random(8)
    for _ in range(2000):
        text = "".join(r.choice(" aeinrstou") for _ in range(r.randrange(1, 30)))
        assert pieces.pieces(text) == pieces.merge(text)


def test_decoding_any_ids(pieces, library):
    r = random.Random(6)
    for _ in range(2000):
        ids = [r.choice([r.randrange(32000), r.randrange(300), r.randrange(100, 260)]) for _ in range(r.randrange(12))]
        assert pieces.decode(np.array(ids, np.uint32)) == library.decode(ids), ids


def test_long_text_in_turns(pieces, library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "PIECE_CHARS", 7)
    text = "one  two threefourfive\n  six ééé 漢字 " * 9
    assert np.frombuffer(pieces.encode([text])[0], "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_other_models_are_refused(tmp_path):
    for message in (b"", b"\x12\x02\x18\x01", b"\x12\x05\x18\x02\x98\x02\x01"):
        path = tmp_path / "m.model"
        path.write_bytes(message)
        with pytest.raises(ValueError):
            sentence_pieces.PieceModel(str(path))


def test_piece_operator(spark, frame, edge, library):
    told = sentence_pieces.decode(sentence_pieces.encode(edge, queries.piece_model()), queries.piece_model())
    got = Counter((r["doc_id"], bytes(r["ids"]), r["text"]) for r in told.collect())
    want = Counter()
    for doc, text, *_ in samples.edge_rows():
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want[doc, np.array(ids, "<u4").tobytes(), library.decode(ids)] += 1
    assert got == want
    assert sentence_pieces.encode(frame([]), queries.piece_model()).count() == 0


def test_piece_query(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_sentence_pieces"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode()))


# --- conversations


def broken(rows):
    """Damaged rows by conversation, from (conv, turn, role, text)."""
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        out[conv]
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out[conv] += [(turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return {c: sorted(own, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, own in out.items()}


def mended(own):
    """The contract's columns of one conversation's rows, by trying all edits."""
    faults, seen = [], set()
    for _, role, text in own:
        solid = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.cache
    def best(i, state, inserts):
        """Least (cost, audit) of the rows from i on, and the lines it gives."""
        found = [(0, "", ())] if i == len(own) and state in ("", "a") else []
        follow = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[follow]
        if inserts < 3:
            cost, audit, lines = best(i, follow, inserts + 1)
            found.append((cost + 3, "I" + audit, (f"{name}:", *lines)))
        if i < len(own):
            _, role, text = own[i]
            cost, audit, lines = best(i + 1, state, 0)
            found.append((cost + 4, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] else 0
                cost, audit, lines = best(i + 1, follow, 0)
                found.append((cost + 3 + extra, "R" + audit, (f"{name}:{text}", *lines)))
                after = step.get((state, role[:1]))
                if after:
                    cost, audit, lines = best(i + 1, after, 0)
                    found.append((cost + extra, "K" + audit, (f"{role}:{text}", *lines)))
        return min(found, default=(math.inf, "", ()))

    for i in range(len(own), -1, -1):  # from the end, so that the recursion stays flat
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in own if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        sha("\n".join(lines).encode()),
    )


CHAT = "conv_id long, turn long, role string, text string, part long, audit string"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def chats(n=60, seed=2, most=14):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "Usher", "s", "u", "", None]
    texts = ["yes.", "no", "what?", " \t", "", None, "a.b", "ends! \n", "ün. ", "x\u0085"]
    out = []
    for conv in range(n):
        for turn in range(r.randrange(0, most)):
            out.append((r.choice([conv, conv, conv, conv, None]) if conv == 7 else conv, r.choice([turn, turn, turn, None, turn + 5, 3]), r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"{turn} words {'.!?'[turn % 3]}", 1, "x"))
    return out


def equal_chats(told, rows):
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in told.collect()}
    want = {c: mended(own) for c, own in broken(rows).items()}
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], (c, broken(rows)[c])


def test_repairs_equal_brute_force(spark, frame):
    rows = chats()
    equal_chats(conversations.audit(frame(rows, CHAT).repartition(5)), rows)
    assert conversations.audit(frame([], CHAT)).count() == 0


def test_large_conversation_in_many_segments(spark, frame, monkeypatch):
    monkeypatch.setattr(conversations, "PLACE_BITS", 3)
    r = random.Random(4)
    rows = [(1, t, r.choice(["user", "assistant"]), r.choice(["fine.", "cut", f"{t}.", f"{t}"]), 1, "") for t in range(400)]
    rows += [(2, t, "user" if t % 2 == 0 else "assistant", f"{t}.", 1, "") for t in range(30)] + [(3, 8, "user", "same.", 1, "")] * 90
    equal_chats(conversations.audit(frame(rows, CHAT).repartition(4)), rows)


def test_repaired_rows_are_the_output(spark, frame):
    rows = chats(20, seed=9)
    done = conversations.repair(conversations.damage(frame(rows, CHAT)))
    told = defaultdict(list)
    for r in done.rows.collect():
        told[r["conv"]].append(r)
    for conv, own in broken(rows).items():
        if own and conv is not None:
            want = mended(own)
            assert "".join(r["edit"] for r in told[conv]) == want[6]
            assert sha("\n".join(f"{r['role']}:{r['text']}" for r in told[conv] if r["edit"] != "D").encode()) == want[7]


def test_checkpoints_do_not_change_the_walk():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 50, 257):
        run = r.integers(0, 12, n)
        vector = conversations.LAST
        for kind in run[::-1]:
            vector = conversations.applied(conversations.MATRICES[kind], vector)
        assert (conversations.applied(conversations.product(run), conversations.LAST) == vector).all()
        for (audit, state), entry in zip(conversations.walk(run, conversations.LAST, [0, 1, 2, 3]), range(4), strict=True):
            prices = {"D": 4, "I": 3, "K": 0, "R": 3}
            rows = iter(run.tolist())
            cost = 0
            for letter in audit + conversations.closing(state):
                kind = next(rows) if letter != "I" else 0
                cost += prices[letter] + (3 if letter in "KR" and kind % 3 == 1 else 0)
            assert cost == vector[entry]


def test_conversation_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    equal_chats(queries.QUERIES["op12_conversation_repair"](spark, sf), rows)


# --- vector codes


def coded(rows, width, parts=16, entries=64, rounds=2):
    """Codes by plain integer loops: {row: (id, code, error, label_error)} and the codebooks' hash."""
    kept = [(i, [math.floor(256 * x) for x in v] + [0] * (width - len(v)), label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = width // parts
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[v[p * size : (p + 1) * size] for _, v, _ in order[:entries]] for p in range(parts)]

    def far(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def pick(v):
        return [min(range(len(b)), key=lambda e: (far(v[p * size : (p + 1) * size], b[e]), e)) for p, b in enumerate(books)]  # noqa: B023

    for _ in range(rounds):
        held = defaultdict(list)
        for _, v, _ in kept:
            for p, e in enumerate(pick(v)):
                held[p, e].append(v[p * size : (p + 1) * size])
        for (p, e), own in held.items():
            books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, labels = [], defaultdict(int)
    for i, v, label in kept:
        code = pick(v)
        error = sum(far(v[p * size : (p + 1) * size], books[p][e]) for p, e in enumerate(code))
        labels[label] += error
        out.append((i, "".join(f"{e:02x}" for e in code), error, label))
    text = ",".join(str(x) for b in books for entry in b for x in entry)
    return Counter((i, c, e, labels[label], sha(text.encode())) for i, c, e, label in out)


VECTORS = "vec_id long, embedding array<double>, label int, codes string, part long"


def vectors(n, width, seed=1, scale=1.0):
    r = random.Random(seed)
    return [(i * 3 % n, [r.choice([r.gauss(0, scale), 0.25, -0.5]) for _ in range(width)], r.choice([1, 1, 2, None])) for i in range(n)]


@pytest.mark.parametrize(("n", "width", "scale"), [(150, 32, 1.0), (90, 16, 3e5), (40, 48, 1.0), (66, 16, 1e7)])
def test_codes_equal_plain_integers(spark, frame, n, width, scale):
    rows = vectors(n, width, scale=scale)
    if scale == 1.0:
        rows += [(n, None, 1), (n + 1, [math.nan] + [0.0] * (width - 1), 1), (None, [0.5] * width, None), (n + 2, [math.inf] * width, 2), (5, rows[0][1], 9), (5, rows[0][1], 9), (n + 3, [None] * width, 1)]
    told = vector_codes.coded(frame([(*r, "x", 1) for r in rows], VECTORS).repartition(4)).collect()
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in told) == coded(rows, width)


def test_uneven_and_empty_vectors(spark, frame):
    rows = vectors(70, 20, seed=4) + [(100, [1.0], 1), (101, [], 2)]
    told = vector_codes.coded(frame([(*r, "x", 1) for r in rows], VECTORS)).collect()
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in told) == coded(rows, 32)
    assert vector_codes.coded(frame([], VECTORS)).count() == 0
    assert [r["error"] for r in vector_codes.coded(frame([(1, [], 1, "", 1)], VECTORS)).collect()] == [0]


def test_limb_products_are_exact():
    r = np.random.default_rng(2)
    for most in (10, 1 << 20, 1 << 26, 1 << 28):
        a, b = r.integers(-most, most, (30, 5)), r.integers(-most, most, (20, 5))
        a[0], b[0], a[1] = most, -most, -1
        assert (vector_codes.dots(a, b).astype(object) == a.astype(object) @ b.T.astype(object)).all()
        for bits in (3, 24):
            assert (sum(x.astype(np.int64) << (bits * k) for k, x in enumerate(vector_codes.limbs(a, bits))) == a).all()


def test_decoded_vectors(spark, frame):
    rows = vectors(50, 32)
    told, books = vector_codes.compress(frame([(*r, "x", 1) for r in rows], VECTORS))
    errors = {r["vec_id"]: r["error"] for r in told.collect()}
    own = {i: np.floor(256 * np.array(v)) for i, v, _ in rows}
    for r in vector_codes.decoded(told, books).collect():
        assert ((own[r["vec_id"]] - 256 * np.array(r["vector"])) ** 2).sum() == errors[r["vec_id"]]
