"""Numpy kernels against plain Python: no Spark."""

import random

import numpy as np
import pyarrow as pa
import pytest
import samples
from hypothesis import given, settings
from hypothesis import strategies as st

from tideledger.llm import forest, jaccard_join, language, merkle, range_coder, substrings, token_file, toxicity
from tideledger.llm import words as w


def all_words(texts, inside, most):
    out = []
    for piece in w.pieces(pa.array(texts, pa.string()), most):
        found = w.words(piece, inside)
        for r in range(piece.rows):
            out.append([piece.data[found.starts[i] : found.ends[i]].tobytes().decode() for i in range(found.first[r], found.first[r + 1])])
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8), st.integers(1, 60))
def test_words_are_those_of_the_pattern(texts, most):
    assert all_words(texts, w.SOLID, most) == [samples.solid(t) for t in texts]
    assert [[samples.lower(x) for x in row] for row in all_words(texts, w.ALNUM, most)] == [samples.alnum(t) for t in texts]


def test_shingle_hashes_do_not_depend_on_place():
    texts = ["a b c d e", "x a b c d", "A B c D", "a b", "b a", "", None, "a  b\tc d"]
    piece = next(w.pieces(pa.array(texts)))
    hashes, bounds = w.shingle_sets(piece, w.SOLID, 4)
    own = [hashes[bounds[r] : bounds[r + 1]].tolist() for r in range(len(texts))]
    assert own[0][0] == own[1][1] == own[2][0] == own[7][0]
    assert len(own[3]) == len(own[4]) == 1 and own[3] != own[4]
    assert own[5] == own[6] == []


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 300, 5000, 40000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 900, n), np.minimum(rng.geometric(0.05, n), 899), np.zeros(n, int), np.tile([5, 6, 7], n)[:n]):
        assert (range_coder.decode(range_coder.encode(ids.astype(np.int64), 900)) == ids).all()


def test_range_coder_learns_and_detects_damage():
    ids = np.tile(np.arange(50), 400).astype(np.int64)
    block = range_coder.encode(ids, 50000)
    assert len(block) * 8 / len(ids) < 3
    for place in (5, len(block) // 2, len(block) - 1):
        broken = bytearray(block)
        broken[place] ^= 4
        with pytest.raises(ValueError, match="damaged"):
            range_coder.decode(bytes(broken))
    with pytest.raises(ValueError, match="outside"):
        range_coder.encode(np.array([50000]), 50000)


def test_divide_skip_counts_occurrences():
    rng = random.Random(1)
    for _ in range(200):
        lists = [np.array(sorted(rng.sample(range(60), rng.randint(1, 50)))) for _ in range(rng.randint(1, 25))]
        need = rng.randint(1, len(lists))
        times = {x: sum(x in o.tolist() for o in lists) for x in range(60)}
        assert dict(jaccard_join.divide_skip(lists, need)) == {x: t for x, t in times.items() if t >= need}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), min_size=1, max_size=4), st.integers(4, 12))
def test_equal_windows_have_equal_keys(rows, window):
    hashes = w.mix(np.array([x for r in rows for x in r], np.uint64) + np.uint64(77))
    first = np.cumsum([0] + [len(r) for r in rows])
    begin, keys = substrings.window_keys(hashes, first, window)
    flat = [x for r in rows for x in r]
    seen = {}
    for b, k in zip(begin.tolist(), keys.tolist(), strict=True):
        assert seen.setdefault(tuple(flat[b : b + window]), k) == k
    assert len(begin) == sum(max(0, len(r) - window + 1) for r in rows)


def test_recompression_names_runs_and_pairs_alike_everywhere():
    rng = random.Random(5)
    text = [rng.randrange(50) for _ in range(200)]
    hashes = w.mix(np.array(text + [1, 2, 3] + text, np.uint64))
    sym, low, high = substrings.recompress(hashes, np.array([0, len(hashes)]))
    assert len(sym) < len(hashes) / 1.8
    place = {(int(s), int(a) - 203) for s, a in zip(sym, low, strict=True) if a >= 203}
    inner = [(int(s), int(a)) for s, a, b in zip(sym, low, high, strict=True) if a > 0 and b < 200]
    assert inner and all(x in place for x in inner)


def test_forest_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.5)).astype(float)
    model = forest.fit(x[:2000], y[:2000], trees=40)
    assert ((model.margins(x[2000:]) > 0) == y[2000:]).mean() > 0.97
    single = [model.margins(x[i : i + 1])[0] for i in range(20)]
    assert np.allclose(single, model.margins(x[:20]))
    assert np.isfinite(forest.fit(x[:0], y[:0]).margins(x[:3])).all()
    xs, ys = forest.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()


def test_language_model_needs_rows():
    assert language.learn(np.zeros((0, language.BUCKETS), np.float32), []) is None
    one = language.learn(np.full((6, language.BUCKETS), 1e-4, np.float32), ["en"] * 6)
    assert one.languages == ["en"]
    best, score = one.decide(np.zeros((2, one.weights.shape[1])))
    assert best.tolist() == [0, 0] and ((score >= 0) & (score <= 1)).all()


def test_normalised_text_shows_hidden_words():
    texts = ["l0ser", "l.o.s.e.r", "looooser", "lo$er!", "loser", "a loser."]
    got = next(w.pieces(pa.array(texts)))
    read = toxicity.normalised(got)
    assert all("loser" in read.row(r).decode() for r in range(len(texts)))
    rows = ["x" * k for k in (0, 1)] + ["5", "a5", ""]
    assert toxicity.normalised(next(w.pieces(pa.array(rows)))).rows == len(rows)


def test_merkle_fingerprint_of_a_long_line_is_read_back():
    (tree,) = merkle.trees(pa.array([" ".join(f"w{i % 9973}v{i % 31}" for i in range(600_000))]))
    read = merkle.parse(tree.text())
    assert len(tree.segments) > 65_536 and read.paragraphs == tree.paragraphs and read.sections == tree.sections
    assert np.array_equal(read.segments, tree.segments) and read.text() == tree.text()


def test_merkle_finds_the_edit():
    text = "\n".join(" ".join(f"w{i}v{j}" for j in range(60)) for i in range(30))
    edited = text.replace("w12v30", "changed")
    a, b = merkle.trees(pa.array([text, edited]))
    assert a.root != b.root and 0.9 < merkle.likeness(a, b) < 1
    assert merkle.likeness(merkle.parse(a.text()), merkle.parse(b.text())) == merkle.likeness(a, b)
    (start, end), *rest = merkle.changes(a, b)
    assert not rest and "changed" in edited[start:end] and end - start < 400
    empty, blank, same = merkle.trees(pa.array([None, " ", text]))
    assert merkle.likeness(a, same) == 1 and merkle.likeness(a, empty) == 0 and empty.root != blank.root


def test_words_of_latin_letters_are_encoded_as_the_library_does():
    from tideledger.llm.queries import word_tokenizer

    words, rng = token_file.WordEncoder(word_tokenizer()), random.Random(3)
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    texts = [f"{a} x{a}y {a}{a}" for a in letters] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    texts += ["".join(rng.choice("abAé'sñß.,!07-́İΣя ") for _ in range(12)) for _ in range(2000)]
    for piece in w.pieces(pa.array(texts)):
        ids, sizes = words.encode(piece)
        for own, text in zip(np.split(ids, np.cumsum(sizes)[:-1]), texts[piece.first :], strict=False):
            assert own.tolist() == words.whole(text).tolist(), text


def test_merkle_cuts_lines_without_blanks():
    rng = np.random.default_rng(5)
    text = "".join(chr(0x4E00 + i) for i in rng.integers(0, 3000, 16_000))
    other = "".join(chr(0x4E00 + i) for i in rng.integers(0, 3000, 16_000))
    edited, inserted = text[:8000] + other[:8000], text[:5000] + other[:3] + text[5000:]
    a, b, c, d = merkle.trees(pa.array([text, edited, inserted, other]))
    assert 0.45 < merkle.likeness(a, b) < 0.55 and merkle.likeness(a, c) > 0.98 and merkle.likeness(a, d) < 0.02
    assert 500 < len(a.segments) < 2000 and int(a.spans.sum()) == len(text.encode())
    ((start, end),) = merkle.changes(a, c)
    assert start <= len(text[:5000].encode()) < end


def test_merkle_runs_of_one_letter_are_cut():
    run, longer, pair = merkle.trees(pa.array(["a" * 10_000, "a" * 9_000 + "b" * 1_000, "ab" * 5_000]))
    assert 10_000 // merkle.LONG_WORD <= len(run.segments) <= 10_000 // merkle.LONG_WORD + 2
    assert 0.8 < merkle.likeness(run, longer) < 1 and len(pair.segments) <= 5_001


def test_merkle_roots_of_texts_with_equal_polynomial_hashes():
    first, second = "a", "b"
    for _ in range(11):
        first, second = first + second, second + first
    a, b = merkle.trees(pa.array([first, second]))
    assert len(first) == 2048 and a.root != b.root  # the same segments in another order, so their likeness is 1


def test_merkle_trees_do_not_depend_on_neighbours():
    texts = ["", "short one", "x" * 500, "ein Wort", "\u6f22\u5b57" * 300 + " end\nnext", None, "tail"]
    alone = [next(merkle.trees(pa.array([t], pa.large_string()))).text() for t in texts]
    assert alone == [t.text() for t in merkle.trees(pa.array(texts, pa.large_string()))]
