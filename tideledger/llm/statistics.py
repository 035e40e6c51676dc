"""Dense statistics of whole texts, a few numpy passes per piece."""

from __future__ import annotations

import numpy as np

from tideledger.llm.words import SOLID, run_hashes, word_hashes, words

_b = np.arange(256)
_CLASSES = {
    "letters": ((_b >= 65) & (_b < 91)) | ((_b >= 97) & (_b < 123)) | (_b >= 0xC3),
    "capitals": (_b >= 65) & (_b < 91),
    "digits": (_b >= 48) & (_b < 58),
    "blanks": (_b == 32) | ((_b >= 9) & (_b <= 13)),
    "lines": _b == 10,
    "not_ascii": _b >= 0x80,
    "symbols": np.isin(_b, list(b"#$%&*+<=>@^_`{|}~\\")),
    "bars": _b == ord("|"),
    "shouts": _b == ord("!"),
    "asks": _b == ord("?"),
    "stops": _b == ord("."),
    "commas": _b == ord(","),
    "brackets": np.isin(_b, list(b"()[]{}<>")),
    "quotes": np.isin(_b, list(b"\"'")),
}
_MATRIX = np.stack(list(_CLASSES.values()), 1).astype(np.float64)
NAMES = [
    "log_bytes", *_CLASSES, "log_words", "word_length", "word_spread", "longest_word", "line_words", "capital_words",
    "marked_words", "distinct_words", "top_word", "same_as_before", "distinct_triples", "distinct_lines", "short_words",
]


def _distinct(values: np.ndarray) -> tuple[float, float]:
    """Share of distinct values and share of the most frequent one."""
    if not len(values):
        return 1.0, 0.0
    own = np.sort(values)
    cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
    return (len(cut) - 1) / len(own), float(np.diff(cut).max()) / len(own)


def statistics(piece) -> np.ndarray:
    """One row of NAMES for each row of the piece; all finite, empty texts too."""
    data, bounds = piece.data, piece.bounds
    found = words(piece, SOLID)
    hashes = word_hashes(piece, found, True)
    triples = run_hashes(hashes, 3)
    lengths = (found.ends - found.starts).astype(np.float64)
    capital = np.zeros(256, bool)
    capital[65:91] = True
    letter = _CLASSES["letters"]
    symbol = ~(letter | _CLASSES["digits"]) & SOLID
    line_piece = words(piece, _b != 10)
    line_hashes = word_hashes(piece, line_piece, True)
    out = np.zeros((piece.rows, len(NAMES)))
    for r in range(piece.rows):
        a, b = int(bounds[r]), int(bounds[r + 1])
        size = b - a
        counts = np.bincount(data[a:b], minlength=256) @ _MATRIX
        i, j = int(found.first[r]), int(found.first[r + 1])
        k, m = int(line_piece.first[r]), int(line_piece.first[r + 1])
        n = j - i
        row = out[r]
        row[0] = np.log1p(size)
        row[1 : 1 + len(counts)] = counts / max(1, size)
        rest = row[1 + len(counts) :]
        if n:
            own, span = hashes[i:j], lengths[i:j]
            first, last = data[found.starts[i:j]], data[found.ends[i:j] - 1]
            share, top = _distinct(own)
            rest[:] = (
                np.log1p(n), span.mean(), span.std(), span.max(), n / max(1, m - k),
                (capital[first] & capital[data[np.minimum(found.starts[i:j] + 1, found.ends[i:j] - 1)]]).mean(), symbol[last].mean(),
                share, top, (own[1:] == own[:-1]).mean() if n > 1 else 0.0,
                _distinct(triples[i : j - 2])[0] if n > 2 else 1.0, _distinct(line_hashes[k:m])[0], (span <= 3).mean(),
            )
    return out


