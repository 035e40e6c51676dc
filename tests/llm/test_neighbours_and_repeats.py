"""Results that must not depend on neighbouring rows, repeated rows or column names."""

import random

import numpy as np
import pyarrow as pa
import pytest
from samples import row

from tideledger.llm import graph, jaccard_join, language, quality, toxicity
from tideledger.llm.shared import Workspace
from tideledger.llm.words import pieces


def histogram(texts, at):
    (piece,) = pieces(pa.array(texts))
    return language.histograms(piece)[at]


@pytest.mark.parametrize("text", ["the", "a", "É", "ÉÀ où", "漢字", "", "x y", "the end "])
def test_trigrams_do_not_see_neighbours(text):
    alone = histogram([text], 0)
    for before, after in (("zz", "qq"), ("Ã", "\x9e"), ("", "é"), ("漢", ""), ("a", "a")):
        assert (histogram([before, text, after], 1) == alone).all()
    assert alone.sum() == pytest.approx(1 if any(c.isalpha() for c in text) else 0)


def test_equal_texts_get_equal_languages(spark, frame):
    r = random.Random(1)
    words = {"en": ["the", "and", "of", "thing"], "fr": ["le", "une", "avec", "été"], "de": ["und", "für", "nicht", "schön"]}
    rows = [row(i, " ".join(r.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(list(words) * 40)]
    docs = frame(rows)
    model = language.train(docs, "doc_id", "text", "lang")
    short = [row(1000 + i, r.choice(["the", "une", "und", "le", "für"]) if i % 2 else rows[i % 100][1]) for i in range(300)]
    told = {}
    for parts in (1, 3, 7):
        for x in language.identify(frame(short).repartition(parts), model).collect():
            told.setdefault(x["text"], set()).add((x["_language"]["lang"], x["_language"]["score"]))
    assert all(len(found) == 1 for found in told.values())


def test_a_column_may_have_any_name(spark, frame):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["the", "of", "and"]) for _ in range(20)), "en", f"own {i}", f"mark {i}") for i in range(20)]
    docs = frame(rows, "doc_id long, text string, lang string, _language string, _mark_of_text string")
    model = language.train(docs, "doc_id", "text", "lang")
    assert {x["_language"] for x in language.identified(docs, model).collect()} == {f"own {i}" for i in range(20)}
    kept = jaccard_join.one_of_each(docs.union(docs))
    assert kept.columns == docs.columns
    assert all(x["_mark_of_text"] == f"mark {x['doc_id']}" for x in kept.collect())


def test_repeated_rows_are_one_set_in_a_block(spark, frame, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    near = [row(2, " ".join(words[:-1] + ["other"])), row(3, " ".join(words[:-1] + ["another"]))]
    rows = [row(1, " ".join(words))] * 600 + near
    most = []
    links = jaccard_join._links
    monkeypatch.setattr(jaccard_join, "_links", lambda members, *how: (most.append(members.groupBy("cell", "block", "chunk").count().agg({"count": "max"}).first()[0] or 0), links(members, *how))[1])
    found = jaccard_join.near_duplicates(frame(rows).repartition(4)).collect()
    assert len(found) == len(rows)
    assert {x["component_id"] for x in found} == {1}
    assert max(most) == 3


def test_forest_keeps_components(spark, frame, monkeypatch):
    monkeypatch.setattr(graph, "FOREST_NODES", 7)
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)]
    told = graph.components(frame(edges, "a long, b long").repartition(5), Workspace(spark, "forest")).collect()
    up = list(range(200))
    for _ in range(200):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    want = {x: up[x] for a, b in edges if a != b for x in (a, b)}
    assert {x["node"]: x["root"] for x in told} == want


@pytest.mark.parametrize(("score", "label"), [(quality.score, "quality"), (toxicity.score, "toxic")])
def test_repeated_ids_bound_the_sample(spark, frame, score, label, monkeypatch):
    """An id that fills a third of the table brings one row to the fit."""
    from tideledger.llm import forest

    seen = []
    fit = forest.fit
    monkeypatch.setattr(forest, "fit", lambda x, y, **how: (seen.append(len(x)), fit(x, y, **how))[1])
    rows = [row(i, f"some words of number {i} {'bad !!!' if i % 2 else 'good'}") for i in range(60)] + [row(7, f"copy {i}") for i in range(500)]
    labels = frame([(i, i % 2) for i in range(60)], f"doc_id long, {label} int")
    assert score(frame(rows), labels).count() == len(rows)
    assert max(seen) <= 60


def test_last_hash_picks_from_any_number_of_labels():
    for n in (10, 20_000, 10**9, 10**13):
        last = language.last_hash(n, quality.ROWS)
        picked = (last + (1 << 63) + 1) / (1 << 64) * n
        assert picked == pytest.approx(min(n, quality.ROWS), rel=0.01)
        assert np.iinfo(np.int64).min <= last <= np.iinfo(np.int64).max

