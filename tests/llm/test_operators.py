"""Dealt operators on awkward rows, against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import samples
from samples import row

from tideledger.llm import decontamination, jaccard_join, language, merkle, mixing, quality, substrings, token_file, toxicity, warc
from tideledger.llm.queries import word_tokenizer


def counted(rows):
    return Counter(tuple(r) for r in rows)


def empty(frame):
    return frame([])


# --- token files


def test_token_file(spark, frame, edge, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_tokenizer())
    path = f"file://{tmp_path}/ids"
    token_file.write(edge, path, word_tokenizer())
    rows = token_file.directory(spark, path).collect()
    want = Counter()
    for doc, text, *_ in samples.edge_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want[doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0] + [r["n_tokens"] for r in ordered])[:-1].tolist()
    ids = [r["doc_id"] for r in ordered]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    whole = {r["doc"]: r["ids"] for r in token_file.read(spark, path).collect()}
    assert whole[4] == [*library.encode("one", add_special_tokens=False).ids, 1]
    token_file.write(empty(frame), path + "-none", word_tokenizer())
    assert token_file.directory(spark, path + "-none").count() == 0


# --- decontamination


def benchmark(frame, items):
    return frame(items, "item_id long, text string, mark long, words string")


def expected_hits(docs, items, window=13):
    known = defaultdict(set)
    for item, text, *_ in items:
        w = samples.alnum(text)
        if w:
            k = min(window, len(w))
            for i in range(len(w) - k + 1):
                known[tuple(w[i : i + k])].add(str(item))
    out = Counter()
    for doc, text, *_ in docs:
        w = samples.alnum(text)
        hit, found = [0] * len(w), set()
        for k in {len(x) for x in known}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in known:
                    hit[i : i + k] = [1] * k
                    found |= known[tuple(w[i : i + k])]
        out[doc, len(w), sum(hit), tuple(sorted(found)), sum(hit) > 0 and 20 * sum(hit) >= len(w)] += 1
    return out


def test_contamination(frame):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(n))
    items = [(i, text(rng.choice([3, 12, 13, 14, 30])), 0, "") for i in range(20)] + [(20, None, 0, ""), (21, "", 0, ""), (22, "Ünï, çödé", 0, "")]
    items += [(23, items[3][1], 0, ""), (3, items[3][1], 0, "")]
    docs = samples.edge_rows()
    for i in range(60):
        inner = rng.choice(items)[1] or ""
        docs.append(row(100 + i, f"{text(rng.randrange(40))}. {inner.upper()}, {text(rng.choice([0, 5, 900]))} {inner[: len(inner) // 2]}"))
    rows = decontamination.contamination(frame(docs).repartition(3), benchmark(frame, items)).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in rows)
    assert got == expected_hits(docs, items)
    kept = decontamination.clean(frame(docs), benchmark(frame, items))
    bad = {k[0] for k in got if k[4]}
    assert {r["doc_id"] for r in kept.collect()} == {k[0] for k in got} - bad and kept.columns == frame(docs).columns


def test_contamination_of_nothing(frame, edge):
    rows = decontamination.contamination(edge, benchmark(frame, [])).collect()
    assert len(rows) == len(samples.edge_rows()) and not any(r["contaminated"] for r in rows)
    assert decontamination.contamination(empty(frame), benchmark(frame, [(1, "a b c", 0, "")])).count() == 0


# --- WARC


def test_warc(spark, frame, tmp_path):
    big = "<html>" + "x" * 9000 + "</html>"
    pages = [(i, f"http://a/{i}", h, 0) for i, h in enumerate([big, big, "tiny", "tiny", None, "", "é" * 60, "y" * 99, "y" * 99])]
    pages += [(None, None, big, 0), (50, "bad\r\nurl", "é" * 60, 0), (1, "http://a/1", big, 0)]
    path = f"file://{tmp_path}/archive"
    warc.write(frame(pages, "page_id long, url string, html string, digest long").repartition(3), path)
    rows = warc.read(spark, path).collect()
    first = {}
    for page, _, html, _ in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(html or "", page)
    want = Counter()
    for page, url, html, _ in pages:
        raw = (html or "").encode()
        revisit = page is not None and len(raw) >= 100 and first[html] != page
        want[f"<urn:page:{'null' if page is None else page}>", "revisit" if revisit else "response", f"<urn:page:{first[html]}>" if revisit else None, len(raw), hashlib.sha256(raw).hexdigest()] += 1
        if not revisit:
            assert any(bytes(r["payload"]) == raw for r in rows if r["record_id"] == f"<urn:page:{'null' if page is None else page}>")
    assert Counter((r["record_id"], r["record_type"], r["refers_to"], r["http_length"], r["payload_digest"].split(":")[1]) for r in rows) == want
    found = warc.read(spark, path, payload=False).where("record_type = 'revisit' and target_uri like 'http://a/%'")
    assert "Filter" not in found._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert {r["target_uri"] for r in found.collect()} == {"http://a/1"} and all(r["payload"] is None for r in found.collect())


def test_warc_splits_and_foreign_files(spark, frame, tmp_path):
    import gzip

    rng = random.Random(4)
    html = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(20, 9000))) + "\x1f\x8b\x08\x04" for _ in range(120)]
    pages = [(i, f"http://b/{i}", h) for i, h in enumerate(html)]
    path = f"{tmp_path}/split"
    warc.write(frame(pages, "page_id long, url string, html string").coalesce(1), path)
    warc.register(spark)
    rows = spark.read.format("warc").option("split_bytes", 20000).load(path)
    assert rows.rdd.getNumPartitions() > 5
    assert {(r["record_id"], bytes(r["payload"]).decode()) for r in rows.collect()} == {(f"<urn:page:{i}>", h) for i, _, h in pages}
    plain = b"".join(warc.record(i, None, h.encode(), hashlib.sha256(h.encode()).hexdigest(), None, "2020-01-01T00:00:00Z") for i, _, h in pages)
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.warc").write_bytes(plain)
    (other / "b.warc.gz").write_bytes(gzip.compress(plain))
    rows = spark.read.format("warc").load(str(other)).collect()
    assert Counter(bytes(r["payload"]).decode() for r in rows) == Counter({h: 2 * n for h, n in Counter(html).items()})
    assert len(spark.read.format("warc").option("payload", "false").load(str(other)).where("content_length > 5000").collect()) == 2 * sum(len(x) > 5000 - 70 for x in []) + len([r for r in rows if r["content_length"] > 5000])


# --- mixing


@pytest.mark.parametrize("weights", [None, {"a": 0.6, "b": 0.3, "": 0.1}])
def test_mix_stays_within_a_block(frame, weights):
    rng = random.Random(6)
    docs = [row(i, "t", source=rng.choices(["a", "b", "c", None], [70, 20, 5, 5])[0]) for i in range(900)] + [row(1, "t", source="a")] * 2 + [row(None, None, source="b")]
    out = mixing.mix(frame(docs).repartition(4), weights, block_rows=3, slots=20)
    rows = out.collect()
    assert out.columns == [*[c for c in frame(docs).columns if c != "position"], "position"]
    assert counted(r[:-1] for r in rows) == counted(tuple(v for k, v in enumerate(d) if k != 8) for d in docs)
    places = sorted((r["position"], r["source"] or "") for r in rows)
    assert len({p for p, _ in places}) == len(rows)
    sizes = Counter(s for _, s in places)
    units = mixing.whole_units({s: (weights or {}).get(s, 0.0) if weights else n**0.5 for s, n in sizes.items()}, 20)
    blocks = {s: -(-n // 3) for s, n in sizes.items()}
    stretch = mixing.phases(blocks, units)[0]
    slots = {p // 3: s for p, s in places}
    full = min(blocks[s] * 20 // units[s] for s in blocks) // 20 * 20
    seen = Counter()
    for t in range(min(full, stretch["width"] * (min(blocks[s] // units[s] for s in blocks)))):
        seen[slots[t]] += 1
        assert all(abs(seen[s] - u * (t + 1) / 20) < 1 for s, u in units.items())


def test_mix_edges(frame, edge):
    assert mixing.mix(empty(frame)).count() == 0
    kept = mixing.in_order(edge)
    assert kept.columns == edge.columns and counted(kept.collect()) == counted(edge.collect())
    with pytest.raises(ValueError, match="slots"):
        mixing.mix(frame([row(i, "x", source=f"s{i}") for i in range(9)]), slots=4)


@pytest.mark.parametrize(
    "weights",
    [{"hot": 0.5, **{f"s{i}": 0.0556 for i in range(9)}}, {"hot": 0.9, **{f"s{i}": 0.001 + i / 1e6 for i in range(99)}}, {"hot": 3333**0.5, **{f"s{i}": (350 + i) ** 0.5 for i in range(19)}}],
)
def test_mix_keeps_to_the_weights_given(weights):
    total = sum(weights.values())
    blocks = {s: int(20_000 * w / total) + 1 for s, w in weights.items()}
    out = list(mixing.in_slots(blocks, mixing.all_weighted(weights)))
    assert sorted(out) == sorted((s, k) for s, n in blocks.items() for k in range(n))
    seen = dict.fromkeys(weights, 0)
    for t in range(int(min(n / weights[s] for s, n in blocks.items()) * total)):
        seen[out[t][0]] += 1
        if t % 7 == 0:
            assert all(abs(n - weights[s] / total * (t + 1)) < 1 for s, n in seen.items())


def test_mix_follows_the_fluid_mix_to_the_last_block():
    rng = random.Random(12)
    blocks = {f"s{i}": rng.choice([0, 1, 2, 5, 40, 300]) for i in range(40)}
    weights = {s: rng.choice([0.01, 0.3, 1.0, 7.7]) for s in blocks}
    out = list(mixing.in_slots(blocks, weights))
    assert sorted(out) == sorted((s, k) for s, n in blocks.items() for k in range(n))
    seen = dict.fromkeys(blocks, 0)
    for t, (s, _) in enumerate(out):
        seen[s] += 1
        low, high = 0.0, 1e6  # the moment at which the fluid mix has filled t + 1 slots
        for _ in range(80):
            half = (low + high) / 2
            low, high = (half, high) if sum(min(n, weights[x] * half) for x, n in blocks.items()) < t + 1 else (low, half)
        assert all(abs(seen[x] - min(n, weights[x] * high)) < 1 for x, n in blocks.items())


@pytest.mark.parametrize("small", [1 << 18, 0])
def test_mix_of_more_sources_than_slots(frame, monkeypatch, small):
    monkeypatch.setattr(mixing, "SMALL_PLAN", small, raising=False)
    monkeypatch.setattr(mixing, "PIECE", 1000, raising=False)
    docs = [row(i, "t", source=f"host{i % 1500}" if i % 3 else "hot") for i in range(4000)]
    places = sorted((r["position"], r["source"]) for r in mixing.mix(frame(docs)).collect())
    assert len({p for p, _ in places}) == len(docs) and counted((s,) for _, s in places) == counted((d[3],) for d in docs)


# --- language, quality, toxicity


def test_language(frame):
    rng = random.Random(8)
    parts = {"en": ["the", "ing", "tion", "th"], "de": ["sch", "ung", "ein", "ä"], "fr": ["eau", "oi", "é", "les"], "es": ["ción", "os", "que", "ñ"]}
    text = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(40))
    docs = [row(i, text(lang), lang) for i in range(160) for lang in [rng.choice(list(parts))]]
    model = language.train(frame(docs + samples.edge_rows()), "doc_id", "text", "lang", rows_per_language=60)
    asked = [row(i, text(lang).upper() if i % 5 == 0 else text(lang), lang) for i in range(80) for lang in [rng.choice(list(parts))]]
    rows = language.identify(frame(asked + samples.edge_rows()), model).collect()
    assert all(r["_language"]["lang"] == r["lang"] for r in rows[: len(asked)])
    assert all(0 <= r["_language"]["score"] <= 1 for r in rows)
    for r in rows[len(asked) :]:
        assert (r["_language"]["lang"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    kept = language.identified(frame(samples.edge_rows()), model)
    assert kept.columns == frame([]).columns and kept.count() == sum(any(c.isalpha() for c in x[1] or "") for x in samples.edge_rows())
    assert language.train(empty(frame), "doc_id", "text", "lang") is None
    assert {r["_language"]["lang"] for r in language.identify(frame(asked), None).collect()} == {"und"}


def test_no_language_is_left_out(frame, monkeypatch):
    monkeypatch.setattr(language, "learn", lambda x, labels: Counter(labels))
    docs = [row(None if k % 9 == 0 else 10 * k + i, f"text {k} {i}", f"l{k}") for k in range(230) for i in range(5)] + [row(9999, "rare", "rare")]
    assert language.train(frame(docs), "doc_id", "text", "lang") == Counter({f"l{k}": 5 for k in range(230)})
    monkeypatch.setattr(language, "SAMPLE", 100 * language.LEAST_ROWS)
    with pytest.raises(ValueError, match="languages"):
        language.train(frame(docs), "doc_id", "text", "lang")


@pytest.mark.parametrize("n", [7, 500, 501, 10**6, 10**9, 10**12])
def test_a_language_of_any_size_is_sampled(n):
    picked = (language.last_hash(n, 500) + (1 << 63) + 1) * n / (1 << 64)
    assert abs(picked - min(n, 500)) < 0.01


def labelled(frame, rows):
    return frame(rows, "doc_id long, quality int, toxic int, score double")


def test_classifiers(frame):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(500):
        own, bad, toxic = [word() for _ in range(50)], i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(4):
                own[rng.randrange(50)] = rng.choice(["zznasty", "qqvile", "zznastyish"])
        docs.append(row(i, " ".join(x.upper() + "!!" if bad else x for x in own)))
        labels.append((i, int(not bad), int(toxic), None))
    docs += samples.edge_rows()
    known = [x for x in labels if x[0] % 3] + [(None, 1, 1, 0.0), (5, None, None, 0.0), (9999, 1, 0, 0.0)]
    for module, column, kind in ((quality, "quality", 1), (toxicity, "toxic", 2)):
        rows = module.score(frame(docs).repartition(3), labelled(frame, known)).collect()
        assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
        want = {x[0]: x[kind] for x in labels}
        held = [r for r in rows if r["doc_id"] is not None and 17 <= r["doc_id"] < 500 and r["doc_id"] % 3 == 0]
        assert np.mean([(r["score"] >= (0.5 if kind == 1 else 0.3)) == want[r["doc_id"]] for r in held]) > 0.95, column
        none = module.score(frame(samples.edge_rows()), labelled(frame, [])).collect()
        assert len(none) == len(samples.edge_rows()) and all(0 <= r["score"] <= 1 for r in none)
        assert module.score(empty(frame), labelled(frame, known)).count() == 0


# --- Jaccard join


@pytest.mark.parametrize("block", [1024, 7])
def test_components(frame, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 4 if block == 7 else 16)
    rows = samples.near_rows()
    rows = [(*r[:1], r[1].replace("t1", "T1") if k % 3 else r[1], *r[2:]) for k, r in enumerate(rows)]
    found = jaccard_join.near_duplicates(frame(rows).repartition(3), width=4, percent=85, inside="solid").collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == samples.components(rows, 4, 85)


def test_a_wide_cell_is_sent_a_few_times(frame, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    rows = [row(i, " ".join(w if j != i % 200 else f"own{i}" for j, w in enumerate(base))) for i in range(240)]
    rows += [row(300 + i, " ".join([*base[:100], *[f"far{rng.randrange(9999)}" for _ in range(100)]])) for i in range(6)]
    sent, search = [], jaccard_join._links

    def watched(members, *how):
        keys = [c for c in ("cell", "block", "chunk") if c in members.columns]
        sent.append([r["count"] for r in members.groupBy(*keys).count().collect()])
        return search(members, *how)

    monkeypatch.setattr(jaccard_join, "_links", watched)
    found = jaccard_join.near_duplicates(frame(rows).repartition(3), width=4, percent=85, inside="solid").collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == samples.components(rows, 4, 85)
    assert len(sent) > 1 and max(map(max, filter(None, sent))) < 60  # a task holds no whole cell
    assert max(map(sum, sent)) < 3 * len(rows)


def test_one_of_each(frame, edge):
    kept = jaccard_join.one_of_each(edge)
    assert kept.columns == edge.columns
    rows = kept.collect()
    got = Counter((r["doc_id"], r["text"]) for r in rows)
    assert max(got.values()) == 1
    texts = {x[1] for x in samples.edge_rows()}
    gone = texts - {r["text"] for r in rows}
    assert all(t.startswith("w0x0") for t in gone) and len(gone) == 1  # the longer near copy
    assert (13, "same text, other id") in got and (14, "same text, other id") not in got and (14, "another text of the same id") in got
    assert {r["doc_id"] for r in rows} >= {None, 1, 2, 3, 9, 11} and 10 not in {r["doc_id"] for r in rows}
    assert jaccard_join.one_of_each(empty(frame)).count() == 0


# --- fingerprints


def test_fingerprints(frame, edge):
    rows = merkle.fingerprints(edge).collect()
    assert len(rows) == len(samples.edge_rows())
    by_id = Counter(r[0] for r in samples.edge_rows())
    texts = {}
    for doc, text, *_ in samples.edge_rows():
        texts.setdefault(doc, text or "")
    ids = sorted((d for d in texts if d is not None))
    single = [d for d in ids if by_id[d] == 1]
    for r in rows:
        d = r["doc_id"]
        follows = ids[(ids.index(d) + 1) % len(ids)] if d in single else None
        if follows in single and d != ids[-1]:
            text, n = texts[d], len(texts[d])
            edited = text[: n - n // 2] + texts[follows][: n // 2]
            assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    a, b = ([r for r in rows if r["doc_id"] == d][0] for d in (13, 9))
    assert a["fingerprint"] in [r["fingerprint"] for r in rows if r["doc_id"] == 14] and b["near_next"] == 1
    assert merkle.fingerprints(empty(frame)).count() == 0
    alone = merkle.fingerprints(frame([row(3, "ab cd")])).first()
    assert alone["near_next"] == 1 and alone["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest()


def test_fingerprints_of_every_row_against_bags_of_segments(frame):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(0, 400))).replace(" w7 ", "\n") for _ in range(12)]
    texts = {}
    for i, doc in enumerate(rng.sample(range(10_000), 60)):
        own = base[i % 12].split(" ")
        own[rng.randrange(len(own))] = "changed"
        texts[doc] = " ".join(own) + "\u6f22\u5b57\u4eee\u540d" * rng.choice([0, 0, 40])
    ids = sorted(texts)
    found = {r["doc_id"]: r for r in merkle.fingerprints(frame([row(d, t) for d, t in texts.items()])).collect()}
    assert sorted(found) == ids

    def bag(text):
        return Counter(next(merkle.trees(pa.array([text], pa.large_string()))).segments.tolist())

    for d, follows in zip(ids, [*ids[1:], ids[0]], strict=True):  # the last is followed by the first
        r, text, n = found[d], texts[d], len(texts[d])
        edited = text[: n - n // 2] + texts[follows][: n // 2]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        for other, near in ((edited, r["near_edited"]), (texts[follows], r["near_next"])):
            a, b = bag(text), bag(other)
            assert near == pytest.approx(2 * sum((a & b).values()) / (a.total() + b.total()))


# --- substring dedup


def expected_cuts(rows, window):
    first = {}
    for doc, text, *_ in rows:
        own = samples.solid(text)
        for i in range(len(own) - window + 1):
            k = tuple(own[i : i + window])
            first[k] = min(first.get(k, doc), doc)
    out = Counter()
    for doc, text, *_ in rows:
        own = samples.solid(text)
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            if first[tuple(own[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(own, gone, strict=True) if not g)
        out[doc, len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("window", [50, 8])
def test_remove_repeats(frame, window):
    rng = random.Random(12)
    base = [rng.choice("abcdef") for _ in range(400)]
    rows = [r for r in samples.edge_rows() if r[0] is not None]
    for i in range(60):
        own = [rng.choice("abcdef") for _ in range(rng.randrange(80))]
        a = rng.randrange(350)
        own[rng.randrange(len(own) + 1) : 0] = base[a : a + rng.choice([5, 49, 50, 51, 120])]
        own += ["run"] * rng.choice([0, 0, 30, 70])
        rows.append(row(100 + i // 2 * 2 if i % 10 == 0 else 100 + i, " ".join(own)))
    found = substrings.remove_repeats(frame(rows).repartition(3), window=window).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == expected_cuts(rows, window)
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in found if r["kept"] is not None)


def test_remove_repeats_edges(frame, edge):
    assert len(substrings.remove_repeats(edge).collect()) == len(samples.edge_rows())
    assert substrings.remove_repeats(empty(frame)).count() == 0
