"""The operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from strandline.llm import anchors, html_text, licenses, mixing, neighbours, packing, quality_model, quality_rules, simhash, suffix_dedup, token_counts
from strandline.llm.tokens import default_path, encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count int, key string, fp string, v double, hits int"


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of", "Zoë", "ünd", "x1", "stone,", "River."]) + str(rng.randrange(300)) for _ in range(n))


def texts() -> list[str | None]:
    rng = random.Random(4)
    passage = words(rng, 60)
    base = words(rng, 400)
    near = base.split(" ")
    near[17] = "changed"
    return [
        None, "", " \n\t ", "one", "one two", base, base, " ".join(near), passage, words(rng, 50) + " " + passage + " " + words(rng, 9), words(rng, 20) + passage, "The The The " * 200, "a" * 700, "a" * 300,
        words(rng, 30_000), "Released under the MIT License.\nx\nx\n", "under the mit license under the MIT license; Apache License, Version 2.0", "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the GNU General Public License, version 3.", "日本語 テキスト 日本語\n\n日本語 🙂", "# * $ % & | < >\n\n  two  spaces\r\nend ", words(rng, 19), words(rng, 20),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "b", "a", "c"][i % 4], 1, 7, "k", "f", 0.5, 3) for i, t in enumerate(texts())]
    rows += [rows[9], (None, "lost id", "en", "a", 1, 7, "k", "f", 0.5, 3)]
    df = spark.createDataFrame(rows, SCHEMA).checkpoint()
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id, *map(str, r)))


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (
        suffix_dedup.remove_repeats(empty), simhash.near_duplicates(empty), mixing.mix(empty), quality_rules.quality_rules(empty), licenses.scan(empty), packing.pack(empty),
        token_counts.token_counts(empty), quality_model.scored(empty, quality_model.fit([])), html_text.extract(pages), neighbours.nearest(vectors, lambda i: i % 50 == 0),
    ):
        assert df.count() == 0


def test_suffix_dedup(docs):
    rows = by_id(docs.select("doc_id", "text"))
    want = suffix_dedup.brute([r.text for r in rows])
    got = by_id(suffix_dedup.remove_repeats(docs))
    assert len(got) == len(rows)
    for r, g, spans in zip(rows, got, want):
        raw = (r.text or "").encode()
        assert [(s.start, s.stop) for s in g.spans] == spans, r.doc_id
        keep = b"".join(raw[a:b] for a, b in zip([0] + [e for _, e in spans], [s for s, _ in spans] + [len(raw)]))
        assert bytes(g.kept) == keep and g.n_bytes == len(raw)
    assert sum(map(len, want)) > 5


def test_suffix_dedup_large_groups(spark, monkeypatch):
    """Many strings round one passage, settled by windows counted across the cluster (a low limit of the group) as by refinement."""
    rng = random.Random(9)
    passage = words(rng, 40)
    rows = [(i, words(rng, 12) + passage[i % 5 : len(passage) - i % 7] + words(rng, 12)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").checkpoint()
    want = suffix_dedup.brute([t for _, t in rows])
    spans = lambda: [[(s.start, s.stop) for s in r.spans] for r in by_id(suffix_dedup.remove_repeats(df))]
    assert spans() == want
    monkeypatch.setattr(suffix_dedup, "GROUP", 1)
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    assert spans() == want


def test_long_texts_in_parts(monkeypatch):
    """Anchors don't depend on how a long text is cut up."""
    text = words(random.Random(2), 4000).encode()
    b, starts = np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)])
    take = lambda: sorted((int(x), int(k)) for part in suffix_dedup._anchors_of(b, starts) for x, k in zip(part[1], part[2]))
    whole = take()
    monkeypatch.setattr(anchors, "SEGMENT", 5000)
    assert take() == whole


def test_every_string_has_one_owner():
    for text in (b"a" * 1000, words(random.Random(3), 500).encode(), b"ab" * 500, bytes(range(256)) * 4):
        b = np.frombuffer(text, dtype=np.uint8)
        _, x, _, _, least, most = anchors.anchor_rows(b, np.array([0, len(b)]))
        owned = sorted(int(p - o) for p, lo, hi in zip(x, least, most) for o in range(lo, hi + 1))
        assert owned == list(range(len(b) - anchors.SPAN + 1))


def test_simhash(docs):
    import xxhash

    def fingerprint(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    rows = by_id(docs.select("doc_id", "text"))
    fps = [fingerprint(r.text) for r in rows]
    label = [r.doc_id if r.doc_id is not None else 10**9 for r in rows]
    for _ in rows:
        label = [min(label[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(rows))]
    got = by_id(simhash.near_duplicates(docs))
    assert [r.fingerprint for r in got] == [f"{f:016x}" for f in fps]
    assert [r.component_id for r in got] == [None if x == 10**9 else x for x in label]


def test_links_of_close_fingerprints(spark, monkeypatch):
    rng = random.Random(6)
    fps = []
    for _ in range(40):
        f = rng.getrandbits(64)
        fps += [f] + [f ^ sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 3, 4)))) for _ in range(8)]
    fps += [1 << b for b in range(64)] + [0, 2**64 - 1]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fp long").checkpoint()
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                up[max(root(a), root(b))] = min(root(a), root(b))
    want = {f: root(f) for f in fps}
    for tile in (2048, 4):
        monkeypatch.setattr(simhash, "TILE", tile)
        from strandline.llm.common import components

        got = {r.node: r.component for r in components(simhash.fingerprint_links(df)).collect()}
        assert {f: got.get(f, f) for f in fps} == want


def test_quality_rules(docs):
    rows = by_id(docs.select("doc_id", "text"))
    got = by_id(quality_rules.quality_rules(docs))
    for r, g in zip(rows, got):
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        count = {}
        for x in grams:
            count[x] = count.get(x, 0) + 1
        covered = {i + k for i, x in enumerate(grams) if count[x] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)), r.doc_id
        assert g.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and (not g.kept or not g.base_failed)


def test_host_verdicts(spark):
    """`kept` by brute force: rates of each rule by host, shrunk by a prior, decide; a document that breaks nothing stays."""
    rng = random.Random(7)
    clean = lambda: words(rng, 40)
    spoilt = lambda: words(rng, 40) + " ### $$$ %%%"
    rows = [("good" if i % 2 else None, spoilt() if i % 25 == 0 else clean()) for i in range(300)] + [("bad", spoilt() if i % 2 else clean()) for i in range(60)] + [("tiny", spoilt())]
    rows = [(i, h, t, "x", 1) for i, (h, t) in enumerate(rows)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, source string, text string, rate string, host int")).collect()
    hosts: dict = {}
    breaks = {}
    for i, h, t, *_ in rows:
        breaks[i] = {"symbols"} if 20 * sum(c in "#*$%&|<>" for c in t) > len(t.split()) else set()
        n = hosts.setdefault(h, [0, 0])
        n[0] += 1
        n[1] += bool(breaks[i])
    p = [f / n for n, f in hosts.values()]
    mean, v = np.mean(p), np.var(p, ddof=1)
    beyond = max(v - mean * (1 - mean) * np.mean([1 / n for n, _ in hosts.values()]), 0)
    k = min(max(mean * (1 - mean) / beyond - 1 if beyond else 1000, 2), 1000)
    fails = {h: (f + mean * k) / (n + k) > max(quality_rules.EXCESS * mean, quality_rules.LEAST) for h, (n, f) in hosts.items()}
    assert sum(fails.values()) in (0, 1, 2)
    for r in got:
        assert r.kept == (not r.base_failed and not (fails[rows[r.doc_id][1]] and breaks[r.doc_id])), r
    verdicts = spark.createDataFrame([("big", "r", 1000, 100), ("bad", "r", 500, 450), ("tiny", "r", 1, 1), (None, "r", 30, 0), *((f"h{i}", "r", 100, 8) for i in range(20))], "host string, rule string, n_docs long, n_failed long")
    of = {r.host: r for r in quality_rules.host_verdicts(verdicts).collect()}
    assert of["bad"].rule_failed and not of["big"].rule_failed and not of[None].rule_failed
    assert 0.1 < of["tiny"].rate < 1 and of["big"].rate == pytest.approx(0.1, abs=0.02)


def targets(size: dict[str, int], limit: float = 3.0) -> dict[str, float]:
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = float(sum(size.values())), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > limit * size[s]}
        if not over:
            return out | {s: w[s] * level for s in free}
        for s in over:
            out[s] = limit * size[s]
            left -= out[s]
        free -= over
    return out


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, None if i == 3 else words(rng, rng.choice((1, 5, 40, 400))), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)] + [(1000, "only one", "z"), (1, "again", "a"), (1, "again", "a"), (2000, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").checkpoint()
    got = mixing.mix(df, block=8).collect()
    assert len(got) == len(rows) and got and sorted(got) == sorted(mixing.mix(df, block=8).collect())
    size: dict = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = targets(size)
    for s in size:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {size[s]} and mine[0].target == pytest.approx(want[s])
        assert sum(r.taken for r in mine) == pytest.approx(want[s], abs=100) and all(0 <= r.taken <= 3 * r.size for r in mine)


def test_mixed_blocks(spark):
    """The mix itself: slots are whole runs of the stream, parts are words of their documents, and their sums are what mix() counts."""
    rng = random.Random(5)
    rows = [(i, None if i == 3 else words(rng, rng.choice((1, 5, 40, 400))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)] + [(2000, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").checkpoint()
    parts = mixing.mixed_blocks(df, block=8, shard=512).collect()
    text = {i: (t or "").split() for i, t, _ in rows}
    taken: dict = {}
    slots: dict = {}
    for r in sorted(parts, key=lambda r: r.offset):
        part = text[r.doc_id][r.start : r.start + r.words]
        assert len(part) == r.words > 0
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.words
        got = slots.setdefault((r.source, r.epoch, r.slot), [r.shard, r["index"], []])
        assert got[:2] == [r.shard, r["index"]] and len(got[2]) == r.offset
        got[2].extend(part)
    assert taken == {r.doc_id: r.taken for r in mixing.mix(df, block=8, shard=512).collect() if r.taken}
    # A block is the same words on every pass; a pass reads each block once at most.
    whole: dict = {}
    for (s, _, _), (_, i, w) in slots.items():
        assert whole.setdefault((s, i), w) == w
    passes = [(s, e, i) for (s, e, _), (_, i, _) in slots.items()]
    assert len(passes) == len(set(passes))
    # Every shard but the last is full, and its counts are those of the plan give or take what is drawn.
    size: dict = {}
    for shard, _, _ in slots.values():
        size[shard] = size.get(shard, 0) + 1
    assert all(size[k] == 512 for k in range(max(size))) and max(size) >= 3


def test_mixing_same_as_sql(spark):
    """Against SQL that makes the draws, the permutation and the stream without partial sums, with null and clashing columns, repeated rows and tiny sources."""
    import duckdb

    rng = random.Random(15)
    rows = [(i, None if i == 3 else words(rng, rng.choice((1, 5, 40, 400))), rng.choice(["a", "a", "a", "a", "b", "c", "d", None]), i, 1, i) for i in range(500)]
    rows += [(1000, "only one", "z", 0, 0, 0), (1, "again", "a", 0, 0, 0), (1, "again", "a", 0, 0, 0), (None, "no id here", "a", 0, 0, 0), (2000, "", "y", 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, slot int, target int").checkpoint()
    c = duckdb.connect()
    c.register("documents", df.select("doc_id", "text", "source").toArrow())
    key = lambda r: tuple((x is None, x) for x in r)
    for ours, blocks, names in ((mixing.mix, False, "doc_id, size, source_size, target, taken"), (mixing.mixed_blocks, True, "shard, source, epoch, slot, index, offset, doc_id, start, words")):
        want = c.execute(f'select {names.replace("index", chr(34) + "index" + chr(34)).replace("offset", chr(34) + "offset" + chr(34))} from ({mixing._sql(blocks, 8, 3, 300)})').fetchall()
        got = [tuple(r) for r in ours(df, block=8, seed=3, shard=300).select(*names.split(", ")).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_slots_are_a_permutation(spark):
    s = spark.createDataFrame([("a", 1000, 3000.0), ("b", 17, 10.0), ("c", 5000, 3007.0)], "source string, source_size long, target double")
    rows = mixing.plan_slots(s, 8, 1, 100).collect()
    for e in (0, 1):
        assert sorted(r["index"] for r in rows if r.source == "a" and r.epoch == e) == list(range(125))
    last = [r["index"] for r in rows if r.source == "a" and r.epoch == 2]
    assert len(last) == len(set(last)) >= 115 and not [r for r in rows if r.epoch > 2]
    part = [r["index"] for r in sorted((r for r in rows if r.source == "c"), key=lambda r: r.slot)]
    assert len(part) == len(set(part)) == pytest.approx(376, abs=12) and len({(y - x) % 625 for x, y in zip(part, part[1:])}) > 150
    assert {r.shard for r in rows} == set(range(8))


def test_shard_counts_are_drawn(spark):
    """Over many shards the counts have the expectations of the plan and vary like independent draws of the slots that are left over."""
    s = spark.createDataFrame([("a", 80_000, 80_000.0 / 3), ("b", 80_000, 80_000.0 / 3), ("c", 80_000, 80_000.0 / 3)], "source string, source_size long, target double")
    n = {(r.source, r.shard): r.n for r in mixing.shard_counts(s, 8, 4, 1, 3.0).collect()}
    a = [n.get(("a", k), 0) for k in range(2500)]
    assert set(a) == {1, 2} and sum(a) / len(a) == pytest.approx(4 / 3, abs=0.05)
    assert sum(n.values()) == 10_000 and n != {(r.source, r.shard): r.n for r in mixing.shard_counts(s, 8, 4, 2, 3.0).collect()}


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    rows = packing.pack(docs).collect()
    ids = {(r.doc_id, r.text): t.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.select("doc_id", "text").collect()}
    total = sum(len(ids[r.doc_id, r.text]) for r in docs.select("doc_id", "text").collect())
    assert sum(r.length for r in rows) == total
    for (i, _), x in ids.items():
        for r in (r for r in rows if r.doc_id == i):
            part = np.array(x[r.start : r.start + r.length], dtype="<u4")
            assert zlib.crc32(part.tobytes()) == r.ids_crc32 and len(part) == r.length
            assert r.length == 1024 or r.piece == 0
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert len(by) <= -(-total // 1024) + 1


def test_fullest_combination_is_the_best():
    rng = random.Random(8)
    for _ in range(60):
        counts = np.zeros(31, dtype=np.int64)
        for _ in range(rng.randrange(1, 7)):
            counts[rng.randrange(1, 31)] += 1
        room = rng.randrange(0, 31)
        items = [n for n in range(31) for _ in range(counts[n])]
        best = max(s for s in (sum(x for k, x in enumerate(items) if m >> k & 1) for m in range(1 << len(items))) if s <= room)
        used = packing.fullest(counts, room)
        assert sum(n * k for n, k in used.items()) == best and all(counts[n] >= k for n, k in used.items())


def test_ids_equal_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    e = encoder(default_path())
    for x in [*(y or "" for y in texts()), "  a", "a ", "a\n", "\n a", "it's we'll\nI'm ok", "a\r\nb", "1234 56\n78", "<|endoftext|> x", "x y z", "a b"]:
        assert e.ids(x).tolist() == t.encode(x, add_special_tokens=False).ids


def test_token_counts(docs):
    rows = token_counts.token_counts(docs).collect()
    e = encoder(default_path())
    text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").where("doc_id <> 9").collect()}
    for i, t in text.items():
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.section)
        assert sum(r.n_tokens for r in mine) == len(e.ids(t))
        lines = re.findall(r"[^\n]*\n|[^\n]+\Z", t) or [""]
        assert [t[r.start : r.start + r.n_chars] for r in mine] == lines


@pytest.mark.parametrize(("rule", "want"), [("start", [2, 1]), ("end", [1, 2]), ("most", [1, 2])])
def test_crossing_tokens(rule, want):
    got, crossing = token_counts.attribute(np.array([0, 3, 8]), np.array([3, 8, 9]), np.array([0, 5, 9]), rule)
    assert got.tolist() == want and crossing.sum() == 1


def test_licenses(docs):
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (rows[15].base_labels, rows[15].labels, rows[15].n_base, rows[15].first_word, rows[15].n_words) == ("mit", "mit", 1, 1, 7)
    assert (rows[16].base_labels, rows[16].n_base, rows[16].first_word, rows[16].last_word, rows[16].score) == ("apache-2,mit", 3, 0, 8, 1.0)
    assert (rows[17].base_labels, rows[18].base_labels, rows[18].labels, rows[18].n_base, rows[18].first_word) == ("cc-by-nc", "", "gpl-3", 0, None)
    assert (rows[0].n_words, rows[0].labels, rows[0].score) == (0, "", 0.0)
    assert rows[20].n_words == 3


def test_license_rivals_share_words():
    """A better match elsewhere in a block drops no label; a better one on the same words does."""
    scanner = licenses.Scanner(licenses.TEMPLATES, {}, 0.8)
    labels = lambda t: licenses.scan_text(t, scanner)[5]
    gpl = "This software is licensed under the GNU General Public License version 2"
    by = "its documentation is licensed under a Creative Commons Attribution 4.0 International License"
    assert labels(f"{gpl}; {by}") == "cc-by,gpl-2" and labels(gpl) == "gpl-2" and labels(by) == "cc-by"
    assert labels(f"{gpl}; {gpl}") == "gpl-2" and labels(f"{gpl}\n{by}") == "cc-by,gpl-2"
    assert labels("This is licensed under the GNU Lesser General Public License version 3") == "lgpl"
    assert labels("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License") == "cc-by-sa"
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    assert labels(f"{isc} Licensed under the GNU Lesser General License version 3") == "isc,lgpl"


def test_license_notices_across_lines():
    """Every template is found under its own label alone wherever line breaks fall in it, with text before and after, and with a tenth of its words spoilt."""
    rng = random.Random(12)
    scanner = licenses.Scanner(licenses.TEMPLATES, {}, 0.8)
    assert licenses.scan_text("This program is licensed under the GNU\nGeneral Public License version 2", scanner)[5:] == ("gpl-2", 1.0)
    for label, t in licenses.TEMPLATES:
        for _ in range(20):
            lines = "".join(w + rng.choice([" ", "\n"]) for w in t.split())
            text = words(rng, rng.randrange(1, 60)) + "\n" + lines + words(rng, rng.randrange(1, 400))
            assert licenses.scan_text(text, scanner)[5] == label, text
    with pytest.raises(ValueError):
        licenses.Scanner([("long", " ".join(map(str, range(300))))], {}, 0.8)


def test_license_join_is_exact():
    rng = random.Random(3)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})
    index = licenses.Index(licenses.TEMPLATES, {w.encode(): rng.randrange(5) for w in vocabulary}, 0.8)
    sets = [(label, set(t.encode().split())) for label, t in licenses.TEMPLATES]
    for _ in range(400):
        label, s = rng.choice(sets)
        block = {w for w in s if rng.random() < 0.85} | {rng.choice(vocabulary).encode() for _ in range(rng.randrange(4))}
        want = {(x, len(block & y) / len(y)) for x, y in sets if len(block & y) >= 0.8 * len(y)}
        assert set(index.matches(block)) == want


def test_licenses_same_as_sql():
    """Texts made of whole, spoilt and wrapped notices, against the SQL, which compares every block with every template."""
    import duckdb
    import pandas as pd

    rng = random.Random(3)
    rows = []
    for i in range(200):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            notice = [w if rng.random() > 0.06 else "spoilt" for w in rng.choice(licenses.TEMPLATES)[1].split()]
            parts.append(rng.choice("\n ").join(notice) if rng.random() < 0.5 else " ".join(rng.choice(["a", "the", "license", "stone", "public"]) for _ in range(rng.randrange(1, 40))))
        rows.append((i, rng.choice([" ", "\n", ". "]).join(parts)))
    rows += [(300, None), (301, ""), (302, "Under the MIT License under the MIT license")] + rows[:2]
    scanner = licenses.Scanner(licenses.TEMPLATES, {}, 0.8)
    got = sorted(((i, *licenses.scan_text(t, scanner)) for i, t in rows), key=lambda r: r[0])
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = c.execute(f"select doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score from ({licenses.SQL}) order by doc_id").fetchall()
    assert [r[:7] for r in got] == [r[:7] for r in want] and [r[7] for r in got] == pytest.approx([r[7] for r in want])
    assert len({r[6] for r in got}) > 12


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((3000, 16)), 2)
    x[10] = x[20] = x[30]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, [0.0] * 16), (3050, None), (3051, [float("nan")] * 16), (3052, [None] + [1.0] * 15), (3053, [1e200] * 16), (3100, [1.0, 2.0]), (None, [1.0] * 16)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0).collect()
    x = np.vstack([x, np.zeros((53, 16)), np.full((1, 16), 1.0)])
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    hit = n = 0
    for q in range(0, 3000, 50):
        s = unit @ unit[q]
        s[q] = s[3000:3053] = -9
        want = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and all(r.score == pytest.approx(s[r.vec_id], abs=1e-12) for r in mine)
        hit += len({r.vec_id for r in mine} & set(want.tolist()))
        n += 5
    assert hit / n >= 0.9
    assert {r.query_id for r in got} == set(range(0, 3000, 50))


def test_neighbours_among_copies(spark):
    """Of many equal scores those of the smallest ids are kept, in a group of far more rows than a leaf holds."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 16))
    group = np.sort(rng.choice(2000, 300, replace=False))
    x[group] = x[group[0]]
    x[group[::3]] *= 2
    near = x[group[0]] + 0.01 * rng.standard_normal(16)
    rows = [(int(i), x[i].tolist()) for i in rng.permutation(2000)] + [(2000, near.tolist())]
    ask = [int(i) for i in group[[0, 1, 7, 150, 299]]] + [2000]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i.isin(ask)).collect()
    for q in ask:
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert [i for i in mine if i != 2000] == [int(i) for i in group if i != q][: 5 - mine.count(2000)], q


def test_neighbours_in_cells(spark, monkeypatch):
    """Many cells and blocks, a cell that one vector fills, clustered rows: recall stays, fewer than all rows are verified, columns may clash."""
    monkeypatch.setattr(neighbours, "ROWS", 200)
    monkeypatch.setattr(neighbours, "SAMPLE", 500)
    monkeypatch.setattr(neighbours, "QUERIES", 20)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 16))[rng.integers(0, 40, 2400)] + 0.3 * rng.standard_normal((2400, 16))
    x[:700] = x[0]
    rows = [(int(i), x[i].tolist(), 1, 2.0, 3) for i in rng.permutation(2400)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int, known double, part int"), lambda i: i % 50 == 0).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 2400, 50):
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        hit += sum(np.round(r.score, 11) >= np.round(np.sort(s)[-5], 11) for r in mine)
    assert hit / (48 * 5) >= 0.9
    ids = np.arange(2400)
    q = ids[ids % 50 == 0]
    assert neighbours.search(ids, x, q, x[q], 5)[2] < 0.7 * len(q) * 2400


def test_chi_square():
    assert neighbours.chi_square(np.array([0.0, 7.344, 15.507, 1e9]), 8) == pytest.approx([0, 0.5, 0.95, 1], abs=1e-3)


PAGE = """<html><body><header><h1>Site</h1></header><nav><a href=a>x</a><a href=b>y</a></nav><div id=wrap><div class="sidebar"><ul><li><a href=x>l1</a><li><a>l2</a></ul></div>
<div class=content><h2>Title &amp; co</h2><p>Para one is long enough,\n it goes on.</p><p>Short.<p>Third &lt;b&gt; <i>x</i>  y<br>z</p><form><p>Your mail</p></form><script>var a="</p>";</script></div>
<div id="comments"><p>nice post, this is a long comment about things and more</p></div></div><div class="cookie-notice">We use cookies</div><footer>c</footer>"""


def test_html(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 3), (2, None, None, 3), (3, "u", "", 3), (4, "u", "<p>only", 3), (5, "u", "a < b &amp; c", 3), (1, "u", PAGE, 3)], "page_id long, url string, html string, n_chars int")
    got = sorted(html_text.extract(df).collect(), key=lambda r: r.page_id)
    assert [r.text for r in got] == ["Title & co\nPara one is long enough, it goes on.\nShort.\nThird <b> x y z"] * 2 + ["", "", "only", "a < b & c"]
    assert all(r.n_chars == len(r.text) for r in got)


BODY = "".join(f"<p>Paragraph {i} of the text, long enough to count for something and without links, so that it is dense.</p>" for i in range(6))


def test_html_density_decides():
    """No article element, no role, no class: the densest subtree is the text, and all of it is, short parts and lists too."""
    menu = "<div>" + "".join(f"<span><a href={i}>Item {i}</a></span>" for i in range(8)) + "</div>"
    page = f"<html><body>{menu}<div>Buy now.</div><div><h1>Title</h1>{BODY}<p>Short.</p><ul><li><a href=1>Reference one</a><li><a href=2>Reference two</a></ul></div><div>{menu}Some firm</div></body></html>"
    lines = html_text.main_text(page).split("\n")
    assert lines[0] == "Title" and lines[-3:] == ["Short.", "Reference one", "Reference two"] and len(lines) == 10
    parts = f"<div id=x>{menu}<div><section><h2>One</h2>{BODY}</section><section><h2>Two</h2>{BODY}</section></div></div>"
    assert html_text.main_text(parts).split("\n")[::7] == ["One", "Two"]


def test_html_roles_are_whole_names():
    drop = lambda c: "kept words" not in html_text.main_text(f"<body><article>{BODY}<div class='{c}'><p>kept words</p></div></article>")
    assert all(map(drop, ("ad", "cookie-notice", "comments", "comment-list", "x sidebar", "site-footer", "related-posts", "AD-SLOT")))
    assert not any(map(drop, ("share-price-table", "notice-board", "advice", "header-image-caption", "commentary", "")))
    assert html_text.main_text(f"<head><title>t</title><body><main>{BODY}<div hidden>x</div><div role=navigation>y</div><p style='display: none'>z</p></main>").count("\n") == 5


def test_html_time_is_linear():
    """A megabyte of each kind of broken markup, after a paragraph that stays."""
    import time

    for unit in ("<a ", "<p title='", '<p title="', "<div>", '<a "x>"', "</div>", "<b></b>", "<ul><li><div>", "<li><p>", "&amp", "<!-- ", "<script x ", "<svg>x</svg", "<", "<a b='>'", "<p><span class=ad>"):
        page = "<body><p>Some text that stays.</p>" + unit * (1_000_000 // len(unit))
        began = time.process_time()
        assert html_text.main_text(page).startswith("Some text that stays."), unit
        assert time.process_time() - began < 40, unit


@pytest.mark.parametrize("html", ["<div" * 50, "</" * 9, "<p></p" * 9, "a<b", "<![CDATA[x", "<!doctype", "<table><td>x<tr><td>y", "\x00<p>\ud800</p>", "<p>x<article>", "&#x110000;&bogus;", "<body><body><p>x</body></body>y"])
def test_html_odd_pages(html):
    assert isinstance(html_text.main_text(html), str)


def test_classifier(spark):
    rng = random.Random(1)
    good = [(words(rng, rng.randrange(20, 200)), 1) for _ in range(150)]
    bad = [(" | ".join(w.upper() + "!!" for w in words(rng, rng.randrange(20, 200)).split()), 0) for _ in range(60)]
    rows = good + bad
    rng.shuffle(rows)
    model = quality_model.fit(rows[:140])
    right = [(model.score(t) >= 0.3) == y for t, y in rows[140:]]
    assert sum(right) / len(right) > 0.95
    for t in (None, "", "x", "long " * 100_000):
        assert 0 <= model.score(t) <= 1
    assert model.score(None) == model.score("")
    only = quality_model.fit([("a b c", 1)] * 5)
    assert only.score("anything") == only.score("else") > 0.5


def test_digest_of_query(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [r for r in suffix_dedup.query(spark, str(tmp_path)).collect() if r.doc_id == 4]
    assert rows[0].asDict() == {"doc_id": 4, "n_bytes": 7, "n_removed": 0, "n_spans": 0, "kept_sha256": hashlib.sha256(b"one two").hexdigest()}
