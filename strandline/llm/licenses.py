"""License scan: exact phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Base: a phrase's words in a row.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: The method's templates: short notices by which works name their license, and the notices and permissions that licenses ask to be kept.
TEMPLATES = [
    ("mit", "this software is released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "this program is licensed under the gnu general public license version 2"),
    ("lgpl", "this library is licensed under the gnu lesser general public license version 2 1"),
    ("lgpl", "this work is licensed under the gnu lesser general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without"
        " limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following"
        " conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright"
        " notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the"
        " documentation and or other materials provided with the distribution",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed"
        " to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language"
        " governing permissions and limitations under the license",
    ),
    *(
        (
            label,
            f"this {what} is free software you can redistribute it and or modify it under the terms of the gnu {kind} public license as published by the free software foundation either version {version} of the"
            f" license or at your option any later version this {what} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a"
            f" particular purpose see the gnu {kind} public license for more details",
        )
        for label, what, kind, version in (
            ("gpl-2", "program", "general", "2"), ("gpl-3", "program", "general", "3"), ("lgpl", "library", "lesser general", "2 1"), ("lgpl", "library", "lesser general", "3"), ("agpl-3", "program", "affero general", "3"),
        )
    ),
]
#: Templates of at most STEP words are looked for in blocks of BLOCK words, one every STEP: each notice lies whole in some block.
SIZES = [(32, 16), (512, 256)]
THRESHOLD = 0.8
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(raw: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of text lower-cased in A-Z, as UTF-8."""
    return _WORD.findall(raw.lower())


class Index:
    """Templates as token sets in ascending order of the corpus' token counts, and an inverted index of their prefixes.

    A block that holds `need` of a template's n tokens holds one of the n - need + 1 rarest: only those are indexed. Length
    filter: a block of fewer than `need` distinct words can't. Positional filter: if the first token found is the i-th, at most
    n - i can be shared.
    """

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float):
        self.templates = []
        self.tokens: list[frozenset[bytes]] = []
        self.prefix: dict[bytes, list[int]] = {}
        for k, (label, text) in enumerate(templates):
            tokens = sorted(set(words_of(text.encode())), key=lambda w: (counts.get(w, 0), w))
            need = ceil(threshold * len(tokens) - 1e-9)
            self.templates.append((label, tokens, need))
            self.tokens.append(frozenset(tokens))
            for w in tokens[: len(tokens) - need + 1]:
                self.prefix.setdefault(w, []).append(k)

    def matches(self, block: set[bytes]) -> Iterator[tuple[str, float]]:
        for k, share in self.hits(block):
            yield self.templates[k][0], share

    def hits(self, block: set[bytes]) -> Iterator[tuple[int, float]]:
        """(template, share) of those that meet the threshold."""
        for k in sorted({k for w in block & self.prefix.keys() for k in self.prefix[w]}):
            _, tokens, need = self.templates[k]
            if len(block) < need:
                continue
            first = next(i for i, w in enumerate(tokens) if w in block)
            if len(tokens) - first < need:
                continue
            shared = sum(w in block for w in tokens[first:])
            if shared >= need:
                yield k, shared / len(tokens)


class Scanner:
    """An index for each of SIZES; a template belongs to the first whose step is no less than its words."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float):
        longest = max((len(words_of(t.encode())) for _, t in templates), default=0)
        if longest > SIZES[-1][1]:
            raise ValueError(f"a template of {longest} words: the longest blocks take {SIZES[-1][1]}")
        size = lambda t: next(k for k, (_, step) in enumerate(SIZES) if len(words_of(t.encode())) <= step)
        self.sizes = [(block, step, Index([x for x in templates if size(x[1]) == k], counts, threshold)) for k, (block, step) in enumerate(SIZES)]

    def hits(self, words: list[bytes]) -> list[Hit]:
        """Every block's every template that meets the threshold."""
        out = []
        for block, step, index in self.sizes:
            if index.prefix.keys().isdisjoint(words):
                continue
            at = [i for i, w in enumerate(words) if w in index.prefix]
            for a, b in blocks_with(len(words), at, block, step):
                for k, share in index.hits(set(words[a:b])):
                    label, tokens, _ = index.templates[k]
                    out.append(Hit(label, round(share * len(tokens)), share, windows(words, index.tokens[k], a, b)))
        return out


class Hit:
    """A template's match in a block: how many tokens it shares, their part of the template, and where they stand (see `windows`)."""

    def __init__(self, label: str, shared: int, share: float, found: list[frozenset[int]]):
        self.label, self.shared, self.share = label, shared, share
        self.span = min(max(w) - min(w) for w in found)
        self.tight = [w for w in found if max(w) - min(w) == self.span]
        self.places = frozenset().union(*found)

    def better(self, other: Hit) -> bool:
        return (self.shared, self.share, -self.span) > (other.shared, other.share, -other.span)


def blocks_with(n: int, at: list[int], block: int, step: int) -> list[tuple[int, int]]:
    """The blocks (start, stop) of n words in a row (runs of `block` words, one every `step`) that hold one of the positions `at`."""
    if n <= block:
        return [(0, n)]
    starts = {s for i in at for s in range(max(0, (i - block) // step * step), i + 1, step) if s <= i < s + block and (s == 0 or s + step < n)}
    return [(s, min(n, s + block)) for s in sorted(starts)]


def windows(words: list[bytes], tokens: frozenset[bytes], start: int, stop: int) -> list[frozenset[int]]:
    """Where the tokens stand in each window of words[start:stop] that holds as many different ones as the whole, and no smaller such window."""
    at = [i for i in range(start, stop) if words[i] in tokens]
    need = len({words[i] for i in at})
    held: dict[bytes, int] = {}
    found, lo, last = [], 0, -1
    for hi, i in enumerate(at):
        held[words[i]] = held.get(words[i], 0) + 1
        while held[words[at[lo]]] > 1:
            held[words[at[lo]]] -= 1
            lo += 1
        if len(held) == need and lo > last:
            found.append(frozenset(at[lo : hi + 1]))
            last = lo
    return found


def rivals(hits: list[Hit]) -> dict[str, float]:
    """Label -> largest share of the hits that stay: one goes if over half of the words of each of its shortest windows are among those of a
    better hit, that is one that shares more tokens, or as many and a larger part of its template, or as large a part in fewer words."""
    by_place: dict[int, list[int]] = {}
    for k, h in enumerate(hits):
        for i in h.places:
            by_place.setdefault(i, []).append(k)
    found: dict[str, float] = {}
    for h in hits:
        if not all(any(2 * len(w & hits[k].places) > len(w) for k in {k for i in w for k in by_place[i]} if hits[k].better(h)) for w in h.tight):
            found[h.label] = max(found.get(h.label, 0.0), h.share)
    return found


def scan_text(text: str | None, scanner: Scanner) -> tuple[int, int, int | None, int | None, str, str, float]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    words = words_of((text or "").encode("utf-8", "surrogatepass"))
    found = rivals(scanner.hits(words))
    joined = b" " + b" ".join(words) + b" "
    base, places = set(), []
    for phrase, label in PHRASES.items():
        p = b" " + phrase.encode() + b" "
        at, done, n = joined.find(p), 0, 0
        while at >= 0:
            n += joined.count(b" ", done, at)
            done = at
            places.append(n)
            base.add(label)
            at = joined.find(p, at + 1)
    score = 1.0 if base else max(found.values(), default=0.0)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found.keys())), score


def _count(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = dict.fromkeys(vocabulary, 0)
        for b in batches:
            for t in b.column(0):
                for w in vocabulary.intersection(words_of((t.as_py() or "").encode("utf-8", "surrogatepass"))):
                    n[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n]), pa.array(list(n.values()), pa.int64())], ["token", "n"])

    return run


def token_counts(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """In how many texts of the corpus each template token occurs; as many rows as there are such tokens reach the driver."""
    vocabulary = frozenset(w for _, t in templates for w in words_of(t.encode()))
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count(vocabulary), "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r.token.encode(): r.n for r in rows}


def _scan(scanner: Scanner):
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan_text(t.as_py(), scanner) for t in b.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True))], names)

    return run


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs(doc_id, text): n_words, the base phrases' places and labels, all labels, and a score.

    labels adds to the base labels those of every template of which some block of the text's words, lines or not (32 words, one every 16, for
    templates of up to 16 words; 512 every 256 for those of up to 256), holds at least `threshold` of the distinct tokens,
    unless a better match accounts for the same words (see `rivals`). score: 1 with a base phrase, else the largest such share, else
    0. Null and empty texts have no words, no labels and null places; repeated rows are scanned each; an empty table gives no
    rows; other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    scanner = Scanner(templates, token_counts(docs, templates), threshold)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_scan(scanner), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    size = lambda t: next(k for k, (_, step) in enumerate(SIZES) if len(t.split()) <= step)
    templates = ", ".join(f"({n}, {size(text)}, '{label}', {quoted(sorted(set(text.split())))})" for n, (label, text) in enumerate(TEMPLATES))
    sizes = ", ".join(f"({k}, {block}, {step})" for k, (block, step) in enumerate(SIZES))
    phrases = ", ".join(f"('{label}', {quoted(phrase.split())})" for phrase, label in PHRASES.items())
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
with tpl(tid, size, label, toks) as (values {templates}), sz(size, block, step) as (values {sizes}), ph(label, p) as (values {phrases}),
w as materialized (select row_number() over () as doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{word}') as ws from documents),
places as (select doc, ph.label, i from w, ph, unnest(range(1, len(ws) + 1)) as r(i) where ws[i] = p[1] and list_slice(ws, i, i + len(p) - 1) = p),
b as (select doc, count(*) as n_base, min(i) - 1 as first_word, max(i) - 1 as last_word, string_agg(distinct label, ',' order by label) as base_labels, list(distinct label) as bl from places group by doc),
blocks as (select doc, size, ws, s, least(len(ws), s + block) as e, list_distinct(list_slice(ws, s + 1, s + block)) as held from w, sz, unnest(case when len(ws) <= block then [0] else range(0, len(ws) - step, step) end) as y(s)),
hit as materialized (select row_number() over () as hit, doc, label, toks, ws, s, e, len(list_intersect(held, toks)) as shared, len(list_intersect(held, toks)) / len(toks) as share
 from blocks join tpl using (size) where len(list_intersect(held, toks)) >= {THRESHOLD} * len(toks) - 1e-9),
pos as materialized (select hit, shared, i, ws[i + 1] as tok from hit, unnest(range(s, e)) as r(i) where list_contains(toks, ws[i + 1])),
nexts as (select a.hit, a.shared, a.i as lo, b.tok, min(b.i) as i from pos a join pos b on a.hit = b.hit and b.i >= a.i group by all),
wins as (select hit, lo, max(i) as hi from nexts group by hit, shared, lo having count(*) = shared),
least_wins as materialized (select *, min(hi - lo) over (partition by hit) as tight from (select *, lead(hi) over (partition by hit order by lo) as nx from wins) where nx is null or nx > hi),
held as materialized (select distinct hit, i from least_wins join pos using (hit) where i between lo and hi),
mine as materialized (select hit, lo, i, count(*) over (partition by hit, lo) as n from least_wins join pos using (hit) where hi - lo = tight and i between lo and hi),
spans as (select hit, doc, shared, share, min(tight) as span from hit join least_wins using (hit) group by all),
pairs as (select a.hit, b.hit as other from spans a join spans b on a.doc = b.doc and (b.shared > a.shared or b.shared = a.shared and (b.share > a.share or b.share = a.share and b.span < a.span))),
covered as (select mine.hit, lo from mine join pairs using (hit) join held on held.hit = pairs.other and held.i = mine.i group by mine.hit, lo, n, pairs.other having 2 * count(*) > n),
m as (select doc, list(distinct label) as ml, max(share) as share from hit where hit in (select hit from (select hit, lo from mine except select hit, lo from covered)) group by doc)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(ml, [])))), ',') as labels, (case when n_base > 0 then 1.0 else coalesce(share, 0.0) end)::double as score
from w left join b using (doc) left join m using (doc)
"""


SQL = _sql()
