"""Each operator against brute force on awkward rows, and on empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tscausal.llm import decontaminate, html, licenses, lm, mixing, quality, simhash, suffix, tokens, topk
from tscausal.llm.common import components
from tscausal.llm.gru import Gru

from .conftest import prose


def raw(row):
    return (row.text or "").encode()


def bag(rows):
    return Counter(map(tuple, rows))


# --- shared ---------------------------------------------------------------------------------------------------------


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(500, 560)] + [(-7, 999), (999, 999)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


# --- 1 --------------------------------------------------------------------------------------------------------------


def edit_brute(p, t):
    before = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        row = [i]
        for j, b in enumerate(t, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
        before = row
    return min(before)


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(150):
        p, t = (bytes(rng.choices(b"abc", k=rng.randint(1, 70))) for _ in range(2))
        assert decontaminate.edit_distance_in(p, t) == edit_brute(p, t)


@pytest.fixture(scope="module")
def leaks(spark, docs, texts):
    rng = random.Random(9)
    items = [(i, " ".join(texts[i].split()[3:38])) for i in range(5, 15)] + [(90, "too short"), (91, None), (None, texts[20]), (92, " ".join(texts[16].split()[:30]))]

    def edit(text, share):
        out = list(text)
        for _ in range(int(share * len(out))):
            k = rng.randrange(len(out))
            out[k : k + 1] = rng.choice(["", "q", out[k] + "z"])
        return "".join(out)

    more = [(1000 + i, f"before it {edit(t, 0.08).upper()} and after") for i, t in items[:10]]
    return spark.createDataFrame(items, "item_id long, text string"), docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))


def test_decontamination_finds_exact_and_edited_items_only(leaks):
    items, docs = leaks
    got = decontaminate.op1_decontaminate(docs, items).collect()
    known = {r.item_id: decontaminate.normal(r.text) for r in items.collect() if r.item_id is not None and r.text}
    want = Counter()
    for d in docs.collect():
        joined = decontaminate.normal(d.text)[:20_000]
        for i, t in known.items():
            if joined and edit_brute(t[:40], joined[:4000]) <= 16 and decontaminate.edit_distance_in(t, joined) <= 0.2 * len(t):
                want[d.doc_id, i] += 1
    assert Counter((r.doc_id, r.item_id) for r in got) == want
    assert sum(n for (d, _), n in want.items() if d is not None and d >= 1000) == 10


def test_decontamination_finds_nine_tenths_of_what_is_near_enough():
    rng, noise = random.Random(21), np.random.default_rng(4)
    items = [(i, prose(rng, rng.randint(4, 60))) for i in range(150)] + [(900, "ünïcödé" * 9), (901, "short item"), (902, "a")]
    matcher = decontaminate.Matcher(items)
    for kind in ("s", "i", "d", "sid"):
        for share in (0, 0.05, 0.1, 0.15, 0.19):
            texts = [decontaminate.normal(t) for _, t in items]
            planted = [decontaminate.edited(t, int(share * len(t)), noise, kind).decode("utf-8", "ignore") for t in texts]
            got = matcher.matches([f"{prose(rng, 90)} {p} {prose(rng, 60)}" for p in planted])
            near = [n for n, t in enumerate(texts) if len(t) >= 16 and decontaminate.edit_distance_in(t, decontaminate.normal(planted[n])) <= int(0.2 * len(t)) or share == 0]
            found = sum(any(m[0] == items[n][0] for m in got[n]) for n in near)
            assert found >= 0.9 * len(near), (kind, share, found, len(near))
    block = items[40][1].split()
    moved = " ".join([*block[:5], *prose(rng, len(block) // 8).split(), *block[5:]])  # a run of words inside
    assert any(m[0] == 40 for m in matcher.matches([moved])[0])


def test_decontamination_keeps_columns_of_clashing_names(spark, leaks):
    items, docs = leaks
    named = docs.withColumnsRenamed({"doc_id": "item_id"}).selectExpr("*", "1 AS edits", "'x' AS benchmark_matches")
    found = decontaminate.with_matches(named, items.selectExpr("*", "0 AS doc_id"), named.columns)
    assert found.columns == ["item_id", "text", "edits", "benchmark_matches"]
    plain = decontaminate.op1_decontaminate(docs, items).collect()
    assert bag((r.item_id, m.item_id, m.edits) for r in found.collect() for m in r.benchmark_matches) == bag((r.doc_id, r.item_id, r.edits) for r in plain)


def test_decontamination_in_blocks_and_empty(spark, leaks, none):
    items, docs = leaks
    one = decontaminate.op1_decontaminate(docs, items).collect()
    parts = decontaminate.with_matches(docs, items, ["doc_id"], block_bytes=400).where("size(benchmark_matches) > 0").collect()
    assert bag((r.doc_id, m.item_id, m.edits) for r in parts for m in r.benchmark_matches) == bag((r.doc_id, r.item_id, r.edits) for r in one)
    assert decontaminate.op1_decontaminate(none, items).count() == 0
    assert decontaminate.op1_decontaminate(docs, items.where("false")).count() == 0


# --- 2 --------------------------------------------------------------------------------------------------------------


def removed_brute(texts, length=400):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, dtype=np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i] += 1
                hit[i + length] -= 1
        gone = np.cumsum(hit)[: len(t)] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_arrays_in_lock_step():
    rng = random.Random(3)
    for _ in range(60):
        texts, buckets = [], []
        for b in range(rng.randint(1, 5)):
            for _ in range(rng.randint(1, 4)):
                texts.append(bytes(rng.choices(rng.choice([b"a", b"ab", b"abc", bytes(range(256))]), k=rng.randint(0, 30))))
                buckets.append(b)
        got, _ = suffix.suffix_arrays(texts, buckets)
        starts = np.cumsum([len(t) + 1 for t in texts]) - [len(t) for t in texts]
        want = []
        for b in sorted(set(buckets)):
            mine = [([c + 1 for c in t[i:]] + [0], k, int(starts[k]) + i) for k, t in enumerate(texts) if buckets[k] == b for i in range(len(t) + 1)]
            want += [x[2] for x in sorted(mine)]
        assert got.tolist() == want


@pytest.mark.parametrize("length", [150, 256, 340, 700])
def test_suffix_dedup_of_other_lengths(docs, length):
    rows = docs.collect()
    got = suffix.with_repeats_cut(docs.select("doc_id", "text"), length).collect()
    assert bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == bag((r.doc_id, *b) for r, b in zip(rows, removed_brute([raw(r) for r in rows], length)))


@pytest.mark.parametrize("many", [64, 0])
def test_suffix_dedup_matches_brute_force(docs, none, many, monkeypatch):
    plain = suffix.repeated_windows
    monkeypatch.setattr(suffix, "repeated_windows", lambda t, n, covered=None: plain(t, n, covered, many=many))
    rows = docs.collect()
    got = suffix.op2_suffix_dedup(docs).collect()
    assert bag(r[:5] for r in got) == bag((r.doc_id, *b) for r, b in zip(rows, removed_brute([raw(r) for r in rows])))
    # What is left holds no repeated passage, and nothing but repeated ones went.
    short = {r.doc_id: b for r, b in zip(rows, removed_brute([raw(r) for r in rows], suffix.PASSAGE))}
    left = [r.text.encode() for r in got]
    assert all(r.n_bytes - len(t) <= short[r.doc_id][1] + 8 and len(t) <= r.n_bytes - r.n_removed for r, t in zip(got, left))
    again = Counter(t[i : i + suffix.PASSAGE] for t in left for i in range(len(t) - suffix.PASSAGE + 1))
    assert max(again.values()) == 1
    assert sum(r.n_removed > 0 for r in got) > 6
    assert suffix.op2_suffix_dedup(none).count() == 0


# --- 3 --------------------------------------------------------------------------------------------------------------


def test_token_histogram(docs, none):
    import tiktoken

    encoding = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=tokens.load_ranks(), special_tokens={})
    lengths = [len(encoding.encode_ordinary(r.text or "")) for r in docs.collect()]
    table = tokens.op3_token_counts(docs)
    counts = Counter(lengths)
    want = {
        n: (c, sum(x >= n for x in lengths), sum(x for x in lengths if x >= n), pytest.approx(sum(x <= n for x in lengths) / len(lengths)), sum(min(x, n) for x in lengths), sum(max(x - n, 0) for x in lengths))
        for n, c in counts.items()
    }
    assert {r.length: tuple(r)[1:] for r in table.collect()} == want
    cut = {r.context: (r.kept, r.lost, r.docs_cut) for r in tokens.limits(table, [1, 100, 10**6], docs.sparkSession).collect()}
    assert cut == {n: (sum(min(x, n) for x in lengths), sum(max(x - n, 0) for x in lengths), sum(x > n for x in lengths)) for n in (1, 100, 10**6)}
    assert tokens.op3_token_counts(none).count() == 0


# --- 4 --------------------------------------------------------------------------------------------------------------


def targets_brute(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * sizes[s] + 1e-9}
        if not above:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(2 * sizes[s] for s in above)
        open_ -= above
    return target


def test_mixing_meets_targets(docs, none):
    rows, got = docs.collect(), mixing.mix(docs, bucket_rows=16).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(raw(r).split())
    want = targets_brute(sizes)
    assert bag((r.doc_id, r.source, len(raw(r).split())) for r in rows) == bag((r.doc_id, r.source, r.size) for r in got)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert bag(got) == bag(mixing.mix(docs.repartition(3), bucket_rows=16).collect())
    assert mixing.op4_mixing(none).count() == 0


def test_rounding_keeps_sums_and_expectations():
    random_, size = np.random.default_rng(1), np.array([5, 1, 9, 3, 7, 2])
    total = np.zeros(6)
    for _ in range(4000):
        p, held = mixing.settle(np.full(6, 0.3), size, random_)
        assert p @ size == pytest.approx(0.3 * size.sum()) and sum((0 < p) & (p < 1)) <= 1
        total += p
    assert np.abs(total / 4000 - 0.3).max() < 0.04


# --- 5 --------------------------------------------------------------------------------------------------------------


def test_top_k_is_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(1, 700)]
    rows += [(i, rows[3][1]) for i in range(700, 760)] + [(0, [0.0] * 8), (800, None), (900, [1.0, None]), (901, [float("nan")] * 8), (902, [float("inf")] * 8), (903, []), (904, [0.5]), (None, [1.0] * 8), (1000, [-0.5] * 8), rows[99], rows[149]]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    kept = [(r.vec_id, [math.floor(1024 * float(np.float32(x))) for x in r.embedding]) for r in table.collect() if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    assert sum(i == 100 for i, _ in kept) == 2  # a repeated query
    want = {}
    for q, v in kept:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in kept if i != q)[:10]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    got = topk.top_k(table, table.where("vec_id % 100 = 0"), block_rows=150, query_rows=3).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want
    assert topk.op5_topk(table.where("false")).count() == 0


# --- 6 --------------------------------------------------------------------------------------------------------------


def test_additive_model_learns_an_interaction():
    x = np.random.default_rng(0).random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs and ((model.score(x[3000:]) >= 0.5) == (y[3000:] > 0)).mean() > 0.95


def test_bounded_choice_of_rows(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    some = [r.doc_id for r in quality.least_hashed(rows, 300).collect()]
    assert 250 <= len(some) <= 300 and sorted(some) == sorted(r.doc_id for r in quality.least_hashed(rows.repartition(7), 300).collect())
    assert quality.least_hashed(rows, 5000).count() == 5000


def test_quality_on_held_out_rows(spark, none):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["the", "Cat", "sat", "on", "mats,", "today."], k=rng.randint(5, 60))) if i % 3 else " ".join(rng.choices(["BUY!!", "$$$", "##", "now!!"], k=rng.randint(5, 60)))) for i in range(900)]
    docs = spark.createDataFrame([*rows, (None, "x"), (5000, None), (5001, ""), rows[0]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(900)] + [(None, 1, 1), (5000, None, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.op6_quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    tested = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in tested) >= 0.98 * len(tested)
    # Labels of held-out rows change nothing.
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    assert {(r.doc_id, r.score) for r in quality.op6_quality(docs, flipped).collect()} == {(r.doc_id, r.score) for r in got}
    assert quality.op6_quality(none, labels).count() == 0
    assert {r.predicted for r in quality.op6_quality(docs, labels.where("false")).collect()} <= {0, 1}


# --- 7 --------------------------------------------------------------------------------------------------------------


def print_brute(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes(docs, none):
    rows = docs.collect()
    prints = [print_brute(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    got = simhash.op7_simhash(docs).collect()
    assert bag(got) == bag((r.doc_id, f"{p:016x}", least.get(find(i))) for i, (r, p) in enumerate(zip(rows, prints)))
    assert simhash.op7_simhash(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({find(i) for i in range(len(rows))})


def test_gray_index_finds_every_link(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = np.array(sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for b in base for _ in range(12)}), dtype=np.uint64)
    index = simhash.GrayIndex(np.zeros(len(prints), np.int64), prints)
    got = {(int(min(x, y)), int(max(x, y))) for a, b in index.links(2) for x, y in zip(index.prints[a], index.prints[b])}
    assert got == {(int(x), int(y)) for i, x in enumerate(prints) for y in prints[i + 1 :] if int(x ^ y).bit_count() <= 2}
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print long"))
    roots = {r.node: r.root for r in components(edges).collect()}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    assert all(roots[signed(a)] == roots[signed(b)] for a, b in got)


# --- 8 --------------------------------------------------------------------------------------------------------------


NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.""",
    "gpl": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.""",
    "bsd": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "epl": """This program and the accompanying materials
are made available under the terms of the Eclipse Public License v1.0
which accompanies this distribution.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0.""",
}


def license_docs(spark):
    texts = ["Some prose.\nReleased under the MIT License.\nMore prose.", "Licensed under the Apache License, Version 2.0.", "All rights reserved.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "He renewed his driving license last week.", "The license of this bar is old.", None, "", "licence " * 20_000, "MIT License\n\nCopyright (c) 2020 Someone"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(1, texts[1], "x", 1), (None, texts[2], None, None)]
    rows += [(100 + i, f"{'Title' if i % 2 else ''}\n\n{t}\n \n\nThe end.", "x", 1) for i, t in enumerate(NOTICES.values())]
    return spark.createDataFrame(rows, "doc_id long, text string, family string, line int")


def test_license_lines_and_paragraphs(spark, none):
    got = licenses.op8_licenses(license_docs(spark)).collect()
    single = [(0, 1, "mit", None), (1, 0, "apache", "2.0"), (1, 0, "apache", "2.0"), (2, 0, "reserved", None), (None, 0, "reserved", None), (3, 0, "gpl", "3"), (4, 0, "cc-by-nc", "4.0"), (10, 0, "mit", None)]
    assert bag((r.doc_id, r.line, r.family, r.version) for r in got if (r.doc_id or 0) < 100) == bag(single)
    # A wrapped notice is found once, as a paragraph or, where one line is enough, as a line.
    wrapped = {r.doc_id - 100: r for r in got if (r.doc_id or 0) >= 100}
    assert len(wrapped) == len(NOTICES) == sum((r.doc_id or 0) >= 100 for r in got)
    for i, (family, text) in enumerate(NOTICES.items()):
        r = wrapped[i]
        assert r.family == family and 2 <= r.line < 2 + len(text.splitlines())
        assert r.lines == 1 or (r.line, r.lines) == (2, len(text.splitlines()))
    assert all(r.probability >= 0.4 and r.similarity >= 0.8 for r in got)
    assert licenses.op8_licenses(none).count() == 0


def test_license_sql_finds_the_same(spark):
    import duckdb

    docs = license_docs(spark)
    documents = docs.toPandas()  # noqa: F841
    want = duckdb.sql("WITH documents AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM (SELECT * FROM documents)) SELECT * FROM (" + licenses.op8_sql().strip() + ")").fetchall()
    none_for = lambda x: None if x is None or x != x else x
    assert bag(licenses.op8_licenses(docs).collect()) == bag(tuple(none_for(x) for x in r) for r in want)


def test_license_templates_are_recognised_and_hold_needed_words(spark):
    words = set(licenses.needed())
    for text in (t for ts in licenses.TEMPLATES.values() for t in ts):
        pairs = set(zip(text.split(), text.split()[1:]))
        assert sum(not words & set(p) for p in pairs) < 0.8 * len(pairs)
    forms = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]
    got = {r.id: r.family for r in licenses.classify(spark.createDataFrame([(t, t) for _, t in forms], "id string, form string")).collect()}
    assert got == {t: f for f, t in forms}
    assert licenses.classify(spark.createDataFrame([(t, t) for t in licenses.OTHER], "id string, form string")).count() == 0


# --- 9 --------------------------------------------------------------------------------------------------------------


def test_gru_gradients():
    rng = np.random.default_rng(0)
    model = Gru(np.array([5.0, 4, 3, 2, 2, 1, 1]), hidden=4, size=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    h, y, grads = rng.normal(size=(6, 4)), np.array([0, 1, 2, 3, 6, 4]), {}
    _, dh = model.output(h, y, grads)
    for name, g in grads.items():
        at = tuple(rng.integers(s) for s in g.shape)
        loss = []
        for e in (1e-6, -1e-6):
            model.p[name][at] += e
            loss.append(-model.output(h, y)[0].mean())
            model.p[name][at] -= e
        assert (loss[0] - loss[1]) / 2e-6 == pytest.approx(g[at], rel=1e-4, abs=1e-9)


def test_gru_gradients_through_time():
    rng = np.random.default_rng(1)
    model = Gru(np.array([5.0, 4, 3, 2, 2, 1, 1]), hidden=4, size=3)
    model.p = {k: v.astype(np.float64) + rng.normal(0, 0.3, v.shape) for k, v in model.p.items()}
    x, y, start = rng.integers(0, 7, (6, 3)), rng.integers(0, 7, (6, 3)), rng.normal(size=(3, 4))

    def loss():
        h, out = start, []
        for t in range(6):
            h = model.step(x[t], h * (x[t] != 0)[:, None])[0]
            out.append(model.output(h, y[t])[0])
        return -np.mean(out)

    grads, last = model.slopes(x, y, start, 0)
    full = np.zeros_like(model.p["E"])
    full[grads.pop("rows")] = grads["E"]
    for name, g in (grads | {"E": full}).items():
        for _ in range(4):
            at = tuple(rng.integers(s) for s in g.shape)
            found = []
            for e in (1e-6, -1e-6):
                model.p[name][at] += e
                found.append(loss())
                model.p[name][at] -= e
            assert (found[0] - found[1]) / 2e-6 == pytest.approx(g[at], rel=1e-4, abs=1e-8), name


def test_gru_is_a_distribution_and_carries_state():
    model = Gru(np.array([5.0, 4, 3, 2, 1]), hidden=8, size=2)
    docs = [np.array([1, 2, 3] * 12 + [0]), np.array([0]), np.array([2, 2, 0])]
    assert model.train(docs * 40, end=0, streams=4, window=4) == 41 * 40
    h = np.random.default_rng(1).normal(size=(1, 8)).astype(np.float32)
    assert sum(math.exp(model.output(h, np.array([k]))[0][0]) for k in range(5)) == pytest.approx(1, abs=1e-5)
    assert model.score(docs, 0, window=5) == pytest.approx(model.score(docs, 0, window=1000), rel=1e-5)
    assert model.score(docs, 0)[0] / 36 > -0.7
    other = Gru(np.array([5.0, 4, 3, 2, 1]), hidden=8, size=2, seed=77)
    other.unpack(model.packed())
    assert other.score(docs, 0).tolist() == model.score(docs, 0).tolist()


def test_gru_scores_match_a_plain_loop():
    model = Gru(np.array([5.0, 4, 3, 2, 2, 1, 1]), hidden=5, size=3)
    docs = [np.array([1, 4, 6, 2, 0]), np.array([0]), np.array([3, 3, 3, 0])]

    def plain(doc):
        p, h, last, total = {k: v.astype(float) for k, v in model.p.items()}, np.zeros(5), 0, 0.0
        for y in doc:
            a, u = p["E"][last] + p["b"], h @ p["U"]
            z, r = 1 / (1 + np.exp(-a[:5] - u[:5])), 1 / (1 + np.exp(-a[5:10] - u[5:10]))
            h = (1 - z) * np.tanh(a[10:] + r * u[10:]) + z * h
            top, low = h @ p["Wc"] + p["bc"], h @ p["Wo"][y // 3] + p["bo"][y // 3]
            total += top[y // 3] - np.log(np.exp(top).sum()) + low[y % 3] - np.log(np.exp(low).sum())
            last = y
        return total

    assert model.score(docs, 0) == pytest.approx([plain(d) for d in docs], rel=1e-4)


def test_gru_computes_softmaxes_of_all_classes_together():
    """Per class only the products are left, so calls hardly grow with the classes; rows are reduced for all of them at once."""
    import cProfile
    import pstats

    calls = {}
    for classes in (4, 64):
        model = Gru(np.ones(classes * 8), hidden=4, size=8)
        rng = np.random.default_rng(3)
        h, y = rng.normal(size=(4096, 4)).astype(np.float32), rng.integers(0, classes * 8, 4096)
        profile = cProfile.Profile()
        profile.runcall(model.output, h, y, {})
        calls[classes] = pstats.Stats(profile).total_calls
    assert calls[64] - calls[4] < 60


def test_gru_probabilities_out_of_range_of_plain_exponentials():
    for scale in (1, 40, 400):
        model = Gru(np.array([5.0, 4, 3, 2, 2, 1, 1]), hidden=4, size=3)
        rng = np.random.default_rng(7)
        model.p = {k: (v + rng.normal(0, scale, v.shape)).astype(np.float32) for k, v in model.p.items()}
        h, y = rng.uniform(-1, 1, (200, 4)).astype(np.float32), rng.integers(0, 7, 200)
        p, want = {k: v.astype(float) for k, v in model.p.items()}, []
        for a, k in zip(h.astype(float), y):
            top, low = a @ p["Wc"] + p["bc"], a @ p["Wo"][k // 3] + p["bo"][k // 3]
            want.append(top[k // 3] - np.logaddexp.reduce(top) + low[k % 3] - np.logaddexp.reduce(low))
        grads = {}
        assert model.output(h, y, grads)[0] == pytest.approx(want, rel=1e-4, abs=1e-3)
        assert all(np.isfinite(v).all() for v in grads.values())


def test_gru_gates_lie_apart(monkeypatch):
    """What enters the cell lies in one piece for each gate, in training and in scoring; an index array laid it out row by row."""
    seen, cell = [], Gru.cell

    def watched(self, a, h, weights):
        seen.append(all(part.flags.c_contiguous for part in a))
        return cell(self, a, h, weights)

    monkeypatch.setattr(Gru, "cell", watched)
    model, docs = Gru(np.ones(40), hidden=4, size=8), [np.append(np.random.default_rng(k).integers(1, 40, 30), 0) for k in range(20)]
    model.train(docs, end=0, streams=8, window=4)
    trained = len(seen)
    model.score(docs, 0)
    assert 0 < trained < len(seen) and all(seen)


ODD_TEXTS = [
    None, b"", b" \t\n", b"The the THE, end. end.. end.!;", b" \t a!!!!!!!!!!!!b !!!!!!!!!!!! ,,;; . a. ", b"caf\xc3\xa9. \xe3\x80\x80 \xc2\xa0 \xff\xfe", b"x\x0by\x0cz\x1cq\x85 ", b"z",
    b"word " * 500 + b"rare" + b"." * 40,
]


def test_lm_reads_the_texts_of_a_batch_together():
    """No Python call for each token: symbols, sums and rare words of a batch are those of a plain loop."""
    texts = pa.array(ODD_TEXTS, pa.binary()).view(pa.string())
    words = [(t or b"").lower().split() for t in ODD_TEXTS]
    kinds = sorted({w for ws in words for w in ws})
    assert lm.classes_of(pa.array(kinds, pa.binary())).tolist() == [lm.class_of(w) for w in kinds]
    for frequent in ([(b"the", 9), (b"word", 7), (b"a.", 3)], []):
        symbols = lm.Symbols(frequent, 2, np.full(lm.CLASSES, 0.5), 4, 100, 20)
        number = lambda w: symbols.words[w] if w in symbols.words else symbols.classes[lm.class_of(w)]  # noqa: B023, E731
        base = {w: math.log10((c + 0.5) / symbols.total) for w, c in frequent}
        got, codes = symbols.read(texts), [[*map(number, ws), symbols.end] for ws in words]
        assert [np.frombuffer(x, "<u2").tolist() for x in got["codes"].to_pylist()] == codes and got["n_tokens"].tolist() == [len(c) for c in codes]
        assert got["known"].tolist() == [sum(w in base for w in ws) + 1 for ws in words]
        assert got["base"] == pytest.approx([sum(base.get(w, 0) for w in ws) + symbols.end_base for ws in words])
        assert got["plain"] == pytest.approx([symbols.log_base[c].sum() for c in codes])
        rare = list(zip(got["rare"][0].tolist(), got["rare"][1].to_pylist(), got["rare"][2].tolist()))
        assert sorted(rare) == sorted((i, w, n) for i, ws in enumerate(words) for w, n in Counter(ws).items() if w not in base)
        assert symbols.read(texts.slice(0, 0))["n_tokens"].tolist() == []


def test_lm_averages_in_a_tree(spark):
    rows = [(n, np.full(3, v, "<f4").tobytes()) for n, v in ((1, 1.0), (2, 4.0), (3, 7.0), (4, 2.0))]
    models = spark.createDataFrame(rows, "tokens long, flat binary").repartition(4)
    for fan, most in ((2, 1), (16, 8)):
        assert lm._averaged(models, fan, most) == pytest.approx([3.8] * 3)


def test_lm_scores(docs, none):
    rows, got = docs.collect(), lm.model_scores(docs, frequent_words=50, own_symbols=30).collect()
    held = lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1
    words = lambda r: [*raw(r).lower().split(), "end"]
    counts = Counter(w for r in rows if not held(r) for w in words(r))
    n, z = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    want = Counter((r.doc_id, held(r), len(words(r)), sum(counts[w] > 0 for w in words(r)), n, round(sum(math.log10((counts[w] + 0.5) / z) for w in words(r)), 4)) for r in rows)
    assert Counter((*tuple(r)[:5], round(r.base_score, 4)) for r in got) == want
    assert sum(r.score for r in got) > sum(r.base_score for r in got) and all(r.score <= 0 for r in got)
    assert lm.op9_lm(none).count() == 0


# --- 10 -------------------------------------------------------------------------------------------------------------


PAGES = [
    ("<html><head><title>t</title></head><body><nav><ul><li>a</li></ul></nav><article><h1>T &amp; u</h1><p>one<b>two</b>\n three<p>four<br>five<script>if (a < b) {}</script></article><footer>f</footer>", "T & u\nonetwo three\nfour five"),
    ("<article><header><h1>Head</h1><span>by me</span></header><p>one<aside>ad</aside>two</p><section class='comments'><p>no</p></section></article>", "Head\none\ntwo"),
    ("<div class=\"site-header\">X</div><div id=content><p>a &lt;b&gt; &#233;</p><ul><li>x<li>y</ul></div><form>f</form>", "a <b> é\nx\ny"),
    ("plain only", "plain only"),
    ("<p>&<b>amp;</b> &lt<i>gt;</i></p>", "&amp; <gt;"),
    ("<p>broken <i>markup <p>goes <div class=ad>buy</div>on</p", "broken markup\ngoes\non"),
    ("", ""),
    (None, ""),
    ("<article>" + "<p>word</p>" * 20_000 + "</article>", "\n".join(["word"] * 20_000)),
]


def test_html_main_text(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.example.com/x", h, "t", 1) for i, (h, _) in enumerate(PAGES)] + [(None, None, None, None, None), (1, "http://h1.example.com/x", PAGES[1][0], "t", 1)], "page_id long, url string, html string, text string, salt int")
    got = html.op10_html(pages).collect()
    assert bag((r.page_id, r.text, r.n_chars) for r in got) == bag([(i, t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(None, "", 0), (1, PAGES[1][1], len(PAGES[1][1]))])
    assert html.op10_html(pages.where("false")).count() == 0


def test_html_templates_go_but_shared_paragraphs_stay(spark):
    box = "<div class=x7><p>Follow our daily letter</p></div>"
    same = "<p>This passage stands in many articles.</p>"
    rows = [(i, f"https://www.example.org/{i}?q", f"<body>{box}<h2>Title {i}</h2><p>Body of {i}.</p></body>") for i in range(12)]
    rows += [(100 + i, f"https://b.example.org/{i}", f"<body>{box}<article><p>Number {i}</p>{same}</article></body>") for i in range(12)]
    rows += [(200 + i, "https://c.example.org/", f"<body>{box}<p>one page, copied</p></body>") for i in range(12)]
    got = {r.page_id: r.text for r in html.op10_html(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 3\nBody of 3." and got[105] == "Number 5\nThis passage stands in many articles."
    assert got[200] == "Follow our daily letter\none page, copied"  # twelve copies are one page


def test_html_templates_of_a_large_host_need_no_share(spark):
    """Neutral markup on 8 of 400 pages of a host goes; what stands on 4 pages, or on 8 pages of other hosts, stays."""
    box, rare = "<div class=x7><p>Rotating word of the week</p></div>", "<div class=x8><p>On four pages</p></div>"
    rows = [(i, f"https://big.example.org/{i}", f"<body>{box if i < 8 else ''}{rare if i % 100 == 0 else ''}<h2>Title {i}</h2></body>") for i in range(400)]
    rows += [(1000 + i, f"https://h{i}.example.org/", f"<body>{box}<h2>Other {i}</h2></body>") for i in range(8)]
    got = {r.page_id: r.text for r in html.op10_html(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 3" and got[0] == "On four pages\nTitle 0" and got[399] == "Title 399"
    assert got[1002] == "Rotating word of the week\nOther 2"


def test_html_templates_work_without_names(spark):
    """Menus whose links change, boxes in the article and footers go by their counts alone; what decides is the surroundings."""
    menu = "<div><ul><li><a href='/{i}'>News</a></li><li><a href='/x{i}'>Sport</a></li></ul></div>"
    box = "<div><span id=b{i}>Read on in our app</span></div>"
    rows = [(i, f"https://a.example.org/{i}", f"<body>{menu}<article><p>Text {i}</p>{box}<p>More {i}</p></article><section>Imprint</section></body>".replace("{i}", str(i))) for i in range(9)]
    rows += [(100 + i, f"https://b.example.org/{i}", f"<body><article><div><p>The same article</p></div></article><i>{i}</i></body>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages, names=False).collect()}
    assert all(got[i] == f"Text {i}\nMore {i}" for i in range(9)) and got[103] == "The same article\n3"
    kept = {r.page_id: r.text for r in html.extract(pages, min_pages=100, names=False).collect()}
    assert kept[3] == "News\nSport\nText 3\nRead on in our app\nMore 3\nImprint"
    named = {r.page_id: r.text for r in html.op10_html(pages).collect()}
    assert named[3] == "Text 3\nMore 3" and named[103] == "The same article"


def test_html_subtrees_match_a_plain_count(spark):
    rng = random.Random(8)
    parts = [f"<div><p>{prose(rng, 3)}</p></div>" for _ in range(6)]
    rows = [(i, "https://a.example.org/", "<body>" + "".join(rng.sample(parts, rng.randint(0, 4))) + f"<article><p>{prose(rng, 5)}</p></article></body>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(sum(p in h for _, _, h in rows) for p in parts)
    found = html.subtrees(pages)
    counts = sorted(r["count"] for r in found.select("subtree", "around").distinct().groupBy("subtree").count().collect())
    assert counts == sorted(want * 2)  # each box and the paragraph in it
    assert html.templates(found, 12).count() == 2 * sum(n >= 12 for n in want)
