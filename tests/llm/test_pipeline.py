"""The corpus pipeline against plain versions of its stages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tscausal.llm import decontaminate, shingles

from .conftest import prose
from .test_operators import print_brute, removed_brute


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    good = [prose(rng, rng.randint(40, 150)).capitalize() + "." for _ in range(200)]
    junk = [" ".join(w.upper() + "!!" for w in prose(rng, 80).split()) for _ in range(60)]
    item, passage = prose(rng, 35), prose(rng, 110)
    good += [good[0], good[1], prose(rng, 60) + " " + item, passage + " " + prose(rng, 50), prose(rng, 50) + " " + passage]
    rows = [(i, t, "en", "abc"[i % 3], len(t), None, "k") for i, t in enumerate(good + junk)] + [(None, None, None, None, None, None, None)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int, _score string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < len(good)), 0) for i in range(len(good) + len(junk))], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), len(good), item


def test_stages(spark, corpus):
    folder, n_good, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    kept = stages["quality"](spark, docs, folder)
    rows = kept.collect()
    assert kept.columns == columns and {r.doc_id for r in rows} - {None} == set(range(n_good))

    unique = stages["simhash"](spark, kept, folder)
    prints = {r.doc_id: print_brute(r.text) for r in rows}
    want = {i for i in prints if i is not None and not any(j is not None and j < i and (prints[i] ^ prints[j]).bit_count() <= 2 for j in prints)}
    got = unique.collect()
    assert unique.columns == columns and {r.doc_id for r in got} - {None} == want

    cut = stages["suffix"](spark, unique, folder)
    after = {r.doc_id: r for r in cut.collect()}
    for r, (size, removed, _, _) in zip(got, removed_brute([(r.text or "").encode() for r in got], corpus_pipeline.REPEAT)):
        if removed == 0 or removed < size:
            assert len((after[r.doc_id].text or "").encode()) == size - removed
    assert cut.columns == columns and sum(after[r.doc_id].text != r.text for r in got if r.doc_id in after) == 2

    clean = stages["decontaminate"](spark, cut, folder)
    leaked = {i for i, r in after.items() if decontaminate.normal(item) in decontaminate.normal(r.text)}
    assert leaked == {n_good - 3} and {r.doc_id for r in clean.collect()} == set(after) - leaked

    mixed = stages["mix"](spark, clean, folder).collect()
    assert all(0 < r.taken <= 2 * r.size and r.size == len(r.text.encode().split()) for r in mixed)
    for source in "abc":
        assert abs(sum(r.taken for r in mixed if r.source == source) - next(r.target for r in mixed if r.source == source)) <= 1


def test_run_and_empty(spark, corpus, tmp_path):
    folder, _, _ = corpus
    assert corpus_pipeline.run(spark, folder).count() > 100
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(5)
    texts = []

    def edited(words, n):
        words = list(words)
        for i in rng.sample(range(len(words)), n):
            words[i] = "new" + str(rng.random())
        return " ".join(words)

    for n in range(40):  # one to six changed words of 150 reach 0.8 or not
        words = prose(rng, 150).split()
        texts += [" ".join(words), edited(words, 1 + n % 3), edited(words, 6)]
    hot = prose(rng, 200).split()
    texts += [edited(hot, 1) for _ in range(30)] + [None, "", " \n", "one", "One ", "two words"]
    docs = spark.createDataFrame([(len(texts) - i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, row int").repartition(3)
    raw = [(t or "").encode() for t in texts]
    root = list(range(len(raw)))
    for i in range(len(raw)):
        for j in range(i):
            if root[i] != root[j] and shingles.similarity(raw[i], raw[j]) >= 0.8:
                root = [root[j] if r == root[i] else r for r in root]
    want = {min(len(texts) - i for i in range(len(raw)) if root[i] == r) for r in set(root)}
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want
    assert shingles.similarity(b"a b c d e f", b"a b c d e g") == 1 / 3


def test_no_similar_pair_is_lost(spark):
    """Pairs at just 0.8 that twenty bands of five least hashes don't let meet, and whose fingerprints are 6 to 9 bits apart."""
    rows = []
    for i in (4182, 7448, 9087, 10810):
        words = [f"w{i}x{j}" for j in range(14)]
        rows += [(len(rows), " ".join(words[:12])), (len(rows) + 1, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {0, 2, 4, 6}


def test_prefixes_of_similar_texts_meet():
    rng = random.Random(3)
    for _ in range(3000):
        n = rng.randint(1, 80)
        common = rng.sample(range(1 << 40), n)
        x, y = (common + rng.sample(range(1 << 40), rng.randint(0, n // 4)) for _ in range(2))
        if len(set(x) & set(y)) < 0.8 * len(set(x) | set(y)):
            continue
        x, y = sorted(set(x)), sorted(set(y))
        (a, a_keys), (b, b_keys) = shingles.prefix_sizes(len(x)), shingles.prefix_sizes(len(y))
        assert set(x[:a_keys]) & set(y[:b_keys])
        assert len(set(x[:a]) & set(y[:b])) >= max(shingles.needed(len(x)), shingles.needed(len(y)))


def test_edited_copies_meet_once_and_few_are_compared(spark, monkeypatch):
    """Copies with one of some hundred edits in up to eight places: all meet at dozens of keys, few are similar beyond their top."""
    rng = random.Random(8)
    main = prose(rng, 200).split()
    texts = [" ".join(main)]
    for i in range(160):
        gone = set(rng.sample(range(100), 3 + i % 6))
        texts.append(" ".join(w for j, w in enumerate(main) if j % 2 or j // 2 not in gone))
    raw = [t.encode() for t in texts]
    root = list(range(len(raw)))
    for i in range(len(raw)):
        for j in range(i):
            if root[i] != root[j] and shingles.similarity(raw[i], raw[j]) >= 0.8:
                root = [root[j] if r == root[i] else r for r in root]
    compared, judged = [], shingles.judged
    monkeypatch.setattr(shingles, "judged", lambda pairs, *rest: compared.append(pairs.count()) or judged(pairs, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {min(i for i in range(len(raw)) if root[i] == r) for r in set(root)}
    assert len(set(root)) > 10 and compared[1] < 2 * len(texts)


def test_sketches_never_differ_more_than_the_texts(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        n = rng.choice((5, 200, 256, 270, 1100))
        common, x, y = ({rng.getrandbits(64) for _ in range(k)} for k in (n, rng.randint(0, n // 8 + 1), rng.randint(0, n // 8 + 1)))
        a, b = (shingles.sketch(np.array(sorted(common | z), dtype="<u8")) for z in (x, y))
        rows.append((len(x ^ y), a.tolist(), b.tolist()))
    pairs = spark.createDataFrame(rows, "most int, a array<long>, b array<long>")
    got = pairs.select("most", shingles.different(pairs.a, pairs.b).alias("n"), (F.size("a") != F.size("b")).alias("folded")).collect()
    assert all(0.6 * r.most <= r.n <= r.most for r in got) and any(r.folded for r in got)
