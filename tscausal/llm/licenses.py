"""License scans: a trained paragraph classifier, confirmed by comparison with templates. DataFrame functions only.

Training (on the driver, from the notices below and ordinary sentences) fits a multinomial logistic regression over
the presence of word 1- to 3-grams, with an unknown class; a temperature calibrates its probabilities on notices that
the regressions of six folds never saw. What is scanned are the lines of a text, and its paragraphs of several lines: a
notice that is wrapped, in a comment frame or not, is whole only there. Scoring is relational: units are reduced to
their different normal forms, these to n-grams, and the n-grams meet the weights and the templates in joins with small
tables. A family is reported if it is the likeliest, beats the unknown class with the probability asked for, and a
template of that family agrees.

A unit that agrees with a template must hold one of some words of it; these follow from the templates (``needed``), and
units without any of them are left out at once. That drops nothing that could be reported.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, release

# The notices that the public licences ask for or open with, in normal form (digits as 0).
TEMPLATES = {
    "mit": [
        "mit license",
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "spdx license identifier mit",
    ],
    "apache": [
        "licensed under the apache license version 0 0",
        "apache license version 0 0 january 0",
        "you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "spdx license identifier apache 0 0",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "licensed under the bsd license",
        "released under the bsd 0 clause license",
        "spdx license identifier bsd 0 clause",
    ],
    "gpl": [
        "licensed under the gnu general public license version 0",
        "it under the terms of the gnu general public license as published by the free software foundation",
        "you should have received a copy of the gnu general public license",
        "gnu general public license version 0",
        "spdx license identifier gpl 0 0",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license version 0",
        "it under the terms of the gnu lesser general public license as published by the free software foundation",
        "gnu lesser general public license version 0",
        "spdx license identifier lgpl 0 0",
    ],
    "agpl": [
        "licensed under the gnu affero general public license version 0",
        "it under the terms of the gnu affero general public license as published by the free software foundation",
        "gnu affero general public license version 0",
        "spdx license identifier agpl 0 0",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 0 0",
        "licensed under the mozilla public license version 0 0",
        "mozilla public license version 0 0",
        "spdx license identifier mpl 0 0",
    ],
    "isc": [
        "isc license",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "licensed under the isc license",
        "spdx license identifier isc",
    ],
    "epl": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license v 0 0",
        "licensed under the eclipse public license version 0 0",
        "eclipse public license version 0 0",
        "spdx license identifier epl 0 0",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose",
        "spdx license identifier unlicense",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "licensed under the zlib license",
        "spdx license identifier zlib",
    ],
    "cc-by": ["licensed under cc by 0 0", "licensed under a creative commons attribution 0 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 0 0", "licensed under a creative commons attribution sharealike 0 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 0 0", "licensed under a creative commons attribution noncommercial 0 0 international license"],
    "cc-by-nd": ["licensed under cc by nd 0 0", "licensed under a creative commons attribution noderivatives 0 0 international license"],
    "cc0": ["dedicated to the public domain under cc0", "licensed under cc0 0 0", "cc0 0 0 universal public domain dedication"],
    "reserved": ["all rights reserved", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential"],
}
#: Ordinary sentences, some with the words of licences.
OTHER = """she renewed her driving license last week and paid the fee
the shop lost its license to sell alcohol in may
a license plate was found under the bridge
the teacher gave permission to leave early without any restriction
copies of the report are distributed to the public every year
the general public was free to visit the foundation
the software is distributed on a disk with the following documentation
all seats are reserved for the members of the club
the rights of the worker are protected by applicable law
the copyright of the song was sold to a larger publisher
a version of this work is shown in the national museum
the apache lived in the south and moved with the seasons
he studied at mit and wrote a paper on free will
the following conditions are met before the bridge is opened
creative work is common in this school and needs attribution
you may not use this door except in an emergency
the file was modified and published under a different name
the court decided that the notice shall be included in the contract
fishing is permitted provided that the permit is carried
public transport is free of charge for any person over seventy
the domain was dedicated to the goddess of the harvest
the source of the river lies under the high mountain
patients should have received a copy of the letter by now
weather was mild and the harvest good in most of the valleys
the warranty of the car ended two years ago
he is a person of substantial means and has a large portion of land
the universal answer is not known to science
in writing and in speech the form is subject to change
binary stars move around each other in long orbits
the identifier on the box was hard to read""".splitlines()
UNKNOWN = "unknown"
#: A line without a letter or digit of ASCII ends a paragraph.
BLANK = "\\n(?:[^A-Za-z0-9\\n]*\\n)+"


def needed(agreement: float = 0.8) -> list[str]:
    """Words of which a text must hold one to share ``agreement`` of the word pairs of any template."""
    plain, chosen = " ".join(OTHER).split(), set()
    for text in (t for ts in TEMPLATES.values() for t in ts):
        words = text.split()
        pairs = set(zip(words, words[1:]))
        left = [p for p in pairs if not chosen & set(p)]
        for word in sorted(set(words) - {"0"}, key=lambda w: (plain.count(w), -len(w), w)):
            if len(left) < agreement * len(pairs):
                break
            chosen.add(word)
            left = [p for p in left if word not in p]
    return sorted(chosen)


def pattern(agreement: float = 0.8) -> str:
    return "(?i)(?:^|[^a-z0-9])(?:" + "|".join(needed(agreement)) + ")(?:[^a-z0-9]|$)"


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def _rows(random: np.random.Generator, samples: int, chosen: Callable[[int], bool]) -> list[tuple[list[str], int]]:
    """Notices of the templates whose number in their family is ``chosen``, in varied surroundings, with the number of the family, and other text."""
    lead = ["this work is", "the code is", "this file is", "unless noted otherwise this text is", "copyright 0 the authors", "c 0"]
    plain = [s.split() for i, s in enumerate(OTHER) if chosen(i)]
    licence_words = [w for ts in TEMPLATES.values() for t in ts for w in t.split()]
    rows: list[tuple[list[str], int]] = []
    for k, family in enumerate((*TEMPLATES, UNKNOWN)):
        texts = [t for i, t in enumerate(TEMPLATES.get(family, ())) if chosen(i)]
        if family != UNKNOWN and not texts:
            continue
        for _ in range(samples if family != UNKNOWN else 6 * samples):
            if family == UNKNOWN:
                words = list(plain[random.integers(len(plain))])
                if random.random() < 0.5:  # words of licences in no order of a licence
                    words += [licence_words[i] for i in random.integers(len(licence_words), size=random.integers(1, 5))]
                    random.shuffle(words)
            else:
                words = texts[random.integers(len(texts))].split()
                if len(words) > 8 and random.random() < 0.3:
                    at = random.integers(len(words))
                    words = words[:at] + words[at + 1 :]
                if random.random() < 0.5:
                    words = lead[random.integers(len(lead))].split() + words
                if random.random() < 0.4:
                    words = words + plain[random.integers(len(plain))]
            rows.append((words, k))
    return rows


def _fit(rows: list[tuple[list[str], int]], epochs: int, ridge: float, least: float) -> tuple[dict[str, tuple[float, ...]], tuple[float, ...]]:
    """Weights of the n-grams and biases of a multinomial logistic regression over their presence, by Adagrad."""
    names = sorted({g for w, _ in rows for g in grams_of(w)})
    place = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1), dtype=np.float32)
    x[:, -1] = 1
    for r, (words, _) in zip(x, rows):
        r[[place[g] for g in grams_of(words)]] = 1
    y = np.eye(len(TEMPLATES) + 1, dtype=np.float32)[[k for _, k in rows]]
    w = np.zeros((x.shape[1], y.shape[1]), dtype=np.float32)
    x /= np.sqrt(x.sum(axis=1, keepdims=True))  # long and short notices weigh alike in training
    memory = np.full_like(w, 1e-6)
    for _ in range(epochs):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (p - y) / len(y) + ridge * w
        memory += g * g
        w -= 0.3 * g / np.sqrt(memory)
    weights = {g: tuple(round(float(v), 4) if abs(v) >= least else 0.0 for v in w[i]) for g, i in place.items() if np.abs(w[i]).max() >= least}
    return weights, tuple(round(float(v), 4) for v in w[-1])


@lru_cache(maxsize=4)
def train(samples: int = 60, seed: int = 3, epochs: int = 150, ridge: float = 3e-5, least: float = 0.05, folds: int = 6) -> tuple[tuple[str, ...], dict[str, tuple[float, ...]], tuple[float, ...], float]:
    """Families (unknown last), weights of each n-gram, biases, and the temperature from notices of templates held out."""
    families, random = (*TEMPLATES, UNKNOWN), np.random.default_rng(seed)
    none, z, t = (0.0,) * len(families), [], []
    for fold in range(folds):
        weights, bias = _fit(_rows(random, samples // 2, lambda i: i % folds != fold), epochs, ridge, least)  # noqa: B023
        for words, k in _rows(random, samples // 6, lambda i: i % folds == fold):  # noqa: B023
            z.append(np.sum([bias, *(weights.get(g, none) for g in sorted(grams_of(words)))], axis=0))
            t.append(k)
    z, t = np.array(z), np.array(t)

    def loss(temperature: float) -> float:
        s = z / temperature
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(t)), t] - np.log(np.exp(s).sum(axis=1))).mean())

    weights, bias = _fit(_rows(random, samples, lambda i: True), epochs, ridge, least)
    return families, weights, bias, min((round(0.1 * k, 1) for k in range(2, 101)), key=loss)


def _local(spark: SparkSession, rows: list[dict], shape: str) -> DataFrame:
    """A small table of constants."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{shape}>>")).alias("r")).select("r.*")


def weight_rows() -> list[dict]:
    families, weights, _, _ = train()
    return [{"gram": g, "family": f, "w": v} for g, vs in weights.items() for f, v in zip(families, vs) if v]


def template_rows() -> list[dict]:
    out, number = [], 0
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = text.split()
            pairs = sorted({" ".join(p) for p in zip(words, words[1:])})
            out += [{"gram": p, "family": family, "template": number, "size": len(pairs)} for p in pairs]
            number += 1
    return out


def normal(text: Column) -> Column:
    """ASCII letters lower-cased, numbers as 0, words by single spaces."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(F.regexp_replace(low, "[0-9]+", "0"), "[^a-z0-9]+", " "))


def classify(units: DataFrame, probability: float = 0.4, agreement: float = 0.8) -> DataFrame:
    """(id, family, probability, similarity) for those of ``units`` (id, form: different normal forms) that are notices.

    Of families that are equally likely the last by name counts.
    """
    spark = units.sparkSession
    families, _, bias, temperature = train()
    # Both tables are constants of the model: some thousand rows, whatever the input.
    weights = F.broadcast(_local(spark, weight_rows(), "gram string, family string, w double"))
    patterns = F.broadcast(_local(spark, template_rows(), "gram string, family string, template int, size int"))
    words = F.split("form", " ")
    n = F.size(words)
    pair = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    triple = F.zip_with(F.slice(pair, F.lit(1), F.greatest(n - 2, F.lit(0))), F.slice(words, F.lit(3), F.greatest(n - 2, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    grams = units.select("id", F.explode(F.array_distinct(F.concat(words, pair, triple))).alias("gram"))
    sums = grams.join(weights, "gram").groupBy("id").pivot("family", list(families)).agg(F.sum("w"))
    scores = [((F.coalesce(F.col(f"`{f}`"), F.lit(0.0)) + F.lit(b)) / temperature).alias(f) for f, b in zip(families, bias)]
    scored = sums.select("id", F.array(*(F.struct(s.alias("z"), F.lit(f).alias("family")) for s, f in zip(scores, families))).alias("z"))
    best = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda a, s: a + F.exp(s["z"] - best["z"]))
    likely = scored.select("id", best["family"].alias("family"), (1 / total).alias("probability")).where((F.col("family") != UNKNOWN) & (F.col("probability") >= probability))
    hits = grams.join(patterns, "gram").groupBy("id", "family", "template").agg((F.count("*") / F.first("size")).alias("part"))
    close = hits.groupBy("id", "family").agg(F.max("part").alias("similarity")).where(F.col("similarity") >= agreement)
    return likely.join(close, ["id", "family"])


def units_of(docs: DataFrame, agreement: float = 0.8) -> DataFrame:
    """(doc_id, source, line, lines, unit, form) of the lines, and of the paragraphs of several lines, that hold a needed word; ``source`` tells texts apart."""
    words = pattern(agreement)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(words)).withColumn("source", F.md5("text"))
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "unit")).where(F.col("unit").rlike(words)).select("doc_id", "source", "line", F.lit(1).alias("lines"), "unit")
    # Each paragraph keeps the blank lines behind it, so that line numbers follow from what stands before.
    parts = F.split(F.regexp_replace("text", BLANK, "$0\u0001"), "\u0001")
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    numbered = F.transform("parts", lambda p, i: F.struct(i.alias("i"), F.regexp_replace(p, "[^A-Za-z0-9]+$", "").alias("unit")))
    kept = F.filter(numbered, lambda x: x["unit"].contains("\n") & x["unit"].rlike(words))
    placed = F.transform(kept, lambda x: F.struct(newlines(F.array_join(F.slice("parts", F.lit(1), x["i"]), "")).cast("int").alias("line"), (newlines(x["unit"]) + 1).cast("int").alias("lines"), x["unit"].alias("unit")))
    wrapped = docs.where(F.col("text").contains("\n")).select("doc_id", "source", parts.alias("parts")).select("doc_id", "source", F.explode(placed).alias("p")).select("doc_id", "source", "p.line", "p.lines", "p.unit")
    return lines.union(wrapped).withColumn("form", normal(F.col("unit")))


def scan(docs: DataFrame, probability: float = 0.4, agreement: float = 0.8) -> DataFrame:
    """(doc_id, line, lines, family, version, probability, similarity): the licence notices among the lines and paragraphs of each text.

    Lines are numbered from 0; ``lines`` is their number, 1 or that of a paragraph, which is reported for a family only
    if none of its lines is. Null and empty texts have none, very long ones are read whole. Repeated rows each report
    theirs; a form that occurs often is classified once.
    """
    units = durable(units_of(docs, agreement).withColumn("id", F.md5("form")))
    found = durable(classify(units.groupBy("id").agg(F.first("form").alias("form")), probability, agreement))
    number = F.regexp_extract("unit", r"(?i)(?:version|v\.?|apache|gpl|mpl|by|nc|sa|nd|attribution|noncommercial|sharealike|noderivatives)[ -]*([0-9]+(?:\.[0-9]+)*)", 1)
    met = durable(units.join(found, "id").select("doc_id", "source", "line", "lines", "family", F.nullif(number, F.lit("")).alias("version"), F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity")))
    release(units, found)
    single = met.where("lines = 1").select(F.col("source").alias("s"), F.col("family").alias("f"), F.col("line").alias("at")).distinct()
    inside = (F.col("source") == F.col("s")) & (F.col("family") == F.col("f")) & (F.col("at") >= F.col("line")) & (F.col("at") < F.col("line") + F.col("lines"))
    return met.where("lines = 1").union(met.where("lines > 1").join(single, inside, "left_anti")).drop("source")


def op8_licenses(docs: DataFrame) -> DataFrame:
    """``scan`` with production parameters."""
    return scan(docs)


def op8_sql() -> str:
    """The same scan for DuckDB; weights and templates stand in it as constants."""
    families, _, bias, temperature = train()
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    values = lambda rows: ", ".join("(" + ", ".join(map(quote, r.values())) + ")" for r in rows)
    return f"""
WITH weights(gram, family, w) AS (VALUES {values(weight_rows())}),
patterns(gram, family, template, size) AS (VALUES {values(template_rows())}),
biases(family, b) AS (VALUES {values([{"f": f, "b": b} for f, b in zip(families, bias)])}),
split_lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
parts AS (SELECT doc_id, text, string_split(regexp_replace(text, '{BLANK}', '\\0' || chr(1), 'g'), chr(1)) AS parts FROM documents WHERE contains(text, chr(10))),
paragraphs AS (
  SELECT doc_id, text, line, length(unit) - length(replace(unit, chr(10), '')) + 1 AS lines, unit FROM (
    SELECT doc_id, text, regexp_replace(parts[i], '[^A-Za-z0-9]+$', '') AS unit, length(array_to_string(parts[1 : i - 1], '')) - length(replace(array_to_string(parts[1 : i - 1], ''), chr(10), '')) AS line
    FROM (SELECT doc_id, text, parts, unnest(range(1, len(parts) + 1)) AS i FROM parts)
  ) WHERE contains(unit, chr(10))
), units AS (
  SELECT *, trim(regexp_replace(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[^a-z0-9]+', ' ', 'g')) AS form FROM (
    SELECT doc_id, text, line, 1 AS lines, unit FROM split_lines UNION ALL SELECT * FROM paragraphs
  ) WHERE regexp_matches(unit, '{pattern()}')
), words AS (SELECT DISTINCT form, string_split(form, ' ') AS w FROM units),
starts AS (SELECT form, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
  SELECT DISTINCT form, array_to_string(w[i : i + n - 1], ' ') AS gram FROM starts, (VALUES (1), (2), (3)) AS s(n) WHERE i + n - 1 <= len(w)
), scores AS (
  SELECT f.form, b.family, (coalesce(sum(x.w), 0) + b.b) / {temperature} AS z
  FROM (SELECT DISTINCT form FROM grams JOIN weights USING (gram)) f CROSS JOIN biases b
  LEFT JOIN (SELECT form, family, w FROM grams JOIN weights USING (gram)) x ON x.form = f.form AND x.family = b.family
  GROUP BY f.form, b.family, b.b
), ranked AS (
  SELECT form, family, z, max(z) OVER (PARTITION BY form) AS top, row_number() OVER (PARTITION BY form ORDER BY z DESC, family DESC) AS k FROM scores
), likely AS (
  SELECT form, max(CASE WHEN k = 1 THEN family END) AS family, 1 / sum(exp(z - top)) AS probability FROM ranked GROUP BY form
), close AS (
  SELECT form, family, max(part) AS similarity FROM (
    SELECT form, family, template, count(*) / max(size) AS part FROM grams JOIN patterns USING (gram) GROUP BY ALL) GROUP BY ALL
), met AS (
  SELECT doc_id, text, line::INTEGER AS line, lines::INTEGER AS lines, family,
    nullif(regexp_extract(unit, '(?i)(?:version|v\\.?|apache|gpl|mpl|by|nc|sa|nd|attribution|noncommercial|sharealike|noderivatives)[ -]*([0-9]+(?:\\.[0-9]+)*)', 1), '') AS version,
    round(probability, 6) AS probability, round(similarity, 6) AS similarity
  FROM units JOIN likely USING (form) JOIN close USING (form, family)
  WHERE family <> '{UNKNOWN}' AND probability >= 0.4 AND similarity >= 0.8
)
SELECT doc_id, line, lines, family, version, probability, similarity FROM met m
WHERE lines = 1 OR NOT EXISTS (SELECT 1 FROM met s WHERE s.lines = 1 AND s.text = m.text AND s.family = m.family AND s.line >= m.line AND s.line < m.line + m.lines)
"""
