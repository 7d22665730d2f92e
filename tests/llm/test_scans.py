"""Scans of texts with very many matches, labels against a plain reading of the rules, fences against plain quantiles."""

from __future__ import annotations

import math
import re
import time

import numpy as np
from pyspark.sql import functions as F

from caseloom.llm import licenses, quality_rules, secrets
from caseloom.llm.common import running, table
from tests.llm import brute

SMALL = "/root/testdata/sf0.01"


def test_running_values(spark):
    rows = [([],), ([5],), ([1, 2],), ([3, 1, 4, 1, 5, 9, 2, 6],), (list(range(100)),), (None,)]
    df = spark.createDataFrame(rows, "v array<int>")
    got = df.select("v", running(F.col("v"), lambda a, b: a + b).alias("s"), running(F.col("v"), F.greatest).alias("m")).collect()
    for r in got:
        assert r.s == (None if r.v is None else np.cumsum(r.v).tolist()) and r.m == (None if r.v is None else np.maximum.accumulate(r.v or [0])[:len(r.v)].tolist())


def growth(run) -> float:
    """How much longer four times as many matches take, beside a second that is allowed for any run. A fold that copies all
    matches for each one takes sixteen times as long; 100,000 take some four seconds on eight idle cores."""
    took = []
    for n in (25_000, 25_000, 100_000):
        began = time.perf_counter()
        run(n)
        took.append(time.perf_counter() - began)
    return (took[2] - 1) / took[1]


def test_a_hundred_thousand_secrets_in_one_text(spark):
    def run(n):
        text = "".join(f"{i:016x} é{'token=' + 'x' * 12 if i % 10 == 0 else ''}\n" for i in range(n))
        df = spark.createDataFrame([(text,)], "text string")
        spans = df.select(secrets.find_secrets(F.col("text")).alias("s")).select(F.size("s").alias("n"), secrets.shown(F.col("s")).alias("shown")).first()
        want = brute.secrets(text)
        assert spans.n == n + n // 10 == want[0] + want[2] and spans.shown == want[4]

    assert growth(run) < 10


def test_a_hundred_thousand_notices_in_one_text(spark):
    def run(n):
        lines = n // 3
        text = "under the MIT license. GNU Lesser General Public License; cc by nc é\n" * lines
        df = spark.createDataFrame([(text,)], "text string")
        got = licenses.scan_licenses(df).select(F.size("base").alias("base"), F.size("notices").alias("n"), licenses.labels_of(F.col("notices")).alias("labels")).first()
        assert got.base == 2 * lines == brute.licenses(text)[1] and got.n == 3 * lines and got.labels == "cc-by-nc,lgpl,mit"

    assert growth(run) < 10


def plain_notices(text, rules):
    """Every rule over the whole text; an interval inside one before it, of the same or a better rank, goes."""
    found = []
    for no, r in enumerate(rules):
        pattern = r.pattern.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff")
        found += [(m.start(), -m.end(), r.rank, no, r.label, r.base) for m in re.finditer(pattern, text, re.I | re.A)]
    kept, best = [], []
    for start, stop, rank, _, label, base in sorted(found):
        if not any(rk <= rank and st <= stop for st, rk in best):
            kept.append((start, -stop, label))
        best.append((stop, rank))
    ranks = [f[2] for f in found]
    return kept, (licenses.SURE[min(ranks)] if ranks else 0.0)


def test_labels_agree_with_a_plain_reading(spark):
    rules = licenses.rules()
    assert len(rules) > 300
    texts = [s[1] for s in licenses.SENTENCES]
    texts += [f"Copyright (c) 2020. {w.title().replace(' ', ',  ')}.\nThe end" for _, w in licenses.SENTENCES]
    texts += ["SPDX-License-Identifier: Apache-2.0 and SPDX-License-Identifier: GPL-2.0-or-later", "Released under the terms of the GNU Lesser General Public License, version 2.1",
              "GNU General Public License v3 see https://www.gnu.org/licenses/gpl-3.0.html", "Creative Commons Attribution-NonCommercial-ShareAlike; CC BY 4.0",
              "BSD 3-Clause License all rights reserved. Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided",
              "Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "nothing here", "mit", "",
              "é under the MIT licenseé under the mit license", "Zlib license zlib/libpng License libpng license"]
    texts += [r.text or "" for r in table(spark, SMALL, "documents").select("text").where("text ilike '%licen%'").limit(60).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in licenses.scan_licenses(df).collect():
        kept, score = plain_notices(texts[r.doc_id], rules)
        assert [(n.start, n.end, n.label) for n in r.notices] == kept, texts[r.doc_id]
        assert r.score == score
    for label, words in licenses.SENTENCES:
        assert label in {n[2] for n in plain_notices(words, rules)[0]}, words


def plain_limits(rows, fences=quality_rules.FENCES, min_docs=200):
    """Limits of each group by sorting its values, buckets and all."""
    def bucketed(v):
        return v if v < quality_rules.EXACT else quality_rules.EXACT * 2 ** (math.floor((math.log2(v) - 10) * quality_rules.STEPS) / quality_rules.STEPS)

    out = {}
    for lang, source in {r[:2] for r in rows}:
        levels = [[r for r in rows if r[:2] == (lang, source)], [r for r in rows if r[0] == lang], rows]
        members = next((x for x in levels if len(x) >= min_docs), levels[-1])
        for k, f in enumerate(fences):
            values = sorted(bucketed(r[2][k]) for r in members)
            low, mid, high = (values[max(0, math.ceil(round(len(values) * q, 9)) - 1)] for q in (1 - f.share, 0.5, f.share))
            out[lang, source, k] = (mid - f.reach * ((mid - low) or f.least), mid + f.reach * ((high - mid) or f.least), high == mid)
    return out


def test_kept_agrees_with_plain_quantiles_and_every_fence_counts(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text", "lang", "source")
    kept = {r.doc_id: r for r in quality_rules.quality_verdicts(docs).collect()}
    n_lines = {r.doc_id: r.n_lines for r in kept.values()}
    assert len(n_lines) == docs.count()
    values = {i: (r.word_chars * 100 // max(r.n_words, 1), r.n_symbols * 100 // max(r.n_words, 1), r.n_dup_lines * 1000 // max(r.n_lines, 1),
                  r.n_repeat_words * 1000 // max(r.n_words, 1)) for i, r in kept.items()}
    limits = plain_limits([(r.lang, r.source, values[i]) for i, r in kept.items() if not r.base_failed])
    alone = [0] * len(quality_rules.FENCES)
    for i, r in kept.items():
        broken = [] if r.base_failed else [k for k, f in enumerate(quality_rules.FENCES) if values[i][k] > limits[r.lang, r.source, k][1]
                                           or f.below and values[i][k] < limits[r.lang, r.source, k][0]]
        assert r.kept == (not r.base_failed and not broken), i
        if len(broken) == 1:
            alone[broken[0]] += 1
    assert min(alone) >= 1, alone
    floors = [x[2] for x in limits.values()]
    assert sum(floors) < len(floors) / 2, sum(floors) / len(floors)


def test_each_fence_rejects_in_one_group_what_it_keeps_in_another(spark):
    """The same document among plain ones and among its like: base rules keep it in both."""
    words = [f"word{i}" for i in range(5000)]

    def text(i, long=0, symbols=0, same=0, again=0):
        own = [words[(i * 37 + k * 11) % 4999] + ("x" * long if k % 2 else "") for k in range(60)]
        own[:symbols] = ["#" + w for w in own[:symbols]]
        lines = [" ".join(own[k:k + 10]) for k in range(0, 60, 10)] + ["shared line"] * same
        return "\n".join(lines) + ("\n" + " ".join(own[:again]) if again else "")

    kinds = {"long": {"long": 14}, "symbols": {"symbols": 20}, "same": {"same": 5}, "again": {"again": 6}}
    rows = [(i, text(i), "en", "plain") for i in range(300)]
    for k, (name, how) in enumerate(kinds.items(), 1):
        rows += [(1000 * k + i, text(i, **{n: v if i % 3 else 0 for n, v in how.items()}), "en", name) for i in range(300)]
        rows.append((100_000 + k, text(7, **how), "en", "plain"))
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in got.values()), [r for r in got.values() if r.base_failed][:3]
    for k in range(1, 5):
        assert not got[100_000 + k].kept, k
        assert all(got[1000 * k + i].kept for i in range(300)), k
