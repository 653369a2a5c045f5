import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import license_scan as L
from lodestone.llm import quality_classifier as C
from lodestone.llm import quality_rules as R

from .common import WORDS, documents, empty


def labelled(spark, n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        words = [rng.choice(["Alpha", "beta", "gamma", "delta", "epsilon"]) + str(rng.randint(0, 99)) * (rng.random() < 0.2) for _ in range(rng.randint(25, 80))]
        if bad:
            words = [w.upper() + "!!" if i % 2 else w + "***" for w in words]
        rows.append((i, " ".join(words), rng.choice(["en", "de"]), rng.choice(["a", "a", "b", None]), 1))
        labels.append((i, int(not bad), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    out = {r.doc_id: r.kept for r in C.classify(docs, labels.where("doc_id % 4 < 2")).collect()}
    truth = {r.doc_id: bool(r.quality) for r in labels.collect()}
    held = [i for i in truth if i % 4 >= 2]  # both kinds of junk are in either half
    assert sum(out[i] == truth[i] for i in held) / len(held) > 0.97
    assert all(out[i] for i in held if truth[i])


def test_classifier_edge_rows(spark):
    docs = documents(spark)
    _, labels = labelled(spark, 100)
    out = C.classify(docs, labels)
    assert out.count() == docs.count() and out.where("score is null or kept is null or isnan(score)").isEmpty()
    assert C.classify(empty(spark), labels).count() == 0
    assert C.classify(docs, labels.where("quality = 1")).where("not kept").isEmpty()
    kept = C.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count()


def site_brute_force(rows, weight=1.0):
    """Posteriors and scores from (host, path, p) in plain loops: moments, shrinkage, and each row's own share taken out."""
    def groups(key):
        out = {}
        for r in rows:
            out.setdefault(key(r), []).append(r[2])
        return out

    def strength(table, prior):
        many = {k: v for k, v in table.items() if len(v) > 1}
        n = sum(map(len, many.values()))
        within = sum(len(v) * (sum(x * x for x in v) - sum(v) ** 2 / len(v)) / (len(v) - 1) for v in many.values()) / n
        between = sum(len(v) * (sum(v) / len(v) - prior(k)) ** 2 - (sum(x * x for x in v) - sum(v) ** 2 / len(v)) / (len(v) - 1) for k, v in many.items()) / n
        return min(1e6, max(1.0, within / between)) if between > 1e-12 else 1e6

    mean = sum(r[2] for r in rows) / len(rows)
    hosts, paths = groups(lambda r: r[0]), groups(lambda r: r[:2])
    k_host = strength(hosts, lambda _: mean)
    host = {h: (sum(v) + k_host * mean) / (len(v) + k_host) for h, v in hosts.items()}
    k_path = strength(paths, lambda q: host[q[0]])
    path = {q: (sum(v) + k_path * host[q[0]]) / (len(v) + k_path) for q, v in paths.items()}
    logit = lambda x: math.log(min(1 - 1e-6, max(1e-6, x)) / (1 - min(1 - 1e-6, max(1e-6, x))))
    out = []
    for h, q, p in rows:
        other_host = (sum(hosts[h]) - p + k_host * mean) / (len(hosts[h]) - 1 + k_host)
        other = (sum(paths[h, q]) - p + k_path * other_host) / (len(paths[h, q]) - 1 + k_path)
        z = logit(p) + weight * (logit(other) - math.log(mean / (1 - mean)))
        out.append((host[h], path[h, q], 1 / (1 + math.exp(-z))))
    return out


def site_documents(spark, n=1200):
    """Junk that looks half like the rest, most of it on two hosts: (documents, labels, truth)."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        host = rng.choice(["h1", "h2", "h3", "h4", "h5", "h6", None])
        bad = rng.random() < {"h1": 0.95, "h2": 0.9}.get(host, 0.04)
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + ("!" if rng.random() < (0.16 if bad else 0.1) else "") for _ in range(40)]
        rows.append((i, " ".join(words), rng.choice(["en", "de"]), host, 1))
        labels.append((i, int(not bad), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, bool(q)) for i, q, _ in labels)


def test_posteriors_match_brute_force(spark):
    for docs, labels in (site_documents(spark)[:2], labelled(spark)):
        out = {r.doc_id: r for r in C.classify(docs, labels).collect()}
        rows = docs.select("doc_id", "source", "lang").collect()
        want = site_brute_force([(r.source, r.lang, out[r.doc_id].document_score) for r in rows])
        for r, (host, path, score) in zip(rows, want):
            o = out[r.doc_id]
            assert o.host_posterior == pytest.approx(host, abs=2e-6) and o.path_posterior == pytest.approx(path, abs=2e-6) and o.score == pytest.approx(score, abs=2e-5)


def test_sites_raise_held_out_accuracy(spark):
    docs, labels, truth = site_documents(spark)
    held = [i for i in truth if i % 2]
    right = {}
    for weight in (0.0, 1.0):
        out = {r.doc_id: r.kept for r in C.classify(docs, labels.where("doc_id % 2 = 0"), weight=weight).collect()}
        right[weight] = sum(out[i] == truth[i] for i in held) / len(held)
    assert right[1.0] > right[0.0] + 0.03, right


def test_training_rows_are_those_of_least_hash(spark):
    df = spark.range(5000).select("id", F.lit(1.0).alias("y"), *[F.lit(0.0).alias(f) for f in C.FEATURES])
    key = F.xxhash64("id", F.lit(11))
    want = [r.id for r in df.orderBy(key, "id").limit(200).collect()]
    assert sorted(r.id for r in C.training_rows(df, 200).collect()) == sorted(want)
    assert C.training_rows(df, 6000).count() == 5000 and C.training_rows(df.limit(0), 10).count() == 0


def test_newton_finds_the_penalised_maximum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    y = (x[:, 0] + rng.normal(size=500) > 0).astype(float)
    w, b = C.fit(x, y)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    z = (x - x.mean(0)) / x.std(0)
    assert np.abs(z.T @ (y - p) - w * x.std(0)).max() < 1e-6


def brute_measures(text):
    text = text or ""
    words = WORDS(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_measures_match_brute_force(spark):
    docs = documents(spark)
    extra = [(900, "a b c d e f g h i a b c d e f g h", "en", "a", 1), (901, ("x y z w v u t s " * 4) + "#*$ <b>|\nq\nq\n \n \nq", "en", "a", 1), (902, "a a a a a a a a a", "en", "a", 1), (903, "\x0b a\x0cb\rc\u00a0d ", "en", "a", 1)]
    df = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, s string, n long").select("doc_id", "text", "lang"))
    want = sorted((r.doc_id is None, r.doc_id or 0, *brute_measures(r.text)) for r in df.collect())
    got = sorted((r.id is None, r.id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in R.measures(df).collect())
    assert got == want


def exact_tail(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_tail_is_exact(spark):
    cases = [(n, k) for n in (1, 10, 500, 3000) for k in (0, 1, 2, 5) if k < n * 0.01] + [(100000, 700)]
    df = spark.createDataFrame(cases, "n long, k long")
    for r in df.select("n", "k", R.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect():
        if r.n <= 3000:
            assert r.p == pytest.approx(exact_tail(r.n, r.k, 0.01), rel=1e-9)
        else:
            assert 0 < r.p < 1e-10
    assert spark.range(1).select(R.binomial_tail(F.lit(10).cast("long"), F.lit(9).cast("long"), 0.01)).first()[0] == 1.0


def test_thresholds_are_certified_and_reject_few_good(spark):
    docs, labels = labelled(spark, 3000)
    out = R.apply_rules(docs, labels, risk_total=0.1)
    j = out.join(labels, "doc_id")
    assert j.where("quality = 1 and not kept and not base_failed").count() <= 0.1 * labels.where("quality = 1").count()
    assert j.where("quality = 0 and kept").count() < 0.2 * labels.where("quality = 0").count()
    cuts = R.thresholds(R.measures(docs), labels, risk_total=0.1).collect()
    assert cuts and all(r.p_value <= 0.05 / (2 * sum(map(len, R.GRID.values()))) for r in cuts)


def test_default_risk_rejects_junk_with_few_hundred_labels(spark):
    docs, labels = labelled(spark, 2000)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 20 == 0, "es").otherwise(F.col("lang")))  # too few of es: pooled
    j = R.apply_rules(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    for r in j.groupBy("lang").agg(F.count_if(F.expr("quality = 0 and kept")).alias("junk"), F.count_if(F.expr("quality = 0")).alias("bad"), F.count_if(F.expr("quality = 1 and not kept and not base_failed")).alias("lost"), F.count_if(F.expr("quality = 1")).alias("good")).collect():
        assert r.bad and r.junk < 0.2 * r.bad and r.lost <= 0.01 * r.good


def test_few_labels_certify_nothing(spark):
    docs, labels = labelled(spark, 60)
    out = R.apply_rules(docs, labels)
    assert out.where("not kept and not base_failed").isEmpty()
    assert R.apply_rules(empty(spark), labels).count() == 0
    edge = R.apply_rules(documents(spark), labels)
    assert edge.count() == documents(spark).count() and edge.where("kept is null").isEmpty()


def test_rules_stay_in_the_jvm(spark):
    docs, labels = labelled(spark, 60)
    plan = R.measures(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""


def test_licences(spark):
    texts = ["Some text.\nLicensed under the Apache License, Version 2.0.\nMore.", MIT, "released under the mit license and then some words. Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "a license to kill", None, "", MIT + " " + "word " * 50_000, "All rights reserved."]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")
    out = {r.doc_id: r.licenses for r in L.scan(df).collect()}
    assert out == {0: "Apache-2.0", 1: "MIT", 2: "MIT+CC-BY-NC-4.0", 3: "GPL-3.0-only", 4: None, 5: None, 6: None, 7: "MIT", 8: "All-Rights-Reserved"}
    assert L.scan(df.where("doc_id < 0")).count() == 0


GPL = """# This program is free software{mark} you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation{sep} either version {version} of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
"""


BSD = """Copyright (c) 2009, Google Inc. All rights reserved.

 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are
 * met:
 *
 *   1. Redistributions of source code must retain the above copyright
 * notice, this list of conditions and the following disclaimer.
 *   2. Redistributions in binary form must reproduce the above
 * copyright notice, this list of conditions and the following disclaimer
 * in the documentation and/or other materials provided with the
 * distribution.
"""
ENDORSE = """ *   3. Neither the name of Google Inc. nor the names of its
 * contributors may be used to endorse or promote products derived from
 * this software without specific prior written permission.
"""
APACHE = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
// See the License for the specific language governing permissions and
// limitations under the License.
"""
ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."


def names(rec, text):
    return [h[0] for h in rec.match([f[0] for f in rec.identify(text)])]


def test_notices_are_recognised():
    rec = L.Recogniser(L.SENTENCES, L.RULES)
    lgpl = GPL.replace("GNU General", "GNU Lesser General")
    for text, want in [
        (GPL.format(mark=":", sep=",", version=3), ["GPL-3.0-or-later"]), (GPL.format(mark=";", sep=";", version=2), ["GPL-2.0-or-later"]), (GPL.format(mark=";", sep=",", version=2).replace("# ", "").replace("#", ""), ["GPL-2.0-or-later"]),
        (lgpl.format(mark=";", sep=";", version="2.1"), ["LGPL-2.1-or-later"]), (GPL.replace("General", "Affero General").format(mark=":", sep=",", version=3), ["AGPL-3.0-or-later"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", ["MPL-2.0"]),
        (BSD, ["All-Rights-Reserved", "BSD-2-Clause"]), (BSD + ENDORSE, ["All-Rights-Reserved", "BSD-3-Clause"]), (APACHE, ["Apache-2.0"]), (ISC, ["ISC"]), (ISC.replace("\n", "\n-- "), ["ISC"]),
        ("This file is part of Foo, licensed under the GNU GPL, version 3 or later.", ["GPL-3.0-or-later"]), ("Licensed under the GPLv2 or any later version", ["GPL-2.0-or-later"]), ("released under the GPLv2+", ["GPL-2.0-or-later"]),
        ("It is distributed under the GNU Lesser General Public License v3.0.", ["LGPL-3.0-only"]), ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]), ("// SPDX-License-Identifier: EPL-2.0 OR MIT", ["EPL-2.0 OR MIT"]),
        ("This is free and unencumbered software released into the public domain.", ["Unlicense"]), ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at http://x.", ["EPL-2.0"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ["CC-BY-NC-SA-4.0"]), ("This is not licensed under the MIT License.", []), ("Permission is granted to leave early.", []),
    ]:
        assert names(rec, text) == want, text


def test_longer_rules_win_and_order_matters():
    rec = L.Recogniser(L.SENTENCES, L.RULES)
    assert rec.match(["bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse"]) == [("BSD-3-Clause", 0, 4)]
    assert rec.match(["bsd-redist", "bsd-source", "bsd-binary", "cc0-waive"]) == [("BSD-2-Clause", 0, 3), ("CC0-1.0", 3, 4)]
    assert rec.match(["bsd-binary", "bsd-source", "bsd-redist"]) == []


def test_spans_and_callers_sentences(spark):
    text = "Some words.\n\n" + MIT + "\n\nMore."
    df = spark.createDataFrame([(None, text), (None, text), (1, "x\nMay the zorch be with <you>.\ny")], "doc_id long, text string")
    out = L.scan(df).collect()
    assert len(out) == 3 and [r.doc_id for r in out].count(None) == 2
    span = next(r.spans for r in out if r.doc_id is None)
    a, b = map(int, span.removeprefix("MIT:").split("-"))
    assert text[a:b].startswith("Permission is") and text[a:b].endswith("of the Software.")
    own = {r.doc_id: r.licenses for r in L.scan(df, sentences={"z": ("may the zorch be with <name>",)}, rules=((("z",), 1, "Z"),)).collect()}
    assert own == {None: None, 1: "Z"}


def brute_fits(template, words):
    """Whether a template fits a list of words, by recursion over its parts."""
    import re

    parts = re.findall(r"\([^)]*\)|\[[^\]]*\]|[^ ]+", template)
    if not parts:
        return not words
    part, rest = parts[0], " ".join(parts[1:])
    if part == "<name>":
        return any(brute_fits(rest, words[k:]) for k in range(1, min(12, len(words)) + 1))
    if part[0] in "([":
        options = part[1:-1].split("|")
        return any(brute_fits((o + " " + rest).strip(), words) for o in options) or part[0] == "[" and brute_fits(rest, words)
    return bool(words) and words[0] == part and brute_fits(rest, words[1:])


def test_scan_matches_plain_search():
    """Wrapped, commented and altered sentences are identified exactly where a recursive search over the templates says so."""
    rng = random.Random(4)
    known = [(t, k) for k, many in L.SENTENCES.items() for t in many]
    rec = L.Recogniser(L.SENTENCES, L.RULES, notices=())
    hits = 0
    for n in range(200):
        t, _ = rng.choice(known)
        words = []
        for part in re.findall(r"\([^)]*\)|\[[^\]]*\]|[^ ]+", t):
            if part[0] in "([":
                part = rng.choice(part[1:-1].split("|")) if part[0] == "(" or rng.random() < 0.5 else ""
            words += ["zog"] * rng.randint(1, 3) if part == "<name>" else part.replace("<name>", "zog").split()
        if n % 3 == 0:
            words[rng.randrange(len(words))] = "changed"
        want = sorted({k for u, k in known if brute_fits(u, words)})
        wrapped = "".join(w + (rng.choice([" ", " ", " ", "\n# ", "; "]) if i + 1 < len(words) else ".") for i, w in enumerate(words))
        got = [f[0] for f in rec.identify("# Filler text here.\n\n# " + wrapped.capitalize())]
        assert (got[0] in want and len(got) == 1) if want else " ".join(words) not in got, (words, want, got)
        hits += bool(want)
    assert hits > 120
