import itertools
import re
import time
from re import _parser

from pyspark.sql import functions as F

from voltlake.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORD.findall((text or "").translate(UPPER))
    places = [i for i in range(len(words)) for p, _ in L.BASE if words[i : i + len(p.split())] == p.split()]
    canon = f" {' '.join(words)} "
    found = []
    for order, (label, keyword, priority, confidence, pattern) in enumerate(L.rules()):
        if keyword in canon:
            for m in re.finditer("(?<= )" + pattern + "(?= )", canon):
                found.append((m.start(), -m.end(), priority, order, label))
    kept = []
    for d in sorted(found):
        if not any(e[0] <= d[0] and -e[1] >= -d[1] and (e[2], e[3]) != (d[2], d[3]) and e[2] <= d[2] for e in sorted(found)[: sorted(found).index(d)]):
            kept.append(d)
    base = sorted({label for p, label in L.BASE if f" {p} " in canon})
    return len(words), len(places), min(places, default=None), max(places, default=None), base, sorted({d[4] for d in kept} | set(base))


def test_against_brute_force(spark, docs, corpus):
    texts = [t for _, t in corpus] + [
        "MIT License MIT license, mit License", "Licensed under the Apache License, Version 2.0. See www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU Lesser General Public License v2.1 or the GNU General Public License version 3", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. MIT",
        "released under the BSD 3-clause license and the mozilla public license 2.0", "Ünï mit license", "mit", "license mit license", "general public license general public license",
    ]
    df = spark.createDataFrame([(k, t, 9) for k, t in enumerate(texts)], "id long, text string, detections int")
    got = {r.id: r for r in L.scan_licenses(df).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        labels = sorted({d.label for d in r.detections} | set(r.base_label_list))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, list(r.base_label_list), labels) == brute(t), t


def test_containment_prefers_priority(spark):
    df = spark.createDataFrame([("licensed under the apache license version 2.0",)], "text string")
    labels = {d.label for d in L.scan_licenses(df).first().detections}
    assert labels == {"apache-2.0"}  # the generic rules inside are suppressed


def test_hundreds_of_rules_and_gates():
    rules = L.rules()
    assert len(rules) > 400 and len({(r[0], r[4]) for r in rules}) > 400 and len(L.CLAUSES) > 170
    assert [r[1] for r in rules if not any(g in r[1] or g in f" {r[1]} " for g in L.SUPER_GATE)] == []
    assert [r for r in rules if r[2] >= L.LEVELS] == []


def test_many_matches_of_one_text(spark):
    """A hundred thousand matches, whose positions are summed in two levels; clashing names of helper columns stay."""
    n = 100_000
    text = "mit license x " * n
    df = spark.createDataFrame([(text, 1, 2, 3)], "text string, canon int, split int, found int")
    start = time.time()
    got = L.scan_licenses(df).select("n_words", "n_base", "first_word", "last_word", F.size("detections").alias("n"), F.element_at("detections", -1).alias("last"), "canon", "split", "found").first()
    assert (got.n_words, got.n_base, got.first_word, got.last_word, got.n) == (3 * n, n, 0, 3 * n - 3, n)
    assert (got.last.start, got.last.end) == (14 * (n - 1), 14 * (n - 1) + 11) and (got.canon, got.split, got.found) == (1, 2, 3)
    assert time.time() - start < 120


def test_empty(none):
    assert L.scan_licenses(none).count() == 0


def spellings(tree):
    """Texts that a pattern accepts: every alternative and option; repeats without a bound once and twice."""
    parts = []
    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            parts.append([chr(arg)])
        elif kind == "NOT_LITERAL":
            parts.append(["x"])
        elif kind == "IN":
            parts.append([chr(a if str(o) == "LITERAL" else a[0]) for o, a in arg])
        elif kind == "MAX_REPEAT":
            low, high, sub = arg
            own = spellings(sub)
            parts.append(["".join(x) for n in range(low, min(int(high), max(low, 2)) + 1) for x in itertools.product(own, repeat=n)])
        elif kind == "SUBPATTERN":
            parts.append(spellings(arg[3]))
        else:
            assert kind == "BRANCH"
            parts.append([x for b in arg[1] for x in spellings(b)])
    return ["".join(x) for x in itertools.product(*parts)]


def test_every_spelling_of_every_rule_is_found(spark):
    rows = [(order, t) for order, r in enumerate(L.rules()) for t in spellings(_parser.parse(r[4]))]
    assert {order for order, _ in rows} == set(range(len(L.rules())))
    assert [t for _, t in rows if not any(g in f" {t} " for g in L.SUPER_GATE)] == []
    df = spark.createDataFrame(rows, "rule int, text string").withColumn("c", F.concat(F.lit(" "), "text", F.lit(" ")))
    missed = df.filter(~F.exists(L._found("c", L.rules()), lambda d: (d["ord"] == F.col("rule")) & (-d["ne"] - d["s"] == F.length("text"))))
    assert [tuple(r) for r in missed.select("rule", "text").collect()] == []


def test_copyright_and_british_spellings(spark):
    want = {"Copyright 2020 Acme": "copyright", "copyright (c) 2019, 2020 acme": "copyright", "Copyright 2021": "copyright", "the Apache Licence": "apache", "End User Licence Agreement": "proprietary", "contributor licence agreement": "contributor-agreement"}
    got = L.scan_licenses(spark.createDataFrame([(t,) for t in want], "text string")).collect()
    assert {r.text: [d.label for d in r.detections] for r in got} == {t: [label] for t, label in want.items()}
