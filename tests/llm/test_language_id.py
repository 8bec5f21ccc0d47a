import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from voltlake.llm import language_id as L

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = L.op9_language_id(spark, DATA).filter("held_out").join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def model(spark):
    rows = [("the cat sat on the mat with that thing", "en"), ("le chat est sur la table avec une chaise", "fr"), ("кошка сидит на столе", "ru"), (None, "en"), ("lost", None)]
    return L.learn(spark.createDataFrame(rows * 20, "text string, lang string"))


def test_mixed_text_has_spans(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat le chat est sur la table avec une chaise кошка сидит на столе")], "doc_id long, text string")
    r = L.label_languages(df, model(spark), penalty=3.0).first()
    assert [s.lang for s in r.spans] == ["en", "fr", "ru"] and r.lang_pred == "fr" and 0 < r.score < 1
    assert r.spans[0].start == 0 and all(a.end == b.start for a, b in zip(r.spans, r.spans[1:]))


def test_edge_cases(spark, docs, corpus, none):
    got = L.label_languages(docs, model(spark)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(corpus)
    assert all((by[d].lang_pred, by[d].score) == ("und", 0.0) and not by[d].spans for d in (78, 79, 80, 85, 86))
    assert all(0 <= r.score <= 1 for r in got)
    assert L.label_languages(none, model(spark)).count() == 0
    assert L.label_languages(docs, L.learn(docs.withColumn("lang", F.lit(None).cast("string")))).filter("lang_pred <> 'und'").count() == 0


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(50):
        score = rng.normal(size=(5, 3, 3))
        length = np.array([5, 3, 1])
        path = L.viterbi(score, length, 0.7)
        for d in range(3):
            n = length[d]
            cost = lambda p: sum(score[t, d, p[t]] for t in range(n)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
            best = max(cost(p) for p in np.ndindex(*[3] * n))
            assert abs(cost(path[:n, d].tolist()) - best) < 1e-9


def test_scripts_by_code_point():
    at = lambda c: int(L.scripts_of(np.array([ord(c)]))[0])
    alike = ["aZéßŽạ", "Ωάἀ", "жЯѣ", "अक", "กข", "தம", "בא", "عپ", "中国々", "あん", "アン", "한글ㄱ", "বক", "აბ", "አበ"]
    assert len({at(g[0]) for g in alike}) == len(alike) and 0 not in {at(g[0]) for g in alike}
    assert all(at(c) == at(g[0]) for g in alike for c in g)
    assert [at(c) for c in "–—’“”…×÷°€→☃😀、。「"] == [0] * 16


def test_dashes_and_quotes_part_words():
    w = L.Words(["–no “quotes”—here’s😀 naïve".encode(), "…“”".encode()])
    assert w.per_text.tolist() == [5, 0] and w.letters.tolist() == [2, 6, 4, 1, 5]


def test_many_languages_score_alike(spark, docs, monkeypatch):
    """Kept sparse, a model labels as the dense one does, in windows of any size; long and empty texts among them."""
    rng = np.random.default_rng(1)
    rows = [(k, " ".join("".join(rng.choice(list("abcdeÄжñ"), 4)) for _ in range(30)), f"l{k % 7}") for k in range(60)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dense = L.learn(known)
    monkeypatch.setattr(L, "MAX_LANGUAGES", 3)
    monkeypatch.setattr(L, "HELD_LANGUAGES", 2)
    sparse = L.learn(known)
    assert isinstance(sparse, L.SparseModel) and sparse.langs == dense.langs
    texts = [t.encode() for _, t, _ in rows[:20]] + [b"", b"...", "жжжж abc".encode(), (rows[0][1] + " ").encode() * 200]
    want = L.label(dense, texts, 3.0)
    for size in (7, 100, 2_000_000):
        monkeypatch.setattr(L, "WINDOW_SCORES", size)
        got = L.label(sparse, texts, 3.0)
        assert got[0] == want[0] and got[2] == want[2] and np.allclose(got[1], want[1])


def test_thousands_of_dirty_labels(spark):
    """Each label's own words are told apart; a batch of whole texts is labelled."""
    letters = "bcdfghjklmnpqrstvwxz"
    word = lambda k: "".join(letters[k // 20**j % 20] + "aeiou"[(k // 3 + j) % 5] for j in range(3))
    rows = [(k, f"{word(k)} {word(k)} {word(k + 9000)} {word(k)}", f"label {k:04d}") for k in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = L.learn(df)
    assert len(model.langs) == 5000
    got = {r.doc_id: r.lang_pred for r in L.label_languages(df.filter("doc_id % 25 = 0"), model).collect()}
    assert len(got) == 200 and sum(got[k] == f"label {k:04d}" for k in got) > 190


def grams(text):
    """Words of a text as lists of byte trigrams with borders, written anew: letters are ASCII letters and characters of a script."""
    words, held = [], []
    for c in [*text, " "]:
        point = ord(c)
        letter = c.isascii() and c.isalpha() or point >= 0x80 and L.scripts_of(np.array([point]))[0]
        if letter:
            held.append(c.lower() if c.isascii() else c)
        elif held:
            raw = b"\0" + "".join(held).encode() + b"\0"
            script = 1 if ord(held[0]) < 0x80 else int(L.scripts_of(np.array([ord(held[0])]))[0])
            words.append((len(held), script, [raw[i : i + 3] for i in range(len(raw) - 2)]))
            held = []
    return words


def bucket(g):
    mask = 0xFFFFFFFF
    return (((g[0] * 0x9E3779B1 & mask) ^ (g[1] * 0x85EBCA77 & mask) ^ (g[2] * 0xC2B2AE3D & mask)) * 0x27D4EB2F & mask) >> 16


def brute(train, texts, penalty):
    counts, scripts = defaultdict(Counter), defaultdict(Counter)
    for t, lang in train:
        for _, script, own in grams(t):
            scripts[lang][script] += 1
            counts[lang].update(map(bucket, own))
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + 0.5 * L.BUCKETS for x in langs}
    out = []
    for t in texts:
        words = grams(t)
        if not words or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        rows = []
        for _, script, own in words:
            share = {x: scripts[x][script] / max(1, sum(scripts[x].values())) for x in langs}
            barred = {x for x in langs if share[x] < L.RARE}
            barred = set() if len(barred) == len(langs) else barred
            rows.append({x: sum(math.log((counts[x][bucket(g)] + 0.5) / total[x]) for g in own) - 1e6 * (x in barred) for x in langs})
        best, back = dict(rows[0]), []
        for row in rows[1:]:
            top = max(langs, key=lambda x: (best[x], -langs.index(x)))
            step = {x: x if best[x] >= best[top] - penalty else top for x in langs}
            best = {x: max(best[x], best[top] - penalty) + row[x] for x in langs}
            back.append(step)
        path = [max(langs, key=lambda x: (best[x], -langs.index(x)))]
        for step in reversed(back):
            path.append(step[path[-1]])
        weight = Counter()
        for (n, _, _), x in zip(words, reversed(path), strict=True):
            weight[x] += n
        name = max(langs, key=lambda x: (weight[x], -langs.index(x)))
        out.append((name, weight[name] / sum(weight.values())))
    return out


def test_whole_query_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = {"en": "the and of house river water light where nothing".split(), "de": "der und die häuser fluß wasser licht wo nichts".split(), "ru": "и дом река вода свет где ничего".split(), "el": "και σπίτι ποτάμι νερό φως πού τίποτα".split()}
    sentence = lambda x, n: " ".join(rng.choice(vocabulary[x]) for _ in range(n))
    train = [(sentence(x, rng.randint(3, 30)), x) for x in vocabulary for _ in range(15)]
    texts = ["; ".join(sentence(rng.choice([*vocabulary]), rng.randint(1, 9)) for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["", "12 – 34", "’“", "é", "Licht–water ничего’s 中", sentence("de", 20_100)]
    model = L.learn(spark.createDataFrame(train, "text string, lang string").repartition(3))
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.label_languages(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), model, penalty=4.0).collect()}
    for k, (name, score) in enumerate(brute(train, texts, 4.0)):
        assert got[k][0] == name and abs(got[k][1] - score) < 1e-9, texts[k][:80]
