import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from voltlake.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(UPPER))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        if v:
            n = min(10, len(v))
            wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_against_brute_force(spark, docs, corpus, limit):
    items = [(1, " ".join(corpus[45][1].split()[22:50])), (2, corpus[3][1]), (3, corpus[3][1]), (4, "two words"), (5, ""), (6, None), (7, "nowhere at all"), (None, "one"), (10, corpus[60][1]), (11, "THE of")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(docs, bench, broadcast_rows=limit, known_rows=limit).collect()
    assert len(got) == len(corpus)
    want = {(d, brute(t, items)[0]): brute(t, items) for d, t in corpus}
    for r in got:
        assert (r.n_words, r.n_hit, list(r["items"])) == want[r.doc_id, r.n_words]


def test_long_text_without_broadcasts(spark):
    """No join is broadcast; what is shuffled grows with the words, not with their square."""
    rng = random.Random(6)
    names = [f"n{k}" for k in range(3000)]
    long = [rng.choice(names) for _ in range(20_000)]
    item = long[7000:7040]
    rows = [(1, " ".join(long)), (2, " ".join(item[5:30] + ["other"] + item)), (3, " ".join(rng.choice(names) for _ in range(500))), (3, " ".join(item[:9])), (4, None)]
    items = [(1, " ".join(item)), (2, " ".join(long[100:104])), (3, "n1 n2"), (4, " ".join(names[:30]))]
    docs, bench = (spark.createDataFrame(x, "doc_id long, text string") for x in (rows, [(k, t) for k, t in items]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = D.contamination(docs, bench.withColumnRenamed("doc_id", "item_id"), broadcast_rows=0, known_rows=0).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == sorted((d, *brute(t, items)[:2], tuple(brute(t, items)[2])) for d, t in rows)


def test_empty_tables(spark, docs, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(none, bench).count() == 0
    assert D.contamination(docs, bench).agg(F.sum("n_hit")).first()[0] == 0


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(",".join([]).encode()).hexdigest()
