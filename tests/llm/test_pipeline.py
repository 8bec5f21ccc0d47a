import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline as P  # noqa: E402
from tests.llm import test_decontaminate, test_jaccard_join, test_suffix_dedup  # noqa: E402


def table(rows):
    return "doc_id long, text string, lang string, source string, n_chars long", [(d, t, "en", "s", len(t or "")) for d, t in rows]


def test_stages_against_brute_force(spark, corpus, tmp_path):
    rows = list({d: (d, t) for d, t in corpus}.values())
    schema, data = table(rows)
    docs = spark.createDataFrame(data, schema)
    spark.createDataFrame([(1, rows[60][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = P.drop_near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    want = sorted(d for d, _, c in test_jaccard_join.brute(rows) if d == c)
    assert sorted(r.doc_id for r in kept.collect()) == want
    rest = [(d, t) for d, t in rows if d in set(want)]
    cut = P.drop_repeats(spark, kept, str(tmp_path))
    whole = {d: (n, gone) for d, n, gone, _, _ in test_suffix_dedup.brute(rest)}
    got = {r.doc_id: r for r in cut.collect()}
    assert set(got) == {d for d, (n, gone) in whole.items() if gone == 0 or gone < n}
    assert all(got[d].text == dict(rest)[d] for d in got if whole[d][1] == 0)
    assert all(r.n_chars == len(r.text or "") for r in got.values())
    clean = P.drop_contaminated(spark, cut, str(tmp_path))
    items = [(1, rows[60][1])]
    assert {r.doc_id for r in clean.collect()} == {d for d, r in got.items() if not test_decontaminate.brute(r.text, items)[1]}


def test_near_duplicates_by_row(spark):
    a, b, c, d = ("one two three four five six seven", "red green blue black white grey pink", "north south east west up down left", "iron gold zinc lead tin copper neon")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, b), (None, d), (5, d), (None, c + " right"), (6, ""), (7, ""), (8, None)]
    schema, data = table(rows)
    kept = P.drop_near_duplicates(spark, spark.createDataFrame(data, schema), "")
    want = [(1, a), (2, b), (3, c), (5, d), (None, c + " right"), (6, ""), (7, ""), (8, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


CLASHES = ("toxic", "p_toxic", "kept", "n_bytes", "n_removed", "n_spans", "key", "first", "component_id", "_0", "_k", "th", "h", "words", "start")


def test_clashing_columns_repeated_rows_and_ids(spark, corpus, tmp_path):
    """Every stage returns the columns of documents with their own values, whatever they are called, and treats repeated and null ids as without them."""
    rows = [*corpus, corpus[41], (None, corpus[42][1]), (None, None)]
    plain = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string").repartition(3)
    more = plain.select("doc_id", *[F.xxhash64(F.lit(c), "doc_id", "text").alias(c) for c in CLASHES], "text", F.length("text").alias("n_chars"))
    labels = [(d, 1, int(d % 2)) for d, _ in corpus if d < 30]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[60][1]), (2, " ".join(rows[20][1].split()[:12]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, more, str(tmp_path))
        assert got.columns == more.columns and got.schema == more.schema
        want = stage(spark, plain, str(tmp_path))
        pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
        assert pairs(got) == pairs(want) and len(pairs(want)) > 0
        wrong = F.lit(False)
        for c in CLASHES:
            wrong = wrong | ~F.col(c).eqNullSafe(F.xxhash64(F.lit(c), "doc_id", "text"))
        kept = got.join(more.select("doc_id", "text").distinct(), ["doc_id", "text"])  # texts that weren't cut
        assert kept.filter(wrong).count() == 0 and got.filter("n_chars <> length(text)").count() == 0


def test_empty_run(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_run_on_the_smallest_tables(spark):
    pieces = P.run(spark, "/root/testdata/sf0.001")
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and pieces.count() > 0
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "repeated_substrings", "decontamination", "packing"] and P.ORACLE_SQL is None
