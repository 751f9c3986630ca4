"""The pipeline against plain loops, and its stages on odd rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lagwise.llm import decontaminate
from lagwise.llm.common import likely_in, store
from tests.llm.test_duplicates import exact_by_loop, print_by_loop


def test_stages_by_loop(spark):
    """Languages, copies, near copies and benchmark passages go as in a loop over all rows."""
    sf_dir = "/root/testdata/sf0.001"
    rng = random.Random(1)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    rows += [(10**6 + i, *rng.choice(rows)[1:]) for i in range(20)] + [(5_000_000, "12 34 !", "en", "s", 7), (5_000_001, None, None, None, None)]
    frame = spark.createDataFrame(rows, docs.schema).repartition(3)
    kept = {name: None for name, _ in corpus_pipeline.STAGES}
    current = frame
    for name, stage in corpus_pipeline.STAGES:
        current = store(stage(spark, current, sf_dir), "stage")
        kept[name] = {r.doc_id for r in current.select("doc_id").collect()}
        assert name == "pack" or current.columns == docs.columns
    text = {r[0]: r[1] for r in rows}
    want = {i for i, t in text.items() if t and any(c.isalpha() for c in t)}
    assert kept["language_id"] == want
    want = {r[0] for r in exact_by_loop([(i, text[i]) for i in want]) if r[3]}
    assert kept["exact_dedup"] == want
    want = near_by_loop([(i, text[i]) for i in sorted(want)])
    assert kept["simhash_dedup"] == want
    hits = decontaminate.benchmark_hits(frame, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").collect()
    want -= {r.doc_id for r in hits}
    assert kept["benchmark_decontamination"] == want == kept["pack"]


def test_stages_keep_one_of_repeated_rows(spark, odd):
    first = {"language_id": odd}
    for name, stage in corpus_pipeline.STAGES:
        out = store(stage(spark, first.get(name, odd), "/root/testdata/sf0.001"), "stage")
        assert stage(spark, odd.limit(0), "/root/testdata/sf0.001").count() == 0
        if name == "exact_dedup":
            rows = sorted((repr(r.doc_id) for r in out.collect()))
            assert out.count() == len({" ".join((r.text or "").split(" ")) for r in out.collect()}) and rows.count("1") == 1
        if name != "pack":
            assert out.columns == odd.columns


def five_words(text):
    words = (text or "").lower().split()
    return {" ".join(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def alike_by_loop(rows):
    """Pairs of places whose five-word sets have a Jaccard similarity of 0.8."""
    sets = [five_words(t) for _, t in rows]
    return [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and len(a & b) >= 0.8 * len(a | b) - 1e-9]


@pytest.mark.parametrize("crowd", [0, 60])
def test_near_copies_by_word_similarity(spark, crowd):
    """Of pairs at a five-word similarity of 0.8 or more none stays, whatever bits their fingerprints differ in."""
    rng = random.Random(crowd)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300 if crowd else 1000)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    for i in range(crowd):  # copies of one text, each with some words of its own: many keys hold most of them
        words = [f"own{i}x{k}" if rng.random() < 0.02 else w for k, w in enumerate(base)]
        rows.append((10**6 + i, " ".join(words)))
    schema = docs.select("doc_id", "text").schema
    kept = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, schema).repartition(3), "").collect()}
    assert len(far_by_loop(rows)) >= 5
    assert kept == near_by_loop(rows)


def far_by_loop(rows):
    """Pairs of places that are alike by words, though their fingerprints differ in more than three bits."""
    prints = [print_by_loop(t) for _, t in rows]
    return [p for p in alike_by_loop(rows) if (prints[p[0]] ^ prints[p[1]]).bit_count() > 3]


def near_by_loop(rows):
    """The smallest id of every group of rows that are near by fingerprint or by words."""
    prints = [print_by_loop(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = [(i, j) for i, a in enumerate(prints) for j in range(i) if (a ^ prints[j]).bit_count() <= 3]
    for i, j in near + far_by_loop(rows):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return set(least.values())


def test_language_fills_nulls(spark, documents):
    docs = documents.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    out = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    truth = {r.doc_id: r.lang for r in documents.collect()}
    assert None not in out.values() and all(out[i] == truth[i] for i in out if i % 2 == 0)
    assert sum(out[i] == truth[i] for i in out) > 0.9 * len(out)


def test_number_column_is_refused(spark, odd):
    with pytest.raises(ValueError):
        corpus_pipeline.exact_dedup(spark, odd.withColumn("_pipeline_row", F.lit(1)), "")


def test_stage_deletes_what_the_one_before_stored(spark, documents):
    first = corpus_pipeline.exact_dedup(spark, documents, "")
    folders = {f.rsplit("/", 1)[0].removeprefix("file:") for f in first.inputFiles()}
    written = store(first, "written")
    assert folders and all(os.path.isdir(f) for f in folders)
    second = corpus_pipeline.exact_dedup(spark, written, "")
    assert not any(os.path.isdir(f) for f in folders) and second.count() == written.count()


def test_rows_stay_where_they_are_when_some_are_dropped(spark):
    """Which rows of a stage stay is told by bits: their texts are not shuffled, however small the limit of broadcasts."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string").repartition(3)
    numbered = corpus_pipeline._numbered(docs)
    wanted = numbered.filter("doc_id % 7 = 0").select(F.col(corpus_pipeline._ROW).alias("row"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline._only(numbered, wanted)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(500) if i % 7 == 0]
        assert kept.columns == docs.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_rows_are_joined_where_bits_are_too_many(spark, monkeypatch):
    docs = spark.createDataFrame([(i, None) for i in range(100)], "doc_id long, text string").repartition(3)
    numbered = corpus_pipeline._numbered(docs)
    wanted = numbered.filter("doc_id < 9").select(F.col(corpus_pipeline._ROW).alias("row"))
    monkeypatch.setattr(corpus_pipeline, "BITMAPS", 0)
    assert sorted(r.doc_id for r in corpus_pipeline._only(numbered, wanted).collect()) == list(range(9))


def test_likely_rows(spark):
    """No wanted row is missing, null keys included, and few others come along."""
    rows = [(i if i % 10 else None, i, "x") for i in range(5_000)]
    df = spark.createDataFrame(rows, "a long, b long, c string")
    wanted = df.filter("b % 50 < 2").select("a", "b")
    found = likely_in(df, ["a", "b"], wanted, 200)
    got = {r.b for r in found.collect()}
    assert found.columns == df.columns and {i for i in range(5_000) if i % 50 < 2} <= got and len(got) < 800
    assert likely_in(df, ["a", "b"], wanted.limit(0), 0).count() == 0
