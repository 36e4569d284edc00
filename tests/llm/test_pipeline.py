import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from millrace.llm import packing, quality
from test_line_dedup import assert_all_but_few, brute as lines_brute
from test_ngram_join import brute as jaccard_brute, near_copies


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(1)
    vocab = ["".join(rnd.choice("abcdefghijk") for _ in range(rnd.randrange(2, 9))) for _ in range(600)]
    rows, labels = [], []
    for i in range(240):
        lines = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(4, 20))) for _ in range(rnd.randrange(1, 5))]
        if i % 6 == 0:
            lines = [x.replace(" ", " $$$ ") for x in lines]
        if i % 7 == 1 and rows:
            lines = rows[-1][1].split("\n")
        rows.append((i, "\n".join(lines), "en", f"src{i % 3}", len("\n".join(lines))))
        if i % 4 < 2:
            labels.append((i, int("$$$" not in rows[-1][1]), 0))
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages_against_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    kept = pipe.stored(pipe.quality(spark, docs, corpus), "t")
    ids = {r.doc_id for r in quality.selected_ids(docs, pipe.good_labels(spark, corpus)).collect()}
    assert {r.doc_id for r in kept.collect()} == ids and kept.columns == columns
    junk = {r.doc_id for r in docs.filter("text like '%$$$%'").collect()}
    assert len(ids & junk) <= 0.2 * len(junk) and len(ids - junk) > 0.85 * (240 - len(junk))  # the draw is random

    lined = pipe.stored(pipe.line_dedup(spark, kept, corpus), "t")
    before = {r.doc_id: r.text for r in kept.collect()}
    left = lines_brute(list(before.items()))
    got = {r.doc_id: (r.text, r.n_chars) for r in lined.collect()}
    assert lined.columns == columns
    assert_all_but_few({d: got.get(d, ("",))[0] for d in before}, left, list(before.items()))
    assert all(t and n == len(t) for t, n in got.values()) and set(got) >= {d for d, t in left.items() if t}

    joined = pipe.stored(pipe.ngram_join(spark, lined, corpus), "t")
    want = jaccard_brute([(d, t) for d, (t, _) in got.items()])
    assert {r.doc_id for r in joined.collect()} == {d for d, (_, c) in want.items() if c == d} and joined.columns == columns

    pieces = pipe.packing(spark, joined, corpus)
    import public_tokenizers

    t = packing.WordCachedTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(t.encode([r.text])[0]) // 4 + 1 for r in joined.collect())
    assert pieces.agg(F.sum("length")).first()[0] == total


def test_near_copies_by_five_words_and_four_fifths(spark):
    rows = near_copies(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in pipe.ngram_join(spark, docs, "").collect()}
    want = {d for d, (_, c) in jaccard_brute(rows, 80, 100, 5).items() if c == d}
    assert kept == want != {d for d, (_, c) in jaccard_brute(rows).items() if c == d}


def test_lines_of_a_crowded_key_all_meet(spark, monkeypatch):
    from millrace.llm import line_dedup

    rows = []
    for i in range(20):
        words = [f"w{i}x{j * 7919 + i}" for j in range(12)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:7], "other", *words[8:]]))]
    monkeypatch.setattr(line_dedup, "keys_of", lambda n, simhash, s: F.array(F.lit(1).cast("long")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    assert {r.doc_id for r in pipe.line_dedup(spark, docs, "").collect()} == set(range(0, 40, 2))


def test_workers_hold_the_caches_of_one_operator(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").repartition(16)
    pipe.stored(pipe.quality(spark, docs, corpus), "t")
    pipe.stored(pipe.ngram_join(spark, docs, corpus), "t")

    def held(batches):
        import os
        import time

        import pyarrow as pa
        from millrace.llm import ngram_join, packing, quality

        for batch in batches:
            time.sleep(0.05)
            n = [len(x) for x in (quality._WORDS, ngram_join._WORDS, packing._TOKENIZERS)]
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), *(pa.array([x]) for x in n)], names=["pid", "quality", "ngrams", "packing"])

    def workers():
        return spark.range(0, 32, 1, 32).mapInArrow(held, "pid long, quality long, ngrams long, packing long").distinct().collect()

    found = workers()
    assert any(r.ngrams for r in found) and not any(r.ngrams and r.quality for r in found)
    pipe.stored(pipe.packing(spark, docs, corpus), "t")
    found = workers()
    assert any(r.packing for r in found) and not any(r.packing and (r.ngrams or r.quality) for r in found)


def test_run(spark, corpus):
    out = pipe.run(spark, corpus)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_stages_results_go(spark, corpus):
    from pathlib import Path

    from millrace.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"), "millrace")
    before = {p.name for p in folder.glob("*")}
    assert pipe.run(spark, corpus).count()
    left = {p.name.rsplit("-", 1)[0] for p in folder.glob("*") if p.name not in before}
    assert {name.replace(" ", "-") for name, _ in pipe.STAGES} & left == {"best-fit-packing"}


def test_defined_cases(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long, gone string, n_lines int"
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, "en", None, None, "a", 1), (2, "", "en", "s", 0, "b", 2), (3, "some text of a few words\n\nand more", None, "s", 9, "c", 3), (3, "some text of a few words\n\nand more", None, "s", 9, "c", 3), (None, "text without an id stays", "en", "s", 9, "d", 4), (5, long, "en", "s", len(long), "e", 5), (3, "another text under the same id", "en", "s", 1, "f", 6)]
    for name, part in (("some", rows), ("none", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(part, shape).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in pipe.STAGES[:-1]:
            docs = pipe.stored(stage(spark, docs, d), "t")
            assert docs.columns == [c.split()[0] for c in shape.split(", ")]
        kept = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        assert kept == sorted(((r[0], r[1]) for r in part), key=str)
        assert pipe.run(spark, d).select("doc_id").distinct().count() == len({r[0] for r in part})


def test_constants():
    assert len(pipe.STAGES) == 4 and pipe.ORACLE_SQL is None
