"""The stored text index against plain scans, load after load."""

import random

from pyspark.sql import functions as F

from attestry.operators import search as S
from attestry.operators import textindex
from attestry.session import scratch_path


def test_search_equals_a_scan_after_each_load(spark, monkeypatch):
    monkeypatch.setattr(textindex, "CHUNK_BITS", 5)  # many chunks per word
    rng, path, rows = random.Random(1), scratch_path(spark, "index"), []
    vocabulary = ["all", *[f"w{i}" for i in range(30)], "Ünïx", "x_1"]
    for load in range(3):
        new = [(1000 * load + i, " ".join(["all", *rng.choices(vocabulary, k=rng.randrange(12))]) if i % 17 else rng.choice([None, "", "..."])) for i in range(200)]
        textindex.append(spark.createDataFrame(new, "id bigint, text string"), "id", "text", path, load)
        if load == 1:  # run again: nothing doubles
            textindex.append(spark.createDataFrame(new, "id bigint, text string"), "id", "text", path, load)
        rows += new
        whole = spark.createDataFrame(rows, "id bigint, text string")
        for query in ("all", "w3 ALL", "w1 w2", "ünïx x_1 all", "w5 nowhere", "w7 w8 w9"):
            got = sorted(r.id for r in textindex.search(spark, path, query, "id").select("id").collect())
            assert got == sorted(r.id for r in whole.filter(S.has_words(F.col("text"), query)).collect()), query


def test_a_search_reads_only_the_folders_of_its_words(spark, folder):
    path = scratch_path(spark, "index")
    textindex.append(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text", path, 0)
    every = len(spark.read.parquet(f"{path}/postings").inputFiles())
    found = textindex.postings_of(spark, path, "les de")
    assert every > 50
    assert found.select(F.input_file_name()).distinct().count() <= 2
