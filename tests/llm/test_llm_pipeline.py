"""The pipeline beside plain steps on a small table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

LINE = "this boilerplate line stands in a lot of the documents here"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(1)
    prose = lambda n: " ".join(f"p{rng.randrange(5000)}" for _ in range(n))
    docs = [(i, prose(60)) for i in range(200)]
    docs += [(i, prose(20) + " idiot scum " + prose(20) + " trash moron " + prose(9)) for i in range(200, 260)]
    docs += [(i, LINE + "\n" + prose(50)) for i in range(260, 280)]
    base = prose(80).split()
    docs += [(i, " ".join(base[:k] + ["x"] + base[k + 1 :])) for i, k in zip(range(280, 290), range(0, 3))]
    item = prose(30)
    docs += [(300, prose(20) + "\n" + item + "\n" + prose(20)), (301, ""), (302, None), (None, prose(30))]
    rows = [(i, t, "en", "s" + str((i or 0) % 3), len(t or ""), "kept") for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(200 <= i < 260)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_each_stage_takes_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    steps = {}
    for name, work in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(work(spark, docs, tables).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
        steps[name] = {r["doc_id"]: r for r in docs.collect()}
    everything = {*range(200), *range(200, 283), 300, 301, 302, None}
    assert set(steps["toxicity"]) == everything - set(range(200, 260))
    lines = steps["line dedup"]
    assert set(lines) == set(steps["toxicity"]) and [i for i, r in lines.items() if LINE in (r["text"] or "")] == [279]
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values() if r["text"] is not None)
    assert set(lines) - set(steps["near duplicates"]) == {281, 282}
    assert set(steps["near duplicates"]) - set(steps["decontamination"]) == {300}


def test_run_gives_the_stages_in_order(spark, tables):
    found = corpus_pipeline.run(spark, tables).collect()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "decontamination", "mixing"]
    assert {r["doc_id"] for r in found} == {*range(200), *range(260, 281), 301, 302, None}
    sizes = {r["source"]: (r["source_size"], r["target"]) for r in found}
    total = sum(size for size, _ in sizes.values())
    assert [round(sizes[s][1] * 6 / total) for s in ("s0", "s1", "s2")] == [1, 2, 3]
    assert all(abs(sum(r["taken"] for r in found if r["source"] == s) - sizes[s][1]) < 1 for s in sizes)


def test_pipeline_of_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
