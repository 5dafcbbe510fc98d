"""The whole pipeline on small tables with nulls, copies, leaks and clashing columns."""

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
LEAK = " ".join(f"leaked{i} word{i * 7}" for i in range(30))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, LEAK), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    body = " ".join(f"some{i} calm{i % 5} words{i * 3}" for i in range(40))
    odd = [(900_001, body), (900_002, body), (900_003, body + " end"), (900_004, "Before it. " + LEAK + " after it."), (900_005, "password = hunter22abc " + " ".join(f"p{i}" for i in range(60))), (900_006, None), (900_007, ""), (None, "no id but text"), (None, None)]
    more = spark.createDataFrame(odd, "doc_id long, text string").join(docs.limit(1).select("lang", "source"), how="cross").withColumn("n_chars", F.length("text"))
    docs = docs.unionByName(more.select(*[F.col(c).cast(t) for c, t in docs.dtypes]))
    names = ("key", "class", "spans", "component_id", "kept", "score", "sequence_id", "n")
    docs.withColumns({c: F.lit("mine") for c in names}).write.parquet(f"{d}/documents.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, seen = docs, {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        seen[name] = docs
        if name != "packing":
            assert docs.dtypes == before.dtypes, name
            if "class" in docs.columns:
                assert docs.where("`class` <> 'mine' or spans <> 'mine' or key <> 'mine'").count() == 0
    ids = {n: [r[0] for r in d.select("doc_id").collect()] for n, d in seen.items()}
    kept = set(ids["quality"])
    assert {900_001, 900_002} <= kept or not {900_001, 900_002} & kept
    copies = [i for i in (900_001, 900_002, 900_003) if i in kept]
    assert [i for i in copies if i in ids["near_duplicates"]] == copies[:1]
    assert 900_004 not in ids["decontamination"]
    assert not seen["secrets"].where("text like '%hunter22abc%'").count()
    assert sorted(map(str, ids["secrets"])) == sorted(map(str, ids["decontamination"]))
    assert {str(i) for i in ids["packing"]} == {str(i) for i in ids["secrets"]}
    for _, d in seen.items():
        d.unpersist()


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
