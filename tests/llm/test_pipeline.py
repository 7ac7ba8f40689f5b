import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from verdara.llm import fertility, personal
from verdara.llm.simhash import text_print

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(10_000)
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(
        docs.where("doc_id < 3").withColumn("text", F.lit(None).cast("string")))
    out = [docs.withColumn("kept", F.lit("x")).withColumn("_row", F.lit(1))]
    out[0].write.parquet(path := str(tmp_path_factory.mktemp("p") / "in"))
    out = [spark.read.parquet(path)]
    for name, stage in C.STAGES:
        stage(spark, out[-1], SF).write.parquet(path := str(tmp_path_factory.mktemp("p") / name))
        out.append(spark.read.parquet(path))
    return out


def test_columns_stay(stages):
    for s in stages[1:4]:
        assert s.columns == stages[0].columns


def test_quality_keeps_what_the_rules_keep(stages):
    measured = fertility.measure(stages[0].drop("kept"))
    judged = fertility.judge(measured, fertility.fit_bands(measured))
    want = sorted(r["doc_id"] for r in judged.where("kept").collect())
    assert sorted(r["doc_id"] for r in stages[1].collect()) == want and len(want) > 100


def test_one_of_each_group_stays(stages):
    before, after = stages[1].collect(), stages[2].collect()
    prints = {r["doc_id"]: text_print(r["text"]) % 2 ** 64 for r in before}
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(r["doc_id"] for r in after) == sorted({find(i) for i in ids})


def test_personal_data_is_gone(stages):
    clean = {r["doc_id"]: r for r in stages[3].collect()}
    assert len(clean) == stages[2].count()
    for r in stages[2].collect():
        (base, spans), = personal.all_spans([r["text"]], personal.trained())
        assert clean[r["doc_id"]]["text"] == personal.redacted(r["text"], spans)
        assert clean[r["doc_id"]]["n_chars"] == len(clean[r["doc_id"]]["text"])


def test_every_document_is_packed_whole(stages):
    rows = stages[4].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("n_tokens").alias("t")).collect()
    assert all(r["n"] == r["t"] for r in rows) and len(rows) == stages[3].count()


def test_empty_input(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in C.STAGES[:3]:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
    assert C.pack(spark, docs, SF).collect() == []
