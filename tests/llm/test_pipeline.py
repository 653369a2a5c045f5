import shutil

from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm.near_dedup import drop_near
from lodestone.llm.quality_classifier import keep_good
from lodestone.llm.shared import without, written

from .common import documents, empty


def test_stages_chain(spark, tmp_path):
    docs = documents(spark).unionByName(documents(spark, 9).withColumn("doc_id", F.col("doc_id") + 10_000))
    shutil.copy("/root/testdata/sf0.001/labels.parquet", tmp_path / "labels.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        counts.append(now.count())
    assert counts[0] >= counts[1] >= counts[2] > 0 and counts[4] >= 1
    run = corpus_pipeline.run(spark, str(tmp_path))
    pick = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(str, run.select(*pick).collect())) == sorted(map(str, now.select(*pick).collect()))


def test_results_do_not_depend_on_partitions(spark, tmp_path):
    """The same pieces whatever the input's files and the number of shuffle partitions."""
    docs = documents(spark)
    shutil.copy("/root/testdata/sf0.001/labels.parquet", tmp_path / "labels.parquet")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for files, parts in ((1, "4"), (7, "9"), (3, "2")):
            docs.repartition(files).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            run = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens")
            found.append(sorted(map(str, run.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and found[0]


def test_empty_table(spark, tmp_path):
    shutil.copy("/root/testdata/sf0.001/labels.parquet", tmp_path / "labels.parquet")
    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_ten_operators_are_registered():
    from lodestone.llm.queries import QUERIES

    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    assert [k for k, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5


def test_texts_that_stay_are_not_dealt(spark):
    """What the quality and near stages drop is joined with marked rows only; the result is that of the plain join."""
    docs = documents(spark).withColumn("__word", F.lit("x")).cache()
    gone = written(docs.where("doc_id is null or doc_id in (3, 300, 305)").select(F.col("doc_id").alias("gone_id"), F.xxhash64("text").alias("gone_key")).distinct(), "gone")
    key = F.xxhash64("d.text")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.gone_id")) & (key == F.col("g.gone_key"))
    want = sorted(map(str, docs.alias("d").join(gone.alias("g"), same, "left_anti").collect()))
    for bits in (6, 24):  # one word, in which rows meet marks by chance, too
        got = without(docs, gone, same, key, F.col("g.gone_key"), bits)
        assert got.columns == docs.columns and sorted(map(str, got.collect())) == want
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (keep_good(docs, labels), drop_near(docs, similarity=0.8, width=5)):
            plan = df._jdf.queryExecution().sparkPlan()
            assert plan.nodeName() == "Union" and "SortMergeJoin" not in plan.children().apply(0).toString() and "SortMergeJoin" in plan.children().apply(1).toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
