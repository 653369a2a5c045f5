import json
import time

import pytest
from pyspark.sql import functions as F

from lodestone.sources import annotator as A
from lodestone.sources import files
from lodestone.streaming import events as live


def test_sites_with_repaired_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("CustomerName, Address ,NameHotel,Ratting,Date\nNam,Huế,Sun,8..5,2020-01-01\n", encoding="utf-8-sig")
    (tmp_path / "b.csv").write_text('CustomerName,NameHotel,Rating\n"Lan ""x"", y",Sea,9\n', encoding="utf-8")
    df = files.load_sites(spark, {"one": str(tmp_path / "a.csv"), "two": str(tmp_path / "b.csv")})
    got = {r.source: (r.CustomerName, r.Location, r.Rating) for r in df.collect()}
    assert got == {"one": ("Nam", "Huế", "8..5"), "two": ('Lan "x", y', None, "9")}
    with pytest.raises(ValueError):
        files.load_sites(spark, {})


def test_cache_keeps_the_last_good_record(spark, tmp_path):
    lines = [{"id": "a", "label": 0, "ts": "1"}, {"id": "a", "label": 1, "ts": "2"}, {"id": "b", "label": 1, "ts": "1"}]
    (tmp_path / "c.jsonl").write_text("\n".join([*map(json.dumps, lines), "", "{broken"]))
    got = files.read_cache(spark, str(tmp_path / "c.jsonl"), "id string, label int, ts string")
    assert {r.id: r.label for r in got.collect()} == {"a": 1, "b": 1}


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "q", é', 1.5), ("b", None, None)], "k string, t string, v double")
    files.write_csv(df, str(tmp_path / "x"), single=True)
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "x"), "k string, t string, v double").collect())) == sorted(map(tuple, df.collect()))
    files.export_csv(df, str(tmp_path / "bom.csv"))
    assert files.read_csv(spark, str(tmp_path / "bom.csv")).columns == ["k", "t", "v"]
    with pytest.raises(ValueError):
        files.export_csv(df, str(tmp_path / "no.csv"), most=1)
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    text = files.markdown(df)
    assert text.splitlines()[0] == "| k | t | v |" and "—" in text and "1.5000" in text
    new = spark.createDataFrame([("b", "new", 2.0), ("c", "y", 3.0)], df.schema)
    assert {r.k: r.t for r in files.upsert(df, new, "k").collect()} == {"a": 'x "q", é', "b": "new", "c": "y"}
    first = files.first_present([df.select("k", F.col("v").alias("x")), new.select("k", F.col("v").alias("x"))], "k", "x")
    assert {r.k: r.x for r in first.collect()} == {"a": 1.5, "b": 2.0, "c": 3.0}
    with pytest.raises(ValueError):
        files.load_fold(spark, str(tmp_path), "nope")


def test_embeddings_are_cached(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def encode(texts):
        with open(calls, "a") as f:
            f.write("x")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, None)], "k int, t string")
    for _ in range(2):
        got = files.cached_embeddings(df, str(tmp_path / "e"), "t", "enc", encode)
    assert {r.k: r.embedding for r in got.collect()} == {1: [3.0], 2: [0.0]}
    before = len(open(calls).read())
    files.cached_embeddings(df, str(tmp_path / "e"), "t", "enc", encode).collect()
    assert len(open(calls).read()) == before


class Stub:
    """Answers by prompt; fails once before each good answer."""

    def __init__(self):
        self.seen = set()

    def __call__(self, request):
        if request.prompt not in self.seen:
            self.seen.add(request.prompt)
            return A.Response(503)
        if request.prompt == "bad":
            return A.Response(200, "no label")
        if request.prompt == "gone":
            return A.Response(404, error="missing")
        return A.Response(200, 'ok ```{"label": 1, "reason": "r"}```', "m", 5, 2)


def factory():
    import lodestone.sources.annotator as own

    own.time.sleep = lambda s: None
    return Stub()


def test_annotation(spark):
    items = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", "gone"), ("4", "cached")], "id string, prompt string")
    cache = spark.createDataFrame([("4", 1)], "id string, label int")
    got = {r.id: r for r in A.annotate(items, cache, factory, parallel=1).collect()}
    assert set(got) == {"1", "2", "3"} and got["1"].label == 1 and got["1"].prompt_tokens == 5
    assert got["2"].label is None and got["2"].attempts == 3 and got["3"].error == "missing"
    assert A.annotate(items, cache, factory, dry_run=True).count() == 3
    assert A.usage(A.annotate(items, cache, factory, parallel=1), 1e6).where("model = 'm'").first().cost == 5.0
    with pytest.raises(ValueError):
        A.check_effort("huge")


def test_refused_credentials_stop_and_temperature_is_dropped():
    with pytest.raises(A.AuthError):
        A.retrying(lambda r: A.Response(401))(A.Request("x", 0))
    request = A.Request("x", 0, {"temperature": 0})
    answers = iter([A.Response(400, error="temperature is not supported"), A.Response(200, "fine")])
    assert A.retrying(lambda r: next(answers))(request).content == "fine" and not request.options
    with pytest.raises(A.RequestError):
        A.retrying(lambda r: A.Response(500), tries=2, sleep=lambda s: None)(A.Request("x", 0))


def test_prompts(spark):
    df = spark.createDataFrame([("a", " ")], "x string, y string")
    assert df.select(A.prompt_of("%s in %s", F.col("x"), F.col("y"))).first()[0] == "a in (unknown)"


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_streams_agree_with_batches(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    src = str(tmp_path / "in")
    ev.repartition(3).write.parquet(src)
    drain(live.first_only(live.stream(spark, src, ev.schema, 10), ["user_id", "event_type"], late="3650 days"), "firsts")
    assert spark.table("firsts").count() == ev.select("user_id", "event_type").distinct().count()
    drain(live.windowed(live.stream(spark, src, ev.schema, 10), late="3650 days"), "wins", "complete")
    assert spark.table("wins").agg(F.sum("n")).first()[0] == ev.count() and spark.table("wins").count() == live.windowed(ev).count()
    drain(live.running_users(live.stream(spark, src, ev.schema)), "users", "update")
    last = spark.table("users").groupBy("user_id").agg(F.max("n").alias("n"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, ev.groupBy("user_id").count().collect()))


def test_upserts(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k int, v string"
    for n, rows in enumerate(([(1, "a"), (2, "b")], [(2, "c")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        live.upsert_sink(live.stream(spark, src, schema), out, "k", str(tmp_path / "cp")).awaitTermination(120)
        time.sleep(1)
    assert {r.k: r.v for r in live.latest(spark, out, "k").collect()} == {1: "a", 2: "c"}


def test_appending_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "cache")
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "id string, ts int")
    for _ in range(2):
        files.append_cache(df, path, "id", "id string, ts int")
    files.append_cache(spark.createDataFrame([("c", 3), ("b", 9)], "id string, ts int"), path, "id", "id string, ts int")
    assert sorted((r.id, r.ts) for r in spark.read.json(path).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_embeddings_of_changed_texts_are_worked_out_anew(spark, tmp_path):
    df = spark.createDataFrame([(1, "abc")], "k int, t string")
    encode = lambda texts: [[float(len(t))] for t in texts]
    a = files.cached_embeddings(df, str(tmp_path / "e"), "t", "enc", encode)
    b = files.cached_embeddings(df.withColumn("t", F.lit("abcd")), str(tmp_path / "e"), "t", "enc", encode)
    assert a.first().embedding == [3.0] and b.first().embedding == [4.0]


def test_folders_are_found_upwards(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "x" / "y").mkdir(parents=True)
    assert files.find_folder(spark, str(tmp_path / "x" / "y"), "data") == f"{tmp_path}/data"
    with pytest.raises(FileNotFoundError):
        files.find_folder(spark, str(tmp_path / "x"), "nothing-like-this", levels=2)


def test_long_frames_are_no_markdown(spark):
    with pytest.raises(ValueError):
        files.markdown(spark.range(5), most=4)
    assert files.markdown(spark.range(4), most=4).count("\n") == 6
