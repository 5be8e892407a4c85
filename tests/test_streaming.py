import datetime as dt

from pyspark.sql import functions as F

from strataloom.operators import memory
from strataloom.operators.index import Store
from strataloom.streaming import state


def write(spark, path, rows, schema, part):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append" if part else "overwrite").parquet(path)


TURNS = "session_id string, id bigint, ts timestamp, topics array<string>"
T = dt.datetime(2024, 5, 1, 9)


def turns(n=30):
    return [(f"s{i % 3}", i, T + dt.timedelta(hours=i), [f"t{i % 7}", "Shared" if i % 2 else "shared"]) for i in range(n)]


def test_streams_equal_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = turns()
    write(spark, path, rows[:12], TURNS, 0)
    write(spark, path, rows[12:], TURNS, 1)
    batch = spark.read.parquet(path)
    stream = state.table_stream(spark, path, batch, files_per_trigger=1)
    got = state.collected(state.interest_stream(stream.select(F.explode("topics").alias("topic"), "ts"), "topic", "ts"), str(tmp_path / "interests"))
    last = got.groupBy("topic").agg(F.max_by("weight", "n").alias("weight"), F.max("n").alias("n"))
    want = memory.interests(batch.select(F.explode("topics").alias("topic"), "ts"), "topic", "ts").select("topic", "weight", "n")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
    days = state.collected(state.timeline_stream(stream, "ts"), str(tmp_path / "days")).groupBy("date").agg(F.max("n"))
    assert sorted(map(tuple, days.collect())) == sorted(map(tuple, batch.groupBy(F.to_date("ts")).count().collect()))
    one = spark.readStream.schema(batch.schema).parquet(path)
    rolled = state.collected(state.session_stream(one, "session_id", "id", "topics", 4), str(tmp_path / "sessions"))
    assert {r["session_id"]: r["n"] for r in rolled.groupBy("session_id").agg(F.max("n").alias("n")).collect()} == {"s0": 10, "s1": 10, "s2": 10}


def test_pages_are_synced_once(spark, tmp_path):
    schema = "id string, updated_time timestamp, content_hash string, title string"
    path, store = str(tmp_path / "pages"), Store(spark, str(tmp_path / "store"))
    write(spark, path, [("a", T, "h1", "old"), ("b", T, "h1", "b"), ("a", T + dt.timedelta(1), "h2", "new")], schema, 0)
    run = lambda: state.sync_pages(spark.readStream.schema(schema).parquet(path), store, "pages", str(tmp_path / "ck")).awaitTermination()
    run()
    assert {r["id"]: r["title"] for r in store.read("pages").collect()} == {"a": "new", "b": "b"}
    # a late older state, an unchanged one and a new page
    write(spark, path, [("a", T, "h0", "late"), ("b", T + dt.timedelta(2), "h1", "same"), ("c", T, "h1", "c")], schema, 1)
    run()
    assert {r["id"]: r["title"] for r in store.read("pages").collect()} == {"a": "new", "b": "b", "c": "c"}


def test_a_failing_sink_stops_no_other(spark, tmp_path, capsys):
    path = str(tmp_path / "in")
    write(spark, path, turns(5), TURNS, 0)
    seen = []

    def bad(df, n):
        raise RuntimeError("no")

    q = state.fan_out(spark.readStream.schema(TURNS).parquet(path), str(tmp_path / "ck"), bad=bad, good=lambda df, n: seen.append(df.count()))
    q.awaitTermination()
    assert sum(seen) == 5 and q.exception() is None


def test_embed_pages(spark, tmp_path):
    from strataloom.functions.text import hash_embedding

    spark.createDataFrame([("p", "some text"), ("q", None)], "id string, content string").write.parquet(str(tmp_path / "pages"))
    pages = state.table_stream(spark, str(tmp_path / "pages"), spark.read.parquet(str(tmp_path / "pages")))
    store = Store(spark, str(tmp_path / "store"))
    state.embed_pages(pages, store, "c", str(tmp_path / "c1"), hash_embedding).awaitTermination()
    assert [(r["id"], len(r["embedding"])) for r in store.read("c").collect()] == [("p::0", 16)]
    no = lambda c: F.raise_error(F.concat(F.lit("no "), c)).cast("array<double>")
    # what is known isn't embedded again
    state.embed_pages(pages, store, "c", str(tmp_path / "c2"), no).awaitTermination()
    assert store.read("c_stats").first()["status"] == "ok"
    spark.createDataFrame([("r", "new text")], "id string, content string").write.mode("append").parquet(str(tmp_path / "pages"))
    state.embed_pages(pages, store, "c", str(tmp_path / "c3"), no).awaitTermination()
    assert store.read("c").count() == 1
    (r,) = store.read("c_stats").collect()
    assert r["pages"] == 3 and r["status"].startswith("failed")
