import datetime
import random

import pytest
from pyspark.sql import functions as F

from snipdex.operators import embed as M
from snipdex.operators import index as I
from snipdex.operators import sessions as S
from snipdex.session import scratch_path
from snipdex.sources.index_store import IndexStore
from snipdex.streaming import apply as A
from snipdex.streaming import changes as C
from snipdex.streaming import lifecycle as L

SCHEMA = "event_id long, path string, new_path string, change_type string, event_time timestamp"
MINUTE = 60_000_000
T0 = datetime.datetime(2024, 1, 1)


def event(i, path, kind, minutes, new=None):
    return (i, path, new, kind, T0 + datetime.timedelta(minutes=minutes))


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def feed(spark, *batches):
    """A stream that takes one file, and so one batch, per trigger."""
    folder = scratch_path(spark, "feed")
    for n, rows in enumerate(batches):
        table(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/part={n}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def drain(df, spark, mode="append"):
    out = scratch_path(spark, "out")
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def test_gap_is_inclusive(spark):
    rows = [event(1, "a", "Created", 0), event(2, "a", "Modified", 10), event(3, "a", "Deleted", 19.98)]
    rows += [event(4, "b", "Created", 0), event(5, "b", "Modified", 10.02)]
    got = sorted((r["path"], r["n_changes"], r["change_type"]) for r in S.debounce(table(spark, rows), 10 * MINUTE, 60 * MINUTE).collect())
    assert got == [("a", 3, "Deleted"), ("b", 1, "Created"), ("b", 1, "Modified")]


def brute_bursts(rows, gap):
    out = {}
    for i, path, _, kind, at in sorted(rows, key=lambda r: (r[1], r[4], r[0])):
        us = round((at - T0).total_seconds() * 1e6)
        bursts = out.setdefault(path, [])
        if bursts and us - bursts[-1][1] <= gap:
            bursts[-1] = (bursts[-1][0], us, bursts[-1][2] + 1, kind)
        else:
            bursts.append((us, us, 1, kind))
    return sorted((p, *b) for p, bs in out.items() for b in bs)


@pytest.mark.parametrize("span_minutes", [1, 7, 60, 100_000])
def test_debounce_matches_brute_force_with_a_hot_path(spark, span_minutes):
    rng = random.Random(5)
    rows = [event(i, "hot" if i % 3 == 0 else f"p{rng.randrange(9)}", rng.choice(["Created", "Modified", "Deleted"]), rng.randrange(0, 4000) / 4) for i in range(900)]
    base = round((T0 - datetime.datetime(1970, 1, 1)).total_seconds() * 1e6)
    got = S.debounce(table(spark, rows), 2 * MINUTE, span_minutes * MINUTE).collect()
    found = sorted((r["path"], r["first_us"] - base, r["last_us"] - base, r["n_changes"], r["change_type"]) for r in got)
    assert found == brute_bursts(rows, 2 * MINUTE)


def test_previous_in_group_with_a_hot_key(spark):
    rng = random.Random(6)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(5)}", rng.randrange(500), rng.choice("abc")) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, k string, us long, v string")
    got = {r["id"]: r["prev_v"] for r in S.previous_in_group(df, "k", "us", "id", ["v"], 13).collect()}
    want, last = {}, {}
    for i, k, us, v in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = last.get(k)
        last[k] = v
    assert got == want


def test_rename_split(spark):
    got = C.split_renames(table(spark, [event(1, "old", "Renamed", 0, "new"), event(2, "x", "Deleted", 1)])).collect()
    assert sorted((r["event_id"], r["path"], r["change_type"]) for r in got) == [(1, "new", "Created"), (1, "old", "Deleted"), (2, "x", "Deleted")]


def test_stream_gives_closed_bursts_as_the_batch_form(spark):
    rng = random.Random(7)
    rows = sorted((event(i, f"p{rng.randrange(4)}", rng.choice(["Modified", "Deleted"]), rng.randrange(0, 900)) for i in range(200)), key=lambda r: r[4])
    bursts = drain(C.debounce_stream(feed(spark, rows[:120], rows[120:]), "5 minutes", "0 seconds"), spark)
    streamed = sorted((r["path"], r["first_time"], r["last_time"], r["n_changes"], r["change_type"]) for r in bursts.collect())
    batch = S.debounce(table(spark, rows), 5 * MINUTE, 60 * MINUTE)
    batch = batch.select("path", F.timestamp_micros("first_us").alias("a"), F.timestamp_micros("last_us").alias("b"), "n_changes", "change_type")
    closed = batch.filter(F.col("b") + F.expr("INTERVAL 5 MINUTES") <= F.lit(rows[-1][4]))
    assert streamed == sorted(tuple(r) for r in closed.collect())


def test_held_bursts_come_from_the_state(spark):
    rng = random.Random(8)
    rows = sorted((event(i, f"p{rng.randrange(4)}", rng.choice(["Modified", "Deleted"]), rng.randrange(0, 900)) for i in range(200)), key=lambda r: r[4])
    bursts = C.debounce_stream(feed(spark, rows[:120], rows[120:]), "5 minutes", "0 seconds")
    out = scratch_path(spark, "out")
    bursts.writeStream.format("parquet").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out).awaitTermination()
    held = C.held_bursts(spark, out + "-state")
    batch = S.debounce(table(spark, rows), 5 * MINUTE, 60 * MINUTE)
    batch = batch.select("path", F.timestamp_micros("first_us").alias("a"), F.timestamp_micros("last_us").alias("b"), "n_changes", "change_type")
    both = spark.read.schema(bursts.schema).parquet(out).unionByName(held)
    assert 0 < held.count() <= 4
    assert sorted(tuple(r) for r in both.select("path", "first_time", "last_time", "n_changes", "change_type").collect()) == sorted(tuple(r) for r in batch.collect())


def test_late_events_are_dropped(spark):
    # A batch calls late what lies behind the watermark of the batch before it.
    first = [event(1, "a", "Created", 0), event(2, "z", "Created", 200)]
    second = [event(3, "z", "Modified", 210)]
    late = [event(4, "a", "Deleted", 1), event(5, "z", "Modified", 500)]
    got = drain(C.debounce_stream(feed(spark, first, second, late), "5 minutes", "10 minutes"), spark).collect()
    assert sorted((r["path"], r["change_type"]) for r in got) == [("a", "Created"), ("z", "Created"), ("z", "Modified")]


def test_repeated_events_are_dropped(spark):
    rows = [event(1, "a", "Created", 0), event(1, "a", "Created", 0), event(2, "a", "Modified", 1)]
    assert C.drop_repeats(table(spark, rows)).count() == 2
    assert drain(C.drop_repeats(feed(spark, rows, rows)), spark).count() == 2


def test_apply_and_replay(spark):
    texts = {"/r/a.py": "def a():\n  pass", "/r/b.py": "def b():\n  pass", "/r/c.txt": "plain"}
    files = spark.createDataFrame([("/r", p, t) for p, t in texts.items()], "root string, path string, text string")
    store = IndexStore(spark, scratch_path(spark, "applied"), buckets=2)

    def build(rows):
        return I.build_index(rows, M.hashed_tokens(4), 4)

    def files_of(wanted):
        # The stream may spell a path in another case than the listing: they share the file key.
        keyed = files.withColumn("file_key", I.file_key("path"))
        return keyed.join(wanted, ["root", "file_key"], "left_semi").drop("file_key")

    def bursts(*rows):
        df = spark.createDataFrame([("/r", p, T0 + datetime.timedelta(minutes=m), k) for p, m, k in rows], "root string, path string, last_time timestamp, change_type string")
        return df

    def paths():
        return sorted(r["file_path"] for r in store.read().collect())

    first = bursts(("/R/a.py", 0, "Created"), ("/r/b.py", 0, "Created"), ("/r/c.txt", 1, "Created"), ("/r/missing.py", 1, "Modified"))
    A.apply_bursts(first, store, files_of, build, "x-0")
    assert paths() == ["/r/a.py", "/r/b.py"]
    A.apply_bursts(bursts(("/r/a.py", 5, "Deleted"), ("/r/b.py", 5, "Deleted"), ("/r/b.py", 9, "Created")), store, files_of, build, "x-1")
    assert paths() == ["/r/b.py"]
    A.apply_bursts(bursts(("/r/a.py", 5, "Deleted"), ("/r/b.py", 5, "Deleted"), ("/r/b.py", 9, "Created")), store, files_of, build, "x-1")
    assert paths() == ["/r/b.py"] and store.read().count() == 1


def states(spark, rows):
    return spark.createDataFrame([(i, s, p, T0 + datetime.timedelta(minutes=m)) for i, s, p, m in rows], "event_id string, status string, path string, event_time timestamp")


def test_latest_state_and_retention(spark):
    rows = states(spark, [("a", "Pending", "p", 0), ("a", "Failed", "p", 1), ("a", "Failed", "p", 2), ("a", "Completed", "p", 3), ("b", "Pending", "q", 0)])
    got = {r["event_id"]: (r["status"], r["retry_count"]) for r in L.latest_state(rows).collect()}
    assert got == {"a": ("Completed", 2), "b": ("Pending", 0)}
    kept = L.retention(rows, "2024-01-01 01:00:00", "58 minutes")
    assert sorted((r["event_id"], r["status"]) for r in kept.collect()) == [("a", "Completed"), ("a", "Failed"), ("a", "Pending"), ("b", "Pending")]


def test_lifecycle_expires_silent_events(spark):
    folder = scratch_path(spark, "states")
    first = states(spark, [("a", "Pending", "p", 0), ("a", "Failed", "p", 1), ("b", "Completed", "q", 0), ("c", "Pending", "r", 300)])
    second = states(spark, [("a", "Processing", "p", 310), ("d", "Completed", "s", 900)])
    first.coalesce(1).write.parquet(folder + "/1")
    second.coalesce(1).write.parquet(folder + "/2")
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    with L.rocksdb_state(spark):
        got = drain(L.lifecycle_stream(stream, 400 * 60_000, "1 minute"), spark).collect()
    last = {}
    for r in sorted(got, key=lambda r: (r["last_us"], r["status"] == "Expired")):
        last[r["event_id"]] = (r["status"], r["retry_count"])
    assert last == {"a": ("Expired", 1), "b": ("Completed", 0), "c": ("Expired", 0), "d": ("Completed", 0)}


def test_texts_of_changed_files_are_found_once(spark):
    """What `build` gets is a stored table, not the plan that finds the texts."""
    from snipdex.streaming.apply import apply_bursts

    plans, stored_rows = [], []

    class Store:
        def replace_files(self, changed, fresh, change_id):
            stored_rows.extend(fresh.collect())

    def files_of(wanted):
        return wanted.select("root", "path", F.regexp_replace("path", "found_here", "x").alias("text"))

    def build(files):
        plans.append(files._jdf.queryExecution().optimizedPlan().toString())
        return files

    bursts = spark.createDataFrame([("/r", "/r/a.py", 1, "Created"), ("/r", "/r/a.py", 2, "Changed"), ("/r", "/r/b.py", 1, "Deleted")], "root string, path string, last_time int, change_type string")
    apply_bursts(bursts, Store(), files_of, build, "one")
    assert [(r.path, r.text) for r in stored_rows] == [("/r/a.py", "/r/a.py")]
    assert len(plans) == 1 and "found_here" not in plans[0]
