"""Streams with timers: shuffled arrival gives what a batch gives, late events are counted, idle groups are forgotten."""

import datetime
import random

from wavemill.streaming import events

START = datetime.datetime(2024, 1, 1)
SCHEMA = "at timestamp, grp string"


def write(spark, path, files):
    for k, rows in enumerate(files):
        spark.createDataFrame([(START + datetime.timedelta(milliseconds=ms), g) for g, ms in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/part={k:03d}")


def run(spark, tmp_path, path, name, r, late):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    q = events.refractory_in_time(stream, r, late).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
    q.awaitTermination(300)
    zero = int(START.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    return sorted((x["grp"], x["t"] - zero) for x in spark.table(name).collect()), q


def batch(rows, r):
    out, last = [], {}
    for g, t in sorted(rows, key=lambda x: (x[0], x[1])):
        if g not in last or t - last[g] > r:
            out.append((g, t))
            last[g] = t
    return out


def test_shuffled_arrival(spark, tmp_path):
    r = random.Random(1)
    rows = sorted(((r.choice("ab"), r.randint(0, 60_000)) for _ in range(300)), key=lambda x: x[1])
    # every file holds a stretch of time and stragglers of the one before, less than ten seconds late
    files = [[] for _ in range(7)]
    for g, t in rows:
        files[min(6, t // 10_000 + (r.random() < 0.3))].append((g, t))
    for f in files:
        r.shuffle(f)
    path = str(tmp_path / "in")
    write(spark, path, [*files, [("end", 900_000)], [("end", 1_900_000)]])
    got, q = run(spark, tmp_path, path, "shuffled", 500, "25 seconds")
    want = batch(rows, 500)
    assert [x for x in got if x[0] != "end"] == want and events.dropped(q) == 0


def test_late_events_are_counted(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [[("a", 1000), ("a", 60_000)], [("a", 61_000)], [("a", 2000), ("a", 62_000)], [("end", 900_000)], [("end", 1_900_000)]])
    got, q = run(spark, tmp_path, path, "late", 100, "5 seconds")
    assert [x for x in got if x[0] == "a"] == [("a", 1000), ("a", 60_000), ("a", 61_000), ("a", 62_000)] and events.dropped(q) == 1
