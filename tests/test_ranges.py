"""Binary files by byte ranges: round trips byte for byte, ranges, and what is refused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.sources import files, ranges

SHAPES = {"dat": (3, "<i2"), "res": (1, "<i8"), "clu": (1, "<i4"), "fet": (5, "<i8"), "spk": (8, "<i2")}
OPTIONS = {"dat": {"channels": 3}, "res": {}, "clu": {}, "fet": {}, "spk": {"samples": 4, "channels": 2}}


def made(tmp_path, kind, n=1000):
    values, store = SHAPES[kind]
    x = np.random.default_rng(len(kind) + n).integers(-300, 300, (n, values)).astype(store)
    head = {"clu": np.array([len(np.unique(x))], "<i4"), "fet": np.array([values], "<i4")}.get(kind, np.zeros(0, "<i4")).tobytes()
    path = tmp_path / f"a.{kind}.1"
    path.write_bytes(head + x.tobytes())
    return str(path), x


@pytest.mark.parametrize("kind", sorted(SHAPES))
def test_round_trip(spark, tmp_path, kind):
    path, x = made(tmp_path, kind)
    number, value, shape, _ = ranges.KINDS[kind]
    df = ranges.read(spark, path, kind, bytes=500, **OPTIONS[kind])
    assert df.rdd.getNumPartitions() == -(-1000 // max(1, 500 // x[0].nbytes))
    got = sorted(df.collect())
    assert [r[number] for r in got] == list(range(1000))
    assert [r[value] for r in got] == (x.tolist() if shape.startswith("array") else x[:, 0].tolist())
    out = str(tmp_path / f"out-{kind}")
    ranges.write(df.repartition(5), out, kind, parts=4)
    ranges.joined(out, str(tmp_path / "one"))
    assert (tmp_path / "one").read_bytes() == open(path, "rb").read()
    # the parts are one file
    again = ranges.read(spark, out, kind, bytes=300, **OPTIONS[kind])
    assert sorted(again.collect()) == got and again.filter(F.col(number) == 700).collect() == [got[700]]
    with pytest.raises(FileExistsError):
        ranges.write(df, out, kind)


def test_ranges_choose_bytes(spark, tmp_path):
    path, x = made(tmp_path, "dat")
    df = ranges.read(spark, path, "dat", channels=3, bytes=60)
    for condition, want in (("sample >= 990", range(990, 1000)), ("sample < 7 AND sample > 2", range(3, 7)), ("sample = 500", [500]), ("sample BETWEEN 10 AND 12 AND xs[0] > -1000", range(10, 13)), ("sample > 5000", []), ("sample < 0", [])):
        part = df.filter(condition)
        assert sorted(r["sample"] for r in part.collect()) == list(want)
        assert part.rdd.getNumPartitions() <= 2  # only the ranges that hold them
    some = ranges.read(spark, path, "dat", channels=3, start=100, count=20, pick="2,0").collect()
    assert sorted((r["sample"], r["xs"]) for r in some) == [(i, [int(x[i, 2]), int(x[i, 0])]) for i in range(100, 120)]
    assert ranges.read(spark, path, "dat", channels=3, start=995, count=20).count() == 5


def test_a_large_file_is_many_tasks(spark, tmp_path):
    # five gigabytes that take no disk: holes read as zeros
    path = tmp_path / "big.dat"
    with open(path, "wb") as f:
        f.seek(5 * 2**30 - 8)
        f.write(np.array([1, 2, 3, 4], "<i2").tobytes())
    n = 5 * 2**30 // 8
    df = ranges.read(spark, str(path), "dat", channels=4)
    assert df.rdd.getNumPartitions() == 80
    assert [(r["sample"], r["xs"]) for r in df.filter(F.col("sample") >= n - 2).collect()] == [(n - 2, [0, 0, 0, 0]), (n - 1, [1, 2, 3, 4])]


def test_refused(spark, tmp_path):
    path, _ = made(tmp_path, "spk")
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="ends within a record"):
        ranges.read(spark, path, "spk", samples=4, channels=2).count()
    with pytest.raises(Exception, match="no-such"):
        ranges.read(spark, str(tmp_path / "no-such"), "res").count()
    (tmp_path / "empty.clu").write_bytes(b"")
    with pytest.raises(Exception, match="no header"):
        ranges.read(spark, str(tmp_path / "empty.clu"), "clu").count()
    (tmp_path / "empty.res").write_bytes(b"")
    assert ranges.read(spark, str(tmp_path / "empty.res"), "res").count() == 0
    fields = "spike_id long, t long"
    with pytest.raises(ValueError, match="null"):
        ranges.write(spark.createDataFrame([(0, 5), (1, None)], fields), str(tmp_path / "n"), "res")
    with pytest.raises(Exception, match="missing|gaps"):
        ranges.write(spark.createDataFrame([(0, 5), (2, 6)], fields), str(tmp_path / "g"), "res", parts=2)
    assert not [f for f in (tmp_path / "g").iterdir() if f.name.startswith("part-")]
    with pytest.raises(ValueError, match="records of 1 to 2"):
        ranges.write(spark.createDataFrame([(0, [1]), (1, [1, 2])], "sample long, xs array<int>"), str(tmp_path / "r"), "dat")
    with pytest.raises(Exception, match="(?i)overflow|fit|range"):
        ranges.write(spark.createDataFrame([(0, [70_000])], "sample long, xs array<int>"), str(tmp_path / "o"), "dat")
    with pytest.raises(Exception, match="does not fit"):
        ranges.write(spark.createDataFrame([(0, 2**40)], "spike_id long, cluster long"), str(tmp_path / "c"), "clu")


def test_text_and_binary_say_the_same(spark, tmp_path):
    path, x = made(tmp_path, "res", 50)
    (tmp_path / "text.res.1").write_text("\n".join(map(str, x[:, 0])))
    text = files.times(spark, str(tmp_path / "text.res.1")).select("spike_id", "t")
    assert sorted(text.collect()) == sorted(ranges.read(spark, path, "res").collect())
    ranges.write(text, str(tmp_path / "binary"), "res", parts=3)
    ranges.joined(str(tmp_path / "binary"), str(tmp_path / "joined"))
    assert (tmp_path / "joined").read_bytes() == x.tobytes()


@pytest.mark.parametrize("bits", [16, 32])
def test_slices_byte_for_byte(spark, tmp_path, bits):
    x = np.random.default_rng(bits).integers(-30_000, 30_000, (500, 6)).astype(f"<i{bits // 8}")
    path = tmp_path / "a.dat"
    path.write_bytes(x.tobytes())
    for k, (pick, start, count) in enumerate((("4,0,0", 0, None), ("5", 123, 200), ("0,1,2,3,4,5", 499, 1), ("2", 10, 0))):
        out = str(tmp_path / f"out{k}")
        ranges.sliced(spark, str(path), out, 6, pick, start, count, bits)
        ranges.joined(out, str(tmp_path / f"one{k}"))
        part = x[start:] if count is None else x[start : start + count]
        assert (tmp_path / f"one{k}").read_bytes() == part[:, [int(c) for c in pick.split(",")]].tobytes()
    for pick in ("", "1,", "a", "1-2", " 1", "6", "2*1.5"):
        with pytest.raises(ValueError, match="channel"):
            ranges.sliced(spark, str(path), str(tmp_path / "no"), 6, pick)
    for start, count in ((400, 200), (-1, 5), (501, None)):
        with pytest.raises(ValueError, match="samples"):
            ranges.sliced(spark, str(path), str(tmp_path / "no"), 6, "0", start, count, bits)
