"""Patterns of channel differences."""

import pytest
from pyspark.sql import functions as F

from wavemill.functions import arrays, patterns


def test_patterns(spark):
    assert patterns.pairs("0-1,1-3, 2 -3") == {0: [1], 1: [3], 2: [3], 3: [1]}
    assert patterns.sets("0-1+2,1-0,2-0+1") == {0: [1, 2], 1: [0], 2: [0, 1]}
    assert patterns.by_group("0-1::0-1+2,1-0,2-0") == [{0: [1], 1: [0]}, None, {0: [1, 2], 1: [0], 2: [0]}]
    t = spark.createDataFrame([([5, 7, 1],)], "xs array<long>")
    row = t.select(arrays.referenced(F.col("xs"), patterns.partners("0-1+2,1-0,2-0")).alias("y"), arrays.referenced(F.col("xs"), patterns.partners("0-1,1-2")).alias("z")).first()
    assert row["y"] == [1.0, 2.0, -4.0] and row["z"] == [-2.0, 6.0, -6.0]


@pytest.mark.parametrize("text", ["", "0", "0-0", "0-1,0-2", "x-1", "0-1+2", "1-0", "0-1,1-0,2-3", "0-2", "-1-2", "0-1-2"])
def test_pairs_refused(text):
    with pytest.raises(ValueError, match="channel|pair|partner"):
        patterns.pairs(text)


@pytest.mark.parametrize("text", ["", "0+1", "0-0+1", "0-1+1,1-0", "0-1,0-1", "0-1+2,1-0", "0-,1-0"])
def test_sets_refused(text):
    with pytest.raises(ValueError, match="channel|set|partner"):
        patterns.sets(text)
