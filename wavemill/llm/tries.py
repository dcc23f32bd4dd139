"""Target-distribution importance resampling over word tries.

A task reads its texts into a trie of words: a node is a run of words, and holds how often it came and the CRC state of its bytes, so a longer
run's bucket goes on from the state of the shorter. Tries stay in their tasks; only their totals per bucket are merged. A second pass walks each
document's paths again, with the gain of its bucket attached to each node. Documents are drawn by their mean gain and seeded Gumbel noise.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Bytes of a word: digits, letters and all of UTF-8 beyond ASCII; others separate words. A-Z become a-z.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Sampling:
    """runs: features are runs of 1 to so many words. buckets: of features. min_words: of a document that may be drawn. percent: of those, what is drawn, rounded
    down. seed: of the noise. nodes: of a task's trie at most, about; then its counts go to the totals and it starts anew, which changes no result."""

    runs: int = 2
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 25
    seed: int = 7
    nodes: int = 1_000_000


def _byte_table() -> np.ndarray:
    """What a byte does to a CRC-32, from its polynomial (a fixed value)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _byte_table()


def continued(state: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC states of texts (state) with tails of so many bytes behind them: the states moved on by as many zero bytes, and the tails' own CRCs."""
    state = state.copy()
    order = np.argsort(length)
    at = np.searchsorted(length[order], np.arange(length.max(initial=0)), side="right")
    for k in at:  # the tails that have a k-th byte
        some = order[k:]
        state[some] = (state[some] >> 8) ^ _TABLE[state[some] & 255]
    return state ^ tail


class Level:
    """The nodes of one depth: (parent << 32 | word) in order, and each one's number. By number: states, the CRC of the run's bytes, and counts, how often it came."""

    def __init__(self) -> None:
        self.keys, self.numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.states, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def grow(self, states: np.ndarray) -> None:
        self.states = np.concatenate([self.states, states])
        self.counts = np.concatenate([self.counts, np.zeros(len(states), np.int64)])


class Trie(dict):
    """A task's trie. Word -> its node below the root, which is the word's number as well; `levels` hold the nodes by depth."""

    def __init__(self, how: Sampling):
        self.how = how
        self.forget()

    def __missing__(self, word: bytes) -> int:
        node = self[word] = len(self)
        self._new.append(word)
        return node

    def forget(self) -> None:
        self.clear()
        self._new: list[bytes] = []
        self.levels = [Level() for _ in range(self.how.runs)]
        self._tails, self._lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def full(self) -> bool:
        return sum(len(level.states) for level in self.levels) > self.how.nodes

    def _words(self, texts: list[list[bytes]]) -> np.ndarray:
        own = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64)
        crc = lambda before: np.fromiter((zlib.crc32(before + w) for w in self._new), np.uint32, len(self._new))
        self.levels[0].grow(crc(b""))
        self._tails = np.concatenate([self._tails, crc(b" ")])
        self._lengths = np.concatenate([self._lengths, np.fromiter(map(len, self._new), np.int64, len(self._new)) + 1])
        self._new.clear()
        return own

    def walk(self, texts: list[list[bytes]]) -> Iterator[tuple[Level, np.ndarray, np.ndarray]]:
        """By depth: the level, and of every run of that many words its node and its text's place. Runs that are new get nodes."""
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        own = nodes = self._words(texts)
        yield self.levels[0], own, text
        for depth, (above, level) in enumerate(zip(self.levels, self.levels[1:], strict=False), 1):
            within = text[depth:] == text[: max(0, len(text) - depth)]
            keys, back = np.unique((nodes[: len(within)] << 32 | own[depth:])[within], return_inverse=True)
            at = np.searchsorted(level.keys, keys)
            new = at == len(level.keys)
            new[~new] = level.keys[at[~new]] != keys[~new]
            parent, word = keys[new] >> 32, keys[new] & 0xFFFFFFFF
            first = len(level.states)
            level.grow(continued(above.states[parent], self._tails[word], self._lengths[word]))
            level.keys = np.insert(level.keys, at[new], keys[new])
            level.numbers = np.insert(level.numbers, at[new], first + np.arange(new.sum()))
            found = level.numbers[np.searchsorted(level.keys, keys)]
            nodes = np.full(len(within), -1)
            nodes[within] = found[back]
            yield level, nodes[within], text[: len(within)][within]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def _slices(columns: Iterator[pa.Array], rows: int = 1024) -> Iterator[list[list[bytes]]]:
    """The words of texts, of a few at once."""
    for column in columns:
        for at in range(0, len(column), rows):
            yield [words(t) for t in column.slice(at, rows).to_pylist()]


def bucket_totals(texts: DataFrame, how: Sampling) -> np.ndarray:
    """How many features of all texts(text) fall to each bucket. Tasks send their totals per bucket; sums of those reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, totals = Trie(how), np.zeros(how.buckets, np.int64)

        def add() -> None:
            for level in trie.levels:
                np.add.at(totals, level.states % how.buckets, level.counts)
            trie.forget()

        for texts in _slices(batch.column("text") for batch in batches):
            for level, nodes, _ in trie.walk(texts):
                level.counts += np.bincount(nodes, minlength=len(level.counts))
            if trie.full():
                add()
        add()
        found = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(totals[found])], names=["bucket", "n"])

    parts = texts.select("text").mapInArrow(run, "bucket long, n long")
    out = np.zeros(how.buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of its smoothed shares in the target and in all documents, in thousandths, rounded down."""
    t, s, n = target.astype(float), raw.astype(float), float(len(raw))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, how: Sampling) -> DataFrame:
    """doc_id, n_words, n_features and weight, the mean gain of a document's features rounded down, of every row of docs(doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # a number per bucket

    @F.arrow_udf("struct<n_words:long,n_features:long,weight:long>")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = Trie(how)
        for column in columns:
            out, at = np.zeros((3, len(column)), np.int64), 0
            for texts in _slices(iter([column])):
                part = out[:, at : at + len(texts)]
                part[0] = list(map(len, texts))
                for level, nodes, text in trie.walk(texts):
                    part[1] += np.bincount(text, minlength=len(texts))
                    np.add.at(part[2], text, sent.value[level.states % how.buckets][nodes])
                part[2] //= np.maximum(part[1], 1)
                at += len(texts)
                if trie.full():
                    trie.forget()
            yield pa.StructArray.from_arrays(list(map(pa.array, out)), names=["n_words", "n_features", "weight"])

    return docs.select("doc_id", score("text").alias("_s")).select("doc_id", "_s.*")


def noise(doc_id: Column, how: Sampling) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a digest of seed and doc_id (null: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(ws: Workspace, docs: DataFrame, target: DataFrame, how: Sampling = Sampling()) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs(doc_id, text), drawn towards target(text); other columns are not read.

    Null and empty texts have no features and weight 0. Of the rows with enough words a share is drawn, those with the highest scores, ties by the smaller
    doc_id, null ones last; the rank of the others is null. Repeated rows are ranked one after another. An empty target, or no documents, are counted as
    no features. Empty: no rows.
    """
    gain = gains(bucket_totals(target, how), bucket_totals(docs, how))
    rows = weighed(docs, gain, how).withColumn("score", F.col("weight") + noise(F.col("doc_id"), how))
    scored = ws.save(rows.withColumn("able", F.col("n_words") >= how.min_words).drop("n_words"), "scored")
    # scores are whole thousandths of logarithms, so there are few: their counts say where each one's ranks begin
    counts = scored.filter("able").groupBy("score").agg(F.count("*").alias("n")).toPandas().sort_values("score", ascending=False)
    want = how.percent * int(counts["n"].sum()) // 100
    before = counts["n"].cumsum() - counts["n"]
    drawn = counts.assign(before=before)[before < want]
    starts = ws.spark.createDataFrame(list(zip(drawn["score"].tolist(), drawn["before"].tolist(), strict=True)), "_score long, _before long")
    lowest = int(drawn["score"].min()) if len(drawn) else None
    among = F.col("able") & (F.col("score") >= lowest) if len(drawn) else F.lit(False)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())) + F.col("_before")
    ranked = scored.filter(among).join(F.broadcast(starts), F.col("score") == F.col("_score")).withColumn("rank", place)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= want, F.col("rank")))
    rest = scored.filter(~among).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
