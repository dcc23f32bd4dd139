"""Best-fit packing of tokenised documents into sequences, by a configuration linear program.

The histogram of piece lengths (as many rows as the capacity at most) is all that the plan needs. Lengths next to each other
form kinds, each as long as its longest. The linear program over configurations - multisets of kinds that fit a sequence - is
solved by multiplicative weights, with knapsack dynamic programming as the pricing step, and rounded to whole
sequences; what rounding leaves is solved again. The few pieces that no round places, and some of the
shortest that are set aside for it, fill what room is left by best fit. The plan says for each length which ranks go where, so
that pieces find their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace


@dataclass(frozen=True)
class Packing:
    """tokenizer: path of a `tokenizers` file. end: the id after each document. rounds: of multiplicative weights, for each solution. kinds:
    of lengths, at most. rate: of the weights' change. full: the least share of a sequence that a configuration fills. again: shares of the sequences, the
    emptiest, that are packed again by best fit while the plan is above the volume's bound. ranked: into how many parts the ranking of one length is split."""

    tokenizer: str
    capacity: int = 4096
    end: int = 1
    rounds: int = 512
    kinds: int = 512
    rate: float = 8.0
    full: float = 0.97
    again: tuple[float, ...] = (0.1, 0.3, 0.6)
    ranked: int = 64


class Ids:
    """The ids of texts, as little-endian bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its runs of other characters.
    Each run is encoded once and remembered, up to a number of runs; new ones are encoded together, a mark between any two.
    """

    MARK, LONG = "\x01", 64
    held: dict[str, Ids] = {}  # by path: a worker keeps them from task to task

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.mark = self._encode(self.MARK)
        self.known: dict[str, bytes] = {"": b""}

    @classmethod
    def at(cls, path: str) -> Ids:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")  # without places in the text

    def _learn(self, runs: set[str]) -> None:
        alone = [r for r in runs if len(r) > self.LONG or self.MARK in r or "<|" in r]
        for run in alone:
            self.known[run] = self._encode(run).tobytes()
        rest = list(runs.difference(alone))
        if len(self.mark) != 1:  # a tokenizer without such a mark
            self.known |= {r: self._encode(r).tobytes() for r in rest}
            return
        for at in range(0, len(rest), 5000):
            part = rest[at : at + 5000]
            ids = self._encode(f" {self.MARK} ".join(part))
            ends = np.flatnonzero(ids == self.mark[0])
            if len(ends) != len(part) - 1:
                raise ValueError("the mark does not stand alone")
            told = ids.tobytes()
            self.known |= zip(part, map(told.__getitem__, map(slice, [0, *(4 * ends + 4).tolist()], [*(4 * ends).tolist(), len(told)])), strict=True)

    def of(self, texts: list[str | None]) -> Iterator[bytes]:
        for at in range(0, len(texts), 256):
            runs = [(t or "").replace("\n", " ").replace("\t", " ").split(" ") for t in texts[at : at + 256]]
            new = set(chain.from_iterable(runs)).difference(self.known)
            self._learn(new)
            for own in runs:
                yield b"".join(map(self.known.__getitem__, own))
            for run in new:
                if len(run) > self.LONG:
                    del self.known[run]
            if len(self.known) > self.most:
                self.known = {"": b""}


def pieces(docs: DataFrame, how: Packing, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian) of every document's pieces. A null text is empty:
    its one piece is the end id. Only documents longer than the capacity are cut."""
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, end, width = Ids.at(how.tokenizer), np.array([how.end], "<u4").tobytes(), 4 * how.capacity
        for batch in batches:
            rows = []
            for doc, own in zip(batch["doc_id"], ids.of(batch["text"].tolist()), strict=True):
                own += end
                for k, at in enumerate(range(0, len(own), width)):
                    part = own[at : at + width]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), *[part] * with_ids))
            out = pd.DataFrame(rows, columns=[f.split()[0] for f in fields.split(", ")])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, fields)


def _knapsack(weight: np.ndarray, sizes: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """How often each kind is in the configuration of the greatest weight, `most` times at most, by dynamic programming over capacities."""
    items = []  # a kind's number in binary parts, each taken or not
    for i in np.flatnonzero((weight > 0) & (most > 0)):
        left, part = min(int(most[i]), capacity // int(sizes[i])), 1
        while left:
            items.append((i, min(part, left)))
            left -= min(part, left)
            part *= 2
    best, taken = np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), bool)
    for row, (i, k) in zip(taken, items, strict=True):
        width = int(sizes[i]) * k
        with_it = best[:-width] + weight[i] * k
        row[width:] = with_it > best[width:]
        np.maximum(best[width:], with_it, out=best[width:])
    config, c = np.zeros(len(sizes), np.int64), capacity
    for row, (i, k) in zip(taken[::-1], reversed(items), strict=True):
        if row[c]:
            config[i] += k
            c -= int(sizes[i]) * k
    return config


def kinds(histogram: dict[int, int], how: Packing) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lengths in order, the kind of each, and each kind's size: that of its longest. Kinds hold about the same volume."""
    lengths = np.array(sorted(histogram))
    volume = np.cumsum(lengths * np.array([histogram[x] for x in lengths]))
    kind = np.arange(len(lengths)) if len(lengths) <= how.kinds else np.unique((volume - 1) * how.kinds // volume[-1], return_inverse=True)[1]
    sizes = np.zeros(kind.max() + 1, np.int64)
    np.maximum.at(sizes, kind, lengths)
    return lengths, kind, sizes


@dataclass
class Solution:
    """Configurations (rows: how often each kind) with their shares, and by what part these and the volume that they leave uncovered are above the
    bound, the whole volume."""

    configs: np.ndarray
    shares: np.ndarray
    gap: float


def fractional(sizes: np.ndarray, need: np.ndarray, how: Packing) -> Solution:
    """Shares of configurations that cover every kind about as often as it occurs.

    Each round prices the configuration of the greatest weight; a kind weighs its size, more where it lags behind the others and less where
    it is ahead. All weights by size alone give the bound, the volume. It ends when all is covered, to half a step.
    """
    total = float(need @ sizes) / how.capacity
    rounds = max(1, min(how.rounds, int(np.ceil(total))))
    step, covered, found = total / rounds, np.zeros(len(sizes)), []
    while len(found) < 2 * rounds:
        ahead = covered / need - min(1.0, len(found) / rounds)
        most = np.maximum(np.floor((need - covered) / step + 1e-9), need - covered >= step / 2)
        config = _knapsack(sizes * np.exp(-how.rate * ahead), sizes, most, how.capacity)
        if not config.any():
            break
        covered += config * step
        found.append(config)
    configs, times = np.unique(np.array(found).reshape(-1, len(sizes)), axis=0, return_counts=True)
    uncovered = float(np.maximum(need - covered, 0) @ sizes) / how.capacity
    return Solution(configs, times * step, (len(found) * step + uncovered) / total - 1)


def _exactly(config: np.ndarray, times: int, stock: list[list[list[int]]]) -> list[tuple[Counter, int]]:
    """`times` sequences of a configuration of kinds, as lengths from the stock (of each kind: [length, number] ascending), longest first."""
    places = []
    for kind in np.flatnonzero(config):
        for _ in range(config[kind]):
            runs, wanted = [], times
            while wanted:
                last = stock[kind][-1]
                n = min(last[1], wanted)
                runs.append((last[0], n))
                wanted, last[1] = wanted - n, last[1] - n
                if not last[1]:
                    stock[kind].pop()
            places.append((np.array([x for x, _ in runs]), np.cumsum([n for _, n in runs])))
    ends = np.unique(np.concatenate([e for _, e in places]))
    return [(Counter(int(x[np.searchsorted(e, end)]) for x, e in places), int(end - start)) for start, end in zip([0, *ends[:-1]], ends, strict=True)]


def rounded(histogram: dict[int, int], how: Packing) -> tuple[list[tuple[Counter, int]], dict[int, int]]:
    """Whole sequences from solutions of the program, one after another on what is left, and the pieces that none of them placed."""
    left, out, aside = dict(histogram), [], Counter()
    lengths, kind, sizes = kinds(left, how)
    # kinds are as long as their longest: as much volume of the shortest pieces as that wastes is set aside to fill it
    waste = how.capacity // 2 + sum(int(sizes[k] - x) * left[x] for x, k in zip(lengths.tolist(), kind, strict=True))
    for x in lengths.tolist():
        n = min(left[x], waste // x)
        aside[x], left[x], waste = n, left[x] - n, waste - n * x
        if not n:
            break
    while any(left.values()):
        left = {x: n for x, n in left.items() if n}
        lengths, kind, sizes = kinds(left, how)
        number = np.bincount(kind, weights=[left[x] for x in lengths]).astype(np.int64)
        solved = fractional(sizes, number, how)
        stock: list[list[list[int]]] = [[] for _ in sizes]
        for x, k in zip(lengths.tolist(), kind, strict=True):
            stock[k].append([x, left[x]])
        placed = 0
        for i in np.argsort(-solved.shares, kind="stable"):
            config, used = solved.configs[i], solved.configs[i] > 0
            times = min(int(solved.shares[i] + 0.5), int((number[used] // config[used]).min()))
            if times and config @ sizes >= how.full * how.capacity:
                out += _exactly(config, times, stock)
                number -= times * config
                placed += times * int(config.sum())
        left = {x: n for own in stock for x, n in own}
        if 10 * placed < placed + sum(left.values()):
            break
    return out, Counter(left) + aside


def best_fit(left: dict[int, int], capacity: int, begun: Iterable[tuple[Counter, int]] = ()) -> list[tuple[Counter, int]]:
    """Configurations and multiplicities by best-fit decreasing into the sequences that are begun and new ones. Equal sequences are
    kept together, so the work follows the number of lengths and not of pieces."""
    room: dict[int, list[tuple[Counter, int]]] = defaultdict(list)
    order: list[int] = []  # the rooms that some sequence has, ascending

    def add(config: Counter, n: int, free: int) -> None:
        if not room[free]:
            insort(order, free)
        room[free].append((config, n))

    for config, n in begun:
        add(config, n, capacity - sum(x * k for x, k in config.items()))
    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            at = bisect_left(order, x)
            if at == len(order):
                fit = capacity // x
                if n >= fit:
                    add(Counter({x: fit}), n // fit, capacity - fit * x)
                if n % fit:
                    add(Counter({x: n % fit}), 1, capacity - n % fit * x)
                break
            free = order[at]
            config, m = room[free].pop()
            if not room[free]:
                order.pop(at)
            each = min(free // x, n)
            used = min(m, n // each)
            add(config + Counter({x: each}), used, free - each * x)
            if used < m:
                add(config, m - used, free)
            n -= used * each
    return [(config, n) for found in room.values() for config, n in found]


def plan(histogram: dict[int, int], how: Packing) -> list[tuple[Counter, int]]:
    """Whole configurations for all pieces: the linear program's, whose room takes up what it leaves, by best fit.

    Where that is more sequences than the volume needs, the emptiest of them, a growing share, are taken apart and their pieces packed again by best fit, as long as
    that saves some.
    """
    if not histogram:
        return []
    out, left = rounded(histogram, how)
    best = best_fit(left, how.capacity, out)
    bound = -(-sum(x * n for x, n in histogram.items()) // how.capacity)
    for share in how.again:
        if sum(n for _, n in best) <= bound:
            break
        kept, pieces = emptiest(best, share)
        best = min(best, tightened(kept, pieces, how.capacity) + best_fit(pieces, how.capacity), key=lambda p: sum(n for _, n in p))
    return best


def tightened(planned: list[tuple[Counter, int]], pieces: Counter, capacity: int) -> list[tuple[Counter, int]]:
    """The plan with pieces exchanged for longer ones among those given, as far as there is room: always the exchange that fills most. The given pieces change with it."""
    order = sorted(x for x, n in pieces.items() if n)
    out, todo = [], list(planned)
    while todo:
        config, n = todo.pop()
        free = capacity - sum(x * k for x, k in config.items())
        more = [(order[at - 1] - x, x) for x in config if (at := bisect_right(order, x + free)) and order[at - 1] > x]
        if not free or not more:
            out.append((config, n))
            continue
        gain, x = max(more)
        used = min(n, pieces[x + gain])
        pieces[x + gain] -= used
        if not pieces[x + gain]:
            order.remove(x + gain)
        if not pieces[x]:
            insort(order, x)
        pieces[x] += used
        new = config + Counter([x + gain])
        new.subtract([x])
        todo.append((+new, used))
        if used < n:
            todo.append((config, n - used))
    return out


def emptiest(planned: list[tuple[Counter, int]], share: float) -> tuple[list[tuple[Counter, int]], Counter]:
    """The plan without a share of its sequences, those with most room, and the pieces of these."""
    go = int(np.ceil(share * sum(n for _, n in planned)))
    kept, pieces = [], Counter()
    for config, n in sorted(planned, key=lambda c: sum(x * k for x, k in c[0].items())):
        gone = min(n, go)
        go -= gone
        for x, k in config.items():
            pieces[x] += gone * k
        if gone < n:
            kept.append((config, n - gone))
    return kept, pieces


def slots(planned: list[tuple[Counter, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank of each slot, the sequence of that rank (one more for each rank after it), and the offset."""
    ranks: Counter = Counter()
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for config, n in planned:
        offset = 0
        for x in sorted(config, reverse=True):
            for _ in range(config[x]):
                out[x].append((ranks[x], sequence, offset))
                ranks[x] += n
                offset += x
        sequence += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for x, rows in out.items()}


def pack(ws: Workspace, docs: DataFrame, how: Packing, with_ids: bool = False) -> DataFrame:
    """The pieces of docs(doc_id, text) with sequence_id and offset (and ids, for sequences()).

    Null doc_ids and repeated ones are documents of their own; other columns are ignored; no rows give no sequences.
    Pieces of a length are interchangeable, so which of them has which rank follows doc_id and piece alone.
    """
    cut = ws.save(pieces(docs, how, with_ids), "pieces")
    # at most `capacity` counts reach the driver, and the plan has a bounded number of slots for each of them
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    at = ws.spark.sparkContext.broadcast(slots(plan(histogram, how)))
    # rank among pieces of a length, without bringing a common length together: counts of its parts, then ranks within each
    part = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(how.ranked)))
    counts = part.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    counts = ws.save(counts.select("length", "part", before.alias("before")), "counts")
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = part.withColumn("rank", rank).join(counts, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = at.value
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            rank = batch["rank"].to_numpy()
            for x, rows in batch.groupby("length").indices.items():
                first, start, place = known[x]
                slot = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows], offset[rows] = start[slot] + rank[rows] - first[slot], place[slot]
            out = batch.drop(columns=["part", "rank", "before"]).assign(sequence_id=sequence, offset=offset)
            yield out.astype({"doc_id": "Int64"})

    fields = "length long, doc_id long, piece int, start long, ids_crc32 long" + ", ids binary" * with_ids
    names = [f.split()[0] for f in fields.split(", ")]
    placed = ranked.select(*names, "part", "rank", "before").mapInPandas(place, fields + ", sequence_id long, offset long")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids (little-endian bytes, at most `capacity` ids) of every sequence, from pack()'s pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
