"""MinHash near-duplicates by an LSH forest, confirmed on the full shingle sets.

Texts with equal shingle sets are one class from the start. Each class has one label in each of several
trees: a row of min-hashes. A tree is kept as its labels in sorted order, range partitioned, so that a crowded region
spreads over tasks as any other. Candidates are the neighbours in that order, by their longest common prefix: where
few labels share a prefix these are all of them, where many do the neighbours are those that agree deepest. Neighbours on
either side of a partition's border meet in a second pass over the border rows.

What a crowded region still leaves apart is found exactly: two linked sets share one of the few rarest shingles of each, so the
region's classes are joined on those, only across groups that are not yet connected. Links need the whole sets; groups are
connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, Workspace, components, mixed

U = np.uint64


@dataclass(frozen=True)
class Forest:
    """trees labels of `depth` min-hashes each; `least` must agree for a candidate; `near` neighbours after each label, and
    `dense` where more labels than those share that prefix, so where the order is deep and an exact join follows. shingle: words.
    Linked: similarity * union <= intersection, in hundredths. sent: up to so many ids go to every task. order: bits of the hashed
    counts by which shingles are ranked from rare to frequent; any ranking gives the same links."""

    trees: int = 16
    depth: int = 8
    least: int = 3
    near: int = 8
    dense: int = 3
    shingle: int = 5
    percent: int = 80
    sent: int = 1_000_000
    order: int = 18
    seed: int = 7


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; fewer words than `size` are one shingle, none give none."""
    h = hashes.of(text)
    if not len(h):
        return h
    k = min(size, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, U)
    for i in range(k):
        out = mixed(out * U(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def _labels(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    low = np.full(len(a), np.iinfo(U).max, U)
    for i in range(0, len(x), 2048):
        np.minimum(low, ((x[None, i : i + 2048] ^ b[:, None]) * a[:, None]).min(1), out=low)
    return (mixed(low) >> U(48)).astype(">u2").tobytes()


def _sketch(labels: bytes) -> np.ndarray:
    """The lowest bit of each min-hash, 64 to a number."""
    bits = np.frombuffer(labels, ">u2").astype(np.uint8) & 1
    bits = np.pad(bits, (0, -len(bits) % 64))
    return np.packbits(bits).view(">i8").astype(np.int64)


def _least_bits(how: Forest) -> int:
    """Equal bits of two sketches that a linked pair has but once in millions: five standard deviations below their mean."""
    n, p = how.trees * how.depth, (1 + how.percent / 100) / 2
    return int(n * p - 5 * (n * p * (1 - p)) ** 0.5)


def signatures(docs: DataFrame, how: Forest = Forest()) -> DataFrame:
    """doc_id, n_shingles, shingles (128-bit digest of the set), labels (of all trees) and sketch (their lowest bits) of every whole text."""
    rng = np.random.default_rng(how.seed)
    a, b = rng.integers(0, 2**63, (2, how.trees * how.depth), dtype=U)
    a = a * U(2) + U(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, how.shingle, hashes) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "n_shingles": [len(x) for x in sets],
                "shingles": [xxhash.xxh3_128_digest(x.tobytes()) for x in sets],
                "labels": (labels := [_labels(x, a, b) if len(x) else b"" for x in sets]),
                "sketch": [_sketch(x) for x in labels],
            })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_shingles long, shingles binary, labels binary, sketch array<long>")


#: What `b` says in rows that are not pairs: `a` lies in a crowded region, or (and below, by tree) next to a partition's border.
CROWDED, BORDER = -1, -2


def _neighbours(how: Forest, notes: bool = True):
    """Pairs (a, b, bits) of neighbours among sorted labels (tree, label, node, n, sketch); with notes also rows for CROWDED and BORDER nodes.

    A region that touches a border may go on behind it, so its nodes count as crowded.
    """
    width, hashes, least, reach = 2 * how.depth, how.trees * how.depth, _least_bits(how), how.near + 1

    def noted(node: np.ndarray, b: np.ndarray | int) -> pd.DataFrame:
        return pd.DataFrame({"a": node, "b": b, "bits": 0})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = None, 0
        waiting, length = [], reach  # of the region under way: nodes not yet known to be crowded, and labels so far
        for batch in batches:
            if not len(batch):
                continue
            both = batch if held is None else pd.concat([held, batch], ignore_index=True)
            old = 0 if held is None else len(held)
            label = np.frombuffer(b"".join(both["label"]), ">u2").reshape(-1, width // 2)
            tree, node, n = (both[c].to_numpy() for c in ("tree", "node", "n"))
            sketch = np.stack(both["sketch"].to_numpy())
            # crowded: the label just beyond the neighbours still shares the least prefix
            crowded = np.zeros(len(both), bool)
            crowded[reach:] = (label[reach:, : how.least] == label[:-reach, : how.least]).all(1) & (tree[reach:] == tree[:-reach])
            for k in range(1, how.near + 1):
                first = max(0, old - k)
                i, j = np.arange(first, len(both) - k), np.arange(first + k, len(both))
                i, j = i[j >= old], j[j >= old]
                agree = (label[i] == label[j]).cumprod(1).sum(1) * (tree[i] == tree[j])
                size_ok = 100 * np.minimum(n[i], n[j]) >= how.percent * np.maximum(n[i], n[j])
                ok = (agree >= how.least) & (node[i] != node[j]) & size_ok & ((k <= how.dense) | ~crowded[j])
                i, j = i[ok], j[ok]
                bits = hashes - np.bitwise_count((sketch[i] ^ sketch[j]).view(U)).sum(1).astype(np.int64)
                i, j, bits = i[bits >= least], j[bits >= least], bits[bits >= least]
                if len(i):
                    yield pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j]), "bits": bits})
            if notes:
                new = np.r_[True, (label[1:, : how.least] != label[:-1, : how.least]).any(1) | (tree[1:] != tree[:-1])][old:]
                new[0] &= old > 0  # the first region counts as begun before
                ends = np.r_[np.flatnonzero(new), len(batch)]
                flagged, own, at = [], node[old:], 0
                for end in ends:  # regions of this batch; the one at its start is still under way
                    length += end - at
                    waiting.append(own[at:end])
                    if length > reach:
                        flagged += waiting
                        waiting = []
                    if end < len(batch):
                        waiting, length = [], 0
                    at = end
                if flagged:
                    yield noted(np.unique(np.concatenate(flagged)), CROWDED)
                if total < reach:
                    edge = slice(old, old + reach - total)
                    yield noted(node[edge], BORDER - tree[edge])
            total += len(batch)
            held = both.iloc[-reach:]
        if notes and held is not None:
            yield noted(np.concatenate([*waiting, np.zeros(0, np.int64)]).astype(np.int64), CROWDED)
            yield noted(held["node"].to_numpy(), BORDER - held["tree"].to_numpy())

    return run


def _short(x: np.ndarray) -> bytes:
    """The top 16 bits of each hash of a sorted set, in order: a quarter of the set's bytes."""
    return (x >> U(48)).astype(">u2").tobytes()


def _numbered(short: bytes) -> np.ndarray:
    """Equal values of a short told apart by their number, so that two shorts share as many as the smaller count of each value, summed."""
    x, at = np.frombuffer(short, ">u2").astype(U), np.arange(len(short) // 2)
    first = np.maximum.accumulate(np.where(np.r_[True, x[1:] != x[:-1]], at, 0)) if len(x) else at
    return (x << U(32)) | (at - first).astype(U)


def _alike(pairs: DataFrame, sets: DataFrame, column: str, how: Forest) -> DataFrame:
    """Those of the stored pairs (a, b) that are similar enough by a column of sets(node, set, short). Equal hashes have equal top bits, so shorts share no less
    than their sets do, and no pair whose sets are similar enough is lost by them.

    Up to so many pairs go to every task, and only the sets they name are shuffled; more meet the sets by a shuffle.
    """
    numbers = _numbered if column == "short" else lambda x: np.frombuffer(x, U)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = numbers(x), numbers(y)
                shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                ok.append(100 * shared >= how.percent * (len(x) + len(y) - shared))
            yield batch.loc[ok, ["a", "b"]]

    x = sets.select(F.col("node").alias("a"), F.col(column).alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col(column).alias("y"))
    if pairs.count() <= how.sent:
        y = y.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
        pairs = F.broadcast(pairs)
    return x.join(pairs, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long").distinct()


def _confirmed(ws: Workspace, pairs: DataFrame, sets: DataFrame, how: Forest, screen: bool = True) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. With screen their shorts meet first, and whole sets only where those leave it open."""
    held = ws.save(pairs.select("a", "b"), "pairs")
    if screen:
        held = ws.save(_alike(held, sets, "short", how), "screened")
    return _alike(held, sets, "set", how)


def _rarest(ws: Workspace, sets: DataFrame, how: Forest) -> DataFrame:
    """node and tokens: the shingles of each set, from rare to frequent, among which one that it shares with any linked set must be.

    Frequencies are counts of hashed shingles, a table of fixed size. Each task adds up its own, then the tasks' tables are added
    part by part.
    """
    size, part = 1 << how.order, 1 << (how.order - 6)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount((np.frombuffer(b"".join(batch["set"]), U) >> U(64 - how.order)).astype(np.int64), minlength=size)
        yield pd.DataFrame({"part": np.arange(64), "counts": [x.tobytes() for x in total.reshape(64, part)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch["part"], batch["counts"], strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(x, np.int64)
        yield pd.DataFrame({"part": list(total), "counts": [x.tobytes() for x in total.values()]})

    counted = sets.select("set").mapInPandas(count, "part int, counts binary").repartition("part").mapInPandas(add, "part int, counts binary").collect()
    counts = np.zeros((64, part), np.int64)
    for k, x in counted:
        counts[k] = np.frombuffer(x, np.int64)
    sent = ws.spark.sparkContext.broadcast(counts.ravel())

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x in batch.pop("set"):
                x = np.frombuffer(x, U)
                order = np.lexsort((x, sent.value[(x >> U(64 - how.order)).astype(np.int64)]))
                out.append(x[order[: len(x) * (100 - how.percent) // 100 + 1]].view(np.int64))
            yield batch.assign(tokens=out)

    return sets.select("node", "set").mapInPandas(rank, "node long, tokens array<long>")


def _across(ws: Workspace, rarest: DataFrame, of: DataFrame, how: Forest) -> DataFrame:
    """All pairs (a, b) of nodes of different roots that may be linked, by the shingles of rarest(node, tokens); of(node, n, root).

    In the order of the shingles, the first that two linked sets share has enough shingles after it in both. Only pairs across roots are
    formed: on each shingle those of the commonest root meet the others alone.
    """
    whole, p = 100 + how.percent, how.percent
    held = rarest.join(of, "node").select("node", "n", "root", F.posexplode("tokens").alias("pos", "token"))
    held = held.select("token", "node", "root", "n", (F.col("n") - F.col("pos")).alias("left"))  # left: shingles from this one on
    held = ws.save(held.withColumn("least", whole * F.col("left") >= 2 * p * F.col("n")), "postings")  # may be the smaller set of a pair
    per = held.groupBy("token", "root").agg(F.count("*").alias("k"), F.bool_or("least").alias("least"))
    lists = per.groupBy("token").agg(F.max(F.struct("k", "root")).alias("top"), F.count("*").alias("roots"), F.bool_or("least").alias("any"))
    lists = ws.save(lists.filter("roots > 1 AND any").select("token", F.col("top.root").alias("top")), "lists")
    live = ws.save(held.join(lists, "token").withColumn("other", F.col("root") != F.col("top")).drop("top"), "live")
    # (token, 0): others' smaller sets with all larger ones; (token, 1): the top root's smaller sets with the others' larger ones
    small = live.filter("least").select("token", (~F.col("other")).cast("int").alias("g"), *[F.col(c).alias(f"{c}_a") for c in ("node", "root", "n", "left")])
    sides = F.explode(F.when(F.col("other"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    large = live.select("token", sides.alias("g"), *[F.col(c).alias(f"{c}_b") for c in ("node", "root", "n", "left")])
    na, nb = F.col("n_a"), F.col("n_b")
    enough = lambda side: whole * F.col(f"left_{side}") >= p * (na + nb)
    first = (na < nb) | ((na == nb) & (F.col("node_a") < F.col("node_b")))
    on = (small.token == large.token) & (small.g == large.g) & (F.col("root_a") != F.col("root_b")) & first & (100 * na >= p * nb) & enough("a") & enough("b")
    pairs = small.join(large, on).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    pairs = ws.save(pairs, "across")
    ws.drop(held, lists, live)
    return pairs


def near_duplicates(ws: Workspace, docs: DataFrame, how: Forest = Forest()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, shingles (digest of the set) and group of every row of docs(doc_id, text); other columns are ignored.

    component_id is the smallest doc_id that links reach. Null and empty texts and texts of white space have no shingles and are
    linked with nothing. Rows that repeat a doc_id each belong to the group of their own text. A null doc_id
    is linked with nothing, has no component and is kept. group tells components of one component_id apart; it is null without shingles.
    Empty: no rows.
    """
    signed = ws.save(signatures(docs, how), "signed")
    some = signed.filter("n_shingles > 0 and doc_id is not null")
    own = [F.first(c).alias(n) for c, n in (("n_shingles", "n"), ("labels", "labels"), ("sketch", "sketch"))]
    # texts of one set are a class; its node is a number of its own, as rows may repeat a doc_id
    classes = ws.save(some.groupBy("shingles").agg(F.min("doc_id").alias("doc_id"), *own).withColumn("node", F.monotonically_increasing_id()), "classes")
    label = lambda tree: F.substring(F.col("labels"), tree * (2 * how.depth) + 1, F.lit(2 * how.depth))
    trees = F.explode(F.transform(F.sequence(F.lit(0), F.lit(how.trees - 1)), lambda t: F.struct(t.alias("tree"), label(t).alias("label"))))
    forest = classes.select("node", "n", "sketch", trees.alias("t")).select("node", "n", "sketch", "t.tree", "t.label")
    order = ("tree", "label", "node")
    found = forest.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_neighbours(how), "a long, b long, bits long")
    found = ws.save(found.groupBy("a", "b").agg(F.max("bits").alias("bits")), "found")
    # neighbours across the borders of partitions: a few rows of each, so that the classes stay where they lie
    border = found.filter(F.col("b") <= BORDER).select(F.col("a").alias("node"), (BORDER - F.col("b")).cast("int").alias("tree"))
    border = classes.join(F.broadcast(border), "node").select("node", "n", "sketch", "tree", label(F.col("tree")).alias("label"))
    region = F.substring("label", 1, 2 * how.least)
    border = border.repartition("tree", region).sortWithinPartitions(*order).mapInPandas(_neighbours(how, notes=False), "a long, b long, bits long")
    pairs = found.filter("b >= 0").unionByName(ws.save(border.groupBy("a", "b").agg(F.max("bits").alias("bits")), "border"))
    crowded = found.filter(F.col("b") == CROWDED).select(F.col("a").alias("node"), F.lit(True).alias("crowded"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.lit(False).alias("crowded")).unionByName(crowded).groupBy("node").agg(F.bool_or("crowded").alias("crowded"))
    wanted = ws.save(classes.join(wanted, "node").select("doc_id", "node", "shingles", "crowded"), "wanted")

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            rows = []
            for node, digest, crowded, text in zip(batch["node"], batch["shingles"], batch["crowded"], batch["text"], strict=True):
                if node not in seen:
                    own = shingle_set(text, how.shingle, hashes).tobytes()
                    if xxhash.xxh3_128_digest(own) == digest:  # not another text under this doc_id
                        seen.add(node)
                        rows.append((node, crowded, own, _short(np.frombuffer(own, U))))
            yield pd.DataFrame(rows, columns=["node", "crowded", "set", "short"]).astype({"node": "int64", "crowded": "bool"})

    # up to so many ids are sent to every task, which then reads the texts where they lie; more meet them by a shuffle
    known = F.broadcast(wanted) if wanted.count() <= how.sent else wanted
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(known, "doc_id").select("node", "shingles", "crowded", "text")
    sets = ws.save(texts.mapInPandas(sets_of, "node long, crowded boolean, set binary, short binary"), "sets")
    # first each node's most alike candidate, which joins most of every group; then the two most alike between any two parts
    ends = F.explode(F.array("a", "b")).alias("node")
    alike = (F.desc("bits"), F.xxhash64("a", "b"), "a", "b")
    best = pairs.select("a", "b", "bits", ends).withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(*alike))).filter("r = 1").select("a", "b").distinct()
    joined = components(ws, ws.save(_confirmed(ws, best, sets, how, screen=False), "links"))
    as_links = lambda: joined.select(F.col("node").alias("a"), F.col("root").alias("b"))

    def apart() -> DataFrame:
        of = lambda side: joined.select(F.col("node").alias(side), F.col("root").alias(f"_{side}"))
        out = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumns({"_a": F.coalesce("_a", "a"), "_b": F.coalesce("_b", "b")})
        return out.filter("_a <> _b").withColumns({"_a": F.least("_a", "_b"), "_b": F.greatest("_a", "_b")})

    rank = F.row_number().over(Window.partitionBy("_a", "_b").orderBy(*alike))
    links = ws.save(_confirmed(ws, apart().withColumn("r", rank).filter("r <= 2"), sets, how), "links")
    joined = components(ws, as_links().unionByName(links))
    # last all that are still apart, with the exact candidates of crowded regions
    of = classes.select("node", "n").join(joined, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
    exact = _across(ws, _rarest(ws, sets.filter("crowded"), how), of, how)
    more = ws.save(apart().select("a", "b").unionByName(exact).distinct(), "more")
    joined = components(ws, as_links().unionByName(_confirmed(ws, more, sets, how)))
    # a component is named by its smallest doc_id; every class gets its component's name, then every document its class's
    root = classes.select("shingles", "node", "doc_id").join(joined, "node", "left").select("shingles", "doc_id", F.coalesce("root", "node").alias("root"))
    root = ws.save(root, "rooted")
    named = root.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = ws.save(root.join(named, "root").select("shingles", "component_id", F.col("root").alias("group")), "of_class")
    ws.drop(classes, found, wanted, sets, exact, more, root)
    # documents without shingles are components of their own
    own = F.coalesce("component_id", "doc_id")
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("shingles")).alias("shingles")).join(of_class, "shingles", "left")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), "shingles", "group")


def one_of_each(ws: Workspace, docs: DataFrame, how: Forest = Forest()) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component one row, under its smallest doc_id.

    Rows that repeat a doc_id belong to the component of their own text; where several rows of one component have its doc_id, the one
    with the smallest text (then other columns, in order) stays. Rows without a doc_id or without words all stay. Empty: no rows.
    """
    found = ws.save(near_duplicates(ws, docs, how).filter("doc_id is not null"), "components")
    twice = ws.save(found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "twice")
    stay = found.filter("kept").join(twice, "doc_id", "left_anti").select("doc_id")
    known = docs.filter("doc_id is not null")
    out = known.join(stay, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
    if not twice.isEmpty():  # a few rows, told apart by their sets
        names = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
        again = known.join(twice, "doc_id", "left_semi").select(F.col("doc_id").cast("long").alias("id"), "text", F.struct("text", *[n for n in names if n != "`text`"]).alias("whole"))
        kept = found.filter("kept").select(F.col("doc_id").alias("id"), "shingles", "group").distinct()
        rows = with_digest(again, how).join(kept, ["id", "shingles"])
        one = rows.filter("group IS NOT NULL").groupBy("group").agg(F.min("whole").alias("whole")).select("whole")
        out = out.unionByName(one.unionByName(rows.filter("group IS NULL").select("whole")).select(*[f"whole.{n}" for n in names]))
    return out.select(*docs.columns)


def with_digest(rows: DataFrame, how: Forest) -> DataFrame:
    """rows(id, text, whole) with the digest of the text's shingles, as in near_duplicates, in place of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            yield pd.DataFrame({"text": batch["text"], "shingles": [xxhash.xxh3_128_digest(shingle_set(t, how.shingle, hashes).tobytes()) for t in batch["text"]]})

    digests = rows.select("text").distinct().mapInPandas(run, "text string, shingles binary")
    return rows.join(digests, rows.text.eqNullSafe(digests.text)).select("id", "shingles", "whole")
