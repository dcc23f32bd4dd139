"""Chat formatting over a prefix tree: conversations that begin alike share their first turns.

A node is a turn after the same turns before it. Each tree is laid out depth first, shared turns once; every node
has its place there, the position ids it would have in a conversation of its own, and the intervals
of its ancestors, which its tokens attend to besides their own past. Units are code points of the
formatted text; a tokenizer's ids can be laid out likewise by their lengths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Fixed values of the template: what opens a turn, what ends its role, what closes it. Inside texts a backslash breaks them up.
OPEN, MID, CLOSE = "<turn ", ">\n", "</turn>\n"
_SEGMENT = re.compile(r"<turn ((?:\\.|[^\\>])*)>\n(.*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<turn", "<\\turn").replace("</turn", "<\\/turn")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segment(role: str, text: str) -> str:
    """A formatted turn."""
    return OPEN + escaped(role).replace(">", "\\>") + MID + escaped(text) + CLOSE


def parsed(formatted: str) -> tuple[str, str]:
    """The role and text of a formatted turn."""
    role, text = _SEGMENT.fullmatch(formatted).groups()
    return unescaped(role), unescaped(text)


@dataclass
class Tree:
    """nodes(tree, node, parent, depth, length, position, start, attends): start is the place in the tree's
    depth-first layout, position that of the first unit in its conversation, attends the ancestors' intervals [from, to).
    stream(tree, start, segment): the layout itself, the formatted turn of each node at its place, once. leaves(conv, node): where each
    conversation ends."""

    nodes: DataFrame
    stream: DataFrame
    leaves: DataFrame


def _by_conversation(df: DataFrame, *order) -> DataFrame:
    """Rows of a conversation in one task in order; they are read as a stream, so its length does not matter."""
    return df.repartition("conv").sortWithinPartitions("conv", *order)


_START = object()


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, depth, node, tree, position = _START, 0, b"", b"", 0
    for batch in batches:
        rows = []
        for c, role, text in zip(batch["conv"], batch["role"], batch["text"], strict=True):
            if c != conv:
                conv, depth, node, tree, position = c, 0, b"", b"", 0
            parent, own = node, segment(role, text)
            node = hashlib.blake2b(parent + own.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            tree = tree or node
            rows.append((c, depth, tree, parent, node, own, len(own), position))
            depth, position = depth + 1, position + len(own)
        yield pd.DataFrame(rows, columns=["conv", "depth", "tree", "parent", "node", "segment", "length", "position"])


def _paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The branches taken down to each node: a node that is its parent's only child adds none."""
    conv, path = _START, b""
    for batch in batches:
        out = []
        for c, depth, node, branch in zip(batch["conv"], batch["depth"], batch["node"], batch["branch"], strict=True):
            conv, path = c, b"" if depth == 0 else path
            path += node[:8] if branch else b""
            out.append(path)
        yield pd.DataFrame({"node": batch["node"], "path": out})


def _layout(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where each node starts among the nodes of its tree that this task has."""
    tree, at = b"", 0
    for batch in batches:
        starts = []
        for t, length in zip(batch["tree"], batch["length"], strict=True):
            tree, at = t, at if t == tree else 0
            starts.append(at)
            at += length
        yield batch[["node", "tree", "length", "task"]].assign(start=starts)


def _attended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    intervals: list[tuple[int, int]] = []
    for batch in batches:
        out = []
        for depth, start, length in zip(batch["depth"], batch["start"], batch["length"], strict=True):
            if depth == 0:
                intervals = []
            out.append([{"from": a, "to": b} for a, b in intervals])
            if intervals and intervals[-1][1] == start:
                intervals[-1] = (intervals[-1][0], start + length)
            else:
                intervals.append((start, start + length))
        yield pd.DataFrame({"node": batch["node"], "attends": out})


def build(ws: Workspace, conversations: DataFrame) -> Tree:
    """The tree of conversations(conv_id, turn, role, text); other columns are ignored.

    Null roles and texts are empty; rows of one turn are turns one after another, by role and text; null turns come
    first; rows without a conv_id are one conversation. Empty: no nodes.
    """
    rows = conversations.select(F.col("conv_id").cast("string").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    fields = "conv string, depth int, tree binary, parent binary, node binary, segment string, length long, position long"
    chain = ws.save(_by_conversation(rows, "turn", "role", "text").mapInPandas(_chain, fields), "chain")
    same = [F.first(c).alias(c) for c in ("tree", "parent", "depth", "length", "position")]
    nodes = ws.save(chain.groupBy("node").agg(*same), "nodes")
    segments = ws.save(chain.groupBy("node").agg(F.first("segment").alias("segment")), "segments")
    turns = ws.save(chain.select("conv", "depth", "node", "length"), "turns")
    ws.drop(chain)
    forks = ws.save(nodes.filter("depth > 0").groupBy("parent").agg(F.count("*").alias("_n")).filter("_n > 1").select("parent", F.lit(True).alias("fork")), "forks")
    branch = (F.col("depth") == 0) | F.coalesce("fork", F.lit(False))
    branches = ws.save(nodes.select("node", "parent", "depth").join(forks, "parent", "left").select("node", branch.alias("branch")), "branches")
    paths = _by_conversation(turns.join(branches, "node"), "depth").mapInPandas(_paths, "node binary, path binary")
    paths = ws.save(paths.groupBy("node").agg(F.first("path").alias("path")), "paths")
    order = ("tree", "path", "depth")
    laid = nodes.select("node", "tree", "depth", "length").join(paths, "node")
    laid = laid.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id())
    laid = ws.save(laid.mapInPandas(_layout, "node binary, tree binary, length long, task int, start long"), "laid")
    # a large tree goes on from task to task
    runs = laid.groupBy("tree", "task").agg(F.sum("length").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("tree").orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    runs = ws.save(runs.select("tree", "task", earlier.alias("earlier")), "runs")
    places = ws.save(laid.join(runs, ["tree", "task"]).select("node", (F.col("start") + F.col("earlier")).alias("start")), "places")
    seen = _by_conversation(turns.join(places, "node"), "depth").mapInPandas(_attended, "node binary, attends array<struct<from:long,to:long>>")
    seen = ws.save(seen.groupBy("node").agg(F.first("attends").alias("attends")), "attends")
    tree = ws.save(nodes.join(places, "node").join(seen, "node"), "tree")
    stream = ws.save(tree.select("node", "tree", "start").join(segments, "node").select("tree", "start", "segment"), "stream")
    leaves = ws.save(turns.groupBy("conv").agg(F.max_by("node", "depth").alias("node")), "leaves")
    ws.drop(nodes, forks, branches, paths, laid, runs, places, seen, segments, turns)
    return Tree(tree, stream, leaves)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    conv, n, chars, loss_chars, turns, loss = _START, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
    for batch in batches:
        rows = []
        for c, at, position, formatted in zip(batch["conv"], batch["at"], batch["position"], batch["segment"], strict=True):
            if c != conv:
                if conv is not _START:
                    rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                conv, n, chars, loss_chars, turns, loss = c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            if at != chars or (position >= 0 and position != chars):
                raise ValueError("the intervals of a conversation do not cover it, or its position ids are others")
            role, text = parsed(formatted)
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            n, chars = n + 1, chars + len(formatted)
            if role == "assistant":
                loss_chars += len(text)
                loss.update(text.encode("utf-8", "surrogatepass"))
        yield pd.DataFrame(rows, columns=columns)
    if conv is not _START:
        yield pd.DataFrame([(conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)], columns=columns)


def read_back(ws: Workspace, tree: Tree, width: int = 4096) -> DataFrame:
    """Per conversation what the laid-out stream says: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A conversation is what its last turn attends to and that turn itself: those intervals are cut out of its tree's stream and must join up, with the position ids
    that the turn says. The loss mask lies on the texts of assistant turns. Intervals and turns meet by tree and by parts of the layout of this width.
    """
    leaf = tree.leaves.join(tree.nodes, "node")
    own = F.struct(F.col("start").alias("from"), (F.col("start") + F.col("length")).alias("to"))
    cuts = leaf.select("conv", "tree", "start", "position", F.posexplode(F.concat("attends", F.array(own))).alias("_k", "_cut"), F.concat("attends", F.array(own)).alias("_all"))
    before = F.aggregate(F.slice("_all", F.lit(1), F.col("_k")), F.lit(0).cast("long"), lambda n, c: n + c["to"] - c["from"])
    cuts = cuts.select("conv", F.col("tree").alias("_tree"), "_cut.*", before.alias("_before"), F.col("start").alias("_leaf"), F.col("position").alias("_position"))
    part = lambda x: F.floor(x / width)
    cuts = ws.save(cuts.withColumn("_part", F.explode(F.sequence(part(F.col("from")), part(F.col("to") - 1)))), "cuts")
    stream = ws.save(tree.stream.withColumn("part", part(F.col("start"))), "parts")
    found = stream.join(cuts, (F.col("tree") == F.col("_tree")) & (F.col("part") == F.col("_part")) & (F.col("start") >= F.col("from")) & (F.col("start") < F.col("to")))
    rows = found.select("conv", "start", "segment", (F.col("_before") + F.col("start") - F.col("from")).alias("at"), F.when(F.col("start") == F.col("_leaf"), F.col("_position")).otherwise(-1).alias("position"))
    fields = "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _by_conversation(rows, "start").mapInPandas(_read, fields).withColumn("conv_id", F.col("conv").cast("long")).drop("conv")
