"""Conversation structure repair: A* on the edit lattice of a conversation's rows and role states.

A repaired conversation's roles are an optional system turn and then user and assistant in turns, or nothing. Rows are kept, given another role or deleted, and
empty turns are inserted; the cheapest edits are found, of equally cheap ones those whose initials (the audit) are least. A node of the lattice is how many
rows are done and which role came last. The heuristic is the suffix sum of what the rows to come cost at least: mandatory deletions, and for truncated rows the
cheaper of deleting and of their charge. It is consistent, so a queue by (cost plus heuristic, audit) takes each node first by its cheapest and least audit.

Conversations are dealt by range in order, so a long one falls to several tasks. Each finds the best edits of its share from every state to every state;
the costs of shares, at most two from each task, are put together and say which of them hold.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Role initials after which a state stands: none yet, system, user, assistant. What may follow each.
STATES = ("", "s", "u", "a")
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NAMES = {2: "user", 3: "assistant"}
#: Faults of a row; the first that holds counts.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
_DONE = (0, 3)


@dataclass(frozen=True)
class Costs:
    """What edits cost. truncated: added for a truncated row that is not deleted. block: rows that one search covers; longer shares are chained from such blocks."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5
    block: int = 128


Row = tuple[str, int]  # a role's initial, a fault
Best = dict[int, tuple[int, str]]  # state -> cost, audit


def search(rows: list[Row], entry: int, how: Costs, whole: bool) -> Best:
    """A* over rows from a state. whole: the best edits to an end of a conversation, with turns inserted after the last row.
    Otherwise the best to each state just after the last row."""
    charge = [0 if fault == FINE else how.delete if fault != TRUNCATED else min(how.delete, how.truncated) for _, fault in rows]
    ahead = [0, *np.cumsum(charge[::-1]).tolist()][::-1]
    queue, closed, found = [(ahead[0], "", 0, entry)], set(), {}
    while queue:
        f, audit, i, state = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = f - ahead[i]
        if i == len(rows) and (not whole or state in _DONE):
            found[state] = (cost, audit)
            if whole or len(found) == len(STATES):
                break
            continue
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(queue, (cost + how.delete + ahead[i + 1], audit + "D", i + 1, state))
            if fault in (FINE, TRUNCATED):
                extra = cost + ahead[i + 1] + (how.truncated if fault == TRUNCATED else 0)
                if initial in _NEXT[state]:
                    heapq.heappush(queue, (extra, audit + "K", i + 1, _NEXT[state][initial]))
                for to in _NEXT[state].values():
                    if to in NAMES:
                        heapq.heappush(queue, (extra + how.rerole, audit + "R", i + 1, to))
        for to in _NEXT[state].values():
            if to in NAMES:
                heapq.heappush(queue, (f + how.insert, audit + "I", i, to))
    return found


@dataclass
class Share:
    """The best edits of a run of rows between any two states: costs[entry][exit], and order[entry], exits from the least audit on. Only
    what leads from one state is comparable, and there no audit begins another, as each ends with a row's edit."""

    costs: list[dict[int, int]]
    order: list[list[int]]

    @staticmethod
    def of(found: list[Best]) -> Share:
        return Share([{x: c for x, (c, _) in best.items()} for best in found], [sorted(best, key=lambda x, best=best: best[x][1]) for best in found])


    def ways(self) -> list[tuple[int, int]]:
        """Every (entry, exit), in a fixed order."""
        return [(m, x) for m, c in enumerate(self.costs) for x in sorted(c)]

    @staticmethod
    def read(told: str) -> Share:
        costs, order = json.loads(told)
        return Share([dict(map(tuple, c)) for c in costs], order)


Frontier = dict[int, tuple[int, int]]  # state -> cost, rank of its audit among the frontier's


def advance(at: Frontier, share: Share) -> tuple[Frontier, dict[int, int]]:
    """The frontier after a share, and from which state each of its states is best reached."""
    back: dict[int, int] = {}
    for x in range(len(STATES)):
        ways = [(at[m][0] + share.costs[m][x], at[m][1], m) for m in at if x in share.costs[m]]
        if ways:
            back[x] = min(ways)[2]
    ranked = sorted(back, key=lambda x: (at[back[x]][1], share.order[back[x]].index(x)))
    return {x: (at[back[x]][0] + share.costs[back[x]][x], k) for k, x in enumerate(ranked)}, back


#: What is inserted after the last row from each state.
TAIL = ("", "II", "I", "")


def last(at: Frontier, how: Costs) -> int:
    """The state after the last row from which the whole is cheapest."""
    return min(at, key=lambda x: (at[x][0] + how.insert * len(TAIL[x]), at[x][1]))


def _per_row(audit: str) -> list[str]:
    """An audit cut after each row's edit; what is inserted goes with the row after it, and at the end alone."""
    out, at = [], 0
    for k, c in enumerate(audit):
        if c != "I":
            out.append(audit[at : k + 1])
            at = k + 1
    return [*out, audit[at:]]


class Chain:
    """The rows of a share in blocks, searched from every state that can stand before them."""

    def __init__(self, rows: list[Row], entries: list[int], how: Costs):
        self.blocks: list[list[Best]] = []
        self.entries, reach = entries, set(entries)
        for at in range(0, len(rows), how.block):
            part = rows[at : at + how.block]
            self.blocks.append([search(part, m, how, False) if m in reach else {} for m in range(len(STATES))])
            reach = {x for best in self.blocks[-1] for x in best}
        shares = list(map(Share.of, self.blocks))
        self.ends: dict[int, Frontier] = {}
        self.backs: dict[int, list[dict[int, int]]] = {}
        for entry in entries:
            at, backs = {entry: (0, 0)}, []
            for share in shares:
                at, back = advance(at, share)
                backs.append(back)
            self.ends[entry], self.backs[entry] = at, backs

    def share(self) -> Share:
        ends = [self.ends.get(m, {}) for m in range(len(STATES))]
        return Share([{x: c for x, (c, _) in e.items()} for e in ends], [sorted(e, key=lambda x, e=e: e[x][1]) for e in ends])

    def ways(self) -> list[tuple[int, int]]:
        return self.share().ways()

    def told(self) -> str:
        share = self.share()
        return json.dumps([[sorted(c.items()) for c in share.costs], share.order])

    def edits(self, entry: int, end: int) -> list[str]:
        """Each row's edit on the best way between two states."""
        out: list[list[str]] = []
        for block, back in zip(reversed(self.blocks), reversed(self.backs[entry]), strict=True):
            out.append(_per_row(block[back[end]][end][1])[:-1])
            end = back[end]
        return [e for part in reversed(out) for e in part]


def repaired_rows(rows: list[Row], how: Costs) -> tuple[list[str], str]:
    """The edits of a whole conversation: of each row, and after the last."""
    if len(rows) <= how.block:
        *own, tail = _per_row(next(iter(search(rows, 0, how, True).values()))[1])
        return own, tail
    chain = Chain(rows, [0], how)
    end = last(chain.ends[0], how)
    return chain.edits(0, end), TAIL[end]


_START = object()
_FIELDS = "part int, conv string, turn string, role string, text string, n long, fault int, illegal long, edits array<string>, tail string, opens boolean, closes boolean, share string, first string, last string"
_COLUMNS = [f.split()[0] for f in _FIELDS.split(", ")]
_OWN = _COLUMNS[:7]


def _forbidden(before: str, after: str) -> bool:
    return before + after not in ("su", "ua", "au")


def _rows(held: list[dict], edge: bool, how: Costs) -> pd.DataFrame:
    """The rows of a conversation's share with their edits: at an edge of the partition, those for every (entry, exit), and one more row that says what these cost."""
    rows = [(r["initial"], r["fault"]) for r in held]
    illegal = [r["n"] - 1 + pair for pair, r in zip([0, *(_forbidden(a[0], b[0]) for a, b in pairwise(rows))], held, strict=True)]
    if edge:
        chain = Chain(rows, list(range(len(STATES))), how)
        edits, tail = list(zip(*[chain.edits(m, x) for m, x in chain.ways()], strict=True)), None
    else:
        own, tail = repaired_rows(rows, how)
        edits = [[e] for e in own]
    end = len(held) - 1
    out = [(*map(r.get, _OWN), i, list(e), tail if k == end else None, k == 0, k == end, None, None, None) for k, (r, i, e) in enumerate(zip(held, illegal, edits, strict=True))]
    if edge:
        out.append((held[0]["part"], held[0]["conv"], *[None] * 3, 0, 0, 0, [], None, False, False, chain.told(), rows[0][0], rows[-1][0]))
    return pd.DataFrame(out, columns=_COLUMNS)


def _searched(how: Costs):
    """Range partitions with edits. Conversations within one are done; those at its edges may have begun before it or go on after it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, held, first = _START, [], True
        for batch in batches:
            out = []
            for row in zip(*[batch[c] for c in batch.columns], strict=True):
                row = {c: None if v is None or v != v else v for c, v in zip(batch.columns, row, strict=True)}
                if row["conv"] != conv:
                    if held:
                        out.append(_rows(held, first, how))
                        first = False
                    conv, held = row["conv"], []
                held.append(row)
            yield from out
        if held:
            yield _rows(held, True, how)

    return run


def _resolved(edges: list, how: Costs) -> list[tuple]:
    """Which (entry, exit) holds for each share at an edge: part, conv, the way's place among the ways, what is inserted after it, forbidden pairs with the row before it."""
    out, by_conv = [], defaultdict(list)
    for r in sorted(edges, key=lambda r: r["part"]):
        by_conv[r["conv"]].append(r)
    for conv, own in by_conv.items():
        at, backs = {0: (0, 0)}, []
        shares = [Share.read(r["share"]) for r in own]
        for share in shares:
            at, back = advance(at, share)
            backs.append(back)
        end = last(at, how)
        tail = TAIL[end]
        for k in reversed(range(len(own))):
            entry = backs[k][end]
            joined = k > 0 and _forbidden(own[k - 1]["last"], own[k]["first"])
            out.append((own[k]["part"], conv, shares[k].ways().index((entry, end)), tail, int(joined)))
            end, tail = entry, ""
    return out


def faults(ws: Workspace, conversations: DataFrame) -> DataFrame:
    """The distinct rows of conversations(conv_id, turn, role, text), their number n and the fault of the first of them; the others repeat it.

    conv is the conv_id as text, null for rows without one; null roles and texts are empty.
    """
    told = [F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]]
    says = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("says")
    rows = ws.save(conversations.select(*told).groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n")).select("*", says), "rows")
    # what was said at an earlier turn, null turns first; counts meet before the shuffle and both sides are stored, so that a hot text's join can be split
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = rows.groupBy(F.col("conv").alias("_conv"), F.col("says").alias("_says")).agg(F.min(when).alias("_first"), F.count("*").alias("_n"))
    firsts = ws.save(firsts.filter("_n > 1").drop("_n"), "firsts")
    seen = rows.join(firsts, (F.col("says") == F.col("_says")) & F.col("conv").eqNullSafe(F.col("_conv")), "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fine = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, BLANK).when(when > F.col("_first"), DUPLICATE).when(fine, FINE).otherwise(TRUNCATED)
    return seen.select("conv", "turn", "role", "text", "n", fault.alias("fault"))


def repair(ws: Workspace, conversations: DataFrame, how: Costs = Costs()) -> DataFrame:
    """The edits of conversations(conv_id, turn, role, text), per distinct row: conv, turn, role, text, n, fault, illegal, edit, tail and number.

    conv is the conv_id as text; rows without one are one conversation. Null roles and texts are empty; null turns come first, rows of
    one turn by role and text. edit: K, R or D, after an I for each turn inserted before the row; repetitions (n - 1) are deleted after it. tail, at a
    conversation's last row: what is inserted after it. illegal: forbidden pairs of roles that end in the row or its repetitions. Texts are kept whole. Empty: no rows.
    """
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    rows = faults(ws, conversations).withColumn("initial", F.substring("role", 1, 1))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    # turns travel as text: null ones would turn the others into floating point
    dealt = dealt.withColumn("turn", F.col("turn").cast("string"))
    found = ws.save(dealt.mapInPandas(_searched(how), _FIELDS), "searched")
    edges = found.filter("share is not null").select("part", "conv", "share", "first", "last").collect()  # two a partition at most
    known = ws.spark.createDataFrame(_resolved(edges, how), "_part int, _conv string, _way int, _tail string, _joined int")
    out = found.filter("share is null").join(F.broadcast(known), (F.col("part") == F.col("_part")) & F.col("conv").eqNullSafe(F.col("_conv")), "left")
    edit = F.element_at("edits", F.coalesce(F.col("_way") + 1, F.lit(1))).alias("edit")
    tail = F.coalesce("tail", F.when(F.col("closes"), F.col("_tail")), F.lit("")).alias("tail")
    illegal = (F.col("illegal") + F.when(F.col("opens"), F.coalesce("_joined", F.lit(0))).otherwise(0)).alias("illegal")
    return out.select("conv", F.col("turn").cast("long").alias("turn"), "role", "text", "n", "fault", illegal, edit, tail)


def report(edits: DataFrame, how: Costs = Costs()) -> DataFrame:
    """Per conversation of edits its conv, gaps in turns (null ones apart), rows blank, duplicate and truncated, illegal pairs and cost. Sums meet by turn first, so a long
    conversation is not in one task."""
    many = lambda letter: F.length("edit") - F.length(F.replace(F.col("edit"), F.lit(letter), F.lit("")))
    again = F.when(F.col("fault") == BLANK, 0).otherwise(F.col("n") - 1)
    truncated = (F.col("fault") == TRUNCATED).cast("long")
    kept = F.when(F.col("edit").endswith("D"), 0).otherwise(truncated)
    cost = how.insert * (many("I") + F.length("tail")) + how.rerole * many("R") + how.delete * (many("D") + F.col("n") - 1) + how.truncated * kept
    sums = {
        "blank": F.when(F.col("fault") == BLANK, F.col("n")).otherwise(0),
        "duplicate": again + (F.col("fault") == DUPLICATE).cast("long"),
        "truncated": truncated,
        "illegal": F.col("illegal"),
        "cost": cost.cast("long"),
    }
    turns = edits.groupBy("conv", "turn").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return turns.groupBy("conv").agg(gaps.alias("gaps"), *[F.sum(name).alias(name) for name in sums])


def repaired(edits: DataFrame) -> DataFrame:
    """The repaired conversations: conv, turn, place, role and text. Turns inserted have an empty text and the turn of the row they stand before or after; rows are in order by turn
    (nulls first), role and text of their origin, and place, the numbers of its edits. The role an edit gives depends on those before it, which are read in order."""
    return _in_order(edits).mapInPandas(_applied, "conv string, turn string, place long, role string, text string").withColumn("turn", F.col("turn").cast("long"))


def digests(edits: DataFrame) -> DataFrame:
    """Per conversation conv, audit (the initials of all edits in order) and repaired_sha256 (of role:text, joined by line feeds). A digest is made in order, so a
    conversation is read by one task, as a stream that keeps nothing but its audit."""
    return _in_order(edits).mapInPandas(_digested, "conv string, audit string, repaired_sha256 string")


def _in_order(edits: DataFrame) -> DataFrame:
    rows = edits.select("conv", "turn", F.col("role").alias("was"), F.col("text").alias("said"), "n", "edit", "tail")
    rows = rows.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "was", "said")
    return rows.withColumn("turn", F.col("turn").cast("string"))


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """(conv, whether it begins, turn, n, edit and tail, repaired (role, text) of the row) of rows in order."""
    conv, state = _START, 0
    for batch in batches:
        out = []
        for c, turn, was, said, n, edit, tail in zip(*[batch[c] for c in ("conv", "turn", "was", "said", "n", "edit", "tail")], strict=True):
            c, turn = None if c is None or c != c else c, None if turn is None or turn != turn else turn
            begins, conv = c != conv, c
            state = 0 if begins else state
            turns = []
            for letter in edit + tail:
                if letter == "K":
                    state = _NEXT[state][was[:1]]
                    turns.append((was, said))
                elif letter != "D":
                    state = next(to for to in _NEXT[state].values() if to in NAMES)
                    turns.append((NAMES[state], said if letter == "R" else ""))
            out.append((c, begins, turn, n, edit, tail, turns))
        yield out


def _applied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    place = 0
    for rows in _stream(batches):
        out = []
        for conv, begins, turn, _, _, _, turns in rows:
            place = 0 if begins else place
            for role, text in turns:
                out.append((conv, turn, place, role, text))
                place += 1
        yield pd.DataFrame(out, columns=["conv", "turn", "place", "role", "text"])


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, audit, digest, empty = _START, [], hashlib.sha256(), True
    for rows in _stream(batches):
        out = []
        for c, begins, _, n, edit, tail, turns in rows:
            if begins:
                if conv is not _START:
                    out.append((conv, "".join(audit), digest.hexdigest()))
                conv, audit, digest, empty = c, [], hashlib.sha256(), True
            audit.append(edit + "D" * (n - 1) + tail)
            for role, text in turns:
                digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                empty = False
        yield pd.DataFrame(out, columns=["conv", "audit", "repaired_sha256"])
    if conv is not _START:
        yield pd.DataFrame([(conv, "".join(audit), digest.hexdigest())], columns=["conv", "audit", "repaired_sha256"])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations(conv_id, turn, role, text) with seeded faults, by the crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its `[.!?]`
    out, 3 repeats it, 4 makes it the user's; other rows stay. Nulls are a space, in conv_id and turn for the crc32 alone."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(name) % 20).alias("_dice"))
    dice = F.col("_dice")
    text = F.when(dice == 1, "").when(dice == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(dice == 4, "user").otherwise(F.col("role"))
    times = F.when(dice == 3, 2).otherwise(1)
    return rows.filter(dice != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_again")).drop("_again")
