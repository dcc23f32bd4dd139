"""Classification EM with a class for noise and deletion by loss, of one table or of many chunks of it, and the joining of chunks' classes.

Every round needs sums over rows for each class alone. Of a table, tasks add them up and Spark adds the tasks'; of a chunk, which has a bound, its one task does.
Chunks overlap: spikes in two of them vote for which classes are the same unit.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .curation import checkpoint_dir
from .models import Mixture, _costs, farthest_first, penalty


@dataclass(frozen=True)
class Rules:
    """classes: seeds, besides noise. rounds: at most. noise: rows that noise has beforehand; none without a noise class. mix: of the penalty, from AIC (0) to BIC (1).
    full: covariances in place of variances. floor: the least variance, as a part of that of all rows. merge: in every round, two classes become one where one Gaussian for both costs less than
    the penalty it saves; deletion alone leaves a unit in parts that hold each other narrow."""

    classes: int = 10
    rounds: int = 60
    noise: float | None = 1.0
    mix: float = 1.0
    full: bool = True
    floor: float = 1e-3
    merge: bool = False


@dataclass
class Classes:
    """model: of the classes 1, 2, ...; class 0 is noise, with weight and the logarithm of the volume it is spread over (infinite without noise)."""

    model: Mixture
    weight: float
    volume: float

    def costs(self, x: np.ndarray) -> np.ndarray:
        noise = np.full((len(x), 1), self.volume - np.log(self.weight) if np.isfinite(self.volume) else np.inf)
        return np.hstack([noise, _costs(x, self.model)])

    def width(self, size: int) -> int:
        return 3 + size + (size * size if self.model.var.ndim == 3 else size)


def sums_of(x: np.ndarray, classes: Classes, centre: np.ndarray) -> np.ndarray:
    """For every class: its rows, their costs, what they would cost more in their second best class, and sums and squares from the centre."""
    costs = classes.costs(x)
    own = costs.argmin(1)
    two = np.partition(costs, 1, axis=1)[:, :2]
    out = np.zeros((costs.shape[1], classes.width(x.shape[1])))
    x = x - centre
    for c in np.unique(own):
        part = x[own == c]
        squares = (part.T @ part).ravel() if classes.model.var.ndim == 3 else (part * part).sum(0)
        out[c] = np.concatenate([[len(part), two[own == c, 0].sum(), (two[own == c, 1] - two[own == c, 0]).sum()], part.sum(0), squares])
    return out


def _alone(sums: np.ndarray, floor: np.ndarray, n: float) -> float:
    """What rows cost as one class, from their number, sums and squares."""
    size, count = len(floor), sums[0]
    mean, square = sums[3 : 3 + size] / count, sums[3 + size :] / count
    if len(square) > size:
        spread = np.linalg.slogdet(square.reshape(size, size) - np.outer(mean, mean) + np.diag(floor))[1]
    else:
        spread = np.log(np.maximum(square - mean**2, floor)).sum()
    return float(count / 2 * (spread + size * (1 + np.log(2 * np.pi))) - count * np.log(count / n))


def merged(live: np.ndarray, floor: np.ndarray, n: float, mix: float) -> np.ndarray:
    """The classes' sums after joining pairs, the cheapest first, as long as one class in place of two costs less than the penalty it saves."""
    size = len(floor)
    while len(live) > 1:
        alone = [_alone(s, floor, n) for s in live]
        saves = penalty(size, len(live) + 1, int(n), mix) - penalty(size, len(live), int(n), mix)
        lost, a, b = min((_alone(live[a] + live[b], floor, n) - alone[a] - alone[b], a, b) for a in range(len(live)) for b in range(a + 1, len(live)))
        if lost >= saves:
            break
        live[a] += live[b]
        live = np.delete(live, b, 0)
    return live


def step(classes: Classes, sums: np.ndarray, centre: np.ndarray, floor: np.ndarray, how: Rules) -> tuple[Classes | None, float, bool]:
    """New classes from a round's sums (None if none live), the round's score, and whether a class was deleted: the one whose rows lose least in their second best
    classes goes if the penalty falls by more."""
    size, n = len(centre), sums[:, 0].sum()
    alive = sums[1:, 0] > size
    k = int(alive.sum())
    score = sums[:, 1].sum() + penalty(size, k + 1, int(n), how.mix)
    live = sums[1:][alive]
    deleted = k < len(alive)
    if k > 1 or (k and how.noise):
        saves = penalty(size, k + 1, int(n), how.mix) - penalty(size, k, int(n), how.mix)
        least = int(live[:, 2].argmin())
        if live[least, 2] < saves:
            live, deleted = np.delete(live, least, 0), True
    if how.merge:
        before = len(live)
        live = merged(live.copy(), floor, float(n), how.mix)
        deleted |= len(live) < before
    if not len(live):
        return None, score, deleted
    count = live[:, :1]
    mean = live[:, 3 : 3 + size] / count
    var = live[:, 3 + size :] / count
    if how.full:
        var = var.reshape(-1, size, size) - mean[:, :, None] * mean[:, None, :] + np.diag(floor)
    else:
        var = np.maximum(var - mean**2, floor)
    extra = how.noise or 0.0
    model = Mixture(mean + centre, var, count[:, 0] / (n + extra), score)
    return replace(classes, model=model, weight=(sums[0, 0] + extra) / (n + extra) if how.noise else 1.0), score, deleted


def begun(seeds: np.ndarray, centre: np.ndarray, spread: np.ndarray, span: np.ndarray, how: Rules) -> Classes:
    """Classes of equal weight at the seeds, with the variances of all rows over the square of the number of seeds' root by dimension."""
    k, size = seeds.shape
    var = np.tile(spread / k ** (2 / size), (k, 1))
    volume = float(np.log(np.maximum(span, 1e-9)).sum()) if how.noise else np.inf
    weight = 0.01 if how.noise else 1.0
    return Classes(Mixture(seeds, var[:, :, None] * np.eye(size) if how.full else var, np.full(k, (1 - weight if how.noise else 1.0) / k), np.inf), weight, volume)


def rounds(classes: Classes, sums, centre: np.ndarray, floor: np.ndarray, how: Rules) -> Classes | None:
    """Rounds until the score does not fall and no class is deleted. sums: from classes to a round's sums."""
    best = np.inf
    for _ in range(how.rounds):
        new, score, deleted = step(classes, sums(classes), centre, floor, how)
        if new is None:
            return None
        if score >= best - 1e-9 * abs(score) and not deleted:
            break
        best, classes = np.inf if deleted else score, new
    return classes


def _seeds(x: np.ndarray, k: int) -> np.ndarray:
    """The first row, then each time the one farthest from all seeds."""
    seeds, far = [x[0]], ((x - x[0]) ** 2).sum(1)
    while len(seeds) < min(k, len(x)) and far.max() > 0:
        seeds.append(x[int(far.argmax())])
        far = np.minimum(far, ((x - seeds[-1]) ** 2).sum(1))
    return np.array(seeds)


def labelled(x: np.ndarray, how: Rules) -> np.ndarray:
    """The class of each row of a bounded group: 0 noise. With too few rows for a class all are noise (or 1, without noise)."""
    size = x.shape[1]
    none = np.full(len(x), 0 if how.noise else 1)
    if len(x) <= size + 1 or not np.ptp(x, 0).any():
        return none
    centre, spread = x.mean(0), np.maximum(x.var(0), 1e-9)
    floor = spread * how.floor
    classes = rounds(begun(_seeds(x, how.classes), centre, spread, np.ptp(x, 0), how), lambda c: sums_of(x, c, centre), centre, floor, how)
    return none if classes is None else classes.costs(x).argmin(1)


def fit(rows: DataFrame, column: str, size: int, how: Rules = Rules()) -> Classes | None:
    """Classes of rows(spike_id, column) from farthest-first seeds; K x D x D sums reach the driver in each round. None without rows that make a class."""
    checkpoint_dir(rows.sparkSession)
    real = rows.select("spike_id", column).filter(F.col(column).isNotNull()).checkpoint()  # read once in each round
    ends = real.agg(F.count("*"), *[f(F.get(column, i).cast("double")) for i in range(size) for f in (F.avg, F.var_pop, F.min, F.max)]).first()
    if ends[0] <= size + 1:
        return None
    centre, spread, low, high = np.array(ends[1:], float).reshape(size, 4).T
    spread = np.maximum(spread, 1e-9)

    def sums(classes: Classes) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(classes.model.mean) + 1, classes.width(size)))
            for batch in batches:
                if len(batch):
                    total += sums_of(np.stack(batch[column].to_numpy())[:, :size].astype(float), classes, centre)
            c, cell = np.indices(total.shape)
            yield pd.DataFrame({"class": c.ravel(), "cell": cell.ravel(), "value": total.ravel()})

        out = np.zeros((len(classes.model.mean) + 1, classes.width(size)))
        for r in real.select(column).mapInPandas(run, "class int, cell int, value double").groupBy("class", "cell").agg(F.sum("value").alias("v")).collect():
            out[r["class"], r["cell"]] = r["v"]
        return out

    return rounds(begun(farthest_first(real, column, size, how.classes), centre, spread, high - low, how), sums, centre, spread * how.floor, how)


def classified(rows: DataFrame, column: str, size: int, classes: Classes | None) -> DataFrame:
    """rows with class (0 noise), second (the next best class) and margin (what it would cost more); null columns where there are no classes or no vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame({"class": None, "second": None, "margin": None}, index=batch.index, dtype=object)
            known = batch[column].notna()
            if classes is not None and known.any():
                costs = classes.costs(np.stack(batch[column][known].to_numpy())[:, :size].astype(float))
                order = costs.argsort(1, kind="stable")[:, :2]
                least = np.take_along_axis(costs, order, 1)
                out.loc[known] = np.column_stack([order.astype(object), (least[:, 1] - least[:, 0]).astype(object)])
            yield pd.concat([batch, out], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, fields + ", class long, second long, margin double")


@dataclass(frozen=True)
class Chunking:
    """length: of a chunk, and overlap: how much of the next one it has as well, in units of t. most: rows of a chunk, about; one with more is cut at cells of a 64th of its length.
    votes: that a pair of classes needs at least, and share: that part of all votes of two chunks. purity, margin: the least part of a class's votes for its partner, and how much more they must be than those of its
    second (0: not asked). alike: the least similarity of what no vote joins. drift: standard deviations of drift at which a displacement counts e^(-1/2) (0: not asked). edge: the part of a chunk at
    either end whose mean stands for it, where it has 5 rows."""

    length: float
    overlap: float
    most: int = 50_000
    votes: int = 3
    share: float = 0.002
    purity: float = 0.0
    margin: float = 0.0
    alike: float = 0.9
    drift: float = 2.0
    edge: float = 0.25


def chunked(rows: DataFrame, by: str, how: Chunking) -> DataFrame:
    """rows(by, t, ...) with chunk, from 0 within each by, and own: whether it is the row's own chunk or the one before, which has the row as overlap."""
    cell = F.floor(F.col("t") * 64 / how.length)
    cells = rows.groupBy(F.col(by).alias("_by"), cell.alias("_cell")).agg(F.count("*").alias("_n"))
    base = F.floor(F.col("_cell") / 64)
    w = Window.partitionBy("_by", "_base").orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("_base", base).withColumn("_part", F.floor((F.sum("_n").over(w) - F.col("_n")) / how.most))
    begins = F.min("_cell").over(Window.partitionBy("_by", "_base", "_part")) * (how.length / 64)
    # cells are few for each by: 64 to a chunk's length at most
    cells = cells.withColumn("_chunk", F.dense_rank().over(Window.partitionBy("_by").orderBy("_base", "_part")) - 1).withColumn("_from", F.when(F.col("_part") == 0, F.col("_base") * float(how.length)).otherwise(begins))
    placed = rows.withColumn("_at", cell).join(cells.drop("_n", "_base", "_part"), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_at") == F.col("_cell")))
    shared = (F.col("_chunk") > 0) & (F.col("t") - F.col("_from") < how.overlap)
    both = F.when(shared, F.array(F.struct(F.col("_chunk").alias("chunk"), F.lit(True).alias("own")), F.struct((F.col("_chunk") - 1).alias("chunk"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(F.col("_chunk").alias("chunk"), F.lit(True).alias("own"))))
    return placed.withColumn("_c", F.explode(both)).select(*rows.columns, F.col("_c.chunk").cast("long").alias("chunk"), F.col("_c.own").alias("own"))


def correlation(a: np.ndarray, b: np.ndarray, lags: int = 0) -> float:
    """The largest normalised product of two vectors over shifts."""
    norm = np.sqrt((a @ a) * (b @ b))
    if not norm:
        return 0.0
    return max(float(a[max(0, -k) : len(a) - max(0, k)] @ b[max(0, k) : len(b) - max(0, -k)]) for k in range(-lags, lags + 1)) / norm


class Union:
    def __init__(self, names: list):
        self.of = {n: n for n in names}

    def find(self, x):
        while self.of[x] != x:
            self.of[x] = x = self.of[self.of[x]]
        return x

    def join(self, a, b) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        self.of[b] = a


def partners(votes: dict[tuple[int, int], int], how: Chunking) -> list[tuple[int, int]]:
    """Classes of two chunks that are each other's most frequent, often and clearly enough. Ties go to the smaller class."""
    floor = max(how.votes, int(sum(votes.values()) * how.share))
    from_a, from_b = defaultdict(list), defaultdict(list)
    for (a, b), n in votes.items():
        from_a[a].append((-n, b))
        from_b[b].append((-n, a))
    out = []
    for a, found in sorted(from_a.items()):
        (n, b), *others = sorted(found)
        total, second = -sum(m for m, _ in found), -others[0][0] if others else 0
        if -n >= floor and min(from_b[b])[1] == a and -n >= how.purity * total and -n >= (1 + how.margin) * second * bool(how.margin):
            out.append((a, b))
    return out


def joined(models: dict[tuple[int, int], dict], votes: dict[int, dict[tuple[int, int], int]], how: Chunking) -> dict[tuple[int, int], int]:
    """(chunk, class) -> label, the noise of all chunks 0, other units from 1 in order of their first (chunk, class).

    models: mean and the two edges' means of each. First votes join neighbouring chunks' classes. What no vote joins is joined to its most similar class of another chunk, by
    the edges that face each other, if it is that one's most similar as well; displacements unlike those of units joined by votes weigh less.
    """
    names = sorted(models)
    union = Union(names)
    noise = [m for m in names if m[1] == 0]
    for m in noise[1:]:
        union.join(noise[0], m)
    matched, moves = set(), defaultdict(list)
    for k, told in sorted(votes.items()):
        for a, b in partners({p: n for p, n in told.items() if p[0] and p[1]}, how):
            x, y = (k, a), (k + 1, b)
            if x in models and y in models:
                union.join(x, y)
                matched |= {x, y}
                moves[k].append(models[y]["mean"] - models[x]["mean"])
    drifts = {}
    for k, found in moves.items():
        if len(found) >= 3:
            shift = np.mean(found, 0)
            drifts[k] = (shift, ((np.array(found) - shift) ** 2).sum() / (len(found) - 1))

    def facing(x: tuple[int, int], y: tuple[int, int]) -> float:
        """How alike a class of an earlier chunk is to one of a later."""
        score = correlation(models[x]["right"], models[y]["left"])
        between = [drifts.get(k) for k in range(x[0], y[0])]
        if how.drift and between and all(between):
            off = models[y]["mean"] - models[x]["mean"] - sum(d[0] for d in between)
            var = sum(d[1] for d in between)
            score *= float(np.exp(-0.5 * (off @ off) / (how.drift**2 * var))) if var > 0 else float(not off.any())
        return score

    units = [m for m in names if m[1]]
    left = [m for m in units if m not in matched]
    best: dict[tuple[int, int], tuple] = {}
    for x in left:
        for y in units:
            if x[0] != y[0]:
                score = facing(*sorted((x, y)))
                for a, b in ((x, y), (y, x)):
                    best[a] = max(best.get(a, (-np.inf,)), (score, -b[0], -b[1]))
    for x in left:
        if x in best and best[x][0] >= how.alike:
            y = (-best[x][1], -best[x][2])
            if (-best[y][1], -best[y][2]) == x:
                # a label has one class of a chunk
                if not {m[0] for m in names if union.find(m) == union.find(x)} & {m[0] for m in names if union.find(m) == union.find(y)}:
                    union.join(x, y)
    roots = sorted({union.find(m) for m in units})
    number = {r: i + 1 for i, r in enumerate(roots)}
    return {m: 0 if m[1] == 0 else number[union.find(m)] for m in names}


def chunked_cem(rows: DataFrame, by: str, column: str, size: int, chunks: Chunking, how: Rules = Rules()) -> DataFrame:
    """spike_id, by, t, chunk, class and label of rows(by, spike_id, t, column): classes are fitted to each chunk alone, one task a chunk, and joined through time
    to units. class 0 and label 0 are noise. Labels are numbered within each by.

    Rows with a null t or vector are left out; chunks with too few rows for a class are noise. Rows of a chunk are read in order of t and spike_id, so the same rows give the same labels.
    """
    checkpoint_dir(rows.sparkSession)
    of = dict(rows.select(by, "spike_id", "t").dtypes)
    held = rows.select(F.col(by).alias("by"), "spike_id", F.col("t").cast("double").alias("t"), F.transform(F.slice(column, 1, size), lambda x: x.cast("double")).alias("x")).filter("t IS NOT NULL AND x IS NOT NULL")
    held = chunked(held, "by", chunks)

    def classes(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["t", "spike_id"])
        return part.assign(**{"class": labelled(np.stack(part["x"].to_numpy()), how)})

    fields = ", ".join(f"{n} {t}" for n, t in held.dtypes)
    found = held.groupBy("by", "chunk").applyInPandas(classes, fields + ", class long").checkpoint()
    # what stands for a class: its mean, and that of what lies near either end of its chunk
    ends = found.groupBy(F.col("by").alias("_by"), F.col("chunk").alias("_chunk")).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    edge = (F.col("b") - F.col("a")) * chunks.edge
    near = found.join(ends, F.col("by").eqNullSafe(F.col("_by")) & (F.col("chunk") == F.col("_chunk"))).select("by", "chunk", "class", "x", (F.col("t") <= F.col("a") + edge).alias("left"), (F.col("t") >= F.col("b") - edge).alias("right"))
    sides = {"mean": F.lit(True), "left": F.col("left"), "right": F.col("right")}
    means = near.groupBy("by", "chunk", "class").agg(*[F.array(*[F.avg(F.when(on, F.get("x", i))) for i in range(size)]).alias(n) for n, on in sides.items()], *[F.count_if(sides[n]).alias(f"n_{n}") for n in ("left", "right")])
    usual = [F.when(F.col(f"n_{n}") >= 5, F.col(n)).otherwise(F.col("mean")).alias(n) for n in ("left", "right")]
    models = means.select("by", "chunk", "class", "mean", *usual, F.lit(None).cast("long").alias("other"), F.lit(None).cast("long").alias("n"))
    twice = found.groupBy("by", "spike_id").agg(F.max(F.when(~F.col("own"), F.struct("chunk", "class"))).alias("a"), F.max(F.when(F.col("own"), F.struct("chunk", "class"))).alias("b")).filter("a IS NOT NULL")
    votes = twice.groupBy("by", F.col("a.chunk").alias("chunk"), F.col("a.class").alias("class"), F.col("b.class").alias("other")).agg(F.count("*").alias("n"))
    nothing = F.lit(None).cast("array<double>")
    told = models.unionByName(votes.select("by", "chunk", "class", nothing.alias("mean"), nothing.alias("left"), nothing.alias("right"), "other", "n"))

    def labels(told: pd.DataFrame) -> pd.DataFrame:
        seen = told[told["other"].isna()]
        known = {(int(r["chunk"]), int(r["class"])): {n: np.asarray(r[n], float) for n in ("mean", "left", "right")} for _, r in seen.iterrows()}
        votes: dict = defaultdict(dict)
        for _, r in told[told["other"].notna()].iterrows():
            votes[int(r["chunk"])][int(r["class"]), int(r["other"])] = int(r["n"])
        label = joined(known, votes, chunks)
        return seen[["by", "chunk", "class"]].assign(label=[label[int(c), int(k)] for c, k in zip(seen["chunk"], seen["class"], strict=True)])

    # a row for each class of each chunk
    named = told.groupBy("by").applyInPandas(labels, f"by {of[by]}, chunk long, class long, label long").withColumnRenamed("by", "_by")
    own = found.filter("own").drop("own", "x")
    out = own.join(named.withColumnsRenamed({"chunk": "_chunk", "class": "_class"}), F.col("by").eqNullSafe(F.col("_by")) & (F.col("chunk") == F.col("_chunk")) & (F.col("class") == F.col("_class")))
    return out.select("spike_id", F.col("by").alias(by), F.col("t").cast(of["t"]).alias("t"), "chunk", "class", "label")
