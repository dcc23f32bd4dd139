"""Quality rules: decision lists learned by sequential covering, applied as Spark conditional expressions.

Everything here is DataFrame and SQL functions. A document becomes a row of integer statistics
(no shuffle: each text is read once, whole). From labelled rows, conjunctions of thresholds are
grown condition by condition on the growing part, cut back on the pruning part, and appended to
an ordered list while they are precise; the list is one CASE expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, words

SYMBOLS = r"[#*$%&|<>]"


def window_hashes(w: Column, size: int) -> Column:
    """64-bit hashes of the windows of `size` words of the array w, in order."""
    return F.when(
        F.size(w) >= size,
        F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])),
    ).otherwise(F.array().cast("array<bigint>"))


def stats(docs: DataFrame, keep: list[str] | tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep and the integer statistics of every whole text. A null text counts as empty: all statistics are 0.

    Repeated doc_ids give a row each. Columns of docs that are not kept and are not text are ignored.
    """
    size = 5
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select(*keep, text.alias("_t")).withColumn("_w", words(F.col("_t")))
    a = a.withColumn("_h", window_hashes(F.col("_w"), size))
    a = a.withColumn("_rep", F.size(F.array_distinct("_h")) < F.size("_h"))
    # only where a window repeats: windows sorted by hash, the places of those with an equal neighbour, in order
    a = a.withColumn("_p", F.when(F.col("_rep"), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    p = F.col("_p")
    again = F.transform(p, lambda x, j: F.when((F.get(p, j - 1)["h"] == x["h"]) | (F.get(p, j + 1)["h"] == x["h"]), x["i"]))
    a = a.withColumn("_i", F.when(F.col("_rep"), F.sort_array(F.filter(again, lambda i: i.isNotNull()))))
    i = F.col("_i")
    # each repeated window adds the words up to the next one's start, its own size at most
    fresh = F.transform(i, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(i, j + 1) - x, F.lit(size))))
    covered = F.aggregate(fresh, F.lit(0).cast("long"), lambda total, x: total + x)
    a = a.withColumn("_l", F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))

    def count(pattern: str) -> Column:
        return F.regexp_count("_t", F.lit(pattern)).cast("long")

    return a.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_rep"), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"[0-9]").alias("n_digits"),
        count(r"[!?]").alias("n_marks"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _permille(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.floor(1000 * F.col(part) / F.col(whole))).otherwise(0).cast("long")


def features() -> dict[str, Column]:
    """What conditions are on: name -> whole-number expression over the columns of stats(), so that thresholds compare exactly."""
    return {
        "n_words": F.col("n_words"),
        "word_length_permille": _permille("word_chars", "n_words"),
        "symbol_permille": _permille("n_symbols", "word_chars"),
        "dup_line_permille": _permille("n_dup_lines", "n_lines"),
        "repeat_permille": _permille("n_repeat_words", "n_words"),
        "upper_permille": _permille("n_upper", "word_chars"),
        "digit_permille": _permille("n_digits", "word_chars"),
        "mark_permille": _permille("n_marks", "word_chars"),
        "distinct_permille": _permille("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str  # "<=" or ">"
    threshold: int

    def holds(self) -> Column:
        x = features()[self.feature]
        return x <= self.threshold if self.op == "<=" else x > self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {self.op} {self.threshold}"


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.holds()
    return out


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects the document."""

    rules: list[list[Condition]] = field(default_factory=list)

    def verdict(self) -> Column:
        """The text of the first rule that holds, null if none does, over the columns of stats()."""
        out = None
        for rule in self.rules:
            said = F.lit(" and ".join(map(str, rule)))
            out = F.when(_all(rule), said) if out is None else out.when(_all(rule), said)
        return F.lit(None).cast("string") if out is None else out


@dataclass(frozen=True)
class Learning:
    """max_rows: labelled rows used, those with the smallest hashes of their doc_id; all where there are fewer.
    precision, support: least share and number of rejected rows of the pruning part that are truly low."""

    max_rows: int = 50_000
    max_rules: int = 8
    max_conditions: int = 3
    precision: float = 0.95
    support: int = 3
    cuts: int = 24


def labelled(docs: DataFrame, labels: DataFrame, how: Learning = Learning()) -> DataFrame:
    """stats() of the documents that learn() takes, found by their ids before a text is read; at most max_rows ids are sent to tasks."""
    known = labels.filter("doc_id is not null and quality is not null").select("doc_id").distinct()
    ids = docs.select("doc_id").join(known, "doc_id").withColumn("_h", F.xxhash64("doc_id"))
    ids = ids.orderBy("_h", "doc_id").limit(how.max_rows).select("doc_id").distinct()
    return stats(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi"))


def learn(ws: Workspace, measured: DataFrame, labels: DataFrame, how: Learning = Learning()) -> DecisionList:
    """A decision list for low quality (label 0) from rows of stats() and labels(doc_id, quality).

    Rows without a label teach nothing; a doc_id labelled twice counts with its lowest label. No labelled
    rows, or none of low quality: an empty list, which rejects nothing. Every step of growing
    is one small aggregation; only counts per feature and cut reach the driver.
    """
    low = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("_low"))
    sample = measured.join(low, "doc_id").withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(how.max_rows)
    sample = ws.save(sample.withColumn("_prune", F.pmod("_h", F.lit(3)) == 0), "labelled")
    names = list(features())
    at = [i / how.cuts for i in range(how.cuts + 1)]
    asked = [F.percentile_approx(F.when(on, x), at, 10_000).alias(f"{n}_{k}") for n, x in features().items() for k, on in (("all", F.lit(True)), ("low", F.col("_low")))]
    found = sample.agg(*asked).first()
    seen = {n: sorted({int(t) for k in ("all", "low") for t in found[f"{n}_{k}"] or ()}) for n in names}
    cuts = {n: [(a + b) // 2 for a, b in zip(x, x[1:], strict=False)] for n, x in seen.items()}  # half-way between values seen

    def cut_bin(name: str) -> Column:
        """How many cuts lie below the value: bin b holds what is above cuts[b - 1] and not above cuts[b]."""
        x = features()[name]
        return F.size(F.filter(F.array(*map(F.lit, cuts[name])), lambda t: t < x))

    bins = [F.struct(F.lit(n).alias("feature"), cut_bin(n).alias("bin")) for n in names if cuts[n]]
    long_form = F.explode(F.array(*bins)) if bins else None
    learned = DecisionList()
    left = F.lit(True)

    def counted(conditions: list[Condition], prune: bool) -> tuple[int, int]:
        row = sample.filter(left & _all(conditions) & (F.col("_prune") == prune)).agg(F.count_if("_low"), F.count_if(~F.col("_low"))).first()
        return row[0], row[1]

    def best(conditions: list[Condition]) -> tuple[float, Condition | None, int]:
        """The condition of the highest information gain, and how many high-quality rows it lets in."""
        hist: dict[str, dict[int, list[int]]] = {n: {} for n in names}
        rows = sample.filter(left & _all(conditions) & ~F.col("_prune")).select("_low", long_form.alias("x")).groupBy("x.feature", "x.bin").agg(F.count_if("_low"), F.count_if(~F.col("_low"))).collect()
        for n, b, low_rows, high_rows in rows:
            hist[n][b] = [low_rows, high_rows]
        out: tuple[float, Condition | None, int] = (0.0, None, 0)
        for n in names:
            p0, n0 = (sum(x[k] for x in hist[n].values()) for k in (0, 1))
            if not p0:
                continue
            p = q = 0
            for b, t in enumerate(cuts[n]):
                x = hist[n].get(b, [0, 0])
                p, q = p + x[0], q + x[1]
                for op, p1, n1 in (("<=", p, q), (">", p0 - p, n0 - q)):
                    if p1 and n1 < n0:
                        gain = p1 * (log2(p1 / (p1 + n1)) - log2(p0 / (p0 + n0)))
                        if gain > out[0] + 1e-9:
                            out = gain, Condition(n, op, t), n1
        return out

    while long_form is not None and len(learned.rules) < how.max_rules:
        rule: list[Condition] = []
        while len(rule) < how.max_conditions:
            gain, condition, wrong = best(rule)
            if condition is None:
                break
            rule.append(condition)
            if not wrong:
                break
        scored = []
        for k in range(1, len(rule) + 1):  # pruning drops final conditions
            p, n = counted(rule[:k], True)
            if p >= how.support and p >= how.precision * (p + n):
                scored.append(((p - n) / (p + n), p, -k))
        if not scored:
            break
        rule = rule[: -max(scored)[2]]
        learned.rules.append(rule)
        left = left & ~_all(rule)
    ws.drop(sample)
    return learned


def apply(measured: DataFrame, rules: DecisionList) -> DataFrame:
    """measured with base_failed, rule (the text of the rule that rejects, else null) and kept."""
    return measured.withColumns({"base_failed": base_failed(), "rule": rules.verdict()}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
