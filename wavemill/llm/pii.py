"""Personal data: fixed kinds by pattern, and terms that give protected entities away, by co-occurrence.

DataFrame and SQL functions only. Every value found by pattern is a protected entity. A term's disclosure of an entity is
the point-wise mutual information of the two over the entity's information content: 1 where the term occurs with the
entity alone. Terms over a threshold, borne out by enough independent contexts, are generalised or removed wherever they stand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: The kinds in order, with what a text must hold for a match, and the pattern. Runs are possessive and may
#: start only where no run is under way or a match has just ended, which changes no match and keeps long runs linear.
KINDS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
SPANS = "array<struct<start:int,k:int,end:int>>"
#: Up to so many rows, of a term or a hash, a join sends them to every task.
SENT = 200_000


@dataclass(frozen=True)
class Disclosure:
    """context: characters on either side of an entity whose words are terms. contexts: least number of independent contexts.
    generalise, remove: shares of the entity's information content that a term must disclose."""

    context: int = 64
    contexts: int = 3
    generalise: float = 0.9
    remove: float = 0.97
    letters: int = 4


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(F.pmod(n - i, F.lit(2)) == 1, twice).otherwise(d)

    return F.pmod(F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0), lambda a, x: a + x), F.lit(10)) == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike("^" + r"\.".join([BYTE] * 4) + "$")
    if kind == "card":
        return F.when(F.length(_digits(m)).between(14, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


#: Lengths are summed in blocks of so many, so that places of many matches take less than quadratic time.
BLOCK = 256


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(text: Column, pattern: str | Column, k: int, valid) -> Column:
    """(start, k, end) of the leftmost non-overlapping matches that are valid: what lies between them gives their places."""
    whole = F.concat(F.lit("("), pattern, F.lit(")")) if isinstance(pattern, Column) else F.lit(f"({pattern})")
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))

    def of(found: Column, steps: Column, blocks: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            end = _sum(F.slice(blocks, F.lit(1), block)) + _sum(F.slice(steps, block * BLOCK + 1, i - block * BLOCK + 1))
            return F.when(valid(m), F.struct((end - F.length(m)).alias("start"), F.lit(k).alias("k"), end.alias("end")))

        return F.filter(F.transform(found, span), lambda x: x.isNotNull())

    def sums(steps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / BLOCK).cast("int")), lambda b: _sum(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))))

    def by_steps(found: Column, steps: Column) -> Column:
        return let(sums(steps), lambda blocks: of(found, steps, blocks))

    def by_gaps(found: Column, gap: Column) -> Column:
        return let(F.transform(found, lambda m, i: F.get(gap, i) + F.length(m)), lambda steps: by_steps(found, steps))

    return let(F.regexp_extract_all(text, whole, F.lit(1)), lambda found: let(gaps, lambda gap: by_gaps(found, gap)))


def base_spans(text: Column) -> Column:
    """All spans of the fixed kinds, by start and then kind."""
    parts = []
    for k, (kind, (needs, pattern)) in enumerate(KINDS.items()):
        has = F.contains(text, F.lit(needs)) if needs == "@" else text.rlike(needs)
        parts.append(F.when(has, _places(text, pattern, k, lambda m, kind=kind: _valid(kind, m))).otherwise(F.array().cast(SPANS)))
    return F.sort_array(F.concat(*parts))


def told(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined. Terms to generalise and to remove come after the fixed kinds."""
    names = F.array(*map(F.lit, [*KINDS, "term", "removed"]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sent(rows: DataFrame) -> DataFrame:
    """rows, marked to be sent to every task if their number is within bounds."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def _terms(text: Column, how: Disclosure) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(\p{{L}}{{{how.letters},}})"), F.lit(1)))


def find(docs: DataFrame) -> DataFrame:
    """docs with _text (empty for null), _row (hash of doc_id and text) and base (spans)."""
    return docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumns({"base": base_spans(F.col("_text")), "_row": F.xxhash64("doc_id", "_text")})


def _near(how: Disclosure) -> Column:
    """The text around span s without the span. A word that the window cuts is dropped with its rest; whole words stay."""
    text, start, end = F.col("text"), F.col("s.start"), F.col("s.end")
    edge = lambda at: ~F.substring(text, at, F.lit(1)).rlike(r"\s")
    before = F.substring(text, F.greatest(F.lit(1), start + 1 - how.context), F.least(F.lit(how.context), start))
    before = F.when((start > how.context) & edge(start - how.context), F.regexp_replace(before, r"^\S+", "")).otherwise(before)
    after = F.substring(text, end + 1, F.lit(how.context))
    after = F.when((F.length(text) > end + how.context) & edge(end + how.context + 1), F.regexp_replace(after, r"\S+$", "")).otherwise(after)
    # the blanks stand for the span, so what is on either side is told apart
    return F.concat(before, F.lit(" \x00 "), after)


def disclosing(ws: Workspace, docs: DataFrame, found: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """term and removed (else generalised) of every term that gives an entity away.

    found: digest (of the text), base and, where base has spans, text of every document.

    Entities are hashes of the values found. A context of an entity and a term is the digest of the whole window
    without both, so copies of a passage are one context however often they stand. All counts are of distinct
    contexts; what lies outside an entity's contexts counts as distinct texts.
    """
    some = found.filter(F.size("base") > 0).select("digest", "text", F.explode("base").alias("s"))
    value = F.lower(F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")))
    held = some.select("digest", F.xxhash64("s.k", value).alias("entity"), _near(how).alias("near"))
    pieces = F.regexp_extract_all(F.lower("near"), F.lit(r"(\p{L}+|[^\p{L}\s])"), F.lit(1))
    held = ws.save(held.select("digest", "entity", _terms(F.col("near"), how).alias("terms"), pieces.alias("pieces")), "contexts")
    texts = found.agg(F.count_distinct("digest")).first()[0]
    held = held.filter(F.size("terms") > 0)
    spread = held.groupBy("entity").agg(F.count_distinct(F.xxhash64("pieces")).alias("docs_e"), F.count_distinct("digest").alias("texts_e"))
    pairs = held.select("entity", "digest", "pieces", F.explode("terms").alias("term"))
    pairs = pairs.select("entity", "digest", "term", F.xxhash64(F.array_remove("pieces", F.col("term"))).alias("context")).distinct()
    pairs = pairs.groupBy("entity", "term").agg(F.count_distinct("context").alias("docs_et"), F.count_distinct("digest").alias("texts_et"))
    pairs = pairs.filter(F.col("docs_et") >= how.contexts)
    pairs = ws.save(pairs.join(spread, "entity"), "pairs")
    # a text that stands in m rows counts as an m-th in each, so that tasks add up before anything is shuffled
    copies = ws.save(found.groupBy("digest").agg(F.count("*").alias("m")).filter("m > 1"), "copies")
    said = F.coalesce("text", F.lit(""))
    spoken = docs.select(F.xxhash64(said).alias("digest"), _terms(said, how).alias("terms")).join(sent(copies), "digest", "left")
    spoken = spoken.select((1 / F.coalesce("m", F.lit(1))).alias("part"), F.explode("terms").alias("term"))
    spoken = spoken.groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("texts_t"))
    joint = pairs.join(spoken, "term")
    docs_t = F.col("docs_et") + F.col("texts_t") - F.col("texts_et")
    content = -F.log2(F.col("docs_e") / (texts - F.col("texts_e") + F.col("docs_e")))
    share = F.when(content > 0, (F.log2(F.col("docs_et") / docs_t) + content) / content).otherwise(0.0)
    worst = joint.groupBy("term").agg(F.max(share).alias("share")).filter(F.col("share") >= how.generalise)
    return ws.save(worst.select("term", (F.col("share") >= how.remove).alias("removed")), "risky")



def learn(ws: Workspace, docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """The terms of docs(doc_id, text) that give entities away."""
    found = find(docs.select("doc_id", "text")).select(F.xxhash64("_text").alias("digest"), "base", F.when(F.size("base") > 0, F.col("_text")).alias("text"))
    return disclosing(ws, docs, ws.save(found, "found"), how)


def apply(ws: Workspace, docs: DataFrame, risky: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """docs with _text, _row, base and spans (base and terms, by start and kind). Terms that touch a base span are part of it."""
    found = find(docs)
    text = F.coalesce("text", F.lit(""))
    said = docs.select(F.xxhash64("doc_id", text).alias("_row"), F.explode(_terms(text, how)).alias("term"))
    hits = said.join(sent(risky), "term")
    names = lambda on: F.array_sort(F.collect_set(F.when(on, F.col("term"))))
    hits = ws.save(hits.groupBy("_row").agg(names(~F.col("removed")).alias("_general"), names(F.col("removed")).alias("_gone")), "hits")

    def of(terms: str, k: int) -> Column:
        pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(terms, "|"), F.lit(r")(?!\p{L})"))
        return F.when(F.size(terms) > 0, _places(F.col("_text"), pattern, k, lambda m: F.lit(True))).otherwise(F.array().cast(SPANS))

    added = F.concat(of("_general", len(KINDS)), of("_gone", len(KINDS) + 1))
    added = F.filter(added, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return found.join(hits, "_row", "left").withColumn("spans", F.sort_array(F.concat("base", added))).drop("_general", "_gone")


def spans(ws: Workspace, docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """doc_id, base and spans of every row of docs(doc_id, text); other columns are ignored.

    Null texts are empty and have none; repeated rows get the same spans each; null doc_ids are rows like others. Empty: no rows.
    """
    risky = learn(ws, docs, how)
    return apply(ws, docs.select("doc_id", "text"), risky, how).select("doc_id", "base", "spans")


def sanitise(ws: Workspace, docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """docs with every span in text replaced; null texts stay null and all other columns, whatever their names, stay as they are.

    Repeated rows stay repeated, null doc_ids are rows like others. Empty: no rows.
    """
    risky = learn(ws, docs, how)
    quoted = {c: "`" + c.replace("`", "``") + "`" for c in docs.columns}
    # the rows travel as one column, so that no name clashes with those of the spans
    found = apply(ws, docs.select("doc_id", "text", F.struct(*quoted.values()).alias("whole")), risky, how)
    clean = F.when(F.col("text").isNotNull(), redacted(F.col("_text"), F.col("spans")))
    return found.select(*[clean.alias(c) if c == "text" else F.col(f"whole.{q}").alias(c) for c, q in quoted.items()])


def digest(spanned: DataFrame) -> DataFrame:
    """The counts by kind, the base spans' digest and all spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return spanned.select("doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def redacted(text: Column, all_spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; removed terms leave nothing. Of overlapping spans the first names them."""
    marks = F.array(*[F.lit(f"[{kind.upper()}]") for kind in KINDS], F.lit("[TERM]"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(marks, s["k"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, out).otherwise(acc["out"]).alias("out"))

    done = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(all_spans) > 0, F.aggregate(all_spans, start, step, done)).otherwise(text)
