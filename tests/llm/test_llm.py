"""The operators of wavemill.llm against brute force, exact round trips and held-out accuracy, with odd rows of every kind."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.llm import ann, chat, importance, langid, mixing, neardup, packing, pii, quality_rules, warc
from wavemill.llm.common import Workspace
from wavemill.llm.queries import ORACLE_SQL, QUERIES, table, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string"


def words_of(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, and columns whose names clash."""
    long = words_of(20_000)
    base = words_of(200, 1)
    rows = [
        (1, None, "en", "a", None, 5, "x"), (2, "", "en", None, 0, None, None), (3, "one", None, "a", 3, 1, ""), (4, "one", "en", "a", 3, 1, ""),
        (4, "one", "en", "a", 3, 1, ""), (None, "no id here", "de", "b", 1, 1, "y"), (6, " \n\t ", None, None, None, None, None), (7, long, "en", "a", 1, 1, ""),
        (8, long, "en", "b", 1, 1, ""), (9, base, "en", "b", 1, 1, ""), (10, base + " tail", "de", "", 1, 1, ""), (11, base.upper(), "en", "a", 1, 1, ""),
        (12, "line\nline\nline two\n\n", "en", "a", 1, 1, ""), (13, "é😀 é😀 é😀 x", "en", "a", 1, 1, ""), (14, "a b c d e f a b c d e f a b c d e z", "en", "a", 1, 1, ""),
        (15, "mail x.y@z.org, 10.0.0.255 and +1 (555) 123-4567; 4242 4242 4242 4242 stays", "en", "a", 1, 1, ""),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def space(spark):
    return Workspace(spark, "test")


def test_warc_round_trip(spark):
    big = "x" * 100
    rows = [(3, "http://a\r\nb%0A", big, 1), (1, None, big, 1), (1, None, big, 1), (None, "u", big, 1), (4, "u", "y" * 99, 1), (5, "u", "y" * 99, 1), (6, "u", None, 1), (7, "u", "é\r\n\r\nWARC/1.1", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest int")
    archive = warc.write(space(spark), pages)
    assert archive.payloads.count() == 4
    got = sorted(map(tuple, warc.parse(warc.restore(archive)).collect()), key=repr)
    want = []
    for page, url, html, _ in rows:
        raw = (html or "").encode()
        revisit = len(raw) >= 100 and page is not None and page > 1
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None, url))
    assert got == sorted(want, key=repr)
    assert warc.parse(warc.restore(warc.write(space(spark), pages.limit(0)))).count() == 0


def test_warc_files(spark, tmp_path):
    # the files read record by record, by the lengths in their headers alone
    rows = [(i, f"http://h/{i}", words_of(30, i % 4) + "\r\n\r\nWARC/1.1\r\n" * (i % 3) + "é😀") for i in range(20)] + [(3, "http://h/3", "x"), (50, "u", words_of(200_000, 5)), (51, None, None)]
    archive = warc.write(space(spark), spark.createDataFrame(rows, "page_id long, url string, html string"))
    warc.export(archive, str(tmp_path / "out"))
    seen, payloads = Counter(), {}
    for part in (tmp_path / "out").glob("part-*"):
        raw = part.read_bytes()
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            assert lines[0] == "WARC/1.1" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(fields)
            n = int(fields["Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n"
            seen[fields["WARC-Record-ID"]] += 1
            payloads[fields["WARC-Record-ID"]] = rest[:n] if fields["WARC-Type"] == "response" else fields["WARC-Refers-To"]
            raw = rest[n + 4 :]
    assert len(seen) == len(rows) and set(seen.values()) == {1}
    whole = lambda x: payloads[x].decode() if isinstance(x, str) else x.decode()
    got = Counter((k.split(":")[2], whole(v) if isinstance(v, str) else v.decode()) for k, v in payloads.items())
    assert got == Counter((str(i), h or "") for i, _, h in rows)


def test_warc_detects_damage(spark):
    archive = warc.write(space(spark), spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"))
    archive.payloads = archive.payloads.withColumn("payload", F.encode(F.lit("abd"), "UTF-8"))
    with pytest.raises(Exception, match="digest"):
        warc.restore(archive).collect()


def test_packing_plan():
    r = random.Random(1)
    how = packing.Packing("", capacity=256, rounds=60, kinds=40)
    for n in (0, 1, 2, 50, 3000):
        histogram = Counter(min(256, int(r.lognormvariate(3.5, 1)) + 1) for _ in range(n))
        planned = packing.plan(dict(histogram), how)
        got = Counter()
        for config, times in planned:
            assert sum(x * k for x, k in config.items()) <= 256
            for x, k in config.items():
                got[x] += k * times
        assert got == histogram
        used = sum(t for _, t in planned)
        bound = -(-sum(x * k for x, k in histogram.items()) // 256)
        assert used <= 1.1 * bound + 1


def test_packing_knapsack():
    r = random.Random(2)
    for _ in range(30):
        sizes = np.array(sorted(r.sample(range(1, 20), 4)))
        weight, most = np.array([r.random() for _ in sizes]), np.array([r.randint(0, 4) for _ in sizes])
        config = packing._knapsack(weight, sizes, most, 30)
        best = max(weight @ c for c in np.ndindex(*(most + 1)) if sizes @ c <= 30)
        assert (config <= most).all() and sizes @ config <= 30 and abs(weight @ config - best) < 1e-9


def test_packing_program(spark, small):
    # the program itself places most pieces, and needs hardly more sequences than the volume
    how = packing.Packing(tokenizer_path())
    cut = packing.pieces(table(spark, small.replace("0.001", "0.01"), "documents"), how)
    histogram = {x["length"]: x["n"] for x in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    out, left = packing.rounded(histogram, how)
    assert sum(sum(c.values()) * n for c, n in out) >= 0.8 * sum(histogram.values()) and sum(left.values()) <= 0.2 * sum(histogram.values())
    lengths, kind, sizes = packing.kinds(histogram, how)
    assert packing.fractional(sizes, np.bincount(kind, weights=[histogram[x] for x in lengths]), how).gap < 0.02
    bound = sum(x * n for x, n in histogram.items()) / how.capacity
    assert sum(n for _, n in packing.plan(histogram, how)) <= 1.01 * bound + 1


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    how = packing.Packing(tokenizer_path(), rounds=20)
    got = packing.pack(space(spark), odd, how).collect()
    tokenizer = Tokenizer.from_file(how.tokenizer)
    want = []
    for row in odd.collect():
        ids = np.array([*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want.append((row.doc_id, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())))
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(space(spark), empty, how).count() == 0


def test_packed_sequences(spark, odd):
    from tokenizers import Tokenizer

    how = packing.Packing(tokenizer_path(), rounds=20)
    packed = packing.pack(space(spark), odd, how, with_ids=True).cache()
    sizes = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(packed).collect()}
    assert sizes == {r.sequence_id: r.n for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()} and max(sizes.values()) <= 4096
    # null and repeated doc_ids are documents of their own, whole and in one piece each unless they are long
    tokenizer, want = Tokenizer.from_file(how.tokenizer), []
    for row in odd.collect():
        ids = np.array([*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [ids[at : at + 4096].tobytes() for at in range(0, len(ids), 4096)]
    assert sorted(want) == sorted(bytes(r.ids) for r in packed.collect())


def shingles(text, size=2):
    w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_groups(rows, size=2):
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: top(i) for i in up}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, odd, empty, size):
    how = neardup.Forest(shingle=size)
    r = random.Random(4)
    base = words_of(120, 9).split()
    rows = [(x.doc_id, x.text) for x in odd.collect()]
    for i in range(100, 190):  # a star of copies that are more or less changed
        copy = list(base)
        for _ in range(r.randint(0, 9)):
            copy[r.randrange(len(copy))] = f"w{r.random()}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("root", F.lit("x"))
    got = neardup.near_duplicates(space(spark), docs, how).collect()
    want = brute_groups(rows, size)
    assert len(got) == len(rows)
    for x in got:
        assert x.component_id == (want[x.doc_id] if x.doc_id is not None else None)
        assert x.kept == (x.doc_id is None or x.doc_id == x.component_id)
    n = {x.doc_id: x.n_shingles for x in got}
    assert n == {i: len(shingles(t, size)) for i, t in rows}
    assert neardup.near_duplicates(space(spark), empty).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    # rows under one doc_id with different texts each belong to the group of their own text
    a, b = words_of(60, 1), words_of(60, 2)
    rows = [(7, a), (7, b), (9, a + " x"), (8, b + " x"), (3, words_of(60, 3)), (9, a + " x")]
    got = neardup.near_duplicates(space(spark), spark.createDataFrame(rows, "doc_id long, text string"), neardup.Forest(shingle=2)).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(3, 3), (7, 7), (7, 7), (8, 7), (9, 7), (9, 7)]


@pytest.mark.parametrize(("template", "own", "changed"), [(180, 25, 6), (170, 29, 9)])
def test_near_duplicates_in_a_crowd(spark, template, own, changed):
    # texts of one template, 0.78 and 0.75 alike and so apart, with one linked pair each, of ids far from one another
    r = random.Random(template)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    base, pairs = [word() for _ in range(template)], 400
    ids = r.sample(range(10_000), 2 * pairs)
    rows, want = [], {}
    for k in range(pairs):
        x = base + [word() for _ in range(own)]
        y = list(x)
        while y == x or 100 * len(shingles(" ".join(x)) & shingles(" ".join(y))) < 80 * len(shingles(" ".join(x)) | shingles(" ".join(y))):
            y = list(x)
            for i in r.sample(range(len(x)), changed):
                y[i] = word()
        two = ids[2 * k], ids[2 * k + 1]
        rows += zip(two, (" ".join(x), " ".join(y)), strict=True)
        want |= dict.fromkeys(two, min(two))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = neardup.near_duplicates(space(spark), docs, neardup.Forest(shingle=2)).collect()
    assert {x.doc_id: x.component_id for x in got} == want


def test_exact_candidates(spark):
    # without the forest: all linked pairs of small sets, of one root each, are among those across roots
    r = random.Random(12)
    how, ws = neardup.Forest(shingle=1), space(spark)
    sets = [sorted(r.sample(range(40), r.randint(1, 30))) for _ in range(150)]
    for i in range(0, 150, 3):
        sets[i + 1] = sorted(set(sets[i]) ^ set(r.sample(range(40), 1)))
    rows = [(i, np.unique(neardup.mixed(np.array(x, np.uint64))).tobytes(), len(x), i % 100) for i, x in enumerate(sets)]
    held = spark.createDataFrame(rows, "node long, set binary, n long, root long")
    got = {(x.a, x.b) for x in neardup._across(ws, neardup._rarest(ws, held, how), held.select("node", "n", "root"), how).collect()}
    for i, x in enumerate(map(set, sets)):
        for j, y in enumerate(map(set, sets[:i])):
            if i % 100 != j % 100 and 100 * len(x & y) >= 80 * len(x | y) and x:
                assert (j, i) in got
    assert len(got) < 150 * 149 // 4


def test_neighbours_across_borders(spark):
    # as many partitions as rows: all neighbours are beyond a border
    rows = [(i, words_of(80, i // 3) + f" {i % 3}") for i in range(90)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = neardup.near_duplicates(space(spark), spark.createDataFrame(rows, "doc_id long, text string"), neardup.Forest(shingle=2, trees=8)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert {x.doc_id: x.component_id for x in got} == {i: i // 3 * 3 for i in range(90)}


def brute_stats(text):
    w = re.findall(WORD, text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(windows)
    repeated = {k for i, x in enumerate(windows) if seen[x] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_quality_statistics(spark, odd):
    r = random.Random(2)
    more = [(100 + i, "".join(r.choice(["a ", "b ", "c\n", "# ", "\x0b", "é "]) for _ in range(r.randint(0, 60)))) for i in range(60)]
    rows = [(x.doc_id, x.text) for x in odd.collect()] + more
    got = quality_rules.apply(quality_rules.stats(spark.createDataFrame(rows, "doc_id long, text string")), quality_rules.DecisionList()).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = sorted(((i, *brute_stats(t)) for i, t in rows), key=repr)
    assert sorted(((x.doc_id, *(x[n] for n in names)) for x in got), key=repr) == want
    for x in got:
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words) and x.kept == (not x.base_failed)


def test_quality_rules_learn(spark, empty):
    docs = [(i, words_of(60, i) if i % 4 else " ### ".join(words_of(60, i).split())) for i in range(400)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = docs.filter("doc_id < 300").select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    ws = space(spark)
    measured = ws.save(quality_rules.stats(docs), "stats")
    rules = quality_rules.learn(ws, measured, labels)
    assert rules.rules
    wrong = quality_rules.apply(measured, rules).filter("doc_id >= 300").filter(F.col("kept") != (F.col("doc_id") % 4 != 0))
    assert wrong.count() == 0
    assert not quality_rules.learn(ws, measured, labels.limit(0)).rules
    none = quality_rules.stats(empty)
    assert not quality_rules.learn(ws, none, labels).rules and quality_rules.apply(none, rules).count() == 0


def test_quality_rules_held_out(spark, small):
    # a list learned on half of the labels tells low from high in the other half
    big = small.replace("0.001", "0.1")
    half, labels, ws = F.pmod(F.xxhash64("doc_id"), F.lit(2)), table(spark, big, "labels"), space(spark)
    measured = ws.save(quality_rules.stats(table(spark, big, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")), "stats")
    rules = quality_rules.learn(ws, measured, labels.filter(half == 0))
    told = quality_rules.apply(measured, rules).join(labels.filter(half == 1), "doc_id").filter("NOT base_failed").toPandas()
    low = told["quality"] == 0
    assert len(told) > 500 and told["kept"][~low].mean() > 0.95 and told["kept"][low].mean() < 0.2


def test_quality_labels_odd(spark, odd):
    # null and repeated labels, ties and repeated documents: a doc_id counts with its lowest label
    labels = spark.createDataFrame([(None, 0), (9, None), (9, 1), (9, 0), (10, 1), (10, 1), (77, 0), (7, 1), (8, 0)], "doc_id long, quality int").withColumn("_low", F.lit(1))
    ws = space(spark)
    measured = ws.save(quality_rules.stats(odd.unionByName(odd)), "stats")
    got = quality_rules.apply(measured, quality_rules.learn(ws, measured, labels.drop("_low"), quality_rules.Learning(support=1)))
    assert got.count() == 2 * odd.count()


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    return True


def brute_spans(text):
    found = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if valid(kind, m[0]))
    return ",".join(f"{list(KINDS)[k]}:{a}:{b}" for a, k, b in found)


def test_pii_patterns(spark, odd, empty):
    r = random.Random(3)
    texts = ["a@b.c_d@e.f g@h", "1.2.3.4.5 256.1.1.1 00.0.0.0255", "9" * 3000, "1." * 2000, "+" + "1 " * 500, "a" * 3000 + "@b.c"]
    texts += ["".join(r.choice("ab1 .@+-()9é😀48") for _ in range(r.randint(0, 300))) for _ in range(200)]
    rows = [(x.doc_id, x.text) for x in odd.collect()] + [(100 + i, t) for i, t in enumerate(texts)]
    got = pii.digest(pii.spans(space(spark), spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    want = sorted(((i, s := brute_spans(t), hashlib.sha256(s.encode()).hexdigest()) for i, t in rows), key=repr)
    assert sorted(((x.doc_id, x.spans, x.base_sha256) for x in got), key=repr) == want
    assert pii.digest(pii.spans(space(spark), empty)).count() == 0


def test_pii_disclosing_terms(spark):
    rows = [(i, f"{words_of(8, i)} zorbalina {words_of(1, 50 + i)} ada@lab.org {words_of(9, 100 + i)}") for i in range(8)]
    rows += [(100 + i, words_of(30, 1000 + i)) for i in range(200)] + [(400, "Zorbalina came alone"), (401, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    ws = space(spark)
    got = {x.doc_id: x.spans for x in pii.digest(pii.spans(ws, docs)).collect()}
    assert re.fullmatch(r"(term|removed):0:9", got[400]) and "email" in got[0] and got[100] == ""
    clean = {x.doc_id: x.text for x in pii.sanitise(ws, docs).collect()}
    assert "ada@" not in clean[0] and "orbalina" not in clean[400] and clean[100] == rows[8][1] and clean[401] is None


def risky(spark, rows):
    ws = space(spark)
    return {x.term: x.removed for x in pii.learn(ws, spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_pii_many_contexts(spark):
    # few words in many documents: the windows differ though each least word is one of a few
    r = random.Random(5)
    vocabulary = words_of(40, 7).split()
    near = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = [(i, f"{near(4)} zorbalina ada@lab.org {near(4)}") for i in range(600)]
    rows += [(1000 + i, words_of(20, 2000 + i)) for i in range(600)]
    assert risky(spark, rows).get("zorbalina") is True
    # 500 copies of one of five contexts hide nothing, and copies of one passage alone bear nothing out
    few = [(i, f"{words_of(4, i)} zorbalina ada@lab.org {words_of(4, 50 + i)}") for i in range(5)]
    few += [(100 + i, few[0][1]) for i in range(500)] + [(2000 + i, words_of(20, 3000 + i)) for i in range(300)]
    assert risky(spark, few).get("zorbalina") is True
    assert "zorbalina" not in risky(spark, [(i, few[0][1]) for i in range(500)] + few[-300:])
    # copies don't make a term a sign of the entity where most of its texts don't name it
    away = few + [(5000 + i, f"zorbalina {words_of(9, 6000 + i)}") for i in range(60)]
    assert "zorbalina" not in risky(spark, away)


def test_pii_border_words(spark):
    # the term is the first or the last word of the whole text: the window did not cut it
    first = [(i, f"zorbalina ada@lab.org {words_of(5, i)}") for i in range(6)]
    last = [(10 + i, f"{words_of(5, 20 + i)} bob@lab.org quexofine") for i in range(6)]
    # here it is cut: only its rest lies within 64 characters
    cut = [(20 + i, f"{words_of(9, 40 + i)} wumpleton{'-' * (60 - i % 2)} eve@lab.org") for i in range(6)]
    got = risky(spark, first + last + cut + [(100 + i, words_of(20, 500 + i)) for i in range(300)])
    assert got.get("zorbalina") is True and got.get("quexofine") is True
    assert not {t for t in got if "wumpleton".endswith(t)}


def test_importance(spark, odd, empty):
    r, vocabulary = random.Random(7), words_of(400, 3).split()
    docs = spark.createDataFrame([(i, " ".join(r.choices(vocabulary[:300] if i % 5 else vocabulary[200:], k=80))) for i in range(500)], "doc_id long, text string")
    labels = docs.filter("doc_id < 250 and doc_id % 5 <> 0").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    how = importance.Resampling(share=0.8)
    got = importance.resample(space(spark), docs, labels, how).collect()
    assert sum(x.kept for x in got) == 400 and sum(x.kept and x.doc_id % 5 != 0 for x in got) > 390
    assert {x.doc_id for x in got if x.kept} == {x.doc_id for x in sorted(got, key=lambda x: -x.key)[:400]}
    again = importance.resample(space(spark), docs.repartition(7), labels, how).collect()
    assert {x.doc_id for x in again if x.kept} == {x.doc_id for x in got if x.kept}
    assert importance.resample(space(spark), odd, labels.limit(0)).count() == odd.count()
    assert importance.resample(space(spark), empty, labels).count() == 0


def test_importance_of_repeated_rows(spark):
    # as many as the share says, however many rows stand at the border
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    same = spark.createDataFrame([(1, "one two three")] * 100, "doc_id long, text string")
    got = importance.resample(space(spark), same, labels).collect()
    assert len(got) == 100 and sum(x.kept for x in got) == 85
    mixed = spark.createDataFrame([(i % 3 if i % 4 else None, "one two three") for i in range(90)], "doc_id long, text string")
    got = importance.resample(space(spark), mixed, labels, importance.Resampling(share=0.5)).collect()
    assert len(got) == 90 and sum(x.kept for x in got) == 45
    assert Counter(x.doc_id for x in got) == Counter(x.doc_id for x in mixed.collect())


def brute_log_weights(rows, target, how):
    """Bags of words and pairs of words over their buckets, counted one by one."""
    from wavemill.llm.common import WordHashes

    hashes, raw, good, own = WordHashes(), Counter(), Counter(), {}
    for i, text in rows:
        w = [hashes[x.encode()] for x in re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
        two = [int(neardup.mixed(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64], np.uint64))[0]) for a, b in zip(w, w[1:])]
        own[i] = [x % how.buckets for x in w + two]
        raw.update(own[i])
        if i in target:
            good.update(own[i])
    log = lambda n, of, x: np.log((of[x] + how.smoothing) / (n + how.smoothing * how.buckets))
    return {i: sum(log(sum(good.values()), good, x) - log(sum(raw.values()), raw, x) for x in g) for i, g in own.items()}


@pytest.mark.parametrize("per_gram", [False, True])
def test_importance_weights(spark, odd, per_gram):
    rows = [(i, t) for i, t in {x.doc_id: x.text for x in odd.collect() if x.doc_id is not None}.items()] + [(100 + i, words_of(40, i)) for i in range(20)]
    how = importance.Resampling(buckets=500, share=0.5, per_gram=per_gram)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100, 110)] + [(9, 1, 1), (10, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = importance.resample(space(spark), spark.createDataFrame(rows, "doc_id long, text string"), labels, how).collect()
    want = brute_log_weights(rows, set(range(100, 110)), how)
    for x in got:
        assert abs(x.log_weight - want[x.doc_id]) < 1e-6 * max(1, abs(want[x.doc_id]))
    assert sum(x.kept for x in got) == -(-len(rows) // 2)


def auc(score, good):
    rank = np.argsort(np.argsort(score))
    n = good.sum()
    return (rank[good].sum() - n * (n - 1) / 2) / n / (len(good) - n)


def test_importance_held_out(spark, small):
    # labelled rows of one half teach, those of the other half tell: good texts weigh more, by sum and by gram
    big = small.replace("0.001", "0.1")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    labels = table(spark, big, "labels")
    rows = importance.resample(space(spark), table(spark, big, "documents"), labels.filter(half == 0)).join(labels.filter(half == 1), "doc_id").toPandas()
    good = rows["quality"].to_numpy() == 1
    assert auc(rows["log_weight"], good) > 0.97 and auc(rows["log_weight"] / rows["n_grams"].clip(1), good) > 0.97
    assert rows["kept"][good].mean() > 0.95 and rows["kept"][~good].mean() < 0.1


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (2, 0, "system", "s"), (2, 1, "user", "hi"), (2, 2, "assistant", "no"),
            (3, 0, "system", "s"), (3, 1, "user", "other"), (4, None, None, None), (4, 5, "a>b\n\\", "</turn> <turn x>\\ \\t"), (5, 0, "assistant", ""), (None, 0, "assistant", "z"), (6, 0, "system", "s"), (6, 1, "user", "hi"), (6, 2, "assistant", "yo")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(0))
    tree = chat.build(space(spark), df)
    got = {x.conv_id: x for x in chat.read_back(space(spark), tree).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].formatted_chars == sum(len(chat.segment(r, x)) for _, r, x in turns)
    nodes = {bytes(x.node): x for x in tree.nodes.collect()}
    assert len(nodes) == 9  # three shared turns are laid out once
    trees = defaultdict(list)
    for x in nodes.values():
        trees[bytes(x.tree)].append(x)
        own, at = [], x
        while at.depth:
            at = nodes[bytes(at.parent)]
            own.append((at.start, at.start + at.length))
        covered = [k for a in x.attends for k in range(a["from"], a["to"])]
        assert sorted(covered) == sorted(k for a, b in own for k in range(a, b)) and x.position == len(covered)
    for nodes_of in trees.values():  # gapless, and a subtree is one interval
        at = 0
        for x in sorted(nodes_of, key=lambda x: x.start):
            assert x.start == at
            at += x.length
    assert chat.read_back(space(spark), chat.build(space(spark), df.limit(0))).count() == 0


def test_chat_is_read_from_its_layout(spark):
    # a layout damaged on purpose is noticed, or says something else
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c % 3 if t < 2 else c} {'x' * 5000 * (t == 1)}") for c in range(12) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ws = space(spark)
    tree = chat.build(ws, df)
    for width in (100, 4096):
        good = {x.conv_id: x for x in chat.read_back(ws, tree, width).collect()}
        assert len(good) == 12 and all(x.n_turns == 4 for x in good.values())
    swapped = chat.Tree(tree.nodes, tree.stream.withColumn("segment", F.regexp_replace("segment", "turn 0 of 1", "turn 9 of 1")), tree.leaves)
    changed = {x.conv_id for x in chat.read_back(ws, swapped).collect() if x.turns_sha256 != good[x.conv_id].turns_sha256}
    assert changed == {c for c in range(12) if c % 3 == 1}
    for nodes in (tree.nodes.withColumn("position", F.col("position") + 1), tree.nodes.withColumn("attends", F.slice("attends", 2, 9))):
        with pytest.raises(Exception, match="intervals of a conversation"):
            chat.read_back(ws, chat.Tree(nodes, tree.stream, tree.leaves)).collect()


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark, odd, empty):
    r = random.Random(6)
    rows = [(i, words_of(r.randint(1, 200), i), r.choice([None, "", "a", "b", "c", "é"] + ["hot"] * 6)) for i in range(1500)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit(0)), odd):
        got = mixing.mix(space(spark), docs).collect()
        assert len(got) == docs.count()
        sizes, taken = Counter(), Counter()
        for x in got:
            sizes[x.source] += x["size"]
            taken[x.source] += x.taken
            assert 0 <= x.taken <= 2 * x["size"]
        want = brute_targets(sizes)
        for x in got:
            assert x.source_size == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6 * max(1, x.target)
        for s in sizes:
            assert abs(taken[s] - want[s]) <= 40
        again = mixing.mix(space(spark), docs.repartition(5)).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert mixing.mix(space(spark), empty).count() == 0


def test_apportionment(spark):
    r = random.Random(8)
    for case in range(4):
        votes = {i: r.choice([0, 1, 5, 1000]) * r.random() for i in range(r.randint(1, 12))}
        seats = r.randint(0, 60)
        rows = [(0, i, v, seats) for i, v in votes.items()]
        won = {x.i: x.won for x in mixing.apportion(spark.createDataFrame(rows, "g int, i long, v double, s long"), ["g"], "v", "s", "i").collect()}
        want = Counter({i: 0 for i in votes})
        if sum(votes.values()):
            for _ in range(seats):
                want[max(votes, key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert won == dict(want), case


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 16))
    rows = [(i, [float(v) for v in x[i]]) for i in range(900)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, []), (None, rows[1][1]), (2005, [1.0, 2.0]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vector", F.lit(1))
    got = defaultdict(list)
    for r in ann.nearest(space(spark), df, F.col("vec_id") % 100 == 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    known = {i: np.array(v) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    hit = 0
    queries = [q for q in known if q % 100 == 5]
    for q in queries:
        far = sorted((np.sqrt(((v - known[q]) ** 2).sum()), i) for i, v in known.items() if i != q)[:10]
        assert len(got[q]) == len({i for i, _ in got[q]}) == 10
        hit += len({i for i, _ in got[q]} & {i for _, i in far})
        assert all(abs(s - np.sqrt(((known[i] - known[q]) ** 2).sum())) < 1e-12 for i, s in got[q])
    assert hit >= 0.9 * 10 * len(queries) and [i for i, _ in got[5]] == list(range(1000, 1010))
    assert [i for i, _ in got[2005]] == [] and ann.nearest(space(spark), df.limit(0), F.lit(True)).count() == 0


def test_neighbours_of_repeated_rows(spark):
    # rows repeated many times count once, ids with several vectors with the nearest, and ten others are found
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(40)]
    rows = rows + rows[1:20] * 30 + [(25, [float(v) for v in x[0] + 0.001]), (0, [99.0] * 8), (3, rows[3][1])]
    got = ann.nearest(space(spark), spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, ann.Collisions(block=16)).collect()
    least = np.array(min(rows[0][1], [99.0] * 8))
    near = {}
    for i, v in rows:
        if i:
            near[i] = min(near.get(i, np.inf), np.sqrt(((np.array(v) - least) ** 2).sum()))
    want = sorted(near.items(), key=lambda e: (e[1], e[0]))[:10]
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [i for i, _ in want]


def test_neighbours_filter(spark):
    # unit vectors in 64 dimensions, as far from one another as can be: most rows are left out unseen
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 64))
    x /= np.sqrt((x**2).sum(1))[:, None]
    block = ann.Block(np.arange(6000), x, ann.Collisions())
    seen, hit = 0, 0
    for q in range(0, 6000, 200):
        ids, far, verified = block.nearest(q, x[q])
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hit, seen = hit + len(set(ids) & set(d.argsort()[:10])), seen + verified
        assert np.allclose(far, d[ids])
    assert seen <= 0.1 * 30 * 6000 and hit >= 0.9 * 300


def test_language(spark, odd, empty, small):
    docs = table(spark, small, "documents")
    model = langid.learn(docs)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(x.lang_pred == x.lang for x in got) >= 0.9 * len(got) and all(0 <= x.score <= 1 for x in got)
    assert {x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got} == {True}
    told = {x.doc_id: x.lang_pred for x in langid.identify(odd, model).collect()}
    assert told[1] == told[2] == told[6] == "und" and told[9] != "und"
    assert {x.lang_pred for x in langid.identify(odd, langid.learn(empty)).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0
    # numerals, fractions and signs are no letters; marks and letters of any script are
    signs = spark.createDataFrame([(1, "\u00bd \u00b2 3"), (2, "\u2167 \u2464"), (3, "123 -- 4_5"), (4, "\u0301"), (5, "3 \u00aa"), (6, "\u4e2d"), (7, "1 x 2")], "doc_id long, text string")
    told = {x.doc_id: (x.lang_pred, x.score) for x in langid.identify(signs, model).collect()}
    assert all(told[i] == ("und", 0.0) for i in (1, 2, 3, 4)) and all(told[i][0] != "und" for i in (5, 6, 7))


def test_language_by_brute_force():
    # features as sets, kernels by counting, and ridge regression as one least-squares problem
    how = langid.Kernel(bits=9, landmarks=4)
    r = random.Random(3)
    texts = [" ".join("".join(r.choice(a) for _ in range(5)) for _ in range(r.randint(2, 9))) for a in ("abcde", "defgh", "ghiab") for _ in range(12)]
    names = np.array([n for n in ("x", "y", "z") for _ in range(12)])

    def features(text):
        out, c = set(), [ord(x) for x in text.lower()]
        for n in how.grams:
            for i in range(len(c) - n + 1):
                h = c[i] + n
                for k in range(1, n):
                    h = (h * 0x100000001B3 + c[i + k]) % 2**64
                out.add((h * 0x9E3779B97F4A7C15) % 2**64 >> (64 - how.bits))
        return out

    sets = [features(t) for t in texts]
    marks = [i for n in "xyz" for i in np.flatnonzero(names == n)[:4]]
    k = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    to = np.array([[k(a, sets[m]) for m in marks] for a in sets])
    own = to[marks]
    y, each = (names[:, None] == np.array(["x", "y", "z"])).astype(float), 1 / 12
    # phi = to @ own^(-1/2): the penalty on the whitened weights is that on own^(1/2) beta
    value, vector = np.linalg.eigh(own)
    root = vector @ np.diag(np.sqrt(np.maximum(value, 0))) @ vector.T
    beta = np.linalg.lstsq(np.vstack([to * np.sqrt(each), root * np.sqrt(how.ridge / 3)]), np.vstack([y * np.sqrt(each), np.zeros((len(marks), 3))]), rcond=None)[0]
    model = langid.fit(names, langid.present(texts, how), how)
    got = langid._kernel(langid.present(texts, how), model.landmarks, model.sizes) @ model.weights
    assert model.languages == ["x", "y", "z"] and np.allclose(got, to @ beta, atol=1e-3)


@pytest.mark.parametrize("name", ["op1_warc", "op3_near_duplicates", "op7_chat"])
def test_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, small).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_pii_keeps_columns(spark):
    names = ["base", "spans", "_text", "_row", "_clean", "whole", "digest", "a.b"]
    docs = spark.createDataFrame([(1, "mail me: x.y@z.org", *"abcdefgh"), (None, None, *"ijklmnop")], ["doc_id", "text", *names])
    got = sorted(map(tuple, pii.sanitise(space(spark), docs).select("doc_id", "text", *[f"`{n}`" for n in names]).collect()), key=repr)
    assert got == [(1, "mail me: [EMAIL]", *"abcdefgh"), (None, None, *"ijklmnop")]


def staged(odd):
    """odd with the columns of documents first and names that stages use themselves."""
    extra = ["_time", "times", "whole", "row_key", "_doc_id", "group", "shingles", "_at", "label"]
    return odd.withColumns({n: F.concat(F.lit(n), F.coalesce("text", F.lit("-"))) for n in extra})


def test_stages_on_odd_rows(spark, odd, empty, small):
    import corpus_pipeline as P

    docs = staged(odd)
    rows = [tuple(r) for r in docs.collect()]
    key = lambda r: repr(r)
    # quality: what the base rules leave, whole
    got = sorted((tuple(r) for r in P.quality(spark, docs, small).collect()), key=key)
    ok = [r for r in rows if (b := brute_stats(r[1]))[0] >= 10 and 100 * b[4] <= 20 * b[0]]
    assert set(got) <= set(ok) and {r[0] for r in got} >= {9, 10, 11}
    # near-duplicates: one row of each group, all without words or doc_id
    got = [tuple(r) for r in P.near_duplicates(spark, docs, small).collect()]
    groups = brute_groups([(r[0], r[1]) for r in rows], 5)
    stay = {i for i, g in groups.items() if i == g}
    assert sorted(r[0] for r in got if r[0] is not None) == sorted(stay) and sum(r[0] is None for r in got) == 1 and set(got) <= set(rows)
    # personal data: rows and other columns stay
    got = sorted((tuple(r) for r in P.personal_data(spark, docs, small).collect()), key=key)
    assert len(got) == len(rows)
    assert {r[0]: r[1] for r in got}[15].startswith("mail [EMAIL], [IP] and [PHONE]") and sorted(map(str, (r[5:] for r in got))) == sorted(map(str, (r[5:] for r in rows)))
    # mixing: whole rows, twice at most
    got = Counter(tuple(r) for r in P.mix(spark, docs, small).collect())
    have = Counter(rows)
    assert all(n <= 2 * have[r] for r, n in got.items()) and got
    # packing: the pieces of every row
    got = P.pack(spark, docs, small).collect()
    assert len({r.sequence_id for r in got}) >= 1 and sum(r.piece == 0 for r in got) == len(rows)
    for _, stage in P.STAGES:
        assert stage(spark, staged(empty), small).count() == 0
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns


def test_one_of_each_group(spark):
    # under doc_id 7 two texts that differ, one of them in the group of 5; repeated rows; rows without words
    a, b = words_of(60, 1), words_of(60, 2)
    rows = [(7, a, "x"), (7, b, "x"), (7, b, "w"), (5, a + " x", "x"), (5, a + " x", "x"), (8, " ", "x"), (8, "", "y"), (8, b, "x"), (None, b, "x")]
    got = neardup.one_of_each(space(spark), spark.createDataFrame(rows, "doc_id long, text string, group string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(5, a + " x", "x"), (7, b, "w"), (8, " ", "x"), (8, "", "y"), (None, b, "x")], key=repr)


def test_mixing_drift(spark):
    # whole documents written as often as rounded come near the words the sources are to have
    import corpus_pipeline as P

    r = random.Random(16)
    rows = [(i, words_of(r.randint(20, 300), i), "en", r.choice(["a", "b", "c", None] + ["hot"] * 4), 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    written = Counter()
    for x in P.mix(spark, docs, "").collect():
        written[x.source] += len(x.text.split())
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(text.split())
    for source, target in brute_targets(sizes).items():
        assert abs(written[source] - target) <= 0.01 * target + 300


def test_pipeline(spark, small):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, small)
    assert got.count() > 0 and got.filter("length > 4096").count() == 0
    assert corpus_pipeline.personal_data(spark, table(spark, small, "documents"), small).columns == table(spark, small, "documents").columns


def test_shorts_lose_no_link():
    # what two shorts share is no less than what their sets share, equal top bits counted as often as both have them
    r = np.random.default_rng(5)
    for bits in (63, 50, 48):  # few top bits are left, so many are equal
        for n in (0, 1, 40, 900):
            x = np.unique(r.integers(0, 2**bits, n, dtype=np.uint64))
            y = np.unique(np.r_[x[: 2 * n // 3], r.integers(0, 2**bits, n // 3, dtype=np.uint64)])
            a, b = neardup._short(x), neardup._short(y)
            assert len(a) == 2 * len(x)
            top = lambda v: Counter((v >> np.uint64(48)).tolist())
            shared = len(np.intersect1d(neardup._numbered(a), neardup._numbered(b)))
            assert shared == sum((top(x) & top(y)).values()) >= len(np.intersect1d(x, y))


def test_whole_sets_are_shuffled_only_where_shorts_leave_it_open(spark, monkeypatch):
    # of pairs that shorts tell apart none reaches the whole sets, with pairs sent to every task or shuffled
    r = np.random.default_rng(6)
    sets = [np.unique(r.integers(0, 2**64, 100, dtype=np.uint64)) for _ in range(20)]
    for i in range(0, 20, 4):
        sets[i + 1] = np.unique(np.r_[sets[i][:95], sets[i + 1][:5]])  # linked, as 90 of 100 and more are shared
        sets[i + 2] = np.unique(np.r_[sets[i][:80], sets[i + 2][:20]])  # not
    held = spark.createDataFrame([(i, x.tobytes(), neardup._short(x)) for i, x in enumerate(sets)] * 2, "node long, set binary, short binary")
    pairs = spark.createDataFrame([(i, j) for i in range(20) for j in range(i + 1, 20)], "a long, b long")
    met, alike = {}, neardup._alike
    monkeypatch.setattr(neardup, "_alike", lambda p, s, column, how: met.setdefault(column, []).append(p.count()) or alike(p, s, column, how))
    for sent in (1000, 0):
        got = neardup._confirmed(space(spark), pairs, held, neardup.Forest(sent=sent)).collect()
        assert sorted((x.a, x.b) for x in got) == [(i, i + 1) for i in range(0, 20, 4)]
    assert met == {"short": [190, 190], "set": [5, 5]}
