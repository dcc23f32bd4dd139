"""Tries, conversation repair and token counts against brute force, with odd rows of every kind."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wavemill.llm import repair, tokencount, tries
from wavemill.llm.common import Workspace
from wavemill.llm.queries import QUERIES, table, tokenizer_path

DOCS = "doc_id long, text string, n_words string, weight string, score string, bucket string"
TALK = "conv_id long, turn long, role string, text string, part string, edit string"


def space(spark):
    return Workspace(spark, "test")


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdé") for _ in range(r.randint(1, 4))) for _ in range(n))


def odd_docs(spark):
    rows = [(i, prose(5 + 3 * i, i), "x", "y", None, "z") for i in range(60)]
    rows += [(7, prose(26, 7), "", "", "", ""), (7, prose(26, 7), "", "", "", ""), (None, prose(40, 1), "", "", "", ""), (None, prose(40, 1), "", "", "", "")]
    rows += [(100, None, None, None, None, None), (101, "", "", "", "", ""), (102, " \n\t-", "", "", "", ""), (103, prose(20_000, 2), "", "", "", ""), (104, "One-TWO_three\x00Ü ü 1 ١", "", "", "", "")]
    return rows, spark.createDataFrame(rows, DOCS).repartition(3)


def resampled(rows, target, how):
    """The contract of the tries, word by word."""

    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [" ".join(w[i : i + k]) for k in range(1, how.runs + 1) for i in range(len(w) - k + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % how.buckets

    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([r[1] for r in rows], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + how.buckets) / ((s[b] + 1) * (t.total() + how.buckets))))
    out, able = [], []
    for doc, text, *_ in rows:
        n, own = features(text)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{how.seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(own), weight, score, None])
        if n >= how.min_words:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: how.percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("how", [tries.Sampling(), tries.Sampling(runs=3, buckets=50, nodes=20, percent=60, min_words=1), tries.Sampling(runs=1, percent=100)])
def test_tries(spark, how):
    rows, docs = odd_docs(spark)
    target = [prose(50, 3), None, "", prose(30, 9)]
    got = tries.resample(space(spark), docs, spark.createDataFrame([(t,) for t in target], "text string"), how)
    assert sorted(map(tuple, got.collect()), key=repr) == resampled(rows, target, how)


def test_tries_without_rows(spark):
    rows, docs = odd_docs(spark)
    none = spark.createDataFrame([], "text string")
    assert sorted(map(tuple, tries.resample(space(spark), docs, none).collect()), key=repr) == resampled(rows, [], tries.Sampling())
    assert tries.resample(space(spark), docs.limit(0), none).count() == 0


def cheapest(rows, how):
    """The least (cost, audit) of a conversation by plain tables over its rows' roles and faults."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                for to in set(follow[state]) - {"s"}:
                    best[to] = min(best.get(to, (math.inf, "")), (cost + how.insert, audit + "I"))
        return best

    best = {"": (0, "")}
    for initial, fault in rows:
        new = defaultdict(lambda: (math.inf, ""))
        for state, (cost, audit) in inserted(best).items():
            new[state] = min(new[state], (cost + how.delete, audit + "D"))
            if fault in (repair.FINE, repair.TRUNCATED):
                extra = cost + how.truncated * (fault == repair.TRUNCATED)
                for to in follow[state]:
                    if to == initial:
                        new[to] = min(new[to], (extra, audit + "K"))
                    if to != "s":
                        new[to] = min(new[to], (extra + how.rerole, audit + "R"))
        best = dict(new)
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


def told(talk, how=repair.Costs()):
    """The contract of conversation repair, conversation by conversation, of rows as they are."""
    by = defaultdict(list)
    for conv, turn, role, text, *_ in talk:
        by[conv].append((turn is not None, turn or 0, role or "", text or "", turn))
    out = []
    for conv, rows in by.items():
        seen, faults = set(), []
        for _, _, role, text, _ in (rows := sorted(rows)):
            solid = text.strip(" \t\n\r\x0b\x0c")
            faults.append(repair.BLANK if not solid else repair.DUPLICATE if (role, text) in seen else repair.FINE if solid[-1] in ".!?" else repair.TRUNCATED)
            seen.add((role, text))
        initials = [r[2][:1] for r in rows]
        cost, audit = cheapest(list(zip(initials, faults, strict=True)), how)
        turns = [r[4] for r in rows if r[4] is not None]
        lines, state, left = [], "", list(rows)
        for letter in audit:
            row = left.pop(0) if letter != "I" else None
            if letter != "D":
                state = "a" if state == "u" else row[2][:1] if letter == "K" else "u"
                lines.append(f"{row[2]}:{row[3]}" if letter == "K" else f"{'user' if state == 'u' else 'assistant'}:{row[3] if row else ''}")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *map(faults.count, (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, talk, how=repair.Costs(), parts=4):
    ws = space(spark)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        edits = ws.save(repair.repair(ws, spark.createDataFrame(talk, TALK).repartition(3), how), "edits")
        both = repair.report(edits, how).alias("r").join(repair.digests(edits).alias("d"), F.col("r.conv").eqNullSafe(F.col("d.conv")))
        rows = both.select(F.col("r.conv").cast("long"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
        return sorted(map(tuple, rows), key=repr), edits
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def talk_of(r, conv, n):
    return [(conv, r.choice([None, *range(n)]) if r.random() < 0.2 else k, r.choice(["user", "assistant", "assistant", "system", "tool", "", None]), r.choice(["Hi.", "So", "", None, " \n", "Well? ", "é!", "x" * k + "."]), "p", "e") for k in range(n)]


@pytest.mark.parametrize("block", [2, 128])
def test_repair(spark, block):
    # conversations of all lengths, two of them over several partitions, repeated rows, null ids and turns
    r = random.Random(block)
    talk = [row for conv in range(40) for row in talk_of(r, conv, r.randint(1, 9))] + talk_of(r, 50, 400) + talk_of(r, None, 150) + 30 * [(60, None, None, None, "", "")] + 5 * [(61, 3, "user", "Again.", "", "")]
    how = repair.Costs(block=block)
    got, edits = found(spark, talk, how)
    assert got == told(talk, how)
    # the repaired rows say the same as the digests
    lines = defaultdict(list)
    for x in sorted(repair.repaired(edits).collect(), key=lambda x: (x.conv or "", x.place)):
        lines[x.conv and int(x.conv)].append(f"{x.role}:{x.text}")
    assert all(hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() == sha for c, *_, sha in got)
    for rows in lines.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in rows))


def test_repair_over_partitions(spark):
    # one conversation alone, in more partitions than any block
    talk = talk_of(random.Random(1), 1, 300)
    for parts in (1, 7, 40):
        assert found(spark, talk, parts=parts)[0] == told(talk)
    assert found(spark, [(1, 0, "user", "x" * 500_000, "", "")])[0] == told([(1, 0, "user", "x" * 500_000)])
    assert repair.repair(space(spark), spark.createDataFrame([], TALK)).count() == 0


def test_other_costs(spark):
    r, how = random.Random(5), repair.Costs(rerole=4, delete=3, insert=2, truncated=1, block=16)
    talk = [row for conv in range(30) for row in talk_of(r, conv, r.randint(1, 40))]
    assert found(spark, talk, how)[0] == told(talk, how)


def test_damage(spark, small):
    """The query's rows from the table itself, damaged here."""
    talk, names = [], set()
    for x in table(spark, small, "conversations").collect():
        dice, role, text = zlib.crc32(f"{x.conv_id}:{x.turn}".encode()) % 20, x.role or " ", x.text or " "
        names.add(x.conv_id)
        text = "" if dice == 1 else re.sub("[.!?]", "", text) if dice == 2 else text
        talk += [(x.conv_id, x.turn, "user" if dice == 4 else role, text)] * (0 if dice == 0 else 2 if dice == 3 else 1)
    got = sorted(map(tuple, QUERIES["op12_conversation_repair"](spark, small).collect()), key=repr)
    gone = [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in names - {t[0] for t in talk}]
    assert got == sorted(told(talk) + gone, key=repr)
    odd = repair.damaged(spark.createDataFrame([(None, None, None, None, "", "")] + [(1, k, None, None, "", "") for k in range(40)], TALK)).collect()
    assert all(x.role in (" ", "user") and x.text in (" ", "") for x in odd)


def counted(path, texts):
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        return list(map(len, SentencePieceProcessor(model_file=path).encode(texts)))
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, small, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    r = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "B", "é", "é", "́", "'s", "'ll", "1", "23", "...", "<|endoftext|>", "<|startoftext|>", "ß", "İ", "Σ", "中", "😀", "　", "\x85", "\x1c", "x y", "foo", "▁", "<s>", "\x00", "‍", "ﬁ"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 30))), "", "", "", "") for i in range(1500)]
    rows += [(None, "null id", "", "", "", ""), (1, None, None, None, None, None), (2, "", "", "", "", ""), (3, prose(30_000, 1), "", "", "", ""), (3, prose(30_000, 1), "", "", "", ""), (4, "x" * 50_000, "", "", "", "")]
    rows += [(x.doc_id, x.text, "", "", "", "") for x in table(spark, small, "documents").collect()]
    texts = [x[1] or "" for x in rows]
    want = [(x[0], len(t.encode()), n, n > 100) for x, t, n in zip(rows, texts, counted(path, texts), strict=True)]
    docs = spark.createDataFrame(rows, DOCS)
    for how in (tokencount.Counting(path, limit=100), tokencount.Counting(path, limit=100, batch_bytes=200, parts=5, short=3)):
        got = tokencount.token_counts(docs, how)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert tokencount.token_counts(docs.limit(0), how).count() == 0


def test_unsafe_tokenizers_are_not_cut():
    import json

    config = json.loads(open(tokenizer_path()).read())
    assert tokencount._words_apart(config)
    for change in ({"added_tokens": [config["added_tokens"][0] | {"rstrip": True}]}, {"pre_tokenizer": None}, {"normalizer": {"type": "Prepend", "prepend": "_"}}):
        assert not tokencount._words_apart(config | change)


def test_batches_are_balanced():
    texts = ["é" * (i % 7) for i in range(50)] + ["x" * 100]
    batches = list(tokencount.by_bytes(texts, 20))
    assert [t for b in batches for t in b] == texts
    assert all(len(b) == 1 or sum(len(t.encode()) for t in b) <= 20 for b in batches)


def test_token_query(spark, small):
    got = QUERIES["op13_token_counts"](spark, small).collect()
    docs = table(spark, small, "documents").collect()
    n = dict(zip((d.doc_id for d in docs), counted(tokenizer_path(), [d.text or "" for d in docs]), strict=True))
    assert sorted(map(tuple, got), key=repr) == sorted(((d.doc_id, len((d.text or "").encode()), n[d.doc_id], n[d.doc_id] > 2048) for d in docs), key=repr)


@pytest.mark.parametrize("middle", [6, 7])
def test_plans_need_no_more_than_best_fit(middle):
    import numpy as np

    from wavemill.llm import packing

    how = packing.Packing("", rounds=128)
    x = np.clip(np.random.default_rng(middle).lognormal(middle, 1.2, 2000), 1, 4096).astype(int)
    histogram = dict(Counter(x.tolist()))
    planned, held = packing.plan(histogram, how), Counter()
    for config, n in planned:
        assert n > 0 and sum(a * k for a, k in config.items()) <= how.capacity
        for a, k in config.items():
            held[a] += k * n
    assert held == Counter(histogram)
    assert sum(n for _, n in planned) <= sum(n for _, n in packing.best_fit(histogram, how.capacity))


def test_exchanged_pieces_stay_the_same_pieces():
    from wavemill.llm import packing

    r = random.Random(2)
    planned = [(Counter([r.randint(1, 40) for _ in range(2)]), r.randint(1, 4)) for _ in range(30)]
    given = Counter(r.randint(1, 60) for _ in range(40))
    count = lambda plan, rest: sum((Counter({x: k * n for x, k in c.items()}) for c, n in plan), Counter(rest))
    before, room = count(planned, given), sum((100 - sum(x * k for x, k in c.items())) * n for c, n in planned)
    out = packing.tightened(planned, given, 100)
    assert count(out, given) == before and sum(n for _, n in out) == sum(n for _, n in planned)
    assert sum((100 - sum(x * k for x, k in c.items())) * n for c, n in out) < room
    for config, _ in out:  # no exchange that would fill more is left
        free = 100 - sum(x * k for x, k in config.items())
        assert free >= 0 and not any(x < y <= x + free for x in config for y, n in given.items() if n)
