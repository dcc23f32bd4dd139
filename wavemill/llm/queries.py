"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, importance, langid, mixing, neardup, packing, pii, quality_rules, repair, tokencount, tries, warc
from .common import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(Workspace(spark, "op1"), table(spark, sf_dir, "pages"))
    return warc.parse(warc.restore(archive)).drop("url")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(Workspace(spark, "op2"), table(spark, sf_dir, "documents"), packing.Packing(tokenizer_path()))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(Workspace(spark, "op3"), table(spark, sf_dir, "documents"), neardup.Forest(shingle=2)).drop("shingles", "group")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op4")
    measured = ws.save(quality_rules.stats(table(spark, sf_dir, "documents")), "stats")
    rules = quality_rules.learn(ws, measured, table(spark, sf_dir, "labels"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return quality_rules.apply(measured, rules).select(*base)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(Workspace(spark, "op5"), table(spark, sf_dir, "documents")))


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(Workspace(spark, "op6"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    ws = Workspace(spark, "op7")
    return chat.read_back(ws, chat.build(ws, conversations))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(Workspace(spark, "op8"), table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(Workspace(spark, "op9"), table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op11_target_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.resample(Workspace(spark, "op11"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws, conversations = Workspace(spark, "op12"), table(spark, sf_dir, "conversations")
    edits = ws.save(repair.repair(ws, repair.damaged(conversations)), "edits")
    names = conversations.select("conv_id").distinct().withColumn("conv", F.col("conv_id").cast("string"))
    found = repair.report(edits).alias("r").join(repair.digests(edits).alias("d"), F.col("r.conv").eqNullSafe(F.col("d.conv")))
    sums = [F.coalesce(F.col(f"r.{c}"), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    told = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")]
    return names.join(found, names.conv.eqNullSafe(F.col("r.conv")), "left").select("conv_id", *sums, *told)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokencount.Counting(tokenizer_path()))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc, op2_packing, op3_near_duplicates, op4_quality_rules, op5_pii,
        op6_importance, op7_chat, op8_mixing, op9_neighbours, op10_language, op11_target_tries, op12_conversation_repair, op13_token_counts, pipeline,
    )
}

#: SQL of the CRC-32's table (its polynomial as a fixed value), as the list t.
_CRC_TABLE = """crc_table AS (
            SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
            FROM range(256) r(i)
        )"""


def _crc32(text: str) -> str:
    """SQL of a text's CRC-32, from a relation that crc_table is joined to."""
    octets = f"list_transform(range(1, CAST(2 * strlen({text}) AS BIGINT), 2), lambda i: CAST('0x' || substr(hex(encode({text})), i, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce({octets}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)))"


def _edited(state: str, cost: str, audit: str, said: str = "''") -> str:
    """SQL of a state after an edit. A state is its cost in nine digits, its audit, a mark and its repaired text, so that the least of several is the cheapest
    and of those the one with the least audit."""
    head, tail = f"split_part({state}, chr(1), 1)", f"substr({state}, strpos({state}, chr(1)))"
    return f"lpad(CAST(CAST(substr({head}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({head}, 10) || '{audit}' || {tail} || {said}"


ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
        FROM f
    """,
    "op3_near_duplicates": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
                ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
            FROM w
        ), u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
        ), p AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))
        ), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p
        ), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
        ), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
        FROM s JOIN c ON s.doc_id = c.a
    """,
    "op7_chat": """
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
        ), e AS (
            SELECT *, replace(replace(replace(role, '\\', '\\\\'), '<turn', '<\\turn'), '</turn', '<\\/turn') AS r,
                replace(replace(replace(text, '\\', '\\\\'), '<turn', '<\\turn'), '</turn', '<\\/turn') AS x
            FROM t
        ), f AS (
            SELECT *, length('<turn ') + length(replace(r, '>', '\\>')) + 2 + length(x) + length('</turn>') + 1 AS n FROM e
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(n) AS BIGINT) AS formatted_chars
        FROM f GROUP BY conv_id
    """,
    "op11_target_tries": f"""
        WITH {_CRC_TABLE}, texts AS (
            SELECT 'd' AS kind, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark
        ), w AS (
            SELECT row_number() OVER () AS row, kind, doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
            FROM texts
        ), f AS (
            SELECT row, kind, doc_id, len(w) AS n_words, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w
        ), u AS (SELECT row, kind, unnest(f) AS x FROM f
        ), b AS (SELECT x, {_crc32("x")} % 10000 AS bucket FROM (SELECT DISTINCT x FROM u), crc_table
        ), c AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM u JOIN b USING (x) GROUP BY bucket
        ), g AS (
            SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE) / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM c
        ), m AS (SELECT row, floor(sum(gain) / count(*)) AS weight FROM u JOIN b USING (x) JOIN g USING (bucket) WHERE kind = 'd' GROUP BY row
        ), p AS (
            SELECT row, doc_id, n_words, len(f) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
            FROM f LEFT JOIN m USING (row) WHERE kind = 'd'
        ), z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM p
        ), r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM z WHERE n_words >= 20
        )
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (row)
    """,
    "op12_conversation_repair": f"""
        WITH RECURSIVE {_CRC_TABLE}, x AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
        ), dice AS (SELECT *, {_crc32("name")} % 20 AS dice FROM x, crc_table
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN dice = 4 THEN 'user' ELSE role END AS role,
                CASE dice WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN dice = 3 THEN 2 ELSE 1 END))
            FROM dice WHERE dice <> 0
        ), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged
        ), q AS (
            SELECT conv_id, turn, role, text, k, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair,
                CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1
                    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 2
                    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault
            FROM o
        ), sums AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM q GROUP BY conv_id
        ), a AS (  -- the cheapest ways to each state before a row, e none, s system, u user, v assistant, and to the same with turns inserted (j, w)
            SELECT conv_id, 0 AS k, '000000000' || chr(1) AS e, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS v FROM sums
            UNION ALL
            SELECT conv_id, k, e, s, u, v FROM (
                SELECT t.conv_id, t.k, {_edited("e", "2", "D")} AS e,
                    least({_edited("s", "2", "D")}, CASE WHEN fault IN (0, 3) AND i = 's' THEN {_edited("e", "extra", "K", "line")} END) AS s,
                    least({_edited("j", "2", "D")},
                        CASE WHEN fault IN (0, 3) AND i = 'u' THEN {_edited("least(e, s, w)", "extra", "K", "line")} END,
                        CASE WHEN fault IN (0, 3) THEN {_edited("least(e, s, w)", "extra + 1", "R", "as_user")} END) AS u,
                    least({_edited("w", "2", "D")},
                        CASE WHEN fault IN (0, 3) AND i = 'a' THEN {_edited("j", "extra", "K", "line")} END,
                        CASE WHEN fault IN (0, 3) THEN {_edited("j", "extra + 1", "R", "as_assistant")} END) AS v
                FROM (
                    SELECT *, least(v, {_edited("j", "5", "I", "'assistant:' || chr(10)")}) AS w FROM (
                        SELECT a.*, least(u, {_edited("e", "5", "I", "'user:' || chr(10)")}, {_edited("s", "5", "I", "'user:' || chr(10)")}, {_edited("v", "5", "I", "'user:' || chr(10)")}) AS j FROM a)
                ) b JOIN (
                    SELECT conv_id, k, fault, i, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS extra, role || ':' || text || chr(10) AS line,
                        'user:' || text || chr(10) AS as_user, 'assistant:' || text || chr(10) AS as_assistant FROM q
                ) t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.k = b.k + 1
            )
        ), done AS (
            SELECT a.conv_id, least(e, v, {_edited("u", "5", "I", "'assistant:' || chr(10)")}, {_edited("s", "10", "II", "'user:' || chr(10) || 'assistant:' || chr(10)")}) AS best
            FROM a JOIN sums ON a.conv_id IS NOT DISTINCT FROM sums.conv_id AND a.k = sums.n
        ), told AS (
            SELECT sums.*, CAST(substr(best, 1, 9) AS BIGINT) AS cost, substr(split_part(best, chr(1), 1), 10) AS audit, left(best[strpos(best, chr(1)) + 1:], -1) AS repaired
            FROM sums JOIN done ON sums.conv_id IS NOT DISTINCT FROM done.conv_id
        )
        SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
            coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told ON c.conv_id IS NOT DISTINCT FROM told.conv_id
    """,
}
