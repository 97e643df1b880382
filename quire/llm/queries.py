"""One query for each operator, over its whole table, and the SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, language_id, lm_score, ngram_join, packing, quality, suffix_dedup, topk, url_rules

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    docs = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    model = language_id.fit(docs.filter(~F.col("held_out")))
    return language_id.predict(docs, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return url_rules.judge(pages, pages.join(labels, "page_id").select("url", "bad"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents")).drop("rejected_by")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_table(spark, sf_dir, "documents"), links=True)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select -7L conv_id, t.turn, t.role, '{text}' text from values (0L, 'user'), (1L, 'assistant') t(turn, role)")
    return chat.read_back(chat.windows(turns.union(extra)))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), VOCABULARY)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").filter("quality = 1")
    return lm_score.score(_table(spark, sf_dir, "documents"), good)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), VOCABULARY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_url_rules, op3_top_k, op4_quality, op5_suffix_dedup, op6_ngram_join, op7_chat, op8_packing, op9_lm_score, op10_bpe)}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op3_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id query_id, d.vec_id, CAST(list_sum(list_transform(range(1, 1 + least(len(q.e), len(d.e))), lambda i: q.e[i] * d.e[i])) AS BIGINT) score
            FROM v q, v d WHERE q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 10""",
    "op4_quality": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{_WORD}') w,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) l FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) i FROM d)),
        twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) c FROM win) WHERE c > 1),
        rep AS (SELECT doc_id, count(DISTINCT i + j) n FROM twice, range(0, 8) r(j) GROUP BY doc_id),
        m AS (SELECT d.doc_id, t, CAST(len(w) AS BIGINT) n_words, CAST(length(array_to_string(w, '')) AS BIGINT) word_chars,
                CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) n_symbols, CAST(len(l) AS BIGINT) n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) n_dup_lines,
                CAST(coalesce(rep.n, 0) AS BIGINT) n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT (base_failed OR 3 * n_symbols > n_words OR 10 * n_dup_lines > 4 * n_lines OR word_chars > 25 * n_words OR word_chars < 2 * n_words
                OR 10 * len(regexp_extract_all(t, '\p{{Lu}}')) > 6 * length(t)) kept FROM b""",
    "op6_ngram_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 80 * (u.n + v.n - c)),
        r(a, z) AS (SELECT x, y FROM e UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.z),
        c AS (SELECT a, min(z) z FROM r GROUP BY a),
        k AS (SELECT x, count(*) n FROM e GROUP BY x)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) n_shingles, least(d.doc_id, coalesce(c.z, d.doc_id)) component_id, CAST(coalesce(k.n, 0) AS BIGINT) n_links
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id LEFT JOIN k ON k.x = d.doc_id""",
    "op7_chat": r"""
        WITH t0 AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') t FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        ctl AS (SELECT list(c || x) l FROM (VALUES ('<'), ('[')) a(c), (VALUES ('|'), ('s>'), ('/s>'), ('INST]'), ('/INST]'), ('SYS>'), ('/SYS>'), ('<SYS>'), ('</SYS>')) b(x)),
        t1 AS (SELECT conv_id, turn, r, t, 4 + len(regexp_extract_all(t, '\p{L}{1,6}|\p{N}{1,3}|[^\p{L}\p{N}\s]{1,3}|\n')) size,
            length(t) + length(t) - length(replace(t, '␛', '')) + 2 * list_sum(list_transform(l, lambda x: (length(t) - length(replace(t, x, ''))) // length(x)))
            + length(r) + length(r) - length(replace(r, '␛', '')) + length(r) - length(replace(r, chr(10), '')) + 2 * list_sum(list_transform(l, lambda x: (length(r) - length(replace(r, x, ''))) // length(x))) + 17 chars FROM t0, ctl),
        t2 AS (SELECT *, sum(size) OVER w e, row_number() OVER w a FROM t1 WINDOW w AS (PARTITION BY conv_id ORDER BY turn, r, t ROWS UNBOUNDED PRECEDING)),
        s0 AS (SELECT conv_id, arg_min(chars, a) c, arg_min(size, a) z, min(a) a FROM t2 WHERE r = 'system' GROUP BY ALL),
        sys AS (SELECT * FROM s0 WHERE z <= 240),
        t3 AS (SELECT t2.*, e - size s, 384 - coalesce(z, 0) room FROM t2 LEFT JOIN sys USING (conv_id)),
        t4 AS (SELECT *, 2 * (s // room) + CASE WHEN e > room * (s // room + 1) AND s > room * (s // room) THEN 1 ELSE 0 END k FROM t3),
        win AS (SELECT conv_id, k, min(s) f, min(CASE WHEN r = 'system' THEN a END) own, least(96, greatest(0, any_value(room) + 96 - sum(size))) back FROM t4 GROUP BY ALL),
        past AS (SELECT t4.conv_id, sum(chars) c FROM win JOIN t4 ON t4.conv_id = win.conv_id AND t4.e <= f AND t4.s >= f - back AND r <> 'system' GROUP BY ALL),
        lead AS (SELECT conv_id, sum(c) c FROM win JOIN sys USING (conv_id) WHERE win.k > 0 AND own IS DISTINCT FROM a GROUP BY ALL)
        SELECT conv_id, CAST(count(*) AS BIGINT) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY a)) turns_sha256,
            CAST(coalesce(sum(CASE WHEN r = 'assistant' THEN length(t) END), 0) AS BIGINT) loss_chars,
            sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN t END, '' ORDER BY a), '')) loss_sha256,
            CAST(sum(chars) + coalesce(any_value(past.c), 0) + coalesce(any_value(lead.c), 0) AS BIGINT) formatted_chars
        FROM t4 LEFT JOIN past USING (conv_id) LEFT JOIN lead USING (conv_id) GROUP BY conv_id""",
}
