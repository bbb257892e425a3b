"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.keys import norm_key, standing
from brindle.llm import abuse, alignment, mixing, splitting, tokens
from brindle.llm import conversations as chats
from brindle.session import spread
from brindle.tables import load


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Chats to leave out."""
    return chats.refused_chats(load(spark, base, "message_v2")).select("chat_id")


def p2_reasons(spark: SparkSession, base: str) -> DataFrame:
    """Chats to leave out by reason."""
    return chats.refused_chats(load(spark, base, "message_v2")).groupBy("reason").agg(F.count(F.lit(1)).alias("chats"))


def p2_conversations(spark: SparkSession, base: str) -> DataFrame:
    """The kept conversations, one row a turn."""
    return chats.conversations(load(spark, base, "message_v2"))


def p4_pieces(spark: SparkSession, base: str) -> DataFrame:
    """Numbered pieces of every item."""
    parts = []
    for table, id_col, text in (("chunk_input", "item_id", "content"), ("hansards_statement", "id", "content_fr")):
        items = standing(load(spark, base, table).select(id_col, text), [id_col], None)
        parts.append(splitting.split_items(items, id_col, text)
            .select(F.lit(table).alias("table_name"), F.col("item_id").cast("int").alias("item_id"), "chunk_index", "n_pieces", "start", "end",
            "item_chars", "text"))
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Items that had to be split."""
    return p4_pieces(spark, base).filter("chunk_index = 0 and n_pieces > 1").select("table_name", "item_id")


def p6_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Sentences that translate one another, on the path or moved: statements by sentence, acts by title and long title."""
    said = load(spark, base, "hansards_statement").select("id", "content_en", "content_fr")
    ratio = alignment.length_ratio(said, "content_en", "content_fr")  # repeats count too, so that they need not be settled twice
    said = standing(said, ["id"], None).withColumn("id", F.col("id").cast("string"))
    said = alignment.align_documents(spread(said), ["id"], "content_en", "content_fr", ratio, "moved")
    acts = load(spark, base, "acts").select(norm_key(F.col("act_id")).alias("key"), "language", "updated_at", "id", "title",
        "long_title").filter("key is not null and language in ('en', 'fr')")
    chars = lambda code: F.sum(F.when(F.col("language") == code, F.length(F.concat_ws(" ", "title", "long_title"))))
    en, fr = acts.agg(chars("en"), chars("fr")).first()
    acts = standing(acts, ["key", "language"], "updated_at", "id")
    side = lambda code: F.max(F.when(F.col("language") == code, F.struct(F.array("title", "long_title").alias("a")))).getField("a").alias(
        code)
    titles = alignment.align_documents(acts.groupBy("key").agg(side("en"), side("fr")), ["key"], "en", "fr", fr / en if en and fr else 1.0, "moved")
    row = lambda df, table, key: df.select(F.lit(table).alias("table_name"), F.col(key).alias("record_key"), "en_pos", "fr_pos", "moved")
    return row(said, "hansards_statement", "id").unionByName(row(titles, "acts", "key"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Sentences that translate one another."""
    return p6_pairs(spark, base).drop("moved")


def p6_steps(spark: SparkSession, base: str) -> DataFrame:
    """How many pairs lie on the path and how many were found out of order, by table."""
    return p6_pairs(spark, base).groupBy("table_name", "moved").agg(F.count(F.lit(1)).alias("pairs"))


def p7_ids(spark: SparkSession, base: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_texts(load(spark, base, "documents").select("doc_id", "text"), "text")


def p8_mixture(spark: SparkSession, base: str) -> DataFrame:
    """Rate and copies of every document in the mixture of sources."""
    sized = tokens.count_tokens(load(spark, base, "documents").select("doc_id", "source", "text"), "text")
    return mixing.mix_sources(sized, load(spark, base, "source_targets"))


def p8_shares(spark: SparkSession, base: str) -> DataFrame:
    """The shares that the mixture reaches."""
    return mixing.share_report(p8_mixture(spark, base), load(spark, base, "source_targets"))


def p9_scores(spark: SparkSession, base: str) -> DataFrame:
    """Score of every document, by a classifier fitted on the labelled ones."""
    documents = load(spark, base, "documents")
    return abuse.score_documents(documents, abuse.train(load(spark, base, "abuse_labels"), documents))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents with an abusive, hateful or sexual passage."""
    return p9_scores(spark, base).filter("abusive").select("doc_id")


def p9_rates(spark: SparkSession, base: str) -> DataFrame:
    """Documents, abusive documents and their rate by source."""
    by = p9_scores(spark, base).groupBy(mixing.source_name(F.col("source")).alias("source")).agg(F.count(F.lit(1)).alias("documents"),
        F.count_if("abusive").alias("abusive"))
    return by.withColumn("rate", F.col("abusive") / F.col("documents"))


QUERIES = {
    "p2_found": p2_found, "p2_reasons": p2_reasons, "p2_conversations": p2_conversations,
    "p4_found": p4_found, "p4_pieces": p4_pieces,
    "p6_found": p6_found, "p6_steps": p6_steps,
    "p7_ids": p7_ids,
    "p8_mixture": p8_mixture, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates,
}
_WS = r"\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_LONG = "length(regexp_replace(regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[" + _WS.replace(
    "{", "{{").replace("}", "}}") + "]+|[" + _WS.replace("{", "{{").replace("}", "}}") + "]+$', '', 'g')) > 6144"
_HAS_TEXT = (
    f"len(list_filter(json_extract(j, '$[*]'), lambda x: json_extract_string(x, '$.type') = 'text' AND json_type(x, '$.text') = "
    f"'VARCHAR' AND regexp_matches(json_extract_string(x, '$.text'), '[^{_WS}]'))) > 0"
)
_PARTS_TEXT = (
    f"array_to_string(list_filter(list_transform(list_filter(json_extract(j, '$[*]'), lambda x: json_extract_string(x, '$.type') = "
    f"'text' AND json_type(x, '$.text') = 'VARCHAR'), lambda x: json_extract_string(x, '$.text')), lambda x: regexp_matches(x, "
    f"'[^{_WS}]')), chr(10))"
)
_CHATS = (
    f"m AS (SELECT DISTINCT id, chat_id, lower(regexp_replace(role, '^[{_WS}]+|[{_WS}]+$', '', 'g')) AS role, TRY_CAST(parts AS JSON) AS "
        f"j, created_at FROM message_v2 WHERE chat_id IS NOT NULL), "
    f"f AS (SELECT *, coalesce(json_type(j) = 'ARRAY', false) AS arr, coalesce({_HAS_TEXT}, false) AS has_text FROM m), "
    "t AS (SELECT chat_id, role, has_text, count(*) FILTER (role = 'user') OVER (PARTITION BY chat_id ORDER BY created_at, role <> "
        "'user', id ROWS UNBOUNDED PRECEDING) AS g FROM f WHERE role IN ('user', 'assistant')), "
    "grp AS (SELECT chat_id, g, bool_or(role = 'assistant' AND has_text) AS answered, bool_or(role = 'user' AND NOT has_text) AS mute FROM t GROUP BY ALL), "
    "bad AS (SELECT chat_id, bool_or(g = 0 OR NOT answered) AS open, bool_or(mute) AS mute FROM grp GROUP BY chat_id), "
    "why AS (SELECT f.chat_id, CASE WHEN bool_or(created_at IS NULL OR role IS NULL OR role NOT IN ('user', 'assistant', 'system') OR "
        "NOT arr) THEN 'broken' WHEN count(*) FILTER (role <> 'system') = 0 THEN 'empty' WHEN any_value(bad.mute) THEN 'empty_turn' WHEN "
        "any_value(bad.open) THEN 'missing_reply_or_opening' END AS reason FROM f LEFT JOIN bad USING (chat_id) GROUP BY f.chat_id)"
)
ORACLE = {
    "p2_reasons": f"WITH {_CHATS} SELECT reason, count(*) AS chats FROM why WHERE reason IS NOT NULL GROUP BY reason",
    "p2_conversations": (
        f"WITH {_CHATS} SELECT chat_id, row_number() OVER (PARTITION BY chat_id ORDER BY created_at, role <> 'user', id) - 1 AS turn, role, "
        f"{_PARTS_TEXT} AS text, created_at FROM f WHERE chat_id IN (SELECT chat_id FROM why WHERE reason IS NULL)"
    ),
    "p2_found": (
        f"WITH m AS (SELECT DISTINCT id, chat_id, lower(regexp_replace(role, '^[{_WS}]+|[{_WS}]+$', '', 'g')) AS role, TRY_CAST(parts AS "
        f"JSON) AS j, created_at FROM message_v2 WHERE chat_id IS NOT NULL), f AS (SELECT *, coalesce(json_type(j) = 'ARRAY', false) AS arr, "
        f"coalesce({_HAS_TEXT}, false) AS has_text FROM m), t AS (SELECT chat_id, role, has_text, count(*) FILTER (role = 'user') OVER "
        f"(PARTITION BY chat_id ORDER BY created_at, role <> 'user', id ROWS UNBOUNDED PRECEDING) AS g FROM f WHERE role IN ('user', "
        f"'assistant')), grp AS (SELECT chat_id, g, bool_or(role = 'assistant' AND has_text) AS answered, bool_or(role = 'user' AND NOT "
        f"has_text) AS mute FROM t GROUP BY ALL) SELECT chat_id FROM f GROUP BY chat_id HAVING bool_or(created_at IS NULL OR role IS NULL OR "
        f"role NOT IN ('user', 'assistant', 'system') OR NOT arr) OR count(*) FILTER (role <> 'system') = 0 UNION SELECT chat_id FROM grp "
        f"WHERE g = 0 OR mute OR NOT answered"
    ),
    "p4_found": (
        f"SELECT DISTINCT 'chunk_input' AS table_name, item_id FROM chunk_input WHERE {_LONG.format(x='content')} UNION ALL SELECT DISTINCT "
        f"'hansards_statement', id FROM hansards_statement WHERE {_LONG.format(x='content_fr')}"
    ),
}
