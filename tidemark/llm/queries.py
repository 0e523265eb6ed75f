"""One query per operator over the whole of its table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, chat, langid, lexicon, mixing, multiset, packing, repair, simhash, substring, warc, wrapper
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that a mix to target weights takes of it."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a packed sequence."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with its preference pair, rendered and masked."""
    return chat.preferences(table(spark, sf_dir, "conversations"))


def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest document that it reaches."""
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its predicted language."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector among all others."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it comes back from its archive."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of a document that an earlier document holds too."""
    return substring.shared_passages(table(spark, sf_dir, "documents"))


def op10_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and its edited text with their fingerprints, in hexadecimal, and likeness."""
    rows = multiset.edited_documents(table(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def op11_lexicon_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by the transducer lexicon, and what they decode to, as digests."""
    return lexicon.encode_documents(table(spark, sf_dir, "documents"))


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged, with the audit and digest of its cheapest repair."""
    return repair.repaired_damage(table(spark, sf_dir, "conversations"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language, order of the five filters and step, with what is removed and kept."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_best_fit_packing,
        op3_preference_pairs,
        op4_simhash_near_duplicates,
        op5_language_id,
        op6_forest_search,
        op7_main_text,
        op8_warc_round_trip,
        op9_shared_passages,
        op10_multiset_fingerprints,
        op11_lexicon_tokens,
        op12_repair_conversations,
        op13_filter_interactions,
    )
}

ORACLES: dict[str, str] = {
    "op3_preference_pairs": """
        WITH c AS (
            SELECT conv_id, list({'role': coalesce(role, 'user'), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        m AS (
            SELECT conv_id, turns, conv_id - ((conv_id % 2 + 2) % 2) + 1 - ((conv_id % 2 + 2) % 2) AS want,
                   list_max(list_filter(range(1, len(turns) + 1), lambda k: turns[k].role = 'assistant')) AS cut FROM c),
        p AS (
            SELECT a.conv_id, a.turns AS chosen, CASE WHEN a.cut IS NOT NULL AND b.cut IS NOT NULL THEN b.conv_id END AS partner,
                   CASE WHEN a.cut IS NOT NULL AND b.cut IS NOT NULL THEN a.turns[1:a.cut - 1] || [b.turns[b.cut]] END AS rejected
            FROM m a LEFT JOIN m b ON a.want = b.conv_id),
        n AS (
            SELECT *, CASE WHEN rejected IS NULL THEN 0 ELSE coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1),
                   lambda k: chosen[k] IS DISTINCT FROM rejected[k])) - 1, least(len(chosen), len(rejected))) END AS shared FROM p),
        s AS (SELECT *, chosen[shared + 1:] AS c2, rejected[shared + 1:] AS r2 FROM n),
        t AS (
            SELECT *, list_transform(c2, lambda t: '<|im_start|>' || t.role || chr(10)) AS ch, list_transform(c2, lambda t: t.text || '<|im_end|>' || chr(10)) AS cb,
                   list_transform(r2, lambda t: '<|im_start|>' || t.role || chr(10)) AS rh, list_transform(r2, lambda t: t.text || '<|im_end|>' || chr(10)) AS rb FROM s),
        u AS (
            SELECT *, [k for k in range(1, len(c2) + 1) if c2[k].role = 'assistant'] AS ck, [k for k in range(1, len(r2) + 1) if r2[k].role = 'assistant'] AS rk FROM t)
        SELECT conv_id, partner, CAST(shared AS INTEGER) AS shared_turns,
               coalesce(array_to_string(list_transform(chosen[1:shared], lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), ''), '') AS prompt,
               coalesce(array_to_string([ch[k] || cb[k] for k in range(1, len(c2) + 1)], ''), '') AS chosen_text,
               CASE WHEN rejected IS NOT NULL THEN coalesce(array_to_string([rh[k] || rb[k] for k in range(1, len(r2) + 1)], ''), '') END AS rejected_text,
               '[' || array_to_string(['{"start":' || CAST(coalesce(list_sum([length(ch[j]) + length(cb[j]) for j in range(1, k)]), 0) + length(ch[k]) AS BIGINT)
                   || ',"length":' || length(cb[k]) || '}' for k in ck], ',') || ']' AS chosen_loss,
               CASE WHEN rejected IS NOT NULL THEN '[' || array_to_string(['{"start":' || CAST(coalesce(list_sum([length(rh[j]) + length(rb[j]) for j in range(1, k)]), 0) + length(rh[k]) AS BIGINT)
                   || ',"length":' || length(rb[k]) || '}' for k in rk], ',') || ']' END AS rejected_loss,
               CAST(coalesce(list_sum([length(cb[k]) for k in ck]), 0) AS INTEGER) AS chosen_loss_chars,
               CASE WHEN rejected IS NOT NULL THEN CAST(coalesce(list_sum([length(rb[k]) for k in rk]), 0) AS INTEGER) END AS rejected_loss_chars
        FROM u
    """,
    "op8_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY ALL)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "op13_filter_interactions": """
        WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        orders AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        w AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY ALL),
        d AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                   (CASE WHEN len(words) < 100 THEN 'A' ELSE '' END)
                   || (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END)
                   || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END)
                   || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
                   || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
            FROM w LEFT JOIN l USING (doc_id)),
        m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
        s AS (
            SELECT part, filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier, m.*
            FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step), m),
        r AS (
            SELECT part, filter_order, step, any_value(f) AS f,
                   sum(CASE WHEN NOT regexp_matches(fails, '[' || earlier || f || ']') THEN n ELSE 0 END) AS kept,
                   sum(CASE WHEN contains(fails, f) AND (earlier = '' OR NOT regexp_matches(fails, '[' || earlier || '_]')) THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN contains(fails, f) AND earlier <> '' AND regexp_matches(fails, '[' || earlier || '_]') THEN n ELSE 0 END) AS redundant,
                   sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN contains(fails, f) AND (earlier = '' OR NOT regexp_matches(fails, '[' || earlier || '_]')) THEN good ELSE 0 END) AS good_lost,
                   sum(CASE WHEN contains(fails, f) AND (earlier = '' OR NOT regexp_matches(fails, '[' || earlier || '_]')) THEN toxic ELSE 0 END) AS toxic_lost
            FROM s GROUP BY part, filter_order, step)
        SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
               CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
               CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
        FROM r
    """,
}
