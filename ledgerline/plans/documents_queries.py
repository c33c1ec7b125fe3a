"""Queries over parsed documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import parsing
from ledgerline.plans.registry import _table, query


@query()
def html_blocks(spark, sf_dir):
    return parsing.parse_blocks(_table(spark, sf_dir, "pages"), "page_id", "html")


@query()
def page_chunks(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.concat(F.lit("P"), "page_id").alias("doc_id"), F.lpad(F.col("page_id").cast("string"), 14, "0").alias("rcept_no"), F.lit("page.html").alias("src_file"), F.lit(1).alias("document_sequence"), F.lit(False).alias("attachment"), F.col("html").alias("source"))
    return parsing.number_repeated_paths(parsing.parse_chunks(pages))


@query("SELECT doc_group, count(*) AS n FROM v_document GROUP BY doc_group")
def documents_by_group(spark, sf_dir):
    from ledgerline.sources import adapters

    return adapters.documents(spark, sf_dir).groupBy("doc_group").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS query_id, 'ok' AS status, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS corp_code FROM customer")
def companies_resolved(spark, sf_dir):
    from ledgerline.operators import entities
    from ledgerline.sources import adapters

    asked = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit(" "), F.upper("c_name")).alias("query"))
    rows = entities.resolve_companies(asked, adapters.universe(spark, sf_dir))
    return rows.select("query_id", "status", F.get("corp_codes", 0).alias("corp_code"))


@query("SELECT o_orderkey, 'ok' AS status, CAST(CAST(o_totalprice AS DECIMAL(18,2)) - CAST(o_custkey AS DECIMAL(18,2)) AS VARCHAR) AS result FROM orders")
def calculated_rows(spark, sf_dir):
    from ledgerline.operators.calculate import calculated

    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.col("o_custkey").cast("string")).alias("xs"))
    return rows.select("o_orderkey", calculated(F.lit("subtract"), F.col("xs")).alias("r")).select("o_orderkey", "r.status", "r.result")


@query("""WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    from ledgerline.streaming.windows import sessions

    return sessions(_table(spark, sf_dir, "events"), "30 minutes")


@query()
def topic_sentences(spark, sf_dir):
    from ledgerline.operators import extractors
    from ledgerline.sources import adapters

    chunks = adapters.chunks(spark, sf_dir).withColumn("rcept_no", F.col("doc_id"))
    return extractors.topic_sentences(chunks, {"the": "(?i)\\bthe\\b", "rights": "(?i)rights|license"})


@query()
def packed_evidence(spark, sf_dir):
    from ledgerline.operators import evidence
    from ledgerline.schemas import CITATION_FIELDS
    from ledgerline.sources import adapters

    cite = F.struct(*((F.lit(True) if c == "is_latest" else F.lit("x")).alias(c) for c in CITATION_FIELDS))
    rows = adapters.chunks(spark, sf_dir).select(F.col("doc_id").alias("request_id"), F.col("chunk_id").alias("source_id"), "text", cite.alias("citation"), F.lit(1).alias("priority"), F.col("part").alias("rank"))
    return evidence.pack_requests(rows)
