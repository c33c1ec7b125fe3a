"""Filing-shaped views over the generic tables, so that every operator runs on data that is at hand.

The same views as SQL (DUCKDB) are the base of the queries' oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART = 1000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(c: str) -> Column:
    return F.lpad(F.col(c).cast("string"), 8, "0")


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation").join(F.broadcast(_read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = _read(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(_code("c_custkey").alias("corp_code"), F.col("c_name").alias("corp_name"), F.col("c_mktsegment").alias("industry"), F.col("n_name").alias("sector"), F.col("r_name").alias("market"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyyMMdd")
    group = F.when(F.col("o_orderpriority") == "1-URGENT", "exchange").when(F.col("o_orderpriority") == "2-HIGH", "major").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "holding").otherwise("periodic")
    month = F.quarter("o_orderdate") * 3
    kind = F.when(F.col("doc_group") != "periodic", F.concat("doc_group", F.lit("_"), F.lower("o_orderstatus"))).when(F.col("base_month") == 12, "annual").when(F.col("base_month") == 6, "half").otherwise("quarter")
    rows = _read(spark, sf_dir, "orders").select(
        F.concat(F.lit("D"), "o_orderkey").alias("doc_id"), F.concat(day, F.lpad(F.col("o_orderkey").cast("string"), 6, "0")).alias("rcept_no"), _code("o_custkey").alias("corp_code"), day.alias("rcept_dt"),
        group.alias("doc_group"), (F.col("o_orderkey") % 4 == 0).alias("is_correction"), F.year("o_orderdate").alias("base_year"), month.cast("int").alias("base_month"),
        F.concat(F.lit("F"), F.col("o_custkey") % 7).alias("flr_nm"), "o_orderkey", "o_orderstatus", "o_custkey",
    ).withColumn("doc_subtype", kind)
    name = F.concat(F.when(F.col("is_correction"), "[correction]").otherwise(""), "doc_subtype", F.lit(" report ("), F.col("base_year"), F.lit("."), F.lpad(F.col("base_month").cast("string"), 2, "0"), F.lit(")"))
    return rows.withColumn("report_nm", name).drop("o_orderstatus")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per filing, from all its lines: totals, the first date, the least type."""
    kind = F.concat("l_returnflag", "l_linestatus")
    line = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min(kind).alias("event_type"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"), F.min("l_shipdate").alias("day"),
        F.min(F.concat(kind, F.lit("-"), F.col("l_partkey") % 5)).alias("title"), F.sum(F.col("l_quantity").cast("int")).cast("int").alias("quantity"),
    )
    docs = documents(spark, sf_dir)
    before = F.lag("rcept_dt").over(Window.partitionBy("o_custkey").orderBy("rcept_dt", "o_orderkey"))
    docs = docs.withColumn("corr_target_date", F.when(F.col("is_correction"), before))
    return line.join(docs, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "doc_id", "rcept_no", "rcept_dt", "corp_code", "doc_group", "doc_subtype", "report_nm", "is_correction", "event_type", F.col("amount").cast("string").alias("amount"), F.lit("원").alias("amount_type"),
        F.date_format("day", "yyyy-MM-dd").alias("event_date"), F.date_format("day", "yyyy-MM-01").alias("period_start"), "title", "corr_target_date", "quantity",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.ceil(F.length("text") / PART).cast("int")
    rows = _read(spark, sf_dir, "documents").filter(F.length("text") > 0)
    rows = rows.select("doc_id", "lang", "source", "text", F.explode(F.sequence(F.lit(1), n)).alias("part"))
    own = F.substring(F.col("text"), (F.col("part") - 1) * PART + 1, F.lit(PART))
    return rows.select(
        F.concat(F.col("doc_id"), F.lit("#"), F.lpad(F.col("part").cast("string"), 5, "0")).alias("chunk_id"), F.concat(F.lit("D"), F.col("doc_id")).alias("doc_id"), F.concat("lang", F.lit(" > "), "source").alias("path"),
        "part", F.col("part").alias("document_sequence"), (F.col("part") - 1).alias("block_start"), F.col("part").alias("block_end"), F.length(own).alias("n_chars"), F.lit(0).alias("n_tables"), own.alias("text"),
    )


#: The views in DuckDB, each used by name after WITH.
DUCKDB = {
    "v_universe": """SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS corp_code, c_name AS corp_name, c_mktsegment AS industry, n_name AS sector, r_name AS market
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_base": """SELECT 'D' || o_orderkey AS doc_id, strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS rcept_no, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS corp_code,
strftime(o_orderdate, '%Y%m%d') AS rcept_dt, CASE o_orderpriority WHEN '1-URGENT' THEN 'exchange' WHEN '2-HIGH' THEN 'major' WHEN '4-NOT SPECIFIED' THEN 'holding' ELSE 'periodic' END AS doc_group,
o_orderkey % 4 = 0 AS is_correction, CAST(year(o_orderdate) AS INTEGER) AS base_year, CAST(quarter(o_orderdate) * 3 AS INTEGER) AS base_month, 'F' || (o_custkey % 7) AS flr_nm, o_orderkey, o_orderstatus, o_custkey FROM orders""",
    "v_document": """SELECT * EXCLUDE (o_orderstatus), (CASE WHEN is_correction THEN '[correction]' ELSE '' END) || doc_subtype || ' report (' || base_year || '.' || lpad(CAST(base_month AS VARCHAR), 2, '0') || ')' AS report_nm
FROM (SELECT *, CASE WHEN doc_group <> 'periodic' THEN doc_group || '_' || lower(o_orderstatus) WHEN base_month = 12 THEN 'annual' WHEN base_month = 6 THEN 'half' ELSE 'quarter' END AS doc_subtype FROM v_base)""",
    "v_event": """SELECT doc_id, rcept_no, rcept_dt, corp_code, doc_group, doc_subtype, report_nm, is_correction, event_type, CAST(amount AS VARCHAR) AS amount,
'원' AS amount_type, strftime(day, '%Y-%m-%d') AS event_date, strftime(day, '%Y-%m-01') AS period_start, title, corr_target_date, quantity
FROM (SELECT l_orderkey, min(l_returnflag || l_linestatus) AS event_type, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount, min(l_shipdate) AS day,
min(l_returnflag || l_linestatus || '-' || (l_partkey % 5)) AS title, CAST(sum(CAST(l_quantity AS INTEGER)) AS INTEGER) AS quantity FROM lineitem GROUP BY l_orderkey) l
JOIN (SELECT *, CASE WHEN is_correction THEN lag(rcept_dt) OVER (PARTITION BY o_custkey ORDER BY rcept_dt, o_orderkey) END AS corr_target_date FROM v_document) d ON l_orderkey = o_orderkey""",
    "v_chunk": f"""SELECT doc_id || '#' || lpad(CAST(part AS VARCHAR), 5, '0') AS chunk_id, 'D' || doc_id AS doc_id, lang || ' > ' || source AS path, CAST(part AS INTEGER) AS part, CAST(part AS INTEGER) AS document_sequence, CAST(part - 1 AS INTEGER) AS block_start,
CAST(part AS INTEGER) AS block_end, CAST(length(substr(text, CAST((part - 1) * {PART} + 1 AS BIGINT), {PART})) AS INTEGER) AS n_chars, 0 AS n_tables, substr(text, CAST((part - 1) * {PART} + 1 AS BIGINT), {PART}) AS text
FROM (SELECT *, unnest(range(1, CAST(ceil(length(text) / {PART}.0) AS BIGINT) + 1)) AS part FROM documents WHERE length(text) > 0)""",
}


def with_views(sql: str, recursive: bool = False) -> str:
    """The SQL after the views that it names, directly or through one another."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in DUCKDB.items():
            if name in text and name not in needed:
                need(body)
                needed.append(name)

    need(sql)
    body = sql.strip()
    views = ", ".join(f"{n} AS ({DUCKDB[n]})" for n in needed)
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {views}, {body[len('WITH'):]}"
    return f"WITH {views} {body}"
