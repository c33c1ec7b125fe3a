"""Importance resampling towards a target: hashed n-gram gains, additive document weights, Gumbel top-k.

Words of every text become rows (document, position, word) by posexplode; for orders above one, lead() per document puts
the following words beside each word, so a row gives one n-gram of each order. An n-gram's bucket is its crc32.
Bucket counts of the raw documents and of the target texts give each bucket a gain, a table of `buckets` rows
that is broadcast and joined to the rows; their sum by document is its weight. A draw without replacement takes the highest
weights plus Gumbel noise from a hash of the id.

At scale: counting sends at most `buckets` rows a task, summing one row a document. Windows are only needed above order
one; a long text is parted into BLOCK positions each, with the next block's first words beside them, so no window holds more.
Ranks come from a range partitioning and the sizes of its parts; no task sees all rows.

Defined results: a null or empty text has no features, weight 0 and is never drawn; repeated rows are scored one by one, and
equal rows take neighbouring ranks; a null doc_id draws its noise from the seed alone and comes after all others among equal scores;
a text of any length is read whole; with an empty target all gains come from the documents alone; an empty table gives no
rows; only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace

#: What parts words: all of ASCII but digits and small letters (A-Z are lower-cased before).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Positions of a text in one window.
BLOCK = 4096


def drawing_order() -> list[Column]:
    return [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("n_features")]


def word_rows(texts: DataFrame, *keep: str) -> DataFrame:
    """keep, pos, word: a row for each word; texts without words have a row with a null word."""
    lowered = F.translate(F.col("text").cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    rows = texts.select(*keep, F.posexplode_outer(F.split(lowered, SEPARATORS)).alias("pos", "word"))
    return rows.withColumns({"pos": F.coalesce("pos", F.lit(0)), "word": F.nullif(F.col("word"), F.lit(""))})


def gram_rows(texts: DataFrame, key: str, orders: int, *keep: str) -> DataFrame:
    """key, keep, order, gram: a row for each run of 1 to `orders` words of a text, and every text has at least one row, with a null gram if need be.

    key: tells the rows of `texts` apart.
    """
    words = word_rows(texts, key, *keep)
    if orders == 1:
        return words.select(key, *keep, F.lit(1).alias("order"), F.col("word").alias("gram"))
    own = F.floor(F.col("pos") / BLOCK)
    blocks = F.when((F.col("pos") >= BLOCK) & (F.col("pos") % BLOCK < orders - 1), F.array(own, own - 1)).otherwise(F.array(own))
    beside = Window.partitionBy(key, "block").orderBy("pos")
    placed = words.select(key, *keep, "pos", "word", F.explode(blocks).alias("block"))
    for k in range(1, orders):
        placed = placed.withColumn(f"next{k}", F.lead("word", k).over(beside))
    run: list[Column] = [F.col("word"), *[F.col(f"next{k}") for k in range(1, orders)]]
    grams = [F.struct(F.lit(n).alias("order"), F.when(run[n - 1].isNotNull() & run[0].isNotNull(), F.concat_ws(" ", *run[:n])).alias("gram")) for n in range(1, orders + 1)]
    rows = placed.filter(own == F.col("block")).select(key, *keep, F.explode(F.array(*grams)).alias("g"))
    return rows.select(key, *keep, "g.order", "g.gram").filter((F.col("order") == 1) | F.col("gram").isNotNull())


def bucket(gram: Column, buckets: int) -> Column:
    return F.crc32(gram.cast("binary")) % buckets


def bucket_counts(texts: DataFrame, buckets: int, orders: int, name: str) -> DataFrame:
    """bucket and its number of features in all texts: at most `buckets` rows."""
    numbered = texts.select(F.monotonically_increasing_id().alias("_n"), "text")
    grams = gram_rows(numbered, "_n", orders).filter("gram IS NOT NULL")
    return grams.groupBy(bucket(F.col("gram"), buckets).alias("bucket")).agg(F.count("*").alias(name))


def bucket_gains(spark: SparkSession, docs: DataFrame, target: DataFrame, buckets: int, orders: int) -> DataFrame:
    """bucket, gain: a row for each of the `buckets`."""
    counted = (
        spark.range(buckets).withColumnRenamed("id", "bucket")
        .join(bucket_counts(docs, buckets, orders, "s"), "bucket", "left")
        .join(bucket_counts(target, buckets, orders, "t"), "bucket", "left")
        .na.fill(0, ["s", "t"])
    )
    whole = Window.partitionBy(F.lit(0))  # over `buckets` rows, whatever the tables
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * (F.sum(s).over(whole) + buckets) / ((s + 1) * (F.sum(t).over(whole) + buckets))
    return counted.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weighed(docs: DataFrame, gains: DataFrame, buckets: int, orders: int, seed: int) -> DataFrame:
    """A row for each of docs: doc_id, n_features, n_words, weight, score."""
    numbered = docs.select(F.monotonically_increasing_id().alias("_n"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    grams = gram_rows(numbered, "_n", orders, "doc_id").withColumn("bucket", bucket(F.col("gram"), buckets))
    sums = grams.join(F.broadcast(gains), "bucket", "left").groupBy("_n", "doc_id").agg(
        F.count("gram").alias("n_features"), F.count(F.when(F.col("order") == 1, F.col("gram"))).alias("n_words"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight")
    )
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    return sums.select("doc_id", "n_features", "n_words", "weight", (F.col("weight") + noise).alias("score"))


def ranked(space: Workspace, rows: DataFrame, most: int) -> DataFrame:
    """rows with their place in drawing_order() as `rank`, null beyond `most`."""
    parts = int(space.spark.conf.get("spark.sql.shuffle.partitions"))
    # the number parts rows that are equal in all else, so that no part holds all copies of one
    dealt = rows.withColumn("_i", F.monotonically_increasing_id()).repartitionByRange(parts, *drawing_order(), F.col("_i")).withColumn("_part", F.spark_partition_id())
    dealt = space.save(dealt, "ranked")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))  # one row a part
    before = sizes.select("_part", (F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_size")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*drawing_order(), "_i")) + F.col("_before")
    found = dealt.join(F.broadcast(before), "_part").withColumn("rank", place)
    return found.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).drop("_part", "_before", "_i")


def resample(
    spark: SparkSession, docs: DataFrame, target: DataFrame, buckets: int = 10_000, orders: int = 1, seed: int = 2024, least_words: int = 20, percent: int = 10
) -> DataFrame:
    """doc_id, n_features, weight, score and the rank of those drawn, for every row of docs."""
    space = Workspace(spark, "resampling")
    scored = space.save(weighed(docs, bucket_gains(spark, docs, target, buckets, orders), buckets, orders, seed), "scored")
    enough = F.col("n_words") >= least_words
    drawn = percent * scored.filter(enough).count() // 100
    rest = scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked(space, scored.filter(enough), drawn).unionByName(rest).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


ORACLE = r"""
WITH RECURSIVE bits(i, k, c) AS (
    SELECT range, 0, range FROM range(256)
    UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc_table AS (SELECT i, c AS x FROM bits WHERE k = 8),
raw AS (SELECT row_number() OVER () AS n, doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents),
aim AS (SELECT unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
spelt AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM raw UNION SELECT word FROM aim)),
crc(word, h, done, c) AS (
    SELECT word, h, 0::BIGINT, 4294967295::BIGINT FROM spelt
    UNION ALL SELECT word, h, done + 1, xor(c // 256, x) FROM crc JOIN crc_table ON i = xor(c % 256, ('0x' || substr(h, 2 * done + 1, 2))::BIGINT)
    WHERE 2 * done < length(h)),
buckets AS (SELECT word, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE 2 * done = length(h)),
s AS (SELECT bucket, count(*) AS s FROM raw JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aim JOIN buckets USING (word) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT count(*) FROM raw)::DOUBLE + 10000)
    / ((s::DOUBLE + 1) * ((SELECT count(*) FROM aim)::DOUBLE + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT n, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM raw JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY n),
numbered AS (SELECT row_number() OVER () AS n, doc_id FROM documents),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
    FROM numbered LEFT JOIN weights USING (n)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
    10 * count(*) FILTER (WHERE n_features >= 20) OVER () // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM placed
"""
