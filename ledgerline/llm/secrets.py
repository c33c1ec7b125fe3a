"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Base spans come from three patterns. A wider pattern also proposes tokens of mixed character classes. All
candidate values are hashed, and each hash is counted over the corpus by distinct repositories (documents)
and distinct owners (sources): a value that several owners hold is a widely copied example; one that a
single owner holds, in however many documents, looks live. Base spans always stay; proposed tokens become spans of kind
`owned` only if they look live. Counting goes by (hash, owner, repository), (hash, owner), hash, so that a
value in a third of all rows is aggregated before each shuffle, and hot values are broadcast to the
candidates instead of shuffling those.

Offsets: a regular expression's matches and the pieces between them give lengths in code points; running
sums over the few rows that matched give the places.

Defined results: a null text is empty; a text without secrets has zero counts and an empty list; rows with
the same id and text get the same result each, and each of their owners counts; a null owner counts as an owner; spans
that start together are listed by kind; texts are read whole; an empty table gives no rows; `secret_scan` reads doc_id, text and source
alone and `redact` keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, Workspace, as_row, lookup, rows_of

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of at least the asked length are the same matches as runs of any length that are dropped when shorter.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
PROPOSED = r"[A-Za-z0-9+/_-]{20,}"
LEAST_VALUE = 12
#: A value held by so many owners is a widely copied example.
EXAMPLE_OWNERS = 3
_ROW = ["doc_id", "h"]


def _kind(number: int, pattern: str, group: int) -> Column:
    text, p = F.col("text"), F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    return F.when(F.regexp_like(text, p), F.struct(F.lit(number).alias("kind"), pieces.alias("piece"), found.alias("match"), (found if not group else F.regexp_extract_all(text, p, F.lit(group))).alias("value")))


def candidates(docs: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h of every row; doc_id, h, owner, kind, start, end, hash of the value of every candidate of an owner)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("source").cast("string").alias("owner"))
    scanned = rows.select("doc_id", F.xxhash64("text").alias("h"), "owner", F.array_compact(F.array(_kind(0, ASSIGN, 2), _kind(1, ACCESS, 0), _kind(2, HEX, 0), _kind(3, PROPOSED, 0))).alias("kinds"))
    scanned = space.save(scanned, "scanned")
    # rows that repeat one another count once for each owner
    each = scanned.filter(F.size("kinds") > 0).groupBy(*_ROW, "owner").agg(F.first("kinds").alias("kinds")).select(*_ROW, "owner", F.explode("kinds").alias("k"))
    each = each.select(*_ROW, "owner", "k.kind", F.posexplode(F.arrays_zip("k.piece", "k.match", "k.value")).alias("i", "z")).filter("z.match IS NOT NULL")
    before = F.sum(F.col("z.piece") + F.length("z.match")).over(Window.partitionBy(*_ROW, "owner", "kind").orderBy("i"))
    each = each.select(*_ROW, "owner", "kind", before.alias("end"), F.length("z.match").alias("n"), F.col("z.value").alias("value"))
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]")
    good = F.when(F.col("kind") == 0, F.length("value") >= LEAST_VALUE).when(F.col("kind") == 3, mixed).otherwise(True)
    spans = each.filter(good).select(*_ROW, "owner", "kind", (F.col("end") - F.col("n")).alias("start"), "end", F.sha2("value", 256).alias("value_hash"))
    return scanned.select(*_ROW), space.save(spans, "candidates")


def ownership(spans: DataFrame) -> DataFrame:
    """value_hash, n_rows, n_repositories, n_owners over the corpus."""
    by_repository = spans.groupBy("value_hash", "owner", "doc_id").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("value_hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"))
    return by_owner.groupBy("value_hash").agg(F.sum("n").alias("n_rows"), F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"))


def judged(docs: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """(rows, spans that stay, with `live` and `example`); a single owner's value looks live in any number of repositories."""
    rows, spans = candidates(docs, space)
    counts = space.save(ownership(spans), "ownership")
    spans = spans.drop("owner").distinct()
    n = counts.agg(F.count("*"), F.sum("n_rows")).first()
    spans = lookup(spans, counts, "value_hash", int(n[1] or 0), int(n[0]), "n_rows")
    spans = spans.withColumns({"live": F.col("n_owners") == 1, "example": F.col("n_owners") >= EXAMPLE_OWNERS})
    return rows, spans.filter((F.col("kind") < 3) | F.col("live"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])), ",")


def secret_scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per input row: base counts and digest, all spans, and how many values look live or copied."""
    rows, spans = judged(docs, Workspace(spark, "secrets"))
    of = lambda k: F.count_if(F.col("kind") == k)
    found = spans.groupBy(*_ROW).agg(
        of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"),
        F.count_if("live").alias("n_live"), F.count_if("example").alias("n_example"),
    )
    found = found.select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), "n_assign", "n_access", "n_hex", "n_live", "n_example", _listed(F.filter("all", lambda x: x["kind"] < 3)).alias("base"), _listed(F.col("all")).alias("spans"))
    joined = rows.join(found, rows.doc_id.eqNullSafe(found["_doc"]) & (rows.h == found["_h"]), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select("doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_example"))


def redact(spark: SparkSession, docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows with all their columns, every span in text replaced by the mark; n_chars follows where there is such a column.

    A proposed token of a single owner goes in however many documents it is, so copies don't hide it.
    """
    space = Workspace(spark, "redact")
    _, spans = judged(docs, space)
    order = Window.partitionBy(*_ROW).orderBy("start", "end")
    earlier = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.when(earlier.isNull() | (F.col("start") > earlier), 1).otherwise(0)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*_ROW, "run").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    runs = runs.groupBy(*_ROW).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    runs = space.save(runs, "runs")
    n, size = (int(x or 0) for x in runs.agg(F.count("*"), F.sum(F.size("spans"))).first())
    if n + size <= BROADCAST_ROWS:
        runs = F.broadcast(runs)
    text = F.col("_row.text").cast("string")
    end = lambda i: F.get("spans", i - 1)["e"]
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(end(i))
    stop = lambda i: F.when(i == F.size("spans"), F.length(text)).otherwise(F.get("spans", i)["s"])
    piece = lambda i: F.substring(text, (start(i) + 1).cast("int"), (stop(i) - start(i)).cast("int"))
    clean = F.array_join(F.transform(F.sequence(F.lit(0), F.size("spans")), piece), mark)
    keyed = docs.select(as_row(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    joined = keyed.join(runs, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("h")), "left")
    found = F.col("spans").isNotNull()
    new = {"text": F.when(found, clean).otherwise(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(found, F.length(clean)).otherwise(F.col("_row.n_chars"))
    return rows_of(joined, docs, **new)


def _oracle() -> str:
    word = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    assign = word + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    parts = " UNION ALL ".join(
        f"SELECT doc_id, source, {k} AS kind, unnest(regexp_extract_all(t, '{p}', 0)) AS m, unnest(regexp_extract_all(t, '{p}', {g})) AS v, "
        f"unnest(list_transform(regexp_split_to_array(t, '{p}'), lambda x: length(x))) AS piece, unnest(range(length(t) + 1)) AS i FROM d WHERE regexp_matches(t, '{p}')"
        for k, p, g in ((0, assign, 2), (1, ACCESS, 0), (2, HEX, 0), (3, PROPOSED, 0))
    )
    listed = lambda which: f"coalesce(string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e){which}, '')"
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
u AS ({parts}),
w AS (SELECT *, CAST(sum(piece + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e FROM u WHERE m IS NOT NULL),
c AS (SELECT doc_id, source, kind, e - length(m) AS s, e, v FROM w WHERE CASE kind WHEN 0 THEN length(v) >= {LEAST_VALUE}
      WHEN 3 THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') ELSE true END),
f AS (SELECT v, count(DISTINCT source) AS owners FROM c GROUP BY v),
k AS (SELECT c.*, owners = 1 AS live, owners >= {EXAMPLE_OWNERS} AS example FROM c JOIN f USING (v) WHERE kind < 3 OR owners = 1)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256({listed(" FILTER (kind < 3)")}) AS base_sha256, {listed(" FILTER (kind IS NOT NULL)")} AS spans,
       count(*) FILTER (live) AS n_live, count(*) FILTER (example) AS n_example
FROM d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id
"""


ORACLE = _oracle()
