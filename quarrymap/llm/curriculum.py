"""Mixing sources to target weights that change over training.

Every source has a weight schedule, piecewise linear in training time t from 0 to 1; the weights of all sources sum to
1 at any time. With a budget of T tokens, source s is asked for D_s(t) = T * (integral of its weight from 0 to t)
tokens by time t. Documents of a source stand in a random but fixed order; the one that starts after c tokens of its
source is due at the t where D_s(t) = c, in closed form on a linear piece. T is the smallest budget that uses every
document once: no document is left out, and a source that the weights favour starts over (``copy`` 1, 2, ...).

Running token sums are two-level: each source is cut into buckets by hash (4,096, and more of large corpora), bucket
totals are summed up as a small table, and a window within a bucket does the rest, so no task handles a source as a
whole. How many buckets there are changes no result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = "mix-1"
#: Characters that count as a token; a row has one token at least.
CHARS_PER_TOKEN = 4
#: (time, exponent): a source's weight there is proportional to its share of the tokens to that power.
SCHEDULE = [(0.0, 1.0), (0.5, 0.85), (1.0, 0.7)]
#: A source has a bucket for every so many rows of the corpus, rounded up to a power of 16, and 16 ** LEAST_DIGITS at least.
BUCKET_ROWS, LEAST_DIGITS = 16384, 3


def _order_columns(docs: DataFrame) -> list[Column]:
    digits = max(LEAST_DIGITS, math.ceil(math.log(max(1, docs.count() / BUCKET_ROWS), 16)))
    text = F.coalesce(F.md5("text"), F.lit(""))
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), text)))
    tokens = F.greatest(F.lit(1), F.ceil(F.coalesce(F.length("text"), F.lit(0)) / CHARS_PER_TOKEN)).cast("long")
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), tokens.alias("n_tokens"), digest.alias("digest"), F.substring(digest, 1, digits).alias("bucket")]


def _buckets(slim: DataFrame, weights: DataFrame | None) -> DataFrame:
    """b_source, b_bucket, before, supply and the source's schedule as pieces (t0, t1, w0, w1, d0), with weight in tokens.

    weights: source, t, weight of given schedules (every source of the corpus at every t); None takes SCHEDULE.
    """
    totals = slim.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    by_source = totals.groupBy("source").agg(F.sum("tokens").alias("supply"))
    share = F.col("supply") / F.sum("supply").over(Window.partitionBy())
    if weights is None:
        points = by_source.select("source", "supply", share.alias("p")).select("source", "supply", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.pow("p", F.lit(a)).alias("raw")) for t, a in SCHEDULE])).alias("x")).select("source", "supply", "x.t", "x.raw")
    else:
        given = weights.select(F.col("source").alias("g"), "t", F.col("weight").alias("raw"))
        points = by_source.join(given, by_source.source.eqNullSafe(given.g)).select("source", "supply", "t", "raw")
    points = points.withColumn("w", F.col("raw") / F.sum("raw").over(Window.partitionBy("t")))
    line = Window.partitionBy("source").orderBy("t")
    pieces = points.select("source", "supply", F.col("t").alias("t0"), F.lead("t").over(line).alias("t1"), F.col("w").alias("w0"), F.lead("w").over(line).alias("w1")).filter("t1 IS NOT NULL")
    area = (F.col("t1") - F.col("t0")) * (F.col("w0") + F.col("w1")) / 2
    line = Window.partitionBy("source").orderBy("t0")
    pieces = pieces.withColumn("d1", F.sum(area).over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("d0", F.col("d1") - area)
    sources = pieces.groupBy("source", "supply").agg(F.max("d1").alias("total"), F.sort_array(F.collect_list(F.struct("t0", "t1", "w0", "w1", "d0"))).alias("pieces"))
    sources = sources.withColumn("budget", F.max(F.col("supply") / F.col("total")).over(Window.partitionBy()))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = totals.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("tokens").over(running), F.lit(0)).alias("before"))
    return cut.join(sources, cut.b_source.eqNullSafe(sources.source)).select("b_source", "b_bucket", "before", "supply", "pieces", "budget", (F.col("total") * F.col("budget")).alias("demand"))


def _due(c: Column) -> Column:
    """The time at which a source's demand reaches c tokens."""
    piece = F.element_at(F.filter("pieces", lambda p: (p["d0"] * F.col("budget") <= c) | (p["t0"] == 0)), -1)
    k = F.greatest(F.lit(0.0), c - piece["d0"] * F.col("budget"))
    b = piece["w0"] * F.col("budget")
    a = (piece["w1"] - piece["w0"]) / (2 * (piece["t1"] - piece["t0"])) * F.col("budget")
    return piece["t0"] + 2 * k / (b + F.sqrt(F.greatest(F.lit(0.0), b * b + 4 * a * k)))


def _placed(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows with copy, due and position (due, rounded to be shown): one row for each time that a row is used."""
    order = Window.partitionBy("source", "bucket").orderBy("digest", "n_tokens")
    start = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    at = rows.withColumn("within", start).join(buckets, rows.source.eqNullSafe(buckets.b_source) & (rows.bucket == buckets.b_bucket))
    at = at.withColumn("start", F.col("before") + F.col("within"))
    times = F.greatest(F.lit(1), F.ceil((F.col("demand") - F.col("start")) / F.col("supply") - 1e-9)).cast("int")
    at = at.withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1)))
    at = at.withColumn("due", _due((F.col("start") + F.col("copy") * F.col("supply")).cast("double")))
    return at.withColumn("position", F.round("due", 9))


#: Documents are sorted by the exact time: in a large corpus many have the same rounded one.
_SORTED = ("due", "source", "doc_id", "copy")


def positions(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """doc_id, source, n_tokens, copy, position of every use of every row, sorted by position (0 to 1).

    Rows with a null source form a source of their own. Null and empty texts count as one token. Order within a source
    is by a hash of doc_id, or of the text where doc_id is null; rows that repeat a doc_id follow one another by
    length, each with a position of its own. Rows are sorted by the exact position, of which position shows nine digits;
    equal ones by source, doc_id and copy. An empty table gives an empty one. Other columns, whatever their names, aren't
    read.
    """
    slim = docs.select(*_order_columns(docs))
    return _placed(slim, _buckets(slim, weights)).orderBy(*_SORTED).select("doc_id", "source", "n_tokens", "copy", "position")


def mixed(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``docs`` in training order: each row as often as ``positions`` uses it, range-sorted over the partitions."""
    columns = _order_columns(docs)
    full = docs.select(*columns, F.struct("*").alias("row"))
    return _placed(full, _buckets(docs.select(*columns), weights)).orderBy(*_SORTED).select("row.*")


def oracle() -> str:
    points = " UNION ALL ".join(f"SELECT source, supply, CAST({t} AS DOUBLE) AS t, pow(p, {a}) AS raw FROM shares" for t, a in SCHEDULE)
    return f"""
WITH slim AS (SELECT doc_id, source, greatest(1, CAST(ceil(length(text) / {CHARS_PER_TOKEN}) AS BIGINT)) AS n_tokens, md5('{SEED}' || doc_id) AS digest FROM documents),
shares AS (SELECT source, sum(n_tokens) AS supply, sum(n_tokens) / (SELECT sum(n_tokens) FROM slim)::DOUBLE AS p FROM slim GROUP BY source),
points AS ({points}),
scaled AS (SELECT source, supply, t, raw / sum(raw) OVER (PARTITION BY t) AS w FROM points),
pieces AS (SELECT *, sum((t1 - t0) * (w0 + w1) / 2) OVER (PARTITION BY source ORDER BY t0) - (t1 - t0) * (w0 + w1) / 2 AS d0 FROM (SELECT source, supply, t AS t0, lead(t) OVER (PARTITION BY source ORDER BY t) AS t1, w AS w0, lead(w) OVER (PARTITION BY source ORDER BY t) AS w1 FROM scaled) WHERE t1 IS NOT NULL),
budget AS (SELECT max(supply / total) AS budget FROM (SELECT source, supply, sum((t1 - t0) * (w0 + w1) / 2) AS total FROM pieces GROUP BY source, supply)),
demand AS (SELECT source, supply, sum((t1 - t0) * (w0 + w1) / 2) * max(budget) AS demand FROM pieces, budget GROUP BY source, supply),
ordered AS (SELECT s.*, d.supply, d.demand, sum(s.n_tokens) OVER (PARTITION BY s.source ORDER BY digest, s.n_tokens ROWS UNBOUNDED PRECEDING) - s.n_tokens AS start FROM slim s JOIN demand d USING (source)),
used AS (SELECT *, unnest(range(0, greatest(1, CAST(ceil((demand - start) / supply - 1e-9) AS BIGINT)))) AS copy FROM ordered),
due AS (SELECT *, CAST(start + copy * supply AS DOUBLE) AS c FROM used),
chosen AS (SELECT a.doc_id, a.source, a.n_tokens, a.copy, a.c, p.t0, p.t1, p.w0, p.w1, p.d0, b.budget, row_number() OVER (PARTITION BY a.doc_id, a.source, a.copy ORDER BY p.t0 DESC) AS k FROM due a JOIN pieces p USING (source) CROSS JOIN budget b WHERE p.d0 * b.budget <= a.c OR p.t0 = 0)
SELECT doc_id, source, n_tokens, CAST(copy AS INT) AS copy, round(t0 + 2 * greatest(0, c - d0 * budget) / (w0 * budget + sqrt(greatest(0, w0 * budget * w0 * budget + 4 * (w1 - w0) / (2 * (t1 - t0)) * budget * greatest(0, c - d0 * budget)))), 9) AS position
FROM chosen WHERE k = 1
"""
