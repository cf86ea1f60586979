"""Mixing sources to target weights by a low-discrepancy source schedule.

Sources in code point order (null last) weigh WEIGHTS, repeating. Together they
share SHARE of all words; no target exceeds REPEAT times its source's words, and
what lies above is reshared by weight. In closed form: the least level L with
sum(min(REPEAT * size, L * weight)) = SHARE * total.

Every source's documents are shuffled (by a hash of the id) into a stream that
runs round at most REPEAT times and is cut into blocks of equal length. The
schedule gives each source as many slots as its target has blocks: the van der
Corput points of 0 .. 2^m - 1 fall into the cells of the cumulated weights (one
cell per block, 2^m >= cells, so that each cell gets a point), the points of a
source are ranked in schedule order, and rank r plays the source's block r. The
last block ends at the target, so every source gives its target's whole words.

All running sums are in two levels (a hash bucket, then rows within it; buckets
grow in number with the table), so a source that holds most rows never sits in
one task. The cells of a source are made in two steps, STEP at a time, so that
no row holds a source's schedule. Only DataFrame functions are used.

Cases: a null text has no words; a null source is a source of its own; null and
repeated doc_ids are ordinary rows; documents without words are never taken;
no words at all give targets of 0; an empty table gives an empty result; other
columns are ignored.

The schedule is part of the result: each document's first slot (-1 if the mix
does not take it) and the number of slots that play a part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, drop, small, store, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEAT = 2
#: Words in a block, more where there would be over 2^30 blocks.
BLOCK = 1024
#: Cells that one row becomes.
STEP = 4096
#: Rows in a bucket of a stream, about.
BUCKET = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _positions(df: DataFrame, group: str, bucket: str, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the sum of value over the group's rows that come before, in order of bucket, then order."""
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col(group).alias("_g"), F.col(bucket).alias("_b"), F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before"))
    w = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn("_inside", F.coalesce(F.sum(value).over(w), F.lit(0)))
    out = inside.join(before, (F.col(group) == F.col("_g")) & (F.col(bucket) == F.col("_b")))
    return out.withColumn(name, F.col("_before") + F.col("_inside")).drop("_g", "_b", "_before", "_inside")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, size) -> source, sid, source_size, target. One row per
    source; the windows see sources only, never documents."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    per = per.withColumn("sid", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("sid") % len(WEIGHTS) + 1).cast("double")
    per = per.withColumn("w", weight).withColumn("cap", F.lit(float(REPEAT)) * F.col("source_size"))
    by = every.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(SHARE) * F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("cap").over(by), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(by), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("open", F.col("cap") / F.col("w") > F.col("level"))
    whole = every.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("final", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(whole))
    target = F.least("cap", F.coalesce(F.col("final") * F.col("w"), F.col("cap")))
    return per.select("source", "sid", "source_size", target.alias("target"))


def _slots(sources: DataFrame, block: int, cells: int) -> DataFrame:
    """sources(sid, quota, first) -> slot, sid, rank; a slot is a place in the whole schedule."""
    bits = max(cells - 1, 0).bit_length()
    spark = sources.sparkSession
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")
    points = spark.range(1 << bits).withColumnRenamed("id", "slot").withColumn("cell", F.shiftright(point * cells, bits))
    steps = sources.filter("quota > 0").select("sid", "quota", "first", F.explode(F.sequence(F.lit(0), F.floor((F.col("quota") - 1) / STEP))).alias("step"))
    begin = F.col("first") + F.col("step") * STEP
    end = F.least(F.col("first") + F.col("quota"), begin + STEP) - 1
    owners = steps.repartition("sid", "step").select("sid", "quota", F.explode(F.sequence(begin, end)).alias("cell"))
    slots = points.join(owners.hint("merge"), "cell").withColumn("part", F.shiftright("slot", 12)).withColumn("one", F.lit(1).cast("long"))
    return _positions(slots, "sid", "part", [F.col("slot")], "one", "rank").filter("rank < quota").select("slot", "sid", "rank")


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, pieces). rows: one per row of docs with doc_id, size, source_size,
    target, sid, start (its place in the source's stream). pieces: the mix in
    order of slot: sid, start, doc_id, size, round (0 or 1), from and to (words
    of the document)."""
    raw = store(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")), "sizes")
    plan = targets(raw).withColumn("goal", F.floor("target").cast("long"))
    plan = store(plan, "targets")
    words = plan.agg(F.sum("goal")).first()[0] or 0
    block = max(BLOCK, -(-words >> 30))
    digits = 3
    while raw.count() > BUCKET * 16**digits:
        digits += 1
    quota = F.ceil(F.col("goal") / block).cast("long")
    w = Window.partitionBy(F.lit(0)).orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("quota", quota).withColumn("first", F.coalesce(F.sum("quota").over(w), F.lit(0)))
    cells = plan.agg(F.sum("quota")).first()[0] or 0

    own = plan.select(F.col("source").alias("_source"), "sid", "source_size", "target", "goal")
    rows = raw.join(small(own, BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    # Rows without an id are told apart by their size.
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.col("size").cast("string"))))
    rows = rows.withColumn("_key", digest).withColumn("_bucket", F.substring("_key", 1, digits))
    rows = _positions(rows, "sid", "_bucket", [F.col("_key"), F.col("doc_id"), F.col("size")], "size", "start").drop("_key", "_bucket")
    rows = store(rows, "streams")
    drop(raw)

    turns = F.explode(F.sequence(F.lit(0), F.lit(REPEAT - 1)))
    spans = rows.filter("size > 0").select("sid", "start", "doc_id", "size", "goal", "source_size", turns.alias("round"))
    spans = spans.withColumn("a", F.col("start") + F.col("round") * F.col("source_size")).withColumn("e", F.least(F.col("a") + F.col("size"), "goal")).filter("a < e")
    blocks = spans.withColumn("rank", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("e") - 1) / block))))
    played = blocks.join(_slots(plan, block, cells).hint("merge"), ["sid", "rank"])
    begin = F.greatest(F.col("a"), F.col("rank") * block)
    end = F.least(F.col("e"), (F.col("rank") + 1) * block)
    pieces = played.select("slot", "sid", "start", "doc_id", "size", "round", (begin - F.col("a")).alias("from"), (end - F.col("a")).alias("to"))
    return rows, pieces


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot, n_slots for each row of docs."""
    rows, pieces = schedule(docs, id_col, text_col, source_col)
    sums = pieces.groupBy("sid", "start").agg(F.sum(F.col("to") - F.col("from")).alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
    fill = {"taken": 0, "first_slot": -1, "n_slots": 0}
    full = rows.filter("size > 0").join(sums.hint("merge"), ["sid", "start"], "left").withColumns({c: F.coalesce(c, F.lit(v)).cast("long") for c, v in fill.items()})
    none = rows.filter("size = 0").withColumns({c: F.lit(v).cast("long") for c, v in fill.items()})
    cols = ("doc_id", "size", "source_size", "target", *fill)
    return full.select(*cols).union(none.select(*cols))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of docs, whole, in the order of the schedule: a row comes once for
    each round of its source's stream in which the mix takes at least half of
    its words, at that round's first slot. Rows that share a doc_id share its
    rounds evenly, rounded up, and its first and last slot."""
    rows, pieces = schedule(docs, id_col, text_col, source_col)
    used = pieces.groupBy("sid", "start", "doc_id", "size", "round").agg(F.sum(F.col("to") - F.col("from")).alias("taken"), F.min("slot").alias("slot")).filter("2 * taken >= size")
    copies = used.groupBy("doc_id").agg(F.count("*").alias("_rounds"), F.min("slot").alias("_early"), F.max("slot").alias("_late"))
    shared = rows.filter("size > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_rows"))
    copies = copies.join(shared, F.col("doc_id").eqNullSafe(F.col("_id")))
    copies = store(copies.select("_id", F.ceil(F.col("_rounds") / F.col("_rows")).cast("int").alias("_copies"), "_early", "_late"), "copies")
    whole = docs.select(F.col(id_col).cast("long").alias("_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    out = whole.filter("_id is not null").join(small(copies.filter("_id is not null")), "_id")
    # Rows without an id have one row of copies between them, so that no join has to bring them together.
    none = copies.filter("_id is null").first()
    if none is not None:
        out = out.unionByName(whole.filter("_id is null").withColumns({c: F.lit(none[c]) for c in ("_copies", "_early", "_late")}))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).withColumn("_slot", F.when(F.col("_copy") == 1, F.col("_early")).otherwise(F.col("_late")))
    return out.repartitionByRange("_slot", F.xxhash64("_row")).sortWithinPartitions("_slot").select("_row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, sum(size) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s
), c AS (
  SELECT *, CAST(CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, 2.0 * CAST(source_size AS DOUBLE) AS cap FROM w
), l AS (
  SELECT *, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM c WINDOW b AS (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT arg_min(level, cap / w) AS level FROM l WHERE cap / w > level
), t AS (
  SELECT source, sid, source_size, least(cap, coalesce((SELECT level FROM f) * w, cap)) AS target FROM l
), k AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS goal FROM t
), b AS (
  SELECT greatest(1024, (sum(goal) + 1073741823) // 1073741824) AS block FROM k
), q AS (
  SELECT *, (goal + block - 1) // block AS quota FROM k, b
), o AS (
  SELECT *, coalesce(sum(quota) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM q
), n AS (
  SELECT cells, CASE WHEN cells > 1 THEN len(bin(cells - 1)) ELSE 0 END AS bits FROM (SELECT CAST(coalesce(sum(quota), 0) AS BIGINT) AS cells FROM q)
), v AS (
  SELECT slot, (CAST(coalesce(list_sum(list_transform(range(bits), lambda i: ((slot >> i) & 1) << (bits - 1 - i))), 0) AS BIGINT) * cells) >> bits AS cell
  FROM n, unnest(range(1 << bits)) AS u(slot) WHERE cells > 0
), r AS (
  SELECT slot, sid, quota, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM v JOIN o ON cell >= first AND cell < first + quota
), p AS (
  SELECT d.doc_id, d.size, o.source_size, o.target, o.goal, o.sid, o.block,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null ' || d.size)), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source
), e AS (
  SELECT sid, start, start + round * source_size AS a, least(start + round * source_size + size, goal) AS z, block FROM p, unnest([0, 1]) AS u(round)
  WHERE size > 0 AND start + round * source_size < goal
), f2 AS (
  SELECT e.sid, e.start, min(r.slot) AS first_slot, count(*) AS n_slots FROM e JOIN r ON r.sid = e.sid AND r.rank < r.quota AND r.rank BETWEEN a // block AND (z - 1) // block GROUP BY 1, 2
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(greatest(0, least(size, goal - p.start)) + greatest(0, least(size, goal - source_size - p.start)) AS BIGINT) AS taken,
  CAST(CASE WHEN size > 0 THEN coalesce(first_slot, -1) ELSE -1 END AS BIGINT) AS first_slot, CAST(CASE WHEN size > 0 THEN coalesce(n_slots, 0) ELSE 0 END AS BIGINT) AS n_slots
FROM p LEFT JOIN f2 ON f2.sid = p.sid AND f2.start = p.start
"""
