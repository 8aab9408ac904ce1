"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source gets a target by its weight. A document's expected copies are its source's target over
the source's size (times the document's own weight, if there is one); whole expected copies are
certain, and the fractions are inclusion probabilities of a sample of fixed size: documents are
ranked by their random odds u/(1-u) over their inclusion odds p/(1-p) (Rosen, 1997), and taken in that
order. The size is fixed in words, not documents, so each source meets its target to within one
document. The order is never sorted whole: a histogram of the ranking finds the bucket where the
sample ends, and only that bucket is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinsift.llm.text import WORD, renamed, restored
from kinsift.operators.skew import join_small
from kinsift.storage import materialize

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2, 7

#: Buckets of the ranking, and buckets whose running sum is one task's.
BUCKETS, RANGE = 4096, 64


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of sizes (source, size): one row per source, null last.

    The total is ``share`` of all sizes, dealt by weight; a source's target stops at ``most`` times its
    size and the excess is dealt again. With sources in order of most * size / weight, the level that
    all unfilled sources share is the largest of the levels got by filling each prefix.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    dealt = by_source.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    fill = Window.orderBy(F.col("_full") / F.col("_w"), F.col("source").asc_nulls_last())
    dealt = dealt.withColumn("_full", (most * F.col("source_size")).cast("double"))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    done, rest = F.sum("_full").over(fill) - F.col("_full"), F.sum("_w").over(Window.partitionBy()) - (F.sum("_w").over(fill) - F.col("_w"))
    dealt = dealt.withColumn("_level", (total - done) / rest)
    dealt = dealt.withColumn("_level", F.max("_level").over(Window.partitionBy()))
    return dealt.select("source", "source_size", F.least(F.col("_full"), F.col("_level") * F.col("_w")).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed alone: 52 bits of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, doc_weight: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row of docs.

    size counts words (null text: 0); copies is how often the mix takes the document, at most
    ``most``; taken = copies * size. Depends on ids, texts and seed alone, so reruns agree. Null sources are
    one source, the last; sources and documents without words take nothing. Draws are by id and text, so
    rows that repeat an id, or have none, are drawn each on its own; rows equal in both have equal
    ranks and are taken one by one in any order, which gives the same rows. doc_weight names a column of
    relative inclusion weights within a source (null or negative: 0). Other columns are not looked at;
    an empty table gives no rows.
    """
    return _mixed(docs, doc_id, source, text, weights, share, most, seed, doc_weight).drop("_source", "_content")


def content(text: Column) -> Column:
    """Half a SHA-256 of the text; null counts as empty."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32)


def _mixed(docs: DataFrame, doc_id: str, source: str, text: str, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, doc_weight: str | None = None) -> DataFrame:
    """mix() with the source and content of each row."""
    own = F.greatest(F.coalesce(F.col(doc_weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if doc_weight else F.lit(1.0)
    sized = materialize(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"), own.alias("_own"), content(F.col(text)).alias("_content")), "sizes")
    aim = targets(sized, weights, share, most)
    if doc_weight:
        aim = aim.join(sized.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("size") * F.col("_own")).alias("_sum")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    else:
        aim = aim.withColumn("_sum", F.col("source_size").cast("double"))
    rate = F.when(F.col("_sum") > 0, F.col("target") / F.col("_sum")).otherwise(F.lit(0.0))
    aim = materialize(aim.select("source", "source_size", "target", rate.alias("_rate")), "targets")
    rows = join_small(sized, aim, "source")
    expected = F.least(F.col("_rate") * F.col("_own"), F.lit(float(most)))
    rows = rows.withColumn("_whole", F.floor(expected)).withColumn("_p", expected - F.floor(expected))
    odds = uniform(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("_content")), seed)
    # null: certain copies only
    rows = rows.withColumn("_rank", F.when(F.col("_p") > 0, (odds / (1 - odds)) / (F.col("_p") / (1 - F.col("_p")))))
    rows = rows.withColumn("_rank", F.col("_rank") / (1 + F.col("_rank")))
    rows = rows.withColumn("_bucket", F.floor(F.col("_rank") * BUCKETS))
    # where each source's sample ends: words left after the whole copies, met by a running sum over ranges and their buckets
    counts = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_size"), F.sum(F.col("_whole") * F.col("size")).alias("_certain"))
    certain = counts.groupBy("source").agg(F.sum("_certain").alias("_certain"))
    left = join_small(aim.select("source", "target"), certain, "source").select("source", (F.col("target") - F.col("_certain")).alias("_left"))
    counts = counts.filter("_bucket is not null").withColumn("_range", F.floor(F.col("_bucket") / RANGE))
    ranges = counts.groupBy("source", "_range").agg(F.sum("_size").alias("_all"))
    ranges = ranges.withColumn("_start", F.sum("_all").over(Window.partitionBy("source").orderBy("_range")) - F.col("_all")).drop("_all")
    inner = F.sum("_size").over(Window.partitionBy("source", "_range").orderBy("_bucket"))
    counts = counts.withColumn("_inner", inner).withColumnsRenamed({"source": "_s", "_range": "_r"})
    counts = counts.join(ranges, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_r") == F.col("_range"))).withColumn("_upto", F.col("_start") + F.col("_inner"))
    ends = join_small(counts.select("source", "_bucket", "_size", "_upto"), left, "source")
    ends = ends.filter("_upto >= _left").groupBy("source").agg(F.min(F.struct("_bucket", (F.col("_upto") - F.col("_size")).alias("_before"), "_left")).alias("_end"))
    ends = materialize(ends.select("source", "_end._bucket", "_end._before", "_end._left").withColumnRenamed("_bucket", "_last"), "ends")
    rows = join_small(rows, ends, "source", "left")
    inside = rows.filter("_bucket = _last")
    order = Window.partitionBy("source").orderBy("_rank", "doc_id", "_content").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = F.col("_before") + F.sum("size").over(order)
    inside = inside.withColumn("_so_far", so_far).withColumn("_extra", ((F.col("_so_far") - F.col("size") < F.col("_left")) & (F.col("_so_far") - F.col("_left") <= F.col("_left") - (F.col("_so_far") - F.col("size")))).cast("int"))
    outside = rows.filter("_bucket is null or _last is null or _bucket <> _last").withColumn("_extra", F.coalesce(F.when(F.col("_bucket").isNull(), 0).when(F.col("_last").isNull() | (F.col("_bucket") < F.col("_last")), 1), F.lit(0)))
    columns = [F.col("source").alias("_source"), "_content", "doc_id", "size", "source_size", "target", (F.col("_whole") + F.col("_extra")).cast("int").alias("copies")]
    out = outside.select(columns).union(inside.select(columns))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def repeat(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **more) -> DataFrame:
    """The mix itself: each row of docs as many times as the mix takes it, documents without words left out.

    Rows are told apart by id, source and text; of rows equal in all three each takes the smallest number
    of their copies. All columns pass through, whatever their names. An empty table gives no rows.
    """
    taken = _mixed(docs, doc_id, source, text, **more).groupBy(F.col("doc_id").alias("_id"), "_source", "_content").agg(F.min("copies").alias("_copies"), F.max("size").alias("_size")).filter("_copies > 0 and _size > 0")
    docs, names = renamed(docs)
    same = F.col(names[doc_id]).cast("bigint").eqNullSafe(F.col("_id")) & F.col(names[source]).cast("string").eqNullSafe(F.col("_source")) & (content(F.col(names[text])) == F.col("_content"))
    return docs.join(taken, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(restored(names))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))


OP2_SQL = """
with d as (
  select doc_id, source, substr(sha256(coalesce(text, '')), 1, 32) as content, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as place from d group by source),
w as (select *, cast(case place % 3 when 0 then 3 when 1 then 1 else 2 end as double) as w, cast(2 * source_size as double) as full_size from s),
l as (
  select *, (sum(source_size) over () * cast(1.5 as double) - (sum(full_size) over f - full_size)) / (sum(w) over () - (sum(w) over f - w)) as level
  from w window f as (order by full_size / w, source nulls last)),
t as (select source, source_size, least(full_size, max(level) over () * w) as target from l),
r as (
  select doc_id, size, content, t.source, source_size, target, case when source_size > 0 then target / cast(source_size as double) else 0.0 end as rate,
    cast(('0x' || substr(sha256('7:' || coalesce(cast(doc_id as varchar), 'null') || ':' || content), 1, 13)) as bigint) / cast(4503599627370496 as double) as u
  from d join t on d.source is not distinct from t.source),
q as (
  select *, least(rate, 2.0) - floor(least(rate, 2.0)) as p, cast(floor(least(rate, 2.0)) as bigint) as whole from r),
k as (
  select *, case when p > 0 then ((u / (1 - u)) / (p / (1 - p))) end as odds, sum(whole * size) over (partition by source) as certain from q),
c as (
  select *, target - certain as rest, sum(case when p > 0 then size else 0 end) over (partition by source order by odds / (1 + odds) nulls last, doc_id nulls first, content rows unbounded preceding) as so_far from k)
select doc_id, size, source_size, target,
  cast(whole + case when p > 0 and so_far - size < rest and so_far - rest <= rest - (so_far - size) then 1 else 0 end as integer) as copies,
  cast((whole + case when p > 0 and so_far - size < rest and so_far - rest <= rest - (so_far - size) then 1 else 0 end) * size as bigint) as taken
from c
"""
