"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is met by whole epochs first. What is left of it is a
weighted sample without replacement: every document draws an exponential key
-ln(u)/w (u from a hash of its id, source and size, w its quality weight), keys
are sorted within the source and sizes summed until the budget is met. The sums
are taken in two steps, over ranges of keys and then within them, so no task
holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._io import cut, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Rows for each range of keys of a source, and least number of ranges.
ROWS, RANGES = 20_000, 1024
#: Least quality weight.
LEAST = 0.25
SYMBOLS = r"[#*$%&|<>]"


def quality_weight() -> Column:
    """From LEAST to 1, by columns text and size: it falls with symbols a word, and with words that are longer or shorter than prose has them.

    The ratios are those of the quality rules: a tenth of a symbol a word, or a mean length of 2 or 15, gives LEAST.
    """
    text = F.coalesce("text", F.lit(""))
    symbols = F.regexp_count(text, F.lit(SYMBOLS)) / F.col("size")
    length = (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))) / F.col("size")
    good = F.least(1 - 10 * symbols, length - 2, (15 - length) / 5, F.lit(1.0))
    return F.when(F.col("size") > 0, F.greatest(F.lit(LEAST), good)).otherwise(LEAST)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size -> the same with target.

    Sources by code point, null last, weigh `weights` in turn. A target is
    min(most * size, level * weight), where the level makes the targets sum to
    share * all sizes: what resharing the excess until none is above leads to.
    One row per source; this table is small next to the documents.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1)
    t = sizes.withColumn("w", w).withColumn("ratio", F.lit(float(most)) * F.col("source_size") / F.col("w"))
    below = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    t = t.withColumn("rest", F.lit(float(share)) * F.sum("source_size").over(whole) - F.lit(float(most)) * F.coalesce(F.sum("source_size").over(below), F.lit(0)))
    t = t.withColumn("level", F.col("rest") / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(below), F.lit(0.0))))
    # sources in order of ratio are full as long as the level that is left exceeds their ratio
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(whole)["level"]
    return t.withColumn("level", level).select("source", "source_size", F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.lit(float(most)) * F.col("source_size")).otherwise(F.col("level") * F.col("w")).alias("target"))


def key() -> tuple[Column, Column]:
    """The uniform number of a document, in (0, 1), and the exponential key."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("source", F.lit("")), F.lit(":"), F.col("size").cast("string")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))
    return u, -F.log(u) / F.col("weight")


def mix(docs: DataFrame, keep: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs (doc_id, text, source), and the columns in keep (which may have any names; of two with one name the caller picks).

    taken is size times the epochs plus size once more if the sample holds
    the row. weight: of the draw, from LEAST to 1, over columns of docs and size
    (quality_weight() if none is given). A null text has size 0 and takes
    nothing; null sources are one source, last in order; repeated rows are rows
    of their own; equal keys (ties) go by id and size; a text counts whole; an
    empty table gives an empty result.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    extra = F.struct(*keep) if keep else F.lit(None)
    sized = docs.select("*", extra.alias("_extra")).withColumn("size", size)
    weight = quality_weight() if weight is None else F.greatest(F.lit(LEAST), F.least(F.lit(1.0), weight))
    sized = sized.select("doc_id", "source", "size", F.col("_extra").alias("extra"), weight.alias("weight"))
    sized = cut(sized.select("doc_id", "source", "size", *(["extra"] if keep else []), key()[1].alias("key")), "mix-sized")
    # a monotone map of keys to ranges; whatever weights there are, a range has no more than some times its share of them
    ranges = max(RANGES, sized.count() // ROWS)
    share = sum((F.exp(-F.col("key") * w) for w in (0.25, 0.5, 0.75, 1.0)), F.lit(0.0)) / 4
    sized = sized.withColumn("range", F.least(F.lit(ranges - 1), F.floor((1 - share) * ranges)).cast("int"))
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    sums = sized.groupBy("source", "range").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    a, b = sums.alias("a"), goal.alias("b")
    sums = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "range", "offset", "source_size", "target", "epochs", "budget")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d, s = sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d"), sums.alias("s")
    joined = d.join(s, F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.range") == F.col("s.range")))
    # a row is in the sample if its middle is within the budget: the sum ends half a document off at most
    middle = F.col("s.offset") + F.col("d.within") + F.col("d.size") / F.lit(2.0)
    taken = F.col("d.size") * (F.col("s.epochs") + F.when(middle <= F.col("s.budget"), 1).otherwise(0))
    return joined.select("d.doc_id", "d.size", "s.source_size", "s.target", taken.cast("long").alias("taken"), *[F.col("d.extra")[c].alias(c) for c in keep])


def op7_efraimidis_spirakis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP7_SQL = f"""
with sized as (
  select doc_id, source, coalesce(text, '') as t, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents
), rated as (
  select doc_id, source, size, case when size > 0 then greatest(0.25, least(1 - 10 * (length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) / size), chars - 2, (15 - chars) / 5, 1.0)) else 0.25 end as weight
  from (select *, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) / size as chars from sized)
), keyed as (
  select *, -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(source, '') || ':' || size::varchar), 1, 12))::bigint::double + 0.5) / 281474976710656.0) / weight as k from rated
), totals as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighed as (
  select *, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3)::int + 1]::double as w from totals
), ratios as (
  select *, {MOST}.0::double * source_size / w as ratio from weighed
), levels as (
  select *, ({SHARE}::double * sum(source_size) over () - 2.0::double * coalesce(sum(source_size) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / (sum(w) over () - coalesce(sum(w) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level from ratios
), cut as (
  select level as l from levels where level <= ratio order by ratio, source nulls last limit 1
), goals as (
  select source, source_size, case when (select l from cut) is null or ratio <= (select l from cut) then 2.0::double * source_size else (select l from cut) * w end as target from levels
), plans as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as epochs from goals
), summed as (
  select d.doc_id, d.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size as budget,
    coalesce(sum(d.size) over (partition by d.source order by k, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as before
  from keyed d join plans p on d.source is not distinct from p.source
)
select doc_id, size, source_size, target, (size * (epochs + case when before + size / 2.0 <= budget then 1 else 0 end))::bigint as taken from summed
"""
