"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share ``share`` times all sizes. A target stops at
``cap`` times its source's size; the excess is shared again by weight until no target is above. A source first takes
every document floor(target / size of the source) times (complete epochs). The rest of its target is a weighted sample
without replacement: each document draws an exponential key -ln(u) / quality, the keys are sorted within the source and
sizes are summed along them until the budget is met. The one further document whose size is nearest to what is still
missing joins, if it brings the source nearer to its target. u is a hash of the identifier, so that reruns agree.

The prefix sums never bring a source together: a source's keys are cut into about ``n / rows_per_bin`` ranges, a range
is one window, and the ranges' totals are summed by source. The water level of the targets is a window over one row per
source; sources are taken to be few against documents.

Defined cases: a null text has size 0 and is taken as often as its source's epochs say (0 words either way); a null
source is a source; rows with equal identifiers draw equal keys and stand next to each other; an empty table, or one
without words, gives targets of 0; ``mixed`` passes other columns through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import count_chars, cut, text_or_empty, words

WEIGHTS = (3, 1, 2)


def quality_weight(text: Column) -> Column:
    """1 for prose, falling with the share of symbols that prose does not use."""
    return F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * count_chars(text, "#*$%&|<>") / F.greatest(F.length(text), F.lit(1)))


def uniform(id_col: str, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of a hash of the identifier."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Of a table (_mx_source, _mx_size, ...) with one row per source: ``_mx_rank`` and ``_mx_target``."""
    ranked = sizes.withColumn("_mx_rank", F.row_number().over(Window.orderBy(F.col("_mx_source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_mx_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    full = F.col("_mx_size") * F.lit(float(cap))
    ranked = ranked.withColumns({"_mx_w": weight, "_mx_full": full, "_mx_fill": full / weight})
    order = Window.orderBy("_mx_fill", "_mx_rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # from the source that is full first: the level at which those from here on share what the full ones leave
    level = (F.sum("_mx_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_mx_full").over(before), F.lit(0.0))) / F.sum("_mx_w").over(after)
    found = ranked.withColumn("_mx_level", level).withColumn("_mx_capped", F.col("_mx_fill") <= F.col("_mx_level"))
    first = F.min(F.when(~F.col("_mx_capped"), F.struct("_mx_fill", "_mx_rank", "_mx_level"))).over(everything)["_mx_level"]
    target = F.when(F.col("_mx_capped"), F.col("_mx_full")).otherwise(first * F.col("_mx_w"))
    return found.withColumn("_mx_target", target).drop("_mx_w", "_mx_full", "_mx_fill", "_mx_level", "_mx_capped")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 42, rows_per_bin: int = 4096) -> DataFrame:
    """One row per row of ``df``: identifier, source, size, the source's size and target, and ``copies``."""
    text = text_or_empty(text_col)
    key = -F.log(uniform(id_col, seed)) / quality_weight(text)
    rows = cut(df.select(F.col(id_col).alias("_mx_id"), F.col(source_col).alias("_mx_source"), F.size(words(text)).cast("long").alias("_mx_n"), key.alias("_mx_key")), "mix-rows")
    per_source = rows.groupBy("_mx_source").agg(F.sum("_mx_n").alias("_mx_size"), F.count(F.lit(1)).alias("_mx_docs"))
    plan = targets(per_source, weights=weights, share=share, cap=cap)
    epochs = F.when(F.col("_mx_size") > 0, F.floor(F.col("_mx_target") / F.col("_mx_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("_mx_epochs", epochs).withColumn("_mx_rest", F.col("_mx_target") - F.col("_mx_epochs") * F.col("_mx_size"))
    plan = cut(plan.withColumn("_mx_bins", F.ceil(F.col("_mx_docs") / rows_per_bin)), "mix-plan")

    # exp(-key) is spread over (0, 1), and falls as the key grows
    sources = plan.withColumnRenamed("_mx_source", "_mx_of")
    dealt = rows.join(sources, rows["_mx_source"].eqNullSafe(sources["_mx_of"])).drop("_mx_of")
    dealt = dealt.withColumn("_mx_bin", F.floor((F.lit(1.0) - F.exp(-F.col("_mx_key"))) * F.col("_mx_bins")))
    order = Window.partitionBy("_mx_rank").orderBy("_mx_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = dealt.groupBy("_mx_rank", "_mx_bin").agg(F.sum("_mx_n").alias("_mx_sum"))
    bins = cut(bins.select("_mx_rank", "_mx_bin", F.coalesce(F.sum("_mx_sum").over(order), F.lit(0)).alias("_mx_before")), "mix-bins")
    along = Window.partitionBy("_mx_rank", "_mx_bin").orderBy("_mx_key", "_mx_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("_mx_along", F.sum("_mx_n").over(along)).join(bins, ["_mx_rank", "_mx_bin"])
    summed = cut(summed.withColumn("_mx_end", F.col("_mx_along") + F.col("_mx_before")).drop("_mx_along", "_mx_before", "_mx_bin", "_mx_bins", "_mx_docs"), "mix-sums")

    inside = F.col("_mx_end") <= F.col("_mx_rest")
    gaps = summed.groupBy("_mx_rank").agg((F.first("_mx_rest") - F.coalesce(F.max(F.when(inside, F.col("_mx_end"))), F.lit(0))).alias("_mx_gap"))
    gaps = cut(gaps, "mix-gaps")
    off = F.abs(F.col("_mx_n") - F.col("_mx_gap"))
    nearest = summed.filter(~inside).join(gaps, "_mx_rank").filter(off < F.col("_mx_gap")).groupBy("_mx_rank").agg(F.min(F.struct(off.alias("off"), F.col("_mx_end").alias("end")))["end"].alias("_mx_top"))
    nearest = cut(nearest, "mix-last")
    out = summed.join(nearest, "_mx_rank", "left")
    chosen = (inside | (F.col("_mx_end") == F.col("_mx_top"))) & (F.col("_mx_n") > 0)
    copies = F.col("_mx_epochs") + F.when(F.coalesce(chosen, F.lit(False)), 1).otherwise(0)
    return out.select(F.col("_mx_id").alias("id"), F.col("_mx_source").alias("source"), F.col("_mx_n").alias("size"), F.col("_mx_size").alias("source_size"), F.col("_mx_target").alias("target"), copies.cast("long").alias("copies"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, with the columns of ``df``: each row as often as the mix takes it. Rows that share an identifier
    are taken equally often."""
    copies = mix(df, id_col, text_col, source_col, **options).groupBy(F.col("id").alias("_mx_of")).agg(F.max("copies").alias("_mx_copies")).filter("_mx_copies > 0")
    out = df.join(cut(copies, "mix-copies").hint("merge"), F.col(id_col).eqNullSafe(F.col("_mx_of")))
    return out.withColumn("_mx_copy", F.explode(F.sequence(F.lit(1), F.col("_mx_copies")))).select(*[df[f"`{c}`"] for c in df.columns])
