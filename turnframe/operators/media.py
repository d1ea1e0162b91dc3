"""Places of media in token streams: one pad a medium grows to as many as its grid has merged patches, and all that follows moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def patches(grid: Column, merge: Column) -> Column:
    """Tokens of a medium: the product of its grid (time, height, width) over merge squared, rounded down; one where grid is null, in formats whose pads stay single."""
    product = F.aggregate(grid, F.lit(1).cast("bigint"), lambda a, x: a * x)
    return F.when(grid.isNull(), F.lit(1).cast("bigint")).otherwise(F.call_function("div", product, (merge * merge).cast("bigint")))


def placed_media(tokens: DataFrame, media: DataFrame, pads: dict[str, int], merge: int = 2) -> DataFrame:
    """(conv_id, modality, item_idx, pad_pos, offset, length, fault) of media (conv_id, modality, item_idx, grid array<int>) in tokens (conv_id, pos, token_id).

    The n-th pad of a modality stands for its n-th item, by item_idx. offset is where its tokens begin once all pads of the
    conversation have grown, length how many these are. fault is unmatched_pad for a pad without item, unplaced_item for an
    item without pad; neither has a length, and no place moves for them. A grid smaller than the merge has no tokens left.
    """
    names = F.create_map(*[F.lit(x) for m, i in pads.items() for x in (i, m)])
    in_order = lambda *by: Window.partitionBy("conv_id", "modality").orderBy(*by)
    seen = tokens.withColumn("modality", F.try_element_at(names, F.col("token_id").cast("int"))).where("modality is not null")
    seen = seen.select("conv_id", "modality", F.col("pos").alias("pad_pos"), F.row_number().over(in_order("pos")).alias("_nth"))
    items = media.select("conv_id", "modality", "item_idx", patches(F.col("grid"), F.lit(merge)).alias("length"), F.lit(True).alias("_item"), F.row_number().over(in_order("item_idx")).alias("_nth"))
    both = seen.join(items, ["conv_id", "modality", "_nth"], "full")
    fault = F.when(F.col("_item").isNull(), "unmatched_pad").when(F.col("pad_pos").isNull(), "unplaced_item")
    judged = both.withColumn("fault", fault).withColumn("length", F.when(F.col("fault").isNull(), F.col("length")))
    earlier = Window.partitionBy("conv_id").orderBy("pad_pos").rowsBetween(Window.unboundedPreceding, -1)
    grown = F.coalesce(F.sum(F.coalesce(F.col("length") - 1, F.lit(0))).over(earlier), F.lit(0))
    return judged.select("conv_id", "modality", "item_idx", "pad_pos", F.when(F.col("pad_pos").isNotNull(), F.col("pad_pos") + grown).alias("offset"), "length", "fault")


def expanded_tokens(tokens: DataFrame, placed: DataFrame) -> DataFrame:
    """tokens with each pad that has an item as often as its medium has tokens, and new positions; the copies keep the pad's other columns."""
    sizes = placed.where("fault is null").select("conv_id", F.col("pad_pos").alias("pos"), "length")
    counted = tokens.join(sizes, ["conv_id", "pos"], "left").withColumn("_n", F.coalesce("length", F.lit(1).cast("bigint")))
    earlier = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    begun = counted.withColumn("_at", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    copies = begun.where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    return copies.withColumn("pos", F.col("_at") + F.col("_k")).select(*tokens.columns)


def bridged_media(previous: DataFrame, lengths: DataFrame, new: DataFrame) -> DataFrame:
    """Ranges (conv_id, modality, item_idx, offset, length) of a bridged prompt: those of the ids before it as they are, and those of its extension behind them.

    lengths: (conv_id, n) of the ids before. Items are numbered on within each modality. A conversation in one of both alone
    keeps what it has; one without a length counts as empty before.
    """
    columns = ["conv_id", "modality", "item_idx", "offset", "length"]
    held = previous.groupBy("conv_id", "modality").agg((F.max("item_idx") + 1).alias("_items"))
    moved = new.join(lengths, "conv_id", "left").join(held, ["conv_id", "modality"], "left")
    moved = moved.select("conv_id", "modality", (F.col("item_idx") + F.coalesce("_items", F.lit(0))).alias("item_idx"), (F.col("offset") + F.coalesce("n", F.lit(0))).alias("offset"), "length")
    return previous.select(*columns).unionByName(moved)
