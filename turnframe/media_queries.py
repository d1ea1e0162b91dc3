"""Registered queries on media in token streams. A turn is a run of tokens; user turns end with an image, others of even length with a video."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnframe.operators import media
from turnframe.registry import query
from turnframe.sources import table

_PADS = {"image": -1, "video": -2}
_MADE = """r AS (SELECT conv_id, turn, role, length(text) % 7 + 1 AS n, CASE WHEN role = 'user' THEN 'image' WHEN length(text) % 2 = 0 THEN 'video' END AS modality,
      CASE WHEN role = 'user' THEN (2 + turn % 3 * 2) * (4 + conv_id % 2 * 2) ELSE 3 * 4 * 4 END // 4 AS size FROM conversations),
    e AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pad, row_number() OVER (PARTITION BY conv_id, modality ORDER BY turn) - 1 AS item FROM r),
    g AS (SELECT *, pad + coalesce(sum(CASE WHEN modality IS NOT NULL AND NOT lost THEN size - 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
      FROM (SELECT *, modality = 'video' AND conv_id % 4 = 0 AND item = max(CASE WHEN modality = 'video' THEN item END) OVER (PARTITION BY conv_id) AS lost FROM e))"""


def _made(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tokens, and media of which some conversations lack the last video."""
    from pyspark.sql import Window

    n = F.length("text") % 7 + 1
    turns = table(spark, sf_dir, "conversations").withColumns({"n": n, "modality": F.when(F.col("role") == "user", "image").when(F.length("text") % 2 == 0, "video")})
    parts = turns.select("conv_id", "turn", "n", "modality", F.explode(F.sequence(F.lit(1), "n")).alias("k"))
    ids = F.when((F.col("k") == F.col("n")) & (F.col("modality") == "image"), _PADS["image"]).when((F.col("k") == F.col("n")) & (F.col("modality") == "video"), _PADS["video"]).otherwise(F.col("k"))
    tokens = parts.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "k")) - 1).alias("pos"), ids.alias("token_id"))
    own = Window.partitionBy("conv_id", "modality")
    some = turns.where("modality is not null").withColumns({"item_idx": F.row_number().over(own.orderBy("turn")) - 1, "items": F.count("*").over(own)})
    grid = F.when(F.col("modality") == "image", F.array(F.lit(1), (2 + F.col("turn") % 3 * 2).cast("int"), (4 + F.col("conv_id") % 2 * 2).cast("int"))).otherwise(F.array(F.lit(3), F.lit(4), F.lit(4)))
    lost = (F.col("modality") == "video") & (F.col("conv_id") % 4 == 0) & (F.col("item_idx") == F.col("items") - 1)
    return tokens, some.where(~lost).select("conv_id", "modality", "item_idx", grid.alias("grid"))


@query(f"""WITH {_MADE} SELECT conv_id, modality, (CASE WHEN lost THEN -1 ELSE item END)::INTEGER AS item_idx, pad::BIGINT AS pad_pos, begins::BIGINT AS "offset", (CASE WHEN lost THEN -1 ELSE size END)::BIGINT AS length, CASE WHEN lost THEN 'unmatched_pad' END AS fault FROM g WHERE modality IS NOT NULL""")
def media_places(spark, sf_dir):
    """Where media stand once their pads have grown; -1 for what a pad without a medium lacks."""
    tokens, items = _made(spark, sf_dir)
    placed = media.placed_media(tokens, items, _PADS)
    return placed.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("item_idx", "length")})


@query(f"""WITH {_MADE} SELECT conv_id, sum(n)::BIGINT + sum(CASE WHEN modality IS NOT NULL AND NOT lost THEN size - 1 ELSE 0 END)::BIGINT AS n_tokens, sum(CASE WHEN modality = 'image' THEN size ELSE 0 END)::BIGINT AS n_image,
    coalesce(sum(CASE WHEN modality = 'image' THEN size * begins + size * (size - 1) // 2 END), 0)::BIGINT AS image_positions FROM g GROUP BY 1""")
def media_tokens(spark, sf_dir):
    """Token streams with their media, counted."""
    tokens, items = _made(spark, sf_dir)
    grown = media.expanded_tokens(tokens, media.placed_media(tokens, items, _PADS))
    image = F.col("token_id") == _PADS["image"]
    return grown.groupBy("conv_id").agg(F.count("*").alias("n_tokens"), F.count_if(image).alias("n_image"), F.sum(F.when(image, F.col("pos")).otherwise(0)).alias("image_positions"))
