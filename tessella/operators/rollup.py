"""Per-day rollups and their captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import even_picks


def day_counts(df: DataFrame, day: Column, conditions: dict[str, Column]) -> DataFrame:
    """day, n and a count per condition."""
    return df.groupBy(day.alias("day")).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def day_values(df: DataFrame, day: Column, value: str, key: str) -> DataFrame:
    """day, value, n: distinct keys per value."""
    return df.filter(F.col(value).isNotNull()).groupBy(day.alias("day"), F.col(value).alias("value")).agg(F.countDistinct(key).alias("n"))


def top_values(counts: DataFrame, n: int, least: int = 1) -> DataFrame:
    """day, values: up to n values per day by descending count, then descending name."""
    w = Window.partitionBy("day").orderBy(F.col("n").desc(), F.col("value").desc())
    ranked = counts.filter(F.col("n") >= least).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    return ranked.groupBy("day").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "value"))), lambda x: x["value"]).alias("values"))


def representatives(df: DataFrame, day: str, order: list[Column], is_photo: Column, n: int = 3) -> DataFrame:
    """n evenly spaced rows per day; photos alone where a day has n of them."""
    rows = df.withColumn("__photo", is_photo).withColumn("__photos", F.count_if("__photo").over(Window.partitionBy(day)))
    rows = rows.filter((F.col("__photos") < n) | F.col("__photo"))
    return even_picks(rows, day, order, n).drop("__photo", "__photos")


def caption(day: Column, weekday: Column, region: Column, photos: Column, videos: Column, people: Column, scenes: Column, camera: Column) -> Column:
    """One or more sentences on a day; parts without content are left out."""
    shaped = F.regexp_extract(day, r"^(\d{4})-(\d{2})-(\d{2})", 2)
    date = F.when(shaped != "", F.concat(shaped.cast("int").cast("string"), F.lit("月"), F.regexp_extract(day, r"^\d{4}-\d{2}-(\d{2})", 1).cast("int").cast("string"), F.lit("日"))).otherwise(day)
    head = F.concat(date, F.when(F.coalesce(weekday, F.lit("")) != "", F.concat(F.lit("（"), weekday, F.lit("）"))).otherwise(""))
    media = F.array_compact(
        F.array(F.when(photos > 0, F.concat(photos.cast("string"), F.lit(" 张照片"))), F.when(videos > 0, F.concat(videos.cast("string"), F.lit(" 段视频"))))
    )
    where = F.when(F.coalesce(region, F.lit("")) != "", F.concat(F.lit("在"), region, F.lit("，"))).otherwise("")
    first = F.when(F.size(media) > 0, F.concat(head, F.lit("，"), where, F.lit("拍摄了 "), F.array_join(media, "、"), F.lit("。"))).otherwise(F.concat(head, F.lit("。")))
    listed = lambda lead, xs: F.when(F.size(F.coalesce(xs, F.array())) > 0, F.concat(F.lit(lead), F.array_join(xs, "、"), F.lit("。")))
    shot = F.when(F.coalesce(camera, F.lit("")) != "", F.concat(F.lit("相机："), camera, F.lit("。")))
    return F.concat_ws("", first, listed("画面中出现", people), listed("场景包含", scenes), shot)
