"""Image datasets as tables of paths, sizes and captions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trainset.functions.text import is_blank, strip, text_or_empty
from trainset.operators.clean import mark_duplicates
from trainset.operators.infer import Complete, batch_complete
from trainset.operators.sampling import cap_groups, upsample
from trainset.sources.images import image_size

# ---- fixed values ----
MIN_SIDE = 512
MIN_IMAGES = 10
SIZE_MULTIPLE = 32
ASPECTS = (1.0, 4 / 3, 3 / 2, 16 / 9)
EXTENSIONS = {"jpeg": ".jpg", "png": ".png", "webp": ".webp"}
# ----------------------


def image_records(files: DataFrame, source: str, order: str = "path") -> DataFrame:
    """Image files to judged records: reason is no_image, unreadable, duplicate or NULL (kept).

    The bytes are hashed and measured where they are read and never shuffled.
    """
    measured = files.withColumn("sha1", F.sha1("content")).withColumn("__size", image_size(F.col("content"))).drop("content")
    reason = F.when(F.coalesce(F.col("length"), F.lit(0)) == 0, F.lit("no_image")).when(F.col("__size.width").isNull(), F.lit("unreadable"))
    judged = mark_duplicates(measured.withColumn("reason", reason), fp="sha1", seq=order)
    extension = F.lit(".png")
    for fmt, ext in EXTENSIONS.items():
        extension = F.when(F.col("__size.format") == fmt, F.lit(ext)).otherwise(extension)
    return judged.select(
        order, "name", F.concat(F.lit("images/"), F.col("sha1"), extension).alias("image"),
        *(["caption"] if "caption" in files.columns else []),
        F.lit(source).alias("meta_source"), F.col("__size.width").alias("width"), F.col("__size.height").alias("height"), "reason",
    )


def cap_images(judged: DataFrame, max_rows: int, seed: int = 42, key: str = "path") -> DataFrame:
    """A seeded selection of at most ``max_rows`` accepted images."""
    kept = judged.where(F.col("reason").isNull()).withColumn("__all", F.lit("all"))
    return cap_groups(kept, {"all": max_rows}, "__all", seed, [key]).drop("__all")


def path_stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def join_captions(images: DataFrame, captions: DataFrame, default: str = "") -> DataFrame:
    """Caption of the ``.txt`` file with the same path stem, else the default; an empty file captions with "".

    Of several rows for one file the one with the greatest text counts, so an image stays one row.
    """
    beside = captions.where(F.col("path").endswith(".txt"))
    sidecar = beside.groupBy(path_stem(F.col("path")).alias("__stem")).agg(F.max(strip(text_or_empty(F.col("text")))).alias("__text"))
    joined = images.withColumn("__stem", path_stem(F.col("path"))).join(sidecar, "__stem", "left")
    return joined.withColumn("caption", F.coalesce("__text", F.lit(default))).drop("__stem", "__text")


def set_captions(images: DataFrame, captions: DataFrame, order: str | None = None) -> DataFrame:
    """Replace captions by image path; of several for one image the last in ``order`` counts (else the greatest)."""
    text = strip(F.col("caption"))
    last = F.max_by(text, F.when(text.isNotNull(), F.col(order))) if order else F.max(text)
    new = captions.groupBy("image").agg(last.alias("__new"))
    return images.join(new, "image", "left").withColumn("caption", F.coalesce("__new", F.col("caption"))).drop("__new")


def caption_images(images: DataFrame, prompt: Column, complete: Complete, overwrite: bool = False, trigger: str | None = None, style: str = "concise, descriptive") -> DataFrame:
    """Caption images that have none (or all): ``prompt`` is what the callable gets per image."""
    todo = images if overwrite else images.where(is_blank(F.col("caption")))
    ask = F.concat(F.lit(f"Describe the image ({style})" + (f"; call its subject {trigger}" if trigger else "") + ":\n"), prompt)
    replies = batch_complete(todo.select("image", ask.alias("__ask")), "__ask", complete, label="captions")
    made = replies.where(~is_blank(F.col("reply"))).select("image", F.btrim(strip(F.col("reply")), F.lit('"')).alias("caption"))
    return set_captions(images, made)


def apply_trigger(caption: Column, trigger: str | None) -> Column:
    """Put the trigger word in front unless the caption already has it."""
    text = strip(text_or_empty(caption))
    word = (trigger or "").strip()
    if not word:
        return text
    return (
        F.when(F.contains(F.lower(text), F.lit(word.lower())), text)
        .when(text == "", F.lit(word))
        .otherwise(F.concat(F.lit(word + ", "), text))
    )


def buckets_for(resolution: int) -> list[tuple[int, int]]:
    """(height, width) of each aspect and its reverse, as multiples of 32 with about resolution² pixels."""
    shapes: dict[tuple[int, int], None] = {}
    for aspect in ASPECTS:
        longer, shorter = (round(resolution * math.sqrt(f) / SIZE_MULTIPLE) * SIZE_MULTIPLE for f in (aspect, 1 / aspect))
        shapes[shorter, longer] = shapes[longer, shorter] = None
    return list(shapes)


def assign_bucket(height: Column, width: Column, buckets: Sequence[tuple[int, int]]) -> Column:
    """Bucket label ``HxW`` with the closest aspect ratio; the earlier bucket wins a tie."""
    ratio = width / height
    choices = [
        F.struct(F.abs(F.log(F.lit(w / h) / ratio)).alias("d"), F.lit(i).alias("i"), F.lit(f"{h}x{w}").alias("b"))
        for i, (h, w) in enumerate(buckets)
    ]
    return F.array_min(F.array(*choices))["b"]


def image_items(records: DataFrame, files: DataFrame) -> DataFrame:
    """One item per repeat with its caption variants, for images whose file exists."""
    filled = F.filter(F.coalesce("captions", F.array().cast("array<string>")), lambda c: text_or_empty(c) != "")
    variants = F.when(F.size(filled) > 0, filled).otherwise(F.array(text_or_empty(F.col("caption"))))
    found = records.join(files.select("image").distinct(), "image", "left_semi")
    return upsample(found.withColumn("captions", variants), F.col("repeat"))


def distinct_captions(items: DataFrame) -> DataFrame:
    return items.select(F.explode("captions").alias("caption")).distinct()


def image_report(images: DataFrame) -> DataFrame:
    """One row: images, upper median of the short side, small and uncaptioned counts, aspects, tips."""
    short = F.least("width", "height")
    ratio = F.when(F.col("height") > 0, F.col("width") / F.col("height")).otherwise(F.lit(1.0))
    rows = images.select(
        short.cast("int").alias("short"), ratio.alias("ratio"), is_blank(F.col("caption")).alias("bare")
    )
    square = (F.col("ratio") >= 0.9) & (F.col("ratio") <= 1.1)
    totals = rows.agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(F.col("short") < MIN_SIDE).alias("small_images"),
        F.count_if("bare").alias("uncaptioned"),
        F.count_if(square).alias("square"),
        F.count_if(F.col("ratio") > 1.1).alias("landscape"),
        F.count_if(F.col("ratio") < 0.9).alias("portrait"),
    )
    tip = lambda test, *text: F.when(test, F.concat(*[t if isinstance(t, Column) else F.lit(t) for t in text]))
    tips = F.concat_ws(
        "; ",
        tip(F.col("images") < MIN_IMAGES, "fewer than 10 images"),
        tip(F.col("small_images") > 0, F.col("small_images").cast("string"), f" image(s) below {MIN_SIDE}px on the short side"),
        tip(F.col("uncaptioned") > 0, F.col("uncaptioned").cast("string"), " image(s) without a caption"),
    )
    return totals.withColumn("short_side_median", upper_median(rows, "short").scalar()).withColumn("tips", tips)


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """The value at index ``n div 2`` of the sorted values, from counts of distinct values."""
    from pyspark.sql import Window

    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("c")).withColumn("hi", F.floor(F.col(value) / 65536))
    coarse = counts.groupBy("hi").agg(F.sum("c").alias("hc"))
    along = Window.orderBy("hi").rowsBetween(Window.unboundedPreceding, -1)  # at most 32768 rows
    bases = coarse.select("hi", F.coalesce(F.sum("hc").over(along), F.lit(0)).alias("base"), F.sum("hc").over(Window.partitionBy(F.lit(0))).alias("n"))
    inside = Window.partitionBy("hi").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.join(F.broadcast(bases), "hi").withColumn("upto", F.col("base") + F.sum("c").over(inside))
    return ranked.where(F.col("upto") > F.floor(F.col("n") / 2)).agg(F.min(value).cast("long").alias("median"))


def mix_images(records: DataFrame, repeat: int = 1, dataset: str = "dataset") -> DataFrame:
    """Combine image datasets: paths get the dataset's name, rows are repeated."""
    base = F.element_at(F.split("image", "/"), -1)
    named = records.withColumn("image", F.concat(F.lit("images/"), F.col(dataset), F.lit("-"), base))
    return upsample(named, F.lit(max(int(repeat), 1)))
