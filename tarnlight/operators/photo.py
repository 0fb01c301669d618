"""Colour measures of photos from their pixels (A33, A34, P14, F43, J13) and detections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions import rules as R

#: Clusters of an image's colours, and how often their centres are moved.
CLUSTERS, STEPS = 3, 20
#: Distinct colours that a task clusters at a time (some 400 MB with what is worked out of them).
COLOURS = 2_000_000


def roi(pixels: DataFrame) -> DataFrame:
    """The middle 80% in both directions, ends excluded."""
    inside = lambda c, size: (F.col(c) >= F.floor(F.col(size) * 0.1)) & (F.col(c) < F.floor(F.col(size) * 0.9))
    return pixels.where(inside("x", "width") & inside("y", "height"))


def hsv(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """byte-scale hue (0-179), saturation and value (0-255)."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    h = F.when(d == 0, 0.0).when(top == r, 60.0 * (g - b) / d).when(top == g, 120.0 + 60.0 * (b - r) / d).otherwise(240.0 + 60.0 * (r - g) / d)
    h = F.when(h < 0, h + 360.0).otherwise(h)
    return {"h": F.pmod(F.floor(h / 2 + 0.5), F.lit(180)), "s": F.when(top == 0, 0).otherwise(F.floor(255.0 * d / top + 0.5)), "v": top}


def colour_measures(pixels: DataFrame) -> DataFrame:
    """Shares of green, foam and unnatural pixels in per cent, deviations of value, saturation and hue, by image.

    The image's middle counts. Foam is the plain mask, without the morphological opening. The hue deviation takes saturated
    pixels and is 0 unless there are more than 100.
    """
    seen = roi(pixels).withColumns(hsv(F.col("r"), F.col("g"), F.col("b")))
    h, s, v = F.col("h"), F.col("s"), F.col("v")
    pct = lambda cond: F.round(F.avg(cond.cast("double")) * 100, 4)
    purple, red = h.between(125, 165) & (s >= 50) & (v >= 50), h.between(0, 10) & (s >= 100) & (v >= 100)
    rich = s > 40
    return seen.groupBy("image_id").agg(
        pct(h.between(35, 85) & (s >= 50) & (v >= 50)).alias("green_pct"), pct((s <= 30) & (v >= 200)).alias("foam_pct"), pct(purple | red).alias("unnatural_pct"),
        F.round(F.avg("v"), 4).alias("v_mean"), F.round(F.stddev_pop("v"), 4).alias("v_std"), F.round(F.stddev_pop("s"), 4).alias("s_std"),
        F.round(F.when(F.count_if(rich) > 100, F.stddev_pop(F.when(rich, h))).otherwise(0.0), 4).alias("hue_std"),
    )


def dominant_rgb(pixels: DataFrame, levels: int = 16) -> DataFrame:
    """The mean colour of the most frequent of ``levels`` cubed colour bins (the first of equals), and its FU index."""
    step = 256 // levels
    bins = [F.floor(F.col(c) / step).cast("int").alias(f"_{c}") for c in "rgb"]
    sums = roi(pixels).groupBy("image_id", *bins).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "rgb"])
    order = Window.partitionBy("image_id").orderBy(F.desc("n"), "_r", "_g", "_b")
    best = sums.withColumn("_k", F.row_number().over(order)).where("_k = 1")
    rounded = [F.round(c, 4).alias(c) for c in "rgb"]
    return best.select("image_id", "n", *rounded, R.nearest_fu(F.col("r"), F.col("g"), F.col("b")).alias("fu_index"))


def clustered(image: np.ndarray, colours: np.ndarray, weights: np.ndarray, k: int = CLUSTERS, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Centres (image, cluster, component) and weights (image, cluster) of ``k`` clusters of each image's weighted colours.

    ``image`` numbers the rows' images from 0 without gaps, in order; an image's colours are in the order of r, g, b. The first
    seed is the heaviest colour, each further one the colour farthest from all seeds before it; of equals the first in order.
    A colour goes to its nearest centre, the first of equally near ones; a cluster without colours keeps its centre. Sums are
    of whole numbers, so the result doesn't depend on their order.
    """
    starts = np.flatnonzero(np.diff(image, prepend=-1))

    def first_highest(score: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(score == np.maximum.reduceat(score, starts)[image])
        return at[np.flatnonzero(np.diff(image[at], prepend=-1))]

    def away(centre: np.ndarray) -> np.ndarray:
        r, g, b = (colours - centre[image]).T
        return r * r + g * g + b * b

    def nearest() -> np.ndarray:
        best, least = np.zeros(len(image), np.int64), away(centres[:, 0])
        for j in range(1, k):
            d = away(centres[:, j])
            closer = d < least
            best[closer], least[closer] = j, d[closer]
        return image * k + best

    m = len(starts)
    centres = np.repeat(colours[first_highest(weights)][:, None], k, axis=1)
    least = away(centres[:, 0])
    for j in range(1, k):
        centres[:, j] = colours[first_highest(least)]
        least = np.minimum(least, away(centres[:, j]))
    for _ in range(steps):
        of = nearest()
        total = np.bincount(of, weights, m * k)[:, None]
        sums = np.stack([np.bincount(of, weights * c, m * k) for c in colours.T], axis=1)
        moved = np.where(total > 0, sums / np.maximum(total, 1), centres.reshape(-1, 3)).reshape(m, k, 3)
        if (moved == centres).all():  # further steps wouldn't move them either
            break
        centres = moved
    return centres, np.bincount(nearest(), weights, m * k).reshape(m, k)


def dominant_cluster(pixels: DataFrame, k: int = CLUSTERS, steps: int = STEPS) -> DataFrame:
    """The centre (whole numbers, cut) of the largest of ``k`` clusters of an image's colours, its pixels, and its FU index.

    The image's middle counts; components are bytes. Pixels with a null component don't count, and an image of such pixels
    alone has no row. Of clusters of one size the first counts. Pixels are summed by colour before an image's colours meet in
    one row, so that row holds 16.8 million of them at most, however many pixels there are; a task clusters some at a time.
    """
    seen = roi(pixels).where("r is not null and g is not null and b is not null")
    code = (F.col("r").cast("int") * 256 + F.col("g").cast("int")) * 256 + F.col("b").cast("int")
    colours = seen.groupBy("image_id", code.alias("c")).agg(F.count("*").alias("n"))
    images = colours.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("c", "n"))).alias("colours"))

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column("colours").offsets.to_numpy())
            part = np.cumsum(size) // COLOURS  # images of so many colours are clustered at once, and a larger one alone
            for rows in np.split(np.arange(len(size)), np.flatnonzero(np.diff(part)) + 1) if len(size) else []:
                some = batch.slice(rows[0], len(rows))
                flat = some.column("colours").flatten()
                c, n = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("c", "n"))
                rgb = np.stack([c >> 16, c >> 8 & 255, c & 255], axis=1).astype(np.float64)
                centres, sizes = clustered(np.repeat(np.arange(len(rows)), size[rows]), rgb, n.astype(np.float64), k, steps)
                top = np.argmax(sizes, axis=1)
                each = np.arange(len(rows))
                found = centres[each, top].astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column("image_id"), pa.array(sizes[each, top].astype(np.int64)), *[pa.array(found[:, x]) for x in range(3)]], ["image_id", "n", "r", "g", "b"])

    out = images.mapInArrow(largest, f"image_id {dict(images.dtypes)['image_id']}, n long, r int, g int, b int")
    return out.withColumn("fu_index", R.nearest_fu(F.col("r"), F.col("g"), F.col("b")))


def detections(rows: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """For each image the top detection, pollution confidence, summary and class counts.

    Rows are added up by image and class first, so an image of very many detections is no one task's. A null confidence ranks
    last, and a null class counts in ``n`` alone.
    """
    rank = F.coalesce(-F.col("confidence"), F.lit(float("inf")))  # of equal confidences the first
    best = F.min(F.struct(rank.alias("_rank"), order, "class", "confidence"))
    dirty = F.max(F.when(F.col("class").isin("polluted", "algae"), F.col("confidence")))
    by_class = rows.groupBy(key, "class").agg(F.count("*").alias("_n"), best.alias("_best"), dirty.alias("_dirty"))
    counts = F.array_sort(F.collect_list(F.when(F.col("class").isNotNull(), F.struct("class", "_n"))))  # as many as there are classes
    n, top = F.sum("_n").cast("int"), F.min("_best")
    return by_class.groupBy(key).agg(
        n.alias("n"), top["class"].alias("top_class"), top["confidence"].alias("top_confidence"), F.coalesce(F.max("_dirty"), F.lit(0.0)).alias("pollution_confidence"),
        R.detection_summary(top, n).alias("summary"), F.map_from_entries(counts).alias("class_counts"),
    )
