"""Page image arithmetic as column expressions: what needs no image library.

Pixels come as arrays; decoding and the library kernels (denoising, local
contrast, rotation) belong to whoever reads the images.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import let


def gray(blue: Column, green: Column, red: Column) -> Column:
    """Weighted brightness, cut to whole numbers of 0 to 255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(0.114 * blue + 0.587 * green + 0.299 * red))).cast("int")


def channels(n: Column) -> Column:
    """How an image of n channels becomes one of three: repeated, as it is, without its last; null: not at all."""
    return F.when(n == 1, "repeat").when(n == 3, "keep").when(n == 4, "drop_alpha")


def resized(width: Column, height: Column, most: int = 2200) -> Column:
    """Struct width, height, scale after shrinking the longer side to ``most``."""
    longest = F.greatest(width, height)
    scale = F.when(longest > most, F.lit(float(most)) / longest).otherwise(1.0)
    side = lambda c: F.greatest(F.lit(1), F.bround(c * scale).cast("int"))
    return F.struct(F.when(longest > most, side(width)).otherwise(width).alias("width"), F.when(longest > most, side(height)).otherwise(height).alias("height"), F.round(scale, 6).alias("scale"))


def correction(angle: Column, pixels: Column, least_pixels: int = 64, most: float = 15.0) -> Column:
    """The turn that sets a page straight, from a rectangle's angle of either convention; none for too few pixels or too large a turn."""
    turn = F.when(angle < -45, angle + 90).when(angle > 45, angle - 90).otherwise(angle)
    bound = max(0.0, min(45.0, most))
    return F.when((pixels < least_pixels) | (F.abs(turn) > bound), 0.0).otherwise(turn)


def otsu(values: Column) -> Column:
    """The brightness that parts an array of gray values (0 to 255) best: the first with the largest variance between the two classes."""
    n, total = F.size(values), F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("best"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))

    def step(a: Column, x: Column) -> Column:
        low, mass = a["n"] + 1, a["sum"] + x["v"]
        high = n - low
        spread = F.when(x["last"] & (high > 0), low * high * F.pow(mass / low - (total - mass) / high, F.lit(2.0))).otherwise(0.0)
        better = spread > a["best"] + 1e-9
        return F.struct(F.when(better, x["v"]).otherwise(a["at"]).alias("at"), F.when(better, spread).otherwise(a["best"]).alias("best"), low.alias("n"), mass.alias("sum"))

    def parted(s: Column) -> Column:
        marked = F.transform(s, lambda x, k: F.struct(x.alias("v"), F.coalesce(F.get(s, k + 1) != x, F.lit(True)).alias("last")))
        return F.aggregate(marked, start, step, lambda a: a["at"])

    return let(F.array_sort(values), parted)


def foreground(values: Column, threshold: Column) -> Column:
    """Pixels that are not brighter than the threshold."""
    return F.size(F.filter(values, lambda x: x <= threshold))


def steps(resize: Column, clahe: bool, angle: Column, threshold: bool, blur: int) -> Column:
    """The names of the steps that a page goes through."""
    return F.array_compact(F.array(
        F.when(resize == 1.0, "resize_skipped").otherwise("resize"), F.lit("grayscale"), F.lit("denoise"), F.when(F.lit(clahe), "clahe"),
        F.when(F.abs(angle) <= 0.25, "deskew_skipped").otherwise("deskew"), F.when(F.lit(threshold), "adaptive_threshold"), F.when(F.lit(blur > 1), "median_blur")))


def preprocessed(job: Column, decoded: Column, failed: Column, encoded: Column) -> Column:
    """What is kept of a page: the processed image, else the original as an image, else its bytes. failed: why processing failed, null if it did not; encoded: whether the original can be written as an image."""
    image, raw = F.concat_ws("/", F.lit("jobs"), job, F.lit("preprocessed/page-0001.png")), F.concat_ws("/", F.lit("jobs"), job, F.lit("preprocessed/source.bin"))
    outcome = F.when(~decoded, "unsupported_format").when(failed.isNull(), "processed").when(encoded, "fallback_original_image").otherwise("preprocess_and_encode_failed")
    return F.struct(outcome.alias("outcome"), F.when(outcome.isin("processed", "fallback_original_image"), image).otherwise(raw).alias("key"), F.when(decoded & failed.isNotNull(), F.left(F.regexp_replace(failed, "\n", " "), F.lit(200))).alias("reason"))
