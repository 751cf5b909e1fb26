"""Scalar expressions: names, paths, binning, outcomes, numeric guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

D = "double"
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp", "gif", "tif", "tiff")


def squeezed(value: Column) -> Column:
    """Trimmed, lower-cased, white space squeezed."""
    return F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))


def slug(value: Column) -> Column:
    """Lower-case runs of letters and digits joined by '-', or 'unknown' (P20)."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("unknown"))


def number_token(value: Column) -> Column:
    """0.5 as 0p5, -1 as m1."""
    shown = F.regexp_replace(value.cast(D).cast("string"), r"\.0$", "")
    return F.replace(F.replace(shown, F.lit("."), F.lit("p")), F.lit("-"), F.lit("m"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))


def is_image_member(path: Column) -> Column:
    """An image suffix, no directory, no resource fork."""
    return path.rlike("(?i)\\.(" + "|".join(IMAGE_SUFFIXES) + ")$") & ~F.array_contains(F.split(path, "/"), "__MACOSX")


def implausible_compression(size: Column, compressed: Column) -> Column:
    """Members that compress to under a hundredth."""
    return (size > 10_000) & (compressed > 0) & (F.try_divide(compressed.cast(D), size.cast(D)) < F.lit(0.01))


def phase_of_split(split: Column) -> Column:
    """discovery for train splits, confirmation for test and validation ones, else an error."""
    s = F.lower(split)
    return F.when(s.contains("train"), "discovery").when(s.contains("test") | s.contains("validation"), "confirmation").otherwise(F.raise_error(F.concat(F.lit("no phase for split "), F.coalesce(split, F.lit("null")))))


def forbidden_demo(path: Column, dataset: Column) -> Column:
    """Demo rows: a validation scene of a demo dataset, case ignored."""
    return F.coalesce(path.rlike("(?i)coco.*val2017") | F.lower(dataset).contains("demo"), F.lit(False))


def forbidden_label(label: Column, tokens: tuple[str, ...] = ("tamper", "edited", "inpaint", "partial", "manipulated")) -> Column:
    """Any forbidden token within the label."""
    return F.coalesce(F.lower(label).rlike("|".join(tokens)), F.lit(False))


def numeric(value: Column) -> Column:
    """Number or null (P10)."""
    return value.try_cast(D)


def finite_or(value: Column, default: float | None) -> Column:
    """NaN and infinities replaced."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(default).cast(D)).otherwise(value)


def sigmoid(value: Column, limit: float = 80.0) -> Column:
    """Logistic of the value clipped to +-limit."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(value.cast(D), F.lit(limit)), F.lit(-limit))))


def softplus(value: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(value, F.lit(0.0)) + F.log1p(F.exp(-F.abs(value)))


def outcome(target: Column, decision: Column) -> Column:
    """TP, TN, FP or FN; null for unknown truth."""
    return F.when((target == 1) & (decision == 1), "TP").when((target == 0) & (decision == 0), "TN").when((target == 0) & (decision == 1), "FP").when((target == 1) & (decision == 0), "FN")


def bin_right(value: Column, edges: Column) -> Column:
    """Number of edges at or below the value, as a right-sided search gives."""
    return F.size(F.filter(edges, lambda e: e <= value))


def bin_fixed(value: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin with a closed last one."""
    return F.greatest(F.least(F.floor((value - low) / F.lit((high - low) / bins)), F.lit(bins - 1)), F.lit(0)).cast("int")


def rounded(value: Column, digits: int = 0) -> Column:
    """Half-even rounding."""
    return F.bround(value, digits)


def cell_text(*cells: Column) -> Column:
    """Composite cell key a,b,c,d."""
    return F.concat_ws(",", *[c.cast("string") for c in cells])


def is_sha256(value: Column) -> Column:
    return F.lower(F.trim(value)).rlike("^[0-9a-f]{64}$")


def nuisance_columns(width: Column, height: Column, size: Column) -> dict[str, Column]:
    """log1p of width, height, area and bytes, aspect ratio and bytes per pixel; zero denominators give null."""
    w, h, b = (c.cast(D) for c in (width, height, size))
    return {
        "log_width": F.log1p(w), "log_height": F.log1p(h), "log_area": F.log1p(w * h), "log_bytes": F.log1p(b),
        "aspect": F.try_divide(w, h), "bytes_per_pixel": F.try_divide(b, w * h),
    }


def display_columns(width: Column, height: Column, size: Column) -> dict[str, Column]:
    """megapixels, aspect_ratio, kilobytes."""
    w, h, b = (c.cast(D) for c in (width, height, size))
    return {"megapixels": w * h / F.lit(1e6), "aspect_ratio": F.try_divide(w, h), "kilobytes": b / F.lit(1024.0)}
