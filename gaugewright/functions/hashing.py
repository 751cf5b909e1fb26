"""Deterministic hashes as column expressions: orders, priorities, seeds and digests that no partitioning can change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = "decimal(20,0)"


def text(value: Column | str | int) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(str(value))


def json_escaped(value: Column) -> Column:
    """The JSON string literal of ASCII text, as compact encoders write it; other characters become \\u escapes."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(code))
    return F.concat(F.lit('"'), F.when(F.char_length(escaped) == F.octet_length(escaped), escaped).otherwise(_unicode_escaped(escaped)), F.lit('"'))


def _unicode_escaped(value: Column) -> Column:
    """Characters beyond ASCII as UTF-16 code units in lower-case hex."""
    units = lambda x: F.regexp_replace(F.lower(F.hex(F.encode(x, "UTF-16BE"))), "([0-9a-f]{4})", r"\\u$1")
    return F.array_join(F.transform(F.split(value, ""), lambda x: F.when(F.octet_length(x) <= 1, x).otherwise(units(x))), "")


def stable_hash(*parts: Column | str | int) -> Column:
    """SHA-256 hex of the compact JSON array of the parts as strings."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *[json_escaped(text(p)) for p in parts]), F.lit("]")), 256)


def joined_hash(separator: str, *parts: Column | str | int) -> Column:
    """SHA-256 hex of the parts joined by a separator."""
    return F.sha2(F.concat_ws(separator, *[text(p) for p in parts]), 256)


def uint64(digest: Column) -> Column:
    """The first 8 digest bytes as an unsigned integer."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast(U64)


def seed32(base_seed: int, value: Column | str) -> Column:
    """First 8 digest bytes of base_seed:value modulo 2 ** 32."""
    return F.pmod(uint64(joined_hash(":", base_seed, value)), F.lit(1 << 32).cast(U64)).cast("long")


def step_seed(base_seed: int, parent: Column, token: Column, occurrence: Column) -> Column:
    """Seed of a recipe step that doesn't depend on its place in the recipe."""
    return F.pmod(uint64(joined_hash(":", base_seed, parent, token, occurrence)), F.lit(1 << 32).cast(U64)).cast("long")


def in_fifth(*parts: Column | str | int) -> Column:
    """True for the fifth of keys whose hash is divisible by five."""
    return F.pmod(uint64(joined_hash(":", *parts)), F.lit(5).cast(U64)) == 0


def priority128(*parts: Column | str | int) -> Column:
    """The first 16 digest bytes as 32 hex digits, whose order is the number's."""
    return F.substring(joined_hash(":", *parts), 1, 32)


def sample_order(seed: int, dataset: Column, parent: Column) -> Column:
    """NUL-separated order key."""
    return joined_hash("\0", seed, dataset, parent)


def derived_parent_id(dataset: Column, path: Column) -> Column:
    """dataset-<20 hex digits>."""
    return F.concat(text(dataset), F.lit("-"), F.substring(F.sha2(F.concat(text(dataset), F.lit(":"), text(path)), 256), 1, 20))


def row_digest(*parts: Column | str) -> Column:
    """Twenty hex digits of the pipe-joined fields."""
    return F.substring(joined_hash("|", *parts), 1, 20)


def ordered_digest(df: DataFrame, columns: list[str], separator: str = "\n") -> DataFrame:
    """One row: SHA-256 of the sorted rows (X10), in two levels so that no task holds them all.

    Rows are hashed and counted in 4096 hash ranges; each range's sorted row hashes become one hash, and the digest is of
    those. It depends on the rows alone, not on their order or partitioning.
    """
    row = F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in columns]), 256)
    ranges = df.select(row.alias("h")).groupBy(F.substring("h", 1, 3).alias("r")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), separator), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    return ranges.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "d"))), lambda x: x["d"]), separator), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def file_digest(binary_files: DataFrame) -> DataFrame:
    """path, sha256, bytes of a binaryFile scan."""
    return binary_files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
