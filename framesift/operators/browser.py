"""The rules that the browser build of the scan has of its own, beside the ones of ``assets``, ``bursts`` and ``ranking``.

Names group without regard to case and ids are 64-bit FNV-1a; every frame has a time; the span from a burst's first frame
always counts; frames with an error are among those to review; decisions that say what is suggested are forgotten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.operators import assets, bursts
from framesift.options import ScanOptions

LOW = (1 << 32) - 1


def code_units(text: Column) -> Column:
    """The UTF-16 units of a text."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    high, low = lambda p: 0xD800 + F.shiftright(p - 0x10000, 10), lambda p: 0xDC00 + (p - 0x10000).bitwiseAND(0x3FF)
    return F.flatten(F.transform(points, lambda p: F.when(p < 0x10000, F.array(p)).otherwise(F.array(high(p), low(p)))))


def fnv_id(text: Column) -> Column:
    """``web-`` and FNV-1a over UTF-16 units: h = (h xor unit) * (2^40 + 435) modulo 2^64.

    The hash is held as two halves of 32 bits, so that nothing overflows: 435 times the low half carries into the high
    one, and 2^40 times the low half adds to the high half alone.
    """
    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("high"), F.lit(0x84222325).cast("bigint").alias("low"))

    def step(h: Column, unit: Column) -> Column:
        low = h["low"].bitwiseXOR(unit)
        product = low * 435
        high = h["high"] * 435 + F.shiftright(product, 32) + F.shiftleft(low, 8).bitwiseAND(LOW)
        return F.struct(high.bitwiseAND(LOW).alias("high"), product.bitwiseAND(LOW).alias("low"))

    digits = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.aggregate(code_units(text), start, step, lambda h: F.concat(F.lit("web-"), digits(h["high"]), digits(h["low"])))


def natural_key(text: Column) -> Column:
    """A sort key that puts numbers in order of size and disregards case: runs of digits are written with their length first."""
    plain = F.lower(text)
    parts = F.regexp_extract_all(plain, F.lit(r"(\d+|\D+)"), 1)

    def part(p: Column) -> Column:
        digits = F.regexp_replace(p, r"^0+(?=\d)", "")
        return F.when(p.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 3, "0"), digits)).otherwise(p)

    return F.array_join(F.transform(parts, part), "\u0001")


def group_files(files: DataFrame) -> DataFrame:
    """Assets as the browser has them: (directory, stem) without case, spelled as in its first file; sorted by natural_key of id's path."""
    kept = files.withColumns({"__d": F.lower("directory"), "__s": F.lower("stem")})
    rank = F.when(F.col("kind") == "raw", 1).otherwise(0)
    entry = F.struct(rank.alias("rank"), "rel_path", "directory", "stem")
    grouped = kept.groupBy("__d", "__s").agg(F.sort_array(F.collect_list(F.when(F.col("kind") != "sidecar", entry))).alias("images"), F.count(F.lit(1)).alias("n_files"))
    first = F.element_at("images", 1)
    rows = grouped.where(F.size("images") > 0).select(first["rel_path"].alias("rel_path"), first["directory"].alias("directory"), first["stem"].alias("stem"), "n_files", (first["rank"] == 1).alias("raw_only"))
    return rows.withColumns({"id": fnv_id(F.col("rel_path")), "sort_key": natural_key(F.col("rel_path"))})


def split_bursts(frames: DataFrame, options: ScanOptions) -> DataFrame:
    """As in ``bursts``, with capture or modification time, which one of is always there."""
    timed = frames.withColumn("time_ms", F.coalesce("capture_ms", "modified_ms"))
    return bursts.split_bursts(assets.with_order_keys(timed), options)


def summarize(frames: DataFrame) -> DataFrame:
    """Counts of actions; errors are counted as review."""
    shown = F.when(F.col("action") == "error", "review").otherwise(F.col("action"))
    return frames.groupBy(shown.alias("action")).agg(F.count(F.lit(1)).alias("frames"))


def differing_decisions(decisions: DataFrame, frames: DataFrame) -> DataFrame:
    """Decisions worth keeping: those that differ from the suggestion."""
    suggested = frames.select(F.col("id").alias("asset_id"), "action")
    return decisions.join(suggested, "asset_id").where(F.col("decision").isNotNull() & (F.col("decision") != F.col("action"))).drop("action")
