"""Scalar functions of the frame model as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions by kind.
RAW = "3fr arw cr2 cr3 dcr dng erf fff iiq kdc mef mos mrw nef nrw orf pef raf raw rw2 rwl sr2 srf x3f".split()
COMPRESSED = "avif bmp gif heic heif jpeg jpg jxl png tif tiff webp".split()
SIDECAR = "aae dop json pp3 xmp".split()
VIEWABLE = "jpg jpeg png gif webp bmp".split()


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def halves(x: Column) -> tuple[Column, Column]:
    """A double as the sum of two of 26 bits, whose products are exact."""
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    return high, x - high


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, rounded from its exact binary value; what lies just half-way goes to the even one.

    0.35 is a little less than it looks, so it gives 0.3. The product with the power of ten is taken with its rounding error:
    product + error is exact, and the fraction of the sum decides. From 2^52 on, scaled, a number has no fraction.
    """
    scale = F.lit(float(10**digits))
    size = F.abs(x.cast("double"))
    (a, b), (c, d) = halves(size), halves(scale)
    product = size * scale
    error = ((a * c - product) + a * d + b * c) + b * d
    whole = F.floor(product).cast("double")
    over = (product - whole - 0.5) + error
    odd = whole - 2 * F.floor(whole / 2).cast("double") == 1
    number = F.when(product >= 2.0**52, product).otherwise(whole + F.when((over > 0) | ((over == 0) & odd), 1.0).otherwise(0.0))
    text = F.format_string(f"%.{digits}f", number / scale)
    signed = F.when(x < 0, F.concat(F.lit("-"), text)).otherwise(text)
    odd_ones = F.when(F.isnan(x.cast("double")), "NaN").when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
    return F.when(x.isNotNull(), F.coalesce(odd_ones, signed))


# -- names and paths ---------------------------------------------------------------------------------------------------


def relative_path(path: Column, root: str) -> Column:
    """The path under root, with forward slashes."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    prefix = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(plain.startswith(prefix), F.substring(plain, F.lit(len(prefix) + 1), F.length(plain))).otherwise(plain)


def file_name(rel_path: Column) -> Column:
    return F.element_at(F.split(rel_path, "/"), -1)


def directory(rel_path: Column) -> Column:
    """What stands before the last slash, '' for none."""
    return F.regexp_extract(rel_path, r"^(?s)(.*)/[^/]*\z", 1)


def extension(name: Column) -> Column:
    """Lower-case, without the dot; null for names without one or that only begin with one."""
    return F.lower(F.nullif(F.regexp_extract(name, r"(?s)^.+\.([^.]*)\z", 1), F.lit("")))


def stem(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?\z", 1)


def file_kind(ext: Column) -> Column:
    return F.when(ext.isin(RAW), "raw").when(ext.isin(COMPRESSED), "compressed").when(ext.isin(SIDECAR), "sidecar")


def stem_prefix(stem: Column) -> Column:
    """The stem without the digits, of any script, that end it."""
    return F.regexp_replace(stem, r"(?U)\d+\z", "")


def stem_sequence(stem: Column) -> Column:
    """The number at the end of a stem; null without one, for digits outside ASCII, and beyond 64 bits."""
    digits = F.regexp_extract(stem, r"(?U)(\d+)\z", 1)
    return F.when(digits.rlike(r"^[0-9]+\z"), digits.try_cast("bigint"))


def stable_id(rel_path: Column) -> Column:
    return F.substring(F.sha1(rel_path.cast("binary")), 1, 16)


# -- times ---------------------------------------------------------------------------------------------------------------


def exif_millis(text: Column, subsec: Column, offset: Column) -> Column:
    """EXIF ``Y:M:D h:m:s`` with fractions of a second and offset ``+hh:mm``, as epoch ms in UTC; what can't be read is ignored,
    a bad date gives null."""
    at = F.try_to_timestamp(F.trim(text), F.lit("yyyy:MM:dd HH:mm:ss"))
    digits = F.when(F.trim(subsec).rlike("^[0-9]+$"), F.trim(subsec))
    fraction = F.coalesce(F.floor(F.concat(F.lit("0."), digits).try_cast("double") * 1000 + 1e-9), F.lit(0))
    sign = F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
    valid = offset.rlike(r"^[+-][0-9]{2}:[0-9]{2}$")
    minutes = F.when(valid, sign * (F.substring(offset, 2, 2).try_cast("bigint") * 60 + F.substring(offset, 5, 2).try_cast("bigint")))
    return F.unix_millis(at) + fraction - F.coalesce(minutes, F.lit(0)) * 60_000


def capture_source(exif: Column, created: Column, modified: Column) -> Column:
    return F.when(exif.isNotNull(), "exif").when(created.isNotNull(), "filesystem_created").when(modified.isNotNull(), "filesystem_modified").otherwise("unavailable")


def shutter_text(seconds: Column) -> Column:
    """``1/Ns`` where that has N of 2 or more, else at most two decimals without trailing zeros; '' for nothing positive.

    From ten seconds on the text has no decimals, and trailing zeros go even so (30 s is '3s'), as existing exports have it.
    """
    parts = F.round(1 / F.when(seconds > 0, seconds)).cast("bigint")
    decimals = F.when(seconds >= 10, fixed(seconds, 0)).otherwise(fixed(seconds, 2))
    plain = F.concat(F.regexp_replace(F.regexp_replace(decimals, r"0+$", ""), r"\.$", ""), F.lit("s"))
    return F.when(seconds.isNull() | (seconds <= 0), "").when((seconds < 1) & (parts >= 2), F.format_string("1/%ds", parts)).otherwise(plain)


def bytes_text(n: Column, largest: str = "TiB") -> Column:
    """A size with one decimal in the unit that keeps it under 1024, or in the largest one."""
    units = ["B", "KiB", "MiB", "GiB", "TiB"]
    last = units.index(largest)
    out = F.concat(fixed(n / 1024.0**last, 1), F.lit(f" {largest}"))
    for i in reversed(range(last)):
        out = F.when(n < 1024.0 ** (i + 1), F.concat(fixed(n / 1024.0**i, 1), F.lit(f" {units[i]}"))).otherwise(out)
    return out


# -- hashes, boxes and image scores ----------------------------------------------------------------------------------------


def hash_distance(a: Column, b: Column) -> Column:
    """Bits that differ between two hashes of up to 16 hex digits; 64 where either is none."""
    valid = a.rlike("^[0-9a-fA-F]{1,16}$") & b.rlike("^[0-9a-fA-F]{1,16}$")
    half = lambda x, at: F.conv(F.substring(F.lpad(x, 16, "0"), at, 8), 16, 10).cast("bigint")
    bits = F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))
    return F.when(valid, bits).otherwise(64)


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(54 * r + 183 * g + 19 * b + 128, 8)


def exposure_score(clipped: Column, mean: Column) -> Column:
    """clipped: share of pixels outside 3..252; mean luma in [0, 1]."""
    return 1 - F.least(F.lit(1.0), 6 * clipped + 0.35 * F.least(F.lit(1.0), F.abs(mean - 0.52) / 0.52))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes (x0, y0, x1, y1) held to the unit square; 0 for an empty union."""
    a, b = [clamp(x, 0.0, 1.0) for x in a], [clamp(x, 0.0, 1.0) for x in b]
    side = lambda low, high: F.greatest(high - low, F.lit(0.0))
    both = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    union = side(a[0], a[2]) * side(a[1], a[3]) + side(b[0], b[2]) * side(b[1], b[3]) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def merged_confidence(own: Column, detected: Column, count: Column) -> Column:
    """A detection that found something raises the object confidence."""
    return F.when((detected > 0) & (count > 0), F.greatest(own, detected)).otherwise(own)


def merged_completeness(own: Column, detected: Column, count: Column, risk: Column) -> Column:
    return F.when((detected > 0) & (count > 0), 0.62 * own + 0.38 * (1 - risk)).otherwise(own)


def needs_refinement(gain: Column, magnification: Column, scale: Column) -> Column:
    """Whether a zoomed preview would show more at a higher resolution; false for anything not finite or positive."""
    sound = gain.isNotNull() & ~F.isnan(gain) & ~F.isnan(magnification * scale) & (magnification > 0) & (scale > 0)
    return F.coalesce(sound & (gain >= 1.15) & (magnification * scale > 1.05), F.lit(False))


def progress_fraction(low: Column, high: Column, current: Column, total: Column) -> Column:
    """Overall progress within a stage's bounds; a stage of nothing is done."""
    part = F.when(total <= 0, 1.0).otherwise(clamp(current / F.greatest(total, F.lit(1)), 0.0, 1.0))
    return low + (high - low) * part


def final_action(decision: Column, suggested: Column) -> Column:
    """For exports: the user's decision, else the suggestion, errors included."""
    return F.coalesce(decision, suggested)


def operation_action(decision: Column, suggested: Column) -> Column:
    """For file operations: an error without a decision is to be reviewed."""
    return F.coalesce(decision, F.when(suggested == "error", "review").otherwise(suggested))
