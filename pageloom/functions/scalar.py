"""Small scalar rules: names, escapes, times, sizes, severities, progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pystr import given, replace, strip

# Time stamps in file names, as (year, month, day, hour, minute, second), tried in this order.
NAME_TIMES = (r"(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})", r"(\d{4})-(\d{2})-(\d{2})_(\d{2})-(\d{2})-(\d{2})")
# Durations under a minute, under an hour, longer ones, and unknown ones.
DURATIONS = ("%ds", "%dm %ds", "%dh %dm", "--:--")
# The image types that are read.
IMAGE_TYPES = (".jpg", ".jpeg", ".png", ".webp")


def safe_filename(title: Column) -> Column:
    """Letters, digits, space, ``-`` and ``_`` stay, the rest becomes ``_``; ends stripped, spaces ``_``, at most 100 characters."""
    return F.left(replace(strip(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", "_")), " ", "_"), F.lit(100))


def normal_header(text: Column) -> Column:
    return F.upper(strip(text))


def escape_xml(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = replace(text, raw, entity)
    return text


def to_xhtml(html: Column) -> Column:
    """br, hr and img closed, bare ampersands escaped, control characters dropped."""
    html = F.regexp_replace(html, r"<(br|hr|img)([^/>]*)(?<!/)>", "<$1$2/>")
    html = F.regexp_replace(html, r"<img([^>]+)(?<!/)>", "<img$1/>")
    html = F.regexp_replace(html, r"&(?!#?[\p{L}\p{N}_]+;)", "&amp;")
    return F.regexp_replace(html, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def name_time(name: Column) -> Column:
    """The time stamp in a file name; an impossible one gives way to the next pattern, then null."""
    found = []
    for pattern in NAME_TIMES:
        part = [F.regexp_extract(name, pattern, i).try_cast("int") for i in range(1, 7)]
        valid = (part[0] >= 1) & (part[3] < 24) & (part[4] < 60) & (part[5] < 60)
        found.append(F.when(valid, F.try_make_timestamp_ntz(*part[:5], part[5].cast("decimal(8,6)"))))
    return F.coalesce(*found)


def exif_time(value: Column) -> Column:
    """``YYYY:MM:DD hh:mm:ss``, else null."""
    return F.try_to_timestamp(value, F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")


def capture_time(exif: Column, name: Column, modified: Column) -> Column:
    return F.coalesce(exif_time(exif), name_time(name), modified.cast("timestamp_ntz"))


def resized(width: Column, height: Column, target: int) -> tuple[Column, Column]:
    """The size with its shorter edge at most ``target``; 0 leaves it."""
    short = F.least(width, height)
    keep = F.lit(target <= 0) | (short <= target)
    scale = F.lit(float(max(target, 1))) / short
    return F.when(keep, width).otherwise((width * scale).cast("int")), F.when(keep, height).otherwise((height * scale).cast("int"))


def scaled(size: Column, scale: Column) -> Column:
    return (size * scale).cast("int")


def severity_of(confidence: Column) -> Column:
    confidence = F.coalesce(confidence, F.lit(0.0))
    return F.when(confidence > 0.8, "high").when(confidence > 0.5, "medium").otherwise("low")


def rate(done: Column, elapsed: Column) -> Column:
    return F.when(elapsed > 0, done / elapsed).otherwise(0.0)


def remaining(total: Column, done: Column, elapsed: Column) -> Column:
    """Seconds still to go; null before the first item."""
    return F.when(rate(done, elapsed) > 0, (total - done) / rate(done, elapsed))


def percent(total: Column, done: Column) -> Column:
    return F.when(total == 0, 100.0).otherwise(done / total * 100)


def duration(seconds: Column) -> Column:
    """``5s``, ``1m 30s``, ``1h 1m``; ``--:--`` for null."""
    whole = seconds.cast("double")
    short = F.format_string(DURATIONS[0], F.bround(whole).cast("bigint"))
    minutes = F.format_string(DURATIONS[1], F.floor(whole / 60), F.floor(F.pmod(whole, F.lit(60.0))))
    hours = F.format_string(DURATIONS[2], F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600.0)) / 60))
    return F.when(whole.isNull(), DURATIONS[3]).when(whole < 60, short).when(whole < 3600, minutes).otherwise(hours)


def one_decimal(x: Column) -> Column:
    """A number of at least 0 with one decimal, rounded as its exact binary value asks for, ties to even."""

    def rounded(s: Column) -> Column:
        x, tenths = s["x"], s["tenths"]
        # the sign of 20 x - (2 tenths + 1), without an error: 16 x and 4 x are exact, and so is what their sum leaves over
        a, b = x * 16.0, x * 4.0
        total = a + b
        back = total - a
        over = (total - (2 * tenths + 1)) + ((a - (total - back)) + (b - back))
        return tenths + F.when(over > 0, 1).when((over == 0) & (tenths % 2 == 1), 1).otherwise(0)

    n = given(given(x, lambda x: F.struct(x.alias("x"), F.floor(x * 10).alias("tenths"))), rounded)
    return given(n, lambda n: F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string")))


def units(text: Column, start: Column, end: Column | None = None) -> Column:
    """The part [start, end) of a text, in UTF-16 units as a browser counts them; an offset within a pair stands before it."""
    astral = text.rlike(r"[\x{10000}-\x{10ffff}]")
    raw = F.encode(text, "UTF-16BE")

    def byte(offset: Column) -> Column:
        second = F.hex(F.substring(raw, 2 * offset + 1, F.lit(1))).between("DC", "DF")
        return 2 * F.when(second & (offset > 0), offset - 1).otherwise(offset)

    size = F.length(text) if end is None else F.greatest(end - start, F.lit(0))
    bytes_ = F.length(raw) if end is None else F.greatest(byte(end) - byte(start), F.lit(0))
    return F.when(astral, F.decode(F.substring(raw, byte(start) + 1, bytes_), "UTF-16BE")).otherwise(F.substring(text, start + 1, size))


def spliced(text: Column, start: Column, end: Column, suggestion: Column) -> Column:
    """``suggestion`` in place of [start, end), in UTF-16 units; an empty one changes nothing."""
    return F.when(F.coalesce(F.length(suggestion), F.lit(0)) == 0, text).otherwise(F.concat(units(text, F.lit(0), start), suggestion, units(text, end)))


def sliced(text: Column, start: Column, end: Column) -> Column:
    return units(text, start, end)


def label(kind: Column) -> Column:
    return replace(kind, "_", " ")


def zoomed(zoom: Column, change: Column) -> Column:
    """A zoom in percent after a change, between 50 and 200."""
    return F.greatest(F.least(zoom + change, F.lit(200)), F.lit(50))


def page_progress(index: Column, total: Column) -> Column:
    """How far a reader on this page (from 0) is, in percent; 0 without pages."""
    return F.when(total > 0, (index + 1) / total * 100).otherwise(0.0)
