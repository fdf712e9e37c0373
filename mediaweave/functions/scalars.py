"""Column expressions. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaweave.functions.constants import EARTH_M

#: A date in its parts, or else whatever it is, without any.
DATE = r"^ *(\d{4}):(\d{1,2}):(\d{1,2}) (\d{1,2}:\d{1,2}:\d{1,2})\s*$|^[\s\S]*$"


def parse_date(raw: Column) -> Column:
    """YYYY:MM:DD HH:MM:SS to TIMESTAMP_NTZ; null where it isn't a date. raw is named once: an expression that names its
    column again and again makes a method too long for the JVM to compile."""
    return F.regexp_replace(raw, DATE, "$1-$2-$3 $4").try_cast("timestamp_ntz")


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a naive timestamp, in no time zone. ts is named once as well."""
    since = ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(since.cast("interval second").cast("decimal(18,6)")).cast("long")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def hash_bits(hex_: Column) -> Column:
    """Up to 16 hex digits as a signed 64-bit number; null where there is anything else."""
    return F.when(hex_.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(hex_, 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def photo_group(date: Column, lat: Column, lon: Column) -> Column:
    dated, placed = F.coalesce(date, F.lit("")) != "", lat.isNotNull() & lon.isNotNull()
    return F.when(dated & placed, "AB").when(placed, "GPS").when(dated, "DATE").otherwise("NONE")


def or_default(x: Column, default: float) -> Column:
    """Null and zero count as missing."""
    return F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(default))


def l1_score(blur: Column, exposure: Column) -> Column:
    sharp = F.least(or_default(blur, 0.0) / 500, F.lit(1.0))
    lit = F.greatest(F.lit(0.0), 1 - F.abs(or_default(exposure, 128.0) - 128) / 128)
    return 0.6 * sharp + 0.4 * lit


def l2_score(aesthetic: Column, blur: Column, exposure: Column) -> Column:
    blurred, badly_lit = F.coalesce(blur < 500, F.lit(False)), F.coalesce((exposure < 50) | (exposure > 220), F.lit(False))
    return or_default(aesthetic, 5.0) - F.when(blurred, 2.0).otherwise(0.0) - F.when(badly_lit, 1.0).otherwise(0.0)


def stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"\.[^.]*$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(length == 0, 1.0).otherwise(length))


def cosine(a: Column, b: Column) -> Column:
    return dot(l2_normalize(a), l2_normalize(b))


def affine_score(v: Column, weights: Column, bias: Column) -> Column:
    """An affine map of a vector, within 1 to 10."""
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), dot(v, weights) + bias))


def fold_layers(layers: list[tuple[list[list[float]], list[float]]]) -> tuple[list[float], float]:
    """The weights and the bias of one affine map that does what linear layers without activation do in turn."""
    import numpy as np

    w, b = np.eye(len(layers[0][0][0])), np.zeros(len(layers[0][0][0]))
    for weight, bias in layers:
        w, b = np.asarray(weight) @ w, np.asarray(weight) @ b + np.asarray(bias)
    return w[0].tolist(), float(b[0])


def effective_path(current: Column, original: Column) -> Column:
    return F.coalesce(F.nullif(current, F.lit("")), original)


def asset_key(content_hash: Column, path: Column) -> Column:
    return F.coalesce(F.substring(F.nullif(content_hash, F.lit("")), 1, 32), F.md5(F.coalesce(path, F.lit("")).cast("binary")))


def dms_to_decimal(degrees: Column, minutes: Column, secs: Column, ref: Column) -> Column:
    """Each part is a struct of num and den; a part that can't be divided gives null. S and W are negative."""
    value = F.try_divide(degrees["num"], degrees["den"]) + F.try_divide(minutes["num"], minutes["den"]) / 60 + F.try_divide(secs["num"], secs["den"]) / 3600
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def normalize_tags(tags: Column) -> dict[str, Column]:
    """Typed columns of a map of metadata tags."""

    def tag(name: str) -> Column:
        return F.nullif(F.trim(F.try_element_at(tags, F.lit(name))), F.lit(""))

    make, model = tag("Image Make"), tag("Image Model")
    number = lambda x: F.split(x, " ")[0].try_cast("int")
    return {
        "exif_date": F.coalesce(tag("EXIF DateTimeOriginal"), tag("EXIF DateTimeDigitized"), tag("Image DateTime")),
        "exif_camera": F.when(model.isNotNull(), F.trim(F.concat_ws(" ", make, model))),
        "exif_orientation": number(tag("Image Orientation")),
        "exif_width": number(tag("EXIF ExifImageWidth")),
        "exif_height": number(tag("EXIF ExifImageLength")),
    }


def has_cyrillic(text: Column) -> Column:
    return text.rlike("[Ѐ-ӿ]")


def bbox_normalize(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> list[Column]:
    """x, y, w and h as shares of the image."""
    return [x1 / width, y1 / height, (x2 - x1) / width, (y2 - y1) / height]
