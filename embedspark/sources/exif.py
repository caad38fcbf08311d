"""Image metadata: a reader for EXIF blocks and the shaping of their values.

The reader turns payload bytes into an array of (tag, type, values) inside the row; shaping,
duplicate handling and the GPS rule are expressions on that array, so no step shuffles.
"""

from __future__ import annotations

import math
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from embedspark.functions.arrow import once_per_row

ENTRIES = T.ArrayType(
    T.StructType(
        [
            T.StructField("tag", T.StringType()),
            T.StructField("type", T.StringType()),
            T.StructField("values", T.ArrayType(T.StringType())),
        ]
    )
)

# Names of common tags by directory (EXIF 2.32). Others are named by number.
IMAGE_TAGS = {
    256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression",
    270: "ImageDescription", 271: "Make", 272: "Model", 274: "Orientation", 277: "SamplesPerPixel",
    282: "XResolution", 283: "YResolution", 296: "ResolutionUnit", 305: "Software", 306: "DateTime",
    315: "Artist", 33432: "Copyright", 33434: "ExposureTime", 33437: "FNumber",
    34850: "ExposureProgram", 34855: "PhotographicSensitivity", 36864: "ExifVersion",
    36867: "DateTimeOriginal", 36868: "DateTimeDigitized", 37377: "ShutterSpeedValue",
    37378: "ApertureValue", 37380: "ExposureBiasValue", 37383: "MeteringMode", 37385: "Flash",
    37386: "FocalLength", 37500: "MakerNote", 37510: "UserComment", 40960: "FlashpixVersion",
    40961: "ColorSpace", 40962: "PixelXDimension", 40963: "PixelYDimension", 41986: "ExposureMode",
    41987: "WhiteBalance", 42036: "LensModel",
}
GPS_TAGS = {
    0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef",
    4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 29: "GPSDateStamp",
}

# Field type number -> (name, bytes per value, struct code).
FIELD_TYPES = {
    1: ("byte", 1, "B"), 2: ("ascii", 1, None), 3: ("short", 2, "H"), 4: ("long", 4, "I"),
    5: ("rational", 8, "I"), 6: ("sbyte", 1, "b"), 7: ("undefined", 1, None), 8: ("sshort", 2, "h"),
    9: ("slong", 4, "i"), 10: ("srational", 8, "i"), 11: ("float", 4, "f"), 12: ("double", 8, "d"),
}
_EXIF_POINTER, _GPS_POINTER = 34665, 34853


def _number_text(value: float) -> str:
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "inf" if value > 0 else "-inf"
    return repr(value).replace("e-0", "e-").replace("e+", "e")


def _values(kind: int, count: int, body: bytes, order: str) -> list[str]:
    name, _, code = FIELD_TYPES[kind]
    if name == "ascii":
        text = body[:-1] if body.endswith(b"\0") else body
        return [part.decode("utf-8") for part in text.split(b"\0") if _is_text(part)]
    if name == "undefined":
        return [body.hex()]
    pairs = name.endswith("rational")
    numbers = struct.unpack(f"{order}{count * (2 if pairs else 1)}{code}", body)
    if pairs:
        out = []
        for top, bottom in zip(numbers[::2], numbers[1::2]):
            if bottom:
                out.append(_number_text(top / bottom))
            else:
                out.append("NaN" if top == 0 else _number_text(math.copysign(math.inf, top)))
        return out
    return [_number_text(n) if isinstance(n, float) else str(n) for n in numbers]


def _is_text(part: bytes) -> bool:
    try:
        part.decode("utf-8")
        return True
    except UnicodeDecodeError:
        return False


def _tiff_block(payload: bytes) -> bytes | None:
    """The TIFF structure of a JPEG (APP1), a PNG (eXIf) or a TIFF payload."""
    if payload[:4] in (b"II*\0", b"MM\0*"):
        return payload
    if payload[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(payload) and payload[at] == 0xFF and payload[at + 1] != 0xDA:
            size = int.from_bytes(payload[at + 2 : at + 4], "big")
            body = payload[at + 4 : at + 2 + size]
            if payload[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
                return body[6:]
            at += 2 + size
    if payload[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(payload):
            size = int.from_bytes(payload[at : at + 4], "big")
            if payload[at + 4 : at + 8] == b"eXIf":
                return payload[at + 8 : at + 8 + size]
            at += 12 + size
    return None


def _read_entries(payload: bytes) -> list[dict]:
    block = _tiff_block(payload)
    if block is None:
        return []
    order = {b"II": "<", b"MM": ">"}[block[:2]]
    out: list[dict] = []
    (first,) = struct.unpack_from(f"{order}I", block, 4)
    pending, seen = [(first, IMAGE_TAGS)], set()
    while pending:
        start, names = pending.pop(0)
        if not start or start in seen:
            continue
        seen.add(start)
        (entries,) = struct.unpack_from(f"{order}H", block, start)
        children = []
        for i in range(entries):
            at = start + 2 + 12 * i
            number, kind, count = struct.unpack_from(f"{order}HHI", block, at)
            if number in (_EXIF_POINTER, _GPS_POINTER):
                (child,) = struct.unpack_from(f"{order}I", block, at + 8)
                children.append((child, GPS_TAGS if number == _GPS_POINTER else IMAGE_TAGS))
                continue
            if kind not in FIELD_TYPES:
                continue
            size = FIELD_TYPES[kind][1] * count
            place = at + 8
            if size > 4:
                (place,) = struct.unpack_from(f"{order}I", block, at + 8)
            body = block[place : place + size]
            if len(body) < size:
                raise ValueError("truncated field")
            out.append(
                {
                    "tag": names.get(number, f"Tag({number:#06x})"),
                    "type": FIELD_TYPES[kind][0],
                    "values": _values(kind, count, body, order),
                }
            )
        (following,) = struct.unpack_from(f"{order}I", block, start + 2 + 12 * entries)
        pending = children + pending + ([(following, names)] if names is IMAGE_TAGS else [])
    return out


@once_per_row
@F.arrow_udf(ENTRIES)
def exif_entries(payload: pa.Array) -> pa.Array:
    """Fields of the EXIF block in file order; empty without a block or if it cannot be parsed."""
    rows = []
    for value in payload.to_pylist():
        try:
            rows.append(_read_entries(value) if value is not None else [])
        except Exception:
            rows.append([])
    entry = pa.struct([("tag", pa.string()), ("type", pa.string()), ("values", pa.list_(pa.string()))])
    return pa.array(rows, pa.list_(entry))


def _quoted(text: Column) -> Column:
    """JSON string, control characters escaped."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def shaped_value(entry: Column) -> Column:
    """JSON text of a field: one value is a scalar, several are an array.

    Text loses trailing NULs; numbers that are not finite become text; undefined bytes become hex
    text up to 32 bytes and a size note beyond.
    """
    kind, values = entry["type"], entry["values"]

    def one(value: Column) -> Column:
        finite = ~value.isin("inf", "-inf", "NaN")
        return (
            F.when(kind == "ascii", _quoted(F.regexp_replace(value, "\\x00+$", "")))
            .when(finite, value)
            .otherwise(_quoted(value))
        )

    hex_text = F.element_at(values, 1)
    size = (F.length(hex_text) / 2).cast("int")
    undefined = F.when(size <= 32, _quoted(hex_text)).otherwise(
        F.concat(F.lit('"<'), size.cast("string"), F.lit(' bytes>"'))
    )
    items = F.transform(values, one)
    listed = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    return (
        F.when(kind == "undefined", undefined)
        .when(F.size(values) == 1, F.element_at(items, 1))
        .otherwise(listed)
    )


def last_of_each_tag(entries: Column) -> Column:
    """Drops every field whose tag comes again later."""
    tags = F.transform(entries, lambda e: e["tag"])
    return F.filter(
        entries,
        lambda e, i: ~F.array_contains(F.slice(tags, i + 2, F.size(tags)), e["tag"]),
    )


def valid_gps(value: Column) -> Column:
    """Whether GPS JSON text holds a real position.

    Text with a known default pattern is invalid; an object is invalid when every latitude part is
    at most 1e-4, and valid when it has no latitude array; other values are valid.
    """
    is_text, is_object = value.startswith('"'), value.startswith("{")
    default = (
        value.contains("(0.0, 0.0, 0.0)")
        | value.contains("'1970:01:01'")
        | value.contains("0.0, 0.0, 0.0")
    )
    latitude = F.from_json(value, "GPSLatitude array<double>")["GPSLatitude"]
    real = F.coalesce(F.exists(latitude, lambda x: F.abs(x) > 1e-4), F.lit(True))
    return F.when(is_text, ~default).when(is_object, real).otherwise(F.lit(True))


def valid_gps_twin(value: Column) -> Column:
    """The stricter rule of the comparison runs: any text with ``0.0`` is invalid (also ``40.0``),
    objects need a non-zero latitude under key 2, and every other type is dropped."""
    is_text, is_object = value.startswith('"'), value.startswith("{")
    latitude = F.from_json(value, "`2` array<double>")["2"]
    real = F.coalesce(F.exists(latitude, lambda x: x != 0.0), F.lit(False))
    text_ok = ~(value.contains("'1970:01:01'") | value.contains("0.0"))
    return F.when(is_text, text_ok).when(is_object, real).otherwise(F.lit(False))


def exif_map(entries: Column) -> Column:
    """MAP<tag, JSON text> of the fields: last of equal tags, without an invalid GPSInfo."""
    shaped = F.transform(
        last_of_each_tag(entries),
        lambda e: F.struct(e["tag"].alias("key"), shaped_value(e).alias("value")),
    )
    kept = F.filter(shaped, lambda e: (e["key"] != "GPSInfo") | valid_gps(e["value"]))
    return F.map_from_entries(kept)


def with_exif(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds the ``exif`` map of a payload column and drops the payload."""
    read = df.withColumn("_entries", exif_entries(payload)).drop(payload)
    return read.withColumn("exif", exif_map(F.col("_entries"))).drop("_entries")
