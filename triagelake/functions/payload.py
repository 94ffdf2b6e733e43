"""Windows event payload fields and entity decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.once import computed

_NAMED = {"&lt;": "<", "&gt;": ">", "&amp;": "&", "&quot;": '"', "&apos;": "'"}
_PIECES = r"(&(?:lt|gt|amp|quot|apos|#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,8});|[^&]+|&)"


def _decode_piece(piece: Column) -> Column:
    hexed = F.regexp_extract(piece, r"^&#[xX]([0-9A-Fa-f]+);$", 1)
    dec = F.regexp_extract(piece, r"^&#([0-9]+);$", 1)
    code = F.when(hexed != "", F.conv(hexed, 16, 10)).when(dec != "", dec).try_cast("long")
    ok = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(ok, code).otherwise(63)), 8, "0")), "UTF-32")
    out = F.when(ok, char).otherwise(piece)
    for ref, plain in _NAMED.items():
        out = F.when(piece == ref, F.lit(plain)).otherwise(out)
    return out


def decode_entities(text: Column) -> Column:
    """XML references to characters in one pass, so a decoded '&' is never decoded again."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECES), 1)
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, _decode_piece), "")).otherwise(text)


def with_payload(events: DataFrame) -> DataFrame:
    """Adds `payload` (map name -> decoded value, first well-formed element wins).

    Done once at ingest; the detections then read map keys instead of parsing again.
    """
    pattern = r'<Data Name="([^"]*)">([^<]*)</Data>'
    cut = computed(
        events,
        _n=F.regexp_extract_all("payload_xml", F.lit(pattern), 1),
        _v=F.regexp_extract_all("payload_xml", F.lit(pattern), 2),
    )
    keys = F.array_distinct("_n")

    def value(k: Column) -> Column:
        return decode_entities(F.element_at(F.col("_v"), F.array_position(F.col("_n"), k).cast("int")))

    # Lambdas are not compiled, and a look-up for each name is quadratic in the names: only rows that repeat a name need it,
    # and only rows with an ampersand need decoding.
    plain = F.when(F.col("payload_xml").contains("&"), F.transform("_v", decode_entities)).otherwise(F.col("_v"))
    values = F.when(F.size(keys) == F.size("_n"), plain).otherwise(F.transform(keys, value))
    return computed(cut, payload=F.map_from_arrays(keys, values)).drop("_n", "_v")


def with_fields(events: DataFrame, **fields: str) -> DataFrame:
    """Adds payload fields as columns (column name = field name); empty or missing gives null.

    Reads the parsed map when there is one, else cuts each field out of the text once.
    """
    if "payload" in events.columns:
        return computed(events, **{c: F.nullif(F.element_at("payload", F.lit(n)), F.lit("")) for c, n in fields.items()})
    raw = {c: F.regexp_extract("payload_xml", f'<Data Name="{n}">([^<]*)</Data>', 1).alias(f"_{c}") for c, n in fields.items()}
    cut = events.select("*", *raw.values())
    out = computed(cut, **{c: F.nullif(decode_entities(F.col(f"_{c}")), F.lit("")) for c in fields})
    return out.drop(*[f"_{c}" for c in fields])
