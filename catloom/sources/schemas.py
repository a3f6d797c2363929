"""Explicit schemas: fields may be missing in a file, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(spec: str) -> list[T.StructField]:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType()}
    return [T.StructField(name, kinds[kind]) for name, kind in (part.split(":") for part in spec.split())]


IMAGE = T.StructType(_fields("url:s source:s license:s caption:s is_hosted:b local_path:s"))
SOURCE = T.StructType(_fields("source:s source_id:s source_url:s retrieved_at:s"))
RATINGS = T.StructType(_fields("buildQuality:d value:d collectibility:d historicalSignificance:d"))
_ARRAYS = [T.StructField("images", T.ArrayType(IMAGE)), T.StructField("sources", T.ArrayType(SOURCE))]

ITEM = T.StructType(
    _fields(
        "id:s name:s manufacturer:s manufacturer_normalized:s manufacturer_country:s "
        "wikidata_qid:s flickr_id:s camera_type:s film_format:s "
        "year_introduced:i year_discontinued:i launch_date:s lens_mount:s shutter_speed_range:s "
        "metering:s weight_g:i dimensions:s battery:s "
        "price_launch_usd:d price_adjusted_usd:d price_market_usd:d "
        "price_launch_currency:s price_launch_source:s price_market_source:s description:s"
    )
    + [T.StructField("ratings", RATINGS)]
    + _ARRAYS
)

FILM = T.StructType(
    _fields("id:s name:s manufacturer:s manufacturer_normalized:s wikidata_qid:s film_type:s iso_speed:i is_current:b")
    + [T.StructField("available_formats", T.ArrayType(T.StringType()))]
    + _fields("year_introduced:i year_discontinued:i launch_date:s grain:s color_rendition:s description:s")
    + _ARRAYS
)

ENTITIES = {"cameras": ITEM, "films": FILM}
