"""Declared schemas; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T

USER = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("screen_name", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("verified", T.BooleanType()),
])

# The raw post layout, in file order.
RAW_COLUMNS = (
    "created_at id id_str full_text truncated display_text_range entities metadata source "
    "in_reply_to_status_id in_reply_to_status_id_str in_reply_to_user_id in_reply_to_user_id_str "
    "in_reply_to_screen_name user geo coordinates place contributors retweeted_status is_quote_status "
    "retweet_count favorite_count favorited retweeted lang possibly_sensitive quoted_status_id "
    "extended_entities quoted_status_id_str quoted_status withheld_in_countries withheld_scope "
    "withheld_copyright"
).split()
RAW_SEPARATOR = ";"

_LONG = {"id", "in_reply_to_status_id", "in_reply_to_user_id", "retweet_count", "favorite_count",
         "quoted_status_id"}
_BOOLEAN = {"truncated", "is_quote_status", "favorited", "retweeted", "possibly_sensitive",
            "withheld_copyright"}
_DOUBLE = {"irrelevant"}


def column_type(name: str) -> T.DataType:
    """The type of a post column; columns outside the layout are read as text."""
    if name in _LONG:
        return T.LongType()
    if name in _BOOLEAN:
        return T.BooleanType()
    return T.DoubleType() if name in _DOUBLE else T.StringType()


RAW_POST = T.StructType([T.StructField(c, column_type(c)) for c in RAW_COLUMNS])

ANNOTATIONS = "full_text STRING, `NER-Tags` STRING, `NER-Words` STRING, rfind BOOLEAN"
EMBEDDING = "token STRING, vector ARRAY<FLOAT>"
