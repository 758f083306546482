"""What an audio input is, and where it comes from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cantata.functions.text import strip

URL, BASE64, PATH = "url", "base64", "path"
#: A string without a separator that is longer than this is taken for base64.
LONGEST_NAME = 256


def is_url(c: Column) -> Column:
    """http or https, and a host."""
    return F.coalesce(F.regexp(c, F.lit(r"(?i)\Ahttps?://[^/?#]+")), F.lit(False))


def looks_like_base64(c: Column) -> Column:
    return F.coalesce(c.startswith("data:audio") | (~F.contains(c, F.lit("/")) & ~F.contains(c, F.lit("\\")) & (F.length(c) > LONGEST_NAME)), F.lit(False))


def route(c: Column) -> Column:
    return F.when(is_url(c), URL).when(looks_like_base64(c), BASE64).otherwise(PATH)


def base64_bytes(c: Column) -> Column:
    """Bytes of base64 text, a data URL's head left out; null where it isn't base64."""
    s = strip(c)
    return F.try_to_binary(F.when(s.startswith("data:") & F.contains(s, F.lit(",")), F.regexp_replace(s, r"\A[^,]*,", "")).otherwise(s), F.lit("base64"))


def data_url(mime: str, payload: Column) -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(payload), r"\s", ""))
