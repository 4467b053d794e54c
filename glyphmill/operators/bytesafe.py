"""Text from bytes that may not be UTF-8, before any string exists: ill-formed bytes are read as Windows-1252 or dropped.

The bytes are seen as Latin-1, a character each, so that patterns can find the well-formed sequences; all of it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Well-formed UTF-8 sequences, as Latin-1.
WELL_FORMED = r"[\x00-\x7F]+|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"
#: A character at which encoding repair starts: C1 controls and the lead letters of mojibake, in their UTF-8 bytes.
ANCHOR = r"\xC2[\x80-\x9F]|\xC3[\x82\x83\x85\x86\x8B\xA2]"


def _as_utf8(byte: int) -> str:
    """A lone byte's character in Windows-1252 (Latin-1 where that has none), its UTF-8 bytes seen as Latin-1."""
    try:
        ch = bytes([byte]).decode("cp1252")
    except UnicodeDecodeError:
        ch = chr(byte)
    return ch.encode().decode("latin-1")


def text_of(raw: Column, repair: bool = True) -> Column:
    """The string of a binary column. With repair, ill-formed bytes of a row that has an anchor for encoding repair are read as
    Windows-1252; other ill-formed bytes go. Null stays null."""
    latin = F.decode(raw, "ISO-8859-1")
    parts = F.regexp_extract_all(latin, F.lit(f"{WELL_FORMED}|[\\x80-\\xFF]"), F.lit(0))
    lone = F.map_from_arrays(F.array(*[F.lit(chr(b)) for b in range(0x80, 0x100)]), F.array(*[F.lit(_as_utf8(b)) for b in range(0x80, 0x100)]))
    single = lambda x: (F.length(x) == 1) & x.rlike(r"^[\x80-\xFF]$")
    kept = F.filter(parts, lambda x: ~single(x))
    out = F.array_join(kept, "")
    if repair:
        read = F.array_join(F.transform(parts, lambda x: F.when(single(x), F.try_element_at(lone, x)).otherwise(x)), "")
        out = F.when(out.rlike(ANCHOR), read).otherwise(out)
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.encode(out, "ISO-8859-1").cast("string"))
