"""Text files as expressions: charset, parts between blank lines, places. No Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip

#: The second charset, by its codec: what its upper half stands for, and the byte that stands for nothing.
UPPER = bytes(b for b in range(128, 256) if b != 0x98)
LATIN, SECOND, HOLE = UPPER.decode("latin-1"), UPPER.decode("cp1251"), "\x98"


def decoded(content: Column) -> Column:
    """text and error of the bytes of a file: UTF-8 or else Windows-1251; bytes that are neither have an error and no text."""
    plain, latin = content.cast("string"), F.decode(content, "ISO-8859-1")
    sound, hole = F.is_valid_utf8(plain), F.instr(latin, HOLE)
    said = F.format_string("UnicodeDecodeError: 'charmap' codec can't decode byte 0x98 in position %d: character maps to <undefined>", hole - 1)
    broken = ~sound & (hole > 0)
    return F.struct(F.when(sound, plain).when(~broken, F.translate(latin, LATIN, SECOND)).alias("text"), F.when(broken, said).alias("error"))


def encoded(text: Column) -> Column:
    """The Windows-1251 bytes of a text whose characters that charset has."""
    return F.encode(F.translate(text, SECOND, LATIN), "ISO-8859-1")


def parts(text: Column) -> Column:
    """What stands between blank lines, without blanks at its ends; blank parts are left out."""
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
