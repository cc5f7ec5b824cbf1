"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, zero-width marks included.
SPACE = r"[\p{IsWhite_Space}\u200B\uFEFF]"


def canonical_ticker(ticker: Column) -> Column:
    """One spelling per ticker: outer white space dropped, upper case, ``.`` as the sign between root and class.

    A null stays null; a blank ticker becomes null, as it names nothing.
    """
    bare = F.regexp_replace(F.upper(ticker), f"^{SPACE}+|{SPACE}+$", "")
    out = F.regexp_replace(bare, rf"{SPACE}*[.\-/]{SPACE}*|{SPACE}+", ".")
    return F.when(out != "", out)


def instant(text: Column) -> Column:
    """ISO 8601 text as a UTC timestamp without zone; UTC unless an offset is given, null if it can't be read.

    Does not depend on the session's time zone.
    """
    bare = F.trim(text)
    zoned = F.when(bare.rlike(r"(Z|z|[+-]\d{2}:?\d{2})$") & bare.rlike(r"\d:\d"), bare).when(bare.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(bare, F.lit("T00:00:00Z"))).otherwise(F.concat(bare, F.lit("Z")))
    zoned = F.regexp_replace(F.upper(zoned), r"([+-]\d{2})(\d{2})$", "$1:$2")
    micros = F.unix_micros(zoned.try_cast("timestamp"))
    return from_micros(micros)


def from_micros(micros: Column) -> Column:
    """A TIMESTAMP_NTZ from microseconds since 1970, without the session's time zone."""
    seconds = (micros / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)
