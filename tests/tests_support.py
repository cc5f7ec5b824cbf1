"""Comparison of query results."""

import datetime
import math


def plain(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.date().isoformat() if v.time() == datetime.time() else v.isoformat()
    return str(v)


def rows(table, columns):
    """The rows of an Arrow table as sorted texts."""
    return sorted("|".join(plain(x) for x in r) for r in zip(*[table.column(c).to_pylist() for c in columns]))
