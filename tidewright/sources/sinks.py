"""Writers: gated parquet, samples and appended logs as csv, summaries as json, tables as markdown."""

from __future__ import annotations

import datetime
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.windows import missing

MOST_REPORT_ROWS = 10_000


def missing_shares(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Share of null or NaN values of each column, in one pass; 0 for an empty frame."""
    row = df.agg(*[F.avg(missing(c).cast("double")).alias(c) for c in columns]).first()
    return {c: row[c] or 0.0 for c in columns}


def gated_write(df: DataFrame, path: str, columns: list[str], limit: float = 0.05) -> dict[str, float]:
    """Writes parquet unless a column misses more than ``limit`` of its values; returns the columns that do, with their shares."""
    over = {c: s for c, s in missing_shares(df, columns).items() if s > limit}
    if not over:
        write_parquet(df, path)
    return over


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Overwrites ``path``; partition columns become directories that later scans can skip."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_sample_csv(df: DataFrame, path: str, n: int, seed: int, key: str) -> None:
    """A sample of n rows that the seed fixes, whatever the partitioning, with a header."""
    df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n).coalesce(1).write.mode("overwrite").csv(path, header=True)


def append_csv(df: DataFrame, path: str) -> None:
    """Appends rows; every file carries the header, quotes are doubled, so that commas and quotes in texts survive."""
    df.write.mode("append").option("escape", '"').csv(path, header=True)


def read_csv_log(spark, path: str, schema: str) -> DataFrame:
    """What append_csv wrote."""
    return spark.read.option("escape", '"').csv(path, header=True, schema=schema)


def _plain(v):
    if isinstance(v, float) and not math.isfinite(v):
        return None
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def json_summary(parts: dict[str, DataFrame], path: str) -> dict:
    """A json file of small result tables (at most MOST_REPORT_ROWS rows each) with the time of writing."""
    out: dict = {"written_at": datetime.datetime.now(datetime.timezone.utc).isoformat()}
    for name, df in parts.items():
        rows = df.limit(MOST_REPORT_ROWS + 1).collect()
        if len(rows) > MOST_REPORT_ROWS:
            raise ValueError(f"{name} has more than {MOST_REPORT_ROWS} rows")
        out[name] = [{k: _plain(v) for k, v in r.asDict().items()} for r in rows]
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, indent=1)
    return out


def _cell(v) -> str:
    if v is None:
        return "–"
    if isinstance(v, bool):
        return "yes" if v else "no"
    if isinstance(v, float):
        return "–" if math.isnan(v) else f"{v:.4g}" if abs(v) < 1e5 else f"{v:,.0f}"
    if isinstance(v, int):
        return f"{v:,}"
    return str(v).replace("|", "\\|").replace("\n", " ")


def markdown(title: str, tables: dict[str, DataFrame]) -> str:
    """A report of small tables in the order of their frames."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        rows = df.limit(MOST_REPORT_ROWS + 1).collect()
        if len(rows) > MOST_REPORT_ROWS:
            raise ValueError(f"{name} has more than {MOST_REPORT_ROWS} rows")
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join(_cell(v) for v in r) + " |" for r in rows]
        out.append("")
    return "\n".join(out)
