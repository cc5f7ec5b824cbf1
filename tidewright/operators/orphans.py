"""References to records that do not exist, followed down a graph of foreign keys.

``orphan_cascade`` finds for each link the rows whose target is not there (direct orphans).  Then it goes round: the children of the
orphans found last are taken by a semi-join and asked again against the parents that are left; those without one are inherited
orphans.  Each round is written to the shared folder and counted, and the first round that adds nothing ends the cascade, so tables may refer
to themselves and links may form cycles.

Defined results
* A null or blank key refers to nothing and is an orphan (``missing``), as no record has that key.
* Repeated child rows are reported each; repeated parent rows count once.
* With times: a parent without a start is there always, without an end for ever; a parent whose end is not after
  its start is never there; a child without a time is taken at the end of time.
* Rows that refer to each other in a circle are there as long as none of them is an orphan by another link.
* Empty child: no rows.  Empty parent: every child row is an orphan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.settle import settle

#: ``test(child, parent)`` gives row_id, period and reason of the child rows (row_id, key, period, ...) without a parent.
Test = Callable[[DataFrame, DataFrame], DataFrame]
FAR = "timestamp_ntz'9999-12-31 23:59:59'"
OLD = "timestamp_ntz'0001-01-01 00:00:00'"


@dataclass(frozen=True)
class Link:
    """Rows of table ``child`` refer by ``child_key`` to ``parent_key`` of table ``parent``; ``test`` decides which have no target."""

    child: str
    parent: str
    test: Test
    child_key: str = "key"
    parent_key: str = "key"


def absent(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Child rows (row_id, key, period) whose key no parent row (key) has: row_id, period, reason ``missing``."""
    child = child.select("row_id", "key", "period")
    keys = parent.select("key").filter(F.col("key").isNotNull()).distinct()
    return child.join(keys, "key", "left_anti").select("row_id", "period", F.lit("missing").alias("reason"))


def absent_at(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Child rows (row_id, key, period, at) for whose key no parent row (key, start, until) is there at ``at``.

    Reasons: ``missing`` (no parent of the key at all), ``removed`` (one had started by then), ``later``.
    Parents are first reduced to their earliest start and the earliest start among those without an end, one row
    per key; only children that these two can't decide meet the ended intervals, and do so by a semi-join.
    """
    child, parent = child.select("row_id", "key", "period", "at"), parent.select("key", "start", "until")
    start = F.coalesce(F.col("start"), F.expr(OLD))
    rows = parent.filter(F.col("key").isNotNull()).select("key", start.alias("start"), "until")
    spans = rows.groupBy("key").agg(F.min("start").alias("first"), F.min(F.when(F.col("until").isNull(), F.col("start"))).alias("open"))
    ended = rows.filter(F.col("until").isNotNull() & (F.col("until") > F.col("start"))).withColumnRenamed("key", "_key").distinct()
    asked = child.withColumn("at", F.coalesce(F.col("at"), F.expr(FAR)))
    undecided = asked.join(spans, "key", "left").filter(F.col("open").isNull() | (F.col("at") < F.col("open")))
    inside = (F.col("key") == F.col("_key")) & (F.col("start") <= F.col("at")) & (F.col("at") < F.col("until"))
    cases = undecided.join(ended, inside, "left_anti")
    reason = F.when(F.col("first").isNull(), "missing").when(F.col("at") >= F.col("first"), "removed").otherwise("later")
    return cases.select("row_id", "period", reason.alias("reason"))


def orphan_cascade(tables: dict[str, DataFrame], links: list[Link]) -> DataFrame:
    """All orphans: child_table, row_id, period, parent_table, reason, inherited, round (0 for direct ones).

    tables: by name, each with the keys and columns that its links' tests use, those with a parent with a unique row_id and, if they
    are to be counted by it, a text ``period``.  A row that is an orphan by two links is reported for each.  Runs one job a
    round; at most as many rounds as the longest chain of orphans, and only children of new orphans take part in one.
    """
    names = {"_c": [x.child for x in links], "_p": [x.parent for x in links]}
    frames = {}
    for name in {*names["_c"], *names["_p"]}:
        df = tables[name]
        frames[name] = df if "period" in df.columns else df.withColumn("period", F.lit(None).cast("string"))

    def side(name: str, key: str) -> DataFrame:
        return frames[name] if key == "key" else frames[name].withColumn("key", F.col(key))

    def report(x: Link, cases: DataFrame, number: int) -> DataFrame:
        reason = F.lit("orphaned parent") if number else F.col("reason")
        head = [F.lit(x.child).alias("child_table"), "row_id", "period", F.lit(x.parent).alias("parent_table"), reason.alias("reason")]
        return cases.select(*head, F.lit(number > 0).alias("inherited"), F.lit(number).alias("round"))

    def close(parts: list[DataFrame], number: int) -> tuple[DataFrame, set[str]]:
        """The round as a table, and the tables that lost rows in it."""
        done = settle(reduce(DataFrame.unionByName, parts), f"orphans-{number}")
        return done, {r["child_table"] for r in done.select("child_table").distinct().collect()}

    last, hit = close([report(x, x.test(side(x.child, x.child_key), side(x.parent, x.parent_key)), 0) for x in links], 0)
    every, number = last, 0
    while again := [x for x in links if x.parent in hit]:
        number += 1
        parts = []
        for x in again:
            parent, child = side(x.parent, x.parent_key), side(x.child, x.child_key)
            new = last.filter(F.col("child_table") == x.parent).select("row_id").distinct()
            gone = every.filter(F.col("child_table") == x.parent).select("row_id").distinct()
            known = every.filter((F.col("child_table") == x.child) & (F.col("parent_table") == x.parent)).select("row_id").distinct()
            touched = parent.join(new, "row_id", "left_semi").select("key").filter(F.col("key").isNotNull()).distinct()
            asked = child.join(touched, "key", "left_semi").join(known, "row_id", "left_anti")
            parts.append(report(x, x.test(asked, parent.join(gone, "row_id", "left_anti")), number))
        last, hit = close(parts, number)
        every = every.unionByName(last)
    return every
