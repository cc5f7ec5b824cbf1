"""Queries p5 to p8 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.digest import RANK_BOUND, certified, digests, merge
from tidewright.llm.encode import decode, encode, token_counts
from tidewright.llm.langid import detect, label_cases
from tidewright.llm.pack import pack
from tidewright.sources.tables import table


PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
BY = ["universe_variant", "column_name"]


def _values(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "m2_setups_with_features")
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in ("vol_contraction_ratio", "adr_pct")])
    return rows.select("universe_variant", "load_id", F.explode(each).alias("c")).select("universe_variant", "load_id", "c.*")


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per variant as written, from digests per load, with their certified rank errors."""
    values = _values(spark, d)
    summaries = merge(digests(values, ["universe_variant", "load_id", "column_name"], "value"), BY)
    return certified(values, BY, "value", summaries, PROBS)


def p5_certified(spark: SparkSession, d: str) -> DataFrame:
    """Whether each rank error is within the bound (or below one row), and the rows that it stands for."""
    return p5_percentiles(spark, d).select(*BY, "p", "n", (F.col("rank_error") * F.col("n") <= F.greatest(RANK_BOUND * F.col("n"), F.lit(1.0))).alias("within"))


def p5_load_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The digests that are kept, per variant, load and column."""
    return digests(_values(spark, d), ["universe_variant", "load_id", "column_name"], "value")


def p5_load_ranges(spark: SparkSession, d: str) -> DataFrame:
    """What the kept digests say exactly: rows, extremes, and whether the weights add up to the rows."""
    total = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w)
    return p5_load_summaries(spark, d).select("universe_variant", "load_id", "column_name", "n", "least", "most", (total == F.col("n")).alias("whole"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whether decoding each document's ids gives its text back, and the characters of what they give."""
    docs = table(spark, d, "documents")
    back = decode(encode(docs)).select("doc_id", F.xxhash64("text").alias("_back"), F.length("text").alias("_length"))
    text = F.coalesce("text", F.lit(""))
    kept = docs.select("doc_id", F.xxhash64(text).alias("_text"), F.length(text).alias("_chars"))
    return kept.join(back, "doc_id").select("doc_id", F.col("_length").cast("bigint").alias("n_chars"), ((F.col("_back") == F.col("_text")) & (F.col("_length") == F.col("_chars"))).alias("same"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return pack(token_counts(docs), table(spark, d, "container_specs"), docs.count())


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    """Containers per capacity beside the least number that could hold the tokens."""
    c = p7_containers(spark, d)
    out = c.groupBy("spec_name", "capacity_tokens").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used_tokens").alias("used_tokens"), F.sum("n_docs").alias("n_pieces"), F.avg("fill").alias("mean_fill"))
    return out.withColumn("least_containers", F.ceil(F.col("used_tokens") / F.col("capacity_tokens")))


MOST_LANGUAGES = 1000


def _detected(spark: SparkSession, d: str) -> DataFrame:
    languages = [(r[0], r[1]) for r in table(spark, d, "lang_list").select("lang", "lang_name").filter(F.col("lang").isNotNull()).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return detect(table(spark, d, "documents"), languages)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return label_cases(_detected(spark, d))


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    """Main language (null: rejected) and confidence of each document, beside what its label names."""
    rejected = F.size(F.filter("cells", lambda c: c["lang"].isNull()))
    return _detected(spark, d).select("doc_id", "label", "main", F.round("confidence", 4).alias("confidence"), F.size("cells").alias("n_cells"), rejected.alias("n_rejected"))


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of each text cell."""
    cells = _detected(spark, d).select("doc_id", F.explode("cells").alias("c"))
    return cells.select("doc_id", "c.cell_no", "c.lang", F.round("c.confidence", 4).alias("confidence"), "c.chars", "c.reason")


QUERIES = {"p5_percentiles": p5_percentiles, "p5_certified": p5_certified, "p5_load_summaries": p5_load_summaries, "p5_load_ranges": p5_load_ranges, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_containers": p7_containers, "p7_summary": p7_summary, "p8_found": p8_found, "p8_documents": p8_documents, "p8_segments": p8_segments}
SQL: dict[str, str] = {
    "p5_load_ranges": """select universe_variant, load_id, column_name, count(*) as n, min(v) as least, max(v) as most, true as whole from (
        select universe_variant, load_id, 'vol_contraction_ratio' as column_name, vol_contraction_ratio as v from m2_setups_with_features
        union all select universe_variant, load_id, 'adr_pct', adr_pct from m2_setups_with_features) t where v is not null and isfinite(v) group by all""",
    "p6_round_trip": "select doc_id, length(coalesce(text, '')) as n_chars, true as same from documents",
    "p5_certified": """select universe_variant, column_name, p, count(*) as n, true as within from (
        select universe_variant, 'vol_contraction_ratio' as column_name, vol_contraction_ratio as v from m2_setups_with_features
        union all select universe_variant, 'adr_pct', adr_pct from m2_setups_with_features) t,
        (select unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::double as p) where v is not null and isfinite(v) group by all""",
}
