"""A list of languages that is too long raises instead of losing some."""

import pytest

from tidewright.llm import plans


def test_too_many_languages_raise(spark, tmp_path):
    rows = [(f"l{i:04}", f"L{i}") for i in range(plans.MOST_LANGUAGES + 1)]
    spark.createDataFrame(rows, "lang string, lang_name string").write.parquet(str(tmp_path / "lang_list.parquet"))
    with pytest.raises(ValueError, match="more than 1000 languages"):
        plans.p8_documents(spark, str(tmp_path))
