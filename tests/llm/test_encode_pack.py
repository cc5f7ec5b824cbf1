"""Encoding, decoding and packing."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from tidewright.llm.encode import decode, encode, token_counts  # noqa: E402
from tidewright.llm.pack import PackParams, difference, fill, pack  # noqa: E402
from tidewright.llm.words import WHITE_SPACE, split  # noqa: E402

ODD = [
    None, "", " ", "\n\n", "  a  b ", "it's we're 'tis I'LL ''s '' 'll", "<|endoftext|> x<|endoftext|>", "日本語のテキスト。", "a b　c d", "\x00\x1b[31mred\x1b[0m\x1c", "🎉🎉🏽", "é́ ̈x", "١٢٣ ½ Ⅷ",
    "tab\tand  two", "x" * 300_000, " " * 50_000, "ab " * 60_000, "�?﻿", "a'sb 's's s's", "naïve café", "\r\n\r\n \t\n end",
]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def docs(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    return df.withColumns({"block": F.lit("clash"), "word": F.lit(1), "ids": F.lit(2), "size": F.lit(3)})


def test_split_equals_the_pattern():
    import random

    import regex

    space = "".join(f"\\U{c:08x}" for c in WHITE_SPACE)
    pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{space}\p{{L}}\p{{N}}]+|[{space}]+(?![^{space}])|[{space}]+")
    random.seed(5)
    signs = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "a", "é", "1", "!", "🎉", "　", "日", "'s", "\x1c", "v", "r", "e"]
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 12))) for _ in range(30_000)] + ODD
    words, before = split(pa.array(texts, pa.string()))
    words = words.to_pylist()
    for t, a, b in zip(texts, before, before[1:]):
        assert words[a:b] == (pattern.findall(t) if t else [])
    assert len(split(pa.array([], pa.string()))[0]) == 0 and len(split(pa.array([None, ""], pa.string()))[0]) == 0


def test_ids_equal_the_tokenizer_and_decode(spark, reference):
    rows = docs(spark, ODD * 2)
    ids = encode(rows)
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert len(got) == 2 * len(ODD)
    for i, t in enumerate(ODD * 2):
        assert list(got[i]) == reference(t)
    back = {r.doc_id: r.text for r in decode(ids).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD * 2))
    assert {r.doc_id: r.size for r in token_counts(rows).collect()} == {i: len(x) for i, x in got.items()}


def test_decoding_odd_ids(spark):
    rows = spark.createDataFrame([(1, [0, None, 10**6, -1, 1]), (2, None), (3, []), (4, [0])], "doc_id bigint, ids array<int>")
    assert [(r.doc_id, r.n_ids, r.text) for r in decode(rows).orderBy("doc_id").collect()] == [(1, 5, '!"'), (2, 0, ""), (3, 0, ""), (4, 1, "!")]
    assert decode(rows.limit(0)).count() == 0


def test_repeated_and_null_documents(spark, reference):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id bigint, text string")
    got = sorted(((r.doc_id or 0), list(r.ids)) for r in encode(rows).collect())
    assert got == sorted([(1, reference("a b")), (1, reference("a b")), (0, reference("c")), (0, [])])
    assert encode(rows.limit(0)).count() == 0 and token_counts(rows.limit(0)).count() == 0


def test_differencing_is_a_partition_and_balances():
    rng = np.random.default_rng(0)
    for n, k in ((1, 1), (5, 9), (40, 7), (300, 20)):
        sizes = rng.integers(1, 1000, n)
        total, windows = difference(sizes, k)
        assert sorted(i for w in windows for i in w) == list(range(n)) and len(windows) <= k
        assert [int(sizes[w].sum()) for w in windows] == [int(t) for t in total]
    assert max(total) - min(total) < 20
    best, _ = difference(np.array([8, 7, 6, 5, 4]), 2)
    assert max(best) <= 16


@pytest.mark.parametrize("seed", range(4))
def test_fill_is_tight(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(rng.lognormal(6, 1, 800).astype(int) + 1, 2048)
    windows = fill(sizes, 2048)
    assert sorted(i for w in windows for i in w) == list(range(800))
    assert max(int(sizes[w].sum()) for w in windows) <= 2048
    least = max(-(-int(sizes.sum()) // 2048), int((sizes > 1024).sum()))
    assert len(windows) <= 1.03 * least + 1


def test_containers_hold_every_token_once(spark):
    rng = np.random.default_rng(1)
    sizes = [0, None, 1, 512, 513, 1024, 5000, 7, 7, 7, *[int(x) for x in rng.integers(1, 1500, 300)]]
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)] + [(2, 1)], "doc_id bigint, size bigint").withColumns({"bucket": F.lit("clash"), "spec_name": F.lit("c")})
    specs = spark.createDataFrame([("short", 512), ("long", 8192), ("none", 0), ("null", None)], "spec_name string, capacity_tokens int")
    out = pack(items, specs, len(sizes), PackParams(bucket_docs=64)).collect()
    assert {r.spec_name for r in out} == {"short", "long"} and len({(r.spec_name, r.container_id) for r in out}) == len(out)
    for name, cap in (("short", 512), ("long", 8192)):
        pieces = []
        for r in (r for r in out if r.spec_name == name):
            assert r.used_tokens == sum(d.n_tokens for d in r.docs) <= cap and r.n_docs == len(r.docs) and r.fill == pytest.approx(r.used_tokens / cap)
            assert [(d.doc_id, d.from_token) for d in r.docs] == sorted((d.doc_id, d.from_token) for d in r.docs)
            pieces += [(d.doc_id, d.from_token, d.n_tokens) for d in r.docs]
        want = []
        for i, s in [*enumerate(sizes), (2, 1)]:
            if s:
                want += [(i, 0, s)] if s <= cap else [(i, a, min(cap, s - a)) for a in range(0, s, cap)]
        assert sorted(pieces) == sorted(want)
    assert pack(items.limit(0), specs, 0).count() == 0 and pack(items, specs.limit(0), 9).count() == 0


def test_best_fit_is_never_beaten_and_ties_go_to_differencing():
    from tidewright.llm.pack import _best_fit, raised

    for seed in range(3):
        rng = np.random.default_rng(seed)
        sizes = np.minimum(rng.lognormal(6, 1, 600).astype(int) + 1, 2048)
        alone = _best_fit([], [], list(range(len(sizes))), sizes, 2048)
        windows, pure = fill(sizes, 2048), raised(sizes, 2048)
        assert len(windows) <= len(alone)
        assert sorted(i for w in pure for i in w) == list(range(600)) and max(int(sizes[w].sum()) for w in pure) <= 2048
    assert fill(np.zeros(0, int), 512) == [] and raised(np.zeros(0, int), 512) == []


def test_equal_rows_do_not_meet_in_one_bucket(spark):
    items = spark.createDataFrame([(None, 300)] * 3000 + [(i, 100) for i in range(50)], "doc_id bigint, size bigint")
    specs = spark.createDataFrame([("s", 512)], "spec_name string, capacity_tokens int")
    out = pack(items, specs, 3050, PackParams(bucket_docs=256)).collect()
    assert sum(r.n_docs for r in out) == 3050 and sum(r.used_tokens for r in out) == 3000 * 300 + 5000 and max(r.used_tokens for r in out) <= 512
    buckets = [r.container_id >> 32 for r in out]
    assert len(set(buckets)) > 4 and max(buckets.count(b) for b in set(buckets)) < 1500


def test_blocks_do_not_follow_ids_and_exchanges_are_shared(spark, reference, tmp_path):
    from tidewright.llm.encode import with_blocks

    spark.createDataFrame([(None if i % 2 else 7, f"word{i} again and again") for i in range(4000)], "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    blocks, _ = with_blocks(df, 2000)
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert len(sizes) > 5 and max(sizes) < 3 * sum(sizes) / len(sizes)
    out = encode(df)
    assert sorted(tuple(r.ids) for r in out.collect()) == sorted(tuple(reference(f"word{i} again and again")) for i in range(4000))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan

