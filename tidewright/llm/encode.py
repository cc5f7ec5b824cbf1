"""Encoding of a whole corpus with a public byte-level BPE vocabulary, and decoding.

Method: a table of distinct words.  Words are split in Spark jobs (:mod:`tidewright.llm.words`), each distinct word of
the corpus is encoded once, and its ids are joined back by position.  Joining every occurrence would shuffle the corpus
many times over, so documents are laid out in blocks of a few megabytes: a block sends its distinct words, gets
(word, ids) back from the join with the word table, and ids are then placed by position inside the block.

Shuffles: the texts once (by block; the exchange serves both passes), (block, word) pairs by word, and by block with their ids.

Defined results
* Null and empty texts give an empty list (size 0).  Texts that look like special tokens are ordinary text.
* Every row gets its own result, repeated doc_ids included; a null doc_id stays null.  Extra columns are ignored.
* An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.words import split

CHUNK = 4 << 20  #: bytes of text that are split at a time
TASK_BYTES = 8 << 20  #: bytes of input behind one task of a shuffle
MOST_TASKS = 200_000


def default_vocabulary() -> str:
    """Path of byte_bpe_50k in rank form, of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_pieces(path: str) -> list[tuple[bytes, int]]:
    """(piece, id) of a rank file; its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]


@cache
def _bpe(path: str):
    """The merger of single words, once per Python worker."""
    import tiktoken

    # the pattern is not used, as words arrive already split
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=dict(read_pieces(path)), special_tokens={})._core_bpe


def file_bytes(df: DataFrame) -> int | None:
    """Estimated bytes of the plan's inputs, without a job; None if Spark doesn't know."""
    try:
        n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # no JVM plan at hand
        return None
    return n if n < 1 << 60 else None


def with_blocks(docs: DataFrame, block_bytes: int = 4 << 20) -> tuple[DataFrame, int]:
    """doc_id, text, block: documents in blocks of about ``block_bytes`` of input, which bounds what one task holds; and the number of tasks.

    Blocks go by a hash of id and text, so that null, repeated or hot ids do not pile up in one; only rows equal in both share a block.
    """
    spark = docs.sparkSession
    known, least = file_bytes(docs), int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, -(-known // block_bytes)) if known else 8 * least
    tasks = max(least, min(-(-known // TASK_BYTES), MOST_TASKS)) if known else 8 * least
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))
    return docs.select("doc_id", "text", block.alias("block")).repartition(tasks, "block"), tasks


def _pieces_of(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices of about CHUNK bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    at, ends = 0, np.cumsum(sizes)
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        yield texts.slice(at, to - at)
        at = to


def _as_string(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.cast(pa.string()) if whole.type != pa.string() else whole


def block_words(blocks: DataFrame) -> DataFrame:
    """block, word: the distinct words of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, found = None, []

        def flush() -> pa.RecordBatch:
            words = pc.unique(pa.concat_arrays(found))
            return pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(words), block)), "word": words})

        for batch in batches:
            ids = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if ids[a] != block:
                    if found:
                        yield flush()
                    block, found = int(ids[a]), []
                for part in _pieces_of(_as_string(batch.column("text")).slice(a, b - a)):
                    words, _ = split(part)
                    if len(words):
                        found.append(pc.unique(words))
                if len(found) > 8:
                    found = [pc.unique(pa.concat_arrays(found))]
        if found:
            yield flush()

    return blocks.sortWithinPartitions("block").mapInArrow(run, "block bigint, word string")


def word_ids(pairs: DataFrame, vocabulary: str, tasks: int, counts: bool = False) -> DataFrame:
    """block, word, ids (int32 as bytes; with ``counts`` their number): each distinct word encoded once.

    The pairs are hashed and sorted by word.  The distinct words of a partition are its part of the word table, and the
    join of the table with the pairs is the repetition of its entries over each word's run of pairs, which saves sending
    the table.  A word has one row per block, so no word is hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocabulary)
        last, got = None, b""  # a run may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("word").dictionary_encode()
            table = coded.dictionary.to_pylist()
            lists = [got if w == last else np.array(bpe.encode_single_piece(w.encode()), dtype=np.int32).tobytes() for w in table]
            end = coded.indices[len(coded) - 1].as_py()
            last, got = table[end], lists[end]
            values = pa.array([len(x) // 4 for x in lists], pa.int32()) if counts else pa.array(lists, pa.binary())
            yield pa.RecordBatch.from_pydict({"block": batch.column("block"), "word": batch.column("word"), "ids": values.take(coded.indices)})

    return pairs.repartition(tasks, "word").sortWithinPartitions("word").mapInArrow(run, f"block bigint, word string, ids {'int' if counts else 'binary'}")


def _lists(column: pa.ChunkedArray) -> pa.ListArray:
    """Binary values as lists of int32, in place."""
    whole = column.combine_chunks()
    if whole.offset or whole.null_count:
        whole = pa.array(whole.to_pylist(), pa.binary())
    if not len(whole):
        return pa.array([], pa.list_(pa.int32()))
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int32, count=len(whole) + 1)
    values = np.frombuffer(whole.buffers()[2], dtype=np.int32, count=int(offsets[-1]) // 4)
    return pa.ListArray.from_arrays(pa.array(offsets // 4), pa.array(values))


def _placed(docs: DataFrame, vocabulary: str | None, counts: bool) -> DataFrame:
    """Ids, or their number, of each row, through the word table."""
    vocabulary = vocabulary or default_vocabulary()
    blocks, tasks = with_blocks(docs)
    known = word_ids(block_words(blocks), vocabulary, tasks, counts)

    def place(texts: pa.Table, known: pa.Table) -> pa.Table:
        words = _as_string(known.column("word"))
        ids = known.column("ids").combine_chunks() if counts else _lists(known.column("ids"))
        out = []
        for part in _pieces_of(_as_string(texts.column("text"))):
            got, before = split(part)
            at = pc.index_in(got, value_set=words) if len(got) else pa.array([], pa.int32())
            if counts:
                total = np.concatenate([[0], np.cumsum(np.asarray(ids.take(at), dtype=np.int64))])
                out.append(pa.array(total[before[1:]] - total[before[:-1]]))
            else:
                lists = ids.take(at)
                ends = np.asarray(lists.offsets)[before] if len(at) else np.zeros(len(before), np.int64)
                out.append(pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), lists.flatten()))
        return pa.table({"doc_id": texts.column("doc_id"), "size" if counts else "ids": pa.chunked_array(out)})

    schema = "doc_id bigint, size bigint" if counts else "doc_id bigint, ids array<int>"
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(place, schema)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) of ``docs`` (doc_id, text)."""
    return _placed(docs, vocabulary, False)


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, size: the number of ids of each document."""
    return _placed(docs, vocabulary, True)


@cache
def _piece_table(path: str) -> pa.Array:
    """Pieces by id; ids that the vocabulary lacks have none."""
    pieces = read_pieces(path)
    out: list[bytes | None] = [None] * (1 + max(i for _, i in pieces))
    for piece, i in pieces:
        out[i] = piece
    return pa.array(out, pa.binary())


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_ids, text of ``encoded`` (doc_id, ids), through a join of ids with the pieces of the vocabulary.

    The piece table is as large as the vocabulary, whatever the corpus, so it is joined map-side; as its ids are dense, the join
    is a look-up by position over a whole batch, and pieces fall into place without sorting or a shuffle.  Empty and null lists give an
    empty text, ids outside the vocabulary and null ids give nothing.  Bytes that are not UTF-8 are replaced by U+FFFD.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _piece_table(vocabulary)
        for batch in (b.slice(a, 512) for b in batches for a in range(0, b.num_rows, 512)):
            lists = pc.fill_null(batch.column("ids").cast(pa.list_(pa.int64())), pa.scalar([], pa.list_(pa.int64())))
            sizes = np.asarray(pc.list_value_length(lists), dtype=np.int64)
            ids = lists.flatten()
            known = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(table)))
            found = pc.fill_null(table.take(pc.if_else(known, ids, pa.scalar(None, pa.int64()))).cast(pa.large_binary()), b"")
            if isinstance(found, pa.ChunkedArray):
                found = found.combine_chunks()
            starts = np.frombuffer(found.buffers()[1], dtype=np.int64, count=len(found) + 1 + found.offset)[found.offset :] if len(found) else np.zeros(1, np.int64)
            data = bytes(memoryview(found.buffers()[2])) if len(found) and found.buffers()[2] else b""
            ends = starts[np.concatenate([[0], np.cumsum(sizes)])]
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_ids": pa.array(sizes.astype(np.int32)), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, n_ids int, text string")
