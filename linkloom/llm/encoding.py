"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

Texts are split into words by the vocabulary's own pattern; every distinct word is encoded once, and
the ids are joined back by position. The most frequent words, a bounded table, go to every task; the
others are joined to the texts that hold them by shuffles in which no word is frequent. Decoding joins
ids with their pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.session import cut

#: Folder of the public vocabularies; only the driver reads it.
VOCABULARIES = "/opt/tokenizers"
#: The word pattern of byte_bpe_50k as Java writes it; (?U) gives \s all Unicode spaces.
WORDS = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The words that every task holds: how many, and the bytes of the longest one. At most 4 MB of words.
FREQUENT_WORDS, FREQUENT_BYTES = 16_000, 256
#: Rows of texts that a task looks up at once.
_ROWS = 1000


def _encode(vocabulary: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, vocabulary.splitlines())}
        encoder = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        for f in batches:
            f["ids"] = [encoder.encode_ordinary(w) for w in f["word"]]
            yield f

    return run


def _words(text: str = "text") -> Column:
    return F.expr(f"regexp_extract_all({text}, r\"{WORDS}\", 0)")


def word_table(texts: DataFrame, vocabulary: bytes) -> DataFrame:
    """texts (text) to (word, n, ids): each distinct word, the rows that hold it, its ids."""
    # the outer form: an inner one would let the optimizer test the whole split a second time as a filter
    words = texts.select(F.explode_outer(F.array_distinct(_words())).alias("word")).filter("word is not null")
    return words.groupBy("word").agg(F.count("*").alias("n")).mapInPandas(_encode(vocabulary), "word string, n bigint, ids array<int>")


def _join(frequent: pa.Table):
    """Rows (key, words, rare), rare being (word, ids) of the words that are not frequent, to (key, ids)."""
    known, known_ids = frequent["word"].combine_chunks(), frequent["ids"].combine_chunks()

    def spans(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

    ids, lengths = spans(known_ids)

    def lookup(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, rare = batch.column(1), batch.column(2).flatten()
        flat = words.flatten()
        at = pc.index_in(flat, known)
        others = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        own_ids, own_lengths = ids, lengths
        if others.any():
            found = pc.index_in(flat.filter(pa.array(others)), rare.field(0))
            if found.null_count:
                raise ValueError("a word is missing from the table of words")
            at[others] = len(lengths) + found.to_numpy(zero_copy_only=False)
            more_ids, more_lengths = spans(rare.field(1))
            own_ids, own_lengths = np.concatenate([ids, more_ids]), np.concatenate([lengths, more_lengths])
        first = np.cumsum(own_lengths) - own_lengths
        many = own_lengths[at]
        ends = np.concatenate([[0], np.cumsum(many)])
        places = np.arange(ends[-1]) + np.repeat(first[at] - ends[:-1], many)
        sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = ends[np.concatenate([[0], np.cumsum(sizes)])]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(own_ids[places], pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], ["key", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                yield lookup(batch.slice(i, _ROWS))

    return run


def encode(texts: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = VOCABULARIES, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """(key, ids array<int>), one row for each row of texts.

    Empty and null texts get an empty list. Nothing is trimmed or normalised, and strings that look
    like special tokens are ordinary text. Keys may be null or repeated. Long texts are encoded whole.
    An empty table gives no rows; other columns are not read.
    """
    slim = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    table = cut(word_table(slim, Path(folder, vocabulary).read_bytes()))
    short = table.filter(F.octet_length("word") <= FREQUENT_BYTES)
    frequent = short.orderBy(F.desc("n"), "word").limit(frequent_words).select("word", "n", "ids").toArrow()
    last = frequent.slice(frequent.num_rows - 1).to_pylist() if frequent.num_rows else []
    # the frequent words are those up to the last one in the same order, so no join tells the others
    among = F.lit(False)
    for row in last:
        among = (F.octet_length("word") <= FREQUENT_BYTES) & ((F.col("n") > row["n"]) | ((F.col("n") == row["n"]) & (F.col("word") <= row["word"])))
    held = slim.select("key", F.explode_outer(F.array_distinct(_words())).alias("word")).filter("word is not null")
    rare_held = held.join(F.broadcast(table.filter(among).select("word")), "word", "left_anti")  # at most frequent_words
    rare = rare_held.join(table.filter(~among).select("word", "ids"), "word").groupBy("key").agg(F.collect_list(F.struct("word", "ids")).alias("rare"))
    whole = slim.alias("t").join(rare.alias("r"), F.col("t.key").eqNullSafe(F.col("r.key")), "left")
    rows = whole.select(F.col("t.key").alias("key"), _words("t.text").alias("words"), "rare")
    return rows.mapInArrow(_join(frequent.select(["word", "ids"])), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def pieces(spark: SparkSession, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = VOCABULARIES) -> DataFrame:
    """(id, piece binary) of a vocabulary file, which the driver reads."""
    rows = [(int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, Path(folder, vocabulary).read_bytes().splitlines())]
    return spark.createDataFrame(pa.table({"id": pa.array([r[0] for r in rows], pa.int32()), "piece": pa.array([r[1] for r in rows], pa.binary())}))


def decode(encoded: DataFrame, key: str = "doc_id", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = VOCABULARIES) -> DataFrame:
    """(key, text) of (key, ids): ids joined with their pieces, an empty text for an empty list."""
    table = pieces(encoded.sparkSession, vocabulary, folder)  # as large as the vocabulary, whatever the corpus
    placed = encoded.select(F.col(key).alias("key"), "ids").repartition("key")
    rows = placed.select("key", F.posexplode_outer("ids").alias("at", "id")).join(F.broadcast(table), "id", "left")
    # bytes are joined as hex digits, since a character may be spread over several pieces
    digits = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.hex("piece").alias("h")))), lambda x: x["h"]), "")
    return rows.groupBy("key").agg(F.decode(F.unhex(digits), "utf-8").alias("text")).withColumnRenamed("key", key)
