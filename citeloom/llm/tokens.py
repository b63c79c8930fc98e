"""Encoding a corpus with a public tokenizer through a table of distinct words.

The tokenizer's own pre-tokenization cuts a text into words that are encoded
independently, so each distinct word is encoded once and its ids are joined back
by position.  Word counts are Zipfian: the FREQUENT most frequent words (a fixed
number) go to every task, which looks up the words of whole texts at once; only
the rare positions, a few in a hundred, are exploded, joined by word and put back
where they came from.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.staging import Stage

TOKENIZERS = os.environ.get("CITELOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how byte_bpe_50k cuts a text into words, white space as Unicode defines it.
WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that every task gets, at most, and how long they may be; about 1 MB.
FREQUENT, FREQUENT_CHARS = 20_000, 64
#: Words that a Python worker looks up at once (texts are not parted): bounds its memory.
RUN = 300_000


def encoding(folder: str, name: str = "byte_bpe_50k"):
    """The tokenizer, loaded once per task; every word is one piece to it."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def words(text: Column) -> Column:
    """The words of a text in order; their concatenation is the text. Null and empty texts have none."""
    return F.when(F.length(text) > 0, F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))).otherwise(F.array().cast("array<string>"))


def encode_words(table: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(word, ids) of a table of distinct words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(folder, name)
        for b in batches:
            yield pd.DataFrame({"word": b["word"], "ids": [enc._core_bpe.encode_single_piece(w.encode()) for w in b["word"]]})

    return table.select("word").mapInPandas(run, "word string, ids array<int>")


def word_table(documents: DataFrame, stage: Stage, text_column: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(word, n, ids): each distinct word with its count and ids."""
    counts = stage.put(documents.select(F.explode(words(F.col(text_column))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    return stage.put(counts.join(encode_words(counts, folder, name), "word"))


class Frequent:
    """The most frequent words of a word table with their ids, as flat arrays; FREQUENT short words at most."""

    def __init__(self, table: DataFrame, most: int = FREQUENT):
        top = table.filter(F.length("word") <= FREQUENT_CHARS).orderBy(F.desc("n"), "word").limit(most).select("word", "ids").collect()
        self.words = [r["word"] for r in top]
        self.sizes = np.array([len(r["ids"]) for r in top] or [0], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.ids = np.array([i for r in top for i in r["ids"]], dtype=np.int32)


def looked_up(documents: DataFrame, known: Frequent, id_column: str, text_column: str) -> DataFrame:
    """(id, h, part, at, rare): of every text with words, the ids of its frequent words, and its rare words with the number of ids in ``part`` before each.

    h tells different texts under one id apart.
    """
    docs = documents.filter(F.length(text_column) > 0).select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("h"), words(F.col(text_column)).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(known.words, pa.string())
        for batch in batches:
            ends, start = batch.column("w").offsets.to_numpy(), 0
            while start < batch.num_rows:
                stop = max(int(np.searchsorted(ends, ends[start] + RUN, "right")) - 1, start + 1)
                b, start = batch.slice(start, stop - start), stop
                lists = b.column("w")
                flat, off = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
                at = pc.fill_null(pc.index_in(flat, value_set=values), -1).to_numpy()
                size = np.where(at >= 0, known.sizes[at], 0)
                before = np.concatenate([[0], np.cumsum(size)])
                ids = known.ids[np.repeat(known.starts[at] - before[:-1], size) + np.arange(before[-1])] if before[-1] else known.ids[:0]
                rare = np.nonzero(at < 0)[0]
                part, rares = before[off].astype(np.int32), np.searchsorted(rare, off).astype(np.int32)
                place = before[rare] - before[off][np.searchsorted(off, rare, "right") - 1]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("h"), pa.ListArray.from_arrays(part, pa.array(ids)), pa.ListArray.from_arrays(rares, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(rares, flat.take(pa.array(rare)))],
                    names=["id", "h", "part", "at", "rare"],
                )

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, h bigint, part array<int>, at array<int>, rare array<string>")


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, ids): the token ids of every text, without special tokens.

    Null, empty texts: an empty array (white space has ids like any text).
    Repeated rows give one row; different texts under one id give a row each; a
    null id is kept.  Strings of special tokens in a text are ordinary text.
    """
    stage = Stage(documents.sparkSession, "tokens")
    docs = documents.select(F.col(id_column).alias(id_column), F.col(text_column).alias(text_column))
    table = word_table(docs, stage, text_column, folder, name)
    # found once: read for the rare words and for the rest
    found = stage.put(looked_up(docs, Frequent(table, frequent), id_column, text_column))
    rare = found.select("id", "h", F.posexplode("rare").alias("k", "word")).join(table.select("word", "ids"), "word")
    rare = rare.groupBy(F.struct("id", "h").alias("doc")).agg(F.array_sort(F.collect_set(F.struct("k", "ids"))).alias("r"))
    whole = found.filter("size(rare) = 0").select("id", "h", F.col("part").alias("ids"))
    prev = lambda i: F.when(i == 0, 0).otherwise(F.get("at", i - 1))
    filled = F.flatten(F.transform("r", lambda x, i: F.concat(F.slice("part", prev(i) + 1, F.get("at", i) - prev(i)), x["ids"])))
    last = F.element_at("at", -1)
    some = found.filter("size(rare) > 0").select(F.struct("id", "h").alias("doc"), "part", "at").join(rare, "doc")
    some = some.select("doc.id", "doc.h", F.concat(filled, F.slice("part", last + 1, F.size("part") - last)).alias("ids"))
    # repeated rows: the texts themselves are not compared again
    full = whole.unionByName(some).dropDuplicates(["id", "h"]).select(F.col("id").alias(id_column), "ids")
    empty = docs.filter(F.col(text_column).isNull() | (F.length(text_column) == 0)).select(id_column, F.array().cast("array<int>").alias("ids")).distinct()
    return full.unionByName(empty)


def sizes(documents: DataFrame, stage: Stage, id_column: str = "doc_id", text_column: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_tokens): the number of tokens of each document, 0 for null and empty texts.

    One row per id: of several texts under one id, the longest in tokens.
    """
    docs = documents.select(F.col(id_column).alias(id_column), F.col(text_column).alias(text_column))
    table = word_table(docs, stage, text_column, folder, name)
    found = stage.put(looked_up(docs, Frequent(table, frequent), id_column, text_column).select("id", "h", F.size("part").alias("n"), "rare"))
    rare = found.select("id", "h", F.posexplode("rare").alias("k", "word")).distinct().join(table.select("word", F.size("ids").alias("n")), "word")
    # a repeated row repeats the number of its frequent ids, which counts once
    parts = found.select("id", "h", "n").distinct().unionByName(rare.select("id", "h", "n"))
    full = parts.groupBy("id", "h").agg(F.sum("n").cast("long").alias("n")).select(F.col("id").alias(id_column), "n")
    empty = docs.filter(F.col(text_column).isNull() | (F.length(text_column) == 0)).select(id_column, F.lit(0).cast("long").alias("n"))
    return full.unionByName(empty).groupBy(id_column).agg(F.max("n").alias("n_tokens"))


def decode(ids: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, text) from ids, through a join with the id-to-piece table (as long as the vocabulary, so broadcast).

    Rows are distinct (doc_id, ids) pairs, as ``encode`` gives them; ids outside
    the vocabulary are dropped; no ids give an empty text.
    """
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        pieces = [(int(b), bytearray(base64.b64decode(a))) for a, b in map(bytes.split, f)]
    vocabulary = ids.sparkSession.createDataFrame(pieces, "token int, piece binary")
    at = ids.select(F.col(id_column).alias("id"), F.xxhash64(ids_column).alias("h"), F.posexplode_outer(ids_column).alias("pos", "token"))
    joined = at.join(F.broadcast(vocabulary), "token", "left").groupBy("id", "h").agg(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", F.hex("piece").alias("x")))).alias("p"))
    text = F.decode(F.unhex(F.array_join(F.transform(F.array_sort("p"), lambda x: x["x"]), "")), "UTF-8")
    return joined.select(F.col("id").alias(id_column), text.alias("text"))
