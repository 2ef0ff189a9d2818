"""Encoding a corpus with a public tokenizer through a global table of distinct words.

Texts are cut into pre-tokens; each distinct pre-token of the whole corpus is
encoded once; the ids are joined back to where the pre-token stood and put in
order again. The join is safe against frequent words: a word with at least a
thousandth of all rows is one of at most a thousand words, which are broadcast;
the others are joined by shuffle, and none of them has more than a thousandth.
"""

from __future__ import annotations

import base64
import functools
import os

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.session import materialise

TOKENIZERS = os.environ.get("SIFTWRIGHT_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the published pattern that splits a text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
HOT_SHARE = 1000  # a word with 1/HOT_SHARE of all rows is hot: at most HOT_SHARE words are


@functools.cache
def _ranks(name: str, folder: str) -> dict[bytes, int]:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def _encoder(name: str, folder: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=_ranks(name, folder), special_tokens={})


def word_positions(documents: DataFrame) -> DataFrame:
    """(doc_id, h, word, positions): each distinct pre-token of a document with all places it stands at.

    h is a hash of the text, so that two texts under one doc_id stay apart.
    The rows of a document are aggregated before anything is shuffled.
    """

    def run(batches):
        pattern = regex.compile(PATTERN)
        for pdf in batches:
            ids, hs, words, places, held = [], [], [], [], 0
            for doc, h, text in zip(pdf["doc_id"], pdf["h"], pdf["text"], strict=True):
                seen: dict[str, list[int]] = {}
                for i, word in enumerate(pattern.findall(text)):
                    seen.setdefault(word, []).append(i)
                words += seen.keys()
                places += seen.values()
                ids += [doc] * len(seen)
                hs += [h] * len(seen)
                held += len(text)
                if held > 2_000_000:
                    yield pd.DataFrame({"doc_id": ids, "h": hs, "word": words, "positions": places})
                    ids, hs, words, places, held = [], [], [], [], 0
            if ids:
                yield pd.DataFrame({"doc_id": ids, "h": hs, "word": words, "positions": places})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    once = rows.dropDuplicates(["doc_id", "h"])
    return once.where("text IS NOT NULL AND text <> ''").mapInPandas(run, "doc_id long, h long, word string, positions array<int>")


def encode_words(words: DataFrame, name: str, folder: str = TOKENIZERS) -> DataFrame:
    """ids of each word of a table of distinct words (other columns are kept)."""

    def run(batches):
        encoder = _encoder(name, folder)
        for pdf in batches:
            pdf["ids"] = [encoder._encode_single_piece(w) for w in pdf["word"]]
            yield pdf

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return words.mapInPandas(run, f"{fields}, ids array<int>")


def _joined(documents: DataFrame, name: str, folder: str) -> DataFrame:
    places = materialise(word_positions(documents), "word-positions")
    table = materialise(encode_words(places.groupBy("word").agg(F.count("*").alias("n")), name, folder), "word-ids")
    total = table.agg(F.sum("n")).first()[0] or 0
    bound = max(2, -(-total // HOT_SHARE))
    hot = table.where(F.col("n") >= bound).drop("n")  # at most HOT_SHARE rows
    cold = table.where(F.col("n") < bound).drop("n")
    by_broadcast = places.join(F.broadcast(hot), "word")
    by_shuffle = places.join(F.broadcast(hot.select("word")), "word", "left_anti").join(cold, "word")
    return by_broadcast.unionByName(by_shuffle)


def encode_corpus(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids) of each document, without special tokens.

    documents: doc_id, text (other columns are ignored). A null and an empty
    text have the empty list. Marks that look like special tokens are text.
    Rows that repeat a doc_id with the same text come out once; different
    texts under one doc_id (also null) come out as separate rows.
    """
    found = _joined(documents, name, folder).groupBy("doc_id", "h").agg(F.collect_list(F.struct("positions", "ids")).alias("w"))
    spread = F.flatten(F.transform("w", lambda x: F.transform(x["positions"], lambda p: F.struct(p.alias("p"), x["ids"].alias("ids")))))
    ids = F.flatten(F.transform(F.array_sort(spread), lambda x: x["ids"]))
    encoded = found.select("doc_id", ids.alias("ids"))
    blank = documents.where("text IS NULL OR text = ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text").distinct().select("doc_id", F.array().cast("array<int>").alias("ids"))
    return encoded.unionByName(blank)


def token_counts(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens): sizes alone, summed over words without putting the ids in order. Null and empty texts have 0."""
    sizes = _joined(documents, name, folder).groupBy("doc_id", "h").agg(F.sum(F.size("positions").cast("long") * F.size("ids")).alias("n_tokens")).select("doc_id", "n_tokens")
    blank = documents.where("text IS NULL OR text = ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text").distinct().select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    return sizes.unionByName(blank)


def token_table(spark, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, piece): the bytes of every token, in hex; as long as the vocabulary."""
    return spark.createDataFrame([(i, b.hex()) for b, i in _ranks(name, folder).items()], "id int, piece string")


def decode_corpus(encoded: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text) back from (doc_id, ids) by joining the token-byte table, which is bounded by the vocabulary.

    An empty list gives an empty text, a null list a null text; bytes that are
    no UTF-8 (ids that were cut) come out as replacement characters.
    """
    table = F.broadcast(token_table(encoded.sparkSession, name, folder))
    rows = encoded.select("doc_id", "ids").distinct().withColumn("h", F.xxhash64("ids"))
    places = rows.select("doc_id", "h", F.col("ids").isNull().alias("none"), F.posexplode_outer("ids").alias("p", "id")).join(table, "id", "left")
    joined = places.groupBy("doc_id", "h").agg(F.max("none").alias("none"), F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("p", "piece")))).alias("w"))
    text = F.decode(F.unhex(F.array_join(F.transform("w", lambda x: x["piece"]), "")), "UTF-8")
    return joined.select("doc_id", F.when(~F.col("none"), text).alias("text"))
