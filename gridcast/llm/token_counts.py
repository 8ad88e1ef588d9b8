"""Token counts by a scan for separators in flat, unindexed token files.

A token file is nothing but token ids of fixed width, one end-of-document id after each document. It is held as blocks of
bytes in file order, cut anywhere: a document may go over any number of blocks. Each block is searched on its own, in one
vectorised comparison, which gives its number of tokens and the places of its separators. A prefix scan over the blocks'
counts then gives every block its place in the file and the place of the last separator before it, so the documents
that cross blocks are stitched without reading a token twice. The scan goes in two levels, so that a file of any length is
spread over tasks.

A document without tokens has length 0. Tokens after a file's last separator form a last, unfinished document. Empty files and
tables give no rows. Null contents count as empty blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridcast.llm.store import stored

BLOCK_TOKENS = 1 << 18
GROUP_BLOCKS = 4096
DTYPE = "<u2"
STORED = "file long, block long, content binary, ids array<long>"


def load_encoding(vocabulary: bytes, pattern: str):
    """A tokenizer from the bytes of a file of ranks."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, path: str, vocabulary: bytes, pattern: str, separator: int, dtype: str = DTYPE,
                      block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes (doc_id, text) as one token file per partition, in a table of blocks; a null text is an empty document.

    Nothing in a file says where documents begin. Beside the blocks stands the order of the ids, without positions.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def tokenize(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, file = load_encoding(sent.value, pattern), TaskContext.get().partitionId()
        held, size, block, first = [], 0, 0, 0

        def row(at: int, content: bytes | None, ids: list | None) -> pd.DataFrame:
            return pd.DataFrame({"file": [file], "block": [at], "content": [content], "ids": [ids]})

        for table in parts:
            names = [None if d is None else int(d) for d in table["doc_id"]]
            if names:
                yield row(first, None, names)
            first += len(names)
            for text in table["text"]:
                ids = encoding.encode_ordinary(text) if isinstance(text, str) else []
                held.append(np.array([*ids, separator], dtype=dtype))
                size += len(ids) + 1
                if size >= block_tokens:
                    flat = np.concatenate(held)
                    for cut in range(0, size - block_tokens + 1, block_tokens):
                        yield row(block, flat[cut:cut + block_tokens].tobytes(), None)
                        block += 1
                    held = [flat[size - size % block_tokens:]]
                    size %= block_tokens
        if size:
            yield row(block, np.concatenate(held).tobytes(), None)

    # Ids as text: beside a null, pandas holds whole numbers as floats, which changes large ones.
    docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(tokenize, STORED).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The blocks, and the order of the ids: (file, ordinal, doc_id)."""
    rows = spark.read.schema(STORED).parquet(path)
    order = rows.filter("ids is not null").select("file", "block", F.posexplode("ids").alias("i", "doc_id"))
    return (rows.filter("content is not null").select("file", "block", "content"),
            order.select("file", (F.col("block") + F.col("i")).alias("ordinal"), "doc_id"))


def scan(blocks: DataFrame, separator: int, dtype: str = DTYPE) -> DataFrame:
    """Per document of every file: file, ordinal (from 0), start (token position), n_tokens, finished."""

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in parts:
            flat = [np.frombuffer(c or b"", dtype=dtype) for c in table["content"]]
            ends = [np.flatnonzero(t == separator).astype(np.int64) for t in flat]
            yield pd.DataFrame({"file": table["file"], "block": table["block"], "size": [len(t) for t in flat], "ends": ends})

    found = blocks.select("file", "block", "content").mapInPandas(search, "file long, block long, size long, ends array<long>")
    found = stored(found).withColumn("part", F.floor(F.col("block") / GROUP_BLOCKS))
    inside = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    between = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    # First the sums inside each group of blocks, then those of the groups.
    local = found.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("at"),
                         F.coalesce(F.sum(F.size("ends")).over(inside), F.lit(0)).alias("nth"))
    own_end = F.when(F.size("ends") > 0, F.col("at") + F.element_at("ends", -1))
    local = local.withColumn("own_end", own_end).withColumn("end_before", F.max("own_end").over(inside))
    groups = local.groupBy("file", "part").agg(F.sum("size").alias("size"), F.sum(F.size("ends")).alias("n"), F.max("own_end").alias("own_end"), F.max("block").alias("top"))
    starts = groups.select("file", "part", F.coalesce(F.sum("size").over(between), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(between), F.lit(0)).alias("base_n"), "own_end", "top")
    starts = starts.withColumn("base_end", F.max(F.col("base") + F.col("own_end")).over(between))
    whole = Window.partitionBy("file")
    starts = starts.select("file", "part", "base", "base_n", "base_end", F.max("top").over(whole).alias("last_block"))
    joined = local.join(starts, ["file", "part"])
    placed = joined.select(
        "file", (F.col("base_n") + F.col("nth")).alias("nth"), (F.col("base") + F.col("at")).alias("at"), "size", "ends",
        F.coalesce(F.col("base") + F.col("end_before"), F.col("base_end"), F.lit(-1)).alias("before"),
        (F.col("block") == F.col("last_block")).alias("final"),
    )
    # Where a document starts: after the separator before it, in this block or an earlier one.
    ends = F.transform("ends", lambda e: e + F.col("at"))
    total = F.col("at") + F.col("size")
    open_end = F.coalesce(F.try_element_at(ends, F.lit(-1)), F.col("before")) + 1
    unfinished = F.col("final") & (open_end < total)
    stops = F.concat(F.transform(ends, lambda e: F.struct(e.alias("stop"), F.lit(True).alias("finished"))),
                     F.when(unfinished, F.array(F.struct(total.alias("stop"), F.lit(False).alias("finished"))))
                     .otherwise(F.array().cast("array<struct<stop:bigint,finished:boolean>>")))
    begins = F.concat(F.array(F.col("before") + 1), F.transform(ends, lambda e: e + 1))
    rows = placed.select("file", "nth", begins.alias("begins"), F.posexplode(stops).alias("i", "doc"))
    start = F.element_at("begins", F.col("i") + 1)
    return rows.select("file", (F.col("nth") + F.col("i")).alias("ordinal"), start.alias("start"),
                       (F.col("doc.stop") - start).alias("n_tokens"), F.col("doc.finished").alias("finished"))
