"""Filling containers of fixed capacity with items that are split only if too long alone.

Hierarchical residual packing: each partition packs its items best-fit, longest first; bins that are
nearly full are final, the underfull ones go on as items of their own to rounds of best fit over ever
fewer, merged partitions. Item sizes are tokens of a public tokenizer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editrail.llm.tokenize import TOKENIZERS, encoder_of, vocabulary
from editrail.runtime import cut, read_table, spread

CAPACITY = 2048
#: A bin with at most this share of its capacity unused is final.
SLACK = 1 / 64
#: Underfull bins that one task of a later round packs together.
FAN_IN = 50_000
#: Items that one task packs at a time; bounds its memory.
LOCAL_ITEMS = 500_000


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, fill of each bin): longest first, each into the fullest bin that holds it.

    Open bins are kept by residual, and the residuals in use as the bits of one integer, so an item
    takes a shift and a lowest set bit, however many bins are open. Items of size 0 have bin -1.
    """
    place = np.full(len(sizes), -1, dtype=np.int64)
    by_residual: dict[int, list[int]] = {}
    used, fills = 0, []
    for i in np.argsort(-sizes, kind="stable"):
        n = int(sizes[i])
        if n == 0:
            break
        fitting = used >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_residual[room].pop()
            if not by_residual[room]:
                used ^= 1 << room
            fills[b] += n
        else:
            room, b = capacity, len(fills)
            fills.append(n)
        place[i] = b
        left = room - n
        if left:
            by_residual.setdefault(left, []).append(b)
            used |= 1 << left
    return place, np.array(fills, dtype=np.int64)


def split_long(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first token, tokens) of the parts: items over the capacity are cut into full ones and a rest."""
    parts = np.maximum(1, -(-sizes // capacity))
    item = np.repeat(np.arange(len(sizes)), parts)
    no = np.arange(len(item)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = no * capacity
    return item, first, np.minimum(capacity, sizes[item] - first)


def _settle(bins: DataFrame, capacity: int, slack: float) -> DataFrame:
    """(bin, final) of underfull bins: rounds of best fit over them, each over fewer partitions."""
    mapping, level = None, 0
    todo = bins
    n = todo.count()
    while n > 1:
        tasks = max(1, -(-n // FAN_IN))
        level += 1
        tag = level << 56

        def merge(frames: Iterator[pd.DataFrame], tag: int = tag) -> Iterator[pd.DataFrame]:
            whole = pd.concat(list(frames), ignore_index=True)
            if len(whole):
                whole = whole.sort_values(["fill", "bin"], ignore_index=True)
                place, fills = best_fit(whole["fill"].to_numpy(), capacity)
                name = tag | (TaskContext.get().partitionId() << 32)
                yield pd.DataFrame({"bin": whole["bin"], "up": name + place, "fill": fills[place]})

        step = cut(todo.repartition(tasks, "bin").mapInPandas(merge, "bin long, up long, fill long"))
        up = step.select("bin", "up")
        if mapping is None:
            mapping = up
        else:
            mapping = cut(mapping.join(up.select(F.col("bin").alias("final"), F.col("up").alias("next")), "final", "left").select("bin", F.coalesce("next", "final").alias("final")))
        mapping = mapping.withColumnRenamed("up", "final")
        todo = step.where(F.col("fill") < capacity * (1 - slack)).groupBy("up").agg(F.first("fill").alias("fill")).select(F.col("up").alias("bin"), "fill")
        before, n = n, todo.count()
        # each round deals the bins to other tasks; it ends when one task holds them all or nothing fits any more
        if tasks == 1 or n >= before:
            break
    return mapping


def pack(items: DataFrame, size_of, columns: list[str], key: str, capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """(key, part_no, token_from, token_count, container_id) of every part of every item.

    size_of() gives, in a worker, a function from an Arrow batch of the columns to the items' sizes. Only items over the
    capacity are split: into full containers and a rest that is packed like any item. Every token is
    in one part and every part in one container; no container is over its capacity. Items of size 0
    have one row of 0 tokens, without container. Repeated rows are items of their own; null keys
    pass through. One scan, no shuffle of items; later rounds move a few underfull bins.
    """
    slim = items.select(*columns)
    kind = slim.schema[key].dataType.simpleString()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes_in, task, made = size_of(), TaskContext.get().partitionId() << 32, 0

        def packed(keys: list[pa.Array], sizes: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal made
            size = np.concatenate(sizes)
            item, first, n = split_long(size, capacity)
            place, fills = best_fit(n, capacity)
            some = place >= 0
            bins = np.where(some, task + made + place, 0)
            fill = np.where(some, fills[place] if len(fills) else 0, 0)
            made += len(fills)
            key_of = pa.concat_arrays(keys).take(pa.array(item))
            cols = [key_of, pa.array((first // capacity).astype(np.int32)), pa.array(first), pa.array(n.astype(np.int32)), pa.array(bins, mask=~some), pa.array(fill)]
            return pa.RecordBatch.from_arrays(cols, names=[key, "part_no", "token_from", "token_count", "bin", "fill"])

        keys, sizes = [], []
        for b in batches:
            keys.append(b.column(0))
            sizes.append(np.asarray(sizes_in(b), dtype=np.int64))
            if sum(map(len, sizes)) >= LOCAL_ITEMS:
                yield packed(keys, sizes)
                keys, sizes = [], []
        if keys:
            yield packed(keys, sizes)

    schema = f"`{key}` {kind}, part_no int, token_from long, token_count int, bin long, fill long"
    parts = cut(spread(slim).mapInArrow(local, schema))
    under = parts.where((F.col("fill") > 0) & (F.col("fill") < capacity * (1 - slack))).groupBy("bin").agg(F.max("fill").alias("fill"))
    mapping = _settle(cut(under), capacity, slack)
    done = parts.drop("fill")
    if mapping is None:
        done = done.withColumn("final", F.lit(None).cast("long"))
    else:
        done = done.join(mapping, "bin", "left")
    return done.select(key, "part_no", "token_from", "token_count", F.coalesce("final", "bin").alias("container_id"))


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """pack() of texts sized in tokens; null and empty texts have 0."""
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary(name, folder))

    def size_of():
        encode = encoder_of(vocab.value).encode
        return lambda b: [len(encode(t.as_py())) for t in b.column(1)]

    return pack(docs, size_of, [key, text], key, capacity)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
