"""Best-fit packing of documents into sequences of fixed length, under conflicts.

Rows are dealt evenly over shards of bounded size, by row and not by content, so that copies don't meet in one shard. In
a shard, bins stand in the order of their residual room. A piece looks up the tightest bin that has room and goes on to
the next tightest until one is compatible: bins carry bitmaps of the sources and duplicate clusters that they hold, and
bins of equal room and bitmaps are one entry, so a large cluster's many bins are passed in one step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import missing_as_null, rows_of, staged, word_count

#: Words in a bin, pieces of one source in a bin, pieces in a shard.
CAPACITY, PER_SOURCE, SHARD = 2048, 6, 20_000


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int, per_source: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, start in bin, number of bins); pieces are placed from the largest down.

    sources and clusters: numbers from 0, -1 for a piece that is in no cluster. A bin holds at most one piece of a cluster
    and ``per_source`` of a source. Its bitmaps are whole numbers: one for clusters, one for sources that are full there.
    """
    n = len(sizes)
    where, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
    # bins by residual room, and there by their two bitmaps: bins that refuse the same pieces are looked at once
    at_room: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    held: list[dict[int, int]] = []
    for i in np.lexsort((np.arange(n), -sizes)).tolist():
        size, source, cluster = int(sizes[i]), int(sources[i]), int(clusters[i])
        bit, its = (1 << cluster if cluster >= 0 else 0), 1 << source
        found, room, rest = None, size, rooms >> size
        while rest and found is None:
            step = (rest & -rest).bit_length() - 1
            room += step
            found = next((k for k in at_room[room] if not (k[0] & bit or k[1] & its)), None)
            if found is None:
                rest >>= step + 1
                room += 1
        if found is None:
            dups, full, b, room = 0, 0, len(held), capacity
            held.append({})
        else:
            dups, full = found
            alike = at_room[room][found]
            b = alike.pop()
            if not alike:
                del at_room[room][found]
                if not at_room[room]:
                    rooms &= ~(1 << room)
        where[i], start[i] = b, capacity - room
        held[b][source] = count = held[b].get(source, 0) + 1
        if count >= per_source:
            full |= its
        at_room[room - size].setdefault((dups | bit, full), []).append(b)
        rooms |= 1 << (room - size)
    return where, start, len(held)


def _pack(capacity: int, per_source: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "row"], kind="stable").reset_index(drop=True)
        codes = np.unique(pdf["cluster"].to_numpy(np.int64), return_inverse=True)[1]
        counts = np.bincount(codes)
        number = np.full(len(counts), -1)  # a cluster with one piece here needs no bit
        number[counts > 1] = np.arange((counts > 1).sum())
        sources = pd.factorize(pdf["source"], use_na_sentinel=False)[0]
        where, start, _ = best_fit(pdf["size"].to_numpy(np.int64), sources, number[codes], capacity, per_source)
        return pd.DataFrame({"id": pdf["id"], "row": pdf["row"], "piece": pdf["piece"], "size": pdf["size"], "shard": pdf["shard"], "bin": where, "start": start})

    return pack


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD
) -> DataFrame:
    """Pack whole documents, measured in words, into bins of ``capacity`` words: one row for each piece of a row of ``docs``.

    Returns ``id_col``, ``piece``, ``first_word``, ``n_words``, ``bin_id``, ``bin_start``. A document longer than a bin
    is cut into full bins and a remainder, so nothing is lost. No bin holds two remainders of one duplicate cluster, nor
    more than ``per_source`` of one source. ``cluster_col`` names the cluster (null: none); without it, rows with equal
    texts are one. Documents without words (null or empty texts) get one row with no bin. The null source is a source;
    repeated rows are packed each for itself; an empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kind = dict(docs.dtypes)[id_col]
    cluster = F.xxhash64(text) if cluster_col is None else F.when(F.col(f"`{cluster_col}`").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(f"`{cluster_col}`"))
    rows = rows_of(docs, id=id_col, words=word_count(text), source=missing_as_null(docs, source_col, "string").cast("string"), cluster=cluster, row=F.monotonically_increasing_id())
    rows = staged(rows, "measured")
    whole = F.floor(F.col("words") / capacity).cast("long")
    total = rows.where(F.col("words") % capacity > 0).count()
    shards = max(1, -(-total // shard))
    h = F.xxhash64("row")
    rest = rows.where(F.col("words") % capacity > 0).select("id", "row", whole.alias("piece"), (F.col("words") % capacity).alias("size"), "source", "cluster", h.alias("h"), F.pmod(h, F.lit(shards)).alias("shard"))
    packed = rest.groupBy("shard").applyInPandas(_pack(capacity, per_source), f"id {kind}, row long, piece long, size long, shard long, bin long, start long")
    packed = packed.select("id", "piece", F.col("size").alias("n_words"), F.concat_ws("-", F.lit("s"), "shard", "bin").alias("bin_id"), F.col("start").alias("bin_start"))
    full = rows.where(whole > 0).select("id", "row", F.posexplode(F.array_repeat(F.lit(0), whole.cast("int"))).alias("piece", "zero"))
    full = full.select("id", F.col("piece").cast("long"), F.lit(capacity).cast("long").alias("n_words"), F.concat_ws("-", F.lit("w"), "row", "piece").alias("bin_id"), F.lit(0).cast("long").alias("bin_start"))
    none = rows.where("words = 0").select("id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("bin_start"))
    every = packed.unionByName(full).unionByName(none)
    return every.select(F.col("id").alias(id_col), "piece", (F.col("piece") * capacity).alias("first_word"), "n_words", "bin_id", "bin_start")
