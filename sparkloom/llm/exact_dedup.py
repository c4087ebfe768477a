"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Each part of the rows sends its sorted 64-bit fingerprints, Rice-coded, to the owners of their ranges. An owner answers
each part with a bitmap: which of your fingerprints another part has too. Only the rows so marked, and those that repeat
inside their part, are suspects; their bytes are then compared by grouping on the text itself. Texts that occur once
are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import RowStore, bitmaps, partitions, rows_of, staged


#: Groups of at least this share of the suspects are answered by broadcast.
HUGE = 1000


def rice_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Ascending distinct uint64 as (width, unary quotients, remainders) of their gaps."""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = max(1, int(values[-1]) // len(values)) if len(values) else 1
    k = max(0, mean.bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.ones(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 0
    if k:
        low = (gaps & np.uint64((1 << k) - 1)).astype(">u8").view(np.uint8).reshape(-1, 8)
        rest = np.unpackbits(low, axis=1)[:, 64 - k :]
    else:
        rest = np.zeros(0, np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(rest).tobytes()


def rice_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.zeros((n, 64), np.uint8)
        bits[:, 64 - k :] = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k)
        gaps |= np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _by_owner(hashes: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in order, and where each owner's range of them starts."""
    own = np.unique(hashes.view(np.uint64))
    cuts = np.array([((1 << 64) * i // owners) for i in range(owners)], np.uint64)
    return own, np.append(np.searchsorted(own, cuts), len(own))


def _send(owners: int):
    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        own, at = _by_owner(pdf["h"].to_numpy(np.int64), owners)
        out = []
        for i in range(owners):
            piece = own[at[i] : at[i + 1]]
            if len(piece):
                base = np.uint64((1 << 64) * i // owners)
                out.append((int(pdf["part"].iloc[0]), i, len(piece), *rice_encode(piece - base)))
        return pd.DataFrame(out, columns=["part", "owner", "n", "k", "unary", "rest"])

    return send


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each part's block, a bitmap of the fingerprints that some other part has sent too."""
    sent = [rice_decode(*x) for x in zip(pdf["n"], pdf["k"], pdf["unary"], pdf["rest"], strict=True)]
    seen, counts = np.unique(np.concatenate(sent), return_counts=True)
    shared = seen[counts > 1]
    return pd.DataFrame({"part": pdf["part"], "owner": pdf["owner"], "bits": [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in sent]})


def _suspects(owners: int):
    def suspects(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        h = rows["h"].to_numpy(np.int64)
        own, at = _by_owner(h, owners)
        double = np.zeros(len(own), bool)
        for i, bits in zip(answers["owner"], answers["bits"], strict=True):
            n = at[i + 1] - at[i]
            double[at[i] : at[i + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8))[:n].astype(bool)
        place = np.searchsorted(own, h.view(np.uint64))
        double |= np.bincount(place, minlength=len(own)) > 1
        found = rows["row"].to_numpy(np.int64)[double[place]]
        if not len(found):
            return pd.DataFrame(columns=["part", "tasks", "bitmaps"], dtype=object)
        tasks, maps = bitmaps(found)
        return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "tasks": [tasks], "bitmaps": [maps]})

    return suspects


def _decide(docs: DataFrame, id_col: str, text_col: str) -> tuple[RowStore, DataFrame]:
    """The stored rows, and (row, part, id, sha, keep_id, size, kept) for each."""
    store = RowStore(
        docs,
        h=lambda c: F.xxhash64(F.coalesce(c(text_col), F.lit(""))),
        sha=lambda c: F.sha2(F.coalesce(c(text_col), F.lit("")).cast("binary"), 256),
    )
    id_at, text = store.names[id_col], F.coalesce(store.names[text_col], F.lit(""))
    owners = partitions(store.spark)
    keys = store.rows.select("part", "row", "h")
    sent = keys.select("part", "h").groupBy("part").applyInPandas(_send(owners), "part long, owner int, n long, k int, unary binary, rest binary")
    answers = sent.groupBy("owner").applyInPandas(_answer, "part long, owner int, bits binary")
    flags = keys.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(_suspects(owners), "part long, tasks array<long>, bitmaps array<binary>")
    marked = store.flagged(staged(flags, "flags"))
    texts = marked.where("flag").groupBy("sha", text.alias("text")).agg(F.count("*").alias("n"))
    verified = texts.groupBy("sha").agg(F.count("*").alias("texts"), F.sum("n").alias("size"))
    verified = verified.where(F.coalesce(F.assert_true(F.col("texts") == 1, F.lit("two texts share a SHA-256 digest")).isNull(), F.lit(True)))
    narrow = staged(marked.select("row", "part", F.col(id_at).alias("id"), "sha", "flag"), "narrow")
    doubles = narrow.where("flag")
    best = doubles.groupBy("sha").agg(F.max(F.struct(F.col("id"), (-F.col("row")).alias("r"))).alias("best"))
    groups = staged(verified.join(best, "sha").select("sha", "size", F.col("best.id").alias("keep_id"), (-F.col("best.r")).alias("keep_row")), "groups")
    alone = narrow.where("not flag").select("row", "part", "id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("kept"))
    # groups of over a HUGE-th of all suspects, so fewer than HUGE of them, go to every task; no group of rows meets at one key
    total = groups.agg(F.sum("size")).first()[0] or 0
    huge = groups.where(F.col("size") > total / HUGE).toDF("sha", *(f"huge_{c}" for c in groups.columns[1:]))
    told = doubles.join(F.broadcast(huge), "sha", "left")
    own = ("row", "part", "id", "sha")
    of_huge = told.where("huge_size is not null").select(*own, F.col("huge_keep_id").alias("keep_id"), F.col("huge_size").alias("size"), (F.col("row") == F.col("huge_keep_row")).alias("kept"))
    rest = told.where("huge_size is null").select(*own).join(groups, "sha").select(*own, "keep_id", "size", (F.col("row") == F.col("keep_row")).alias("kept"))
    return store, alone.unionByName(of_huge).unionByName(rest)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of byte-identical whole texts: one row for each row of ``docs``, dropped ones too.

    Returns ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``. The row with the largest id stays; of
    repeated rows with that id, the first read. A null text counts as empty; a null id is below all others. Should two
    different texts ever share a SHA-256 digest the job stops instead of merging them. An empty table gives an empty
    result. Other columns are ignored.
    """
    _, found = _decide(rows_of(docs, id=id_col, text=text_col), "id", "text")
    return found.select(F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns."""
    store, found = _decide(docs, id_col, text_col)
    return store.select(found.where("kept"))
