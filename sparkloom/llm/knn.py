"""Exact top-k search by a Voronoi join.

Vectors become whole numbers. Adding one coordinate, the root of what a vector's square norm lacks of the largest, turns
the largest inner product into the least distance. Pivots, more of them the more vectors there are, cut space into
cells. Queries and data go to their nearest pivot; a cell of data is summed up by its smallest distances. From these
follows for every query a distance within which its k neighbours lie, and for every cell of queries how far its needs
reach. Neighbouring cells of queries form groups of bounded size, and a data vector is sent, once, to each group with a
cell that reaches it. A group's data is dealt over several keys. Groups are solved in blocks, with numpy: a query skips
the data cells that it can't need, by the triangle inequality and by the plane between two pivots, and the blocks' best
are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bounded, rows_of, staged

#: Pivots at least and at most (they are sent to every task), vectors in a block, keys that a group's data is dealt over.
PIVOTS, MOST_PIVOTS, BLOCK, SALTS = 64, 1024, 2048, 16
#: Queries in a group of cells, about, and in a block.
GROUP, QUERY_BLOCK = 4096, 512


def _points(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _whole(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _lift(x: np.ndarray, square: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0, square - (x**2).sum(1)))[:, None]])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(0, d))


def _assign(pivots: np.ndarray, width: int, square: float):
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = _points(pdf["v"], width)
            lifted = _lift(x, square)
            d = _distances(lifted, pivots)
            flat = np.hstack([x, np.zeros((len(x), 1))])  # as a query
            dq = _distances(flat, pivots)
            cell, qcell = d.argmin(1), dq.argmin(1)
            yield pd.DataFrame({"id": pdf["id"], "query": pdf["query"], "v": pdf["v"], "cell": cell, "d": d.min(1), "qcell": qcell, "dq": dq.min(1)})

    return assign


def near_ids(summary: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(cell, distance) of different ids near pivots: of an id that several cells name, the nearest."""
    cells = np.repeat(summary["cell"].to_numpy(int), summary["near"].map(len))
    near, ids = (np.concatenate([*summary[c], []]) for c in ("near", "ids"))
    order = np.lexsort((near, ids))
    first = order[np.unique(ids[order], return_index=True)[1]]
    return cells[first], near[first]


def limits(to_pivots: np.ndarray, cells: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """For each query, by its distances to all pivots, one within which it has k neighbours beside itself."""
    if len(cells) <= k:
        return np.full(len(to_pivots), np.inf)
    out = [np.partition(to_pivots[i : i + 64][:, cells] + near, k, axis=1)[:, k] for i in range(0, len(to_pivots), 64)]  # k + 1 ids, as none of a query's own vectors counts
    return np.concatenate(out) if out else np.zeros(0)


def needed(to_pivots: np.ndarray, limit: np.ndarray, pivots: np.ndarray, cells: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Queries x data cells: whether a vector of a cell, ``least`` to ``most`` from its pivot, can be within a query's limit."""
    d = to_pivots[:, cells]
    slack = limit[:, None] + 1e-6 * (1 + d + np.where(np.isfinite(limit), limit, 0)[:, None])
    ok = (d - most <= slack) & (least - d <= slack)
    # a vector lies on its own pivot's side of the plane between that and the query's nearest pivot
    own = to_pivots.argmin(1)
    apart = np.linalg.norm(pivots[own][:, None] - pivots[cells][None], axis=2) if len(cells) * len(own) < 1 << 18 else _distances(pivots[own], pivots)[:, cells]
    plane = np.where(apart > 0, (d**2 - to_pivots.min(1)[:, None] ** 2) / np.maximum(2 * apart, 1e-12), 0)
    return ok & (plane <= slack)


def _limited(pivots: np.ndarray, width: int, cells: np.ndarray, near: np.ndarray, k: int):
    def limited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _points(pdf["v"], width)
                yield pdf.assign(limit=limits(_distances(np.hstack([x, np.zeros((len(x), 1))]), pivots), cells, near, k))

    return limited


def _groups(centres: np.ndarray, counts: dict[int, int], most: int) -> dict[int, int]:
    """A group for each cell of queries: from the cell farthest out, its nearest free neighbours until ``most`` queries are in."""
    free, out, group = dict(sorted(counts.items())), {}, 0
    middle = centres[list(free)].mean(0) if free else None
    while free:
        cells = np.array(list(free))
        seed = cells[np.argmax(np.linalg.norm(centres[cells] - middle, axis=1))]
        size = 0
        for c in cells[np.argsort(np.linalg.norm(centres[cells] - centres[seed], axis=1), kind="stable")]:
            if size and size + free[c] > most:
                break
            out[int(c)] = group
            size += free.pop(c)
        group += 1
    return out


def _send(pivots: np.ndarray, width: int, square: float, reaches: dict[int, float], groups: dict[int, int]):
    cells = np.array(sorted(reaches), int)
    reach = np.array([reaches[c] for c in cells])
    of = np.array([groups[int(c)] for c in cells], int)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.sort_values("cell", kind="stable")  # a block holds few cells
            d = _distances(_lift(_points(pdf["v"], width), square), pivots)[:, cells]
            near = d <= reach + 1e-6 * (1 + reach + d)
            ids, cell, own_d = pdf["id"].to_numpy(np.int64), pdf["cell"].to_numpy(np.int64), pdf["d"].to_numpy(float)
            exact = _whole(pdf["v"], width)
            salt = int(ids[0]) % SALTS
            for g in np.unique(of):
                own = np.flatnonzero(near[:, of == g].any(1))
                for i in range(0, len(own), BLOCK):
                    s = own[i : i + BLOCK]
                    yield pd.DataFrame({"group": [int(g)], "salt": [(salt + i // BLOCK) % SALTS], "ids": [ids[s].tobytes()], "vectors": [exact[s].tobytes()], "cells": [cell[s].tobytes()], "dists": [own_d[s].tobytes()]})

    return send


def _scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Inner products, as exact whole numbers."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, data.shape[1])
    if bound < 2**53:  # then doubles hold every sum exactly
        return (queries.astype(float) @ data.T.astype(float)).astype(np.int64)
    return np.clip(queries.astype(object) @ data.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


def top_of(queries: np.ndarray, qids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, parts: list[tuple[slice, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best in a block, ties to the smaller id; parts: which queries a slice of the data is compared with."""
    score, seen = np.zeros((len(queries), len(data)), np.int64), np.zeros((len(queries), len(data)), bool)
    for own, some in parts if parts is not None else [(slice(None), np.ones(len(queries), bool))]:
        if some.any():
            score[some, own] = _scores(queries[some], data[own])
            seen[some, own] = True
    out = [], [], []
    order = np.argsort(ids, kind="stable")
    ids, score, seen = ids[order], score[:, order], seen[:, order]
    for i in np.flatnonzero(seen.any(1)):
        row = score[i]
        fit = np.flatnonzero(seen[i] & (ids != qids[i]))
        if len(fit) > k:
            least = np.partition(row[fit], len(fit) - k)[len(fit) - k]
            fit = fit[row[fit] >= least]
        best = fit[np.argsort(-row[fit], kind="stable")[:k]]
        out[0].append(np.full(len(best), qids[i]))
        out[1].append(ids[best])
        out[2].append(row[best])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def parts_of(to_pivots: np.ndarray, limit: np.ndarray, pivots: np.ndarray, cells: np.ndarray, dists: np.ndarray) -> list[tuple[slice, np.ndarray]]:
    """A block's data, in the order of its cells, as slices of one cell with the queries that need it."""
    which, starts = np.unique(cells, return_index=True)
    ends = np.append(starts[1:], len(cells))
    least, most = (np.array([f(dists[a:b]) for a, b in zip(starts, ends, strict=True)]) for f in (np.min, np.max))
    ok = needed(to_pivots, limit, pivots, which, least, most)
    return [(slice(a, b), ok[:, j]) for j, (a, b) in enumerate(zip(starts, ends, strict=True))]


def _solve(pivots: np.ndarray, width: int, k: int):
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for qids, queries, limit, ids, vectors, cells, dists in zip(*(pdf[c] for c in ("qids", "queries", "limits", "ids", "vectors", "cells", "dists")), strict=True):
                q, n = np.frombuffer(qids, np.int64), np.frombuffer(ids, np.int64)
                asked = np.frombuffer(queries, np.int64).reshape(len(q), width)
                to = _distances(np.hstack([asked.astype(float), np.zeros((len(q), 1))]), pivots)
                parts = parts_of(to, np.frombuffer(limit), pivots, np.frombuffer(cells, np.int64), np.frombuffer(dists))
                found = top_of(asked, q, np.frombuffer(vectors, np.int64).reshape(len(n), width), n, k, parts)
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    return solve


def _query_blocks(width: int):
    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, limit, exact = pdf["id"].to_numpy(np.int64), pdf["limit"].to_numpy(float), _whole(pdf["v"], width)
        s = [slice(i, i + QUERY_BLOCK) for i in range(0, len(ids), QUERY_BLOCK)]
        return pd.DataFrame({"group": int(pdf["group"].iloc[0]), "qids": [ids[i].tobytes() for i in s], "queries": [exact[i].tobytes() for i in s], "limits": [limit[i].tobytes() for i in s]})

    return blocks


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100, scale: int = 1024, pivots: int | None = None) -> DataFrame:
    """The ``k`` largest inner products for each query: (query_id, rank, vec_id, score), exact.

    Components are floor(scale * x) of x as double. Queries are the rows whose id ``every`` divides; candidates are all
    rows but the query's own. Ties go to the smaller id. Vectors that are null or hold a null or a number that isn't
    finite take no part, nor do rows with a null id; vectors of unequal length compare as if filled up with zeros; scores
    beyond 64 bits stop at the end of the range. Rows repeated with equal id and vector count once; an id with several
    vectors keeps each as a candidate. An empty table gives an empty result. Other columns are ignored.
    """
    v = F.col("v")
    rows = rows_of(vectors, id=F.col(f"`{id_col}`").cast("long"), v=F.col(f"`{vector_col}`").cast("array<double>"))
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.least(F.greatest(F.floor(x * float(scale)), F.lit(-(2**62))), F.lit(2**62)).cast("long"))
    rows = rows.where(fine & F.col("id").isNotNull()).select("id", whole.alias("v"))
    rows = staged(rows.dropDuplicates(["id", "v"]).withColumn("query", F.col("id") % every == 0), "vectors")
    # of one vector's copies only the first k + 1 ids can be among the k best of any query
    copies = Window.partitionBy("v").orderBy("id")
    numbered = rows.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1)
    data = staged(numbered.select("id", "v", F.lit(False).alias("query"), (F.col("n") == 1).alias("first")), "points")
    asked = rows.where("query")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = rows.agg(F.max(F.size("v")), F.max(square), F.count_if("query"), F.count("*")).first()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if facts[0] is None or not facts[2]:
        return empty
    width, most = int(facts[0]), float(facts[1])
    many = pivots or min(MOST_PIVOTS, max(PIVOTS, int(facts[3] ** 0.5) // 4))
    # a bounded choice of different vectors as pivots; any choice gives the same result
    chosen = np.unique(_points(pd.Series([r.v for r in bounded(data.where("first").select("v"), many, F.col("v")).collect()]), width), axis=0)
    centres = _lift(chosen, most)
    schema = "id long, query boolean, v array<long>, cell int, d double, qcell int, dq double"
    placed = staged(data.drop("first").unionByName(asked.select("id", "v", "query")).mapInPandas(_assign(centres, width, most), schema), "placed")
    points, queries = placed.where("not query"), placed.where("query")
    first = Window.partitionBy("cell").orderBy("d", "id")
    # the least distances of at most k + 1 ids for each pivot
    least = points.groupBy("cell", "id").agg(F.min("d").alias("d")).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    near = near_ids(least.groupBy("cell").agg(F.collect_list("d").alias("near"), F.collect_list("id").alias("ids")).toPandas())
    queries = staged(queries.select("id", "v", "qcell", "dq").mapInPandas(_limited(centres, width, *near, k), "id long, v array<long>, qcell int, dq double, limit double"), "limited")
    reaches = queries.groupBy("qcell").agg(F.max(F.col("dq") + F.col("limit")).alias("reach"), F.count("*").alias("n")).toPandas()
    cells = reaches["qcell"].astype(int)
    groups = _groups(centres, dict(zip(cells, reaches["n"].astype(int), strict=True)), GROUP)
    send = _send(centres, width, most, dict(zip(cells, reaches["reach"], strict=True)), groups)
    sent = points.select("id", "v", "cell", "d").mapInPandas(send, "group int, salt int, ids binary, vectors binary, cells binary, dists binary")
    # a group's queries go to each key of its data, and a cell of very many queries is cut into blocks in several tasks
    of = F.element_at(F.lit([groups.get(c, 0) for c in range(len(centres))]), F.col("qcell") + 1).cast("int")
    deal = F.pmod(F.xxhash64("id"), F.lit(1 + int(facts[2]) // (8 * GROUP)))
    blocks = queries.withColumns({"group": of, "deal": deal}).groupBy("group", "deal").applyInPandas(_query_blocks(width), "group int, qids binary, queries binary, limits binary")
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = sent.join(blocks, ["group", "salt"]).select("qids", "queries", "limits", "ids", "vectors", "cells", "dists")
    best = pairs.mapInPandas(_solve(centres, width, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
