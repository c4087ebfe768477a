"""Periodic runs of words: maximal repetitions, found from the Lyndon words that start at each place.

A run with period q has a Lyndon word of length q inside, for one of the two orders of words, that is the longest one to
start at its place. So every place gives two candidates, by the next smaller suffix in either order; each is extended to
both sides by longest common extensions, which suffix trees of the stretch and of its reversal answer in constant time
from the Euler tours of their nodes' depths. A run of twelve words or more repeats six words in a row at least, so only
stretches that repeated six-word sequences cover are built into trees: every such run lies inside one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import rows_of, staged

#: Least length of a run in words. Half of it is the length of the sequences that a run must repeat.
LEAST = 12


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers from 1, equal words alike."""
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids) + 1) for w in words), np.int64, len(words))


def covered(x: np.ndarray, size: int) -> np.ndarray:
    """Which places lie in a sequence of ``size`` numbers that occurs twice or more (by hash, so a few others may too)."""
    n = len(x) - size + 1
    if n < 2:
        return np.zeros(len(x), bool)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[i : i + n].astype(np.uint64)
            h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    repeated = np.zeros(n, bool)
    repeated[order[1:][same]] = repeated[order[:-1][same]] = True
    edges = np.zeros(len(x) + 1, np.int64)
    edges[:n] += repeated
    edges[size : size + n] -= repeated
    return np.cumsum(edges[:-1]) > 0


class SuffixTree:
    """Ukkonen's suffix tree of whole numbers from 1, with 0 put after them, and an Euler tour of its nodes' depths."""

    def __init__(self, x: list[int]):
        self.s = [*x, 0]
        self._build()
        self._tour()

    def _build(self) -> None:
        s = self.s
        n = len(s)
        width = self.width = max(s) + 1
        child: dict[int, int] = {}  # by node * width + first number of the edge
        start, end, link = [0], [0], [0]  # an edge's label; leaves end at n
        node = length = edge = waiting = 0  # edge: place of the active edge's first number
        for i, c in enumerate(s):
            waiting += 1
            inner = 0  # made in this step, still without a link
            while waiting:
                if not length:
                    edge = i
                key = node * width + s[edge]
                down = child.get(key)
                if down is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if inner:
                        link[inner] = node
                        inner = 0
                else:
                    first = start[down]
                    size = (end[down] if end[down] < i + 1 else i + 1) - first
                    if length >= size:
                        edge += size
                        length -= size
                        node = down
                        continue
                    if s[first + length] == c:
                        length += 1
                        if inner:
                            link[inner] = node
                        break
                    split = len(start)
                    start.append(first)
                    end.append(first + length)
                    link.append(0)
                    child[key] = split
                    child[split * width + c] = split + 1
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    start[down] = first + length
                    child[split * width + s[first + length]] = down
                    if inner:
                        link[inner] = split
                    inner = split
                waiting -= 1
                if not node and length:
                    length -= 1
                    edge = i - waiting + 1
                elif node:
                    node = link[node]
        self.child, self.start, self.end = child, start, end

    def _tour(self) -> None:
        n, count = len(self.s), len(self.start)
        keys = np.fromiter(self.child.keys(), np.int64, len(self.child))
        to = np.fromiter(self.child.values(), np.int64, len(self.child))
        order = np.argsort(keys)
        parent, to = keys[order] // self.width, to[order]
        at = np.searchsorted(parent, np.arange(count + 1)).tolist()
        size = (np.array(self.end) - np.array(self.start)).tolist()
        below = to.tolist()
        depth = [0] * count
        tour: list[int] = []  # depths, in the order in which the tour meets nodes
        first, leaves = [0] * n, []
        stack = [0]
        while stack:
            v = stack.pop()
            if v < 0:
                tour.append(depth[~v])
                continue
            d = depth[v]
            low, high = at[v], at[v + 1]
            if low == high:
                i = n - d
                first[i] = len(tour)
                leaves.append(i)
            else:
                for k in range(high - 1, low - 1, -1):
                    u = below[k]
                    depth[u] = d + size[u]
                    stack.append(u)
                    if k > low:
                        stack.append(~v)
            tour.append(d)
        self.first = np.array(first)
        self.rank = np.empty(n, np.int64)
        self.rank[leaves] = np.arange(n)
        table = [np.array(tour, np.int32)]
        while 2 << (len(table) - 1) <= len(tour):
            half, last = 1 << (len(table) - 1), table[-1]
            table.append(np.minimum(last[:-half], last[half:]))
        self.table = table
        # the order of suffixes under which larger words come first, a suffix still before those that it begins
        stack, leaves = [0], []
        while stack:
            v = stack.pop()
            low, high = at[v], at[v + 1]
            if low == high:
                leaves.append(n - depth[v])
                continue
            ends = self.s[self.start[below[low]]] == 0
            stack.extend(below[low + ends : high])
            if ends:
                stack.append(below[low])
        self.other_rank = np.empty(n, np.int64)
        self.other_rank[leaves] = np.arange(n)
        del self.child, self.start, self.end

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common beginning of the suffixes at i and j, pair by pair; i and j differ."""
        a, b = self.first[i], self.first[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            of = level == k
            out[of] = np.minimum(self.table[k][low[of]], self.table[k][high[of] - (1 << int(k)) + 1])
        return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller rank."""
    out, stack = [0] * len(rank), []
    for i, r in enumerate(rank.tolist()):
        while stack and stack[-1][0] > r:
            out[stack.pop()[1]] = i
        stack.append((r, i))
    for _, i in stack:
        out[i] = len(rank)
    return np.array(out)


def runs_of_stretch(x: list[int], least: int) -> np.ndarray:
    """All runs (start, length, period) of at least ``least`` numbers, in no order."""
    n = len(x)
    tree, back = SuffixTree(x), SuffixTree(x[::-1])
    found = []
    for rank in (tree.rank, tree.other_rank):
        i = np.arange(n)
        q = _next_smaller(rank)[:n] - i
        i, q = i[i + q < n], q[i + q < n]
        right = tree.common(i, i + q)
        left = np.zeros(len(i), np.int64)
        more = i > 0
        left[more] = back.common(n - i[more], n - i[more] - q[more])  # the suffix at n - i of the reversal is the beginning up to i
        length = left + right + q
        ok = (left + right >= q) & (length >= least)
        found.append(np.stack([(i - left)[ok], length[ok], q[ok]], 1))
    return np.unique(np.concatenate(found), axis=0)


def runs(x: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs (start, length, period) of at least ``least`` numbers, by start, then period.

    Stretches that repeated sequences cover go into one pair of trees, with a number of its own after each, which no run
    contains.
    """
    inside = covered(x, max(1, least // 2))
    none = np.zeros((0, 3), np.int64)
    if not inside.any():
        return none
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    wide = ends - starts >= least
    starts, ends = starts[wide], ends[wide]
    if not len(starts):
        return none
    places = np.concatenate([np.append(np.arange(a, b), -1) for a, b in zip(starts, ends, strict=True)])
    values = np.where(places >= 0, np.unique(x[places], return_inverse=True)[1] + 1, 0)
    gaps = places < 0
    values[gaps] = values.max() + 1 + np.arange(gaps.sum())
    found = runs_of_stretch(values.tolist(), least)
    found[:, 0] = places[found[:, 0]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stay, if each run keeps its first period alone."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def repeated_words(doc_id: str, words: list[bytes]) -> list[bytes]:
    """For one in ten ids, by crc32, the words from some place on as repetitions of the first of them."""
    h, n = zlib.crc32(doc_id.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _found(least: int, planted: bool, with_text: bool):
    def of(doc_id, text):
        words = (text or "").encode("utf-8", "replace").split()  # bytes: only ASCII space splits
        if planted:
            words = repeated_words("" if doc_id is None else str(doc_id), words)
        found = runs(numbered(words), least)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist())
        stay = collapsed(len(words), found)
        kept = b" ".join([w for w, k in zip(words, stay.tolist(), strict=True) if k]) if len(found) else b" ".join(words)
        best = min(found.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        out = (len(found), *best, 1000 * best[1] // best[2] if len(found) else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
        return (*out, [dict(zip(("start", "length", "period"), r, strict=True)) for r in found.tolist()], kept.decode()) if with_text else out

    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", *(["runs", "collapsed"] if with_text else [])]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 200):
                some = pdf.iloc[i : i + 200]
                out = pd.DataFrame([of(d, t) for d, t in zip(some["name"], some["text"], strict=True)], columns=names)
                for c in ("start", "length", "period", "exponent_milli"):
                    out[c] = out[c].astype("Int64")
                yield pd.concat([some[["id"]].reset_index(drop=True), out], axis=1)

    return each


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, planted: bool = False, with_text: bool = False) -> DataFrame:
    """The periodic runs of each whole text's words: one row for each row of ``docs``.

    A run is a stretch of words with smallest period q, of length max(``least``, 2 q) or more, that can't be extended.
    Returns ``id_col``, ``n_runs``; of the longest run (ties: first start, then smaller period; nulls if there is none)
    ``start``, ``length``, ``period``, ``exponent_milli``; ``runs_sha256`` of all runs as lines, ``collapsed_sha256`` of the
    words that are left when every run keeps its first period, and, with ``with_text``, those ``runs`` and words
    themselves (``collapsed``). ``planted`` makes ``repeated_words`` of a text first. Null and empty texts have no words;
    rows with equal ids or texts each get a row; an empty table gives an empty result. Other columns are ignored. Texts
    never meet; trees take about a kilobyte for each word that repeated sequences cover, so that much of one text must
    fit in a task.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    kind = dict(docs.dtypes)[id_col]
    rows = rows_of(docs, id=id_col, name=F.col(f"`{id_col}`").cast("string"), text=text_col)
    more = ", runs array<struct<start: long, length: long, period: long>>, collapsed string" if with_text else ""
    made = rows.mapInPandas(_found(least, planted, with_text), f"id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string{more}")
    return staged(made, "runs").withColumnRenamed("id", id_col)
