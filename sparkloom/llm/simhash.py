"""Near-duplicate groups by SimHash: tiles of fingerprints, compared exactly with numpy.

Fingerprints are cut into three words. The population counts of the first two name a fingerprint's tile. Two
fingerprints within ``radius`` differing bits have population counts within ``radius`` of each other, summed over the
words, so a pair of tiles farther apart is never looked at; inside a pair of tiles, the third word's count narrows the
comparison to a slice in the same way. All that remains is compared bit by bit, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import rows_of, staged

SEED = 42
SHINGLE = 3
#: Bits of the three words that population counts are taken of.
WORDS = (21, 21, 22)
#: Fingerprints in a block, and rows of a block compared at once.
BLOCK, STRIP = 8192, 32
#: Keys that a node's links are spread over, and at most those that the comparisons of a pair of tiles are spread over.
SALTS, SPREAD = 4, 16


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text, unsigned; 0 if it has no word."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: n - 1].tolist()]
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    every = np.array(hashes, "<u8")
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(every[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fp = np.fromiter(map(fingerprint, pdf["text"]), np.uint64, len(pdf)).view(np.int64)
        yield pd.DataFrame({"id": pdf["id"], "fp": fp})


def _counts(fp: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for width in WORDS:
        out.append(np.bitwise_count((fp >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    return out


def _blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """The fingerprints of one part of a tile, ordered by the third word's count, as blocks of bounded size."""
    fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
    fp = fp[np.lexsort((fp, _counts(fp)[2]))]
    cut = range(0, len(fp), BLOCK)
    x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
    return pd.DataFrame({"x": x, "y": y, "name": [f"{x}.{y}.{pdf['salt'].iloc[0]}.{i}" for i in cut], "fps": [fp[i : i + BLOCK].tobytes() for i in cut]})


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b as a star for each group: every node but the least with that least one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, root = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, before[left], low)
        np.minimum.at(root, before[right], low)
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            break
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def links_between(a: np.ndarray, b: np.ndarray, radius: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over what links join in two blocks ordered by their third word's count; the other counts differ by ``near``.

    Strip by strip only links between different groups so far are looked at, so a dense group costs no memory.
    """
    nodes = np.unique(np.concatenate([a, b]))
    ia, ib, group = np.searchsorted(nodes, a), np.searchsorted(nodes, b), np.arange(len(nodes))
    rest, ca, cb = radius - near, _counts(a)[2], _counts(b)[2]
    low, high = np.searchsorted(cb, ca - rest), np.searchsorted(cb, ca + rest, "right")
    for i in range(0, len(a), STRIP):
        s = slice(i, i + STRIP)
        start, end = low[i], high[s][-1]  # both ends rise with the row
        r, c = np.nonzero(np.bitwise_count(a[s, None] ^ b[None, start:end]) <= radius)
        x, y = group[ia[i + r]], group[ib[start + c]]
        if (x != y).any():
            x, y = np.divmod(np.unique((x * len(nodes) + y)[x != y]), len(nodes))
            node, root = _forest(x, y)
            to = np.arange(len(nodes))
            to[node] = root
            group = to[group]
    moved = np.flatnonzero(group != np.arange(len(nodes)))
    return nodes[moved].view(np.int64), nodes[group[moved]].view(np.int64)


def _compare(radius: int):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for one, two, near in zip(pdf["fps"], pdf["fps2"], pdf["near"], strict=True):
                x, y = links_between(np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64), radius, near)
                if len(x):
                    yield pd.DataFrame({"a": x, "b": y})

    return compare


def near_links(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b) links over distinct fingerprints ``fp``: in each pair of blocks a spanning forest of what is within ``radius``."""
    at, parts = 0, []
    for width in WORDS[:2]:
        parts.append(F.bit_count(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))).cast("int"))
        at += width
    many = fps.count()
    salt = F.pmod(F.xxhash64("fp"), F.lit(1 + many // (40 * BLOCK))).cast("int")  # a tile of very many is gathered in parts
    tiles = fps.select("fp", parts[0].alias("x"), parts[1].alias("y"), salt.alias("salt"))
    blocks = staged(tiles.groupBy("x", "y", "salt").applyInPandas(_blocks, "x int, y int, name string, fps binary"), "blocks")
    ball = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius and (i, j) >= (0, 0)]
    offset = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ball)))
    out = blocks.select("name", "fps", "x", "y", offset.alias("o")).select(
        F.col("name").alias("name1"), "fps", (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"), (F.abs("o.i") + F.abs("o.j")).alias("near")
    )
    # the middle tiles hold the most: what is compared there is dealt over several keys, to each of which the other side goes
    spread = min(SPREAD, 1 + many // (4 * BLOCK))
    out = out.withColumn("deal", F.pmod(F.xxhash64("name1"), F.lit(spread)).cast("int"))
    other = blocks.select("x", "y", "name", F.col("fps").alias("fps2"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("deal"))
    pairs = out.join(other, ["x", "y", "deal"]).where("near > 0 or name1 <= name")
    return pairs.select("fps", "fps2", "near").mapInPandas(_compare(radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), root being its component's least node: alternating stars.

    Each round links every node's larger neighbours to its least one, then its smaller ones, until nothing moves. The
    edges live in the shared folder from round to round. Nodes with very many links are spread over salted keys.
    """

    def least(sym: DataFrame) -> DataFrame:
        salted = sym.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        to = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return salted.join(to, ["u", "s"]).select("u", "v", "m")

    edges = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")).toDF("u", "v"))
        large = least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        joined = least(large)
        star = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = staged(star, "edges")
        now = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
        seen = now


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """Near-duplicate groups of whole texts: one row for each row of ``docs``.

    Returns ``id_col``, ``fingerprint`` (16 hex digits) and ``component_id``, the least id that links of at most
    ``radius`` differing bits reach. A null or empty text has fingerprint zero and links like any other; rows with equal
    ids or texts each get a row; a null id is never a component's id unless the group has no other (then null). An
    empty table gives an empty result. Other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    fps = staged(rows_of(docs, id=id_col, text=text_col).mapInPandas(_fingerprints, f"id {kind}, fp long"), "fps")
    distinct = staged(fps.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    found = staged(components(near_links(distinct.select("fp"), radius)), "components")
    lows = found.join(distinct, found.node == distinct.fp).groupBy("root").agg(F.min("low").alias("group_low"))
    of = found.join(lows, "root").select(F.col("node").alias("fp"), "group_low")
    ids = staged(distinct.join(of, "fp", "left").select("fp", F.coalesce("group_low", "low").alias("component_id")), "ids")
    return fps.join(ids, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
