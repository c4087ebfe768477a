"""One large JSON document, cut at its top-level elements by many tasks.

Spark's text reader gives each task a byte range of the file, moved to the next comma (or line, where a comma may be part
of a longer character). What a range does to a reader of
JSON is a small summary that composes: whether it leaves a string that it was entered in or not, and by how much the
depth changes in either case. The summaries of all ranges, a few numbers each, give every range the state that it begins
in; then each range is cut at the commas between elements, and the pieces of an element that lies in several ranges are
put together again. A document may also be written in parts, as a folder of files that follow each other by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import decode
from .scratch import kept

_OPEN, _CLOSE = np.isin(np.arange(256), [ord("["), ord("{")]), np.isin(np.arange(256), [ord("]"), ord("}")])
QUOTE, ESCAPE, COMMA = ord('"'), ord("\\"), ord(",")


def quotes(b: np.ndarray) -> np.ndarray:
    """Which bytes are quotation marks that begin or end a string."""
    found = b == QUOTE
    slashes = np.flatnonzero(b == ESCAPE)
    if len(slashes):
        # of a run of backslashes every second one is escaped itself; what follows an odd run is escaped
        starts = np.flatnonzero(np.diff(slashes, prepend=-2) > 1)
        sizes = np.diff(np.append(starts, len(slashes)))
        after = slashes[starts] + sizes
        after = after[(sizes % 2 == 1) & (after < len(b))]
        found[after] = False
    return found


def steps(b: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """For each byte whether it lies in a string, and by how much it changes the depth; and the state after the last."""
    marks = np.cumsum(quotes(b))
    within = (marks + inside) % 2 == 1
    depth = np.where(within, 0, _OPEN[b].astype(np.int8) - _CLOSE[b])
    return within, depth, bool((int(marks[-1]) if len(marks) else 0) + inside & 1)


def _blocks(batches: Iterator[pd.DataFrame], sep: str, encoding: str) -> Iterator[tuple[str, int, bytes]]:
    """(path, block, UTF-8 bytes): a batch's pieces with what they were read at; a block's bytes come in order."""
    for pdf in batches:
        for (path, block), own in pdf.groupby(["path", "block"], sort=False):
            values = map(bytes, own["value"])
            if encoding != "utf-8":
                values = (decode(v, encoding).encode() for v in values)
            yield path, int(block), b"".join(v + sep.encode() for v in values)


def _summaries(sep: str, encoding: str):
    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[str, int], list[int]] = {}
        for path, block, data in _blocks(batches, sep, encoding):
            b = np.frombuffer(data, np.uint8)
            flips, out, into = found.get((path, block), (0, 0, 0))
            deltas = [int(steps(b, bool(entered))[1].sum()) for entered in (0, 1)]
            # entered outside of a string, the block is now in one if flips is odd; entered inside, if it is even
            found[path, block] = [(flips + int(quotes(b).sum())) % 2, out + deltas[flips], into + deltas[1 - flips]]
        if found:
            yield pd.DataFrame([(*k, *v) for k, v in found.items()], columns=["path", "block", "flips", "out", "into"])

    return summaries


def compose(summaries: list[tuple[str, int, int, int, int]], parts: bool = False) -> tuple[dict[tuple[str, int], tuple[bool, int]], dict[str, tuple[bool, int]]]:
    """The state, in a string and depth, that each block begins in, and that each file ends in; of ``parts``, a file begins as the one before ended."""
    begins, ends, before = {}, {}, (False, 0)
    for path, block, flips, out, into in sorted(summaries):
        inside, depth = ends.get(path, before)
        if parts and ends and path not in ends and (inside, depth) != (False, 1):
            raise ValueError(f"{max(ends)} is no part of a JSON document: it ends inside an element, or outside of the array")
        begins[path, block] = inside, depth
        ends[path] = inside != bool(flips), depth + (into if inside else out)
        before = ends[path] if parts else before
    return begins, ends


def _cut(begins: dict[tuple[str, int], tuple[bool, int]], sep: str, encoding: str):
    """Blocks as pieces: (path, block, i, text, closed). Piece 0 goes on with the element before; ``closed`` ends one."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[tuple[str, int], list] = {}  # in a string, depth, number of the piece, its bytes so far
        for path, block, data in _blocks(batches, sep, encoding):
            inside, depth, i, rest = state.get((path, block)) or [*begins[path, block], 0, b""]
            b = np.frombuffer(data, np.uint8)
            within, change, inside_after = steps(b, inside)
            after = depth + np.cumsum(change, dtype=np.int64)
            # an array's own brackets part elements too; all other text at depth 0 must be blank
            at = np.flatnonzero(~within & ((b == COMMA) & (after == 1) | (change == 1) & (after == 1) & (b == ord("[")) | (change == -1) & (after == 0) & (b == ord("]"))))
            starts, ends = np.append(0, at + 1), np.append(at, len(b))
            pieces = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            pieces[0] = rest + pieces[0]
            done = [(path, block, i + k, p.decode("utf-8", "surrogatepass"), True) for k, p in enumerate(pieces[:-1])]
            if done:
                yield pd.DataFrame(done, columns=["path", "block", "i", "text", "closed"])
            state[path, block] = [inside_after, int(after[-1]), i + len(pieces) - 1, pieces[-1]]
        open_ones = [(p, b, s[2], s[3].decode("utf-8", "surrogatepass"), False) for (p, b), s in state.items()]
        if open_ones:
            yield pd.DataFrame(open_ones, columns=["path", "block", "i", "text", "closed"])

    return cut


def elements(lines: DataFrame, sep: str = ",", encoding: str = "utf-8", parts: bool = False) -> DataFrame:
    """(path, block, i, text): the elements of each file's array, in the order of those columns; a file that is no array is one element.

    lines: files as (path, block, n, value), read at ``sep``. With ``parts`` the files, by name, are one document; each
    must end between two elements. A ValueError says if a document ends inside a string or a bracket, or a part elsewhere.
    Elements are not parsed.
    """
    spark = lines.sparkSession
    # a few numbers for each range of a file
    begins, ends = compose([tuple(r) for r in lines.mapInPandas(_summaries(sep, encoding), "path string, block long, flips int, out long, into long").collect()], parts)
    whole = {p: ends[p] for p in [max(ends)]} if parts and ends else ends
    broken = sorted(p for p, (inside, depth) in whole.items() if inside or depth)
    if broken:
        raise ValueError(f"{broken[0]} is no valid JSON: it ends inside a {'string' if whole[broken[0]][0] else 'bracket'}, or closes one that isn't open")
    pieces = kept(lines.mapInPandas(_cut(begins, sep, encoding), "path string, block long, i long, text string, closed boolean"), "pieces")
    # a piece that isn't closed, and the first of a block, are parts of the element that began last
    counts = {(r.path, r.block): r.n for r in pieces.groupBy("path", "block").agg(F.max("i").alias("n")).collect()}
    owner, last = {}, {}
    for p, b in sorted(counts):
        document = "" if parts else p
        owner[p, b] = last.get(document, (p, b, 0))
        if counts[p, b] or document not in last:
            last[document] = (p, b, counts[p, b])
    of = spark.createDataFrame([(*k, *v) for k, v in owner.items()] or [("", 0, "", 0, 0)], "path string, block long, own_path string, own_block long, own_i long")
    ends_of = pieces.where("i = 0 or not closed").join(F.broadcast(of), ["path", "block"])
    own = (F.when(F.col("i") == 0, F.col(f"own_{c}")).otherwise(F.col(c)).alias(c) for c in ("path", "block", "i"))
    ends_of = ends_of.select(*own, F.struct(F.col("path").alias("file"), F.col("block").alias("at"), "text").alias("part"))
    joined = ends_of.groupBy("path", "block", "i").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["text"]), "").alias("text"))
    every = pieces.where("i > 0 and closed").select("path", "block", "i", "text").unionByName(joined)
    return every.where(F.trim(F.translate("text", "\t\r\n﻿,", "     ")) != "")
