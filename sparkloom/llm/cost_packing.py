"""Cost-balanced packing of token sequences: descending pieces go to the sequence with the lowest cost that has room.

A piece of n tokens costs n for what is linear in it and n * n / (6 * width) for attention, which looks at pairs inside a
piece. Documents are cut into full sequences and a remainder; remainders are dealt evenly, by row, over shards of bounded
size. A shard's sequences have just as much room as its remainders have tokens: full ones, and one for each power of two
in what is left over, so none is padded. Pieces that fit nowhere whole are cut.
"""

from __future__ import annotations

import contextlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import rows_of, staged

#: Tokens of a sequence, the id after each document, the width of the model whose costs are estimated, remainders in a shard.
CAPACITY, END, WIDTH, SHARD = 2048, 1, 4096, 4096
#: Documents whose ids are in memory at once.
AT_ONCE = 200
# Fixed value: what byte-level BPE takes as units of a text.
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The ids of a plain byte-level BPE file by their bytes, or None if the file is of another kind."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file["pre_tokenizer"] or {}
    alike = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not file["normalizer"] and not file["truncation"] and not file["padding"]
    if not alike or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    vocabulary = model["vocab"]
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged):  # then a merge's rank isn't its id
        return None
    # a printable byte stands for itself; the others, in order, for the characters from 256 on
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    added = {t["content"] for t in file["added_tokens"]}
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in added}


class Encoder:
    """Ids of whole texts as bytes of little-endian whole numbers, those that ``tokenizers`` gives for a tokenizer file.

    Plain byte-level BPE is encoded by tiktoken with the file's own ranks, in half the time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a text can't forge a control token
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.ranked, ranks = None, byte_ranks(path)
        if ranks:
            with contextlib.suppress(ImportError):  # then tokenizers does it alone
                import tiktoken

                self.ranked = tiktoken.Encoding("ranked", pat_str=UNITS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.ranked is not None:
            return [np.array(self.ranked.encode_ordinary(t), self.kind).tobytes() for t in texts]
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_encoders: dict[str, Encoder] = {}  # of this worker


def _encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel work
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def plain(text: str) -> str:
    """A text as UTF-8 can hold it: halves of surrogate pairs become question marks."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def _cut(path: str, capacity: int, end: int):
    """Texts as pieces of at most ``capacity`` ids, with ``end`` after each text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        size = np.dtype(encoder.kind).itemsize
        last = np.array([end], encoder.kind).tobytes()
        for pdf in batches:
            for i in range(0, len(pdf), AT_ONCE):
                some = pdf.iloc[i : i + AT_ONCE]
                every = [x + last for x in encoder.encode([plain(t) for t in some["text"].fillna("")])]
                pieces = [(row, doc, at // size, len(ids) // size, ids[at : at + capacity * size]) for row, doc, ids in zip(some["row"], some["id"], every, strict=True) for at in range(0, len(ids), capacity * size)]
                for j in range(0, len(pieces), 4096):
                    out = pd.DataFrame(pieces[j : j + 4096], columns=["row", "id", "start", "doc_tokens", "ids"])
                    yield out.assign(length=out["ids"].map(len) // size)

    return cut


def wide(ids: bytes, kind: str) -> bytes:
    return ids if kind == "<u4" else np.frombuffer(ids, kind).astype("<u4").tobytes()


def rooms(tokens: int, capacity: int) -> np.ndarray:
    """Room of each sequence for so many tokens: full ones, and what is left over as powers of two."""
    rest = tokens % capacity
    return np.array([capacity] * (tokens // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)


def cost(tokens, width: int = WIDTH):
    return tokens + tokens * tokens / (6.0 * width)


def balanced(sizes: np.ndarray, capacity: int, width: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in the piece, length, sequence, offset there): longest first, each to the lowest-cost sequence with room.

    Of sequences with equal cost the first is taken. What fits nowhere whole fills the lowest-cost sequence that has any
    room, and its rest is placed in its turn among the pieces that are left.
    """
    room = rooms(int(sizes.sum()), capacity)
    whole = room.copy()
    spent = np.zeros(len(room))
    open_cost = np.where(room > 0, spent, np.inf)
    waiting = [(int(n), int(i), 0) for i, n in enumerate(sizes)]
    waiting.sort(key=lambda x: (-x[0], x[1]))
    rests: list[tuple[int, int, int]] = []  # a heap of what was cut off
    out, at = [], 0
    while at < len(waiting) or rests:
        if rests and (at == len(waiting) or -rests[0][0] >= waiting[at][0]):
            n, piece, start = heapq.heappop(rests)
            n = -n
        else:
            n, piece, start = waiting[at]
            at += 1
        fits = np.where(room >= n, spent, np.inf)
        b = int(fits.argmin())
        if fits[b] == np.inf:
            b = int(open_cost.argmin())
        length = min(n, int(room[b]))
        out.append((piece, start, length, b, int(whole[b] - room[b])))
        room[b] -= length
        spent[b] += cost(length, width)
        open_cost[b] = spent[b] if room[b] else np.inf
        if length < n:
            heapq.heappush(rests, (length - n, piece, start + length))
    return out


def _pack(path: str, capacity: int, width: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = _encoder(path).kind
        size = np.dtype(kind).itemsize
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True]).reset_index(drop=True)
        placed = pd.DataFrame(balanced(pdf["length"].to_numpy(np.int64), capacity, width), columns=["piece", "from", "length", "bin", "offset"])
        of = pdf.iloc[placed["piece"]].reset_index(drop=True)
        ids = [wide(x[a * size : (a + n) * size], kind) for x, a, n in zip(of["ids"], placed["from"], placed["length"], strict=True)]
        return pd.DataFrame(
            {"id": of["id"], "start": of["start"] + placed["from"], "length": placed["length"], "doc_tokens": of["doc_tokens"], "shard": of["shard"], "bin": placed["bin"], "offset": placed["offset"], "ids": ids}
        )

    return pack


def pack_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, width: int = WIDTH, shard: int = SHARD) -> DataFrame:
    """Pack the ids of whole documents, ``end`` after each, into sequences of at most ``capacity``: one row for each piece.

    ``tokenizer`` is the path of a tokenizer file, the same on all machines. Returns ``id_col``, ``start`` (ids of the
    document before the piece), ``length``, ``doc_tokens`` (with ``end``), ``sequence_id``, ``offset`` (in the sequence,
    without gaps from 0) and ``ids`` (binary, little-endian unsigned 32-bit). Every sequence holds ``capacity`` ids or a
    power of two. A null text counts as empty, and an empty one is its ``end`` alone; half surrogates become question
    marks; a null id stays null; repeated rows are packed each for itself, and so are ties, by row; an empty table gives
    an empty result. Other columns are ignored. A shard's ids, ``shard`` times ``capacity`` of them at most, meet in a task.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two, so that what is left over fills sequences of powers of two")
    kind = dict(docs.dtypes)[id_col]
    rows = rows_of(docs, row=F.monotonically_increasing_id(), id=id_col, text=text_col)
    cut = rows.mapInPandas(_cut(tokenizer, capacity, end), f"row long, id {kind}, start long, doc_tokens long, ids binary, length long")
    pieces = staged(cut, "tokens")
    rest, full = pieces.where(F.col("length") < capacity), pieces.where(F.col("length") == capacity)
    shards = max(1, -(-rest.count() // shard))
    own = F.pmod(F.xxhash64("row"), F.lit(shards))
    packed = rest.withColumn("shard", own).groupBy("shard").applyInPandas(_pack(tokenizer, capacity, width), f"id {kind}, start long, length long, doc_tokens long, shard long, bin long, offset long, ids binary")
    columns = ("id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
    packed = packed.withColumn("sequence_id", (F.col("shard") * (1 << 24) + F.col("bin")) * 2).select(*columns)
    stored = _encoder(tokenizer).kind
    widen = F.pandas_udf(lambda s: s.map(lambda x: wide(x, stored)), "binary")
    full = full.withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full.withColumn("ids", widen("ids")).select(*columns)).withColumnRenamed("id", id_col)
