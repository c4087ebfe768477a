"""Scoring by a Katz backoff model: trigrams (if asked for), then bigrams, then words, then one class for all unknown words.

Counts are Good-Turing discounted, and every context's backoff weight makes its probabilities sum to one exactly. Texts
are cut into tokens once, in chunks that live in the shared folder. A chunk asks for its distinct words, then its distinct
bigrams, then its distinct trigrams, as packed blocks of numbers that go to owners: of the word, of the bigram's context,
of the trigram's context. An owner adds up what chunks have counted, writes its part of the order's table, partitioned by
order in the shared folder, and answers each chunk with counts over the whole corpus and what backing off needs. Each
token is then scored in its chunk by the recursion. Other texts can be scored later from the tables alone. A context that
makes up a thousandth of all tokens or more (there are at most a thousand) is dealt over all owners by its words, and its
totals are added up on the way.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bucketed, even_keys, in_fold, partitions, release_memory, rows_of, staged

#: Tokens in a chunk; counts above LARGE are not discounted; contexts of a HOT-th of all tokens are dealt by word; entries that an owner spreads out at once.
CHUNK, LARGE, HOT, SLICE = 750_000, 5, 1000, 400_000
#: Words in an n-gram; 3 is the most.
ORDER = 2
#: No word can be a line feed, which stands for the text's end.
END_TOKEN = b"\n"


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END_TOKEN]


def _pack(**arrays: np.ndarray) -> bytes:
    import zstandard

    out = io.BytesIO()
    np.savez(out, **arrays)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    import zstandard

    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data)), allow_pickle=False) as x:
        return {k: x[k] for k in x.files}


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type."""
    top, low = int(x.max(initial=0)), int(x.min(initial=0))
    if low < 0:
        return x.astype(np.int64)
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)


def _steps(x: np.ndarray) -> np.ndarray:
    return _small(np.diff(x, prepend=0))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    task = TaskContext.get().partitionId()
    for number, chunk in enumerate(_cut(batches)):
        yield pd.DataFrame({"chunk": [(task << 20) + number], **{k: [v] for k, v in chunk.items()}})


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    import xxhash

    size, ids, held, lengths, pieces, index = 0, [], [], [], [], {}

    def flush() -> dict:
        words = np.fromiter((xxhash.xxh64_intdigest(w) for w in index), np.uint64, len(index))
        flat = np.concatenate(pieces)
        counts = np.bincount(flat[np.repeat(~np.array(held, bool), lengths)], minlength=len(words))
        body = _pack(tokens=_small(flat), lengths=np.array(lengths, np.int64), held=np.array(held, bool))
        return {"ids": ids, "words": _pack(words=words, counts=_small(counts)), "body": body}

    for pdf in batches:
        for doc, text, out in zip(pdf["id"].tolist(), pdf["text"], pdf["held"], strict=True):
            own = tokens(text)
            flat = np.fromiter((index.setdefault(t, len(index)) for t in own), np.int64, len(own))
            ids.append(None if doc is None or doc != doc else doc)
            held.append(bool(out))
            lengths.append(len(own))
            pieces.append(flat.astype(np.int32))
            size += len(own)
            if size >= CHUNK or len(lengths) >= 50_000:
                yield flush()
                size, ids, held, lengths, pieces, index = 0, [], [], [], [], {}
                release_memory()
    if ids:
        yield flush()


def _owner(keys: np.ndarray, owners: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(owners)).astype(np.int64)


def _mix(h: np.ndarray, w: np.ndarray | int = 0) -> np.ndarray:
    """One 64-bit key for a context and a word, by their numbers."""
    x = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (np.atleast_1d(w).astype(np.uint64) + np.uint64(0xBF58476D1CE4E5B9)) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def discounts(ranks: list[float]) -> np.ndarray:
    """Factors for counts 0 to LARGE (0 is unused): Katz's from numbers of items counted 1 to LARGE + 1.

    Where these numbers give no factors between 0 and 1, as in small corpora, a constant is taken off instead.
    """
    n = [0.0, *map(float, ranks)]
    out = np.ones(LARGE + 1)
    if all(n[1 : LARGE + 2]):
        top = (LARGE + 1) * n[LARGE + 1] / n[1]
        if top < 1:
            for r in range(1, LARGE + 1):
                out[r] = ((r + 1) * n[r + 1] / n[r] / r - top) / (1 - top)
            if (out[1:] > 0).all() and (out[1:] < 1).all():
                return out
    off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    out[1:] = [(r - off) / r for r in range(1, LARGE + 1)]
    return out


def _kept(factor: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts after discounting."""
    return factor[np.where(counts > LARGE, 0, counts)] * counts


@dataclass
class Words:
    """The lowest order: probabilities of words by their count, and of the unknown class, which sum to one."""

    total: int
    types: int
    ranks: list[int]

    def __post_init__(self):
        self.factor = discounts(self.ranks)
        taken = sum((1 - self.factor[r]) * r * self.ranks[r - 1] for r in range(1, LARGE + 1))
        self.divisor = self.total + (taken <= 0)  # nothing discounted: one count is set aside for the unknown
        self.unknown = (taken if taken > 0 else 1.0) / max(self.divisor, 1)
        if not self.total:
            self.unknown = 1.0

    def chance(self, counts: np.ndarray) -> np.ndarray:
        c = counts.astype(np.int64)
        return np.where(c > 0, _kept(self.factor, c) / max(self.divisor, 1), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1.0) / (self.total + self.types + 1.0))


@dataclass
class Higher:
    """An order's discounts, and its hot contexts by number with their facts (as of ``_context_facts``)."""

    factor: np.ndarray
    names: np.ndarray
    facts: np.ndarray


@dataclass
class Katz:
    """What every task needs to know of a model; the rest is in its tables."""

    words: Words
    docs: int
    owners: int
    order: int = ORDER
    higher: dict[int, Higher] = field(default_factory=dict)

    @property
    def hot_from(self) -> int:
        return max(1, -(-self.words.total // HOT))


# Words: requests are hashes in order; a word's number is its place with its owner, 0 is the start, -1 a word in no table.


def _word_blocks(owners: int):
    def requests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, packed in zip(pdf["chunk"], pdf["words"], strict=True):
                x = _unpack(packed)
                owner = _owner(x["words"], owners)
                order = np.lexsort((x["words"], owner))
                cuts = np.searchsorted(owner[order], np.arange(owners + 1))
                for o in range(owners):
                    own = order[cuts[o] : cuts[o + 1]]
                    if len(own):
                        yield pd.DataFrame({"owner": [o], "chunk": [chunk], "block": [_pack(words=x["words"][own], times=_small(x["counts"][own]))]})

    return requests


def _own_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """The owner's part of the table, and answers to each chunk: numbers and corpus counts of its words.

    Rows of chunk -1 are the table if there is one; then nothing is counted.
    """
    sent = [_unpack(b) for b in pdf["block"]]
    table = (pdf["chunk"] == -1).to_numpy()
    words, place = np.unique(np.concatenate([x["words"] for x in sent]), return_inverse=True)
    times = np.concatenate([x["times"].astype(float) * (t or not table.any()) for x, t in zip(sent, table, strict=True)])
    total = np.bincount(place, times, len(words)).astype(np.int64)
    number = np.arange(len(words))
    if table.any():
        number = np.full(len(words), -1)
        for x in (x for x, t in zip(sent, table, strict=True) if t):
            number[np.searchsorted(words, x["words"])] = np.arange(len(x["words"]))
    cuts = np.cumsum([0, *(len(x["words"]) for x in sent)])
    owner = int(pdf["owner"].iloc[0])
    out = [(owner, int(c), _pack(number=_small(number[place[a:b]]), counts=_small(total[place[a:b]])), None) for c, a, b in zip(pdf["chunk"], cuts[:-1], cuts[1:], strict=True) if c >= 0]
    if not table.any():
        facts = [float(total.sum()), float((total > 0).sum()), *(float((total == r).sum()) for r in range(1, LARGE + 2))]
        out += [(owner, -1, _pack(words=words, times=_small(total)), None), (owner, -2, None, [0.0, *facts])]
    return pd.DataFrame(out, columns=["owner", "chunk", "block", "facts"])


# Higher orders. An entry is a context, a word, the count of what it backs off to, and how often the chunk has it in
# training texts. Blocks are in the order of contexts and words.


@dataclass
class Entries:
    """A chunk's distinct n-grams of one order and which of them each token ends; -1 for none."""

    at: np.ndarray
    context: np.ndarray
    total: np.ndarray
    divisor: np.ndarray
    word: np.ndarray
    lower: np.ndarray
    times: np.ndarray

    def owner(self, owners: int, hot_from: int) -> np.ndarray:
        return _owner(np.where(self.total >= hot_from, _mix(self.context, self.word), _mix(self.context)), owners)

    def order(self, owner: np.ndarray) -> np.ndarray:
        return np.lexsort((self.word, self.context, owner))


def _block(k: int, context: np.ndarray, hot: np.ndarray, word: np.ndarray, lower: np.ndarray, times: np.ndarray, **more: np.ndarray) -> bytes:
    """Entries packed: each context and each word once; ``hot`` are the places of hot contexts. A word's own count goes with the word."""
    start = np.flatnonzero(np.diff(context, prepend=context[0] - 1))
    w, first, wi = np.unique(word, return_index=True, return_inverse=True)
    of = {"wc": _small(lower[first])} if k == 2 else {"lc": _small(lower)}
    ends = np.diff(np.append(start, len(context)))
    return _pack(h=_small(np.append(context[:1], np.diff(context[start]))), hot=_small(np.flatnonzero(hot[start])), runs=_small(ends), w=_small(np.append(w[:1], np.diff(w))), wi=_small(wi), times=_small(times), **of, **more)


class Chunk:
    """A chunk's tokens, and what the owners have answered so far."""

    def __init__(self, model: Katz, words: bytes, body: bytes, answers: list[list[tuple[int, bytes]]]):
        x, known = _unpack(body), _unpack(words)["words"]
        self.model, self.flat, self.lengths, self.held = model, x["tokens"].astype(np.int64), x["lengths"], x["held"]
        n, owner = len(known), _owner(known, model.owners)
        order = np.lexsort((known, owner))
        cuts = np.searchsorted(owner[order], np.arange(model.owners + 1))
        # the last one is the start of a text
        self.number, self.count = np.append(np.full(n, -1), 0), np.append(np.zeros(n, np.int64), model.docs)
        for o, block in answers[0]:
            got, own = _unpack(block), order[cuts[o] : cuts[o + 1]]
            place = got["number"].astype(np.int64)
            self.number[own] = np.where(place < 0, -1, place * model.owners + o + 1)
            self.count[own] = got["counts"]
        self.first = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(~self.held, self.lengths)
        self.orders = {}
        for k in range(2, min(len(answers) + 1, model.order) + 1):
            self.orders[k] = entries = self.bigrams() if k == 2 else self.trigrams()
            if k <= len(answers):
                self.take(k, entries, answers[k - 1])

    def bigrams(self) -> Entries:
        n = len(self.number)
        before = np.empty(len(self.flat), np.int64)
        before[1:] = self.flat[:-1]
        before[self.first] = n - 1
        key, at = np.unique(before * n + self.flat, return_inverse=True)
        h, self.last = np.divmod(key, n)
        self.before = h
        return Entries(at, self.number[h], self.count[h], np.ones(len(key), np.int64), self.number[self.last], self.count[self.last], np.bincount(at, self.train, len(key)).astype(np.int64))

    def trigrams(self) -> Entries:
        two = self.orders[2].at
        m = len(self.before)
        inner = np.ones(len(self.flat), bool)
        inner[self.first] = False
        key, place = np.unique(two[np.flatnonzero(inner) - 1] * m + two[inner], return_inverse=True)
        h, low = np.divmod(key, m)
        at = np.full(len(self.flat), -1)
        at[inner] = place
        self.above = low  # the bigram that each trigram backs off to
        return Entries(at, self.numbers[h], self.counts[2][h], self.divisors[2][low], self.number[self.last[low]], self.counts[2][low], np.bincount(place, self.train[inner], len(key)).astype(np.int64))

    def take(self, k: int, e: Entries, answers: list[tuple[int, bytes]]) -> None:
        """Counts of the entries of order k, divisors of their contexts, and chances by the recursion."""
        if k == 2:
            self.counts, self.divisors, self.chances = {}, {}, {}
        model, higher = self.model, self.model.higher[k]
        owner = e.owner(model.owners, model.hot_from)
        order = e.order(owner)
        cuts = np.searchsorted(owner[order], np.arange(model.owners + 1))
        n = len(e.context)
        count, number, none, alpha = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, bool), np.ones(n)
        for o, block in answers:
            got, own = _unpack(block), order[cuts[o] : cuts[o + 1]]
            count[own] = got["counts"]
            if "number" in got:
                place = np.cumsum(got["number"].astype(np.int64))
                number[own] = np.where(got["known"], place * model.owners + o + 1, -1)
            context = e.context[own]
            of = np.cumsum(np.diff(context, prepend=context[0] - 1) != 0) - 1  # place of each entry's context in the block
            none[own] = got["none"][of]
            if len(got["asked"]):
                weight = np.ones(int(of[-1]) + 1)
                start = np.flatnonzero(np.diff(of, prepend=-1))
                asked = own[start[got["asked"]]]
                weight[got["asked"]] = backoff(got["facts"], e.total[asked], e.divisor[asked], higher.factor)[1]
                alpha[own] = weight[of]
        hot = np.flatnonzero(e.total >= model.hot_from)
        if len(hot) and len(higher.names):
            at = np.minimum(np.searchsorted(higher.names, e.context[hot]), len(higher.names) - 1)
            found = higher.names[at] == e.context[hot]
            hot, at = hot[found], at[found]
            divisor, weight = backoff(higher.facts[at], e.total[hot], e.divisor[hot], higher.factor)
            none[hot], alpha[hot] = divisor > e.total[hot], weight
        self.numbers, self.counts[k], self.divisors[k] = number, count, e.total + none
        lower = model.words.chance(self.count[self.last]) if k == 2 else self.chances[k - 1][self.above]
        # the recursion: an n-gram's own discounted count, or its context's weight times the chance one order down
        self.chances[k] = np.where(count > 0, _kept(higher.factor, count) / np.maximum(self.divisors[k], 1), alpha * lower)

    def scores(self) -> dict[str, np.ndarray]:
        doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        value = np.log10(self.chances[2])[self.orders[2].at]
        top = max(self.chances)
        if top > 2:
            at = self.orders[top].at
            value = np.where(at >= 0, np.log10(self.chances[top])[at] if len(self.chances[top]) else value, value)
        sums = lambda x: np.bincount(doc, x, len(self.lengths))
        own = self.count[self.flat]
        return {"held_out": self.held, "n_tokens": self.lengths, "n_known": sums(own > 0).astype(np.int64), "train_tokens": self.model.words.total, "base_score": sums(self.model.words.base(own)), "score": sums(value)}


def _requests(model: Katz, k: int):
    def requests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                e = Chunk(model, row.words, row.body, _sorted_answers(row, k)).orders[k]
                owner = e.owner(model.owners, model.hot_from)
                order = e.order(owner)
                cuts = np.searchsorted(owner[order], np.arange(model.owners + 1))
                for o in range(model.owners):
                    own = order[cuts[o] : cuts[o + 1]]
                    if len(own):
                        yield pd.DataFrame({"owner": [o], "chunk": [row.chunk], "block": [_block(k, e.context[own], e.total[own] >= model.hot_from, e.word[own], e.lower[own], e.times[own])]})
                release_memory()

    return requests


def _sorted_answers(row, k: int) -> list[list[tuple[int, bytes]]]:
    """The answers to a chunk of all orders below k, each by owner; a chunk of single tokens has no trigrams, and so no answers to them."""
    given = (getattr(row, f"a{i}") for i in range(1, k))
    return [[] if own is None else sorted((a["owner"], bytes(a["block"])) for a in own) for own in given]


def _spread(x: dict[str, np.ndarray], a: int, b: int) -> tuple[np.ndarray, ...]:
    """A block's entries of its contexts a to b: context, whether it is hot, word, count of what it backs off to, times."""
    runs = x["runs"].astype(np.int64)
    at = np.cumsum(np.append(0, runs))
    own, of = slice(at[a], at[b]), np.repeat(np.arange(a, b), runs[a:b])
    hot = np.zeros(len(runs), bool)
    hot[x["hot"]] = True
    wi = x["wi"][own]
    return x["h"][of], hot[of], x["w"][wi], (x["wc"][wi] if "wc" in x else x["lc"][own]).astype(np.int64), x["times"][own].astype(np.int64)


def _slices(sent: list[dict[str, np.ndarray]]) -> Iterator[list[tuple[int, int]]]:
    """For each block the range of its contexts, slice by slice in the order of contexts, of about SLICE entries at once."""
    for x in sent:
        x["h"], x["w"] = np.cumsum(x["h"], dtype=np.int64), np.cumsum(x["w"], dtype=np.int64)
    h = np.concatenate([x["h"] for x in sent])
    order = np.argsort(h, kind="stable")
    h, runs = h[order], np.concatenate([x["runs"] for x in sent])[order].astype(np.int64).cumsum()
    many = max(1, -(-int(runs[-1]) // SLICE))
    ends = np.unique(h[np.minimum(np.searchsorted(runs, SLICE * np.arange(1, many + 1)), len(h) - 1)])
    ends[-1] = h[-1]
    low = [0] * len(sent)
    for end in ends:
        high = [int(np.searchsorted(x["h"], end, "right")) for x in sent]
        yield list(zip(low, high, strict=True))
        low = high


def _context_facts(context: np.ndarray, count: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context with training n-grams: how many have count 1 .. LARGE, the sum of larger counts, sum of chances one order down (without their divisor)."""
    seen = count > 0
    names, at = np.unique(context[seen], return_inverse=True)
    facts = np.zeros((len(names), LARGE + 2))
    c = count[seen]
    for r in range(1, LARGE + 1):
        facts[:, r - 1] = np.bincount(at, c == r, len(names))
    facts[:, LARGE] = np.bincount(at, np.where(c > LARGE, c, 0), len(names))
    facts[:, LARGE + 1] = np.bincount(at, chance[seen], len(names))
    return names, facts


def backoff(facts: np.ndarray, total: np.ndarray, lower: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(divisor, backoff weight) for contexts: what discounts leave, over the words that the context hasn't; lower: the divisor one order down."""
    r = np.arange(1, LARGE + 1)
    none = ~facts[:, :LARGE].any(1)  # only large counts: one count is set aside
    left = facts[:, :LARGE] @ ((1 - factor[1:]) * r)
    divisor = total + none
    rest = np.maximum(1 - facts[:, LARGE + 1] / lower, 1e-15)
    return divisor, np.where(none, 1.0, left) / divisor / rest


def _own(model: Katz, k: int):
    words, lower = model.words, model.higher.get(k - 1)

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        """The owner's part of the order's table, answers to each chunk, and facts: counts of counts, and of hot contexts.

        Rows of chunk -1 are the table if there is one; then nothing is counted.
        """
        sent, owner = [_unpack(b) for b in pdf["block"]], int(pdf["owner"].iloc[0])
        chunks = pdf["chunk"].to_numpy(np.int64)
        stored = bool((chunks == -1).any())
        answers = [{"counts": [], "number": [], "known": [], "none": [], "asked": [], "facts": []} for _ in sent]
        ranks, offset, out = np.zeros(LARGE + 1), 0, []
        base = np.zeros(len(sent), np.int64)
        for ranges in _slices(sent):
            parts = [_spread(x, a, b) for x, (a, b) in zip(sent, ranges, strict=True)]
            size = np.array([len(p[0]) for p in parts])
            context, hot, word, low, times = (np.concatenate(c) for c in zip(*parts, strict=True))
            names, ci = np.unique(context, return_inverse=True)
            vocabulary, wi = np.unique(word, return_inverse=True)
            _, first, place = np.unique(ci * len(vocabulary) + wi, return_index=True, return_inverse=True)
            if stored:
                times = times * np.repeat(chunks == -1, size)
            count = np.bincount(place, times, len(first)).astype(np.int64)
            number = offset + np.arange(len(first))
            if stored:
                number = np.full(len(first), -1)
                at = 0
                for i, (x, (a, b)) in enumerate(zip(sent, ranges, strict=True)):
                    if chunks[i] == -1 and "number" in x:
                        start = int(x["runs"][:a].sum())
                        number[place[at : at + size[i]]] = np.cumsum(x["number"].astype(np.int64))[start : start + size[i]]
                    at += size[i]
            offset += len(first)
            low, hot = low[first], hot[first]
            # chances one order down, but for their divisor: that is the same in all of a context, and the chunk has it
            chance = words.chance(low) if k == 2 else _kept(lower.factor, low)
            facts_of, facts = _context_facts(ci[first][~hot], count[~hot], chance[~hot])
            seen, none = np.zeros(len(names), np.int64) - 1, np.zeros(len(names), bool)
            seen[facts_of] = np.arange(len(facts_of))
            none[facts_of] = ~facts[:, :LARGE].any(1)
            if not stored:
                ranks += [(count == r).sum() for r in range(1, LARGE + 2)]
                hot_names, hot_facts = _context_facts(context[first][hot], count[hot], chance[hot])
                out += [(owner, int(n), None, [2.0, *f]) for n, f in zip(hot_names, hot_facts, strict=True)]
                keep = count > 0
                if keep.any():
                    f = first[keep]
                    out.append((owner, -1, _block(k, context[f], hot[keep], word[f], low[keep], count[keep], number=_steps(number[keep])), None))
            at = 0
            for i, answer in enumerate(answers):
                entries = place[at : at + size[i]]
                at += size[i]
                if chunks[i] == -1 or not len(entries):
                    base[i] += ranges[i][1] - ranges[i][0]
                    continue
                block_ci = ci[at - size[i] : at]
                start = np.flatnonzero(np.diff(block_ci, prepend=-1))
                of = block_ci[start]
                unseen = np.unique(np.repeat(np.arange(len(start)), np.diff(np.append(start, size[i])))[count[entries] == 0])
                unseen = unseen[seen[of[unseen]] >= 0]
                answer["counts"].append(count[entries])
                answer["number"].append(number[entries])
                answer["none"].append(none[of])
                answer["asked"].append(unseen + base[i])
                answer["facts"].append(facts[seen[of[unseen]]])
                base[i] += len(start)
        for c, a in zip(chunks, answers, strict=True):
            if c >= 0:
                number = np.concatenate(a["number"])
                numbers = {"number": _steps(np.maximum.accumulate(number)), "known": number >= 0} if k < model.order else {}
                facts = np.concatenate(a["facts"])
                out.append((owner, int(c), _pack(counts=_small(np.concatenate(a["counts"])), none=np.concatenate(a["none"]), asked=_small(np.concatenate(a["asked"])), facts=facts, **numbers), None))
        if not stored:
            out.append((owner, -2, None, [1.0, *ranks, 0.0]))
        return pd.DataFrame(out, columns=["owner", "chunk", "block", "facts"])

    return own


def _by_owner(work):
    """A function of one owner's rows as one of a partition's batches. Owners are dealt one to a partition, unsorted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if got:
            for _, own in pd.concat(got, ignore_index=True).sort_values(["owner", "chunk"], kind="stable").groupby("owner"):
                yield work(own.reset_index(drop=True))
                release_memory()

    return run


def _scores(model: Katz):
    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield pd.DataFrame({"id": list(row.ids), **Chunk(model, row.words, row.body, _sorted_answers(row, model.order + 1)).scores()})
                release_memory()

    return scores


@dataclass
class Fitted:
    """A model and its tables by order, 1 for words: (owner, chunk, block), in the shared folder."""

    model: Katz
    tables: dict[int, DataFrame] = field(default_factory=dict)


class _Exchange:
    """Texts in chunks, and the answers to them order by order."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, modulus: int, held: int, owners: int | None = None):
        self.spark, self.kind = docs.sparkSession, dict(docs.dtypes)[id_col]
        self.owners = owners or partitions(self.spark)
        self.keys = even_keys(self.spark, self.owners)
        self.rows = rows_of(docs, id=id_col, text=text_col, held=in_fold(F.col(f"`{id_col}`"), modulus, held))
        self.chunks = bucketed(self.rows.mapInPandas(_chunks, f"chunk long, ids array<{self.kind}>, words binary, body binary"), "chunks", "chunk", partitions(self.spark))
        self.answers: dict[int, DataFrame] = {}

    def told(self) -> DataFrame:
        """Chunks with all answers so far: for each order an array of (owner, block), no longer than there are owners."""
        out = self.chunks
        for k, a in self.answers.items():
            out = out.join(a.groupBy("chunk").agg(F.collect_list(F.struct("owner", "block")).alias(f"a{k}")).hint("shuffle_hash"), "chunk", "left")
        return out

    def ask(self, k: int, requests: DataFrame, work, table: DataFrame | None) -> DataFrame:
        """Requests, and the stored table if there is one, meet at their owners: (owner, chunk, block, facts) by kind: table, answer, facts."""
        if table is not None:
            requests = requests.unionByName(table.select("owner", "chunk", "block"))
        dealt = requests.repartition(self.owners, F.element_at(F.lit(self.keys), F.col("owner") + 1).cast("long"))
        out = dealt.mapInPandas(_by_owner(work), "owner int, chunk long, block binary, facts array<double>")
        kind = F.when(F.col("facts").isNotNull(), "facts").when(F.col("chunk") == -1, "table").otherwise("answer")
        out = staged(out.withColumn("kind", kind), f"order-{k}", by="kind", rows=CHUNKS_AT_ONCE)
        self.answers[k] = out.where("kind = 'answer'").select("owner", "chunk", "block")
        return out

    def words(self, table: DataFrame | None = None) -> DataFrame:
        return self.ask(1, self.chunks.select("chunk", "words").mapInPandas(_word_blocks(self.owners), "owner int, chunk long, block binary"), _own_words, table)

    def order(self, k: int, model: Katz, table: DataFrame | None = None) -> DataFrame:
        return self.ask(k, self.told().drop("ids").mapInPandas(_requests(model, k), "owner int, chunk long, block binary"), _own(model, k), table)

    def scored(self, model: Katz, id_col: str) -> DataFrame:
        schema = f"id {self.kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return staged(self.told().mapInPandas(_scores(model), schema), "scores", rows=CHUNKS_AT_ONCE).withColumnRenamed("id", id_col)


#: Chunks that go to Python at once.
CHUNKS_AT_ONCE = 2


def _fit(exchange: _Exchange, order: int) -> Fitted:
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    out = exchange.words()
    total = lambda n: [F.coalesce(F.sum(F.get("facts", F.lit(i + 1))), F.lit(0.0)) for i in range(n)]
    facts = [int(x) for x in out.where("kind = 'facts'").agg(*total(LARGE + 3)).first()]
    model = Katz(Words(facts[0], facts[1], facts[2:]), exchange.rows.where("not held").count(), exchange.owners, order)
    tables = {1: out.where("kind = 'table'")}
    for k in range(2, order + 1):
        out = exchange.order(k, model)
        tables[k] = out.where("kind = 'table'")
        # at most HOT + 1 rows: the counts of counts, and the contexts that are a HOT-th of all tokens
        of = F.get("facts", F.lit(0)).alias("of")
        added = out.where("kind = 'facts'").groupBy(of, F.when(of == 2, F.col("chunk")).alias("context")).agg(F.array(*total(LARGE + 2)).alias("x")).collect()
        ranks = [r.x for r in added if r.of == 1]
        hot = sorted((r.context, r.x) for r in added if r.of == 2)
        model.higher[k] = Higher(discounts(ranks[0][: LARGE + 1] if ranks else [0.0] * (LARGE + 1)), np.array([h for h, _ in hot], np.int64), np.array([x for _, x in hot]).reshape(len(hot), LARGE + 2))
    return Fitted(model, tables)


def fit_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, order: int = ORDER) -> Fitted:
    """Count a Katz model of n-grams up to ``order`` words, from the rows whose id's crc32, by ``modulus``, doesn't leave ``held``. Nulls and such: see ``score_texts``."""
    return _fit(_Exchange(docs, id_col, text_col, modulus, held), order)


def score_with(docs: DataFrame, fitted: Fitted, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2) -> DataFrame:
    """Score any texts from a fitted model's tables; what they return is what ``score_texts`` returns, and they teach nothing."""
    exchange = _Exchange(docs, id_col, text_col, modulus, held, fitted.model.owners)
    exchange.words(fitted.tables[1])
    for k in range(2, fitted.model.order + 1):
        exchange.order(k, fitted.model, fitted.tables[k])
    return exchange.scored(fitted.model, id_col)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, order: int = ORDER) -> DataFrame:
    """Score every whole text by a Katz model of n-grams up to ``order`` words, 2 or 3, from the rows whose id's crc32, by ``modulus``, doesn't leave ``held``.

    Returns ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (one-count smoothed
    words) and ``score`` (log10 probability), one row for each row of ``docs``. A null or empty text is its end alone, and
    a long one is scored whole. Null ids count as the empty text for the fold; repeated rows are counted each time. With
    nothing to learn from every token is of the unknown class, with score 0. An empty table gives an empty result. Other
    columns are ignored. The same as ``score_with(docs, fit_texts(docs))``, with one exchange for both.
    """
    exchange = _Exchange(docs, id_col, text_col, modulus, held)
    return exchange.scored(_fit(exchange, order).model, id_col)
