"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word is a set of pairs (letter, how often it came before): a binary vector. One inserted or deleted letter changes one
place of it, one replaced letter two. The places are divided into parts, and a signature is what a word has in some of
them, as many parts being left out as places may differ; words that are near agree in one signature at least. Words of
equal length (two places) and words whose lengths differ by one (one place) are joined apart, on equal signatures, and
then verified, so no pair is lost and none is wrong.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import rows_of, staged

#: Parts for words of equal length (two are left out), and for lengths that differ by one (one is left out).
PARTS, PARTS_LONGER = 6, 3
#: Words of a task that are counted before they are passed on.
COUNTED = 200_000
#: Places whose weight decides on their part; others, if letters are so many, are dealt by number.
WEIGHED = 2000
#: One of so many pairs of document and word loses a letter in ``noised_counts``.
NOISE = 97
#: Bytes of Latin-1 as letters in lower case (A-Z only) or, if no letters, as spaces.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def words_of(text: str | None) -> Counter:
    """How often each run of letters (A-Z, a-z, U+00C0 to U+00FF) is in a whole text, as Latin-1 bytes, A-Z lower-cased."""
    return Counter((text or "").encode("latin-1", "replace").translate(_LETTERS).split())


def with_letter_lost(word: bytes, start: int, noise: int) -> bytes:
    """The word without one letter, if ``noise`` divides its crc32, carried on from ``start``; the crc32 also names the letter."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
    if h % noise:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counts(noise: int | None, shortest: int):
    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()

        def passed_on() -> pd.DataFrame:
            out = pd.DataFrame({"word": [w.decode("latin-1") for w in total], "n": np.fromiter(total.values(), np.int64, len(total))})
            total.clear()
            return out

        for pdf in batches:
            for doc_id, text in zip(pdf["id"], pdf["text"], strict=True):
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in words_of(text).items():
                    kept = word if noise is None else with_letter_lost(word, start, noise)
                    if len(kept) >= shortest:
                        total[kept] += n
                if len(total) > COUNTED:
                    yield passed_on()
        if total:
            yield passed_on()

    return counts


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, fewest: int = 3, noise: int | None = None) -> DataFrame:
    """(word, n): runs of letters of at least ``shortest`` code points that occur ``fewest`` times or more in whole texts.

    With ``noise`` some words of some documents lose a letter first, as ``with_letter_lost`` says (a null id is empty
    there). Null and empty texts have no words; each task passes on partial counts of a bounded number of words.
    """
    rows = rows_of(docs, id=F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), text=text_col)
    partial = rows.mapInPandas(_counts(noise, shortest), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def places(word: str) -> list[tuple[str, int]]:
    """The word's letters with how often each came before in it: the places at which its vector is one."""
    seen: Counter = Counter()
    out = []
    for c in word:
        out.append((c, seen[c]))
        seen[c] += 1
    return out


def _weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        seen = Counter(p for word in pdf["word"] for p in places(word))
        if seen:
            yield pd.DataFrame([(*p, n) for p, n in seen.items()], columns=["letter", "before", "n"])


def parts_by_weight(weights: list[tuple[str, int, int]], parts: int) -> dict[tuple[str, int], int]:
    """Each place's part, heaviest first to the lightest part, so that signatures tell words apart about equally."""
    load = [0] * parts
    out = {}
    for letter, before, n in sorted(weights, key=lambda x: (-x[2], x[0], x[1])):
        p = load.index(min(load))
        load[p] += n
        out[letter, before] = p
    return out


def signatures(word: str, part_of: dict[tuple[str, int], int], parts: int, left_out: int) -> list[int]:
    """A 64-bit signature for each choice of parts that are looked at."""
    import xxhash

    held: list[list[str]] = [[] for _ in range(parts)]
    for letter, before in places(word):
        held[part_of.get((letter, before), (ord(letter) + before) % parts)].append(f"{letter}{before}")
    own = ["".join(sorted(h)) for h in held]
    return [xxhash.xxh64_intdigest("|".join([own[p] for p in some]), seed=i) for i, some in enumerate(combinations(range(parts), parts - left_out))]


def _signed(same: dict, longer: dict):
    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = pdf["word"].tolist()
            for j in range(0, len(words), 5000):
                some = words[j : j + 5000]
                equal = [signatures(w, same, PARTS, 2) for w in some]
                other = [signatures(w, longer, PARTS_LONGER, 1) for w in some]
                as_long = lambda x: np.array(x, np.uint64).view(np.int64).tolist()
                yield pd.DataFrame({"word": some, "n": pdf["n"].iloc[j : j + 5000].to_numpy(), "equal": [as_long(x) for x in equal], "other": [as_long(x) for x in other]})

    return signed


def one_edit(a: Column, b: Column) -> Column:
    """Whether exactly one code point is inserted, deleted or replaced."""
    return F.levenshtein(a, b, 1) == 1


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, an, b, bn): every pair of words (word, n; all different) that is one edit apart, once."""
    weights = words.select("word").mapInPandas(_weights, "letter string, before int, n long").groupBy("letter", "before").agg(F.sum("n").alias("n"))
    heavy = [tuple(r) for r in weights.orderBy(F.desc("n"), "letter", "before").limit(WEIGHED).collect()]
    same, longer = parts_by_weight(heavy, PARTS), parts_by_weight(heavy, PARTS_LONGER)
    signed = staged(words.mapInPandas(_signed(same, longer), "word string, n long, equal array<long>, other array<long>"), "signatures", rows=10_000)
    size = F.length("word")
    equal = signed.select("word", "n", size.alias("size"), F.explode("equal").alias("sig"))
    a, b = (equal.select(F.col("word").alias(x), F.col("n").alias(f"{x}n"), "size", "sig") for x in "ab")
    alike = a.join(b, ["sig", "size"]).where("a < b").where(one_edit(F.col("a"), F.col("b"))).select("a", "an", "b", "bn")
    long = signed.select(F.col("word").alias("a"), F.col("n").alias("an"), (size - 1).alias("size"), F.explode("other").alias("sig"))
    short = signed.select(F.col("word").alias("b"), F.col("n").alias("bn"), size.alias("size"), F.explode("other").alias("sig"))
    grown = long.join(short, ["sig", "size"]).where(one_edit(F.col("a"), F.col("b"))).select("a", "an", "b", "bn")
    return alike.unionByName(grown).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for links (word, form): the end of each chain, found by doubling; no chain may return to itself."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = staged(now.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(words: DataFrame, factor: float = 2.0) -> DataFrame:
    """Each word's usual spelling: (word, n) with all words different -> word, form, root, n, n_near, form_n.

    A word's form is, of the words one edit away, the one with the largest n (ties: first in code-point order), if that
    n is ``factor`` times the word's or more; else null. ``root`` follows forms to the last, and is the word itself if
    it has none. ``n_near`` counts words one edit away. ``factor`` must be over 1, so that chains end. Null words are
    left out, an empty word is a word, an empty table gives an empty result, and other columns are ignored.
    """
    if factor <= 1:
        raise ValueError("factor must be over 1")
    words = staged(words.where("word is not null").select("word", "n"), "words", rows=10_000)
    pairs = staged(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    usual = -F.col("best.less") >= F.col("n") * factor
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("best.near")).alias("form"), F.when(usual, -F.col("best.less")).alias("form_n"))
    formed = staged(formed, "forms")
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, fewest: int = 3, factor: float = 2.0, noise: int | None = None) -> DataFrame:
    """``variants`` of the words that ``word_counts`` finds in whole texts; repeated rows count each, ids only steer ``noise``."""
    return variants(word_counts(docs, id_col, text_col, shortest, fewest, noise), factor)
