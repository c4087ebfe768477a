"""Words of Japanese text, which has no spaces: a lexicon learned from a column, and the likeliest cut of each text by it.

The lexicon is a unigram model: each word has a probability, and a run of Japanese characters is as likely as the product
over its words, summed over all ways to cut it. Candidates are the substrings that occur often enough anywhere in the
column and change script at most from kanji to hiragana, as Japanese words do; a run of kanji or katakana that is no such
word may stand whole as an unknown one. A word has one script, or is
kanji with an ending of up to four hiragana. Expectation maximisation over the lattice of a run's cuts gives their expected counts; words that the data don't
bear go from round to round. Counting, and every round, is one pass over the column's distinct runs; what reaches the
driver is the lexicon alone, whose size is a parameter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Runs of Japanese characters, and other words, as the text functions know them.
JAPANESE_RUN = "[぀-ヿ一-龯々]+"
_PIECE = re.compile(rf"({JAPANESE_RUN})|([^\W_]+)")
#: What each further character of an unknown word costs, and a change of script inside a word: particles are likelier than endings.
FURTHER, CHANGE = 1.0, 2.5
_CHANGES = re.compile("[一-龯々][ぁ-ゟ]")
#: Code points of the longest word, occurrences of a candidate, words of a lexicon, rounds of expectation maximisation.
LONGEST, FEWEST, SIZE, ROUNDS = 8, 3, 50_000, 4
#: Code points of a run that are cut at once: a longer one is cut in windows, of which the last word waits for the next.
WINDOW = 2000
#: Expected occurrences below which a word of several characters is given up, and code points whose substrings are counted at once.
GIVEN_UP, COUNTED = 0.5, 500_000
#: Code points of the runs that are gone through side by side.
AT_ONCE = 20_000


class _Index:
    """A lexicon's words as sorted keys, a level for each length: (prefix, character) to the longer prefix and its word."""

    def __init__(self, words: dict[str, float]):
        self.p = np.fromiter(words.values(), np.float64, len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        longest = int(sizes.max(initial=1))
        letters = np.array(list(words), dtype=f"U{longest}").view(np.uint32).reshape(len(words), longest)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        prefix = np.zeros(len(words), np.int64)
        for n in range(1, longest + 1):
            has = np.flatnonzero(sizes >= n)
            keys, own = np.unique(prefix[has] << 21 | letters[has, n - 1], return_inverse=True)
            prefix[has] = own
            word = np.full(len(keys), -1)
            word[own[sizes[has] == n]] = has[sizes[has] == n]
            self.levels.append((keys, word))


class _Text:
    """Runs one after the other as code points, with each character's run, its place there, and what is left of the run."""

    def __init__(self, runs: list[str]):
        self.text = "".join(runs)
        self.codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.run = np.repeat(np.arange(len(runs)), self.sizes)
        self.place = np.arange(len(self.codes)) - self.starts[self.run]
        self.left = self.sizes[self.run] - self.place
        c = self.codes
        self.kanji, self.hiragana, self.kana = (c >= 0x4E00) & (c <= 0x9FAF) | (c == 0x3005), (c >= 0x3041) & (c <= 0x309F), (c >= 0x30A0) & (c <= 0x30FF)

    def stretch(self, of: np.ndarray) -> np.ndarray:
        """How many characters from each on are of a class, within its run."""
        n = len(of)
        stops = np.where(~of, np.arange(n), n)
        nearest = np.minimum.accumulate(stops[::-1])[::-1] if n else stops
        return np.minimum(nearest - np.arange(n), self.left)

    def one_script(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of whole stretches of two or more kanji, or of katakana."""
        kind = self.kanji + 2 * self.kana
        begins = np.flatnonzero((kind > 0) & ((self.place == 0) | (kind != np.roll(kind, 1))))
        size = np.where(self.kanji, self.stretch(self.kanji), self.stretch(self.kana))[begins]
        return begins[size > 1], size[size > 1]


class _Lattice:
    """All cuts of many runs: edges from place to place with their log probability and word, -1 where it is unknown.

    A run of n characters has n + 1 nodes. Runs are gone through side by side: a step takes the edges of all runs that
    end, or begin, at one place.
    """

    def __init__(self, runs: list[str], lexicon: Lexicon):
        self.t = t = _Text(runs)
        at, prefix = np.arange(len(t.codes)), np.zeros(len(t.codes), np.int64)
        single = np.full(len(t.codes), -1)
        found = []
        for n, (keys, word) in enumerate(lexicon.index.levels if lexicon.words else [], 1):
            keep = t.left[at] >= n
            at, prefix = at[keep], prefix[keep]
            key = prefix << 21 | t.codes[at + n - 1]
            own = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[own] == key
            at, prefix = at[hit], own[hit]
            w = word[prefix]
            if n == 1:
                single[at] = w
            else:
                found.append((at[w >= 0], np.full(int((w >= 0).sum()), n), w[w >= 0]))
        start, size, word = (np.concatenate(x) for x in zip((np.arange(len(t.codes)), np.ones(len(t.codes), np.int64), single), *found, strict=True))
        p = np.where(word >= 0, lexicon.index.p[word], lexicon.unknown) if lexicon.words else np.full(len(word), lexicon.unknown)
        more, length = t.one_script()
        whole, known = np.zeros(len(t.codes), np.int64), np.zeros(len(t.codes), bool)
        whole[more] = length
        known[start[whole[start] == size]] = True
        more, length = more[~known[more]], length[~known[more]]
        start, size, word = np.append(start, more), np.append(size, length), np.append(word, np.full(len(more), -1))
        p = np.append(p, lexicon.unknown - FURTHER * (length - 1))
        order = np.argsort((t.place[start] + size) << 42 | t.run[start] << 21 | (2**21 - 1 - size))  # by end; of a node's edges the longest first
        self.start, self.size, self.word, self.p = start[order], size[order], word[order], p[order]
        self.run, self.place = t.run[self.start], t.place[self.start]
        self.source = self.start + self.run
        self.target = self.source + self.size
        self.first = t.starts + np.arange(len(runs))
        self.last = self.first + t.sizes

    @staticmethod
    def _steps(node: np.ndarray, place: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """The edges of each place, by node: (edges, the first of each node among them, nodes)."""
        begins = np.flatnonzero(np.diff(node, prepend=-1))
        bounds = np.flatnonzero(np.diff(place, prepend=-1))
        groups = np.searchsorted(begins, np.append(bounds, len(node)))
        for a, b, i, j in zip(bounds.tolist(), [*bounds[1:].tolist(), len(node)], groups[:-1].tolist(), groups[1:].tolist(), strict=True):
            yield slice(a, b), begins[i:j] - a, node[begins[i:j]]

    @staticmethod
    def _sums(terms: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        top = np.maximum.reduceat(terms, firsts)
        return top + np.log(np.add.reduceat(np.exp(terms - np.repeat(top, np.diff(np.append(firsts, len(terms))))), firsts))

    def expected(self, times: np.ndarray, into: np.ndarray) -> np.ndarray:
        """The runs' log probabilities; words' expected occurrences in all runs, each of which occurs ``times``, are added to ``into``."""
        ahead, behind = np.zeros(len(self.t.codes) + len(times)), np.zeros(len(self.t.codes) + len(times))
        for edges, firsts, nodes in self._steps(self.target, self.place + self.size):
            ahead[nodes] = self._sums(ahead[self.source[edges]] + self.p[edges], firsts)
        order = np.argsort((2**21 - self.place) << 21 | self.run)
        source, target, p = self.source[order], self.target[order], self.p[order]
        for edges, firsts, nodes in self._steps(source, self.place[order]):
            behind[nodes] = self._sums(behind[target[edges]] + p[edges], firsts)
        known = self.word >= 0  # unknown words don't become known
        run, word = self.run[known], self.word[known]
        share = np.exp(ahead[self.source[known]] + self.p[known] + behind[self.target[known]] - ahead[self.last[run]])
        sums = np.bincount(word, times[run] * share, len(into))
        seen = np.flatnonzero(np.bincount(word, minlength=len(into)))
        into[seen] = np.nan_to_num(into[seen]) + sums[seen]
        return ahead[self.last]

    def best(self) -> list[list[str]]:
        """Each run's likeliest cut; of equally likely ones that with the longest last word, then the one before, and so on."""
        score, back = np.zeros(len(self.t.codes) + len(self.first)), np.zeros(len(self.t.codes) + len(self.first), np.int64)
        for edges, firsts, nodes in self._steps(self.target, self.place + self.size):
            terms = score[self.source[edges]] + self.p[edges]
            score[nodes] = top = np.maximum.reduceat(terms, firsts)
            best = np.flatnonzero(terms == np.repeat(top, np.diff(np.append(firsts, len(terms)))))[::-1]
            back[self.target[edges][best]] = self.source[edges][best]  # the first of a node is written last
        out, back, text = [], back.tolist(), self.t.text
        for r, (first, last) in enumerate(zip(self.first.tolist(), self.last.tolist(), strict=True)):
            words = []
            while last > first:
                words.append(text[back[last] - r : last - r])
                last = back[last]
            out.append(words[::-1])
        return out


def _at_once(runs: list[str], most: int) -> Iterator[slice]:
    """Runs of about ``most`` characters in all."""
    begin = size = 0
    for i, r in enumerate(runs, 1):
        size += len(r)
        if size >= most or i == len(runs):
            yield slice(begin, i)
            begin, size = i, 0


@dataclass
class Lexicon:
    """Log probabilities of words. A character that is in none has that of ``unknown``."""

    words: dict[str, float] = field(default_factory=dict)
    unknown: float = -20.0

    def __post_init__(self):
        self.index = _Index(self.words) if self.words else None

    def cut_all(self, runs: list[str]) -> list[list[str]]:
        """The likeliest cut of each run, window by window for one longer than WINDOW."""
        out: list[list[str]] = [[] for _ in runs]
        rest = {i: r for i, r in enumerate(runs) if r}
        while rest:
            places = sorted(rest, key=lambda i: len(rest[i]))  # runs of one length share all steps
            ahead = [rest[i][:WINDOW] for i in places]
            for part in _at_once(ahead, AT_ONCE):
                for i, words in zip(places[part], _Lattice(ahead[part], self).best(), strict=True):
                    if len(rest[i]) > WINDOW:
                        words = words[:-1] or words
                    out[i] += words
                    rest[i] = rest[i][sum(map(len, words)) :]
            rest = {i: r for i, r in rest.items() if r}
        return out

    def cut(self, run: str) -> list[str]:
        return self.cut_all([run])[0]

    def expected_all(self, runs: list[str], times: np.ndarray, into: np.ndarray) -> float:
        """Add each word's expected occurrences, over all cuts of runs of which each occurs ``times``, to ``into`` (a place for each word, NaN before it occurs); the log probability of all."""
        total = 0.0
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))  # runs of one length share all steps
        runs, times = [runs[i] for i in order], times[order]
        for part in _at_once(runs, AT_ONCE):
            total += float(times[part] @ _Lattice(runs[part], self).expected(times[part], into))
        return total

    def expected(self, run: str, times: float, into: dict[str, float]) -> float:
        counts = np.full(len(self.words), np.nan)
        total = self.expected_all([run], np.array([times], np.float64), counts)
        for w, n in zip(self.words, counts.tolist(), strict=True):
            if n == n:
                into[w] = into.get(w, 0.0) + n
        return total

    def words_of_all(self, texts: list[str | None]) -> list[list[str] | None]:
        """Each text's words: runs of Japanese characters as cut by the lexicon, other runs of letters and digits whole."""
        pieces = [None if t is None else _PIECE.findall(t) for t in texts]
        runs = list(dict.fromkeys(japanese for own in pieces for japanese, _ in own or () if japanese))
        cuts = dict(zip(runs, self.cut_all(runs), strict=True))
        return [None if own is None else [w for japanese, other in own for w in (cuts[japanese] if japanese else (other,))] for own in pieces]

    def words_of(self, text: str) -> list[str]:
        return self.words_of_all([text])[0]


def _windows(run: str) -> list[str]:
    return [run[i : i + WINDOW] for i in range(0, len(run), WINDOW)]


def _pieces(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """Runs in windows, with how often each occurs, of about ``most`` characters at once."""
    pieces: list[str] = []
    times: list[int] = []
    size = 0
    for pdf in batches:
        for run, n in zip(pdf["run"], pdf["n"], strict=True):
            own = _windows(run)
            pieces += own
            times += [n] * len(own)
            size += len(run)
            if size >= most:
                yield pieces, np.array(times, np.float64)
                pieces, times, size = [], [], 0
    if pieces:
        yield pieces, np.array(times, np.float64)


def _substrings(longest: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for runs, times in _pieces(batches, COUNTED):
            t = _Text(runs)
            n = len(t.codes)
            # what begins a word of one of the three forms is of that form itself: one greatest size says all of a start
            endings = np.append(t.stretch(t.hiragana), 0)
            kanji, loose, kana = t.stretch(t.kanji), t.stretch(t.hiragana | (t.codes == 0x30FC)), t.stretch(t.kana)
            mixed = np.where(kanji > 0, kanji + np.where(kanji < t.left, np.minimum(endings[np.arange(n) + kanji], 4), 0), 0)
            most = np.minimum(np.maximum(np.maximum(mixed, loose), kana), longest)
            begins, size = t.one_script()
            whole = np.zeros(n, np.int64)
            whole[begins] = size
            at, prefix = np.flatnonzero(most), np.zeros(n, np.int64)
            for k in range(1, longest + 1):
                at = at[most[at] >= k]
                if not len(at):
                    break
                _, first, own = np.unique(prefix[at] << 21 | t.codes[at + k - 1], return_index=True, return_inverse=True)
                prefix[at] = own
                yield pd.DataFrame({
                    "word": [t.text[i : i + k] for i in at[first].tolist()], "n": np.rint(np.bincount(own, times[t.run[at]])).astype(np.int64),
                    "whole": np.bincount(own, whole[at] == k) > 0,
                })

    return count


def _expected(lexicon: Lexicon):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        into = np.full(len(lexicon.words), np.nan)
        for runs, times in _pieces(batches, COUNTED):
            lexicon.expected_all(runs, times, into)
        seen = np.flatnonzero(~np.isnan(into))
        if len(seen):
            words = list(lexicon.words)
            yield pd.DataFrame({"word": [words[i] for i in seen.tolist()], "n": into[seen]})

    return step


def runs_of(df: DataFrame, column: str) -> DataFrame:
    """(run, n): the distinct runs of Japanese characters in a column and how often each occurs."""
    pattern = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FAF}\x{3005}]+"
    return df.select(F.explode(F.regexp_extract_all(F.col(f"`{column}`").cast("string"), F.lit(pattern), F.lit(0))).alias("run")).groupBy("run").agg(F.count("*").alias("n"))


def digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    return out + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)


def maximised(counts: dict[str, float], given_up: float = GIVEN_UP) -> Lexicon:
    """A lexicon from expected counts, each a little less likely than its share (a sparse prior): rare words lose most."""
    kept = {w: n for w, n in counts.items() if len(w) == 1 or n > given_up}
    total = digamma(sum(kept.values()) or 1.0)
    words = {w: digamma(n) - total - CHANGE * bool(_CHANGES.search(w)) if n > 0.05 else -30.0 for w, n in kept.items()}
    return Lexicon(words, min([*words.values(), -20.0]) if words else -20.0)


def learn_lexicon(df: DataFrame, column: str, longest: int = LONGEST, fewest: int = FEWEST, size: int = SIZE, rounds: int = ROUNDS) -> Lexicon:
    """The words of a column of Japanese text.

    Candidates are substrings of runs that look like words, of at most ``longest`` code points, that occur ``fewest`` times, and whole runs of kanji or katakana that do so once; of more than
    ``size`` those with the most characters in all (occurrences times length, ties in code-point order), and every single
    character among them. Null and blank rows, and text in other scripts, have no part; without Japanese text the lexicon
    is empty.
    """
    runs = kept(runs_of(df, column), "runs")
    seen = runs.mapInPandas(_substrings(longest), "word string, n long, whole boolean").groupBy("word").agg(F.sum("n").alias("n"), F.max("whole").alias("whole"))
    weight = F.when(F.length("word") == 1, F.lit(2**62)).otherwise(F.col("n") * F.length("word"))
    first = seen.where((F.col("n") >= fewest) | F.col("whole") | (F.length("word") == 1)).orderBy(F.desc(weight), "word").limit(size).toPandas()
    lexicon = maximised({w: float(n) for w, n in zip(first["word"], first["n"], strict=True)})
    for _ in range(rounds if lexicon.words else 0):
        counts = runs.mapInPandas(_expected(lexicon), "word string, n double").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
        lexicon = maximised(dict(zip(counts["word"], counts["n"], strict=True)))
    return lexicon
