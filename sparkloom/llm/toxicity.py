"""Toxicity by weak supervision.

Voters are lexicons and patterns: each votes toxic or clean on a document, or abstains. Lexicons are told apart by what
they hold (words, or beginnings of words), by how sure that was where it was found, and by a part that a feature is dealt
to; a word of a text speaks through the surest feature of its own alone. A pattern looks at how a text is written; labels give it its one sign, and a pattern that
goes with neither label has no vote. A generative label model, fitted on the votes by expectation maximisation, estimates
how often each voter votes and errs given the label, and which voters depend on each other beyond it: those are joined in
a tree, in which a vote depends on the label and on the parent's vote. A linear classifier over words and beginnings of
words is trained on the posterior labels, calibrated, and scores every document.

No label is a training target, and none has a part in its own posterior. The sample is cut into folds. For each fold a
label model is fitted whose lexicons, signs, class balance and known labels all come from other folds; a lexicon that
votes in one of those was found without it too. Labels of other folds hold the model to what is meant by toxic: left
alone, it would find the language or the junk instead.

Features are counted on the executors; only the kept ones, and where the sample has them, reach the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._linear import Sparse, fit_logistic, platt, sigmoid
from ._shared import bounded, in_fold, partitions, release_memory, rows_of, staged

#: Labelled documents that a fit reads at most (the sample's bound), by a hash of their id.
SAMPLE = 12_000
#: Lengths of word beginnings that are features beside whole words.
STEMS = (3, 4, 5)
#: Features that a model has at most.
FEATURES = 6000
#: Lower ends of the shares of one label by which lexicons are told apart, and the least root of a G statistic in them.
SURE, STRONG = (0.9, 0.75, 0.6, 0.4), 3.5
#: Rows of the usual share of labels that a feature's own are taken together with: what few rows have is never sure.
DOUBT = 5.0
#: Parts of the sample: lexicons that vote in one come from all others.
FOLDS = 5
#: Lexicons of one kind and sureness: features are dealt over so many, so that two words of a text can be two voters.
PARTS = 3
#: Conditional mutual information, in nats, from which on two voters are joined; what a voter's table is smoothed by.
JOINED, SMOOTH = 0.01, 0.5
#: Standard errors by which a pattern's share of toxic rows must part from the class balance for it to vote.
TELLING = 3.0
#: Words whose features a worker remembers.
REMEMBERED = 200_000

_TOKEN = re.compile(r"[^\W\d_]+")
#: How toxic words are written to pass filters: with digits and signs for letters, letter by letter, or masked.
_ODD, _MAYBE_ODD = re.compile(r"(?:[^\W\d_]+[013457@$]+)+[^\W\d_]*"), re.compile(r"[^\W\d_][013457@$]")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-]){3,}[^\W\d_](?!\w)")
_LOOKALIKE = str.maketrans("013457@$", "oieastas")
PATTERNS = {
    "masked": re.compile(r"[^\W\d_][*#@$%]{2,}[^\W\d_]"),
    "spaced": _SPACED,
    "lookalike": re.compile(r"(?<!\w)(?=\w*[^\W\d_])(?=\w*[013457])\w{4,}(?!\w)"),
    "shouted": re.compile(r"(?:(?<!\w)[A-Z]{3,}[^\w]+){3,}"),
    "marks": re.compile(r"[!?]{2,}"),
    "stretched": re.compile(r"([^\W\d_])\1{3,}"),
    "repeated": re.compile(r"(?<!\w)([^\W\d_]{4,})(?:\W+\1(?!\w)){2,}", re.I),
    "address": re.compile(r"(?<!\w)you(?:'re| are| all)?\W+(?:\w+\W+){0,3}[^\W\d_]+[.!]*\s*$", re.I | re.M),
}


def text_words(text: str | None) -> set[str]:
    """Distinct words of a text, in lower case, also with disguises taken off."""
    text = (text or "").lower()
    words = set(_TOKEN.findall(text))
    if _MAYBE_ODD.search(text):
        words.update(w for odd in _ODD.findall(text) if (w := odd.translate(_LOOKALIKE)).isalpha())
    words.update("".join(filter(str.isalpha, run)) for run in _SPACED.findall(text))
    return words


def text_features(text: str | None) -> set[str]:
    """``text_words`` and the beginnings of words, which end in a hyphen."""
    words = text_words(text)
    out = set(words)
    for n in STEMS:
        out.update(w[:n] + "-" for w in words if len(w) > n)
    return out


def features_of_words(names: list[str], place: dict[str, int]) -> list[int]:
    """For each word among ``names`` the places of the word and of its beginnings, -1 for what isn't known; words of which nothing is are left out."""
    out = []
    for w in names:
        if not w.endswith("-"):
            own = [place.get(w, -1), *(place.get(w[:n] + "-", -1) if len(w) > n else -1 for n in STEMS)]
            if max(own) >= 0:
                out += own
    return out


def feature_kind(name: str) -> int:
    """0 for a word, else the length of a beginning."""
    return len(name) - 1 if name.endswith("-") else 0


def pattern_votes(text: str | None) -> int:
    """Bit i is set if the text matches pattern i."""
    return sum(1 << i for i, p in enumerate(PATTERNS.values()) if p.search(text or ""))


@dataclass
class Toxicity:
    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = -3.0
    scale: tuple[float, float] = (1.0, 0.0)
    accuracies: np.ndarray = field(default_factory=lambda: np.zeros(0))
    correlations: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def __post_init__(self):
        names = list(self.weights)
        self._place = {name: i for i, name in enumerate(names)}
        self._weight = [self.weights[name] for name in names]
        self._known: dict[str, tuple[int, ...]] = {}

    def _features(self, word: str) -> tuple[int, ...]:
        """Places of the features that a word has: itself and its beginnings."""
        found = self._known.get(word)
        if found is None:
            if len(self._known) > REMEMBERED:
                self._known.clear()
            own = [word, *(word[:n] + "-" for n in STEMS if len(word) > n)]
            found = self._known[word] = tuple(self._place[x] for x in own if x in self._place)
        return found

    def margin(self, text: str | None) -> float:
        known = {i for word in text_words(text) for i in self._features(word)} if self.weights else ()
        return self.intercept + sum(self._weight[i] for i in sorted(known))

    def score(self, texts: pd.Series) -> np.ndarray:
        m = np.fromiter(map(self.margin, texts), float, len(texts))
        return sigmoid(self.scale[0] * m + self.scale[1])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()


def sketch(text: str | None) -> tuple[int, int]:
    """Two minima over hashes of the text's runs of three words: copies and near copies share one or both."""
    import xxhash

    words = (text or "").split()
    runs = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    h = np.fromiter((xxhash.xxh64_intdigest(r) for r in runs), np.uint64, len(runs))
    return int(h.view(np.int64).min()), int((h * np.uint64(0x9E3779B97F4A7C15)).view(np.int64).min())


def _collected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys = [sketch(t) for t in pdf["text"]]
        yield pd.DataFrame({"toxic": pdf["toxic"], "k1": [k for k, _ in keys], "k2": [k for _, k in keys], "patterns": [pattern_votes(t) for t in pdf["text"]], "names": [sorted(text_features(t)) for t in pdf["text"]]})


# The label model. Votes are 1 (toxic), 0 (clean) and -1 (none); in tables they stand in the order toxic, clean, none.


def _joint(votes: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Expected counts of pairs of votes given each label: label x voter x vote x voter x vote."""
    n, k = votes.shape
    one = (np.where(votes == 1, 0, np.where(votes == 0, 1, 2))[:, :, None] == np.arange(3)).reshape(n, 3 * k).astype(float)
    return np.stack([(one * p[:, None]).T @ one for p in (1 - post, post)]).reshape(2, k, 3, k, 3)


def _parents(joint: np.ndarray, least: float) -> np.ndarray:
    """Each voter's parent, -1 for none: a forest of the pairs that depend on each other most, given the label."""
    k = joint.shape[1]
    share = joint / max(1.0, joint[:, 0, :, 0, :].sum())
    own = np.einsum("yjaja->yja", share)
    label = own[:, 0].sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = share * label[:, None, None, None, None] / (own[:, :, :, None, None] * own[:, None, None, :, :])
        info = np.where(share > 0, share * np.log(ratio), 0.0).sum((0, 2, 4))
    parent, done = np.full(k, -1), np.zeros(k, bool)
    best, frm = np.zeros(k), np.full(k, -1)
    for _ in range(k):  # the voter that depends most on one already in the forest comes next
        j = int(np.argmax(np.where(done, -1.0, best)))
        parent[j] = frm[j] if best[j] > least else -1
        done[j] = True
        closer = info[j] > best
        best, frm = np.where(closer, info[j], best), np.where(closer, j, frm)
    return parent


def _tables(which: np.ndarray, post: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """log P(vote | label, parent's vote): label x voter x parent's vote x vote; without a parent all its rows are the same."""
    k = which.shape[1]
    out = np.empty((2, k, 3, 3))
    for y, weight in enumerate((1 - post, post)):
        for j, p in enumerate(parent):
            own = np.bincount(which[:, j], weight, 3) + SMOOTH
            alone = own / own.sum()
            counts = 4 * SMOOTH * alone[None, :]
            if p >= 0:
                counts = counts + np.bincount(3 * which[:, p] + which[:, j], weight, 9).reshape(3, 3)
            out[y, j] = counts / counts.sum(-1, keepdims=True) if p >= 0 else alone
    return np.log(out)


def label_model(votes: np.ndarray, prior: float, start: np.ndarray, known: np.ndarray | None = None, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, accuracies, correlations of errors) from votes; start: how often each voter is thought to be right at first; known: labels, -1 where hidden.

    What depends strongly is joined at once; half way, when the posterior has formed, the forest is found anew.
    """
    n, k = votes.shape
    which = np.where(votes == 1, 0, np.where(votes == 0, 1, 2))
    cast = np.stack([(votes == 1).mean(0), (votes == 0).mean(0)], 1)
    first = np.empty((2, k, 3))
    for y, share in ((0, 1 - prior), (1, prior)):
        right = np.stack([start if y else 1 - start, 1 - start if y else start], 1)  # of votes for toxic, for clean
        first[y, :, :2] = np.clip(right * cast / share, 1e-4, 0.98)
        first[y, :, 2] = np.maximum(0.01, 1 - first[y, :, :2].sum(1))
    first /= first.sum(-1, keepdims=True)
    known = np.full(n, -1) if known is None else known
    tables, parent, post = np.log(np.repeat(first[:, :, None, :], 3, 2)), np.full(k, -1), np.full(n, prior)
    for turn in range(rounds):
        above = np.where(parent >= 0, which[:, parent], 0)
        at = [tables[y][np.arange(k), above, which].sum(1) for y in (0, 1)]
        new = np.where(known >= 0, known, sigmoid(np.log(prior / (1 - prior)) + at[1] - at[0]))
        settled, post = np.abs(new - post).max(initial=0) < 1e-6, new
        if turn in (0, rounds // 2) or settled and turn < rounds // 2:
            parent = _parents(_joint(votes, post), JOINED * (1 if turn else 10))
            if settled and turn and turn != rounds // 2:  # the posterior has formed early
                tables = _tables(which, post, parent)
                rounds = turn + max(2, rounds // 4)
                settled = False
                continue
            settled = False
        tables = _tables(which, post, parent)
        if settled and turn > rounds // 2:
            break
    own = np.einsum("yjaja->yja", _joint(votes, post))
    accuracy = (own[1, :, 0] + own[0, :, 1]) / np.maximum(own[:, :, :2].sum((0, 2)), 1e-9)
    chance = own / np.maximum(own.sum(-1, keepdims=True), 1e-9)
    rest = (votes == 1) - (post[:, None] * chance[1, :, 0] + (1 - post[:, None]) * chance[0, :, 0])
    rest = rest / (np.sqrt((rest**2).mean(0)) + 1e-9)
    return post, accuracy, rest.T @ rest / max(1, n)


def strengths(counts: np.ndarray, sizes: np.ndarray, without: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Of features, from all folds but some: the root of the G statistic against the label, negative where it goes with label 0, and the share of toxic rows.

    counts: feature x fold x label; sizes: fold x label.
    """
    use = [f for f in range(FOLDS) if f not in without]
    clean, hits = counts[:, use].sum(1).T
    neg, pos = sizes[use].sum(0)
    if not pos or not neg:
        return np.zeros(len(counts)), np.full(len(counts), 0.5)
    n, both = neg + pos, hits + clean
    part = lambda a, e: a * np.log(np.maximum(a, 1e-12) / np.maximum(e, 1e-12))
    g = part(hits, both * pos / n) + part(clean, both * neg / n) + part(pos - hits, (n - both) * pos / n) + part(neg - clean, (n - both) * neg / n)
    return np.sqrt(np.maximum(0, 2 * g)) * np.where(hits * n >= both * pos, 1, -1), (hits + DOUBT * pos / n) / (both + DOUBT)


#: What is left out where a fold's rows are voted on, and where those of another fold anchor that fold's label model.
LEFT_OUT = [(f,) for f in range(FOLDS)] + [(f, g) for f in range(FOLDS) for g in range(f + 1, FOLDS)]


def _telling(sizes: np.ndarray):
    """Keeps features that are strong in all rows, or in those that some lexicon comes from."""
    names = [f"c{f}{y}" for f in range(FOLDS) for y in (0, 1)]

    def telling(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            counts = pdf[names].to_numpy(float).reshape(len(pdf), FOLDS, 2)
            z = strengths(counts, sizes)[0]
            best = np.max([np.abs(z), *(np.abs(strengths(counts, sizes, w)[0]) for w in LEFT_OUT)], axis=0)
            if (best > STRONG).any():
                yield pdf.assign(z=z)[best > STRONG]

    return telling


def _first_of_copies(seen: DataFrame) -> DataFrame:
    """Rows that share neither sketch with an earlier row: copies of a text would pass for evidence."""
    order = (F.col("k1"), F.col("k2"), F.desc("toxic"))
    one, two = (F.row_number().over(Window.partitionBy(k).orderBy(*order)) for k in ("k1", "k2"))
    return seen.withColumns({"n1": one, "n2": two}).where("n1 = 1 and n2 = 1").drop("n1", "n2")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Toxicity:
    """Learn from at most ``sample`` labelled ids whose crc32 as text leaves a remainder by 5, and as many different texts of theirs."""
    known = rows_of(labels, lid=id_col, toxic=label_col).where("lid is not null and toxic is not null").groupBy("lid").agg(F.max("toxic").cast("int").alias("toxic"))
    known = bounded(known.where(~in_fold(F.col("lid"), 5, 0)), sample, F.col("lid"))
    # at most ``sample`` pairs of numbers: their size is proven
    rows = rows_of(docs, id=id_col, text=text_col).join(F.broadcast(known), F.col("id") == F.col("lid")).select("toxic", "text").repartition(partitions(docs.sparkSession))
    seen = staged(rows.mapInPandas(_collected, "toxic int, k1 long, k2 long, patterns long, names array<string>"), "features")
    fold = F.pmod(F.xxhash64("k1", "k2"), F.lit(FOLDS)).cast("int")
    seen = staged(bounded(_first_of_copies(seen), sample, F.col("k1"), F.col("k2")).withColumn("fold", fold), "sample")
    sizes = {(r.fold, r.toxic): r["count"] for r in seen.groupBy("fold", "toxic").count().collect()}
    n, pos = sum(sizes.values()), sum(v for (_, y), v in sizes.items() if y == 1)
    model = Toxicity()
    if not pos or pos == n:
        model.intercept = float(np.log((pos + 0.5) / (n - pos + 0.5))) if n else -3.0
        return model
    by_fold = np.array([[sizes.get((f, y), 0) for y in (0, 1)] for f in range(FOLDS)], float)
    kept = _kept(seen, by_fold).toPandas().sort_values("name").reset_index(drop=True)
    place = {name: i for i, name in enumerate(kept["name"])}

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "fold": pdf["fold"], "patterns": pdf["patterns"], "k1": pdf["k1"], "k2": pdf["k2"], "at": [features_of_words(names, place) for names in pdf["names"]]})

    # at most ``sample`` rows of numbers, a few for each word that the model knows
    got = seen.mapInPandas(found, "toxic int, fold int, patterns long, k1 long, k2 long, at array<int>").toPandas().sort_values(["k1", "k2"])
    counts = kept[[f"c{f}{y}" for f in range(FOLDS) for y in (0, 1)]].to_numpy(float).reshape(len(kept), FOLDS, 2)
    rows = Rows([np.asarray(a, np.int64).reshape(-1, 1 + len(STEMS)) for a in got["at"]], got["fold"].to_numpy(), got["patterns"].to_numpy(np.int64), got["toxic"].to_numpy(int))
    model = fit_rows(list(kept["name"]), counts, rows)
    release_memory()
    return model


def _kept(seen: DataFrame, sizes: np.ndarray) -> DataFrame:
    """(name, counts by fold and label, z): at most FEATURES features, the strongest first, from counts made on the executors."""
    keys = [(f, y) for f in range(FOLDS) for y in (0, 1)]
    counts = seen.select("fold", "toxic", F.explode("names").alias("name")).groupBy("name").agg(*(F.count_if((F.col("fold") == f) & (F.col("toxic") == y)).cast("double").alias(f"c{f}{y}") for f, y in keys))
    often = sum((F.col(f"c{f}{y}") for f, y in keys), F.lit(0.0)) >= 3  # what fewer rows have is no evidence
    telling = counts.where(often).mapInPandas(_telling(sizes), "name string, " + ", ".join(f"c{f}{y} double" for f, y in keys) + ", z double")
    return telling.orderBy(F.desc(F.abs("z")), "name").limit(FEATURES)


@dataclass
class Rows:
    """The labelled sample: of each row the known features of its words (words x 4, -1 for none), its fold, patterns and label."""

    words: list[np.ndarray]
    fold: np.ndarray
    patterns: np.ndarray
    toxic: np.ndarray


#: Voters: lexicons of toxic features by kind, sureness and part, of clean ones by kind, then patterns.
TOXIC_DECKS, CLEAN_DECKS = (1 + len(STEMS)) * len(SURE) * PARTS, 1 + len(STEMS)
VOTERS = TOXIC_DECKS + CLEAN_DECKS + len(PATTERNS)


def lexicons(names: list[str], z: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each feature the lexicon, by label, kind, sureness and part, that it is in, -1 for none; and how sure it is."""
    kinds = (0, *STEMS)
    kind = np.array([kinds.index(feature_kind(x)) for x in names], int)
    sure = np.where(z > 0, share, 1 - share)
    tier = np.searchsorted(-np.array(SURE), -sure)
    # what goes with label 0 is only said to if no toxic text has it
    fit = (np.abs(z) >= STRONG) & (tier < len(SURE)) & ((z > 0) | (sure > 0.99))
    part = np.array([zlib.crc32(x.encode()) % PARTS for x in names], int)
    return np.where(fit, np.where(z > 0, (kind * len(SURE) + tier) * PARTS + part, TOXIC_DECKS + kind), -1), np.where(fit, sure, 0)


def signs(rows: Rows, without: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Each pattern's vote, 1 or 0, or -1 if it tells nothing; and how often that is right: from all folds but some."""
    use = ~np.isin(rows.fold, without)
    toxic, prior = rows.toxic[use], rows.toxic[use].mean() if use.any() else 0.5
    vote, right = np.full(len(PATTERNS), -1), np.full(len(PATTERNS), 0.5)
    for j in range(len(PATTERNS)):
        hit = rows.patterns[use] >> j & 1 == 1
        n, share = hit.sum(), (toxic[hit].sum() + DOUBT * prior) / (hit.sum() + DOUBT)
        if n >= 5 and abs(share - prior) > TELLING * np.sqrt(prior * (1 - prior) / n):
            vote[j] = int(share > prior)
            right[j] = share if vote[j] else 1 - share
    return vote, right


def cast_votes(names: list[str], counts: np.ndarray, sizes: np.ndarray, rows: Rows, hidden: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows x voters, and the share of right votes that each promises, for the label model in which a fold's labels are hidden.

    Nothing that votes comes from the hidden fold, nor from the fold of the row that is voted on.
    """
    votes = np.full((len(rows.fold), VOTERS), -1)
    promised = np.zeros((2, VOTERS))
    for g in range(FOLDS):
        own = np.flatnonzero(rows.fold == g)
        if not len(own):
            continue
        without = tuple({hidden, g})
        deck, sure = lexicons(names, *strengths(counts, sizes, without))
        words = np.concatenate([rows.words[i] for i in own])
        row = np.repeat(own, [len(rows.words[i]) for i in own])
        best = words[np.arange(len(words)), np.where(words >= 0, sure[words], -1.0).argmax(1)] if len(words) else np.zeros(0, int)
        voter = deck[best] if len(words) else best
        row, best, voter = row[voter >= 0], best[voter >= 0], voter[voter >= 0]
        votes[row, voter] = voter < TOXIC_DECKS
        promised[0] += np.bincount(voter, minlength=VOTERS)
        promised[1] += np.bincount(voter, sure[best], VOTERS)
        sign, right = signs(rows, without)
        for j in np.flatnonzero(sign >= 0):
            hit = own[rows.patterns[own] >> j & 1 == 1]
            votes[hit, TOXIC_DECKS + CLEAN_DECKS + j] = sign[j]
            promised[:, TOXIC_DECKS + CLEAN_DECKS + j] += len(hit), len(hit) * right[j]
    return votes, np.clip((promised[1] + 1) / (promised[0] + 2), 0.5, 0.99)


def posteriors(names: list[str], counts: np.ndarray, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's posterior, from a label model that its own label has no part in; and the mean accuracies and correlations of the voters."""
    post, accuracy, correlation = np.zeros(len(rows.fold)), [], []
    sizes = np.array([[((rows.fold == f) & (rows.toxic == y)).sum() for y in (0, 1)] for f in range(FOLDS)], float)
    for f in range(FOLDS):
        own, rest = rows.fold == f, rows.fold != f
        if not own.any():
            continue
        if not rest.any() or rows.toxic[rest].min() == rows.toxic[rest].max():
            post[own] = rows.toxic[rest].mean() if rest.any() else 0.5
            continue
        votes, start = cast_votes(names, counts, sizes, rows, f)
        found = label_model(votes, float(np.clip(rows.toxic[rest].mean(), 0.01, 0.99)), start, np.where(rest, rows.toxic, -1))
        post[own] = found[0][own]
        accuracy.append(found[1])
        correlation.append(found[2])
    none = np.zeros((1, VOTERS))
    return post, np.mean(accuracy or none, 0), np.mean(correlation or [none.T @ none], 0)


def fit_rows(names: list[str], counts: np.ndarray, rows: Rows) -> Toxicity:
    """The linear classifier, trained on posteriors alone; gold labels only calibrate its scores."""
    post, accuracies, correlations = posteriors(names, counts, rows)
    at = [np.unique(a[a >= 0]) for a in rows.words]
    x = Sparse(np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate([*at, np.zeros(0, np.int64)]), np.ones(sum(map(len, at))), len(at), len(names))
    w, b = fit_logistic(x, post, np.abs(2 * post - 1), l2=0.3, steps=300)  # an open question teaches nothing
    return Toxicity(dict(zip(names, w.tolist(), strict=True)), float(b), platt(x.dot(w) + b, rows.toxic.astype(float)), accuracies, correlations)


def with_score(docs: DataFrame, model: Toxicity, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; a null text scores as an empty one."""
    score = F.pandas_udf(lambda texts: pd.Series(model.score(texts)), "double")
    return docs.withColumn(name, score(F.col(f"`{text_col}`")))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Score every whole text, however long: ``id_col``, ``held_out``, ``score`` from 0 to 1, ``predicted``; one row for each of ``docs``.

    Only the text is scored. Labels of rows whose id's crc32 is divisible by 5 are never read (``held_out``). A null text
    scores as an empty one. Rows with equal texts score alike; null ids and labels teach nothing; of an id labelled twice
    the larger label counts. Without labels of both kinds every score is the same. An empty table gives an empty result.
    Other columns are ignored.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    scored = staged(with_score(rows_of(docs, id=id_col, text=text_col), model).select("id", "score"), "scored")
    return scored.select(F.col("id").alias(id_col), in_fold(F.col("id"), 5, 0).alias("held_out"), "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
