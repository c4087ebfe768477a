"""Quality by co-training.

Two classifiers see different views of a document. The content view is its words: which occur, what they look like, and
how often they repeat; the metadata view never sees the text: language, source and recorded length. In each round both
are fitted on the labelled rows and on what each has been taught, and each hands the documents that it is surest of, out
of all without a label, as pseudo-labels to the other. Documents stay where they are: a round is its two classifiers and
the margins from which on they teach, and a pass over the documents goes through the rounds again. The classifiers are
naive Bayes models, so a fit is sums by feature. In the end both are calibrated on labelled rows, each row judged by a
model without it, their log odds are combined, and every document is scored. A view that predicts labelled rows no better
than their share of good ones neither teaches nor counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._linear import Sparse, fit_logistic, platt, sigmoid
from ._shared import bounded, in_fold, missing_as_null, partitions, rows_of, staged

#: Labelled ids that a fit reads at most, and as many rows of theirs; rounds, and the share of unlabelled rows handed over in each.
LABELLED, ROUNDS, SHARE = 8000, 5, 0.05
#: What all unlabelled rows together weigh at most, as a multiple of the labelled; the chance of being right from which on a view teaches.
MASS, SURE = 2.0, 0.95
#: Buckets that the features of the content view and of the metadata view are hashed to.
WIDTHS = (1 << 14, 1 << 12)
#: Buckets whose counts travel as one row.
SPAN = 1 << 10
#: Standard errors by which a view must predict labelled rows better than their share of good ones does, to teach and to count.
SKILL = 3.0
#: What a feature's counts are smoothed by, and how many times the variance of its log odds their square has to be.
SMOOTH, NOISE = 0.5, 4.0

_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def shape(word: str) -> str:
    """What a whole word looks like: runs of letters as A (capitals) or a, of digits as 0, all else as it is."""
    return _DIGITS.sub("0", _LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", word))


def content_view(text: str) -> set[str]:
    words, lines = text.split(), [x for x in text.split("\n") if x]
    distinct = set(words)
    n, chars = max(1, len(words)), max(1, len(text))
    letters = sum(map(len, _LETTERS.findall(text)))
    pairs = len(set(zip(words, words[1:], strict=False)))
    numbers = {"types": len(distinct) / n, "pairs": pairs / n, "letters": letters / chars, "lines": len(set(lines)) / max(1, len(lines)), "length": min(1.0, len(text) / n / 20), "ends": sum(x[-1] in ".?!" for x in lines) / max(1, len(lines))}
    return {w.lower() for w in distinct} | {"s " + s for s in map(shape, distinct)} | {f"n {k} {int(v * 10)}" for k, v in numbers.items()}


def metadata_view(lang: str | None, source: str | None, size: float | None) -> set[str]:
    lang, source = lang or "", source or ""
    band = "" if size is None or size != size else str(int(2 * np.log2(1 + max(0, size))))
    return {f"l {lang}", f"s {source}", f"n {band}", f"ls {lang} {source}", f"sn {source} {band}"}


def hashed(features: set[str], width: int) -> bytes:
    return np.unique(np.fromiter((zlib.crc32(f.encode("utf-8", "surrogatepass")) % width for f in features), np.uint16, len(features))).tobytes()


class View:
    """One view of some rows: the features of all rows one after the other, and where each row's begin. No row is without any."""

    def __init__(self, packed):
        packed = list(packed)
        self.flat = np.frombuffer(b"".join(packed), np.uint16)
        self.size = np.fromiter((len(p) // 2 for p in packed), np.int64, len(packed))
        self.start = np.cumsum(self.size) - self.size

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sum over each row's features of a number for each of all features."""
        return np.add.reduceat(x, self.start) if len(self.start) else np.zeros(0)

    def counts(self, weight: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.flat, np.repeat(weight, self.size), width).astype(float)


def ordered(x: np.ndarray) -> np.ndarray:
    """Numbers as whole numbers in the same order, in steps of a 2048th of their size."""
    bits = np.ascontiguousarray(x + 0.0, np.float32).view(np.int32)
    return np.where(bits < 0, bits ^ 0x7FFFFFFF, bits) >> 12


def _odds(c0: np.ndarray, c1: np.ndarray, n0: np.ndarray | float, n1: np.ndarray | float) -> np.ndarray:
    """Log odds of features counted c0 and c1 times in n0 and n1 documents, shrunk by their noise: 0 for what tells nothing sure."""
    w = np.log((c1 + SMOOTH) / (n1 + 2 * SMOOTH)) - np.log((c0 + SMOOTH) / (n0 + 2 * SMOOTH))
    noise = NOISE * (1 / (c0 + SMOOTH) + 1 / (c1 + SMOOTH))
    return w * np.maximum(0, 1 - noise / np.maximum(w * w, 1e-9))


@dataclass
class Bayes:
    """Counts of documents by label (0, 1) and feature, and of documents by label."""

    counts: np.ndarray
    total: np.ndarray

    def margin(self, view: View, label: np.ndarray | None = None) -> np.ndarray:
        """Mean log odds of label 1 over the features that tell something; with ``label``, each row's by the counts without it."""
        if label is None:
            w = _odds(self.counts[0], self.counts[1], *self.total)[view.flat]
        else:
            own = np.repeat(label, view.size)
            c = [np.maximum(self.counts[y][view.flat] - (own == y), 0) for y in (0, 1)]
            w = _odds(*c, *(np.maximum(self.total[y] - (own == y), 0) for y in (0, 1)))
        return view.sums(w) / np.maximum(1, view.sums((w != 0).astype(float)))


@dataclass
class Teacher:
    """A view's model in a round; rows whose ordered margin is at most ``low`` or at least ``high`` teach the other view."""

    model: Bayes
    low: int = -(2**31)
    high: int = 2**31 - 1


Rounds = list[tuple[Teacher, Teacher]]


def taught(views: tuple[View, View], rounds: Rounds) -> tuple[np.ndarray, np.ndarray]:
    """What each view has been taught of unlabelled rows: 1, 0, or -1 for nothing."""
    out = tuple(np.full(len(v.size), -1, np.int8) for v in views)
    for teachers in rounds:
        for i, t in enumerate(teachers):
            m, to = ordered(t.model.margin(views[i])), out[1 - i]
            free = to < 0
            to[free & (m <= t.low)], to[free & (m >= t.high)] = 0, 1
    return out


def _views(pdf: pd.DataFrame) -> tuple[View, View]:
    return View(pdf["content"]), View(pdf["metadata"])


def _counted(pool: DataFrame, rounds: Rounds) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view (counts, totals) by label over what it has been taught: summed in each task, then by feature on the executors."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, totals = [np.zeros((2, w)) for w in WIDTHS], np.zeros((2, 2))
        for pdf in batches:
            if len(pdf):
                views = _views(pdf)
                for i, known in enumerate(taught(views, rounds)):
                    for y in (0, 1):
                        sums[i][y] += views[i].counts(known == y, WIDTHS[i])
                        totals[i, y] += (known == y).sum()
        for i in (0, 1):
            spans = [totals[i][:, None], *np.split(sums[i], WIDTHS[i] // SPAN, 1)]
            yield pd.DataFrame({"which": i, "span": range(len(spans)), "n": [np.ascontiguousarray(x).tobytes() for x in spans]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"which": pdf["which"].iloc[:1], "span": pdf["span"].iloc[:1], "n": [sum(map(np.frombuffer, pdf["n"])).tobytes()]})

    # each task sends a few spans of counts, of which there are as many in the end
    kind = "which int, span int, n binary"
    got = pool.mapInPandas(add, kind).groupBy("which", "span").applyInPandas(total, kind).toPandas().sort_values(["which", "span"])
    out = []
    for i, width in enumerate(WIDTHS):
        own = [np.frombuffer(x).reshape(2, -1) for x in got[got["which"] == i]["n"]]
        out.append((np.hstack(own[1:]), own[0][:, 0]) if own else (np.zeros((2, width)), np.zeros(2)))
    return out


def _fit(pool: DataFrame, views: tuple[View, View], label: np.ndarray, rounds: Rounds, weight: float) -> tuple[Bayes, Bayes]:
    own = [(np.stack([v.counts(label == y, w) for y in (0, 1)]), np.bincount(label, minlength=2).astype(float)) for v, w in zip(views, WIDTHS, strict=True)]
    if rounds:
        own = [(a + weight * c, b + weight * d) for (a, b), (c, d) in zip(own, _counted(pool, rounds), strict=True)]
    return tuple(Bayes(*x) for x in own)


def _surest(pool: DataFrame, models: tuple[Bayes, Bayes], scales: list[tuple[float, float]], rounds: Rounds, low: int, high: int) -> tuple[Teacher, Teacher]:
    """Who teaches next: the ``low`` least and ``high`` largest margins of all rows that the other view knows nothing of, with ties, if calibration says SURE."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                views = _views(pdf)
                known = taught(views, rounds)
                for i, m in enumerate(models):
                    key, n = np.unique(ordered(m.margin(views[i])[known[1 - i] < 0]), return_counts=True)
                    yield pd.DataFrame({"which": i, "key": key, "n": n})

    # margins are rounded, so there are few
    counts = pool.mapInPandas(keys, "which int, key int, n long").groupBy("which", "key").agg(F.sum("n").alias("n")).toPandas().sort_values(["which", "key"])
    out, odds = [], float(np.log(SURE / (1 - SURE)))
    for i, (m, (a, b)) in enumerate(zip(models, scales, strict=True)):
        own = counts[counts["which"] == i]
        t, key, n = Teacher(m), own["key"].to_numpy(), own["n"].to_numpy()
        if len(key) and a > 0:
            sure = ordered(np.array([(-odds - b) / a, (odds - b) / a]))
            if low:
                t.low = min(int(sure[0]), int(key[min(len(key) - 1, np.searchsorted(n.cumsum(), low))]))
            if high:
                t.high = max(int(sure[1]), int(key[::-1][min(len(key) - 1, np.searchsorted(n[::-1].cumsum(), high))]))
        out.append(t)
    return tuple(out)


@dataclass
class Quality:
    models: tuple[Bayes, Bayes]
    scales: list[tuple[float, float]]
    mix: tuple[float, float, float] = (1.0, 1.0, 0.0)
    rounds: Rounds = field(default_factory=list)

    def logits(self, views: tuple[View, View], label: np.ndarray | None = None) -> list[np.ndarray]:
        return [a * m.margin(v, label) + b for m, v, (a, b) in zip(self.models, views, self.scales, strict=True)]

    def scores(self, views: tuple[View, View]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of both views together, of the content, of the metadata."""
        one, two = self.logits(views)
        return sigmoid(self.mix[0] * one + self.mix[1] * two + self.mix[2]), sigmoid(one), sigmoid(two)


def loss(logit: np.ndarray, label: np.ndarray) -> np.ndarray:
    """What each row's label costs, in nats."""
    return np.logaddexp(0, np.where(label == 1, -logit, logit))


def _scales(models: tuple[Bayes, Bayes], views: tuple[View, View], label: np.ndarray) -> list[tuple[float, float]]:
    """Calibration of each view on rows judged without themselves; a view without skill says the share of good rows of every row."""
    prior = float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1)))
    out = []
    for m, v in zip(models, views, strict=True):
        margin = m.margin(v, label)
        a, b = platt(margin, label.astype(float))
        won = loss(np.full(len(label), prior), label) - loss(a * margin + b, label)
        skilled = a > 0 and won.mean() > SKILL * won.std() / np.sqrt(len(won))
        out.append((a, b) if skilled else (0.0, prior))
    return out


def _mix(logits: list[np.ndarray], label: np.ndarray) -> tuple[float, float, float]:
    """Weights of both views' log odds and an intercept; a view alone, unless both together, neither against its own word, predict labelled rows better by a standard error."""
    both = np.stack(logits, 1)
    w, b = fit_logistic(Sparse(np.repeat(np.arange(len(label)), 2), np.tile([0, 1], len(label)), both.ravel(), len(label), 2), label.astype(float), l2=0.1, steps=300)
    ways = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (float(w[0]), float(w[1]), float(b))]
    lost = [loss(x * logits[0] + y * logits[1] + z, label) for x, y, z in ways]
    alone = int(lost[1].mean() < lost[0].mean())
    won = lost[alone] - lost[2]
    better = won.mean() > won.std() / np.sqrt(len(won))
    return ways[2 if min(w) > 0 and better else alone]


def co_train(pool: DataFrame, unlabelled: int, views: tuple[View, View], label: np.ndarray, rounds: int = ROUNDS, share: float = SHARE) -> Quality:
    """pool: the ``unlabelled`` rows (content, metadata); views, label: the labelled rows."""
    prior = float((label.sum() + 1) / (len(label) + 2))
    weight = min(1.0, MASS * len(label) / max(1, unlabelled))
    many, done = int(share * unlabelled), []
    for _ in range(rounds if many else 0):
        models = _fit(pool, views, label, done, weight)
        done.append(_surest(pool, models, _scales(models, views, label), done, round(many * (1 - prior)), round(many * prior)))
    models = _fit(pool, views, label, done, weight)
    out = Quality(models, _scales(models, views, label), rounds=done)
    out.mix = _mix(out.logits(views, label), label)
    return out


def _viewed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        content = [hashed(content_view(t or ""), WIDTHS[0]) for t in pdf["text"]]
        metadata = [hashed(metadata_view(*x), WIDTHS[1]) for x in zip(pdf["lang"], pdf["source"], pdf["size"], strict=True)]
        yield pd.DataFrame({"id": pdf["id"], "held_out": pdf["held_out"], "quality": pdf["quality"], "content": content, "metadata": metadata})


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", size_col: str = "n_chars", label_col: str = "quality"
) -> DataFrame:
    """Score every whole document, however long: ``id_col``, ``held_out``, ``score`` from 0 to 1, ``content_score``, ``metadata_score``, ``predicted``.

    One row for each of ``docs``. Labels of rows whose id's crc32 is divisible by 5 are never read (``held_out``). A fit
    reads at most ``LABELLED`` labelled ids, by a hash of them, and as many rows of theirs, and all other documents:
    pseudo-labels go to the surest of all, ties together. Null texts are empty; a null or missing language, source or
    length is a value of its own; null ids and labels teach nothing; of an id labelled twice the larger label counts.
    Without labels of both kinds every score is the same. An empty table gives an empty result. Other columns are ignored.
    """
    known = rows_of(labels, lid=id_col, quality=label_col).where("lid is not null and quality is not null").groupBy("lid").agg(F.max("quality").cast("int").alias("quality"))
    known = bounded(known.where(~in_fold(F.col("lid"), 5, 0)), LABELLED, F.col("lid"))
    rows = rows_of(docs, id=id_col, text=text_col, lang=missing_as_null(docs, lang_col, "string"), source=missing_as_null(docs, source_col, "string"), size=missing_as_null(docs, size_col, "double").cast("double"))
    kind = dict(docs.dtypes)[id_col]
    # at most LABELLED pairs of numbers; -1 is without a label, -2 takes no part
    rows = rows.join(F.broadcast(known), F.col("id") == F.col("lid"), "left").withColumn("quality", F.when(F.col("id").isNull(), -2).otherwise(F.coalesce("quality", F.lit(-1))))
    rows = rows.withColumn("held_out", in_fold(F.col("id"), 5, 0)).drop("lid")
    viewed = staged(rows.mapInPandas(_viewed, f"id {kind}, held_out boolean, quality int, content binary, metadata binary"), "views")
    many = {r[0]: r[1] for r in viewed.groupBy("quality").count().collect()}
    if not (many.get(0) and many.get(1)):
        constant = F.lit((many.get(1, 0) + 1) / (many.get(0, 0) + many.get(1, 0) + 2))
        scored = viewed.select("id", "held_out", constant.alias("score"), constant.alias("content_score"), constant.alias("metadata_score"))
    else:
        seen = bounded(viewed.where("quality >= 0").select("quality", "id", "content", "metadata"), LABELLED, F.col("id"), F.col("content")).toPandas()
        pool = viewed.where("quality = -1").select("content", "metadata").coalesce(partitions(docs.sparkSession))
        model = co_train(pool, many.get(-1, 0), _views(seen), seen["quality"].to_numpy(int))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame({"id": pdf["id"], "held_out": pdf["held_out"], **dict(zip(("score", "content_score", "metadata_score"), model.scores(_views(pdf)), strict=True))})

        scored = viewed.mapInPandas(score, f"id {kind}, held_out boolean, score double, content_score double, metadata_score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", "content_score", "metadata_score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
