"""Text statistics over a column. Only Japanese text needs Python, for its words.

``japanese`` says how texts that are Japanese, or mixed with it, are cut: False at white space and marks like others;
True by a lexicon that is learned from the column first; or by a lexicon that is given.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import has_text, safe_percent, trim_text
from ..sources.scratch import kept
from .segment import Lexicon, learn_lexicon

# Character ranges, marks and patterns.
HIRAGANA, KATAKANA, KANJI = r"\x{3040}-\x{309F}", r"\x{30A0}-\x{30FF}", r"\x{4E00}-\x{9FAF}"
JAPANESE = HIRAGANA + KATAKANA + KANJI
MARKS = (".", ",", "!", "?", ";", ":", "。", "、", "！", "？", "；", "：")
PUNCTUATION = r".,!?;:'\"()\[\]{}\-_/\\@#$%^&*+=<>|~`"
_SPACE = r"\s\x{FEFF}"
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
PATTERNS = {
    "email": rf"{_EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{_EDGE}",
    "url": rf"(?U)https?://[^{_SPACE}]+",
    "phone": r"\d{2,4}-\d{2,4}-\d{4}|\d{10,11}",
    "number_only": r"^\d+\z",
    "japanese_only": rf"(?U)^[{JAPANESE}{_SPACE}]+\z",
    "alphanumeric_only": rf"(?U)^[A-Za-z0-9{_SPACE}]+\z",
}
CLASSES = {"hiragana": f"[{HIRAGANA}]", "katakana": f"[{KATAKANA}]", "kanji": f"[{KANJI}]", "alphanumeric": "[a-zA-Z0-9]", "punctuation": f"[{PUNCTUATION}]", "whitespace": rf"(?U)[{_SPACE}]"}
_SENTENCE = r"[.!?。！？]+"
#: What words are cut at, as characters: white space, ends of sentences, all others.
_BLANKS = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
_ENDS, _OTHERS = ".!?。！？", ",;:'\"()[]{}-_/\\@#$%^&*+=<>|~`、；：「」『』（）【】"


def _matches(t: Column, name: str) -> Column:
    """Numbers alone may have white space around them."""
    return (trim_text(t) if name == "number_only" else t).rlike(PATTERNS[name])


def characters_in(text: Column, kind: str) -> Column:
    """How many characters are of a class, by what removing its runs leaves."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{kind}+", ""))


def detect_language(text: Column) -> Column:
    """A struct (language, confidence) by the shares of Japanese and of Latin letters and digits among characters that aren't space."""
    size = F.length(text) - characters_in(text, r"(?U)\s")
    ja, en = (F.coalesce(F.try_divide(characters_in(text, p), size), F.lit(0.0)) for p in (f"[{JAPANESE}]", CLASSES["alphanumeric"]))
    name = F.when(size == 0, "unknown").when(ja > 0.3, "japanese").when(en > 0.7, "english").when((ja > 0.1) & (en > 0.3), "mixed").otherwise("other")
    sure = F.when(size == 0, 0.0).when(ja > 0.3, F.least(ja * 2, F.lit(1.0))).when(en > 0.7, en).when((ja > 0.1) & (en > 0.3), 0.8).otherwise(0.5)
    return F.struct(name.alias("language"), sure.cast("double").alias("confidence"))


def learned(df: DataFrame, column: str | Column, japanese: bool | Lexicon) -> Lexicon | None:
    """What ``japanese`` means for a column: a lexicon, or None."""
    if not isinstance(japanese, bool):
        return japanese
    return learn_lexicon(df.select(F.lower(column).alias("t")), "t") if japanese else None


def _classed(text: Column) -> Column:
    """A text whose white space is all spaces, whose ends of sentences are all points, and whose other marks between words are commas."""
    return F.translate(text, _BLANKS + _ENDS + _OTHERS, " " * len(_BLANKS) + "." * len(_ENDS) + "," * len(_OTHERS))


def tokens(text: Column, lexicon: Lexicon | None = None) -> Column:
    """Words: text without listed punctuation, at white space; with a lexicon, Japanese and mixed texts are cut by it."""
    between = _BLANKS + _ENDS + _OTHERS
    plain = F.filter(F.split(F.translate(text, between, " " * len(between)), " "), lambda t: t != "")
    if lexicon is None:
        return plain
    cut = F.pandas_udf(lambda s: pd.Series(lexicon.words_of_all(s.tolist()), dtype=object), "array<string>")
    own = detect_language(text)["language"].isin("japanese", "mixed")
    return F.when(own, cut(F.when(own, text))).otherwise(plain)  # other texts aren't sent to Python


def word_count(text: Column, lexicon: Lexicon | None = None) -> Column:
    """Number of words, without making them where there is no lexicon."""
    return F.size(tokens(text, lexicon)) if lexicon is not None else F.regexp_count(_classed(text), F.lit("[^ .,]+"))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, _SENTENCE), trim_text), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n\s*\n|\r\n\s*\r\n"), has_text)


def readability(words_per_sentence: Column, chars_per_word: Column) -> Column:
    score = 100 - F.least(words_per_sentence / 20, F.lit(1.0)) * 40 - F.least((chars_per_word - 3) / 5, F.lit(1.0)) * 40
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def sentence_count(text: Column) -> Column:
    """Number of sentences that aren't blank, without making them."""
    return F.regexp_count(_classed(text), F.lit(" *+[^ .][^.]*+"))


#: What is counted of each text.
MEASURES = ("chars", "words", "sentences", "paragraphs")


def _measured(df: DataFrame, column: str, japanese: bool | Lexicon) -> DataFrame:
    """(digest, blank, chars, words, sentences, paragraphs) of each text that isn't null."""
    c = F.col(f"`{column}`").cast("string")
    lexicon, t = learned(df, c, japanese), F.col("t")
    counts = {"chars": F.length(t), "words": word_count(t, lexicon), "sentences": sentence_count(t), "paragraphs": F.size(paragraphs(t))}
    rows = df.select(c.alias("t")).where("t is not null")
    return rows.select(F.unhex(F.sha2(t, 256)).alias("digest"), (~has_text(t)).alias("blank"), *(v.cast("long").alias(k) for k, v in counts.items()))


def _totals() -> list[Column]:
    return [F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(f"total_{m}") for m in MEASURES]


def text_statistics(df: DataFrame, column: str, japanese: bool | Lexicon = False) -> DataFrame:
    """One row: records, empty and unique ones and their shares, totals, means, medians, least and most of characters, words and sentences, readability.

    Null rows have no part; blank texts count as records, and as empty ones. A median is the value at place floor(n / 2).
    Texts are read once: three numbers and a digest of each are kept for the rest.
    """
    rows = kept(_measured(df, column, japanese), "measured")
    records = F.count("*")
    aggs = [
        records.alias("records"), F.count_if("blank").alias("empty_records"), safe_percent(F.count_if("blank"), records).alias("empty_pct"),
        F.count_distinct("digest").alias("unique_records"), safe_percent(F.count_distinct("digest"), records).alias("unique_pct"),
    ]
    aggs += _totals() + [F.avg(m).alias(f"mean_{m}") for m in MEASURES]
    for m in MEASURES[:3]:
        aggs += [F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}")]
    from .stats import index_quantiles

    long = rows.select(F.inline(F.array(*(F.struct(F.lit(m).alias("m"), F.col(m).alias("v")) for m in MEASURES[:3]))))
    medians = index_quantiles("v", ["m"], long, {"median": 0.5}).agg(*(F.max(F.when(F.col("m") == m, F.col("median"))).alias(f"median_{m}") for m in MEASURES[:3]))
    wps, cpw = (F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)) for a, b in (("total_words", "total_sentences"), ("total_chars", "total_words")))
    return rows.agg(*aggs).crossJoin(F.broadcast(medians)).withColumn("words_per_sentence", wps).withColumn("readability", readability(wps, cpw))


def word_frequency(df: DataFrame, column: str, k: int = 20, japanese: bool | Lexicon = False) -> DataFrame:
    """(word, count, pct): lower-case words of two letters or more; the share is of all words."""
    t = F.lower(F.col(f"`{column}`").cast("string"))
    words = df.select(F.explode(tokens(t, learned(df, t, japanese))).alias("word")).groupBy("word").agg(F.count("*").alias("count"))
    total = words.agg(F.sum("count").alias("n"))
    # short words come last rather than being filtered first, so that both uses of the counts share one pass over the texts
    long = F.length("word") >= 2
    return words.orderBy(F.desc(long), F.desc("count"), "word").limit(k).where(long).crossJoin(F.broadcast(total)).select("word", "count", safe_percent(F.col("count"), F.col("n")).alias("pct"))


def char_frequency(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """(char, count, pct) without white space, upper and lower case apart."""
    chars = df.select(F.explode(F.split(F.regexp_replace(F.col(f"`{column}`"), r"(?U)\s+", ""), "")).alias("char")).where("char <> ''").groupBy("char").agg(F.count("*").alias("count"))
    total = chars.agg(F.sum("count").alias("n"))
    return chars.orderBy(F.desc("count"), "char").limit(k).crossJoin(F.broadcast(total)).select("char", "count", safe_percent(F.col("count"), F.col("n")).alias("pct"))


def _least_three(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(pattern, count, example) of a task: each pattern's count with its first text, and up to two more."""
    counts: Counter = Counter()
    least: dict[str, list[str]] = {}
    for pdf in batches:
        counts[""] += len(pdf)
        for name in PATTERNS:
            own = pdf["t"][pdf[name]]
            if len(own):
                counts[name] += len(own)
                least[name] = sorted({*own, *least.get(name, [])}, key=lambda t: t.encode("utf-8", "surrogatepass"))[:3]
    rows = [(name, n if not i else 0, t) for name, n in counts.items() for i, t in enumerate(least.get(name, [None]))]
    if rows:
        yield pd.DataFrame(rows, columns=["pattern", "count", "example"])


def text_patterns(df: DataFrame, column: str) -> DataFrame:
    """(pattern, count, pct, examples): rows that match, of all that aren't null; the first three different texts in their order, if so many, as examples; patterns without a match are left out.

    One pass: patterns are matched by Spark, and each task passes on its counts and three texts for each pattern. A text
    that matches nothing isn't sent to Python.
    """
    t = F.col(f"`{column}`").cast("string")
    marked = df.select(t.alias("t")).where("t is not null").select("t", *(_matches(F.col("t"), name).alias(name) for name in PATTERNS))
    any_of = reduce(lambda a, b: a | b, (F.col(name) for name in PATTERNS))
    parts = kept(marked.withColumn("t", F.when(any_of, F.col("t"))).mapInPandas(_least_three, "pattern string, count long, example string"), "patterns")
    counts = parts.groupBy("pattern").agg(F.sum("count").alias("count"))
    total = counts.where("pattern = ''").select(F.col("count").alias("n"))
    place = F.row_number().over(Window.partitionBy("pattern").orderBy("example"))
    first = parts.where("example is not null").select("pattern", "example").distinct().withColumn("place", place).where("place <= 3")
    examples = first.groupBy("pattern").agg(F.array_sort(F.collect_list("example")).alias("examples"))
    return counts.where("pattern <> ''").join(F.broadcast(total)).join(examples, "pattern").select("pattern", "count", safe_percent(F.col("count"), F.col("n")).alias("pct"), "examples")


def language_detection(df: DataFrame, column: str) -> DataFrame:
    """(language, count, pct, confidence) of the rows that aren't null; a blank text's language is unknown."""
    rows = df.select(F.col(f"`{column}`").cast("string").alias("t")).where("t is not null").select(detect_language(F.col("t")).alias("d"))
    found = rows.groupBy(F.col("d.language").alias("language")).agg(F.count("*").alias("count"), F.avg("d.confidence").alias("confidence"))
    total = F.sum("count").over(Window.partitionBy())  # of five languages at most
    return found.select("language", "count", safe_percent(F.col("count"), total).alias("pct"), "confidence")


def char_types(df: DataFrame, column: str) -> DataFrame:
    """(char_type, count, pct) of hiragana, katakana, kanji, alphanumeric, punctuation, white space and other."""
    t = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    sums = {k: F.sum(F.regexp_count(t, F.lit(p))).cast("long").alias(k) for k, p in CLASSES.items()}
    wide = df.agg(*sums.values(), F.sum(F.length(t)).cast("long").alias("n"))
    wide = wide.withColumn("other", F.col("n") - reduce(lambda a, b: a + b, (F.col(k) for k in CLASSES)))
    long = wide.select("n", F.inline(F.array(*(F.struct(F.lit(k).alias("char_type"), F.col(k).alias("count")) for k in (*CLASSES, "other")))))
    return long.where("count > 0").select("char_type", "count", safe_percent(F.col("count"), F.col("n")).alias("pct"))


def sentence_analysis(df: DataFrame, column: str, japanese: bool | Lexicon = False) -> DataFrame:
    """(kind, name, count, mean): sentences in all with their mean number of words, by length, and punctuation marks."""
    t = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
    one = df.select(F.explode(sentences(t)).alias("s")).select(word_count(F.col("s"), learned(df, t, japanese)).alias("w"))
    w = F.col("w")
    band = F.when(w <= 5, "0-5").when(w <= 10, "6-10").when(w <= 20, "11-20").when(w <= 30, "21-30").otherwise("31+")
    none = F.lit(None).cast("double")
    total = one.agg(F.lit("total").alias("kind"), F.lit("sentences").alias("name"), F.count("*").alias("count"), F.avg("w").alias("mean"))
    bands = one.groupBy(band.alias("name")).agg(F.count("*").alias("count")).select(F.lit("length").alias("kind"), "name", "count", none.alias("mean"))
    wide = df.agg(*(F.sum(F.length(t) - F.length(F.replace(t, F.lit(m), F.lit("")))).cast("long").alias(f"m{i}") for i, m in enumerate(MARKS)))
    marks = wide.select(F.inline(F.array(*(F.struct(F.lit("mark").alias("kind"), F.lit(m).alias("name"), F.col(f"m{i}").alias("count"), none.alias("mean")) for i, m in enumerate(MARKS))))).where("count > 0")
    return total.unionByName(bands).unionByName(marks)


def readability_report(df: DataFrame, column: str, japanese: bool | Lexicon = False) -> DataFrame:
    """(score, level, words_per_sentence, chars_per_word, recommendations) of the rows that aren't null."""
    sums = _measured(df, column, japanese).agg(*_totals())
    wps, cpw = (F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)) for a, b in (("total_words", "total_sentences"), ("total_chars", "total_words")))
    base = sums.select(wps.alias("words_per_sentence"), cpw.alias("chars_per_word")).withColumn("score", readability(F.col("words_per_sentence"), F.col("chars_per_word")))
    s, a, b = F.col("score"), F.col("words_per_sentence"), F.col("chars_per_word")
    level = F.when(s >= 80, "very easy").when(s >= 60, "easy").when(s >= 40, "normal").when(s >= 20, "difficult").otherwise("very difficult")
    advice = F.array_compact(F.array(F.when(a > 20, F.lit("shorten sentences")), F.when(a < 5, F.lit("join short sentences")), F.when(b > 8, F.lit("use shorter words")), F.when(s < 40, F.lit("simplify"))))
    return base.select("score", level.alias("level"), "words_per_sentence", "chars_per_word", F.when(F.size(advice) == 0, F.array(F.lit("fine as it is"))).otherwise(advice).alias("recommendations"))
