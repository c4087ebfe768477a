import json
import math
import os
import random
import re
import sqlite3
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.functions.coerce import num, parse_date
from sparkloom.operators import filters, frequent, information, mining, missing, multivariate, preview, profile, ranks, sampling, segment, series, stats, text
from sparkloom.operators.filters import Filter
from sparkloom.operators.ordering import with_row_index
from sparkloom.plans import catalogue
from sparkloom.sources import encoding, files, json_document
from sparkloom.sources.workspace import Workspace, write
from sparkloom.streaming import monitor, simulator


def test_numbers_in_text(spark):
    values = [" 5 ", "1e5", ".5", "5.", "", "abc", "5abc", "1,000", "NaN", "Infinity", "1d", "1_000", "0x10", None]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    assert [r[0] for r in df.select(num(df, "s")).collect()] == [5.0, 1e5, 0.5, 5.0] + [None] * 10


def test_values_at_places(spark):
    """With brackets and with many rounds of cutting, against sorted values."""
    rng = random.Random(5)
    rows = [("a", float(rng.randint(0, 400))) for _ in range(3000)] + [("b", rng.gauss(0, 1)) for _ in range(2000)] + [("c", 7.0)] * 500 + [("d", None)] + [("e", 1.5)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    places = {"low": (0.25, lambda n: F.floor((n - 1) * 0.25)), "high": (0.25, lambda n: F.ceil((n - 1) * 0.25)), "first": (0.0, lambda n: F.lit(0)), "last": (1.0, lambda n: n - 1), "mid": (0.5, lambda n: F.floor(n * 0.5))}
    want = {}
    for g in "abce":
        v = sorted(x for k, x in rows if k == g)
        n = len(v)
        want[g] = (v[math.floor((n - 1) * 0.25)], v[math.ceil((n - 1) * 0.25)], v[0], v[-1], v[min(n - 1, n // 2)], n)
    for most in (stats.ORDERED, 50, 3):
        got = {r.g: (r.low, r.high, r.first, r["last"], r.mid, r.k) for r in stats.values_at(df, "x", ["g"], places, [F.count("x").alias("k")], most).collect()}
        assert got == want
    whole = stats.values_at(df.where("g = 'b'"), "x", [], {"mid": places["mid"]}).first()
    assert whole.mid == want["b"][4]
    assert stats.values_at(df.limit(0), "x", ["g"], places).count() == 0


def test_dates(spark):
    values = ["2024-03-01", "2024-03-01T10:20:30", "03/01/2024", "2024/03/01", "2024-3-1", "2024年3月1日", "2024年3月1日 10時20分30秒", "nothing", "2024-13-45"]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r[0] for r in df.select(parse_date("s")).collect()]
    assert [x is not None for x in got] == [True] * 7 + [False] * 2
    assert {(x.year, x.month, x.day) for x in got[:7]} == {(2024, 3, 1)}


def test_basic_statistics(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "x double")
    assert stats.basic_stats(df, ["x"]).select("q1", "q2", "q3").first() == (2.0, 4.0, 8.0)
    assert stats.basic_stats_sql(df, ["x"]).first().q1 == 1.75
    ages = spark.createDataFrame([(a,) for a in ("30", "25", "35", "28", "32")], "age string")
    row = stats.basic_stats(ages, ["age"]).first()
    assert (row["count"], row["mean"], row["q1"], row["q2"], row["q3"]) == (5, 30.0, 28.0, 30.0, 32.0)
    assert math.isclose(row["std"], math.sqrt(11.6))


def test_constant_column(spark):
    df = spark.createDataFrame([(7.0, float(i)) for i in range(12)], "x double, i double")
    assert stats.correlation_matrix(df, ["x", "i"]).first().correlation == 0.0
    assert [r["count"] for r in stats.histogram(df, "x", 3).orderBy("bin").collect()] == [12, 0, 0]
    assert series.change_points(df, "x", algorithm="ewma", order_by=["i"]).count() == 0
    assert stats.basic_stats(df.limit(0), ["x"]).count() == 0


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "i int, s string")
    n = lambda *f, **k: filters.apply_filters(df, list(f), **k).count()
    assert n(Filter("s", "not_equals", "a")) == 1 and n(Filter("s", "not_equals", "a"), null_mode="memory") == 2
    assert n(Filter("s", "not_in", values=["a"]), null_mode="memory") == 2
    assert n(Filter("s", "equals", ""), null_mode="memory") == 2
    assert n(Filter("i", "greater_than", None)) == 0 and n(Filter("i", "in")) == 0 and n(Filter("i", "not_in")) == 3
    assert n(Filter("i", "greater_than", "1")) == 2
    with pytest.raises(ValueError):
        n(Filter("i", "between", 1))
    assert filters.coerce_list("1, 2,", df.schema["i"].dataType) == [1, 2]


def test_sorting_and_pages(spark):
    df = spark.createDataFrame([(None,), ("10",), ("9",)], "s string")
    assert [r[0] for r in preview.sort_rows(df, "s", kind="NUMERIC").collect()] == [None, "9", "10"]
    assert [r[0] for r in preview.sort_rows(df, "s", kind="NUMERIC", nulls="result").collect()] == ["9", "10", None]
    assert preview.page_count(11, 5) == 3


@pytest.mark.parametrize("zero, lengths", [(True, [3]), (False, [2])])
def test_missing_runs(spark, zero, lengths):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["a", None, "", "0", "b", None])], "i long, v string")
    flags = missing.missing_flags(df, ["v"], ["i"], include_zero=zero)
    events = missing.missing_events(flags).orderBy("row_index").collect()
    assert [e.row_index for e in events if e.event == "missing_start"] == [1, 5]
    assert [e.length for e in events if e.event == "missing_end"] == lengths
    assert [e.previous_value for e in events][0] == "a"
    row = missing.missing_stats(flags).first()
    assert row.runs == 2 and row.max_length == lengths[0]
    small = missing.missing_flags(df, ["v"], ["i"], include_zero=zero, chunk=2)
    assert sorted(map(tuple, missing.missing_events(small).collect()), key=str) == sorted(map(tuple, events), key=str)


def test_row_index_and_samples(spark):
    values = list(range(5000))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v, float(v % 17)) for v in values], "v long, y double").repartition(7)
    assert with_row_index(df, ["v"]).where("row_index <> v").count() == 0
    got = sorted(r.v for r in sampling.sample_rows(df, ["v"], 100).collect())
    assert got == sorted({0, 4999, *(math.floor(i * 50 + 0.5) for i in range(1, 99))})
    assert sampling.sample_rows(df, ["v"], 100, "systematic", seed=3).count() == 100
    assert sampling.sample_rows(df, ["v"], 100, "stratified").count() == 100
    assert with_row_index(df.limit(0), ["v"]).count() == 0
    with pytest.raises(ValueError):
        sampling.sample_rows(df, ["v"], 100, "other")


def test_step_is_found(spark):
    df = spark.createDataFrame([(i, 0.0 if i < 20 else 10.0) for i in range(40)], "i long, x double")
    found = {a: [r["index"] for r in series.change_points(df, "x", order_by=["i"], algorithm=a).collect()] for a in series.ALGORITHMS}
    assert 20 in found["binary_segmentation"] and found["cusum"]
    x = np.array([0.0] * 20 + [10.0] * 20)
    want = [i for i in range(3, 37) if abs(x[i : i + 3].mean() - x[i - 3 : i].mean()) > 2 * x.std()]
    assert found["moving_average"] == want


def test_time_series(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "i long, x double")
    rows = series.time_series(df, "x", order_by=["i"]).orderBy("index").collect()
    assert rows[0].direction == "increasing" and rows[50].moving_average == 48.0 and math.isclose(rows[7].trend, 7.0, abs_tol=1e-9)


def test_inference(spark):
    df = spark.createDataFrame([(str(i), f"{i}.5", "true", "2024年1月2日", None) for i in range(20)], "a string, b string, c string, d string, e string")
    got = {r.column_name: r.inferred_type for r in profile.infer_types(df, df.columns, ["a"]).collect()}
    assert got == {"a": "INTEGER", "b": "FLOAT", "c": "BOOLEAN", "d": "DATE", "e": "TEXT"}
    with pytest.raises(ValueError):
        profile.check_arity("correlation", ["a"])


def test_multivariate(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    df = spark.createDataFrame([(float(a), float(b), float(a + b), float(b)) for a, b in x], "a double, b double, c double, d double")
    assert math.isclose(multivariate.canonical_correlation(df, ["a"], ["c", "d"]).first().correlation, 1.0, abs_tol=1e-9)
    with pytest.raises(ValueError):
        multivariate.canonical_correlation(df, ["a"], ["b", "d"])
    shares = [r.share for r in multivariate.pca(df, ["a", "b"]).where("column_name = 'a'").orderBy("factor").collect()]
    assert math.isclose(sum(shares), 100) and shares[0] >= shares[1]


def test_text(spark):
    rows = [("これは日本語の文章です。とても短い。",), ("Hello world. This is text!",), ("",), (None,), ("mail a@b.co or https://x.y",)]
    df = spark.createDataFrame(rows, "t string")
    got = {r.language: r["count"] for r in text.language_detection(df, "t").collect()}
    assert got == {"japanese": 1, "unknown": 1, "english": 2}
    row = text.text_statistics(df, "t").first()
    assert row.records == 4 and row.empty_records == 1
    assert {r.pattern for r in text.text_patterns(df, "t").collect()} == {"email", "url"}
    words = {r.word for r in text.word_frequency(df, "t", japanese=True).collect()}
    assert {"hello", "日本語"} <= words
    assert text.readability_report(df, "t").first().level


def test_text_rules(spark):
    """Nulls have no part, blank texts are records, digits count as letters."""
    df = spark.createDataFrame([("ab cd",), (None,), ("   ",), ("12345 67",)], "t string")
    row = text.text_statistics(df, "t").first()
    assert (row.records, row.empty_records, row.unique_records, row.mean_chars, row.total_words, row.median_words, row.min_words) == (3, 1, 3, 16 / 3, 4, 2, 0)
    got = {r.language: (r["count"], round(r.pct, 3), r.confidence) for r in text.language_detection(df, "t").collect()}
    assert got == {"english": (2, 66.667, 1.0), "unknown": (1, 33.333, 0.0)}
    none = text.text_statistics(df.where("t is null"), "t").first()
    assert none.records == 0 and none.median_chars is None and none.total_chars == 0


def all_cuts(run):
    if not run:
        yield []
    for i in range(1, len(run) + 1):
        for rest in all_cuts(run[i:]):
            yield [run[:i], *rest]


def test_japanese_cuts_against_all_cuts():
    """Viterbi and expected counts against every way to cut a run."""
    rng = random.Random(7)
    for _ in range(150):
        words = {"".join(rng.choice("日本ですタ") for _ in range(rng.randint(1, 3))): -rng.uniform(0.5, 6) for _ in range(12)}
        lexicon = segment.Lexicon(words)
        run = "".join(rng.choice("日本ですタ京") for _ in range(rng.randint(1, 9)))

        def score(cut):
            total, at = 0.0, 0
            for w in cut:
                one_script = re.fullmatch("[一-龯]{2,}|[ァ-ヶ]{2,}", w) and any(m.span() == (at, at + len(w)) for m in re.finditer("[一-龯]+|[ァ-ヶ]+", run))
                if w not in words and len(w) > 1 and not one_script:
                    return -math.inf
                total += words.get(w, lexicon.unknown - (len(w) - 1))
                at += len(w)
            return total

        scores = {tuple(c): score(c) for c in all_cuts(run)}
        best = max(scores.values())
        assert math.isclose(scores[tuple(lexicon.cut(run))], best)
        whole = math.log(sum(math.exp(v) for v in scores.values()))
        want = Counter()
        for cut, v in scores.items():
            for w in cut:
                if w in words:
                    want[w] += 3 * math.exp(v - whole)
        got = {}
        assert math.isclose(lexicon.expected(run, 3, got), 3 * whole, abs_tol=1e-9)
        assert all(math.isclose(got.get(w, 0), want[w], abs_tol=1e-9) for w in {*got, *want})


def test_japanese_runs_side_by_side():
    """Many runs at once: substrings against a pattern, cuts and expected counts against each run by itself; in a few microseconds a character."""
    rng = random.Random(11)
    letters = "日本語々東京ですまーテレビのぁゟ゠"
    runs = ["".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 3, 9, 40, 200)))) for _ in range(300)] + ["東" * 5000]
    times = [rng.randint(1, 5) for _ in runs]
    pdf = pd.DataFrame({"run": runs, "n": times})
    got = pd.concat(segment._substrings(8)(iter([pdf[:100], pdf[100:]]))).groupby("word").agg({"n": "sum", "whole": "max"})
    want, whole = Counter(), set()
    for run, n in zip(runs, times, strict=True):
        for piece in (run[i : i + segment.WINDOW] for i in range(0, len(run), segment.WINDOW)):
            whole.update(w for w in re.findall("[一-龯々]{2,}|[゠-ヿ]{2,}", piece) if len(w) <= 8)
            for i in range(len(piece)):
                for w in (piece[i : i + k] for k in range(1, min(8, len(piece) - i) + 1)):
                    if re.fullmatch("[一-龯々]+[ぁ-ゟ]{0,4}|[ぁ-ゟー]+|[゠-ヿ]+", w):
                        want[w] += n
    assert got["n"].to_dict() == want and set(got.index[got["whole"]]) == whole
    lexicon = segment.maximised({w: float(n) for w, n in want.items() if n > 2})
    assert lexicon.cut_all(runs) == [lexicon.cut(r) for r in runs]
    assert all("".join(words) == r for words, r in zip(lexicon.cut_all(runs), runs, strict=True))
    each: dict = {}
    for run, n in zip(runs[:-1], times, strict=False):
        lexicon.expected(run, n, each)
    into = np.full(len(lexicon.words), np.nan)
    lexicon.expected_all(runs[:-1], np.array(times[:-1], float), into)
    counts = {w: n for w, n in zip(lexicon.words, into.tolist(), strict=True) if n == n}
    assert counts.keys() == each.keys() and all(math.isclose(counts[w], each[w], rel_tol=1e-9) for w in each)
    many = ["".join(rng.choice(letters) for _ in range(25)) for _ in range(8000)]
    began = time.process_time()
    lexicon.expected_all(many, np.ones(len(many)), np.full(len(lexicon.words), np.nan))
    assert time.process_time() - began < 8e-6 * 200_000


def test_japanese_long_runs_are_cut_in_windows():
    lexicon = segment.Lexicon({"日本": -2.0, "語": -2.0, "です": -2.0})
    run = "日本語です" * 5000
    assert lexicon.cut(run) == ["日本", "語", "です"] * 5000


def test_japanese_lexicon(spark):
    rng = random.Random(3)
    nouns, ends = ["東京", "大学", "コーヒー", "日本語", "新聞", "テレビ"], ["です", "でした", "がある", "を見る", "へ行く"]
    rows = [("".join(rng.choice(nouns) + "の" for _ in range(2)) + rng.choice(nouns) + rng.choice(ends) + "。",) for _ in range(400)] + [(None,), ("",), ("plain words",)]
    df = spark.createDataFrame(rows, "t string")
    lexicon = segment.learn_lexicon(df, "t")
    assert lexicon.words_of("東京の大学でした。mixed テキスト") == ["東京", "の", "大学", "でした", "mixed", "テキスト"]
    counts = {r.word: r["count"] for r in text.word_frequency(df, "t", 50, japanese=True).collect()}
    want = Counter(w for t, in rows if t for w in lexicon.words_of(t) if len(w) >= 2)
    assert {w: n for w, n in counts.items() if w != "plain" and w != "words"} == {w: n for w, n in want.items() if w not in ("plain", "words")}
    assert {"東京", "大学", "コーヒー", "日本語", "新聞", "テレビ"} <= counts.keys()
    assert segment.learn_lexicon(df.where("t = 'plain words'"), "t").words == {}
    assert text.sentence_analysis(df, "t", lexicon).where("kind = 'total'").first()["count"] == 401


def test_japanese_words_query(spark):
    """Most words of the transliterated conversations are cut where the spaces were."""
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("text is not null").select(F.transform(F.split(F.lower("text"), " "), catalogue.in_japanese).alias("w")).select("w", F.array_join("w", "").alias("t"))
    lexicon = segment.learn_lexicon(rows, "t")
    hit = true = 0
    for r in rows.collect():
        places = lambda words: set(np.cumsum([len(w) for w in words]).tolist())
        got, want = places(lexicon.words_of(r.t)), places([x for w in r.w for x in re.findall(segment.JAPANESE_RUN, w)])
        hit, true = hit + len(got & want), true + len(want)
    assert hit > 0.7 * true


def test_pattern_examples(spark):
    rows = [("d@x.org",), ("b@x.org",), ("a@x.org",), ("a@x.org",), ("c@x.org",), ("7",), (None,), ("no match here",)]
    got = {r.pattern: (r["count"], r.examples) for r in text.text_patterns(spark.createDataFrame(rows, "t string"), "t").collect()}
    assert got == {"email": (5, ["a@x.org", "b@x.org", "c@x.org"]), "number_only": (1, ["7"]), "alphanumeric_only": (2, ["7", "no match here"])}


def test_csv(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('name, note ,x\r\n"a ""b""","c, d",1\r\n\r\ne\r\nf,g,h,i\r\n', encoding="utf-8")
    df = files.read_csv(spark, str(p))
    assert df.columns == ["name", "note", "x"]
    assert [tuple(r) for r in df.collect()] == [('a "b"', "c, d", "1"), ("e", None, None), ("f", "g", "h")]


@pytest.mark.parametrize("name", ["utf-8", "utf-8-sig", "utf-16", "shift_jis", "euc_jp", "iso2022_jp"])
def test_encodings(spark, tmp_path, name):
    p = tmp_path / "e.csv"
    p.write_bytes("名前,町\nたなか,東京の町です\nさとう,大阪にすみます\n".encode(name))
    assert files.read_csv(spark, str(p)).where("`町` like '東京%'").count() == 1
    assert encoding.describe("sjis").startswith("Japanese") and encoding.corruption("�") == 1


@pytest.mark.parametrize("name", ["shift_jis", "euc_jp", "iso2022_jp", "cp1252"])
def test_encodings_in_ranges(spark, tmp_path, name):
    """A file in ranges of a few hundred bytes, which begin anywhere in a character: the same rows as decoded whole."""
    rng = random.Random(2)
    letters = "abcéü" if name == "cp1252" else "abc東京表示ソ能十ーあいう"  # some of these have bytes of ASCII letters, brackets and backslashes in them
    rows = [(str(i), "".join(rng.choice(letters) for _ in range(rng.randint(1, 30)))) for i in range(400)]
    p = tmp_path / "own.csv"
    p.write_bytes("".join(f"{a},{b}\r\n" for a, b in [("id", "名" if name != "cp1252" else "nom"), *rows]).encode(name))
    j = tmp_path / "own.json"
    j.write_bytes(json.dumps([{"id": a, "v": b} for a, b in rows], ensure_ascii=False, indent=1).encode(name))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = files.read_csv(spark, str(p), encoding=name)
        assert df.rdd.getNumPartitions() >= 8
        assert [tuple(r) for r in df.collect()] == rows
        assert sorted(map(tuple, files.read_json(spark, str(j), name).collect())) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def json_like(rng, depth=0):
    odd = ['"', "\\", "[", "]", "{", "}", ",", ":", "é", "\n", "日", "a", " "]
    kind = rng.randint(0, 6 if depth < 3 else 3)
    if kind == 0:
        return rng.choice([True, None, 12, -3, False])
    if kind <= 3:
        return "".join(rng.choice(odd) for _ in range(rng.randint(0, 12)))
    if kind <= 4:
        return [json_like(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(odd) + str(rng.randint(0, 3)): json_like(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def test_json_elements_in_ranges(spark, tmp_path):
    """Documents full of brackets and quotes inside strings, read in ranges of a few bytes, against a parser."""
    rng = random.Random(4)
    for k, indent in enumerate((None, None, 1)):
        rows = [json_like(rng) for _ in range(60)]
        p = tmp_path / f"{k}.json"
        p.write_text("\ufeff" * (k == 1) + json.dumps(rows, ensure_ascii=k == 0, indent=indent) + "\n")
        for size in ("97", "1500", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            try:
                found = json_document.elements(files.raw_lines(spark, str(p), ","))
                got = [json.loads(r.text) for r in found.orderBy("path", "block", "i").collect()]
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
                spark.conf.unset("spark.sql.files.openCostInBytes")
            assert got == rows


def test_json_documents(spark, tmp_path):
    def read(text):
        p = tmp_path / f"{abs(hash(text))}.json"
        p.write_text(text)
        return files.read_json(spark, str(p))

    df = read('[{"z": 1, "a": "mentions \\"b\\" and late"}, 5, {"b": {"y": 1, "x": [1, 2]}, "7": true, "3": null, "it\'s": "q"}, {"late": 2.5, "Z": 0}]')
    assert df.columns == ["z", "a", "3", "7", "b", "it_s", "late", "Z_2"]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(
        [("1", 'mentions "b" and late') + (None,) * 6, (None,) * 8, (None, None, None, "true", '{"y":1,"x":[1,2]}', "q", None, None), (None,) * 6 + ("2.5", "0")], key=str
    )
    assert read(' {"only": [1, {"k": "]"}]} ').collect() == [('[1,{"k":"]"}]',)]
    for bad in ("[1, 2]", "[]", "", '[{"a": 1}', '[{"a": 1}]]', '[{"a": nope}]', '[{"a": "open]', "[{}]", '"text"'):
        with pytest.raises(ValueError):
            read(bad)


def test_json_document_in_parts(spark, tmp_path):
    """A folder's files as one document, of which each is read in ranges of a few bytes; each file must end between elements."""
    rng = random.Random(9)
    rows = [{"k": i, "v": json_like(rng)} for i in range(90)] + [{"late": 1}]
    lines = [json.dumps(r) + ("," if i < 90 else "]") + "\n" for i, r in enumerate(rows)]
    for n in (1, 20, 91):
        folder = tmp_path / f"{n}.json"
        folder.mkdir()
        for i, at in enumerate(range(0, 91, n)):
            (folder / f"part-{i:05d}.txt").write_text("[\n" * (i == 0) + "".join(lines[at : at + n]))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "197")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            found = json_document.elements(files.raw_lines(spark, str(folder), ","), parts=True)
            assert [json.loads(r.text) for r in found.orderBy("path", "block", "i").collect()] == rows
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    df = files.read_json(spark, str(folder), parts=True)
    assert df.columns == ["k", "v", "late"] and df.count() == 91
    for cut in (['[{"a": 1}, {"b":', " 2}]"], ['[{"a": 1}]', '[{"a": 2}]'], ['[{"a": "x,', 'y"}]'], ['[{"a": 1},', '{"a": 2}']):
        bad = tmp_path / f"bad{len(list(tmp_path.iterdir()))}.json"
        bad.mkdir()
        for i, part in enumerate(cut):
            (bad / f"{i}.txt").write_text(part)
        with pytest.raises(ValueError):
            files.read_json(spark, str(bad), parts=True)


@pytest.mark.parametrize("name", ["json_load", "csv_odd_lines", "csv_shift_jis", "csv_iso2022_jp", "csv_utf_8_sig", "encoding_detection"])
def test_lines_are_written_in_parts(spark, monkeypatch, name):
    """No task writes the whole of a file: the same rows from files of some 40 lines each."""
    made, folder = [], catalogue.scratch_path
    monkeypatch.setattr(catalogue, "scratch_path", lambda s, n: made.append(folder(s, n)) or made[-1])
    read = lambda: sorted(map(str, catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
    want = read()
    monkeypatch.setattr(catalogue, "PART", 40)
    made.clear()
    assert read() == want
    assert made and all(len([f for f in os.listdir(p.removeprefix("file:")) if f.startswith("part-")]) > 2 for p in made)


@pytest.mark.parametrize("name", ["range_scan", "values_scan"])
def test_large_tables_are_counted_before_a_join_on_few_values(spark, name):
    """Joined as they are, all rows of a value would be sorted in one task."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join, scan = (next(i for i, line in enumerate(plan) if word in line) for word in ("Join ", " parquet"))
    assert any("Aggregate " in line for line in plan[join:scan])


def test_json_and_children(spark, tmp_path):
    p = tmp_path / "j.json"
    p.write_text('[{"b": 1, "a": "x", "o": {"k": 2}}, {"b": null, "c": true}]', encoding="utf-8")
    df = files.read_json(spark, str(p))
    assert df.columns == ["b", "a", "o", "c"] and df.first().o == '{"k":2}'
    rows = spark.createDataFrame([(1, '{"k": 5}'), (2, '{"k": 6, "z": "u"}'), (3, "[1]")], "i int, j string")
    child = files.json_child_table(rows, "t", "j", ["i"])
    assert sorted((r.k, r.z, r._source_row_id) for r in child.collect()) == [(5, None, 1), (6, "u", 2)]
    assert files.json_child_table(rows.selectExpr("i", "'x' as j"), "t", "j", ["i"]) is None


def test_workspace(spark, tmp_path):
    db = tmp_path / "d.sqlite"
    con = sqlite3.connect(db)
    con.execute("create table t (i integer, r real, s text not null)")
    con.executemany("insert into t values (?, ?, ?)", [(1, 0.5, "a"), (2, None, "b")])
    con.execute("create table u (x)")
    con.commit()
    con.close()
    w = Workspace(spark)
    assert w.load(str(db)) == ["t", "u"] and w.count("t") == 2
    assert w.sql("select s from t where i = :i", i=2).first().s == "b"
    w.insert("t", spark.createDataFrame([(3, "c")], "i long, s string"))
    assert w.count("t", [Filter("s", "in", values=["b", "c"])]) == 2
    assert {r.table_name: r.rows for r in w.union_counts(["t", "u"]).collect()} == {"t": 3, "u": 0}
    write(w.table("t"), str(tmp_path / "out.csv"), single=True)
    assert files.read_csv(spark, str(tmp_path / "out.csv")).count() == 3
    write(w.table("t"), str(tmp_path / "o.sqlite"), "sqlite")
    assert Workspace(spark).load(str(tmp_path / "o.sqlite")) == ["data"]
    bad = tmp_path / "x.sqlite"
    bad.write_bytes(b"SQLite format 3\0" + bytes(1008))
    assert isinstance(w.load_all([str(bad), str(tmp_path / "a.exe")])[str(tmp_path / "a.exe")], ValueError)
    w.drop("t")
    assert "t" not in w.tables()


def test_names():
    assert files.clean_column(" a'b  c; ") == "a_b_c" and files.clean_column("", 3) == "column_3"
    assert files.clean_table("1 x") == "t_1_x" and len(files.clean_table("a" * 90)) == 63
    assert files.base_name("/a/b.c.csv") == "b.c" and files.is_accepted("x.TSV") and not files.is_accepted("x.exe")


def test_sql_errors(spark):
    for bad in ("select * from nowhere", "selec 1", "select 1/0"):
        with pytest.raises(Exception):
            spark.sql(bad).collect()
    assert spark.sql("WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 1000) SELECT count(*) FROM n").first()[0] == 1000


def test_monitor(spark):
    sizes, told, ran = [3, 5, 5, 1], [], []
    m = monitor.Monitor(spark, 1)
    m.notifications.listeners += [told.append, lambda n: 1 / 0]
    m.subscribe("t", lambda: sizes.pop(0))
    m.on_change("t", ran.append)
    for _ in range(3):
        m.check()
    assert [(n.change_type, n.count) for n in told] == [("inserted", 2), ("deleted", 4)] and ran == ["t", "t"]
    m.notifications.acknowledge(1)
    assert m.notifications.unacknowledged() == 1 and m.seconds == 5
    assert m.notifications.frame(spark).count() == 2


def test_simulator(spark):
    t = simulator.sample_table(spark, 200, rate=50)
    assert t.columns[0] == "id" and t.where("category is null or category = ''").count() > 40
    assert sorted(map(str, t.collect())) == sorted(map(str, simulator.sample_table(spark, 200, rate=50).collect()))
    assert simulator.sample_table(spark, 50, rate=0).where("score is null").count() == 0


def test_display(spark):
    from sparkloom.functions import display

    numbers = [None, float("nan"), 0.0, 5.0, -1234567.0, 1234.5, 2.5, 0.0125, 0.005, 0.0001234, 1.5e9, 10.00001]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").orderBy("i")
    got = [r[0] for r in rows.select(display.number_label(F.col("x"))).collect()]
    assert got == ["N/A", "N/A", "0", "5", "-1,234,567", "1,234.5", "2.5", "0.0125", "0.005", "1.234e-4", "1.50e+9", "10"]
    sizes = [None, -1, 0, 1, 1023, 1024, 1536, 1048576, 5 * 2**40, 100 * 1024]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(sizes)], "i int, x bigint").orderBy("i")
    got = rows.select(display.bytes_label(F.col("x")), display.bytes_label(F.col("x"), 0), display.memory_label(F.col("x"))).collect()
    assert [r[0] for r in got] == ["サイズ不明", "サイズ不明", "0 Bytes", "1 Bytes", "1023 Bytes", "1 KB", "1.5 KB", "1 MB", "5 TB", "100 KB"]
    assert got[9][1] == "100 KB" and got[8][2] == "5120.00 GB" and got[7][2] == "1.00 MB" and got[0][2] is None


def test_analysis_by_kind(spark):
    from sparkloom.operators import analysis

    rows = [(i, float(i % 7), float(i * i % 11), "a" if i % 3 else "b", f"word {i}. next one") for i in range(60)]
    df = spark.createDataFrame(rows, "i long, x double, y double, c string, t string")
    only = [Filter("i", "less_than", 50)]
    for kind, columns in {"column": ["x", "c"], "basic": ["x"], "correlation": ["x", "y"], "changepoint": ["x"], "factor": ["x", "y"], "histogram": ["x"], "timeseries": ["x"], "missing": ["x", "c"], "text": ["t"], "association": ["x", "c"], "mutual": ["x", "c"], "canonical": ["x", "y"]}.items():
        found = analysis.analyse(df, kind, columns, only, order_by=["i"])
        assert found and all(f.columns for f in found.values())
    basic = analysis.analyse(df, "basic", ["x"], only, order_by=["i"])["statistics"].first()
    assert basic["count"] == 50
    for kind, columns in (("basic", []), ("histogram", ["x", "y"]), ("none", ["x"]), ("missing", ["x"]), ("basic", ["b"])):
        with pytest.raises(ValueError):
            analysis.analyse(df.withColumn("b", F.lit(True)), kind, columns)


def test_quantiles_beyond_few_values(spark):
    import numpy as np

    from sparkloom.operators import stats

    n = 150_001
    x = np.random.default_rng(1).gamma(2, 10, n).round(2)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0), ("b", None)], "g string, x double")
    want = np.sort(x)
    got = {r.g: r for r in stats.index_quantiles("x", ["g"], df, {"q1": 0.25, "q3": 0.75, "all": 1.0}).collect()}
    assert (got["a"].q1, got["a"].q3, got["a"]["all"]) == (want[int(n * 0.25)], want[int(n * 0.75)], want[-1]) and got["b"].q1 == 1.0
    got = {r.g: r for r in stats.interpolated_quantiles("x", ["g"], df, {"q": 0.37}).collect()}
    assert abs(got["a"].q - np.quantile(x, 0.37)) < 1e-9 and got["b"].q == 1.0


def test_itemsets_against_all_subsets(spark):
    rng = random.Random(9)
    columns = [f"c{i}" for i in range(6)] + ["n", "b"]
    rows = [(*(rng.choice(["x", "y", "z", "", None]) for _ in range(6)), rng.choice([None, -1.0, 0.0, 5.0, 5000.0]), rng.choice([True, False, None])) for _ in range(300)] + [(None,) * 8]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns[:6]) + ", n double, b boolean")
    band = {-1.0: "negative", 0.0: "zero", 5.0: "low", 5000.0: "very_high"}
    baskets = []
    for r in rows:
        own = [f"{c}={v}" for c, v in zip(columns[:6], r, strict=False) if v] + ([f"n={band[r[6]]}"] if r[6] is not None else []) + (["b=true"] if r[7] else [])
        baskets += [frozenset(own)] if own else []
    for support, size in ((0.05, 3), (0.02, 4), (0.3, 2), (0.9, 3), (0.0, 1)):
        least = max(1, math.ceil(support * len(baskets)))
        want = {}
        for k in range(1, size + 1):
            for s in {s for b in baskets for s in combinations(sorted(b), k)}:
                n = sum(set(s) <= b for b in baskets)
                if n >= least:
                    want[s] = n
        got = {tuple(r["items"]): r["count"] for r in mining.frequent_itemsets(df, columns, min_support=support, max_size=size).collect()}
        assert got == want
    assert mining.frequent_itemsets(df.limit(0), columns).count() == 0
    rules = mining.association_rules(mining.frequent_itemsets(df, columns, min_support=0.02), 0.1).collect()
    assert rules and all(math.isclose(r.support, sum(set(r.antecedent) | set(r.consequent) <= b for b in baskets) / len(baskets)) for r in rules)


def test_itemsets_of_many_columns(spark):
    """Fifty columns: sets of three come from frequent pairs, not from all 20825 subsets of columns in an expression."""
    rng = random.Random(1)
    rows = [tuple(rng.choice("ab") if i % 5 else "a" for i in range(50)) for _ in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(50)))
    start = time.perf_counter()
    got = mining.frequent_itemsets(df, df.columns, min_support=0.3).groupBy("size").count().collect()
    assert {r["size"] for r in got} == {1, 2, 3} and time.perf_counter() - start < 30


def test_candidates():
    assert mining.candidates([(1,), (2,), (4,)]) == [(1, 2), (1, 4), (2, 4)]
    assert mining.candidates([(1, 2), (1, 4), (2, 4), (2, 5)]) == [(1, 2, 4)]


def stepped(rng, n=160):
    return [rng.gauss(0, 1) + (i * 5 // n % 3) * 12 for i in range(n)]


def squares(v):
    return sum((x - sum(v) / len(v)) ** 2 for x in v)


def test_binary_segmentation_against_all_splits():
    """Every split of every stretch, the whole series' squares measuring how sure it is; down to the shortest stretches."""
    for seed in range(4):
        v = stepped(random.Random(seed))
        found, todo = {}, [(0, len(v))]
        while todo:
            a, b = todo.pop()
            splits = {k: squares(v[a:k]) + squares(v[k:b]) for k in range(a + 5, b - 5)}
            if splits:
                k = min(splits, key=splits.get)
                sure = min(1 - splits[k] / squares(v), 1)
                if sure > 0.1:
                    found[k] = sure
                    todo += [(a, k), (k, b)]
        got = dict(series.binary_segmentation(np.array(v)))
        assert got.keys() == found.keys() and len(got) > 4 and all(math.isclose(got[k], found[k], abs_tol=1e-9) for k in got)


def test_moving_average_points_against_windows():
    """Both modes: means of the windows before and after each point, and the running sum whose later window drops the wrong value."""
    for seed in range(4):
        v = stepped(random.Random(seed), 230)
        n, w = len(v), max(3, min(10, 230 // 20))
        limit = 2 * np.std(v)
        plain = {i: abs(np.mean(v[i : i + w]) - np.mean(v[i - w : i])) for i in range(w, n - w)}
        odd, later = {}, sum(v[w : 2 * w])
        for i in range(w, n - w):
            if i > w:
                later += v[min(i + w, n - 1)] - v[i + w - 1]
            odd[i] = abs(later / w - np.mean(v[i - w : i]))
        for exact, want in ((False, plain), (True, odd)):
            got = dict(series.moving_average(np.array(v), exact_reference=exact))
            assert got.keys() == {i for i, x in want.items() if x > limit} and all(math.isclose(got[i], min(want[i] / limit, 3) / 3, abs_tol=1e-9) for i in got)
        assert dict(series.moving_average(np.array(v)))


def test_rows_at_places(spark):
    """Keys of several kinds with nulls, odd numbers and many equal values; buckets that must be cut again and again."""
    rng = random.Random(6)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, 1e308, -1e308]
    words = ["", "a", "prefix", "prefixa", "prefixb", "prefixprefixz", "prefixprefixa", "é", "日本", None]
    rows = [(i, rng.choice(odd) if rng.random() < 0.2 else rng.gauss(0, 5), rng.choice(words), rng.choice([1, 1, 1, 1, 2, 2**60, 2**60 + 1])) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, x double, t string, k long").withColumn("d", F.timestamp_millis(F.col("id") % 50 * 10**9)).repartition(3)
    for keys in (["x", "id"], ["t", "x", "id"], ["k", "t", "id"], ["d", "id"], [F.col("k"), F.col("id")], [F.desc("x"), "id"]):
        want = [r.id for r in df.orderBy(*keys).select("id").collect()]
        for buckets, heavy in ((ranks.BUCKETS, ranks.HEAVY), (40, 300)):
            places = sorted(rng.sample(range(900), 12)) + [2000]
            got = {r.row_index: r.id for r in ranks.rows_at(df, keys, places, buckets=buckets, heavy=heavy).collect()}
            assert got == {p: want[p] for p in places if p < 900}
    assert ranks.rows_at(df.limit(0), ["x"], [0, 1]).count() == 0


def test_samples_write_nothing(spark, monkeypatch):
    monkeypatch.setattr(sampling, "with_row_index", None)
    df = spark.range(5000).withColumn("v", F.col("id") * 2)
    for method in ("uniform", "systematic", "stratified"):
        got = sampling.sample_rows(df, ["v"], 100, method).collect()
        assert 90 < len(got) <= 100 and all(r.row_index == r.id for r in got)


def test_most_frequent_values(spark):
    """Heavy values proven by the summary, and columns in which only a count of everything tells; against plain counts."""
    rng = random.Random(8)
    rows = []
    for i in range(6000):
        heavy = min(int(rng.paretovariate(0.9)), 5000)
        rows += [("heavy", f"v{heavy}", i), ("flat", f"u{rng.randint(0, 1500)}", i), ("few", rng.choice("abc"), i), ("unique", str(9 * i % 6000), i)]
    df = spark.createDataFrame(rows, "column_name string, value string, at long").repartition(4)
    want = {}
    for c in ("heavy", "flat", "few", "unique"):
        n, first = Counter(), {}
        for name, v, at in rows:
            if name == c:
                n[v] += 1
                first[v] = min(at, first.get(v, at))
        want |= {(c, i + 1): (v, n[v]) for i, v in enumerate(sorted(n, key=lambda v: (-n[v], first[v]))[:7])}
    for tracked, candidates in ((frequent.TRACKED, frequent.CANDIDATES), (400, 50), (20, 10)):
        got = {(r.column_name, r["rank"]): (r.value, r["count"]) for r in frequent.most_frequent(df, 7, tracked, candidates).collect()}
        assert got == want
    assert frequent.most_frequent(df.limit(0), 3).count() == 0


def test_heavy_values_need_no_full_count(spark, monkeypatch):
    monkeypatch.setattr(frequent, "ERROR", 3.5)
    df = spark.range(20000).select(F.lit("c").alias("column_name"), F.when(F.col("id") % 2 == 0, F.col("id") % 6).otherwise(F.col("id")).cast("string").alias("value"), F.col("id").alias("at"))
    plan = frequent.most_frequent(df, 3, 2000, 100)._jdf.queryExecution().toString()
    assert "Range" not in plan  # the table isn't read a third time


def test_mutual_information_against_counts(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "", "p", "q"]), rng.choice([None, 0.0, 1.0, 2.5, 9.0]), str(rng.randint(0, 30)), rng.choice(["7", "x", None]), 5) for _ in range(500)]
    df = spark.createDataFrame(rows, "a string, b double, c string, d string, e int").repartition(3)
    got = {(r.column1, r.column2): r for r in information.mutual_information(df, list("abcde")).collect()}
    number = lambda v: isinstance(v, (int, float)) or v.lstrip("-").isdigit()
    for (i, p), (j, q) in combinations(enumerate("abcde"), 2):
        both = [(r[i], r[j]) for r in rows if r[i] not in (None, "") and r[j] not in (None, "")]
        sides = []
        for own in zip(*both, strict=True):
            if all(map(number, own)):
                v = [float(x) for x in own]
                low, high = min(v), max(v)
                own = [0 if low == high else min(int((x - low) / ((high - low) / 10)), 9) for x in v]
            sides.append(own)
        h = lambda x: -sum(c / len(both) * math.log2(c / len(both)) for c in Counter(x).values())  # noqa: E731, B023
        want = (len(both), h(sides[0]), h(sides[1]), h(list(zip(*sides, strict=True))))
        assert got[p, q].n == want[0] and all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip((got[p, q].h1, got[p, q].h2, got[p, q].h12), want[1:], strict=True))
    assert information.mutual_information(df.limit(2), list("ab")).count() == 0


def test_mutual_information_of_many_columns(spark):
    df = spark.range(3000).select(*(F.concat(F.lit("t"), F.hash("id", F.lit(i)) % 5).alias(f"c{i}") for i in range(40)))
    start = time.perf_counter()
    assert information.mutual_information(df, df.columns).count() == 780 and time.perf_counter() - start < 40


def test_many_inserts_stay_one_scan(spark, tmp_path):
    w = Workspace(spark, f"{tmp_path}/space")
    w.create("own", spark.createDataFrame([(0, "a")], "i long, s string"))
    for i in range(1, 41):
        w.insert("own", spark.createDataFrame([(i, i / 2)], "i int, half double"))
    plan = w.table("own")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation") == 1
    assert w.table("own").agg(F.count("*"), F.sum("i"), F.sum("half"), F.count("s")).first() == (41, 820, 410.0, 1)
    w.compact("own")
    w.create("view", spark.range(3).toDF("k"))
    w.save_manifest()
    again = Workspace.reopen(f"{tmp_path}/space", spark)
    assert again.table("own").count() == 41 and again.current == "view" and again.meta["view", "default"]["loaded"] is False
    again.insert("own", "SELECT CAST(:i AS BIGINT) AS i", i=99)
    assert again.table("own").where("i = 99").count() == 1
    again.drop("own")
    with pytest.raises(FileNotFoundError):
        Workspace.reopen(f"{tmp_path}/nowhere", spark)


def test_durable_monitor_repeats_a_batch(spark, tmp_path):
    """A batch that fails after its counts were written is run again, and told once."""
    folder, schema = f"{tmp_path}/m", spark.range(1).schema
    spark.range(5).write.parquet(f"{tmp_path}/in")
    watch = monitor.DurableMonitor(spark, folder)
    watch.catch_up({"t": (f"{tmp_path}/in", schema)})
    spark.range(7).write.mode("append").parquet(f"{tmp_path}/in")
    watch.catch_up({"t": (f"{tmp_path}/in", schema)})
    for commit in (tmp_path / "m" / "checkpoint" / "commits").glob("*1*"):  # as if the driver had died before the commit
        commit.unlink()
    monitor.DurableMonitor(spark, folder).catch_up({"t": (f"{tmp_path}/in", schema)})
    got = [(r.batch, r["count"], r.total) for r in watch.notifications().orderBy("batch").collect()]
    assert got == [(0, 5, 5), (1, 7, 12)]
    assert watch.notifications(1).first().batch == 1


def test_monitor_reports_errors(spark):
    m = monitor.Monitor(spark)
    answers = [1, 2, ValueError("gone"), 3]
    m.subscribe("t", lambda: (_ for _ in ()).throw(a) if isinstance(a := answers.pop(0), Exception) else a)
    m.on_change("t", lambda t: 1 / 0)
    m.check()
    assert "division" in m.subscriptions["t"].error
    m.check()
    assert "gone" in m.subscriptions["t"].error and m.subscriptions["t"].rows == 2


def test_database_ranges_of_sparse_ids(tmp_path):
    from sparkloom.sources import databases

    path = str(tmp_path / "sparse.sqlite")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t (v TEXT)")
    ids = [*range(1, 101), *range(10**12, 10**12 + 100)]
    con.executemany("INSERT INTO t (rowid, v) VALUES (?, 'x')", [(i,) for i in ids])
    con.commit()
    con.close()
    reader = databases.DatabaseReader({"path": path, "dbtable": "t", "numpartitions": "4"}, ["string"])
    parts = reader.partitions()
    assert [len(list(reader.read(p))) for p in parts] == [50] * 4


def test_small_rules(spark):
    from pyspark.sql import types as T

    assert encoding.corruption("clean") == 0 and math.isclose(encoding.corruption("a\ufffd\x01¿"), (1 + 0.5 + 0.3) / 4)
    assert encoding.has_japanese("x日") and encoding.has_japanese("カ") and not encoding.has_japanese("plain é")
    assert len(encoding.supported()) == 8 and encoding.describe("sjis") == "Japanese (Shift_JIS)" and encoding.describe("koi8-r") == "koi8-r"
    assert files.clean_column(' a"b;c  d ') == "a_b_c_d" and files.clean_column("  ", 3) == "column_3"
    assert files.clean_table("2024 sales") == "t_2024_sales" and len(files.clean_table("x" * 200)) == 63 and files.clean_table("") == "data"
    assert sampling.recommended(500)["method"] == "none" and sampling.recommended(50_000) == {"points": 1500, "method": "uniform"} and sampling.recommended(10**6)["method"] == "stratified"
    assert "contains" in filters.operators_for(T.StringType()) and "greater_than" in filters.operators_for(T.LongType()) and "contains" not in filters.operators_for(T.DateType())
    assert filters.coerce_value("", T.LongType()) is None and filters.coerce_value(" TRUE", T.BooleanType()) is True and filters.coerce_list("1, ,2", T.LongType()) == [1, 2]
    with pytest.raises(ValueError):
        filters.compile_filter(Filter("x", "resembles", 1))
    for kind, columns in (("correlation", ["a"]), ("histogram", ["a", "b"]), ("nothing", ["a"])):
        with pytest.raises((ValueError, KeyError)):
            profile.check_arity(kind, columns)


def test_eligible_columns(spark):
    df = spark.createDataFrame([], "i int, d double, s string, t timestamp, b boolean")
    assert profile.eligible_columns(df, "numeric") == ["i", "d"] and profile.eligible_columns(df, "date") == ["t"] and profile.eligible_columns(df, "x") == ["index", "i", "d", "t"]


def test_words_and_sentences_against_patterns(spark):
    """White space and marks of all kinds, against the patterns that say what words and sentences are."""
    rng = random.Random(12)
    parts = [*"ab.!?。！？,;()-_/\\`~「」、； \t\n", "\u00a0", "\u3000", "\ufeff", "\u2009", "\x85", "\x0b", "日", "é", "😀", "word"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    space = r"\s\ufeff"
    between = rf"[{space}.,!?;:'\"()\[\]{{}}\-_/\\@#$%^&*+=<>|~`。、！？；：「」『』（）【】]+"
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", text.tokens(F.col("t")).alias("w"), text.word_count(F.col("t")).alias("n"), text.sentence_count(F.col("t")).alias("s")).collect()
    for r in got:
        words = [w for w in re.split(between, r.t) if w]
        assert r.w == words and r.n == len(words)
        assert r.s == len([x for x in re.split("[.!?。！？]+", r.t) if x.strip(" \t\n\x0b\x0c\r\x85\u00a0\u3000\ufeff\u2009")])
