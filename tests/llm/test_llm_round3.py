"""Token packing, spelling variants and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import cost_packing, queries, repeats, spelling
from test_llm import CLASH, DIR, REPEATED, docs_of

# 11: packing of tokens

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_ids(texts):
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n a", "x \n  y\tz", "don't  stop", "日本語の テキスト です", "é  è", "  a", "a  b", "1 2  3,4 .5", "<|endoftext|>", "a <|endoftext|> b", "w" * 5000, "tab\t \tx", "a\r\n b",
    "  a  ", "a \x1c b", "\x85 x", " " * 300 + "end", "'s 't we'll it 's", "emoji 😀 😀😀", "x" * 60 + " " + "y" * 60, "٣ 四 5", "a​ b",
]


def test_encoder_against_whole_texts():
    rng = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "\t", "É", "ß", "日本", "don't", "1", "23", "!", "...", " ", "😀", "<|endoftext|>", "\x0b", " "]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    encoder = cost_packing.Encoder(PATH)
    assert encoder.ranked is not None
    for _ in range(2):  # by ranks, then by tokenizers alone
        assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)] == [x[:-1] for x in plain_ids(texts)]
        encoder.ranked = None
    assert cost_packing.byte_ranks(public_tokenizers.path("word_bpe_49k.json")) is None
    other = cost_packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert len(np.frombuffer(other.encode(["Hello there"])[0], other.kind)) == 2


def check_pieces(rows, texts, capacity=2048):
    """rows: (doc_id, start, length, crc, doc_tokens, sequence_id, offset); ids of documents must be different."""
    ids = dict(zip(texts, plain_ids(texts.values()), strict=True))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, n, sequence, offset in rows:
        own = ids[doc]
        assert n == len(own) and length > 0 and zlib.crc32(np.array(own[start : start + length], "<u4").tobytes()) == crc
        by_doc[doc].append((start, length))
        by_sequence[sequence].append((offset, length))
    for pieces, full in [(p, len(ids[d])) for d, p in by_doc.items()] + [(p, None) for p in by_sequence.values()]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == full if full is not None else at <= capacity and at & (at - 1) == 0  # no padding at all
    assert by_doc.keys() == ids.keys()


def test_pack_tokens(spark):
    texts = dict(enumerate([*ODD, None, "word " * 9000, "one two three " * 1365, *(r[1] for r in REPEATED)]))
    df = docs_of(spark, [(i, t) for i, t in texts.items()]).withColumns({"ids": F.lit(1), "length": F.lit(2), "shard": F.lit(3), "start": F.lit(4)})
    for shard in (4096, 7):
        rows = cost_packing.pack_tokens(df, PATH, shard=shard).select("doc_id", "start", "length", F.crc32("ids"), "doc_tokens", "sequence_id", "offset").collect()
        check_pieces(map(tuple, rows), texts)
    got = cost_packing.pack_tokens(spark.createDataFrame([(None, None), (None, None), (5, "a")], "doc_id long, text string"), PATH).collect()
    assert sorted((r.doc_id is None, r.start, r.length, r.doc_tokens) for r in got) == [(False, 0, 2, 2), (True, 0, 1, 1), (True, 0, 1, 1)]
    assert cost_packing.pack_tokens(df.limit(0), PATH).count() == 0


def test_balanced_against_plain_rule():
    """The rule in plain words: longest first; lowest cost that fits whole, else lowest cost with any room."""
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.randint(1, 63) for _ in range(rng.randint(0, 40))]
        total = sum(sizes)
        room = [64] * (total // 64) + [1 << b for b in range(6, -1, -1) if total % 64 >> b & 1]
        size, spent, queue, want = list(room), [0.0] * len(room), [(n, i, 0) for i, n in enumerate(sizes)], []
        while queue:
            queue.sort(key=lambda x: -x[0])
            longest = [x for x in queue if x[0] == queue[0][0]]
            n, i, start = min((x for x in longest if x[2]), key=lambda x: x[1], default=longest[0])
            queue.remove((n, i, start))
            fits = [b for b in range(len(room)) if room[b] >= n] or [b for b in range(len(room)) if room[b]]
            b = min(fits, key=lambda b: spent[b])
            take = min(n, room[b])
            want.append((i, start, take, b, size[b] - room[b]))
            room[b] -= take
            spent[b] += take + take * take / (6 * 100)
            if take < n:
                queue.append((n - take, i, start + take))
        got = cost_packing.balanced(np.array(sizes, np.int64), 64, 100)
        assert got == want and not any(room)


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 400, 4000)
    got = cost_packing.balanced(sizes, 2048, 16)  # attention weighs much
    spent = Counter()
    for _, _, n, b, _ in got:
        spent[b] += cost_packing.cost(n, 16)
    first = list(range(0, len(sizes)))  # as they come, cut where a sequence ends
    flat = np.concatenate([np.full(sizes[i], i) for i in first])
    plain = [sum(cost_packing.cost(int(n), 16) for n in np.unique(flat[a : a + 2048], return_counts=True)[1]) for a in range(0, len(flat) - 2047, 2048)]
    full = [v for b, v in spent.items() if b < len(flat) // 2048]
    assert np.std(full) < np.std(plain) / 2


def test_op11_query(spark):
    rows = queries.op11_cost_packing(spark, DIR).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    check_pieces(map(tuple, rows), texts)


# 12: spelling variants


def brute_words(rows, noise):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    """By cases: a letter replaced, or one more."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    near = {w: [] for w in words}
    by_size = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    for w in words:
        near[w] = [v for k in (len(w) - 1, len(w), len(w) + 1) for v in by_size[k] if v != w and one_apart(v, w)]
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), None if form[w] is None else words[form[w]]) for w, n in words.items()}


def as_rows(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_signatures_meet():
    rng = random.Random(6)
    for _ in range(4000):
        w = "".join(rng.choice("aabcdeé") for _ in range(rng.randint(5, 9)))
        at, c = rng.randrange(len(w)), rng.choice("aabcdefé")
        same = spelling.parts_by_weight([("a", 0, 9), ("b", 0, 4), ("a", 1, 3)], spelling.PARTS)
        longer = spelling.parts_by_weight([("a", 0, 9), ("c", 0, 4)], spelling.PARTS_LONGER)
        assert any(x == y for x, y in zip(spelling.signatures(w, same, spelling.PARTS, 2), spelling.signatures(w[:at] + c + w[at + 1 :], same, spelling.PARTS, 2), strict=True))
        assert any(x == y for x, y in zip(spelling.signatures(w, longer, spelling.PARTS_LONGER, 1), spelling.signatures(w[:at] + c + w[at:], longer, spelling.PARTS_LONGER, 1), strict=True))


def test_variants_against_brute_force(spark):
    rng = random.Random(8)
    words = {}
    for _ in range(400):
        words["".join(rng.choice("abÀé") for _ in range(rng.randint(4, 6)))] = rng.choice([3, 3, 4, 6, 8, 12, 24, 48, 100])
    words |= {"": 5, "x": 2, "x" * 3000: 4, "x" * 3001: 9, "𝒳bcde": 3, "xbcde": 9}
    df = spark.createDataFrame([*words.items(), (None, 7)], "word string, n long").withColumns({"form": F.lit("q"), "sig": F.lit(1)})
    assert as_rows(spelling.variants(df)) == sorted(brute_variants(words), key=str)
    assert spelling.variants(df.limit(0)).count() == 0


def test_spelling_of_documents(spark):
    rng = random.Random(5)
    vocabulary = ["spelling", "speling", "Colour", "colour", "color", "co×our", "straße", "strasse", "ÉCOLE", "école", "écoles", "ab", "日本", "x" * 40]
    rows = [(i if i % 7 else None, " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "1", "日"]) for _ in range(rng.randint(0, 80)))) for i in range(300)]
    rows += [(1, None), (2, ""), (3, "y" * 200_000), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASH.items()}).withColumns({"word": F.lit(1), "n": F.lit(2), "name": F.lit(3)})
    for noise in (None, spelling.NOISE, 3):
        assert as_rows(spelling.spelling_variants(df, noise=noise)) == sorted(brute_variants(brute_words(rows, noise)), key=str)
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_op12_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert as_rows(queries.op12_spelling(spark, DIR)) == sorted(brute_variants(brute_words(rows, 97)), key=str)


# 13: periodic runs


def brute_runs(x, least=12):
    n, out = len(x), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            size = i - start + q
            if i > start and size >= max(least, 2 * q) and all(any(x[k] != x[k + p] for k in range(start, start + size - p)) for p in range(1, q)):
                out.append((start, size, q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        k, n = rng.choice([1, 2, 3, 5]), rng.randint(0, 60)
        x = [rng.randint(1, k) for _ in range(n)]
        if rng.random() < 0.4 and n > 4:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 2))
            x = x[:a] + [x[a + i % p] for i in range(n - a)]
        for least in (2, 5, 12):
            assert [tuple(r) for r in repeats.runs(np.array(x, np.int64), least).tolist()] == brute_runs(x, least)


def test_suffix_tree_extensions():
    rng = random.Random(9)
    for n in (1, 2, 17, 120):
        x = [rng.randint(1, 2) for _ in range(n)]
        tree = repeats.SuffixTree(x)
        assert np.argsort(tree.rank).tolist() == sorted(range(n + 1), key=lambda i: x[i:])
        assert np.argsort(tree.other_rank).tolist() == sorted(range(n + 1), key=lambda i: [-c for c in x[i:]])
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j]
        if pairs:
            i, j = map(np.array, zip(*pairs, strict=True))
            want = [next((k for k in range(n) if max(a, b) + k >= n or x[a + k] != x[b + k]), n) for a, b in pairs]
            assert tree.common(i, j).tolist() == want


def brute_document(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc is None else str(doc)).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") + rng.choice("de") for _ in range(rng.randint(0, 90)))) for i in range(150)]
    rows += [(None, "a b " * 30), (None, None), (150, ""), (151, " \t\n"), (152, "x\x0by\x0cz  " * 12), rows[3], rows[3], *((r[0], r[1]) for r in REPEATED if len(r[1] or "") < 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASH.items()}).withColumns({"start": F.lit(1), "n_runs": F.lit(2), "name": F.lit(3)})
    assert sorted(map(tuple, repeats.periodic_runs(df, planted=True).collect()), key=str) == sorted((brute_document(*r) for r in rows), key=str)
    assert repeats.periodic_runs(df.limit(0)).count() == 0


def test_periodic_runs_with_text(spark):
    df = spark.createDataFrame([(1, "now " + "ho ho ha " * 5 + "end"), (2, "é " * 30000)], "doc_id long, text string")
    one, two = repeats.periodic_runs(df, with_text=True).orderBy("doc_id").collect()
    assert one.runs == [(1, 15, 3)] and one.collapsed == "now ho ho ha end" and one.exponent_milli == 5000
    assert two.runs == [(0, 30000, 1)] and two.collapsed == "é"


def test_op13_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r) for r in queries.op13_repeats(spark, DIR).collect()}
    assert len(got) == len(rows)
    assert all(got[r[0]] == brute_document(*r) for r in rows if len((r[1] or "").split()) < 1500)
