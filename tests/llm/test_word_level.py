"""Operators 11 to 13 against the library, brute force and round trips, and their defined cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from convhist.llm import encoders, op11_byte_bpe, op12_squares, op13_fim  # noqa: E402

RANKS = str(P.path("byte_bpe_50k.tiktoken"))
SCHEMA = "doc_id long, text string, word string, chunk string, number int, key string, form string"
LONG = "the quick brown fox " * 4000 + "x" * 30_000
CASES = [
    (1, "it's  a\t\ttest\n\n  of it's 123 words… ünïcödé 漢字かな\r\n", "w", "c", 1, "k", "f"),
    (2, None, None, None, None, None, None),
    (3, "", "w", "c", 1, "k", "f"),
    (4, "a b a b a b a b a b", "w", "c", 1, "k", "f"),
    (4, "a b a b a b a b a b", "w", "c", 1, "k", "f"),
    (None, "no id at all", "w", "c", 1, "k", "f"),
    (None, None, None, None, None, None, None),
    (7, " \t\n", "w", "c", 1, "k", "f"),
    (8, LONG, "w", "c", 1, "k", "f"),
    (9, "holds <S> itself", "w", "c", 1, "k", "f"),
    (10, "newer letters: ࢏ ꟎ \U00031350 end \U00011de1՘ <|endoftext|>", "w", "c", 1, "k", "f"),
]


def sha(value: bytes) -> str:
    return hashlib.sha256(value).hexdigest()


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(CASES, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- 11

@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {t: i for i, t in enumerate(op11_byte_bpe.token_bytes(RANKS)) if t}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected_bpe(library, docs):
    out = []
    for doc_id, text in docs:
        ids = library.encode_ordinary(text or "")
        out.append((doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha(library.decode_bytes(ids))))
    return sorted(out, key=repr)


def test_op11_matches_the_library(spark, sf_dir, texts, library):
    assert rows_of(op11_byte_bpe.op11_word_shuffle_bpe(spark, sf_dir)) == expected_bpe(library, texts)


@pytest.mark.parametrize("chunk_bytes", [1, 40, 1 << 20])
def test_op11_cases_and_chunks(cases, library, chunk_bytes):
    got = op11_byte_bpe.digests(cases, RANKS, P.PATTERN, chunk_bytes=chunk_bytes)
    assert rows_of(got) == expected_bpe(library, [(c[0], c[1]) for c in CASES])


def test_op11_encode_decode(cases, library, spark):
    coded = op11_byte_bpe.encode(cases, RANKS, P.PATTERN, chunk_bytes=100)
    rows = coded.collect()
    assert sorted((list(r.ids), bytes(r.decoded)) for r in rows) == sorted((library.encode_ordinary(c[1] or ""), (c[1] or "").encode()) for c in CASES)
    decoded = op11_byte_bpe.decode(coded, RANKS).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in decoded) == sorted((c[0] or 0, (c[1] or "").encode()) for c in CASES)
    empty = spark.createDataFrame([], SCHEMA)
    assert op11_byte_bpe.digests(empty, RANKS, P.PATTERN).collect() == []
    assert [tuple(r) for r in op11_byte_bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), RANKS).collect()] == [(1, b"")]


def test_op11_positions_pack():
    numbers = np.array([0, 1, 70_000, 3, 2**31])
    assert op11_byte_bpe.unpacked(op11_byte_bpe.packed(numbers)).tolist() == numbers.tolist()
    assert op11_byte_bpe.unpacked(op11_byte_bpe.packed(numbers[:0])).tolist() == []


# ---- 12

def brute_runs(words, exponent=4, least=6):
    """All runs by trying every period; the smallest period of equal stretches."""
    n, best = len(words), {}
    for q in range(1, n // exponent + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - (i - q) >= max(least, exponent * q):
                best.setdefault((i - q, j), q)
            i = j
    return sorted((s, e, q) for (s, e), q in best.items())


def expected_summary(doc_id, words):
    runs = brute_runs(words)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    top = (None,) * 4
    if runs:
        s, e, q = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]))
        top = s, e - s, q, 1000 * (e - s) // q
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *top, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()), sha(kept.encode()))


def echo_words(doc_id, words):
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_op12_matches_brute_force(spark, sf_dir, texts):
    short = [(i, t) for i, t in texts if len(t) < 20_000]
    got = {r.doc_id: tuple(r) for r in op12_squares.op12_word_runs(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    some = 0
    for doc_id, text in short:
        want = expected_summary(doc_id, echo_words(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text)))
        assert got[doc_id] == want
        some += want[1] > 0
    assert some > 5


def test_op12_cases(spark, cases):
    got = rows_of(op12_squares.summaries(cases))
    want = [expected_summary(c[0], re.findall(r"[^\x20\x09-\x0D]+", c[1] or "")) for c in CASES if c[1] != LONG]
    assert [r for r in got if r[0] != 8] == sorted(want, key=repr)
    long = next(r for r in got if r[0] == 8)
    assert long[1:6] == (1, 0, 16_000, 4, 4_000_000)
    assert rows_of(op12_squares.runs(cases.filter("doc_id = 4"))) == [(4, 0, 10, 2, 5000)] * 2
    assert rows_of(op12_squares.collapse(cases.filter("doc_id in (2, 4)"))) == [(2, 0, "")] + [(4, 1, "a b")] * 2
    empty = spark.createDataFrame([], SCHEMA)
    assert op12_squares.summaries(empty).collect() == [] and op12_squares.runs(empty).collect() == []


def random_stream(rng):
    words = []
    while len(words) < rng.randrange(1, 260):
        unit = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(1, 24))]
        words += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit) + 1)]
    return words


@pytest.mark.parametrize("seed", range(40))
def test_op12_any_way_of_appending(seed):
    rng = random.Random(seed)
    words = random_stream(rng)
    for exponent, least in ((2, 2), (4, 6)):
        want = [list(r) for r in brute_runs(words, exponent, least)]
        for step in (len(words), 1, 7, None):
            catcher, at = op12_squares.SquareCatcher(len(words) // exponent), 0
            while at < len(words):
                size = step or rng.randrange(1, 40)
                squares = catcher.append(np.array(words[at : at + size], dtype=np.int64))
                at += size
                assert all(e - s >= 2 * p for s, e, p in squares.tolist())
            assert sorted(catcher.runs(exponent, least).tolist()) == want, (seed, step)


def test_op12_documents_do_not_meet():
    docs = [[1, 1, 1], [1, 1, 1], [], [2, 3] * 4, [2, 3] * 4]
    assert [r.tolist() for r in op12_squares.word_runs(docs, 4, 6)] == [[], [], [], [[0, 8, 2]], [[0, 8, 2]]]
    assert op12_squares.word_runs([], 4, 6) == []


def test_op12_wrong_fingerprints_do_no_harm(monkeypatch):
    words = random_stream(random.Random(3)) + list(range(100, 160))
    monkeypatch.setattr(op12_squares.SquareCatcher, "_hash", lambda self, start, size: np.zeros(len(start), dtype=np.uint64))
    catcher = op12_squares.SquareCatcher(len(words) // 4)
    catcher.append(np.array(words))
    got = {tuple(r) for r in catcher.runs(4, 6).tolist()}
    assert got <= set(brute_runs(words))


# ---- 13

def expected_fim(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}".encode())
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    parts = ["".join(u) for u in (units[:a], units[a:b], units[b:])]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, sha(text.encode()), sha(text.encode())
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}" if form == "psm" else f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return doc_id, len(units), form, len(parts[0]), len(parts[1]), sha(out.encode()), sha(text.encode())


def test_op13_matches_brute_force(spark, sf_dir, texts):
    want = [expected_fim(*d) for d in texts]
    assert rows_of(op13_fim.op13_skiplist_fim(spark, sf_dir)) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_op13_cases(spark, cases):
    rows = op13_fim.transform(cases).withColumn("back", op13_fim.restored(F.col("output"), F.col("form"))).collect()
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, sha(r.output.encode()), sha(r.back.encode())) for r in rows]
    assert sorted(got, key=repr) == sorted((expected_fim(c[0], c[1] or "") for c in CASES), key=repr)
    assert op13_fim.transform(spark.createDataFrame([], SCHEMA)).collect() == []


def test_op13_parts_ending_in_half_markers(spark):
    texts = ["<" * 50, "<S" * 40, "S>P>M>" * 20, "<M<P<S>" [:6] * 30, "é<S漢<M" * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 8)], "doc_id long, text string")
    rows = op13_fim.transform(df, plain_percent=0).withColumn("back", op13_fim.restored(F.col("output"), F.col("form"))).collect()
    assert {r.form for r in rows} == {"psm", "spm"}
    assert all(r.back == (texts * 8)[r.doc_id] for r in rows)


@pytest.mark.parametrize("markers", [("<<", "<S>", "<M>"), ("ab", "bc", "x"), ("", "b", "c")])
def test_op13_markers_that_overlap_raise(markers):
    with pytest.raises(ValueError):
        op13_fim.check_markers(markers)


@pytest.mark.parametrize("seed", range(10))
def test_op13_skip_list_reaches_every_rank(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab é漢-") for _ in range(rng.choice([0, 1, 5, 300, 2000]))) for _ in range(6)]
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    starts = op13_fim.unit_starts(flat, bounds[:-1])
    firsts = np.searchsorted(starts, bounds)
    lists = op13_fim.SkipLists(starts, len(flat), firsts)
    units = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    assert np.diff(firsts).tolist() == [len(u) for u in units]
    for _ in range(30):
        ranks = [rng.randrange(len(u) + 1) for u in units]
        assert lists.find(np.array(ranks)).tolist() == [len("".join(u[:r])) for u, r in zip(units, ranks, strict=True)]


# ---- words that a worker keeps

def test_forgetting_words_changes_nothing(monkeypatch):
    from convhist.llm import encoders

    monkeypatch.setattr(encoders, "WORDS", 60)
    texts = [" ".join(f"w{i % 7} common x{i}" for i in range(k, k + 30)) for k in range(0, 900, 30)]
    for kind, name in ((encoders.SpacedWords, "byte_bpe_50k.json"), (encoders.BareWords, "word_bpe_49k.json")):
        path = encoders.vocabulary(name)
        coder, library = kind(path, "<u4"), encoders.library(path)
        for a in range(0, len(texts), 3):
            got = coder.batch(texts[a : a + 3])
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts[a : a + 3]]
            assert len(coder.table.known) <= 60 + 100


def test_byte_level_words_join_only_where_they_may():
    """New words are encoded in one call: white space of every kind, marks, letters beyond the plain ones, empty texts."""
    kinds = ["a", "I'll", "word", "<|", "<", "|b", "<|endoftext|>", "ȿ", "ɀ", "ɏ", "ɐ", "é", "日本", "😀", "12", "...", "\x00"]
    blanks = ["", " ", "  ", "\n", "\n\n ", "\t", "\x0b", "\x0c", "\r\n", "\x1c", "\x85", "\xa0", "　"]
    rng = random.Random(5)
    texts = ["", " ", "\n\n", "x", " x", "x ", "\x0bx\x0c"]
    texts += ["".join(rng.choice(blanks[: rng.choice((9, 13))]) + rng.choice(kinds) for _ in range(rng.randint(0, 12))) + rng.choice(blanks) for _ in range(600)]
    path = encoders.vocabulary("byte_bpe_50k.json")
    words, plain = encoders.SpacedWords(path, "<u4"), encoders.library(path)
    for a in range(0, len(texts), 50):
        ids, sizes = words.encode([t.encode() for t in texts[a : a + 50]])
        wanted = [plain.encode(t, add_special_tokens=False).ids for t in texts[a : a + 50]]
        assert sizes.tolist() == [len(w) for w in wanted]
        assert ids.tolist() == [i for w in wanted for i in w]
