"""The registered queries against brute force on whole small tables, and the defined cases of each operator."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from convhist.llm import (  # noqa: E402
    common,
    near_text,
    op1_adaptive,
    op2_bpe,
    op3_quotes,
    op4_suffix,
    op5_packing,
    op6_phrases,
    op7_arrow_tokens,
    op8_urls,
    op9_lines,
    op10_simhash,
)
from convhist.llm.encoders import BareWords, SpacedWords, vocabulary  # noqa: E402
from convhist.session import scratch_path  # noqa: E402

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
SCHEMA = "doc_id long, text string, key string, spans int, ids string, kept string, n_chars long"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve " * 12
CASES = [
    (1, PASSAGE + "alpha", "k", 1, "i", "x", 1),
    (2, None, None, None, None, None, None),
    (3, "", "k", 1, "i", "x", 0),
    (4, "beta\n" + PASSAGE, "k", 1, "i", "x", 2),
    (4, "beta\n" + PASSAGE, "k", 1, "i", "x", 2),
    (None, PASSAGE, "k", 1, "i", "x", 3),
    (None, None, None, None, None, None, None),
    (7, " \t\n", "k", 1, "i", "x", 4),
    (8, "ä" * 500 + " €uro " + "w " * 3000, "k", 1, "i", "x", 5),
]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(CASES, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def sha(value: bytes) -> str:
    return hashlib.sha256(value).hexdigest()


@functools.cache
def library(name: str) -> Tokenizer:
    return Tokenizer.from_file(vocabulary(name))


def ids_of(name: str, text: str) -> list[int]:
    return library(name).encode(text, add_special_tokens=False).ids


# ---- 1

def test_op1_recall_and_scores(spark, sf_dir):
    rows = op1_adaptive.op1_adaptive_search(spark, sf_dir).collect()
    vectors = {r.vec_id: np.array(r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    want = op1_adaptive.brute_force(vectors, [i for i in vectors if i % 20 == 0], 20)
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(dict(want[q]).get(i, s) == s for i, s in found)


def test_op1_many_lists_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(op1_adaptive, "LIST_BLOCK", 64)
    monkeypatch.setattr(op1_adaptive, "QUERY_CHUNK", 8)
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((12, 16)) * 4
    vectors = {i: centers[i % 12] + rng.standard_normal(16) * (1 + i % 3) for i in range(3000)}
    for i in range(0, 900, 3):
        vectors[i] = vectors[0]  # a large group of copies
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    rows = op1_adaptive.search(df, F.col("vec_id") % 100 == 0, k=10, probe_share=0.5).collect()
    want = op1_adaptive.brute_force(vectors, [i for i in vectors if i % 100 == 0], 10)
    got = defaultdict(set)
    for r in rows:
        got[r.query_id].add((r.vec_id, r.score))
    assert sum(len(got[q] & set(w)) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))
    assert len(got[0] & set(want[0])) == 10  # ties of copies go to the smaller ids


def test_op1_defined_cases(spark):
    bad = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0])]
    good = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0])]
    df = spark.createDataFrame(bad + good, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    rows = sorted(tuple(r) for r in op1_adaptive.search(df, F.col("vec_id") % 20 == 0).collect())
    assert rows == [(0, 1, 7, 1.0), (0, 2, 8, 1.0), (0, 3, 20, 0.0), (20, 1, 7, 1.0), (20, 2, 8, 1.0), (20, 3, 0, 0.0)]
    assert op1_adaptive.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_op1_mixed_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (20, [1.0, 2.0, 3.0]), (5, [1.0, 1.0, 1.0]), (40, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in op1_adaptive.search(df, F.col("vec_id") % 20 == 0).collect()) == [(0, 1, 1, 1.0), (0, 2, 2, 0.0), (20, 1, 5, 6.0)]


# ---- 2, 5, 7

ODD = ["", " two  spaces\n\nx ", "<|endoftext|> a<|startoftext|>b it's İSTANBUL ΣΑΣ ﬁ é ́x", "tab\tand\x1cfs\x85nel nbsp 　wide", "12345 ½ ١٢ !!! ''s 'll", "日本語 🎉🎉 👩‍👩‍👧", "a\r\nb\n", " x<|endoftext|>y <|endoftext|>", "ab" * 3000, "a <|endoftext|>  b"]


def test_encoders_agree_with_the_library_on_odd_texts():
    for kind, name in ((SpacedWords, BYTE), (BareWords, WORD)):
        got = [np.frombuffer(b, "<u4").tolist() for b in kind(vocabulary(name), "<u4").batch(ODD)]
        assert got == [ids_of(name, t) for t in ODD]
    for text, (ids, decoded, n) in zip(ODD, op2_bpe.Codec(vocabulary(WORD)).batch(ODD), strict=True):
        want = ids_of(WORD, text)
        assert (ids, decoded, n) == (" ".join(map(str, want)), library(WORD).decode(want, skip_special_tokens=False), len(want))


def test_op2_is_the_librarys_round_trip(spark, sf_dir, texts):
    for r in op2_bpe.op2_bpe_roundtrip(spark, sf_dir).collect():
        ids = library(WORD).encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha(" ".join(map(str, ids)).encode())
        assert r.decoded_sha256 == sha(library(WORD).decode(ids, skip_special_tokens=False).encode())


def test_op2_defined_cases(cases, none):
    rows = op2_bpe.encode(cases, vocabulary(WORD)).collect()
    assert sorted(len(r.ids) for r in rows) == sorted(len(ids_of(WORD, c[1] or "")) for c in CASES)
    assert op2_bpe.digests(none, vocabulary(WORD)).collect() == []


def check_pieces(rows, texts: dict, capacity: int = 1024) -> None:
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for doc_id, own in pieces.items():
        ids, at = [*ids_of(BYTE, texts[doc_id]), 0], 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    padding = total = 0
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding <= 0.01 * total


def test_op5_packs_every_id_once(spark, sf_dir, texts):
    check_pieces(op5_packing.op5_harmonic_packing(spark, sf_dir).collect(), texts)


def test_op5_defined_cases(spark, cases, none):
    pieces = op5_packing.pack(cases, vocabulary(BYTE))
    whole = op5_packing.sequences(pieces).collect()
    assert sum(r.tokens for r in whole) == sum(len(ids_of(BYTE, c[1] or "")) + 1 for c in CASES)
    assert all(len(r.ids) == 4 * r.tokens for r in whole)
    assert op5_packing.pack(none, vocabulary(BYTE)).collect() == []


@pytest.mark.parametrize("capacity", [1, 7, 64])
@pytest.mark.parametrize("sizes", ["mixed", "long", "short"])
def test_op5_bins_hold_a_fixed_number_of_whole_documents(capacity, sizes):
    most = {"mixed": 6 * capacity, "long": 9 * capacity, "short": max(1, capacity // 3)}[sizes]
    least = 2 * capacity + 1 if sizes == "long" else 1
    bins, rows = op5_packing.Bins(capacity, 0), []
    totals = random.Random(3).choices(range(least, most + 1), k=300)
    for i, n in enumerate(totals):
        rows += bins.add(i, b"".join(x.to_bytes(4, "little") for x in range(n)), n)
        assert bins.loose_size < 2 * capacity
    rest = bins.finish()
    parts = defaultdict(list)
    for r in rows:
        parts[r[5]].append(r)
    for own in parts.values():
        assert sum(r[2] for r in own) == capacity
        if sizes == "short":  # without long documents every bin starts with the documents of its class
            k = capacity // own[0][2]
            assert all(r[2] == r[4] and capacity // r[2] == k for r in own[:k])
    tokens = Counter()
    for r in rest:
        tokens[r[5]] += r[2]
    assert all(t == capacity or t & (t - 1) == 0 for t in tokens.values())
    seen = defaultdict(list)
    for doc_id, start, length, ids, total, *_ in rows + rest:
        assert total == totals[doc_id] and ids == b"".join(x.to_bytes(4, "little") for x in range(start, start + length))
        seen[doc_id].append((start, length))
    for doc_id, pieces in seen.items():
        ends = [0, *(start + length for start, length in sorted(pieces))]
        assert [start for start, _ in sorted(pieces)] == ends[:-1] and ends[-1] == totals[doc_id]
    assert len(seen) == len(totals)


def test_op5_counts_documents_by_class():
    bins, rows = op5_packing.Bins(64, 0), []
    for i, n in enumerate([20, 20, 30, 18, 30, 40, 3]):
        rows += bins.add(i, bytes(4 * n), n)
    first = [(r[0], r[2]) for r in rows if r[5] == 0]
    assert first == [(0, 20), (1, 20), (3, 18), (4, 6)]  # three of class 3, then ids cut from the next document


def test_op7_reads_back_what_it_wrote(spark, sf_dir, texts):
    got = {r.doc_id: r for r in op7_arrow_tokens.op7_arrow_tokens(spark, sf_dir).collect()}
    at = 0
    for doc_id in sorted(texts):
        ids = [*ids_of(WORD, texts[doc_id]), 2]
        assert (got[doc_id].start, got[doc_id].n_tokens) == (at, len(ids))
        assert got[doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_op7_random_access_and_cases(spark, cases, none):
    manifest = op7_arrow_tokens.write_token_files(cases, scratch_path(spark, "test-tokens"), vocabulary(WORD), seq_len=16)
    rows = op7_arrow_tokens.read_token_files(spark, manifest, seq_len=16).orderBy("start").collect()
    stream = [i for r in rows for i in np.frombuffer(r.ids, "<u4").tolist()]
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 3, 4, 4, 7, 8]
    assert len(stream) == sum(len(ids_of(WORD, c[1] or "")) + 1 for c in CASES)
    flat = []
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        tokens = op7_arrow_tokens.TokenFile(r.tokens_path, 16, "<u2")
        part = [i for k in range(-(-r.n_ids // 16)) for i in tokens.row(k).tolist()]
        assert len(part) % 16 == 0 and part[r.n_ids :] == [0] * (len(part) - r.n_ids)
        flat += part[: r.n_ids]
    assert flat == stream
    empty = op7_arrow_tokens.write_token_files(none, scratch_path(spark, "test-tokens"), vocabulary(WORD))
    assert op7_arrow_tokens.read_token_files(spark, empty).collect() == []


# ---- 4, 6

@pytest.mark.parametrize(("keep", "length", "hot"), [("none", 400, 1024), ("first", 120, 1024), ("none", 100, 1), ("first", 100, 1)])
def test_op4_removes_what_counting_removes(spark, sf_dir, texts, monkeypatch, keep, length, hot):
    monkeypatch.setattr(op4_suffix, "HOT_CLASSES", hot)
    blobs = {d: t.encode() for d, t in texts.items()}
    want = op4_suffix.brute_force(blobs, length, keep)
    for r in op4_suffix.dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), length, keep).collect():
        assert [(s.a, s.b) for s in r.spans] == want[r.doc_id]
        assert len(r.kept) == len(blobs[r.doc_id]) - r.n_removed


def test_op4_defined_cases(cases, none):
    rows = op4_suffix.dedup_substrings(cases, 100, "none").collect()
    assert len(rows) == len(CASES)
    kept = {(r.doc_id, r.n_bytes): bytes(r.kept) for r in rows}
    assert kept[1, len(PASSAGE) + 5] == b"alpha" and kept[4, len(PASSAGE) + 5] == b"beta\n"
    assert kept[None, len(PASSAGE)] == b"" and kept[3, 0] == b""
    first = {(r.doc_id, r.n_bytes): r.n_removed for r in op4_suffix.dedup_substrings(cases, 700, "first").collect()}
    assert first[1, len(PASSAGE) + 5] == 0 and first[4, len(PASSAGE) + 5] == len(PASSAGE)
    assert op4_suffix.dedup_substrings(none, 100).collect() == []
    cut = op4_suffix.without_repeats(cases, 100)
    assert cut.columns == cases.columns and op4_suffix.without_repeats(none, 100).collect() == []


def test_op4_overlaps_and_periods(spark):
    rng = random.Random(5)
    base = "".join(rng.choices("ab", k=700))
    texts = {1: "ab" * 300, 2: base, 3: base[100:400] + "x" + base[50:500], 4: "b" * 250, 5: base[300:] + base[:350]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for keep in ("none", "first"):
        want = op4_suffix.brute_force({d: t.encode() for d, t in texts.items()}, 80, keep)
        assert {r.doc_id: [(s.a, s.b) for s in r.spans] for r in op4_suffix.dedup_substrings(df, 80, keep).collect()} == want


@pytest.mark.parametrize("keep", ["none", "first"])
def test_op4_hot_hashes_hash_only_windows_of_mixed_bins(spark, monkeypatch, keep):
    rng = random.Random(11)
    fresh = lambda n: "".join(rng.choices("abcdefgh", k=n))
    base, head, tail = fresh(250), fresh(350), fresh(350)
    alone = [fresh(300) + base + fresh(300) for _ in range(40)]
    shared = [fresh(300) + base + tail + fresh(100) for _ in range(6)] + [fresh(90) + head + base + fresh(300) for _ in range(6)]
    edges = [base + tail[:200], base + tail[:170] + "x" * 40, head[-160:] + base, head + base + tail, head[-100:] + base + tail[:90] + fresh(50)]
    texts = dict(enumerate(alone + shared + edges))
    df = spark.createDataFrame([*texts.items(), (3, texts[3]), (45, texts[45])], "doc_id long, text string")
    hashed, store = [], op4_suffix.materialize
    monkeypatch.setattr(op4_suffix, "HOT_CLASSES", 4)
    monkeypatch.setattr(op4_suffix, "materialize", lambda t: hashed.append(x) or x if "rel" in (x := store(t)).columns else x)
    want = op4_suffix.brute_force({d: t.encode() for d, t in texts.items()}, 400, keep)
    assert {r.doc_id: [(s.a, s.b) for s in r.spans] for r in op4_suffix.dedup_substrings(df, 400, keep).collect()} == want
    assert any(want.values()) and len(hashed) == 1
    assert 0 < hashed[0].count() < 40 * 150  # the texts that share only `base` have more than 150 windows each


def test_op4_columns_of_spans_merge_like_lists():
    rng = random.Random(3)
    rows = [None, [], *([(a, a + rng.randrange(1, 9)) for a in rng.choices(range(60), k=rng.randrange(12))] for _ in range(200)), [(0, 70)], [(0, 3), (3, 5)], None]
    column = pa.array([None if r is None else [{"a": a, "b": b} for a, b in r] for r in rows], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
    for cut in (column, column[1:], column[150:], column[:2], column[:0]):
        bounds, starts, ends = op4_suffix.merged_column(cut)
        found = list(zip(starts.tolist(), ends.tolist(), strict=True))
        want = rows[len(rows) - len(cut) :] if len(cut) > 2 else rows[: len(cut)]
        assert [found[a:b] for a, b in zip(bounds, bounds[1:], strict=False)] == [common.merged(r or ()) for r in want]


@pytest.mark.parametrize(("window", "hot"), [(50, 1024), (12, 1024), (12, 1)])
def test_op6_removes_what_a_table_of_windows_removes(spark, sf_dir, texts, monkeypatch, window, hot):
    monkeypatch.setattr(op6_phrases, "HOT_CLASSES", hot)
    want = op6_phrases.brute_force({d: t.encode() for d, t in texts.items()}, window)
    for r in op6_phrases.dedup_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"), window).collect():
        assert [(s.a, s.b) for s in r.spans] == want[r.doc_id]


def test_op6_defined_cases(cases, none):
    kept = {(r.doc_id, r.n_words): (r.n_removed, bytes(r.kept)) for r in op6_phrases.dedup_phrases(cases, 50).collect()}
    assert kept[1, 145] == (0, (PASSAGE + "alpha").encode()) and kept[4, 145] == (144, b"beta")
    assert kept[None, 144] == (144, b"") and kept[3, 0] == (0, b"") and kept[8, 3002][0] == 0
    assert op6_phrases.dedup_phrases(none, 50).collect() == []


# ---- 8

def test_op8_rules_and_parts(spark):
    urls = ["http://A.Example.NET/en/1", "http://x.net/", "http://x.net", "http://notnet/", "https://m.org/fr/?q=1#x", "http://a.example.com/de/5", "ftp://h?x=/y", None, "no scheme", "a://b://c/d", "http://example.net/EN/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    labels = spark.createDataFrame([("http://a.example.com/x", 0.0)], "url string, label double")
    rows = {r.page_id: tuple(r)[1:] for r in op8_urls.judge(df, op8_urls.UrlModel(labels)).collect()}
    assert rows[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert rows[1] == ("x.net", "/", "net/", "block") and rows[2] == ("x.net", "", None, "allow")
    assert rows[3] == ("notnet", "/", None, "allow") and rows[4] == ("m.org", "/fr/", "org/fr/", "allow")
    assert rows[5] == ("a.example.com", "/de/5", "example.com/de/", "block") and rows[6] == ("h", "", None, "allow")
    assert rows[7] == rows[8] == ("", "", None, "allow") and rows[9] == ("b:", "//c/d", None, "allow")
    assert rows[10] == ("example.net", "/EN/", "net/", "block")
    assert op8_urls.judge(df.limit(0), op8_urls.UrlModel(labels.limit(0))).collect() == []


def test_op8_trees_learn_lexical_features(spark):
    rng = random.Random(2)

    def url(bad: bool) -> str:
        host = rng.choice(["shop", "news", "blog"]) + ("".join(rng.choices("0123456789", k=6)) if bad else "") + rng.choice([".com", ".org"])
        query = "?" + "&".join(f"p{i}={rng.randrange(10**6)}" for i in range(rng.randrange(3, 7))) if bad else ""
        return f"http://{host}/{'a/' * rng.randrange(1, 3)}page{query}"

    made = [(url(i % 3 == 0), float(i % 3 == 0)) for i in range(900)]
    model = op8_urls.UrlModel(spark.createDataFrame(made[:600], "url string, label double"))
    held = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(made[600:])], "page_id long, url string, y double")
    said = {r.page_id: r.verdict for r in op8_urls.judge(held, model, rules=()).collect()}
    assert sum((said[i] == "block") == (y == 1.0) for i, (_, y) in enumerate(made[600:])) >= 0.95 * 300


def test_op8_shares_cover_all_labels(spark):
    made = [(f"http://h{i % 40}.site{i % 80}.t{i % 40}/p{i}", float(i % 40 < 10 or i % 7 == 0)) for i in range(800)]
    model = op8_urls.UrlModel(spark.createDataFrame(made, "url string, label double"), max_rows=30)
    prior = sum(y for _, y in made) / len(made)
    bad, n = defaultdict(float), Counter()
    for url, y in made:
        host = url.split("/")[2].split(".")
        for part in (host[-1], ".".join(host[-2:])):
            bad[part] += y
            n[part] += 1
    assert math.isclose(model.prior, prior)
    for name, column in (("suffix_share", "suffix"), ("site_share", "site")):
        got = {r[column]: r[name] for r in model.shares[name].collect()}
        assert got.keys() == {p for p in n if ("." in p) == (column == "site")}
        assert all(math.isclose(v, (bad[p] + 20 * prior) / (n[p] + 20)) for p, v in got.items())


def test_op8_judges_every_page(spark, sf_dir):
    rows = op8_urls.op8_url_verdicts(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert {r.verdict for r in rows} <= {"allow", "block"}


# ---- 9

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_quality(text: str) -> tuple:
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    duplicates, lost, _ = op9_lines.judged_lines(text, op9_lines.RULES)
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(hit), failed, not failed and lost <= 0.4 * len(words)


def test_op9_measures(spark, sf_dir, texts):
    for r in op9_lines.op9_line_quality(spark, sf_dir).collect():
        assert tuple(r)[1:] == slow_quality(texts[r.doc_id])


def test_op9_lines_and_cases(spark, cases, none):
    good = "A line of some plain words that end well."
    text = "\n".join([good, good, "home | shop | news | help", "SALE TODAY ONLY IN OUR SHOP", "All rights reserved.", "", "w*** x### y$$$ z%%%", "Another line of plain words follows here."])
    _, lost, cleaned = op9_lines.judged_lines(text, op9_lines.RULES)
    assert cleaned == good + "\n\nAnother line of plain words follows here." and lost == 9 + 7 + 6 + 3 + 4
    judged = op9_lines.judge(cases)
    assert judged.count() == len(CASES) and judged.filter("doc_id = 2").head()["_q_n_words"] == 0
    assert op9_lines.clean(cases).columns == cases.columns and op9_lines.clean(none).collect() == []


# ---- 10

def slow_print(text: str) -> int:
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    import xxhash

    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_op10_components(spark, sf_dir, texts):
    prints = {d: slow_print(t) for d, t in texts.items()}
    want = op10_simhash.brute_force(prints)
    for r in op10_simhash.op10_simhash_components(spark, sf_dir).collect():
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])


@pytest.mark.parametrize("hot", [200, 3])
def test_op10_chains_and_hot_cells(spark, monkeypatch, hot):
    monkeypatch.setattr(op10_simhash, "HOT_CELL", hot)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = {}
    for i in range(400):
        x = base[i % 20]
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            x ^= 1 << rng.randrange(64)
        prints[i] = x
    df = spark.createDataFrame([(d, x - (1 << 64) if x >> 63 else x) for d, x in prints.items()], "doc_id long, fp long")
    want = op10_simhash.brute_force(prints)
    assert {r.doc_id: r.component_id for r in op10_simhash.near_components(df).collect()} == want


def test_op10_defined_cases(cases, none):
    rows = op10_simhash.near_components(op10_simhash.fingerprints(cases)).collect()
    assert len(rows) == len(CASES)
    zero = [r for r in rows if r.fp == 0]
    assert {r.doc_id for r in zero} == {None, 2, 3, 7} and {r.component_id for r in zero} == {2}
    assert op10_simhash.near_components(op10_simhash.fingerprints(none)).collect() == []


# ---- pipeline

def slow_near(texts: dict[int, str]) -> set[int]:
    sets = {d: set(near_text.shingle_hashes(t.encode().lower().split(), 5).tolist()) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d for d in texts if find(d) == d}


def test_pipeline_equals_brute_force(spark, sf_dir, texts):
    kept = {}
    for d, t in texts.items():
        if slow_quality(t)[-1]:
            kept[d] = op9_lines.judged_lines(t, op9_lines.RULES)[2]
    kept = {d: kept[d] for d in slow_near(kept)}
    spans = op4_suffix.brute_force({d: t.encode() for d, t in kept.items()}, corpus_pipeline.REPEAT_BYTES, "first")
    left = {}
    for d, t in kept.items():
        blob, at, out = t.encode(), 0, ""
        for a, b in spans[d]:
            out += blob[at:a].decode(errors="ignore")
            at = b
        out += blob[at:].decode(errors="ignore")
        if not spans[d] or WORDS.search(out):
            left[d] = out
    check_pieces(corpus_pipeline.run(spark, sf_dir).collect(), left)


def test_pipeline_stages_keep_the_columns(spark, cases, none):
    for docs in (cases, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").columns == cases.columns
    kept = near_text.drop_near_copies(cases).collect()
    assert Counter(r.doc_id for r in kept) == {1: 1, 2: 1, 8: 1}


def test_near_copies_in_large_classes(spark, monkeypatch):
    monkeypatch.setattr(near_text, "SMALL_CLASS", 4)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    base = rng.choices(words, k=300)
    texts = {0: " ".join(rng.choices(words, k=300))}
    for i in range(1, 40):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(300)] = "edit"
        texts[i] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in near_text.drop_near_copies(df).collect()} == slow_near(texts)
    assert math.isclose(near_text.jaccard(b"a b c d e f", b"a b c d e g", 5), 1 / 3)


def noisy(rng: random.Random, base: list[str], most: float) -> str:
    """The words of `base` of which a random share up to `most` is replaced by words of this copy alone."""
    copy = list(base)
    for at in rng.sample(range(len(base)), rng.randrange(int(most * len(base)) + 1)):
        copy[at] = f"x{rng.getrandbits(40)}"
    return " ".join(copy)


@pytest.mark.parametrize("block", [256, 16])
def test_near_copies_in_large_classes_are_settled(spark, monkeypatch, block):
    monkeypatch.setattr(near_text, "BLOCK", block, raising=False)
    rng = random.Random(11)
    bases = [rng.choices([f"w{i}" for i in range(900)], k=300) for _ in range(2)]
    texts = {i: noisy(rng, bases[i % 2], 0.06) for i in range(240)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in near_text.drop_near_copies(df).collect()} == slow_near(texts)


def test_near_copies_pairs_aside_of_the_leaders(spark):
    rng = random.Random(12)
    common = rng.choices([f"w{i}" for i in range(900)], k=150)
    texts = {}
    for i in range(60):  # pairs that are alike, in one class, with no likeness of 0.8 to other pairs
        own = [*common, *(f"p{i}q{k}" for k in range(60))]
        texts[2 * i], texts[2 * i + 1] = " ".join(own), " ".join([*own, "end"])
    hashes = {d: near_text.shingle_hashes(t.encode().split(), 5) for d, t in texts.items()}
    views = defaultdict(set)
    for d, h in hashes.items():
        for v, x in enumerate(near_text.view_prints(h)):
            views[v, x].add(d)
    assert max(map(len, views.values())) > near_text.SMALL_CLASS
    keys = spark.createDataFrame([(1, d, 120) for d in texts], "class long, key long, members long")
    packed = near_text.packed_texts(spark.createDataFrame([(d, d, t) for d, t in texts.items()], "key long, doc_id long, text string"))
    assert {(r.a, r.b) for r in near_text.block_links(keys, packed, 5, 0.8).collect()} == {(2 * i, 2 * i + 1) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in near_text.drop_near_copies(df).collect()} == slow_near(texts)


def test_pipeline_repeats_of_short_words(spark):
    rng = random.Random(13)
    for size in (1, 2, 3):  # 101, 152 and 203 bytes
        passage = " ".join("".join(rng.choices("abcdefghijklmnop", k=size)) for _ in range(51))
        shorter = " ".join(passage.split()[:50])
        texts = {i: f"Opening here{i}. {passage} Closing{i} there." for i in range(1, 5)}
        texts[5], texts[6] = f"{shorter} five", f"six {shorter} six"
        texts[7] = f"seven {passage} {passage} seven"
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        left = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, df, "").collect()}
        want = {1: texts[1], 5: texts[5], 6: texts[6]} | {i: texts[i].replace(passage, "") for i in (2, 3, 4)}
        assert {d: left[d] for d in want} == want
        assert passage not in left[7] and left[7].startswith("seven ") and left[7].endswith(" seven")


# ---- 3

def slow_links(turns: list[tuple[str, int, str]]) -> dict[tuple[str, int], int]:
    """The reply of each turn, by looking for every quoted run of words in every earlier turn."""
    def runs(text):
        out = []
        for line in text.split("\n"):
            body = line.lstrip("> \t")
            level, words = line[: len(line) - len(body)].count(">"), body.lower().split()
            if words and out and out[-1][0] == level:
                out[-1][1].append(words)
            elif words:
                out.append((level, [words]))
        return out

    replies = {}
    for conv, turn, text in turns:
        votes = defaultdict(Counter)
        pieces = set()
        for level, lines in runs(text):
            words = sum(lines, [])
            n = min(5, len(words))
            if level:
                pieces |= {(level, tuple(words[i : i + n])) for i in range(len(words) - n + 1)} | {(level, tuple(x)) for x in lines if len(x) < n}
        for level, piece in pieces:
            for other in sorted((t, x) for c, t, x in turns if c == conv and t < turn):
                if any(f" {' '.join(piece)} " in f" {' '.join(sum(lines, []))} " for at, lines in runs(other[1]) if not at):
                    votes[level][other[0]] += len(piece)
                    break
        if votes:
            replies[conv, turn] = max(votes[min(votes)].items(), key=lambda x: (x[1], x[0]))[0]
    return replies


def quoting_turns() -> list[tuple[str, int, str]]:
    rng = random.Random(17)
    turns = [("n", 1, "A1\nA2\nA3"), ("n", 2, "> A1\n> A2\n> A3\nB"), ("n", 3, ">> A1\n>> A2\n>> A3\n> B\nC"), ("n", 4, "> A1\n> A3\nD")]
    said = "the quick brown fox jumps over the lazy dog and runs far away from here"
    turns += [("w", 1, "some words before it\n" + said), ("w", 2, "other things"), ("w", 3, "> fox jumps over\n> the lazy dog\n> and runs\nyes"), ("w", 4, "> brown FOX\nno"), ("w", 5, "> never said by anyone at all\nno")]
    texts: list[str] = []
    for i in range(60):  # a long conversation, its first turn quoted very often
        own = " ".join(rng.choices([f"v{k}" for k in range(400)], k=30))
        if i:
            source = texts[0 if i % 3 else rng.randrange(i)].split("\n")
            words, width = [f"> {x}" if not x.startswith(">") else f">{x}" for x in source], 7
            if i % 2:  # wrapped anew
                plain = " ".join(x for x in source if not x.startswith(">")).split()[3:]
                words = ["> " + " ".join(plain[k : k + width]) for k in range(0, len(plain), width)]
            own = "\n".join([*words, own])
        texts.append(own)
    return turns + [("h", i, t) for i, t in enumerate(texts)]


def test_op3_links_and_order(spark):
    turns = quoting_turns()
    df = spark.createDataFrame([(*t[:2], "user", t[2]) for t in turns], "conv_id string, turn long, role string, text string")
    linked = op3_quotes.link_quotations(df)
    got = {(r.conv_id, r.turn): r.reply_to for r in linked.collect()}
    want = slow_links(turns)
    assert got == {t[:2]: want.get(t[:2]) for t in turns}
    assert [got["n", i] for i in (1, 2, 3, 4)] == [None, 1, 2, 1] and [got["w", i] for i in (3, 4, 5)] == [1, 1, None]
    levels = {(r.conv_id, r.turn, r.level): r.origin for r in op3_quotes.quoted_links(df).collect()}
    assert (levels["n", 3, 1], levels["n", 3, 2]) == (2, 1)
    below = defaultdict(list)
    for (conv, turn), up in sorted(got.items()):
        below[conv, up].append(turn)

    def walk(conv, up):
        for turn in below[conv, up]:
            yield turn
            yield from walk(conv, turn)

    placed = {(r.conv_id, r.turn): r.position for r in op3_quotes.reading_order(linked).collect()}
    assert placed == {(c, t): i for c in "nwh" for i, t in enumerate(walk(c, None))}
    whole = op3_quotes.conversations(df).collect()
    assert {(r.conv_id, r.turn): (r.reply_to, r.position) for r in whole} == {k: (got[k], placed[k]) for k in got} and len(whole) == len(turns)


def test_op3_defined_cases(spark):
    rows = [("a", 1, "u", "Hello there"), ("a", 2, "u", "> hello   THERE\nyes"), ("a", 2, "u", "> hello   THERE\nyes"), (None, 3, "u", "> Hello there"), ("a", None, "u", "> Hello there"), ("a", 4, None, None), ("a", 5, "u", ">\n> \n")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = sorted((str(r.conv_id), str(r.turn), r.reply_to, r.n_quoted, r.max_level, r.text) for r in op3_quotes.link_quotations(df).collect())
    assert got == sorted([("a", "1", None, 0, 0, "Hello there"), ("a", "2", 1, 1, 1, "yes"), ("a", "2", 1, 1, 1, "yes"), ("None", "3", None, 1, 1, ""), ("a", "None", None, 1, 1, ""), ("a", "4", None, 0, 0, ""), ("a", "5", None, 2, 1, "")])
    assert op3_quotes.link_quotations(df.limit(0)).collect() == []
    placed = sorted((str(r.conv_id), str(r.turn), r.position) for r in op3_quotes.conversations(df).collect())
    assert placed == [("None", "3", None), ("a", "1", 0), ("a", "2", 1), ("a", "2", 1), ("a", "4", 2), ("a", "5", 3), ("a", "None", None)]
    assert op3_quotes.conversations(df.limit(0)).collect() == []
