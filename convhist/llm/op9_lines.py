"""Quality rules, lines first: bad lines go, then documents that lost too much text.

A line fails by one of these rules (in this order, the first that fits names it):
  duplicate    it equals an earlier line of the document
  punctuation  more than `symbol_share` of its word characters are symbols, or more than `mark_share` are ! or ?
  navigation   at least `separator_share` of its words are separators only, or it shouts: five words or more, no lower case
  boilerplate  it holds a phrase of BOILERPLATE
Lines without words are neither judged nor counted. A document is kept if its base measures pass and the words of failed
lines are at most `max_loss` of its words.

Defined cases: null text has no words, so its base measures fail; measures of whole texts, whatever their length; ids
and repeated rows play no part; other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convhist.llm import grams
from convhist.llm.common import encoded, text_slices

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = frozenset(["|", ">", "<", "/", "-", "·", "•", "»", "«", "–", "—", "::", "||", ">>"])
#: Fixed phrases of page furniture, lower case.
BOILERPLATE = (
    "accept cookies",
    "all rights reserved",
    "click here to",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "sign up for our newsletter",
    "terms of service",
    "terms of use",
    "this site uses cookies",
)
_FURNITURE = re.compile("|".join(map(re.escape, BOILERPLATE)))
WINDOW = 5
RULES = {"symbol_share": 0.1, "mark_share": 0.1, "separator_share": 0.25, "max_loss": 0.4}


def repeat_words(blobs: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(words, words in windows of `window` words that the text holds twice or more) of each text."""
    flat = np.frombuffer(b" ".join((*blobs, b"")), dtype=np.uint8)
    inside = ~((flat == 32) | ((flat >= 9) & (flat <= 13)))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    first, last = edges[::2], edges[1::2]
    stops = np.searchsorted(first, np.cumsum([len(b) + 1 for b in blobs]))
    sizes = np.diff(np.concatenate(([0], stops)))
    covered = np.zeros(len(first) + 1, dtype=np.int64)
    if len(first) >= window:
        doc = np.repeat(np.arange(len(blobs)), sizes)
        hashes = grams.Prefix(grams.Prefix(grams.BYTE_SYMBOLS[0][flat]).ranges(first, last)).grams(window)
        at = np.flatnonzero(doc[: len(hashes)] == doc[window - 1 :])
        hashes = grams.mix(hashes[at] + doc[at].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        order = np.argsort(hashes)
        same = hashes[order][1:] == hashes[order][:-1]
        hit = at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        covered = np.bincount(hit, minlength=len(covered)) - np.bincount(hit + window, minlength=len(covered))
    flags = np.concatenate(([0], np.cumsum(np.cumsum(covered[:-1]) > 0)))
    return sizes, flags[stops] - flags[stops - sizes]


def line_verdict(line: str, words: list[str], seen: set[str], rules: dict[str, float]) -> str | None:
    """The rule a line with words fails, or None."""
    if line in seen:
        return "duplicate"
    chars = sum(map(len, words))
    if sum(map(line.count, SYMBOLS)) > rules["symbol_share"] * chars or line.count("!") + line.count("?") > rules["mark_share"] * chars:
        return "punctuation"
    if sum(w in SEPARATORS for w in words) >= rules["separator_share"] * len(words) or (len(words) >= 5 and line.upper() == line and line.lower() != line):
        return "navigation"
    return "boilerplate" if _FURNITURE.search(line.lower()) else None


_SPLIT = re.compile(f"[^{SPACE}]+")


def words_of(line: str) -> list[str]:
    return line.split() if line.isascii() and not re.search("[\x1c-\x1f]", line) else _SPLIT.findall(line)


def judged_lines(text: str, rules: dict[str, float]) -> tuple[int, int, str]:
    """(duplicate lines, words of failed lines, text without failed lines)."""
    seen: set[str] = set()
    kept: list[str] = []
    duplicates = lost = 0
    for line in text.split("\n"):
        words = words_of(line)
        if not words:
            kept.append(line)
            continue
        failed = line_verdict(line, words, seen, rules)
        duplicates += failed == "duplicate"
        seen.add(line)
        if failed:
            lost += len(words)
        else:
            kept.append(line)
    return duplicates, lost, text if not lost else "\n".join(kept)


_MEASURES = (("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("lost_words", pa.int64()), ("cleaned", pa.string()))


def _judge(text_col: str, rules: dict[str, float], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = encoded(batch.column(text_col))
            for a, b in text_slices([len(x) for x in blobs]):
                part = blobs[a:b]
                n_words, repeats = repeat_words(part)
                rows = []
                for blob in part:
                    text = blob.decode()
                    duplicates, lost, cleaned = judged_lines(text, rules)
                    rows.append((len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), duplicates, lost, cleaned if with_text else None))
                chars, symbols, duplicates, lost, cleaned = zip(*rows, strict=True)
                found = [pa.array(v, t) for v, (_, t) in zip((n_words, chars, symbols, duplicates, repeats, lost, cleaned), _MEASURES, strict=True)]
                old = batch.slice(a, b - a)
                keep = old.columns if with_text else [old.column(0)]
                yield pa.RecordBatch.from_arrays([*keep, *found], names=[*(old.schema.names[: len(keep)]), *(f"_q_{n}" for n, _ in _MEASURES)])

    return run


def judge(docs: DataFrame, text_col: str = "text", with_text: bool = True, **rules: float) -> DataFrame:
    """All columns (or the first alone) and, with names that begin with _q_, the measures, the verdicts and the text
    without failed lines."""
    limits = RULES | rules
    kinds = {"int64": T.LongType(), "string": T.StringType()}
    schema = T.StructType(docs.schema.fields[: None if with_text else 1])
    for name, kind in _MEASURES:
        schema = schema.add(f"_q_{name}", kinds[str(kind)])
    out = docs.mapInArrow(_judge(text_col, limits, with_text), schema)
    failed = (F.col("_q_n_words") < 10) | (100 * F.col("_q_n_repeat_words") > 20 * F.col("_q_n_words"))
    lost = F.col("_q_lost_words") > F.lit(limits["max_loss"]) * F.col("_q_n_words")
    return out.withColumn("_q_base_failed", failed).withColumn("_q_kept", ~failed & ~lost)


def clean(docs: DataFrame, text_col: str = "text", **rules: float) -> DataFrame:
    """The kept documents with their columns, their texts without failed lines."""
    return judge(docs, text_col, **rules).filter("_q_kept").select(*[F.col("_q_cleaned").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op9_line_quality(spark, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judge(docs, with_text=False).select("doc_id", *[F.col(f"_q_{n}").alias(n) for n in names])


_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_COUNT = "(length({0}) - length(translate({0}, '{1}', '')))"

#: The same rules in SQL, over whole tables.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {_WORDS.format("text")} AS words FROM d),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)
),
hit AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, range(5) AS r(k) GROUP BY doc_id),
line AS (
  SELECT doc_id, no, line, {_WORDS.format("line")} AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM d)
),
judged AS (
  SELECT doc_id, len(words) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY no) > 1 AS dup,
    list_sum(list_transform(words, lambda x: length(x))) AS chars,
    {_COUNT.format("line", SYMBOLS)} AS symbols, {_COUNT.format("line", "!?")} AS marks,
    len(list_filter(words, lambda x: x IN ({", ".join(f"'{s}'" for s in sorted(SEPARATORS))}))) AS seps,
    len(words) >= 5 AND upper(line) = line AND lower(line) <> line AS shouts,
    regexp_matches(lower(line), '{"|".join(BOILERPLATE)}') AS furniture
  FROM line WHERE len(words) > 0
),
lines AS (
  SELECT doc_id, count(*) FILTER (dup) AS dups,
    sum(n) FILTER (dup OR symbols > 0.1 * chars OR marks > 0.1 * chars OR seps >= 0.25 * n OR shouts OR furniture) AS lost
  FROM judged GROUP BY doc_id
),
base AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(text) - (length(text) - length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))) AS BIGINT) AS word_chars,
    CAST({_COUNT.format("text", SYMBOLS)} AS BIGINT) AS n_symbols,
    CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(lost, 0) AS lost
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN lines ON lines.doc_id = w.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT lost > 0.4 * n_words AS kept
FROM base
"""
