"""Fill-in-the-middle texts, cut at unit ranks by indexable skip lists.

A unit is a run of ASCII letters or any other single character. The units of a text form a skip list: lane 0 links every
unit to the next one, and each lane above keeps about a quarter of the nodes below it. A link carries two widths, the units
and the code points it spans. A cut rank is reached from the head by going along a lane while the accumulated units stay at
or below the rank and going down a lane otherwise; the accumulated code points are then the place of the cut.

The lists of a batch of texts lie in shared flat arrays, and all texts descend together. Nothing is shuffled.

Defined cases: null and empty texts are plain; whole texts, whatever their length; a null id is hashed as empty decimal;
repeated ids get the same cuts; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convhist.llm import grams
from convhist.llm.common import encoded, table, text_slices

MARKERS = ("<P>", "<S>", "<M>")
PIECES = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where units start in flat code points; texts start at `begins`."""
    lower = points | 32
    letter = (lower >= 97) & (lower <= 122) & (points < 128)
    starts = ~letter
    starts[1:] |= ~letter[:-1]
    starts[begins[begins < len(points)]] = True
    return np.flatnonzero(starts)


class SkipLists:
    """Indexable skip lists of many texts. starts: of all units, in code points; texts: first unit of each text, and the end."""

    def __init__(self, starts: np.ndarray, length: int, texts: np.ndarray):
        n = len(starts)
        self.texts = texts
        heads = np.unique(texts[:-1][np.diff(texts) > 0])
        place = np.append(starts, length)
        # A node rises a lane with probability 1/4: two more low zero bits of a hash of its number.
        coin = grams.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        lanes = 1
        while 4**lanes < np.diff(texts).max(initial=0):
            lanes += 1
        nodes, self.units, self.points, self.down = np.arange(n), [], [], []
        below = None
        for lane in range(lanes):
            if lane:
                rises = (coin[nodes] & np.uint64((1 << (2 * lane)) - 1)) == 0
                rises[np.searchsorted(nodes, heads)] = True
                nodes = nodes[rises]
                self.down.append(np.append(np.searchsorted(below, nodes), len(below)))
            after = np.append(nodes[1:], n)
            self.units.append(np.append(after - nodes, n + 1))  # beyond the last node no link fits any rank
            self.points.append(np.append(place[after] - place[nodes], 0))
            below = nodes
        self.top = below

    def find(self, ranks: np.ndarray) -> np.ndarray:
        """Code points before the unit with the given rank, for each text; its number of units gives its length."""
        at = np.searchsorted(self.top, self.texts[:-1])
        units, points = np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
        for lane in range(len(self.units) - 1, -1, -1):
            going = np.flatnonzero(ranks > 0)
            while len(going):
                going = going[units[going] + self.units[lane][at[going]] <= ranks[going]]
                units[going] += self.units[lane][at[going]]
                points[going] += self.points[lane][at[going]]
                at[going] += 1
            if lane:
                at = self.down[lane - 1][at]
        return points


def draws(doc_id: int | None, salt: str) -> tuple[int, int, int, int]:
    """The first four 32-bit numbers of the digest of salt and id."""
    return struct.unpack(">4I", hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def check_markers(markers: Sequence[str]) -> None:
    """Markers must not overlap, so that the first occurrence in an output is the one that was put there."""
    for a in markers:
        for b in markers:
            if any(a.endswith(b[:i]) for i in range(1, min(len(a), len(b)) + (a != b))) or not a:
                raise ValueError("markers must not be empty or overlap one another")


def _transform(salt: str, plain_percent: int, spm_percent: int, markers: Sequence[str]):
    first, second, third = markers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = batch.column("doc_id").to_pylist(), encoded(batch.column("text"))
            for a, b in text_slices([len(t) for t in raw]):
                texts = [t.decode() for t in raw[a:b]]
                flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
                bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
                starts = unit_starts(flat, bounds[:-1])
                firsts = np.searchsorted(starts, bounds)
                n = np.diff(firsts)
                hashes = [draws(i, salt) for i in ids[a:b]]
                cuts = np.sort(np.array([h[:2] for h in hashes], dtype=np.int64).reshape(-1, 2) % (n + 1)[:, None], axis=1)
                lists = SkipLists(starts, len(flat), firsts)
                ends = [lists.find(cuts[:, k]).tolist() for k in (0, 1)]
                rows = []
                for text, (_, _, h3, h4), p, m in zip(texts, hashes, *ends, strict=True):
                    if not text or any(x in text for x in markers) or h3 % 100 >= 100 - plain_percent:
                        rows.append(("plain", None, None, text))
                    elif h4 % 100 < spm_percent:
                        rows.append(("spm", p, m - p, f"{second}{text[m:]}{first}{text[:p]}{third}{text[p:m]}"))
                    else:
                        rows.append(("psm", p, m - p, f"{first}{text[:p]}{second}{text[m:]}{third}{text[p:m]}"))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def transform(docs: DataFrame, salt: str = "1", plain_percent: int = 10, spm_percent: int = 20, markers: Sequence[str] = MARKERS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each document. markers: of prefix, suffix and middle."""
    check_markers(markers)
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInArrow(_transform(salt, plain_percent, spm_percent, tuple(markers)), PIECES)


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The exact text of an output, from the output and its form alone."""
    first, second, third = markers

    def parts(head: str, mid: str) -> tuple[Column, Column, Column]:
        one, two = F.locate(mid, output), F.locate(third, output)
        cut = lambda a, b: F.substring(output, a, b - a)
        return cut(F.lit(len(head) + 1), one), cut(one + len(mid), two), cut(two + len(third), F.length(output) + 1)

    prefix, suffix, middle = parts(first, second)
    late_suffix, late_prefix, late_middle = parts(second, first)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(late_prefix, late_middle, late_suffix)).otherwise(output)


def op13_skiplist_fim(spark, sf_dir: str) -> DataFrame:
    """Forms, cuts and digests of all documents."""
    rows = transform(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
e AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
