"""BPE encoding and decoding by batched merge rounds in numpy.

The words of a batch that the worker hasn't met yet stand as symbols in one flat array. A round looks up every adjacent
pair by binary search over the sorted pair keys, takes the lowest rank of each word, and merges it in all words at once;
words without a known pair leave. Texts are put together from the words' ids.

Normalisation and word splitting are what the vocabulary file says (its own components are called); merging, special
tokens and decoding are done here. Only vocabularies without a decoder and with an end-of-word suffix are supported: their
decoded text is the tokens joined by one space.

Defined cases: null text is empty: no ids, empty decoded text; whole texts, whatever their length; null and repeated ids
play no part; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convhist.llm.common import encoded, joined, text_slices
from convhist.llm.encoders import BareWords, byte_characters, encoder, flattened, vocabulary


class Merges:
    """The merge table as sorted pair keys, with their ranks and results."""

    def __init__(self, merges: list, vocab: dict[str, int]):
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        self.none = len(pairs)

    def apply(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all words to the end: (symbols, sizes), words in their order."""
        number = np.arange(len(sizes))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sizes):
            word = np.repeat(np.arange(len(sizes)), sizes)
            rank = np.full(len(symbols), self.none)
            at = np.flatnonzero(word[1:] == word[:-1])
            key = symbols[at] << 32 | symbols[at + 1]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[place] == key
            rank[at[known]] = self.ranks[place[known]]
            low = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
            over = low == self.none
            if over.any():
                stays = over[word]
                done.append((number[over], sizes[over], symbols[stays]))
                number, sizes, low, symbols, rank = number[~over], sizes[~over], low[~over], symbols[~stays], rank[~stays]
                if not len(sizes):
                    break
                word = np.repeat(np.arange(len(sizes)), sizes)
            hit = np.flatnonzero((rank == low[word]) & (rank < self.none))
            if len(hit) > 1:  # of overlapping pairs every other one, from the left
                fresh = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]])))
                lead = np.flatnonzero(fresh)
                hit = hit[(np.arange(len(hit)) - lead[np.cumsum(fresh) - 1]) % 2 == 0]
            key = symbols[hit] << 32 | symbols[hit + 1]
            symbols[hit] = self.made[np.searchsorted(self.keys, key)]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            sizes = sizes - np.bincount(word[hit], minlength=len(sizes))
            symbols = symbols[keep]
        if not done:
            return symbols, sizes
        numbers, widths, flat = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(numbers)
        begin = np.cumsum(widths) - widths
        out = widths[order]
        index = np.repeat(begin[order] - (np.cumsum(out) - out), out) + np.arange(out.sum())
        return flat[index], out


class Codec(BareWords):
    """Ids and tokens of texts, words learnt in batches by the merge rounds."""

    def __init__(self, path: str, dtype: str = "<u4"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        if not self.reads(path):
            raise ValueError("the vocabulary needs an end-of-word suffix and no decoder, unknown token or prefix")
        super().__init__(path, dtype)
        vocab = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges = Merges(model["merges"], vocab)
        self.inner = {c: i for c, i in vocab.items() if len(c) == 1}
        self.last = {c[: -len(suffix)]: i for c, i in vocab.items() if c.endswith(suffix) and len(c) == 1 + len(suffix)}
        self.by_byte = np.array([[table[c] for c in byte_characters()] for table in (self.inner, self.last)])
        tokens = [""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in (vocab | added).items():
            tokens[i] = token
        # Each with a space after it: what a text ends with is cut.
        self.tokens = pa.array([t + " " for t in tokens], pa.large_binary())
        self.decimals = pa.array([b"%d " % i for i in range(len(tokens))], pa.large_binary())
        self.added = added
        self.special = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None

    @staticmethod
    def reads(path: str) -> bool:
        """Whether the vocabulary is of the kind that is supported."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        return bool(model["end_of_word_suffix"] and not spec["decoder"] and not model["unk_token"] and not model["continuing_subword_prefix"])

    def learn_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Their bytes are symbols, the last one with the end of the word."""
        raw = [p.encode() for p in pieces]
        sizes = np.array([len(p) for p in raw], dtype=np.int64)
        points = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.by_byte[0][points]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.by_byte[1][points[ends]]
        return self.merges.apply(symbols, sizes)

    def learn_odd(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [w for w in words if not (self.special and self.special.search(w))]
        known = dict(zip(plain, self.by_rounds(plain), strict=True))
        return flattened([known[w] if w in known else self.with_specials(w) for w in words])

    def split_words(self, words: list[str]) -> tuple[list[str], list[int]]:
        """The word pieces of words without special tokens, and how many belong to each."""
        normal, before = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        text = normal.normalize_str(" ".join(words))
        each = text.split(" ")
        if len(each) == len(words):
            found = before.pre_tokenize_str(text)
            ends = np.cumsum([len(w) + 1 for w in each])
            owner = np.searchsorted(ends, [span[0] for _, span in found], side="right")
            return [p for p, _ in found], np.bincount(owner, minlength=len(words)).tolist()
        split = [[p for p, _ in before.pre_tokenize_str(normal.normalize_str(w))] for w in words]
        return [p for x in split for p in x], [len(x) for x in split]

    def by_rounds(self, words: list[str]) -> list[list[int]]:
        """Ids of words, or of whole texts, without special tokens."""
        pieces, counts = self.split_words(words)
        symbols, sizes = [], []
        for p in pieces:
            symbols += [self.inner[c] for c in p[:-1]]
            symbols.append(self.last[p[-1]])
            sizes.append(len(p))
        flat, widths = self.merges.apply(np.array(symbols, dtype=np.int64), np.array(sizes, dtype=np.int64))
        total = np.concatenate(([0], np.cumsum(widths)))
        ends = total[np.cumsum(counts)].tolist() if counts else []
        ids = flat.tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def with_specials(self, text: str) -> list[int]:
        """Ids of a text in which the vocabulary's special tokens stand for themselves."""
        out: list[int] = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                out.append(self.added[part])
            elif part.strip():
                out += self.by_rounds([part])[0]
        return out

    def written(self, column: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> Iterator[memoryview]:
        """Per text: its ids through a column of the table, with one space between."""
        data, edge = joined(column, ids, np.concatenate(([0], np.cumsum(sizes))))
        return (data[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))

    def batch(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """(ids joined by spaces, tokens joined by spaces, count) of each text."""
        ids, sizes = self.encode([t.encode() for t in texts])
        return list(zip(*([str(x, "utf-8") for x in self.written(c, ids, sizes)] for c in (self.decimals, self.tokens)), sizes.tolist(), strict=True))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(Codec, path, "<u4")
        for batch in batches:
            texts = encoded(batch.column("text"))
            for a, b in text_slices([len(t) for t in texts]):
                ids, sizes = codec.encode(texts[a:b])
                lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes)))), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32()))
                tokens = pa.array([str(x, "utf-8") for x in codec.written(codec.tokens, ids, sizes)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(sizes), lists, tokens], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(Codec, path, "<u4")
        for batch in batches:
            texts = encoded(batch.column("text"))
            for a, b in text_slices([len(t) for t in texts]):
                ids, sizes = codec.encode(texts[a:b])
                hexed = [pa.array([hashlib.sha256(x).hexdigest() for x in codec.written(c, ids, sizes)], pa.string()) for c in (codec.decimals, codec.tokens)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(sizes), *hexed], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _slim(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each document."""
    return _slim(docs, text_col, id_col).mapInArrow(_encode(tokenizer), "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): `encode` without moving the ids out of the task."""
    return _slim(docs, text_col, id_col).mapInArrow(_digests(tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe_roundtrip(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, vocabulary("word_bpe_49k.json"))
