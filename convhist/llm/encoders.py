"""Token ids of texts, each distinct word encoded once per worker.

A text splits at white space into words whose ids don't depend on each other. A worker keeps the ids of the words it met in
flat arrays; a batch of texts is looked up word by word and its ids are gathered at once in numpy. Words where that can't
be told by sight (rare space characters) send their text to the library whole. `path` is the vocabulary file, a parameter.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa

#: Words a worker keeps, and ids of theirs; beyond either it forgets the words that it met in one batch only.
WORDS = 500_000
IDS = 8_000_000
_open: dict[tuple, object] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encoder(kind: type, path: str, dtype: str):
    """One encoder per worker and vocabulary, so words learnt in one task serve the next."""
    if (kind, path, dtype) not in _open:
        _open[kind, path, dtype] = kind(path, dtype)
    return _open[kind, path, dtype]


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array and their sizes."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(sizes.sum())), sizes


def byte_characters() -> list[str]:
    """How byte-level vocabularies write bytes: visible Latin-1 characters as they are, the others from U+0100 on, in order."""
    shown = [33 <= k <= 126 or 161 <= k <= 172 or 174 <= k <= 255 for k in range(256)]
    hidden = np.cumsum(~np.array(shown)).tolist()
    return [chr(k if shown[k] else 255 + hidden[k]) for k in range(256)]


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1 .. of each range, one range after the other."""
    stop = np.cumsum(size)
    return np.repeat(begin - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)


class IdTable:
    """Ids by word, in flat arrays."""

    def __init__(self, learn):
        self.learn = learn
        self.clear()

    def clear(self) -> None:
        self.known: dict = {}
        self.ids, self.begin, self.size, self.met = (np.empty(0, dtype=np.int64) for _ in range(4))

    def forget(self) -> None:
        """Keep the words of two batches or more, if they are few enough."""
        kept = np.flatnonzero(self.met > 1)
        size = self.size[kept]
        if len(kept) > WORDS // 2 or size.sum() > IDS // 2:
            self.clear()
            return
        names = list(self.known)
        self.known = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.ids, self.begin, self.size, self.met = self.gather(kept), np.cumsum(size) - size, size, np.ones(len(kept), dtype=np.int64)

    def numbers(self, words: list) -> np.ndarray:
        """Numbers of words, for `begin` and `size`; unknown ones are learnt."""
        if len(self.known) > WORDS or len(self.ids) > IDS:
            self.forget()
        found = self._found(words)
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            new = list(dict.fromkeys([words[i] for i in missing]))
            ids, sizes = self.learn(new)
            first = len(self.known)
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(sizes) - sizes))
            self.size = np.concatenate((self.size, sizes))
            self.ids = np.concatenate((self.ids, ids))
            self.met = np.concatenate((self.met, np.zeros(len(new), dtype=np.int64)))
            found[missing] = self._found([words[i] for i in missing])
        self.met[found] += 1  # once a batch, however often the word is in it
        return found

    def _found(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        return self.ids[ranges(self.begin[numbers], self.size[numbers])]


class WordEncoder:
    """Ids of texts (UTF-8) through those of their words; subclasses say how to split and how to learn words."""

    def __init__(self, path: str, dtype: str):
        self.tokenizer, self.dtype = library(path), dtype
        self.table = IdTable(self.learn)

    def split(self, text: bytes) -> list[bytes]:
        raise NotImplementedError

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of each text."""
        split = [self.split(t) for t in texts]
        counts = np.concatenate(([0], np.cumsum([len(w) for w in split])))
        numbers = self.table.numbers(list(chain.from_iterable(split)))
        sizes = np.diff(np.concatenate(([0], np.cumsum(self.table.size[numbers])))[counts])
        return self.table.gather(numbers), sizes

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of `dtype`."""
        ids, sizes = self.encode([t.encode() for t in texts])
        data, ends = ids.astype(self.dtype), np.cumsum(sizes).tolist()
        return [data[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]


class SpacedWords(WordEncoder):
    """Byte-level vocabularies whose words carry the white space before them.

    Word ends are found in the bytes of all texts at once, and Arrow numbers the distinct words of a batch, so Python touches
    each distinct word of a batch once. New plain words are encoded in one call and told apart by the lengths of their tokens.
    """

    _space = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
    #: Bytes outside ASCII and the Latin letters up to U+024F, which all libraries know alike. U+0240 on needs a second look.
    _foreign = np.isin(np.arange(256), [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, *range(0xCA, 0x100)])
    #: Characters that some take for white space: a text that holds one goes to the library whole.
    _odd = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    #: By first byte of their UTF-8 form: whether a batch may hold any.
    _may = np.isin(np.arange(256), [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3])

    def __init__(self, path: str, dtype: str):
        super().__init__(path, dtype)
        self.quick, self.token_bytes = self._quick(path)

    def _quick(self, path: str):
        """The ranks library's encoder and the bytes of each token, where the file is the plain kind that it knows; else None."""
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        byte_of = {c: k for k, c in enumerate(byte_characters())}
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"].get(m, -1) for m in made]
        options = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        ordered = len(model["vocab"]) == 256 + len(made) and ids == sorted(set(ids)) and (not ids or ids[0] >= 256)
        if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex") or options or not ordered:
            return None, None
        ranks = {bytes([byte_of[c] for c in token]): i for token, i in model["vocab"].items()}
        token_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        token_bytes[list(ranks.values())] = list(map(len, ranks))
        return tiktoken.Encoding("ascii", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, token_bytes

    def joinable(self, words: list[bytes], ends: np.ndarray) -> np.ndarray:
        """Which words are plain and can stand behind each other: white space first, none at the end, no mark."""
        data = np.frombuffer(b"".join([*words, b" "]), dtype=np.uint8)
        here, after = data[:-1], data[1:]
        bad = self._foreign[here] | ((here == 0xC9) & (after >= 0x90)) | ((here == ord("<")) & (after == ord("|")))
        total = np.concatenate(([0], np.cumsum(bad)))
        begin = np.concatenate(([0], ends[:-1]))
        return (total[ends] == total[begin]) & self._space[data[begin]] & ~self._space[data[ends - 1]]

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not self.quick:
            return flattened([self.whole(w.decode()) for w in words])
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        plain = self.joinable(words, np.cumsum(size))
        joined = np.array(self.quick(b"".join(compress(words, plain)).decode()), dtype=np.int64)
        token_ends = np.cumsum(self.token_bytes[joined])
        sizes = np.empty(len(words), dtype=np.int64)
        sizes[plain] = np.diff(np.searchsorted(token_ends, np.cumsum(size[plain]), side="right"), prepend=0)
        odd_ids, sizes[~plain] = flattened([self.whole(w.decode()) for w in compress(words, ~plain)])
        owner = np.repeat(plain, sizes)
        ids = np.empty(len(owner), dtype=np.int64)
        ids[owner], ids[~owner] = joined, odd_ids
        return ids, sizes

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = b"".join(texts)
        if self._may[np.frombuffer(data, dtype=np.uint8)].any():
            odd = [bool(self._odd.search(t.decode())) for t in texts]
            if any(odd):
                parts = [flattened([self.whole(t.decode())]) if o else self.by_words(t, [t]) for t, o in zip(texts, odd, strict=True)]
                return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return self.by_words(data, texts)

    def by_words(self, data: bytes, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each text; `data` is all texts, one after the other."""
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))))
        if not data:
            return flattened([[] for _ in texts])
        space = self._space[np.frombuffer(data, dtype=np.uint8)]
        first = space & ~np.concatenate(([True], space[:-1]))
        first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        at = np.flatnonzero(first)
        offsets = np.append(at, len(data))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        numbers = self.table.numbers(words.dictionary.to_pylist())[words.indices.to_numpy()]
        sizes = np.diff(np.concatenate(([0], np.cumsum(self.table.size[numbers])))[np.searchsorted(at, bounds)])
        return self.table.gather(numbers), sizes


class BareWords(WordEncoder):
    """Vocabularies that drop white space and mark the ends of words.

    Words of printable ASCII and Latin letters up to U+024F, which all libraries know alike, split further into pieces by the
    file's own pattern; each distinct piece is encoded once.
    """

    _printable = re.compile(rb"(?:[\x21-\x7e]|\xc3[\x80-\xbf]|\xc4[\x80-\xaf\xb2-\xbf]|[\xc5-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")
    _mark = "<|endoftext|>"

    def __init__(self, path: str, dtype: str):
        super().__init__(path, dtype)
        self.mark = self.tokenizer.token_to_id(self._mark)
        self.pieces = IdTable(self.learn_pieces)
        self.find = self._pattern(path)

    @staticmethod
    def _pattern(path: str):
        """What finds the pieces of a lower-case word, where the file is of the usual kind; else None."""
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if normal != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] or not steps[0]["invert"] or steps[0]["behavior"] != "Removed" or steps[1]["use_regex"]:
            return None
        return regex.compile(steps[0]["pattern"]["Regex"]).findall

    def split(self, text: bytes) -> list[bytes]:
        return text.split()

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        plain = [bool(self.find and self._printable.fullmatch(w) and b"<|" not in w) for w in words]
        split = [self.find(w.decode().lower()) for w, p in zip(words, plain, strict=True) if p]
        counts = np.concatenate(([0], np.cumsum([len(p) for p in split], dtype=np.int64)))
        numbers = self.pieces.numbers(list(chain.from_iterable(split)))
        sizes = np.empty(len(words), dtype=np.int64)
        plain = np.array(plain, dtype=bool)
        sizes[plain] = np.diff(np.concatenate(([0], np.cumsum(self.pieces.size[numbers])))[counts])
        odd_ids, sizes[~plain] = self.learn_odd([w.decode() for w, p in zip(words, plain, strict=True) if not p])
        owner = np.repeat(plain, sizes)
        ids = np.empty(len(owner), dtype=np.int64)
        ids[owner], ids[~owner] = self.pieces.gather(numbers), odd_ids
        return ids, sizes

    def learn_odd(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.by_library(words)

    def learn_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.by_library(pieces)

    def by_library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All in one call with a mark between them, unless one holds a mark itself."""
        if not pieces:
            return flattened([])
        ids = np.array(self.whole(self._mark.join(pieces)), dtype=np.int64)
        ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
        if len(ends) != len(pieces):
            return flattened([self.whole(p) for p in pieces])
        return ids[ids != self.mark], np.diff(ends, prepend=-1) - 1
