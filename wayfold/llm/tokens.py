"""Byte-level BPE with a public vocabulary, in batched numpy merge rounds.

Texts are split by the vocabulary's pattern; each distinct word of a batch is encoded once. The symbols of all new words
lie in one flat array. A round looks every adjacent pair up by binary search in the sorted pair keys, finds each word's
lowest rank and merges all places that have it; finished words leave the array.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text into words before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.int32(2**31 - 1)
#: Distinct words a worker keeps; beyond, it forgets them all and starts again (memory only, never a result).
KEPT_WORDS = 400_000
#: Characters of text handled at a time within an Arrow batch.
CHUNK_CHARS = 4_000_000


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes words by batched merge rounds. Ids of known words are kept flat, with their offsets."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        letters = _byte_letters()
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.base = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.split = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.start = np.zeros(1, np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each word has."""
        raw = [w.encode("utf-8", "replace") for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_word, done_sym = [], []
        while len(sym):
            rank = np.full(len(sym), NO_RANK, np.int32)
            same = word[1:] == word[:-1]
            rank[:-1][same] = self.ranks_of(sym[:-1][same], sym[1:][same])
            first = np.flatnonzero(np.append(True, ~same))
            low = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(sym)))
            ended = np.repeat(low == NO_RANK, count)
            if ended.any():
                done_word.append(word[ended])
                done_sym.append(sym[ended])
                live = ~ended
                sym, word, rank = sym[live], word[live], rank[live]
                low, count = low[low != NO_RANK], count[low != NO_RANK]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, count)
            # A pair of equal symbols can overlap itself (a a a): of a run of hits every second one is merged.
            at = np.flatnonzero(hit)
            run = np.append(True, np.diff(at) != 1)
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            sym = sym.copy()
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_word:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def _learn(self, words: list[str]) -> None:
        ids, counts = self.encode_words(words)
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(need, np.int32)])
        self.flat[self.used : need] = ids
        self.start = np.concatenate([self.start, self.used + np.cumsum(counts)])
        self.used = need

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each; null and empty texts have none."""
        if len(self.index) > KEPT_WORDS:
            self.forget()
        index, known, pieces, counts = self.index, len(self.index), [], []
        for t in texts:
            found = self.split(t) if t else ()
            counts.append(len(found))
            pieces.extend(found)
        new = [w for w in dict.fromkeys(pieces) if w not in index]
        if new:
            index.update(zip(new, range(known, known + len(new))))
            self._learn(new)
        word = np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))
        begin = self.start[word]
        size = self.start[word + 1] - begin
        ends = np.cumsum(size)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)
        total = np.concatenate([[0], ends])[np.cumsum([0, *counts])]
        return self.flat[where], np.diff(total)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_CHARS characters; a longer text makes a range of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _tokenizer_file(folder: str, name: str) -> str:
    return os.path.join(folder, name + ".json")


def encode_texts(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(`key`, `ids`): the token ids of each row's text, without special tokens; no shuffle.

    Null and empty texts give an empty list; blank texts are encoded as they stand. Every input row gives one row,
    repeated rows as many as there are. The strings of special tokens are ordinary text.
    """
    path = _tokenizer_file(folder, tokenizer)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _chunks(texts):
                flat, counts = enc.encode(texts[i:j])
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                ids = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str, out: str = "n_tokens", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns `keep` with the number of tokens of each row's text (0 for null and empty); no shuffle."""
    path = _tokenizer_file(folder, tokenizer)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", `{out}` long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            for i, j in _chunks(texts):
                counts = enc.encode(texts[i:j])[1]
                cols = [b.column(k).slice(i, j - i) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], names=[*keep, out])

    return df.select(*keep, text).mapInArrow(run, schema)
