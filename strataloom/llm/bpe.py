"""Byte-level BPE of a whole corpus with a public vocabulary.

Method: batched numpy merge rounds. The distinct words of a batch lie as symbols in one flat
array; each round looks all adjacent pairs up by binary search over the sorted pair keys,
takes each word's lowest rank and merges every occurrence of it, left to right. Words without a
mergeable pair leave the array. Merging all occurrences of a word's lowest pair at once
equals merging them one by one, as a pair with the merged symbol always has a higher rank.
"""

from __future__ import annotations

import importlib.util
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the pattern that splits text before the merges, as published with the vocabulary.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
CACHE_WORDS = 300_000  # distinct words whose ids a Python worker keeps
CACHE_CHARS = 64  # longer words are not kept


def vocabulary_path(name: str = VOCABULARY) -> str:
    """``$STRATALOOM_TOKENIZERS/name``, else the installed package of public tokenizers."""
    if root := os.environ.get("STRATALOOM_TOKENIZERS"):
        return os.path.join(root, name)
    spec = importlib.util.find_spec("public_tokenizers")
    root = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(root, name)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(c): b for c, b in zip([*shown, *(256 + k for k in range(len(hidden)))], [*shown, *hidden])}


class Encoder:
    """Ids of texts by a byte-level BPE vocabulary file; special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in _byte_letters().items():
            self.of_byte[byte] = vocab[letter]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.merged = keys[order], order.astype(np.int64), merged[order]
        self.known: dict[str, np.ndarray] = {}

    def words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word, by merge rounds over one flat array."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(b) for b in raw], np.int64)
        ids = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = np.iinfo(np.int64).max
        while len(ids):
            rank = np.full(len(ids), none)
            inside = np.flatnonzero(word[:-1] == word[1:])
            key = ids[inside] << 20 | ids[inside + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            where = inside[hit]
            rank[where] = self.rank[at[hit]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            of = np.cumsum(np.r_[False, word[1:] != word[:-1]])
            live = least[of] != none
            if not live.all():
                done.append((word[~live], ids[~live]))
                if not live.any():
                    break
            pick = (rank == least[of]) & live
            # of a run of overlapping picks, every second one merges
            p = np.flatnonzero(pick)
            head = np.r_[True, (p[1:] != p[:-1] + 1) | (word[p[1:]] != word[p[:-1]])]
            run = p - p[head][np.cumsum(head) - 1]
            p = p[run % 2 == 0]
            found = np.searchsorted(self.keys, ids[p] << 20 | ids[p + 1])
            ids[p] = self.merged[found]
            keep = live.copy()
            keep[p + 1] = False
            ids, word = ids[keep], word[keep]
        if not done:
            return [np.zeros(0, np.int32)] * len(words)
        word, ids = np.concatenate([w for w, _ in done]), np.concatenate([i for _, i in done])
        order = np.argsort(word, kind="stable")
        ids = ids[order].astype(np.int32)
        ends = np.cumsum(np.bincount(word, minlength=len(words)))
        return np.split(ids, ends[:-1])

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each text; null and empty texts give none."""
        split = [SPLIT.findall(t) if t else [] for t in texts]
        fresh: dict[str, np.ndarray] = {}
        for ws in split:
            for w in ws:
                if w not in self.known:
                    fresh[w] = None  # type: ignore[assignment]
        if fresh:
            names = list(fresh)
            fresh.update(zip(names, self.words(names)))
        look = lambda w: x if (x := self.known.get(w)) is not None else fresh[w]
        out = [np.concatenate([look(w) for w in ws]) if ws else np.zeros(0, np.int32) for ws in split]
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known = {}
        self.known.update((w, x.copy()) for w, x in fresh.items() if len(w) <= CACHE_CHARS)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _slices(pdf: pd.DataFrame, text: str, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Parts of a batch of about so many characters, a row at least."""
    size = pdf[text].str.len().fillna(0).cumsum() // chars
    for _, part in pdf.groupby(size, sort=False):
        yield part


def encode_corpus(df: DataFrame, key: str, text: str, path: str | None = None, ids: bool = True) -> DataFrame:
    """(key, ids): the token ids of every row's text, without special tokens; (key, n_tokens) if not ``ids``.

    A null or empty text gives an empty list. Every row gives a row, repeated keys included.
    Narrow: no shuffle; other columns are not read.
    """
    path = path or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            for part in _slices(pdf, "__t"):
                found = enc.encode(part["__t"])
                yield pd.DataFrame({key: part["__k"].array, "ids": found} if ids else {key: part["__k"].array, "n_tokens": [len(x) for x in found]})

    out = f"`{key}` {kind}, " + ("ids array<int>" if ids else "n_tokens bigint")
    return df.select(F.col(f"`{key}`").alias("__k"), F.col(f"`{text}`").alias("__t")).mapInPandas(run, out)
