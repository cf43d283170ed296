"""Ids of a lower-casing word BPE (a ``tokenizers`` JSON file), in bulk.

The file's normaliser (NFC, white space, lower case), its split pattern and
its merges all act within words, so ids are computed once per distinct word
and concatenated.  They equal ``tokenizers`` with add_special_tokens=False and
encode_special_tokens=True (special strings in a text are ordinary text)."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

from epiframe.llm.common import WordCache, slices
from epiframe.llm.merges import PairTable, merge_words


def _byte_alphabet() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [rest.get(b, chr(b)) for b in range(256)]


#: Two characters in a row that are no letters, digits or white space: the split pattern may keep them together.
_MARKS = re.compile(r"(?:[^\w\s]|[_\x1c-\x1f]){2}")


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        bpe = spec["model"]
        if (kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"]
                or level["type"] != "ByteLevel" or level["add_prefix_space"] or bpe["continuing_subword_prefix"]
                or bpe["ignore_merges"] or bpe["dropout"]):
            raise ValueError("not a lower-casing word BPE with byte-level letters")
        self.split = regex.compile(split["pattern"]["Regex"] + r"|\n")
        vocab, suffix, alphabet = bpe["vocab"], bpe["end_of_word_suffix"], _byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int32)
        self.last = np.array([vocab[c + suffix] for c in alphabet], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in bpe["merges"]]
        rows = [(vocab[a], vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(merges)]
        self.pairs = PairTable(*np.array(rows, np.int64).T)
        self.words = WordCache(self._words, np.int32)

    def _tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of tokens that the split pattern cut."""
        if not tokens:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        lens = np.array([len(t) for t in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym, ends = self.inner[data], np.cumsum(lens)
        sym[ends - 1] = self.last[data[ends - 1]]
        return merge_words(self.pairs, sym, lens)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised words (no space or newline in them)."""
        plain = np.fromiter(map(str.isalpha, words), bool, len(words))
        if plain.all():
            return self._tokens(words)
        parts: list[list[str]] = [[]]
        for token in self.split.findall("\n".join([w for w in words if not w.isalpha()])):
            if token == "\n":
                parts.append([])
            else:
                parts[-1].append(token)
        counts = np.ones(len(words), np.int64)
        counts[~plain] = [len(p) for p in parts]
        rest = iter(parts)
        flat, sizes = self._tokens([t for w, p in zip(words, plain.tolist()) for t in ((w,) if p else next(rest))])
        ends, to = np.concatenate(([0], np.cumsum(sizes))), np.cumsum(counts)
        return flat, ends[to] - ends[to - counts]

    def _cut(self, text: str) -> list[str]:
        """The normalised text in words, none of which a token crosses."""
        if not text.isascii():
            # One letter at a time, as the normaliser does: no special final sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower().replace("\n", " ")
        if not _MARKS.search(text):  # each full stop and comma is then a token of its own
            text = text.replace(".", " . ").replace(",", " , ")
        return text.split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all whole texts in order, how many per text)."""
        parts = [self.words.lookup([self._cut(t) for t in texts[a:b]]) for a, b in slices(texts)]
        return (np.concatenate([np.zeros(0, np.int32), *(f for f, _ in parts)]),
                np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)]))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
