"""Whole-text encoding with the ``tokenizers`` library, remembering the ids of words seen before.

Web text repeats its words, so the library is asked for each distinct pre-token only once per
worker: a text is cut at exactly the places where the tokenizer's own pre-tokenizer cuts it, known
pre-tokens are looked up, and the unknown ones go to the library in one batch. Texts holding a
character for which the cuts are not certain, or the string of a special token, go to the library
whole, with its defaults. Both ways give equal ids.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Pre-tokens remembered by one worker, in each of two generations: when the young one is full it
#: becomes the old one, whose words return to the young one when met again. This changes no result.
MEMO_WORDS = 160_000
#: Letters outside ASCII that the quick cuts know. Any other character sends its text the slow way.
_LETTERS = "À-ÖØ-öø-ÿ"
_UNSURE = re.compile(rf"[^\x00-\x7f{_LETTERS}]")
_SPACE = r" \t\n\x0b\x0c\r"
_CLITICS = "'s|'t|'re|'ve|'m|'ll|'d"
_LOWER_WORDS = re.compile(rf"{_CLITICS}|[a-zß-öø-ÿ]+|[0-9]|[^{_SPACE}a-zß-öø-ÿ0-9]+")
_SPACED_WORDS = re.compile(
    rf"{_CLITICS}| ?[A-Za-z{_LETTERS}]+| ?[0-9]+| ?[^{_SPACE}A-Za-z{_LETTERS}0-9]+"
    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: The pre-tokenizer pattern and normalizer steps of lower-casing word vocabularies.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_STEPS = ["NFC", "Replace", "Lowercase"]


def _cuts(spec: dict):
    """The quick cut for a tokenizer file, or None if its pre-tokenizer is not one of the two known."""
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    if not normal and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return _SPACED_WORDS.findall
    steps = [x.get("type") for x in normal.get("normalizers", [])]
    first = (pre.get("pretokenizers") or [{}])[0]
    if steps == _WORD_STEPS and first.get("pattern", {}).get("Regex") == _WORD_PATTERN:
        return lambda text: _LOWER_WORDS.findall(text.lower())
    return None


def _special(spec: dict) -> re.Pattern | None:
    """Finds the string of any added token, whatever its case, as a normalizer may change that."""
    found = [re.escape(t["content"]) for t in spec.get("added_tokens") or [] if t.get("content")]
    return re.compile("|".join(found), re.IGNORECASE) if found else None


class Encoder:
    """Encodes whole texts to little-endian unsigned ids of ``dtype`` (16 bits if the ids fit, else 32).

    The ids are those of the library at its defaults without special tokens added: a special
    token's own string in a text is that token.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark owns the cores
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._cut, self._special = _cuts(spec), _special(spec)
        self._tok = Tokenizer.from_file(path)
        self.dtype = id_type(self._tok.get_vocab_size())
        vocab, suffix = self._tok.get_vocab(), spec["model"].get("end_of_word_suffix")
        self._ends = None
        if suffix:
            self._ends = np.zeros(max(vocab.values()) + 1, bool)
            self._ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self._lengths = None
        if self._cut == _SPACED_WORDS.findall:  # its tokens hold a character for each byte
            self._lengths = np.zeros(max(vocab.values()) + 1, np.int64)
            self._lengths[list(vocab.values())] = list(map(len, vocab))
        self._memo: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        """The ids of each word, asked for as one text: words end at the tokens that have the ending suffix."""
        ids = np.array(self._tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(words) or ends[-1:] != len(ids):  # not cut as expected: word by word
            return self._library(words)
        raw, cuts = ids.tobytes(), (ends * ids.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]

    def _listed(self, words: list[str]) -> list[bytes]:
        """The ids of each word, asked for as a list of words."""
        e = self._tok.encode_batch([words], is_pretokenized=True, add_special_tokens=False)[0]
        ids, owner = np.array(e.ids, self.dtype), np.array(e.word_ids, np.int64)
        raw, cuts = ids.tobytes(), (np.searchsorted(owner, np.arange(len(words)), "right") * ids.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """The ids of words of a space and letters, asked for as one text, which is cut at its spaces: words end where
        that many bytes have been given tokens."""
        ids = np.array(self._tok.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        upto = np.cumsum(self._lengths[ids])
        ends = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in words])
        cuts = np.searchsorted(upto, ends)
        if not len(upto) or upto[-1] != ends[-1] or (upto[cuts] != ends).any():  # not cut as expected
            return self._listed(words)
        raw, cuts = ids.tobytes(), ((cuts + 1) * ids.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]

    def _learn(self, words: list[str]) -> None:
        ask = self._listed if self._ends is None else self._joined
        if self._lengths is not None:
            spaced = [w for w in words if w[0] == " " and w[1:].isalpha()]
            for i in range(0, len(spaced), 256):
                block = spaced[i : i + 256]
                self._memo.update(zip(block, self._spaced(block), strict=True))
            words = [w for w in words if not (w[0] == " " and w[1:].isalpha())]
        for i in range(0, len(words), 256):
            block = words[i : i + 256]
            self._memo.update(zip(block, ask(block), strict=True))

    def _unsure(self, text: str) -> bool:
        return self._cut is None or _UNSURE.search(text) is not None or (self._special is not None and self._special.search(text) is not None)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes, in order; a null text has none."""
        out: list[bytes] = [b""] * len(texts)
        if len(self._memo) > MEMO_WORDS:
            self._old, self._memo = self._memo, {}
        slow: list[int] = []
        cut: list[tuple[int, list[str]]] = []
        missing: set[str] = set()
        for i, text in enumerate(texts):
            if not text:
                continue
            if self._unsure(text):
                slow.append(i)
                continue
            words = self._cut(text)
            cut.append((i, words))
            missing.update(words)
        for i, ids in zip(slow, self._library([texts[i] for i in slow]), strict=True):
            out[i] = ids
        missing.difference_update([w for w in missing if w in self._memo])
        back = [w for w in missing if w in self._old]
        self._memo.update(zip(back, map(self._old.__getitem__, back)))
        missing.difference_update(back)
        self._learn(list(missing))
        known = self._memo.__getitem__
        for i, words in cut:
            out[i] = b"".join(map(known, words))
        return out


def id_type(n_ids: int) -> np.dtype:
    """Little-endian unsigned type that holds ids below ``n_ids``."""
    return np.dtype("<u2" if n_ids <= 1 << 16 else "<u4")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and Python worker."""
    return Encoder(path)


def text_blocks(texts: list, budget: int = 1_000_000):
    """(start, end) runs of texts of about ``budget`` characters, so that a batch of long texts stays small."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= budget:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
