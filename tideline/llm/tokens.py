"""Token ids of many texts, each distinct word looked up once.

With a vocabulary that marks word ends and drops white space, the ids of a text are the
ids of its words one after the other.  So a chunk's words are found by hash in a table
of words seen by this worker, and only new ones are split and encoded, a few hundred to a
call.  The table keeps the words' bytes: each word found is compared with them, and where
any differs, all words of the chunk are encoded without the table.  Words with characters
outside ASCII and Latin letters go through the whole tokenizer.  The table is emptied when
full.
"""

from __future__ import annotations

import os
import re

import numpy as np

from . import common as C

MOST_WORDS, MOST_BYTES = 500_000, 16 << 20
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_OPEN: dict[str, "WordTokenizer"] = {}


def tokenizer_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """For tokenizers with a lower-casing normaliser and the suffix </w> at word ends."""

    #: Fixed by the vocabulary: how it cuts words into pieces.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for word, i in vocab.items():
            self.ends[i] = word.endswith("</w>")
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.split = regex.compile(self.PIECES).findall
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.spelt, self.spell, self.letters = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def _encode_pieces(self, new: list[str]) -> dict[str, bytes]:
        have: dict[str, bytes] = {}
        for k in range(0, len(new), 500):
            part = new[k : k + 500]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                a = 0
                for piece, b in zip(part, cuts.tolist()):
                    have[piece] = ids[a:b].tobytes()
                    a = b
            else:  # not one word end a piece: take them one by one
                for piece in part:
                    have[piece] = self._slow(piece)
        return have

    def _slow(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        plain = [PLAIN.fullmatch(w) is not None and "<|" not in w for w in words]
        cut = [self.split(w.lower()) if ok else None for w, ok in zip(words, plain)]
        have = self._encode_pieces(list({p for c in cut if c for p in c}))
        return [
            self._slow(w) if c is None else have[c[0]] if len(c) == 1 else b"".join([have[p] for p in c])
            for w, c in zip(words, cut)
        ]

    def chunk(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        unique, at, inverse = np.unique(C.hash_words(data, starts, ends, C.BASES[0]), return_index=True, return_inverse=True)
        length = ends - starts
        one_each = (length == length[at][inverse]).all() and C.same_words(data, starts, data, starts[at][inverse], length)
        if len(self.keys) > MOST_WORDS or len(self.letters) > MOST_BYTES:
            self.clear()
        place = np.searchsorted(self.keys, unique)
        near = np.minimum(place, max(len(self.keys) - 1, 0))
        known = self.keys[near] == unique if len(self.keys) else np.zeros(len(unique), bool)
        old, here = near[known], at[known]
        as_known = (self.spell[old] == length[here]).all() and C.same_words(self.letters, self.spelt[old], data, starts[here], length[here])
        if not (one_each and as_known):  # two words under one hash: leave the table out
            whole = data.tobytes()
            got = self.encode_words([whole[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())])
            return np.frombuffer(b"".join(got), np.uint32), np.array([len(x) // 4 for x in got])
        new = np.flatnonzero(~known)
        if len(new):
            whole = data.tobytes()
            words = [whole[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())]
            got = self.encode_words([w.decode() for w in words])
            size, spell = np.fromiter((len(x) // 4 for x in got), np.int64, len(got)), length[at[new]]
            begin, spelt = len(self.flat) + np.cumsum(size) - size, len(self.letters) + np.cumsum(spell) - spell
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(got), np.uint32)])
            self.letters = np.concatenate([self.letters, np.frombuffer(b"".join(words), np.uint8)])
            for name, value in (("keys", unique[new]), ("begin", begin), ("size", size), ("spelt", spelt), ("spell", spell)):
                setattr(self, name, np.insert(getattr(self, name), place[new], value))
            place = np.searchsorted(self.keys, unique)
        begin, size = self.begin[place][inverse], self.size[place][inverse]
        index = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.flat[index], size


def word_tokenizer(name: str) -> WordTokenizer:
    """One for each worker process, kept between tasks."""
    if name not in _OPEN:
        _OPEN[name] = WordTokenizer(tokenizer_path(name))
    return _OPEN[name]
