"""Ids of a lower-casing word BPE (a tokenizers file) for whole texts, remembered word by word.

Such a tokenizer cuts a text at white space before anything else, so the ids of a text are those of its
words in order, and a word's ids are looked up once. A text that holds characters whose normalisation isn't
certain to be the same word by word (combining marks, unusual spaces, special tokens) goes to the tokenizer whole.
"""

from __future__ import annotations

import regex

from .common import local_path

#: The pattern by which the tokenizer cuts words: a fixed value of its file.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Letters and signs that lower-case one by one and are in composed form.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-įĲ-ž]*")


class WordIds:
    def __init__(self, path: str, limit: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ids = self.tokenizer.get_vocab()
        self.ends = {i for t, i in ids.items() if t.endswith("</w>")}
        self.limit, self.words, self.pieces = limit, {}, {}

    def _learn(self, words: list[str]) -> None:
        cut = {w: PIECES.findall(w) for w in words}
        fresh = list({p for ps in cut.values() for p in ps if p not in self.pieces})
        for k in range(0, len(fresh), 5_000):
            some, own = fresh[k : k + 5_000], []
            it = iter(some)
            for i in self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids:
                own.append(i)
                if i in self.ends:
                    self.pieces[next(it)] = b"".join(x.to_bytes(4, "little") for x in own)
                    own = []
        for w, ps in cut.items():
            self.words[w] = b"".join([self.pieces[p] for p in ps])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) > self.limit:
            self.words, self.pieces = {}, {}
        plain = [PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        split = [t.lower().split() if p else None for t, p in zip(texts, plain)]
        missing = {w for s in split if s for w in s}.difference(self.words)
        if missing:
            self._learn(list(missing))
        get, out = self.words.__getitem__, []
        for t, s in zip(texts, split):
            if s is None:
                out.append(b"".join(x.to_bytes(4, "little") for x in self.tokenizer.encode(t, add_special_tokens=False).ids))
            else:
                out.append(b"".join(map(get, s)))
        return out


_KEPT: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each worker process, so that what it has learnt serves later batches and tasks."""
    if path not in _KEPT:
        _KEPT[path] = WordIds(local_path(path))
    return _KEPT[path]
