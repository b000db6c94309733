"""SentencePiece encoding and decoding by a forward pass over a trie of marked words.

A text's marked form (white space as U+2581, one in front) falls into marked words, and no piece spans two of
them. The distinct marked words of a batch are sorted, which is the depth-first order of their trie. The forward
pass keeps, for each prefix, its best last piece; a word reuses these over the prefix it shares with the word
before, so each node of the trie is computed once.

The scores follow the model's type, which its file states. For a unigram model the best last piece maximises the sum of the pieces' log probabilities (Viterbi).
The public model at hand is of type BPE, for which that sum gives other, wrong pieces: a BPE encoding is not the
one of the highest total. There the forward pass uses what determines BPE: a sequence of pieces is the encoding
of its text exactly if each piece encodes to itself and each adjacent pair encodes to itself, so the last piece of
a prefix is the one that is compatible with the last piece of the prefix before it, and it is unique. The ids
equal those of the SentencePiece library (tests hold both models' passes against brute force).

No shuffle. Words learnt are kept in each worker up to a limit, for later batches.

Defined cases: a null or empty text has no ids and decodes to an empty text; characters without a piece become
byte pieces; U+2581 in a text is indistinguishable from a blank, as in the library; very long words are encoded
like others but not kept; characters without a piece in a model without byte pieces are unknown, a run of them one
unknown id, as in the library; an empty table gives no rows; all columns of the table, of any name, come back in the
column `row`.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_path, named, nested, of_row

MARK = "▁"
PART = 1_500  # texts whose words a worker holds at a time
MARKED_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceTrie:
    """pieces: text -> (id, score). bytes_: the id of each byte piece, or None; then unknown characters get `unknown`."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bytes_: list[int] | None, unknown: int = 0, kind: str = "bpe", limit: int = 400_000):
        self.pieces, self.bytes_, self.unknown, self.kind, self.limit = pieces, bytes_, unknown, kind, limit
        self.longest = max(map(len, pieces), default=1)
        self.worst = min((s for _, s in pieces.values()), default=0.0) - 10
        self.pairs: dict[str, dict[str, bool]] = {}
        self.coded = {p: i.to_bytes(4, "little") for p, (i, _) in pieces.items()}
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The definition of BPE: the best pair, the leftmost of equals, is merged until none is left."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                found = self.pieces.get(parts[i] + parts[i + 1])
                if found and (best is None or found[1] > best[0]):
                    best = (found[1], i)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fits(self, before: str, piece: str) -> bool:
        """Whether `piece` may follow `before` ("" at the start) in an encoding."""
        return self.merged(before + piece) == ([before, piece] if before else [piece])

    def forward(self, words: list[str]):
        """(word, its pieces) of sorted words: depth first over their trie."""
        previous, last, score = "", [""], [0.0]
        follows = [self.pairs.setdefault("", {})]  # of each prefix: which pieces may follow its last one
        pieces, longest, viterbi, pairs = self.pieces, self.longest, self.kind == "unigram", self.pairs
        for w in words:
            shared, most = 0, min(len(previous), len(w))
            while shared < most and previous[shared] == w[shared]:
                shared += 1
            del last[shared + 1 :], score[shared + 1 :], follows[shared + 1 :]
            for end in range(shared + 1, len(w) + 1):
                if viterbi:
                    best, choice = score[end - 1] + self.worst, w[end - 1]
                    for start in range(max(0, end - longest), end):
                        found = pieces.get(w[start:end])
                        if found and score[start] + found[1] > best:
                            best, choice = score[start] + found[1], w[start:end]
                    score.append(best)
                    last.append(choice)
                    continue
                choice = w[end - 1]  # a character without a piece stands alone
                for start in range(end - longest if end > longest else 0, end):
                    piece = w[start:end]
                    if piece in pieces:
                        ok = follows[start].get(piece)
                        if ok is None:
                            ok = follows[start][piece] = self.fits(last[start], piece)
                        if ok:
                            choice = piece
                            break
                last.append(choice)
                row = pairs.get(choice)
                if row is None:
                    row = pairs[choice] = {}
                follows.append(row)
            out, end = [], len(w)
            while end:
                out.append(last[end])
                end -= len(last[end])
            previous = w
            yield w, out[::-1]

    def ids(self, parts: list[str]) -> bytes:
        coded = self.coded
        return b"".join([coded[p] if p in coded else self._unknown(p) for p in parts])

    def _unknown(self, char: str) -> bytes:
        return b"".join(self.bytes_[b].to_bytes(4, "little") for b in char.encode()) if self.bytes_ else self.unknown.to_bytes(4, "little")

    def _one_unknown(self, ids: np.ndarray) -> np.ndarray:
        """ids with each run of unknown ones as one."""
        again = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[np.concatenate([[True], ~again])] if again.any() else ids

    def encode(self, some: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [MARKED_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in some]
        if len(self.known) > self.limit:
            self.known.clear()
        if sum(map(len, self.pairs.values())) > 4 * self.limit:
            self.pairs.clear()
        known = self.known
        fresh = {w for s in split for w in s}.difference(known)
        long: dict[str, bytes] = {}
        for w, parts in self.forward(sorted(fresh)):
            (known if len(w) <= 64 else long)[w] = self.ids(parts)
        get = known.__getitem__ if not long else lambda w: known.get(w) or long[w]
        found = [np.frombuffer(b"".join(map(get, s)), "<i4") for s in split]
        return found if self.bytes_ else [self._one_unknown(x) for x in found]


_KEPT: dict[str, PieceTrie] = {}


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer: an int, or the bytes of a message or string."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, data[at : at + size]
            at += size


def model_type(path: str) -> str:
    """unigram, bpe, word or char: field 3 of the trainer's specification, which is field 2 of a model file."""
    with open(path, "rb") as f:
        spec = b"".join(v for n, v in _fields(f.read()) if n == 2)
    return {1: "unigram", 2: "bpe", 3: "word", 4: "char"}[next((v for n, v in _fields(spec) if n == 3), 1)]


def loaded(path: str) -> PieceTrie:
    """A model file's pieces, once for each worker."""
    if path not in _KEPT:
        import sentencepiece

        file = local_path(path)
        sp, kind = sentencepiece.SentencePieceProcessor(model_file=file), model_type(file)
        if kind not in ("unigram", "bpe"):
            raise ValueError(f"{path}: models of type {kind} aren't built")
        if sp.normalize("A éﬁ  b ") != f"{MARK}A{MARK}éﬁ{MARK}{MARK}b{MARK}":
            raise ValueError(f"{path}: only models with identity normalisation and a marked start are built")
        plain, bytes_ = {}, [-1] * 256
        for i in range(len(sp)):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                bytes_[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain[p] = (i, sp.get_score(i))
        if any(MARK in p[1:] and set(p) != {MARK} for p in plain):
            raise ValueError(f"{path}: a piece spans two words")
        _KEPT[path] = PieceTrie(plain, bytes_ if -1 not in bytes_ else None, sp.unk_id(), kind)
    return _KEPT[path]


def encoded(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """row (all of docs) and the ids of each whole text."""

    @F.pandas_udf("array<int>")
    def encode(column):
        import pandas as pd

        model = loaded(model_path)
        some = [x or "" for x in column]
        out = [ids for k in range(0, len(some), PART) for ids in model.encode(some[k : k + PART])]
        return pd.Series(out, dtype=object)

    return nested(docs).withColumn("ids", encode(of_row(text).cast("string")))


class PieceTexts:
    """Texts of ids: control pieces are empty, byte pieces are joined and decoded (what isn't UTF-8 as U+FFFD a byte)."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=local_path(path))
        self.texts = ["" if sp.is_control(i) else " ⁇ " if sp.is_unknown(i) else sp.id_to_piece(i) for i in range(len(sp))]
        self.bytes = {i: int(sp.id_to_piece(i)[3:5], 16) for i in range(len(sp)) if sp.is_byte(i)}
        self.is_byte = np.zeros(len(sp), dtype=bool)
        self.is_byte[list(self.bytes)] = True

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        get, out, at = self.texts.__getitem__, [], 0
        marks = np.flatnonzero(np.diff(np.concatenate([[0], self.is_byte[ids].astype(np.int8), [0]])))
        listed = ids.tolist()
        for a, b in zip(marks[::2].tolist(), marks[1::2].tolist()):
            out += map(get, listed[at:a])
            out.append(self._text(bytes(self.bytes[i] for i in listed[a:b])))
            at = b
        out += map(get, listed[at:])
        whole = "".join(out)
        return (whole[1:] if whole.startswith(MARK) else whole).replace(MARK, " ")

    @staticmethod
    def _text(data: bytes) -> str:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)


_DECODERS: dict[str, PieceTexts] = {}


def decoded(rows: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """row (all of rows) and `decoded`, the text of each list of ids (null: empty)."""

    @F.pandas_udf("string")
    def decode(column):
        import pandas as pd

        if model_path not in _DECODERS:
            _DECODERS[model_path] = PieceTexts(model_path)
        model = _DECODERS[model_path]
        return pd.Series([model.decode(np.asarray(x, dtype=np.int64)) if x is not None else "" for x in column])

    return nested(rows).withColumn("decoded", decode(of_row(ids)))


CHECKED = "n_ids long, ids array<int>, round_trip boolean"


def checked(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_ids, ids and round_trip (whether they decode to the text again) of each whole text: encoding and decoding
    in one pass over parts of PART rows, so that a worker holds few texts and ids at a time. A key named like one of these
    comes back as `key`."""
    kind, name = docs.schema[key].dataType.simpleString(), key if key not in ("n_ids", "ids", "round_trip") else "key"

    def run(batches):
        import pyarrow as pa

        model = loaded(model_path)
        if model_path not in _DECODERS:
            _DECODERS[model_path] = PieceTexts(model_path)
        back = _DECODERS[model_path]
        for batch in batches:
            for k in range(0, batch.num_rows, PART):
                part = batch.slice(k, PART)
                some = [x or "" for x in part.column(1).to_pylist()]
                ids = model.encode(some)
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                same = pa.array([back.decode(x) == t for x, t in zip(ids, some)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), lists, same], names=[name, "n_ids", "ids", "round_trip"])

    own = docs.select(named(key).alias("__key"), named(text).cast("string").alias("text"))
    return own.mapInArrow(run, f"`{name}` {kind}, {CHECKED}")
