"""Operator 13: encoding and decoding with a SentencePiece vocabulary of merge type.

A text gets its dummy prefix and white-space marks. Its characters form a doubly linked list of symbols; an agenda holds the
adjacent pairs that are a piece, by score and then by place, and an entry whose symbols have changed since is stale and skipped.
What is no piece in the end becomes its bytes, or the unknown id where the vocabulary has no bytes; unused pieces are taken apart again.
Before that, texts are cut where no piece of the vocabulary reaches across, which the loader proves from the pieces, so that
the agenda of a part is that of the whole, and parts can be kept in a cache of bounded size. A part without such a place, however long, takes n log n steps.

Each Arrow batch is also encoded and decoded by the sentencepiece library, and the column agrees tells whether ids and text are the same.

Null and empty texts have the begin and end ids only. Rows are independent: no shuffle, repeated rows give equal results, other
columns are not read, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from itertools import groupby
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of each of two generations of the cache.
CACHE = 750_000
PLACE = (1 << 32) - 1
SHORT, NEVER = 32, 1 << 31
LONG = 64
BATCH = 200
SPACE = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Fixed value: the type of models whose pieces come from merges.
MERGES = 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message; messages, strings and floats come as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(wire) or varint()
        yield number, data[at : at + size]
        at += size


class Pieces(dict):
    """Encoder and decoder of one vocabulary; as a dict, the cache from a part of a text to its ids as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__()
        self.before: dict[str, bytes] = {}
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        trainer = dict(fields(next((v for k, v in model if k == 2), b"")))
        rules = dict(fields(next((v for k, v in model if k == 3), b"")))
        if trainer.get(3, 1) != MERGES:
            raise ValueError("the model's pieces don't come from merges")
        if rules.get(2) or rules.get(4, 1) or trainer.get(24, 0) or not rules.get(5, 1):
            raise ValueError("only models that keep characters and white space as they are can be read")
        self.prefix = SPACE if rules.get(3, 1) else ""
        self.bytes_, self.unknown = bool(trainer.get(35, 0)), trainer.get(40, 0)
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        blank = trainer.get(44, b" \xe2\x81\x87 ")
        self.id, self.score, self.kind, self.own, self.text = {}, [], [], {}, []
        byte_at = {}
        for k, v in model:
            if k == 1:
                p = dict(fields(v))
                piece, kind, i = p[1].decode(), p.get(3, NORMAL), len(self.kind)
                self.kind.append(kind)
                self.score.append(struct.unpack("<f", p.get(2, bytes(4)))[0])
                (self.id if kind in (NORMAL, USER, UNUSED) else self.own)[piece] = i
                if kind == BYTE:
                    byte_at[i] = int(piece[3:5], 16)
                self.text.append(bytes([byte_at[i]]) if kind == BYTE else b"" if kind == CONTROL else blank if kind == UNKNOWN else piece.replace(SPACE, " ").encode())
        self.control = {i for i, k in enumerate(self.kind) if k == CONTROL}
        self.byte_id = {b: i for i, b in byte_at.items()}
        self.packed = [struct.pack("<I", i) for i in range(len(self.kind))]
        frozen = sorted((p for p, i in self.id.items() if self.kind[i] == USER), key=len, reverse=True)
        self.symbols = re.compile("|".join([*map(re.escape, frozen), "(?s:.)"])).findall
        self.frozen = set(frozen)
        place = {x: k for k, x in enumerate(sorted({-self.score[i] for i in self.id.values()}))}
        self.rank = {p: place[-self.score[i]] for p, i in self.id.items()}
        self.unused = UNUSED in self.kind
        self.plain = {p: i for p, i in self.id.items() if p not in self.own and self.kind[i] != UNUSED}
        self.cut = self._cut()

    def _cut(self):
        """The finder of the parts of a text. Parts are marks and the letters or other characters after them, if no piece holds a mark after another character or letters beside others;
        else marks and what is up to the next; else the whole."""
        bodies = [p.lstrip(SPACE) for p in self.id]
        if any(SPACE in b for b in bodies):
            return re.compile("(?s:.+)").findall
        letters = {c for b in bodies if len(b) > 1 for c in b if c.isalpha()}
        rest = {c for b in bodies if len(b) > 1 for c in b} - letters
        lead = {b for p, b in zip(self.id, bodies) if len(p) > len(b)} - {""}
        letters |= {c for b in lead for c in b if c.isalpha()}
        rest |= {c for b in lead for c in b if not c.isalpha()}
        if any({c in letters for c in b} == {True, False} for b in bodies):
            return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        one = "".join(map(re.escape, sorted(letters)))
        two = "".join(map(re.escape, sorted(rest)))
        kinds = [f"{SPACE}*[{c}]+" for c in (one, two) if c]
        return re.compile("|".join([*kinds, f"{SPACE}+", "(?s:.)"])).findall

    def merged(self, part: str) -> list[int]:
        """Ids of one part. An entry of the agenda is the rank of a piece's score and the place where the piece would begin, in one number. The agenda of a short part is a plain list, without stale entries."""
        if len(part) <= SHORT and not self.frozen and not self.unused:
            return self._merged_short(part)
        sym = self.symbols(part) if self.frozen else list(part)
        n, rank, made, pop, push = len(sym), self.rank, {}, heapq.heappop, heapq.heappush
        right, left = [*range(1, n), -1], [*range(-1, n - 1)]
        agenda = [r << 32 | i for i, r in enumerate(map(rank.get, map(add, sym, sym[1:]))) if r is not None]
        if self.frozen:
            agenda = [e for e in agenda if not self.frozen.intersection(sym[e & PLACE : (e & PLACE) + 2])]
        heapq.heapify(agenda)
        while agenda:
            e = pop(agenda)
            i = e & PLACE
            j = right[i]
            if j < 0 or sym[i] is None:
                continue  # stale
            new = sym[i] + sym[j]
            if rank.get(new) != e >> 32:
                continue  # stale
            if self.unused:
                made[new] = (sym[i], sym[j])
            sym[i], sym[j] = new, None
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (r := rank.get(new + sym[k])) is not None and sym[k] not in self.frozen:
                    push(agenda, r << 32 | i)
            h = left[i]
            if h >= 0 and (r := rank.get(sym[h] + new)) is not None and sym[h] not in self.frozen:
                push(agenda, r << 32 | h)
        ids = self.plain.get
        out: list[int] = []
        for s in sym:
            if s is not None:
                if (i := ids(s)) is not None:
                    out.append(i)
                else:
                    self._found(s, made, out)
        return out

    def _merged_short(self, part: str) -> list[int]:
        sym, rank = list(part), self.rank.get
        agenda = [rank(p, NEVER) for p in map(add, sym, part[1:])]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)  # of equal ones the first
            new = sym[i] = sym[i] + sym.pop(i + 1)
            agenda.pop(i)
            if i < len(agenda):
                agenda[i] = rank(new + sym[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank(sym[i - 1] + new, NEVER)
        try:
            return [self.plain[s] for s in sym]
        except KeyError:
            out: list[int] = []
            for s in sym:
                self._found(s, {}, out)
            return out

    def _found(self, piece: str, made: dict, out: list[int]) -> None:
        i = self.own.get(piece, self.id.get(piece, self.unknown))
        if self.kind[i] == UNUSED and piece in made:
            for part in made[piece]:
                self._found(part, made, out)
        elif i == self.unknown and self.bytes_:
            out += [self.byte_id[b] for b in piece.encode()]
        else:
            out.append(i)

    def __missing__(self, part: str) -> bytes:
        ids = self.before.get(part)
        if ids is None:
            ids = b"".join(map(self.packed.__getitem__, self.merged(part)))
        if len(part) <= LONG:
            if len(self) >= CACHE:
                self.before = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids, begin and end among them, as little-endian 32-bit numbers."""
        body = b""
        if text:
            body = b"".join(map(self.__getitem__, self.cut(self.prefix + text.replace(" ", SPACE))))
            if not self.bytes_:
                ids = np.frombuffer(body, "<u4")  # neighbours that are unknown share one id
                body = ids[~((ids == self.unknown) & (np.r_[-1, ids[:-1].astype(int)] == self.unknown))].tobytes()
        return self.packed[self.begin] + body + self.packed[self.end]

    def decode(self, ids: list[int]) -> str:
        """Pieces one after the other, runs of bytes read as UTF-8 with U+FFFD for each byte that is not; the dummy prefix goes."""
        kind, parts = self.kind, list(map(self.text.__getitem__, ids))
        if self.prefix:
            first = next((k for k, i in enumerate(ids) if kind[i] != CONTROL), None)
            if first is not None and kind[ids[first]] in (NORMAL, USER, UNUSED):
                parts[first] = parts[first].removeprefix(b" ")
        if self.control.isdisjoint(ids[1:-1]):  # else one may stand between bytes, which then are no character
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        runs = groupby(zip(ids, parts), lambda x: kind[x[0]] == BYTE)
        return "".join((_characters if is_byte else bytes.decode)(b"".join(p for _, p in run)) for is_byte, run in runs)


def _characters(data: bytes) -> str:
    """UTF-8, with one U+FFFD for each byte that is not part of a character."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            at += 1
    return "".join(out)


_loaded: dict[str, tuple[Pieces, object]] = {}


def loaded(path: str) -> tuple[Pieces, object]:
    """The vocabulary and the library's processor, one per Python worker, kept between tasks."""
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for b in batches:
        for k in range(0, b.num_rows, BATCH):
            part = b.slice(k, BATCH)
            yield part.column(0), [t or "" for t in part.column(1).to_pylist()]


def encoded(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids, agrees) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, library = loaded(path)
        for keys, texts in _slices(batches):
            ids = [np.frombuffer(pieces.encode(t), "<u4") for t in texts]
            agrees = [x.tolist() == y for x, y in zip(ids, library.encode(texts, add_bos=True, add_eos=True, num_threads=1))]
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32())), pa.array(agrees)], [key, "ids", "agrees"])

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, ids array<int>, agrees boolean")


def decoded(df: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, text, agrees) from (key, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, library = loaded(path)
        for b in batches:
            ids = [x or [] for x in b.column(1).to_pylist()]
            texts = [pieces.decode(x) for x in ids]
            agrees = [t == library.decode(x) for t, x in zip(texts, ids)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(agrees)], [key, "text", "agrees"])

    return df.select(F.col(f"`{key}`"), "ids").mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, text string, agrees boolean")


def digests(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes and decodes every row in one pass: key, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256, and agrees, whether the library's ids and text are the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, library = loaded(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for keys, texts in _slices(batches):
            packed = [pieces.encode(t) for t in texts]
            ids = [np.frombuffer(p, "<u4").tolist() for p in packed]
            back = [pieces.decode(x) for x in ids]
            same = [x == y.astype("<u4").tobytes() and t == u for x, y, t, u in zip(packed, library.encode_as_numpy(texts, add_bos=True, add_eos=True, num_threads=1), back, library.decode(ids, num_threads=1))]
            columns = [keys, pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(p) for p in packed], pa.string()), pa.array([sha(t.encode()) for t in back], pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", "agrees"]
    schema = f"`{key}` {dict(df.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def op13_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    from tessera.llm.common import table

    return digests(table(spark, sf_dir, "documents"), path or public_tokenizers.path("piece_bpe_32k.model"))
