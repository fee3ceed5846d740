"""Operator 4: byte-level BPE encoding and decoding.

A text is cut at the special strings, then into pre-tokens by the public pattern. In each, the bytes form a doubly linked
list of symbols, and a heap holds the adjacent pairs by merge rank and place; an entry whose symbols have changed since is
stale and skipped. Merging takes n log n steps, also for a pre-token as long as the whole text. Decoding concatenates the
vocabulary's byte strings and reads them as UTF-8, with U+FFFD for what is not. Recent pre-tokens are kept in a cache of bounded size.

Null and empty texts have no tokens. Rows are independent: no shuffle, repeated rows give equal results, other columns are not
read, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE = 400_000
LONG = 64
_SPACE = r"\p{White_Space}"
#: Fixed value: the public pre-token pattern of this vocabulary.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?![^{_SPACE}])|{_SPACE}+"


def byte_letters() -> dict[int, str]:
    """The vocabulary's letter for each byte: printable Latin-1 stands for itself, the others for the letters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {b: chr(b) for b in own}
    return out | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in out)}


class ByteBpe(dict):
    """Encoder and decoder of one vocabulary; as a dict, the cache from pre-token to ids."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        top = max(*vocab.values(), *self.special.values())
        self.strings = [b""] * (top + 1)
        for text, i in vocab.items():
            self.strings[i] = bytes(byte_of[c] for c in text) if all(c in byte_of for c in text) else text.encode()
        for text, i in self.special.items():
            self.strings[i] = text.encode()
        self.decimal = [str(i) for i in range(top + 1)]
        self.first = [vocab[letters[b]] for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.cut = regex.compile(PATTERN).findall
        self.mark = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        sym = [self.first[b] for b in data]
        n = len(sym)
        if n < 2:
            return tuple(sym)
        merges, pop, push = self.merges, heapq.heappop, heapq.heappush
        right, left = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, m[1], sym[i], sym[i + 1]) for i in range(n - 1) if (m := merges.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = pop(heap)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # stale
            sym[i], sym[j] = new, -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if m := merges.get((new, sym[k])):
                    push(heap, (m[0], i, m[1], new, sym[k]))
            h = left[i]
            if h >= 0 and (m := merges.get((sym[h], new))):
                push(heap, (m[0], h, m[1], sym[h], new))
        return tuple(s for s in sym if s >= 0)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.merged(piece.encode())
        if len(piece) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if self.mark is None or not self.mark.search(text):
            return list(chain.from_iterable(map(self.__getitem__, self.cut(text))))
        out, at = [], 0
        for m in self.mark.finditer(text):
            out += chain.from_iterable(map(self.__getitem__, self.cut(text[at : m.start()])))
            out.append(self.special[m[0]])
            at = m.end()
        return out + list(chain.from_iterable(map(self.__getitem__, self.cut(text[at:]))))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """One per Python worker, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encoded(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, ids array<int>")


def decoded(df: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            texts = [bpe.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.select(key, "ids").mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, text string")


def digests(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", with_ids: bool = False, hold: bool = True) -> DataFrame:
    """Encodes and decodes every row in one pass and returns key, n_tokens, ids_sha256 and decoded_sha256, and the ids if asked for. hold: a worker keeps its cache for its next task; without, the memory is free for other operators' tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = loaded(path), hashlib.sha256
        decimal = bpe.decimal.__getitem__
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                n, one, two, every = [], [], [], []
                for t in part.column(1).to_pylist():
                    ids = bpe.encode(t or "")
                    n.append(len(ids))
                    if with_ids:
                        every.append(pa.array(ids, pa.int32()))
                    one.append(sha(",".join(map(decimal, ids)).encode()).hexdigest())
                    two.append(sha(bpe.decode(ids).encode()).hexdigest())
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
                if with_ids:
                    off = np.cumsum([0, *n]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(off), pa.concat_arrays([pa.array([], pa.int32()), *every])))
                yield pa.RecordBatch.from_arrays(columns, names)
        if not hold:
            bpe.clear()

    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string{', ids array<int>' if with_ids else ''}")


def op4_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    from tessera.llm.common import table

    return digests(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"))
