"""Operator 2: token ids in a grammar-compressed binary format.

Encoding uses the public tokenizers library. White space separates its tokens and is dropped, so a text's ids are those of its
chunks between ASCII white space, one after the other. The distinct chunks of a part of a batch are found in Arrow; those of plain Latin letters, with ASCII signs behind
them or none, are lower-cased there and their distinct words go to the library's BPE model by the thousand. Other chunks of plain letters, digits and ASCII signs go to it
piece by piece, all others through the library's whole chain.

The ids of all documents in ascending id order, each closed by the end id, are dealt to ranges of document ids and there to
blocks of about BLOCK ids. A block is a grammar of its own, by Re-Pair: pairs of neighbouring symbols that repeat become nonterminals, never across a document's end, until
no pair occurs twice in the block. Symbols are linked, so only places whose pairs have changed are counted again. A round replaces all pairs that repeat, of overlapping
ones the more frequent one, so that rules are found in order of frequency wherever they compete.
The block's bytes hold the rules, the length of each rule's expansion, the symbols, and for each document its id, its last symbol and its number of ids: a document, or a position
in it, is expanded from its own symbols and the rules they lead to, without other documents' symbols; the block's rules are unpacked first, as a whole. Blocks are rows of a Parquet table in the shared folder, so any store that Spark writes will do.

Null and empty texts have the end id only. Null ids come first, in one block row or more; rows of equal id are ordered by their ids' bytes.
An empty table gives an empty file.

Block bytes, little endian: magic TRP2; seven uint32: documents, ids that occur, rules, symbols, bits a symbol, bytes of the rules' first symbols, bytes of the lengths; then int64 id
and uint8 "id is null" of each document, uint32 end symbol and uint32 ids of each document, uint32 ids that occur in ascending order; of all rules the first symbols, as differences from rule to
rule (int32, deflated), the lengths less two (uint32, deflated) and the second symbols; symbols. A symbol below the number of ids that occur stands for that one of them, others for
rules in order. Second symbols and symbols are uint16 of the low bits, then one bit plane for each higher bit.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import saved, shared_dir, table

END = 1
#: Stands for the end id at a document's end while pairs are replaced; the same id may occur inside a text.
STOP = 2**32 - 1
FREE = np.int32(2**31 - 1)
BLOCK = 1_000_000
#: Bytes of text whose chunks are encoded together, and words that the library gets at once.
PART = 1 << 25
WORDS = 4000
CACHE = 100_000
MAX_RANGES = 4096
_SAFE = re.compile("[!-~À-ÖØ-öø-ÿ]{1,64}").fullmatch
#: Fixed value: the public split pattern of this vocabulary, for chunks without white space.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
#: A word of plain letters, with signs or none behind it, which are one piece: what _SAFE takes, but for "<".
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_ALL = "".join(c for c in map(chr, range(65, 256)) if re.match(f"[{_LETTERS}]", c))
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "<")
_WORD = f"^[{_LETTERS}]{{1,56}}[{re.escape(_SIGNS)}]{{0,8}}$"


def _gathered(ids: np.ndarray, start: np.ndarray, size: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """The ranges of ids that begin at start, one after the other. Places are made for short ranges only, and for some of them at a time."""
    out, total = np.empty(int(size.sum()), ids.dtype), 0
    for k in range(0, len(size), step):
        begin, own = start[k : k + step], size[k : k + step]
        n = int(own.sum())
        if n > 64 * len(own):
            np.concatenate([ids[i : i + j] for i, j in zip(begin.tolist(), own.tolist())], out=out[total : total + n])
        else:
            at = np.repeat(begin - np.cumsum(own) + own, own)
            at += np.arange(n)
            np.take(ids, at, out=out[total : total + n], mode="clip")
        total += n
    return out


class Encoder:
    """From texts to their ids."""

    def __init__(self, path: str):
        import tokenizers

        from tessera.llm.bpe import byte_letters

        self.tool = tokenizers.Tokenizer.from_file(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        self.tokenize, self.letters = self.tool.model.tokenize, byte_letters()
        self.points = np.array([ord(self.letters[b]) if b != 32 else 32 for b in range(256)], "<u4")
        self.by_space = tokenizers.Tokenizer(self.tool.model)
        self.by_space.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
        self.size = self.tool.get_vocab_size()
        self.kind = "<u2" if self.size < 65536 else "<u4"
        self.code = "H" if self.size < 65536 else "I"
        #: Ids that end a word.
        suffix = self.tool.model.end_of_word_suffix
        self.closing = np.zeros(self.size, bool)
        self.closing[[i for t, i in self.tool.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        #: Of pieces of _SAFE chunks, and of chunks that are none: no text is both.
        self.known: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        plain = text if text.isascii() else "".join([self.letters[b] for b in text.encode()])
        return array(self.code, [t.id for t in self.tokenize(plain)]).tobytes()

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tool.encode(text, add_special_tokens=False).ids).tobytes()

    def kept(self, text: str, made: Callable[[str], bytes]) -> bytes:
        ids = self.known.get(text)
        if ids is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            ids = self.known[text] = made(text)
        return ids

    def chunk(self, text: str) -> bytes:
        """Ids of a chunk without ASCII white space."""
        if _SAFE(text) and "<|" not in text:
            return b"".join([self.kept(p, self.piece) for p in _PIECES(text.lower())])
        return self.kept(text, self.whole) if len(text) <= 96 else self.whole(text)

    def joined(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one after the other, and their number for each."""
        ids = np.frombuffer(b"".join(parts), self.kind)
        return ids, np.fromiter(map(len, parts), np.int64, len(parts)) // ids.itemsize

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case words of plain letters, one after the other, and their number for each."""
        out, sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), WORDS):
            part = words.slice(k, WORDS)
            raw = np.frombuffer(b" ".join(part.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint8)
            text = self.points[raw].tobytes().decode("utf-32-le")
            ids = np.array(self.by_space.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            size = np.diff(np.flatnonzero(self.closing[ids]), prepend=-1)
            if len(size) != len(part) or size.sum() != len(ids):  # a vocabulary that doesn't mark the ends of words
                ids, size = self.joined([self.piece(w) for w in part.to_pylist()])
            out.append(ids)
            sizes.append(size)
        return np.concatenate(out), np.concatenate(sizes)

    def chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size): those of chunk k are ids[start[k] : start[k] + size[k]]."""
        plain = pc.match_substring_regex(chunks, _WORD)
        some = chunks.filter(plain)
        words = pc.utf8_lower(pc.utf8_rtrim(some, _SIGNS)).dictionary_encode()
        signs = pc.utf8_ltrim(some, _ALL).dictionary_encode()
        ids, size = self.words(words.dictionary)
        behind, own = self.joined([self.kept(x, self.piece) if x else b"" for x in signs.dictionary.to_pylist()])
        ids, size = np.concatenate((ids, behind)), np.concatenate((size, own))
        part = np.stack((words.indices.to_numpy(), len(words.dictionary) + signs.indices.to_numpy()), axis=1).reshape(-1)
        start, size = (np.cumsum(size) - size)[part], size[part]
        mask = plain.to_numpy(zero_copy_only=False)
        other, own = self.joined([self.chunk(x) for x in chunks.filter(pc.invert(plain)).to_pylist()])
        sizes, starts = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        sizes[mask], sizes[~mask] = size[::2] + size[1::2], own
        ids = _gathered(ids, start, size)
        starts[mask], starts[~mask] = np.cumsum(sizes[mask]) - sizes[mask], len(ids) + np.cumsum(own) - own
        return np.concatenate((ids, other)), starts, sizes

    def texts(self, texts: pa.Array, rows: int = 500) -> Iterator[pa.Array]:
        """Ids of each text and the end id, as little-endian numbers of 2 or 4 bytes, in arrays of some rows; null is an empty text."""
        parts = pc.ascii_split_whitespace(texts.fill_null(""))
        words = parts.flatten().dictionary_encode()
        ids, start, size = self.chunks(words.dictionary)
        ids, start, size = np.append(ids, ids.dtype.type(END)), np.append(start, len(ids)), np.append(size, 1)
        index, edge = words.indices.to_numpy(), np.asarray(parts.offsets).astype(np.int64)
        edge -= edge[0]
        for k in range(0, len(texts), rows):
            ends = edge[k : k + rows + 1]
            at = np.insert(index[ends[0] : ends[-1]], ends[1:] - ends[0], len(size) - 1)  # each text is closed by the last entry
            own = size.take(at)
            got = _gathered(ids, start.take(at), own)
            stops = np.cumsum(own).take(ends[1:] - ends[0] + np.arange(len(ends) - 1)) * ids.itemsize
            offsets = np.concatenate(([0], stops)).astype(np.int64)
            yield pa.Array.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(got)]).cast(pa.binary())


_loaded: dict[str, Encoder] = {}


def loaded(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _groups(left: np.ndarray, right: np.ndarray, odd: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs that occur twice or more: all members, pair by pair in order, a member of each and the number of its members. The odd ones don't count. Symbols have bits bits."""
    size = max(1, (len(left) - 1).bit_length())
    key = left.astype(np.int64)
    if 2 * bits + size < 64:  # a value sort of pair and index in one number is faster than a sort of indexes
        key = np.delete((((key << bits) | right) << size) | np.arange(len(left)), odd)
        key.sort()
        order = key & ((1 << size) - 1)
        key >>= size
    else:
        key = (key << 32) | right
        order = np.delete(np.arange(len(left)), odd)
        order = order[np.argsort(key[order], kind="stable")]
        key = key[order]
    if not len(key):
        return order, order, order
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(begin, append=len(key))
    often = count > 1
    return order[np.repeat(often, count)], order[begin[often]], count[often]


def repair(seq: np.ndarray, first: int, stop: int = STOP) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule k is nonterminal first + k. Nothing but overlapping places of one pair occurs twice in the symbols; no pair holds the stop symbol.

    Only places whose pair still repeats, and those beside a new symbol, are looked at again. That is enough: a pair without a new symbol never gets more places, and a pair with one is new.
    """
    n = len(seq)
    sym = np.append(np.where(seq == stop, -1, seq.astype(np.int64)), -1).astype(np.int32)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[-1] = n
    alive, marked = np.ones(n + 1, bool), np.zeros(n + 1, bool)
    alive[n] = False
    rank = np.full(n + 1, FREE)  # of a place's pair in this round, the most frequent first; FREE for no candidate
    rules, total = [], 0
    at, left, right = np.arange(n), sym[:-1], sym[1:]
    while True:
        whole = np.flatnonzero((left | right) >= 0)
        at, left, right = at.take(whole), left.take(whole), right.take(whole)
        # Of places of one pair that overlap, as in a run of one id, every second one counts.
        twin = np.flatnonzero(left == right)
        index, place = np.arange(len(twin)), at.take(twin)
        again = np.zeros(len(twin), bool)
        again[1:] = after.take(place[:-1]) == place[1:]
        odd = twin[((index - np.maximum.accumulate(np.where(again, 0, index))) & 1) == 1]
        members, one, count = _groups(left, right, odd, max(1, (first + total).bit_length()))
        if not len(one):
            break
        pairs = np.stack((left.take(one), right.take(one)), axis=1)
        by_count = np.argsort(65535 - np.minimum(count, 65535).astype(np.uint16), kind="stable")
        number = np.empty(len(one), np.int32)
        number[by_count] = np.arange(len(one), dtype=np.int32)
        cand = at.take(members)
        rank[cand] = np.repeat(number, count)
        marked[cand] = True
        undecided = np.flatnonzero(marked)
        marked[at.take(odd)] = True
        won, of = [], []
        while len(undecided):
            mine, prior, later = rank.take(undecided), before.take(undecided), after.take(undecided)
            best = np.flatnonzero((mine < rank.take(prior)) & (mine <= rank.take(later)))
            now = undecided.take(best)
            won.append(now)
            of.append(mine.take(best))
            rank[now] = rank[prior.take(best)] = rank[later.take(best)] = FREE
            undecided = undecided.take(np.flatnonzero(rank.take(undecided) != FREE))
        cand, of = np.concatenate(won), by_count.take(np.concatenate(of))
        often = np.bincount(of, minlength=len(one)) > 1
        good = np.flatnonzero(often.take(of))
        cand, of = cand.take(good), of.take(good)
        gone = after.take(cand)
        sym[cand] = (np.cumsum(often) + (first + total - 1)).take(of)
        rules.append(pairs[often])
        total += len(rules[-1])
        alive[gone] = False
        beyond = after.take(gone)
        after[cand] = beyond
        before[beyond] = cand
        # Pairs that repeated and are still there, and those around a new symbol.
        marked[cand] = True
        marked[before.take(cand)] = True
        marked &= alive
        at = np.flatnonzero(marked)
        marked[:] = False
        left, right = sym.take(at), sym.take(after.take(at))
    out = sym[:n][alive[:n]].astype(np.int64)
    return np.where(out < 0, stop, out), np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def expansions(rules: np.ndarray, first: int) -> np.ndarray:
    """The length of each rule's expansion: those of its two symbols, which are ids or earlier rules."""
    size = np.ones(first + len(rules), np.int64)
    left = np.arange(len(rules))
    known = np.zeros(first + len(rules), bool)
    known[:first] = True
    while len(left):
        ready = known[rules[left, 0]] & known[rules[left, 1]]
        k = left[ready]
        size[first + k] = size[rules[k, 0]] + size[rules[k, 1]]
        known[first + k] = True
        left = left[~ready]
    return size


def _planes(x: np.ndarray, bits: int) -> bytes:
    x = x.reshape(-1).astype(np.uint32)
    return b"".join([(x & 0xFFFF).astype("<u2").tobytes(), *(np.packbits((x >> b) & 1 == 1).tobytes() for b in range(16, bits))])


class Planes:
    """Random access to numbers written by _planes."""

    def __init__(self, data: memoryview, at: int, n: int, bits: int):
        self.low = np.frombuffer(data, "<u2", n, at)
        size = -(-n // 8)
        self.high = [np.frombuffer(data, np.uint8, size, at + 2 * n + k * size) for k in range(max(0, bits - 16))]
        self.end = at + 2 * n + size * len(self.high)

    def __getitem__(self, part: slice) -> np.ndarray:
        i, j = part.start, part.stop
        out = self.low[i:j].astype(np.int64)
        for b, plane in enumerate(self.high):
            out |= np.unpackbits(plane[i // 8 : -(-j // 8)])[i % 8 : i % 8 + j - i].astype(np.int64) << (16 + b)
        return out


def packed(ids: np.ndarray, doc_ids: list, counts: np.ndarray) -> bytes:
    """The bytes of a block."""
    seen = np.zeros(max(int(ids.max(initial=0)), END) + 1, bool)
    seen[ids] = seen[END] = True
    used = np.flatnonzero(seen)
    ids = (np.cumsum(seen) - 1).astype(np.uint32)[ids]
    ids[np.cumsum(counts) - 1] = STOP
    seq, rules = repair(ids, len(used))
    ends = np.flatnonzero(seq == STOP) + 1
    seq[ends - 1] = np.searchsorted(used, END)
    bits = max(16, (len(used) + len(rules) - 1).bit_length())
    lengths = zlib.compress((expansions(rules, len(used))[len(used) :] - 2).astype("<u4").tobytes(), 2)
    left = zlib.compress(np.diff(rules[:, 0], prepend=0).astype("<i4").tobytes(), 2)  # a round's rules are in order of their pairs
    return b"".join(
        (
            struct.pack("<4s7I", b"TRP2", len(doc_ids), len(used), len(rules), len(seq), bits, len(left), len(lengths)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            ends.astype("<u4").tobytes(),
            counts.astype("<u4").tobytes(),
            used.astype("<u4").tobytes(),
            left,
            lengths,
            _planes(rules[:, 1], bits),
            _planes(seq, bits),
        )
    )


class Block:
    """Random access to a block's documents."""

    def __init__(self, data: bytes | memoryview):
        magic, docs, used, self.n_rules, self.n_symbols, bits, *size = struct.unpack_from("<4s7I", data)
        if magic != b"TRP2":
            raise ValueError("not a block of token ids")
        at = 32

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, null = take(docs, "<i8"), take(docs, "u1")
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null)]
        self.ends, self.counts, self.used = take(docs, "<u4"), take(docs, "<u4"), take(used, "<u4")
        self.first = used
        self._left, self._lengths = bytes(data[at : at + size[0]]), bytes(data[at + size[0] : at + sum(size)])
        self.right = Planes(data, at + sum(size), self.n_rules, bits)
        self.symbols = Planes(data, self.right.end, self.n_symbols, bits)
        self._size = self._first = None

    @property
    def size(self) -> np.ndarray:
        """How many ids each symbol stands for."""
        if self._size is None:
            self._size = np.concatenate((np.ones(self.first, np.int64), np.frombuffer(zlib.decompress(self._lengths), "<u4").astype(np.int64) + 2))
        return self._size

    @property
    def left(self) -> np.ndarray:
        """The first symbol of each rule."""
        if self._first is None:
            self._first = np.cumsum(np.frombuffer(zlib.decompress(self._left), "<i4"), dtype=np.int64)
        return self._first

    def span(self, i: int, j: int) -> np.ndarray:
        """Ids of documents i to j, by putting its pair in the place of every nonterminal until none is left."""
        seq = self.symbols[slice(int(self.ends[i - 1]) if i else 0, int(self.ends[j - 1]) if j else 0)]
        right = self.right[0 : self.n_rules]
        out, at = np.empty(int(self.size[seq].sum()), np.int64), np.cumsum(self.size[seq]) - self.size[seq]
        while len(seq):
            plain = seq < self.first
            out[at[plain]] = seq[plain]
            seq, at = seq[~plain], at[~plain]
            rule = seq - self.first
            first = self.left[rule]
            at = np.stack((at, at + self.size[first]), axis=1).reshape(-1)
            seq = np.stack((first, right[rule]), axis=1).reshape(-1)
        return self.used[out]

    def document(self, k: int) -> np.ndarray:
        return self.span(k, k + 1)

    def at(self, k: int, position: int) -> int:
        """The id at a position of document k: lengths lead to the symbol, and down its rules to the id."""
        if not 0 <= position < int(self.counts[k]):
            raise IndexError(position)
        seq = self.symbols[slice(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))]
        ends = np.cumsum(self.size[seq])
        n = int(np.searchsorted(ends, position, "right"))
        symbol, position = int(seq[n]), position - int(ends[n] - self.size[seq[n]])
        while symbol >= self.first:
            rule = symbol - self.first
            a, b = int(self.left[rule]), int(self.right[rule : rule + 1][0])
            symbol, position = (a, position) if position < self.size[a] else (b, position - int(self.size[a]))
        return int(self.used[symbol])


def write(df: DataFrame, path: str, where: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes df and writes its blocks; returns the table of blocks (pid, seq, start, n_ids, block), start counted in its range pid."""
    spark = df.sparkSession
    ranges = min(MAX_RANGES, max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
    probes = [k / ranges for k in range(1, ranges)]
    bounds = (df.agg(F.percentile_approx(key, probes, 10 * ranges).alias("b")).first()["b"] or []) if probes else []  # at most MAX_RANGES numbers

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, edge = loaded(path), np.array(bounds, np.int64)
        for b in batches:
            doc = b.column(0).cast(pa.int64())
            pid = np.searchsorted(edge, doc.fill_null(-(2**63)).to_numpy(zero_copy_only=False), "left").astype(np.int32)
            size = np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            k = 0
            while k < b.num_rows:
                end = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + PART, "right")))
                for ids in tool.texts(b.column(1).slice(k, end - k)):
                    yield pa.RecordBatch.from_arrays([pa.array(pid[k : k + len(ids)]), doc.slice(k, len(ids)), ids], ["pid", "doc_id", "ids"])
                    k += len(ids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = loaded(path).kind
        state = {"pid": None, "seq": 0, "start": 0}
        docs, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, ids, held
            counts = np.array([len(x) for x in ids], np.int64)
            row = [state["pid"], state["seq"], state["start"], int(counts.sum()), packed(np.concatenate(ids), docs, counts)]
            state["seq"] += 1
            state["start"] += row[3]
            docs, ids, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["pid", "seq", "start", "n_ids", "block"])

        for b in batches:
            for pid, doc, raw in zip(*(b.column(k).to_pylist() for k in range(3))):
                if pid != state["pid"]:
                    if docs:
                        yield flush()
                    state = {"pid": pid, "seq": 0, "start": 0}
                docs.append(doc)
                ids.append(np.frombuffer(raw, kind))
                held += len(ids[-1])
                if held >= BLOCK:
                    yield flush()
        if docs:
            yield flush()

    rows = df.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(encode, "pid int, doc_id long, ids binary")
    blocks = rows.repartition("pid").sortWithinPartitions("pid", "doc_id", "ids").mapInArrow(pack, "pid int, seq int, start long, n_ids long, block binary")
    return saved(blocks, where)


def read(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of a table of blocks."""
    totals = blocks.groupBy("pid").agg(F.sum("n_ids").alias("_n"))  # at most MAX_RANGES rows
    offset = totals.select("pid", (F.sum("_n").over(Window.orderBy("pid")) - F.col("_n")).alias("_before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, data in zip(b.column(0).to_pylist(), b.column(1)):
                block = Block(memoryview(data.as_buffer()))
                ids = block.span(0, len(block.doc_ids)).astype("<u4")
                edge = np.concatenate(([0], np.cumsum(block.counts, dtype=np.int64)))
                crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.doc_ids, pa.int64()), pa.array(edge[:-1] + begin), pa.array(np.diff(edge)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return blocks.join(F.broadcast(offset), "pid").select((F.col("start") + F.col("_before")).alias("begin"), "block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_tokenfile(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    path = path or public_tokenizers.path("word_bpe_49k.json")
    return read(write(table(spark, sf_dir, "documents"), path, f"{shared_dir(spark)}/blocks"))
