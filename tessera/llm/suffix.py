"""Operator 6: removes every byte covered by a 200-byte string that also starts anywhere else.

Which suffixes must be sorted together is settled first. Every 200-byte window has an anchor, its 64-byte substring of least
hash; equal windows have equal anchors. Consecutive windows with one anchor form a segment. Segments meet by the hash of
their anchor, read as a sorted stream: an anchor that occurs once matches nothing; equal segments match as a whole, and only one of them goes
on; only anchors with several different segments need their suffixes sorted. These segments, one of each kind, are dealt to shards, as many as their bytes ask for, and a
shard's suffixes are sorted by external induced sorting (see induced). Its pieces, their suffixes and their order keep to a memory limit, also those
of one anchor, and are in temporary files beyond it.
Neighbours in the order with a common prefix of 200 bytes or more match. Matches are judged on the input only.

Null and empty texts and texts under 200 bytes lose nothing. Rows that repeat are copies, so all their windows match. Rows are told apart by
doc_id and a 64-bit hash of the text; segments by 128 bits. Other columns are not read but for those asked for, of any names; one that is named like a
result is left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textvec
from tessera.llm.common import saved, shared_dir, table
from tessera.llm.induced import MEMORY, Sink, array, spans, suffix_order

LENGTH = 200
GRAM = 64
#: Bytes of pieces a shard has on average; a task sorts one shard after the other. One anchor's pieces are in one shard, however many.
SHARD_BYTES = 80_000
_COLUMNS = ["anchor", "seg", "doc_id", "th", "start", "n"]
_OCCURRENCE = "anchor long, seg long, doc_id long, th long, start int, n int"
_RANGE = "doc_id long, th long, start int, n int"
_SALT = np.random.Generator(np.random.PCG64(6)).integers(1, 2**63, 256, dtype=np.uint64)


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive values: the better of a block's tail and the next block's head."""
    n = len(x)
    size = -(-n // w) * w
    full = np.full(size, np.uint64(2**64 - 1))
    full[:n] = x
    rows = full.reshape(-1, w)
    head = np.minimum.accumulate(rows, axis=1).reshape(-1)
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def segments(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """Of all texts of a block: row, first window (its place in the text), number of windows, anchor hash and segment hash of each segment."""
    n = len(data)
    empty = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    if n < length:
        return empty
    with np.errstate(over="ignore"):
        power, inverse = textvec.powers(n + 1), textvec.powers(n + 1, textvec.INVERSE)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_SALT[data] * power[:n], out=total[1:])
        g = textvec.mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
        bits = np.uint64(max(1, (n - 1).bit_length()))
        keyed = ((g >> bits) << bits) | np.arange(len(g), dtype=np.uint64)
        anchor = (_sliding_least(keyed, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(anchor)]
        inside = np.arange(len(anchor)) + length <= off[1:][row]
        at = np.flatnonzero(inside)
        if not len(at):
            return empty
        anchor, row = anchor[at], row[at]
        new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))))
        count = np.diff(np.append(new, len(at)))
        first = at[new]
        end = first + count - 1 + length
        seg = textvec.mix((total[end] - total[first]) * inverse[first] + count.astype(np.uint64) * textvec.BASE + (anchor[new] - first).astype(np.uint64))
        return [row[new], first - off[row[new]], count, g[anchor[new]], seg]


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, _, data, off in textvec.blocks(b.column(2)):
            row, start, n, anchor, seg = segments(data, off)
            at = pa.array(row + i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(textvec.signed(anchor)), pa.array(textvec.signed(seg)), b.column(0).take(at), b.column(1).take(at), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], _COLUMNS
            )


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a stream sorted by anchor and segment: kind 0, occurrences whose segment occurs again; kind 1, one of each segment of an anchor that has several.

    From batch to batch at most two rows are carried: the first of the last segment, and one that stands for the anchor's other segments.
    """
    carry: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        zero = pa.array(np.zeros(b.num_rows, np.int8))
        t = pa.Table.from_arrays([*b.columns, pa.array(np.ones(b.num_rows, np.int8)), zero, zero], [*_COLUMNS, "c", "done0", "done1"])
        if carry is not None:
            t = pa.concat_tables([carry, t])
        anchor, seg = t["anchor"].to_numpy(), t["seg"].to_numpy()
        c, done0, done1 = (t[k].to_numpy().astype(np.int64) for k in ("c", "done0", "done1"))
        new_a = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        new_s = new_a | np.concatenate(([True], seg[1:] != seg[:-1]))
        first = np.flatnonzero(new_s)
        s_of = np.cumsum(new_s) - 1
        total = np.add.reduceat(c, first)
        a_of_s = (np.cumsum(new_a) - 1)[first]
        several = np.bincount(a_of_s)[a_of_s] > 1
        zero_out = np.flatnonzero((total[s_of] > 1) & (done0 == 0))
        one_out = first[several & (done1[first] == 0)]
        kind = np.concatenate((np.zeros(len(zero_out), np.int8), np.ones(len(one_out), np.int8)))
        yield pa.RecordBatch.from_arrays([pa.array(kind), *(x.combine_chunks() for x in t.select(_COLUMNS).take(pa.array(np.concatenate((zero_out, one_out)))).columns)], ["kind", *_COLUMNS])
        last = first[-1]
        keep = [int(last)]
        if several[-1]:
            keep.insert(0, int(first[-2]))
        carry = t.take(pa.array(keep))
        flags = [np.array([min(2, int(total[s_of[k]])) for k in keep], np.int8), np.array([int(total[s_of[k]] > 1) for k in keep], np.int8), np.array([int(several[-1])] * len(keep), np.int8)]
        for name, values in zip(("c", "done0", "done1"), flags):
            carry = carry.set_column(carry.schema.get_field_index(name), name, pa.array(values))


def repeats(text: np.ndarray, begin: np.ndarray, windows: np.ndarray, length: int = LENGTH, most: int = MEMORY) -> np.ndarray:
    """Whether each place of text is among the first windows[k] places from a begin[k], and its string of length symbols also starts at another such place."""
    order = suffix_order(text, most)
    valid, found = array(len(text), bool, most), array(len(text), bool, most)
    for k in spans(len(begin), most):
        for at, n in zip(begin[k].tolist(), windows[k].tolist()):
            valid[at : at + n] = True
    last = np.zeros(0, np.int64)
    for part in spans(len(text), most):
        places = np.array(order[part])
        places = np.concatenate((last, places[valid[places]]))
        same = np.arange(len(places) - 1)
        for k in range(length):  # the shared prefix of neighbours, for those that have come this far
            if not len(same):
                break
            same = same[text[places[same] + k] == text[places[same + 1] + k]]
        found[places[same]] = True
        found[places[same + 1]] = True
        last = places[-1:]
    return found


class Shard:
    """Pieces of a shard one after the other, with their rows: in memory up to most bytes, in temporary files beyond."""

    def __init__(self, most: int):
        self.most, self.text = most, Sink(np.uint16, most)
        self.rows = [Sink(np.int64, most) for _ in range(6)]

    def add(self, doc: int | None, th: int, start: int, n: int, piece: bytes) -> None:
        row = (self.text.size, n, doc or 0, doc is None, th, start)
        for sink, value in zip(self.rows, row):
            sink.add(np.array([value]))
        symbols = np.ones(len(piece) + 1, np.uint16)
        symbols[:-1] = np.frombuffer(piece, np.uint8)
        symbols[:-1] += 2
        self.text.add(symbols)

    def matches(self) -> Iterator[pa.RecordBatch]:
        """(doc_id, th, start, n) of the runs of matching windows."""
        self.text.add(np.zeros(1, np.uint16))
        begin, windows, doc, null, th, start = (s.array() for s in self.rows)
        found = repeats(self.text.array(), begin, windows, LENGTH, self.most)
        for part in spans(len(begin), 10_000):
            out = [
                (None if no else d, t, s + i, n)
                for at, w, d, no, t, s in zip(*(c[part].tolist() for c in (begin, windows, doc, null, th, start)))
                if (flags := found[at : at + w]).any()
                for i, n in _runs(flags)
            ]
            cols = [*zip(*out)] or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "th", "start", "n"])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(int(i), int(j - i)) for i, j in zip(edge[::2], edge[1::2])]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, doc_id, th, start, n, piece) of (doc_id, th, text, reps)."""
    for b in batches:
        for k in range(0, b.num_rows, 500):
            out: list[list] = [[] for _ in range(6)]
            for doc, th, text, reps in zip(*(c.to_pylist() for c in b.slice(k, 500).columns)):
                raw = (text or "").encode()
                for r in reps:
                    for o, v in zip(out, (r["anchor"], doc, th, r["start"], r["n"], raw[r["start"] : r["start"] + r["n"] - 1 + LENGTH])):
                        o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], ["anchor", "doc_id", "th", "start", "n", "piece"])


def _sorted_shards(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, None
        for b in batches:
            for k in range(0, b.num_rows, 500):
                for s, *row in zip(*(c.to_pylist() for c in b.slice(k, 500).columns)):
                    if s != number:
                        if shard is not None:
                            yield from shard.matches()
                        number, shard = s, Shard(most)
                    shard.add(*row)
        if shard is not None:
            yield from shard.matches()

    return run


def covered(n: int, ranges: list[dict] | None) -> np.ndarray:
    """Which of n bytes the windows of the ranges cover."""
    step = np.zeros(n + 1, np.int64)
    for r in ranges or []:
        step[r["start"]] += 1
        step[r["start"] + r["n"] - 1 + LENGTH] -= 1
    return np.cumsum(step[:n]) > 0


def repeated(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = MEMORY) -> DataFrame:
    """(doc_id, th, ranges): of each text that has any, the starts of its matching windows as runs (start, n); th is xxhash64 of the text."""
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/suffix"
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("th"), F.col(f"`{text}`").alias("text"))
    long_ = docs.where(F.octet_length("text") >= LENGTH)
    found = long_.mapInArrow(_anchored, _OCCURRENCE).repartition("anchor").sortWithinPartitions("anchor", "seg").mapInArrow(_resolved, f"kind tinyint, {_OCCURRENCE}")
    found = saved(found, f"{where}/found")
    reps = found.where("kind = 1").groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n", "anchor")).alias("reps"))
    joined = long_.alias("d").join(reps.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.th") == F.col("r.th"))).select("d.doc_id", "d.th", "d.text", "r.reps")
    size = found.where("kind = 1").agg(F.coalesce(F.sum(F.col("n") + LENGTH - 1), F.lit(0)).alias("b")).first()["b"]
    shards = max(1, -(-size // SHARD_BYTES))
    pieces = joined.mapInArrow(_cut, "anchor long, doc_id long, th long, start int, n int, piece binary")
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).select("shard", "doc_id", "th", "start", "n", "piece")
    sorted_ = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_sorted_shards(most), _RANGE)
    ranges = found.where("kind = 0").select("doc_id", "th", "start", "n").unionByName(sorted_)
    return saved(ranges.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n")).alias("ranges")), f"{where}/ranges")


def removed(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), most: int = MEMORY, as_text: bool = False) -> DataFrame:
    """key, keep, n_bytes, n_removed, n_spans and kept, the remaining bytes, of every row; as_text: as a string without the rests of cut characters."""
    ranges = repeated(df, key, text, most).withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    keep = tuple(c for c in keep if c not in (key, "n_bytes", "n_removed", "n_spans", "kept"))
    kinds = [df.schema[c].dataType.simpleString() for c in (key, *keep)]
    inner = [f"_in{k}" for k in range(len(kinds))]
    docs = df.select(*[F.col(f"`{c}`").alias(i) for c, i in zip((key, *keep), inner)], F.col(f"`{text}`").alias("_text"))
    same = F.col("_in0").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col("_text"), F.lit(""))) == F.col("_th"))
    joined = docs.join(ranges, same, "left").select(*inner, "_text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = 1 + len(keep)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                out: list[list] = [[], [], [], []]
                for t, r in zip(part.column(m).to_pylist(), part.column(m + 1).to_pylist()):
                    raw = (t or "").encode()
                    if r:
                        gone = covered(len(raw), r)
                        spans = len(_runs(gone))
                        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    else:
                        spans, kept = 0, raw
                    for o, v in zip(out, (len(raw), len(raw) - len(kept), spans, kept.decode("utf-8", "ignore") if as_text else kept)):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(m)), *(pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary())))], [*inner, "n_bytes", "n_removed", "n_spans", "kept"])

    head = ", ".join(f"{i} {kind}" for i, kind in zip(inner, kinds))
    out = joined.mapInArrow(run, f"{head}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")
    return out.select(*[F.col(i).alias(c) for i, c in zip(inner, (key, *keep))], "n_bytes", "n_removed", "n_spans", "kept")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
