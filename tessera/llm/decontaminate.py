"""Operator 3: benchmark decontamination by a BM25 index of the test items with block-max WAND.

The items are the indexed documents. Each weight is BM25's, divided by the item's score for itself, so a score is the share of the item
that a passage has, from 0 to 1, and one threshold serves all items. Terms and document frequencies are counted in Spark over all items, and workers
build the index, in parts of a checked size (INDEX_BYTES of text; a longer item is a part of its own). The driver hands parts on as bytes; each part is a pass over the documents, so a
benchmark of any size is searched whole, with the same weights.

An item of n words is searched in windows of its length class: with L the least power of two that is n or more, windows are of 2 L words and move on by L, so the item fits in one,
whatever other items there are. A passage whose terms' greatest weights don't add up to the threshold can't have a hit and is left out at once; for the others, block-max WAND
retrieves all items of the class at or above the threshold. A hit counts if the passage also has SHARED of the word trigrams of the item's
question, and of its answer: the part after an answer mark, else the last quarter of the words. Of a document's passages the best one is reported, of equals the first.

Words are runs of letters and digits, in lower case. Null or empty texts and items match nothing; an item without words is left out, an item of fewer words
than a trigram is compared as a whole. Repeated rows are reported each; items that repeat in id and text once. Empty tables give no rows. Columns may have any names.
"""

from __future__ import annotations

import pickle
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm import textvec
from tessera.llm.common import saved, shared_dir, table, unused

K1, B = 1.2, 0.75
THRESHOLD = 0.5
SHARED = 0.5
GRAM = 3
ANSWER_SHARE = 0.25
BLOCK = 4
DENSE = 4_000_000
LEAST_CLASS = 8
INDEX_BYTES = 16_000_000
_ANSWER = re.compile(r"(?:^|\n)\s*(?:answer|a)\s*:", re.IGNORECASE)


def term_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    return textvec.tokens(raw, np.array([0, len(raw)]), False, textvec.PUNCTUATION)[3]


def trigrams(h: np.ndarray) -> set:
    n = min(GRAM, len(h))
    return {tuple(h[i : i + n].tolist()) for i in range(len(h) - n + 1)} if n else set()


def halves(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of an item's question and answer."""
    if (m := _ANSWER.search(text)) and m.start():
        q, a = term_hashes(text[: m.start()]), term_hashes(text[m.end() :])
        if len(q) and len(a):
            return q, a
    h = term_hashes(text)
    k = len(h) - max(min(GRAM, len(h) - 1), ceil(ANSWER_SHARE * len(h)))
    return h[:k], h[k:]


def length_class(n: int) -> int:
    """The least power of two that is n or more, LEAST_CLASS at least."""
    return max(LEAST_CLASS, 1 << (max(1, n) - 1).bit_length())


class Index:
    """Postings of items of one length class: of each term the items in order and their weights; and the term's greatest weight in every block of BLOCK consecutive items that has it."""

    def __init__(self, items: list[tuple], rows: list[tuple], n_items: int, mean: float, step: int | None = None):
        """items: (item_id, text); rows: (place in items, term, tf, length, df)."""
        self.ids = [i for i, _ in items]
        place, term, tf, size, df = (np.array(c) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
        weight = np.log(1 + (n_items - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
        weight = weight / np.bincount(place, weight, len(items))[place]
        self.vocab, at = np.unique(term.astype(np.int64).view(np.uint64), return_inverse=True)
        order = np.lexsort((place, at))
        edge = np.searchsorted(at[order], np.arange(len(self.vocab) + 1))
        self.lists, self.blocks = [], []
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            where, w = place[order[i:j]], weight[order[i:j]]
            block, first = np.unique(where // BLOCK, return_index=True)
            self.lists.append((where.tolist(), w.tolist()))
            self.blocks.append((block, np.maximum.reduceat(w, first)))
        self.most = np.array([m.max() for _, m in self.blocks])
        # The same for a few long spans of items, dense, to bound many passages at once.
        spans = max(1, min(256, -(-len(items) // BLOCK), DENSE // max(1, len(self.vocab))))
        width = -(-max(1, len(items)) // spans)
        self.dense = np.zeros((len(self.vocab), spans), np.float32)
        np.maximum.at(self.dense, (at, place // width), weight.astype(np.float32))
        both = [halves(t) for _, t in items]
        self.parts = [(trigrams(q), trigrams(a)) for q, a in both]
        self.step = step or max((length_class(len(q) + len(a)) for q, a in both), default=LEAST_CLASS)

    def retrieve(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All items whose weights for the distinct terms add up to least or more: WAND in every block whose greatest weights do."""
        bounds = [self.blocks[t] for t in terms]
        block, most = np.concatenate([x for x, _ in bounds]), np.concatenate([m for _, m in bounds])
        total = np.bincount(block, most)
        out = []
        for k in np.flatnonzero(total >= least - 1e-12).tolist():
            here = np.flatnonzero(block == k)
            owner = np.searchsorted(np.cumsum([len(x) for x, _ in bounds]), here, "right")
            out += self._wand([(terms[o], float(m)) for o, m in zip(owner.tolist(), most[here])], k * BLOCK, (k + 1) * BLOCK, least - 1e-12)
        return out

    def _wand(self, terms: list[tuple[int, float]], first: int, end: int, least: float) -> list[tuple[int, float]]:
        """Items from first to end. A head is (item, place, items, weights, greatest weight here)."""
        heads = []
        for t, most in terms:
            at, weight = self.lists[t]
            c = bisect_left(at, first)
            heads.append([at[c], c, at, weight, most])
        out = []
        while heads:
            heads.sort(key=lambda h: h[0])
            bound, pivot = 0.0, -1
            for k, h in enumerate(heads):
                bound += h[4]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = heads[pivot][0]
            if heads[0][0] == item:
                score = sum(h[3][h[1]] for h in heads if h[0] == item)
                if score >= least:
                    out.append((item, score))
                to = item + 1
            else:
                to = item
            kept = []
            for h in heads:
                if h[0] < to:
                    h[1] = bisect_left(h[2], to, h[1])
                    if h[1] == len(h[2]) or h[2][h[1]] >= end:
                        continue
                    h[0] = h[2][h[1]]
                kept.append(h)
            heads = kept
        return out

    def hits(self, row: np.ndarray, h: np.ndarray, rows: int, least: float, shared: float) -> list[tuple[int, int, int, float]]:
        """(row, item, first word of the passage, score) of all confirmed passages of rows texts, given the row and hash of every word."""
        if not len(h) or not len(self.vocab):
            return []
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        known = self.vocab[at] == h
        total = np.concatenate(([0.0], np.cumsum(np.where(known, self.most[at], 0.0))))
        count = np.bincount(row, minlength=rows)
        begin = np.cumsum(count) - count
        size, step = 2 * self.step, self.step
        windows = np.where(count > 0, np.maximum(1, -(-(count - size) // step) + 1), 0)
        doc = np.repeat(np.arange(len(count)), windows)
        place = (np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)) * step
        first = begin[doc] + place
        last = np.minimum(first + size, begin[doc] + count[doc])
        out = []
        maybe = np.flatnonzero(total[last] - total[first] >= least - 1e-9)
        doc, place, first, last = doc[maybe], place[maybe], first[maybe], last[maybe]
        size = last - first
        inside = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        passage = np.repeat(np.arange(len(first)), size)
        passage, inside = passage[known[inside]], inside[known[inside]]
        pair = np.unique(passage * len(self.vocab) + at[inside])
        passage, term = np.divmod(pair, len(self.vocab))
        begins = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1]))) if len(pair) else passage
        ends = np.append(begins[1:], len(pair))
        near = np.flatnonzero((np.add.reduceat(self.dense[term], begins, axis=0) >= least - 1e-5).any(axis=1)) if len(pair) else begins
        for n in near.tolist():
            k = passage[begins[n]]
            i, j = first[k], last[k]
            found = self.retrieve(term[begins[n] : ends[n]].tolist(), least)
            if found:
                grams = trigrams(h[i:j])
                short = set(h[i:j].tolist())
                for item, score in found:
                    if all(self.overlap(p, grams, short) >= shared for p in self.parts[item]):
                        out.append((int(doc[k]), item, int(place[k]), float(score)))
        return out

    @staticmethod
    def overlap(part: set, grams: set, words: set) -> float:
        if not part:
            return 1.0
        n = len(next(iter(part)))
        if n == GRAM:
            return len(part & grams) / len(part)
        return sum(all(x in words for x in p) for p in part) / len(part)


def _terms(items: DataFrame) -> DataFrame:
    """(item, term, tf, length) of every distinct term of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = term_hashes(text or "")
                term, tf = np.unique(h, return_counts=True)
                rows += [(item, t, int(n), len(h)) for t, n in zip(textvec.signed(term).tolist(), tf)]
            cols = [*zip(*rows)] or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int32()))], ["item", "term", "tf", "length"])

    return items.mapInArrow(run, "item string, term long, tf int, length int")


def _built(n_items: int, mean: float):
    """Of items (part, id, text, length, terms) sorted by part: (part, index), the pickled indexes of its length classes. The items of one part, of bounded text, are in memory."""

    def pickled(held: list[tuple]) -> bytes:
        classes: dict[int, list[tuple]] = {}
        for row in held:
            classes.setdefault(length_class(row[2]), []).append(row)
        made = []
        for step, rows in sorted(classes.items()):
            post = [(k, t["term"], t["tf"], size, t["df"]) for k, (_, _, size, terms) in enumerate(rows) for t in terms]
            made.append(Index([(i, text) for i, text, *_ in rows], post, n_items, mean, step))
        return pickle.dumps(made, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda part, held: pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([pickled(held)], pa.binary())], ["part", "index"])
        part, held = None, []
        for b in batches:
            for p, *row in zip(*(c.to_pylist() for c in b.columns)):
                if p != part and held:
                    yield out(part, held)
                    held = []
                part = p
                held.append(tuple(row))
        if held:
            yield out(part, held)

    return run


_open: dict[str, list[Index]] = {}


def _opened(name: str, broadcast) -> list[Index]:
    """A part's indexes, unpickled once a worker; only the last part is kept."""
    if name not in _open:
        _open.clear()
        _open[name] = pickle.loads(broadcast.value)
    return _open[name]


def contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", least: float = THRESHOLD, shared: float = SHARED) -> DataFrame:
    """(key, item, first_word, score) of the best passage of every document and item that match."""
    spark = df.sparkSession
    kinds = {"key": df.schema[key].dataType.simpleString(), "item": benchmark.schema[item].dataType.simpleString()}
    # Items are told apart by id and text, also where an id repeats or is null.
    named = benchmark.select(F.col(f"`{item}`").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    named = named.withColumn("item", F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.md5("text"))).dropDuplicates(["item"])
    terms = _terms(named.select("item", "text"))
    stats = terms.select("item", "length").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    frequency = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    posted = terms.join(frequency, "term").groupBy("item").agg(F.first("length").alias("length"), F.collect_list(F.struct("term", "tf", "df")).alias("terms"))
    part = F.pmod(F.xxhash64("item"), F.lit(max(1, ceil(size / INDEX_BYTES))))
    items = named.join(posted, "item").select(part.alias("part"), "id", "text", "length", "terms").repartition("part").sortWithinPartitions("part")
    index = saved(items.mapInArrow(_built(stats["n"], stats["mean"] or 1.0), "part long, index binary"), f"{shared_dir(spark)}/bm25")
    docs = df.select(F.col(f"`{key}`").alias("key"), F.lower(F.col(f"`{text}`")).alias("text"))
    id_type = to_arrow_type(benchmark.schema[item].dataType)
    out = spark.createDataFrame([], f"key {kinds['key']}, item {kinds['item']}, first_word long, score double")
    for row in index.select("part").distinct().collect():  # one number for each INDEX_BYTES of the benchmark
        name, one = uuid.uuid4().hex, spark.sparkContext.broadcast(bytes(index.where(F.col("part") == row["part"]).first()["index"]))

        def run(batches: Iterator[pa.RecordBatch], name=name, one=one) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, j, data, off in textvec.blocks(b.column(1)):
                    _, _, of, h = textvec.tokens(data, off, False, textvec.PUNCTUATION)
                    best: dict[tuple, tuple[int, float]] = {}
                    for c, ix in enumerate(_opened(name, one)):
                        for k, n, first, score in ix.hits(of, h, j - i, least, shared):
                            if (k, c, n) not in best or score > best[k, c, n][1]:
                                best[k, c, n] = first, score
                    ids = pa.array([_opened(name, one)[c].ids[n] for _, c, n in best], id_type)
                    at = pa.array([i + k for k, *_ in best], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), ids, pa.array([f for f, _ in best.values()], pa.int64()), pa.array([s for _, s in best.values()], pa.float64())], ["key", "item", "first_word", "score"])

        out = out.unionByName(docs.mapInArrow(run, out.schema))
    return out.select(F.col("key").alias(key), F.col("item").alias(item), "first_word", "score")


def clean(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df, all its columns, without the rows that match an item. Rows are told apart by key and a hash of the text."""
    mark = unused(df, "row")
    of = F.concat_ws(":", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("string"))
    hit = contaminated(df.select(of.alias(mark), F.col(f"`{text}`").alias("text")), benchmark, mark).select(mark).distinct()
    return df.withColumn(mark, of).join(hit, mark, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
