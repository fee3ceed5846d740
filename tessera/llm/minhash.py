"""Operator 10: near duplicates by MinHash bands, sequential Bayesian verification and an exact check.

1. A document's set holds the hashes of its distinct five-word shingles (a text of fewer words has one shingle; without words the set
   is empty and linked with nothing). Its signature is the least of HASHES hash functions over the set.
2. Documents of equal sets form a class; one member stands for it from here on, so copies never make pairs.
3. Signatures are cut into bands. Equal bands meet in a bucket, read as a sorted stream; a bucket's first member is its hub, and every
   node is paired with the least of its hubs only.
4. A pair's signatures are compared batch by batch. Of a pair with m of n equal values the posterior of the similarity is
   Beta(m + 1, n - m + 1); the pair is dropped once the posterior chance of a similarity of 0.75 or more is below MISS.
5. Survivors are confirmed on their full sets in whole numbers.
6. Components of the confirmed links are labelled. In buckets whose members still belong to several components, members of different components
   are compared by the same batches, in cells of bounded size; components that may be linked form families, told by one pair for each two parts joined. All
   members of a family meet once more, with their texts: every pair that its sizes and signatures don't rule out is confirmed on full sets, unless its
   components have been joined in that cell before, and again a cell gives one link for each two components joined. So no link in a bucket is lost to
   step 3, and rows stay in proportion to members; only a family with many components that stay apart costs comparisons in proportion to their number times its size.
7. The final components give component_id, the smallest doc_id that can be reached.

With 32 bands of 4 values, a pair at a similarity of 0.75 misses all bands with a chance of 5e-6. Sets are of 64-bit hashes, classes of
128-bit ones. Rows of equal doc_id and different texts are different documents; rows that repeat are copies. A null doc_id takes part, but
is never a component_id unless all ids it reaches are null. Other columns, of any names, pass through where asked for; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textvec
from tessera.llm.common import saved, shared_dir, table

WORDS = 5
SIMILAR = (75, 100)
HASHES = 128
BANDS = 32
BATCH = 16
MISS = 1e-6
ROWS_OF_BLOCK = 4096
BYTES_OF_BLOCK = 32_000_000
CHECKED = 16
_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


@lru_cache
def least_equal(n: int, miss: float = MISS) -> int:
    """Fewest equal values of n with which the posterior chance of a similarity of 0.75 or more is at least miss."""
    t, left = SIMILAR[0] / SIMILAR[1], 0.0
    for m in range(n + 1):
        left += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if left >= miss:
            return m
    return n


def sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts of a block, sorted within each, and where each text's begin (one more than texts)."""
    rows = len(off) - 1
    _, _, row, h = textvec.tokens(data, off)
    at, value = textvec.grams(h, row, rows, WORDS)
    order = np.lexsort((value, at))
    at, value = at[order], value[order]
    if len(at):
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (value[1:] != value[:-1])))
        at, value = at[new], value[new]
    return value, np.searchsorted(at, np.arange(rows + 1))


def names(value: np.ndarray, edge: np.ndarray) -> list[bytes | None]:
    """128 bits that name each set; none for an empty one."""
    with np.errstate(over="ignore"):
        one, two = textvec.mix(value + textvec.BASE), textvec.mix(value ^ np.uint64(0x5851F42D4C957F2D))
        return [np.array([one[x:y].sum() + np.uint64(y - x), two[x:y].sum()], np.uint64).tobytes() if y > x else None for x, y in zip(edge[:-1], edge[1:])]


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(shingles), 1024):
        with np.errstate(over="ignore"):
            h = ((shingles[i : i + 1024, None] * _A + _B) >> np.uint64(32)).astype(np.uint32)
        low = np.minimum(low, h.min(axis=0))
    return low


def _fixed(values: list[bytes], size: int) -> pa.Array:
    return pa.array(values, pa.binary())


def sketched(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, n_shingles, node (128 bits that name the set, null if empty) and sig."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in textvec.blocks(b.column(len(keep))):
                value, edge = sets(data, off)
                n = np.diff(edge)
                node = names(value, edge)
                sig = [signature(value[x:y]).tobytes() if y > x else None for x, y in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(len(keep))), pa.array(n, pa.int64()), _fixed(node, 16), _fixed(sig, 4 * HASHES)], [*keep, "n_shingles", "node", "sig"])

    out = "".join(f"`{c}` {kinds[c]}, " for c in keep)
    return df.select(*keep, text).mapInArrow(run, f"{out}n_shingles long, node binary, sig binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """(band, node): a row for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = HASHES // BANDS
        for b in batches:
            for k in range(0, b.num_rows, 4000):
                part = b.slice(k, 4000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, step).astype(np.uint64)
                with np.errstate(over="ignore"):
                    h = np.arange(BANDS, dtype=np.uint64)[None, :] * textvec.BASE
                    for c in range(step):
                        h = textvec.mix(h + sig[:, :, c] + np.uint64(1))
                node = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))
                yield pa.RecordBatch.from_arrays([pa.array(textvec.signed(h.reshape(-1))), node], ["band", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "band long, node binary")


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a stream sorted by band: (band, hub, node) for the members after a bucket's first, and (band, hub, hub) for a first that has others."""
    band, hub, alone = None, None, True
    for b in batches:
        h = b.column(0).to_numpy()
        first = np.concatenate(([len(h) > 0 and (band is None or h[0] != band)], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        begin = np.flatnonzero(first)
        nodes = b.column(1)
        out_band, out_hub, out_node = [], [], []
        edge = [0, *begin.tolist(), len(h)] if len(h) and not first[0] else [*begin.tolist(), len(h)]
        for i, j in zip(edge[:-1], edge[1:]):
            if first[i]:
                band, hub, alone = int(h[i]), nodes[i].as_py(), True
                i += 1
            if i < j:
                members = nodes.slice(i, j - i).to_pylist()
                if alone:
                    members.insert(0, hub)
                    alone = False
                out_band += [band] * len(members)
                out_hub += [hub] * len(members)
                out_node += members
        yield pa.RecordBatch.from_arrays([pa.array(out_band, pa.int64()), pa.array(out_hub, pa.binary()), pa.array(out_node, pa.binary())], ["band", "hub", "node"])


def _survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sig of a, sig of b) that no batch of their signatures rules out."""
    for b in batches:
        for k in range(0, b.num_rows, 4000):
            part = b.slice(k, 4000)
            x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in (2, 3))
            left, equal = np.arange(part.num_rows), np.zeros(part.num_rows, np.int32)
            for n in range(0, HASHES, BATCH):
                equal = equal + (x[left, n : n + BATCH] == y[left, n : n + BATCH]).sum(axis=1)
                keep = equal >= least_equal(n + BATCH)
                left, equal = left[keep], equal[keep]
            at = pa.array(left)
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at)], ["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text of a, text of b) of a similarity of 0.75 or more on their full sets. Consecutive pairs often share a."""
    part_, whole = SIMILAR
    last: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, np.uint64))
    for b in batches:
        good = []
        for i, j, data, off in textvec.blocks(b.column(3)):
            value, edge = sets(data, off)
            for k in range(i, j):
                a = b.column(0)[k].as_py()
                if a != last[0]:
                    raw = np.frombuffer((b.column(2)[k].as_py() or "").encode(), np.uint8)
                    last = a, sets(raw, np.array([0, len(raw)]))[0]
                one, two = last[1], value[edge[k - i] : edge[k - i + 1]]
                both = len(np.intersect1d(one, two, assume_unique=True))
                if whole * both >= part_ * (len(one) + len(two) - both):
                    good.append(k)
        at = pa.array(good, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])


class Merging:
    """Members of one cell that are asked for, and which of their components have been joined so far."""

    def __init__(self) -> None:
        self.roots: list[bytes] = []
        self.numbers: dict[bytes, int] = {}
        self.names: list[bytes] = []
        self.sketch: list[bytes] = []
        self.size: list[int] = []
        self.sets: list[np.ndarray] = []
        self.at = None

    def number(self, root: bytes) -> int:
        n = self.numbers.get(root)
        if n is None:
            n = self.numbers[root] = len(self.names)
            self.names.append(root)
            if self.at is not None:
                self.at = np.append(self.at, n)
        return n

    def add(self, root: bytes, sketch: bytes, size: int, values: np.ndarray | None = None) -> None:
        self.roots.append(root)
        self.sketch.append(sketch)
        self.size.append(size)
        if values is not None:
            self.sets.append(values)

    def begin(self) -> None:
        self.of = np.array([self.number(r) for r in self.roots], np.int64)
        self.at = np.arange(len(self.names))
        self.array = np.frombuffer(b"".join(self.sketch), np.uint8).reshape(-1, HASHES)
        self.sizes = np.array(self.size, np.int64)

    def near(self, me: int, sketch: np.ndarray, size: int, limits: np.ndarray) -> np.ndarray:
        """Members of other components that neither their sizes nor a batch of the signatures rules out, the most similar first."""
        part, whole = SIMILAR
        left = np.flatnonzero((self.at[self.of] != self.at[me]) & (whole * np.minimum(self.sizes, size) >= part * np.maximum(self.sizes, size)))
        equal = np.zeros(len(left), np.int64)
        for n in range(0, HASHES, BATCH):
            if not len(left):
                break
            equal = equal + (self.array[left, n : n + BATCH] == sketch[n : n + BATCH]).sum(axis=1)
            good = equal >= limits[n // BATCH]
            left, equal = left[good], equal[good]
        return left[np.argsort(-equal, kind="stable")]

    def join(self, me: int, other: int) -> None:
        self.at[self.at == self.at[other]] = self.at[me]


def _limits() -> np.ndarray:
    return np.array([least_equal(n + BATCH) for n in range(0, HASHES, BATCH)])


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of cells (band, i, j, part, root, sketch, size) sorted by the first four: pairs of components that hold members which may be similar.

    The rows of part 0 are held, those of part 1 streamed past them. Components that a pair has joined are one from then on, so a cell gives fewer
    pairs than it has components.
    """
    key, cell, limits = None, Merging(), _limits()
    for b in batches:
        out: list[tuple[bytes, bytes]] = []
        for band, i, j, part, root, sketch, size in zip(*(c.to_pylist() for c in b.columns)):
            if (band, i, j) != key:
                key, cell = (band, i, j), Merging()
            if not part:
                cell.add(root, sketch, size)
                continue
            if cell.at is None:
                if not cell.roots:
                    continue
                cell.begin()
            me, values = cell.number(root), np.frombuffer(sketch, np.uint8)
            for n in cell.near(me, values, size, limits).tolist():
                other = int(cell.of[n])
                if cell.at[other] != cell.at[me]:
                    cell.join(me, other)
                    out.append((root, cell.names[other]))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], ["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of cells (family, i, j, part, root, sketch, text) sorted by the first four: links between components, confirmed on full sets, that join them.

    As _plausible, with the exact check in place; a pair whose components have been joined in this cell meanwhile is left out.
    """
    part_, whole = SIMILAR
    key, cell, limits = None, Merging(), _limits()
    for b in batches:
        out: list[tuple[bytes, bytes]] = []
        for lo, hi, data, off in textvec.blocks(b.column(6)):
            value, edge = sets(data, off)
            for k, (family, i, j, part, root, sketch) in enumerate(zip(*(b.column(c).slice(lo, hi - lo).to_pylist() for c in range(6)))):
                mine = value[edge[k] : edge[k + 1]]
                if (family, i, j) != key:
                    key, cell = (family, i, j), Merging()
                if not part:
                    cell.add(root, sketch, len(mine), mine.copy())
                    continue
                if cell.at is None:
                    if not cell.roots:
                        continue
                    cell.begin()
                me = cell.number(root)
                left = cell.near(me, np.frombuffer(sketch, np.uint8), len(mine), limits)
                while len(left):
                    now, left = left[:CHECKED], left[CHECKED:]
                    others = np.concatenate([cell.sets[n] for n in now.tolist()])
                    place = np.minimum(np.searchsorted(mine, others), len(mine) - 1)
                    size = cell.sizes[now]
                    both = np.add.reduceat((mine[place] == others).astype(np.int64), np.cumsum(size) - size)
                    for n in now[whole * both >= part_ * (size + len(mine) - both)].tolist():
                        other = int(cell.of[n])
                        if cell.at[other] != cell.at[me]:
                            cell.join(me, other)
                            out.append((root, cell.names[other]))
                    left = left[cell.at[cell.of[left]] != cell.at[me]]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], ["a", "b"])


def components(edges: DataFrame, where: str) -> DataFrame:
    """(node, root) of every node of the edges (a, b) that isn't a root itself: alternating star contraction, one written table a round.

    The least neighbour of a node comes from an aggregation with partial sums and goes back to its edges by a join, which a hub's edges may be split for.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    mark, k = None, 0
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()  # larger neighbours to the least
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        pairs = saved(small.where("u <> v").distinct(), f"{where}/round-{k}")
        k += 1
        seen = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen


def _cells(members: DataFrame, group: str, size: str | None = None) -> DataFrame:
    """members (group, root, node, ...) of groups of several components, dealt to cells (i, j, part): every member that isn't of a group's largest component meets
    all members. A cell holds about ROWS_OF_BLOCK members, and about BYTES_OF_BLOCK of size, and streams about ROWS_OF_BLOCK; large groups have several."""
    weight = F.sum(size) if size else F.lit(0)
    count = members.groupBy(group, "root").agg(F.count(F.lit(1)).alias("n"), weight.alias("w"))
    whole = count.groupBy(group).agg(F.max(F.struct("n", "root", "w")).alias("top"), F.sum("n").alias("all"), F.sum("w").alias("bytes")).where("all > top.n")
    parts = lambda x, y: F.greatest(F.lit(1), F.ceil(x / y)).cast("int")
    held = F.greatest(parts(F.col("all") - F.col("top.n"), ROWS_OF_BLOCK), parts(F.col("bytes") - F.col("top.w"), BYTES_OF_BLOCK))
    dealt = members.join(whole.select(group, F.col("top.root").alias("_top"), held.alias("_ki"), parts(F.col("all"), ROWS_OF_BLOCK).alias("_kj")), group)
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rest = [c for c in members.columns if c != group]
    ask = dealt.where("root <> _top").select(group, own("_ki").alias("i"), F.explode(every("_kj")).alias("j"), F.lit(0).alias("part"), *rest)
    against = dealt.select(group, F.explode(every("_ki")).alias("i"), own("_kj").alias("j"), F.lit(1).alias("part"), *rest)
    return ask.unionByName(against).repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "part")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, keep, n_shingles, component_id (least key that can be reached) and kept. A column of keep that is named like one of these is left out."""
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/minhash"
    keep = tuple(c for c in keep if c not in (key, "n_shingles", "component_id", "kept"))
    inner = {c: f"_in{k}" for k, c in enumerate((key, *keep))}
    given = df.select(*[F.col(f"`{c}`").alias(i) for c, i in inner.items()], F.col(f"`{text}`").alias("_text"))
    base = saved(sketched(given, list(inner.values()), "_text"), f"{where}/base")
    nodes = saved(base.where("node IS NOT NULL").groupBy("node").agg(F.min("_in0").alias("least"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")), f"{where}/nodes")
    buckets = saved(_bands(nodes).repartition("band").sortWithinPartitions("band", "node").mapInArrow(_starred, "band long, hub binary, node binary"), f"{where}/buckets")

    # Only texts of nodes in pairs are needed again: each node's by one of its documents.
    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        sig = lambda c: nodes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))
        likely = pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_survive, "a binary, b binary")
        likely = saved(likely, f"{where}/likely-{name}")
        used = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        ids = nodes.join(used, "node").select("node", "least")
        texts = _texts(given, "_in0", "_text", ids)
        texts = saved(texts, f"{where}/texts-{name}")
        side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
        checked = likely.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").sortWithinPartitions("a")
        return saved(checked.mapInArrow(_confirm, "a binary, b binary"), f"{where}/links-{name}")

    # A bucket's first member is its hub; every node is tried with the least of its hubs.
    stars = buckets.where("hub <> node").groupBy(F.col("node").alias("b")).agg(F.min("hub").alias("a")).select("a", "b")
    links = confirmed(stars, "star")
    final = saved(components(links, f"{where}/first"), f"{where}/labels-0")

    # Buckets whose members are still of several components: components that may be linked form families, and all pairs across a family's components are checked.
    small = saved(_sketches(nodes), f"{where}/sketches")
    member = buckets.join(final, "node", "left").select("band", F.coalesce("root", "node").alias("root"), "node")
    open_ = member.join(member.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band"), "band").join(small, "node")
    maybe = _cells(saved(open_.select("band", "root", "node", "sketch", "size"), f"{where}/open"), "band").select("band", "i", "j", "part", "root", "sketch", "size")
    maybe = saved(maybe.mapInArrow(_plausible, "a binary, b binary"), f"{where}/plausible")
    if maybe.limit(1).count():
        family = components(maybe, f"{where}/families").withColumnRenamed("root", "family")
        family = saved(family.unionByName(family.select(F.col("family").alias("node"), "family").distinct()), f"{where}/family")
        kin = nodes.join(final, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")).join(family.withColumnRenamed("node", "root"), "root")
        kin = saved(kin, f"{where}/kin")
        full = kin.drop("least").join(_texts(given, "_in0", "_text", kin.select("node", "least")), "node").join(small, "node")
        full = saved(full.select("family", "root", "node", "sketch", (F.col("size") * 8).alias("bytes"), "text"), f"{where}/full")
        found = _cells(full, "family", "bytes").select("family", "i", "j", "part", "root", "sketch", "text")
        found = saved(found.mapInArrow(_linked, "a binary, b binary"), f"{where}/links-cross")
        if found.limit(1).count():
            final = saved(components(links.unionByName(found), f"{where}/second"), f"{where}/labels-1")
    rooted = nodes.select("node", "least").join(final, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    out = base.drop("sig").join(named, "node", "left").withColumn("component_id", F.coalesce("component_id", "_in0"))
    return out.select(*[F.col(i).alias(c) for c, i in inner.items()], "n_shingles", "component_id", F.col("_in0").eqNullSafe(F.col("component_id")).alias("kept"))


def _sketches(nodes: DataFrame) -> DataFrame:
    """(node, sketch, size): a byte of each value of the signature, and the size of the set. A chance match of bytes only adds work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            small = [np.frombuffer(x, np.uint32).astype(np.uint8).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(small, pa.binary()), b.column(2)], ["node", "sketch", "size"])

    return nodes.select("node", "sig", F.col("n_shingles").alias("size")).mapInArrow(run, "node binary, sketch binary, size long")


def _texts(df: DataFrame, key: str, text: str, ids: DataFrame) -> DataFrame:
    """(node, text) of one document of each of the given nodes. Candidates are found by the id; where an id repeats, the set decides."""
    docs = df.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(ids.select(F.col("least"), F.col("node").alias("want")), F.col("_key").eqNullSafe(F.col("least")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = []
            for i, j, data, off in textvec.blocks(b.column(0)):
                value, edge = sets(data, off)
                at += [i + k for k, node in enumerate(names(value, edge)) if node == b.column(1)[i + k].as_py()]
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(1).take(at), b.column(0).take(at)], ["node", "text"])

    found = docs.select("text", "want").mapInArrow(run, "node binary, text string")
    return found.groupBy("node").agg(F.first("text").alias("text"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def oracle_sql() -> str:
    """All pairs with a common shingle, counted; links by the exact rule; components by reachability."""
    part, whole = SIMILAR
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
    g AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, words[i:i + {WORDS - 1}] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WORDS - 2})) AS i FROM w WHERE len(words) >= {WORDS})
      UNION ALL SELECT doc_id, words FROM w WHERE len(words) BETWEEN 1 AND {WORDS - 1})),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {whole} * both_ >= {part} * (x.n + y.n - both_)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
    """
