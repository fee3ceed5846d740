"""Operators 11 to 13 against plain versions and the sentencepiece library."""

import hashlib
import math
import random
import struct
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import balls, errata, pieces

# Operator 11


def plain_clusters(rows, k=8, rounds=10, dim=64):
    """rows (vec_id, vector) to sorted (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), with whole numbers throughout."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) < 1 << 17 for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(centres)), key=lambda j: (far(v, centres[j]), j))
    for _ in range(rounds):
        of = [near(v) for _, v in kept]
        for j in range(len(centres)):
            own = [v for (_, v), o in zip(kept, of) if o == j]
            if own:
                centres[j] = [sum(c) // len(own) for c in zip(*own)]
    rows = [(i, near(v), v) for i, v in kept]
    rows = [(i, j, far(v, centres[j])) for i, j, v in rows]
    by = Counter()
    for _, j, d in rows:
        by[j] += d
    return sorted(((i, j, d, by[j], sum(by.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, j, d in rows), key=str)


def vectors(n, seed, spread=0.05, top=1.0):
    rnd = random.Random(seed)
    middle = [[rnd.uniform(-top, top) for _ in range(64)] for _ in range(5)]
    return [(i, [float(np.float32(rnd.gauss(c, spread * top))) for c in middle[i % 5]]) for i in range(n)]


def run_clusters(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in balls.clustered(df, **options).select(*names).collect()), key=str)


@pytest.mark.parametrize("top", [1.0, 2000.0])
def test_clusters_equal_plain_ones(spark, top):
    rows = vectors(400, 1, top=top)
    assert run_clusters(spark, rows) == plain_clusters(rows)


def test_clusters_of_ties_repeats_and_rows_that_are_left_out(spark):
    base = [0.0] * 64
    axis = lambda k, x: [*base[:k], x, *base[k + 1 :]]
    rows = [(i, axis(i % 4, float((-1) ** i))) for i in range(60)] + [(7, axis(0, 1.0))] * 3 + [(100 + i, base) for i in range(20)]
    bad = [(1000, None), (1001, base[:63]), (1002, [*base, 0.0]), (1003, axis(3, None)), (1004, axis(3, float("nan"))), (1005, axis(3, float("inf"))), (1006, axis(0, 3e38)), (None, axis(5, 0.5))]
    assert run_clusters(spark, rows + bad) == plain_clusters(rows + bad)


def test_clusters_of_few_and_of_no_vectors(spark):
    rows = vectors(3, 2)
    assert run_clusters(spark, rows) == plain_clusters(rows)
    assert run_clusters(spark, []) == []


def test_columns_that_clash_are_not_read(spark):
    rows = vectors(30, 3)
    df = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string, ids double")
    got = balls.clustered(df).collect()
    assert sorted((r.vec_id, r.cluster) for r in got) == [(i, j) for i, j, *_ in sorted(plain_clusters(rows))]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 90), st.integers(1, 5), st.sampled_from([1, 3, 40, 1 << 26]))
def test_balls_give_the_nearest_centroid(seed, n, k, top):
    rnd = np.random.default_rng(seed)
    x, c = rnd.integers(-top, top + 1, (n, 4)), rnd.integers(-top, top + 1, (k, 4))
    order, *rest = balls.tree(x, 4)
    whole, rows, of = balls.assigned(x[order], *map(np.asarray, rest), c)
    got = np.full(n, -1)
    got[rows] = of
    for b, j in whole:
        got[rest[0][b] : rest[1][b]] = j
        assert (rest[4][b] == x[order][rest[0][b] : rest[1][b]].sum(axis=0)).all()
    far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x[order]]
    assert got.tolist() == [f.index(min(f)) for f in far]


def test_whole_balls_are_assigned_where_clusters_are_apart():
    rows = np.array([[math.floor(1024 * x) for x in v] for _, v in vectors(2000, 4, 0.01)])
    order, *rest = balls.tree(rows)
    centres = np.stack([rows[k::5].mean(axis=0).astype(int) for k in range(5)])
    whole, looked_at, _ = balls.assigned(rows[order], *map(np.asarray, rest), centres)
    assert len(looked_at) <= 100 and len(whole) <= 40


# Operator 12


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(docs, least_chars=5, least_n=3, drop=97):
    import regex

    n = Counter()
    for i, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for w in regex.findall("[A-Za-zÀ-ÿ]+", low):
            h = crc32(f"{'' if i is None else i}:{w}".encode())
            if h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_chars and k >= least_n}
    by = {w: [v for v in n if near(v, w)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in by.items()}
    form = {w: f if f is not None and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), k, len(by[w]), n[form[w]] if form[w] is not None else None) for w, k in n.items())


def variants(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    return sorted(tuple(r) for r in errata.variants(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect())


def made_up(seed, letters="abÀ", words=300, size=(4, 9)):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice(letters) for _ in range(rnd.randint(*size))) for _ in range(words)]
    return [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 400)))) for k in range(40)]


def test_variants_equal_plain_ones(spark):
    docs = made_up(1) + made_up(1)[:9] + [(None, None), (None, "abbab Abbab ABBAB"), (50, ""), (51, "×÷×÷× " * 3 + "x" * 5000 + " " + "y" * 5000)]
    docs += [(k, "hotels hotels hotels hotel ".upper() * 4 + "q" * 3000 + " " + "q" * 2999 + " ") for k in range(60, 64)]
    assert variants(spark, docs) == plain_variants(docs)


def test_groups_that_are_halved_again_lose_no_pair(spark):
    docs = [(k, t) for k, t in made_up(2, "ab", 500, (5, 11))]
    assert variants(spark, docs, limit=6, drop=5) == plain_variants(docs, drop=5)


def test_a_chain_of_forms_leads_to_its_last_word(spark):
    chain = ["aaaaaaaaaa"[: 10 - k] + "b" * k for k in range(8)]
    docs = [(k, " ".join([w] * 3 * 2**k)) for k, w in enumerate(chain)]
    assert variants(spark, docs, drop=10**12) == plain_variants(docs, drop=10**12)
    assert {r[2] for r in variants(spark, docs, drop=10**12)} == {chain[-1]}


def test_variants_of_nothing_and_of_clashing_columns(spark):
    assert variants(spark, []) == [] and variants(spark, [(1, None), (2, "a b c")]) == []
    docs = made_up(3)[:8]
    df = spark.createDataFrame([(i, t, "w", 1, 2, "g") for i, t in docs], "doc_id long, text string, word string, n int, m int, suf string")
    assert sorted(tuple(r) for r in errata.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()) == plain_variants(docs)


@settings(max_examples=80, deadline=None)
@given(st.sets(st.text("abc", min_size=4, max_size=5), min_size=2, max_size=40))
def test_classes_hold_every_pair_once(words):
    words = sorted(words)
    got = Counter(frozenset((words[i], words[j])) for c in errata.classes(words, 4, 0, 99) for k, i in enumerate(c) for j in c[:k])
    assert got == {frozenset((a, b)): 1 for k, a in enumerate(words) for b in words[:k] if near(a, b) and min(len(a), len(b)) == 4}


# Operator 13

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = " ▁\n\tabcdeTHE.,<s>0129é中文日本ि한글😀\0́ �"


def packed(number, value):
    """A field of a protocol-buffer message."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, bool | int):
        return varint(number << 3) + varint(int(value))
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def model(path, words, byte_fallback, prefix=True):
    """A small merge model: words (piece, kind), earlier ones score higher."""
    every = [("<unk>", 2), ("<s>", 3), ("</s>", 3), *([(f"<0x{k:02X}>", 6) for k in range(256)] if byte_fallback else []), *words]
    out = b"".join(packed(1, packed(1, p) + packed(2, -float(k)) + packed(3, kind)) for k, (p, kind) in enumerate(every))
    out += packed(2, packed(3, 2) + packed(35, byte_fallback)) + packed(3, packed(1, "identity") + packed(3, prefix) + packed(4, False) + packed(5, True))
    path.write_bytes(out)
    return str(path)


def same(own, library, text):
    ids = np.frombuffer(own.encode(text), "<u4").tolist()
    assert ids == library.encode(text, add_bos=True, add_eos=True), text
    assert own.decode(ids) == library.decode(ids), text


@settings(max_examples=400, deadline=None)
@given(st.text(LETTERS, max_size=60) | st.text(st.characters(exclude_categories=["Cs"]), max_size=30))
def test_pieces_equal_the_library(text):
    same(*pieces.loaded(MODEL), text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*range(260), 28705, 28708, 300, 260, 31999]), max_size=12))
def test_any_ids_decode_as_in_the_library(ids):
    own, library = pieces.loaded(MODEL)
    assert own.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
def test_unused_own_and_unknown_pieces(tmp_path, byte_fallback, prefix):
    words = [("▁a", 1), ("bc", 5), ("ab", 1), ("abc", 5), ("cc", 1), ("XY", 4), ("a▁", 1), ("a", 1), ("b", 1), ("c", 1), ("▁", 1), ("bcc", 1), ("X", 1)]
    path = model(tmp_path / "m.model", words, byte_fallback, prefix)
    own, library = pieces.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(5)
    for _ in range(3000):
        same(own, library, "".join(rnd.choice("aaabbbcccXY zé") for _ in range(rnd.randint(0, 14))))


def test_very_long_parts_and_repeats(spark):
    texts = ["a" * 200_000, "中" * 50_000, " " * 30_000, "word " * 50_000, "", None, "same", "same"]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    library = pieces.loaded(MODEL)[1]
    got = {r.doc_id: r for r in pieces.digests(df, MODEL).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[k].agrees and got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert got[6][1:] == got[7][1:]
    back = pieces.decoded(pieces.encoded(df, MODEL), MODEL).collect()
    assert {r.doc_id: r.text for r in back} == {k: t or "" for k, t in enumerate(texts)} and all(r.agrees for r in back)
    assert pieces.digests(df.where("false"), MODEL).collect() == []


def test_another_kind_of_model_is_refused(tmp_path):
    (tmp_path / "u.model").write_bytes(packed(1, packed(1, "a")) + packed(2, packed(3, 1)))
    with pytest.raises(ValueError):
        pieces.Pieces(str(tmp_path / "u.model"))
