"""Every corpus operator against a plain version, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, chat, decontaminate, html, minhash, ngram, quality, sharding, suffix, textvec, tokenfile
from tessera.llm.induced import suffix_order

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed=5):
    r = random.Random(seed)
    vocab = ["the", "of", "and", "Straße", "ñandú"] + ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(120)]
    make = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base = [make(r.randint(1, 120)) for _ in range(30)]
    passage = make(60)
    near = base[3].split()
    near[1] = "changed"
    out = [*base, None, "", "  \t\n", base[0], base[0], " ".join(near), f"x {passage} y", f"{make(30)}\n{passage}\n{make(5)}", "zz " * 4000, "a" * 3000, "one two", "one two", passage.upper(), "##$$ !! <|endoftext|> 12 \x1c\x85 3"]
    return [(k, t, "en" if k % 3 else None, "s", len(t or "")) for k, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts() + [texts()[2], (None, "null id text", "xx", None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t, lower=True):
    raw = (t or "").encode()
    return [w.decode() for w in (raw.lower() if lower else raw).split()]


def test_word_hashes_are_those_of_the_words():
    rows = [t or "" for _, t, *_ in texts()]
    data = "".join(rows).encode()
    off = np.cumsum([0, *(len(t.encode()) for t in rows)])
    start, end, row, h = textvec.tokens(np.frombuffer(data, np.uint8), off)
    got = [data[a:b].lower().decode() for a, b in zip(start, end)]
    assert got == [w for t in rows for w in words(t)]
    assert row.tolist() == [k for k, t in enumerate(rows) for _ in words(t)]
    by = collections.defaultdict(set)
    for w, x in zip(got, h.tolist()):
        by[w].add(x)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_op1_equals_a_plain_model(spark, docs, empty, tmp_path):
    rows = docs.select("doc_id", "text").collect()
    train = [r for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    c, b = collections.Counter(), collections.Counter()
    for r in train:
        q = [*words(r.text), "\0end"]
        c.update(q)
        b.update(zip(["\0start", *q], q))
    ways, total = collections.Counter(w for _, w in b), collections.Counter()
    by = collections.defaultdict(lambda: [0, 0, 0])
    for (v, _), k in b.items():
        total[v] += k
        by[v][min(k, 3) - 1] += 1
    d = lambda n: ngram.Model.discounts(*(sum(1 for v in n.values() if v == k) for k in (1, 2, 3, 4)))
    d2, d1 = d(b), d(ways)
    floor = sum(d1[min(k, 3)] for k in ways.values()) / len(b) / (len(c) + 1)
    marked = docs.withColumn("held", ngram.held_out(F.col("doc_id")))
    model = ngram.train(marked.where("NOT held"), f"file://{tmp_path}/m")
    got = collections.defaultdict(list)
    for r in ngram.scored(marked, model).collect():
        got[r.doc_id].append(r)
    for r in rows:
        q, score, base = [*words(r.text), "\0end"], 0.0, 0.0
        for v, w in zip(["\0start", *q], q):
            p = max(0.0, ways[w] - d1[min(ways[w], 3)]) / len(b) + floor
            if total[v]:
                p = max(0.0, b[v, w] - d2[min(b[v, w], 3)]) / total[v] + sum(d2[i + 1] * by[v][i] for i in range(3)) / total[v] * p
            score += math.log10(p)
            base += math.log10((c[w] + 1) / (sum(c.values()) + len(c) + 1))
        g = got[r.doc_id][0]
        assert g.n_tokens == len(q) and g.n_known == sum(c[w] > 0 for w in q)
        assert g.score == pytest.approx(score, rel=1e-9) and g.base_score == pytest.approx(base, rel=1e-9)
    assert ngram.scored(empty, model).count() == 0
    names = marked.select("doc_id", "text", F.lit(1).alias("score"), F.lit(2).alias("_in0"), F.lit(3).alias("a.b"), F.lit(4).alias("_text"))
    again = ngram.scored(names, model, keep=("_text", "score", "_in0", "a.b", "doc_id"))
    assert again.columns == ["_text", "_in0", "a.b", "doc_id", "n_tokens", "n_known", "base_score", "score"]
    assert collections.Counter((r.doc_id, r.score) for r in again.collect()) == collections.Counter((r.doc_id, r.score) for v in got.values() for r in v)
    none = ngram.train(empty, f"file://{tmp_path}/none")
    assert all(r.score == 0 and r.n_known == 0 for r in ngram.scored(docs, none).collect())


def test_op2_round_trip_and_random_access(spark, docs, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tool = Tokenizer.from_file(path)
    blocks = tokenfile.write(docs, path, f"file://{tmp_path}/b")
    got = tokenfile.read(blocks).orderBy("start").collect()
    rows = docs.select("doc_id", "text").collect()
    want = collections.Counter()
    for r in rows:
        ids = [*tool.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert want == collections.Counter((g.doc_id, g.n_tokens, g.ids_crc32) for g in got)
    at, ids = 0, [g.doc_id for g in got]
    for g in got:
        assert g.start == at
        at += g.n_tokens
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    first = blocks.orderBy("pid", "seq").first()
    block = tokenfile.Block(bytes(first["block"]))
    whole = block.span(0, len(block.doc_ids))
    assert np.array_equal(np.concatenate([block.document(k) for k in range(len(block.doc_ids))]), whole)
    for k in range(len(block.doc_ids)):
        ids = block.document(k)
        assert [block.at(k, i) for i in range(0, len(ids), 7)] == ids[::7].tolist() and block.at(k, len(ids) - 1) == 1
    with pytest.raises(IndexError):
        block.at(0, int(block.counts[0]))
    assert tokenfile.read(tokenfile.write(empty, path, f"file://{tmp_path}/e")).count() == 0
    clash = docs.select("doc_id", "text", F.lit(1).alias("pid"), F.lit(2).alias("ids"), F.lit(3).alias("block"))
    again = tokenfile.read(tokenfile.write(clash, path, f"file://{tmp_path}/c"))
    assert collections.Counter(map(tuple, again.collect())) == collections.Counter(map(tuple, got))


def non_overlapping(seq, stop):
    """Of every pair without the stop symbol, how many times it occurs beside itself."""
    last, count = {}, collections.Counter()
    for i in range(len(seq) - 1):
        pair = seq[i], seq[i + 1]
        if stop not in pair and last.get(pair, -2) < i - 1:
            count[pair] += 1
            last[pair] = i
    return count


def test_op2_encodes_a_batch_as_the_library_does_in_few_calls():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), tokenfile.Encoder(path)
    atoms = [*"abcXYZéÀßÿñ×÷ªº0123.,;:!?'\"<>|#$%*()[]^_`~-=\\/ \t\n\x0b\x1c\x85\xa0\u2028ΣςİıﬁÅ中😀\u0301\u200d", "'s", "'ll", "It's", "<|endoftext|>", "<|", "</w>", "the", "a" * 70, "b" * 56 + "!" * 8, "c" * 57 + "!", "d" + "!" * 9]
    r = np.random.default_rng(5)
    texts = [None, "", " "] + ["".join(atoms[k] + " " * (r.random() < 0.2) for k in r.integers(0, len(atoms), int(r.integers(0, 40)))) for _ in range(3000)]
    for part in (pa.array(texts).slice(1, 700), pa.array(texts, pa.large_string())):
        got = [x for ids in own.texts(part, 333) for x in ids.to_pylist()]
        assert [np.frombuffer(x, own.kind).tolist() for x in got] == [[*lib.encode(t or "", add_special_tokens=False).ids, 1] for t in part.to_pylist()]
    assert list(own.texts(pa.array([], pa.string()))) == []

    class Counted:
        n = 0

        def encode_batch_fast(self, *args, **named):
            self.n += 1
            return whole.encode_batch_fast(*args, **named)

    whole, own.by_space = own.by_space, Counted()
    single = []
    own.tokenize = lambda t: single.append(t) or own.tool.model.tokenize(t)
    words = ["".join(map(chr, r.integers(97, 123, 9))) for _ in range(3 * tokenfile.WORDS)]
    forms = [f(w) for w in words for f in (str, str.upper, str.title, lambda w: w + ".", lambda w: w + "$$$")]
    assert len(next(own.texts(pa.array([" ".join(forms)])))[0].as_py()) > 2 * len(forms)
    assert own.by_space.n == 3 and len(single) <= 2
    own.closing[:] = False  # as of a vocabulary that doesn't mark the ends of words
    assert [np.frombuffer(x, own.kind).tolist() for x in next(own.texts(pa.array(["The house, éa"]))).to_pylist()] == [[*lib.encode("The house, éa", add_special_tokens=False).ids, 1]]


def test_op2_parts_of_a_batch_give_what_the_whole_batch_gives(spark, docs, tmp_path, monkeypatch):
    path, got = public_tokenizers.path("word_bpe_49k.json"), []
    for size in (tokenfile.PART, 700, 1):
        monkeypatch.setattr(tokenfile, "PART", size)  # goes to the workers with the function that uses it
        got.append(sorted(map(tuple, tokenfile.read(tokenfile.write(docs, path, f"file://{tmp_path}/{size}")).collect()), key=lambda r: r[1]))
    assert got[0] == got[1] == got[2] and len(got[0]) == docs.count()


def test_op2_grammar_looks_again_only_where_something_changed(monkeypatch):
    seen, plain = [], tokenfile._groups
    monkeypatch.setattr(tokenfile, "_groups", lambda left, *rest: seen.append(len(left)) or plain(left, *rest))
    ids = np.random.default_rng(6).integers(0, 400, 50_000).astype(np.uint32)
    seq, _ = tokenfile.repair(ids, 400)
    assert seen[0] == len(ids) - 1 and seen[-1] < 0.1 * len(seq) and sum(seen[1:]) < 2.5 * len(ids)


def test_op2_grammar_leaves_no_pair_twice():
    r = np.random.default_rng(2)
    for k in range(200):
        ids = r.integers(0, int(r.integers(1, 30)), int(r.integers(1, 400))).astype(np.uint32)
        if k % 4 == 0:
            ids = np.tile(ids[:9], 30)
        if k % 5 == 0:
            ids[:] = 3
        ids[r.integers(0, len(ids), int(r.integers(0, 6)))] = tokenfile.STOP
        seq, rules = tokenfile.repair(ids, 100)
        assert max(non_overlapping(seq.tolist(), tokenfile.STOP).values(), default=0) < 2
        full = {}
        for j, (x, y) in enumerate(rules.tolist()):
            full[100 + j] = [*full.get(x, [x]), *full.get(y, [y])]
        assert [v for x in seq.tolist() for v in full.get(x, [x])] == ids.tolist()
        assert tokenfile.expansions(rules, 100)[100:].tolist() == [len(full[100 + j]) for j in range(len(rules))]


def test_op2_grammar_is_smaller_than_deflated_ids():
    r = np.random.default_rng(4)
    phrases = [r.integers(2, 3000, int(r.integers(3, 12))) for _ in range(6000)]
    ids = [np.append(np.concatenate([phrases[k] for k in r.integers(0, 6000, 60)]), 1) for _ in range(500)]
    data = tokenfile.packed(np.concatenate(ids), list(range(len(ids))), np.array([len(x) for x in ids]))
    assert len(data) < len(zlib.compress(np.concatenate(ids).astype("<u2").tobytes(), 9))
    block = tokenfile.Block(data)
    assert all(np.array_equal(block.document(k), x) for k, x in enumerate(ids))


def test_op2_grammar_shrinks_repetition():
    ids = np.tile(np.array([5, 6, 7, 8, 1], np.uint32), 3000)
    block = tokenfile.Block(tokenfile.packed(ids, list(range(3000)), np.full(3000, 5)))
    assert block.n_symbols == 3000 * 2 and block.n_rules == 3
    assert np.array_equal(block.span(0, 3000), ids) and np.array_equal(block.document(1234), [5, 6, 7, 8, 1])
    wide = np.concatenate([np.arange(70_000, dtype=np.uint32), [1]])
    block = tokenfile.Block(tokenfile.packed(np.concatenate([wide, wide]), [None, 7], np.array([len(wide)] * 2)))
    assert block.doc_ids == [None, 7] and np.array_equal(block.document(1), wide) and block.at(1, 69_999) == 69_999


def test_op3_finds_planted_items_only(spark, docs, empty):
    items = [(1, "where does the quick red fox jump over sleepy dogs tonight? It jumps in the old park behind our house."), (2, "entirely other words make up this second benchmark question here, answer follows now at the end"), (3, None), (4, ""), (None, "null item words alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    planted = [(100, f"{texts()[4][1]} {items[0][1].upper()} {texts()[5][1]}"), (101, items[1][1].replace(" ", "\n")), (102, items[0][1].split("?")[0]), (103, "the old park and the quick dogs")]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(both, bench).collect()}
    assert got == {(100, 1), (101, 2)}
    kept = decontaminate.clean(both, bench)
    assert kept.columns == ["doc_id", "text"] and kept.count() == both.count() - 2
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def plain_hits(docs, items):
    """Every window of every item's length class scored in full, for texts of ASCII letters, digits and signs."""
    split = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    items = {(i, t): split(t) for i, t in items if split(t)}
    df = collections.Counter(w for q in items.values() for w in set(q))
    mean = sum(map(len, items.values())) / max(1, len(items))
    out = {}
    for (item, text), q in items.items():
        tf = collections.Counter(q)
        w = {t: math.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(q) / mean)) for t, n in tf.items()}
        m = re.search(r"(?:^|\n)\s*(?:answer|a)\s*:", text, re.IGNORECASE)
        parts = (split(text[: m.start()]), split(text[m.end() :])) if m and m.start() else ([], [])
        if not all(parts):
            k = len(q) - max(min(3, len(q) - 1), math.ceil(0.25 * len(q)))
            parts = q[:k], q[k:]
        step = 8
        while step < len(q):
            step *= 2
        for row, (doc, body) in enumerate(docs):
            b = split(body)
            for first in range(0, max(1, len(b) - step), step):
                here = b[first : first + 2 * step]
                score = sum(w[t] for t in set(here) if t in w) / sum(w.values())
                if score < 0.5 or not here:
                    continue
                share = []
                for p in parts:
                    n = min(3, len(p))
                    grams = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)} if n else set()
                    have = {tuple(here[i : i + n]) for i in range(len(here) - n + 1)} if n == 3 else None
                    share.append(1.0 if not grams else sum(g in have if n == 3 else all(t in here for t in g) for g in grams) / len(grams))
                if min(share) >= 0.5 and ((row, item) not in out or score > out[row, item][1]):
                    out[row, item] = first, score
    return collections.Counter((docs[row][0], item, first, round(score, 9)) for (row, item), (first, score) in out.items())


def test_op3_equals_a_plain_version(spark):
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 3)))
    make = lambda n: " ".join(word() for _ in range(n))
    items = [(k, make(r.randint(1, 70)) + (f"\nAnswer: {make(r.randint(1, 6))}" if k % 3 == 0 else "")) for k in range(25)]
    items += [(50, items[3][1]), (50, items[3][1]), (51, "A"), (52, None), (53, ""), (54, "?! ,")]
    docs = []
    for k in range(60):
        parts = [make(r.randint(0, 60))]
        for _ in range(r.randint(0, 2)):
            q = items[r.randrange(25)][1].split()
            for _ in range(r.randint(0, len(q) // 2)):
                q[r.randrange(len(q))] = word()
            parts += [" ".join(q), make(r.randint(0, 40))]
        docs.append((k, " ".join(parts)))
    docs += [docs[1], docs[1], (70, None), (71, ""), (72, "x " * 3000 + items[4][1] + " y" * 3000), (None, items[5][1])]
    table = spark.createDataFrame([(k, t) for k, t in docs], "doc_id int, text string")
    for kind in ("int", "string", "long"):
        bench = spark.createDataFrame([(k, t) for k, t in items], "item_id long, text string").withColumn("item_id", F.col("item_id").cast(kind))
        got = decontaminate.contaminated(table, bench)
        assert dict(got.dtypes) == {"doc_id": "int", "item_id": {"long": "bigint"}.get(kind, kind), "first_word": "bigint", "score": "double"}
        assert collections.Counter((x.doc_id, int(x.item_id), x.first_word, round(x.score, 9)) for x in got.collect()) == plain_hits(docs, [(k, t) for k, t in dict.fromkeys(items) if t])


def test_op3_an_item_is_judged_alike_beside_others(spark):
    """A long neighbour doesn't lengthen the windows of a short item."""
    r = random.Random(9)
    make = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    q = make(12).split()
    spread = " ".join(f"{w} {make(25)}" for w in q)  # an item's words, far from each other
    docs = spark.createDataFrame([(1, spread), (2, f"{make(50)} {' '.join(q)} {make(50)}")], "doc_id long, text string")
    for items in ([(1, " ".join(q))], [(1, " ".join(q)), (2, make(400))]):
        got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
        assert {(x.doc_id, x.item_id) for x in got.collect()} == {(2, 1)}


def test_op3_clean_keeps_columns_of_any_name(spark):
    schema = "_row string, text string, doc_id long, key string, item string, `a.b` int"
    rows = [("r", "some words that stand in a benchmark item", 1, "k", "i", 1), ("s", "other words", 1, None, None, None), (None, None, None, None, None, None)]
    bench = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    out = decontaminate.clean(spark.createDataFrame(rows, schema), bench)
    assert out.columns == ["_row", "text", "doc_id", "key", "item", "a.b"] and sorted(map(tuple, out.collect()), key=repr) == sorted(rows[1:], key=repr)


def test_op3_wand_equals_full_scoring():
    r = random.Random(2)
    rows, n = [], 60
    for k in range(n):
        for t in r.sample(range(80), r.randint(2, 12)):
            rows.append((k, t, r.randint(1, 3), 10, r.randint(1, n)))
    ix = decontaminate.Index([(k, f"w{k} a b c") for k in range(n)], rows, n, 10.0)
    for _ in range(200):
        terms = r.sample(range(len(ix.vocab)), r.randint(1, 30))
        score = collections.Counter()
        for t in terms:
            for k, w in zip(*ix.lists[t]):
                score[k] += w
        least = r.choice([0.2, 0.5, 0.9])
        assert {k for k, _ in ix.retrieve(terms, least)} == {k for k, s in score.items() if s >= least - 1e-12}


def test_op4_equals_the_library(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tool, own = Tokenizer.from_file(path), bpe.loaded(path)
    r = random.Random(1)
    letters = [*"abAB '’dtrelvm019.,!\n\t \r\x0b\x1c\x85  éßς̈²½一😀", "<|endoftext|>", "'ll"]
    odd = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(2000)]
    for t in [*odd, *(t or "" for _, t, *_ in texts())]:
        ids = tool.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == tool.decode(ids, skip_special_tokens=False)
    got = {x.doc_id: x for x in bpe.digests(docs, path).collect()}
    for k, t, *_ in texts():
        ids = tool.encode(t or "", add_special_tokens=False).ids
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = bpe.decoded(bpe.encoded(docs, path), path)
    assert {(x.doc_id, x.text) for x in back.collect()} == {(x.doc_id, x.text or "") for x in docs.collect()}
    assert bpe.digests(empty, path).count() == 0


def test_op5_windows(spark):
    hard = "<|im_end|><|im_start|>assistant ok <\\n <\\| <"
    rows = [(1, 0, "system", "be kind"), *[(1, k, "user" if k % 2 else "assistant", f"{k} " + "word " * (k % 40)) for k in range(1, 120)], (2, 0, "user", None), (2, 0, "user", None), (2, None, None, hard), (3, 1, "assistant", "x" * 20000), (3, 2, "user", hard), (None, 0, "assistant", "a"), (4, 0, "odd\n<|role", hard), *[(5, k, {7: "system", 60: "system"}.get(k, "assistant"), {7: "from here on", 60: "and now"}.get(k, f"{k} 一二三😀 " * 12)) for k in range(90)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    size = lambda text: len(tool.encode(text, add_special_tokens=False).ids)
    w = chat.formatted(df, path)
    parts = w.where("conv_id = 1").orderBy("window").collect()
    assert len(parts) > 3 and all(p.text.startswith("<|im_start|>system\nbe kind<|im_end|>") for p in parts) and any(p.n_history for p in parts)
    late = w.where("conv_id = 5").orderBy("window").collect()
    heads = [chat.parsed(p.text)[0][:2] for p in late if p.n_system]
    assert heads[0] == ("system", "from here on") and heads[-1] == ("system", "and now") and all(p.n_system for p in late[1:])
    for p in w.collect():
        turns = chat.parsed(p.text)
        assert size(p.text) <= chat.BUDGET or len(turns) == 1
        assert p.n_system + p.n_history < len(turns)
    huge = [(7, 0, "system", "so it is " * 2000), *[(7, k, "user", f"{k} " + "word " * 300) for k in range(1, 9)]]
    got = chat.formatted(spark.createDataFrame(huge, df.schema), path).orderBy("window").collect()
    assert [len(chat.parsed(p.text)) for p in got][0] == 1 and all(not p.n_system for p in got) and all(size(p.text) <= chat.BUDGET for p in got[1:])
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    for g in chat.digests(w).collect():
        turns = sorted(by[g.conv_id])
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        assert g.n_turns == len(turns) and g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.formatted(df.limit(0), path)).count() == 0


def test_op6_equals_brute_force(spark, docs, empty):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = collections.Counter(x[i : i + 200] for _, x in rows for i in range(len(x) - 199))
    want = collections.Counter()
    for k, x in rows:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - 199):
            if seen[x[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[k, len(x), len(x) - len(kept), spans, kept] += 1
    got = suffix.removed(docs)
    assert want == collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect())
    assert any(v[2] and v[3] > 0 for v in want)
    assert suffix.removed(empty).count() == 0
    names = docs.select("doc_id", "text", F.lit(1).alias("_text"), F.lit("2").alias("_id"), F.lit(3).alias("kept"), F.lit(4).alias("a.b"))
    again = suffix.removed(names, keep=("_text", "_id", "kept", "a.b"))
    assert again.columns == ["doc_id", "_text", "_id", "a.b", "n_bytes", "n_removed", "n_spans", "kept"]
    assert want == collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in again.collect() if (r["_text"], r["_id"], r["a.b"]) == (1, "2", 4))


@pytest.mark.parametrize("most", [3, 40, 100_000])
def test_op6_suffix_order(most):
    r = np.random.default_rng(most)
    for k in range(150):
        body = r.integers(1, int(r.integers(2, 6)), int(r.integers(1, 70)))
        if k % 3 == 0:
            body = np.tile(body[:4], 12)
        t = np.append(body, 0)
        assert suffix_order(t, most).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_op6_one_anchor_in_bounded_memory():
    import tracemalloc

    r = np.random.default_rng(6)
    core = r.integers(97, 123, 64, dtype=np.uint8).tobytes()
    context = [(r.integers(97, 123, 136, dtype=np.uint8).tobytes(), r.integers(97, 123, 136, dtype=np.uint8).tobytes()) for _ in range(3000)]
    pieces = [a + core + b for a, b in context]
    pieces[10] = context[7][0] + core + context[10][1]  # its windows up to the end of the core are those of piece 7
    pieces[2000] = context[5][0][36:] + core + context[5][1][:60]  # a part of piece 5

    def found(rows):
        shard = suffix.Shard(10_000)
        for k, p in rows:
            shard.add(k if k else None, k, 0, len(p) - 199, p)
        return [tuple(x.values()) for b in shard.matches() for x in b.to_pylist()]

    found([*enumerate(pieces)][:8])  # what is imported on first use isn't measured
    tracemalloc.start()
    got = found(enumerate(pieces))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(got) == [(5, 5, 36, 25), (7, 7, 0, 1), (10, 10, 0, 1), (2000, 2000, 0, 25)]
    assert most < sum(map(len, pieces)) * 8  # less than one array of 64-bit numbers


def test_op7_table_and_moves():
    for shards, slots in ((("a",), 7), (("a", "b", "c"), 101), (tuple(map(str, range(20))), 251)):
        at = [(sharding._number(f"offset:{s}") % slots, sharding._number(f"skip:{s}") % (slots - 1) + 1) for s in shards]
        want, turn, place = [None] * slots, 0, [0] * len(shards)
        while None in want:
            k = turn % len(shards)
            while want[s := (at[k][0] + place[k] * at[k][1]) % slots] is not None:
                place[k] += 1
            want[s] = k
            turn += 1
        assert sharding.lookup_table(shards, slots) == want
    few = sharding.lookup_table(sharding.SHARDS)
    less = sharding.lookup_table(sharding.SHARDS[:-1])
    share = collections.Counter(few)
    assert max(share.values()) - min(share.values()) <= 1
    moved = sum(a != b for a, b in zip(few, less) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.1 * len(few)
    with pytest.raises(ValueError):
        sharding.lookup_table(("a", "a"))


def test_op7_written_shards(spark, docs, empty, tmp_path):
    named = docs.withColumn("a.b", F.lit(1))
    sharding.write_shards(named, "doc_id", f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert collections.Counter((r.doc_id, r.text, r["a.b"], r.shard) for r in back.collect()) == collections.Counter((r.doc_id, r.text, r["a.b"], r.shard) for r in sharding.place(named, "doc_id").collect())
    sharding.write_shards(empty, "doc_id", f"{tmp_path}/e")


def test_op7_rows(spark, docs, empty):
    out = sharding.place(docs, "doc_id").collect()
    assert len(out) == docs.count() and all(r.shard in sharding.SHARDS for r in out)
    assert sharding.place(empty, "doc_id").count() == 0
    with pytest.raises(ValueError):
        sharding.place(docs.withColumn("Shard", F.lit(1)), "doc_id")


PAGES = {
    "<html><body><nav><a>Menu</a></nav><article><h1>T &amp; U</h1><p>One\n two&nbsp;three<p><b>Four<br>five</article><footer>f</footer></body></html>": "T & U\nOne two three\nFour five",
    "": "",
    "<p></p>": "",
    "<div class='ad'>buy<article><p>Text of the page.</p><div class='comments'><p>I disagree</p></div></article>": "Text of the page.",
    "<body><div id='cookie-notice'>We use cookies</div><div><h1>Title</h1><p>A long first paragraph that says something at length.</p><p>Short.</p><p>Another long paragraph that goes on &lt;here&gt; for some time.</p></div><aside>side</aside></body>": "Title\nA long first paragraph that says something at length.\nShort.\nAnother long paragraph that goes on <here> for some time.",
    "<article><header><h1>Head</h1><p>by me</p></header><p>Body text</p><form><p>Mail</p></form><script>x='<p>no</p>'</script></article>": "Head\nBody text",
}


def test_op8_pages(spark):
    rows = [(k, f"u{k}", h) for k, h in enumerate(PAGES)] + [(99, None, None)]
    got = {r.page_id: (r.text, r.n_chars) for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{k: (t, len(t)) for k, t in enumerate(PAGES.values())}, 99: ("", 0)}


def plain_counts(t):
    t = t or ""
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
    grams = collections.defaultdict(list)
    for i in range(len(w) - 4):
        grams[tuple(w[i : i + 5])].append(i)
    hit = {i + k for v in grams.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_op9_counts_and_verdict(spark, docs, empty):
    clash = docs.withColumn("n_words", F.lit(7)).withColumn("_q", F.lit(1))
    got = collections.Counter(tuple(r)[:6] for r in quality.quality(clash).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == collections.Counter((r.doc_id, *plain_counts(r.text)) for r in docs.collect())
    assert quality.quality(empty).count() == 0
    names = docs.select("doc_id", "text", "lang", F.lit(1).alias("_lang"), F.lit(2).alias("_in0"), F.lit(3).alias("kept"), F.lit(4).alias("a.b"))
    assert quality.quality(names, keep=("_lang", "_in0", "kept", "a.b")).columns == ["_lang", "_in0", "a.b", *quality.RESULTS]
    # 60 clean texts and one in capitals with signs
    good = [r for r in texts(8)[:30]] * 2
    rows = [(k, f"{t} {good[(k + 1) % 60][1]} {good[(k + 7) % 60][1]}", "en", "s", 0) for k, (_, t, *_) in enumerate(good)] + [(1000, " ".join(f"{w.upper()}!!" for w in (good[1][1] + good[2][1] + good[3][1]).split()), "en", "s", 0)]
    out = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not out[1000].kept and not out[1000].base_failed
    assert all(out[k].class_distance < out[1000].class_distance for k in range(60) if out[k].class_distance is not None)


def test_op9_small_languages_are_judged_by_themselves_or_not_at_all(spark):
    """An unspaced script is far from all other texts. With enough text of its own it is judged by it; with less, not at all; a larger corpus beside it changes nothing."""
    r = random.Random(12)
    other = lambda n: "".join(chr(r.randrange(0x4E00, 0x5000)) + ("\u3002\n" if k % 30 == 29 else "") for k in range(n))
    small = [(k, other(900), "zz", "s", 0) for k in range(5)]
    enough = [(100 + k, other(900), "yy", "s", 0) for k in range(30)]
    big = [(1000 + k, " ".join(t for _, t, *_ in texts(k)[:6]), "en", "s", 0) for k in range(40)]
    for rows in ([*small, *enough], [*small, *enough, *big]):
        out = {x.doc_id: x for x in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert all(out[k].kept and out[k].class_distance is None for k in range(5)) and all(out[100 + k].kept and out[100 + k].class_distance < 0.1 for k in range(30))


def test_op10_equals_brute_force(spark, docs, empty):
    more = docs
    chain = [f"c{k} " + " ".join(f"w{j}" for j in range(60)) for k in range(40)]
    more = more.select("doc_id", "text").unionByName(spark.createDataFrame([(500 + k, t) for k, t in enumerate(chain)], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in more.collect() if r.doc_id is not None]
    sets = []
    for _, t in rows:
        q = words(t)
        sets.append({tuple(q[i : i + 5]) for i in range(len(q) - 4)} if len(q) > 4 else {tuple(q)} if q else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[find(k)] = min(d, least.get(find(k), d))
    want = collections.Counter((d, len(sets[k]), least[find(k)], d == least[find(k)]) for k, (d, _) in enumerate(rows))
    clash = more.select("doc_id", "text", F.lit(1).alias("node"), F.lit(2).alias("kept"), F.lit(3).alias("sig"), F.lit(4).alias("a.b"))
    out = minhash.near_duplicates(clash, keep=("node", "kept", "sig", "a.b"))
    assert out.columns == ["doc_id", "node", "sig", "a.b", "n_shingles", "component_id", "kept"]
    got = out.where("doc_id IS NOT NULL").collect()
    assert want == collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got)
    assert minhash.near_duplicates(empty).count() == 0


def test_op10_large_groups_are_split_into_cells_without_losing_links(spark, monkeypatch):
    """Near copies of two texts, most pairs of which aren't similar enough, in cells of a few members; rows of the cells stay in proportion to the members."""
    monkeypatch.setattr(minhash, "ROWS_OF_BLOCK", 8)
    monkeypatch.setattr(minhash, "BYTES_OF_BLOCK", 3000)
    r = random.Random(21)
    made = []
    for g in range(2):
        base = [f"g{g}w{k}" for k in range(60)]
        for _ in range(45):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(60)] = f"x{r.randrange(1000)}"
            made.append(" ".join(t))
        made += [made[-1]] * 5
    r.shuffle(made)
    sets = [{tuple(q[i : i + 5]) for i in range(len(q) - 4)} for q in (t.split() for t in made)]
    root = list(range(len(made)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(made)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert len({find(k) for k in range(len(made))}) > 4
    got = minhash.near_duplicates(spark.createDataFrame([(k, t) for k, t in enumerate(made)], "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == {k: find(k) for k in range(len(made))}


def test_op10_pruning_keeps_similar_pairs():
    for n in (16, 64, 128):
        m = minhash.least_equal(n)
        lost = sum(math.comb(n, k) * 0.75**k * 0.25 ** (n - k) for k in range(m))
        assert lost < 1e-3 and 0 < m < 0.75 * n
