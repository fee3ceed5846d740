"""The pipeline on planted documents, and against plain versions of its five stages applied one after the other."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
from test_corpus_operators import SCHEMA, plain_hits
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import minhash, quality


def prose(r, n):
    vocab = ["the", "of", "and", "to", "in"] + ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 8))) for _ in range(3000)]
    return " ".join(r.choice(vocab[:5]) if r.random() < 0.3 else r.choice(vocab) for _ in range(n))


def plain_pipeline(rows, items):
    """Rows (doc_id, text, ...) that repeat count once; whatever stage rejects a document, later stages don't see it."""
    docs = {(i, t): (i, t, lang) for i, t, lang, *_ in rows}
    con = duckdb.connect()

    def sql(query):
        con.execute("CREATE OR REPLACE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [list(d) for d in docs.values()])
        return con.execute(f"SELECT doc_id, kept FROM ({query})").fetchall()

    good = {i for i, kept in sql(quality.oracle_sql()) if kept}
    docs = {k: d for k, d in docs.items() if k[0] in good}
    good = {i for i, kept in sql(minhash.oracle_sql()) if kept}
    docs = {k: d for k, d in docs.items() if k[0] in good}
    seen = collections.Counter(x[i : i + 200] for _, t, _ in docs.values() for x in [t.encode()] for i in range(len(x) - 199))
    left = {}
    for i, t, _ in docs.values():
        x = t.encode()
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                gone[k : k + 200] = True
        if not gone.all():
            left[i] = np.frombuffer(x, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    bad = {i for i, *_ in plain_hits([*left.items()], items)}
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: tool.encode(t, add_special_tokens=False).ids for i, t in left.items() if i not in bad}, left


def test_pipeline_equals_plain_stages(spark, tmp_path):
    r = random.Random(11)
    clean = [(k, prose(r, 90 + 7 * k), "en", "s", 1) for k in range(30)]
    item = "which of the seven planets has rings of ice and rock around it today? Saturn has the brightest rings of all planets."
    passage = prose(r, 60)
    near = clean[5][1].split()
    near[4] = "changed"
    rows = [
        *clean, (100, clean[4][1], "en", "s", 1), (101, " ".join(near) + " tail", "en", "s", 1), (102, f"{item} {prose(r, 80)}", "en", "s", 1), (103, "junk", "en", "s", 1), (104, None, None, None, None), (105, "", "en", "s", 0),
        (106, f"{prose(r, 70)} {passage} {prose(r, 70)}", "en", "s", 1), (107, f"{prose(r, 50)} {passage} {prose(r, 90)}", "en", "s", 1), (108, "".join(f"{w.upper()}## " for w in prose(r, 90).split()), "en", "s", 1), (109, prose(r, 20000), "en", "s", 1), (110, "again " * 50, "en", "s", 1),
    ]
    d = str(tmp_path)
    df = spark.createDataFrame([*rows, rows[3], rows[3]], SCHEMA)
    df.selectExpr("*", "1 AS _row", "2 AS _th", "3 AS _hash", "4 AS kept", "5 AS node", "6 AS _text").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = corpus_pipeline.run(spark, d).collect()
    got = {x.doc_id: x.ids for x in out}
    want, texts = plain_pipeline(rows, [(1, item)])
    assert got == want and len(out) == len(got)
    assert not {100, 101, 102, 103, 104, 105, 108, 110} & got.keys() and len(got.keys() & set(range(30))) >= 20
    assert passage[:150] not in texts[106] and passage[:150] not in texts[107]
    assert all(x.ids_sha256 == hashlib.sha256(",".join(map(str, x.ids)).encode()).hexdigest() and x.decoded_sha256 == hashlib.sha256(texts[x.doc_id].encode()).hexdigest() for x in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_strings", "decontamination", "tokens"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, d).columns == docs.columns, name


def test_pipeline_of_no_documents(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
