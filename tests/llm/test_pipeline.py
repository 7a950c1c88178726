import random

import pytest

import corpus_pipeline
from lodesearch.llm import packing

from .conftest import odd_rows
from .test_packing import check, n_tokens

ITEMS = "item_id long, text string"


def sentences(prose, seed, n):
    r = random.Random(seed)
    return " ".join(prose(seed * 1000 + k, r.randint(5, 12)).capitalize() + "." for k in range(n))


@pytest.fixture
def folder(spark, tmp_path):
    def write(docs, items):
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


def test_planted_cases(spark, documents, prose, folder):
    clean = [(k, sentences(prose, k, 12)) for k in range(150)]
    item = prose(5555, 30)
    secret = "".join(random.Random(4).choices("0123456789abcdef", k=40))
    rows = clean + [
        (500, "%$# @@@ *** " * 60),
        (501, clean[3][1].replace(clean[3][1].split()[20], "edited")), (502, clean[4][1]),
        (503, f"{sentences(prose, 503, 6)} {item} {sentences(prose, 504, 6)}"),
        (505, f"{sentences(prose, 505, 6)} token {secret} {sentences(prose, 506, 6)}"),
    ]
    sf_dir = folder(documents(rows), [(1, item)])
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        seen[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: {r.doc_id for r in own} for n, own in seen.items()}
    assert 500 not in ids["quality_rules"] and {501, 502, 503, 505} <= ids["quality_rules"] and len(ids["quality_rules"]) >= 148
    assert ids["quality_rules"] - ids["near_dedup"] == {501, 502}
    assert ids["near_dedup"] - ids["decontamination"] == {503}
    assert ids["secret_scan"] == ids["decontamination"]
    texts = {r.doc_id: r.text for r in seen["secret_scan"]}
    assert secret not in texts[505] and {i: t for i, t in clean if i in texts} == {i: texts[i] for i, _ in clean if i in texts}
    want = [(i, n_tokens(t)) for i, t in texts.items()]
    check(seen["best_fit_packing"], want, packing.CAPACITY)
    check(corpus_pipeline.run(spark, sf_dir).collect(), want, packing.CAPACITY)


def test_odd_rows(spark, documents, prose, folder):
    rows = odd_rows(prose)
    sf_dir = folder(documents(rows, clashing=True), [(None, None), (1, "")])
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == {3, 4, 5, 7, 8, None}


def test_empty(spark, documents, folder):
    assert corpus_pipeline.run(spark, folder(documents([]), [])).isEmpty()
