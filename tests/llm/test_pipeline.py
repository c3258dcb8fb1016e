"""The pipeline's stages against brute force, on rows with nulls, empty texts, copies, repeated ids and clashing columns."""

import numpy as np
import pytest
from test_operators import brute_lines, edited, ids, split, words

import corpus_pipeline
from netohm.llm import order_minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_deleted string, __gone string, class_id string, h string"
EXTRA = ("en", "hot", 7, "a", "b", "c", "d", "e")


def prose(seed, n=80):
    w = words(seed, n)
    return "\n".join(" ".join(w[i : i + 10]) for i in range(0, n, 10))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    item = "the shop sells 12 apples and then 5 pears to each of those people"
    base = prose(900, 200)
    texts = [prose(i) for i in range(60)] + ["### $$$ !!! " * 20 for _ in range(30)]
    texts += [None, "", base, base, base.replace(" ", "  "), "\n".join(edited(base.split("\n"), 5, 1)), f"{prose(950)}\n{item.replace('12', '30')}", f"{prose(951)}\n{prose(3)}"]
    rows = [(i, t, *EXTRA) for i, t in enumerate(texts)]
    rows += [(92, prose(960), *EXTRA), (92, base, *EXTRA)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60)) for i in range(85)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["text"] is not None)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / str(k)))
        got = docs.collect()
        if name == "packing":
            break
        assert docs.columns == columns and all(tuple(r)[2:4] + tuple(r)[5:] == EXTRA[:2] + EXTRA[3:] for r in got)
        now = sorted((r["doc_id"], r["text"]) for r in got if r["text"] is not None)
        if name == "quality classifier":
            gone = {i for i, _ in before} - {i for i, _ in now}
            assert set(range(60, 90)) <= gone and not gone & (set(range(60)) | {92, 93, 94, 95, 96, 97})
        if name == "line dedup":
            place = sorted({(i, t): None for i, t in before}, key=lambda x: (x[0], order(spark, x[1])))
            want = dict(zip(place, brute_lines(place, 2, 10, 50)))
            assert now == sorted((i, want[i, t]) for i, t in before if split(want[i, t]) or want[i, t] == t)
        if name == "near duplicates":
            assert {i for i, _ in now} == {i for i, _ in before} - later(before)
        if name == "benchmark decontamination":
            assert now == [x for x in before if x[0] != 96]
        before = now
    texts = {i: [t for j, t in before if j == i] for i, _ in before} | {r["doc_id"]: [None] for r in spark.read.parquet(str(tmp_path / "3")).where("text is null").collect()}
    assert {p["doc_id"] for p in got} == set(texts)
    for i, own in texts.items():
        sizes = sorted(len(ids(t, 0)) for t in own)
        assert sum(p["length"] for p in got if p["doc_id"] == i) == sum(sizes)
    last = {}
    for p in sorted(got, key=lambda p: p["offset"]):
        assert last.get(p["sequence_id"], 0) == p["offset"]
        last[p["sequence_id"]] = p["offset"] + p["length"]


def order(spark, text):
    from pyspark.sql import functions as F

    return spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]


def later(rows):
    """Ids whose class of pairs at 0.8 or more, all compared with all, holds a smaller one; of a repeated id each text meets its exact copies."""
    code, seqs, copies = {}, {}, {}
    for i, t in rows:
        seqs.setdefault(i, np.array([code.setdefault(w, len(code)) for w in split(t)], np.uint32))
        copies.setdefault(i, set()).add(tuple(split(t)))
    root = {i: i for i in seqs}
    for i in seqs:
        for j in seqs:
            if j < i and len(seqs[i]) and (copies[i] & copies[j] - {()} or order_minhash.aligned(seqs[i], seqs[j], 5, 0.8) >= 0.8):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return {i for i, r in root.items() if r != i}


def test_empty_tables(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 60
