"""The registered queries without SQL, and the pipeline, against brute force on small tables."""

import collections
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from graphloom.llm import merge_dropout, near_dup, packing, pii, quality, registry, subwords
from tests.llm.test_operators import SCHEMA, brute_spans, check_packed, held_out, multiset, prose, weighted

FOLDER = "/root/testdata/sf0.001"
on_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    return subwords.ChunkEncoder(subwords.vocabulary_path()).tokenizer


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@on_tables
def test_op4_and_op7(spark, texts, library):
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
    rows = registry.QUERIES["op4_best_fit_packing"](spark, FOLDER).collect()
    check_packed(rows, ids)
    assert {r["doc_id"] for r in rows} == set(ids)
    lengths = collections.Counter(n for x in ids.values() for _, n in packing.cut(len(x)))
    plain = sum(n for _, n in packing.best_fit(np.array([lengths[i] for i in range(1025)]), 1024))
    assert len({r["sequence_id"] for r in rows}) <= plain
    found, at = {r["doc_id"]: r for r in registry.QUERIES["op7_simple8b_ids"](spark, FOLDER).collect()}, 0
    for d in sorted(ids):
        assert (found[d]["start"], found[d]["n_tokens"], found[d]["ids_crc32"]) == (at, len(ids[d]), crc(ids[d]))
        at += len(ids[d])


@on_tables
def test_op1(spark, texts):
    rows = registry.QUERIES["op1_pii_surrogates"](spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    listed = {r["doc_id"]: r["found"] for r in table.select("doc_id", pii.entities(table["text"]).alias("found")).collect()}
    assert sum(map(len, listed.values())) > 0
    for r in rows:
        plain = [e for e in listed[r["doc_id"]] if not e.startswith(pii._BARE) and pii._TOLD not in e]
        assert r["n_entities"] == len(listed[r["doc_id"]]) and (plain or r["n_entities"] or r["text"] == texts[r["doc_id"]])
        assert not any(e in r["text"] for e in plain)


@on_tables
def test_op6(spark, texts):
    rows = registry.QUERIES["op6_merge_dropout"](spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and all(r["lossless"] for r in rows)
    own, some = merge_dropout.model(merge_dropout.model_path()), sorted(texts, key=lambda d: len(texts[d]))[:60]
    for r in rows:
        if r["doc_id"] in some:
            assert crc(own.encode(pa.array([texts[r["doc_id"]]]))[0]) == r["ids_crc32"]  # alone, not in its slice


@on_tables
def test_op8(spark, texts):
    names = sorted(texts)
    sets, name = {d: multiset(texts[d]) for d in names}, {d: d for d in names}
    for i, a in enumerate(names):
        for b in names[:i]:
            if texts[a] == texts[b] or (min(sum(sets[a].values()), sum(sets[b].values())) >= 0.8 * max(sum(sets[a].values()), sum(sets[b].values())) and weighted(sets[a], sets[b]) >= 0.8):
                low, high = sorted((name[a], name[b]))
                name = {d: low if x == high else x for d, x in name.items()}
    assert {r["doc_id"]: r["class_id"] for r in registry.QUERIES["op8_dart_minhash"](spark, FOLDER).collect()} == name


@on_tables
def test_op10(spark, texts):
    rows = registry.QUERIES["op10_semantic_neighbours"](spark, FOLDER).collect()
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(texts)
    assert all(r["held_out"] == held_out(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    tested = [r for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert np.mean([r["predicted"] == marks[r["doc_id"]] for r in tested]) > 0.85


def test_pipeline_against_brute_force(spark, tmp_path, library):
    rng, texts, marks = random.Random(5), [], {}
    sentence = lambda: prose(rng.random(), rng.randrange(6, 14)).capitalize() + rng.choice([". ", "? ", ".\n"])
    passage = "".join(sentence() for _ in range(6))
    for i in range(120):
        good = i % 4 > 0
        body = [sentence() for _ in range(rng.randrange(8, 15))]
        if good and i % 5 == 0:
            body.insert(4, passage)
        if good and i % 7 == 0:
            body.append(f"Write to user{i}@mail.example.com now. ")
        text = "".join(body) if good else rng.choice(["$$$ ", " | ", "!!! "]).join(prose(i, 60).upper().split())
        texts.append(text)
        marks[i] = int(good)
    texts += [texts[1], texts[2].replace(texts[2].split(" ")[9], "changed", 1), None, "", texts[5] + " "]
    rows = [(i, t, "en", "h", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, q in marks.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = quality.fit(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    kept = [i for i, s in enumerate(model.score(pa.array(texts)).tolist()) if s >= quality.ACCEPT]
    assert {i for i in kept if i < 120} == {i for i, q in marks.items() if q}
    sets, ones = {i: multiset(texts[i]) for i in kept}, []
    for i in kept:  # in rising order, so that a class keeps its smallest id
        if not any(weighted(sets[i], sets[j]) >= 0.8 for j in ones):
            ones.append(i)
    assert len(ones) < len(kept)
    cleaned = dict(zip(ones, brute_spans([texts[i] for i in ones]), strict=True))
    assert sum(passage[:200] in t for t in cleaned.values()) == 1
    table = spark.createDataFrame([(i, t, "en", "h", len(t)) for i, t in cleaned.items()], SCHEMA)
    final = {r["doc_id"]: r["text"] for r in pii.replace_entities(table).collect()}
    assert not any(f"user{i}@" in t for i, t in final.items())
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in final.items()}
    check_packed(found, ids)
    assert {r["doc_id"] for r in found} == set(ids)


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    odd = [(None, "no id", None, None, None), (1, None, "en", "h", 0), (1, None, "en", "h", 0), (2, "", None, "h", 0), (3, "x" * 40_000, "en", None, 40_000)]
    for name, rows in (("odd", odd), ("empty", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == docs.columns
            assert stage(spark, docs, folder).count() <= len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).where("piece = 0").count() == len(rows)
        assert corpus_pipeline.run(spark, folder).count() >= 0
        assert near_dup.near_duplicates(docs).count() == len(rows)
