"""Vector operators and the pipeline against plain versions."""

import numpy as np
import pytest

import corpus_pipeline
from newslab.llm import block_knn, near_graph

SCHEMA = "vec_id long, embedding array<double>, v string, id string"


def clouds(n=300, copies=40, dim=16, seed=3):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dim))
    near = base[0] + 0.08 * r.normal(size=(copies, dim))
    return np.concatenate([base, near, base[5:9], base[5:7] * 3])


def table(spark, rows):
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] * 16, [1.0, 2.0], [1.0, 2.0]]
    made = [(i, [float(x) for x in v], "a", "b") for i, v in enumerate(rows)]
    made += [(1000 + i, v, "a", "b") for i, v in enumerate(odd)]
    made += [(None, made[0][1], "a", "b"), made[3], made[3]]
    return spark.createDataFrame(made, SCHEMA)


@pytest.mark.parametrize("lot", [2048, 100])
def test_near_graph_finds_the_links(spark, lot, monkeypatch):
    monkeypatch.setattr(near_graph, "LOT", lot)
    rows = clouds()
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(rows))
    for _ in range(len(rows)):
        label = np.minimum(label, np.where(link, label[None, :], len(rows)).min(axis=1))
    got = {r.vec_id: r for r in near_graph.near_duplicates(table(spark, rows)).collect()}
    assert set(got) == {*range(len(rows)), *range(1000, 1008)}
    n = np.array([got[i].n_links for i in range(len(rows))])
    assert (n <= link.sum(axis=1)).all() and n.sum() >= 0.97 * link.sum()
    assert [got[i].component_id for i in range(len(rows))] == label.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert got[1006].n_links == 1 and got[1007].component_id == 1006 and got[1000].n_links == 0


def test_block_join_is_exact(spark, monkeypatch):
    for name, value in (("QUERY_BLOCK", 8), ("CANDIDATE_BLOCK", 100), ("TILE", 30)):
        monkeypatch.setattr(block_knn, name, value)
    rows = clouds()
    got = {}
    for r in block_knn.nearest(table(spark, rows), "id % 20 = 0", k=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    score = rows @ rows.T
    for q in range(0, len(rows), 20):
        order = sorted((-round(score[q, i], 9), i) for i in range(len(rows)) if i != q)[:20]
        assert [i for _, i, _ in sorted(got[q])] == [i for _, i in order]
        assert np.allclose([s for *_, s in sorted(got[q])], [-s for s, _ in order])
    assert set(got) == set(range(0, len(rows), 20))
    assert block_knn.nearest(table(spark, rows).limit(0), "id % 20 = 0").count() == 0


def test_empty_vectors(spark):
    assert near_graph.near_duplicates(table(spark, clouds()).limit(0)).count() == 0


def test_pipeline_stages_keep_the_columns_of_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, folder)
        assert after.columns == docs.columns, name
        assert after.count() <= kept.count() and after.select("doc_id").subtract(kept.select("doc_id")).count() == 0
        kept = spark.createDataFrame(after.collect(), docs.schema)
    pieces = corpus_pipeline.into_sequences(spark, kept, folder)
    assert pieces.select("doc_id").distinct().count() == kept.count()
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
