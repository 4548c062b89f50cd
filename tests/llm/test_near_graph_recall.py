"""What the near graph does when its search misses links."""

import numpy as np
import pytest

from newslab.llm import near_graph


def truth(rows, threshold=0.9):
    """Links and smallest reachable row of each row, by all pairs."""
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    link = unit @ unit.T >= threshold
    np.fill_diagonal(link, False)
    label = np.arange(len(rows))
    for _ in range(len(rows)):
        label = np.minimum(label, np.where(link, label[None, :], len(rows)).min(axis=1))
    return link.sum(axis=1).tolist(), label.tolist()


def groups(n=700, hot=0, pairs=0, copied=0, dim=16, seed=11):
    """Rows far apart, a group of near copies, pairs of near copies and exact copies."""
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dim))
    near = base[0] + 0.03 * r.normal(size=(hot, dim))
    twins = base[1:1 + pairs] + 0.03 * r.normal(size=(pairs, dim))
    return np.concatenate([base, near, twins, base[n - copied:]])


def result(spark, rows):
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)],
                                  "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in near_graph.near_duplicates(table).collect()}
    assert set(got) == {*range(len(rows))}
    return [got[i].n_links for i in range(len(rows))], [got[i].component_id for i in range(len(rows))]


@pytest.mark.parametrize("lot", [100, 2048])
def test_a_search_that_finds_nothing_ends_in_all_pairs(spark, lot, monkeypatch):
    none = np.zeros(0, np.int64)
    for name, value in (("LOT", lot), ("MOST_OVERLAP", 3), ("BLOCK", 150), ("TILE", 64)):
        monkeypatch.setattr(near_graph, name, value, raising=False)
    monkeypatch.setattr(near_graph, "range_search", lambda *_: (none, none))
    rows = groups(n=300, hot=60, pairs=20, copied=3)
    assert result(spark, rows) == truth(rows)


def test_a_hot_group_does_not_hide_lost_pairs(spark, monkeypatch):
    for name, value in (("LOT", 200), ("MOST_OVERLAP", 3)):
        monkeypatch.setattr(near_graph, name, value)
    search = near_graph.range_search

    def without_small_groups(asks, *rest):
        q, found = search(asks, *rest)
        keep = np.bincount(q, minlength=len(asks))[q] > 10
        return q[keep], found[keep]

    monkeypatch.setattr(near_graph, "range_search", without_small_groups)
    rows = groups(n=500, hot=300, pairs=20)
    assert result(spark, rows) == truth(rows)
