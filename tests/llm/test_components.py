"""Components against plain merging, and the number of steps that they and the set join take."""

import random

import pytest

from driftlens.llm import setjoin
from driftlens.llm.components import components
from driftlens.llm.workspace import Workspace

EDGES = "a long, b long"


@pytest.fixture
def steps(monkeypatch):
    """Labels of the tables that are written."""
    labels, keep = [], Workspace.keep

    def noted(self, df, label, *rest, **named):
        labels.append(label)
        return keep(self, df, label, *rest, **named)

    monkeypatch.setattr(Workspace, "keep", noted)
    return labels


def merged(edges):
    root = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            for x in (a, b):
                root.setdefault(x, x)
            low, high = sorted((root[a], root[b]))
            root = {x: low if r == high else r for x, r in root.items()}
    return root


@pytest.mark.parametrize("seed", range(4))
def test_components_are_those_of_plain_merging(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(rng.choice([5, 20, 60]))]
    chain = list(range(100, 140))
    rng.shuffle(chain)
    edges += [*zip(chain, chain[1:]), (1, 1), (None, 3), (7, None), *edges[:3]]
    got = components(spark.createDataFrame(edges, EDGES), Workspace(spark, "test"), "c").collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.root for r in got} == merged(edges)


def test_stars_take_one_pair_of_steps(spark, steps):
    edges = [(k % 3, k) for k in range(3, 60)]
    got = components(spark.createDataFrame(edges, EDGES), Workspace(spark, "test"), "c").collect()
    assert {r.node: r.root for r in got} == merged(edges)
    assert steps == ["c-large1", "c-small1"]
    assert components(spark.createDataFrame([], EDGES), Workspace(spark, "test"), "e").count() == 0


def test_rounds_without_a_link_make_no_components(spark, steps):
    """Texts that share many shingles, none of them near enough to another: one round of components, of no edge."""
    rng = random.Random(5)
    lines = [" ".join(f"w{rng.randrange(300)}" for _ in range(12)) for _ in range(30)]
    texts = ["\n".join(x for x in lines if rng.random() < 0.6) for _ in range(40)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    assert not any(100 * len(x & y) >= 75 * len(x | y) for i, x in enumerate(sets) for y in sets[:i])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in setjoin.similar_documents(docs).collect()}
    assert got == {k: k for k in range(40)}
    assert sum(x.startswith("live") for x in steps) > 2
    assert [x for x in steps if "-small" in x] == ["round0-small1"]
