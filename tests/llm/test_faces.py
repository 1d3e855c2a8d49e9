"""Links and searches of faces against brute force."""

import math

import numpy as np
import pytest

from docuvet.llm import face_links, face_search

BAD = [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, []]
SCHEMA = "case_id long, selfie_embedding array<float>, label int, length int, leaf string"


@pytest.fixture(scope="module")
def faces(spark):
    rng = np.random.default_rng(11)
    people = rng.normal(size=(60, 8))
    rows = [people[rng.integers(60)] + rng.normal(size=8) * rng.choice([0, 0.05, 0.2]) for _ in range(500)]
    rows += [2 * rows[0], -rows[1], rows[2], rows[2]]
    rows = [[float(np.float32(x)) for x in r] for r in rows] + BAD + [[1.0, 2.0], [2.0, 4.0]]
    return rows, spark.createDataFrame([(i, r, i % 3, 1, "x") for i, r in enumerate(rows)] + [(None, rows[0], 0, 0, "y")], SCHEMA)


def cosines(rows):
    ok = {i: np.array(r) for i, r in enumerate(rows) if r and all(x is not None and math.isfinite(x) for x in r) and any(r)}
    return ok, {(i, j): float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) for i, a in ok.items() for j, b in ok.items() if i != j and len(a) == len(b)}


@pytest.mark.parametrize("small", [{}, {"LEAF": 40, "BLOCK": 16}, {"LARGE": 60, "BLOCK": 16}])
def test_links_match_brute_force(spark, faces, small, monkeypatch):
    for name, value in small.items():  # many leaves, several blocks in a leaf; leaves split again
        monkeypatch.setattr(face_links, name, value)
    rows, df = faces
    _, cosine = cosines(rows)
    near = {p for p, c in cosine.items() if c >= 0.95}
    label = {i: i for i in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for i, j in near:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    got = face_links.link_faces(df).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.case_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, None)
        else:
            assert r.n_links == sum(i == r.case_id for i, _ in near), r
            assert (r.component_id, r.kept) == (label[r.case_id], label[r.case_id] == r.case_id)
    assert face_links.link_faces(df.filter("false")).count() == 0


def test_nearest_faces_match_brute_force(spark, faces):
    """With the whole block compared, the forest is exact; ties go to the smaller case."""
    rows, df = faces
    ok, cosine = cosines(rows)
    got = face_search.nearest_faces(df, df.filter("case_id % 7 = 0"), share=1.0, block=100).collect()
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) == {i for i in ok if i % 7 == 0}
    for q, found in by_query.items():
        found.sort(key=lambda r: r["rank"])
        want = sorted((-c, j) for (i, j), c in cosine.items() if i == q)[:5]
        assert [r["rank"] for r in found] == list(range(1, len(want) + 1))
        assert np.allclose([r.score for r in found], [-s for s, _ in want], atol=1e-12)
        assert all(abs(cosine[q, r.case_id] - r.score) < 1e-12 for r in found)
    assert face_search.nearest_faces(df.filter("false"), df).count() == 0
    assert face_search.nearest_faces(df, df.filter("false")).count() == 0


def test_recall_of_the_forest(spark):
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(1500, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "case_id long, selfie_embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    hit = total = 0
    for r in face_search.nearest_faces(df, df.filter("case_id % 50 = 0"), block=500).groupBy("query_id").agg({"case_id": "collect_list"}).collect():
        score = unit @ unit[r.query_id]
        score[r.query_id] = -2
        hit += len(set(np.argsort(-score)[:5]) & set(r[1]))
        total += 5
    assert total == 150 and hit >= 0.9 * total


@pytest.mark.parametrize("size", [2, 3, 6, 30, 100, 200])
def test_small_tables_and_rare_lengths_give_all_they_hold(spark, size):
    """Every query gets k faces, or all others if there are fewer, also among few faces of one length in a larger table."""
    rng = np.random.default_rng(size)
    rows = [*rng.normal(size=(size, 64)), *rng.normal(size=(300, 32))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "case_id long, selfie_embedding array<double>")
    unit = np.array([v / np.linalg.norm(v) for v in rows[:size]])
    hit = 0
    want = min(5, size - 1)
    got = face_search.nearest_faces(df, df.filter(f"case_id < {size}"), block=250).groupBy("query_id").agg({"case_id": "collect_list"}).collect()
    for r in got:
        score = unit @ unit[r.query_id]
        score[r.query_id] = -2
        assert len(r[1]) == want
        hit += len(set(np.argsort(-score)[:want]) & set(r[1]))
    assert len(got) == size and hit >= 0.9 * size * want


def _with_hot_person(total, cosine):
    """Random faces, a third of them round one person at about the given mutual cosine."""
    rng = np.random.default_rng(13)
    unit = rng.normal(size=(total, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    hot = total // 3
    unit[:hot] = math.sqrt(cosine) * unit[-1] + math.sqrt(1 - cosine) * unit[:hot]
    return unit / np.linalg.norm(unit, axis=1)[:, None]


@pytest.mark.parametrize("cosine", [0.9, 0.95])
def test_trees_stay_small_where_a_third_of_the_faces_is_alike(cosine):
    sample = _with_hot_person(4000, cosine)
    tree = face_links.Tree(0, sample, 12_000)
    assert sum(len(inside) for _, inside in tree.leaves_of(sample)) <= face_links.COPIES * len(sample)


def test_links_of_a_hot_person_match_brute_force(spark, monkeypatch):
    for name, value in {"LEAF": 100, "LARGE": 150, "BLOCK": 64}.items():
        monkeypatch.setattr(face_links, name, value)
    unit = _with_hot_person(900, 0.95)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "case_id long, selfie_embedding array<double>")
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    got = {r.case_id: r.n_links for r in face_links.link_faces(df).collect()}
    assert want.sum() > 10_000 and got == dict(enumerate(want.tolist()))
