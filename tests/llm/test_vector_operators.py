"""Operators on vectors against brute force, and on odd rows."""

import random

import numpy as np
import pytest

from panelcast import session
from panelcast.llm import components, multi_index, quantised

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows():
    r = np.random.default_rng(3)
    out = [(i, r.standard_normal(16).astype(np.float32).tolist(), int(r.integers(0, 3))) for i in range(300)]
    hub = r.standard_normal(16)
    out += [(1000 + i, (hub + 0.15 * r.standard_normal(16)).astype(np.float32).tolist(), 1) for i in range(200)]
    out += [(2000 + i, hub.astype(np.float32).tolist(), 1 + i % 2) for i in range(40)]
    nan, inf = float("nan"), float("inf")
    out += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [nan] + [1.0] * 15, 1), (3003, [None] + [1.0] * 15, 1), (3004, [inf] + [1.0] * 15, 1), (3005, [], 1)]
    return out + [(3006, [1.0, 2.0], 1), (3007, hub.astype(np.float32).tolist(), None), (None, hub.astype(np.float32).tolist(), 1), (2000, hub.astype(np.float32).tolist(), 1)]


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    return (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))


@pytest.mark.parametrize("tile", [2048, 37])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(quantised, "TILE", tile)
    data = rows()
    root, links = list(range(len(data))), [0] * len(data)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, v, lab) in enumerate(data):
        for j in range(i):
            if lab is not None and lab == data[j][2] and good(v) and good(data[j][1]) and len(v) == len(data[j][1]) and cosine(v, data[j][1]) >= 0.93:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (key, *_) in enumerate(data):
        if key is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), key)
    expected = sorted((str(key), links[i], least.get(find(i), key)) for i, (key, *_) in enumerate(data))
    got = quantised.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()
    assert sorted((str(x.vec_id), x.n_links, x.component_id) for x in got) == expected
    assert all(x.kept == (x.vec_id == x.component_id) for x in got if x.vec_id is not None)
    assert quantised.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_error_bounds_hold():
    r = np.random.default_rng(5)
    for scale in (1e-3, 1.0, 50.0):
        x, y = r.standard_normal((200, 24)) ** 3 * scale, r.standard_normal((180, 24))
        x, y = x / np.linalg.norm(x, axis=1)[:, None], y / np.linalg.norm(y, axis=1)[:, None]
        (qx, sx, kx, ex), (qy, sy, _, ey) = quantised.quantise(x), quantised.quantise(y)
        product = (qx.astype(float) @ qy.T.astype(float)) * sx[:, None] * sy[None, :]
        assert (np.abs(product - x @ y.T) <= ex[:, None] + kx[:, None] * ey[None, :] + 1e-12).all()


def test_search_finds_the_nearest(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 100)
    data = [x for x in rows() if x[0] not in (None,)]
    data = list({x[0]: x for x in data}.values())
    d = spark.createDataFrame(data, SCHEMA).repartition(4)
    got = multi_index.nearest(d, d.where("vec_id % 10 = 0")).collect()
    usable = {k: v for k, v, _ in data if good(v) and len(v) == 16}
    asked = [k for k in usable if k % 10 == 0]
    assert {x.query_id for x in got} == set(asked)
    hits = 0
    for q in asked:
        best = sorted((k for k in usable if k != q), key=lambda k: (-cosine(usable[k], usable[q]), k))[:5]
        mine = sorted((x for x in got if x.query_id == q), key=lambda x: x["rank"])
        assert [x["rank"] for x in mine] == [1, 2, 3, 4, 5]
        assert all(x.score == pytest.approx(cosine(usable[q], usable[x.vec_id]), abs=1e-12) for x in mine)
        assert [(x.score, -x.vec_id) for x in mine] == sorted(((x.score, -x.vec_id) for x in mine), reverse=True)
        hits += len(set(best) & {x.vec_id for x in mine})
    assert hits >= 0.9 * 5 * len(asked)
    few = spark.createDataFrame(data[:3], SCHEMA)
    assert multi_index.nearest(few, few).count() == 6
    assert multi_index.nearest(few.limit(0), few).count() == 0 and multi_index.nearest(few, few.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_many_blocks_give_the_best_of_each_and_store_few_rows(spark, monkeypatch, tmp_path, kind):
    """Found rows are not stored once for each block and query; each block is widened by itself as by brute force."""
    r = np.random.default_rng(4)
    x = r.standard_normal((1500, 16)).astype(np.float32).astype(float)
    x[700:720], x[900:960] = x[3], -x[:60]
    if kind == "double":
        x[5:130:31] *= 1e-170  # squares vanish
    data = [*enumerate(x.tolist()), (700, x[3].tolist()), (700, x[4].tolist()), (10, x[11].tolist()), (None, x[5].tolist())]
    for name, size in (("BLOCK", 25), ("SAMPLE", 400), ("ASKED_BYTES", 16 * 8 * 40), ("ASKED_LEAST", 16), ("INDEX_TASKS", 4)):
        monkeypatch.setattr(multi_index, name, size, raising=False)
    for module in (session, multi_index):
        monkeypatch.setattr(module, "shared_folder", lambda spark, purpose: str(tmp_path / f"{purpose}-1"), raising=False)
    coders, learn = [], multi_index.learn
    monkeypatch.setattr(multi_index, "learn", lambda x: (coders.append(learn(x)), coders[0])[1])
    rows = spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>").repartition(3)
    got = sorted(map(repr, map(tuple, multi_index.nearest(rows, rows.where("vec_id % 10 = 0")).collect())))

    data = data[:-1]
    at = {i: i_block for i, i_block in spark.range(1500).selectExpr("id", f"pmod(xxhash64(id), {-(-len(data) // 25)})").collect()}
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data])
    of, codes, found = np.array([at[i] for i in ids]), coders[0].parts(multi_index.unit(x)), {}
    with np.errstate(all="ignore"):
        for i in np.flatnonzero(ids % 10 == 0):
            far = multi_index._ONES[codes ^ codes[i]].sum(1, dtype=int)
            score = (x * x[i]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[i] * x[i]).sum()))
            for b in set(of.tolist()):
                others, radius = np.flatnonzero((of == b) & (ids != ids[i])), coders[0].radius
                while (far[others] <= radius).sum() < 5 and radius < 256:
                    radius += 16
                others = others[far[others] <= radius]
                others = others[np.lexsort((ids[others], -score[others]))[:5]]
                found.setdefault(int(ids[i]), set()).update((np.isfinite(s) or s < 0, -s, n, repr(s)) if s == s else (False, -np.inf, n, "nan") for s, n in zip(score[others].tolist(), ids[others].tolist(), strict=True))
    # Spark ranks what is not a number before the greatest number
    want = [(q, k, n, float(s)) for q, f in found.items() for k, (_, _, n, s) in enumerate(sorted(f, key=lambda v: (v[3] != "nan", v[1], v[2]))[:5], 1)]
    assert got == sorted(map(repr, want))
    stored = sum(spark.read.parquet(str(p)).count() for p in tmp_path.glob("found-*"))
    assert len(want) <= stored <= 151 * 5 * 10, "far fewer than the 61 blocks would give"


def test_radius_follows_the_whole_sample():
    """Families of close copies that were loaded first do not set the radius for all others."""
    r = np.random.default_rng(9)
    families = np.repeat(r.standard_normal((50, 32)), 6, axis=0) + 0.01 * r.standard_normal((300, 32))
    x = np.concatenate([families, r.standard_normal((1500, 32))])
    other = multi_index.learn(x[::-1].copy()).radius
    assert multi_index.learn(x).radius >= 0.8 * other > 20


def test_every_code_in_the_radius_is_found():
    r = np.random.default_rng(7)
    parts = r.integers(0, 1 << 16, (500, 16)).astype(np.uint16)
    index = multi_index.MultiIndex(parts)
    ones = np.array([bin(i).count("1") for i in range(1 << 16)])
    for radius in (0, 7, 40, 100, 117, 256):
        code = parts[3] ^ np.uint16(5)
        distance = ones[parts ^ code].sum(1)
        assert sorted(index.within(code, radius).tolist()) == np.flatnonzero(distance <= radius).tolist()


def test_lookups_and_counting_agree():
    """Small radii look values up, larger ones count; codes of any number of substrings, opposite codes too."""
    r = np.random.default_rng(8)
    for m in (16, 5, 1):
        parts = r.integers(0, 1 << 16, (40, m)).astype(np.uint16)[r.integers(0, 40, 3000)] ^ (r.random((3000, m)) < 0.1).astype(np.uint16)
        parts[5] = ~parts[4]
        index = multi_index.MultiIndex(parts)
        for radius in (0, 1, m, 2 * m - 1, 3 * m, 7 * m, 16 * m - 1, 16 * m):
            distance = multi_index._ONES[parts ^ parts[4]].sum(1, dtype=int)
            assert index.within(parts[4], radius).tolist() == np.flatnonzero(distance <= radius).tolist()


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(200, 400)] + [(7, x) for x in range(500, 900)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(300)] + [(5, 5), (3, 2), (2, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: find(x) for x in list(root) if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_end_in_one_round(spark, monkeypatch):
    written = []
    keep = components.write_and_read
    monkeypatch.setattr(components, "write_and_read", lambda df, purpose: (written.append(purpose), keep(df, purpose))[1])
    order = np.random.default_rng(8).permutation(400).tolist()
    edges = spark.createDataFrame([*zip(order, order[1:], strict=False), (900, 901)], "a long, b long").repartition(7)
    want = {**dict.fromkeys(range(1, 400), 0), 901: 900}
    assert {x.node: x.root for x in components.components(edges).collect()} == want and len(written) == 2
    assert {x.node: x.root for x in components.components(edges, few=0).collect()} == want and len(written) > 4
