import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from oracle import compare
from tidemark.llm import kdtree, maxscore, queries


def test_search_equals_its_sql(spark, small):
    compare(spark, small, queries.QUERIES["op8_maxscore_topk"], queries.ORACLE["op8_maxscore_topk"])


def test_search_against_all_scores(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([0, 0, 0, 1, -1, 3, -5]) if i % 3 else r.randint(-40, 40) for _ in range(12)]) for i in range(700)]
    rows += [(900 + i, rows[5][1]) for i in range(40)]
    numbered = [(n, i, v) for n, (i, v) in enumerate(rows)]
    df = spark.createDataFrame(numbered, "row long, vec_id long, v array<long>")
    asked = [x for x in numbered if x[1] % 7 == 0]
    for shards, blocks in (3, 2), (1, 1), (60, 1):
        got = maxscore.top_k(df, spark.createDataFrame(asked, df.schema), 9, shards, blocks).collect()
        found = defaultdict(list)
        for x in sorted(got, key=lambda x: (x.query_id, x.rank)):
            found[x.query_id].append((x.score, x.vec_id))
        for n, i, q in asked:
            every = sorted(((sum(a * b for a, b in zip(q, v, strict=True)), j) for m, j, v in numbered if m != n), key=lambda x: (-x[0], x[1]))
            assert found[i] == every[:9]


def test_rows_that_share_an_id_are_queries_and_candidates_of_their_own(spark):
    rows = [(0, [1.0, 2.0]), (0, [3.0, -1.0]), (0, [1.0, 2.0]), (5, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in maxscore.embedding_top_k(df, 2).collect())
    u = 64 * 64
    assert got == Counter({(0, 1, 0, 5 * u): 2, (0, 2, 5, 3 * u): 2, (0, 1, 5, 2 * u): 1, (0, 2, 0, 1 * u): 1})


def test_terms_that_cannot_matter_are_not_essential(monkeypatch):
    monkeypatch.setattr(maxscore, "STEP", 8)
    r = np.random.RandomState(1)
    x = r.randint(-3, 4, (300, 16)).astype(float)
    x[:10] *= 20
    shard = maxscore.Shard(np.arange(300), np.arange(300), x)
    for i in range(0, 300, 11):
        ids, scores = shard.search(i, x[i], 5)
        every = sorted(((x[j] @ x[i], j) for j in range(300) if j != i), key=lambda t: (-t[0], t[1]))[:5]
        assert [(s, j) for j, s in zip(ids, scores, strict=True)] == every
        for least in every[2][0], every[4][0], every[0][0] + 1:
            ids, scores = shard.search(i, x[i], 5, least)
            assert [(s, j) for j, s in zip(ids, scores, strict=True)] == [e for e in every if e[0] >= least]


def test_search_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [nan, 1.0]), (80, [inf, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0]), (3, [1e9, -1e9])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = [tuple(r) for r in maxscore.embedding_top_k(df).collect()]
    assert {g[0] for g in got} == {0} and sorted(g[2] for g in got) == [1, 1, 2, 3]
    assert {g[2]: g[3] for g in got} == {1: 64 * 64 * 5, 2: 64 * 192, 3: 64 * 64 * (10**9 - 2 * 10**9)}
    assert maxscore.embedding_top_k(df.limit(0)).collect() == []


def laws(rows, docs):
    texts = Counter((i, t) for i, t in docs)
    assert len(rows) == sum(texts.values())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    for shard, own in by.items():
        assert 0 <= shard < 16 and sorted(r.slot for r in own) == list(range(len(own)))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    return {s: sum(r.size for r in own) for s, own in by.items()}


def homes(rows):
    by = defaultdict(set)
    for x in rows:
        by[x.text_crc32].add(x.shard)
    return by


def test_shards_of_near_equal_bytes_keep_equal_texts_together(spark, frame):
    r = random.Random(9)
    docs = [(i, "x" * int(r.paretovariate(1.2) * 50) + str(r.random())) for i in range(6000)]
    docs = [(i, t[-4000:]) for i, t in docs] + [(7000 + i, "copy of a text") for i in range(150)] + [(8000 + i, "a b c d" * 9) for i in range(700)]
    rows = kdtree.shards(frame(docs)).collect()
    sizes = laws(rows, docs)
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and max(abs(s / mean - 1) for s in sizes.values()) < 0.05
    assert all(len(h) == 1 for h in homes(rows).values())


def test_only_a_text_that_outweighs_a_shard_is_parted(spark, frame):
    docs = [(i % 50 if i % 2 else None, "the same" if i % 3 == 0 else f"text {i * i}") for i in range(3000)]
    rows = kdtree.shards(frame(docs)).collect()
    sizes = laws(rows, docs)
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and max(abs(s / mean - 1) for s in sizes.values()) < 0.1
    by = homes(rows)
    hot = by.pop(zlib.crc32(b"the same"))
    assert len(hot) <= -(-9 * 1000 // int(mean + 1)) + 1 and all(len(h) == 1 for h in by.values())


def test_a_third_of_all_bytes_has_one_length(spark, frame):
    r = random.Random(4)
    rest = [(i, ("y" * int(r.paretovariate(1.2) * 60))[-3500:] + str(r.random())) for i in range(4000)]
    for size in 1500, 4000:
        n = sum(len(t) + 1 for _, t in rest) // (2 * size)
        for hot in ["z" * size] * n, [f"{i:08}" * (size // 8) + "." * (size % 8) for i in range(n)]:
            docs = rest + [(10000 + i, t) for i, t in enumerate(hot)]
            sizes = laws(kdtree.shards(frame(docs)).collect(), docs)
            mean = sum(sizes.values()) / 16
            assert len(sizes) == 16 and max(abs(s / mean - 1) for s in sizes.values()) < 0.15, (size, sorted(round(s / mean, 2) for s in sizes.values()))


def plain_leaves(points, depth, room):
    """Cuts of a K-d tree one node after the other, in exact order of the widest dimension."""
    spread = [max(p[d] for p, _ in points) - min(p[d] for p, _ in points) for d in range(len(points[0][0]))]
    todo, out = [(points, 0, depth)], {}
    while todo:
        own, leaf, left = todo.pop()
        if not left or not own:
            out |= {p: leaf for p, _ in own}
            continue
        d = max(range(len(spread)), key=lambda d: (max(p[d] for p, _ in own) - min(p[d] for p, _ in own)) / spread[d])
        own = sorted(own, key=lambda x: x[0][d])
        wide = 2**left
        part = room[leaf * wide : (leaf + 1) * wide]
        half, run, i = sum(w for _, w in own) * sum(part[: wide // 2]) / sum(part), 0, 0
        while i < len(own) and abs(run + own[i][1] - half) < abs(run - half):
            run, i = run + own[i][1], i + 1
        todo += [(own[:i], 2 * leaf, left - 1), (own[i:], 2 * leaf + 1, left - 1)]
    return out


def test_cuts_are_those_of_a_plain_tree(spark):
    r = random.Random(6)
    points = [((r.gauss(0, 1), r.uniform(0, 9), r.random() ** 4), r.randint(1, 50)) for _ in range(1500)]
    df = spark.createDataFrame([(*p, w) for p, w in points], "a double, b double, c double, w long")
    for room in [1.0] * 8, [1.0, 0.2, 1.0, 1.0, 0.0, 1.0, 0.7, 1.0]:
        got = {(x.a, x.b, x.c): x.leaf for x in kdtree.leaves(df, ["a", "b", "c"], "w", 3, room).collect()}
        assert got == plain_leaves(points, 3, room)


def test_leaves_reach_a_target_of_bytes(spark, frame):
    docs = [(i, f"text {i * i}" * (1 + i % 7)) for i in range(2000)]
    sizes = Counter()
    for x in kdtree.shards(frame(docs), target_bytes=sum(len(t) + 1 for _, t in docs) // 20).collect():
        sizes[x.shard] += x.size
    assert len(sizes) == 32 and max(sizes.values()) < 1.1 * sum(sizes.values()) / 32


def test_shards_of_hard_rows(hard, empty):
    laws(kdtree.shards(hard).collect(), [(r.doc_id, r.text) for r in hard.collect()])
    assert kdtree.shards(empty).collect() == []


def test_thousands_of_leaves(spark):
    r = random.Random(7)
    df = spark.createDataFrame([(r.random(), r.random() ** 3, r.gauss(0, 1), r.randint(1, 9)) for _ in range(40000)], "a double, b double, c double, w long")
    found = kdtree.leaves(df, ["a", "b", "c"], "w", 10)
    sizes = {x.leaf: x.w for x in found.groupBy("leaf").agg({"w": "sum"}).withColumnRenamed("sum(w)", "w").collect()}
    mean = sum(sizes.values()) / 1024
    assert len(sizes) == 1024 and max(sizes.values()) < 1.35 * mean and min(sizes.values()) > 0.65 * mean
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20000  # no branch a node
