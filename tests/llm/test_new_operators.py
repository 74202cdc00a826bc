import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import compare
from tidemark.llm import codes, manifest, queries, secrets


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_merkle_manifest", "op13_secret_scan"])
def test_query_equals_its_sql(spark, small, name):
    compare(spark, small, queries.QUERIES[name], queries.ORACLE[name])


# --- secret scans


def plain_scan(text):
    """Counts, digest and spans by Python's own patterns, rule by rule."""
    own = []
    for n, r in enumerate((secrets.BASE[0], secrets.Rule("access", "AKIA[A-Z0-9]+", 0, 20), secrets.Rule("hex", "[0-9a-f]+", 0, 24), *secrets.MORE)):
        own += [(m.start(), n, m.end()) for m in re.finditer(r.pattern, text or "") if len(m[r.group]) >= r.least]
    own.sort()
    said = [f"{secrets.RULES[n].kind}:{a}:{b}" for a, n, b in own]
    base = [x for x, (_, n, _) in zip(said, own, strict=True) if n < 3]
    return *[sum(n == i for _, n, _ in own) for i in range(3)], hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(said)


def test_secrets_against_plain_patterns(frame, hard):
    r = random.Random(5)
    bits = ["password", "PassWd", "api_key", "APIKEY", "secret", "token", '"', "'", " ", "  ", ":", "=", "abc", "abcdef", "x/+_.=-", "AKIA", "ABCDEFGHIJKLMNOP", "deadbeef" * 3, "0123", "é", "日本", "😀", "\n", "ghp_" + "a1B2" * 9,
            "xoxb-123456789-ab", "AIza" + "x" * 35, "sk_live_" + "a" * 20, "eyJab.eyJcd.ef", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "https://me:pw@host", "toKenſ", "K", "to", "ken", "ASIA"]
    docs = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for i in range(400)]
    docs += [(500, "token=abcdef " * 3000), (501, "a" * 30000), (502, "token=secret=abc"), (503, "token: secret: abcdef"), (504, "😀 password = 'abc123'"), (505, "AKIA" * 9), (506, "api_" * 9 + "key:abcdefg")]
    docs += [(600 + i, x.text) for i, x in enumerate(hard.collect())]
    got = {x.doc_id: tuple(x)[1:] for x in secrets.secret_scan(frame(docs)).collect()}
    assert got == {i: plain_scan(t) for i, t in docs}
    assert sum(len(g[4]) > 0 for g in got.values()) > 100


def test_queries_of_trigrams():
    q = lambda p: {tuple(sorted(a)) for a in secrets.trigram_query(p)}
    assert q("abcd") == {("abc", "bcd")} and q("[Aa]bc|xyz?") == {()} and q("[Aa]bc|xyz+") == {()} and q("(abc|xyz)+") == {("abc",), ("xyz",)}
    assert q("abc[0-9]*def") == {("abc", "def")} and q("[0-9a-f]+") == {()} and q("ab?cd") == {("abc", "bcd"), ("acd",)} and q("") == {()} and q("a{3}bcd") == {("bcd",)}
    assert q("AKIA[A-Z0-9]{16,}") == {("aki", "kia")} and q("abcdefgh") == {("abc", "bcd", "def", "fgh")} and () not in q(secrets.BASE[0].pattern) and ("ken", "oke", "tok") in q(secrets.BASE[0].pattern)
    assert [r.kind for r in secrets.RULES if q(r.pattern) == {()}] == ["hex"]


def test_no_match_lacks_its_trigrams():
    r = random.Random(2)
    for _ in range(300):
        parts = [r.choice(["abc", "(ab|cde)", "[xy]z", "q?", "r*", "s+", "t{2}", "(u|vw)?", ".", "(mno|pqr+)"]) for _ in range(r.randint(1, 6))]
        pattern = "".join(parts)
        q = secrets.trigram_query(pattern)
        for _ in range(40):
            text = "".join(r.choice(["abc", "ab", "cde", "xz", "yz", "q", "rr", "s", "tt", "u", "vw", "mno", "pqrr", "-"]) for _ in range(r.randint(1, 9)))
            if m := re.search(pattern, text):
                assert any(all(g in m[0] for g in a) for a in q), (pattern, text)


def test_secrets_of_rows_that_repeat(frame, empty):
    rows = [(7, "token: abcdef"), (7, "token: abcdef"), (None, "token: abcdef"), (None, None), (7, "nothing")]
    got = Counter((x.doc_id, x.spans) for x in secrets.secret_scan(frame(rows)).collect())
    assert got == Counter({(7, "assign:0:13"): 2, (None, "assign:0:13"): 1, (None, ""): 1, (7, ""): 1})
    assert secrets.secret_scan(empty).collect() == []


# --- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def plain_tree(leaves):
    """Root and the proof of each leaf as (place, others) by level."""
    paths, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            paths[i].append((p % 8, run[: p % 8] + run[p % 8 + 1 :]))
        level, at = [h(*level[a : a + 8]) for a in range(0, len(level), 8)], [p // 8 for p in at]
    return level[0], paths


def plain_manifest(rows):
    by = {}
    for x in rows:
        by.setdefault((x["lang"] is not None, (x["lang"] or "").encode()), []).append((x["doc_id"] is not None, x["doc_id"] or 0, plain_leaf(x, x["text"]), x))
    trees = [(sorted(own, key=lambda t: t[:3]), *plain_tree([t[2] for t in sorted(own, key=lambda t: t[:3])])) for _, own in sorted(by.items())]
    root, above = plain_tree([sub for _, sub, _ in trees])
    for (own, sub, paths), top in zip(trees, above, strict=True):
        for (_, _, leaf, x), path in zip(own, paths, strict=True):
            third = x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 3 == 0 and x["text"] is not None
            digest = plain_leaf(x, re.sub("[A-Z]", lambda m: m[0].lower(), x["text"])) if third else leaf
            for at, others in path + top:
                digest = h(*others[:at], digest, *others[at:])
            yield x["doc_id"], leaf, sub, root, h(*[d for _, o in path + top for d in o]), digest, digest == root


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, block int, path int"


@pytest.mark.parametrize("levels", [4, 1, 2])
def test_manifest_against_plain_trees(spark, levels):
    r = random.Random(levels)
    langs = [None, "", "de", "en", "é", "zz", *[f"l{i}" for i in range(12)]]
    rows = [dict(doc_id=r.choice([None, *range(-5, 900)]), source=r.choice([None, "", "web"]), lang=langs[min(int(r.expovariate(0.4)), 17)], n_chars=r.choice([None, 3]), text=r.choice([None, "", f"Text {i % 50}", "lower", "É A" * 99])) for i in range(1300)]
    rows += [rows[3]] * 20 + [dict(rows[4], lang="alone")]
    made = spark.createDataFrame([(*x.values(), "clash", 1, 1) for x in rows], SCHEMA)
    got = Counter(map(tuple, manifest.manifest(made.repartition(5), levels).collect()))
    assert got == Counter(plain_manifest(rows)) and {g[6] for g in got} == {True, False}


def test_proofs_of_any_length_and_height():
    for n in [*range(1, 70), 511, 512, 513, 600]:
        leaves = [h(str(i)) for i in range(n)]
        levels = next(k for k in range(9) if 8**k >= n)
        root, paths = plain_tree(leaves)
        for height in 1, 2, 3:
            assert list(manifest.proofs(leaves, levels, height)) == paths
        assert all(manifest.folded(leaf, p) == root for leaf, p in zip(leaves, paths, strict=True))


def test_manifest_of_one_row_and_of_none(spark):
    row = dict(doc_id=3, source="s", lang="en", n_chars=1, text="A")
    made = spark.createDataFrame([(*row.values(), "clash", 1, 1)], SCHEMA)
    one = manifest.manifest(made).first()
    assert tuple(one) == next(plain_manifest([row])) and one.leaf == one.subroot == one.root and one.proof_sha256 == h("")
    assert manifest.manifest(made.limit(0)).collect() == []


# --- vector codes


def plain_codes(rows, dims):
    """Every distance, in Python's integers."""
    kept = [(i, lab, [int(np.floor(256 * np.float64(c))) for c in v] + [0] * (dims - len(v))) for i, v, lab in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    w = dims // 16
    part = lambda x, p: x[p * w : (p + 1) * w]
    first = sorted(kept, key=lambda t: (t[0] is None, t[0] or 0, t[2]))[:64]
    books = [[part(x, p) for _, _, x in first] for p in range(16)]
    square = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    near = lambda x: [min((square(part(x, p), e), n) for n, e in enumerate(books[p])) for p in range(16)]
    for _ in range(2):
        at = [near(x) for _, _, x in kept]
        for p in range(16):
            for n in range(len(books[p])):
                own = [part(x, p) for (_, _, x), a in zip(kept, at, strict=True) if a[p][1] == n]
                if own:
                    books[p][n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = [(i, "".join(f"{n:02x}" for _, n in a), sum(d for d, _ in a), lab) for (i, lab, x) in kept for a in [near(x)]]
    total = Counter()
    for _, _, e, lab in out:
        total[lab] += e
    return Counter((i, c, e, total[lab], digest) for i, c, e, lab in out)


@pytest.mark.parametrize("n", [0, 1, 40, 300])
def test_codes_against_all_distances(spark, n):
    r = random.Random(n)
    # few values, so that entries tie and repeat
    rows = [(r.choice([None, *range(200)]), [r.choice([0.0, 0.1, -0.3, 1.0]) if i % 2 else r.gauss(0, 1) for _ in range(32)], r.choice([None, 1, 1, 1, 2])) for i in range(n)]
    rows += rows[:3] + ([(9, None, 1), (8, [float("nan")] * 32, 1), (7, [None] * 32, 2), (6, [float("inf")] * 32, 1), (5, [1.0, -1.0], None)] if n else [])
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    got = Counter(map(tuple, codes.vector_codes(df).collect()))
    assert got == (plain_codes(rows, 32) if n else Counter())


def test_codes_of_odd_lengths_and_large_numbers(spark):
    rows = [(1, [1e7] * 20, 1), (2, [-1e7, 3.0], 1), (3, [], 2), (4, [0.5] * 19, 2), (5, [1e9], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert Counter(map(tuple, codes.vector_codes(df).collect())) == plain_codes(rows, 32)
    huge = spark.createDataFrame([(1, [1e300], 1), (2, [-1e300], 1), (3, [0.0], 1)], df.schema)
    assert len(codes.vector_codes(huge).collect()) == 3


def test_a_tree_finds_what_all_distances_find():
    r = np.random.RandomState(4)
    for k in 1, 5, 64, 200:
        for entries in r.randint(-9, 9, (k, 3)), r.randint(-500, 500, (k, 4)), np.repeat(r.randint(-3, 3, (1, 2)), k, 0):
            points = r.randint(-600, 600, (500, entries.shape[1]))
            points[:k] = entries[:500]
            every = ((points[:, None] - entries[None]) ** 2).sum(2)
            at, best = codes.Tree(entries).nearest(points)
            assert (at == every.argmin(1)).all() and (best == every.min(1)).all()
