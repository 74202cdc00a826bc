import random
import re

from tidemark.llm.components import components
from tidemark.llm.neardup import near_duplicates


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain(docs):
    """doc_id -> (size of set, smallest id that links reach), pair by pair."""
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = sorted((top(x), top(y)))
                up[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def fixture():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    line = " ".join(say(30))
    docs = []
    for _ in range(40):  # families of edits, around the threshold
        base = say(r.randint(20, 80))
        for _ in range(r.randint(1, 5)):
            t = list(base)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = r.choice(words)
            docs.append(" ".join(t))
    for _ in range(120):  # a line that many short documents share, which fills tables
        docs.append(line + " " + " ".join(say(r.randint(0, 14))))
    center = say(60)
    for _ in range(80):  # a crowd of near copies of one text
        t = list(center)
        t[r.randrange(60)] = r.choice(words)
        t[r.randrange(60)] = r.choice(words)
        docs.append(" ".join(t))
    docs += ["same text"] * 50 + ["Same\tTEXT", "", " ", "é é", "a b c d e", "A b c d e"]
    r.shuffle(docs)
    return list(enumerate(docs))


def test_against_every_pair(frame):
    docs = fixture()
    got = near_duplicates(frame(docs)).collect()
    want = plain(docs)
    assert len(got) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_hard_rows(hard):
    got = near_duplicates(hard).collect()
    assert len(got) == hard.count()
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert by[0, 0].component_id == 0 and by[1, 0].component_id == 1 and by[2, 0].kept
    assert all(r.component_id == 3 for r in got if r.doc_id == 3)
    assert [r.kept for r in got if r.doc_id is None] == [True]


def test_no_rows(empty):
    assert near_duplicates(empty).collect() == []


def test_components_of_a_path_and_a_hub(spark):
    name = lambda i: b"%05d" % i
    edges = [(name(i), name(i + 1)) for i in range(60)] + [(name(500), name(i)) for i in range(501, 560)] + [(name(7), name(7))]
    got = {bytes(r.node): bytes(r.comp) for r in components(spark.createDataFrame(edges, "u binary, v binary")).collect()}
    assert got == {name(i): name(0) for i in range(61)} | {name(i): name(500) for i in range(500, 560)}
    assert components(spark.createDataFrame([], "u binary, v binary")).collect() == []
