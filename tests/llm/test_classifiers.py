import random
import zlib

import numpy as np
from tidemark.llm import mil, toxicity


def labelled(n=900, seed=1):
    """Documents whose quality falls with shouting and signs, and whose toxicity comes from a few words."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(500)]
    rude = ["grumbol", "snarkel", "twidger"]
    docs, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(20, 200))]
        bad, toxic = r.random() < 0.3, r.random() < 0.3
        if bad:
            a = r.randrange(len(text) // 2)
            text[a:] = [w.upper() + "!!" if i % 2 else w + r.choice(["$$$", "###"]) for w in text[a:]]
        if toxic:
            for _ in range(3):
                w = r.choice(rude)
                text.insert(r.randrange(len(text)), w.replace("o", "0").replace("e", "е") if r.random() < 0.3 else w)
        docs.append((i, " ".join(text)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def loss(p, x, at, y):
    """The mean log loss, one document and passage after the other."""
    total = 0.0
    for a, b, want in zip(at[:-1], at[1:], y, strict=True):
        h = [np.tanh(v @ p["E"] + p["e"]) for v in x[a:b]]
        s = [np.sum(p["w"] * np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) for v in h]
        e = np.exp(np.array(s) - max(s))
        z = sum(w * v for w, v in zip(e / e.sum(), h, strict=True))
        q = 1 / (1 + np.exp(-(z @ p["c"] + p["b"][0])))
        total -= want * np.log(q) + (1 - want) * np.log(1 - q)
    return total / len(y)


def test_gradients_of_attention_are_the_numeric_ones():
    r = np.random.RandomState(0)
    x, at, y = r.rand(9, mil.WIDTH), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    p = mil.start()
    p["c"], p["b"] = r.randn(mil.HIDDEN), np.array([0.2])
    assert np.allclose(mil.score(p, x, at), [np.exp(-loss(p, x[a:b], np.array([0, b - a]), np.array([1.0]))) for a, b in zip(at[:-1], at[1:], strict=True)])
    got = mil.gradient(p, x, at, y)
    assert set(got) == set(p)
    for k in p:
        for i in r.choice(p[k].size, min(p[k].size, 12), replace=False):
            both = []
            for step in 1e-5, -1e-5:
                q = {n: v.copy() for n, v in p.items()}
                q[k].reshape(-1)[i] += step
                both.append(loss(q, x, at, y))
            assert np.isclose((both[0] - both[1]) / 2e-5, got[k].reshape(-1)[i], rtol=1e-4, atol=1e-8), k
    one = mil.score(p, x[[1, 0, 2, 8, 7, 6, 5, 4, 3]], at)
    assert np.allclose(one, mil.score(p, x, at))  # the order of passages does not matter


def test_steps_of_learning_lower_the_loss():
    r = np.random.RandomState(2)
    y = r.randint(0, 2, 200).astype(float)
    size = r.randint(1, 6, 200)
    at = np.concatenate([[0], np.cumsum(size)])
    x = r.rand(at[-1], mil.WIDTH) * 0.1
    x[at[:-1], 3] += np.where(y == 1, 1.0, 0.0)  # one passage of each tells
    p = mil.fit(x.astype(np.float16), at, y)
    assert loss(p, x, at, y) < 0.1 < loss(mil.start(), x, at, y)


def test_long_texts_are_learned_from_and_repeated_ids_count_once(spark, frame):
    long = "x y " * 20_000
    docs = frame([(i, long + str(i)) for i in range(1, 9)] + [(1, "again")] * 5)
    labels = frame([(i, i % 2, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    seen = []
    own = mil.fit
    mil.fit = lambda x, at, y: seen.append((np.diff(at).tolist(), y.tolist())) or own(x, at, y)
    try:
        mil.learned(docs, labels)
        mil.learned(docs.repartition(7), labels)
    finally:
        mil.fit = own
    held = sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(1, 9))
    assert seen[0] == seen[1] and len(seen[0][0]) == 8 - held
    assert set(seen[0][0]) <= {1, -(-80_001 // mil.PASSAGE)}  # whole bags


def test_bags_are_whole_and_bounded_in_all(spark, frame, monkeypatch):
    texts = ["a!" * 3000, "b" * 401, "", None, "c. " * 900]
    data = [(t or "").encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in data])])
    x, at = mil.passages(np.frombuffer(b"".join(data), np.uint8), off)
    for most in 5000, 4:
        monkeypatch.setattr(mil, "FIT_BAG", most)
        for i, row in enumerate(mil._bags(np.frombuffer(b"".join(data), np.uint8), off)["x"].to_pylist()):
            got, own = np.frombuffer(row, np.float16).reshape(-1, mil.WIDTH), x[at[i] : at[i + 1]]
            n = -(-len(own) // most)
            assert np.allclose(got, [own[a : a + n].mean(0) for a in range(0, len(own), n)], atol=2e-3) and len(got) <= most
    monkeypatch.setattr(mil, "FIT_TOTAL", 40)
    monkeypatch.setattr(mil, "FIT_BAG", 5000)
    seen, own = [], mil.fit
    monkeypatch.setattr(mil, "fit", lambda x, at, y: seen.append(len(x)) or own(x, at, y))
    mil.learned(frame([(i, "w " * 2000) for i in range(60)]), frame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int"))
    assert seen == [40]


def test_passages_of_a_batch_are_those_of_each_text():
    texts = [b"", b"a", b"x" * 400, b"Ab1!" * 333, "é".encode() * 999]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x, at = mil.passages(np.frombuffer(b"".join(texts), np.uint8), off)
    for i, t in enumerate(texts):
        y, own = mil.passages(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert own[-1] == max(1, -(-len(t) // mil.PASSAGE))
        assert np.allclose(x[at[i] : at[i + 1]], y)


def _held_out(rows, truth):
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    return np.mean([r.predicted == truth[r.doc_id] for r in held])


def test_quality_of_documents_not_learned_from(spark, frame):
    docs, labels = labelled()
    got = mil.quality(frame(docs), frame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert _held_out(got, {i: q for i, q, _ in labels}) > 0.9


def test_toxicity_of_documents_not_learned_from(spark, frame):
    docs, labels = labelled()
    got = toxicity.toxicity(frame(docs), frame(labels, "doc_id long, quality int, toxic int")).collect()
    assert _held_out(got, {i: t for i, _, t in labels}) > 0.97


def test_lexicon_folds_spares_and_normalises():
    x = toxicity.Lexicon({"trash": 5.0, "trash ": 6.0, "idio": 4.0}, curve=(-4.0, 4.0, 0.25))
    assert x.hits("You IDIOT!") == (4.0, 2) and x.hits("1d10t, іdiоt")[0] == 8.0
    assert x.hits("the trash can is full")[0] == 0 and x.hits("trash canteen")[0] == 6.0 and x.hits("trashy")[0] == 5.0
    assert x.hits("the idi ot subtrash") == (0.0, 4) and x.hits(None) == (0.0, 0)
    assert x.score("idiot") > x.score("idiot " + "word " * 5000) > x.score("word")


def plain_hits(lexicon, text):
    """Every term tried at the beginning of every word, the longest counts; exceptions are looked for everywhere."""
    folded = toxicity.fold(text)
    words = folded.split()
    spared = [False] * len(folded)
    for e in lexicon.exceptions:
        phrase = f" {e} "
        for i in range(len(folded)):
            if folded.startswith(phrase, i):
                spared[i : i + len(phrase) - 1] = [True] * (len(phrase) - 1)
    total = 0.0
    for i in range(len(folded)):
        starts = lambda t, i=i: folded.startswith(" " + t.rstrip("+"), i) and (t[-1] != "+" or folded[i + len(t)] != " ")
        fit = [t for t in lexicon.weights if starts(t)]
        if fit and not spared[i]:
            total += lexicon.weights[max(fit, key=lambda t: (len(t.rstrip("+")), t[-1] == "+"))]
    return total, len(words)


def test_matches_are_those_of_a_plain_search():
    r = random.Random(8)
    x = toxicity.Lexicon({"trash": 5.0, "trash ": 6.0, "idio": 4.0, "clown": 3.0, "scum ": 2.0, "can": 1.5, "canteen": 2.5, "scum+": 7.0, "clown+": 8.0, "cantee+": 9.0})
    bits = ["trash", "TRA5H", "can", "canteen", "clown", "fish", "school", "pond", "scum", "scummy", "clowns", "cantee", "1d10t", "іdiоtic", "a", "—", " ", "  ", ", ", "\n", "trash can", "the"]
    for _ in range(400):
        text = "".join(r.choice(bits) + r.choice([" ", "", " ", "-"]) for _ in range(r.randint(0, 14)))
        assert x.hits(text) == plain_hits(x, text), text
    many = "trash can idiot " * 50_000
    assert x.hits(many) == (4.0 * 50_000, 150_000)


def test_lexicon_does_not_hang_on_repeated_ids_or_partitions(spark, frame, monkeypatch):
    docs, labels = labelled(400)
    docs += [(i, t + " twice grumbol") for i, t in docs[:300]]
    monkeypatch.setattr(toxicity, "FIT_DOCS", 250)
    given = frame(labels, "doc_id long, quality int, toxic int")
    one, two = (toxicity.learned(frame(docs).repartition(n), given) for n in (1, 9))
    assert one.weights and one.weights == two.weights and np.allclose(one.curve, two.curve)


def test_copies_add_no_terms(spark, frame):
    docs, labels = labelled()
    copy = "zanzibar quixotic wombatted " + docs[0][1]
    docs += [(5000 + i, copy + " grumbol") for i in range(60)]
    labels += [(5000 + i, 1, 1) for i in range(60)]
    found = toxicity.learned(frame(docs), frame(labels, "doc_id long, quality int, toxic int")).weights
    assert not [t for t in found if t.startswith(("zanz", "quix", "womb"))] and any(t.startswith("grum") for t in found)


def test_hard_rows_and_no_rows(spark, hard, empty, frame):
    none = frame([], "doc_id long, quality int, toxic int")
    odd = frame([(1, None, None), (None, 1, 0), (2, 1, 1), (2, 0, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    for op in (mil.quality, toxicity.toxicity):
        for labels in (none, odd):
            got = op(hard, labels).collect()
            assert len(got) == hard.count() and all(0 <= r.score <= 1 for r in got)
        assert op(empty, odd).collect() == []


def plain_chosen(known, docs, toxic, other):
    """The terms that are taken, from what each toxic document has: {term: word before}."""
    stem = lambda t: t.rstrip(" +")
    have = {t: [i for i, d in enumerate(docs) if t in d] for t in known}
    covered, left, weights = [0] * len(docs), {t for t in known if len(have[t]) >= toxicity.GAIN}, {}
    gain = lambda t: len({docs[i][t] for i in have[t] if covered[i] < toxicity.COVER})
    while len(weights) < toxicity.TERMS:
        left = {t for t in left if gain(t) >= toxicity.GAIN}
        if not left:
            break
        t = max(left, key=lambda t: (gain(t) - 2 * known[t][1] * toxic / other, -len(stem(t)), t))
        t = max((u for u in left if stem(u).startswith(stem(t)) and u[-1] != " " and len(have[u]) >= 0.97 * len(have[t])), key=lambda u: (len(stem(u)), u), default=t)
        weights[t] = np.log((known[t][0] + 0.5) / toxic) - np.log((known[t][1] + 0.5) / other)
        for i in have[t]:
            covered[i] += 1
        left = {u for u in left if u != t and not stem(u).startswith(stem(t)) and not stem(t).startswith(stem(u))}
    return weights


def test_terms_are_chosen_as_a_plain_search_does(monkeypatch):
    import pyarrow as pa

    r = random.Random(6)
    for cover in 2, 8:
        monkeypatch.setattr(toxicity, "COVER", cover)
        words = ["".join(r.choice("abc") for _ in range(r.randint(4, 6))) for _ in range(25)]
        terms = sorted({t for w in words for t in toxicity._of_word(w)})
        known = {t: (r.randint(5, 60), r.randint(0, 9)) for t in terms}
        docs = [{t: r.randint(0, 30) for w in r.sample(words, r.randint(0, 6)) for t in toxicity._of_word(w)} for _ in range(120)]
        place = {t: i for i, t in enumerate(known)}
        bags = pa.table({"has": pa.array([[place[t] for t in d] for d in docs], pa.list_(pa.int32())), "after": pa.array([list(d.values()) for d in docs], pa.list_(pa.int32()))})
        got, want = toxicity._chosen(known, bags, 120, 900), plain_chosen(known, docs, 120, 900)
        assert list(got) == list(want) and all(np.isclose(got[t], want[t]) for t in want) and len(want) > 5
