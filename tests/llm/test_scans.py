import hashlib
import random
import re

from oracle import compare
from tidemark.llm import license, queries, winnow


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination_equals_its_sql(spark, small):
    compare(spark, small, queries.QUERIES["op9_winnowing"], queries.ORACLE["op9_winnowing"])


def test_licences_equal_their_sql(spark, small):
    compare(spark, small, queries.QUERIES["op10_license_diagonals"], queries.ORACLE["op10_license_diagonals"])


def hits(text, items):
    """Words hit and items found, window by window."""
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        k = min(10, len(v))
        for a in range(len(v) - k + 1) if k else ():
            for b in range(len(w) - k + 1):
                if w[b : b + k] == v[a : a + k]:
                    hit |= set(range(b, b + k))
                    found |= {str(i)} if i is not None else set()
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_every_window_is_found(spark, frame, hard):
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(12)]  # few words, so that windows repeat
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(r.randint(0, 30))) for i in range(25)] + [(90, "alone"), (91, "Two Words"), (None, "a null id has this text of its own"), (92, None), (93, "one"), (9, "same same same same same same same same same same same same")]
    docs = []
    for i in range(150):
        t = say(r.randint(0, 60))
        if i % 2:
            v = words(items[r.randrange(25)][1])
            a = r.randint(0, max(0, len(v) - 8))
            t += " Éa " + ", ".join(v[a : a + r.randint(7, 14)]).upper() + " ß " + say(5)
        docs.append((i, t))
    docs += [(500, "ALONE"), (501, "two: words"), (502, "same " * 40), (503, "a null id has this text of its own")] + [(600 + i, x.text) for i, x in enumerate(hard.collect())]
    got = {x.doc_id: tuple(x)[1:] for x in winnow.contamination(frame(docs), frame(items, "item_id long, text string")).collect()}
    assert got == {i: hits(t, items) for i, t in docs}


def test_decontamination_without_rows(spark, frame, hard, empty):
    nothing = frame([], "item_id long, text string")
    got = winnow.contamination(hard, nothing).collect()
    assert len(got) == hard.count() and not any(x.contaminated for x in got)
    assert winnow.contamination(empty, frame([(1, "a")], "item_id long, text string")).collect() == []


def test_licence_places_and_votes(spark, frame):
    mit = next(t for label, t in license.NOTICES if t.startswith("permission"))
    broken = mit.replace(" free of charge ", " quite free of any charge ").replace("copy of", "copy, of")
    docs = [
        (1, "Under the MIT license. under The mit License"), (2, "Licensed under CC BY-NC 4.0."), (3, "under the mit-licence"), (4, broken.upper()), (5, mit[:60]), (6, None), (7, "cc by nc cc by nc"),
        (8, "Apache License, Version 2.0"), (9, "under the mit license " * 300), (10, "K" * 9 + " ünder the mit license"),
    ]
    got = {r.doc_id: r for r in license.license_scan(frame(docs)).collect()}
    pick = lambda i: (got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels, got[i].labels)
    assert pick(1) == (2, 0, 4, "mit", "mit") and pick(2) == (1, 2, 2, "cc-by-nc", "cc-by-nc") and pick(3) == (0, None, None, "", "")
    assert pick(4) == (0, None, None, "", "mit") and 0.8 <= got[4].score < 1 and pick(5)[4] == "" and got[5].score == 0
    assert pick(6) == (0, None, None, "", "") and got[6].n_words == 0 and pick(7)[:3] == (2, 0, 3) and pick(8)[3] == "apache-2"
    assert pick(9)[:3] == (300, 0, 1196) and got[9].score == 1 and pick(10)[0] == 0


def test_only_a_to_z_are_folded_and_words_are_compared(spark, frame, monkeypatch):
    docs = [(1, "under the MIT license"), (2, "under the M\u0130T license"), (3, "apache licen\u017fe version 2"), (4, "CC BY NC"), (5, "cc by n\u212a")]
    got = {r.doc_id: (r.n_base, r.base_labels) for r in license.license_scan(frame(docs)).collect()}
    assert got == {1: (1, "mit"), 2: (0, ""), 3: (0, ""), 4: (1, "cc-by-nc"), 5: (0, "")}
    # where all hashes are one, words alone tell runs apart
    own = license.F.xxhash64
    monkeypatch.setattr(license.F, "xxhash64", lambda *c: own(license.F.lit(1)))
    again = {r.doc_id: (r.n_base, r.base_labels, r.n_words) for r in license.license_scan(frame([*docs, (6, "no such words here"), (7, "")])).collect()}
    assert {i: x[:2] for i, x in again.items()} == got | {6: (0, ""), 7: (0, "")} and again[6][2] == 4


def test_licences_of_hard_rows(hard, empty):
    got = license.license_scan(hard).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in got) == sorted((str(r.doc_id), len(words(r.text))) for r in hard.collect())
    assert license.license_scan(empty).collect() == []


def test_whole_licence_texts_with_changes(frame):
    whole = {label: t for label, t in license.NOTICES if len(t.split()) > 80}
    r = random.Random(4)
    docs = []
    for i, (_, t) in enumerate(whole.items()):
        w = t.split()
        for _ in range(4):  # a name here, a typing error there
            at = r.randrange(len(w))
            w[at : at + 1] = ["acme", "inc"] if r.random() < 0.5 else []
        docs += [(10 * i, "Copyright (c) 2024 somebody. " + " ".join(w).capitalize() + "."), (10 * i + 1, " ".join(w[: len(w) // 4])), (10 * i + 2, " ".join(sorted(w)))]
    got = {x.doc_id: x for x in license.license_scan(frame(docs)).collect()}
    assert set(whole) == {"mit", "bsd", "gpl-3", "isc"} | ({"apache-2"} if "apache-2" in whole else set())
    for i, label in enumerate(whole):
        assert got[10 * i].labels.split(",") == [label] and got[10 * i].score >= license.COVER and got[10 * i + 2].labels == ""
