import json
import random
import time

from tidemark.functions import abi
from tidemark.functions.abi import Event, Param


def word(n):
    return f"{n % 2**256:064x}"


def tail(kind, v):
    if kind in ("string", "bytes"):
        h = v.encode().hex() if kind == "string" else v[2:]
        return word(len(h) // 2) + h + "0" * (-len(h) % 64)
    return word(len(v)) + encode([kind[:-2]] * len(v), v)


def encode(kinds, of):
    """Plain encoding: heads, then what they point to."""
    heads, tails, at = [], [], 32 * len(kinds)
    for k, v in zip(kinds, of, strict=True):
        if k.endswith("[]") or k in ("string", "bytes"):
            t = tail(k, v)
            heads.append(word(at))
            tails.append(t)
            at += len(t) // 2
        else:
            heads.append(v[2:].rjust(64, "0") if k == "address" else v[2:].ljust(64, "0") if k.startswith("bytes") else word(int(v)))
    return "".join(heads + tails)


KINDS = ["uint256", "address", "address[]", "uint256[]", "string[]", "bytes[]", "int24", "int256", "bool", "bytes4", "bytes", "string", "uint8"]


def some(r, kind):
    if kind.endswith("[]"):
        return [some(r, kind[:-2]) for _ in range(r.choice([0, 1, 2, 5]))]
    if kind == "string":
        return "".join(r.choice(["a", "é", "日本", "😀", " ", '"', "\\", "\n"]) for _ in range(r.choice([0, 1, 15, 16, 40])))
    if kind == "bytes" or kind == "bytes4":
        return "0x" + r.randbytes(4 if kind == "bytes4" else r.choice([0, 1, 31, 32, 33, 70])).hex()
    if kind == "address":
        return "0x" + r.randbytes(20).hex()
    if kind == "bool":
        return r.choice([True, False])
    return {"uint256": r.choice([0, 1, 2**64, 2**120, 2**256 - 1, r.getrandbits(200)]), "uint8": r.randint(0, 255), "int24": r.randint(-(2**23), 2**23 - 1), "int256": r.choice([-1, 0, 10**37, -(10**37), -(2**90)])}[kind]


def said(v):
    return [said(x) for x in v] if isinstance(v, list) else v if isinstance(v, str) else str(v).lower()


def test_values_come_back(spark):
    r = random.Random(1)
    rows = [[some(r, k) for k in KINDS] for _ in range(60)]
    event = Event("E", tuple(Param(f"p{i}", k) for i, k in enumerate(KINDS)))
    logs = spark.createDataFrame([(i, "C", ["0xAB"], "0x" + encode(KINDS, v)) for i, v in enumerate(rows)], "id long, contract string, topics array<string>, data string")
    got = {x.id: x for x in abi.decoded(logs, {("C", "0xab"): event}).collect()}
    for i, v in enumerate(rows):
        assert got[i].error is None and got[i].event == "E"
        assert json.loads(got[i].decoded) == {f"p{n}": said(x) for n, x in enumerate(v)}


def test_whatever_points_outside_is_a_dead_letter(spark):
    """Each word of good data is replaced by numbers that are too large, and the end is cut off."""
    r = random.Random(2)
    kinds = ["string", "uint256[]", "bytes[]"]
    good = encode(kinds, ["héllo", [1, 2], ["0x01", "0x" + "ff" * 40]])
    words = [good[i : i + 64] for i in range(0, len(good), 64)]
    texts = [good[: 64 * i] for i in range(len(words))] + [good[:-1], "zz" * 32]
    for i in range(len(words)):
        for bad in (word(2**255), word(2**40 - 1), word(len(good)), "f" * 64):
            texts.append("".join([*words[:i], bad, *words[i + 1 :]]))
    event = Event("E", tuple(Param(n, k) for n, k in zip("abc", kinds, strict=True)))
    logs = spark.createDataFrame([(i, "C", ["t"], t) for i, t in enumerate(texts)], "id long, contract string, topics array<string>, data string")
    for x in abi.decoded(logs, {("C", "t"): event}).collect():
        want = plain(kinds, texts[x.id])
        assert (x.decoded and list(json.loads(x.decoded).values())) == want and (x.error is None) == (want is not None), (texts[x.id], x, want)
    assert r


def plain(kinds, data):
    """What the words say, or None where they say nothing."""

    class Bad(Exception):
        pass

    if len(data) % 64 or any(c not in "0123456789abcdef" for c in data):
        return None

    def number(at):
        if not 0 <= 2 * at <= len(data) - 64:
            raise Bad
        return int(data[2 * at : 2 * at + 64], 16)

    def body(kind, at):
        n = number(at)
        if n >= 2**40:
            raise Bad
        if kind in ("string", "bytes"):
            if 2 * (at + 32 + n) > len(data):
                raise Bad
            h = data[2 * at + 64 : 2 * (at + 32 + n)]
            try:
                return bytes.fromhex(h).decode() if kind == "string" else "0x" + h
            except UnicodeDecodeError:
                raise Bad from None
        if 2 * (at + 32 + 32 * n) > len(data):
            raise Bad
        return [str(number(at + 32 + 32 * i)) if kind == "uint256[]" else body(kind[:-2], at + 32 + far(at + 32 + 32 * i)) for i in range(n)]

    def far(at):
        n = number(at)
        if n >= 2**40:
            raise Bad
        return n

    try:
        return [body(k, far(32 * i)) for i, k in enumerate(kinds)]
    except Bad:
        return None


def test_topics_contracts_and_what_is_critical(spark):
    one = Event("Bond", (Param("who", "address", True), Param("note", "string", True), Param("amount", "uint256")), True)
    events = {("A", "aa"): one, ("B", "aa"): Event("Other", ())}
    who, note = "0x" + "0" * 24 + "AB" * 20, "0x" + "cd" * 32
    logs = [(1, "A", ["0xaa", who, note], "0x" + word(7)), (2, "B", ["0xaa"], "0x"), (3, "C", ["0xaa"], "0x"), (4, "A", ["0xaa", who], "0x" + word(7)), (5, "A", [], "0x"), (6, "A", None, None),
            (7, "A", ["0xaa", "0x" + "f" * 64, note], "0x" + word(7)), (8, "A", ["0xaa", who, note], None), (9, "A", ["0xaa", "0x12", note], "0x" + word(7))]
    got = {x.id: x for x in abi.decoded(spark.createDataFrame(logs, "id long, contract string, topics array<string>, data string"), events).collect()}
    assert json.loads(got[1].decoded) == {"who": "0x" + "ab" * 20, "note": note, "amount": "7"} and got[1].critical and got[2].decoded == "{}" and not got[2].critical
    assert [got[i].error for i in range(1, 10)] == [None, None, "unknown topic", "topics missing or left over", "no topic", "no topic", "values do not fit the event", "data is not whole words", "values do not fit the event"]


def test_encoding_is_what_a_plain_one_gives(spark):
    rows = [(1, "0x" + "ab" * 20, ["0x" + "01" * 20], [5, 6], ["", "é" * 40], ["0x", "0x" + "ff" * 33], -3, True, "text"), (2, "0x" + "00" * 20, [], [], [], [], 9, False, "")]
    kinds = ["uint256", "address", "address[]", "uint256[]", "string[]", "bytes[]", "int24", "bool", "string"]
    df = spark.createDataFrame(rows, "a long, b string, c array<string>, d array<long>, e array<string>, f array<string>, g long, h boolean, i string")
    got = [x.x for x in df.select(abi.encoded(kinds, list("abcdefghi")).alias("x")).collect()]
    assert got == [encode(kinds, list(r)) for r in rows]


def test_decoding_and_encoding_do_work_in_proportion_to_the_data(spark):
    """A place in the data is found without counting from its start, and a tail is told once whatever its place."""
    numbers = list(range(30_000))
    logs = spark.createDataFrame([(1, "C", ["t"], encode(["uint256[]"], [numbers]))], "id long, contract string, topics array<string>, data string")
    event = Event("E", (Param("a", "uint256[]"),))
    abi.decoded(logs, {("C", "t"): event}).collect()  # code is compiled
    began = time.monotonic()
    found = abi.decoded(logs, {("C", "t"): event}).first()
    assert time.monotonic() - began < 15 and json.loads(found.decoded)["a"] == [str(n) for n in numbers]
    sql = abi.encoded(["string"] * 6, [f"text{i}" for i in range(6)])._jc.toString()
    assert [sql.count(f"text{i}") for i in range(6)] == [1] * 6


def test_data_that_is_not_whole_words(spark):
    bad = ["0x" + word(7) + "\n", "0x" + word(7)[:-1], "0x" + word(7)[:-1] + "g", "0x" + word(7)[:-1] + "é", "0x" + word(7) + "00"]
    logs = spark.createDataFrame([(i, "C", ["t"], t) for i, t in enumerate([*bad, "0X"[:0] + word(7).upper()])], "id long, contract string, topics array<string>, data string")
    got = {x.id: x for x in abi.decoded(logs, {("C", "t"): Event("E", (Param("a", "uint256"),))}).collect()}
    assert all(got[i].error == "data is not whole words" and got[i].decoded is None for i in range(len(bad))) and json.loads(got[len(bad)].decoded) == {"a": "7"}


def test_a_condition_on_the_error_does_not_decode_again(spark):
    logs = spark.createDataFrame([(1, "C", ["t"], "0x" + word(7)), (2, "C", ["u"], "0x")], "id long, contract string, topics array<string>, data string")
    dead = abi.decoded(logs, {("C", "t"): Event("E", (Param("a", "uint256"),))}).where("error is not null")
    conditions = [line for line in dead._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert [r.id for r in dead.collect()] == [2] and conditions and not any("lambda" in c for c in conditions)
