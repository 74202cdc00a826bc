"""Contract data in words of 32 bytes: decoding and encoding of events and calls, in SQL functions alone.

Types are address, uint<bits>, int<bits>, bool, bytes<size>, and of any length bytes, string and arrays ``T[]`` of all these.
Data of any length stands behind an offset, and has its number of bytes or elements first. Whatever points outside the data, or has
bits where none belong, is no value: the row has an error and nothing of it is guessed.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.money import uint_text

_names = (f"x{i}" for i in itertools.count())


class Param(NamedTuple):
    name: str
    kind: str
    indexed: bool = False


class Event(NamedTuple):
    """An event of a contract; a critical one that cannot be decoded halts what reads it."""

    name: str
    params: tuple[Param, ...]
    critical: bool = False


def let(value: str, body) -> str:
    """``body`` of a name that stands for ``value``, which is computed once."""
    name = next(_names)
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def _ends(kind: str) -> bool:
    """Whether values of a type have one length."""
    return not kind.endswith("[]") and kind not in ("string", "bytes")


def _size(word: str) -> str:
    """A number of bytes or elements; null if it is more than any data has."""
    return f"if({word} rlike '^0{{54}}[0-9a-f]{{10}}$', cast(conv(right({word}, 10), 16, 10) as bigint), null)"


def _word(data: str, at: str) -> str:
    """Hex digits of the word at a place in bytes; null beyond the end."""
    return f"if({at} >= 0 and ({at}) + 32 <= length({data}), lower(hex(substring({data}, cast({at} as int) + 1, 32))), null)"


def _sized(data: str, at: str) -> str:
    """The number that the word at a place says."""
    return let(_word(data, at), _size)


def _static(kind: str, word: str) -> str:
    """Text of a word as a type; null if it has bits that the type has not."""
    if kind == "address":
        return f"if(left({word}, 24) = repeat('0', 24), concat('0x', right({word}, 40)), null)"
    if kind == "bool":
        return f"case {word} when repeat('0', 64) then 'false' when concat(repeat('0', 63), '1') then 'true' end"
    if kind.startswith("uint"):
        free = 64 - int(kind[4:] or 256) // 4
        text = uint_text(word)
        return f"if(left({word}, {free}) = repeat('0', {free}), {text}, null)" if free else text
    if kind.startswith("int"):
        digits = int(kind[3:] or 256) // 4
        # a negative number is one less than what its turned bits say, so numbers of up to 38 digits have a value
        turned = uint_text(f"translate({word}, '0123456789abcdef', 'fedcba9876543210')")
        minus = f"if({word} rlike '^f{{{64 - digits}}}[89a-f]', concat('-', cast(try_add(try_cast({turned} as decimal(38,0)), cast(1 as decimal(1,0))) as string)), null)"
        return f"if({word} rlike '^0{{{64 - digits}}}[0-7]', {uint_text(word)}, {minus})"
    size = 2 * int(kind[5:])
    return f"if(substring({word}, {size + 1}) = repeat('0', {64 - size}), concat('0x', left({word}, {size})), null)"


def _body(kind: str, data: str, at: str) -> str:
    """A value of any length that begins at ``at``: its size, then its bytes or elements."""
    if kind in ("string", "bytes"):
        inside = lambda n: f"if({n} is not null and ({at}) + 32 + {n} <= length({data}), substring({data}, cast({at} as int) + 33, cast({n} as int)), null)"
        found = let(_sized(data, at), inside)
        return f"try_validate_utf8(cast({found} as string))" if kind == "string" else f"concat('0x', lower(hex({found})))"
    one = kind[:-2]

    def each(n: str) -> str:
        start, i = f"({at} + 32)", next(_names)
        word = _word(data, f"{start} + 32 * {i}")
        value = let(word, lambda w: _static(one, w)) if _ends(one) else let(let(word, _size), lambda o: f"if({o} is null, null, {_body(one, data, f'({start} + {o})')})")
        found = f"transform(sequence(0L, {n} - 1), {i} -> {value})"
        none = "cast(array() as array<string>)" if _ends(one) or one in ("string", "bytes") else "null"
        return f"case when {n} is null or ({at}) + 32 + 32 * {n} > length({data}) then null when {n} = 0 then {none} else {let(found, lambda v: f'if(exists({v}, e -> e is null), null, {v})')} end"

    return let(_sized(data, at), each)


def values(kinds: list[str], data: str) -> list[str]:
    """SQL of each value of ``data``, as text or arrays of it; null where there is none.

    ``data`` is a ``let`` name of bytes: a place in them is found at once, one in text only by counting from its start, and a column's bytes are copied whenever it is named.
    """
    heads = [_word(data, str(32 * i)) for i in range(len(kinds))]
    return [let(h, lambda w, k=k: _static(k, w)) if _ends(k) else let(let(h, _size), lambda o, k=k: f"if({o} is null, null, {_body(k, data, o)})") for k, h in zip(kinds, heads, strict=True)]


def decoded(logs: DataFrame, events: dict[tuple[str, str], Event], keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """``keep`` columns, event, decoded (JSON by the parameters' names), error and critical, of logs (contract, topics: array<string>, data).

    An event is found by its contract and its first topic. Indexed parameters are in the other topics, of those of any length
    only the hash. An unknown topic, a missing one, odd data, and values that do not hold are dead letters that tell what was wrong; no row is lost.
    """
    bare = lambda c: f"lower(if(startswith({c}, '0x'), substring({c}, 3), {c}))"
    logs = logs.selectExpr("*", f"unhex({bare('data')}) as _data", f"length({bare('data')}) % 64 <> 0 as _odd", f"transform(topics, t -> {bare('t')}) as _topics")
    logs = logs.withColumn("_first", F.expr("try_element_at(_topics, 1)"))
    place = lambda key: f"contract = '{key[0]}' and _first = '{key[1].removeprefix('0x').lower()}'"
    case = lambda of: "case " + " ".join(f"when {place(k)} then {of(e)}" for k, e in events.items()) + " end"

    def fields(e: Event, data: str) -> str:
        plain = [p for p in e.params if not p.indexed]
        found = dict(zip([p.name for p in plain], values([p.kind for p in plain], data), strict=True))
        for i, p in enumerate(p for p in e.params if p.indexed):
            word = f"if(try_element_at(_topics, {i + 2}) rlike '^[0-9a-f]{{64}}$', try_element_at(_topics, {i + 2}), null)"
            found[p.name] = let(word, lambda w, p=p: _static(p.kind if _ends(p.kind) else "bytes32", w))
        made = f"named_struct({', '.join(f"'{p.name}', {found[p.name]}" for p in e.params)})"
        whole = lambda v: f"if({' or '.join(f'{v}.{p.name} is null' for p in e.params) or 'false'}, null, to_json({v}))"
        return let(made, whole) if e.params else "'{}'"

    count = lambda e: str(1 + sum(p.indexed for p in e.params))
    logs = logs.withColumn("event", F.expr(case(lambda e: f"'{e.name}'"))).withColumn("critical", F.expr(f"coalesce({case(lambda e: str(e.critical).lower())}, false)"))
    odd = F.expr("_data is null or _odd")
    logs = logs.withColumn("error", F.when(F.col("_first").isNull(), "no topic").when(F.col("event").isNull(), "unknown topic").when(F.size("topics") != F.expr(case(count)), "topics missing or left over").when(odd, "data is not whole words"))
    logs = logs.withColumn("decoded", F.when(F.col("error").isNull(), F.expr(let("_data", lambda data: case(lambda e: fields(e, data))))))
    error = F.when(F.col("error").isNull() & F.col("decoded").isNull(), "values do not fit the event").otherwise(F.col("error"))
    # an array of one, so that a condition on the error waits for what was decoded; else all of it is written into the condition, once for each place that names it
    return logs.select(*keep, F.inline(F.array(F.struct("event", "decoded", error.alias("error"), "critical"))))


def uint_word(number: str) -> str:
    """SQL of a word from a whole number of up to 63 bits."""
    return f"lpad(lower(hex(cast({number} as bigint))), 64, '0')"


def _tail(kind: str, value: str) -> str:
    """SQL of what stands behind an offset: size, bytes or elements."""
    if kind in ("string", "bytes"):
        hexes = f"lower(hex(cast({value} as binary)))" if kind == "string" else f"substring({value}, 3)"
        return let(hexes, lambda h: f"concat({uint_word(f'length({h}) div 2')}, rpad({h}, cast(ceil(length({h}) / 64) * 64 as int), '0'))")
    one, x = kind[:-2], next(_names)
    if _ends(one):
        return f"concat({uint_word(f'size({value})')}, array_join(transform({value}, {x} -> {_encoded_word(one, x)}), ''))"
    parts = f"transform({value}, {x} -> {_tail(one, x)})"
    step = f"aggregate(t, named_struct('at', 32L * size(t), 'heads', ''), (s, e) -> named_struct('at', s.at + length(e) div 2, 'heads', concat(s.heads, {uint_word('s.at')})), s -> s.heads)"
    return f"element_at(transform(array({parts}), t -> concat({uint_word(f'size({value})')}, {step}, array_join(t, ''))), 1)"


def _encoded_word(kind: str, value: str) -> str:
    if kind == "address":
        return f"lpad(lower(substring({value}, 3)), 64, '0')"
    if kind == "bool":
        return uint_word(f"if({value}, 1, 0)")
    if kind.startswith("bytes"):
        return f"rpad(lower(substring({value}, 3)), 64, '0')"
    return uint_word(value) if kind.startswith("uint") else f"lpad(lower(hex(cast({value} as bigint))), 64, if({value} < 0, 'f', '0'))"


def encoded(kinds: list[str], of: list[str]) -> Column:
    """Hex digits of some values as a call or an event has them; numbers of up to 63 bits. ``of`` are SQL."""
    tails = [_tail(k, v) for k, v in zip(kinds, of, strict=True) if not _ends(k)]

    def joined(t: str) -> str:
        heads, before, n = [], [str(32 * len(kinds))], itertools.count()
        for k, v in zip(kinds, of, strict=True):
            heads.append(_encoded_word(k, v) if _ends(k) else uint_word(" + ".join(before)))
            if not _ends(k):
                before.append(f"length({t}.t{next(n)}) div 2")
        return f"concat({', '.join([*heads, *[f'{t}.t{i}' for i in range(len(tails))]])})"

    # each tail is told once, though the heads of all behind it ask for its length
    return F.expr(let(f"named_struct({', '.join(f"'t{i}', {t}" for i, t in enumerate(tails))})", joined) if tails else joined(""))
