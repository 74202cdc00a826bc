r"""Chat formatting: layouts found by schema fingerprints, one canonical form, one reversible template.

A record is a VARIANT. Its fingerprint is the hash of its nested field paths, types of leaves left
out; a table of declarative mappings tells for each known fingerprint how to make turns of it. All of
it is SQL functions. Formatted text is, for every turn,

    <|im_start|>ROLE\nTEXT<|im_end|>\n

where a backslash goes between each ``<`` and the backslashes, if any, and the ``|`` that follow it in
a text. No text then holds ``<|``, and taking one backslash away gives it back. In a role a backslash is also written as ``\s``
and a line break as ``\n``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layouts: name, how the record nests, required and optional fields, and the turns as an SQL expression over ``record``.
_GET = "cast(variant_get(record, '$.{}', 'string') as string)"
_TURN = "named_struct('role', {}, 'text', {})"


def _get(field: str) -> str:
    return _GET.format(field)


def _say(role: str, *fields: str) -> str:
    """A turn of a fixed role whose text is the fields that are there, blank lines between."""
    parts = ", ".join(f"nullif({_get(f)}, '')" for f in fields)
    return _TURN.format(f"'{role}'", f"concat_ws('\\n\\n', {parts})" if len(fields) > 1 else _get(fields[0]))


def _list(path: str, role: str, text: str) -> str:
    """Turns of an array of messages; well-known names of roles become the canonical ones."""
    named = f"case lower(m.{role}) when 'human' then 'user' when 'gpt' then 'assistant' when 'bot' then 'assistant' when 'model' then 'assistant' else m.{role} end"
    return f"transform(variant_get(record, '$.{path}', 'array<struct<{role}:string,{text}:string>>'), m -> {_TURN.format(named, f'm.{text}')})"


def _system(turns: str) -> str:
    return f"concat(filter(array({_say('system', 'system')}), t -> t.text is not null), {turns})"


LAYOUTS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...], str]] = {
    "row": ("OBJECT<{}>", ("role", "text"), (), f"array({_TURN.format(_get('role'), _get('text'))})"),
    "messages": ("OBJECT<{}>", ("messages: ARRAY<OBJECT<content, role>>",), ("system",), _system(_list("messages", "role", "content"))),
    "conversations": ("OBJECT<{}>", ("conversations: ARRAY<OBJECT<from, value>>",), ("system",), _system(_list("conversations", "from", "value"))),
    "instruction": ("OBJECT<{}>", ("instruction", "output"), ("input", "system"), _system(f"array({_say('user', 'instruction', 'input')}, {_say('assistant', 'output')})")),
    "prompt": ("OBJECT<{}>", ("completion", "prompt"), ("system",), _system(f"array({_say('user', 'prompt')}, {_say('assistant', 'completion')})")),
    "response": ("OBJECT<{}>", ("prompt", "response"), ("system",), _system(f"array({_say('user', 'prompt')}, {_say('assistant', 'response')})")),
    "question": ("OBJECT<{}>", ("answer", "question"), ("context", "system"), _system(f"array({_say('user', 'context', 'question')}, {_say('assistant', 'answer')})")),
}


def _paths(layout: str) -> list[str]:
    """The forms that a layout's nested fields can take, each with some of the optional fields."""
    nest, need, may, _ = LAYOUTS[layout]
    return [nest.format(", ".join(sorted([*need, *more]))) for n in range(len(may) + 1) for more in combinations(may, n)]


def fingerprint(record: Column) -> Column:
    """Hash of a record's nested field paths: names and nesting in the order of names, without types of leaves or empty fields' kinds."""
    nested = F.expr("schema_of_variant(record)") if record is None else F.schema_of_variant(record)
    return F.xxhash64(F.regexp_replace(nested, r": (?!OBJECT<|ARRAY<OBJECT<)[A-Z]+(?:\([0-9,]+\)|<[A-Z]+(?:\([0-9,]+\))?>)?(?=[,>])", ""))


def canonical_turns(records: DataFrame) -> DataFrame:
    """Adds ``layout`` and ``turns`` (array of role, text) to rows with a VARIANT ``record``.

    A record of no known layout, or a null one, has a null layout and no turns; no row is lost.
    """
    forms = [(layout, form) for layout in LAYOUTS for form in _paths(layout)]
    which = F.expr("case fingerprint " + " ".join(f"when xxhash64('{form}') then '{layout}'" for layout, form in forms) + " end")
    turns = F.expr("coalesce(case layout " + " ".join(f"when '{n}' then {x[3]}" for n, x in LAYOUTS.items()) + " end, cast(array() as array<struct<role:string,text:string>>))")
    return records.withColumn("fingerprint", fingerprint(F.col("record"))).withColumn("layout", which).withColumn("turns", turns).drop("fingerprint")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """A role on one line: each backslash in it is written with an s after it, so a backslash with an n is a line break."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


#: Turns whose places are summed together, so that long conversations take time in proportion to their turns.
CHUNK = 256


def _sums_before(sizes: str) -> str:
    """SQL for the sum of all numbers before each one of an array."""
    part = f"slice({sizes}, c * {CHUNK} + 1, {CHUNK})"
    run = "aggregate({}, named_struct('at', {}, 'all', cast(array() as array<bigint>)), (s, x) -> named_struct('at', s.at + x, 'all', array_append(s.all, s.at)), s -> s.all)"
    whole = f"transform(sequence(0, cast((size({sizes}) - 1) div {CHUNK} as int)), c -> aggregate({part}, 0L, (a, x) -> a + x))"
    return f"flatten(transform({run.format(whole, '0L')}, (b, c) -> {run.format(part, 'b')}))"


def formatted(rows: DataFrame, key: str, loss_role: str = "assistant") -> DataFrame:
    """One row per key: ``formatted`` and ``loss``, the code points (start, length) of texts to learn from.

    ``rows`` have the key, an order ``at`` and role and text, null ones as empty. A conversation is
    one row of the result, so its turns meet in one task; ties in ``at`` go by role, then text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    piece = F.struct("at", role.alias("role"), text.alias("text"))
    one = rows.groupBy(key).agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    parts = F.transform("turns", lambda t: F.struct(t.role.alias("role"), F.concat(F.lit("<|im_start|>"), escaped_role(t.role), F.lit("\n")).alias("head"), escaped(t.text).alias("body")))
    one = one.select(key, parts.alias("parts")).withColumn("sizes", F.expr("transform(parts, p -> cast(length(p.head) + length(p.body) + 11 as bigint))"))
    one = one.withColumn("at", F.expr(_sums_before("sizes"))).withColumn("placed", F.arrays_zip("parts", "at"))
    spans = F.transform(F.filter("placed", lambda p: p["parts"]["role"] == loss_role), lambda p: F.struct((p["at"] + F.length(p["parts"]["head"])).alias("start"), F.length(p["parts"]["body"]).cast("bigint").alias("length")))
    whole = F.array_join(F.transform("placed", lambda p: F.concat(p["parts"]["head"], p["parts"]["body"], F.lit("<|im_end|>\n"))), "")
    return one.select(key, whole.alias("formatted"), spans.alias("loss"))


def read_back(chats: DataFrame, key: str) -> DataFrame:
    """The turns (array of role, text) of ``formatted`` and the texts under ``loss``, both unescaped."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")
    turn = lambda p: F.struct(
        unescaped_role(F.substring_index(F.substr(p, F.lit(13)), "\n", 1)).alias("role"),
        unescaped(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)).alias("text"),
    )
    spans = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.select(key, "formatted", F.transform(pieces, turn).alias("turns"), F.array_join(spans, "").alias("learned"))


def chat_digest(conversations: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """One row per conv_id of rows (conv_id, turn, role, text), all read back from the formatted text.

    Null roles and texts are empty, a null conv_id is a conversation of its own, a null turn comes
    first, and rows that repeat are turns that repeat. No rows give no conversations. A very long text is formatted whole; a
    conversation is one row of the result, so its turns meet in one task. Other columns are not read, whatever their names.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    if extra is not None:
        rows = rows.unionByName(extra)
    records = rows.select("conv_id", "turn", F.expr("to_variant_object(named_struct('role', role, 'text', text))").alias("record"))
    turns = canonical_turns(records).select("conv_id", "turn", F.posexplode("turns").alias("nth", "t"))
    back = read_back(formatted(turns.select("conv_id", F.struct("turn", "nth").alias("at"), "t.role", "t.text"), "conv_id"), "conv_id")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
