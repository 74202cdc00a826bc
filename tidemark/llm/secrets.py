"""Secret scans with a trigram inverted index, in DataFrame and SQL functions alone.

Each rule's pattern gives a Boolean query over trigrams: alternatives, each a set of trigrams that a text must have if
the rule is to match in it. The index has a posting (trigram, key of the row) for each trigram that some query asks for;
its postings are intersected by key, and only rules whose query holds are verified, by their pattern, on the whole text. A rule
without mandatory trigrams has the empty alternative and is verified on every text. Trigrams are taken from
folded texts and patterns, so the index passes some texts more than needed, never fewer.

The key is a hash of the row. Two rows with one key get each other's candidates, which verification rejects.
"""

from __future__ import annotations

from functools import reduce
from re import _constants as kinds
from re import _parser
from string import ascii_uppercase
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

#: Strings that a part of a pattern may stand for, alternatives of a query, and trigrams of an alternative, beyond which less is asked for.
STRINGS, ALTERNATIVES, GRAMS = 32, 64, 4


class Rule(NamedTuple):
    """A match counts if its ``group`` has at least ``least`` characters. Patterns mean the same to Java, RE2 and Python."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def any_case(word: str) -> str:
    """A pattern for the word with ASCII letters in either case; flags would fold other letters too, in some engines."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The rules that every scan has, in the order in which kinds are listed. Longest runs of at least so many characters are what is left of
#: all longest runs when the shorter ones are dropped, as a run's first start is also the one with the most behind it.
BASE = (
    Rule("assign", f"({'|'.join(any_case(w) for w in ('password', 'passwd', 'secret', 'token', 'api_?key'))})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Publicly documented shapes of keys and tokens, whose spans are added.
MORE = (
    Rule("temporary", "ASIA[A-Z0-9]{16,}"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", "[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("private", "-----BEGIN ((RSA|DSA|EC|OPENSSH|ENCRYPTED) )?PRIVATE KEY-----"),
    Rule("login", r"(https?|ftp|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9_.-]+:[A-Za-z0-9_.%+-]+@[A-Za-z0-9_.-]+"),
)
RULES = BASE + MORE

Query = frozenset[frozenset[str]]
ALL: Query = frozenset([frozenset()])


def _fewest(q: Query) -> Query:
    """Without alternatives that ask for more than another does."""
    return frozenset(a for a in q if not any(b < a for b in q))


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > ALTERNATIVES:
        return min(a, b, key=len)  # asks for less, so nothing is missed
    return _fewest(frozenset(x | y for x in a for y in b))


def _either(parts: list[Query]) -> Query:
    q = _fewest(frozenset().union(*parts))
    return q if len(q) <= ALTERNATIVES else ALL


def _of_strings(strings: set[str]) -> Query:
    return _either([frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings])


def _part(op, arg) -> tuple[set[str] | None, Query]:
    """The folded strings that a part of a pattern stands for, if they are few, else what must be in a match of it."""
    if op is kinds.LITERAL:
        return {chr(arg).lower()}, ALL
    if op is kinds.AT:
        return {""}, ALL
    if op is kinds.IN:
        found = set()
        for kind, value in arg:
            if kind is kinds.LITERAL:
                found.add(chr(value).lower())
            elif kind is kinds.RANGE and value[1] - value[0] < STRINGS:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, ALL
        return (found, ALL) if len(found) <= STRINGS // 2 else (None, ALL)
    if op is kinds.SUBPATTERN:
        return _sequence(arg[3])
    if op is kinds.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        if all(s is not None for s, _ in parts) and len(found := set().union(*[s for s, _ in parts])) <= STRINGS:
            return found, ALL
        return None, _either([q if s is None else _of_strings(s) for s, q in parts])
    if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
        least, most, inner = arg
        strings, q = _sequence(inner)
        if strings is not None and (least, most) in ((0, 1), (1, 1)):
            return strings | ({""} if least == 0 else set()), ALL
        return None, ALL if least == 0 else q if strings is None else _of_strings(strings)
    return None, ALL


def _sequence(items) -> tuple[set[str] | None, Query]:
    run, whole, q = {""}, True, ALL
    for op, arg in items:
        strings, need = _part(op, arg)
        if strings is not None and len(run) * len(strings) <= STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        whole, q = False, _both(q, _of_strings(run))
        run = {""} if strings is None else strings
        q = _both(q, need)
    return (run, ALL) if whole else (None, _both(q, _of_strings(run)))


def trigram_query(pattern: str) -> Query:
    """Alternatives of folded trigrams, one of which every text has whole in which the pattern matches."""
    strings, q = _sequence(_parser.parse(pattern))
    q = q if strings is None else _of_strings(strings)
    few = lambda a: sorted(a) if len(a) <= GRAMS else [sorted(a)[i * (len(a) - 1) // (GRAMS - 1)] for i in range(GRAMS)]
    return _fewest(frozenset(frozenset(few(a)) for a in q))


def postings(docs: DataFrame, trigrams: list[str], key: str, text: str) -> DataFrame:
    """The index: (gram, key) for each of the trigrams that a row's folded text has, once a row."""
    low = docs.select(key, F.lower(F.col(text)).alias("low"))
    there = F.filter(F.array(*[F.lit(g) for g in trigrams]), lambda g: F.contains(F.col("low"), g))
    return low.select(key, F.explode(there).alias("gram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...], key: str) -> DataFrame:
    """(key, rules): numbers of the rules whose query holds, from postings intersected by key; rules without a query are not here."""
    held = index.groupBy(key).agg(F.collect_set("gram").alias("grams"))
    asks = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) != ALL}
    one = lambda grams: F.size(F.array_except(F.array(*[F.lit(g) for g in sorted(grams)]), F.col("grams"))) == 0
    found = [F.when(reduce(lambda a, b: a | b, [one(g) for g in q]), F.lit(i)) for i, q in asks.items()]
    return held.select(key, F.array_compact(F.array(*found)).alias("rules")).where(F.size("rules") > 0)


def _matches(rule: Rule, number: int, text: str) -> Column:
    """Leftmost matches of a rule that do not overlap: their order, the characters before each since the last one, and their own."""
    every = lambda group: F.regexp_extract_all(F.col(text), F.lit(rule.pattern), F.lit(group))
    found = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), every(0).alias("hit"), *([every(rule.group).alias("part")] if rule.group else []))
    row = lambda x, i: F.struct(F.lit(number).alias("rule"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), (F.length(x["part" if rule.group else "hit"]) >= rule.least).alias("good"))
    return F.transform(F.filter(found, lambda x: x["hit"].isNotNull()), row)


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, a count for each of the first ``base`` rules, base_sha256 of their spans, all spans.

    A span is kind:start:end of a whole match, in code points, the end exclusive; spans go by start, then by the order of
    the rules. Null and empty texts have none, and give empty lists. Rows that repeat or share an id stay apart; other columns are
    not read. An empty table gives no rows. A very long text is verified whole, in one task, and its matches are numbered by a
    running sum, so time follows its length. Texts are shuffled once, to their candidates.
    """
    trigrams = sorted({g for r in rules for a in trigram_query(r.pattern) for g in a})
    always = [i for i, r in enumerate(rules) if trigram_query(r.pattern) == ALL]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    found = candidates(postings(rows, trigrams, "key", "text"), rules, "key").hint("shuffle_hash")
    rows = rows.join(found, "key", "left").withColumn("row", F.monotonically_increasing_id())
    none = F.array().cast("array<struct<rule:int,i:int,gap:int,size:int,good:boolean>>")
    # most candidates have no match, which one look tells
    asked = lambda i, r: F.rlike(F.col("text"), F.lit(r.pattern)) if i in always else F.array_contains("rules", i) & F.rlike(F.col("text"), F.lit(r.pattern))
    tried = [F.when(asked(i, r), _matches(r, i, "text")).otherwise(none) for i, r in enumerate(rules)]
    each = rows.select("key", "row", "doc_id", F.explode_outer(F.flatten(F.array(*tried))).alias("m")).select("key", "row", "doc_id", "m.*")
    run = SparkWindow.partitionBy("key", "row", "rule").orderBy("i").rowsBetween(SparkWindow.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(run)).withColumn("start", F.col("end") - F.col("size"))
    span = F.when(F.col("good"), F.struct("start", "rule", "end"))
    spans = each.groupBy("key", "row").agg(F.max("doc_id").alias("doc_id"), *[F.count_if(F.col("good") & (F.col("rule") == i)).alias(f"n_{rules[i].kind}") for i in range(base)], F.array_sort(F.collect_list(span)).alias("spans"))
    names = F.array(*[F.lit(r.kind) for r in rules])
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    first = F.filter("spans", lambda s: s["rule"] < base)
    return spans.select("doc_id", *[f"n_{rules[i].kind}" for i in range(base)], F.sha2(said(first).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
