"""DuckDB SQL of the numbered queries, over the same tables."""

from __future__ import annotations

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM benchmark),
m AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
        FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM m)),
dw AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
             FROM d, (SELECT DISTINCT k FROM m) WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN win ON dw.g = win.g AND dw.k = win.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP8 = """
WITH v AS (SELECT DISTINCT vec_id, [CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product([CAST(a AS DOUBLE) FOR a IN q.x], [CAST(b AS DOUBLE) FOR b IN c.x]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP1 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
           UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
f AS (SELECT *, '<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) AS line FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(length(line)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


def op10() -> str:
    """The same votes with runs of words as text."""
    from tidemark.llm.license import COVER, GAP, K, templates

    values = ", ".join(f"({i}, '{label}', {phrase}, string_split('{words}', ' '))" for i, label, phrase, words in templates())
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
t(tid, label, phrase, tw) AS (VALUES {values}),
tr AS (SELECT tid, label, phrase, len(tw) AS length, i - 1 AS tpos, array_to_string(list_slice(tw, i, i + {K - 1}), ' ') AS g
       FROM (SELECT *, unnest(generate_series(1, len(tw) - {K - 1})) AS i FROM t)),
dr AS (SELECT doc_id, i - 1 AS pos, array_to_string(list_slice(w, i, i + {K - 1}), ' ') AS g
       FROM (SELECT *, unnest(generate_series(1, len(w) - {K - 1})) AS i FROM d)),
lines AS (SELECT doc_id, tid, label, phrase, length, pos - tpos AS diagonal, list(tpos) AS runs, min(pos) AS lo, max(pos) AS hi
          FROM dr JOIN tr USING (g) GROUP BY ALL),
parts AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) AS part
          FROM (SELECT *, CASE WHEN phrase OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) > {GAP} THEN 1 ELSE 0 END AS apart FROM lines)),
spans AS (SELECT doc_id, tid, label, phrase, length, min(lo) AS lo, max(hi) + {K} AS hi, min(diagonal) AS start,
          len(list_distinct(flatten(list_transform(flatten(list(runs)), lambda p: generate_series(p, p + {K - 1}))))) / length AS share
          FROM parts GROUP BY doc_id, tid, label, phrase, length, part),
good AS (SELECT * FROM spans WHERE CASE WHEN phrase THEN share = 1 ELSE share >= {COVER} AND hi - lo <= 2 * length END),
agg AS (SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(start) FILTER (phrase) AS first_word, max(start) FILTER (phrase) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
        FROM good GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN agg USING (doc_id)
"""


def op11() -> str:
    """The same rounds with every distance computed; vectors of one length that 16 divides."""
    from tidemark.llm.codes import ENTRIES, PARTS, ROUNDS

    dot = "list_inner_product"
    near = lambda n: f"""
a{n} AS (SELECT p.r, p.part, min({{'d': CAST({dot}(p.y, p.y) + {dot}(c.y, c.y) - 2 * {dot}(p.y, c.y) AS BIGINT), 'e': c.entry}}) AS best
       FROM p JOIN c{n} c ON p.part = c.part GROUP BY p.r, p.part)"""  # noqa: E731
    learn = lambda n: f"""{near(n)},
c{n + 1} AS (SELECT c.part, c.entry, coalesce(m.y, c.y) AS y FROM c{n} c LEFT JOIN (
       SELECT part, entry, list(floor(s / k) ORDER BY place) AS y FROM (
         SELECT p.part, best.e AS entry, place, sum(p.y[place]) AS s, count(*) AS k
         FROM p JOIN a{n} USING (r, part), (SELECT unnest(generate_series(1, (SELECT w FROM w))) AS place) GROUP BY ALL)
       GROUP BY part, entry) m ON m.part = c.part AND m.entry = c.entry)"""  # noqa: E731
    return f"""
WITH v AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r FROM (
       SELECT vec_id, label, [floor(256 * CAST(c AS DOUBLE)) FOR c IN embedding] AS x FROM embeddings
       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
w AS (SELECT max(len(x)) // {PARTS} AS w FROM v),
p AS (SELECT r, part, x[part * w + 1 : (part + 1) * w] AS y FROM v, w, (SELECT unnest(range({PARTS})) AS part)),
c0 AS (SELECT part, r - 1 AS entry, y FROM p WHERE r <= {ENTRIES}),
{",".join(learn(n) for n in range(ROUNDS))},
{near(ROUNDS)},
b AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, place)) AS h
      FROM (SELECT part, entry, unnest(y) AS v, generate_subscripts(y, 1) AS place FROM c{ROUNDS})),
o AS (SELECT r, string_agg(format('{{:02x}}', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN o USING (r), b
"""


def op12(levels: int = 7, last: int = 3) -> str:
    """The same trees level by level, for at most 8 ** levels rows of a language and 8 ** last languages."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    said = lambda x: f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(said(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def climb(n: str, s: str, count: int) -> str:
        made = []
        for i in range(count):
            made.append(f"""
r{n}{i} AS (SELECT tree, pos // 8 AS pos, max(total) AS total, list(h ORDER BY pos) AS run FROM {n}{i} GROUP BY tree, pos // 8),
{n}{i + 1} AS (SELECT tree, pos, (total + 7) // 8 AS total, CASE WHEN total = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM r{n}{i}),
{s}{i + 1} AS (SELECT r, s.tree, s.pos // 8 AS pos, CASE WHEN total = 1 THEN sibs ELSE sibs || run[: s.pos % 8] || run[s.pos % 8 + 2 :] END AS sibs,
       CASE WHEN total = 1 THEN fold ELSE sha256(array_to_string(run[: s.pos % 8] || [fold] || run[s.pos % 8 + 2 :], '')) END AS fold
       FROM {s}{i} s JOIN r{n}{i} q ON q.tree = s.tree AND q.pos = s.pos // 8)""")
        return ",".join(made)

    return f"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
crc AS (SELECT *, xor(list_reduce(list_concat([4294967295], [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents, tab),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS leaf,
      CASE WHEN crc % 3 = 0 THEN {leaf(low)} ELSE {leaf("text")} END AS other FROM crc),
m0 AS (SELECT r, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS total, leaf AS h, other FROM d),
n0 AS (SELECT tree, pos, total, h FROM m0),
s0 AS (SELECT r, tree, pos, CAST([] AS VARCHAR[]) AS sibs, other AS fold FROM m0),
{climb("n", "s", levels)},
u AS (SELECT tree AS own, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS total, h FROM n{levels}),
t0 AS (SELECT '' AS tree, pos, total, h FROM u),
p0 AS (SELECT r, '' AS tree, u.pos, sibs, fold FROM s{levels} s JOIN u ON u.own = s.tree),
{climb("t", "p", last)}
SELECT doc_id, leaf, u.h AS subroot, t.h AS root, sha256(array_to_string(sibs, '')) AS proof_sha256, fold AS folded_root, fold = t.h AS verified
FROM d JOIN p{last} p USING (r) JOIN u ON u.own = d.tree, t{last} t
"""


def op13() -> str:
    """The same rules on every text, without an index."""
    from tidemark.llm.secrets import BASE, RULES, Rule

    # all runs, of which the short ones are dropped
    plain = (BASE[0], Rule("access", "AKIA[A-Z0-9]+", 0, 20), Rule("hex", "[0-9a-f]+", 0, 24), *RULES[len(BASE) :])
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    each = " UNION ALL ".join(f"""
SELECT r, {i} AS rule, generate_subscripts(hits, 1) AS i, unnest(list_transform(hits, lambda x: length(x))) AS size,
       unnest(list_transform(gaps[: len(hits)], lambda x: length(x))) AS gap, unnest(list_transform(parts, lambda x: length(x) >= {x.least})) AS good
FROM (SELECT r, regexp_extract_all(t, {quoted(x.pattern)}) AS hits, regexp_extract_all(t, {quoted(x.pattern)}, {x.group}) AS parts, string_split_regex(t, {quoted(x.pattern)}) AS gaps FROM d)"""
                              for i, x in enumerate(plain))
    said = "kind || ':' || first || ':' || last"
    counts = ", ".join(f"count(*) FILTER (rule = {i}) AS n_{x.kind}" for i, x in enumerate(BASE))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({each}),
k AS (SELECT r, rule, good, [{", ".join(quoted(x.kind) for x in RULES)}][rule + 1] AS kind, CAST(sum(gap + size) OVER (PARTITION BY r, rule ORDER BY i) AS BIGINT) AS last, size FROM m),
g AS (SELECT *, last - size AS first FROM k WHERE good),
o AS (SELECT r, {counts}, sha256(coalesce(string_agg({said}, ',' ORDER BY first, rule) FILTER (rule < {len(BASE)}), '')) AS base_sha256,
      string_agg({said}, ',' ORDER BY first, rule) AS spans FROM g GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{x.kind}, 0) AS n_{x.kind}" for x in BASE)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (r)
"""
