"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from hydrolake.llm import chat, decontaminate, lines


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def escaped(column: str, template: chat.Template) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in template.controls:
        out = f"replace({out}, {quoted(c)}, {quoted(c[0] + chr(92) + c[1:])})"
    return out


def chat_sql(template: chat.Template, extra: str) -> str:
    own = template.turns.items()
    a, b, c = template.other
    marks = " ".join(f"WHEN {quoted(r)} THEN {len(t.before) + len(t.after)}" for r, t in own)
    marks = f"CASE role {marks} ELSE {len(a + b + c)} + length({escaped('role', template)}) END"
    known = ", ".join(quoted(r) for r in template.follows[""])
    moves = " ".join(f"WHEN before = {quoted(s)} THEN role IN ({', '.join(map(quoted, to))})" for s, to in template.follows.items() if s)
    loss = ", ".join(quoted(r) for r, t in own if t.loss)
    ends = ", ".join(map(quoted, template.ends))
    order = "ORDER BY turn, role, text"
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {quoted(extra)} UNION ALL SELECT -7, 1, 'assistant', {quoted(extra)}),
turns AS (SELECT *, lag(role) OVER (PARTITION BY conv_id {order}) AS before, row_number() OVER (PARTITION BY conv_id {order}) AS pos FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role IN ({loss})), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (role IN ({loss})), '')) AS loss_sha256,
  CAST(sum({marks} + length({escaped('text', template)})) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ({known}) {moves} ELSE FALSE END) AND arg_max(role, pos) IN ({ends}) AS valid
FROM turns GROUP BY conv_id"""


LINES_SQL = f"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM cut),
full_lines AS (SELECT *, row_number() OVER d AS k, lead(line) OVER d AS next_line, lead(i) OVER d AS next_i FROM numbered WHERE trim(line) <> ''
  WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
chunks AS (SELECT doc_id, k, line || chr(10) || next_line AS chunk, i AS a, next_i AS b FROM full_lines WHERE next_i IS NOT NULL
  UNION ALL SELECT doc_id, k, line, i, i FROM full_lines WHERE len(regexp_extract_all(line, '{lines.WORD}')) > {lines.LONG}),
judged AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, k) > 1 AS gone FROM chunks),
out_lines AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM judged WHERE gone)
SELECT n.doc_id, count(*) AS n_lines, count(o.i) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY n.i) FILTER (o.i IS NULL), '')) AS kept_sha256
FROM numbered n LEFT JOIN out_lines o ON o.doc_id = n.doc_id AND o.i = n.i GROUP BY n.doc_id"""


def seeds_sql(source: str, whole: bool) -> str:
    """Seeds of general masks, and of those of short items: items as a whole, documents at every place."""
    parts = []
    for number, mask in enumerate(decontaminate.MASKS):
        key = ", ".join(f"words[pos + {i + 1}]" for i, bit in enumerate(mask) if bit == "1")
        parts.append(f"SELECT id, words, pos, concat_ws(' ', '{number}', {key}) AS seed FROM (SELECT *, unnest(range(0, len(words) - {len(mask) - 1})) AS pos FROM {source})")
    for n in range(1, decontaminate.WIDTH):
        for number, mask in enumerate(decontaminate.whole_masks(n, decontaminate.LEAST)):
            key = ", ".join(f"words[pos + {i + 1}]" for i, bit in enumerate(mask) if bit == "1")
            places = "[0]" if whole else f"range({-mask.index('1')}, len(words) - {mask.rindex('1')})"
            rows = f"len(words) = {n}" if whole else f"{n} IN (SELECT len(words) FROM b)"
            parts.append(f"SELECT id, words, pos, concat_ws(' ', '{n}/{number}', {key}) AS seed FROM (SELECT *, unnest({places}) AS pos FROM {source} WHERE {rows})")
    return " UNION ALL ".join(parts)


DECONTAMINATE_SQL = f"""
WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words FROM documents),
b AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words FROM benchmark),
ds AS ({seeds_sql("d", False)}), bs AS ({seeds_sql("b", True)}),
hits AS (SELECT ds.id AS doc_id, bs.id AS item_id, ds.words AS dw, bs.words AS iw, ds.pos - bs.pos AS shift, bs.pos AS pos,
  least({decontaminate.WIDTH}, len(bs.words)) AS need FROM ds JOIN bs ON ds.seed = bs.seed),
bits AS (SELECT doc_id, item_id, need, list_transform(
  range(greatest(pos - {decontaminate.WIDTH - 1}, -shift, 0), least(pos + {max(map(len, decontaminate.MASKS)) + decontaminate.WIDTH - 1}, len(iw), len(dw) - shift)),
  lambda t: CASE WHEN iw[t + 1] = dw[t + shift + 1] THEN 1 ELSE 0 END) AS same FROM hits),
best AS (SELECT doc_id, item_id, need,
  list_max(list_transform(range(1, len(same) + 1), lambda i: list_sum(same[greatest(i - need, 0) + 1:i]))) AS agreeing FROM bits)
SELECT doc_id, item_id, count(*) AS n_hits, CAST(max(agreeing) AS BIGINT) AS agreeing
FROM best WHERE agreeing >= ceil(need * {decontaminate.LEAST} - 1e-9) GROUP BY doc_id, item_id"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RANKING_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY item_id, term),
s AS (SELECT count(*) AS big_n, CAST(sum(len(terms)) AS BIGINT) AS big_l FROM d WHERE len(terms) > 0),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term, big_n),
scored AS (SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""
