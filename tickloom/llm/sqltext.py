"""SQL texts (DuckDB) of the operators that SQL can express, written independently of their method."""

from __future__ import annotations

# Base32 from five hex digits at a time: 20 bits, four letters.
_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((g >> {}) & 31 AS INTEGER), 1)"
_GROUP = "CAST(concat('0x', substr(sha1(p), {}, 5)) AS INTEGER)"
_BASE32 = (
    "list_aggregate(list_transform(["
    + ", ".join(_GROUP.format(5 * k + 1) for k in range(8))
    + "], lambda g: concat("
    + ", ".join(_DIGIT.format(b) for b in (15, 10, 5, 0))
    + ")), 'string_agg', '')"
)

WARC = f"""WITH r AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY p) AS first_id FROM r)
SELECT page_id, CAST(octet_length(encode(p)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM m"""

CHAT = r"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, CASE WHEN contains(text, '\') OR contains(text, '</turn>') OR contains(text, '### ')
    THEN replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# ') ELSE text END AS shown FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(concat('### ', role, ': ', shown, '</turn>', chr(10)))) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 12], ' ') AS x, least(len(w), 13) AS size
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') AS x
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
h AS (SELECT dw.doc_id, dw.k, dw.size, iw.item_id FROM dw JOIN iw ON dw.x = iw.x AND dw.size = iw.size),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM h) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

EMBEDDING = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

# Bytes of letters up to U+00FF, digits and the colon; crc32 from its polynomial, byte by byte.
_BYTES = "flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))"
_SPELLED_H = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(b, lambda x: CAST(x AS BIGINT))),
    lambda c, x: xor(c >> 8, t[1 + CAST(xor(c, x) & 255 AS INTEGER)])), CAST(4294967295 AS BIGINT))"""

SPELLING = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY 1, 2),
bytes AS (SELECT run, n, {_BYTES} AS b FROM (SELECT run, n, concat(doc_id, ':', run) AS s FROM runs)),
hashed AS (SELECT run, n, {_SPELLED_H} AS h FROM bytes, crc),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN concat(left(run, CAST(h % length(run) AS INTEGER)), substr(run, CAST(h % length(run) AS INTEGER) + 2)) ELSE run END AS word, n FROM hashed),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
gone AS MATERIALIZED (SELECT word, p, concat(left(word, p - 1), substr(word, p + 1)) AS rest FROM (SELECT word, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS p FROM w)),
near AS MATERIALIZED (SELECT DISTINCT a.word, b.word AS other FROM gone a JOIN gone b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT g.word, w.word FROM gone g JOIN w ON g.rest = w.word UNION SELECT w.word, g.word FROM gone g JOIN w ON g.rest = w.word),
best AS (SELECT near.word, count(*) AS n_near, first(struct_pack(form := o.word, n := o.n) ORDER BY o.n DESC, encode(o.word)) AS x FROM near JOIN w o ON near.other = o.word GROUP BY 1),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN x.n >= 5 * w.n THEN x.form END AS form, CASE WHEN x.n >= 5 * w.n THEN x.n END AS form_n
  FROM w LEFT JOIN best USING (word)),
walk(word, reached) AS (SELECT word, word FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON walk.reached = forms.word WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, walk.reached AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk ON walk.word = f.word JOIN forms last ON last.word = walk.reached AND last.form IS NULL"""


def _repair_sql() -> str:
    """The cheapest edits from the last row to the first: for each state (nothing kept, system, user, assistant) the least
    (cost, edits, rows) that completes the conversation."""
    made = lambda cost, letter, row, rest: f"{{'c': {rest}.c + {cost}, 'a': concat('{letter}', {rest}.a), 'r': {'list_prepend(' + row + f', {rest}.r)' if row else f'{rest}.r'}}}"
    own, user, assistant = "concat(role, ':', text)", "concat('user:', text)", "concat('assistant:', text)"
    free = "fault NOT IN (1, 2)"
    keep = lambda initial, then: f"CASE WHEN {free} AND left(role, 1) = '{initial}' THEN {made('x', 'K', own, then)} END"
    rerole = lambda row, then: f"CASE WHEN {free} THEN {made('x + 3', 'R', row, then)} END"
    least = lambda *options: f"list_min([{', '.join(options)}])"
    plain = {
        "e": least(made(4, "D", "", "e"), keep("u", "u"), keep("s", "s"), rerole(user, "u")),
        "s": least(made(4, "D", "", "s"), keep("u", "u"), rerole(user, "u")),
        "u": least(made(4, "D", "", "u"), keep("a", "a"), rerole(assistant, "a")),
        "a": least(made(4, "D", "", "a"), keep("u", "u"), rerole(user, "u")),
    }
    one = lambda role, rest: made(3, "I", f"'{role}:'", rest)
    two = "{'c': a.c + 6, 'a': concat('II', a.a), 'r': list_concat(['user:', 'assistant:'], a.r)}"
    closed = {"e": least("e", one("user", "u"), two), "s": least("s", one("user", "u"), two), "u": least("u", one("assistant", "a")), "a": least("a", one("user", "u"))}
    end = lambda cost, edits, rows: f"{{'c': CAST({cost} AS BIGINT), 'a': '{edits}', 'r': CAST([{rows}] AS VARCHAR[])}}"
    solid = r"regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1)"
    return f"""WITH RECURSIVE {SPELLING[len('WITH RECURSIVE '):SPELLING.index('runs AS')]}
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS s FROM conversations),
hashed AS (SELECT *, {_SPELLED_H} % 20 AS f FROM (SELECT *, {_BYTES} AS b FROM src), crc),
damaged AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, (VALUES (0), (1)) v(copy) WHERE f <> 0 AND (copy = 0 OR f = 3)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text)) AS i FROM damaged),
faults AS MATERIALIZED (SELECT *, CASE WHEN {solid} = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
    WHEN {solid} NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  concat(left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1), left(role, 1)) AS pair FROM numbered),
walk(conv_id, i, e, s, u, a) AS (
  SELECT conv_id, max(i) + 1, {end(0, '', '')}, {end(6, 'II', "'user:', 'assistant:'")}, {end(3, 'I', "'assistant:'")}, {end(0, '', '')} FROM faults GROUP BY 1
  UNION ALL SELECT conv_id, i, {', '.join(closed[k] for k in 'esua')} FROM (
    SELECT conv_id, i, {', '.join(f'{plain[k]} AS {k}' for k in 'esua')} FROM (
      SELECT f.conv_id, f.i, role, text, fault, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS x, e, s, u, a
      FROM walk JOIN faults f ON f.conv_id IS NOT DISTINCT FROM walk.conv_id AND f.i = walk.i - 1))),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY 1)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(array_to_string(e.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN walk w ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = 1"""


REPAIR = _repair_sql()
