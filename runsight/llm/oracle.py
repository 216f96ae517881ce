"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from runsight.llm.chat import CHAT
from runsight.llm.licence_texts import COMMON, COMMON_DIGESTS, EQUIVALENT, KNOWN
from runsight.llm.licenses import BEGINNING, ENDORSEMENT, FROM_NOTICE, MARKER, NOTICE, SIGNS, TITLE, TITLE_LINE

_WORD = r"[^\x20\x09-\x0D]+"


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for sign in CHAT.control:
        out = f"replace({out}, {_text(sign)}, {_text(sign[0] + CHAT.escape + sign[1:])})"
    return out


_CHAT = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
stepped AS (
    SELECT *, lag(role) OVER w AS last, lead(role) OVER w AS next FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
grouped AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(length({_escaped("text")}) + length(replace({_escaped("role")}, chr(10), '\\' || chr(10))) + {len(CHAT.turn_start) + 1 + len(CHAT.turn_end)}) AS formatted_chars,
        bool_and(CASE WHEN last IS NULL THEN role IN ('system', 'user') WHEN last = 'system' THEN role = 'user'
            WHEN last = 'user' THEN role = 'assistant' WHEN last = 'assistant' THEN role = 'user' ELSE FALSE END
            AND (next IS NOT NULL OR role = 'assistant')) AS valid
    FROM stepped GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
    CAST(formatted_chars AS BIGINT) AS formatted_chars, valid FROM grouped"""

_LINES = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, i, lines[i] AS line FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs)),
keyed AS (SELECT *, {_lower("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
often AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, o.key IS NOT NULL AND k.doc_id IS DISTINCT FROM o.keeper AS gone FROM keyed k LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY r, doc_id"""


def _spelled(text: str, spellings: dict[str, str]) -> str:
    out = f"' ' || replace(replace({text}, ' ', '  '), chr(10), ' ' || chr(10) || ' ') || ' '"
    for other, usual in spellings.items():
        out = f"replace({out}, ' {other.replace(' ', '  ')} ', ' {usual} ')"
    return f"regexp_replace({out}, ' +', ' ', 'g')"


def _levelled(text: str) -> str:
    """The canonical text, with a line break ahead."""
    out = f"regexp_replace(lower(coalesce({text}, '')), '{SIGNS}', ' copyright ', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '{MARKER}', '\\1\\2', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    out = _spelled(out, {other: usual for other, usual in EQUIVALENT.items() if " " not in other})
    return f"chr(10) || array_to_string(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), chr(10))"


def _text_digest(text: str) -> str:
    flat = _spelled(f"trim(regexp_replace({text}, '[ \\n]+', ' ', 'g'))", {other: usual for other, usual in EQUIVALENT.items() if " " in other})
    flat = f"trim(regexp_replace({flat}, '{ENDORSEMENT}', 'neither the name of the copyright holder nor the names of', 'g'))"
    return f"(SELECT CASE WHEN f <> '' THEN sha256(f) END FROM (SELECT {flat} AS f))"


_APART = "array_to_string(list_transform(string_split({}, chr(10)), lambda x: CASE WHEN regexp_matches(x, '" + TITLE_LINE + "') AND NOT contains(x, 'copyright') THEN chr(10) || x || chr(10) ELSE x END), chr(10))"
_PARAGRAPHS = "list_transform(string_split_regex({}, '\\n\\n+'), lambda p: trim(replace(p, chr(10), ' ')))"
_DIGESTS = f"""
    SELECT id, t, CASE WHEN begun THEN {_text_digest("array_to_string(list_transform(ps, lambda p: CASE WHEN regexp_matches(p, '" + NOTICE + "') THEN regexp_replace(p, '" + FROM_NOTICE + "', '', 'g') ELSE p END), ' ') || body")}
            WHEN len(list_filter(ps, lambda p: p <> '' AND NOT regexp_matches(p, '{NOTICE}'))) = 0 AND (contains(t, 'copyright') OR contains(t, 'all rights reserved')) THEN NULL ELSE {_text_digest("t")} END AS whole,
        CASE WHEN begun AND len(list_filter(ps, lambda p: p <> '' AND NOT regexp_matches(p, '{NOTICE}') AND NOT regexp_matches(p, '{TITLE}'))) = 0 THEN {_text_digest("body")} END AS body
    FROM (SELECT *, {_PARAGRAPHS.format(_APART.replace("{}", "CASE WHEN begun THEN head ELSE t END"))} AS ps, substr(t, length(head) + 1) AS body
        FROM (SELECT *, regexp_matches(t, '{BEGINNING}') AS begun, regexp_extract(t, '{BEGINNING}', 1) AS head FROM (SELECT id, {_levelled("text")} AS t FROM TABLE_OF_TEXTS)))"""

_LICENCES = f"""
WITH texts(id, text) AS (VALUES {", ".join(f"({_text(name)}, {_text(text)})" for name, text in (KNOWN | COMMON).items())}),
of_texts AS ({_DIGESTS.replace("TABLE_OF_TEXTS", "texts")}),
known AS (SELECT min(licence) AS licence, digest FROM (SELECT id AS licence, whole AS digest FROM of_texts UNION ALL SELECT id, body FROM of_texts
    UNION ALL VALUES {", ".join(f"({_text(name)}, {_text(digest)})" for digest, name in COMMON_DIGESTS.items())}) WHERE digest IS NOT NULL GROUP BY digest),
docs AS (SELECT row_number() OVER () AS id, doc_id, text FROM documents),
of_docs AS ({_DIGESTS.replace("TABLE_OF_TEXTS", "docs")}),
notices AS (SELECT id, string_agg(DISTINCT k.licence, ',' ORDER BY k.licence) AS notices
    FROM (SELECT id, unnest(string_split(t, chr(10))) AS line FROM of_docs) JOIN known k ON k.digest = sha256(line) WHERE line <> '' GROUP BY id)
SELECT d.doc_id, o.whole AS digest, coalesce(a.licence, b.licence) AS licence, coalesce(n.notices, '') AS notices
FROM docs d JOIN of_docs o USING (id) LEFT JOIN known a ON a.digest = o.whole LEFT JOIN known b ON b.digest = o.body LEFT JOIN notices n ON n.id = d.id"""

_NEAR = f"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_WORD}') AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [words]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i:i + 2])) END AS shingles FROM texts),
sized AS (SELECT doc_id, len(shingles) AS n_shingles FROM sets),
held AS (SELECT doc_id, unnest(shingles) AS shingle FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM held a JOIN held b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)),
reach(doc_id, other) AS (SELECT a, b FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT doc_id, n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id, doc_id <= coalesce(other, doc_id) AS kept
FROM sized LEFT JOIN least USING (doc_id)"""

_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(vec_id, other) AS (SELECT a, b FROM links UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(other, vec_id)) AS component_id, vec_id <= coalesce(other, vec_id) AS kept
FROM v LEFT JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)"""

_SENTENCE = r"[^.!?\n]*[.!?\n][.!?\n \t\x0B\f\r]*|[^.!?\n]+"
# All runs of 2 to 13 sentences with 12 words, though the operator hashes only the shortest.
_RUNS = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_SENTENCE}') AS sentences FROM documents),
each AS (SELECT r, doc_id, i, sentences[i] AS sentence FROM (SELECT *, unnest(range(1, len(sentences) + 1)) AS i FROM docs)),
plain AS (SELECT *, trim(regexp_replace({_lower("sentence")}, '[ \t\x0B\f\r]+', ' ', 'g'), ' ' || chr(10)) AS s FROM each),
sized AS (SELECT *, CASE WHEN s = '' THEN 0 ELSE length(s) - length(replace(s, ' ', '')) + 1 END AS w FROM plain),
ahead AS (SELECT *, list(s) OVER x AS ss, list(w) OVER x AS ws FROM sized WINDOW x AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
spans AS (SELECT r, doc_id, i, n, ss[1:n] AS span FROM (SELECT *, unnest(range(2, len(ss) + 1)) AS n FROM ahead) WHERE list_sum(ws[1:n]) >= 12
    UNION ALL SELECT r, doc_id, i, 1, [s] FROM sized WHERE w >= 30),
ranked AS (SELECT *, row_number() OVER x AS k, first(doc_id) OVER x AS first_doc_id FROM spans WINDOW x AS (PARTITION BY span ORDER BY doc_id NULLS FIRST, i)),
gone AS (SELECT r, j, min(first_doc_id) AS first_doc_id FROM (SELECT r, unnest(range(i, i + n)) AS j, first_doc_id FROM ranked WHERE k > 1) GROUP BY r, j)
SELECT doc_id, count(*) AS n_sentences, count(g.j) AS n_removed,
    sha256(coalesce(string_agg(sentence, '' ORDER BY i) FILTER (g.j IS NULL), '')) AS kept_sha256, min(first_doc_id) AS first_doc_id
FROM each e LEFT JOIN gone g ON g.r = e.r AND g.j = e.i GROUP BY e.r, doc_id HAVING count(g.j) > 0"""

_MIDDLE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
rolled AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM docs),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM rolled),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM parts"""


def _clusters(rounds: int = 3) -> str:
    """Rounds one after another, each as a step of its own."""
    steps = """WITH whole AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
vectors AS (SELECT r, vec_id, i, v[i] AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM whole)),
centroids_0 AS (SELECT c, i, v[i] AS y FROM (SELECT *, unnest(range(1, 65)) AS i FROM (
    SELECT v, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS c FROM whole) WHERE c < 16))"""
    for n in range(rounds + 1):
        steps += f""",
apart_{n} AS (SELECT r, vec_id, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS distance FROM vectors JOIN centroids_{n} USING (i) GROUP BY ALL),
nearest_{n} AS (SELECT r, vec_id, c, distance FROM apart_{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1)"""
        if n < rounds:
            steps += f""",
means_{n} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM nearest_{n} JOIN vectors USING (r) GROUP BY ALL),
centroids_{n + 1} AS (SELECT c, i, coalesce((s - (s % n + n) % n) // n, y) AS y FROM centroids_{n} LEFT JOIN means_{n} USING (c, i))"""
    return f"""{steps},
digests AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM centroids_{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
    CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM nearest_{rounds} JOIN digests USING (c)"""


ORACLE = {"op7_span_dedup": _RUNS, "op7_span_dedup_runs": _RUNS, "op8_embedding_near_dup": _VECTORS, "op1_near_dup": _NEAR, "op5_chat_format": _CHAT, "op9_line_dedup": _LINES, "op10_license_scan": _LICENCES, "op12_centroid_clusters": _clusters(), "op13_fill_in_middle": _MIDDLE}
