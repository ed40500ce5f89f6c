"""SQL (DuckDB dialect) of the queries over sources, sinks, model outputs, link preparation, re-indexing and pipelines."""

from __future__ import annotations

from skein.operators.chunking import SEPARATORS
from skein.plans.sql import _BM25, _BODY, _COVER, _FIRST, _GRAMS, _H, _L2, _LINE, _LINKS, _NOTE_EDGES, _PRED, _PRF, _QA20, _SEEDS, _SENTS, _STOP, _STOPHEADS, _VEC, _WS, ORACLE_SQL as _BASE, _edge_counts, _strip, _title, _tokens

_NEWLINES = r"regexp_replace(content, '\r\n?', chr(10), 'g')"
_PART = r"regexp_extract({0}, '^[^_]+_[^_]+_(.+)$', 1)"


def _spaced(x: str) -> str:
    return _strip(f"regexp_replace(replace({x}, '_', ' '), '{_WS}+', ' ', 'g')")


def _node(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all(lower({_spaced(x)}), '\p{{L}}+|\P{{L}}+'), lambda p: upper(p[1:1]) || p[2:]), '')"


def _alias(x: str) -> str:
    return "lower(" + _strip(rf"translate({x}, '_\-', '   ')") + ")"


def _file_name(x: str) -> str:
    return f"""replace(replace(replace({_strip(x)}, ' ', '_'), '/', '-'), '"', '')"""


def _lemmas(x: str) -> str:
    return f"list_distinct(list_filter({_tokens(x)}, lambda w: NOT list_contains({_STOP}, w)))"


def _stem(x: str) -> str:
    return rf"regexp_replace(list_last(string_split({x}, '/')), '\.md$', '')"


_NEW_LINES = f"""
nl AS (
  SELECT source_path, list_sort(list(line)) AS new FROM (SELECT DISTINCT source_path, {_LINE} AS line FROM ({_PRED})
    WHERE relation_type IS NOT NULL AND lower(trim(relation_type)) NOT IN ('no link', '')) GROUP BY source_path)"""
_CHANGES = f"changes AS ({_BASE['content_hash_changes']})"
_TITLE_HITS = rf"""
pg AS (
  SELECT vault || '/' || rel_path AS page, {_strip(rf"regexp_replace(body, '(?ims)^(?:#{{1,6}}\s+|={{1,6}}\s*)?(?:{_STOPHEADS})(?:\s*[:\-])?\s*$.*\z', '')")} AS text FROM notes WHERE body IS NOT NULL),
sl AS (SELECT page, {_SENTS.format('text')} AS ss FROM pg),
se AS (SELECT page, unnest(range(len(ss))) AS idx, unnest(ss) AS sentence FROM sl),
ti AS (SELECT * FROM (SELECT DISTINCT sample_name || '/' || source_file AS page, {_PART.format('entity')} AS title FROM gold WHERE entity IS NOT NULL AND source_file IS NOT NULL) WHERE title <> ''),
tl AS (SELECT page, title, list_filter({_tokens(_spaced('title'))}, lambda x: NOT list_contains({_STOP}, x)) AS l FROM ti),
tw AS (SELECT page, title, l[1] AS head, list_distinct(l) AS w, CASE WHEN len(list_distinct(l)) <= 2 THEN len(list_distinct(l)) ELSE ceil(len(list_distinct(l)) * 0.75) END AS need FROM tl),
pr AS (SELECT se.page, title, idx, sentence, {_tokens('sentence')} AS s, w, head, need FROM se JOIN tw USING (page)),
po AS (SELECT page, title, idx, i, s[i] AS tok FROM (SELECT page, title, idx, s, w, unnest(range(1, len(s) + 1)) AS i FROM pr) WHERE list_contains(w, s[i])),
sp AS (SELECT p.page, p.title, p.idx, p.i, count(DISTINCT q.tok) AS n, list(q.tok) AS held FROM po p JOIN po q ON p.page = q.page AND p.title = q.title AND p.idx = q.idx AND q.i BETWEEN p.i AND p.i + 15 GROUP BY ALL),
hit AS (SELECT DISTINCT pr.page, pr.title, pr.idx, sentence FROM pr JOIN sp ON pr.page = sp.page AND pr.title = sp.title AND pr.idx = sp.idx WHERE len(w) > 0 AND n >= need AND (head IS NULL OR list_contains(held, head)))"""
_GOLD_LINES = f"""
gl AS (
  SELECT sample_name AS vault, source_file AS rel_path, string_agg('- ' || coalesce(link_type, 'None') || ':: [[' || entity || ']]', chr(10) ORDER BY gold_id) AS lines
  FROM gold WHERE entity IS NOT NULL GROUP BY ALL)"""
_NAMES = f"""
nm AS (
  SELECT DISTINCT vault, {_alias('n')} AS alias, file_path FROM (
    SELECT vault, vault || '/' || rel_path AS file_path, unnest([{_title('rel_path')}, stem, {_PART.format('stem')}]) AS n FROM notes)),
names_ AS (SELECT * FROM nm WHERE alias <> '')"""
_CONTEXTS = """
cx AS (
  SELECT query_id, count(*) AS n, list(text ORDER BY rank_no, text) AS texts FROM search_hits WHERE text IS NOT NULL GROUP BY query_id)"""
_VISITED = """
seeds AS (SELECT DISTINCT query_id, file_path AS node FROM bmk JOIN chunks USING (chunk_id) WHERE rank_no <= 5),
"""
_COLLECT = f"""
ct AS (
  SELECT v.query_id, c.file_path, c.chunk_id, c.text, round({_COVER.format(q='q.ql', c=_tokens('c.text'))}, 6) AS score
  FROM (SELECT DISTINCT query_id, node FROM visited) v JOIN chunks c ON c.file_path = v.node JOIN (SELECT query_id, list_distinct({_tokens('question')}) AS ql FROM questions) q ON q.query_id = v.query_id)
SELECT query_id, CAST(rank_no AS INTEGER) AS rank_no, text, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_path, chunk_id) AS rank_no FROM ct WHERE score >= 0) WHERE rank_no <= 10"""


def _step(frontier: str, more: str = "") -> str:
    """The nodes that one typed step from a frontier reaches, with their best score."""
    return f"""SELECT s.query_id, dst AS node, max({_COVER.format(q='q.ql', c='et.c')}) AS score FROM {frontier} s JOIN et ON et.src = s.node JOIN (SELECT query_id, list_distinct({_tokens('question')}) AS ql FROM questions) q ON q.query_id = s.query_id
  WHERE NOT EXISTS (SELECT 1 FROM seeds z WHERE z.query_id = s.query_id AND z.node = dst){more} GROUP BY 1, 2 HAVING score >= 0.2"""


def _slots(x: str) -> str:
    """The slots of a text's tokens among 64."""
    return f"list_transform({_tokens(x)}, lambda w: CAST('0x' || md5(w)[1:8] AS UBIGINT) % 64)"


_COUNTS = "list_transform(range(64), lambda i: CAST(len(list_filter(sl, lambda s: s = i)) AS DOUBLE))"


def _unit(x: str) -> str:
    """A list of counts scaled to length one; zeros stay."""
    return f"list_transform({x}, lambda c: c / greatest(1e-300, sqrt(list_dot_product({x}, {x}))))"


def _near(queries: str, keep: int) -> str:
    """near: the nearest chunks of queries (query_id, v) by the cosine of hashed term vectors."""
    return f"""
hc AS (SELECT chunk_id, {_COUNTS} AS v FROM (SELECT chunk_id, {_slots('text')} AS sl FROM chunks WHERE text IS NOT NULL)),
hq AS ({queries}),
hd AS (
  SELECT query_id, chunk_id, round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS distance FROM hq a, hc b
  WHERE list_dot_product(a.v, a.v) > 0 AND list_dot_product(b.v, b.v) > 0),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank_no FROM hd) WHERE rank_no <= {keep})"""


_HASHED_QUESTIONS = f"SELECT query_id, {_COUNTS} AS v FROM (SELECT query_id, {_slots('question')} AS sl FROM questions)"

def _split_at(level: int, separator: str) -> str:
    """Pieces of more than 3000 characters cut in front of each separator but one at their very start."""
    sep = "'" + separator.replace("\n", "' || chr(10) || '") + "'"
    return f"""
l{level + 1} AS (
  SELECT doc_id, flatten(list_transform(ps, lambda p: CASE WHEN length(p) <= 3000 THEN [p] ELSE list_transform(string_split(p[2:], {sep}), lambda x, i: CASE WHEN i = 1 THEN p[1:1] || x ELSE {sep} || x END) END)) AS ps FROM l{level})"""


def _short(x: str) -> str:
    """What a title says behind its two coined words, as an alias."""
    return _alias(rf"regexp_extract({x}, '^\S+ \S+ (.+)$', 1)")


ORACLE_SQL: dict[str, str] = {
    "bfs_discoverers": f"""
WITH RECURSIVE {_NOTE_EDGES}, {_SEEDS},
b(query_id, node, depth) AS (
  SELECT query_id, node, 0 FROM seeds UNION SELECT b.query_id, e.dst, b.depth + 1 FROM b JOIN edges e ON e.src = b.node WHERE b.depth < 2),
d AS (SELECT query_id, node, min(depth) AS depth FROM b GROUP BY ALL)
SELECT d.query_id, d.node, CAST(d.depth AS INTEGER) AS depth, min(p.node) AS via
FROM d LEFT JOIN (SELECT DISTINCT src, dst FROM edges WHERE src <> dst) e ON e.dst = d.node AND d.depth > 0 LEFT JOIN d p ON p.query_id = d.query_id AND p.node = e.src AND p.depth = d.depth - 1 GROUP BY 1, 2, 3""",
    "entity_seeds": f"""
WITH q AS (SELECT qa_id AS query_id, vault, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(question, '[A-Za-zА-Яа-яЁё0-9]{{4,}}'), lambda x: lower(x)), lambda x: NOT list_contains({_STOP}, x)))) AS term FROM qa WHERE qa_id % 20 = 0),
n AS (SELECT DISTINCT concat_ws(':', vault, {_node('stem')}) AS node, vault, {_spaced('stem')} AS dn FROM notes),
k AS (SELECT DISTINCT node, vault, unnest({_tokens('dn')}) AS token FROM n),
m AS (SELECT term, token FROM (SELECT DISTINCT term FROM q), (SELECT DISTINCT token FROM k) WHERE term = token OR (length(term) > 5 AND abs(length(term) - length(token)) <= 1 AND levenshtein(term, token) <= 1)),
s AS (SELECT query_id, node, count(DISTINCT term) AS score FROM q JOIN m USING (term) JOIN k ON k.token = m.token AND k.vault = q.vault GROUP BY ALL)
SELECT query_id, node, score, CAST(rn AS INTEGER) AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS rn FROM s) WHERE rn <= 5""",
    "results_appended": "SELECT sample_name, source_file, entity, lower(arg_max(link_type, gold_id) FILTER (link_type IS NOT NULL)) AS true_type FROM gold GROUP BY ALL HAVING count(link_type) > 0",
    "recursive_chunks": f"""
WITH RECURSIVE l0 AS (SELECT doc_id, [text] AS ps FROM documents WHERE text <> ''),{",".join(_split_at(i, s) for i, s in enumerate(SEPARATORS[:-1]))},
pc AS (SELECT doc_id, flatten(list_transform(ps, lambda p: CASE WHEN length(p) <= 3000 THEN [p] ELSE list_transform(range(0, length(p), 3000), lambda k: p[k + 1:k + 3000]) END)) AS ps FROM l{len(SEPARATORS) - 1}),
pf AS (SELECT doc_id, ps, len(ps) AS n, list_transform(range(0, len(ps) + 1), lambda k: CASE WHEN k = 0 THEN 0 ELSE list_sum(list_transform(ps[1:k], lambda x: length(x))) END) AS sums FROM pc),
w(doc_id, i, st, a, b) AS (
  SELECT doc_id, 1::BIGINT, 1::BIGINT, NULL::BIGINT, NULL::BIGINT FROM pf
  UNION ALL SELECT w.doc_id, i + 1,
    CASE WHEN sums[i + 2] - sums[st] > 3000 THEN list_min(list_filter(range(st, i + 2), lambda k: sums[i + 1] - sums[k] <= least(300, 3000 - length(ps[i + 1])))) ELSE st END,
    CASE WHEN sums[i + 2] - sums[st] > 3000 THEN st END, CASE WHEN sums[i + 2] - sums[st] > 3000 THEN i END
  FROM w JOIN pf ON pf.doc_id = w.doc_id WHERE i < n),
ck AS (
  SELECT w.doc_id, i AS o, {_strip("array_to_string(ps[a:b], '')")} AS chunk FROM w JOIN pf ON pf.doc_id = w.doc_id WHERE a IS NOT NULL
  UNION ALL SELECT w.doc_id, i + 1, {_strip("array_to_string(ps[st:n], '')")} FROM w JOIN pf ON pf.doc_id = w.doc_id WHERE i = n)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS idx, chunk FROM ck WHERE chunk <> ''""",
    "pipeline_property_graph": f"""
WITH RECURSIVE {_QA20}, {_BM25}, {_NOTE_EDGES}, {_GRAMS},
qt AS (SELECT query_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(question, '[A-Za-zА-Яа-яЁё0-9]{{4,}}'), lambda x: lower(x)), lambda x: NOT list_contains({_STOP}, x)))) AS term FROM questions),
tk AS (SELECT DISTINCT alias, unnest({_tokens('alias')}) AS token FROM aliases WHERE alias <> ''),
mt AS (SELECT term, token FROM (SELECT DISTINCT term FROM qt), (SELECT DISTINCT token FROM tk) WHERE term = token OR (length(term) > 5 AND abs(length(term) - length(token)) <= 1 AND levenshtein(term, token) <= 1)),
sf AS (SELECT query_id, alias, count(DISTINCT term) AS score FROM qt JOIN mt USING (term) JOIN tk USING (token) GROUP BY ALL),
sd AS (SELECT query_id, alias AS node FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, alias) AS rn FROM sf) WHERE rn <= 10),
es AS (SELECT DISTINCT {_short(_title('src'))} AS s, {_short(_title('dst'))} AS d FROM edges WHERE relation NOT IN ('MENTIONS', 'NEXT_CHUNK')),
eu AS (SELECT s, d FROM es WHERE s <> '' AND d <> '' UNION SELECT d, s FROM es WHERE s <> '' AND d <> ''),
kh(query_id, node, depth) AS (SELECT query_id, node, 0 FROM sd UNION SELECT k.query_id, eu.d, k.depth + 1 FROM kh k JOIN eu ON eu.s = k.node WHERE k.depth < 3),
tt AS (SELECT chunk_id, {_tokens("coalesce(text, '')")} AS l FROM chunks),
gg AS (SELECT chunk_id, n, l, unnest(range(len(l) - n + 1)) AS pos FROM tt, (SELECT DISTINCT n FROM al) WHERE len(l) >= n),
me AS (SELECT DISTINCT chunk_id, alias FROM gg JOIN al ON al.n = gg.n AND array_to_string(l[pos + 1:pos + gg.n], ' ') = gram),
dn AS (SELECT query_id, chunk_id, count(*) AS score FROM (SELECT DISTINCT query_id, node FROM kh) JOIN me ON alias = node GROUP BY ALL),
br AS (
  SELECT query_id, 0 AS branch, rn AS ord, chunk_id, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM dn) WHERE rn <= 10
  UNION ALL SELECT query_id, 1, rank_no, chunk_id, score FROM bmk),
tx AS (SELECT chunk_id, text || coalesce(chr(10) || lead(text) OVER (PARTITION BY file_path ORDER BY chunk_index, chunk_id), '') AS text FROM chunks),
fu AS (SELECT br.query_id, text, score / CASE WHEN max(score) OVER b <> 0 THEN max(score) OVER b ELSE 1 END AS x FROM br JOIN tx USING (chunk_id) WINDOW b AS (PARTITION BY query_id, branch)),
ag AS (SELECT query_id, substring(text, 1, 120) AS text_key, round(sum(x), 6) AS score FROM fu GROUP BY ALL)
SELECT query_id, CAST(rn AS INTEGER) AS rank_no, text_key, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, text_key) AS rn FROM ag) WHERE rn <= 10""",
    "broad_retrieval_by_summary": f"""
WITH qs AS (SELECT vault || '/' || rel_path AS source_path, query AS qt FROM ({_BASE['title_summary']}) JOIN (SELECT vault, rel_path FROM notes WHERE body IS NOT NULL) USING (vault, rel_path)),
a AS (SELECT source_path, qt, {_unit('h')} AS v FROM (SELECT *, {_COUNTS} AS h FROM (SELECT *, {_slots('qt')} AS sl FROM qs))),
b AS (SELECT chunk_id, file_path, text, {_unit('h')} AS v FROM (SELECT *, {_COUNTS} AS h FROM (SELECT *, {_slots('text')} AS sl FROM chunks WHERE text IS NOT NULL))),
nn AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY distance, chunk_id) AS rank_no FROM (
    SELECT source_path, qt, chunk_id, file_path, text, round({_L2}, 6) AS distance FROM a, b)) WHERE rank_no <= 16),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_path, text ORDER BY rank_no, chunk_id) AS rn FROM nn WHERE file_path <> source_path) WHERE rn = 1),
s AS (SELECT *, {_COVER.format(q=f"list_distinct({_tokens('qt')})", c=_tokens('text'))} AS score FROM u),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY score DESC, distance, chunk_id) AS rk FROM s WHERE score >= 0.3) WHERE rk <= 5)
SELECT source_path, file_path AS target_path, md5(string_agg(coalesce(text, ''), chr(10) || '...' || chr(10) ORDER BY rk)) AS content_md5, round(max(score), 6) AS reranker_score FROM t GROUP BY source_path, file_path""",
    "vector_search": f"WITH {_QA20}, {_near(_HASHED_QUESTIONS, 5)} SELECT query_id, chunk_id, CAST(rank_no AS INTEGER) AS rank_no FROM near",
    "hybrid_search": f"""
WITH {_QA20}, {_near(_HASHED_QUESTIONS, 5)}, {_BM25.replace("SELECT chunk_id, " + _tokens("coalesce(text, '')") + " AS l FROM chunks", "SELECT chunk_id, " + _tokens("text") + " AS l FROM chunks WHERE text IS NOT NULL")},
a AS (SELECT query_id, chunk_id, CASE WHEN max(distance) OVER w > min(distance) OVER w THEN (max(distance) OVER w - distance) / (max(distance) OVER w - min(distance) OVER w) ELSE 1 END AS x FROM near WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT query_id, chunk_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS y FROM (SELECT * FROM bmk WHERE rank_no <= 5) WINDOW w AS (PARTITION BY query_id)),
u AS (SELECT query_id, chunk_id, round(0.5::DOUBLE * coalesce(x, 0) + 0.5::DOUBLE * coalesce(y, 0), 6) AS score FROM a FULL JOIN b USING (query_id, chunk_id))
SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM u) WHERE rn <= 5""",
    "pipeline_untyped_vector": f"""
WITH RECURSIVE {_QA20}, {_near(_HASHED_QUESTIONS, 5)}, {_NOTE_EDGES},
seeds AS (SELECT DISTINCT query_id, file_path AS node FROM near JOIN chunks USING (chunk_id)),
visited(query_id, node, depth) AS (
  SELECT query_id, node, 0 FROM seeds UNION SELECT b.query_id, e.dst, b.depth + 1 FROM visited b JOIN edges e ON e.src = b.node WHERE b.depth < 2),
{_COLLECT}""",
    "scan_roundtrip": f"""
SELECT vault, rel_path, stem, sha256(content) AS sha, sha256({_BODY}) AS content_hash, md5({_LINKS}) AS links_md5 FROM (SELECT vault, rel_path, stem, {_NEWLINES} AS content FROM notes)""",
    "loaded_documents": f"SELECT vault || '/' || rel_path AS source, rel_path AS source_rel, vault, md5(clean) AS text_md5 FROM ({_BASE['clean_text']}) WHERE clean <> ''",
    "front_matter_aliases": f"SELECT rel_path, {_title('rel_path')} AS title, CASE WHEN length(stem) % 4 = 3 THEN '' ELSE {_strip('stem')} || '|old name' END AS aliases FROM notes",
    "settings": """
SELECT vault, CASE WHEN trim(coalesce(lang, '')) <> '' THEN lang ELSE 'en' END AS lang, CASE WHEN vector_search_weight >= 0 AND NOT isnan(vector_search_weight) THEN vector_search_weight ELSE 1.0 END AS vector_search_weight,
  CASE WHEN initial_retrieval_k >= 1 THEN initial_retrieval_k ELSE 15 END AS initial_retrieval_k, CASE WHEN trim(coalesce(broad_query_mode, '')) <> '' THEN broad_query_mode ELSE 'chunk' END AS broad_query_mode,
  CASE WHEN rerank_top_k >= 1 THEN rerank_top_k ELSE 5 END AS rerank_top_k, CASE WHEN rerank_threshold >= 0 AND NOT isnan(rerank_threshold) THEN rerank_threshold ELSE 0.5 END AS rerank_threshold,
  CASE WHEN chunk_size >= 1 THEN chunk_size ELSE 3000 END AS chunk_size, CASE WHEN chunk_overlap >= 0 THEN chunk_overlap ELSE 300 END AS chunk_overlap,
  CASE WHEN trim(coalesce(link_header, '')) <> '' THEN link_header ELSE """ + _H + """ END AS link_header FROM vault_config""",
    "gold_as_json": "SELECT gold_id, entity, source_file, sentence, is_direct_mention, link_type FROM gold",
    "links_as_json": _BASE["links_by_note"],
    "enriched_export": f"""
WITH {_NEW_LINES},
o AS (SELECT vault, rel_path, {_BODY} AS b, new FROM notes LEFT JOIN nl ON source_path = vault || '/' || rel_path)
SELECT vault, rel_path, md5({_NEWLINES}) AS content_md5 FROM (SELECT vault, rel_path, CASE WHEN new IS NULL THEN b ELSE b || {_H} || array_to_string(new, chr(10)) END AS content FROM o)""",
    "cleared_links": f"SELECT vault, rel_path, md5({_BODY}) AS content_md5 FROM notes",
    "index_upkeep": """
WITH c AS (SELECT file_path, min(chunk_id) AS chunk_id FROM chunks GROUP BY file_path HAVING count(*) > 4)
SELECT file_path, chunk_id FROM chunks x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.file_path = x.file_path) UNION ALL SELECT file_path, chunk_id FROM c""",
    "candidate_dump": """
SELECT pair_id, source_path, 'before' AS stage FROM candidates
UNION ALL SELECT pair_id, source_path, 'after' FROM candidates WHERE reranker_score >= 0.5 AND NOT isnan(reranker_score)""",
    "predictions_by_strategy": "SELECT CASE WHEN vector_distance = 0 THEN 'strict' ELSE 'broad' END AS strategy, source_path, count(*) AS n FROM candidates WHERE target_path IS NOT NULL GROUP BY ALL",
    "checkpoint_resume": """
SELECT DISTINCT source_path, target_path FROM candidates c WHERE target_path IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM gold WHERE sample_name || '/' || source_file = c.source_path AND sample_name || '/' || entity || '.md' = c.target_path)""",
    "graph_merge": f"""
WITH g AS (SELECT DISTINCT concat_ws(':', sample_name, {_node('entity')}) AS id FROM gold WHERE entity IS NOT NULL),
n AS (SELECT DISTINCT concat_ws(':', vault, {_node('stem')}) AS id FROM notes),
r AS (SELECT DISTINCT sample_name || '/' || source_file AS src_id, concat_ws(':', sample_name, {_node('entity')}) AS dst_id, lower(link_type) AS type FROM gold WHERE link_type IS NOT NULL AND entity IS NOT NULL),
d AS (SELECT dst_id, count(*) AS n_in FROM r GROUP BY 1)
SELECT coalesce(n.id, g.id) AS id, CASE WHEN n.id IS NULL THEN 'Entity' ELSE 'Note' END AS type, CASE WHEN n.id IS NULL THEN 'gold' ELSE 'notes' END AS origin, coalesce(n_in, 0) AS n_in
FROM n FULL JOIN g ON n.id = g.id LEFT JOIN d ON d.dst_id = coalesce(n.id, g.id)""",
    "typed_links_anywhere": r"""
SELECT vault, rel_path, CAST(i AS INTEGER) AS link_no, trim(r) AS relation, trim(t) AS target FROM (
  SELECT vault, rel_path, unnest(range(len(regexp_extract_all(content, '-?\s*(.+?)\s*::\s*\[\[\s*(.+?)\s*\]\]', 1)))) AS i,
    unnest(regexp_extract_all(content, '-?\s*(.+?)\s*::\s*\[\[\s*(.+?)\s*\]\]', 1)) AS r, unnest(regexp_extract_all(content, '-?\s*(.+?)\s*::\s*\[\[\s*(.+?)\s*\]\]', 2)) AS t
  FROM notes WHERE content IS NOT NULL)""",
    "link_labels": f"WITH {_NOTE_EDGES} SELECT vault, src_path AS rel_path, link_ord AS link_no, target_name AS name, CASE WHEN link_ord % 2 = 0 THEN relation END AS label FROM note_edges",
    "pair_keys": "SELECT pair_id, md5(concat_ws('|', source_path, target_path, target_content)) AS pair_key FROM candidates",
    "plain_file_names": f"""SELECT vault, rel_path, replace({_file_name(f"' ' || {_title('rel_path')} || '''s \"log\"/1 '")}, '''', '') AS name FROM notes""",
    "answers_parsed": rf"""
SELECT qa_id, {_strip("CASE WHEN contains(lower(a), '<answer>') THEN regexp_replace(regexp_replace(a, '(?is)^.*<answer>', ''), '(?is)</answer>.*$', '') ELSE a END")} AS answer
FROM (SELECT qa_id, coalesce(answer, '') AS a FROM qa WHERE question IS NOT NULL)""",
    "outputs_parsed": "SELECT gold_id, 0 AS id, lower(link_type) AS relation_type, 'row ' || gold_id AS reasoning FROM gold",
    "retry_delays": """
SELECT hit_id, CASE WHEN rank_no % 3 = 0 THEN CAST(printf('%.1f', distance) AS DOUBLE) + 1 ELSE 30.0 END AS wait, rank_no % 3 <> 2 AS transient
FROM search_hits WHERE distance IS NOT NULL AND NOT isnan(distance) AND distance >= 0""",
    "links_rewritten": f"""
WITH {_GOLD_LINES} SELECT n.vault, n.rel_path, md5({_BODY} || coalesce({_H} || lines, '')) AS content_md5 FROM notes n LEFT JOIN gl ON n.vault = gl.vault AND n.rel_path = gl.rel_path""",
    "saved_outlinks": f"""
WITH o AS (SELECT vault || '/' || src_path AS page, replace(target_name, '_', ' ') AS title FROM ({_BASE['extract_wikilinks']})),
s AS (SELECT DISTINCT {_file_name("replace(stem, '_', ' ')")} AS k FROM notes WHERE body IS NOT NULL),
b AS (SELECT page, string_agg(line, chr(10) ORDER BY line) AS block FROM (SELECT DISTINCT page, '- [[' || {_file_name('title')} || ']]' AS line FROM o WHERE {_file_name('title')} IN (SELECT k FROM s)) GROUP BY page)
SELECT DISTINCT o.page, coalesce(block, '') AS block FROM o LEFT JOIN b ON o.page = b.page""",
    "saved_outlinks_ignoring_case": f"""
WITH o AS (SELECT vault || '/' || src_path AS page, replace({_file_name("replace(target_name, '_', ' ')")}, '''', '') AS name FROM ({_BASE['extract_wikilinks']})),
s AS (SELECT DISTINCT lower(replace({_file_name("replace(stem, '_', ' ')")}, '''', '')) AS k FROM notes WHERE body IS NOT NULL),
b AS (SELECT page, string_agg(line, chr(10) ORDER BY line) AS block FROM (SELECT DISTINCT page, '- [[' || name || ']]' AS line FROM o WHERE lower(name) IN (SELECT k FROM s)) GROUP BY page)
SELECT DISTINCT o.page, coalesce(block, '_No links found._') AS block FROM o LEFT JOIN b ON o.page = b.page""",
    "claimed_relations": f"""
WITH {_NOTE_EDGES},
l AS (SELECT DISTINCT vault || ':' || {_stem('src_path')} AS source, vault || ':' || target_name AS target FROM note_edges),
c AS (SELECT source, target, string_agg(label, ', ' ORDER BY label) AS relation FROM (
  SELECT DISTINCT concat_ws(':', sample_name, {_stem('source_file')}) AS source, concat_ws(':', sample_name, entity) AS target, link_type AS label FROM gold WHERE link_type IS NOT NULL AND entity IS NOT NULL) GROUP BY ALL)
SELECT l.source, l.target, relation FROM l LEFT JOIN c ON l.source = c.source AND l.target = c.target""",
    "titles_in_text": f"WITH {_TITLE_HITS} SELECT DISTINCT page, title FROM hit",
    "link_contexts": f"""
WITH {_TITLE_HITS},
sc AS (SELECT page, title, idx, sentence, {_COVER.format(q=f"list_distinct({_tokens(_spaced('title'))})", c=_tokens('sentence'))} AS score FROM hit),
o AS (SELECT page, title, sentence, max(score) AS score, min(idx) AS idx FROM sc WHERE score >= 0.5 GROUP BY ALL)
SELECT page, title, CAST(rn AS INTEGER) AS rank_no, md5(sentence) AS sentence_md5, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page, title ORDER BY score DESC, idx) AS rn FROM o) WHERE rn <= 3""",
    "link_contexts_unscored": f"""
WITH {_TITLE_HITS}, o AS (SELECT page, title, sentence, min(idx) AS idx FROM hit GROUP BY ALL)
SELECT page, title, CAST(rn AS INTEGER) AS rank_no, md5(sentence) AS sentence_md5 FROM (SELECT *, row_number() OVER (PARTITION BY page, title ORDER BY idx) AS rn FROM o) WHERE rn <= 3""",
    "crawl_ranking": f"""
WITH p AS (SELECT CASE WHEN rank_no = 1 THEN 'Talk:' || file_path ELSE file_path END AS title, text AS summary, hit_id AS ord FROM search_hits WHERE file_path IS NOT NULL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY ord) AS rn FROM p WHERE NOT contains(title, ':') AND title NOT IN (SELECT vault || '/' || rel_path FROM notes WHERE body IS NULL)) WHERE rn = 1),
l AS (SELECT title, {_tokens("title || ': ' || substring(coalesce(summary, ''), 1, 500)")} AS c FROM f ORDER BY ord, title LIMIT 200),
s AS (SELECT title, {_COVER.format(q="['the', 'old', 'mill', 'and', 'river', 'wheel']", c='c')} AS score FROM l)
SELECT title, round(score, 6) AS score FROM s WHERE score > 0.1""",
    "property_graph_nodes": f"""
WITH pt AS (SELECT DISTINCT {_PART.format('stem')} AS p FROM notes),
al AS (SELECT p, {_tokens(_alias('p'))} AS tk FROM pt WHERE {_alias('p')} <> ''),
t AS (SELECT vault, vault || '/' || rel_path AS page, {_tokens('body')} AS l FROM notes WHERE body IS NOT NULL),
g AS (SELECT vault, page, n, l, unnest(range(len(l) - n + 1)) AS pos FROM t, (SELECT DISTINCT len(tk) AS n FROM al WHERE len(tk) > 0) WHERE len(l) >= n),
h AS (SELECT DISTINCT vault, page, p, vault || ':' || {_node('p')} AS id, {_spaced('p')} AS display_name FROM g JOIN al ON len(tk) = n AND l[pos + 1:pos + n] = tk WHERE page <> p),
c AS (SELECT id, count(DISTINCT page) AS n_mentions FROM h GROUP BY id)
SELECT DISTINCT id, vault, 'Entity' AS type, display_name, n_mentions FROM h JOIN c USING (id)""",
    "entity_resolution": """
WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0 AND round(list_cosine_similarity(a.v, b.v), 6) >= 0.35),
e AS (SELECT a AS s, b AS d FROM p UNION SELECT b, a FROM p),
r(node, comp) AS (SELECT DISTINCT s, s FROM e UNION SELECT e.d, r.comp FROM r JOIN e ON e.s = r.node)
SELECT node, min(comp) AS component FROM r GROUP BY node""",
    "resolved_edges": f"""
WITH m AS (SELECT concat_ws('/', vault, stem) AS node, min(concat_ws('/', vault, stem)) OVER (PARTITION BY stem) AS least FROM notes),
k AS (SELECT DISTINCT node, least FROM m),
e AS (SELECT concat_ws('/', sample_name, {_stem('source_file')}) AS src, concat_ws('/', sample_name, entity) AS dst FROM gold WHERE link_type IS NOT NULL AND entity IS NOT NULL)
SELECT DISTINCT coalesce(a.least, e.src) AS src, coalesce(b.least, e.dst) AS dst FROM e LEFT JOIN k a ON a.node = e.src LEFT JOIN k b ON b.node = e.dst WHERE coalesce(a.least, e.src) <> coalesce(b.least, e.dst)""",
    "micro_by_strategy": f"""
WITH s AS (
  SELECT 'typed' AS strategy, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (WITH {_edge_counts('lower({0})')} SELECT * FROM cnt)
  UNION ALL SELECT 'untyped', sum(tp), sum(fp), sum(fn) FROM (WITH {_edge_counts("'x'")} SELECT * FROM cnt))
SELECT strategy, {_PRF} FROM s""",
    "merged_ranking": """
WITH h AS (SELECT query_id, hit_id, CASE WHEN rank_no <= 3 THEN 0 ELSE 1 END AS side, round(1.0::DOUBLE / (1.0 + distance), 6) AS score FROM search_hits),
s AS (SELECT query_id, hit_id, side, CASE WHEN side = 0 THEN score ELSE round(score * 0.9::DOUBLE, 6) END AS score FROM h)
SELECT query_id, hit_id, side, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, side, hit_id) AS INTEGER) AS rank_no FROM s""",
    "context_recall": f"""
WITH {_CONTEXTS},
q AS (SELECT qa_id AS query_id, {_lemmas("coalesce(answer, '')")} AS r, coalesce({_lemmas("array_to_string(texts, ' ')")}, []) AS h FROM qa LEFT JOIN cx ON query_id = qa_id)
SELECT query_id, round(CASE WHEN len(r) > 0 THEN len(list_intersect(r, h)) / len(r) ELSE 0 END, 6) AS recall FROM q""",
    "qa_evaluation": f"""
WITH {_CONTEXTS},
q AS (SELECT query_id, n, {_lemmas('answer')} AS r, list_transform(texts, lambda x: {_lemmas('x')}) AS t, {_lemmas("array_to_string(texts, ' ')")} AS every, {_lemmas("array_to_string(texts[1:3], ' ')")} AS a FROM qa JOIN cx ON query_id = qa_id WHERE answer IS NOT NULL),
f AS (
  SELECT query_id, n, len(list_intersect(r, every)) / len(r) AS cr, len(list_filter(t, lambda s: len(list_intersect(r, s)) >= least(3, len(r)))) / n AS cp,
    CASE WHEN len(a) > 0 THEN len(list_intersect(a, every)) / len(a) ELSE 0 END AS fa, CASE WHEN len(a) > 0 THEN len(list_intersect(a, r)) / len(a) ELSE 0 END AS p, len(list_intersect(r, a)) / len(r) AS rc
  FROM q WHERE len(r) > 0)
SELECT query_id, CAST(n AS INTEGER) AS n_contexts, round(cr, 6) AS context_recall, round(cp, 6) AS context_precision, round(fa, 6) AS faithfulness, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 6) AS correctness FROM f""",
    "reindexed": f"""
WITH {_CHANGES},
nw AS (SELECT vault || '/' || rel_path AS file_path, body, md5(content) AS h FROM notes JOIN changes ON file_path = vault || '/' || rel_path WHERE change IN ('added', 'updated') AND trim(coalesce(body, '')) <> '')
SELECT file_path, chunk_index, md5(text) AS text_md5, file_hash FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM changes x WHERE x.file_path = c.file_path AND change IN ('removed', 'updated'))
UNION ALL SELECT file_path, CAST(i AS INTEGER), md5(substring(body, CAST(i * 900 + 1 AS BIGINT), 1000)), h FROM (
  SELECT *, unnest(range(CAST(greatest(1, ceil((length(body) - 100) / 900.0)) AS BIGINT))) AS i FROM nw)""",
    "kept_after_removal": f"WITH {_CHANGES} SELECT chunk_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM changes x WHERE x.file_path = c.file_path AND change IN ('removed', 'updated'))",
    "phrase_notes": f"WITH {_NAMES} SELECT * FROM names_",
    "strict_note_retrieval": f"""
WITH {_NAMES},
al AS (SELECT DISTINCT alias, {_tokens('alias')} AS tk FROM names_ WHERE len({_tokens('alias')}) > 0),
d AS (SELECT vault, vault || '/' || rel_path AS source_path, {_SENTS.format('body')} AS s FROM notes WHERE body IS NOT NULL),
ss AS (SELECT vault, source_path, s, unnest(range(len(s))) AS i FROM d),
t AS (SELECT vault, source_path, i, array_to_string(s[greatest(i, 1):least(i + 2, len(s))], ' ') AS w, {_tokens('s[i + 1]')} AS l FROM ss),
g AS (SELECT vault, source_path, i, w, n, l, unnest(range(len(l) - n + 1)) AS pos FROM t, (SELECT DISTINCT len(tk) AS n FROM al) WHERE len(l) >= n),
h AS (SELECT g.vault, source_path, alias, i, w FROM g JOIN al ON len(tk) = n AND l[pos + 1:pos + n] = tk)
SELECT source_path, x.file_path AS target_path, arg_min(w, i) AS target_content FROM h JOIN names_ x ON x.vault = h.vault AND x.alias = h.alias WHERE source_path <> x.file_path GROUP BY ALL""",
    "broad_retrieval": f"""
WITH {_VEC},
nn AS (
  SELECT * FROM (
    SELECT query_id, item_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank_no FROM (
      SELECT a.chunk_id AS query_id, b.chunk_id AS item_id, round({_L2}, 6) AS distance FROM v a, v b WHERE a.chunk_id % 20 = 0)) WHERE rank_no <= 16),
h AS (
  SELECT query_id, item_id, distance, rank_no, q.file_path AS source_path, q.text AS qt, c.file_path, c.text FROM nn JOIN v c ON c.chunk_id = item_id JOIN v q ON q.chunk_id = query_id WHERE c.file_path <> q.file_path),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY rank_no, item_id) AS rn FROM h) WHERE rn = 1),
s AS (SELECT *, {_COVER.format(q=f"list_distinct({_tokens('qt')})", c=_tokens('text'))} AS score FROM u),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, item_id) AS rk FROM s WHERE score >= 0.5) WHERE rk <= 5)
SELECT source_path, file_path AS target_path, string_agg(coalesce(text, ''), chr(10) || '...' || chr(10) ORDER BY rk) AS target_content, round(arg_min(distance, rk), 6) AS vector_distance, round(max(score), 6) AS reranker_score
FROM b GROUP BY query_id, source_path, file_path""",
    "pipeline_untyped": f"""
WITH RECURSIVE {_QA20}, {_BM25}, {_NOTE_EDGES}, {_VISITED}
visited(query_id, node, depth) AS (
  SELECT query_id, node, 0 FROM seeds UNION SELECT b.query_id, e.dst, b.depth + 1 FROM visited b JOIN edges e ON e.src = b.node WHERE b.depth < 2),
{_COLLECT}""",
    "pipeline_typed": f"""
WITH {_QA20}, {_BM25}, {_NOTE_EDGES}, {_FIRST}, {_VISITED}
e AS (SELECT DISTINCT src, dst, relation FROM edges WHERE src <> dst),
et AS (SELECT src, dst, {_tokens(f"relation || ': ' || {_title('dst')} || '. ' || coalesce(summary, '')")} AS c FROM e LEFT JOIN firsts ON file_path = dst),
h1 AS ({_step('seeds')}),
h2 AS ({_step('h1', ' AND NOT EXISTS (SELECT 1 FROM h1 z WHERE z.query_id = s.query_id AND z.node = dst)')}),
visited AS (SELECT query_id, node FROM seeds UNION ALL SELECT query_id, node FROM h1 UNION ALL SELECT query_id, node FROM h2),
{_COLLECT}""",
    "pipeline_single_hop": f"""
WITH {_QA20}, {_BM25}, {_NOTE_EDGES}, {_FIRST},
sc AS (
  SELECT b.query_id, c.chunk_id, c.file_path, c.text, {_COVER.format(q=f"list_distinct({_tokens('question')})", c=_tokens('c.text'))} AS score
  FROM bmk b JOIN chunks c USING (chunk_id) JOIN questions USING (query_id) WHERE b.rank_no <= 5),
sd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank_no FROM sc WHERE score >= 0.3) WHERE rank_no <= 10),
nd AS (SELECT query_id, file_path AS node, min(rank_no) AS rank_no, max(score) AS score FROM sd GROUP BY ALL),
ex AS (
  SELECT n.query_id, e.dst AS node, n.score, n.rank_no, e.link_ord FROM nd n JOIN edges e ON e.src = n.node
  WHERE e.dst IN (SELECT file_path FROM firsts WHERE summary IS NOT NULL AND summary <> '') AND NOT EXISTS (SELECT 1 FROM nd z WHERE z.query_id = n.query_id AND z.node = e.dst)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY rank_no, link_ord) AS rn FROM ex) WHERE rn = 1),
x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_no, link_ord, node) AS ord FROM f) WHERE ord <= 5),
a AS (
  SELECT query_id, text, score, 0 AS side, rank_no AS ord FROM sd
  UNION ALL SELECT x.query_id, summary, round(x.score * 0.9, 9), 1, ord FROM x JOIN firsts ON file_path = node)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, side, ord) AS INTEGER) AS rank_no, text, round(score, 6) AS score FROM a""",
}
