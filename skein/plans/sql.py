"""SQL (DuckDB dialect) of the registered queries, over the same tables."""

from __future__ import annotations

from skein.functions.text import LINK_HEADER, NO_CONTEXT, QUERY_STOPWORDS, STOP_SECTIONS

_H = "'" + LINK_HEADER.replace("\n", "' || chr(10) || '") + "'"
_STOP = "[" + ", ".join(f"'{w}'" for w in QUERY_STOPWORDS) + "]"
_WS = r"[\s\p{Z}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _rstrip(x: str) -> str:
    return rf"regexp_replace({x}, '{_WS}+$', '')"


def _tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def _stem_of(x: str) -> str:
    return rf"regexp_replace(list_last(string_split({x}, '/')), '\.[^.]*$', '')"


def _title(x: str) -> str:
    return f"trim(replace({_stem_of(x)}, '_', ' '))"


_BODY = f"CASE WHEN contains(content, {_H}) THEN {_rstrip(f'split_part(content, {_H}, 1)')} ELSE content END"
_LINKS = f"CASE WHEN contains(content, {_H}) THEN {_strip(f'list_last(string_split(content, {_H}))')} ELSE '' END"
_SPACED = rf"{_strip(rf'''regexp_replace(replace(stem, '_', ' '), '{_WS}+', ' ', 'g')''')}"
_SENTS = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_LATEST = """
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path, chunk_index ORDER BY indexed_at DESC NULLS LAST, chunk_id DESC) AS rn_ FROM chunks) WHERE rn_ = 1)"""
_NOTE_EDGES = r"""
note_edges AS (
  SELECT vault, src_path, trim(r) AS relation, trim(tg) AS target_name, CAST(link_ord AS INTEGER) AS link_ord FROM (
    SELECT vault, rel_path AS src_path,
      unnest(regexp_extract_all(links_section, '(?m)^\s*(?:[-*+]\s+)?([^\n]*?)\s*::\s*\[\[([^\n]*?)\]\]', 1)) AS r,
      unnest(regexp_extract_all(links_section, '(?m)^\s*(?:[-*+]\s+)?([^\n]*?)\s*::\s*\[\[([^\n]*?)\]\]', 2)) AS tg,
      unnest(range(len(regexp_extract_all(links_section, '(?m)^\s*(?:[-*+]\s+)?([^\n]*?)\s*::\s*\[\[([^\n]*?)\]\]', 1)))) AS link_ord
    FROM notes WHERE links_section IS NOT NULL)),
names AS (SELECT vault, stem AS target_name, min(rel_path) AS dst_path FROM notes GROUP BY ALL),
edges AS (
  SELECT e.vault || '/' || src_path AS src, e.vault || '/' || dst_path AS dst, relation, link_ord
  FROM note_edges e JOIN names n ON e.vault = n.vault AND e.target_name = n.target_name)"""
_SEEDS = """
seeds AS (
  SELECT query_id, q.vault || '/' || dst_path AS node, CAST(min(i) + 1 AS INTEGER) AS rank_no, 1.0::DOUBLE / (min(i) + 1) AS score
  FROM (SELECT qa_id AS query_id, vault, unnest(relevant_docs) AS stem, unnest(range(len(relevant_docs))) AS i FROM qa WHERE relevant_docs IS NOT NULL) q
  JOIN names n ON q.vault = n.vault AND q.stem = n.target_name GROUP BY 1, 2)"""
_PRED = "SELECT sample_name || '/' || source_file AS source_path, entity || '.md' AS target_path, link_type AS relation_type FROM gold"
_LINE = f"'- ' || relation_type || ':: [[' || {_stem_of('target_path')} || ']]'"
_ALIAS = r"aliases AS (SELECT DISTINCT " + f"""lower({_strip(r"translate(regexp_extract(stem, '^[^_]+_[^_]+_(.+)$', 1), '_\-', '   ')")})""" + " AS alias FROM notes)"
_GRAMS = rf"""
{_ALIAS},
al AS (SELECT alias, array_to_string({_tokens('alias')}, ' ') AS gram, len({_tokens('alias')}) AS n FROM aliases WHERE alias <> '' AND len({_tokens('alias')}) > 0)"""
_BM25 = f"""
q AS (SELECT query_id, unnest(list_distinct({_tokens('coalesce(question, chr(0))')})) AS token FROM questions),
dt AS (SELECT chunk_id, {_tokens("coalesce(text, '')")} AS l FROM chunks),
post AS (SELECT chunk_id, token, dl, count(*) AS tf FROM (SELECT chunk_id, len(l) AS dl, unnest(l) AS token FROM dt) GROUP BY ALL),
st AS (SELECT count(*) AS nd, avg(len(l)) AS al FROM dt),
dfs AS (SELECT token, count(*) AS df FROM post WHERE token IN (SELECT token FROM q) GROUP BY token),
bm AS (
  SELECT q.query_id, p.chunk_id,
         round(sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))), 6) AS score
  FROM q JOIN post p USING (token) JOIN dfs USING (token), st GROUP BY ALL),
bmk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank_no FROM bm) WHERE rank_no <= 10)"""
_QA20 = "questions AS (SELECT qa_id AS query_id, question FROM qa WHERE qa_id % 20 = 0)"
_VEC = """
v AS (
  SELECT chunk_id, file_path, text, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS v FROM chunks
  WHERE vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e30)) = 64)"""


def _knn(distance: str) -> str:
    return f"""{_VEC},
nn AS (
  SELECT * FROM (
    SELECT query_id, item_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank_no FROM (
      SELECT a.chunk_id AS query_id, b.chunk_id AS item_id, round({distance}, 6) AS distance
      FROM v a, v b WHERE a.chunk_id % 20 = 0 AND a.file_path IS DISTINCT FROM b.file_path)
    WHERE distance IS NOT NULL AND NOT isnan(distance)) WHERE rank_no <= 10)"""


_L2 = "greatest(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 0)"
_COS = "CASE WHEN list_dot_product(a.v, a.v) > 0 AND list_dot_product(b.v, b.v) > 0 THEN 1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) END"
_PRF = """
  CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2.0 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END, 6) AS f1"""


def _edge_counts(relation: str) -> str:
    g = f"SELECT DISTINCT sample_name AS vault, source_file AS rel_path, entity AS target_name, {relation.format('link_type')} AS rel FROM gold WHERE link_type IS NOT NULL"
    p = f"SELECT DISTINCT vault, src_path AS rel_path, target_name, {relation.format('relation')} AS rel FROM note_edges"
    return f"""{_NOTE_EDGES},
ge AS ({g}), pe AS ({p}),
cnt AS (
  SELECT coalesce(ge.vault, pe.vault) AS vault, count(*) FILTER (ge.vault IS NOT NULL AND pe.vault IS NOT NULL) AS tp,
         count(*) FILTER (ge.vault IS NULL) AS fp, count(*) FILTER (pe.vault IS NULL) AS fn
  FROM ge FULL JOIN pe ON ge.vault = pe.vault AND ge.rel_path = pe.rel_path AND ge.target_name = pe.target_name AND ge.rel = pe.rel
  GROUP BY 1)"""


_CLASSES = f"""{_NOTE_EDGES},
gg AS (
  SELECT sample_name, source_file, entity, lower(arg_max(link_type, gold_id) FILTER (link_type IS NOT NULL)) AS true_type
  FROM gold GROUP BY ALL HAVING count(link_type) > 0),
pt AS (SELECT vault, src_path, target_name, min(lower(relation)) AS predicted_type FROM note_edges GROUP BY ALL),
tp_ AS (
  SELECT true_type, coalesce(predicted_type, 'no link') AS predicted_type FROM gg
  LEFT JOIN pt ON gg.sample_name = pt.vault AND gg.source_file = pt.src_path AND gg.entity = pt.target_name),
cls AS (SELECT true_type AS cls FROM tp_ UNION SELECT predicted_type FROM tp_),
cc AS (
  SELECT cls, count(*) FILTER (true_type = cls AND predicted_type = cls) AS tp, count(*) FILTER (true_type <> cls AND predicted_type = cls) AS fp,
         count(*) FILTER (true_type = cls AND predicted_type <> cls) AS fn, count(*) FILTER (true_type = cls) AS support
  FROM cls, tp_ GROUP BY cls),
cp AS (SELECT cls, support, {_PRF} FROM cc)"""
_COVER = "CASE WHEN len({q}) > 0 THEN len(list_intersect({q}, {c})) / len({q}) ELSE 0 END"
_GROUPED = """
gp AS (
  SELECT *, row_number() OVER (PARTITION BY source_path, target_path ORDER BY CASE WHEN NOT isnan(reranker_score) THEN reranker_score END DESC NULLS LAST, pair_id) AS rn FROM candidates)"""
_FIRST = """
firsts AS (
  SELECT file_path, text AS summary, text_lemmatized AS summary_lemmas FROM (
    SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY chunk_index, chunk_id) AS rn FROM chunks) WHERE rn = 1)"""
_STOPHEADS = "|".join(s.replace(".", r"\.") for s in STOP_SECTIONS)

ORACLE_SQL: dict[str, str] = {
    "note_split": f"SELECT vault, rel_path, md5({_BODY}) AS body_md5, md5({_LINKS}) AS links_md5, md5(split_part(content, {_H}, 1)) AS cut_md5 FROM notes",
    "content_hash": r"SELECT vault, rel_path, sha256(regexp_replace(content, '\r\n?', chr(10), 'g')) AS sha FROM notes",
    "clean_text": rf"""
SELECT vault, rel_path, {_strip("regexp_replace(c, chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS clean FROM (
  SELECT vault, rel_path, regexp_replace(regexp_replace(regexp_replace(content, '(?s)\A---\n.*?\n---\n?', ''),
    '(?ims)^\s*## Related Connections\s*$.*\z', ''), '(?m)^\s*(?:[-*+]\s+)?[^\n:]{{1,120}}::\s*\[\[[^\]]+\]\]\s*$', '', 'g') AS c FROM notes)""",
    "normalize_names": rf"""
SELECT vault, rel_path,
  array_to_string(list_transform(regexp_extract_all(lower({_SPACED}), '\p{{L}}+|\P{{L}}+'), lambda p: upper(p[1:1]) || p[2:]), '') AS node,
  array_to_string(list_transform(list_filter(regexp_split_to_array(stem, '[_\-\s]+'), lambda p: p <> ''), lambda p: upper(p[1:1]) || lower(p[2:])), '') AS label,
  replace(lower({_SPACED}), 'ß', 'ss') AS entity,
  replace(replace(replace({_strip(_title('rel_path'))}, ' ', '_'), '/', '-'), '"', '') AS file_name,
  lower({_strip(r"translate(stem, '_\-', '   ')")}) AS alias
FROM notes""",
    "strip_sections": rf"""
SELECT doc_id, {_strip(rf"regexp_replace(c, '(?ims)^(?:#{{1,6}}\s+|={{1,6}}\s*)?(?:{_STOPHEADS})(?:\s*[:\-])?\s*$.*\z', '')")} AS clean FROM (
  SELECT doc_id, {_strip(r"regexp_replace(regexp_replace(text, '\[\d+\]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS c FROM documents)""",
    "title_summary": f"""
SELECT vault, rel_path, CASE WHEN b = '' THEN t WHEN starts_with(b, '#') THEN b WHEN t = '' THEN b ELSE t || chr(10) || b END AS query FROM (
  SELECT vault, rel_path, {_title('rel_path')} AS t, {_strip(f"split_part({_strip("coalesce(body, '')")}, chr(10) || chr(10), 1)")} AS b FROM notes)""",
    "query_strings": f"""
SELECT qa_id, array_to_string(list_transform(list_filter(raw, lambda t, i: NOT list_contains({_STOP}, lower(t)) AND list_position(low, lower(t)) = i),
  lambda t: CASE WHEN length(t) > 5 THEN t || ' OR ' || t || '~1' ELSE t END), ' OR ') AS q
FROM (SELECT qa_id, raw, list_transform(raw, lambda x: lower(x)) AS low FROM (SELECT qa_id, regexp_extract_all(question, '[A-Za-zА-Яа-яЁё0-9]{{4,}}') AS raw FROM qa))""",
    "lemma_texts": f"SELECT chunk_id, array_to_string({_tokens('text')}, ' ') AS lemmas FROM chunks",
    "prompt_items": f"""
WITH {_GROUPED}
SELECT source_path, target_path, 'Item 1' || chr(10) || 'Source: ' || source_path || chr(10) || 'Target: ' || coalesce(target_path, '') || chr(10)
  || string_agg('  [' || rn || '] ' || coalesce(target_content, ''), chr(10) ORDER BY rn) AS item FROM gp WHERE rn <= 5 GROUP BY source_path, target_path""",
    "line_chunks": f"""
SELECT doc_id, CAST(idx AS INTEGER) AS idx, sentence FROM (
  SELECT doc_id, unnest(range(len(l))) AS idx, unnest(l) AS sentence FROM (SELECT doc_id, {_SENTS.format('text')} AS l FROM documents))""",
    "sentence_window": f"""
SELECT doc_id, CAST(i AS INTEGER) AS idx, array_to_string(l[greatest(i, 1):least(i + 2, len(l))], ' ') AS "window" FROM (
  SELECT doc_id, l, unnest(range(len(l))) AS i FROM (SELECT doc_id, {_SENTS.format('text')} AS l FROM documents))""",
    "fixed_chunks": """
SELECT doc_id, CAST(i AS INTEGER) AS idx, substring(text, CAST(i * 900 + 1 AS BIGINT), 1000) AS chunk FROM (
  SELECT doc_id, text, unnest(range(CAST(greatest(1, ceil((length(text) - 100) / 900.0)) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)""",
    "latest_chunks": f"WITH {_LATEST} SELECT file_path, chunk_index, chunk_id FROM latest",
    "first_chunk_summary": f"WITH {_FIRST} SELECT * FROM firsts",
    "next_chunk": f"WITH {_LATEST} SELECT chunk_id, text || coalesce(chr(10) || lead(text) OVER (PARTITION BY file_path ORDER BY chunk_index), '') AS text_next FROM latest",
    "prev_chunk": f"""
WITH {_LATEST} SELECT file_path || '::' || chunk_index AS chunk_key,
  file_path || '::' || lag(chunk_index) OVER (PARTITION BY file_path ORDER BY chunk_index) AS previous_key FROM latest""",
    "next_chunk_edges": f"""
WITH {_LATEST} SELECT DISTINCT p AS src_key, k AS dst_key FROM (
  SELECT file_path || '::' || chunk_index AS k, file_path || '::' || lag(chunk_index) OVER (PARTITION BY file_path ORDER BY chunk_index) AS p FROM latest) WHERE p IS NOT NULL""",
    "chunk_batches": "SELECT chunk_id, CAST((row_number() OVER (PARTITION BY file_path ORDER BY chunk_id) - 1) // 5 AS INTEGER) AS batch_no FROM chunks",
    "extract_links": f"WITH {_NOTE_EDGES} SELECT * FROM note_edges",
    "extract_wikilinks": r"""
SELECT vault, src_path, CAST(link_ord AS INTEGER) AS link_ord, trim(tg) AS target_name FROM (
  SELECT vault, rel_path AS src_path, unnest(regexp_extract_all(content, '\[\[\s*([^\]|\n]+)(?:\|[^\]]+)?\s*\]\]', 1)) AS tg,
    unnest(range(len(regexp_extract_all(content, '\[\[\s*([^\]|\n]+)(?:\|[^\]]+)?\s*\]\]', 1)))) AS link_ord FROM notes WHERE content IS NOT NULL)""",
    "resolve_links": f"WITH {_NOTE_EDGES} SELECT e.vault, e.target_name, src_path, relation, link_ord, dst_path FROM note_edges e JOIN names n ON e.vault = n.vault AND e.target_name = n.target_name",
    "dangling_links": f"WITH {_NOTE_EDGES} SELECT e.* FROM note_edges e ANTI JOIN names n ON e.vault = n.vault AND e.target_name = n.target_name",
    "links_by_note": f"""
SELECT source_path, string_agg(line, chr(10) ORDER BY line) AS lines FROM (
  SELECT DISTINCT source_path, {_LINE} AS line FROM ({_PRED}) WHERE relation_type IS NOT NULL AND lower(trim(relation_type)) NOT IN ('no link', '')) GROUP BY source_path""",
    "link_upsert": f"""
WITH nl AS (
  SELECT source_path, list(line) AS new FROM (SELECT DISTINCT source_path, {_LINE} AS line FROM ({_PRED})
    WHERE relation_type IS NOT NULL AND lower(trim(relation_type)) NOT IN ('no link', '')) GROUP BY source_path),
o AS (
  SELECT vault, rel_path, content, {_BODY} AS b, coalesce(new, []) AS new,
    list_filter(list_transform(string_split({_LINKS}, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS old
  FROM notes LEFT JOIN nl ON source_path = vault || '/' || rel_path)
SELECT vault, rel_path, CASE WHEN len(list_filter(new, lambda x: NOT list_contains(old, x))) > 0
  THEN b || {_H} || array_to_string(list_sort(list_distinct(list_concat(old, new))), chr(10)) ELSE content END AS content FROM o""",
    "backfill_types": """
WITH k AS (SELECT sample_name || '/' || source_file AS source_path, sample_name AS vault, entity, max(link_type) AS relation_type FROM gold WHERE link_type IS NOT NULL GROUP BY ALL),
p AS (SELECT k.source_path, k.vault || '/' || n.rel_path AS target_path, max(relation_type) AS relation_type FROM k JOIN notes n ON n.vault = k.vault AND n.stem = k.entity GROUP BY ALL)
SELECT pair_id, coalesce(relation_type, 'no link') AS llm_type, CASE WHEN relation_type IS NULL THEN '' ELSE 'gold' END AS llm_reasoning
FROM candidates c LEFT JOIN p ON c.source_path = p.source_path AND c.target_path = p.target_path""",
    "strict_broad_union": """
SELECT source_path, target_path, target_content, d FROM (
  SELECT *, row_number() OVER (PARTITION BY source_path, target_path, target_content ORDER BY CASE WHEN d = 0 THEN 0 ELSE 1 END, d NULLS FIRST, pair_id) AS rn FROM (
    SELECT source_path, target_path, target_content, CASE WHEN NOT isnan(vector_distance) THEN vector_distance END AS d, pair_id FROM candidates)) WHERE rn = 1""",
    "alias_dictionary": rf"""
SELECT alias, string_agg(rel_path, '|' ORDER BY rel_path) AS paths FROM (
  SELECT DISTINCT rel_path, lower({_strip(r"translate(nm, '_\-', '   ')")}) AS alias FROM (
    SELECT rel_path, {_title('rel_path')} AS nm FROM notes UNION ALL SELECT rel_path, regexp_extract(stem, '^[^_]+_[^_]+_(.+)$', 1) FROM notes))
WHERE alias <> '' GROUP BY alias""",
    "phrase_join": f"""
WITH {_GRAMS},
t AS (SELECT CAST(chunk_id AS VARCHAR) AS chunk, {_tokens("coalesce(text, '')")} AS l FROM chunks),
g AS (SELECT chunk, n, l, unnest(range(len(l) - n + 1)) AS pos FROM t, (SELECT DISTINCT n FROM al) WHERE len(l) >= n)
SELECT chunk, alias, CAST(min(pos) AS INTEGER) AS token_pos FROM g JOIN al ON al.n = g.n AND array_to_string(l[pos + 1:pos + g.n], ' ') = gram GROUP BY ALL""",
    "strict_retrieval": f"""
WITH {_GRAMS},
d AS (SELECT vault || '/' || rel_path AS source_path, {_SENTS.format('body')} AS s FROM notes WHERE body IS NOT NULL),
ss AS (SELECT source_path, s, unnest(range(len(s))) AS i FROM d),
t AS (SELECT source_path, i, array_to_string(s[greatest(i, 1):least(i + 2, len(s))], ' ') AS w, {_tokens('s[i + 1]')} AS l FROM ss),
g AS (SELECT source_path, i, w, n, l, unnest(range(len(l) - n + 1)) AS pos FROM t, (SELECT DISTINCT n FROM al) WHERE len(l) >= n),
h AS (SELECT source_path, alias, i, w FROM g JOIN al ON al.n = g.n AND array_to_string(l[pos + 1:pos + g.n], ' ') = gram)
SELECT source_path, alias AS target_path, arg_min(w, i) AS target_content, 1.0::DOUBLE AS reranker_score FROM h GROUP BY source_path, alias""",
    "proximity_match": f"""
WITH a AS (
  SELECT gold_id, {_tokens("coalesce(sentence, '')")} AS s, list_filter({_tokens("regexp_extract(entity, '^[^_]+_[^_]+_(.+)$', 1)")}, lambda x: NOT list_contains({_STOP}, x)) AS l FROM gold),
b AS (SELECT gold_id, s, list_distinct(l) AS w, l[1] AS head, CASE WHEN len(list_distinct(l)) <= 2 THEN len(list_distinct(l)) ELSE ceil(len(list_distinct(l)) * 0.75) END AS need FROM a),
p AS (SELECT gold_id, i, s[i] AS tok FROM (SELECT gold_id, s, w, unnest(range(1, len(s) + 1)) AS i FROM b) WHERE list_contains(w, s[i])),
x AS (SELECT p.gold_id, p.i, count(DISTINCT q.tok) AS n, list(q.tok) AS held FROM p JOIN p q ON p.gold_id = q.gold_id AND q.i BETWEEN p.i AND p.i + 15 GROUP BY 1, 2)
SELECT b.gold_id, len(b.w) > 0 AND coalesce(bool_or(x.n >= need AND (head IS NULL OR list_contains(held, head))), false) AS hit
FROM b LEFT JOIN x ON b.gold_id = x.gold_id GROUP BY b.gold_id, b.w""",
    "bm25_topk": f"WITH {_QA20}, {_BM25} SELECT query_id, chunk_id, score, CAST(rank_no AS INTEGER) AS rank_no FROM bmk",
    "fulltext_or_fuzzy": f"""
WITH {_QA20},
q AS (SELECT query_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(question, '[A-Za-zА-Яа-яЁё0-9]{{4,}}'), lambda x: lower(x)), lambda x: NOT list_contains({_STOP}, x)))) AS term FROM questions),
tok AS (SELECT DISTINCT chunk_id, unnest({_tokens("coalesce(text, '')")}) AS token FROM chunks),
voc AS (SELECT DISTINCT token FROM tok),
m AS (SELECT term, token FROM (SELECT DISTINCT term FROM q), voc WHERE term = token OR (length(term) > 5 AND abs(length(term) - length(token)) <= 1 AND levenshtein(term, token) <= 1)),
sc AS (SELECT query_id, chunk_id, count(DISTINCT term) AS score FROM q JOIN m USING (term) JOIN tok USING (token) GROUP BY ALL)
SELECT query_id, chunk_id, score, CAST(rank_no AS INTEGER) AS rank_no FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank_no FROM sc) WHERE rank_no <= 10""",
    "knn_topk": f"WITH {_knn(_L2)} SELECT query_id, item_id, CAST(rank_no AS INTEGER) AS rank_no FROM nn",
    "knn_threshold": f"WITH {_knn(_COS)} SELECT query_id, item_id, CAST(rank_no AS INTEGER) AS rank_no FROM nn WHERE distance <= 0.2",
    "hybrid_fusion": f"""
WITH {_knn(_COS)},
questions AS (SELECT chunk_id AS query_id, text AS question FROM v WHERE chunk_id % 20 = 0), {_BM25},
a AS (SELECT query_id, item_id AS chunk_id, CASE WHEN max(distance) OVER w > min(distance) OVER w THEN (max(distance) OVER w - distance) / (max(distance) OVER w - min(distance) OVER w) ELSE 1 END AS x FROM nn WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT query_id, chunk_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS y FROM bmk WINDOW w AS (PARTITION BY query_id))
SELECT query_id, chunk_id, round(0.6::DOUBLE * coalesce(x, 0) + 0.4::DOUBLE * coalesce(y, 0), 6) AS score FROM a FULL JOIN b USING (query_id, chunk_id)""",
    "maxnorm_fusion": """
WITH h AS (
  SELECT query_id, 0 AS branch, hit_id AS ord, text, 1.0::DOUBLE / (1.0 + distance) AS score FROM search_hits
  UNION ALL SELECT query_id, 1, hit_id, text, 1.0::DOUBLE / rank_no FROM search_hits),
s AS (SELECT *, score / CASE WHEN max(score) OVER (PARTITION BY query_id, branch) <> 0 THEN max(score) OVER (PARTITION BY query_id, branch) ELSE 1 END AS x FROM h)
SELECT query_id, substring(text, 1, 120) AS text_key, round(sum(x), 6) AS score, arg_max(text, (branch, ord)) AS text FROM s GROUP BY 1, 2""",
    "rerank_hits": f"""
WITH h AS (
  SELECT s.query_id, hit_id, list_distinct({_tokens('question')}) AS q, {_tokens("coalesce(s.text, '')")} AS c FROM search_hits s JOIN qa ON qa_id = s.query_id),
x AS (SELECT query_id, hit_id, round({_COVER.format(q='q', c='c')}, 6) AS score FROM h)
SELECT query_id, hit_id, score, CAST(rank_no AS INTEGER) AS rank_no FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS rank_no FROM x WHERE score >= 0.1) WHERE rank_no <= 5""",
    "dedup_hits": "SELECT query_id, hit_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY distance NULLS FIRST, hit_id) AS rn FROM search_hits) WHERE rn = 1",
    "best_text_score": "SELECT query_id, text, max(distance) AS score FROM search_hits GROUP BY ALL",
    "text_path_recovery": """
SELECT query_id, text, CASE WHEN text IS NOT NULL THEN file_path END AS file_path FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY rank_no DESC, hit_id DESC) AS rn FROM search_hits) WHERE rn = 1""",
    "group_topn_contexts": f"""
WITH {_GROUPED} SELECT source_path, target_path, string_agg(coalesce(target_content, ''), chr(10) ORDER BY rn) AS contexts, CAST(count(*) AS INTEGER) AS n_contexts
FROM gp WHERE rn <= 5 GROUP BY source_path, target_path""",
    "group_hits_by_file": """
WITH o AS (SELECT query_id, file_path, rank_no, min(text) AS text, min(distance) AS distance, max(1.0::DOUBLE / rank_no) AS score FROM search_hits WHERE file_path IS NOT NULL GROUP BY ALL)
SELECT query_id, file_path, string_agg(coalesce(text, ''), chr(10) || '...' || chr(10) ORDER BY rank_no) AS text, round(arg_min(distance, rank_no), 6) AS distance, round(max(score), 6) AS score
FROM o GROUP BY query_id, file_path""",
    "bfs_untyped": f"""
WITH RECURSIVE {_NOTE_EDGES}, {_SEEDS},
b(query_id, node, depth) AS (
  SELECT query_id, node, 0 FROM seeds UNION SELECT b.query_id, e.dst, b.depth + 1 FROM b JOIN edges e ON e.src = b.node WHERE b.depth < 2)
SELECT query_id, node, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY query_id, node""",
    "bfs_typed": f"""
WITH {_NOTE_EDGES}, {_SEEDS}, {_FIRST},
e AS (SELECT DISTINCT src, dst, relation FROM edges WHERE src <> dst),
et AS (SELECT src, dst, {_tokens(f"relation || ': ' || {_title('dst')} || '. ' || coalesce(summary, '')")} AS c FROM e LEFT JOIN firsts ON file_path = dst),
q AS (SELECT qa_id AS query_id, list_distinct({_tokens('question')}) AS q FROM qa),
h1 AS (SELECT s.query_id, dst AS node, max({_COVER.format(q='q.q', c='et.c')}) AS score FROM seeds s JOIN et ON et.src = s.node JOIN q ON q.query_id = s.query_id
       WHERE (s.query_id, dst) NOT IN (SELECT (query_id, node) FROM seeds) GROUP BY 1, 2 HAVING score >= 0.2),
h2 AS (SELECT s.query_id, dst AS node, max({_COVER.format(q='q.q', c='et.c')}) AS score FROM h1 s JOIN et ON et.src = s.node JOIN q ON q.query_id = s.query_id
       WHERE (s.query_id, dst) NOT IN (SELECT (query_id, node) FROM seeds) AND (s.query_id, dst) NOT IN (SELECT (query_id, node) FROM h1) GROUP BY 1, 2 HAVING score >= 0.2)
SELECT query_id, node, 0 AS depth, CAST(NULL AS DOUBLE) AS score FROM seeds
UNION ALL SELECT query_id, node, 1, round(score, 6) FROM h1 UNION ALL SELECT query_id, node, 2, round(score, 6) FROM h2""",
    "expand_one_hop": f"""
WITH {_NOTE_EDGES}, {_SEEDS}, {_FIRST},
st AS (
  SELECT s.query_id, e.dst AS node, s.score, s.rank_no, e.link_ord FROM seeds s JOIN edges e ON e.src = s.node
  WHERE e.dst IN (SELECT file_path FROM firsts WHERE summary IS NOT NULL AND summary <> '') AND (s.query_id, e.dst) NOT IN (SELECT (query_id, node) FROM seeds)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY rank_no, link_ord) AS rn FROM st) WHERE rn = 1),
r AS (SELECT query_id, node, round(score * 0.9, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank_no, link_ord, node) AS expand_no FROM f)
SELECT query_id, node, score, CAST(expand_no AS INTEGER) AS expand_no FROM r WHERE expand_no <= 5""",
    "khop_undirected": f"""
WITH RECURSIVE {_NOTE_EDGES}, {_SEEDS},
e AS (SELECT src, dst FROM edges WHERE relation NOT IN ('MENTIONS', 'NEXT_CHUNK') UNION SELECT dst, src FROM edges WHERE relation NOT IN ('MENTIONS', 'NEXT_CHUNK')),
b(query_id, node, depth) AS (
  SELECT query_id, node, 0 FROM seeds UNION SELECT b.query_id, e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 3)
SELECT query_id, node, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY query_id, node""",
    "note_components": f"""
WITH RECURSIVE {_NOTE_EDGES},
e AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
r(node, comp) AS (SELECT DISTINCT src, src FROM e UNION SELECT e.dst, r.comp FROM r JOIN e ON e.src = r.node)
SELECT node, min(comp) AS component FROM r GROUP BY node""",
    "entity_documents": """
WITH m AS (SELECT DISTINCT concat_ws('/', sample_name, source_file) AS doc, concat_ws(':', sample_name, entity) AS node FROM gold),
s AS (SELECT DISTINCT query_id, concat_ws(':', vault, stem) AS node FROM (SELECT qa_id AS query_id, vault, unnest(relevant_docs) AS stem FROM qa))
SELECT query_id, doc, count(*) AS n FROM m JOIN s USING (node) GROUP BY query_id, doc""",
    "edge_prf": f"WITH {_edge_counts('lower({0})')} SELECT vault, {_PRF} FROM cnt",
    "edge_prf_untyped": f"WITH {_edge_counts("'x'")} SELECT vault, {_PRF} FROM cnt",
    "prf_rollup": f"""
WITH {_edge_counts('{0}')},
s AS (SELECT vault, tp, fp, fn FROM cnt UNION ALL SELECT 'OVERALL', sum(tp), sum(fp), sum(fn) FROM cnt)
SELECT vault, {_PRF} FROM s""",
    "class_prf": f"WITH {_CLASSES} SELECT cls, CAST(support AS BIGINT) AS support, tp, fp, fn, precision, recall, f1 FROM cp",
    "class_averages": f"""
WITH {_CLASSES}
SELECT 'macro' AS avg_kind, round(coalesce(avg(precision), 0), 6) AS precision, round(coalesce(avg(recall), 0), 6) AS recall, round(coalesce(avg(f1), 0), 6) AS f1 FROM cp WHERE support > 0
UNION ALL SELECT 'weighted', round(coalesce(sum(precision * support) / sum(support), 0), 6), round(coalesce(sum(recall * support) / sum(support), 0), 6), round(coalesce(sum(f1 * support) / sum(support), 0), 6) FROM cp WHERE support > 0""",
    "gold_groups": """
SELECT sample_name, source_file, entity, lower(arg_max(link_type, gold_id) FILTER (link_type IS NOT NULL)) AS true_type, string_agg(coalesce(sentence, ''), chr(10) ORDER BY gold_id) AS sentences
FROM gold GROUP BY sample_name, source_file, entity HAVING count(link_type) > 0""",
    "sentence_ranking": """
SELECT gold_id, CAST(rn AS INTEGER) AS rank_no FROM (
  SELECT gold_id, row_number() OVER (PARTITION BY sample_name, source_file, entity ORDER BY coalesce(is_direct_mention, false) DESC, length(sentence) DESC NULLS LAST, gold_id) AS rn FROM gold) WHERE rn <= 5""",
    "fuzzy_match": f"""
WITH g AS (SELECT sample_name, gold_id, source_file, entity, coalesce(sentence, '') AS s, list_distinct(list_filter({_tokens("coalesce(sentence, '')")}, lambda x: NOT list_contains({_STOP}, x))) AS gs FROM gold),
p AS (
  SELECT DISTINCT vault AS sample_name, substring(source_path, length(vault) + 2) AS source_file, regexp_replace(list_last(string_split(target_path, '/')), '\\.md$', '') AS entity, target_content AS ps
  FROM candidates WHERE target_path IS NOT NULL AND target_content IS NOT NULL),
h AS (
  SELECT DISTINCT gold_id FROM g JOIN p USING (sample_name, source_file, entity)
  WHERE CASE WHEN len(gs) > 0 THEN len(list_intersect(gs, list_filter({_tokens('ps')}, lambda x: NOT list_contains({_STOP}, x)))) / len(gs) >= 0.5 ELSE contains(ps, s) END),
a AS (SELECT sample_name, count(*) FILTER (gold_id IN (SELECT gold_id FROM h)) AS tp, count(*) FILTER (gold_id NOT IN (SELECT gold_id FROM h)) AS fn FROM g GROUP BY 1),
b AS (
  SELECT sample_name, count(*) AS fp FROM (SELECT DISTINCT sample_name, source_file, entity FROM p EXCEPT SELECT DISTINCT sample_name, source_file, entity FROM g) GROUP BY 1),
c AS (SELECT coalesce(a.sample_name, b.sample_name) AS sample_name, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM a FULL JOIN b ON a.sample_name = b.sample_name)
SELECT sample_name, {_PRF} FROM c""",
    "nan_mean": """
SELECT round(avg(vector_distance) FILTER (NOT isnan(vector_distance)), 6) AS vector_distance, round(avg(reranker_score) FILTER (NOT isnan(reranker_score)), 6) AS reranker_score,
  count(*) - greatest(count(*) FILTER (vector_distance IS NULL OR isnan(vector_distance)), count(*) FILTER (reranker_score IS NULL OR isnan(reranker_score))) AS n_evaluated FROM candidates""",
    "qa_reference_contexts": rf"""
WITH n AS (
  SELECT vault, stem, {_strip(r"regexp_replace(c, '(?ims)^\s*#{1,3}\s*(?:Related Connections|Connections|Links)\s*$.*\z', '')")} AS text FROM (
    SELECT vault, stem, {_strip(r"regexp_replace(content, '(?s)\A---\n.*?\n---\n?', '')")} AS c FROM notes)),
d AS (SELECT qa_id, vault, unnest(relevant_docs) AS stem, unnest(range(len(relevant_docs))) AS i FROM qa),
x AS (SELECT qa_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) AS c FROM d JOIN n USING (vault, stem) WHERE text <> '' GROUP BY qa_id)
SELECT qa_id, coalesce(c, '{NO_CONTEXT}') AS contexts FROM qa LEFT JOIN x USING (qa_id)""",
    "content_hash_changes": """
WITH f AS (SELECT vault || '/' || rel_path AS file_path, max(md5(content)) AS n FROM notes GROUP BY 1),
s AS (SELECT file_path, file_hash AS o, true AS old FROM (
  SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY indexed_at DESC NULLS LAST, chunk_id DESC) AS rn FROM chunks) WHERE rn = 1)
SELECT file_path, CASE WHEN old IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' ELSE 'updated' END AS change FROM f FULL JOIN s USING (file_path)
WHERE old IS NULL OR n IS NULL OR n IS DISTINCT FROM o""",
    "chunk_cache": "SELECT chunk_id FROM chunks c WHERE EXISTS (SELECT 1 FROM notes n WHERE n.vault || '/' || n.rel_path = c.file_path AND md5(n.content) = c.file_hash)",
    "resume_anti_join": "SELECT vault || '/' || rel_path AS file_path FROM notes WHERE vault || '/' || rel_path NOT IN (SELECT sample_name || '/' || source_file FROM gold WHERE link_type IS NOT NULL AND sample_name IS NOT NULL AND source_file IS NOT NULL)",
    "corpus_counts": "SELECT vault, count(*) AS n_pairs, count(DISTINCT source_path) AS n_sources FROM candidates GROUP BY vault",
}
