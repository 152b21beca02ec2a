"""SQL counterparts of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

import re

from ..config import Prompts
from ..functions.markers import BLOCK_END, BLOCK_START
from .inputs import EPOCH, GRAMMAR_LINES, HOUR, NOW_MS

W = (
    r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
    r"\x{3000}\x{FEFF}"
)
WN = W.replace(r"\n", "")
DOT = r"[^\n\r\x{2028}\x{2029}]"
P = Prompts()

ORACLES: dict[str, str] = {}


def text(value: str) -> str:
    """A string literal; line ends become ``chr(10)``."""
    parts = ["'" + part.replace("'", "''") + "'" for part in value.split("\n")]
    return "(" + "||chr(10)||".join(parts) + ")"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{W}]+|[{W}]+$', '', 'g')"


def rtrim(x: str) -> str:
    return f"regexp_replace({x}, '[{W}]+$', '')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{W}]+')"


def terms(x: str) -> str:
    return rf"regexp_extract_all(lower(strip_accents({x})), '[\p{{L}}\p{{N}}]+')"


def iso(ms: str) -> str:
    return f"(strftime(epoch_ms(({ms})::BIGINT), '%Y-%m-%dT%H:%M:%S.%g')||'Z')"


def render(template: str, values: dict[str, str]) -> str:
    """The template as one SQL concatenation."""
    pieces = re.split(r"\{\{\s*([\w.]+)\s*\}\}", template)
    out = [text(pieces[0])]
    for name, rest in zip(pieces[1::2], pieces[2::2]):
        out += [f"({values[name]})::VARCHAR" if name in values else "''", text(rest)]
    return "(" + "||".join(out) + ")"


def truncate(x: str, limit: int) -> str:
    cut = rtrim(f"substr({x}, 1, {limit})")
    return f"CASE WHEN length({x}) <= {limit} THEN {x} ELSE {cut}||chr(10)||'...' END"


BLOCK = f"{BLOCK_START}([\\s\\S]*?){BLOCK_END}"


def strip(x: str) -> str:
    collapsed = trim(
        f"regexp_replace(regexp_replace({x}, '{BLOCK}', chr(10), 'g'), '\\n{{2,}}', chr(10), 'g')"
    )
    return f"CASE WHEN contains({x}, '{BLOCK_START}') THEN {collapsed} ELSE {x} END"


PATH = "source||'/'||doc_id||'.md'"
MTIME = f"({EPOCH} + doc_id*{HOUR})::BIGINT"

CORPUS = f"""
corpus AS (
  SELECT doc_id::VARCHAR AS chunk_id, source||'.md' AS file_path, [source, lang] AS hp,
         text AS content, len({words('text')}) AS tokens, {EPOCH} + doc_id*{HOUR} AS mtime,
         coalesce(embedding::DOUBLE[], []::DOUBLE[]) AS emb, source, lang, doc_id
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"""
VECTORS = f"""
vectors AS (
  SELECT vec_id::VARCHAR AS chunk_id, embedding::DOUBLE[] AS emb, label,
         {EPOCH} + vec_id*{HOUR} AS mtime FROM embeddings)"""
BOOST = f"0.05::DOUBLE / (1 + ({NOW_MS} - mtime) / 86400000.0::DOUBLE)"


def dot(a: str, b: str) -> str:
    """Dot product; 0 when a side has no vector."""
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE list_inner_product({a}, {b}) END"


def cosine(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE list_cosine_similarity({a}, {b}) END"


def centroid(name: str, source: str, key: str) -> str:
    return f"""
{name} AS (
  SELECT {key}, list(x ORDER BY pos) AS vector FROM (
    SELECT {key}, pos, avg(x) AS x FROM (
      SELECT {key}, generate_subscripts(emb, 1) AS pos, unnest(emb) AS x FROM {source})
    GROUP BY ALL) GROUP BY ALL)"""


WORD_QUESTIONS = f"""
wq AS (
  SELECT source AS query_id, string_agg(t, ' ' ORDER BY t) AS question FROM (
    SELECT source, t, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, t) AS rn
    FROM (SELECT source, unnest(list_distinct({terms('text')})) AS t FROM documents)
    WHERE regexp_matches(t, '^[a-z0-9]{{5,}}$') GROUP BY source, t)
  WHERE rn <= 2 GROUP BY source)"""
SOURCE_QUESTIONS = (
    CORPUS + "," + centroid("means", "corpus", "source") + "," + WORD_QUESTIONS
    + ", sq AS (SELECT query_id, question, vector FROM wq JOIN means ON source = query_id)"
)
BENCH_QUESTIONS = """
bq AS (
  SELECT item_id::VARCHAR AS query_id, text AS question, coalesce(embedding::DOUBLE[], []::DOUBLE[]) AS vector
  FROM benchmark LEFT JOIN embeddings ON item_id = vec_id)"""


def vector_list(questions: str, where: str = "TRUE") -> str:
    return f"""
vec AS (
  SELECT query_id, chunk_id, score, rank FROM (
    SELECT query_id, chunk_id, score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
    FROM (SELECT query_id, chunk_id,
                 round(({dot('emb', 'vector')}) + {BOOST}, 12) AS score
          FROM corpus, {questions} WHERE {where})) WHERE rank <= 40)"""


def bm25(questions: str, docs: str, limit: int = 30) -> str:
    """CTEs ending in ``lex(query_id, chunk_id, bm25, rank)``; ``docs`` gives chunk_id, content."""
    return f"""
d AS (SELECT chunk_id, {terms('content')} AS toks FROM ({docs})),
corpus_stats AS (SELECT count(*) AS n, sum(len(toks))::DOUBLE / count(*) AS avgdl FROM d),
tf AS (SELECT chunk_id, t, count(*)::DOUBLE AS tf
       FROM (SELECT chunk_id, unnest(toks) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
idf AS (SELECT t, CASE WHEN ln((n-df+0.5::DOUBLE)/(df+0.5::DOUBLE)) > 0
                       THEN ln((n-df+0.5::DOUBLE)/(df+0.5::DOUBLE)) ELSE 1e-6::DOUBLE END AS idf
        FROM df, corpus_stats),
qt AS (SELECT query_id, lower(w) AS t, count(*)::DOUBLE AS m FROM (
         SELECT query_id, unnest(regexp_extract_all(question, '[A-Za-z0-9_]+')) AS w
         FROM {questions}) GROUP BY ALL),
qn AS (SELECT query_id, count(*) AS n FROM qt GROUP BY query_id),
matched AS (
  SELECT qt.query_id, tf.chunk_id, count(*) AS c,
         -sum(m*idf*tf*2.2::DOUBLE/(tf + 1.2::DOUBLE*(0.25::DOUBLE + 0.75::DOUBLE*len(d.toks)/avgdl))) AS bm25
  FROM qt JOIN tf ON tf.t = qt.t JOIN idf ON idf.t = qt.t JOIN d ON d.chunk_id = tf.chunk_id,
       corpus_stats GROUP BY ALL),
lex_all AS (SELECT query_id, chunk_id, bm25 FROM matched JOIN qn USING (query_id) WHERE c = qn.n),
lex AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 12), chunk_id) AS rank
    FROM lex_all) WHERE rank <= {limit})"""


ALL_DOCS = "SELECT doc_id::VARCHAR AS chunk_id, text AS content FROM documents"
IN_CORPUS = "SELECT chunk_id, content FROM corpus"


def fused(name: str = "fused", wv: float = 0.7, wl: float = 0.3, lex: str = "lex") -> str:
    return f"""
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY score DESC, vr NULLS LAST, lr NULLS LAST) AS rank FROM (
    SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.chunk_id, l.chunk_id) AS chunk_id,
           v.rank AS vr, l.rank AS lr,
           coalesce({wv}::DOUBLE/v.rank, 0) + coalesce({wl}::DOUBLE/l.rank, 0) AS score
    FROM vec v FULL JOIN {lex} l ON v.query_id = l.query_id AND v.chunk_id = l.chunk_id))"""


CAPPED = """
capped AS (
  SELECT query_id, chunk_id, file_path, score, emb, content, hp, tokens,
         row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
  FROM (SELECT f.query_id, f.chunk_id, f.score, f.rank, c.file_path, c.emb, c.content, c.hp, c.tokens,
               row_number() OVER (PARTITION BY f.query_id, c.file_path ORDER BY f.rank) AS nth
        FROM fused f JOIN corpus c ON c.chunk_id = f.chunk_id) WHERE nth <= 2)"""


def mmr(pool: str) -> str:
    """CTEs ending in ``final``; needs WITH RECURSIVE."""
    return f"""
pool AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM ({pool}) WHERE rank <= 40),
picks AS (
  SELECT query_id, chunk_id, score, rank, emb, 0 AS step, 0.0::DOUBLE AS closest,
         NULL::INTEGER AS picked FROM pool WHERE n > 12
  UNION ALL
  SELECT query_id, chunk_id, score, rank, emb, step + 1,
         CASE WHEN step = 0 THEN {dot('emb', 'best')}
              ELSE greatest(closest, {dot('emb', 'best')}) END,
         CASE WHEN rn = 1 THEN step + 1 ELSE picked END
  FROM (SELECT *, row_number() OVER w AS rn, first_value(emb) OVER w AS best FROM picks
        WHERE step < 12
        WINDOW w AS (PARTITION BY query_id ORDER BY (picked IS NOT NULL),
                     round(0.65::DOUBLE*score - (1-0.65::DOUBLE)*closest, 12) DESC, rank))),
final AS (
  SELECT query_id, chunk_id, score, picked::BIGINT AS rank FROM picks WHERE step = 12 AND picked IS NOT NULL
  UNION ALL SELECT query_id, chunk_id, score, rank FROM pool WHERE n <= 12)"""


def packed(ranked: str, budget: int = 1800) -> str:
    """CTEs ending in ``packed(query_id, chunk_id, tokens, label)``; needs WITH RECURSIVE."""
    return f"""
seq AS (SELECT query_id, chunk_id, tokens,
               row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rn FROM ({ranked})),
fold AS (
  SELECT query_id, chunk_id, tokens, rn, {budget} - tokens AS room, TRUE AS taken, 1 AS label
  FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.query_id, s.chunk_id, s.tokens, s.rn,
         CASE WHEN f.room - s.tokens >= 0 THEN f.room - s.tokens ELSE f.room END,
         f.room - s.tokens >= 0,
         CASE WHEN f.room - s.tokens >= 0 THEN f.label + 1 ELSE f.label END
  FROM fold f JOIN seq s ON s.query_id = f.query_id AND s.rn = f.rn + 1),
packed AS (SELECT query_id, chunk_id, tokens, label FROM fold WHERE taken)"""


# --- vectors ---------------------------------------------------------------------------------

ORACLES["vector_topk"] = f"""
WITH {VECTORS}, {centroid('means', 'vectors', 'label')}
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (
  SELECT query_id, chunk_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT 'label'||m.label AS query_id, chunk_id,
               round(list_inner_product(emb, vector) + {BOOST}, 12) AS score
        FROM vectors v, means m)) WHERE rank <= 40"""

ORACLES["vector_topk_pruned"] = ORACLES["vector_topk"]
ORACLES["related_all"] = f"""
WITH {VECTORS}
SELECT query_id, path, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM (
    SELECT a.chunk_id AS query_id, 'v/'||b.chunk_id||'.md' AS path, round({cosine('a.emb', 'b.emb')}, 12) AS score
    FROM vectors a JOIN vectors b ON a.chunk_id <> b.chunk_id)) WHERE rank <= 5"""
RELATED = f"""
WITH {CORPUS}, {centroid('means', 'corpus', 'file_path')},
best AS (
  SELECT m.file_path AS query_id, c.file_path AS path,
         max(round({cosine('emb', 'vector')}, 12)) AS score
  FROM corpus c, means m WHERE c.file_path <> m.file_path GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM best)"""
ORACLES["related_sources"] = f"""{RELATED}
SELECT query_id, path, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5"""
ORACLES["related_lines"] = f"""{RELATED}
SELECT query_id, string_agg(rank||'. [['||regexp_replace(path, '\\.md$', '')||']] (score '
       ||printf('%.1f', score*100)||'%)', chr(10) ORDER BY rank) AS lines
FROM ranked WHERE rank <= 5 GROUP BY query_id"""
ORACLES["vector_similarity"] = f"""
WITH {VECTORS}, {centroid('means', 'vectors', 'label')}
SELECT chunk_id, round(list_inner_product(emb, vector), 6) AS dot,
       round(list_cosine_similarity(emb, vector), 6) AS cosine
FROM vectors v JOIN means m ON m.label = v.label"""
ORACLES["l2_normalize"] = f"""
WITH {VECTORS}, s AS (SELECT chunk_id, list_transform(emb, lambda x: x*label) AS v FROM vectors),
n AS (SELECT *, sqrt(list_inner_product(v, v)) AS norm FROM s),
u AS (SELECT *, CASE WHEN norm > 0 THEN list_transform(v, lambda x: x/norm) ELSE v END AS unit FROM n)
SELECT chunk_id, round(norm, 6) AS norm, round(sqrt(list_inner_product(unit, unit)), 6) AS unit_norm,
       round(unit[1], 6) AS first, round(unit[-1], 6) AS last FROM u"""
ORACLES["recency_boost"] = f"""
SELECT {PATH} AS file_path,
       round(1e6::DOUBLE * 0.05::DOUBLE / (1 + ({NOW_MS} - {MTIME}) / 86400000.0::DOUBLE), 6) AS boost_e6,
       round(CASE WHEN {NOW_MS} - {MTIME}*1000 <= 0 THEN 0.05::DOUBLE ELSE
             0.05::DOUBLE / (1 + ({NOW_MS} - {MTIME}*1000) / 86400000.0::DOUBLE) END, 9) AS by_seconds
FROM documents"""

# --- lexical ---------------------------------------------------------------------------------

ORACLES["query_words"] = """
SELECT conv_id, turn, array_to_string(w, ' ') AS words, len(w)::BIGINT AS n
FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z0-9_]+') AS w FROM conversations)"""
ORACLES["term_statistics"] = f"""
SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (
  SELECT term, doc_id, count(*) AS tf
  FROM (SELECT doc_id, unnest({terms('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term"""
ORACLES["fts_match"] = f"""
WITH {BENCH_QUESTIONS}, {bm25('bq', ALL_DOCS)} SELECT query_id, chunk_id FROM lex_all"""
ORACLES["bm25_topk"] = f"""
WITH {WORD_QUESTIONS}, {bm25('wq', ALL_DOCS)}
SELECT query_id, chunk_id, round(bm25, 9) AS bm25, round(1/(bm25+1), 6) AS score, rank FROM lex"""
ORACLES["bm25_passages"] = f"""
WITH {BENCH_QUESTIONS}, {bm25('bq', ALL_DOCS)}
SELECT query_id, chunk_id, round(bm25, 9) AS bm25, rank FROM lex"""
ORACLES["bm25_phrases"] = f"""
WITH d AS (SELECT doc_id::VARCHAR AS chunk_id, source, {terms('text')} AS toks FROM documents),
s AS (SELECT count(*) AS n, sum(len(toks))::DOUBLE/count(*) AS avgdl FROM d),
bg AS (SELECT chunk_id, source, size, toks[i] AS a, toks[i+1] AS b
       FROM (SELECT *, len(toks) AS size, unnest(range(1, len(toks))) AS i FROM d)),
q AS (SELECT source AS query_id, a, b FROM (
        SELECT source, a, b, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, a||'_'||b) AS rn
        FROM bg WHERE regexp_matches(a, '^[a-z0-9]{{4,}}$') AND regexp_matches(b, '^[a-z0-9]{{4,}}$')
        GROUP BY source, a, b) WHERE rn = 1),
tf AS (SELECT query_id, chunk_id, size, count(*)::DOUBLE AS tf
       FROM q JOIN bg ON bg.a = q.a AND bg.b = q.b GROUP BY ALL),
df AS (SELECT query_id, count(*) AS df FROM tf GROUP BY query_id),
score AS (SELECT query_id, chunk_id,
          -greatest(CASE WHEN ln((n-df+0.5::DOUBLE)/(df+0.5::DOUBLE)) > 0
                         THEN ln((n-df+0.5::DOUBLE)/(df+0.5::DOUBLE)) ELSE 1e-6::DOUBLE END, 0)
          *tf*2.2::DOUBLE/(tf+1.2::DOUBLE*(0.25::DOUBLE+0.75::DOUBLE*size/avgdl)) AS bm25
          FROM tf JOIN df USING (query_id), s)
SELECT query_id, chunk_id, round(bm25, 9) AS bm25, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 12), chunk_id) AS rank
  FROM score) WHERE rank <= 30"""
_WORDS, _PHRASES = ORACLES["bm25_topk"], ORACLES["bm25_phrases"]
ORACLES["bm25_postings"] = f"""
SELECT query_id, chunk_id, bm25, rank FROM ({_WORDS.strip()})
UNION ALL SELECT 'phrase '||query_id, chunk_id, bm25, rank FROM ({_PHRASES.strip()})"""
ORACLES["bm25_topk_stored"] = ORACLES["bm25_topk"]
ORACLES["fts_phrases"] = f"""
WITH d AS (SELECT doc_id, {terms('text')} AS w FROM documents),
pairs AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
items AS (SELECT {terms('text')} AS w FROM benchmark),
asked AS (SELECT DISTINCT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM items))
SELECT a||' '||b AS phrase, count(DISTINCT doc_id) AS documents, count(*) AS occurrences
FROM pairs JOIN asked USING (a, b) GROUP BY ALL"""
ORACLES["lexical_postfilter"] = f"""
WITH {WORD_QUESTIONS}, {bm25('wq', ALL_DOCS)}
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
FROM lex JOIN documents ON doc_id::VARCHAR = chunk_id
WHERE starts_with(source||'.md', 'src1') AND lang IN ('en', 'fr')"""

# --- fusion and what follows -------------------------------------------------------------------

LISTS = f"{SOURCE_QUESTIONS}, {vector_list('sq')}, {bm25('sq', IN_CORPUS)}"
FUSED = f"{LISTS}, {fused()}"
ORACLES["fuse_rankings"] = f"""
WITH {FUSED} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM fused"""
ORACLES["cap_per_file"] = f"""
WITH {FUSED}, {CAPPED} SELECT query_id, chunk_id, file_path, round(score, 6) AS score, rank FROM capped"""
ORACLES["mmr_select"] = f"""
WITH RECURSIVE {FUSED}, {mmr('SELECT f.*, emb FROM fused f JOIN corpus c ON c.chunk_id = f.chunk_id')}
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM final"""
ORACLES["merge_results"] = f"""
WITH {LISTS}, {fused('f1')}, {fused('f2', 0.3, 0.7)},
both_lists AS (SELECT query_id, chunk_id, score, rank AS seen FROM f1
         UNION ALL SELECT query_id, chunk_id, score, 1000000 + rank FROM f2),
best AS (SELECT query_id, chunk_id, max(score) AS score, min(seen) AS seen FROM both_lists GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 6) AS score,
       row_number() OVER (PARTITION BY query_id ORDER BY best.score DESC, seen) AS rank FROM best"""
ORACLES["rerank_by_ids"] = f"""
WITH {FUSED}, top AS (SELECT f.query_id, f.chunk_id, f.rank, hp, content FROM fused f
                      JOIN corpus c ON c.chunk_id = f.chunk_id WHERE f.rank <= 12),
placed AS (
  SELECT *, CASE WHEN chunk_id::BIGINT % 2 = 1 THEN 100 - rank END AS pos FROM top
  UNION ALL SELECT *, 200 AS pos FROM top WHERE rank = 1
  UNION ALL SELECT *, 300 + rank AS pos FROM top WHERE chunk_id::BIGINT % 2 = 0 AND rank > 1)
SELECT query_id, chunk_id,
       sha1('ID: '||chunk_id||chr(10)||'Heading: '||array_to_string(hp, ' > ')||chr(10)||'Content:'
            ||chr(10)||substr(content, 1, 800)) AS preview_sha1,
       row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank
FROM placed WHERE pos IS NOT NULL"""
ORACLES["pack_context"] = f"""
WITH RECURSIVE {packed(f"SELECT lang AS query_id, doc_id::VARCHAR AS chunk_id, doc_id AS rank, len({words('text')})::BIGINT AS tokens FROM documents")}
SELECT query_id, chunk_id, tokens, label::BIGINT AS label FROM packed"""


def hybrid(questions: str, setup: str, where: str = "TRUE") -> str:
    lexical = f"""
kept AS (SELECT query_id, l.chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
         FROM lex l JOIN corpus c ON c.chunk_id = l.chunk_id WHERE {where})"""
    return f"""
{setup}, {vector_list(questions, where)}, {bm25(questions, IN_CORPUS)}, {lexical},
{fused(lex='kept')}, {CAPPED}, {mmr('SELECT * FROM capped')}"""


FILTERED = "starts_with(file_path, 'src1') AND lang IN ('en', 'fr')"
SHOW_FINAL = """
SELECT f.query_id, f.chunk_id, c.file_path, round(f.score, 6) AS score, f.rank
FROM final f JOIN corpus c ON c.chunk_id = f.chunk_id"""
BENCH_HYBRID = hybrid("bq", f"{CORPUS}, {BENCH_QUESTIONS}")
ORACLES["hybrid_retrieve"] = f"WITH RECURSIVE {hybrid('sq', SOURCE_QUESTIONS)} {SHOW_FINAL}"
ORACLES["hybrid_filtered"] = f"WITH RECURSIVE {hybrid('sq', SOURCE_QUESTIONS, FILTERED)} {SHOW_FINAL}"
ORACLES["hybrid_passages"] = f"WITH RECURSIVE {BENCH_HYBRID} {SHOW_FINAL}"
ORACLES["rerank_model"] = f"""
WITH RECURSIVE {hybrid('sq', SOURCE_QUESTIONS)}
SELECT f.query_id, f.chunk_id, c.file_path, round(f.score, 6) AS score,
       row_number() OVER (PARTITION BY f.query_id ORDER BY f.rank DESC) AS rank
FROM final f JOIN corpus c ON c.chunk_id = f.chunk_id"""
BENCH_PACKED = f"""{BENCH_HYBRID}, {packed('SELECT f.query_id, f.chunk_id, f.rank, c.tokens FROM final f JOIN corpus c ON c.chunk_id = f.chunk_id')}"""
HEAD = "'[C'||label||'] '||file_path||' | '||array_to_string(hp, ' > ')"
ORACLES["answer_context"] = f"""
WITH RECURSIVE {BENCH_PACKED}
SELECT query_id,
       string_agg({HEAD}||chr(10)||content, {text(chr(10)*2 + '---' + chr(10)*2)} ORDER BY label) AS context,
       string_agg({HEAD}, chr(10) ORDER BY label) AS citation_lines, count(*) AS cited,
       string_agg(file_path, ' ' ORDER BY label) AS paths
FROM packed p JOIN corpus c ON c.chunk_id = p.chunk_id GROUP BY query_id"""
ORACLES["eval_metrics"] = f"""
WITH RECURSIVE {BENCH_PACKED},
got AS (SELECT query_id, list(file_path ORDER BY label) AS paths
        FROM packed p JOIN corpus c ON c.chunk_id = p.chunk_id GROUP BY query_id),
want AS (SELECT query_id, list(DISTINCT file_path) AS expected
         FROM lex l JOIN corpus c ON c.chunk_id = l.chunk_id GROUP BY query_id),
cases AS (SELECT paths, coalesce(expected, []) AS expected FROM got LEFT JOIN want USING (query_id)),
scored AS (SELECT
  CASE WHEN len(expected) = 0 THEN 1.0::DOUBLE
       ELSE len(list_filter(expected, lambda p: list_contains(paths[1:12], p)))::DOUBLE/len(expected) END AS r,
  CASE WHEN len(paths) = 0 THEN 0.0::DOUBLE WHEN len(expected) = 0 THEN 1.0::DOUBLE
       ELSE len(list_filter(paths, lambda p: list_contains(expected, p)))::DOUBLE/len(paths) END AS c
  FROM cases)
SELECT round(sum(r)/greatest(count(*), 1), 6) AS recall_at_k,
       round(sum(c)/greatest(count(*), 1), 6) AS citation_accuracy FROM scored"""

# --- chunking --------------------------------------------------------------------------------


def plain_chunks(source: str) -> str:
    """Chunks of one-paragraph notes: the text, and after a size flush its last 60 tokens."""
    return f"""
plain AS (
  SELECT path, doc_id::VARCHAR AS title, mtime, {trim('text')} AS t, {words('text')} AS w FROM ({source})),
chunks AS (
  SELECT sha1(path||'|'||title||'|'||ordinal) AS chunk_id, path AS file_path, title AS note_title,
         title AS heading_path, ordinal::BIGINT AS ordinal, 'text' AS chunk_type, '' AS tags, '' AS links,
         mtime, content, sha1(content) AS content_hash,
         sha1('Heading: '||title||chr(10)||chr(10)||content) AS representation_sha1, tokens::BIGINT AS tokens
  FROM (SELECT path, title, mtime, 1 AS ordinal, t AS content, len(w) AS tokens FROM plain WHERE len(w) > 0
        UNION ALL
        SELECT path, title, mtime, 2, array_to_string(w[-60:], ' '), 60 FROM plain WHERE len(w) >= 350))"""


DOC_SOURCE = f"SELECT {PATH} AS path, doc_id, {MTIME} AS mtime, text FROM documents"
CHUNK_LIST = """chunk_id, file_path, note_title, heading_path, ordinal, chunk_type, tags, links, mtime,
       content, content_hash, representation_sha1, tokens"""
ORACLES["chunk_documents"] = f"WITH {plain_chunks(DOC_SOURCE)} SELECT {CHUNK_LIST} FROM chunks"

GENERATED = f"{text(chr(10)*2 + BLOCK_START + chr(10) + 'AI Summary' + chr(10)*2 + 'old ')}||doc_id||{text(chr(10) + BLOCK_END)}"
TAIL = f"{text(chr(10)*2 + '## Links' + chr(10)*2 + '- [[')}||source||{text(']]' + chr(10) + '- see [[')}||lang||{text('/index|home]]' + chr(10)*2 + '```sql' + chr(10) + 'select ')}||doc_id||{text(chr(10)*2 + 'from t' + chr(10) + '```' + chr(10))}"
RICH = f"""
rich AS (
  SELECT *, front||body AS markdown FROM (
    SELECT d.doc_id, d.source, d.lang, d.text, quality, coalesce(toxic, 0) AS toxic, {PATH.replace('doc_id', 'd.doc_id')} AS path,
           ({EPOCH} + d.doc_id*{HOUR})::BIGINT AS mtime,
           CASE WHEN quality IS NULL THEN {text('---' + chr(10) + 'title: Note ')}||d.doc_id||{text(chr(10) + 'tags:' + chr(10) + '  - #')}||lang||{text(chr(10) + '  - ')}||source||{text(chr(10) + '---' + chr(10))}
                WHEN quality = 0 THEN {text('---' + chr(10) + 'summary: Short' + chr(10) + 'tags: ')}||lang||', #'||source||{text(chr(10) + '---' + chr(10))}
                ELSE '' END AS front,
           '# '||source||chr(10)||text||CASE WHEN coalesce(toxic, 0) = 1 THEN {GENERATED.replace('doc_id', 'd.doc_id')} ELSE '' END||{TAIL.replace('doc_id', 'd.doc_id')} AS body
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id))"""


def rich_chunks(loose: bool) -> str:
    code = "'```sql'||chr(10)||'select '||doc_id||chr(10)||CASE WHEN toxic = 1 THEN '' ELSE chr(10) END||'from t'||chr(10)||'```'"
    listing = "'- [['||source||']]'||chr(10)||'- see [['||lang||'/index|home]]'"
    links = "source||','||lang||'/index'"
    if loose:
        tail = f"""
        SELECT *, 2 + long AS ordinal, [source, 'Links'] AS sections, {listing}||chr(10)||chr(10)||{code} AS content,
               11 AS tokens, 'code' AS chunk_type, {links} AS links FROM base"""
        head = "'Title: '||title"
    else:
        tail = f"""
        SELECT *, 2 + long AS ordinal, [source, 'Links'] AS sections, {listing} AS content, 5 AS tokens,
               'list' AS chunk_type, {links} AS links FROM base
        UNION ALL
        SELECT *, 3 + long, [source, 'Links'], {code}, 6, 'code', '' FROM base"""
        head = "'Heading: '||array_to_string(hp, ' > ')"
    return f"""
base AS (
  SELECT *, {words('text')} AS w, (len({words('text')}) >= 350)::INT AS long,
         CASE WHEN quality IS NULL THEN 'Note '||doc_id ELSE source END AS title,
         CASE WHEN quality IS NULL THEN [lang, source] WHEN quality = 0 THEN [lang] ELSE []::VARCHAR[] END AS tag_list
  FROM rich),
parts AS (
  SELECT *, 1 AS ordinal, [source] AS sections, {trim('text')} AS content, len(w) AS tokens,
         'text' AS chunk_type, '' AS links FROM base
  UNION ALL
  SELECT *, 2, [source], array_to_string(w[-60:], ' '), 60, 'text', '' FROM base WHERE long = 1
  UNION ALL {tail}),
pathed AS (SELECT *, CASE WHEN title = source THEN sections ELSE list_prepend(title, sections) END AS hp FROM parts),
chunks AS (
  SELECT sha1(path||'|'||array_to_string(hp, '>')||'|'||ordinal) AS chunk_id, path AS file_path,
         title AS note_title, array_to_string(hp, '>') AS heading_path, ordinal::BIGINT AS ordinal, chunk_type,
         array_to_string(tag_list, ',') AS tags, links, mtime, content, sha1(content) AS content_hash,
         sha1({head}||CASE WHEN len(tag_list) > 0 THEN chr(10)||'Tags: '||array_to_string(tag_list, ', ') ELSE '' END
              ||chr(10)||chr(10)||content) AS representation_sha1, tokens::BIGINT AS tokens, lang
  FROM pathed)"""


ORACLES["chunk_notes"] = f"WITH {RICH}, {rich_chunks(False)} SELECT {CHUNK_LIST} FROM chunks"
ORACLES["chunk_sql"] = ORACLES["chunk_notes"]
ORACLES["chunk_titles_only"] = f"WITH {RICH}, {rich_chunks(True)} SELECT {CHUNK_LIST} FROM chunks"
ORACLES["filter_notes"] = f"""
WITH {RICH}, {rich_chunks(False)} SELECT chunk_id, file_path, chunk_type FROM chunks
WHERE starts_with(file_path, 'src1') AND chunk_type IN ('text', 'code')
  AND (list_has_any(string_split(tags, ','), ['en', 'fr']))"""
ORACLES["filter_stored"] = ORACLES["filter_notes"]
ORACLES["classify_lines"] = f"""
WITH {RICH},
lines AS (SELECT path, unnest(string_split(markdown, chr(10))) AS line,
                 generate_subscripts(string_split(markdown, chr(10)), 1) - 1 AS pos FROM rich),
kinds AS (SELECT path, pos, CASE
  WHEN regexp_matches(line, '^#[{W}]+{DOT}*$') THEN '1' WHEN regexp_matches(line, '^##[{W}]+{DOT}*$') THEN '2'
  WHEN regexp_matches(line, '^###[{W}]+{DOT}*$') THEN '3' WHEN regexp_matches(line, '^####[{W}]+{DOT}*$') THEN '4'
  WHEN regexp_matches(line, '^#####[{W}]+{DOT}*$') THEN '5' WHEN regexp_matches(line, '^######[{W}]+{DOT}*$') THEN '6'
  WHEN starts_with(line, '```') THEN '`' WHEN starts_with(line, '~~~') THEN '~'
  WHEN {trim('line')} = '' THEN '.'
  WHEN regexp_matches(line, '^((\\*[{W}]*){{3,}}|(-[{W}]*){{3,}}|(_[{W}]*){{3,}})$') THEN '-'
  WHEN starts_with({trim('line')}, '|') AND NOT starts_with({trim('line')}, '|---') THEN '|'
  WHEN regexp_matches(line, '(?i)^>[{W}]*\\[![A-Z]+\\]{DOT}*$') THEN '!'
  WHEN starts_with(line, '>') THEN '>'
  WHEN regexp_matches(line, '^[{W}]{{0,3}}([-*+]|[0-9]+\\.)[{W}]+') THEN '*'
  WHEN starts_with({trim('line')}, '```') THEN 'b' WHEN starts_with({trim('line')}, '~~~') THEN 't'
  ELSE 'p' END AS kind FROM lines)
SELECT path AS file_path, kind, count(*) AS n, min(pos)::BIGINT AS first_line FROM kinds GROUP BY ALL"""
_GRAMMAR = "||chr(10)||".join(["text", *(
    "(" + "||".join(
        {"\r": "chr(13)", "\t": "chr(9)", "\u00a0": "chr(160)"}.get(part, "lang" if part == "{}" else "'" + part + "'")
        for part in re.split(r"(\{\}|[\r\t\u00a0])", line) if part) + ")" for line in GRAMMAR_LINES)])
ORACLES["classify_grammar"] = ORACLES["classify_lines"].replace(
    f"WITH {RICH},", f"WITH rich AS (SELECT {PATH} AS path, {_GRAMMAR} AS markdown FROM documents),"
)
ORACLES["token_counts"] = f"""
SELECT doc_id, len({words('t')})::BIGINT AS tokens,
       CASE WHEN {trim('t')} = '' THEN 0 ELSE len(regexp_split_to_array(t, '[{W}]+')) END::BIGINT AS pieces,
       len(regexp_split_to_array(' '||t, '[{W}]+'))::BIGINT AS raw_pieces, length(t)::BIGINT AS units
FROM (SELECT doc_id, text||chr(10) AS t FROM documents)"""
ORACLES["overlap_text"] = f"""
SELECT doc_id, CASE WHEN len(w) > 60 THEN array_to_string(w[-60:], ' ') END AS overlap
FROM (SELECT doc_id, {words('text')} AS w FROM documents)"""

# --- notes as text ---------------------------------------------------------------------------

ORACLES["frontmatter"] = f"""
WITH {RICH}
SELECT path AS file_path, front <> '' AS has,
       CASE WHEN quality IS NULL THEN 'Note '||doc_id END AS title,
       CASE WHEN quality = 0 THEN 'Short' END AS summary,
       CASE WHEN quality IS NULL THEN lang||','||source WHEN quality = 0 THEN lang ELSE '' END AS tags,
       CASE WHEN quality IS NULL THEN '#'||lang||',#'||source WHEN quality = 0 THEN '#'||lang ELSE '' END AS existing,
       sha1(body) AS body_sha1 FROM rich"""
CREATED = iso("mtime*1000")
ORACLES["ensure_frontmatter"] = f"""
WITH {RICH}
SELECT path AS file_path, {CREATED} AS created,
       CASE WHEN front <> '' THEN {rtrim('markdown')}
            ELSE '---'||chr(10)||'title: "'||doc_id||'"'||chr(10)||'created: '||{CREATED}||chr(10)||'---'||chr(10)||{rtrim('markdown')}
       END AS markdown FROM rich"""
ORACLES["generated_blocks"] = f"""
WITH {RICH}, m AS (SELECT *, contains(markdown, '{BLOCK_START}') AS marked FROM rich)
SELECT path AS file_path, sha1({strip('markdown')}) AS stripped,
       sha1(CASE WHEN marked THEN {rtrim(f"regexp_replace(regexp_replace(markdown, '{BLOCK}', '', 'g'), '{chr(92)}n{{3,}}', chr(10)||chr(10), 'g')")} ELSE markdown END) AS dropped,
       marked::BIGINT AS removed,
       sha1(CASE WHEN marked THEN {rtrim(f"regexp_replace(markdown, '{chr(92)}n{{3,}}', chr(10)||chr(10), 'g')")} ELSE markdown END) AS kept,
       0::BIGINT AS kept_removed,
       CASE WHEN marked THEN 'AI Summary'||chr(10)||chr(10)||'old '||doc_id ELSE '' END AS blocks,
       sha1(regexp_replace(regexp_replace(markdown, '<!--[{W}]*AI:BEGIN[{W}]*-->[{W}]*', '', 'g'),
            '[{W}]*<!--[{W}]*AI:END[{W}]*-->', '', 'g')) AS unwrapped
FROM m"""
ORACLES["wiki_links"] = f"""
WITH {RICH} SELECT path AS file_path, source||','||lang||'/index,x' AS links FROM rich"""


def normalized(x: str) -> str:
    bare = trim(f"regexp_replace({x}, '^[#{W}]+', '')")
    kept = trim(f"regexp_replace(lower({bare}), '[^a-z0-9{W}-]', '', 'g')")
    return f"'#'||regexp_replace({kept}, '[{W}]+', '-', 'g')"


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


TURN_TAGS = f"""
split AS (
  SELECT conv_id, turn, role,
         list_filter(list_transform(regexp_split_to_array(text, '[\\n,]+'),
           lambda p: {trim(f"regexp_replace(p, '^[-*][{W}]*', '')")}), lambda p: p <> '') AS cand,
         list_filter(list_transform(regexp_split_to_array(text, '[\\n,]'), lambda p: {trim('p')}), lambda p: p <> '') AS plain
  FROM conversations),
norm AS (
  SELECT *, list_filter(list_transform(cand, lambda p: {normalized('p')}), lambda p: p <> '#') AS n1,
         list_filter(list_transform(plain, lambda p: {normalized('p')}), lambda p: p <> '#') AS n2 FROM split),
tags AS (SELECT *, {distinct_in_order('n1')} AS t1, {distinct_in_order('n2')} AS t2 FROM norm)"""
ORACLES["normalize_tags"] = f"""
WITH {TURN_TAGS}
SELECT conv_id, turn, len(cand)::BIGINT AS candidates, array_to_string(t1[1:6], ',') AS tags,
       array_to_string(t2, ',') AS all_tags FROM tags"""
ORACLES["merge_tags"] = f"""
WITH {TURN_TAGS}, e AS (SELECT *, ['#'||role, '#turn-'||turn] AS old FROM tags)
SELECT conv_id, turn, array_to_string(old, ',') AS existing,
       array_to_string(list_filter(t1[1:6], lambda t: NOT list_contains(old, t))[1:4], ',') AS added FROM e"""
ORACLES["parse_responses"] = f"""
SELECT conv_id, turn, len(l)::BIGINT AS ids, 0::BIGINT AS broken_ids, sha1(array_to_string(l, '|')) AS from_json,
       array_to_string(list_filter(list_transform(l, lambda p: {trim('p')}), lambda p: p <> ''), '|') AS from_lines,
       array_to_string(list_filter(list_transform(string_split('* '||array_to_string(l, chr(10)||'- '), chr(10)),
         lambda p: {trim(f"regexp_replace(p, '^[*-][{W}]*', '')")}), lambda p: p <> ''), '|') AS from_bullets
FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations)"""
ORACLES["render_prompts"] = """
SELECT doc_id, sha1('Hi {{ text }} '||source||' ['||n_chars||'] '||text||'!') AS prompt_sha1 FROM documents"""
ORACLES["truncate_text"] = f"""
SELECT doc_id, {truncate('text', 1500)} AS snippet, least(length(text), 4000)::BIGINT AS prefix_chars FROM documents"""
ORACLES["path_labels"] = f"""
SELECT {PATH} AS file_path, {PATH} AS relative, source AS dir, doc_id::VARCHAR AS title,
       '[['||source||'/'||doc_id||']]' AS link FROM documents"""
ORACLES["time_labels"] = """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g')||'Z' AS iso,
       CASE WHEN ms < 1000 THEN ms||'ms' WHEN ms < 60000
            THEN printf('%.2fs', s + CASE WHEN s*8 = floor(s*8) THEN 0.001 ELSE 0 END)
            ELSE printf('%dm%.1fs', ms // 60000, r + CASE WHEN r*4 = floor(r*4) THEN 0.01 ELSE 0 END) END AS took
FROM (SELECT *, ms/1000::DOUBLE AS s, ms/1000::DOUBLE - (ms // 60000)*60 AS r
      FROM (SELECT *, floor(abs(value)*1000)::BIGINT AS ms FROM events))"""
ORACLES["length_gates"] = f"""
SELECT {PATH} AS file_path, length({trim('text')})::BIGINT AS units, length({trim('text')}) >= 120 AS tag,
       length({trim('text')}) >= 200 AS summary FROM documents"""
ORACLES["note_hygiene"] = f"""
WITH {RICH}, checks AS (
  SELECT path, unnest([
    CASE WHEN front = '' THEN {{'type': 'missing_frontmatter', 'detail': 'Add YAML frontmatter for consistent metadata.', 'seq': 1}} END,
    CASE WHEN NOT regexp_matches(body, '(?m)^#{{1,6}}[{W}]+') THEN {{'type': 'no_headings', 'detail': 'Add headings to improve chunk structure.', 'seq': 2}} END,
    CASE WHEN list_max(list_transform(string_split(regexp_replace(body, '\\n(#{{1,6}}[{W}])', chr(1)||'\\1', 'g'), chr(1)),
           lambda s: len(regexp_split_to_array(s, '[{W}]+')))) > 300
         THEN {{'type': 'long_section', 'detail': 'Section exceeds 300 tokens.', 'seq': 3}} END,
    CASE WHEN regexp_matches(body, '#{{1,6}}{DOT}*\\n[^\\n#]') THEN {{'type': 'separator', 'detail': 'Add blank lines after headings for consistent parsing.', 'seq': 4}} END,
    CASE WHEN NOT regexp_matches(body, '(?i)#{{1,3}}[{W}]+Summary') AND quality IS DISTINCT FROM 0
         THEN {{'type': 'missing_summary', 'detail': 'Add a summary heading or frontmatter summary.', 'seq': 5}} END
  ]) AS i FROM rich)
SELECT path, i.type AS type, i.detail AS detail, i.seq::BIGINT AS seq FROM checks WHERE i IS NOT NULL"""
ORACLES["hygiene_plain"] = ORACLES["note_hygiene"].replace(
    f"WITH {RICH}, checks", f"WITH rich AS (SELECT {PATH} AS path, '' AS front, text AS body, 1 AS quality FROM documents), checks"
)
ORACLES["journal_history"] = f"""
WITH turns AS (
  SELECT conv_id, turn, 'conv'||conv_id||'/turn'||turn||'.md' AS path, ({NOW_MS} - turn*604800000 - conv_id)::BIGINT AS ms,
         CASE WHEN {trim('text')} <> '' THEN CASE WHEN role = 'assistant' THEN 'Prior AI reflections:' ELSE 'User entry:' END
              ||chr(10)||chr(10)||{trim('text')} END AS content FROM conversations),
blocks AS (
  SELECT *, 'File: turn'||turn||'.md'||chr(10)||'Modified: '||{iso('ms')}||chr(10)||chr(10)||{truncate('content', 300)} AS block
  FROM turns WHERE content IS NOT NULL AND ms >= {NOW_MS} - 30*86400000::BIGINT),
run AS (
  SELECT t.path, b.block, b.ms, b.path AS other,
         sum(length(b.block)) OVER (PARTITION BY t.path ORDER BY b.ms DESC, b.path) AS total
  FROM turns t JOIN blocks b ON b.conv_id = t.conv_id AND b.path <> t.path)
SELECT t.path AS file_path, coalesce(string_agg(block, {text(chr(10)*2 + '---' + chr(10)*2)} ORDER BY r.ms DESC, other), '') AS recent_entries
FROM turns t LEFT JOIN (SELECT * FROM run WHERE total <= 2000) r ON r.path = t.path GROUP BY t.path"""

# --- index -----------------------------------------------------------------------------------

FILES = f"""
files AS (
  SELECT {PATH.replace('doc_id', 'd.doc_id')} AS path, {EPOCH} + d.doc_id*{HOUR} - (quality = 0)::INT AS mtime
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id
  UNION ALL SELECT 'pages/'||page_id||'.md', {EPOCH} FROM pages),
status AS (
  SELECT coalesce(n.path, f.path) AS path,
         CASE WHEN n.path IS NULL THEN 'removed' WHEN f.path IS NULL THEN 'new'
              WHEN n.mtime = f.mtime THEN 'unchanged' ELSE 'changed' END AS status
  FROM (SELECT {PATH} AS path, {MTIME} AS mtime FROM documents) n FULL JOIN files f ON n.path = f.path)"""
ORACLES["index_status"] = f"WITH {FILES} SELECT path, status FROM status"
ORACLES["index_counters"] = f"""
WITH {FILES} SELECT count(*) FILTER (status = 'new') AS fresh, count(*) FILTER (status = 'changed') AS changed,
  count(*) FILTER (status = 'unchanged') AS skipped, count(*) FILTER (status = 'removed') AS removed FROM status"""
OLD_SOURCE = f"""SELECT {PATH.replace('doc_id', 'd.doc_id')} AS path, d.doc_id, 0 AS mtime,
  CASE WHEN quality = 0 THEN text||' '||text ELSE text END AS text FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""
OLD_CHUNKS = plain_chunks(OLD_SOURCE).replace("plain AS", "old_plain AS").replace("FROM plain", "FROM old_plain").replace("chunks AS", "stored AS")
INDEX = f"WITH {plain_chunks(DOC_SOURCE)}, {OLD_CHUNKS}"
ORACLES["index_reuse"] = f"""{INDEX}
SELECT c.chunk_id, c.file_path, coalesce(s.content_hash = c.content_hash, FALSE) AS reused,
       CASE WHEN s.content_hash = c.content_hash THEN 2 ELSE 0 END::BIGINT AS dimensions
FROM chunks c LEFT JOIN stored s ON s.chunk_id = c.chunk_id"""
ORACLES["index_run"] = f"""{INDEX}, {FILES},
todo AS (SELECT path FROM status WHERE status IN ('new', 'changed'))
SELECT count(*) FILTER (status <> 'removed') AS total_files,
  count(*) FILTER (status IN ('new', 'changed')) AS processed,
  count(*) FILTER (status = 'unchanged') AS skipped, count(*) FILTER (status = 'removed') AS removed, 0::BIGINT AS failed,
  (SELECT count(*) FROM chunks WHERE file_path IN (SELECT path FROM todo)) AS chunks_upserted,
  (SELECT count(*) FROM stored WHERE file_path IN (SELECT path FROM todo)
   AND chunk_id NOT IN (SELECT chunk_id FROM chunks)) AS chunks_deleted FROM status"""
ORACLES["index_stale"] = f"""{INDEX}
SELECT chunk_id, file_path FROM stored WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks)"""
ORACLES["index_upsert"] = f"{INDEX} SELECT chunk_id, file_path, content_hash, tokens FROM chunks"
ORACLES["index_postings"] = f"""{INDEX},
tokens AS (SELECT chunk_id, {terms('content')} AS toks FROM chunks),
each AS (SELECT chunk_id, len(toks) AS length, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM tokens)
SELECT term, chunk_id, length::BIGINT AS length, count(*) AS tf, max(pos)::BIGINT AS last_position FROM each GROUP BY ALL"""
CHUNK_TERMS = f"""tokens AS (SELECT chunk_id, file_path, {terms('content')} AS toks FROM chunks),
each AS (SELECT chunk_id, file_path, unnest(toks) AS term FROM tokens)"""
ORACLES["index_statistics"] = f"""{INDEX}, {CHUNK_TERMS}
SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM each GROUP BY term"""
ORACLES["index_committed"] = f"""{INDEX}, {CHUNK_TERMS}
SELECT 'chunks' AS part, chunk_id AS key, file_path, content_hash, tokens::BIGINT AS n FROM chunks
UNION ALL
SELECT 'files', c.file_path, c.file_path,
       string_agg(c.content_hash, ':' ORDER BY coalesce(s.content_hash = c.content_hash, FALSE) DESC, c.ordinal), count(*)
FROM chunks c LEFT JOIN stored s ON s.chunk_id = c.chunk_id GROUP BY c.file_path
UNION ALL SELECT 'postings', chunk_id, file_path, NULL, count(*) FROM each GROUP BY chunk_id, file_path"""
ORACLES["index_file_states"] = f"""{INDEX}
SELECT c.file_path AS path, max(c.mtime)::BIGINT AS mtime, count(*) AS chunk_count,
       string_agg(c.content_hash, ':' ORDER BY coalesce(s.content_hash = c.content_hash, FALSE) DESC, c.ordinal) AS content_hash
FROM chunks c LEFT JOIN stored s ON s.chunk_id = c.chunk_id GROUP BY c.file_path"""

# --- writers ---------------------------------------------------------------------------------

STAMP = f"'Generated: '||{iso(str(NOW_MS))}||chr(10)||chr(10)"
CLEANED = f"""
cleaned AS (
  SELECT *, substr(cleaned, length(front) + 1) AS clean_body,
         CASE WHEN quality IS NULL THEN 'Note '||doc_id ELSE doc_id::VARCHAR END AS title
  FROM (SELECT *, {trim('(' + strip('markdown') + ')')} AS cleaned FROM rich))"""


def reply(prompt: str) -> str:
    return f"'response '||sha1({prompt})"


SUMMARY_PROMPT = render(
    P.summarization, {"path": "path", "title": "title", "context": trim("clean_body")}
)
ORACLES["summarize_notes"] = f"""
WITH {RICH}, {CLEANED}, replied AS (
  SELECT *, {reply(SUMMARY_PROMPT)} AS reply,
         {rtrim(f"CASE WHEN toxic = 1 THEN regexp_replace(regexp_replace(markdown, '{BLOCK}', '', 'g'), '{chr(92)}n{{3,}}', chr(10)||chr(10), 'g') ELSE markdown END")} AS base
  FROM cleaned)
SELECT path AS file_path, CASE WHEN length(cleaned) >= 200 THEN 'updated' ELSE 'skipped' END AS status,
       CASE WHEN length(cleaned) < 200 THEN 'Too short for summary: '||length(cleaned)||' of 200 characters.' END AS message,
       CASE WHEN length(cleaned) >= 200 THEN base||{text(chr(10)*2 + BLOCK_START + chr(10) + 'AI Summary' + chr(10)*2)}||{STAMP}||reply
            ||{text(chr(10) + BLOCK_END + chr(10)*2)} END AS new_markdown
FROM replied"""
TAG_PROMPT = render(P.tagging, {"title": "path", "context": "tag_text", "tag_limit": "'6'"})
ORACLES["tag_notes"] = f"""
WITH {RICH}, c AS (SELECT *, {trim('(' + strip('body') + ')')} AS tag_text FROM rich),
replied AS (SELECT *, replace({reply(TAG_PROMPT)}, ' ', '-') AS tag FROM c)
SELECT path AS file_path, CASE WHEN length(tag_text) >= 120 THEN 'updated' ELSE 'skipped' END AS status,
       CASE WHEN length(tag_text) < 120 THEN 'Too short for tagging: '||length(tag_text)||' of 120 characters.' END AS message,
       CASE WHEN length(tag_text) >= 120 THEN '---'||chr(10)
         ||CASE WHEN quality IS NULL THEN 'title: Note '||doc_id||chr(10) WHEN quality = 0 THEN 'summary: Short'||chr(10) ELSE '' END
         ||'tags:'||chr(10)||CASE WHEN quality IS NULL OR quality = 0 THEN '  - "#'||lang||'"'||chr(10) ELSE '' END
         ||CASE WHEN quality IS NULL THEN '  - "#'||source||'"'||chr(10) ELSE '' END
         ||'  - "#'||tag||'"'||chr(10)||'---'||chr(10)||body END AS new_markdown
FROM replied"""
REWORK_PROMPT = render(
    P.rework,
    {"path": "path", "title": "title", "context": "markdown", "created_at": CREATED, "modified_at": CREATED},
)
ORACLES["rework_notes"] = f"""
WITH {RICH}, {CLEANED}
SELECT path AS file_path, 'updated' AS status, NULL::VARCHAR AS message,
       '---'||chr(10)||'title: '||CASE WHEN quality IS NULL THEN title ELSE '"'||title||'"' END||chr(10)||'created: '||{CREATED}
       ||chr(10)||'---'||chr(10)||{reply(REWORK_PROMPT)}||chr(10) AS new_markdown
FROM cleaned"""

# --- plans with model calls: the stand-in's embedding and responses are SQL as well --------------


def stand_in_vectors(name: str, texts: str) -> str:
    """CTEs ending in ``name(id, vector)`` for ``texts(id, t)``: hashed bag of words, unit length."""
    return f"""
{name}_texts AS ({texts}),
{name}_slots AS (
  SELECT id, ('0x'||substr(h, 1, 8))::BIGINT % 64 AS slot,
         sum(CASE WHEN contains('13579bdf', substr(h, 10, 1)) THEN 1 ELSE -1 END)::DOUBLE AS v
  FROM (SELECT id, sha1(unnest({words('lower(t)')})) AS h FROM {name}_texts) GROUP BY ALL),
{name}_raw AS (
  SELECT i.id, list(coalesce(v, 0) ORDER BY r.range) AS vec
  FROM (SELECT DISTINCT id FROM {name}_texts) i CROSS JOIN range(64) r
  LEFT JOIN {name}_slots s ON s.id = i.id AND s.slot = r.range GROUP BY i.id),
{name} AS (
  SELECT id, CASE WHEN sqrt(list_inner_product(vec, vec)) > 0
                  THEN list_transform(vec, lambda x: x/sqrt(list_inner_product(vec, vec))) ELSE vec END AS vector
  FROM {name}_raw)"""


def collapsed(x: str) -> str:
    """What is left of a note in which no block was replaced."""
    return rtrim(
        f"CASE WHEN contains({x}, '{BLOCK_START}') THEN regexp_replace({x}, '\\n{{3,}}', chr(10)||chr(10), 'g') ELSE {x} END"
    )


def block(title: str, reply_sql: str) -> str:
    return f"{text(chr(10)*2 + BLOCK_START + chr(10) + title + chr(10)*2)}||{STAMP}||{reply_sql}||{text(chr(10) + BLOCK_END + chr(10)*2)}"


def related_lists(vectors: str) -> str:
    """CTE ``related_lists(id, context)``: the five closest source files as lines."""
    return f"""
related_best AS (
  SELECT v.id, c.file_path AS path, max(round({cosine('c.emb', 'v.vector')}, 12)) AS score
  FROM {vectors} v, corpus c GROUP BY ALL),
related_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, path) AS rank FROM related_best),
related_lists AS (
  SELECT id, string_agg(rank||'. [['||regexp_replace(path, '\\.md$', '')||']] (score '||printf('%.1f', score*100)||'%)',
                        chr(10) ORDER BY rank) AS context
  FROM related_ranked WHERE rank <= 5 GROUP BY id)"""


RELATED_PROMPT = render(P.related, {"title": "doc_id||'.md'", "context": "context"})
ORACLES["related_notes"] = f"""
WITH {RICH}, {CLEANED}, {CORPUS},
{stand_in_vectors('note_vectors', 'SELECT path AS id, substr(cleaned, 1, 4000) AS t FROM cleaned WHERE length(cleaned) >= 200')},
{related_lists('note_vectors')}
SELECT path AS file_path, CASE WHEN context IS NULL THEN 'skipped' ELSE 'updated' END AS status,
       CASE WHEN context IS NULL THEN 'Too short for related content: '||length(cleaned)||' of 200 characters.' END AS message,
       CASE WHEN context IS NOT NULL THEN {collapsed('markdown')}||{block('AI Related Content', reply(RELATED_PROMPT))} END AS new_markdown
FROM cleaned LEFT JOIN related_lists r ON r.id = path"""

SUMMARIZED = ORACLES["summarize_notes"].split("SELECT path AS file_path", 1)[0]
ENRICH_TAG_PROMPT = render(P.tagging, {"title": "path", "context": "tag_text", "tag_limit": "'6'"})
ORACLES["enrich_notes"] = f"""{SUMMARIZED.rstrip()},
one AS (
  SELECT *, length(cleaned) >= 200 AS summary,
         CASE WHEN length(cleaned) >= 200 THEN base||{block('AI Summary', 'reply')} ELSE markdown END AS text1
  FROM replied),
two AS (
  SELECT *, substr(text1, length(front) + 1) AS body1,
         {trim('(' + strip('substr(text1, length(front) + 1)') + ')')} AS tag_text FROM one),
three AS (
  SELECT *, length(tag_text) >= 120 AS tags,
         CASE WHEN length(tag_text) >= 120 THEN '---'||chr(10)
           ||CASE WHEN quality IS NULL THEN 'title: Note '||doc_id||chr(10) WHEN quality = 0 THEN 'summary: Short'||chr(10) ELSE '' END
           ||'tags:'||chr(10)||CASE WHEN quality IS NULL OR quality = 0 THEN '  - "#'||lang||'"'||chr(10) ELSE '' END
           ||CASE WHEN quality IS NULL THEN '  - "#'||source||'"'||chr(10) ELSE '' END
           ||'  - "#'||replace({reply(ENRICH_TAG_PROMPT)}, ' ', '-')||'"'||chr(10)||'---'||chr(10)||body1
         ELSE text1 END AS text2 FROM two),
four AS (SELECT *, {trim('(' + strip('text2') + ')')} AS cleaned2 FROM three),
{CORPUS},
{stand_in_vectors('note_vectors', 'SELECT path AS id, substr(cleaned2, 1, 4000) AS t FROM four WHERE length(cleaned2) >= 200')},
{related_lists('note_vectors')},
five AS (
  SELECT *, context IS NOT NULL AS related,
         CASE WHEN context IS NOT NULL THEN {collapsed('text2')}||{block('AI Related Content', reply(RELATED_PROMPT))} ELSE text2 END AS text3
  FROM four LEFT JOIN related_lists r ON r.id = path)
SELECT path AS file_path, CASE WHEN summary OR tags OR related THEN 'updated' ELSE 'skipped' END AS status,
       'summary='||CASE WHEN summary THEN 'updated' ELSE 'skipped' END||' tags='||CASE WHEN tags THEN 'updated' ELSE 'skipped' END
       ||' related='||CASE WHEN related THEN 'updated' ELSE 'skipped' END AS message,
       CASE WHEN summary OR tags OR related THEN text3 END AS new_markdown FROM five"""

CONTEXT_ROWS = f"{HEAD}||chr(10)||content, {text(chr(10)*2 + '---' + chr(10)*2)} ORDER BY label"
TODAY = truncate("cleaned", 4000)
JOURNAL_PROMPT = render(
    P.journal,
    {
        "path": "path", "title": "title", "today_entry": "today", "history_days": "'30'",
        "recent_entries": "coalesce(recent, 'No other journal entries found in the last month.')",
        "knowledge_context": "coalesce(knowledge, 'No indexed context available.')",
    },
)
ORACLES["journal_notes"] = f"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, 'conv'||conv_id||'/turn'||turn||'.md' AS path, 'turn'||turn AS title,
         ({NOW_MS} - turn*604800000 - conv_id)::BIGINT AS ms,
         CASE WHEN role = 'assistant' THEN '{BLOCK_START}'||chr(10)||text||chr(10)||'{BLOCK_END}' ELSE text END AS markdown,
         CASE WHEN role = 'assistant' THEN '' ELSE {trim('text')} END AS cleaned,
         CASE WHEN {trim('text')} <> '' THEN CASE WHEN role = 'assistant' THEN 'Prior AI reflections:' ELSE 'User entry:' END
              ||chr(10)||chr(10)||{trim('text')} END AS content FROM conversations),
blocks AS (
  SELECT *, 'File: turn'||turn||'.md'||chr(10)||'Modified: '||{iso('ms')}||chr(10)||chr(10)||{truncate('content', 1500)} AS block
  FROM turns WHERE content IS NOT NULL AND ms >= {NOW_MS} - 30*86400000::BIGINT),
run AS (
  SELECT t.path, b.block, b.ms, b.path AS other,
         sum(length(b.block)) OVER (PARTITION BY t.path ORDER BY b.ms DESC, b.path) AS total
  FROM turns t JOIN blocks b ON b.conv_id = t.conv_id AND b.path <> t.path),
history AS (
  SELECT path, string_agg(block, {text(chr(10)*2 + '---' + chr(10)*2)} ORDER BY ms DESC, other) AS recent
  FROM run WHERE total <= 12000 GROUP BY path),
ready AS (SELECT *, CASE WHEN length(cleaned) >= 200 THEN {TODAY} END AS today FROM turns),
asked AS (SELECT path AS query_id, title||chr(10)||today AS question FROM ready WHERE today IS NOT NULL),
{stand_in_vectors('asked_vectors', 'SELECT query_id AS id, question AS t FROM asked')},
jq AS (SELECT query_id, question, vector FROM asked JOIN asked_vectors ON id = query_id),
{hybrid('jq', CORPUS)},
{packed('SELECT f.query_id, f.chunk_id, f.rank, c.tokens FROM final f JOIN corpus c ON c.chunk_id = f.chunk_id')},
known AS (SELECT query_id, string_agg({CONTEXT_ROWS}) AS knowledge
          FROM packed p JOIN corpus c ON c.chunk_id = p.chunk_id GROUP BY query_id),
full_rows AS (SELECT r.*, recent, knowledge FROM ready r LEFT JOIN history h ON h.path = r.path LEFT JOIN known k ON k.query_id = r.path)
SELECT path AS file_path, CASE WHEN today IS NULL THEN 'skipped' ELSE 'updated' END AS status,
       CASE WHEN today IS NULL THEN 'Too short for journal reflection: '||length(cleaned)||' of 200 characters.' END AS message,
       CASE WHEN today IS NOT NULL THEN {collapsed('markdown')}||{block('AI Journal Reflection', reply(JOURNAL_PROMPT))} END AS new_markdown
FROM full_rows"""

_CTE_NAMES = (
    "vec|d|corpus_stats|tf|df|idf|qt|qn|matched|lex_all|lex|kept|fused|capped|pool|picks|final|seq|fold|packed"
)


def renamed(sql: str, suffix: str) -> str:
    """A second copy of a pipeline's CTEs in the same statement."""
    return re.sub(rf"(?<![\w'])({_CTE_NAMES})(?![\w'(])", rf"\1_{suffix}", sql)


PACK_MERGED = "SELECT m.query_id, m.chunk_id, m.rank, c.tokens FROM {0} m JOIN corpus c ON c.chunk_id = m.chunk_id"


def merged(name: str, base: str, extra: str) -> str:
    return f"""
{name} AS (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank
  FROM (SELECT query_id, chunk_id, max(score) AS score, min(seen) AS seen FROM (
          SELECT query_id, chunk_id, score, rank AS seen FROM ({base})
          UNION ALL SELECT query_id, chunk_id, score, 1000000 + rank FROM ({extra})) GROUP BY ALL))"""


def context_cte(name: str, packs: str) -> str:
    return f"""
{name} AS (
  SELECT query_id, string_agg({CONTEXT_ROWS}) AS context, string_agg({HEAD}, chr(10) ORDER BY label) AS lines,
         count(*) AS cited FROM {packs} p JOIN corpus c ON c.chunk_id = p.chunk_id GROUP BY query_id)"""


REWRITE = render(P.query_rewrite, {"question": "text"})
GAP = render(P.iterative_gap, {"question": "text", "context": "context"})
QA = render(P.qa, {"question": "text", "context": f"(context||{text(chr(10)*2 + 'Citations:' + chr(10))}||lines)"})
ORACLES["answer_questions"] = f"""
WITH RECURSIVE first_wave AS (
  SELECT item_id::VARCHAR AS query_id, text AS question FROM benchmark
  UNION ALL SELECT item_id||'#rewrite', {reply(REWRITE)} FROM benchmark),
{stand_in_vectors('wave_vectors', 'SELECT query_id AS id, question AS t FROM first_wave')},
q1 AS (SELECT query_id, question, vector FROM first_wave JOIN wave_vectors ON id = query_id),
{hybrid('q1', CORPUS)},
{merged('m1', "SELECT * FROM final WHERE NOT contains(query_id, '#')", "SELECT split_part(query_id, '#', 1) AS query_id, chunk_id, score, rank FROM final WHERE contains(query_id, '#')")},
{packed(PACK_MERGED.format('m1'))},
{context_cte('c1', 'packed')},
second_wave AS (SELECT query_id, {reply(GAP)} AS question FROM c1 JOIN benchmark ON item_id::VARCHAR = query_id),
{stand_in_vectors('gap_vectors', 'SELECT query_id AS id, question AS t FROM second_wave')},
q2 AS (SELECT query_id, question, vector FROM second_wave JOIN gap_vectors ON id = query_id),
{renamed(hybrid('q2', '').lstrip().removeprefix(','), 'b')},
{merged('m2', 'SELECT * FROM m1', 'SELECT * FROM final_b')},
{renamed(packed(PACK_MERGED.format('m2')), 'b')},
{context_cte('c2', 'packed_b')}
SELECT query_id, {reply(QA)} AS answer, context, cited FROM c2 JOIN benchmark ON item_id::VARCHAR = query_id"""
ORACLES["eval_answers"] = ORACLES["answer_questions"].rsplit("SELECT query_id,", 1)[0].rstrip() + f""",
got AS (SELECT query_id, list(file_path ORDER BY label) AS paths
        FROM packed_b p JOIN corpus c ON c.chunk_id = p.chunk_id GROUP BY query_id),
scored AS (
  SELECT coalesce(list_contains(paths[1:12], source||'.md'), FALSE)::INT::DOUBLE AS hit,
         CASE WHEN coalesce(len(paths), 0) = 0 THEN 0.0::DOUBLE
              ELSE len(list_filter(paths, lambda p: p = source||'.md'))::DOUBLE/len(paths) END AS c
  FROM benchmark JOIN documents ON doc_id = item_id LEFT JOIN got ON query_id = item_id::VARCHAR)
SELECT round(sum(hit)/count(*), 6) AS recall_at_k, round(sum(c)/count(*), 6) AS citation_accuracy FROM scored"""
