"""DuckDB SQL that states, independently of the Spark code, what each
registered query must return.  Used by ``__spark_entry__.oracle_sql`` and the
tests.  Tables are the driver's parquet files registered as views.
"""

from __future__ import annotations

DIM = 64


def hash_embed_ctes(name: str, src: str, id_expr: str, text_expr: str = "text",
                    dim: int = DIM) -> str:
    """CTEs ``<name>`` (id, b, w): the sparse hash embedding of ``src``.

    Token = lower-cased text split on blanks; bucket = first four hex digits
    of MD5 mod dim; weight = count / L2 norm of the counts.
    """
    return f"""
{name}_tok AS (
  SELECT {id_expr} AS id, unnest(string_split_regex(lower({text_expr}), '[ \\t\\n\\r]+')) AS tok
  FROM {src}),
{name}_cnt AS (
  SELECT id, ('0x' || substr(md5(tok), 1, 4))::INTEGER % {dim} AS b, count(*)::DOUBLE AS c
  FROM {name}_tok WHERE tok <> '' GROUP BY id, b),
{name} AS (
  SELECT id, b, c / greatest(sqrt(sum(c * c) OVER (PARTITION BY id)), 1e-12) AS w FROM {name}_cnt)"""


USER_Q = """(SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS question_id, text
            FROM conversations WHERE role = 'user')"""
DOC_PATH = "'/data/' || source || '/' || doc_id::VARCHAR || '.txt'"


def best_context(k: int = 5) -> str:
    return f"""
WITH {hash_embed_ctes('qv', USER_Q, 'question_id')},
{hash_embed_ctes('dv', 'documents', 'doc_id')},
qi AS (SELECT question_id AS id FROM {USER_Q}),
di AS (SELECT doc_id AS id FROM documents),
{topk_ctes('hits', 'qv', 'qi', 'dv', 'di', k, 'cosine')}
SELECT u.question_id, h.id AS doc_id, {DOC_PATH} AS path, round(h.score, 6) AS score,
       d.text AS context, d.doc_id IS NULL AS missing
FROM {USER_Q} u LEFT JOIN hits h ON h.question_id = u.question_id AND h.rank = 1
LEFT JOIN documents d ON d.doc_id = h.id"""


# ---- pages / URLs ------------------------------------------------------------
STRIP = "trim(url, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
VALID = "regexp_matches({u}, '^[a-z][a-z0-9+.-]*://')"
TLD = "regexp_extract({u}, '^([a-z][a-z0-9+.-]*://[^/?#]*)', 1)"
NO_HTML = "CASE WHEN ends_with({u}, '.html') THEN left({u}, length({u}) - 5) ELSE {u} END"


def path_sql(u: str) -> str:
    t = f"string_split(regexp_replace({u}, '^/+|/+$', '', 'g'), '/')"
    return (f"array_to_string(list_concat(['/data'], "
            f"list_filter({t}[1:len({t}) - 1], lambda p: p <> ''), [{t}[-1] || '.txt']), '/')")


def links() -> str:
    return f"""
SELECT DISTINCT url FROM (SELECT {STRIP} AS url FROM pages)
WHERE url <> '' AND {VALID.format(u='url')}"""


def page_files() -> str:
    return f"""
WITH u AS (SELECT page_id, {STRIP} AS url FROM pages),
f AS (SELECT url, min(page_id) AS first_id FROM u
      WHERE url <> '' AND {VALID.format(u='url')} GROUP BY url),
p AS (SELECT url, first_id, {path_sql(NO_HTML.format(u='url'))} AS path FROM f),
w AS (SELECT path, arg_max(url, first_id) AS url, max(first_id) AS page_id FROM p GROUP BY path)
SELECT path, url, page_id, {TLD.format(u='url')} AS tld FROM w"""


def page_references() -> str:
    path = path_sql(NO_HTML.format(u='url'))
    return f"""
SELECT page_id, url, {TLD.format(u='url')} AS tld, {path} AS path,
       '[Reference 1](' || replace(replace({path}, '/data/https:/', 'https://'), '.txt', '.html') || ')'
         AS reference
FROM pages WHERE {VALID.format(u='url')}"""


# ---- cleaning and chunking ---------------------------------------------------
CLEAN = "regexp_replace({t}, '[^A-Za-z0-9 .,?!]', '', 'g')"
LINES = "regexp_replace({t}, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]', ' ', 'g')"


def words_sql(t: str, route: str = "txt") -> str:
    if route == "pdf":
        t = LINES.format(t=t)
    return f"list_filter(string_split({CLEAN.format(t=t)}, ' '), lambda x: x <> '')"


def chunks(route: str = "txt", step: int = 500) -> str:
    """Greedy rule as a recursive query: each chunk start joins the running
    maximum of sentence-end positions at min(start + step, n - 1)."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {words_sql('text', route)} AS w FROM documents),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
pb AS (SELECT doc_id, pos,
              max(CASE WHEN right(word, 1) IN ('.', '!', '?') THEN pos END)
                OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pb
       FROM pos),
n AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
ch(doc_id, chunk_ix, st, e, n) AS (
  SELECT n.doc_id, 0, 0, CASE WHEN pb.pb > 0 THEN pb.pb ELSE least({step}, n.n - 1) END, n.n
  FROM n JOIN pb ON pb.doc_id = n.doc_id AND pb.pos = least({step}, n.n - 1)
  UNION ALL
  SELECT ch.doc_id, ch.chunk_ix + 1, ch.e + 1,
         CASE WHEN pb.pb > ch.e + 1 THEN pb.pb ELSE least(ch.e + 1 + {step}, ch.n - 1) END, ch.n
  FROM ch JOIN pb ON pb.doc_id = ch.doc_id AND pb.pos = least(ch.e + 1 + {step}, ch.n - 1)
  WHERE ch.e < ch.n - 1)
SELECT ch.doc_id, ch.chunk_ix::INTEGER AS chunk_ix, ch.st::INTEGER AS start_word, ch.e::INTEGER AS end_word,
       (ch.e - ch.st + 1)::INTEGER AS n_words,
       array_to_string(d.w[ch.st + 1 : ch.e + 1], ' ') AS text,
       sha256(ch.doc_id::VARCHAR || ':' || ch.chunk_ix::VARCHAR) AS chunk_id
FROM ch JOIN d USING (doc_id)"""


def chunk_counts() -> str:
    c = chunks()
    return f"""
WITH c AS ({c})
SELECT doc_id, count(*) AS n_chunks, max(n_words) AS max_words FROM c GROUP BY doc_id"""


def text_stats() -> str:
    return f"""
SELECT doc_id, length(text)::BIGINT AS n_chars,
       length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))::BIGINT AS ascii_chars,
       length({CLEAN.format(t='text')})::BIGINT AS clean_chars,
       len({words_sql('text')})::BIGINT AS words_txt,
       len({words_sql('text', 'pdf')})::BIGINT AS words_pdf
FROM documents"""


def length_summary() -> str:
    return """
SELECT lang, min(length(text))::BIGINT AS min_chars, round(avg(length(text)), 4) AS avg_chars,
       max(length(text))::BIGINT AS max_chars, count(*) AS n_docs
FROM documents GROUP BY lang"""


# ---- index loads -------------------------------------------------------------
def first_store() -> str:
    return f"""
WITH {hash_embed_ctes('dv', 'documents', 'doc_id')},
es AS (SELECT id, sum(w) AS s FROM dv GROUP BY id),
b AS (SELECT substr(text, 1, 512) AS id, {DOC_PATH} AS file_path,
             CAST(substr(source, 4) AS INTEGER) AS batch_no, doc_id FROM documents),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch_no DESC, file_path DESC) AS rn
                     FROM b) WHERE rn = 1)
SELECT w.id, w.file_path, w.batch_no, 'hash-64' AS embedding_model, 64 AS n_dims,
       round(coalesce(es.s, 0), 6) AS emb_sum
FROM w LEFT JOIN es ON es.id = w.doc_id"""


def first_store_subwords() -> str:
    """The first 256 pieces of four characters, mean of the MD5 bytes' vectors, unit length."""
    return f"""
WITH b AS (SELECT substr(text, 1, 512) AS id, {DOC_PATH} AS file_path, CAST(substr(source, 4) AS INTEGER) AS batch_no, doc_id, text FROM documents),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch_no DESC, file_path DESC) AS rn FROM b) WHERE rn = 1),
words AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '')[1:256] AS l FROM w),
toks AS (SELECT doc_id, unnest(flatten(list_transform(l, lambda x: list_transform(range(0, (length(x) + 3) // 4),
                lambda i: CASE WHEN i > 0 THEN '##' ELSE '' END || substr(x, i * 4 + 1, 4))))[1:256]) AS tok FROM words),
cnt AS (SELECT doc_id, tok, count(*) AS c FROM toks GROUP BY ALL),
vec AS (SELECT tok, j, ('0x' || substr(md5((j // 16)::VARCHAR || ':' || tok), 2 * (j % 16) + 1, 2))::INTEGER / 127.5 - 1 AS v
        FROM (SELECT DISTINCT tok FROM cnt), range(0, {DIM}) AS r(j)),
pooled AS (SELECT doc_id, j, sum(c * v) / greatest(sum(c), 1e-9) AS x FROM cnt JOIN vec USING (tok) GROUP BY doc_id, j),
unit AS (SELECT doc_id, j, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 1e-12) AS x FROM pooled),
e AS (SELECT doc_id, sum(x) AS s, max(x) FILTER (j = 0) AS f, max(x) FILTER (j = {DIM} - 1) AS l FROM unit GROUP BY doc_id)
SELECT w.id, w.file_path, w.batch_no, round(coalesce(f, 0), 6) AS emb_first, round(coalesce(l, 0), 6) AS emb_last,
       'subword-{DIM}' AS embedding_model, {DIM} AS n_dims, round(coalesce(s, 0), 6) AS emb_sum
FROM w LEFT JOIN e USING (doc_id)"""


def second_store() -> str:
    ch = chunks()
    return f"""
WITH ch AS ({ch.replace('WITH RECURSIVE', 'WITH RECURSIVE', 1)}),
rows AS (
  SELECT doc_id, -1 AS chunk_ix, {DOC_PATH} AS path, text, 0 AS batch_no FROM documents
  UNION ALL
  SELECT doc_id, chunk_ix, '/data/doc_' || chunk_id || '.txt' AS path, text, 1 AS batch_no FROM ch),
keyed AS (SELECT row_number() OVER () AS rid, path AS id, * FROM rows),
{hash_embed_ctes('ev', 'keyed', 'rid')},
es AS (SELECT id, sum(w) AS s FROM ev GROUP BY id),
cls AS (SELECT DISTINCT doc_id, 'restricted' AS c FROM labels WHERE toxic = 1),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch_no, doc_id, chunk_ix) AS rn
                     FROM keyed) WHERE rn = 1)
SELECT w.id, coalesce(cls.c, 'public') AS classification, w.batch_no, w.doc_id, w.chunk_ix::INTEGER AS chunk_ix,
       'hash-64' AS embedding_model, 64 AS n_dims, round(coalesce(es.s, 0), 6) AS emb_sum
FROM w LEFT JOIN es ON es.id = w.rid LEFT JOIN cls ON cls.doc_id = w.doc_id"""


def pathless_store() -> str:
    return f"""
WITH k AS (SELECT substr(text, 1, 50) AS id, text AS document, conv_id, turn FROM conversations),
w AS (SELECT row_number() OVER () AS rid, * FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY conv_id, turn, document) AS rn FROM k) WHERE rn = 1),
{hash_embed_ctes('ev', 'w', 'rid', 'document')},
es AS (SELECT id, sum(w) AS s FROM ev GROUP BY id)
SELECT w.id, 'public' AS classification, conv_id, turn, 'hash-64' AS embedding_model, 64 AS n_dims,
       round(coalesce(es.s, 0), 6) AS emb_sum
FROM w LEFT JOIN es ON es.id = w.rid"""


def first_store_reload() -> str:
    """Later load first: its rows win wherever the 512-character key is equal."""
    return f"""
WITH d AS (SELECT doc_id, {DOC_PATH} AS path, text, CAST(substr(source, 4) AS INTEGER) AS b FROM documents),
r AS (SELECT doc_id, path, text, b AS batch_no, 1 AS load FROM d WHERE b % 2 = 0
      UNION ALL SELECT doc_id, path, text, -1, 2 FROM d WHERE b % 2 <> 0
      UNION ALL SELECT doc_id, '/a' || path, substr(text, 1, 512) || ' changed', -1, 3 FROM d WHERE b % 2 = 0 AND doc_id % 10 = 0),
w AS (SELECT row_number() OVER () AS rid, * FROM (
  SELECT substr(text, 1, 512) AS id, *,
         row_number() OVER (PARTITION BY substr(text, 1, 512) ORDER BY load DESC, batch_no DESC, path DESC) AS rn FROM r) WHERE rn = 1),
{hash_embed_ctes('ev', 'w', 'rid')},
es AS (SELECT id, sum(w) AS s FROM ev GROUP BY id)
SELECT w.id, path AS file_path, batch_no, 'hash-64' AS embedding_model, 64 AS n_dims, round(coalesce(es.s, 0), 6) AS emb_sum
FROM w LEFT JOIN es ON es.id = w.rid"""


def second_store_reload() -> str:
    """A path keeps its first load's text; only unknown paths are added."""
    return f"""
WITH d AS (SELECT doc_id, {DOC_PATH} AS path, text, CAST(substr(source, 4) AS INTEGER) AS b FROM documents),
r AS (SELECT path, text, b AS batch_no, 1 AS load FROM d WHERE b % 2 = 0
      UNION ALL SELECT path, text, b, 2 FROM d WHERE b % 2 <> 0
      UNION ALL SELECT path, text || ' changed', b, 3 FROM d WHERE b % 2 = 0 AND doc_id % 10 = 0),
w AS (SELECT row_number() OVER () AS rid, * FROM (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY load, batch_no, text) AS rn FROM r) WHERE rn = 1),
{hash_embed_ctes('ev', 'w', 'rid')},
es AS (SELECT id, sum(w) AS s FROM ev GROUP BY id)
SELECT path AS id, 'public' AS classification, md5(text) AS document_md5, batch_no, 'hash-64' AS embedding_model,
       64 AS n_dims, round(coalesce(es.s, 0), 6) AS emb_sum
FROM w LEFT JOIN es ON es.id = w.rid"""


def index_stats() -> str:
    return f"""
SELECT 'hash-64' AS embedding_model, count(DISTINCT substr(text, 1, 512)) AS total_vector_count,
       64 AS min_dim, 64 AS max_dim, 'first' AS store FROM documents
UNION ALL
SELECT 'hash-64', count(DISTINCT id), 64, 64, 'second' FROM (
  SELECT {DOC_PATH} AS id FROM documents
  UNION ALL SELECT '/data/doc_' || chunk_id || '.txt' FROM ({chunks()}))"""


def ann_check() -> str:
    """What the approximate index must reach: all rows, at least nine of ten exact hits, exact scores."""
    return """
SELECT (SELECT count(*) FROM conversations WHERE role = 'user') AS questions, (SELECT count(*) FROM documents) AS rows_indexed,
       (SELECT count(*) FROM conversations WHERE role = 'user') * least(5, (SELECT count(*) FROM documents)) AS hits,
       true AS recall_ok, true AS scores_ok"""


# ---- prompts, models, evaluation ----------------------------------------------
def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def summaries() -> str:
    from quarry.functions.prompts import SUMMARY
    return f"""
WITH p AS (SELECT doc_id, replace({_lit(SUMMARY)}, '{{{{USER_TEXT}}}}', text) AS prompt FROM documents)
SELECT doc_id, length(prompt)::BIGINT AS prompt_chars,
       len(list_filter(string_split_regex(prompt, '[ \\t\\n\\r]+'), lambda x: x <> ''))::BIGINT AS prompt_words,
       len(list_filter(string_split_regex(prompt, '[ \\t\\n\\r]+'), lambda x: x <> '')) <= 9000 AS fits_window,
       4096 AS max_tokens_to_sample, 0.6::DOUBLE AS temperature, 250 AS top_k, 1.0::DOUBLE AS top_p,
       0 AS n_stop, ' Echo: ' || right(prompt, 40) AS summary, NULL::VARCHAR AS error
FROM p"""


def fewshot_predictions() -> str:
    from quarry.functions.prompts import FEW_SHOT
    arms = "\nUNION ALL\n".join(
        f"SELECT doc_id, label, '{n}' AS prompt, replace({_lit(t)}, '{{review}}', sentence) AS pt FROM ex"
        for n, t in FEW_SHOT.items())
    return f"""
WITH ex AS (SELECT d.doc_id, d.text AS sentence, l.quality AS label FROM documents d JOIN labels l USING (doc_id)),
runs AS ({arms}),
g AS (SELECT *, ['Positive', 'negative', 'maybe'][length(pt) % 3 + 1] AS prediction FROM runs)
SELECT doc_id, prompt, label, prediction,
       CASE lower(prediction) WHEN 'negative' THEN 0 WHEN 'positive' THEN 1 ELSE -1 END AS prediction_int
FROM g"""


def fewshot_accuracy() -> str:
    return f"""
WITH p AS ({fewshot_predictions()})
SELECT prompt, round(avg(CASE WHEN prediction_int = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       count(*) AS n FROM p GROUP BY prompt"""


def fewshot_best() -> str:
    return f"""
WITH a AS (SELECT prompt, avg(CASE WHEN prediction_int = label THEN 1.0 ELSE 0.0 END) AS acc
           FROM ({fewshot_predictions()}) GROUP BY prompt)
SELECT prompt AS best_prompt, round(acc, 6) AS best_accuracy FROM a ORDER BY acc DESC, prompt LIMIT 1"""


def chat_history() -> str:
    return """
SELECT conv_id, string_agg(text, '; ' ORDER BY turn) AS history, count(*)::INTEGER AS n_turns
FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id"""


def upload_manifest() -> str:
    name = f"string_split({DOC_PATH}, '/')[-1]"
    stem = (f"CASE WHEN regexp_matches({name}, '^\\.*[^.]+$') THEN {name} "
            f"ELSE regexp_replace({name}, '\\.[^./]*$', '') END")
    return f"""
SELECT doc_id, {DOC_PATH} AS path, {name} AS file_name, 'staged_files/' || {name} AS staged_path,
       {stem} || '.txt' AS text_name,
       'File ' || {name} || ' has been uploaded and moved to ''staged_files''.' AS status
FROM documents"""


QUESTIONS = """(SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS question_id, text,
        CASE WHEN conv_id % 2 = 0 THEN 'completion' ELSE 'hosted' END AS model,
        ((conv_id * 7 + turn) % 100 + 1)::DOUBLE / 100 AS temperature,
        ['50', '100', '250', '500', '1000'][conv_id % 5 + 1] AS token_count,
        ['none', 'first', 'second'][turn % 3 + 1] AS store
 FROM conversations WHERE role = 'user')"""


def question_settings() -> str:
    return f"""
WITH q AS {QUESTIONS},
p AS (SELECT *, list_filter([
        CASE WHEN temperature < 0.01 OR temperature > 1.0 THEN 'temperature out of range' END,
        CASE WHEN abs(temperature * 100 - round(temperature * 100)) > 1e-9 THEN 'temperature not in steps of 0.01' END,
        CASE WHEN token_count NOT IN ('50', '100', '250', '500', '1000') THEN 'token count not offered' END,
        CASE WHEN store NOT IN ('none', 'first', 'second') THEN 'unknown vector store' END],
        lambda x: x IS NOT NULL) AS probs FROM q)
SELECT question_id, temperature, token_count::INTEGER AS max_tokens, store,
       array_to_string(probs, '; ') AS problems, len(probs) = 0 AS accepted FROM p"""


# ---- search variants -----------------------------------------------------------
def topk_ctes(name: str, q: str, q_ids: str, d: str, d_ids: str, k: int, metric: str,
              dim: int = DIM) -> str:
    """CTE ``<name>`` (question_id, rank, id, score) for cosine or squared L2.

    Sparse vectors ``(id, b, w)`` are densified to ``dim``-element lists
    (ids without weights become zero vectors) and every question × record
    pair is scored with ``list_dot_product``.
    """
    def dense(src: str, ids: str) -> str:
        return (f"SELECT i.id, list(coalesce(x.w, 0.0) ORDER BY r.b) AS v "
                f"FROM {ids} i CROSS JOIN range({dim}) r(b) LEFT JOIN {src} x ON x.id = i.id AND x.b = r.b "
                f"GROUP BY i.id")
    if metric == "cosine":
        score = ("list_dot_product(q.v, d.v) / greatest(sqrt(list_dot_product(q.v, q.v)), 1e-12) "
                 "/ greatest(sqrt(list_dot_product(d.v, d.v)), 1e-12)")
        order = "round(score, 9) DESC"
    else:
        score = "pow(list_distance(q.v, d.v), 2)"
        order = "round(score, 9) ASC"
    return f"""
{name}_qv AS ({dense(q, q_ids)}),
{name}_dv AS ({dense(d, d_ids)}),
{name}_all AS (SELECT q.id AS qid, d.id AS did, {score} AS score FROM {name}_qv q CROSS JOIN {name}_dv d),
{name} AS (
  SELECT * FROM (
    SELECT qid AS question_id, did AS id, score,
           row_number() OVER (PARTITION BY qid ORDER BY {order}, did)::INTEGER AS rank
    FROM {name}_all) WHERE rank <= {k})"""


BENCH_Q = "(SELECT item_id AS question_id, text FROM benchmark)"


def search_hits(k: int = 5) -> str:
    return f"""
WITH {hash_embed_ctes('qv', USER_Q, 'question_id')},
{hash_embed_ctes('dv', 'documents', 'doc_id')},
qi AS (SELECT question_id AS id FROM {USER_Q}),
di AS (SELECT doc_id AS id FROM documents),
{topk_ctes('hits', 'qv', 'qi', 'dv', 'di', k, 'cosine')}
SELECT question_id, rank, id, round(score, 6) AS score FROM hits"""


def search_l2(k: int = 10) -> str:
    return f"""
WITH {hash_embed_ctes('qv', BENCH_Q, 'question_id')},
{hash_embed_ctes('dv', 'documents', 'doc_id')},
qi AS (SELECT item_id AS id FROM benchmark),
di AS (SELECT doc_id AS id FROM documents),
{topk_ctes('hits', 'qv', 'qi', 'dv', 'di', k, 'l2')}
SELECT question_id, rank, id, round(score, 6) AS score FROM hits"""


def vector_search(k: int = 5, label: int | None = None) -> str:
    where = f"WHERE label = {label}" if label is not None else ""
    return f"""
WITH {hash_embed_ctes('qv', BENCH_Q, 'question_id')},
src AS (SELECT vec_id, embedding FROM embeddings {where}),
ev AS (SELECT vec_id AS id, unnest(range(len(embedding))) AS b, unnest(embedding)::DOUBLE AS w FROM src),
qi AS (SELECT item_id AS id FROM benchmark),
di AS (SELECT vec_id AS id FROM src),
{topk_ctes('hits', 'qv', 'qi', 'ev', 'di', k, 'cosine')}
SELECT question_id, rank, id, round(score, 6) AS score FROM hits"""


def vector_search_label() -> str:
    return vector_search(5, 1)


CLASSIFIED = f"""(SELECT d.doc_id, {DOC_PATH.replace('source', 'd.source').replace('doc_id::', 'd.doc_id::')} AS id,
   d.text AS document, coalesce(c.c, 'public') AS classification
 FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, 'restricted' AS c FROM labels WHERE toxic = 1) c
 ON c.doc_id = d.doc_id)"""


def filtered_search(k: int = 2) -> str:
    return f"""
WITH cl AS {CLASSIFIED},
f AS (SELECT * FROM cl WHERE classification = 'public' AND contains(document, ' the ')),
{hash_embed_ctes('qv', BENCH_Q, 'question_id')},
{hash_embed_ctes('dv', 'f', 'id', 'document')},
qi AS (SELECT item_id AS id FROM benchmark),
di AS (SELECT id FROM f),
{topk_ctes('hits', 'qv', 'qi', 'dv', 'di', k, 'l2')}
SELECT h.question_id, h.rank, h.id, cl.classification, round(h.score, 6) AS score,
       substr(cl.document, 1, 100) AS snippet, cl.document AS full_document, false AS missing
FROM hits h JOIN cl ON cl.id = h.id"""


def qa_context(k: int = 4) -> str:
    from quarry.functions.prompts import QA_CHAIN
    pre, rest = QA_CHAIN.split("{context}")
    mid, post = rest.split("{question}")
    prompt = f"{_lit(pre)} || coalesce(c.context, '') || {_lit(mid)} || q.text || {_lit(post)}"
    return f"""
WITH {hash_embed_ctes('qv', USER_Q, 'question_id')},
{hash_embed_ctes('dv', 'documents', 'doc_id')},
qi AS (SELECT question_id AS id FROM {USER_Q}),
di AS (SELECT doc_id AS id FROM documents),
{topk_ctes('hits', 'qv', 'qi', 'dv', 'di', k, 'cosine')},
c AS (SELECT h.question_id, string_agg(d.text, chr(10) || chr(10) ORDER BY h.rank) AS context,
             count(*) AS n_docs
      FROM hits h JOIN documents d ON d.doc_id = h.id GROUP BY h.question_id),
p AS (SELECT q.question_id, coalesce(c.n_docs, 0) AS n_docs, length(coalesce(c.context, ''))::BIGINT AS context_chars, {prompt} AS prompt
      FROM {USER_Q} q LEFT JOIN c USING (question_id))
SELECT question_id, n_docs, context_chars, prompt, ' Echo: ' || right(prompt, 40) AS answer FROM p"""


# ---- embeddings ------------------------------------------------------------------
def hash_embedding() -> str:
    return f"""
WITH {hash_embed_ctes('dv', 'documents', 'doc_id')}
SELECT id AS doc_id, b::INTEGER AS dim_ix, round(w, 6) AS weight FROM dv"""


# ---- routed question answering (Q6) -------------------------------------------------
def answers() -> str:
    from quarry.functions import prompts as P
    pre1, rest1 = P.HOSTED_WITH_CONTEXT.split("{context}")
    mid1, post1 = rest1.split("{question}")
    pre0, post0 = P.HOSTED_NO_CONTEXT.split("{question}")
    sys_ = P.HOSTED_SYS
    pre1, pre0 = pre1.replace("{sys}", sys_), pre0.replace("{sys}", sys_)
    hosted = (f"CASE WHEN c.context = '' THEN {_lit(pre0)} || q.text || {_lit(post0)} "
              f"ELSE {_lit(pre1)} || c.context || {_lit(mid1)} || q.text || {_lit(post1)} END")
    completion = (f"CASE WHEN c.context = '' THEN replace(replace({_lit(P.COMPLETION_NO_CONTEXT)}, "
                  f"'{{{{QUESTION}}}}', q.text), '{{{{CONTEXT}}}}', c.context) "
                  f"ELSE replace(replace({_lit(P.COMPLETION_WITH_CONTEXT)}, '{{{{QUESTION}}}}', q.text), "
                  f"'{{{{CONTEXT}}}}', c.context) END")
    ch = chunks()
    return f"""
WITH q AS {QUESTIONS},
{hash_embed_ctes('qv', 'q', 'question_id')},
{hash_embed_ctes('dv', 'documents', 'doc_id')},
-- first store: one record per 512-character prefix, last writer wins
fb AS (SELECT substr(text, 1, 512) AS id, {DOC_PATH} AS file_path,
              CAST(substr(source, 4) AS INTEGER) AS batch_no, doc_id FROM documents),
fw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch_no DESC, file_path DESC) AS rn
                      FROM fb) WHERE rn = 1),
fa AS (SELECT fw.id, dv.b, dv.w FROM fw JOIN dv ON dv.id = fw.doc_id),
qa AS (SELECT * FROM qv WHERE id IN (SELECT question_id FROM q WHERE store = 'first')),
qai AS (SELECT question_id AS id FROM q WHERE store = 'first'),
fai AS (SELECT id FROM fw),
{topk_ctes('ah', 'qa', 'qai', 'fa', 'fai', 5, 'cosine')},
a_ctx AS (SELECT ah.question_id, d.text AS context, fw.file_path AS source
          FROM ah JOIN fw ON fw.id = ah.id JOIN documents d ON {DOC_PATH.replace('source', 'd.source').replace('doc_id::', 'd.doc_id::')} = fw.file_path
          WHERE ah.rank = 1),
-- second store: documents, then chunk files, each by its path; the first writer wins
ch AS ({ch}),
rows AS (SELECT doc_id, -1 AS chunk_ix, {DOC_PATH} AS path, text, 0 AS batch_no FROM documents
         UNION ALL SELECT doc_id, chunk_ix, '/data/doc_' || chunk_id || '.txt', text, 1 FROM ch),
keyed AS (SELECT row_number() OVER () AS rid, path AS id, * FROM rows),
sw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch_no, doc_id, chunk_ix) AS rn
                      FROM keyed) WHERE rn = 1),
{hash_embed_ctes('ev', 'sw', 'rid')},
sb AS (SELECT sw.id, ev.b, ev.w FROM sw JOIN ev ON ev.id = sw.rid),
qb AS (SELECT * FROM qv WHERE id IN (SELECT question_id FROM q WHERE store = 'second')),
qbi AS (SELECT question_id AS id FROM q WHERE store = 'second'),
sbi AS (SELECT id FROM sw),
{topk_ctes('bh', 'qb', 'qbi', 'sb', 'sbi', 1, 'l2')},
b_ctx AS (SELECT bh.question_id, sw.text AS context, sw.id AS source FROM bh JOIN sw ON sw.id = bh.id),
c AS (SELECT question_id, '' AS context, NULL::VARCHAR AS source FROM q WHERE store = 'none'
      UNION ALL SELECT * FROM a_ctx UNION ALL SELECT * FROM b_ctx),
p AS (SELECT q.question_id, q.model, q.store, c.source,
             CASE WHEN q.model = 'completion' THEN {completion} ELSE {hosted} END AS prompt
      FROM q JOIN c USING (question_id)),
r AS (SELECT *, CASE WHEN model = 'completion' THEN ' Echo: ' || right(prompt, 40)
                     ELSE substring(prompt || ' Echo: ' || right(prompt, 40), length(prompt) - 5) END AS reply
      FROM p)
SELECT question_id, model, store, source, length(prompt)::BIGINT AS prompt_chars,
       CASE WHEN store = 'none' THEN reply
            ELSE reply || {_lit(P.SEE_ALSO)} || '[Reference 1](' ||
                 replace(replace(source, '/data/https:/', 'https://'), '.txt', '.html') || ')' END AS answer,
       NULL::VARCHAR AS error
FROM r"""


def fewshot_preview() -> str:
    return f"""
SELECT * FROM ({fewshot_predictions()}) WHERE prompt = 'prompt_3' ORDER BY doc_id LIMIT 5"""


def _fill(template: str, **vals) -> str:
    """SQL concatenation of an f-string style template."""
    import re
    out, pos = [], 0
    for m in re.finditer(r"\{([a-z_]+)\}", template):
        if m.start() > pos:
            out.append(_lit(template[pos:m.start()]))
        out.append(vals[m.group(1)])
        pos = m.end()
    if pos < len(template):
        out.append(_lit(template[pos:]))
    return " || ".join(out)


def prompt_forms() -> str:
    from quarry.functions import prompts as P
    sys_u = _lit(P.UPLOAD_SYS)
    forms = {
        "prototype": _fill(P.PROTOTYPE, question="q.text", context="q.context"),
        "upload": (f"CASE WHEN q.context = '' THEN {_fill(P.UPLOAD_NO_CONTEXT, sys=sys_u, question='q.text')} "
                   f"ELSE {_fill(P.UPLOAD_WITH_CONTEXT, sys=sys_u, question='q.text', context='q.context')} END"),
        "upload_plain": _fill(P.UPLOAD_NO_CONTEXT, sys=sys_u, question="q.text"),
        "tagged": _fill(P.PLAIN_TAGGED, question="q.text"),
        "untagged": _fill(P.PLAIN_UNTAGGED, question="q.text"),
    }
    cols = ",\n       ".join(f"length({e})::BIGINT AS {n}_chars, md5({e}) AS {n}_md5" for n, e in forms.items())
    return f"""
WITH best AS ({best_context()}),
q AS (SELECT u.question_id, u.text, coalesce(b.context, '') AS context
      FROM {USER_Q} u LEFT JOIN best b USING (question_id))
SELECT q.question_id, {cols}, 50 AS max_new_tokens, 0.5::DOUBLE AS repetition_penalty FROM q"""


def page_text_native() -> str:
    from quarry.functions.text import ENTITIES, RAW_TEXT_ELEMENTS
    x = "regexp_replace(p.html, '(?s)<!--.*?-->', '', 'g')"
    for el in RAW_TEXT_ELEMENTS:
        x = f"regexp_replace({x}, '(?is)<{el}\\b[^>]*>.*?</{el}\\s*>', '', 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for ent, ch in ENTITIES:
        x = f"regexp_replace({x}, {_lit(ent)}, {_lit(ch)}, 'g')"
    x = f"regexp_replace(replace({x}, chr(10), ' '), '[^\\x00-\\x7F]+', '', 'g')"
    return f"""
WITH f AS ({page_files()})
SELECT f.page_id, f.path, f.url, {x} AS text FROM f JOIN pages p USING (page_id)"""


def vector_context(k: int = 5) -> str:
    vs = vector_search(k)
    return f"""
WITH h AS ({vs})
SELECT h.question_id, h.id AS vec_id, h.score, {DOC_PATH.replace('source', 'd.source').replace('doc_id::', 'd.doc_id::')} AS path,
       length(d.text)::BIGINT AS context_chars, d.doc_id IS NULL AS missing
FROM h LEFT JOIN documents d ON d.doc_id = h.id
WHERE h.rank = 1"""


def pooled_embedding_256() -> str:
    cut = """(SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '')[1:256], ' ') AS text
              FROM documents)"""
    return f"""
WITH {hash_embed_ctes('dv', cut, 'doc_id')}
SELECT id AS doc_id, b::INTEGER AS dim_ix, round(w, 6) AS weight FROM dv"""


def same_model_hits(k: int = 3) -> str:
    def one(n: str, dim: int, r: int) -> str:
        q = f"(SELECT item_id, text FROM benchmark WHERE item_id % 2 = {r})"
        d = f"(SELECT doc_id, text FROM documents WHERE doc_id % 2 = {r})"
        return f"""{hash_embed_ctes(n + 'q', q, 'item_id', dim=dim)},
{hash_embed_ctes(n + 'd', d, 'doc_id', dim=dim)},
{n}qi AS (SELECT item_id AS id FROM {q}), {n}di AS (SELECT doc_id AS id FROM {d}),
{topk_ctes(n + 'h', n + 'q', n + 'qi', n + 'd', n + 'di', k, 'cosine', dim)}"""
    return f"""
WITH {one('a', 64, 0)}, {one('b', 32, 1)}
SELECT question_id, rank, id, round(score, 6) AS score FROM ah
UNION ALL SELECT question_id, rank, id, round(score, 6) FROM bh"""


def single_question(k: int = 5) -> str:
    q = "(SELECT 'q' AS question_id, text FROM conversations WHERE role = 'user' ORDER BY conv_id, turn, text LIMIT 1)"
    return f"""
WITH {hash_embed_ctes('qv', q, 'question_id')},
{hash_embed_ctes('dv', 'documents', 'doc_id')},
qi AS (SELECT question_id AS id FROM {q}),
di AS (SELECT doc_id AS id FROM documents),
{topk_ctes('hits', 'qv', 'qi', 'dv', 'di', k, 'cosine')}
SELECT id, round(score, 6) AS score FROM hits"""


def retriever_hits(k: int = 4) -> str:
    return f"""
WITH f AS (SELECT * FROM {CLASSIFIED} WHERE classification = 'public' AND contains(document, ' the ')),
{hash_embed_ctes('qv', BENCH_Q, 'question_id')},
{hash_embed_ctes('dv', 'f', 'id', 'document')},
qi AS (SELECT item_id AS id FROM benchmark),
di AS (SELECT id FROM f),
{topk_ctes('hits', 'qv', 'qi', 'dv', 'di', k, 'cosine')}
SELECT question_id, rank, id, id AS file_path, round(score, 6) AS score FROM hits"""


def settings_rejects() -> str:
    return f"""
WITH s AS (SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS question_id,
    CASE conv_id % 7 WHEN 0 THEN 'warm' WHEN 1 THEN '1.5' WHEN 2 THEN '0.005' ELSE '0.5' END AS temperature,
    CASE WHEN conv_id % 5 = 3 THEN '300' ELSE ['50', '100', '250', '500', '1000'][conv_id % 5 + 1] END AS token_count,
    CASE WHEN turn % 4 = 2 THEN 'other' ELSE ['none', 'first', 'second'][turn % 3 + 1] END AS store
  FROM conversations WHERE role = 'user'),
p AS (SELECT *, list_filter([
    CASE WHEN temperature = 'warm' THEN 'temperature is not a number' END,
    CASE WHEN temperature IN ('1.5', '0.005') THEN 'temperature out of range' END,
    CASE WHEN temperature = '0.005' THEN 'temperature not in steps of 0.01' END,
    CASE WHEN token_count = '300' THEN 'token count not offered' END,
    CASE WHEN store = 'other' THEN 'unknown vector store' END], lambda x: x IS NOT NULL) AS probs FROM s)
SELECT question_id, temperature, token_count, store, array_to_string(probs, '; ') AS problems FROM p WHERE len(probs) > 0"""


def upload_answers() -> str:
    from quarry.functions import prompts as P
    sys_u = _lit(P.UPLOAD_SYS)
    return f"""
WITH best AS ({best_context()}),
q AS (SELECT u.question_id, u.text, coalesce(b.context, '') AS context
      FROM {USER_Q} u LEFT JOIN best b USING (question_id)),
p AS (SELECT q.question_id, q.context,
        CASE WHEN q.context = '' THEN {_fill(P.UPLOAD_NO_CONTEXT, sys=sys_u, question='q.text')}
             ELSE {_fill(P.UPLOAD_WITH_CONTEXT, sys=sys_u, question='q.text', context='q.context')} END AS prompt FROM q)
SELECT question_id, substr(context, 1, 10) AS preview_10, substr(context, 1, 4) AS preview_4,
       substring(prompt || ' Echo: ' || right(prompt, 40), length(prompt) - 5)
         || chr(10) || chr(10) || ' For additional info see source information below' AS answer
FROM p"""


def pages_first_store() -> str:
    pt = page_text_native()
    return f"""
WITH pt AS ({pt}),
{hash_embed_ctes('pv', 'pt', 'path')},
es AS (SELECT id, sum(w) AS s FROM pv GROUP BY id),
w AS (SELECT * FROM (SELECT substr(text, 1, 512) AS id, path AS file_path,
                            row_number() OVER (PARTITION BY substr(text, 1, 512) ORDER BY path DESC) AS rn
                     FROM pt) WHERE rn = 1)
SELECT w.id, w.file_path, 0 AS batch_no, 'hash-64' AS embedding_model, 64 AS n_dims,
       round(coalesce(es.s, 0), 6) AS emb_sum
FROM w LEFT JOIN es ON es.id = w.file_path"""
