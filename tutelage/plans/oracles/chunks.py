"""Check queries for chunks and study aids."""

from __future__ import annotations

from tutelage.plans.oracles.base import with_ctes as q

PARAS = """
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, p FROM (
    SELECT doc_id, unnest(a) AS p, generate_subscripts(a, 1) AS i
    FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS a
          FROM documents))
  WHERE p <> ''"""
PACKED = """
  SELECT doc_id, i, 0 AS idx, strlen(p) AS used FROM paras WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.i,
         CASE WHEN r.used + strlen(n.p) + 2 > 1600 THEN r.idx + 1 ELSE r.idx END,
         CASE WHEN r.used + strlen(n.p) + 2 > 1600 THEN strlen(n.p)
              ELSE r.used + strlen(n.p) + 2 END
  FROM packed r JOIN paras n ON n.doc_id = r.doc_id AND n.i = r.i + 1"""
PROSE = """
  SELECT k.doc_id, k.idx, string_agg(p.p, chr(10) || chr(10) ORDER BY p.i) AS text
  FROM packed k JOIN paras p ON p.doc_id = k.doc_id AND p.i = k.i GROUP BY ALL"""
LESSONS = """
  SELECT doc_id, 'module_' || regexp_extract(source, '(\\d+)', 1) AS module, lang, source, n_chars,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS lesson_index,
         'Lesson' || chr(9) || doc_id AS lesson
  FROM documents"""
DEFS = """
  SELECT module, lesson_index, doc_id, lang || '-term-' || (doc_id % 7) AS term,
         ' small in ' || source || ' by ' || doc_id AS val FROM lessons
  UNION ALL
  SELECT module, lesson_index, doc_id, upper(lang) || '-Term-' || (doc_id % 5),
         'capital by ' || doc_id FROM lessons"""
NUMS = """
  SELECT module, lesson_index, doc_id, (doc_id % 50) || ' °C' AS term, 'held warm' AS val
  FROM lessons WHERE doc_id % 4 <> 0
  UNION ALL
  SELECT module, lesson_index, doc_id, n_chars || ' g/L', 'seen in ' || source
  FROM lessons WHERE doc_id % 4 <> 0"""
CHUNKS = """
  SELECT module || '_l' || CASE WHEN lesson_index < 1000 THEN
           lpad(CAST(lesson_index AS VARCHAR), 3, '0') ELSE CAST(lesson_index AS VARCHAR) END
         || '_' || type || '_' || idx AS id, *
  FROM (
    SELECT l.module, l.lesson_index, l.lesson AS lesson_title, 'prose' AS type, p.idx,
           p.text, CAST(NULL AS VARCHAR) AS term
    FROM prose p JOIN lessons l USING (doc_id)
    UNION ALL
    SELECT d.module, d.lesson_index, l.lesson, 'definition',
           row_number() OVER (PARTITION BY d.doc_id ORDER BY term) - 1,
           term || ': ' || val, term FROM defs d JOIN lessons l USING (doc_id)
    UNION ALL
    SELECT d.module, d.lesson_index, l.lesson, 'key_number',
           row_number() OVER (PARTITION BY d.doc_id ORDER BY term) - 1,
           term || ': ' || val, term FROM nums d JOIN lessons l USING (doc_id)
    UNION ALL
    SELECT module, lesson_index, lesson, 'process', i, 'Step ' || i || ' of ' || doc_id, NULL
    FROM lessons, (VALUES (0), (1), (2)) v(i) WHERE i <= doc_id % 3)"""
ENRICHED = """
  SELECT *, CASE WHEN idx % 3 = 2 THEN '' ELSE 'Sum of ' || id END AS summary,
         idx % 4 + 4 AS n_options, (lesson_index + idx) % 9 - 1 AS correct,
         CASE WHEN idx % 2 = 1 THEN 'Because' || chr(13) || id ELSE '' END AS why,
         'What is' || chr(9) || id || '?' AS mc, 'Why ' || id || '?' AS sa,
         'So' || chr(10) || CASE WHEN idx % 7 = 3 THEN '' ELSE id END AS answer
  FROM chunks WHERE type = 'prose' AND (lesson_index + idx) % 11 <> 5"""
QA = """
  SELECT *, '**MC 1.** ' || mc || chr(10) || chr(10) || array_to_string(list_transform(
             range(1, least(n_options, 6) + 1), lambda j: '  ' || substr('ABCDEF', j, 1) ||
             '. opt ' || j || ' of ' || id || CASE WHEN j - 1 = correct THEN ' ✓' ELSE '' END
             || chr(10)), '') ||
           CASE WHEN why <> '' THEN chr(10) || '  _' || why || '_' || chr(10) ELSE '' END ||
           chr(10) || '**SA 1.** ' || sa || chr(10) || chr(10) || '> ' || answer || chr(10) ||
           chr(10) AS asked
  FROM enriched"""
CARDS = """
  SELECT module, lesson_index, 'Lesson    ' || substr(lesson_title, 8) AS lesson,
         id || '_mc_0' AS id,
         'Q: What is    ' || id || '?' || array_to_string(list_transform(
             range(1, least(n_options, 6) + 1), lambda j: '<br>' || substr('ABCDEF', j, 1) ||
             '. opt ' || j || ' of ' || id), '') AS front,
         CASE WHEN correct BETWEEN 0 AND 5 THEN substr('ABCDEF', CAST(correct + 1 AS INT), 1) ||
              '. ' || CASE WHEN correct < n_options THEN 'opt ' || (correct + 1) || ' of ' || id
                      ELSE '' END ELSE '' END ||
         CASE WHEN why <> '' THEN '<br><br>Because<br>' || id ELSE '' END AS back,
         'module::' || module || ' lesson::' || lpad(CAST(lesson_index AS VARCHAR), 3, '0') ||
         ' type::prose question_type::mc' AS tags
  FROM enriched
  UNION ALL
  SELECT module, lesson_index, 'Lesson    ' || substr(lesson_title, 8), id || '_sa_0', sa,
         replace(answer, chr(10), '<br>'),
         'module::' || module || ' lesson::' || lpad(CAST(lesson_index AS VARCHAR), 3, '0') ||
         ' type::prose question_type::sa'
  FROM enriched"""
STEPS = {"paras": PARAS, "packed": PACKED, "prose": PROSE, "lessons": LESSONS, "defs": DEFS,
         "nums": NUMS, "chunks": CHUNKS, "enriched": ENRICHED, "qa": QA, "cards": CARDS}


def on(body: str, *upto: str) -> str:
    return q(body, **{k: STEPS[k] for k in STEPS if not upto or k in upto})


DOCS = ("paras", "packed", "prose", "lessons", "defs", "nums", "chunks")
RICH = (*DOCS, "enriched", "qa", "cards")

CARRIED = """
  SELECT id, module,
         type = 'prose' AND (lesson_index + idx) % 5 <> 0 AND (lesson_index + idx) % 7 <> 0
           AS enriched,
         (lesson_index + idx) % 5 <> 0 AND (lesson_index + idx) % 7 <> 0
           AND (lesson_index + idx) % 3 <> 0 AS embedded
  FROM chunks"""

ORACLES = {
    "chunk_paragraphs": on("SELECT doc_id, CAST(idx AS INT) AS idx, strlen(text) AS bytes, "
                           "md5(text) AS text_md5 FROM prose", "paras", "packed", "prose"),
    "chunk_lessons": on("SELECT id, module, lesson_index, lesson_title, type, CAST(idx AS INT) "
                        "AS idx, term, md5(text) AS text_md5 FROM chunks", *DOCS),
    "chunk_stats": on("""
      SELECT module, count(DISTINCT lesson_index) AS num_lessons, count(*) AS num_chunks,
             count(*) FILTER (WHERE type = 'prose') AS num_prose,
             count(*) FILTER (WHERE type = 'definition') AS num_definitions,
             count(*) FILTER (WHERE type = 'key_number') AS num_key_numbers,
             count(*) FILTER (WHERE type = 'process') AS num_processes
      FROM chunks GROUP BY module""", *DOCS),
    "speech_chunks": q("""
      SELECT doc_id, CAST(seg - 1 AS INT) AS seg, CAST(idx AS INT) AS idx, text FROM (
        SELECT doc_id, seg, to_idx AS idx, string_agg(s, ' ' ORDER BY i) AS text
        FROM (SELECT z.*, CASE WHEN idx > 0 AND c.chars < 200 AND c.prev_chars + 1 + c.chars <= 700
                       AND idx = max(idx) OVER (PARTITION BY doc_id, seg)
                     THEN idx - 1 ELSE idx END AS to_idx
              FROM sized z JOIN (
                SELECT doc_id, seg, idx, max(used) AS chars,
                       lag(max(used)) OVER (PARTITION BY doc_id, seg ORDER BY idx) AS prev_chars
                FROM sized GROUP BY doc_id, seg, idx) c USING (doc_id, seg, idx))
        GROUP BY doc_id, seg, to_idx)""",
        segs="""
          SELECT doc_id, unnest(a) AS text, generate_subscripts(a, 1) AS seg
          FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)""",
        sents="""
          SELECT doc_id, seg, row_number() OVER (PARTITION BY doc_id, seg ORDER BY i) AS i, s
          FROM (SELECT doc_id, seg, unnest(a) AS s, generate_subscripts(a, 1) AS i
                FROM (SELECT doc_id, seg, string_split(regexp_replace(text, '([.!?]+)\\s+',
                        '\\1' || chr(1), 'g'), chr(1)) AS a FROM segs))
          WHERE trim(s) <> ''""",
        sized="""
          SELECT doc_id, seg, i, s, 0 AS idx, length(s) AS used FROM sents WHERE i = 1
          UNION ALL
          SELECT n.doc_id, n.seg, n.i, n.s,
                 CASE WHEN r.used + 1 + length(n.s) > 700 THEN r.idx + 1 ELSE r.idx END,
                 CASE WHEN r.used + 1 + length(n.s) > 700 THEN length(n.s)
                      ELSE r.used + 1 + length(n.s) END
          FROM sized r JOIN sents n ON n.doc_id = r.doc_id AND n.seg = r.seg AND n.i = r.i + 1"""),
    "flatten_items": """
      SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INT) AS item_idx, unnest(a) AS item
      FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)""",
    "embedding_dims": q("""
      SELECT export, count(*) AS rows, count(*) FILTER (WHERE dim > 0) AS embedded,
             CASE WHEN count(*) FILTER (WHERE dim > 0) = 0 THEN 'no vectors'
                  WHEN count(DISTINCT dim) FILTER (WHERE dim > 0) > 1 THEN
                    'mixed: row ' || min(id) FILTER (WHERE dim > 0 AND dim <> first_dim) ||
                    ' has ' || arg_min(dim, id) FILTER (WHERE dim > 0 AND dim <> first_dim) ||
                    ', others ' || any_value(first_dim)
                  WHEN max(expected) > 0 AND any_value(first_dim) <> max(expected) THEN
                    'expected ' || max(expected) || ', got ' || any_value(first_dim)
                  ELSE 'ok' END AS status,
             count(*) FILTER (WHERE dim > 0) > 0
               AND count(DISTINCT dim) FILTER (WHERE dim > 0) = 1
               AND (max(expected) = 0 OR any_value(first_dim) = max(expected)) AS ok
      FROM (SELECT v.*, f.first_dim FROM v LEFT JOIN
              (SELECT export, arg_min(dim, id) AS first_dim FROM v WHERE dim > 0 GROUP BY 1) f
              USING (export))
      GROUP BY export""", v="""
      SELECT vec_id AS id, label AS export,
             CASE WHEN vec_id % 10 = 3 OR label = 5 THEN 0
                  WHEN label = 3 AND vec_id % 4 = 1 THEN 32 ELSE len(embedding) END AS dim,
             CASE label WHEN 6 THEN 128 WHEN 7 THEN 0 ELSE 64 END AS expected
      FROM embeddings"""),
    "resume_carry": on("SELECT id, enriched, embedded FROM (" + CARRIED + ")", *DOCS),
    "carry_counts": on("SELECT module, count(*) AS chunks, count(*) FILTER (WHERE enriched) AS "
                       "carried_enrichment, count(*) FILTER (WHERE embedded) AS "
                       "carried_embedding FROM (" + CARRIED + ") GROUP BY module", *DOCS),
    "parse_enrichment": on("""
      SELECT c.id, CASE WHEN e.id IS NULL THEN 'retry' ELSE 'ok' END AS status, e.summary,
             CASE WHEN e.id IS NULL THEN 0 ELSE 2 END AS terms,
             CAST(e.correct AS INT) AS correct, CAST(coalesce(e.n_options, 0) AS INT) AS options,
             e.answer
      FROM chunks c LEFT JOIN enriched e USING (id) WHERE c.type = 'prose'""",
                           *DOCS, "enriched"),
    "glossary": on("""
      SELECT module, canon, trim(term) AS term, trim(val) AS definition FROM (
        SELECT *, lower(trim(term)) AS canon, row_number() OVER (
          PARTITION BY module, lower(trim(term)) ORDER BY lesson_index, term) AS r FROM defs)
      WHERE r = 1""", "lessons", "defs"),
    "key_numbers": on("""
      SELECT n.module, n.lesson_index, l.lesson, CAST(row_number() OVER (
               PARTITION BY n.doc_id ORDER BY term) - 1 AS INT) AS pos,
             term AS value, val AS context
      FROM nums n JOIN lessons l USING (doc_id)""", "lessons", "nums"),
    "flashcards": on("SELECT * FROM cards", *RICH),
    "deck_guids": on("""
      SELECT deck, row, id, left(sha256(CASE WHEN row = first_row THEN seed
               ELSE seed || ':' || row END), 16) AS guid, row <> first_row AS repeated
      FROM (SELECT *, min(row) OVER (PARTITION BY deck, seed) AS first_row FROM (
        SELECT *, CASE WHEN trim(id) = '' THEN front || '::' || back ELSE id END AS seed
        FROM (SELECT deck, row, front, trim(back) AS back,
                     CASE WHEN row % 3 = 0 THEN '  ' ELSE regexp_replace(id, '_(mc|sa)_0$', '')
                     END AS id
              FROM (SELECT *, module AS deck, row_number() OVER (
                      PARTITION BY module ORDER BY lesson_index, id) - 1 AS row FROM cards))
        WHERE back <> ''))""", *RICH),
    "study_qa": on("""
      SELECT module, lesson_index, CAST(idx // 500 AS INT) AS part,
             CASE WHEN idx // 500 = 0 THEN chr(10) || '## ' || any_value(lesson_title) || chr(10)
               || chr(10) ELSE '' END ||
             string_agg(CASE WHEN summary <> '' THEN '**Summary**: ' || summary || chr(10) ||
               chr(10) ELSE '' END || asked, '' ORDER BY idx) AS markdown
      FROM qa GROUP BY module, lesson_index, idx // 500""", *RICH),
    "lesson_documents": on("""
      SELECT module, lesson_index, section, part, md5(t) AS md5, length(t) AS chars FROM (
        SELECT module, lesson_index, 0 AS section, 0 AS part,
               '# ' || min(lesson_title) || chr(10) || chr(10) AS t
        FROM chunks GROUP BY ALL
        UNION ALL
        SELECT module, lesson_index, s, CAST(idx // 500 AS INT),
               CASE WHEN idx // 500 = 0 THEN h || chr(10) || chr(10) ELSE '' END ||
               string_agg(CASE type WHEN 'prose' THEN text || chr(10) || chr(10)
                 WHEN 'process' THEN '- ' || text || chr(10)
                 ELSE '- **' || term || '** — ' || substr(text, length(term) + 3) || chr(10)
                 END, '' ORDER BY idx)
        FROM chunks JOIN (VALUES ('prose', 1, '## Lecture content'),
               ('definition', 2, '## Definitions'), ('key_number', 3, '## Key numbers'),
               ('process', 4, '## Processes')) v(type, s, h) USING (type)
        GROUP BY module, lesson_index, s, h, idx // 500
        UNION ALL
        SELECT module, lesson_index, 5, CAST(idx // 500 AS INT),
               CASE WHEN idx // 500 = 0 THEN '## Study questions' || chr(10) || chr(10)
                    ELSE '' END || string_agg(asked, '' ORDER BY idx)
        FROM qa GROUP BY module, lesson_index, idx // 500)""", *RICH),
    "new_documents": on("""
      SELECT module, lesson_index, module || '_lesson_' || CASE WHEN lesson_index < 1000 THEN
        lpad(CAST(lesson_index AS VARCHAR), 3, '0') ELSE CAST(lesson_index AS VARCHAR) END
        || '.md' AS file_name
      FROM lessons WHERE lesson_index % 3 <> 0""", "lessons"),
    "upsert_vectors": q("""
      SELECT id, text, dim, vector_md5, module, lesson_index, type FROM latest
      UNION ALL
      SELECT 'v' || vec_id * 2, 'old ' || vec_id, CAST(len(embedding) AS INT),
             md5(array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1e6) AS BIGINT)), ',')),
             'module_' || label, label, 'prose'
      FROM embeddings WHERE 'v' || vec_id * 2 NOT IN (SELECT id FROM latest)""", latest="""
      SELECT * EXCLUDE (r) FROM (
        SELECT 'v' || (vec_id // 2 * 3) AS id, 'new ' || vec_id AS text,
               CAST(len(embedding) AS INT) AS dim, md5(array_to_string(list_transform(
                 embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1e6) AS BIGINT)), ',')) AS vector_md5,
               'module_' || label AS module,
               label AS lesson_index, 'prose' AS type,
               row_number() OVER (PARTITION BY vec_id // 2 ORDER BY vec_id DESC) AS r
        FROM embeddings WHERE vec_id % 4 <> 1)
      WHERE r = 1"""),
}
