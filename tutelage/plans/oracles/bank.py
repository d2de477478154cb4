"""Check queries for the question bank.

The lessons are written by rule from conversations, so the checks state what
extraction must find instead of parsing the markdown a second time.
"""

from __future__ import annotations

from tutelage.plans.oracles.base import with_ctes as q

ASKED = """
  SELECT conv_id, turn // 50 AS block, text, answer,
         row_number() OVER (PARTITION BY conv_id, turn // 50 ORDER BY turn) AS n
  FROM (SELECT *, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user'"""
PLACED = """
  SELECT *, 'module_' || (conv_id % 9 + 1) AS module, 'Module_' || (conv_id % 9 + 1) AS dir,
         'Lesson_' || CASE WHEN conv_id < 100 THEN lpad(CAST(conv_id AS VARCHAR), 2, '0')
                           ELSE left(CAST(conv_id AS VARCHAR), 2) END
           || '_Talk_' || conv_id || 'b' || block AS stem,
         CASE n % 4 WHEN 1 THEN 'short' WHEN 2 THEN 'progressive' WHEN 3 THEN 'long' ELSE '' END
           AS tier,
         CASE n % 4 WHEN 1 THEN '\\* ' WHEN 2 THEN '\\*\\* ' WHEN 3 THEN '\\*\\*\\* ' ELSE '' END
           AS stars,
         CASE (n + conv_id) % 4 WHEN 0 THEN 'Response:' WHEN 1 THEN '**Response:**'
           WHEN 2 THEN 'response:' ELSE '' END AS label,
         CASE WHEN conv_id % 5 = 0 THEN ' ### Note Keep this.' ELSE '' END AS note
  FROM asked"""
SECTIONS = """
  SELECT * FROM placed WHERE answer IS NOT NULL OR n % 2 = 0"""
LIST_BANK = """
  SELECT 'list_course' AS course, module, stem || '_SAQ' AS lesson_dir, n AS num,
         row_number() OVER (PARTITION BY conv_id, block ORDER BY n) - 1 AS pos,
         CASE WHEN tier <> '' THEN tier
              WHEN label = '**Response:**' AND conv_id % 2 = 1 THEN 'progressive' ELSE '' END
           AS difficulty,
         text AS prompt,
         CASE WHEN conv_id % 5 = 0 THEN trim(coalesce(answer, '') ||
              chr(10) || chr(10) || '### Note' || chr(10) || chr(10) || 'Keep this.', chr(10))
              ELSE coalesce(answer, '') END AS answer,
         CASE WHEN n % 3 = 0 THEN dir || '/' || stem || '_SAQ/images/q' || n || '.png' ELSE '' END
           AS figures,
         replace(stem, '_', ' ') || ' SAQ' AS unit, 'Talk ' || conv_id || 'b' || block
           AS unit_topic
  FROM sections"""
HEAD_BANK = """
  SELECT 'heading_course' AS course, module, stem || '_Quiz' AS lesson_dir, n AS num,
         row_number() OVER (PARTITION BY conv_id, block ORDER BY answer IS NULL, n) - 1 AS pos,
         '' AS difficulty, text AS prompt, coalesce(answer, '') AS answer, '' AS figures,
         replace(stem, '_', ' ') || ' Quiz' AS unit, 'Talk ' || conv_id || 'b' || block
           AS unit_topic
  FROM placed"""
NORM = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
ID = (f"module || '.' || {SLUG.format('unit')} || '.q' || left(sha256({NORM.format('module')} "
      f"|| '|' || {NORM.format('unit')} || '|' || {NORM.format('prompt')}), 8)")
BANK = f"""
  SELECT *, {ID} AS id,
         array_to_string(list_filter(list_transform(
           string_split(answer, chr(10) || chr(10)), lambda p: trim(p, chr(10))),
           lambda p: p <> ''), '¦') AS points,
         module || ' / ' || unit || ' › Q' || num AS citation,
         module || '.' || {SLUG.format('unit')} || '.q' || num AS aliases
  FROM (SELECT * FROM list_bank UNION ALL SELECT * FROM head_bank)"""
STEPS = {"asked": ASKED, "placed": PLACED, "sections": SECTIONS, "list_bank": LIST_BANK,
         "head_bank": HEAD_BANK, "built": BANK}


def on_lessons(body: str) -> str:
    return q(body, **STEPS)


DOCQ = """
  SELECT 'module_' || regexp_extract(source, '(\\d+)', 1) AS module,
         'Lesson ' || lang || ' SAQ' AS unit, doc_id AS num,
         CASE WHEN doc_id % 2 = 0 THEN '  ' || translate(text, 'aeiou', 'AEIOU') || chr(10) ELSE text END AS prompt
  FROM documents"""
DOC_LESSONS = """
  SELECT 'course_' || lang AS course,
         'Module_' || (CAST(regexp_extract(source, '(\\d+)', 1) AS INT) + 1) AS dir,
         CASE WHEN doc_id % 10 = 7 THEN 'Extra_' ELSE 'Lesson_' END || doc_id ||
           CASE WHEN doc_id % 4 = 0 THEN '_SAQ' ELSE '_Notes' END AS lesson_dir,
         doc_id, text AS content, strlen(text) AS n_bytes
  FROM documents"""
LISTED = """
  SELECT DISTINCT course, dir, CAST(substr(dir, 8) AS INT) AS num,
         100 - CAST(substr(dir, 8) AS INT) AS module_order
  FROM lessons WHERE CAST(substr(dir, 8) AS INT) % 7 <> 0"""
MANIFESTS = """
  SELECT CAST(p_partkey AS VARCHAR) AS course,
    CASE p_partkey % 17 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS version,
    CASE p_partkey % 19 WHEN 0 THEN '' WHEN 1 THEN p_brand WHEN 2 THEN 'REPLACE-slug'
      ELSE lower(replace(p_name, ' ', '-')) || '-' || p_partkey END AS slug,
    CASE p_partkey % 23 WHEN 0 THEN '  ' WHEN 1 THEN 'REPLACE-title' ELSE p_name END AS title,
    CASE WHEN p_partkey % 29 = 0 THEN '' ELSE p_name END AS persona,
    CASE WHEN p_partkey % 31 = 0 THEN 'REPLACE-cover' ELSE '' END AS cover_prompt,
    p_size % 4 + 1 AS n_modules, p_partkey AS k, p_type,
    CASE WHEN p_partkey % 3 = 0 THEN 'saq' WHEN p_partkey % 3 = 1 THEN ''
         WHEN p_partkey % 53 = 0 THEN 'exam' ELSE 'none' END AS preset,
    CASE WHEN p_partkey % 5 = 0 THEN '*_Unit_*' ELSE '' END AS lesson_pattern,
    CASE WHEN p_partkey % 7 = 0 THEN '## Question {n}' ELSE '' END AS question_heading,
    CASE WHEN p_partkey % 7 = 0 THEN '## Answer {n}' ELSE '' END AS answer_heading,
    CASE WHEN p_partkey % 11 = 0 THEN 'memory' ELSE '' END AS memory_slug,
    CASE WHEN p_partkey % 12 = 0 THEN 'shelf' ELSE '' END AS knowledge_collection
  FROM part"""
ALIASES = """
  SELECT CAST(p_partkey AS VARCHAR) AS alias,
         CAST(p_partkey + p_partkey % 2 + 1 AS VARCHAR) AS id
  FROM part WHERE p_partkey % 5 = 0"""

ORACLES = {
    "size_gate": """
      SELECT doc_id, n_bytes,
        CASE WHEN n_bytes = 0 THEN 'empty' WHEN n_bytes > 1048576 THEN 'dropped'
             WHEN n_bytes > 204800 THEN 'omitted_from_batches'
             WHEN n_bytes > 120000 THEN 'truncated' ELSE 'ok' END AS status,
        n_bytes <= 1048576 AS in_course, n_bytes BETWEEN 1 AND 1048576 AS in_bank
      FROM (SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN 0 ELSE strlen(text) * 60 END AS n_bytes
            FROM documents)""",
    "assessment_filter": q("""
      SELECT course, dir, lesson_dir FROM lessons
      WHERE CASE course WHEN 'course_en' THEN lesson_dir LIKE '%SAQ%'
                 WHEN 'course_fr' THEN regexp_matches(lesson_dir, '^Lesson_._.*$')
                 ELSE true END""", lessons=DOC_LESSONS),
    "stable_ids": q(f"""
      SELECT num, {ID} AS id, module || '.' || {SLUG.format('unit')} || '.q' || num AS legacy_id
      FROM docq""", docq=DOCQ),
    "id_collisions": q(f"""
      SELECT id, count(*) AS questions, count(DISTINCT prompt) AS spellings
      FROM (SELECT {ID} AS id, prompt FROM docq) GROUP BY id HAVING count(*) > 1""", docq=DOCQ),
    "extract_figures": """
      SELECT doc_id, pos, CASE pos WHEN 0 THEN 'Module_1/img/' || doc_id || '.png'
             ELSE 'Module_1/Lesson_' || doc_id || '/c.svg' END AS figure,
             md5(' ' || text || ' ') AS text_md5
      FROM documents, (VALUES (0), (1)) v(pos)""",
    "decompose_points": """
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS pos,
             point
      FROM (SELECT doc_id, unnest(p) AS point, generate_subscripts(p, 1) AS i
            FROM (SELECT doc_id, CASE
                    WHEN doc_id % 3 = 2 AND NOT regexp_matches(text,
                         '(?m)^\\s*([-*]|[0-9]{1,3}\\.) \\s*\\S') THEN [trim(text)]
                    WHEN doc_id % 3 = 2 THEN list_filter(list_transform(
                      string_split(text, chr(10)), lambda x: trim(regexp_extract(trim(x),
                        '^(?:[-*]|[0-9]{1,3}\\.) (.*)$', 1))), lambda x: x <> '')
                    ELSE list_transform(string_split(text, chr(10)), lambda x: trim(x)) END AS p
                  FROM documents))
      WHERE point <> ''""",
    "split_sections": on_lessons("""
      SELECT 'list_course' AS course, module, stem || '_SAQ' AS lesson_dir,
             CAST(row_number() OVER (PARTITION BY conv_id, block ORDER BY n) - 1 AS INT) AS pos,
             CAST(n AS INT) AS num,
             regexp_replace(' ' || CASE WHEN conv_id % 2 = 0 AND label <> '' THEN
                 stars || text || ' ' ELSE '' END ||
               CASE WHEN label <> '' THEN label || ' ' ELSE '' END || coalesce(answer, '')
               || note || ' ', '\\s+', ' ', 'g') AS body
      FROM sections"""),
    "question_list": on_lessons("""
      SELECT 'list_course' AS course, module, stem || '_SAQ' AS lesson_dir, CAST(n AS INT) AS num,
             text AS prompt, CASE WHEN n % 3 = 0 THEN dir || '/' || stem || '_SAQ/images/q' || n
             || '.png' ELSE '' END AS figures, tier AS difficulty
      FROM placed"""),
    "question_headings": on_lessons("""
      SELECT 'heading_course' AS course, module, stem || '_Quiz' AS lesson_dir,
             CAST(n AS INT) AS num, text AS prompt, '' AS figures, '' AS difficulty
      FROM placed"""),
    "extract_bank": on_lessons("""
      SELECT id, course, module, lesson_dir, unit, unit_topic,
             CAST(num AS INT) AS num, CAST(pos AS INT) AS pos, difficulty, prompt, answer,
             points, citation, figures, aliases
      FROM built"""),
    "dedupe_bank": on_lessons("""
      SELECT md5(prompt) AS id, course, module, lesson_dir, CAST(num AS INT) AS num, prompt
      FROM (SELECT *, row_number() OVER (PARTITION BY course, md5(prompt) ORDER BY
                CAST(substr(module, 8) AS INT), lesson_dir, pos) AS r FROM built)
      WHERE r = 1"""),
    "lessons_in_manifest": q("""
      SELECT l.course, 'module_' || m.num AS module, m.module_order, l.lesson_dir, l.n_bytes
      FROM lessons l JOIN listed m USING (course, dir)""", lessons=DOC_LESSONS, listed=LISTED),
    "unlisted_modules": q("""
      SELECT course, dir, count(*) AS lessons FROM lessons
      WHERE (course, dir) NOT IN (SELECT (course, dir) FROM listed) GROUP BY ALL""",
                          lessons=DOC_LESSONS, listed=LISTED),
    "resolve_markers": q("""
      SELECT course, slug,
        CASE WHEN lesson_pattern <> '' THEN lesson_pattern WHEN preset = 'saq' THEN '*SAQ*'
             ELSE '' END AS lesson_pattern,
        CASE WHEN question_heading <> '' THEN question_heading
             WHEN preset = 'saq' THEN '## Self-Assessment Questions' ELSE '' END
          AS question_heading,
        CASE WHEN answer_heading <> '' THEN answer_heading
             WHEN preset = 'saq' THEN '## Suggested Response - Q{n}' ELSE '' END AS answer_heading,
        CASE WHEN preset = 'saq' THEN 'escaped-asterisks' ELSE '' END AS difficulty_marker,
        CASE WHEN memory_slug <> '' THEN memory_slug ELSE slug END AS memory_slug,
        CASE WHEN knowledge_collection <> '' THEN knowledge_collection ELSE slug END
          AS knowledge_collection,
        preset, preset NOT IN ('', 'none') OR question_heading <> '' AS has_material,
        question_heading <> '' AS per_question
      FROM manifests""", manifests=MANIFESTS),
    "migrate_ids": q("""
      SELECT learner_id, new_topic AS topic, attempts, reps, streak, lapses, mastered, due,
             created, last_reviewed, last_quality, last_confidence, note, merged_items
      FROM (SELECT s.*, coalesce(a.id, s.topic) AS new_topic,
              count(*) OVER (PARTITION BY learner_id, coalesce(a.id, s.topic)) AS merged_items,
              row_number() OVER (PARTITION BY learner_id, coalesce(a.id, s.topic)
                ORDER BY a.id IS NOT NULL, s.topic) AS r
            FROM state s LEFT JOIN aliases a ON a.alias = s.topic)
      WHERE r = 1""", "state", aliases=ALIASES),
    "migrate_history": q("""
      SELECT t.learner_id, coalesce(a.id, t.topic) AS topic, t.ts, t.seq, t.quality, t.confidence
      FROM attempts t LEFT JOIN aliases a ON a.alias = t.topic""", "attempts", aliases=ALIASES),
}
