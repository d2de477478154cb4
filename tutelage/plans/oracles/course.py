"""Check queries for files, grading, lint and build steps."""

from __future__ import annotations

from tutelage.plans.oracles.bank import DOC_LESSONS, LISTED, MANIFESTS
from tutelage.plans.oracles.base import with_ctes as q
from tutelage.plans.oracles.chunks import LESSONS, NUMS, ORACLES as CHUNK_ORACLES

TREE = f"""
  SELECT course, dir, lesson_dir, doc_id,
         CASE WHEN doc_id % 50 = 11 THEN NULL WHEN doc_id % 97 = 0 THEN 0 ELSE n_bytes * 60 END
           AS n_bytes,
         doc_id % 50 <> 11 AND doc_id % 97 <> 0 AS filled
  FROM ({DOC_LESSONS})"""
MODULES = """
  SELECT course, dir, num FROM listed
  UNION SELECT DISTINCT course, 'Module_99', 99 FROM listed"""
ASSETS = f"""
  SELECT l.course, l.dir, l.lesson_dir, l.doc_id, v.name,
         lower(regexp_extract(v.name, '\\.([^.]+)$', 1)) AS ext,
         l.course || '/' || l.dir || '/' || l.lesson_dir || '/images/' || v.name AS path,
         CASE WHEN v.name LIKE 'plan%' THEN v.name || l.dir ELSE l.content END AS content
  FROM ({DOC_LESSONS}) l, (VALUES ('fig.png', 0), ('fig.JPG', 1), ('fig.svg', 2), ('fig.txt', 3),
       ('fig.webp', 4), ('plan.svg', 5), ('plan.PNG', 6)) v(name, i)
  WHERE CASE WHEN i < 5 THEN l.doc_id % 5 = i WHEN i = 5 THEN l.doc_id % 2 = 0
        ELSE l.doc_id % 4 = 0 END"""
USABLE = "SELECT * FROM tree WHERE lesson_dir LIKE 'Lesson\\_%' ESCAPE '\\' AND n_bytes <= 1048576"
IMAGES = "('png', 'jpg', 'jpeg', 'gif', 'webp', 'bmp', 'svg')"
STEMS = f"""
  SELECT a.course, a.dir, a.lesson_dir, regexp_replace(name, '\\.[^.]*$', '') AS stem,
         count(*) AS n, bool_or(ext = 'svg') AS vector, bool_or(ext <> 'svg') AS raster
  FROM assets a JOIN usable u USING (course, dir, lesson_dir)
  WHERE ext IN {IMAGES} GROUP BY ALL"""
SUMMARY = """
  SELECT m.course, m.dir, m.num,
    (SELECT count(*) FROM usable u WHERE u.course = m.course AND u.dir = m.dir) AS lessons,
    (SELECT count(*) FROM usable u WHERE u.course = m.course AND u.dir = m.dir
       AND lesson_dir LIKE '%SAQ%') AS assessment,
    CAST(coalesce((SELECT sum(n) FROM stems s WHERE s.course = m.course AND s.dir = m.dir), 0)
      AS BIGINT) AS images,
    (SELECT count(*) FROM stems s WHERE s.course = m.course AND s.dir = m.dir AND vector) AS svg,
    (SELECT count(*) FROM stems s WHERE s.course = m.course AND s.dir = m.dir AND vector
       AND NOT raster) AS svg_only
  FROM modules m"""
ORDER = """
  SELECT course, dir, CASE WHEN repeats > 0 THEN 'numbers_repeat' ELSE 'order_lexical' END AS code,
         CASE WHEN repeats > 0 THEN CAST(repeats AS VARCHAR) ELSE bad.earlier || '|' || bad.later END AS detail
  FROM (SELECT course, dir,
          (SELECT count(*) FROM (SELECT num FROM numbered x WHERE x.course = m.course
             AND x.dir = m.dir GROUP BY num HAVING count(*) > 1)) AS repeats,
          (SELECT arg_min({'earlier': earlier, 'later': lesson_dir}, lesson_dir)
           FROM steps x WHERE x.course = m.course AND x.dir = m.dir AND num < earlier_num) AS bad
        FROM (SELECT DISTINCT course, dir FROM numbered) m)
  WHERE repeats > 0 OR bad IS NOT NULL"""
NUMBERED = """
  SELECT course, dir, lesson_dir, CAST(regexp_extract(lesson_dir, '^Lesson_(\\d+)', 1) AS INT)
         AS num FROM usable"""
STEPPED = """
  SELECT *, lag(lesson_dir) OVER w AS earlier, lag(num) OVER w AS earlier_num FROM numbered
  WINDOW w AS (PARTITION BY course, dir ORDER BY lesson_dir)"""
FINDINGS = f"""
  SELECT course, CASE WHEN code IN ('lesson_without_file', 'lesson_empty', 'lesson_too_large') THEN 'error' ELSE 'warning' END
           AS severity,
         dir || '/' || lesson_dir || CASE WHEN code IN ('lesson_without_file', 'lesson_misnamed') THEN '' ELSE '/lesson.md' END
           AS path, code, CASE WHEN code = 'lesson_misnamed' THEN CAST(num AS VARCHAR)
           WHEN code IN ('lesson_too_large', 'lesson_not_read_whole', 'lesson_cut_unevenly') THEN CAST(n_bytes AS VARCHAR)
           ELSE '' END AS detail
  FROM (SELECT *, unnest([
          CASE WHEN named AND n_bytes IS NULL THEN 'lesson_without_file' END, CASE WHEN named AND n_bytes = 0 THEN 'lesson_empty' END,
          CASE WHEN named AND n_bytes > 1048576 THEN 'lesson_too_large' WHEN named AND n_bytes > 204800 THEN 'lesson_not_read_whole'
               WHEN named AND n_bytes > 120000 THEN 'lesson_cut_unevenly' END,
          CASE WHEN named AND filled AND n_bytes <= 1048576 AND doc_id % 3 <> 0 THEN 'lesson_without_title' END,
          CASE WHEN NOT named AND n_bytes IS NOT NULL THEN 'lesson_misnamed' END]) AS code FROM kept)
  WHERE code IS NOT NULL
  UNION ALL
  SELECT course, 'error', dir, 'module_absent', CAST(num AS VARCHAR) FROM modules WHERE dir = 'Module_99'
  UNION ALL
  SELECT course, 'error', dir, 'module_without_lessons', CAST(num AS VARCHAR)
  FROM summary WHERE lessons = 0 AND dir <> 'Module_99'
  UNION ALL
  SELECT course, 'warning', dir, 'lessons_skipped', num || '|' || count(*)
  FROM kept WHERE named AND (n_bytes IS NULL OR n_bytes > 1048576) GROUP BY course, dir, num
  UNION ALL
  SELECT course, 'warning', dir, 'vector_figures', num || '|' || svg || '|' || svg_only FROM summary WHERE svg > 0
  UNION ALL
  SELECT a.course, 'warning', a.dir || '/' || a.lesson_dir || '/images/' || a.name, 'image_type', ext
  FROM assets a JOIN usable USING (course, dir, lesson_dir) JOIN modules m USING (course, dir)
  WHERE ext NOT IN {IMAGES}
  UNION ALL
  SELECT o.course, 'warning', o.dir, o.code, o.detail FROM ordering o JOIN modules USING (course, dir)
  UNION ALL
  SELECT DISTINCT course, 'warning', dir, 'module_unlisted', ''
  FROM tree WHERE (course, dir) NOT IN (SELECT (course, dir) FROM modules)
  UNION ALL
  SELECT course, 'warning', '', 'no_assessment', '' FROM summary GROUP BY course HAVING sum(assessment) = 0"""
KEPT = """
  SELECT t.*, m.num, lesson_dir LIKE 'Lesson%' AS named
  FROM tree t JOIN modules m USING (course, dir)"""
LINT = {"lessons": DOC_LESSONS, "listed": LISTED, "modules": MODULES, "tree": TREE,
        "assets": ASSETS, "usable": USABLE, "stems": STEMS, "summary": SUMMARY,
        "numbered": NUMBERED, "steps": STEPPED, "ordering": ORDER, "kept": KEPT,
        "findings": FINDINGS}


def on_tree(body: str) -> str:
    return q(body, **LINT)


GOLDEN = """
  SELECT doc_id, source AS grader, CAST(doc_id * 7 % 2500 AS VARCHAR) AS question_id,
         source || ' ' || lang || ' ' || n_chars AS learner_answer,
         quality * 4 + toxic AS expected, CAST(n_chars % 6 AS INT) AS actual
  FROM labels JOIN documents USING (doc_id)"""
RESOLVED = """
  SELECT g.*, b.prompt, b.answer, b.difficulty, CASE WHEN b.id IS NULL THEN 'question_id "' ||
         question_id || '" not found in the question bank' END AS reject
  FROM golden g LEFT JOIN bank b ON b.id = g.question_id"""
VERDICTS = """
  SELECT doc_id, grader, CASE WHEN reject IS NULL THEN
           CASE WHEN k = 6 THEN 0 ELSE greatest(0, least(5, actual * 2 - 2)) END END AS quality,
         CASE WHEN reject IS NULL THEN CASE WHEN k = 6 THEN '' ELSE 'a {1};b' END END AS hits,
         CASE WHEN reject IS NULL AND k <> 6 THEN learner_answer END AS misses,
         CASE WHEN reject IS NULL AND k <> 6 THEN 'so' END AS explanation, reject
  FROM (SELECT *, doc_id % 11 AS k, CASE doc_id % 11 WHEN 3 THEN 'no JSON object'
               WHEN 4 THEN 'not valid JSON' WHEN 5 THEN 'not valid JSON' END AS reject
        FROM golden)"""
GRADE = {"golden": GOLDEN, "verdicts": VERDICTS}


def _issues() -> str:
    rules = [
        ("version = 0", "'version'", "missing", "''"), ("version > 1", "'version'", "version_unknown", "version"),
        ("slug = ''", "'slug'", "missing", "''"),
        ("slug <> '' AND NOT regexp_matches(slug, '^[a-z0-9][a-z0-9-]{0,63}$')", "'slug'", "slug_form", "slug"),
        ("trim(title) = ''", "'title'", "missing", "''"), ("trim(persona) = ''", "'persona'", "missing", "''"),
        ("preset NOT IN ('', 'none', 'saq')", "'assessment_markers.preset'", "preset_unknown", "preset"),
        *((f"starts_with({c}, 'REPLACE-')", f"'{f}'", "placeholder", c)
          for c, f in (("slug", "slug"), ("title", "title"), ("cover_prompt", "render.cover_prompt"))),
    ]
    per_module = [("num <= 0", "num", "number_not_positive", "num"), ("num > 0 AND again", "num", "number_repeated", "num"),
                  ("topic = ''", "topic", "missing", "''"), ("topic LIKE 'REPLACE-%'", "topic", "placeholder", "topic")]
    return " UNION ALL ".join(
        [f"SELECT course, {f} AS field, '{code}' AS code, CAST({d} AS VARCHAR) AS detail FROM manifests WHERE {w}"
         for w, f, code, d in rules]
        + [f"SELECT course, 'modules[' || i || '].{f}', '{code}', CAST({d} AS VARCHAR) FROM mods WHERE {w}"
           for w, f, code, d in per_module])


MODS = """
  SELECT *, EXISTS (SELECT 1 FROM raw_mods b WHERE b.course = a.course AND b.i < a.i
                    AND b.num = a.num) AS again FROM raw_mods a"""
RAW_MODS = """
  SELECT course, i - 1 AS i,
         CASE WHEN k % 13 = 0 AND i = 2 THEN 1 WHEN k % 41 = 0 AND i = 1 THEN 0 ELSE i END AS num,
         CASE WHEN k % 43 = 0 AND i = 1 THEN '' WHEN k % 47 = 0 AND i = 1 THEN 'REPLACE-topic'
              ELSE p_type END AS topic
  FROM manifests, (VALUES (1), (2), (3), (4)) v(i) WHERE i <= n_modules"""

ORACLES = {
    "scan_lessons": q("SELECT course, dir, lesson_dir, n_bytes, md5(content) AS md5 FROM lessons "
                      "WHERE starts_with(lesson_dir, 'Lesson_')", lessons=DOC_LESSONS),
    "scan_assets": q(f"""
      SELECT course, dir, lesson_dir, name, ext, ext IN {IMAGES} AS usable,
             strlen(content) AS n_bytes, sha256(content) AS sha256
      FROM assets WHERE starts_with(lesson_dir, 'Lesson_')""", assets=ASSETS),
    "load_lessons_json": q("""
      SELECT module, lesson_index, lesson, md5(d.text) AS md5, 2 AS definitions,
             CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2 END AS key_numbers,
             array_to_string(list_transform(range(0, doc_id % 3 + 1),
               lambda i: 'Step ' || i || ' of ' || doc_id), ';') AS processes
      FROM lessons JOIN documents d USING (doc_id)""", lessons=LESSONS),
    "load_cards": """
      SELECT id, module, unit, unit AS unit_topic, num, 'number' AS difficulty, prompt, answer,
             'c' AS citation
      FROM (SELECT 'card' || (p_partkey - p_partkey % 3) AS id, p_brand AS module, p_type AS unit,
                   p_name AS prompt, CAST(p_size AS VARCHAR) AS answer,
                   CAST(p_partkey % 500 + 1 AS INT) AS num,
                   row_number() OVER (PARTITION BY p_partkey // 500, p_partkey - p_partkey % 3
                     ORDER BY p_partkey % 500) AS r
            FROM part)
      WHERE r = 1""",
    "load_golden": q("""
      SELECT CASE WHEN k = 3 OR k = 7 THEN '' ELSE question_id END AS question_id,
             CASE WHEN k = 3 THEN '' ELSE learner_answer END AS learner_answer,
             CASE WHEN k IN (3, 6) THEN 0 WHEN k = 5 THEN 9 ELSE expected END AS expected_quality,
             CASE WHEN k IN (3, 6) THEN 'not valid JSON'
                  WHEN k = 7 THEN 'question_id is required'
                  WHEN k = 5 THEN 'expected_quality 9 out of range 0-5' END AS reject
      FROM (SELECT *, doc_id % 40 AS k FROM golden) WHERE k <> 9""", golden=GOLDEN),
    "write_chunks": CHUNK_ORACLES["chunk_lessons"],
    "write_flashcards": CHUNK_ORACLES["flashcards"].replace(
        "SELECT * FROM cards", "SELECT id, front, back, lesson, tags FROM cards"),
    "resolve_golden": q("SELECT doc_id, question_id, expected, prompt, reject FROM resolved",
                        "bank", golden=GOLDEN, resolved=RESOLVED),
    "grading_requests": q("""
      SELECT doc_id, question_id, 'Question:' || chr(10) || prompt || chr(10) || chr(10) ||
             'Key, not to be shown:' || chr(10) || answer || chr(10) ||
             CASE WHEN answer <> '' THEN chr(10) || 'Points to be named:' || chr(10) || '- ' ||
                  answer || chr(10) ELSE '' END ||
             CASE WHEN difficulty = 'long' THEN chr(10) || 'The answer should cover '
                  || 'the topic as a whole; judge coverage and order.'
                  || chr(10) ELSE '' END ||
             chr(10) || 'Answer given:' || chr(10) || learner_answer || chr(10) AS request
      FROM resolved WHERE reject IS NULL""", "bank", golden=GOLDEN, resolved=RESOLVED),
    "parse_verdicts": q("SELECT * FROM verdicts", **GRADE),
    "verdict_rejects": q("""
      SELECT grader, count(*) AS verdicts, count(reject) AS rejected,
             count(reject) / count(*) AS reject_rate FROM verdicts GROUP BY grader""", **GRADE),
    "eval_summary": q("""
      SELECT grader, count(*) AS count, count(*) FILTER (WHERE d = 0) AS exact_matches,
             count(*) FILTER (WHERE abs(d) <= 1) AS within_one,
             count(*) FILTER (WHERE d = 0) / count(*) AS exact_rate,
             count(*) FILTER (WHERE abs(d) <= 1) / count(*) AS within_one_rate,
             sum(d) / count(*) AS mean_signed_error,
             count(*) FILTER (WHERE d = 0) / count(*) >= 0.5
               AND count(*) FILTER (WHERE abs(d) <= 1) / count(*) >= 0.9
               AND sum(d) / count(*) <= 0.5 AS passed
      FROM (SELECT grader, actual - expected AS d FROM golden) GROUP BY grader""", golden=GOLDEN),
    "annotate": q("""
      SELECT doc_id, CASE WHEN n % 7 <> 3 THEN '{"quality": ' || n % 6 || '}' END AS output,
             CAST(CASE WHEN n % 7 = 3 THEN 3 WHEN n % 5 = 2 THEN 2 ELSE 1 END AS INT) AS tries,
             CASE WHEN n % 7 = 3 THEN 'failed' ELSE 'ok' END AS status
      FROM (SELECT doc_id, length(learner_answer) AS n FROM golden)""", golden=GOLDEN),
    "module_summary": on_tree("SELECT * FROM summary"),
    "lesson_order": on_tree("SELECT * FROM ordering"),
    "course_findings": on_tree("SELECT * FROM findings"),
    "course_verdict": on_tree("""
      SELECT coalesce(course, '(all)') AS course,
             count(*) FILTER (WHERE severity = 'error') AS errors,
             count(*) FILTER (WHERE severity = 'warning') AS warnings,
             count(*) FILTER (WHERE severity = 'error') = 0 AS passed
      FROM findings GROUP BY ROLLUP (course)"""),
    "manifest_findings": q(_issues(), manifests=MANIFESTS, raw_mods=RAW_MODS, mods=MODS),
    "merge_lessons": q("""
      SELECT module, lesson_index, lesson, CASE WHEN lesson_index % 3 <> 0
             THEN CAST(doc_id % 3 + 1 AS INT) END AS n_processes FROM lessons""",
                       lessons=LESSONS),
    "unique_by_key": """
      SELECT md5(text) AS md5, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source
      FROM documents GROUP BY text""",
    "content_dedupe": q("""
      SELECT sha256(content) AS sha256, min(path) AS first_path, count(*) AS referrers,
             max(strlen(content)) AS n_bytes FROM assets GROUP BY sha256(content)""",
                        assets=ASSETS),
    "asset_descriptions": q("""
      SELECT path, sha256(content) AS sha256, 'seen at ' || min(path) OVER (
             PARTITION BY content) AS description FROM assets""", assets=ASSETS),
    "guide_sections": q("""
      SELECT module, lesson_index, 0 AS kind, '' AS name, '# ' || lesson AS markdown FROM lessons
      UNION ALL
      SELECT module, lesson_index, 1, '', '### Figures' FROM lessons WHERE doc_id % 2 = 0
      UNION ALL
      SELECT module, lesson_index, 2, v.name, '![' || v.name || '](/src/' || doc_id || '/' ||
             v.name || ')'
      FROM lessons, (VALUES ('b.png', 2), ('a.png', 4)) v(name, m) WHERE doc_id % m = 0""",
                        lessons=LESSONS),
    "split_passes": """
      SELECT source, lang, lesson_index, passes,
             CAST(CASE passes WHEN 1 THEN ntile(1) OVER w WHEN 2 THEN ntile(2) OVER w
                  ELSE ntile(3) OVER w END AS INT) AS pass_no, minutes / passes AS target_minutes
      FROM (SELECT source, lang, doc_id AS lesson_index, minutes,
                   CASE WHEN minutes <= 60 THEN 1 WHEN minutes <= 90 THEN 2 ELSE 3 END AS passes
            FROM documents JOIN (SELECT source, lang, CAST(sum(n_chars) % 91 + 30 AS INT)
                                   AS minutes FROM documents GROUP BY ALL) USING (source, lang))
      WINDOW w AS (PARTITION BY source, lang ORDER BY lesson_index)""",
    "corpus_budget": q("""
      SELECT module, lesson_index, before, CAST(CASE WHEN strlen(text) <= room THEN strlen(text)
               ELSE room - list_min(list_filter(range(0, 4), lambda b: NOT (
                 substr(h, CAST((room - b) * 2 + 1 AS BIGINT), 2) BETWEEN '80' AND 'BF'))) END
               AS INT) AS bytes,
             CASE WHEN strlen(text) <= room THEN md5(text) END AS md5
      FROM (SELECT *, 60000 - before AS room, hex(encode(text)) AS h
            FROM (SELECT *, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY module
                     ORDER BY lesson_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                   AS BIGINT) AS before FROM texts))
      WHERE before <= 60000""", lessons=LESSONS, nums=NUMS, texts="""
      SELECT module, lesson_index, '## ' || lesson || chr(10) || chr(10) || trim(d.text) ||
             chr(10) || CASE WHEN doc_id % 4 <> 0 THEN chr(10) || 'Key numbers:' || chr(10) || (
               SELECT string_agg('- ' || term || ': ' || val || chr(10), '' ORDER BY term)
               FROM nums n WHERE n.doc_id = l.doc_id) ELSE '' END ||
             array_to_string(list_transform(range(0, doc_id % 3 + 1),
               lambda i: '- Step ' || i || ' of ' || doc_id || chr(10)), '') || chr(10) AS text
      FROM lessons l JOIN documents d USING (doc_id)"""),
}
