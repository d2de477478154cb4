"""Check queries for study state, policy and reports."""

from __future__ import annotations

from tutelage.plans.oracles.base import with_ctes as q

STATE_COLS = """learner_id, topic, attempts, reps, streak, lapses, mastered, due, created,
                last_reviewed, last_quality, last_confidence, note"""
TIER = "CASE difficulty WHEN 'short' THEN 0 WHEN 'progressive' THEN 1 ELSE 2 END"
COUNTS = """
  SELECT learner_id, count(*) AS tracked, count(*) FILTER (WHERE mastered) AS mastered,
         count(*) FILTER (WHERE NOT mastered AND due <= (SELECT t FROM now)) AS due,
         count(*) FILTER (WHERE NOT mastered AND calibration = 'blindspot') AS blindspots
  FROM items GROUP BY learner_id"""
RANKED_GAPS = """
  SELECT row_number() OVER (PARTITION BY learner_id ORDER BY risk DESC, topic) AS rank, *
  FROM items WHERE NOT mastered"""


def _next_due(condition: str) -> str:
    return f"""
      SELECT learner_id, topic, module, unit, kind, calibration, streak, lapses, last_quality,
             last_confidence, due
      FROM (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY
                calibration <> 'blindspot', streak, due, topic) AS r
            FROM items WHERE NOT mastered AND due <= (SELECT t FROM now) AND {condition})
      WHERE r = 1"""


NEXT_MASTERED = """
  SELECT learner_id, topic, module, unit, streak, due FROM (
    SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY due, topic) AS r
    FROM items WHERE mastered AND due <= (SELECT t FROM now) AND kind NOT IN ('number', 'math'))
  WHERE r = 1"""

# every learner against every answered question: fine for a check on small tables
PAIRS = """
  SELECT l.learner_id, a.*, a.course || '|' || a.module || '|' || a.unit_topic AS unit_key,
         s.topic IS NOT NULL AS seen
  FROM (SELECT DISTINCT learner_id FROM state) l CROSS JOIN answered a
  LEFT JOIN state s ON s.learner_id = l.learner_id AND s.topic = a.id"""
NEXT_QUESTION = f"""
  SELECT learner_id, id, module, unit_topic AS unit, difficulty, num, prompt,
         tried AS unit_attempted
  FROM (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY tried, unit_key,
                {TIER}, num, id) AS r
        FROM (SELECT *, count(*) FILTER (WHERE seen) OVER (
                     PARTITION BY learner_id, unit_key) AS tried FROM pairs)
        WHERE NOT seen)
  WHERE r = 1"""

COVERAGE = """
  WITH_UNITS AS (
    SELECT e.learner_id, o.course, o.module, o.unit_topic AS unit, count(*) AS questions,
           count(s.topic) AS attempted,
           CAST(coalesce(sum(CASE WHEN s.mastered THEN 1 ELSE 0 END), 0) AS BIGINT) AS mastered
    FROM (SELECT DISTINCT s.learner_id, o.course FROM state s JOIN official o ON o.id = s.topic) e
    JOIN official o ON o.course = e.course
    LEFT JOIN state s ON s.learner_id = e.learner_id AND s.topic = o.id
    GROUP BY ALL)""".replace("WITH_UNITS AS (", "", 1).rstrip(")")
COVERAGE = COVERAGE.strip()

PLACED = """
  SELECT i.*, coalesce(b.course, '') AS course, b.kind AS bank_kind, b.prompt
  FROM items i LEFT JOIN bank b ON b.id = i.topic"""
SPOTS = """
  SELECT p.learner_id, p.course, row_number() OVER (PARTITION BY p.learner_id, p.course ORDER BY p.risk DESC,
         p.topic) AS rank, coalesce(p.prompt, p.topic) AS topic, p.note
  FROM placed p WHERE NOT p.mastered AND p.calibration = 'blindspot'"""
TOTALS = """
  SELECT *, CASE WHEN questions = 0 THEN 0 ELSE mastered * 100 // questions END AS pct
  FROM (SELECT learner_id, course, count(*) FILTER (WHERE NOT mastered AND due <= (SELECT t FROM now)) AS due,
               (SELECT count(*) FROM official o WHERE o.course = p.course) AS questions,
               count(*) FILTER (WHERE bank_kind = 'official') AS attempted,
               count(*) FILTER (WHERE bank_kind = 'official' AND mastered) AS mastered
        FROM placed p GROUP BY learner_id, course)"""
WEAK = """
  SELECT learner_id, course, module || ' · ' || unit AS unit,
         CAST(mastered * 100 // questions AS INT) AS pct,
         row_number() OVER (PARTITION BY learner_id, course
           ORDER BY CAST(mastered * 100 // questions AS INT), module, unit) AS r
  FROM units WHERE mastered * 100 // questions < 100"""
DIGEST = {"placed": PLACED, "spots": SPOTS, "totals": TOTALS, "units": COVERAGE, "weak": WEAK}

WEAK8 = """
  SELECT learner_id, string_agg(topic, ',' ORDER BY rank) AS weak
  FROM ranked WHERE rank <= {n} GROUP BY learner_id"""

ORACLES = {
    "attempt_log": """
      SELECT CAST(l_suppkey % 10 AS BIGINT) AS learner_id, CAST(l_partkey AS VARCHAR) AS topic,
             l_shipdate AS ts,
             CAST(greatest(0, least(5, q)) AS INT) AS quality,
             CAST(greatest(0, least(3, c)) AS INT) AS confidence,
             CASE WHEN c = 7 THEN 'confidence: not a whole number' END AS reject
      FROM (SELECT *, CAST(l_quantity AS INT) % 8 - 1 AS q,
                   CASE WHEN l_linenumber = 7 AND l_orderkey % 2 = 0 THEN 7
                        ELSE CAST((l_orderkey + l_linenumber) % 6 AS INT) - 1 END AS c
            FROM lineitem)
      WHERE c <> 7
      UNION ALL
      SELECT CAST(l_suppkey % 10 AS BIGINT), CAST(l_partkey AS VARCHAR), l_shipdate,
             CAST(greatest(0, least(5, CAST(l_quantity AS INT) % 8 - 1)) AS INT), NULL,
             'confidence: not a whole number'
      FROM lineitem WHERE l_linenumber = 7 AND l_orderkey % 2 = 0""",
    "item_state": q(f"SELECT {STATE_COLS} FROM state", "state"),
    "attempt_history": q("""
      SELECT learner_id, topic, ts, seq, attempts, quality, confidence, reps, streak, lapses,
             mastered, due, calibration,
             CASE WHEN mastered THEN topic || ' is mastered; next review ' || strftime(due, '%Y-%m-%d')
                  WHEN calibration = 'blindspot' THEN topic || ' was missed although you felt sure; it is asked first'
                  ELSE topic || ' noted; next try ' || strftime(due, '%Y-%m-%dT%H:%M:%SZ') END AS message
      FROM dues""", "dues"),
    "due_schedule": q("""
      SELECT learner_id, topic, ts, seq, streak, mastered, CAST(wait_minutes AS INT)
             AS wait_minutes, due FROM dues""", "dues"),
    "calibrate": q("SELECT learner_id, topic, last_quality, last_confidence, calibration "
                   "FROM state", "state"),
    "risk_score": q("SELECT learner_id, topic, calibration, lapses, streak, risk FROM state",
                    "state"),
    "emit_points": q("""
      SELECT learner_id, topic, ts, seq, n, n % 5 <> 0 AS trailing FROM (
        SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY ts, seq, topic) AS n,
               count(*) OVER (PARTITION BY learner_id) AS total FROM attempts)
      WHERE n % 5 = 0 OR n = total""", "attempts"),
    "counts": q(COUNTS, "items", "now"),
    "study_report": q("""
      SELECT c.*, n.next_due, w.weak,
             (SELECT count(*) FROM official) AS bank_questions
      FROM counts c
      LEFT JOIN (SELECT learner_id, min(due) AS next_due FROM items WHERE NOT mastered
                 GROUP BY 1) n USING (learner_id)
      LEFT JOIN weak w USING (learner_id)""", "items", "official", "now",
                      counts=COUNTS, ranked=RANKED_GAPS, weak=WEAK8.format(n=8)),
    "strong_topics": q("SELECT learner_id, topic FROM state WHERE mastered", "state"),
    "gaps": q("""
      SELECT rank, learner_id, topic, module, unit, calibration, last_quality, streak, lapses,
             note, risk FROM ranked WHERE rank <= 10""", "items", ranked=RANKED_GAPS),
    "next_due": q(_next_due("kind NOT IN ('number', 'math')"), "items", "now"),
    "next_numbers": q(_next_due("kind = 'number'"), "items", "now"),
    "next_math": q(_next_due("kind = 'math'"), "items", "now"),
    "next_mastered": q(NEXT_MASTERED, "items", "now"),
    "next_question": q(NEXT_QUESTION, "state", "answered", pairs=PAIRS),
    "next_action": q("""
      SELECT c.learner_id,
             CASE WHEN d.calibration = 'blindspot' THEN 'review'
                  WHEN f.id IS NOT NULL THEN 'quiz_new' WHEN d.topic IS NOT NULL THEN 'review'
                  WHEN m.topic IS NOT NULL THEN 'reverify' ELSE 'introduce_new' END AS action,
             CASE WHEN d.calibration = 'blindspot' THEN d.topic
                  WHEN f.id IS NOT NULL THEN f.id WHEN d.topic IS NOT NULL THEN d.topic
                  WHEN m.topic IS NOT NULL THEN m.topic END AS topic,
             c.tracked, c.mastered, c.due, c.blindspots,
             CASE WHEN d.topic IS NULL AND f.id IS NULL AND m.topic IS NULL
                  THEN coalesce(w.weak, '') END AS weak_topics
      FROM counts c LEFT JOIN due d USING (learner_id) LEFT JOIN fresh f USING (learner_id)
      LEFT JOIN again m USING (learner_id) LEFT JOIN weak w USING (learner_id)""",
                     "items", "answered", "now", counts=COUNTS,
                     due=_next_due("kind NOT IN ('number', 'math')"), pairs=PAIRS,
                     fresh=NEXT_QUESTION, again=NEXT_MASTERED, ranked=RANKED_GAPS,
                     weak=WEAK8.format(n=5)),
    "unseen_questions": q("""
      SELECT e.learner_id, a.course, a.id, a.module, a.unit_topic, a.num, a.difficulty
      FROM (SELECT DISTINCT s.learner_id, a.course FROM state s JOIN answered a
            ON a.id = s.topic) e
      JOIN answered a ON a.course = e.course
      WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.learner_id = e.learner_id
                        AND s.topic = a.id)""", "state", "answered"),
    "coverage": q("""
      SELECT learner_id, course, module, unit, questions, attempted, mastered,
             CAST(mastered * 100 // questions AS INT) AS mastered_pct
      FROM (SELECT * FROM units UNION ALL
            SELECT learner_id, course, '', '(overall)', sum(questions), sum(attempted),
                   sum(mastered) FROM units GROUP BY ALL)""",
                  "state", "official", units=COVERAGE),
    "reattach_keys": q("""
      SELECT i.learner_id, i.topic, i.module, i.unit, i.kind, i.calibration, i.streak, i.lapses,
             i.due, coalesce(b.prompt, '') AS question, b.answer AS grading_key, b.difficulty,
             b.citation
      FROM items i LEFT JOIN bank b ON b.id = i.topic
      WHERE i.due <= (SELECT t FROM now) AND NOT i.mastered""", "items", "now"),
    "enrich_attempts": q("""
      SELECT a.*, o.module, o.unit, o.difficulty, o.prompt AS question,
             CASE WHEN o.id IS NULL THEN 'freeform' ELSE 'official' END AS kind
      FROM attempts a LEFT JOIN official o ON o.id = a.topic""", "attempts", "official"),
    "mastery_digest": q("""
      SELECT t.learner_id, t.course, 0 AS part,
        '{"course_slug":"' || t.course || '","updated":"' ||
        strftime((SELECT t FROM now), '%Y-%m-%dT%H:%M:%SZ') ||
        '","coverage":{"questions":' || t.questions || ',"attempted":' || t.attempted ||
        ',"mastered":' || t.mastered || ',"mastered_pct":' || t.pct ||
        '},"due":' || t.due || ',"blindspots":' ||
        (SELECT count(*) FROM spots s WHERE s.learner_id = t.learner_id AND s.course = t.course) ||
        ',"weak_units":[' || coalesce((
           SELECT string_agg('{"unit":"' || unit || '","mastered_pct":' || pct || '}', ','
                             ORDER BY r)
           FROM weak w WHERE w.learner_id = t.learner_id AND w.course = t.course AND r <= 5), '') || ']}' AS digest
      FROM totals t
      UNION ALL
      SELECT learner_id, course, CAST((rank - 1) // 1000 + 1 AS INT),
        '{"course_slug":"' || course || '","blindspots":[' ||
        string_agg('{"topic":"' || topic || '","note":"' || note || '"}', ',' ORDER BY rank) ||
        ']}'
      FROM spots GROUP BY learner_id, course, (rank - 1) // 1000""",
                        "items", "official", "now", **DIGEST),
    "mastery_summary": q("""
      SELECT t.learner_id, t.course,
        'Tried ' || t.attempted || ' of ' || t.questions || ' questions; ' ||
        t.mastered || ' mastered (' || t.pct || '%), ' || t.due ||
        ' to repeat' || chr(10) ||
        coalesce((SELECT 'Blindspots (' || count(*) || '): ' ||
                    string_agg(CASE WHEN rank <= 3 THEN topic END, '; ' ORDER BY rank) || '.'
                  FROM spots s WHERE s.learner_id = t.learner_id AND s.course = t.course HAVING count(*) > 0),
                 'No blindspots') ||
        coalesce((SELECT chr(10) || 'Least mastered: ' ||
                    string_agg(unit || ' (' || pct || '%)', ', ' ORDER BY r) || '.'
                  FROM weak w WHERE w.learner_id = t.learner_id AND w.course = t.course AND r <= 5), '') AS summary
      FROM totals t""", "items", "official", "now", **DIGEST),
}
