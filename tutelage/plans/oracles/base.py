"""Shared common table expressions of the check queries (DuckDB dialect)."""

from __future__ import annotations

from tutelage.plans.fixtures import COURSES, NOW

CTES = {
    "attempts": """
      SELECT l_suppkey % 10 AS learner_id, CAST(l_partkey AS VARCHAR) AS topic,
             l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS seq,
             CAST(l_quantity AS INT) % 6 AS quality,
             CAST((l_orderkey + l_linenumber) % 4 AS INT) AS confidence,
             CASE WHEN CAST(l_quantity AS INT) % 6 < 4
                  THEN 'missed: ' || l_returnflag || '; ' || l_linestatus ELSE '' END AS note
      FROM lineitem""",
    # islands of attempts between misses
    "islands": """
      SELECT *, sum(CASE WHEN quality < 4 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY learner_id, topic ORDER BY ts, seq) AS island
      FROM attempts""",
    "streaks": """
      SELECT *, CAST(count(*) FILTER (WHERE quality >= 4) OVER (
                  PARTITION BY learner_id, topic, island ORDER BY ts, seq) AS INT) AS streak
      FROM islands""",
    "marks": """
      SELECT *,
        CAST(count(*) OVER w AS INT) AS attempts,
        CAST(count(*) FILTER (WHERE quality >= 4) OVER w AS INT) AS reps,
        CAST(count(*) FILTER (WHERE quality < 3) OVER w AS INT) AS lapses,
        min(ts) OVER w AS created,
        coalesce(bool_or(quality >= 4 AND streak >= 2 AND confidence >= 2) OVER (
          PARTITION BY learner_id, topic, island ORDER BY ts, seq), false)
          AND quality >= 4 AS mastered,
        row_number() OVER (PARTITION BY learner_id, topic ORDER BY ts DESC, seq DESC) AS back
      FROM streaks
      WINDOW w AS (PARTITION BY learner_id, topic ORDER BY ts, seq)""",
    "history": """
      SELECT *,
        CASE WHEN mastered THEN (CASE WHEN streak <= 2 THEN 1 WHEN streak = 3 THEN 2 ELSE 4 END)
                  * 1440
             WHEN quality >= 4 AND confidence >= 2 THEN 1440
             WHEN quality < 4 THEN 7 WHEN streak = 1 THEN 20 ELSE 40 END AS wait_minutes,
        CASE WHEN quality < 3 AND confidence >= 2 THEN 'blindspot'
             WHEN quality >= 4 AND confidence >= 2 THEN 'solid' ELSE 'shaky' END AS calibration
      FROM marks""",
    "dues": "SELECT *, ts + to_minutes(wait_minutes) AS due FROM history",
    "state": """
      SELECT learner_id, topic, attempts, reps, streak, lapses, mastered, due, created,
             ts AS last_reviewed, quality AS last_quality, confidence AS last_confidence,
             note, calibration,
             CAST(CASE calibration WHEN 'blindspot' THEN 100 WHEN 'shaky' THEN 40 ELSE 0 END
               + CASE WHEN quality < 3 THEN 30 ELSE 0 END + lapses * 10 + (2 - streak) * 5
               AS DOUBLE) AS risk
      FROM dues WHERE back = 1""",
    "bank": f"""
      SELECT CAST(p_partkey AS VARCHAR) AS id,
             'course_' || (CAST(substr(p_brand, 7) AS INT) % {COURSES}) AS course,
             'module_' || substr(p_brand, 7) AS module, 'Lesson ' || p_type AS unit,
             p_type AS unit_topic, p_size AS num,
             CASE p_size % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'progressive' ELSE 'long' END
               AS difficulty,
             p_name AS prompt,
             CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name || ' ' || p_type END AS answer,
             'module_' || substr(p_brand, 7) || ' / ' || p_type || ' › Q' || p_size AS citation,
             CASE WHEN p_partkey % 13 = 0 THEN 'number' WHEN p_partkey % 13 = 1 THEN 'math'
                  ELSE 'official' END AS kind
      FROM part""",
    "official": "SELECT * FROM bank WHERE kind = 'official'",
    "answered": "SELECT * FROM official WHERE trim(answer) <> ''",
    "items": """
      SELECT s.*, b.module, b.unit_topic AS unit, coalesce(b.kind, 'freeform') AS kind
      FROM state s LEFT JOIN bank b ON s.topic = b.id""",
    "now": f"SELECT TIMESTAMP '{NOW}' AS t",
}

NEEDS = {
    "islands": ["attempts"], "streaks": ["islands"], "marks": ["streaks"],
    "history": ["marks"], "dues": ["history"], "state": ["dues"], "items": ["state", "bank"],
    "official": ["bank"], "answered": ["official"],
}


def needed(names: list[str]) -> list[str]:
    """The named tables and everything they build on, in order."""
    order: dict[str, None] = {}
    for name in names:
        order.update(dict.fromkeys(needed(NEEDS.get(name, []))))
        order[name] = None
    return list(order)


def with_ctes(body: str, *names: str, **extra: str) -> str:
    """``body`` with the named shared tables, and any extra ones, in front."""
    parts = [f"{n} AS ({CTES[n]})" for n in needed(list(names))]
    parts += [f"{n} AS ({sql})" for n, sql in extra.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
