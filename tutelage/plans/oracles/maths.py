"""Check queries for equation catalogs and practice.

The catalog has eight known shapes, so the checks state each shape's formula,
faults and wording directly.
"""

from __future__ import annotations

from tutelage.plans.oracles.base import with_ctes as q

EQ = """
  SELECT CASE WHEN p_partkey % 31 = 0 THEN 'eq' || (p_partkey - p_partkey % 2)
              ELSE 'eq' || p_partkey END AS id,
         'module_' || substr(p_brand, 7) AS module, p_type AS topic,
         CASE WHEN p_partkey % 37 = 0 THEN '' ELSE p_name || ' ' || p_partkey END AS name,
         CASE WHEN p_partkey % 41 = 0 THEN ' ' ELSE
           ['(d_lap * k * 3.5) / t_lap', '-x^2 + y', '2^-n * c0',
            '(d_lap * k * 4.5) / t_lap', 'x * missing', 'x / (y - y)', 'x * (y',
            'sqrt(x) + max(y, 3)'][p_partkey % 8 + 1] END AS expr,
         p_partkey AS pos, p_partkey % 8 AS shape, CAST(p_size AS DOUBLE) AS size,
         CAST(5 + p_size % 5 AS DOUBLE) AS span,
         [3, 2, 2, 3, 1, 2, 2, 3][p_partkey % 8 + 1] AS n_vars,
         CASE WHEN p_partkey % 8 IN (0, 1, 3, 7) THEN 1 ELSE 0 END AS n_examples
  FROM part"""
VARS = """
  SELECT e.id AS equation_id, e.pos AS eq_pos, CAST(v.pos AS INT) AS pos, v.name, v.unit, v.role,
         CAST(v.lo AS DOUBLE) AS min,
         CASE WHEN shape = 1 AND v.name = 'x' THEN span ELSE CAST(v.hi AS DOUBLE) END AS max,
         CAST(v.step AS DOUBLE) AS step,
         CASE WHEN shape = 1 AND v.name = 'y' THEN size WHEN v.name = 'c0' THEN size + 1
              ELSE CAST(v.val AS DOUBLE) END AS value, CAST(v.decimals AS INT) AS decimals
  FROM eq e JOIN (VALUES
    (0, 0, 'd_lap', 'm', 'input', 200, 800, 12.5, 0, 1), (0, 1, 'k', '', 'constant', 0, 0, 0, 0.25, 0),
    (0, 2, 't_lap', 's', 'input', 30, 90, 2, 0, 0), (1, 0, 'x', '', 'input', 0, 0, 0, 0, 2),
    (1, 1, 'y', '', 'constant', 0, 0, 0, 0, 0), (2, 0, 'n', '', 'input', 1, 6, 1, 0, 0),
    (2, 1, 'c0', '', 'constant', 0, 0, 0, 0, 0), (3, 0, 'd_lap', 'm', 'input', 200, 800, 12.5, 0, 1),
    (3, 1, 'k', '', 'constant', 0, 0, 0, 0.25, 0), (3, 2, 't_lap', 's', 'input', 30, 90, 2, 0, 0),
    (4, 0, 'x', '', 'input', 10, 5, 0, 0, 0), (5, 0, 'x', '', 'input', 1, 2, 0, 0, 0),
    (5, 1, 'y', '', 'input', 1, 3, 0, 0, 0), (6, 0, 'x', '', 'input', 1, 2, 0, 0, 0),
    (6, 1, 'y', '', 'input', 1, 3, 0, 0, 0), (7, 0, 'x', '', 'input', 1, 9, 0, 0, 0),
    (7, 1, 'y', '', 'input', 2, 2, -1, 0, 0), (7, 2, '', '', 'input', 0, 0, 0, 0, 0)
  ) v(s, pos, name, unit, role, lo, hi, step, val, decimals) ON v.s = e.shape"""
ISSUES = """
  SELECT id AS equation_id, pos, 'duplicate id' AS reason
  FROM (SELECT *, min(pos) OVER (PARTITION BY id) AS first_pos FROM eq) WHERE pos > first_pos
  UNION ALL SELECT id, pos, 'missing name' FROM eq WHERE name = ''
  UNION ALL SELECT id, pos, 'missing expr' FROM eq WHERE expr = ' '
  UNION ALL SELECT id, pos, 'expr does not parse' FROM eq WHERE shape = 6 AND expr <> ' '
  UNION ALL
  SELECT id, pos, r FROM eq JOIN (VALUES
    (3, 'example 0: formula disagrees with the source'), (4, 'variable "x": max below min'),
    (4, 'undeclared variable "missing"'),
    (4, 'mid-range sample: undefined variable "missing"'),
    (5, 'mid-range sample: division by zero'), (7, 'variable "y": empty range'),
    (7, 'variable "y": negative step'), (7, 'variable with empty name'),
    (7, 'undeclared placeholder "zz"')) v(s, r) ON v.s = eq.shape
  WHERE expr <> ' '"""
CLEAN = "SELECT * FROM eq WHERE id NOT IN (SELECT equation_id FROM issues)"
STEPS = {"eq": EQ, "vars": VARS, "issues": ISSUES, "clean": CLEAN}


def on(body: str, *names: str, **extra: str) -> str:
    return q(body, *names, **STEPS, **extra)


ROUND = "sign({0}) * floor(abs({0}) + 0.5)"


def _draw(key: str, lo: str, hi: str, step: str | None) -> str:
    """One draw: uniform from the key's md5, snapped to the grid or two decimals."""
    raw = (f"({lo} + CAST(('0x' || left(md5({key}), 8)) AS BIGINT) / 4294967296.0 "
           f"* ({hi} - {lo}))")
    if step is None:
        return ROUND.format(f"({raw} * 100.0)") + " / 100.0"
    snapped = f"({ROUND.format(f'({raw} / {step})')} * {step})"
    up = f"(CASE WHEN {snapped} < {lo} THEN {snapped} + {step} ELSE {snapped} END)"
    return f"(CASE WHEN {up} > {hi} THEN {up} - {step} ELSE {up} END)"


def drawn(source: str, key: str) -> str:
    """Draws and solved answers of the three sound shapes."""
    return f"""
      SELECT *, CASE shape WHEN 0 THEN (a * 0.25::DOUBLE * 3.5::DOUBLE) / b WHEN 1 THEN -(a * a) + size
                ELSE pow(2, -a) * (size + 1) END AS answer
      FROM (SELECT *,
        CASE shape WHEN 0 THEN {_draw(key + " || '|d_lap'", '200.0::DOUBLE', '800.0::DOUBLE', '12.5::DOUBLE')}
          WHEN 1 THEN {_draw(key + " || '|x'", '0.0::DOUBLE', 'span', None)}
          ELSE {_draw(key + " || '|n'", '1.0::DOUBLE', '6.0::DOUBLE', '1.0::DOUBLE')} END AS a,
        CASE shape WHEN 0 THEN {_draw(key + " || '|t_lap'", '30.0::DOUBLE', '90.0::DOUBLE', '2.0::DOUBLE')}
          END AS b
        FROM ({source}))"""


def _text(x: str, places: int = 6) -> str:
    return f"rtrim(rtrim(printf('%.{places}f', {x}), '0'), '.')"


SOLVED = f"""
  SELECT *, CASE shape WHEN 0 THEN 'A lap of ' || {_text('a')} || ' m is run in ' || {_text('b')} || ' s. How fast is that?'
            WHEN 1 THEN 'Given x = ' || {_text('a')} || ', calculate ' || name || '.'
            ELSE 'Given n = ' || {_text('a')} || ', calculate ' || name || '.' END AS question,
         CASE shape WHEN 0 THEN {_text('answer', 3)} || ' m/s' WHEN 1 THEN {_text('answer', 4)}
              ELSE {_text('answer', 5)} END AS answer_text
  FROM drawn"""
POSED = """
  SELECT a.learner_id, e.id AS equation_id, d.draw, e.*
  FROM (SELECT DISTINCT learner_id, 'eq' || topic AS equation_id FROM attempts) a
  JOIN clean e ON e.id = a.equation_id, (VALUES (1), (2)) d(draw)"""
KEY = "'1|' || learner_id || '|' || id || '|' || draw"
SLOTS = """
  SELECT c.*, s.kind, s.slot FROM clean c, (VALUES (0, 1), (1, 1), (1, 2), (1, 3), (1, 4), (2, 1))
         s(kind, slot)
  WHERE s.kind < 2 OR (SELECT count(*) FROM clean o WHERE o.module = c.module
                       AND o.topic = c.topic) >= 2"""
SLOT_KEY = "'1|' || module || '|' || id || '|' || kind || '.' || slot"

ORACLES = {
    "load_catalog": on("""
      SELECT 'p' AS program, id, module, topic, name, expr, CAST(n_vars AS INT) AS n_vars,
             CAST(CASE WHEN shape < 3 THEN shape + 3 ELSE 0 END AS INT) AS decimals, n_examples
      FROM eq"""),
    "load_catalog_variables": on("""
      SELECT equation_id, pos, name, name AS symbol, unit, role, min, max, step, value, decimals
      FROM vars"""),
    "load_catalog_examples": on("""
      SELECT id AS equation_id, 0 AS pos, CASE WHEN shape = 1 THEN 1 ELSE 2 END AS n_inputs,
             CASE shape WHEN 1 THEN size - 4 WHEN 7 THEN 5.0 ELSE 5.25 END AS expected,
             0.0 AS tol
      FROM eq WHERE n_examples = 1"""),
    "catalog_order": on("SELECT module, topic, name, id FROM eq"),
    "eval_formulas": on("""
      SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
             CASE WHEN expr = ' ' THEN NULL ELSE round(CASE shape
               WHEN 0 THEN ((200 + s * 600) * 0.25::DOUBLE * 3.5::DOUBLE) / (30 + s * 60)
               WHEN 1 THEN -((s * span) * (s * span)) + size
               WHEN 2 THEN pow(2, -(1 + s * 5)) * (size + 1)
               WHEN 3 THEN ((200 + s * 600) * 0.25::DOUBLE * 4.5::DOUBLE) / (30 + s * 60)
               WHEN 7 THEN sqrt(1 + s * 8) + 3 END, 6) END AS value,
             CASE WHEN expr = ' ' THEN 'does not parse' ELSE CASE shape
               WHEN 4 THEN 'undefined variable "missing"' WHEN 5 THEN 'division by zero'
               WHEN 6 THEN 'does not parse' END END AS error
      FROM (SELECT *, l_quantity / 50 AS s FROM lineitem) JOIN eq ON eq.pos = l_partkey"""),
    "validate_catalog": on("SELECT * FROM issues"),
    "filter_catalog": on("""
      SELECT id, pos, n_examples > 0 AS verified,
             id NOT IN (SELECT equation_id FROM issues) AS kept FROM eq"""),
    "sample_inputs": on("""
      SELECT learner_id, equation_id, draw, unnest([['d_lap', 'k', 't_lap'], ['x', 'y'], ['n', 'c0']][shape + 1]) AS name,
             unnest([[a, 0.25::DOUBLE, b], [a, size], [a, size + 1]][shape + 1]) AS value FROM drawn""",
                        "attempts", posed=POSED, drawn=drawn("SELECT * FROM posed", KEY)),
    "generate_problems": on(f"""
      SELECT learner_id, equation_id, draw, question, round(answer, 6) AS answer, answer_text,
             CASE shape WHEN 0 THEN 'v_mean = (d_lap × k × 3.5) / t_lap | v_mean = (' || {_text('a')}
                    || ' × 0.25 × 3.5) / ' || {_text('b')} || ' | v_mean = ' || answer_text
               WHEN 1 THEN 'answer = -x^2 + y | answer = -' || {_text('a')} || '^2 + ' ||
                    {_text('size')} || ' | answer = ' || answer_text
               ELSE 'answer = 2^-n * c0 | answer = 2^-' || {_text('a')} || ' × ' ||
                    {_text('size + 1')} || ' | answer = ' || answer_text END AS steps
      FROM solved""", "attempts", posed=POSED, drawn=drawn("SELECT * FROM posed", KEY),
                            solved=SOLVED),
    "practice_set": on("""
      SELECT module, topic, id AS equation_id, kind, slot,
             CASE kind WHEN 1 THEN 'P' || number WHEN 2 THEN 'C' || number || '(' ||
               substr('abcde', CAST(part AS INT), 1) || ')' ELSE '' END AS label,
             question, answer_text
      FROM (SELECT *, sum(CASE WHEN kind = 1 OR (kind = 2 AND part = 1) THEN 1 ELSE 0 END) OVER (
              PARTITION BY module ORDER BY topic, kind = 2, CASE WHEN kind = 2 THEN part END,
              name, id, kind, slot ROWS UNBOUNDED PRECEDING) AS number
            FROM (SELECT *, row_number() OVER (PARTITION BY module, topic, kind, slot
                    ORDER BY name, id) AS part FROM solved)
            WHERE kind < 2 OR part <= 5)""",
                       slots=SLOTS, drawn=drawn("SELECT * FROM slots", SLOT_KEY), solved=SOLVED),
    "check_sheets": """
      SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'empty' WHEN doc_id % 5 = 3
               AND NOT starts_with(text, '#') THEN 'not markdown' ELSE 'ok' END AS status,
             CAST(CASE WHEN doc_id % 5 = 4 OR (doc_id % 5 = 3 AND NOT starts_with(text, '#')) THEN 0
               ELSE (len(string_split(text, chr(10))) + 1) // 3 END AS INT) AS equations
      FROM documents""",
}
