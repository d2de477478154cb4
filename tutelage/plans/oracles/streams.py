"""Check queries for the drained streams: they must equal the batch results."""

from __future__ import annotations

from tutelage.plans.oracles.base import CTES, needed
from tutelage.plans.oracles.base import with_ctes as q
from tutelage.plans.oracles.chunks import DOCS, STEPS
from tutelage.plans.oracles.study import STATE_COLS

EVENT_ATTEMPTS = """
  SELECT user_id AS learner_id, event_type AS topic, ts, event_id AS seq,
         CAST(floor(value) % 6 AS INT) AS quality, CAST(floor(value / 6) % 4 AS INT) AS confidence,
         '' AS note FROM events"""


def on_events(body: str, **extra: str) -> str:
    """The state tables of the batch checks, over events instead of lineitem."""
    tables = {n: CTES[n] for n in needed(["state"])}
    return q(body, **{**tables, "attempts": EVENT_ATTEMPTS, **extra})


ORACLES = {
    "stream_item_state": on_events(f"SELECT {STATE_COLS} FROM state"),
    # counters as of each attempt: running sums of what it changes about its item
    "stream_digest": on_events("""
      SELECT learner_id, n, tracked, mastered, due, blindspots FROM (
        SELECT learner_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY learner_id) AS total,
               sum(CASE WHEN prior IS NULL THEN 1 ELSE 0 END) OVER w AS tracked,
               sum(m - coalesce(prior.m, 0)) OVER w AS mastered, sum(d - coalesce(prior.d, 0)) OVER w AS due,
               sum(b - coalesce(prior.b, 0)) OVER w AS blindspots
        FROM changes WINDOW w AS (PARTITION BY learner_id ORDER BY ts, seq, topic ROWS UNBOUNDED PRECEDING))
      WHERE n % 5 = 0 OR n = total""", flags="""
        SELECT learner_id, topic, ts, seq, CAST(mastered AS INT) AS m,
               CAST(NOT mastered AND due <= TIMESTAMP '2024-01-30 12:00:00' AS INT) AS d,
               CAST(NOT mastered AND calibration = 'blindspot' AS INT) AS b FROM dues""",
                               changes="""
        SELECT *, lag({'m': m, 'd': d, 'b': b}) OVER (PARTITION BY learner_id, topic ORDER BY ts, seq) AS prior
        FROM flags"""),
    "stream_resume": q("""
      SELECT id, sha256(text) AS text_hash, length(text) AS chars, 'ok' AS status FROM chunks
      UNION ALL
      SELECT id, sha256(text || ' more'), length(text) + 5, 'ok' FROM chunks WHERE idx % 3 = 1""",
                       **{k: STEPS[k] for k in STEPS if k in DOCS}),
}
