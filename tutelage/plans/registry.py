"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from tutelage.plans import (
    bank_queries,
    chunk_queries,
    course_queries,
    maths_queries,
    stream_queries,
    study_queries,
)
from tutelage.plans.oracles import bank, chunks, course, maths, streams, study
from tutelage.session import ship_package

_QUERY_SETS = [study_queries, bank_queries, chunk_queries, course_queries, maths_queries,
               stream_queries]
_ORACLE_SETS = [study, bank, chunks, course, maths, streams]


def _shipped(query):
    """Queries may run Python in tasks, so the executors need the package."""
    def run(spark, sf):
        ship_package(spark)
        return query(spark, sf)
    return run


QUERIES = {k: _shipped(f) for m in _QUERY_SETS for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _ORACLE_SETS for k, s in m.ORACLES.items()}
