"""Streaming jobs drained over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tutelage.operators import grading
from tutelage.plans import fixtures as fx
from tutelage.session import shared_dir
from tutelage.sources.attempts import BATCH_BYTES
from tutelage.streaming import jobs
from tutelage.streaming.state import current_state

def _delivered(s, d, root, parts, job):
    """``events`` as attempts, delivered in ``parts``: each is written as it comes and drained by ``job``."""
    events = fx.table(s, d, "events")
    stream = fx.event_attempts(s.readStream.schema(events.schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(f"{root}/in/*"))
    for number, part in enumerate(parts):
        events.where(part).write.parquet(f"{root}/in/{number}")
        job(stream)


def _state(s, d):
    """Four deliveries without any order of time, so most attempts come late; some come twice."""
    root = shared_dir(s, "stream-state")
    drawn = F.pmod(F.xxhash64("event_id"), F.lit(4))
    parts = [(drawn == i) | ((drawn == i - 1) & (F.col("event_id") % 5 == 0)) for i in range(4)]
    _delivered(s, d, root, parts, lambda stream: jobs.run_item_state(stream, root))
    return current_state(s, root)


def _digest(s, d):
    """Four deliveries in order of time."""
    root = shared_dir(s, "stream-digest")
    week = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))
    parts = [week == i for i in range(4)]
    _delivered(s, d, root, parts, lambda stream: jobs.run_digests(
        stream, root, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")))
    return s.read.parquet(f"{root}/digests").drop("batch")


def _length_model():
    return lambda text, attempt: str(len(text))


def _resume(s, d):
    """All chunks are delivered, then delivered again with some texts changed."""
    root = shared_dir(s, "stream-resume")
    chunks = fx.chunks(s, d, keep=False).select("id", "idx", "text")
    source = s.readStream.schema(chunks.schema).parquet(f"{root}/in/*")

    def model(rows):
        return grading.annotate(rows, "id", "text", lambda: _length_model(), None)

    chunks.write.parquet(f"{root}/in/1")
    jobs.run_resume(source, root, model, parallelism=8)
    s.read.schema(chunks.schema).parquet(f"{root}/in/1").withColumn("text", F.when(
        F.col("idx") % 3 == 1, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))).write.parquet(f"{root}/in/2")
    jobs.run_resume(source, root, model, parallelism=8)
    done = s.read.parquet(f"{root}/annotated")
    return done.select("id", "text_hash", F.col("output").cast("int").alias("chars"), "status")


QUERIES = {"stream_item_state": _state, "stream_digest": _digest, "stream_resume": _resume}
