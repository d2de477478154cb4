"""Streams drained over several micro-batches."""

import random
from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_study import SCHEMA, T0
from tutelage.operators import grading, study
from tutelage.sources.keyed import KeyedTable
from tutelage.streaming import jobs, state
from tutelage.streaming.state import current_state


def log(spark, n=240):
    rng = random.Random(11)
    return spark.createDataFrame([
        (rng.randint(1, 3), rng.choice("ab"), T0 + timedelta(minutes=i), i,
         rng.choice([1, 3, 5, 5, 5]), rng.randint(0, 3), "") for i in range(n)], SCHEMA)


def source(spark, path):
    return spark.readStream.schema(SCHEMA).parquet(path)


def deliver(spark, root, parts, job):
    for i, part in enumerate(parts):
        part.write.parquet(f"{root}/in/{i}")
        job(source(spark, f"{root}/in/*"))


def test_state_with_shuffled_late_and_repeated_attempts(spark, tmp_path, monkeypatch):
    """Five batches without any order; the first comes again as a whole, a third of all twice."""
    monkeypatch.setattr(study, "SLOT_DAYS", 1)
    root = str(tmp_path)
    rows = log(spark, 400).withColumn("ts", F.expr("ts + make_dt_interval(seq % 7)")).cache()
    parts = [rows.where(f"hash(seq) % 4 = {k} or (seq % 3 = 0 and hash(seq) % 4 = {k - 1})") for k in (-1, 0, 1, 2, 3, -2, -3)]
    parts.append(rows.where("hash(seq) % 4 = 0"))
    seen = []
    for i, part in enumerate(parts):
        seen.append(part)
        deliver(spark, f"{root}/{i}", [part], lambda stream: jobs._drain(
            stream, lambda batch, _, n=i: state.take_in(batch, n, root), f"{root}/{i}"))
        if i in (1, len(parts) - 1):
            sofar = seen[0]
            for more in seen[1:]:
                sofar = sofar.unionByName(more)
            want = study.item_state(sofar.distinct())
            assert sorted(current_state(spark, root).select(*want.columns).collect()) == sorted(want.collect())


def test_state_reads_only_the_touched_slots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(study, "SLOT_DAYS", 1)
    root = str(tmp_path)
    rows = log(spark, 300).withColumn("ts", F.expr("ts + make_dt_interval(seq div 30)"))
    late = rows.where("seq >= 260 and learner_id = 1 and topic = 'a'")
    deliver(spark, root, [rows.where("seq < 260"), late], lambda s: jobs.run_item_state(s, root))
    table = state.slots_of(spark, root)
    assert {v[-1] for v in table.versions().values()} == {0, 1}    # buckets without new attempts stay
    want = study.item_state(rows.where("seq < 260").unionByName(late))
    assert sorted(current_state(spark, root).collect()) == sorted(want.collect())
    # a batch that runs again leaves the same tables
    before = sorted(table.read().collect(), key=str)
    state.take_in(late, 1, root)
    assert sorted(table.read().collect(), key=str) == before


def standings(rows, now):
    """Counters as of every fifth attempt of each learner and its last one, attempt by attempt."""
    out, items, n = [], {}, {}
    total = Counter(r.learner_id for r in rows)
    for r in sorted(rows, key=lambda r: (r.ts, r.seq, r.topic)):
        streak, mastered = items.get((r.learner_id, r.topic), (0, False, None))[:2]
        streak = streak + 1 if r.quality >= 4 else 0
        mastered = r.quality >= 4 and (mastered or (streak >= 2 and r.confidence >= 2))
        wait = timedelta(days={0: 1, 1: 1, 2: 1, 3: 2}.get(streak, 4)) if mastered else (
            timedelta(days=1) if r.quality >= 4 and r.confidence >= 2 else
            timedelta(minutes=7 if r.quality < 4 else 20 if streak == 1 else 40))
        items[r.learner_id, r.topic] = (streak, mastered, not mastered and r.ts + wait <= now,
                                        not mastered and r.quality < 3 and r.confidence >= 2)
        k = n[r.learner_id] = n.get(r.learner_id, 0) + 1
        if k % 5 == 0 or k == total[r.learner_id]:
            own = [v for (who, _), v in items.items() if who == r.learner_id]
            out.append((r.learner_id, k, len(own), *(sum(v[j] for v in own) for j in (1, 2, 3))))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 4, 12])
def test_digests_are_the_same_for_any_batches(spark, tmp_path, batches):
    root = str(tmp_path)
    rows = log(spark, 100)
    size = -(-100 // batches)
    now = T0 + timedelta(minutes=90)
    parts = [rows.where(f"seq div {size} = {b}") for b in range(batches)]
    parts[-1] = parts[-1].unionByName(rows.where("seq = 99"))      # delivered twice
    items, learners = KeyedTable(spark, f"{root}/items", study.KEY), KeyedTable(spark, f"{root}/learners", ["learner_id"])
    deliver(spark, root, parts if batches < 12 else parts[:1], lambda s: jobs.run_digests(
        s, root, F.lit(now).cast("timestamp_ntz")))
    if batches == 12:    # the same step, without starting a stream for each
        jobs.run_digests(rate(spark, root, parts[1:]), root, F.lit(now).cast("timestamp_ntz"))
    got = spark.read.parquet(f"{root}/digests").select("learner_id", "n", "tracked", "mastered", "due", "blindspots")
    assert sorted(map(tuple, got.collect())) == standings(rows.collect(), now)
    assert learners.read().agg(F.sum("n")).scalar() is not None and items.read().count() > 0


def rate(spark, root, parts):
    """Further parts written in order, read back one file at a time."""
    for i, part in enumerate(parts, 1):
        part.coalesce(1).write.parquet(f"{root}/in/{i:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")


def test_keyed_table_writes_touched_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    first = spark.createDataFrame([(i, i) for i in range(40)] + [(None, 7)], "k long, v long")
    table.upsert(first, 1, ["k"])
    assert table.upsert(first.where("false"), 2, ["k"]) == []
    written = table.upsert(spark.createDataFrame([(3, 300), (None, 70)], "k long, v long"), 5, ["k"])
    assert 1 <= len(written) <= 2
    assert {b for b, v in table.versions().items() if 5 in v} == set(written)
    rows = {r.k: r.v for r in table.read().collect()}
    assert rows == {**{i: i for i in range(40)}, 3: 300, None: 70} and table.read().count() == 41
    assert {r.k: r.v for r in table.read(before=5).collect()}[3] == 3


def test_resume_does_no_work_twice(spark, tmp_path):
    root = str(tmp_path)
    chunks = spark.createDataFrame([("a", "one"), ("b", "two")], "id string, text string")
    stream = spark.readStream.schema("id string, text string").parquet(f"{root}/in/*")

    def model(rows):
        return grading.annotate(rows, "id", "text", lambda: _upper(), 1)

    chunks.write.parquet(f"{root}/in/0")
    jobs.run_resume(stream, root, model)
    chunks.unionByName(spark.createDataFrame([("b", "new"), ("c", "three")], chunks.schema)
                       ).write.parquet(f"{root}/in/1")
    jobs.run_resume(stream, root, model)
    done = sorted(r.output for r in spark.read.parquet(f"{root}/annotated").collect())
    assert done == ["NEW", "ONE", "THREE", "TWO"]


def test_resume_keeps_two_texts_of_one_id_apart(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([("a", "x"), ("a", "xyz"), ("b", "y")], "id string, text string")
    rows.write.parquet(f"{root}/in/0")
    jobs.run_resume(spark.readStream.schema(rows.schema).parquet(f"{root}/in/*"), root,
                    lambda fresh: grading.annotate(fresh, "id", "text", lambda: _upper(), 1))
    done = spark.read.parquet(f"{root}/annotated")
    assert sorted((r.id, r.output) for r in done.collect()) == [("a", "X"), ("a", "XYZ"), ("b", "Y")]
    assert done.where(F.col("text_hash") == F.sha2(F.lower("output"), 256)).count() == 3


def test_resume_deals_rows_once(spark, tmp_path):
    """A batch comes to the model in the partitions asked for; repeats, null ids and null texts count once."""
    root, schema, parts = str(tmp_path), "id string, text string", []
    rows = [("a", "x"), ("a", "x"), ("a", "y"), (None, "x"), (None, "x"), ("b", None), ("+", "x"), (None, None)]

    def model(fresh):
        parts.append(fresh.rdd.getNumPartitions())
        return grading.annotate(fresh, "id", "text", lambda: lambda text, attempt: str(text), None)

    stream = spark.readStream.schema(schema).parquet(f"{root}/in/*")
    for number in range(2):
        spark.createDataFrame(rows + [("new", str(number))], schema).repartition(3).write.parquet(f"{root}/in/{number}")
        jobs.run_resume(stream, root, model, parallelism=5)
    done = sorted((str(r.id), r.output) for r in spark.read.parquet(f"{root}/annotated").collect())
    assert done == sorted((str(i), str(t)) for i, t in set(rows) | {("new", "0"), ("new", "1")})
    assert parts == [5, 5]


def _upper():
    return lambda text, attempt: text.upper()


def test_log_reader_streams_in_bounded_batches(spark, tmp_path):
    """Raw scores go through the same checks on a stream; small batches give the same state."""
    from tutelage.sources.attempts import RAW_ATTEMPT, accepted, attempt_log, read_attempts

    root = str(tmp_path)
    rows = log(spark, 60)
    raw = rows.withColumn("quality", F.col("quality").cast("string")).withColumn(
        "confidence", F.col("confidence").cast("string")).withColumn(
        "ts", F.col("ts").cast("timestamp"))
    raw.select(*RAW_ATTEMPT.names).write.parquet(f"{root}/in")
    stream = accepted(attempt_log(read_attempts(spark, f"{root}/in", stream=True, batch_bytes=1))).withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    jobs.run_item_state(stream, root)
    batch = study.item_state(accepted(attempt_log(read_attempts(spark, f"{root}/in"))).withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")))
    assert sorted(map(str, current_state(spark, root).collect())) == sorted(map(str, batch.collect()))
