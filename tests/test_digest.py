"""The digest's log, also after a stop between its writes; near duplicates in a stream against the same in a batch."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicfeed.operators import digest
from civicfeed.streaming import chat_state

CHATS = "chat_id long, chat_type string, last_digest_date date, last_message_id long, last_message_at timestamp"
MESSAGES = "chat_id long, id long, text string, created_at timestamp"


def day(n, hour=12):
    return dt.datetime(2024, 1, n, hour)


@pytest.fixture
def tables(spark):
    chats = [(1, "chat", None, None, None), (2, "chat", None, 3, None), (3, "chat", None, None, day(2)), (4, "removed", None, None, None), (5, "chat", dt.date(2024, 1, 5), None, None), (6, "chat", None, None, None)]
    rows = [(c, i, " " if i == 6 else f"text {i}", day(i)) for c in (1, 2, 3, 4, 5) for i in range(1, 7)]
    return spark.createDataFrame(chats, CHATS), spark.createDataFrame(rows, MESSAGES)


def outcome(df):
    return sorted((r.chat_id, r.n, r.sent, r.last_message_id) for r in df.collect())


def test_cursor_by_id_by_time_or_none(tables):
    got = digest.outcomes(*tables, F.lit(day(5)), 2, 12, 0, "UTC")
    assert outcome(got) == [(1, 5, True, 5), (2, 2, False, 3), (3, 3, True, 5), (6, 0, False, None)]
    texts = digest.texts(got, tables[1], tables[0])
    assert sorted((r.chat_id, r.id) for r in texts.collect()) == [(1, i) for i in range(1, 6)] + [(3, i) for i in (3, 4, 5)]


def test_log_is_one_write(spark, tables, tmp_path):
    log = digest.DigestLog(spark, str(tmp_path / "log"))
    chats, messages = tables
    sent = []

    def fails(rows, texts):
        sent.append(outcome(rows))
        raise RuntimeError("the network is gone")

    args = dict(least=2, hour=12, jitter=0, tz="UTC")
    with pytest.raises(RuntimeError):
        log.run(0, chats, messages, F.lit(day(5)), send=fails, **args)
    assert log.read().isEmpty() and outcome(log.unread(messages).groupBy("chat_id").agg(F.count("*").alias("n"), F.lit(True).alias("sent"), F.max("id").alias("last_message_id")))[0] == (1, 6, True, 6)
    # stopped within the write: files without the mark of a whole folder
    digest.outcomes(chats, messages, F.lit(day(5)), 0, 12, 0, "UTC").write.parquet(str(tmp_path / "log" / "cycle=0"))
    (tmp_path / "log" / "cycle=0" / "_SUCCESS").unlink()
    assert log.read().isEmpty()
    first = outcome(log.run(0, chats, messages, F.lit(day(5)), send=lambda r, t: sent.append(outcome(r)), **args))
    assert sent == [[(1, 5, True, 5), (3, 3, True, 5)]] * 2
    # again: the same rows, nothing goes out; later messages do not change them
    more = messages.union(spark.createDataFrame([(1, 7, "late", day(5)), (2, 8, "x", day(6)), (2, 9, "y", day(6))], MESSAGES))
    assert outcome(log.run(0, chats, more, F.lit(day(5)), send=fails, **args)) == first
    assert {(r.chat_id, r.id) for r in log.unread(more).filter("chat_id IN (1, 3)").collect()} == {(1, 6), (1, 7), (3, 6)}
    # the same day is done; the next day has quiet days' messages too
    assert outcome(log.run(1, chats, more, F.lit(day(5, 20)), **args)) == []
    assert outcome(log.run(2, chats, more, F.lit(day(6)), **args)) == [(1, 1, False, 5), (2, 4, True, 9), (3, 0, False, 5), (5, 5, True, 5), (6, 0, False, None)]


def test_cycles_of_a_stream(spark, tables, tmp_path):
    ticks = tmp_path / "ticks"
    log = digest.DigestLog(spark, str(tmp_path / "log"))
    for n in (5, 6):
        spark.createDataFrame([(day(n),)], "now timestamp").write.mode("append").parquet(str(ticks))
        stream = spark.readStream.schema("now timestamp").parquet(str(ticks))
        log.stream(stream, lambda: tables[0], lambda: tables[1], 2, 12, 0, str(tmp_path / "mark"), "UTC").awaitTermination()
    assert [r.n for r in log.read().groupBy("cycle").agg(F.count("*").alias("n")).orderBy("cycle").collect()] == [4, 5]


DRAFTS = "id long, address_id long, v array<double>, ts timestamp"


def in_turn(drafts, duplicate, days):
    events, out = [], {}
    for n, address, v, ts in sorted(drafts, key=lambda r: (r[3], r[0])):
        x = np.array(v) / max(np.linalg.norm(v), 1e-12)
        scores = [(round(float(x @ e[2]), 9), e[0]) for e in events if e[1] == address and e[3] >= ts - dt.timedelta(days=days)]
        best = max(scores, default=(-2, None))
        out[n] = best[1] if best[0] >= duplicate else None
        if out[n] is None:
            events.append((n, address, x, ts))
    return out


def test_stream_of_near_duplicates(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 5))
    start = dt.datetime(2024, 1, 1)
    drafts = [(i, None if i % 4 == 0 else i % 3, (centres[rng.integers(9)] + rng.normal(0, 0.2, 5)).tolist(), start + dt.timedelta(hours=6 * i)) for i in range(400)]
    source = tmp_path / "drafts"
    answers, kept = {}, []
    stream = None
    # the last batch is an hour of another lane, three months on
    batches = [drafts[i : i + 80] for i in range(0, 400, 80)] + [[(900 + k, 77, [1.0, 0.0, 0.0, 0.0, 0.0], start + dt.timedelta(days=200 + 40 * k))] for k in range(3)]
    for batch in batches:
        spark.createDataFrame(batch, DRAFTS).coalesce(1).write.mode("append").parquet(str(source))
        rows = chat_state.near_duplicates(spark.readStream.schema(DRAFTS).parquet(str(source)), 0.9)
        stream = rows.writeStream.foreachBatch(lambda b, _: answers.update({r.id: r.match_id for r in b.collect()})).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        stream.awaitTermination()
        kept.append(stream.lastProgress["stateOperators"][0]["numRowsTotal"])
    want = in_turn(drafts, 0.9, 30)
    assert {n: answers[n] for n in want} == want
    assert 0 < sum(m is not None for m in want.values()) < 400
    # four lanes while their events are live; after the horizon only the last lane is left
    assert kept[4] == 4 and kept[-1] == 1
