"""Offsets, codecs and processing modes against plain restatements."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scans import numbered, prefix, previous
from tidemark.operators import codecs, modes, offsets

DONE = "topic string, partition int, offset bigint"
BASE = "topic string, partition int, base bigint"


def frontiers(spark, done, bases):
    found = offsets.frontier(spark.createDataFrame(done, DONE), spark.createDataFrame(bases, BASE)).collect()
    return {(r.topic, r.partition): r for r in found}


@pytest.mark.parametrize(
    ("base", "done", "want"),
    [(10, [], 10), (10, [11, 12], 12), (10, [12], 10), (10, [12, 11], 12), (10, [11, 13], 11), (10, [11, 13, 12], 13), (10, [11, 11, 11], 11), (10, [9, 11], 11),
     (0, [3, 1, 2, 5, 4], 5), (0, [*range(1, 128), 129], 127), (0, [*range(1, 130)], 129)],
)
def test_frontier_cases(spark, base, done, want):
    got = frontiers(spark, [("a", 0, o) for o in done], [("a", 0, base)])["a", 0]
    assert got.frontier == want and got.highest == max([base, *done])
    for kind in (codecs.SetTracker, codecs.BitTracker):
        t = kind(base)
        for o in done:
            t.mark(o)
        assert t.advance() == want and t.processed(want) and not t.processed(want + 1)


def test_frontier_over_many_buckets(spark):
    rng = random.Random(5)
    done = [("a", p, o) for p in (0, 1, 2) for o in range(5, 80_000) if not (p == 1 and o == 70_001) and not (p == 2 and o % 32_768 == 4)]
    rng.shuffle(done)
    bases = [("a", 0, 4), ("a", 1, 4), ("a", 2, 3), ("b", 0, 7)]
    got = frontiers(spark, [*done, ("z", 0, 1)], bases)
    assert [got["a", p].frontier for p in (0, 1, 2)] == [79_999, 70_000, 3] and got["b", 0].frontier == 7
    frame, base = spark.createDataFrame(done, DONE), spark.createDataFrame(bases, BASE)
    runs = {(r.partition, r.start, r.length) for r in offsets.runs(frame, base).collect()}
    assert (0, 5, 79_995) in runs and (1, 5, 69_996) in runs and (1, 70_002, 9_998) in runs and len(runs) == 6
    assert {(r.partition, r.start) for r in offsets.remainder_runs(frame, base).collect()} == {(1, 70_002), (2, 5), (2, 32_773), (2, 65_541)}


def test_snapshot_restores_what_is_out_of_order(spark):
    done = [o for o in range(0, 700) if o % 7 or o < 200]
    rows = [("a", 0, o) for o in done]
    frame, base = spark.createDataFrame(rows, DONE), spark.createDataFrame([("a", 0, -1)], BASE)
    s = codecs.encode_snapshots(offsets.snapshots(frame, base)).first()
    front = offsets.frontier(frame, base).first().frontier
    assert front == 202
    tracker = codecs.BitTracker.restore(front, codecs.decode_metadata(s.metadata))
    assert [o for o in range(1000) if tracker.processed(o)] == done
    assert codecs.decode_metadata(s.metadata) == (s.head_offset, s.head_index, list(s.words))


def test_trackers_agree_on_shuffled_offsets():
    rng = random.Random(12345)
    plain, bits = codecs.SetTracker(-1), codecs.BitTracker(-1)
    for at in range(0, 20_000, 64):
        window = list(range(at, at + 64))
        rng.shuffle(window)
        for k, o in enumerate(window):
            plain.mark(o), bits.mark(o)
            if k % 16 == 0:
                assert plain.advance() == bits.advance()
    assert plain.advance() == bits.advance() == 20_031


@pytest.mark.parametrize("name", list(codecs.CODECS))
def test_codecs_round_trip(name):
    rng = random.Random(3)
    codec = codecs.CODECS[name]
    dense = [rng.random() < (0.98 if k < 3000 else 0.2 if k < 5000 else 0.5) for k in range(6001)]
    for flags in ([], [1], [0], [1] * 64, [0] * 200, [1] * 1000 + [0] * 3000 + [1], dense, [1, 0] * 300):
        s = codecs.Snapshot(1_000_000, len(flags), sum(int(b) << k for k, b in enumerate(flags)))
        assert codec.decode(codec.encode(s)) == s
    if name not in ("raw", "zstd", "lz4"):
        with pytest.raises(ValueError):
            codec.decode(codec.encode(codecs.Snapshot(0, 300, (1 << 299) + 5))[:-1])


def test_metadata_forms():
    small, large = [5, -1], [-1] * 200
    assert codecs.unpack_words(codecs.pack_words(7, 1, small)) == (7, 1, small)
    assert codecs.pack_words(7, 1, small)[0] == codecs.RAW and codecs.pack_words(7, 1, large)[0] == codecs.ZSTD
    assert codecs.decode_metadata(codecs.encode_metadata(7, 0, large)) == (7, 0, large)
    rng = random.Random(1)
    noise = [rng.getrandbits(63) for _ in range(512)]
    assert codecs.encode_metadata(0, 0, noise) is None
    for bad in (b"", b"\x05" + bytes(16), codecs.pack_words(0, 0, small)[:-1]):
        with pytest.raises(ValueError):
            codecs.unpack_words(bad)
    with pytest.raises(ValueError, match="ahead"):
        codecs.BitTracker.restore(5, (7, 0, [0, 0]))


# --- modes

ROW = "topic string, partition int, offset bigint, key string, value string, timestamp_ms bigint, arrival bigint, window bigint, now_ms bigint, in_flight boolean"


def rows(spark, keys, flying=(), window=0, now=0):
    return spark.createDataFrame([("t", 0, k, key, "v", 0, k, window, now, k in flying) for k, key in enumerate(keys, 1)], ROW)


def verdicts(frame):
    found = frame.orderBy("arrival").collect()
    return [r.offset for r in found if r.outcome == "processed"], [(r.offset, r.reason) for r in found if r.outcome == "dropped"]


@pytest.mark.parametrize(
    ("keys", "capacity", "done", "dropped"),
    [(["hot"] * 3, 4, [1, 3], [(2, "replaced_by_newer_key_record")]), (["a", "b", "c"], 1, [1, 2], [(3, "new_key_queue_full")]),
     (["a", "b", "b", "c"], 1, [1, 3], [(2, "replaced_by_newer_key_record"), (4, "new_key_queue_full")])],
)
def test_replace_pending_with_one_in_flight(spark, keys, capacity, done, dropped):
    assert verdicts(modes.replace_pending(rows(spark, keys, {1}), capacity)) == (done, dropped)


def test_modes_against_sequential_windows(spark):
    rng = random.Random(8)
    data, at = [], 0
    for window in range(12):
        for _ in range(rng.randrange(1, 40)):
            at += 1
            data.append(("t", at % 2, at, rng.choice([None, "a", "b", "c", "d", "e"]), "v", rng.choice([0, 50, 90]), at, window, 100, False))
    frame, n = spark.createDataFrame(data, ROW), 3
    oldest, replaced, pool = {}, {}, {}
    for window in range(12):
        mine = [r for r in data if r[7] == window]
        queue, pending = [], {}
        for r in mine:
            pool[r[2]] = None if len(queue) < n else "admission_failed"
            queue.append(r)
            if r[3] in pending:
                replaced[pending[r[3]]] = "replaced_by_newer_key_record"
                pending[r[3]] = r[2]
            elif len(pending) < n:
                pending[r[3]] = r[2]
            else:
                replaced[r[2]] = "new_key_queue_full"
        for k, r in enumerate(queue):
            oldest[r[2]] = "queue_overflow" if k < len(queue) - n else "stale_age" if r[5] > 0 and 100 - r[5] > 20 else None
        for o in pending.values():
            ts = data[o - 1][5]
            replaced[o] = "stale_age" if ts > 0 and 100 - ts > 20 else None
    reasons = lambda f: {r.offset: r.reason for r in f.collect()}
    assert reasons(modes.drop_oldest(frame, n, max_age_ms=20)) == oldest
    assert reasons(modes.replace_pending(frame, n, max_age_ms=20)) == replaced
    assert reasons(modes.bounded_pool(frame, n)) == pool


def test_lanes(spark):
    frame = rows(spark, ["a", None, "a", None, "b"])
    got = [(r.lane, r.seq) for r in modes.key_ordering(frame, chunk=2).orderBy("arrival").collect()]
    assert got == [("k:a", 0), ("null", 0), ("k:a", 1), ("null", 1), ("k:b", 0)]
    got = [(r.lane, r.seq) for r in modes.partition_ordering(frame, chunk=2).orderBy("arrival").collect()]
    assert got == [("p:t/0", k) for k in range(5)]


def test_mode_options():
    assert modes.Mode.AT_LEAST_ONCE_KEY_ORDERING.tracks_offsets and modes.Mode.FRESHNESS_FIRST_DROP_OLDEST.is_freshness_first
    with pytest.raises(ValueError):
        modes.apply_mode(None, modes.Mode.AT_LEAST_ONCE_NO_ORDERING, modes.ModeOptions(max_age_ms=1))
    with pytest.raises(ValueError):
        modes.drop_oldest(None, 0)


def test_two_level_scans_equal_plain_windows(spark):
    rng = random.Random(2)
    data = [(rng.choice("ab"), k, rng.choice([None, *range(9)])) for k in range(300)]
    frame = spark.createDataFrame(data, "g string, k bigint, v bigint")
    chunk = F.expr("k div 17")
    for kind in ("max", "min", "sum"):
        one, two = (prefix(frame, "x", F.col("v"), ["g"], ["k"], kind, c) for c in (None, chunk))
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    for make in (lambda c: previous(frame, "x", F.col("v"), ["g"], ["k"], c), lambda c: numbered(frame, "x", ["g"], ["k"], c)):
        assert sorted(map(str, make(None).collect())) == sorted(map(str, make(chunk).collect()))
