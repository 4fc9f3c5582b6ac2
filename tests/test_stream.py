"""The incremental corpus: state that expires, late rows on the side, settling."""

import os

import pytest

from offerlens.sources import stages as ST
from offerlens.streaming import incremental as IN

EVENTS = "event_id long, user_id long, ts timestamp, event_type string, props string"


def put(spark, folder, name, rows):
    """One source file of (event_id, day) rows; day None has no event time."""
    df = spark.createDataFrame([(i, d) for i, d in rows], "event_id long, d int").selectExpr(
        "event_id", "event_id % 7 user_id", "if(d is null, null, make_timestamp(2024, 1, d, 0, 0, 0)) ts", "'view' event_type", "concat('p', event_id) props")
    df.coalesce(1).write.parquet(f"{folder}/{name}-folder")
    part = next(f for f in os.listdir(f"{folder}/{name}-folder") if f.endswith(".parquet"))
    with open(f"{folder}/{name}-folder/{part}", "rb") as f, open(f"{folder}/events-{name}.parquet", "wb") as g:
        g.write(f.read())


@pytest.fixture()
def paths(tmp_path):
    (tmp_path / "in").mkdir()
    return str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")


def drain(spark, paths):
    src, out, ck = paths
    IN.run_incremental(spark, src, out, ck, "events-*.parquet", max_files=1, delay="2 days")
    return sorted(r.event_id if r.event_id is not None else -1 for r in IN.corpus(spark, out).collect())


def test_out_of_order_late_and_repeated_rows(spark, paths):
    src, out, _ = paths
    put(spark, src, "0", [(i, 5) for i in range(10)] + [(0, 5), (3, 5)])   # repeats within a file
    put(spark, src, "1", [(10 + i, 4) for i in range(10)] + [(1, 5)])       # out of order, but within the delay; a repeat
    put(spark, src, "2", [(20 + i, 20) for i in range(10)])                 # the watermark moves on to the 18th
    put(spark, src, "3", [(30 + i, 3) for i in range(10)] + [(2, 5), (11, 4), (30, 3)])  # too late, and late repeats
    put(spark, src, "4", [(40, None), (40, None), (None, 20), (None, 20), (25, 20)])
    let_through = drain(spark, paths)
    assert let_through == list(range(30))                                   # nothing twice, late rows wait
    assert spark.read.parquet(f"{out}/late").where("event_id between 30 and 39").count() == 11
    assert IN.settle(spark, out) == spark.read.parquet(f"{out}/late").agg({"epoch": "max"}).first()[0] + 1
    assert sorted(r.event_id if r.event_id is not None else -1 for r in IN.corpus(spark, out).collect()) == [-1, -1, *range(41)]
    assert not os.path.exists(f"{out}/work") or os.listdir(f"{out}/work") == []

    # further files: what was settled is not added again, and a settling finds nothing to do
    put(spark, src, "5", [(31, 3), (50, 21), (26, 20)])
    drain(spark, paths)
    IN.settle(spark, out)
    done = sorted(r.event_id if r.event_id is not None else -1 for r in IN.corpus(spark, out).collect())
    assert done == [-1, -1, *range(41), 50]
    before = ST.read_manifest(spark, out)
    assert IN.settle(spark, out) == int(before["data"]) and len(IN.corpus(spark, out).collect()) == len(done)


def test_batches_read_no_earlier_output(spark, paths):
    src, out, _ = paths
    put(spark, src, "0", [(i, 5) for i in range(5)])
    drain(spark, paths)
    broken = []
    for folder, _, names in os.walk(out):
        for n in names:
            if n.endswith(".parquet"):
                broken.append(os.path.join(folder, n))
                os.truncate(broken[-1], 3)  # can be read no more
    assert broken
    put(spark, src, "1", [(i, 5) for i in range(3, 8)])
    IN.run_incremental(spark, src, out, paths[2], "events-*.parquet", max_files=1, delay="2 days")
    found = []
    for e in os.listdir(f"{out}/fresh"):
        if not any(f"/fresh/{e}/" in b for b in broken):
            found += [r.event_id for r in spark.read.parquet(f"{out}/fresh/{e}").collect()]
    assert sorted(found) == [5, 6, 7]  # the state knows 3 and 4


def test_a_settling_that_broke_off_is_done_again(spark, paths, monkeypatch):
    src, out, _ = paths
    put(spark, src, "0", [(i, 20) for i in range(5)])
    drain(spark, paths)  # rows count as late from the batch after the one that moves the watermark
    put(spark, src, "1", [(i, 3) for i in range(5, 9)])
    assert drain(spark, paths) == [0, 1, 2, 3, 4]

    def lost(*a):
        raise RuntimeError("before the manifest")

    with monkeypatch.context() as m:
        m.setattr(IN, "publish", lost)
        with pytest.raises(RuntimeError):
            IN.settle(spark, out)
    assert [r for r in IN.corpus(spark, out).collect() if r.event_id > 4] == []  # not counted before it is complete
    put(spark, src, "2", [(i, 2) for i in range(9, 11)])
    drain(spark, paths)
    IN.settle(spark, out)
    assert sorted(r.event_id for r in IN.corpus(spark, out).collect()) == list(range(11))
