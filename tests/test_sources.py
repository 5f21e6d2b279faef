"""Sources and sinks on files made here: odd names, missing and broken files, literals, and restarts of the stream."""

import os

import pytest
from pyspark.sql import functions as F

from tidewater.functions import mailtext as mt
from tidewater.sources import maildir, replies, state
from tidewater.streaming import follow

NAMES = ["1.h,U=7:2,RS", "2.h:2,T", "3.h", "4.h,U=4294967295", "5.h,U=0", "6.h,U=x,U=9:2,ZF", "7.h,U=" + "9" * 45, "8.h,U=18446744073709551615", "9.h,U=4294967298:2,D:2,S"]
WANT = {"1.h,U=7:2,RS": (7, 3), "2.h:2,T": (None, 8), "3.h": (None, 0), "4.h,U=4294967295": (4294967295, 0), "5.h,U=0": (None, 0), "6.h,U=x,U=9:2,ZF": (None, 4), NAMES[6]: (4294967295, 0), NAMES[7]: (4294967295, 0), NAMES[8]: (2, 17)}


def test_maildir(spark, tmp_path):
    spark.dataSource.register(maildir.Maildir)
    with pytest.raises(Exception):
        spark.read.format("maildir").load(str(tmp_path)).collect()
    maildir.ensure_maildir(str(tmp_path / "a/b"))
    maildir.ensure_maildir(str(tmp_path / "a/b"))
    assert sorted(os.listdir(tmp_path / "a/b")) == ["cur", "new", "tmp"] and os.stat(tmp_path / "a/b/new").st_mode & 0o777 == 0o700
    for d in ("cur", "new"):
        (tmp_path / d).mkdir()
    for k, n in enumerate(NAMES):
        (tmp_path / ("new" if k == 2 else "cur") / n).touch()
    (tmp_path / "cur/.hidden").touch()
    got = {r["name"]: (r["uid"], r["flags"], r["indir"]) for r in spark.read.format("maildir").load(str(tmp_path)).collect()}
    assert got == {n: (*v, int(n == "3.h")) for n, v in WANT.items()}
    assert set(maildir.folder_mtimes(str(tmp_path))) == {"curs", "curn", "news", "newn"}


def test_names_as_columns(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    assert {r["name"]: r["uid"] for r in df.select("name", mt.uid_of_name(F.col("name")).alias("uid")).collect()} == {n: v[0] for n, v in WANT.items()}


def test_state_file(tmp_path):
    path = str(tmp_path / "s")
    assert not maildir.read_state(path).present
    with open(path, "w") as out:
        out.write("FarUidValidity 7\nOther 3\nMaxPulledUid 40\n\n10 1 S\n11 2 \n5\nx y\n0 3 TZ\n")
    own = maildir.read_state(path)
    assert (own.present, own.fuidval, own.nuidval, own.maxpulled) == (True, 7, 0, 40)
    assert own.pairs == [(10, 1, 1), (11, 2, 0), (None, 3, 8)]
    state.write_state(path, own)
    assert maildir.read_state(path) == own and os.listdir(tmp_path) == ["s"]
    assert open(path).read().startswith("FarUidValidity 7\nNearUidValidity 0\nMaxPulledUid 40\nMaxPushedUid 0\n\n10 1 S\n")


def test_uid_validity_and_baseline(tmp_path):
    path = str(tmp_path / "u")
    assert maildir.read_uid_validity(path) is None and maildir.read_baseline(path) is None
    state.write_uid_validity(path, 9, 12)
    assert maildir.read_uid_validity(path) == (9, 12)
    open(path, "w").write("9 x")
    with pytest.raises(ValueError):
        maildir.read_uid_validity(path)
    own = {c: k for k, c in enumerate(c for names in maildir.BASELINE.values() for c in names)}
    state.write_baseline(path, own)
    assert maildir.read_baseline(path) == {"version": 2} | own
    open(path, "w").write("HmlState 1\nUidNext 5\n")
    assert maildir.read_baseline(path)["version"] == 1


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    assert state.load(spark, root, "pairs") is None
    for n in (3, 5):
        state.save({"pairs": spark.range(n), "headers": spark.range(1)}, root)
        assert state.load(spark, root, "pairs").count() == n
    assert state.load(spark, root, "headers").count() == 1


def test_logical_lines(spark):
    data = b"* 1 EXISTS\r\n* 2 FETCH (UID 5 BODY[] {8}\r\na\r\nb\rc\n)\n FLAGS (\\Seen))\r\nx {2}\r\n\r\ny\r\n"
    data = b"* 1 EXISTS\r\n* 2 FETCH (UID 5 BODY[] {7}\r\na\r\nb\rc\n FLAGS (\\Seen))\r\nx {2}\r\n\r\ny\r\n"
    want = [(b"* 1 EXISTS", None), (b"* 2 FETCH (UID 5 BODY[]  FLAGS (\\Seen))", b"a\nb\rc\n"), (b"x y", None)]
    assert list(replies.logical_lines(data)) == want
    assert list(replies.logical_lines(b"")) == []
    for cut in (b"abc", b"a {5}\r\nxy", b"a {2}\r\nxy"):
        with pytest.raises(ValueError):
            list(replies.logical_lines(cut))
    df = spark.createDataFrame([(1, bytearray(data)), (2, None)], "id long, data binary")
    rows = replies.reply_lines(df).orderBy("number")
    assert [(r["id"], r["line"].encode(), r["body"] and bytes(r["body"])) for r in rows.collect()] == [(1, *w) for w in want]
    got = rows.where("number = 1").select(mt.fetched_uid(F.col("line")).alias("u"), mt.fetched_flags(F.col("line")).alias("f")).first()
    assert tuple(got) == (5, 1)


def test_changes_stream(spark, tmp_path):
    seen = []
    take = lambda df, k: seen.append(sorted((r["uid"], r["flags"], r["modseq"]) for r in df.collect()))
    schema = "account int, channel int, uid bigint, flags int, modseq bigint"
    put = lambda rows: spark.createDataFrame([(0, 0, *r) for r in rows], schema).write.mode("append").parquet(str(tmp_path / "far"))
    run = lambda: follow(spark, str(tmp_path / "far"), str(tmp_path / "checkpoint"), take, after=2).awaitTermination()
    put([(1, 0, 1), (2, 0, 3), (3, 0, 4), (3, 1, 5)])
    run()
    assert seen == [[(2, 0, 3), (3, 1, 5)]]
    run()
    assert len(seen) == 1
    put([(1, 8, 9), (2, 0, 3)])
    run()
    assert seen[1:] == [[(1, 8, 9)]]
