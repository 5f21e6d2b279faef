"""Reconciliation on small hand-made mailboxes whose folders share uids."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from tidewater.functions import flags as fl
from tidewater.operators import reconcile as rc
from tidewater.plans.run import Run
from tidewater.sources import state

KEY = "account int, channel int"


def mailbox(spark, folders, **how):
    """folders: {channel: dict(expunge, pairs, near, far, state, stats, baseline)}; a state of None is a folder never synced."""
    rows = {k: [] for k in ("channels", "pairs", "near", "far", "state", "stats", "baseline", "mtimes")}
    for ch, f in folders.items():
        at = (0, ch)
        rows["channels"].append((*at, f.get("expunge", True)))
        rows["pairs"] += [(*at, *p) for p in f.get("pairs", [])]
        rows["near"] += [(*at, *n) for n in f.get("near", [])]
        rows["far"] += [(*at, *m) for m in f.get("far", [])]
        far = f.get("far", [])
        top = f.get("maxpulled", max([p[0] or 0 for p in f.get("pairs", [])] or [0]))
        if f.get("state", True):
            rows["state"].append((*at, True, 7, 9, top, top, 9, f.get("uvlast", top), f.get("journal", False)))
        rows["stats"].append((*at, f.get("exists", len(far)), f.get("validity", 7), max([m[0] for m in far] or [0]) + 1, f.get("modseq", 100)))
        if "baseline" in f:
            rows["baseline"].append((*at, *f["baseline"]))
        rows["mtimes"].append((*at, 1, 2, 3, 4))
    schema = {
        "channels": "expunge boolean",
        "pairs": "fuid long, nuid long, flags int",
        "near": "uid long, flags int, name string, indir int",
        "far": "uid long, flags int, modseq long",
        "state": "present boolean, fuidval int, nuidval int, maxpulled long, maxpushed long, uvval int, uvlast long, journal boolean",
        "stats": "`exists` long, uidvalidity int, uidnext long, modseq long",
        "baseline": "version int, uidval int, uidnext long, `exists` long, modseq long, ghosts long, nlocal long, curs int, curn int, news int, newn int",
        "mtimes": "curs int, curn int, news int, newn int",
    }
    return rc.Mailbox(**{t: spark.createDataFrame(rows[t], f"{KEY}, {schema[t]}") for t in rows}, **how)


def lines(box):
    out = rc.outcomes(box)
    acts = rc.actions(out, rc.to_pull(box), rc.to_push(box))
    return {r["channel"]: (r["rc"], re.sub(r"^remote +\d+  local +\d+  ", "", r["line"])) for r in rc.report(box, rc.folder_counts(box, out, acts)).collect()}


def test_lines_and_codes(spark):
    box = mailbox(
        spark,
        {
            0: dict(pairs=[(5, 5, 0)], near=[], far=[], maxpulled=5, exists=1),  # outcome A alone, and a message beyond the listing
            1: dict(pairs=[(5, 5, 0)], near=[(5, 1, "a", 0)], far=[(5, 0, 1)]),  # one flag to set remotely
            2: dict(pairs=[(None, 5, 0)], near=[(5, 0, "a", 0)], far=[(3, 0, 1)], maxpulled=3),  # nothing alive, one untracked
            3: dict(state=None, near=[(None, 0, "n", 1)], far=[(9, 0, 1), (10, 0, 1), (11, 8, 1)]),
            4: dict(pairs=[(5, 5, 0)], near=[(5, 0, "a", 0)], far=[(5, 0, 1)], validity=8),
            5: dict(pairs=[(5, 5, 0)], near=[(5, 0, "a", 0)], far=[(5, 0, 1)], journal=True),
            6: dict(expunge=False, pairs=[(5, 5, 0)], near=[(5, 8, "a", 0)], far=[(5, 0, 1), (4, 8, 1)]),
        },
    )
    got = lines(box)
    assert got[0] == (1, "1 gone remote")
    assert got[1] == (1, "1 flag updates for remote")
    assert got[2] == (0, "1 remote untracked (skipped)")
    assert got[3] == (1, "2 to pull, 1 to push, no sync state, 1 ghost-deleted remote")
    assert got[4][0] == 2 and "state 7, server 8" in got[4][1]
    assert got[5] == (0, "mbsync journal present")
    assert got[6] == (0, "1 trashed, kept (no expunge here), 1 ghost-deleted remote")
    shown = [r["text"] for r in rc.dry_run(rc.actions(rc.outcomes(box), rc.to_pull(box), rc.to_push(box))).where("channel = 3").orderBy("line").collect()]
    assert shown == ["would pull uid 9", "would pull uid 10", "would push n"]
    counts = {r["channel"]: r["alive"] for r in rc.count_check(box).collect()}
    assert counts[2] == 0 and counts[1] == 1


def test_sync_run_reports_what_was_done(spark):
    folder = dict(pairs=[(5, 5, 0), (6, 6, 0)], near=[(5, 0, "a", 0), (None, 0, "n", 0)], far=[(5, 1, 1), (6, 0, 1), (7, 0, 1)], maxpulled=6)
    got = lines(mailbox(spark, {0: folder, 1: folder | {"journal": True}}, sync=True))
    assert got[0] == (0, "pulled 1, pushed 1, 1 flag updates remote, 1 flag updates local, expunged 1 remote")
    assert got[1][0] == 2


def test_fast_path_and_baseline(spark):
    quiet = dict(pairs=[(5, 5, 0)], near=[(5, 0, "a", 0)], far=[(5, 0, 1)])
    base = lambda **x: tuple(({"version": 2, "uidval": 7, "uidnext": 6, "exists": 1, "modseq": 100, "ghosts": 0, "nlocal": 1, "curs": 1, "curn": 2, "news": 3, "newn": 4} | x).values())
    box = mailbox(spark, {0: quiet | {"baseline": base()}, 1: quiet | {"baseline": base(curn=9)}, 2: quiet | {"baseline": base(version=1)}, 3: quiet | {"baseline": base(modseq=0), "modseq": 0}, 4: quiet | {"baseline": base(uidval=6)}})
    verdicts = {r["channel"]: (r["verdict"], r["valid"]) for r in rc.folders(box).collect()}
    assert verdicts == {0: ("fast", True), 1: (None, True), 2: (None, False), 3: ("fast", True), 4: (None, False)}
    got = lines(box)
    assert got[0] == (0, "in sync (fast)") and got[1] == (0, "in sync") and got[2] == (0, "in sync (verified)")
    out = rc.outcomes(box)
    saved = rc.next_baseline(box, rc.folder_counts(box, out, rc.actions(out, rc.to_pull(box), rc.to_push(box))))
    assert {r["channel"]: (r["exists"], r["nlocal"], r["curn"]) for r in saved.collect()} == {k: (1, 1, 2) for k in (1, 2, 4)}


def test_delta_and_full_listing_agree(spark):
    pairs = [(k, k, 0) for k in range(1, 9)]
    near = [(k, 4 if k == 2 else 0, f"m{k}", 0) for k in range(1, 9) if k != 3]
    far = [(k, 1 if k == 5 else 0, 50 if k == 5 else 3) for k in range(1, 9) if k != 7] + [(20, 8, 60)]
    folder = dict(pairs=pairs, near=near, far=far, maxpulled=8, exists=8)
    base = (2, 7, 9, 8, 10, 0, 8, 0, 0, 0, 0)
    both = mailbox(spark, {0: folder, 1: folder | {"baseline": base}})
    assert {r["channel"]: r["listing"] for r in rc.folders(both).collect()} == {0: "full", 1: "delta"}
    by = {}
    for r in rc.outcomes(both).collect():
        by.setdefault(r["channel"], {})[r["fuid"]] = r["code"]
    assert by[0] == by[1] and by[1][7] == "C1" and by[1][3] == "D1+T" and by[1][1] == "G"
    settled = mailbox(spark, {0: dict(pairs=pairs[:2], near=[(1, 0, "a", 0), (2, 0, "b", 0)], far=[(1, 0, 1), (2, 0, 1)], baseline=base[:3] + (2, 10, 0, 2, 0, 0, 0, 0))})
    assert {r["code"] for r in rc.outcomes(settled).collect()} == {"G"}  # nothing in the delta is nothing vanished


def test_applied_plan_leaves_nothing_to_do(spark):
    folder = dict(pairs=[(k, k, 0) for k in range(1, 7)], near=[(1, 1, "a", 1), (2, 0, "b", 0), (3, 8, "c", 0), (5, 0, "e", 0), (6, 4, "f", 0), (None, 8, "n", 0)], far=[(1, 0, 1), (2, 2, 1), (3, 0, 1), (4, 0, 1), (6, 4, 1), (9, 1, 2), (10, 8, 2)], maxpulled=6, uvlast=6)
    box = mailbox(spark, {0: folder})
    out = rc.outcomes(box)
    pull, push = rc.to_pull(box), rc.to_push(box)
    placed = rc.assign_uids(box, pull, push)
    appended = spark.createDataFrame([(0, 0, "n", 11)], f"{KEY}, name string, fuid long")
    after = sorted((r["fuid"], r["nuid"], r["flags"]) for r in rc.next_pairs(box, out, placed, appended).collect())
    assert after == [(1, 1, 1), (2, 2, 2), (6, 6, 4), (9, 7, 1), (11, 8, 0)]
    head = rc.next_headers(box, placed, appended).first()
    assert (head["maxpulled"], head["maxpushed"], head["uvlast"]) == (11, 8, 8)
    acts = {(r["kind"], r["uid"], r["name"]) for r in rc.actions(out, pull, push).collect()}
    assert acts == {("pull", 9, None), ("push", None, "n"), ("far_flags", 1, None), ("near_flags", 2, "b"), ("near_delete", 3, "c"), ("far_flags", 3, None), ("expunge", 3, None), ("far_flags", 4, None), ("expunge", 4, None), ("near_delete", 5, "e")}
    again = mailbox(spark, {0: dict(pairs=after, near=[(1, 1, "a", 0), (2, 2, "b", 0), (6, 4, "f", 0), (7, 1, "p", 0), (8, 8, "n", 0)], far=[(1, 1, 3), (2, 2, 1), (6, 4, 1), (9, 1, 2), (10, 8, 2), (11, 8, 4)], maxpulled=11, expunge=False)})
    assert rc.actions(rc.outcomes(again), rc.to_pull(again), rc.to_push(again)).count() == 0
    assert rc.next_pairs(again, rc.outcomes(again), rc.assign_uids(again, rc.to_pull(again), rc.to_push(again)), appended).count() == len(after)


def test_late_deletions_take_no_uid(spark):
    box = mailbox(spark, {0: dict(far=[(9, 0, 1), (10, 0, 1)], near=[], pairs=[], uvlast=4)})
    fetched = spark.createDataFrame([(0, 0, 9, 8)], f"{KEY}, uid long, flags int")
    placed = rc.assign_uids(box, rc.to_pull(box, fetched), rc.to_push(box))
    assert [(r["uid"], r["near_uid"], r["save_batch"]) for r in placed.collect()] == [(10, 5, 0)]
    assert rc.next_headers(box, placed, spark.createDataFrame([], f"{KEY}, name string, fuid long")).first()["uvlast"] == 6


def test_same_uid_twice_counts_once(spark):
    box = mailbox(spark, {0: dict(pairs=[(5, 5, 0)], near=[(5, 1, "b", 1), (5, 0, "z", 0)], far=[(5, 4, 1), (5, 2, 9)])})
    (r,) = rc.outcomes(box).collect()
    assert (r["nf"], r["name"], r["ff"]) == (1, "b", 2)


def test_every_case_has_one_outcome(spark):
    want = {}
    for fuid, far, nuid, near, ex, ft, nt in itertools.product((False, True), repeat=7):
        far, near = far and fuid, near and nuid
        if fuid and not far and not near:
            code = "A"
        elif not fuid and nuid and not near:
            code = "B"
        elif fuid and not far:
            code = "C1" if ex else "C3" if nt else "C2"
        elif fuid and nuid and not near:
            code = ("D1" if ex else "D2") + ("" if ft else "+T")
        elif not fuid or not nuid:
            code = "E"
        elif ex and (ft or nt):
            code = "F" if ft else "F+T"
        else:
            code = "Gd" if ft != nt else "G"
        want[fuid, far, nuid, near, ex, ft, nt] = code
    folders = {}
    for k, (fuid, far, nuid, near, ex, ft, nt) in enumerate(want):
        folders[k] = dict(expunge=ex, pairs=[(5 if fuid else None, 5 if nuid else None, 0)], near=[(5, 8 * nt, "a", 0)] if near else [], far=([(5, 8 * ft, 1)] if far else []) + [(4, 0, 1)], maxpulled=5)
    got = {r["channel"]: r["code"] for r in rc.outcomes(mailbox(spark, folders)).collect()}
    assert [got[k] for k in range(len(want))] == list(want.values())


def test_merge_of_all_flags(spark):
    n = 32
    bits = lambda c: F.expr(f"({c} & 7) | (({c} & 24) << 1)")  # noqa: E731  the five synced bits
    x = spark.range(n**3).select(bits("id % 32").alias("s"), bits("(id div 32) % 32").alias("f"), bits("id div 1024").alias("n"))
    x = x.withColumn("got", fl.merge(F.col("s"), F.col("f"), F.col("n")))
    changed = F.expr("(f & (f ^ s)) | (n & (n ^ s) & ~(f ^ s)) | (s & ~(f ^ s) & ~(n ^ s))")
    assert x.where(F.col("got") != changed).count() == 0


def test_one_pass(spark):
    """The plan looks at pairs, near and far messages in a fixed number of joins, whatever the kinds of actions."""
    box = mailbox(spark, {0: dict(pairs=[(5, 5, 0)], near=[(5, 1, "a", 0)], far=[(5, 0, 1)])})
    out = rc.outcomes(box)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(rc.pair_actions(out)) == joins(out)


@pytest.mark.parametrize("size", [0, 1, 40, 41, 81])
def test_chunks(spark, size):
    uids = [k * 30_000 + 1 for k in range(size)]  # over many buckets of uids
    rows = spark.createDataFrame([(0, 0, k) for k in reversed(uids)] + [(0, 1, 7)], f"{KEY}, uid long")
    got = rc.batches(rows, []).where("channel = 0").orderBy("batch").collect()
    assert all(r["n"] == rc.CHUNK for r in got[:-1])
    assert [int(u) for r in got for u in r["uids"].split(",")] == uids


def test_whole_run(spark, tmp_path):
    box = mailbox(spark, {0: dict(pairs=[(5, 5, 0)], near=[(5, 1, "a", 0), (None, 0, "n", 0)], far=[(5, 0, 1), (7, 0, 1)], maxpulled=5)}, sync=True)
    run = Run(box, appended=spark.createDataFrame([(0, 0, "n", 8)], f"{KEY}, name string, fuid long"))
    assert [r["command"] for r in run.commands()["store"].collect()] == ["UID STORE 5 +FLAGS.SILENT (\\Seen)"]
    run.commit(str(tmp_path))
    assert sorted(map(tuple, state.load(spark, str(tmp_path), "pairs").select("fuid", "nuid", "flags").collect())) == [(5, 5, 1), (7, 6, 0), (8, 7, 0)]
    assert state.load(spark, str(tmp_path), "headers").first()["maxpulled"] == 8
    assert state.load(spark, str(tmp_path), "baseline").first()["exists"] == 2  # the counters from before the run


def test_tasks_grow_with_the_tables(spark, monkeypatch):
    pairs = [(None if k % 3 == 0 else k, None if k % 3 == 1 else k, 0) for k in range(1, 901)]
    folder = dict(pairs=pairs, near=[(k, 1, f"m{k}", 0) for k in range(1, 901) if k % 5] + [(k, 0, f"d{k}", 1) for k in range(890, 905)], far=[(k, 8 if k % 7 == 0 else 4, 1) for k in range(1, 905) if k % 4], maxpulled=900)

    def made(rows):
        monkeypatch.setattr(rc, "TASK_ROWS", rows, raising=False)
        box = mailbox(spark, {0: folder, 1: folder | {"expunge": False}})
        out = rc.outcomes(box)
        counts = rc.folder_counts(box, out, rc.actions(out, rc.to_pull(box), rc.to_push(box)))
        codes = out.withColumn("task", F.spark_partition_id()).collect()
        by_row = sorted((repr([r[c] for c in ("account", "channel", "fuid", "nuid", "code", "merged")]) for r in codes))
        at = [r["task"] for r in codes]
        return by_row, sorted(map(repr, counts.collect())), max(at.count(t) for t in set(at)), out.rdd.getNumPartitions()

    few, many = made(1_000_000), made(60)
    assert few[:2] == many[:2]
    assert many[3] >= 30  # before, as many as for small tables
    assert many[2] <= 180  # pairs without a far uid are dealt too: before, all of a folder came to one task
