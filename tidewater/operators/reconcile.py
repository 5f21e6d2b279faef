"""Three-way reconciliation of a far mailbox, a near maildir and the saved state, for all folders at once.

Every join is on (account, channel, uid): uids are unique only within a folder.
Absent uids are null.  A `Mailbox` holds the inputs; `folders` says for each
folder whether and how it is looked at, `outcomes` what is to happen to each
saved pair, `actions` what that makes to do, and `next_pairs`, `next_headers`
and `next_baseline` what is saved afterwards.  Nothing here acts on a mailbox.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import flags as fl
from tidewater.functions import mailtext as mt

FOLDER = ["account", "channel"]
#: Uids in a command, lines of a dry run, and placed messages between two writes of the state.
CHUNK, SHOWN, SAVE_EVERY = 40, 12, 32
BASELINE_VERSION = 2
#: The order in which actions are carried out and listed.
KINDS = {"pull": 1, "push": 2, "far_flags": 3, "near_flags": 4, "near_delete": 5, "expunge": 6}
GONE = ("A", "B", "C1", "D1", "D1+T", "F", "F+T")
_COUNTERS = ("uidval", "uidnext", "exists", "modseq", "curs", "curn", "news", "newn")
#: Of each table, the rows that one task sorts at most, but for the unevenness of hashes.
TASK_ROWS = 250_000


@dataclass
class Mailbox:
    """What one run starts from; every table has the columns account and channel.

    channels: expunge.  pairs: fuid, nuid, flags.  near: uid, flags, name, indir.
    far, the whole mailbox: uid, flags, modseq.  state, one row a folder that has
    one: present, fuidval, nuidval, maxpulled, maxpushed, uvval, uvlast, journal
    (of these nulls are absent files).  stats: exists, uidvalidity, uidnext,
    modseq.  baseline, at most one row a folder: version, ghosts, nlocal and the
    counters.  mtimes: curs, curn, news, newn.  force distrusts baselines; sync
    is true for a run that will act.  known and checked, if given, are the stored
    results of `folders` and `count_check`; see `settled`.  sized holds the rows
    of the largest table once they have been counted.
    """

    channels: DataFrame
    pairs: DataFrame
    near: DataFrame
    far: DataFrame
    state: DataFrame
    stats: DataFrame
    baseline: DataFrame
    mtimes: DataFrame
    force: bool = False
    sync: bool = False
    known: DataFrame | None = None
    checked: DataFrame | None = None
    sized: list[int] = field(default_factory=list)


def _or0(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def settled(box: Mailbox, store: Callable[[DataFrame, str], DataFrame], checked: bool = False) -> Mailbox:
    """The mailbox with what is known of its folders, one row each, written once by `store` rather than worked out in every plan."""
    box = box if box.known is not None else replace(box, known=store(folders(box), "folders"))
    return box if not checked or box.checked is not None else replace(box, checked=store(count_check(box), "checked"))


def folders(box: Mailbox) -> DataFrame:
    """One row for each folder: headers and counters, `verdict` and `listing`.

    verdict: null where the folder is looked at, `fast` where neither side has
    changed since the baseline, else the reason why it is refused.  listing is
    what is asked of flags up to the high-water mark: `full` without a usable
    baseline, `delta` where both sides know a modseq and they differ, else `none`.
    """
    if box.known is not None:
        return box.known
    x = box.channels.select(*FOLDER, "expunge").join(box.state, FOLDER, "left").join(box.stats, FOLDER, "left")
    counters = ["version", "ghosts", "nlocal", *_COUNTERS]
    x = x.join(box.baseline.select(*FOLDER, *[F.col(c).alias(f"b_{c}") for c in counters]), FOLDER, "left").join(box.mtimes, FOLDER, "left")
    x = x.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("present", "journal")} | {c: _or0(c) for c in ("fuidval", "nuidval", "maxpulled", "maxpushed", "uvval", "uvlast", "exists", "uidvalidity", "uidnext", "modseq")})
    valid = F.coalesce((F.col("b_version") == BASELINE_VERSION) & (F.col("b_uidval") == F.col("uidvalidity")), F.lit(False)) & F.lit(not box.force)
    x = x.withColumn("valid", valid)
    same = F.col("valid")
    for c in _COUNTERS[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    number = lambda c: F.col(c).cast("string")
    verdict = (
        F.when(F.lit(box.sync) & F.col("journal"), "error: mbsync journal present (interrupted sync); run mbsync on this channel to recover first")
        .when(F.col("present") & (F.col("uvval") != 0) & (F.col("uvval") != F.col("nuidval")), F.concat(F.lit("error: .uidvalidity/.mbsyncstate disagree ("), number("uvval"), F.lit(" vs "), number("nuidval"), F.lit(")")))
        .when(F.col("present") & (F.col("fuidval") != 0) & (F.col("uidvalidity") != F.col("fuidval")), F.concat(F.lit("UIDVALIDITY MISMATCH (state "), number("fuidval"), F.lit(", server "), number("uidvalidity"), F.lit("), refusing")))
        .when(same, "fast")
    )
    asked = F.col("present") & (F.col("maxpulled") > 0) & (F.col("exists") > 0)
    moved = (F.coalesce("b_modseq", F.lit(0)) != 0) & (F.col("modseq") != 0) & (F.col("modseq") != F.col("b_modseq"))
    listing = F.when(asked & ~F.col("valid"), "full").when(asked & moved, "delta").otherwise("none")
    asks_new = (F.col("exists") > 0) & (~F.col("present") | (F.col("uidnext") > F.col("maxpulled") + 1))
    return x.withColumns({"verdict": verdict, "listing": listing, "asks_new": asks_new})


def _open(box: Mailbox) -> DataFrame:
    return folders(box).where("verdict is null")


def _most_rows(box: Mailbox) -> int:
    if not box.sized:
        tables = [t.select(F.lit(k).alias("t")) for k, t in enumerate((box.far, box.near, box.pairs))]
        box.sized.append(max([0, *(r["count"] for r in tables[0].union(tables[1]).union(tables[2]).groupBy("t").count().collect())]))
    return box.sized[0]


def _dealt(box: Mailbox, rows: DataFrame) -> DataFrame:
    """The rows dealt by folder and uid, over tasks whose number grows with the tables, so that what a task holds does not.

    Uids hardly repeat, so rows are dealt as they are: what is worked out by uid
    follows here, in one sort, and not in another one before the exchange.
    """
    tasks = -(-_most_rows(box) // TASK_ROWS)
    few = tasks <= rows.sparkSession.sparkContext.defaultParallelism  # Spark makes as many tasks of its own accord
    return rows.repartition(*FOLDER, "uid") if few else rows.repartition(tasks, *FOLDER, "uid")


def _last_far() -> Column:
    return F.struct(F.coalesce("modseq", F.lit(0)).alias("modseq"), "flags")


def far_once(box: Mailbox, only: DataFrame | None = None) -> DataFrame:
    """The far listing, or only these rows of it, with one row for each uid; of several the one with the last modseq counts."""
    rows = (box.far if only is None else only).where("uid > 0").select(*FOLDER, "uid", _last_far().alias("m"))
    return _dealt(box, rows).groupBy(*FOLDER, "uid").agg(F.max("m").alias("m")).select(*FOLDER, "uid", "m.flags", "m.modseq")


def near_once(box: Mailbox) -> DataFrame:
    """The near messages that have a uid, one row for each; of several the one scanned last counts: new after cur, then by name."""
    rows = box.near.where("uid > 0").select(*FOLDER, "uid", F.struct("indir", "name", "flags").alias("m"))
    return _dealt(box, rows).groupBy(*FOLDER, "uid").agg(F.max("m").alias("m")).select(*FOLDER, "uid", "m.flags", "m.name", "m.indir")


def new_messages(box: Mailbox) -> DataFrame:
    """Far messages beyond the high-water mark: uid, flags, and whether they arrive deleted, which makes them ghosts."""
    beyond = box.far.join(_open(box).where("asks_new").select(*FOLDER, "maxpulled"), FOLDER).where(F.col("uid") > F.col("maxpulled"))
    return far_once(box, beyond).select(*FOLDER, "uid", "flags", fl.has(F.col("flags"), fl.DELETED).alias("ghost"))


def listed(box: Mailbox, listing: str | None = None) -> DataFrame:
    """What the full or delta listing of each folder returns: uid, flags."""
    own = _open(box).where("listing <> 'none'").select(*FOLDER, "maxpulled", "b_modseq", "listing")
    asked = box.far.join(own.select(*FOLDER, "maxpulled"), FOLDER).where(F.col("uid") <= F.col("maxpulled"))
    x = far_once(box, asked).join(own, FOLDER).where((F.col("listing") == "full") | ((F.col("listing") == "delta") & (F.col("modseq") > F.col("b_modseq"))))
    return (x if listing is None else x.where(F.col("listing") == listing)).select(*FOLDER, "uid", "flags")


def search_set(box: Mailbox, what: str) -> DataFrame:
    """The uids that a search of `ALL` or `DELETED` answers with."""
    x = far_once(box)
    return (x if what == "ALL" else x.where(fl.has(F.col("flags"), fl.DELETED))).select(*FOLDER, "uid")


def _unpaired(box: Mailbox, dealt: DataFrame, side: str) -> DataFrame:
    """Those of the dealt rows whose uid is in no pair; by an outer join, as Spark would deal rows after an anti join and not before it."""
    paired = _dealt(box, box.pairs.where(f"{side} is not null").select(*FOLDER, F.col(side).alias("uid"))).distinct()
    return dealt.join(paired.withColumn("paired", F.lit(True)), [*FOLDER, "uid"], "left").where("paired is null").drop("paired")


def far_unpaired(box: Mailbox) -> DataFrame:
    """Far messages without a pair: uid, flags, modseq."""
    return _unpaired(box, far_once(box), "fuid")


def far_untracked(box: Mailbox) -> DataFrame:
    """Messages of full listings that have no pair and are not deleted."""
    return _unpaired(box, listed(box, "full"), "fuid").where(~fl.has(F.col("flags"), fl.DELETED))


def listed_ghosts(box: Mailbox) -> DataFrame:
    """Messages of full listings that have no pair and are deleted."""
    return _unpaired(box, listed(box, "full"), "fuid").where(fl.has(F.col("flags"), fl.DELETED))


def near_untracked(box: Mailbox) -> DataFrame:
    """Near messages that have a uid but no pair."""
    own = box.near.where("uid > 0").join(_open(box).select(*FOLDER), FOLDER).select(*FOLDER, "uid", "flags", "name")
    return _unpaired(box, _dealt(box, own), "nuid")


def _far_sides(box: Mailbox) -> DataFrame:
    """Each uid of the far mailbox or of a pair's far side, once: m, the far modseq and flags if it is there, and its number of pairs."""
    far = box.far.where("uid > 0").select(*FOLDER, "uid", _last_far().alias("m"), F.lit(0).alias("pairs"))
    none = F.lit(None).cast(far.schema["m"].dataType)
    paired = box.pairs.where("fuid is not null").select(*FOLDER, F.col("fuid").alias("uid"), none.alias("m"), F.lit(1).alias("pairs"))
    return _dealt(box, far.unionByName(paired)).groupBy(*FOLDER, "uid").agg(F.max("m").alias("m"), F.sum("pairs").alias("pairs"))


def count_check(box: Mailbox) -> DataFrame:
    """For each folder without a full listing: what its counters say of ghosts and vanished messages.

    The messages that should exist are the live pairs, the new messages and the
    known ghosts.  Where the server has another number the deleted messages
    without a pair are counted anew; where that does not explain it either, the
    pairs are held against all messages (by_all), and what is left over are ghosts.
    Messages of full listings that have no pair are counted in the same pass.
    """
    if box.checked is not None:
        return box.checked
    sides = _far_sides(box).join(_open(box).select(*FOLDER, "maxpulled", "listing", "asks_new"), FOLDER)
    there, dead, old = F.col("m").isNotNull(), fl.has(F.col("m.flags"), fl.DELETED), F.col("uid") <= F.col("maxpulled")
    lone, new, full = there & (F.col("pairs") == 0), there & F.col("asks_new") & ~old, (F.col("listing") == "full") & old
    counts = {
        "server": F.count_if(there),
        "deleted": F.count_if(lone & dead),
        "new": F.count_if(new & ~dead),
        "new_ghosts": F.count_if(new & dead),
        "alive": F.sum("pairs"),
        "missing": F.sum(F.when(there, 0).otherwise(F.col("pairs"))),
        "remuntracked": F.count_if(lone & full & ~dead),
        "listed_ghosts": F.count_if(lone & full & dead),
    }
    x = _open(box).join(sides.groupBy(*FOLDER).agg(*[c.alias(n) for n, c in counts.items()]), FOLDER, "left").na.fill(0, [*counts])
    x = x.withColumn("known", F.col("new_ghosts") + F.when(F.col("valid"), _or0("b_ghosts")).otherwise(0))
    counted = F.col("present") & (F.col("listing") != "full")
    x = x.withColumn("expected", F.col("alive") + F.col("new") + F.col("known")).withColumn("recounted", F.col("alive") + F.col("new") + F.col("deleted"))
    x = x.withColumn("by_all", counted & (F.col("exists") != F.col("expected")) & (F.col("exists") != F.col("recounted")))
    left = F.greatest(F.col("server") - (F.col("alive") - F.col("missing")) - F.col("new"), F.lit(0))
    ghosts = F.when(~F.col("present"), F.col("new_ghosts")).when(~counted, F.lit(None)).when(F.col("exists") == F.col("expected"), F.col("known")).when(F.col("exists") == F.col("recounted"), F.col("deleted")).otherwise(left)
    return x.withColumn("counted_ghosts", ghosts)


def outcomes(box: Mailbox) -> DataFrame:
    """Each pair of a folder that is looked at, with what each side holds and the code of what is to happen.

    Far flags (ff) that the listing does not give are the saved ones; a pair
    that a delta does not mention has neither changed nor vanished.
    """
    checked = count_check(box).select(*FOLDER, "expunge", "listing", "maxpulled", "b_modseq", "by_all")
    near = near_once(box).select(*FOLDER, "uid", F.col("flags").alias("nf"), "name", "indir")
    far = far_once(box).select(*FOLDER, "uid", F.col("flags").alias("far_flags"), F.col("modseq").alias("far_modseq"))
    x = box.pairs.join(checked, FOLDER)
    for side, other, table in (("nuid", "fuid", near), ("fuid", "nuid", far)):
        absent = -F.abs(F.col(other))  # no message has it; one null for all would bring them to one task
        x = _dealt(box, x.withColumn("uid", F.coalesce(side, absent))).join(table, [*FOLDER, "uid"], "left").drop("uid")
    there, old, full = F.col("far_flags").isNotNull(), F.col("fuid") <= F.col("maxpulled"), F.col("listing") == "full"
    vanished = F.when(full, ~(there & old)).otherwise(F.col("by_all") & ~there)
    given = there & old & (full | ((F.col("listing") == "delta") & (F.col("far_modseq") > F.col("b_modseq"))))
    x = x.withColumn("has_far", F.col("fuid").isNotNull() & ~vanished).withColumn("has_near", F.col("nf").isNotNull())
    x = x.withColumn("ff", F.when(F.col("has_far"), F.when(given, F.col("far_flags")).otherwise(F.col("flags"))))
    fuid, nuid, ex, has_far, has_near = F.col("fuid").isNotNull(), F.col("nuid").isNotNull(), F.col("expunge"), F.col("has_far"), F.col("has_near")
    far_t, near_t = fl.has(F.col("ff"), fl.DELETED), fl.has(F.col("nf"), fl.DELETED)
    code = (
        F.when(fuid & ~has_far & ~has_near, "A")
        .when(~fuid & nuid & ~has_near, "B")
        .when(fuid & ~has_far & ex, "C1")
        .when(fuid & ~has_far, F.when(near_t, "C3").otherwise("C2"))
        .when(has_far & nuid & ~has_near, F.concat(F.when(ex, "D1").otherwise("D2"), F.when(far_t, "").otherwise("+T")))
        .when(~(has_far & has_near), "E")
        .when(ex & (far_t | near_t), F.when(far_t, "F").otherwise("F+T"))
        .otherwise(F.when(far_t != near_t, "Gd").otherwise("G"))
    )
    x = x.select(*FOLDER, "fuid", "nuid", "flags", "ff", "nf", "name", "indir", "expunge", code.alias("code"))
    return x.withColumn("merged", F.when(F.col("code").startswith("G"), fl.merge(F.col("flags"), F.col("ff"), F.col("nf"))))


def pair_actions(out: DataFrame) -> DataFrame:
    """The actions of all pairs in one pass: kind, far uid, near uid, name, masks to add and remove, and new near flags."""
    code, nf, ff = F.col("code"), F.col("nf"), F.col("ff").bitwiseAND(F.lit(fl.SYNCED))
    g = code.startswith("G")
    add = F.when(g, F.col("merged").bitwiseAND(F.bitwise_not(ff))).when(code.endswith("+T"), fl.DELETED).otherwise(0)
    rem = F.when(g, ff.bitwiseAND(F.bitwise_not(F.col("merged")))).otherwise(0)
    moved = g & (F.col("merged") != nf.bitwiseAND(F.lit(fl.SYNCED)))
    new = F.when(code == "C2", nf.bitwiseOR(F.lit(fl.DELETED))).when(moved, F.col("merged").bitwiseOR(nf.bitwiseAND(F.lit(fl.DELETED))))
    act = lambda kind, when: F.when(when, F.lit(kind))
    kinds = F.array(act("far_flags", (F.col("add_mask") != 0) | (F.col("rem_mask") != 0)), act("near_flags", F.col("new_flags").isNotNull()), act("near_delete", code.isin("C1", "F", "F+T")), act("expunge", code.isin("D1", "D1+T", "F", "F+T")))
    x = out.withColumns({"add_mask": add.cast("int"), "rem_mask": rem.cast("int"), "new_flags": new.cast("int")})
    return x.withColumn("kind", F.explode(F.filter(kinds, lambda k: k.isNotNull()))).select(*FOLDER, "kind", "fuid", "nuid", "name", "indir", "add_mask", "rem_mask", "new_flags")


def far_flag_updates(out: DataFrame) -> DataFrame:
    """Masks to add to and remove from far messages."""
    return pair_actions(out).where("kind = 'far_flags'").select(*FOLDER, "fuid", "add_mask", "rem_mask")


def near_flag_updates(out: DataFrame) -> DataFrame:
    """New flags of near messages, and the file name and folder that these give; seen mail never goes back to new."""
    x = pair_actions(out).where("kind = 'near_flags'")
    place = F.when(fl.has(F.col("new_flags"), fl.SEEN) | (F.col("indir") == 0), "cur").otherwise("new")
    return x.select(*FOLDER, "nuid", "name", "new_flags", mt.name_with_flags(F.col("name"), F.col("new_flags")).alias("new_name"), place.alias("new_sub"))


def near_deletes(out: DataFrame) -> DataFrame:
    return pair_actions(out).where("kind = 'near_delete'").select(*FOLDER, "nuid", "name")


def far_expunges(out: DataFrame) -> DataFrame:
    return pair_actions(out).where("kind = 'expunge'").select(*FOLDER, "fuid")


def vanished(out: DataFrame) -> DataFrame:
    """Pairs whose far message is gone."""
    return out.where("fuid is not null and ff is null").select(*FOLDER, "fuid")


def to_pull(box: Mailbox, fetched: DataFrame | None = None) -> DataFrame:
    """New far messages and where each is placed.

    fetched, if given, has the flags (uid, flags) that came with the bodies: what
    has been deleted since becomes a ghost and takes no near uid.
    """
    x = new_messages(box).where("not ghost").drop("ghost")
    if fetched is not None:
        x = x.join(fetched.select(*FOLDER, "uid", F.col("flags").alias("now")), [*FOLDER, "uid"], "left").withColumn("flags", F.coalesce("now", "flags")).drop("now")
        x = x.where(~fl.has(F.col("flags"), fl.DELETED))
    return x.select(*FOLDER, "uid", "flags", F.when(fl.has(F.col("flags"), fl.SEEN), "cur").otherwise("new").alias("place"))


def to_push(box: Mailbox) -> DataFrame:
    """Near messages without a uid; also those that are marked deleted."""
    x = box.near.where("coalesce(uid, 0) = 0").join(_open(box).select(*FOLDER), FOLDER)
    return x.select(*FOLDER, "name", F.col("flags").bitwiseAND(F.lit(fl.SYNCED)).alias("flags"), F.col("flags").alias("near_flags"), "indir")


def _numbered(rows: DataFrame, keys: list[str], buckets: dict[str, Column], order: list) -> DataFrame:
    """Adds k, the row's number from 1 among the rows of its keys.

    buckets are columns without nulls whose order agrees with `order`: rows are
    numbered within a bucket and buckets by their sizes, so the rows of one very
    large folder are dealt over tasks.
    """
    x, names = rows.withColumns(buckets), list(buckets)
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    first = x.groupBy(*keys, *names).agg(F.count("*").alias("n")).select(*keys, *names, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order))
    return x.withColumn("own", own).join(first, [*keys, *names]).withColumn("k", F.col("first") + F.col("own")).drop("first", "own", *names)


#: The uids of a bucket are alike but for this many bits; names of one bucket begin alike, with the leading digits of their time.
UID_BITS, NAME_SIGNS = 16, 8


def assign_uids(box: Mailbox, pull: DataFrame, push: DataFrame) -> DataFrame:
    """Near uids in the order of pulls, then pushes, from each folder's last uid on, and the write of the state after each.

    Pushes get the file name that holds their uid.
    """
    one = pull.select(*FOLDER, F.lit("pull").alias("kind"), "uid", F.lit("").alias("name"), F.col("flags").alias("near_flags"))
    both = one.unionByName(push.select(*FOLDER, F.lit("push").alias("kind"), F.lit(None).cast("long").alias("uid"), "name", "near_flags"))
    buckets = {"kind_bucket": F.col("kind"), "uid_bucket": F.shiftright(_or0("uid"), UID_BITS), "name_bucket": F.substring("name", 1, NAME_SIGNS)}
    x = _numbered(both, FOLDER, buckets, ["uid", "name"]).join(folders(box).select(*FOLDER, "uvlast"), FOLDER).withColumn("near_uid", F.col("uvlast") + F.col("k"))
    named = F.when(F.col("kind") == "push", mt.name_with_uid(F.col("name"), F.col("near_uid"), F.col("near_flags")))
    return x.select(*FOLDER, "kind", "uid", "name", F.col("near_flags").bitwiseAND(F.lit(fl.SYNCED)).alias("flags"), "near_uid", named.alias("new_name"), F.floor((F.col("k") - 1) / SAVE_EVERY).cast("long").alias("save_batch"))


def actions(out: DataFrame, pull: DataFrame, push: DataFrame) -> DataFrame:
    """All actions in one table, one row each: kind, kind_order, uid (of the side that is acted on) and name."""
    near = F.col("kind").isin("near_flags", "near_delete")
    own = pair_actions(out).select(*FOLDER, "kind", F.when(near, F.col("nuid")).otherwise(F.col("fuid")).alias("uid"), F.when(near, F.col("name")).alias("name"), "add_mask", "rem_mask", F.when(F.col("kind") == "near_flags", F.col("new_flags")).alias("new_flags"))
    none = F.lit(0).alias("add_mask"), F.lit(0).alias("rem_mask"), F.lit(None).cast("int").alias("new_flags")
    x = pull.select(*FOLDER, F.lit("pull").alias("kind"), "uid", F.lit(None).cast("string").alias("name"), *none)
    x = x.unionByName(push.select(*FOLDER, F.lit("push").alias("kind"), F.lit(None).cast("long").alias("uid"), "name", *none))
    x = x.unionByName(own.withColumns({m: F.when(F.col("kind") == "far_flags", F.col(m)).otherwise(0) for m in ("add_mask", "rem_mask")}))
    order = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in KINDS.items()])
    return x.select(*FOLDER, "kind", order.alias("kind_order"), "uid", "name", "add_mask", "rem_mask", "new_flags")


def dry_run(acts: DataFrame, most: int = SHOWN) -> DataFrame:
    """What a dry run prints for each folder: its first actions, and how many more there are."""
    rank = F.row_number().over(Window.partitionBy(*FOLDER).orderBy("kind_order", F.col("uid").asc_nulls_last(), "name"))
    kind, uid = F.col("kind"), F.col("uid").cast("string")
    text = (
        F.when(kind == "pull", F.concat(F.lit("would pull uid "), uid))
        .when(kind == "push", F.concat(F.lit("would push "), F.col("name")))
        .when(kind == "far_flags", F.concat(F.lit("would store flags on remote uid "), uid))
        .when(kind == "near_flags", F.concat(F.lit("would set flags ["), fl.to_letters(F.col("new_flags")), F.lit("] on "), F.col("name")))
        .when(kind == "near_delete", F.concat(F.lit("would delete "), F.col("name")))
        .otherwise(F.concat(F.lit("would expunge remote uid "), uid))
    )
    first = acts.withColumn("line", rank).where(F.col("line") <= most).select(*FOLDER, "line", text.alias("text"))
    rest = acts.groupBy(*FOLDER).agg((F.count("*") - most).alias("n")).where("n > 0")
    return first.unionByName(rest.select(*FOLDER, F.lit(most + 1).alias("line"), F.concat(F.lit("... and "), F.col("n").cast("string"), F.lit(" more actions")).alias("text")))


def batches(rows: DataFrame, by: list[str], size: int = CHUNK) -> DataFrame:
    """Commands of at most `size` uids each: rows of (folder, by, uid) to (folder, by, batch, n, uids)."""
    keys = [*FOLDER, *by]
    numbered = _numbered(rows, keys, {"uid_bucket": F.shiftright("uid", UID_BITS)}, ["uid"]).withColumn("batch", F.floor((F.col("k") - 1) / size).cast("long"))
    return numbered.groupBy(*keys, "batch").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("uid")), lambda u: u.cast("string")), ",").alias("uids"))


def store_batches(updates: DataFrame, size: int = CHUNK) -> DataFrame:
    """STORE commands: first those that add masks, then those that remove them, like masks together."""
    ops = F.explode(F.array(F.struct(F.lit("+").alias("op"), F.col("add_mask").alias("mask")), F.struct(F.lit("-").alias("op"), F.col("rem_mask").alias("mask"))))
    rows = updates.select(*FOLDER, F.col("fuid").alias("uid"), ops.alias("o")).select(*FOLDER, "uid", "o.*").where("mask <> 0")
    text = F.concat(F.lit("UID STORE "), F.col("uids"), F.lit(" "), F.col("op"), F.lit("FLAGS.SILENT ("), fl.to_imap(F.col("mask")), F.lit(")"))
    return batches(rows, ["op", "mask"], size).withColumn("command", text)


def next_pairs(box: Mailbox, out: DataFrame, placed: DataFrame, appended: DataFrame) -> DataFrame:
    """The pairs after the run: survivors, pulled messages, and pushed ones that the server has acknowledged.

    placed is what assign_uids gives; appended has the far uid (fuid) of each
    pushed name.  A merge is saved even where both sides made the same change.
    Pairs of folders that are not looked at stay as they are.
    """
    live = out.where(~F.col("code").isin(*GONE))
    c, d = F.col("code").isin("C2", "C3"), F.col("code").startswith("D2")
    flags = F.when(c, F.col("nf").bitwiseOR(F.lit(fl.DELETED))).when(d, F.col("ff").bitwiseOR(F.lit(fl.DELETED))).otherwise(F.coalesce("merged", "flags"))
    kept = live.select(*FOLDER, F.when(~c, F.col("fuid")).alias("fuid"), F.when(~d, F.col("nuid")).alias("nuid"), flags.cast("int").alias("flags"))
    pulled = placed.where("kind = 'pull'").select(*FOLDER, F.col("uid").alias("fuid"), F.col("near_uid").alias("nuid"), "flags")
    pushed = placed.where("kind = 'push'").join(appended.select(*FOLDER, "name", "fuid"), [*FOLDER, "name"]).select(*FOLDER, "fuid", F.col("near_uid").alias("nuid"), "flags")
    rest = box.pairs.join(_open(box).select(*FOLDER), FOLDER, "left_anti").select(*FOLDER, "fuid", "nuid", "flags")
    return kept.unionByName(pulled).unionByName(pushed).unionByName(rest)


def next_headers(box: Mailbox, placed: DataFrame, appended: DataFrame, now: int = 1) -> DataFrame:
    """The headers after the run: uid validities, high-water marks, and the last near uid with all that was reserved.

    A folder without a state takes the server's validity, and its near one from
    the uid file or else `now`.
    """
    far = F.when(F.col("kind") == "pull", F.col("uid")).otherwise(F.col("fuid"))
    done = placed.join(appended.select(*FOLDER, "name", "fuid", F.lit("push").alias("kind")), [*FOLDER, "kind", "name"], "left").withColumn("far", far)
    marks = done.groupBy(*FOLDER).agg(F.max("far").alias("far"), F.max(F.when(F.col("far").isNotNull(), F.col("near_uid"))).alias("near"))
    reserved = new_messages(box).where("not ghost").select(*FOLDER).unionByName(to_push(box).select(*FOLDER)).groupBy(*FOLDER).agg(F.count("*").alias("reserved"))
    x = _open(box).join(marks, FOLDER, "left").join(reserved, FOLDER, "left")
    own = F.when(F.col("present"), F.col("nuidval")).when(F.col("uvval") != 0, F.col("uvval")).otherwise(F.lit(now))
    return x.select(
        *FOLDER,
        F.when(F.col("present"), F.col("fuidval")).otherwise(F.col("uidvalidity")).alias("fuidval"),
        own.alias("nuidval"),
        F.greatest("maxpulled", _or0("far")).alias("maxpulled"),
        F.greatest("maxpushed", _or0("near")).alias("maxpushed"),
        F.when(F.col("uvval") != 0, F.col("uvval")).otherwise(own).alias("uvval"),
        (F.col("uvlast") + _or0("reserved")).alias("uvlast"),
    )


_PAIR_COUNTS = ("vgone", "lgone", "tdrift", "settled")


def folder_counts(box: Mailbox, out: DataFrame, acts: DataFrame) -> DataFrame:
    """All counts of each folder that is looked at; `changed` says whether its pairs change shape even without an action."""
    c = F.col("code")
    pairs = out.groupBy(*FOLDER).agg(F.count_if(c.isin("A", "C1", "C2", "C3")).alias("vgone"), F.count_if(c.startswith("D")).alias("lgone"), F.count_if((c == "Gd") & ~F.col("expunge")).alias("tdrift"), F.count_if(~(c.startswith("G") | (c == "E"))).alias("settled"))
    kinds = acts.groupBy(*FOLDER).agg(F.count("*").alias("actions"), *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    near = box.near.groupBy(*FOLDER).agg(F.count("*").alias("local"))
    lone = near_untracked(box).groupBy(*FOLDER).agg(F.count("*").alias("untracked"))
    x = count_check(box).drop("expunge")  # here the number of expunges
    for part in (pairs, kinds, near, lone):
        x = x.join(part, FOLDER, "left")
    x = x.na.fill(0, [*_PAIR_COUNTS, "actions", *KINDS, "local", "untracked"])
    ghosts = F.coalesce("counted_ghosts", F.col("new_ghosts") + F.col("listed_ghosts"))
    keep = ["present", "valid", "journal", "listing", "exists", "uidvalidity", "uidnext", "modseq", "alive", "expected", "untracked", "remuntracked"]
    return x.select(*FOLDER, *keep, ghosts.alias("ghosts"), "vgone", "lgone", "tdrift", (F.col("settled") > 0).alias("changed"), "actions", *KINDS, "local")


def _part(name: str, text: str, before: str = "") -> Column:
    return F.when(F.col(name) > 0, F.concat(F.lit(before), F.col(name).cast("string"), F.lit(text)))


def report(box: Mailbox, counts: DataFrame) -> DataFrame:
    """One line and return code for each folder, refused and skipped ones too: 0 in sync, 1 differences, 2 refused.

    A run that acts and found something to do reports it as done.
    """
    n = F.col
    done = [
        _part("pull", "", "pulled "),
        _part("push", "", "pushed "),
        _part("far_flags", " flag updates remote"),
        _part("near_flags", " flag updates local"),
        _part("near_delete", " local", "deleted "),
        _part("expunge", " remote", "expunged "),
        F.when(n("near_delete") == 0, _part("vgone", " gone remote", "recorded ")),
        F.when(n("expunge") == 0, _part("lgone", " gone local", "recorded ")),
    ]
    to_do = [
        _part("pull", " to pull"),
        _part("push", " to push"),
        _part("far_flags", " flag updates for remote"),
        _part("near_flags", " flag updates for local"),
        _part("vgone", " gone remote"),
        _part("lgone", " gone local"),
    ]
    acted = F.lit(box.sync) & ((n("actions") > 0) | n("changed"))
    both = [F.when(acted, a) for a in done] + [F.when(~acted, b) for b in to_do]
    rest = [_part("untracked", " local untracked (skipped)"), _part("remuntracked", " remote untracked (skipped)"), _part("tdrift", " trashed, kept (no expunge here)"), F.when(~n("present"), "no sync state"), F.when(n("journal"), "mbsync journal present")]
    said = F.concat_ws(", ", *both, *rest)
    line = F.concat_ws(", ", F.when(said != "", said).when(n("valid"), "in sync").otherwise("in sync (verified)"), _part("ghosts", " ghost-deleted remote"))
    rc = F.when(F.lit(not box.sync) & (n("actions") + n("vgone") + n("lgone") > 0), 1).otherwise(0)
    fields = lambda remote, local, text: F.format_string("remote %6d  local %6d  %s", remote, local, text)
    seen = counts.select(*FOLDER, rc.alias("rc"), fields(n("exists"), n("local"), line).alias("line"))
    other = folders(box).where("verdict is not null")
    fast = fields(n("exists"), F.coalesce(n("b_nlocal"), F.lit(0)), F.lit("in sync (fast)"))
    return seen.unionByName(other.select(*FOLDER, F.when(n("verdict") == "fast", 0).otherwise(2).alias("rc"), F.when(n("verdict") == "fast", fast).otherwise(n("verdict")).alias("line")))


def exit_codes(lines: DataFrame) -> DataFrame:
    """The return code of each account and, with a null account, of the run: the worst of its folders."""
    return lines.rollup("account").agg(F.max("rc").alias("rc"))


def next_baseline(box: Mailbox, counts: DataFrame) -> DataFrame:
    """The baselines to save: the counters from before the run, so that the run's own writes are looked at again.

    Only a run that acts, or one that found nothing to do and nothing untracked,
    moves a baseline on; the modification times are those from before the scan.
    """
    quiet = (F.col("actions") == 0) & ~F.col("changed") & (F.col("untracked") == 0) & (F.col("remuntracked") == 0) & (F.col("vgone") + F.col("lgone") == 0)
    x = counts.where(F.lit(box.sync) | quiet).join(box.mtimes, FOLDER, "left")
    acted = F.lit(1 if box.sync else 0)
    return x.select(
        *FOLDER,
        F.lit(BASELINE_VERSION).alias("version"),
        F.col("uidvalidity").alias("uidval"),
        "uidnext",
        "exists",
        "modseq",
        (F.col("ghosts") + acted * F.col("expunge")).alias("ghosts"),
        (F.col("local") + acted * (F.col("pull") - F.col("near_delete"))).alias("nlocal"),
        "curs",
        "curn",
        "news",
        "newn",
    )


def select_accounts(accounts: DataFrame, names: list[str], most: int = 16) -> DataFrame:
    """The accounts named, or all where none is, the first `most` by position; unknown names count for nothing if one matches."""
    x = accounts.where(F.col("name").isin(names)) if names else accounts
    return x.orderBy("position").limit(most)


def pick_account(mails: DataFrame, accounts: DataFrame) -> DataFrame:
    """Adds `picked` to mails (wanted, sender): the first account of the wanted name, else whose user is the sender, whatever its case, else the first.

    An unknown wanted name without a matching sender picks nothing.  accounts
    (position, name, user) may be of any size: its first rows by name and by user
    are joined, and the first of all is one row.
    """
    own = F.min_by("name", "position")
    by_name = accounts.groupBy(F.col("name").alias("wanted")).agg(own.alias("by_name"))
    by_user = accounts.groupBy(F.lower("user").alias("__user")).agg(own.alias("by_user"))
    first = accounts.agg(own.alias("first"))  # one row
    x = mails.join(by_name, "wanted", "left").withColumn("__user", F.lower("sender")).join(by_user, "__user", "left").join(F.broadcast(first))
    return x.withColumn("picked", F.coalesce("by_name", "by_user", F.when(F.col("wanted").isNull(), F.col("first")))).drop("__user", "by_name", "by_user", "first")
