"""Registered reconciliation and mail text queries, each with DuckDB SQL that works it out in its own way."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import flags as fl
from tidewater.functions import mailtext as mt
from tidewater.operators import reconcile as rc
from tidewater.plans.fixtures import SQL, Snapshots
from tidewater.shared import dealt

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str, build) -> None:
    QUERIES[name] = build
    ORACLE_SQL[name] = sql


def _letters(x: str) -> str:
    return "concat(" + ", ".join(f"CASE WHEN {x} & {b} <> 0 THEN '{c}' ELSE '' END" for c, b in fl.LETTERS) + ")"


def _imap(x: str) -> str:
    return "rtrim(concat(" + ", ".join(f"CASE WHEN {x} & {b} <> 0 THEN '{c} ' ELSE '' END" for c, b in fl.NAMES) + "))"


def _steps(force: bool = False, sync: bool = False) -> str:
    """What a run works out from the snapshots, in the order of the reference's steps."""
    return f"""{SQL},
folder0 AS (SELECT c.account, c.channel, c.expunge, s.present, s.fuidval, s.nuidval, s.maxpulled, s.maxpushed, s.uvval, s.uvlast, s.journal, t."exists" srv, t.uidvalidity, t.uidnext, t.modseq, m.curs, m.curn, m.news, m.newn,
  b.uidnext buidnext, b."exists" bsrv, b.modseq bmodseq, b.ghosts bghosts, b.nlocal, (b.curs, b.curn, b.news, b.newn) = (m.curs, m.curn, m.news, m.newn) quiet, {'FALSE' if force else 'coalesce(b.version = 2 AND b.uidval = t.uidvalidity, FALSE)'} valid
  FROM channels c LEFT JOIN state s USING (account, channel) LEFT JOIN stats t USING (account, channel) LEFT JOIN baseline b USING (account, channel) LEFT JOIN mtimes m USING (account, channel)),
folder1 AS (SELECT *, CASE WHEN {'journal' if sync else 'FALSE'} THEN 'error: mbsync journal present (interrupted sync); run mbsync on this channel to recover first'
  WHEN present AND uvval <> 0 AND uvval <> nuidval THEN 'error: .uidvalidity/.mbsyncstate disagree (' || uvval || ' vs ' || nuidval || ')'
  WHEN present AND fuidval <> 0 AND uidvalidity <> fuidval THEN 'UIDVALIDITY MISMATCH (state ' || fuidval || ', server ' || uidvalidity || '), refusing'
  WHEN valid AND uidnext = buidnext AND srv = bsrv AND modseq = bmodseq AND quiet THEN 'fast' END verdict,
  CASE WHEN present AND maxpulled > 0 AND srv > 0 THEN CASE WHEN NOT valid THEN 'full' WHEN bmodseq <> 0 AND modseq <> 0 AND modseq <> bmodseq THEN 'delta' ELSE 'none' END ELSE 'none' END listing,
  srv > 0 AND (NOT present OR uidnext > maxpulled + 1) asks_new FROM folder0),
folder AS (SELECT * FROM folder1 WHERE verdict IS NULL),
incoming AS (SELECT account, channel, uid, flags, flags & 8 <> 0 ghost FROM far JOIN folder USING (account, channel) WHERE asks_new AND uid > maxpulled),
lst AS (SELECT account, channel, uid, flags, listing FROM far JOIN folder f USING (account, channel) WHERE uid <= maxpulled AND (listing = 'full' OR listing = 'delta' AND far.modseq > f.bmodseq)),
fset AS (SELECT DISTINCT account, channel, fuid uid FROM pairs WHERE fuid IS NOT NULL),
nset AS (SELECT DISTINCT account, channel, nuid uid FROM pairs WHERE nuid IS NOT NULL),
tally AS (SELECT f.account, f.channel,
  (SELECT count(*) FROM pairs p WHERE (p.account, p.channel) = (f.account, f.channel) AND fuid IS NOT NULL) alive,
  (SELECT count(*) FROM incoming i WHERE (i.account, i.channel) = (f.account, f.channel) AND NOT ghost) fresh,
  (SELECT count(*) FROM incoming i WHERE (i.account, i.channel) = (f.account, f.channel) AND ghost) fresh_ghosts,
  (SELECT count(*) FROM far r ANTI JOIN fset USING (account, channel, uid) WHERE (r.account, r.channel) = (f.account, f.channel) AND flags & 8 <> 0) deleted,
  (SELECT count(*) FROM far r WHERE (r.account, r.channel) = (f.account, f.channel)) server,
  (SELECT count(*) FROM pairs p WHERE (p.account, p.channel) = (f.account, f.channel) AND fuid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM far r WHERE (r.account, r.channel, r.uid) = (p.account, p.channel, p.fuid))) missing FROM folder f),
ladder AS (SELECT *, alive + fresh + known expected, alive + fresh + deleted recounted, present AND listing <> 'full' AND srv <> alive + fresh + known AND srv <> alive + fresh + deleted by_all
  FROM (SELECT *, fresh_ghosts + CASE WHEN valid THEN bghosts ELSE 0 END known FROM folder JOIN tally USING (account, channel))),
ghostly AS (SELECT *, CASE WHEN NOT present THEN fresh_ghosts WHEN listing = 'full' THEN fresh_ghosts + (SELECT count(*) FROM lst ANTI JOIN fset USING (account, channel, uid) WHERE (lst.account, lst.channel) = (l.account, l.channel) AND flags & 8 <> 0)
  WHEN srv = expected THEN known WHEN srv = recounted THEN deleted ELSE greatest(server - (alive - missing) - fresh, 0) END ghosts FROM ladder l),
held AS (SELECT p.account, p.channel, p.fuid, p.nuid, p.flags, l.expunge, n.flags nf, n.name, n.indir, p.fuid IS NOT NULL AND NOT CASE WHEN l.listing = 'full' THEN s.uid IS NULL ELSE l.by_all AND a.uid IS NULL END hasfar, s.flags said
  FROM pairs p JOIN ladder l USING (account, channel) LEFT JOIN near n ON n.account = p.account AND n.channel = p.channel AND n.uid = p.nuid LEFT JOIN far a ON a.account = p.account AND a.channel = p.channel AND a.uid = p.fuid LEFT JOIN lst s ON s.account = p.account AND s.channel = p.channel AND s.uid = p.fuid),
sided AS (SELECT *, CASE WHEN hasfar THEN coalesce(said, flags) END ff FROM held),
coded AS (SELECT *, CASE
 WHEN fuid IS NOT NULL AND NOT hasfar AND nf IS NULL THEN 'A'
 WHEN fuid IS NULL AND nuid IS NOT NULL AND nf IS NULL THEN 'B'
 WHEN fuid IS NOT NULL AND NOT hasfar THEN CASE WHEN expunge THEN 'C1' WHEN nf & 8 = 0 THEN 'C2' ELSE 'C3' END
 WHEN nuid IS NOT NULL AND nf IS NULL THEN (CASE WHEN expunge THEN 'D1' ELSE 'D2' END) || (CASE WHEN ff & 8 = 0 THEN '+T' ELSE '' END)
 WHEN fuid IS NULL OR nuid IS NULL THEN 'E'
 WHEN expunge AND (ff | nf) & 8 <> 0 THEN CASE WHEN ff & 8 = 0 THEN 'F+T' ELSE 'F' END
 WHEN (ff & 8) <> (nf & 8) THEN 'Gd' ELSE 'G' END code FROM sided),
outc AS (SELECT *, CASE WHEN code IN ('G','Gd') THEN (ff & 55 & xor(ff & 55, flags & 55)) | (nf & 55 & xor(nf & 55, flags & 55) & (~xor(ff & 55, flags & 55))) | (flags & 55 & (~xor(ff & 55, flags & 55)) & (~xor(nf & 55, flags & 55))) END merged FROM coded),
upd AS (SELECT account, channel, fuid, CASE WHEN code IN ('G','Gd') THEN merged & (~(ff & 55)) WHEN code LIKE '%+T' THEN 8 ELSE 0 END add_mask, CASE WHEN code IN ('G','Gd') THEN (ff & 55) & (~merged) ELSE 0 END rem_mask FROM outc),
farupd AS (SELECT * FROM upd WHERE add_mask <> 0 OR rem_mask <> 0),
nearupd0 AS (SELECT account, channel, nuid, name, indir, CASE WHEN code = 'C2' THEN nf | 8 WHEN code IN ('G','Gd') AND merged <> (nf & 55) THEN merged | (nf & 8) END new_flags FROM outc),
nearupd AS (SELECT account, channel, nuid, name, new_flags, split_part(name, ':2,', 1) || ':2,' || {_letters('new_flags')} new_name, CASE WHEN new_flags & 1 <> 0 OR indir = 0 THEN 'cur' ELSE 'new' END new_sub FROM nearupd0 WHERE new_flags IS NOT NULL),
ndel AS (SELECT account, channel, nuid, name FROM outc WHERE code IN ('C1','F','F+T')),
expu AS (SELECT account, channel, fuid FROM outc WHERE code IN ('D1','D1+T','F','F+T')),
pull AS (SELECT account, channel, uid, flags, CASE WHEN flags & 1 <> 0 THEN 'cur' ELSE 'new' END place FROM incoming WHERE NOT ghost),
push AS (SELECT account, channel, name, flags & 55 flags, flags near_flags, indir FROM near JOIN folder USING (account, channel) WHERE uid IS NULL),
acts AS (SELECT account, channel, 'pull' kind, 1 kind_order, uid, NULL AS name, 0 add_mask, 0 rem_mask, CAST(NULL AS INT) new_flags FROM pull
 UNION ALL SELECT account, channel, 'push', 2, NULL, name, 0, 0, NULL FROM push
 UNION ALL SELECT account, channel, 'far_flags', 3, fuid, NULL, add_mask, rem_mask, NULL FROM farupd
 UNION ALL SELECT account, channel, 'near_flags', 4, nuid, name, 0, 0, new_flags FROM nearupd
 UNION ALL SELECT account, channel, 'near_delete', 5, nuid, name, 0, 0, NULL FROM ndel
 UNION ALL SELECT account, channel, 'expunge', 6, fuid, NULL, 0, 0, NULL FROM expu),
counts AS (SELECT g.account, g.channel, g.present, g.valid, g.journal, g.listing, g.srv, g.uidvalidity, g.uidnext, g.modseq, g.alive, g.expected, g.ghosts, g.curs, g.curn, g.news, g.newn,
  (SELECT count(*) FROM near n ANTI JOIN nset USING (account, channel, uid) WHERE (n.account, n.channel) = (g.account, g.channel) AND uid IS NOT NULL) untracked,
  (SELECT count(*) FROM lst ANTI JOIN fset USING (account, channel, uid) WHERE (lst.account, lst.channel) = (g.account, g.channel) AND listing = 'full' AND flags & 8 = 0) remuntracked,
  (SELECT count(*) FROM near n WHERE (n.account, n.channel) = (g.account, g.channel)) local,
  coalesce(vgone, 0) vgone, coalesce(lgone, 0) lgone, coalesce(tdrift, 0) tdrift, coalesce(settled, 0) > 0 changed, coalesce(actions, 0) actions, coalesce(pull, 0) pull, coalesce(push, 0) push, coalesce(far_flags, 0) far_flags, coalesce(near_flags, 0) near_flags, coalesce(near_delete, 0) near_delete, coalesce(expunge, 0) expunge
  FROM (SELECT * EXCLUDE (expunge) FROM ghostly) g
  LEFT JOIN (SELECT account, channel, count(*) FILTER (fuid IS NOT NULL AND NOT hasfar) vgone, count(*) FILTER (hasfar AND nuid IS NOT NULL AND nf IS NULL) lgone, count(*) FILTER (code = 'Gd' AND NOT expunge) tdrift, count(*) FILTER (code NOT IN ('E','G','Gd')) settled FROM outc GROUP BY ALL) USING (account, channel)
  LEFT JOIN (SELECT account, channel, count(*) actions, {', '.join(f"count(*) FILTER (kind = '{k}') {k}" for k in rc.KINDS)} FROM acts GROUP BY ALL) USING (account, channel))"""


def _plan(name: str, body: str, build, **how: bool) -> None:
    _query(name, f"WITH {_steps(**how)} {body}", lambda spark, sf_dir: build(Snapshots(spark, sf_dir, **how)))


def _out(s: Snapshots):
    return rc.outcomes(s.checked)


def _acts(s: Snapshots):
    return rc.actions(_out(s), rc.to_pull(s.box), rc.to_push(s.box))


def _counts(s: Snapshots):
    out = s.store(_out(s), "outcomes")  # counted by code, and by the actions that it makes
    return s.store(rc.folder_counts(s.checked, out, rc.actions(out, rc.to_pull(s.box), rc.to_push(s.box))), "counts")  # a row for each folder


def _placed(s: Snapshots):
    return rc.assign_uids(s.box, rc.to_pull(s.box, s.fetched), rc.to_push(s.box))


def _batch_sql(rows: str, by: str) -> str:
    return f"SELECT account, channel, {by}batch, count(*) n, string_agg(CAST(uid AS VARCHAR), ',' ORDER BY uid) uids FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY account, channel{', ' + by.rstrip(', ') if by else ''} ORDER BY uid) - 1) / 40) AS BIGINT) batch FROM ({rows})) GROUP BY account, channel, {by}batch"


_STORE = "SELECT account, channel, '+' op, add_mask mask, fuid uid FROM farupd WHERE add_mask <> 0 UNION ALL SELECT account, channel, '-', rem_mask, fuid FROM farupd WHERE rem_mask <> 0"
_CODES = "SELECT account, channel, fuid, nuid, code FROM outc"
_codes = lambda s: _out(s).select("account", "channel", "fuid", "nuid", "code")

_plan("folder_listing", "SELECT account, channel, verdict, listing, valid FROM folder1", lambda s: rc.folders(s.box).select("account", "channel", "verdict", "listing", "valid"))
_plan("folder_listing_forced", "SELECT account, channel, verdict, listing, valid FROM folder1", lambda s: rc.folders(s.box).select("account", "channel", "verdict", "listing", "valid"), force=True, sync=True)
_plan("reconcile_outcomes", _CODES, _codes, force=True)
_plan("outcomes_delta", _CODES, _codes)
_plan("flag_merge", "SELECT account, channel, fuid, merged FROM outc WHERE merged IS NOT NULL", lambda s: _out(s).where("merged is not null").select("account", "channel", "fuid", "merged"))
_plan("far_flag_updates", "SELECT * FROM farupd", lambda s: rc.far_flag_updates(_out(s)))
_plan("near_flag_updates", "SELECT * FROM nearupd", lambda s: rc.near_flag_updates(_out(s)))
_plan("near_deletes", "SELECT * FROM ndel", lambda s: rc.near_deletes(_out(s)))
_plan("far_expunges", "SELECT * FROM expu", lambda s: rc.far_expunges(_out(s)))
_plan("far_full_listing", "SELECT account, channel, uid, flags FROM lst", lambda s: rc.listed(s.box, "full"), force=True)
_plan("far_delta_listing", "SELECT account, channel, uid, flags FROM lst WHERE listing = 'delta'", lambda s: rc.listed(s.box, "delta"))
_plan("far_new_messages", "SELECT * FROM incoming", lambda s: rc.new_messages(s.box))
_plan("search_deleted", "SELECT DISTINCT account, channel, uid FROM far WHERE flags & 8 <> 0", lambda s: rc.search_set(s.box, "DELETED"))
_plan("far_vanished", "SELECT account, channel, fuid FROM outc WHERE fuid IS NOT NULL AND NOT hasfar", lambda s: rc.vanished(_out(s)))
_plan("far_untracked", "SELECT account, channel, uid, flags FROM lst ANTI JOIN fset USING (account, channel, uid) WHERE listing = 'full' AND flags & 8 = 0", lambda s: rc.far_untracked(s.box))
_plan("ghosts", "SELECT account, channel, uid, flags FROM lst ANTI JOIN fset USING (account, channel, uid) WHERE listing = 'full' AND flags & 8 <> 0", lambda s: rc.listed_ghosts(s.box))
_plan("near_untracked", "SELECT account, channel, uid, flags, name FROM near JOIN folder USING (account, channel) ANTI JOIN nset USING (account, channel, uid) WHERE uid IS NOT NULL", lambda s: rc.near_untracked(s.box))
_plan("residual_ghosts", "SELECT account, channel, srv \"exists\", alive, expected, recounted, by_all, CASE WHEN listing <> 'full' OR NOT present THEN ghosts END counted_ghosts FROM ghostly", lambda s: rc.count_check(s.checked).select("account", "channel", "exists", "alive", "expected", "recounted", "by_all", "counted_ghosts"))
_plan("to_pull", "SELECT * FROM pull", lambda s: rc.to_pull(s.box))
_plan("to_push", "SELECT * FROM push", lambda s: rc.to_push(s.box))
_plan("store_batches", f"SELECT *, 'UID STORE ' || uids || ' ' || op || 'FLAGS.SILENT (' || {_imap('mask')} || ')' command FROM ({_batch_sql(_STORE, 'op, mask, ')})", lambda s: rc.store_batches(rc.far_flag_updates(_out(s))))
_plan("expunge_batches", _batch_sql("SELECT account, channel, fuid uid FROM expu", ""), lambda s: rc.batches(rc.far_expunges(_out(s)).withColumnRenamed("fuid", "uid"), []))
_PLACED = f"""placed AS (SELECT account, channel, kind, uid, name, near_flags & 55 flags, uvlast + k near_uid, CASE WHEN kind = 'push' THEN split_part(name, ':2,', 1) || ',U=' || (uvlast + k) || ':2,' || {_letters('near_flags')} END new_name, CAST(floor((k - 1) / 32) AS BIGINT) save_batch
 FROM (SELECT *, row_number() OVER (PARTITION BY account, channel ORDER BY kind, uid NULLS LAST, name) k FROM (SELECT p.account, p.channel, 'pull' kind, p.uid, '' AS name, coalesce(g.flags, p.flags) near_flags FROM pull p LEFT JOIN fetched g USING (account, channel, uid) WHERE coalesce(g.flags, p.flags) & 8 = 0 UNION ALL SELECT account, channel, 'push', NULL, name, near_flags FROM push)) JOIN folder USING (account, channel))"""
_query("assign_near_uids", f"WITH {_steps()}, {_PLACED} SELECT * FROM placed", lambda spark, sf_dir: _placed(Snapshots(spark, sf_dir)))
_query(
    "next_state",
    f"""WITH {_steps()}, {_PLACED} SELECT account, channel, CASE WHEN code NOT IN ('C2','C3') THEN fuid END fuid, CASE WHEN code NOT LIKE 'D2%' THEN nuid END nuid, CAST(CASE WHEN code IN ('C2','C3') THEN nf | 8 WHEN code LIKE 'D2%' THEN ff | 8 ELSE coalesce(merged, flags) END AS INT) flags FROM outc WHERE code NOT IN ('A','B','C1','D1','D1+T','F','F+T')
 UNION ALL SELECT account, channel, uid, near_uid, flags FROM placed WHERE kind = 'pull'
 UNION ALL SELECT p.account, p.channel, a.fuid, near_uid, flags FROM placed p JOIN appended a USING (account, channel, name) WHERE kind = 'push'
 UNION ALL SELECT account, channel, fuid, nuid, flags FROM pairs ANTI JOIN folder USING (account, channel)""",
    lambda spark, sf_dir: (lambda s: rc.next_pairs(s.box, _out(s), _placed(s), s.appended))(Snapshots(spark, sf_dir)),
)
_query(
    "high_water_marks",
    f"""WITH {_steps()}, {_PLACED}, done AS (SELECT p.account, p.channel, CASE WHEN kind = 'pull' THEN uid ELSE a.fuid END far, near_uid FROM placed p LEFT JOIN appended a ON p.kind = 'push' AND (a.account, a.channel, a.name) = (p.account, p.channel, p.name))
 SELECT account, channel, CASE WHEN present THEN fuidval ELSE uidvalidity END fuidval, CASE WHEN present THEN nuidval WHEN uvval <> 0 THEN uvval ELSE 1 END nuidval,
 greatest(maxpulled, coalesce((SELECT max(far) FROM done d WHERE (d.account, d.channel) = (f.account, f.channel)), 0)) maxpulled, greatest(maxpushed, coalesce((SELECT max(near_uid) FROM done d WHERE (d.account, d.channel) = (f.account, f.channel) AND far IS NOT NULL), 0)) maxpushed,
 CASE WHEN uvval <> 0 THEN uvval WHEN present THEN nuidval ELSE 1 END uvval,
 uvlast + (SELECT count(*) FROM pull p WHERE (p.account, p.channel) = (f.account, f.channel)) + (SELECT count(*) FROM push p WHERE (p.account, p.channel) = (f.account, f.channel)) uvlast FROM folder f""",
    lambda spark, sf_dir: (lambda s: rc.next_headers(s.box, _placed(s), s.appended))(Snapshots(spark, sf_dir)),
)
_plan("action_plan", "SELECT * FROM acts", _acts)
_plan(
    "dry_run_lines",
    f"""SELECT account, channel, CAST(line AS INT) line, CASE kind WHEN 'pull' THEN 'would pull uid ' || uid WHEN 'push' THEN 'would push ' || name WHEN 'far_flags' THEN 'would store flags on remote uid ' || uid WHEN 'near_flags' THEN 'would set flags [' || {_letters('new_flags')} || '] on ' || name WHEN 'near_delete' THEN 'would delete ' || name ELSE 'would expunge remote uid ' || uid END AS text
 FROM (SELECT *, row_number() OVER (PARTITION BY account, channel ORDER BY kind_order, uid NULLS LAST, name) line FROM acts) WHERE line <= 12
 UNION ALL SELECT account, channel, 13, '... and ' || (count(*) - 12) || ' more actions' FROM acts GROUP BY account, channel HAVING count(*) > 12""",
    lambda s: rc.dry_run(_acts(s)),
)
_COUNTS = ["account", "channel", "alive", "expected", "untracked", "remuntracked", "ghosts", "vgone", "lgone", "tdrift", "changed", "actions", *rc.KINDS, "local"]
_plan("folder_counts", f"SELECT {', '.join(_COUNTS)} FROM counts", lambda s: _counts(s).select(*_COUNTS))


def _part(n: str, after: str, before: str = "", when: str = "TRUE") -> str:
    return f"CASE WHEN {n} > 0 AND {when} THEN '{before}' || {n} || '{after}' END"


_TO_DO = [_part("pull", " to pull"), _part("push", " to push"), _part("far_flags", " flag updates for remote"), _part("near_flags", " flag updates for local"), _part("vgone", " gone remote"), _part("lgone", " gone local")]
_DONE = [_part("pull", "", "pulled "), _part("push", "", "pushed "), _part("far_flags", " flag updates remote"), _part("near_flags", " flag updates local"), _part("near_delete", " local", "deleted "), _part("expunge", " remote", "expunged "), _part("vgone", " gone remote", "recorded ", "near_delete = 0"), _part("lgone", " gone local", "recorded ", "expunge = 0")]
_REST = [_part("untracked", " local untracked (skipped)"), _part("remuntracked", " remote untracked (skipped)"), _part("tdrift", " trashed, kept (no expunge here)"), "CASE WHEN NOT present THEN 'no sync state' END", "CASE WHEN journal THEN 'mbsync journal present' END"]


def _report_sql(sync: bool) -> str:
    acted = "(actions > 0 OR changed)" if sync else "FALSE"
    parts = ", ".join([f"CASE WHEN {acted} THEN {p} END" for p in _DONE] + [f"CASE WHEN NOT {acted} THEN {p} END" for p in _TO_DO] + _REST)
    return f"""lines AS (SELECT account, channel, CASE WHEN {'FALSE' if sync else 'actions > 0 OR vgone > 0 OR lgone > 0'} THEN 1 ELSE 0 END rc,
 'remote ' || lpad(CAST(srv AS VARCHAR), CAST(greatest(6, length(CAST(srv AS VARCHAR))) AS INT), ' ') || '  local ' || lpad(CAST(local AS VARCHAR), CAST(greatest(6, length(CAST(local AS VARCHAR))) AS INT), ' ') || '  ' || coalesce(nullif(concat_ws(', ', {parts}), ''), CASE WHEN valid THEN 'in sync' ELSE 'in sync (verified)' END) || CASE WHEN ghosts > 0 THEN ', ' || ghosts || ' ghost-deleted remote' ELSE '' END line FROM counts
 UNION ALL SELECT account, channel, CASE WHEN verdict = 'fast' THEN 0 ELSE 2 END, CASE WHEN verdict = 'fast' THEN 'remote ' || lpad(CAST(srv AS VARCHAR), 6, ' ') || '  local ' || lpad(CAST(nlocal AS VARCHAR), 6, ' ') || '  in sync (fast)' ELSE verdict END FROM folder1 WHERE verdict IS NOT NULL)"""


def _report(s: Snapshots):
    return rc.report(s.box, _counts(s))


for _name, _how in (("status_summary", {}), ("sync_report", {"sync": True}), ("verified_report", {"force": True})):
    _plan(_name, f", {_report_sql(_how.get('sync', False))} SELECT * FROM lines".lstrip(), _report, **_how)
    ORACLE_SQL[_name] = ORACLE_SQL[_name].replace(") , lines AS", "), lines AS")
_plan("exit_codes", f", {_report_sql(False)} SELECT account, CAST(max(rc) AS INT) rc FROM lines GROUP BY ROLLUP (account)", lambda s: rc.exit_codes(_report(s)))
_BASE = 'account, channel, 2 AS version, uidvalidity uidval, uidnext, srv "exists", modseq, {g} ghosts, {n} nlocal, curs, curn, news, newn FROM counts'
_plan("next_baseline", "SELECT " + _BASE.format(g="ghosts", n="local") + " WHERE actions = 0 AND NOT changed AND untracked = 0 AND remuntracked = 0", lambda s: rc.next_baseline(s.box, _counts(s)))
_plan("next_baseline_synced", "SELECT " + _BASE.format(g="ghosts + expunge", n="local + pull - near_delete"), lambda s: rc.next_baseline(s.box, _counts(s)), sync=True)
_plan("folder_fast_path", "SELECT account, channel FROM folder1 WHERE verdict = 'fast'", lambda s: rc.folders(s.box).where("verdict = 'fast'").select("account", "channel"))
_plan("epoch_refusals", "SELECT account, channel, verdict FROM folder1 WHERE verdict <> 'fast'", lambda s: rc.folders(s.box).where("verdict <> 'fast'").select("account", "channel", "verdict"), sync=True)


def _text(name: str, sql: str, build) -> None:
    _query(name, sql, lambda spark, sf_dir: build(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")))


#: A cursor in the events table; rows beyond it are the change.
CURSOR = "2024-01-15 00:00:00"
_text("changed_since", f"SELECT event_id, user_id, event_type FROM events WHERE ts > TIMESTAMP '{CURSOR}'", lambda t: t("events").where(F.col("ts") > F.lit(CURSOR).cast("timestamp_ntz")).select("event_id", "user_id", "event_type"))
_text("flags_to_letters", f"SELECT o_orderkey, {_letters('(o_orderkey % 64)')} letters FROM orders", lambda t: t("orders").select("o_orderkey", fl.to_letters(F.col("o_orderkey") % 64).alias("letters")))
_bits = lambda x, table: " + ".join(f"CASE WHEN contains({x}, '{c}') THEN {b} ELSE 0 END" for c, b in table)
_text(
    "letters_to_flags",
    f"SELECT o_orderkey, CAST({_bits('o_orderpriority', fl.LETTERS)} AS INT) flags, CAST({_bits('upper(o_orderpriority)', fl.LETTERS)} AS INT) upper_flags FROM orders",
    lambda t: t("orders").select("o_orderkey", fl.from_letters(F.col("o_orderpriority")).alias("flags"), fl.from_letters(F.upper("o_orderpriority")).alias("upper_flags")),
)
_REPLY = "'* ' || CAST(o_orderkey AS STRING) || ' FETCH (UID ' || CAST(o_orderkey + 1 AS STRING) || ' FLAGS (' || CASE WHEN o_orderkey % 2 = 0 THEN '\\Seen ' ELSE '\\Seenish ' END || CASE WHEN o_orderkey % 3 = 0 THEN '\\Draft' ELSE '\\draft' END || CASE WHEN o_orderkey % 5 = 0 THEN ' $Forwarded2' ELSE '' END || '))'"
_text(
    "imap_flags",
    f"SELECT o_orderkey, {_imap('(o_orderkey % 64)')} imap, CAST(regexp_extract(line, 'UID ([0-9]+)', 1) AS BIGINT) uid, CAST({_bits('line', fl.NAMES)} AS INT) flags FROM (SELECT o_orderkey, {_REPLY} line FROM orders)",
    lambda t: t("orders").selectExpr("o_orderkey", _REPLY.replace("\\", "\\\\") + " AS line").select("o_orderkey", fl.to_imap(F.col("o_orderkey") % 64).alias("imap"), mt.fetched_uid(F.col("line")).alias("uid"), mt.fetched_flags(F.col("line")).alias("flags")),
)
_NAME = "'17.' || CAST(o_orderkey AS STRING) || CASE WHEN o_orderkey % 3 <> 0 THEN ',U=' || CAST((o_orderkey % 5) * o_orderkey AS STRING) ELSE '' END || CASE WHEN o_orderkey % 7 = 0 THEN '0000000000' ELSE '' END || CASE WHEN o_orderkey % 4 <> 0 THEN ':2,' || o_orderpriority ELSE '' END"
_text(
    "filename_parse",
    f"""SELECT o_orderkey, name, nullif(CASE WHEN d <> '' THEN CAST(d AS BIGINT) % 4294967296 END, 0) uid, CASE WHEN position(':2,' IN name) > 0 THEN CAST({_bits("substr(name, position(':2,' IN name) + 3)", fl.LETTERS)} AS INT) ELSE 0 END flags, split_part(name, ':2,', 1) base
 FROM (SELECT *, CASE WHEN position(',U=' IN name) > 0 THEN regexp_extract(substr(name, position(',U=' IN name) + 3), '^[0-9]*') ELSE '' END d FROM (SELECT o_orderkey, {_NAME} AS name FROM orders))""",
    lambda t: t("orders").selectExpr("o_orderkey", f"{_NAME} AS name").select("o_orderkey", "name", mt.uid_of_name(F.col("name")).alias("uid"), fl.from_letters(mt.letters_of_name(F.col("name"))).alias("flags"), mt.base_of_name(F.col("name")).alias("base")),
)
_text(
    "crlf_normalise",
    "SELECT doc_id, md5(replace(text, chr(10), chr(13) || chr(10))) crlf_md5, CAST(strlen(replace(text, chr(10), chr(13) || chr(10))) AS BIGINT) crlf_bytes, md5(text) lf_md5 FROM documents",
    lambda t: t("documents").select("doc_id", F.md5(mt.to_crlf("text").cast("binary")).alias("crlf_md5"), F.octet_length(mt.to_crlf("text")).cast("long").alias("crlf_bytes"), F.md5(mt.to_lf(mt.to_crlf("text")).cast("binary")).alias("lf_md5")),
)
_text(
    "append_sizes",
    "SELECT doc_id, 'APPEND \"a\\\"' || replace(lang, 'e', '\\\\') || '\" (\\Seen) {' || strlen(replace(text, chr(10), chr(13) || chr(10))) || '}' command FROM documents",
    lambda t: t("documents").select("doc_id", mt.append_command(F.concat(F.lit('a"'), F.replace("lang", F.lit("e"), F.lit("\\"))), F.lit(1), F.col("text")).alias("command")),
)
_text(
    "dot_stuff",
    "SELECT doc_id, md5(substr(replace(chr(10) || replace(text, ' ', chr(10) || '.'), chr(10) || '.', chr(10) || '..'), 2)) stuffed_md5 FROM documents",
    lambda t: t("documents").select("doc_id", F.md5(mt.dot_stuffed(F.regexp_replace("text", " ", "\n.")).cast("binary")).alias("stuffed_md5")),
)
_text("base64_text", "SELECT conv_id, turn, md5(base64(encode(text))) b64_md5 FROM conversations", lambda t: t("conversations").select("conv_id", "turn", F.md5(mt.base64_text(F.col("text")).cast("binary")).alias("b64_md5")))

#: A message for each customer: folded fields, names in any case, quoted commas, Bcc fields, bodies that look like headers.
_CRLF = "chr(13) || chr(10)"
_MAIL = f"""'Subject: x' || {_CRLF} || CASE WHEN c_custkey % 4 = 0 THEN 'noise' || chr(10) || ' bcc: n@x' || chr(10) ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN 'FROM' ELSE 'From' END || ': "Last, ' || c_mktsegment || '"' || {_CRLF} || ' <u' || CAST(c_custkey AS STRING) || '@a.test>, z@z.test' || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN 'bCC: h' || CAST(c_custkey AS STRING) || '@b.test,' || chr(10) || chr(9) || '<i@b.test>' || chr(10) ELSE '' END || 'To: t@c.test , <>, <p> <q>' || chr(10) || chr(10) || 'Bcc: body@d.test' || chr(10) || '.dot'"""
_mails = lambda t: dealt(t("customer").select("c_custkey", "c_mktsegment"), "c_custkey").selectExpr("c_custkey", f"{_MAIL} AS mail")
_SENT = "'u' || c_custkey || '@a.test'"
_text("header_addresses", f"SELECT c_custkey, {_SENT} || ';z@z.test' AS senders, CASE WHEN c_custkey % 2 = 0 THEN 'h' || c_custkey || '@b.test;i@b.test;' ELSE '' END || 't@c.test' AS recipients FROM customer", lambda t: _mails(t).select("c_custkey", F.array_join(mt.addresses_of(F.col("mail"), "from"), ";").alias("senders"), F.array_join(mt.recipients(F.col("mail")), ";").alias("recipients")))
_text("header_fields", "SELECT c_custkey, 'Subject;' || CASE WHEN c_custkey % 3 = 0 THEN 'FROM' ELSE 'From' END || CASE WHEN c_custkey % 2 = 0 THEN ';bCC' ELSE '' END || ';To' AS names FROM customer", lambda t: _mails(t).select("c_custkey", F.array_join(F.transform(mt.header_fields(F.col("mail")), lambda f: f["name"]), ";").alias("names")))
_text(
    "smtp_plan",
    f"SELECT c_custkey, 'MAIL FROM:<' || {_SENT} || '>' || CASE WHEN c_custkey % 2 = 0 THEN ';RCPT TO:<h' || c_custkey || '@b.test>;RCPT TO:<i@b.test>' ELSE '' END || ';RCPT TO:<t@c.test>;DATA' AS commands FROM customer",
    lambda t: _mails(t).select("c_custkey", F.array_join(mt.submission(F.lit(None).cast("string"), F.col("mail"), F.lit("u")), ";").alias("commands")),
)
_text("strip_bcc", f"SELECT c_custkey, md5(replace(mail, 'bCC: h' || c_custkey || '@b.test,' || chr(10) || chr(9) || '<i@b.test>' || chr(10), '')) AS left_md5 FROM (SELECT *, {_MAIL} AS mail FROM customer)", lambda t: _mails(t).select("c_custkey", F.md5(mt.without_bcc(F.col("mail")).cast("binary")).alias("left_md5")))
_text("smtp_data", f"SELECT c_custkey, md5(replace(replace(replace(mail || chr(10), {_CRLF}, chr(10)), chr(10) || '.', chr(10) || '..'), chr(10), {_CRLF})) AS wire_md5 FROM (SELECT *, {_MAIL} AS mail FROM customer)", lambda t: _mails(t).select("c_custkey", F.md5(mt.smtp_data(F.col("mail")).cast("binary")).alias("wire_md5")))
_text("envelope_sender", f"SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'given@x.test' WHEN c_custkey % 7 = 0 THEN 'user@x.test' ELSE {_SENT} END AS sender FROM customer", lambda t: _mails(t).select("c_custkey", mt.envelope_sender(F.when(F.col("c_custkey") % 5 == 0, "given@x.test"), F.when(F.col("c_custkey") % 7 == 0, F.lit("To: a@b")).otherwise(F.col("mail")), F.lit("user@x.test")).alias("sender")))
_REPLIES = "'250-first' || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN '250-' || o_orderstatus || chr(10) ELSE '' END || CAST(200 + o_orderkey % 400 AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN ' ok' ELSE '' END || chr(10) || '354 late'"
_text("smtp_replies", "SELECT o_orderkey, CAST(200 + o_orderkey % 400 AS INT) code, CAST(floor((200 + o_orderkey % 400) / 100) AS INT) reply_class FROM orders", lambda t: t("orders").selectExpr("o_orderkey", f"split({_REPLIES}, '\\n') AS r").select("o_orderkey", mt.reply_code(F.col("r")).alias("code"), mt.reply_class(F.col("r")).alias("reply_class")))
_SELECTED = "'* ' || CAST(o_orderkey AS STRING) || ' EXISTS' || chr(10) || '* ' || CAST(o_orderkey AS STRING) || ' EXISTSNOT' || chr(10) || '* 3 RECENT' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN '* OK [UIDVALIDITY 5] x' || chr(10) ELSE '' END || '* OK [UIDVALIDITY ' || CAST(o_custkey AS STRING) || '] y' || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN '* OK [HIGHESTMODSEQ 18446744073709551615]' ELSE '* NO [UIDNEXT 4]' END || chr(10) || '* SEARCH 4 ' || CAST(o_orderkey AS STRING) || ' x 5'"
_text(
    "select_counters",
    "SELECT o_orderkey, o_orderkey \"exists\", o_custkey uidvalidity, CAST(0 AS BIGINT) uidnext, CAST(CASE WHEN o_orderkey % 3 = 0 THEN '18446744073709551615' ELSE '0' END AS DECIMAL(20,0)) modseq, '4;' || o_orderkey AS found FROM orders",
    lambda t: t("orders").selectExpr("o_orderkey", f"split({_SELECTED}, '\\n') AS r").select("o_orderkey", *[c.alias(n) for n, c in mt.select_counters(F.col("r")).items()], F.array_join(F.flatten(F.transform("r", mt.searched_uids)).cast("array<string>"), ";").alias("found")),
)
_text("host_labels", "SELECT c_custkey, split_part(lower(c_name) || '.a.test', '.', 1) AS label, CASE WHEN c_custkey % 2 = 0 THEN '/home/x/' || c_custkey ELSE 'y~/' || c_custkey END AS path FROM customer", lambda t: t("customer").select("c_custkey", mt.host_label(F.concat(F.lower("c_name"), F.lit(".a.test"))).alias("label"), mt.expanded(F.concat(F.when(F.col("c_custkey") % 2 == 0, "~/").otherwise("y~/"), F.col("c_custkey").cast("string")), "/home/x").alias("path")))


def _pick(t):
    accounts = t("nation").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("name"), F.concat(F.lower("n_name"), F.lit("@x.test")).alias("user"))
    k = F.col("c_custkey")
    mails = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(k % 4 == 0, F.col("n_name")).when(k % 4 == 1, "nobody").alias("wanted"), F.when(k % 3 != 0, F.concat(F.col("n_name"), F.lit("@X.test"))).alias("sender"))
    return rc.pick_account(mails, accounts).select("c_custkey", "picked")


_text(
    "pick_account",
    "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN n_name WHEN c_custkey % 3 <> 0 THEN n_name WHEN c_custkey % 4 <> 1 THEN (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1) END picked FROM customer JOIN nation ON c_nationkey = n_nationkey",
    _pick,
)
_text("select_accounts", "SELECT n_name AS name, n_nationkey AS position FROM nation WHERE n_name IN ('NATION_3', 'NATION_11', 'NOWHERE') OR NOT EXISTS (SELECT 1 FROM nation WHERE n_name IN ('NATION_3', 'NATION_11', 'NOWHERE')) ORDER BY n_nationkey LIMIT 16", lambda t: rc.select_accounts(t("nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("position")), ["NATION_3", "NATION_11", "NOWHERE"]))
