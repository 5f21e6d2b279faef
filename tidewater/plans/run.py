"""A whole run over all folders: what it reports, what it would do, and what it saves once that is done.

Spark works out the plan; one applier on the driver carries it out, as uploads
and submissions carry no key that would make a retried task harmless.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from tidewater.operators import reconcile as rc
from tidewater.shared import Scratch
from tidewater.sources import state


class Run:
    """The tables of one run; each is worked out when it is asked for.

    fetched and appended are what the applier learnt: flags that came with the
    bodies, and the far uids of pushed messages.
    """

    def __init__(self, box: rc.Mailbox, fetched: DataFrame | None = None, appended: DataFrame | None = None):
        self.scratch = Scratch(box.near.sparkSession, "run")
        self.box, self.fetched = rc.settled(box, self.scratch.write, checked=True), fetched
        self.appended = appended if appended is not None else box.near.sparkSession.createDataFrame([], "account int, channel int, name string, fuid long")

    @cached_property
    def outcomes(self) -> DataFrame:
        return self.scratch.write(rc.outcomes(self.box), "outcomes")

    @cached_property
    def pull(self) -> DataFrame:
        return rc.to_pull(self.box, self.fetched)

    @cached_property
    def push(self) -> DataFrame:
        return rc.to_push(self.box)

    @cached_property
    def actions(self) -> DataFrame:
        return rc.actions(self.outcomes, self.pull, self.push)

    @cached_property
    def counts(self) -> DataFrame:
        return self.scratch.write(rc.folder_counts(self.box, self.outcomes, self.actions), "counts")

    @cached_property
    def report(self) -> DataFrame:
        return rc.report(self.box, self.counts)

    @cached_property
    def placed(self) -> DataFrame:
        return rc.assign_uids(self.box, self.pull, self.push)

    def commands(self) -> dict[str, DataFrame]:
        """The far side's commands in chunks."""
        expunge = rc.far_expunges(self.outcomes).withColumnRenamed("fuid", "uid")
        return {"store": rc.store_batches(rc.far_flag_updates(self.outcomes)), "expunge": rc.batches(expunge, [])}

    def commit(self, root: str) -> str:
        """Saves pairs, headers and baselines as one new version, after the plan has been carried out."""
        tables = {
            "pairs": rc.next_pairs(self.box, self.outcomes, self.placed, self.appended),
            "headers": rc.next_headers(self.box, self.placed, self.appended),
            "baseline": rc.next_baseline(self.box, self.counts),
        }
        return state.save(tables, root)
