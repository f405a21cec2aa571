"""Member-days as keyed streaming state: what a turn changes is its member's state, and nothing is read again.

State of a member (RocksDB, so it may outgrow memory): the ids of turns seen, the sums of each day and chamber, and the
latest name, party and state. A batch of turns costs its own rows, not the corpus; repeated ids count once, in whatever
batch they come; a turn of any age changes its own day, and a member's attributes only if no later turn has told them.
The result equals :func:`lectern.operators.members.member_day` over all turns, each id once.

Each micro-batch writes the new state of the days and members that it touched to a change table, under its epoch. A
replayed epoch overwrites itself, so a failure between state and table leaves no double count. Readers take the last
change of each key; :func:`compact` keeps only those.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.functions.domain import blank_to_null
from lectern.functions.scoring import Scorer
from lectern.operators.dedup import keep_first
from lectern.operators.members import COUNTS, attributed, score_spoken
from lectern.sources.turn_files import load_partitions
from lectern.streaming.turn_stream import read_stream

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SUMS = COUNTS[1:]
CHANGE = "bioguide string, kind string, date string, chamber string, congress int, speaker_name string, party string, state string, " + ", ".join(f"{c} long" for c in COUNTS)


class MemberState(StatefulProcessor):
    """Rows of one member, as :func:`prepared` makes them, to the changes that they make."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "turn_id string", "one boolean")
        self.days = handle.getMapState("days", "date string, chamber string", "congress int, pos string, " + ", ".join(f"{c} long" for c in COUNTS))
        self.who = handle.getValueState("who", "name string, name_at string, party string, party_at string, state string, state_at string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        who = self.who.get() if self.who.exists() else None
        who = dict(zip(("name", "name_at", "party", "party_at", "state", "state_at"), who or ("", "", "", "", "", ""), strict=True))
        touched: dict[tuple, list] = {}
        for frame in rows:
            # Rows of one id in one batch: the first by date, then by its other values; no partitioning changes that.
            for r in frame.sort_values(["turn_id", "date", "chamber", "n_words"], kind="stable").itertuples(index=False):
                if self.seen.containsKey((r.turn_id,)):
                    continue
                self.seen.updateValue((r.turn_id,), (True,))
                day = (r.date, r.chamber)
                if day not in touched:
                    touched[day] = list(self.days.getValue(day)) if self.days.containsKey(day) else [0, "", *[0] * len(COUNTS)]
                sums = touched[day]
                if r.turn_id >= sums[1]:
                    sums[0], sums[1] = int(r.congress), r.turn_id
                for k, v in enumerate((1, r.n_words, *(getattr(r, c) for c in SUMS[1:]))):
                    sums[2 + k] += int(v)
                at = f"{r.date}|{r.turn_id}"
                for name, value in (("name", r.speaker_name), ("party", r.party), ("state", r.state)):
                    if value and at >= who[f"{name}_at"]:
                        who[name], who[f"{name}_at"] = value, at
        if not touched:
            return
        self.who.update(tuple(who.values()))
        changes = [(key[0], "member", "", "", 0, who["name"], who["party"], who["state"], *[0] * len(COUNTS))]
        for day, sums in touched.items():
            self.days.updateValue(day, tuple(sums))
            changes.append((key[0], "day", *day, sums[0], "", "", "", *sums[2:]))
        yield pd.DataFrame(changes, columns=[c.split()[0] for c in CHANGE.split(", ")])

    def close(self) -> None:
        pass


def prepared(turns: DataFrame, scorer: Scorer) -> DataFrame:
    """Scored turns of known members, blanks filled as the member-day table fills them."""
    scored = score_spoken(attributed(turns), scorer)
    fill = lambda c, v: F.coalesce(blank_to_null(F.col(c)), F.lit(v)).alias(c)
    return scored.select(
        "bioguide", F.coalesce("turn_id", F.lit("")).alias("turn_id"), "date", fill("chamber", "other"), F.coalesce("congress", F.lit(0)).alias("congress"),
        fill("speaker_name", ""), fill("party", "other"), fill("state", ""), "n_words", *SUMS[1:],
    )


def changes(turns: DataFrame, scorer: Scorer) -> DataFrame:
    """The change stream of a turn stream. The session's state store must be RocksDB (:func:`start` sees to it)."""
    return prepared(turns, scorer).groupBy("bioguide").transformWithStateInPandas(MemberState(), CHANGE, "Update", "None")


def start(spark: SparkSession, path: str, out: str, checkpoint: str, scorer: Scorer, available_now: bool = True, partitions: int | None = None):
    """Keep the change table at ``out`` current with the turn files at ``path``; a folder an epoch.

    State is dealt to ``partitions`` for good when the checkpoint is made (the session's number of shuffle partitions, if not given).
    """
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, **({} if partitions is None else {"spark.sql.shuffle.partitions": str(partitions)})}

    def apply(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    writer = changes(read_stream(spark, path), scorer).writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", checkpoint)
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()  # it keeps the settings of its start
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def last_changes(spark: SparkSession, out: str) -> DataFrame | None:
    """The last change of each day and member."""
    rows = load_partitions(spark, out)
    return None if rows is None else keep_first(rows, ["bioguide", "kind", "date", "chamber"], [F.col("epoch").desc()])


def member_days(spark: SparkSession, out: str) -> DataFrame | None:
    """The member-day table: current sums of each day with the member's latest attributes."""
    rows = last_changes(spark, out)
    if rows is None:
        return None
    who = rows.filter("kind = 'member'").select("bioguide", "speaker_name", "party", "state")
    days = rows.filter("kind = 'day'").select("bioguide", "date", "chamber", "congress", *COUNTS)
    return days.join(who, "bioguide").select("bioguide", "date", "chamber", "speaker_name", "party", "state", "congress", *COUNTS)


def compact(spark: SparkSession, out: str, to: str) -> None:
    """Write the last changes alone to another folder, for readers; the stream's own table stays as it is."""
    rows = last_changes(spark, out)
    if rows is not None:
        rows.write.mode("overwrite").partitionBy("epoch").parquet(to)
