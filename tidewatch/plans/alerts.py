"""The alert pipeline over one raw stream, as tables that share their upstream steps."""

from functools import cached_property

from pyspark.sql import DataFrame

from tidewatch import model
from tidewatch.operators import dedup, enrich, incidents, lifecycle, normalize
from tidewatch.operators.keyed import kept
from tidewatch.session import materialize
from tidewatch.sources import records


class AlertPipeline:
    """Raw webhook texts to events, groups, state changes and incidents, all of them lazy.

    Rows that a step reads twice are stored in between (``keep``), so each result parses the texts
    once. ``close`` gives the storage back; what is read later is worked out anew. ``tasks`` is how
    many tasks whole events are dealt over at least.
    """

    def __init__(self, raw: DataFrame, tasks: int = 0):
        self.raw = raw
        self.tasks = tasks
        self._kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(kept(df))
        return self._kept[-1]

    def close(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()

    @cached_property
    def parsed(self) -> DataFrame:
        return normalize.parse_webhooks(self.raw)

    @cached_property
    def dead_letters(self) -> DataFrame:
        return normalize.letters_of(self.parsed)

    @cached_property
    def normalized(self) -> DataFrame:
        return normalize.events_of(self.parsed)

    @cached_property
    def enriched(self) -> DataFrame:
        return enrich.enriched_events(self.normalized)

    @cached_property
    def events(self) -> DataFrame:
        """The enriched events without the maps of their texts, which the states do not need."""
        unused = ("labels", "annotations", "resource")
        return self.enriched.select(*(c for c in self.enriched.columns if c not in unused))

    @cached_property
    def deduplicated(self) -> DataFrame:
        """Whole events with their groups."""
        return dedup.deduplicate(self.enriched, keep=self.keep, tasks=self.tasks)

    @cached_property
    def groups(self) -> DataFrame:
        return dedup.alert_groups(dedup.deduplicate(self.events, keep=self.keep, tasks=self.tasks))

    @cached_property
    def unique_alerts(self) -> DataFrame:
        return dedup.unique_alerts(self.events)

    @cached_property
    def state_changes(self) -> DataFrame:
        return lifecycle.state_changes(self.unique_alerts, keep=self.keep)

    @cached_property
    def incident_changes(self) -> DataFrame:
        return incidents.incident_changes(self.state_changes, keep=self.keep)

    @cached_property
    def incident_members(self) -> DataFrame:
        return incidents.incident_members(self.incident_changes)

    def write(self, sink, batch_id: int = 0) -> None:
        """Write all result topics, each step from the written rows of the step before it.

        ``sink`` writes topics, and where it also reads them, as ``TopicFolders`` does, the next
        step goes on from its files. Rows for a sink that only writes, as Kafka is, are kept in the
        shared folder and sent in their wire form. A lost executor costs at most the work since the
        last written topic. The texts are parsed once for the events and once for the dead letters,
        which costs less than keeping all parsed texts. Topic folders of an earlier batch run with the
        same ``batch_id`` are replaced.
        """
        reads = hasattr(sink, "read")
        sink = sink.anew() if hasattr(sink, "anew") else sink  # rows of an earlier run are replaced
        step = AlertPipeline(self.raw, self.tasks)  # its tables are replaced by written ones

        def written(rows: DataFrame, topic: str) -> DataFrame:
            rows = rows if reads else materialize(rows)
            sink.write(rows, topic, batch_id)
            return sink.read(rows.sparkSession, topic, batch_id) if reads else rows

        sink.write(records.dead_letter_json(step.dead_letters), model.DEAD_LETTER_TOPIC, batch_id)
        step.enriched = written(step.enriched, model.NORMALIZED_TOPIC)
        unused = ("labels", "annotations", "resource") if reads else ()
        needed = [c for c in step.deduplicated.columns if c not in unused]
        step.deduplicated = materialize(step.deduplicated.select(*needed))
        groups = (dedup.alert_groups if reads else records.group_json)(step.deduplicated)
        sink.write(groups, model.GROUPS_TOPIC, batch_id)
        step.unique_alerts = dedup.unique_alerts(step.deduplicated)
        step.state_changes = written(step.state_changes, model.STATE_TOPIC)
        changes = step.incident_changes
        if not reads:
            changes = records.incident_json(incidents.incident_records(materialize(changes)))
        sink.write(changes, model.INCIDENT_TOPIC, batch_id)
        step.close()
