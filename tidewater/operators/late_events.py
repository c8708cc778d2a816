"""Late and out-of-order events: per-period aggregates that late records correct until a cut-off.

Every source declares low watermarks: punctuations "nothing before `bound` is outstanding", made at some
instant of the arrival clock. A period closes, that is, its first result is published, once every source has
passed its end; a source that stays silent for the idle timeout no longer holds the others back. Records that
arrive after the closing correct the published result, those after the cut-off are diverted.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.session import c, fresh


def _us(span: timedelta) -> int:
    return round(span / timedelta(microseconds=1))


@dataclass(frozen=True)
class Lateness:
    """period: length of a period; delay: how long after its end a source's punctuation for it comes;
    cutoff: how long after its end corrections are taken; idle: silence after which a source is ignored."""

    period: timedelta = timedelta(hours=1)
    delay: timedelta = timedelta(minutes=15)
    cutoff: timedelta = timedelta(hours=24)
    idle: timedelta | None = None

    def start(self, micros: Column) -> Column:
        width = F.lit(_us(self.period))
        return micros - F.pmod(micros, width)

    def end(self, micros: Column) -> Column:
        return self.start(micros) + F.lit(_us(self.period))


def scheduled_punctuations(events: DataFrame, rule: Lateness) -> DataFrame:
    """(source, bound, passed_at) of sources that punctuate by the clock: each period's end, `delay` later.

    `events`: source, event_us, arrival_us. One row per source and period that has events.
    """
    bound = rule.end(F.col("event_us"))
    return events.where(F.col("event_us").isNotNull()).select("source", bound.alias("bound")).distinct().withColumn(
        "passed_at", F.col("bound") + F.lit(_us(rule.delay))
    )


def observed_punctuations(events: DataFrame, rule: Lateness) -> DataFrame:
    """(source, bound, passed_at) of sources whose watermark trails their greatest event time by `delay`.

    A source passes a bound with the first arrival of an event at or after bound + delay. Arrivals are reduced
    to the first one per source and period before any ordering, so the running minimum over a source's later
    periods sees one row per period however many events the source sent.
    """
    known = events.where(F.col("event_us").isNotNull() & F.col("arrival_us").isNotNull())
    first = known.groupBy("source", rule.start(F.col("event_us") - F.lit(_us(rule.delay))).alias("bound")).agg(F.min("arrival_us").alias("arrival"))
    later = W.partitionBy("source").orderBy(F.col("bound").desc()).rowsBetween(W.unboundedPreceding, 0)
    return first.select("source", "bound", F.min("arrival").over(later).alias("passed_at"))


def idle_times(events: DataFrame, rule: Lateness) -> DataFrame:
    """(source, silent_at): when each source has been silent for the idle timeout after its last arrival."""
    return events.where(F.col("arrival_us").isNotNull()).groupBy("source").agg((F.max("arrival_us") + F.lit(_us(rule.idle))).alias("silent_at"))


def closing_times(events: DataFrame, punctuations: DataFrame, rule: Lateness) -> DataFrame:
    """(bound, closed_at): when the last source that had events in a period passed its end.

    A bound is passed by the source's first punctuation at or above it; with `idle`, a source that never passes it does so
    once it has been silent for so long. Periods some source never passes stay
    open and have no row. The low watermark over sources is the greatest passing time of a bound. Only sources and the periods
    they had events in meet, never all sources and all periods.
    """
    periods = events.where(F.col("event_us").isNotNull()).select("source", rule.end(F.col("event_us")).alias("bound")).distinct()
    marks = punctuations.groupBy("source", "bound").agg(F.min("passed_at").alias("passed_at")).withColumn("needs", F.lit(False))
    asked = periods.select("source", "bound", F.lit(None).cast("long").alias("passed_at"), F.lit(True).alias("needs"))
    later = W.partitionBy("source").orderBy(F.col("bound").desc(), F.col("needs")).rowsBetween(W.unboundedPreceding, 0)
    both = marks.unionByName(asked).withColumn("at", F.min("passed_at").over(later)).where("needs")
    if rule.idle is not None:
        both = both.join(idle_times(events, rule), "source", "left").withColumn("at", F.coalesce("at", "silent_at"))
    closed = both.groupBy("bound").agg(F.max("at").alias("closed_at"), F.count_if(F.col("at").isNull()).alias("open"))
    return closed.where("open = 0").select("bound", "closed_at")


def classify(events: DataFrame, closed: DataFrame, rule: Lateness) -> DataFrame:
    """Events plus period_us and fate: on_time, correction, diverted, or unknown without an arrival or event time.

    An event of a period that is still open is on time. Limits belong to the earlier class. Other columns stay;
    only ones of the two new names are replaced.
    """
    end = rule.end(F.col("event_us"))
    limit = end + F.lit(_us(rule.cutoff))
    bound, at = fresh(events, "bound", "closed_at")
    known = closed.select(F.col("bound").alias(bound), F.col("closed_at").alias(at))
    joined = events.withColumn(bound, end).join(known, bound, "left")
    fate = (
        F.when(F.col("event_us").isNull() | F.col("arrival_us").isNull(), "unknown")
        .when(F.col("arrival_us") > limit, "diverted")
        .when(F.col("arrival_us") > F.col(at), "correction")
        .otherwise("on_time")
    )
    return joined.withColumn("fate", fate).withColumn("period_us", rule.start(F.col("event_us"))).drop(bound, at)


def corrected_aggregates(fates: DataFrame, value: str, by: list[str] = (), whole: bool = False) -> DataFrame:
    """Per period: what was published, what it became by the cut-off, and what was diverted.

    `whole` adds diverted_sum, unknown_n and unknown_sum: events without an arrival time are counted as unknown in
    the period of their event time, those without an event time in the period null, so that final, diverted and
    unknown add up to all events. Otherwise unknown events are left out.
    """
    on, fix, late, unknown = (F.col("fate") == x for x in ("on_time", "correction", "diverted", "unknown"))
    v = c(value)
    rest = [F.sum(F.when(late, v)).alias("diverted_sum"), F.count_if(unknown).alias("unknown_n"), F.sum(F.when(unknown, v)).alias("unknown_sum")]
    return (fates if whole else fates.where(~unknown)).groupBy(*by, "period_us").agg(
        F.count_if(on).alias("published_n"), F.sum(F.when(on, v)).alias("published_sum"),
        F.count_if(fix).alias("corrections"), F.count_if(on | fix).alias("final_n"),
        F.sum(F.when(on | fix, v)).alias("final_sum"), F.count_if(late).alias("diverted_n"), *(rest if whole else []),
    )
