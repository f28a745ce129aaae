"""CLEAR-MOT and identity metrics over an event log, from a registry of metrics.

A metric is a base aggregate over the events of a sequence, or a Column derived from other metrics. Asking for names yields
the aggregates they need, in one pass over the log; the row over all sequences comes from the same aggregates by rollup, so
counts add up and ratios follow from the sums.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lensfold.operators.assignment import heaviest_pairs

#: Events that describe pairs or bookkeeping, not an outcome.
EXTRA = ("RAW", "TRANSFER", "ASCEND", "MIGRATE")


def raw(events: DataFrame) -> DataFrame:
    return events.filter("type = 'RAW'")


def noraw(events: DataFrame) -> DataFrame:
    return events.filter(~F.col("type").isin(*EXTRA))


def extra(events: DataFrame) -> DataFrame:
    return events.filter("type <> 'RAW'")


@dataclass
class Metric:
    name: str
    fn: Callable
    deps: tuple[str, ...]
    help: str
    kind: str  # "events": aggregate over events; "objects": over per-object rows; "ids": from the identity matching; "derived"
    formatter: str | None = None


class Registry:
    """Metrics by name. Arguments of a derived metric's function name the metrics that it needs."""

    def __init__(self):
        self.metrics: dict[str, Metric] = {}

    def register(self, fn: Callable, name: str | None = None, deps: tuple[str, ...] | None = None, help: str | None = None, kind: str = "derived", formatter: str | None = None) -> Metric:
        name = name or fn.__name__
        deps = tuple(inspect.signature(fn).parameters) if deps is None and kind == "derived" else deps or ()
        metric = Metric(name, fn, deps, help or (inspect.getdoc(fn) or ""), kind, formatter)
        self.metrics[name] = metric
        return metric

    def needed(self, names: list[str]) -> list[str]:
        """The metrics and all that they are derived from, those first that others need."""
        out: list[str] = []

        def visit(name: str, path: tuple[str, ...]) -> None:
            if name in path:
                raise ValueError(f"{name} depends on itself")
            for dep in self.metrics[name].deps:
                visit(dep, (*path, name))
            if name not in out:
                out.append(name)

        for name in names:
            visit(name, ())
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(m.name, m.kind, list(m.deps), m.help, m.formatter) for m in self.metrics.values()]
        return spark.createDataFrame(rows, "name string, kind string, deps array<string>, help string, formatter string")

    def markdown(self) -> str:
        return "\n".join(["Name|Description", ":---|:---", *[f"{m.name}|{m.help}" for m in self.metrics.values()]])

    def compute(self, events: DataFrame, names: list[str] | None = None, overall: bool = True, sequences: DataFrame | None = None) -> DataFrame:
        """One row a sequence, and one with ``seq`` = ``OVERALL``; metrics as columns. ``sequences(seq)`` adds those without events."""
        names = names or list(self.metrics)
        needed = [self.metrics[n] for n in self.needed(names)]
        parts = []
        if base := [m for m in needed if m.kind == "events"]:
            parts.append((rolled(events, [m.fn().alias(m.name) for m in base]), base))
        if base := [m for m in needed if m.kind == "objects"]:
            parts.append((rolled(object_rows(events), [m.fn().alias(m.name) for m in base]), base))
        if base := [m for m in needed if m.kind == "ids"]:
            parts.append((rolled(identity_matches(events), [m.fn().alias(m.name) for m in base]), base))
        if not parts:
            raise ValueError("no metric needs the events")
        every = rolled(events.select("seq") if sequences is None else events.select("seq").union(sequences.select("seq")), []).select("seq")
        rows = every
        for part, base in parts:
            rows = rows.join(part, "seq", "left").fillna(0, [m.name for m in base])
        for m in needed:
            if m.kind == "derived":
                rows = rows.withColumn(m.name, m.fn(*[F.col(d) for d in m.deps]))
        rows = rows if overall else rows.filter("seq <> 'OVERALL'")
        return rows.select("seq", *names)


def rolled(rows: DataFrame, aggregates: list[Column]) -> DataFrame:
    """Aggregates per sequence and over all, as ``seq`` = ``OVERALL``."""
    seq = F.when(F.grouping("seq") == 1, F.lit("OVERALL")).otherwise(F.col("seq"))
    return rows.withColumn("seq", F.col("seq").cast("string")).rollup("seq").agg(seq.alias("name"), *aggregates).drop("seq").withColumnRenamed("name", "seq")


def object_rows(events: DataFrame) -> DataFrame:
    """Per object of a sequence: ``frames`` it is in, ``tracked`` ones among them and ``ratio``; ``fragments`` of its track."""
    own = noraw(events).filter("oid is not null")
    order = Window.partitionBy("seq", "oid").orderBy("frame_id", "event")
    missed = F.col("type") == "MISS"
    rows = own.select("seq", "oid", missed.alias("missed"), F.lag(missed).over(order).alias("before"), F.row_number().over(order).alias("place"))
    last = F.max(F.when(~F.col("missed"), F.col("place"))).over(Window.partitionBy("seq", "oid"))
    rows = rows.withColumn("last", last)
    # A fragment ends where a tracked frame is followed by a missed one, before the last tracked frame.
    cut = F.col("missed") & ~F.col("before") & (F.col("place") < F.col("last"))
    per = rows.groupBy("seq", "oid").agg(F.count("*").alias("frames"), F.count_if(~F.col("missed")).alias("tracked"), F.count_if(F.coalesce(cut, F.lit(False))).alias("fragments"))
    return per.withColumn("ratio", F.col("tracked") / F.col("frames"))


def id_counts(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Over RAW events: frames per object, frames per hypothesis, and frames in which a pair is near."""
    r = raw(events)
    objects = r.filter("oid is not null").groupBy("seq", "oid").agg(F.count_distinct("frame_id").alias("n"))
    hypotheses = r.filter("hid is not null").groupBy("seq", "hid").agg(F.count_distinct("frame_id").alias("n"))
    pairs = r.filter("oid is not null and hid is not null and d is not null and not isnan(d)").groupBy("seq", "oid", "hid").agg(F.count("*").alias("n"))
    return objects, hypotheses, pairs


def identity_matches(events: DataFrame) -> DataFrame:
    """``seq, n``: for each pair of the matching of identities with most common frames, these frames.

    An identity that stays alone costs its frames whether or not another could have it, so the cheapest full assignment is
    the matching of most weight, and the sparse graph of near pairs splits into parts.
    """
    _, _, pairs = id_counts(events)
    return heaviest_pairs(pairs.withColumn("seq", F.col("seq").cast("string")).filter("seq IS NOT NULL"), ["seq"], "oid", "hid", "n")


def _outcome(*types: str) -> Callable[[], Column]:
    return lambda: F.count_if(F.col("type").isin(*types))


registry = Registry()
_event = {
    "num_frames": (lambda: F.count_distinct("frame_id"), "Frames."),
    "num_matches": (_outcome("MATCH"), "Matched pairs."),
    "num_switches": (_outcome("SWITCH"), "Track switches."),
    "num_transfer": (_outcome("TRANSFER"), "Hypotheses that went to another object."),
    "num_ascend": (_outcome("ASCEND"), "Switches to a hypothesis that had no object before."),
    "num_migrate": (_outcome("MIGRATE"), "Transfers to an object that had no hypothesis before."),
    "num_false_positives": (_outcome("FP"), "Hypotheses without object."),
    "num_misses": (_outcome("MISS"), "Objects without hypothesis."),
    "num_objects": (lambda: F.count(F.when(~F.col("type").isin(*EXTRA), F.col("oid"))), "Object appearances over all frames."),
    "num_predictions": (lambda: F.count(F.when(~F.col("type").isin(*EXTRA), F.col("hid"))), "Hypothesis appearances over all frames."),
    "sum_distance": (lambda: F.coalesce(F.sum(F.when(~F.col("type").isin(*EXTRA), F.col("d"))), F.lit(0.0)), "Distance over all matched pairs."),
}
_object = {
    "num_unique_objects": (lambda: F.count("*"), "Different objects."),
    "mostly_tracked": (lambda: F.count_if(F.col("ratio") >= 0.8), "Objects tracked for 80 % of their frames or more."),
    "partially_tracked": (lambda: F.count_if((F.col("ratio") >= 0.2) & (F.col("ratio") < 0.8)), "Objects tracked for 20 % to 80 %."),
    "mostly_lost": (lambda: F.count_if(F.col("ratio") < 0.2), "Objects tracked for less than 20 %."),
    "tracked_test": (lambda: F.count_if(F.col("ratio") > 0), "Objects tracked at all."),
    "num_fragmentations": (lambda: F.coalesce(F.sum("fragments"), F.lit(0)), "Changes from tracked to not tracked inside tracks."),
}
for _name, (_fn, _help) in _event.items():
    registry.register(_fn, _name, help=_help, kind="events")
for _name, (_fn, _help) in _object.items():
    registry.register(_fn, _name, help=_help, kind="objects")
registry.register(lambda: F.coalesce(F.sum("n"), F.lit(0)), "idtp", help="Frames of matched identities.", kind="ids")
registry.register(lambda num_matches, num_switches: num_matches + num_switches, "num_detections", help="Matches and switches.")
registry.register(lambda sum_distance, num_detections: F.try_divide(sum_distance, num_detections), "motp", help="Mean distance of detections.", formatter="%.3f")
registry.register(lambda num_misses, num_switches, num_false_positives, num_objects: 1 - F.try_divide(num_misses + num_switches + num_false_positives, num_objects), "mota", help="1 less the errors per object.", formatter="%.1f%%")
registry.register(lambda num_detections, num_false_positives: F.try_divide(num_detections, num_false_positives + num_detections), "precision", help="Detections per hypothesis.", formatter="%.1f%%")
registry.register(lambda num_detections, num_objects: F.try_divide(num_detections, num_objects), "recall", help="Detections per object.", formatter="%.1f%%")
registry.register(lambda num_predictions, idtp: num_predictions - idtp, "idfp", help="Hypothesis frames without matched identity.")
registry.register(lambda num_objects, idtp: num_objects - idtp, "idfn", help="Object frames without matched identity.")
registry.register(lambda idtp, num_predictions: F.try_divide(idtp, num_predictions), "idp", help="Identity precision.", formatter="%.1f%%")
registry.register(lambda idtp, num_objects: F.try_divide(idtp, num_objects), "idr", help="Identity recall.", formatter="%.1f%%")
registry.register(lambda idtp, num_objects, num_predictions: F.try_divide(2 * idtp, num_objects + num_predictions), "idf1", help="Identity F1.", formatter="%.1f%%")

#: The usual selection and its display names.
MOTCHALLENGE = ["idf1", "idp", "idr", "recall", "precision", "num_unique_objects", "mostly_tracked", "partially_tracked", "mostly_lost", "num_false_positives", "num_misses", "num_switches", "num_fragmentations", "mota", "motp"]
DISPLAY_NAMES = {"idf1": "IDF1", "idp": "IDP", "idr": "IDR", "recall": "Rcll", "precision": "Prcn", "num_unique_objects": "GT", "mostly_tracked": "MT", "partially_tracked": "PT", "mostly_lost": "ML", "num_false_positives": "FP", "num_misses": "FN", "num_switches": "IDs", "num_fragmentations": "FM", "mota": "MOTA", "motp": "MOTP", "num_transfer": "IDt", "num_ascend": "IDa", "num_migrate": "IDm"}


def compute(events: DataFrame, names: list[str] | None = None, overall: bool = True) -> DataFrame:
    return registry.compute(events, names, overall)


def rendered(summary: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Metrics as display strings under display names."""
    names = DISPLAY_NAMES if names is None else names
    columns = []
    for c in summary.columns:
        fmt = registry.metrics[c].formatter if c in registry.metrics else None
        value = F.format_string(fmt, F.col(c) * 100 if fmt.endswith("%%") else F.col(c)) if fmt else F.col(c).cast("string")
        columns.append(value.alias(names.get(c, c)))
    return summary.select(*columns)


def frequencies(events: DataFrame, column: str) -> DataFrame:
    """Appearances of each object or hypothesis, over events that are outcomes."""
    return noraw(events).filter(F.col(column).isNotNull()).groupBy("seq", column).agg(F.count("*").alias("n"))
