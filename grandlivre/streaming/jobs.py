"""Progress of processing jobs as streams, and the same in batch.

Events are (job_id, ts, event, page, count). State is kept by Spark; late events follow the watermark.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Events that end a job's stream. A reader is opened by the last name.
TERMINAL = ("result_ready", "job_failed")
SUBSCRIBE = "subscribe"
LIFE_COLUMNS = ["job_id", "kind", "n", "ts", "event", "reader"]


def progress(events: DataFrame, total: str = "total") -> DataFrame:
    """(job_id, n_pages, n_skipped, n_failed, last_ts, pct, state): page events move to 80 %, completion to 100.

    An aggregation by job, for batch tables and streams (update mode) alike.
    """
    event = F.col("event")
    out = events.groupBy("job_id").agg(
        F.count_if(event == "page").alias("n_pages"), F.count_if(event == "skipped").alias("n_skipped"), F.count_if(event == "failed").alias("n_failed"),
        F.max(total).alias("total"), F.bool_or(event == "completed").alias("done"), F.max("ts").alias("last_ts"),
    )
    part = F.least(F.lit(80), (15 + F.floor(F.try_divide(70 * F.col("n_pages"), F.col("total")))).cast("int"))
    return out.select("job_id", "n_pages", "n_skipped", "n_failed", "last_ts", F.when(F.col("done"), 100).otherwise(F.coalesce(part, F.lit(0))).cast("int").alias("pct"), F.when(F.col("done"), "completed").otherwise("running").alias("state"))


# Steps of a job by event, the share done and what is said then.
STEPS = [
    ("job_started", "validating", 2, "Validation du PDF…"), ("pdf_validated", "validating", 5, "PDF validé"), ("pages_rendered", "rendering", 15, "Pages rendues"), ("page_classified", "classifying", None, None),
    ("page_extracted", "extracting_page", None, None), ("page_skipped", "extracting_page", None, None), ("page_failed", "extracting_page", None, None), ("resolving_fields", "resolving", 85, "Résolution des champs"),
    ("running_controls", "controls", 90, "Contrôles comptables"), ("calculating_ratios", "ratios", 95, "Calcul des ratios"), ("result_ready", "completed", 100, "Analyse terminée"),
    ("job_failed", "failed", None, None),
]


def job_state(events: DataFrame) -> DataFrame:
    """(job_id, step, pct, message, state, n_financial, n_skipped, n_failed, error, last_ts) of named events, for tables and streams (update mode).

    ``events`` (job_id, ts, event, page, page_type, count, error). The latest event tells step, share and message, of equal times the
    one furthest in the order of steps, then of the highest page and type; page events
    move the share to 15 and on to 80 by page of the count that ``pages_rendered`` gave. A failed job keeps its share.
    """
    event = F.col("event")
    known = lambda place: F.element_at(F.create_map(*(F.lit(x) for s in STEPS if s[place] is not None for x in (s[0], s[place]))), event)
    total = F.max(F.when(event == "pages_rendered", F.col("count")))
    place = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i, s in enumerate(STEPS) for x in (s[0], i))), event), F.lit(-1))
    latest = lambda x: F.max_by(x, F.when(x.isNotNull(), F.struct("ts", place, "page", "page_type", "error")))
    paged = F.col("page").isNotNull() & event.startswith("page_")
    told = F.when(paged | known(3).isNotNull(), F.struct(F.col("page").alias("page"), F.col("page_type").alias("page_type"), known(2).alias("pct"), known(3).alias("text"), paged.alias("paged")))
    g = events.groupBy("job_id").agg(
        latest(known(1)).alias("step"), latest(told).alias("told"), total.alias("total"), F.count_if(event == "page_extracted").alias("n_financial"), F.count_if(event == "page_skipped").alias("n_skipped"),
        F.count_if(event == "page_failed").alias("n_failed"), F.bool_or(event == "result_ready").alias("done"), F.bool_or(event == "job_failed").alias("broken"), latest(F.col("error")).alias("error"), F.max("ts").alias("last_ts"),
    )
    told, page = F.col("told"), F.col("told.page")
    share = F.least(F.lit(80), (15 + F.floor(70 * page / F.greatest("total", F.lit(1)))).cast("int"))
    by_page = told["paged"] & F.col("total").isNotNull()
    text = F.when(by_page, F.concat_ws(" — ", F.concat(F.lit("Page "), page.cast("string"), F.lit("/"), F.col("total").cast("string")), told["page_type"])).otherwise(told["text"])
    state = F.when(F.col("done"), "completed").when(F.col("broken"), "failed").otherwise("processing")
    pct = F.when(F.col("done"), 100).when(by_page, share).otherwise(told["pct"])
    return g.select("job_id", "step", F.coalesce(pct, F.lit(0)).cast("int").alias("pct"), text.alias("message"), state.alias("state"), "n_financial", "n_skipped", "n_failed", "error", "last_ts")


def expire(events: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """The events of a job until it expires: one that comes more than ``ttl_seconds`` after the one before is ignored, and so are all later ones."""
    own = Window.partitionBy("job_id").orderBy("ts")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(own) > ttl_seconds * 1_000_000
    dead = F.max(F.coalesce(gap, F.lit(False)).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("_dead", dead).where("_dead = 0").drop("_dead")


class Lives(StatefulProcessor):
    """The life of one job: its last events, who reads it, and a timer that ends it.

    State is the number of events and the time of the last (``job``), the last ``most`` events (``log``) and the readers
    (``readers``). An event sets the timer ``ttl_seconds`` ahead; when the watermark passes it, log and readers go and only a
    mark stays, which turns away what still comes, until ``forget_seconds`` of event time later it goes too.
    """

    def __init__(self, ttl_seconds: int, most: int, forget_seconds: int):
        self.ttl, self.most, self.forget = ttl_seconds * 1000, most, forget_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "last long, n long, dead boolean")
        self.log = handle.getListState("log", "n long, at long, event string")
        self.readers = handle.getMapState("readers", "reader string", "since long")

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def _end(self, last: int, n: int) -> None:
        self.log.clear()
        self.readers.clear()
        self.job.update((last, n, True))
        self._timer(last + self.ttl + self.forget)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        last, n, dead = self.job.get() if self.job.exists() else (None, 0, False)
        log = deque(self.log.get() if self.log.exists() else (), self.most)
        readers = [r[0] for r in self.readers.keys()] if self.readers.exists() else []
        came, out = pd.concat(list(rows)), []
        came = came.assign(at=came["ts"].astype("int64") // {"ns": 10**6, "us": 10**3, "ms": 1}[came["ts"].dtype.unit if hasattr(came["ts"].dtype, "unit") else "ns"])
        tell = lambda kind, n, at, event, reader: out.append((key[0], kind, n, pd.Timestamp(at, unit="ms"), event, reader))
        for at, event, reader in came.sort_values(["at", "event", "reader"], kind="stable")[["at", "event", "reader"]].itertuples(index=False):
            if not dead and last is not None and at - last > self.ttl:
                dead, readers = True, []
                log.clear()
                tell("expired", n, last + self.ttl, None, None)
            if dead:
                continue
            if event == SUBSCRIBE:
                ended = False
                for k, when, what in log:
                    if not ended:
                        tell("replay", k, when, what, reader)
                    ended = ended or what in TERMINAL
                if not ended and reader not in readers:
                    readers.append(reader)
                continue
            n, last = n + 1, at if last is None else max(last, at)
            log.append((n, at, event))
            tell("event", n, at, event, None)
            for one in sorted(readers):
                tell("event", n, at, event, one)
            if event in TERMINAL:
                readers = []
        if dead:
            self._end(last, n)
        elif last is not None:
            self.log.put(list(log))
            self.readers.clear()
            for one in readers:
                self.readers.updateValue((one,), (last,))
            self.job.update((last, n, False))
            self._timer(last + self.ttl)
        yield pd.DataFrame(out, columns=LIFE_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        import pandas as pd

        out = []
        if self.job.exists():
            last, n, dead = self.job.get()
            if dead:
                self.job.clear()
            else:
                self._end(last, n)
                out.append((key[0], "expired", n, pd.Timestamp(last + self.ttl, unit="ms"), None, None))
        yield pd.DataFrame(out, columns=LIFE_COLUMNS)

    def close(self) -> None:
        pass


def live_events(stream: DataFrame, ttl_seconds: int = 3600, most: int = 500, late: str = "10 minutes", forget_seconds: int = 86_400) -> DataFrame:
    """(job_id, kind, n, ts, event, reader) of a stream of (job_id, ts, event, reader).

    A row whose event is ``subscribe`` opens a reader: the last ``most`` events are replayed to it (kind ``replay``), then every
    later one comes to it as well as to the log (kind ``event``, without a reader), until a terminal event ends it. A job without an
    event for ``ttl_seconds`` of event time ends by a timer (kind ``expired``), whether or not anything else comes for
    it; later events of it are ignored. Events of one batch are taken in order of time, then name. The session keeps
    such state in RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = stream.select("job_id", F.col("ts").cast("timestamp").alias("ts"), "event", (F.col("reader") if "reader" in stream.columns else F.lit(None)).cast("string").alias("reader")).withWatermark("ts", late)
    schema = f"job_id {dict(stream.dtypes)['job_id']}, kind string, n long, ts timestamp, event string, reader string"
    return rows.groupBy("job_id").transformWithStateInPandas(Lives(ttl_seconds, most, forget_seconds), schema, "append", "eventTime")


def until_terminal(events: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """What a reader of each job sees: its events in ``order`` up to the first terminal one, which ends the stream; all if there is none."""
    own = Window.partitionBy("job_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("event").isin(*TERMINAL)).over(own), F.lit(False))
    return events.withColumn("_ended", ended).where(~F.col("_ended")).drop("_ended")


def live_windows(events: DataFrame, ttl: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    """(job_id, begin, end, n): a job's life ends ``ttl`` after its last event; later events begin another."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    out = source.groupBy("job_id", F.session_window("ts", ttl)).agg(F.count("*").alias("n"))
    return out.select("job_id", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")


def terminal_once(events: DataFrame, late: str = "60 minutes", terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """Terminal events, each once for a job: the earliest, the first by its other columns if equal."""
    some = events.where(F.col("event").isin(*terminal))
    if events.isStreaming:
        return some.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id", "event"])
    rest = [c for c in events.columns if c not in ("job_id", "event", "ts")]
    first = Window.partitionBy("job_id", "event").orderBy("ts", *rest)
    return some.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def history(events: DataFrame, most: int = 500, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The last ``most`` events of each job, which a new reader replays in order."""
    last = Window.partitionBy("job_id").orderBy(*[F.desc(c) for c in order])
    return events.withColumn("age", F.row_number().over(last)).where(F.col("age") <= most)
