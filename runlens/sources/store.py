"""The four tables as stored: parts by day in a ``Store``, with retention (S10/M7) and the run upsert (S9) as
one published version each.

Layout: ``runs`` are parted by the day of ``created_at``; ``failure_logs`` and ``healing_actions`` by
the day of *their run* (retention removes children with their run, not by their own time);
``metrics`` by the day of their own ``timestamp``. Rows without a day (null times, orphans) are
in a part without one, which retention never touches.

Retention names no part wholly before the cutoff any more and rewrites only the part with the cutoff instant. The
upsert finds the parts that may hold a run by each part's range of run ids and rewrites only those. Either is
visible when its version is, for all four tables at once; before that the old version stands. Lists of parts (one
per day) come to the driver, never rows.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import cutoff, run_upsert
from .versioned import Store

PART = "run_day"
TABLES = ("runs", "failure_logs", "healing_actions", "metrics")


def write_tables(runs: DataFrame, failure_logs: DataFrame, actions: DataFrame, metrics: DataFrame, base: str) -> Store:
    """Publish the four tables as the next version of the store at ``base``."""
    store = Store(runs.sparkSession, base)
    days = runs.select("run_id", F.to_date("created_at").alias(PART))
    store.write({"runs": runs.withColumn(PART, F.to_date("created_at")),
                 "failure_logs": failure_logs.join(days, "run_id", "left"),
                 "healing_actions": actions.join(days, "run_id", "left"),
                 "metrics": metrics.withColumn(PART, F.to_date("timestamp"))}, by=dict.fromkeys(TABLES, PART))
    _note_ids(store)
    return store


def _ids_of(store: Store, parts: list[dict], state: dict) -> dict[str, dict]:
    """Least and greatest run id of each part of ``runs``, and whether it has runs without a number."""
    if not parts:
        return {}
    name = F.element_at(F.split(F.input_file_name(), "/data/"), -1)
    rows = store.frame("runs", parts, state).select("id", F.concat(F.lit("data/"), F.regexp_replace(name, "/[^/]*$", "")).alias("path"))
    rows = rows.groupBy("path").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count_if(F.col("id").isNull()).alias("other"))
    return {r["path"]: {"lo": r["lo"], "hi": r["hi"], "other": r["other"]} for r in rows.collect()}


def _note_ids(store: Store) -> None:
    """Add the id ranges to the parts of ``runs`` that lack them."""
    state = store.state()
    new = [p for p in state["tables"]["runs"]["parts"] if "other" not in p]
    ids = _ids_of(store, new, state)

    def change(state: dict) -> dict:
        for p in state["tables"]["runs"]["parts"]:
            p.update(ids.get(p["path"], {}))
        return state
    if ids:
        store.commit(change)


def apply_retention(store: Store, as_of: str, days: int = 90) -> dict[str, int]:
    """Publish a version without the parts before the cutoff day and with the keep-sets of that day's.
    Returns how many parts were dropped per table."""
    spark = store.spark
    cut_ts = _dt.datetime.fromisoformat(as_of) - _dt.timedelta(days=days)
    cut_day, cut = cut_ts.date().isoformat(), cutoff(as_of, days=days)
    state = store.state()
    parts = {t: state["tables"][t]["parts"] for t in TABLES}
    old = {t: [p for p in parts[t] if p["by"] is not None and p["by"] < cut_day] for t in TABLES}
    border = {t: [p for p in parts[t] if p["by"] == cut_day] for t in TABLES}
    kept: dict[str, list[dict]] = {t: [] for t in TABLES}
    if cut_ts != _dt.datetime.combine(cut_ts.date(), _dt.time()):
        gone = store.frame("runs", border["runs"], state).where(F.col("created_at") < cut).select("run_id")
        for t in TABLES:
            if not border[t]:
                continue
            rows = store.frame(t, border[t], state)
            if t in ("runs", "metrics"):
                time = F.col("created_at" if t == "runs" else "timestamp")
                rows = rows.where(~(time < cut) | time.isNull())
            else:
                rows = rows.join(gone, "run_id", "left_anti")
            kept[t] = store.stage(rows.withColumn(PART, F.lit(cut_day)), by=PART)
        if kept["runs"]:
            ids = _ids_of(store, kept["runs"], state)
            kept["runs"] = [{**p, **ids.get(p["path"], {})} for p in kept["runs"]]
    else:
        border = {t: [] for t in TABLES}

    def change(now: dict) -> dict:
        for t in TABLES:
            have = {p["path"] for p in now["tables"][t]["parts"]}
            if any(p["path"] not in have for p in [*old[t], *border[t]]):
                raise RuntimeError(f"{t} was rewritten while retention ran; run it again")
            store.put(now, t, spark.createDataFrame([], "run_id string").schema, kept[t], instead=[*old[t], *border[t]])
        return now

    store.commit(change)
    return {t: len(old[t]) for t in TABLES}


def touched(store: Store, updates: DataFrame, state: dict) -> list[dict]:
    """Parts of ``runs`` whose range of ids has an id of ``updates``."""
    parts = state["tables"]["runs"]["parts"]
    ids = updates.select(F.col("run_id").try_cast("bigint").alias("id")).distinct()
    ranges = store.spark.createDataFrame([(p["path"], p.get("lo"), p.get("hi"), bool(p.get("other", 1))) for p in parts],
                                         "path string, lo long, hi long, other boolean")
    inside: Column = F.col("id").between(F.col("lo"), F.col("hi")) | (F.col("id").isNull() & F.col("other"))
    hit = {r["path"] for r in F.broadcast(ranges).join(ids, inside, "left_semi").collect()} if parts else set()
    return [p for p in parts if p["path"] in hit or "other" not in p]


def upsert_runs(store: Store, updates: DataFrame) -> list[dict]:
    """S9 into the stored runs: fold run events (``seq, run_id, ts, repo, status, conclusion``) into the parts that may
    hold their runs, publish one version and return the parts that were read."""
    state = store.state()
    parts = touched(store, updates, state)
    now = run_upsert(updates, store.frame("runs", parts, state))
    schema = store.frame("runs", [], state).schema
    new = store.stage(now.select(*schema.names, F.to_date("created_at").alias(PART)), by=PART)

    def change(latest: dict) -> dict:
        have = {p["path"] for p in latest["tables"]["runs"]["parts"]}
        if any(p["path"] not in have for p in parts):
            raise RuntimeError("runs were rewritten while the upsert ran; run it again")
        return store.put(latest, "runs", schema, new, instead=parts)

    store.commit(change)
    _note_ids(store)
    return parts
