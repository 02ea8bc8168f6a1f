"""Operations analytics: device scores, profiles, incident windows, artifact completeness, event logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.functions.columns import first_reason, fixed
from tidewake.operators.estimate import in_step, sorted_runs

FLOOR, CLOSE = 0.60, 0.12


def static_score(by_id: Column, vendor: Column, product: Column, texts: Sequence[Column]) -> Column:
    """Score of an identity against a rule from what matches; at most 0.95."""
    hit = lambda c, w: F.when(F.coalesce(c, F.lit(False)), F.lit(w)).otherwise(0.0)
    total = hit(by_id, 0.55) + hit(vendor, 0.15) + hit(product, 0.20)
    return F.least(F.lit(0.95), sum((hit(t, 0.10) for t in texts), total))


def rule_scores(identities: DataFrame, rules: DataFrame, score: Column) -> DataFrame:
    """Every identity with every rule that scores. Rules are a small hand-written list: their number is checked."""
    n = rules.count()
    if n > 10_000:
        raise ValueError(f"{n} rules are too many to be given to each identity")
    return identities.join(F.broadcast(rules)).withColumn("score", score).filter("score > 0")


def merged_scores(scores: DataFrame) -> DataFrame:
    """Per identity and type the best score, 0.12 more where sources differ, at most 0.99; evidence is united in order."""
    rows = scores.groupBy("identity", "type").agg(F.max("score").alias("best"), F.count_distinct("source").alias("sources"), F.array_sort(F.collect_list(F.struct("source", "evidence"))).alias("e"))
    score = F.least(F.lit(0.99), F.col("best") + F.when(F.col("sources") > 1, 0.12).otherwise(0.0))
    return rows.select("identity", "type", score.alias("score"), F.array_distinct(F.flatten(F.transform("e", lambda x: x.evidence))).alias("evidence"))


def resolved(scores: DataFrame) -> DataFrame:
    """Per identity its type: unknown under the floor, ambiguous where the second is close and over the floor too."""
    order = W.partitionBy("identity").orderBy(F.desc("score"), "type")
    rows = scores.withColumns({"rank": F.row_number().over(order), "second": F.lead("score").over(order)}).filter("rank = 1")
    close = (F.col("score") - F.col("second") <= CLOSE + 1e-9) & (F.col("second") >= FLOOR)
    return rows.select("identity", first_reason([("unknown", F.col("score") < FLOOR), ("ambiguous", F.coalesce(close, F.lit(False)))], "").alias("state"), "type", "score").select(
        "identity", F.when(F.col("state") == "", F.col("type")).otherwise(F.col("state")).alias("type"), "score"
    )


def best_bindings(resolved_types: DataFrame) -> DataFrame:
    """Per type the identity with the highest score, the first at ties."""
    rank = F.row_number().over(W.partitionBy("type").orderBy(F.desc("score"), "identity"))
    return resolved_types.filter("type not in ('unknown', 'ambiguous')").withColumn("rank", rank).filter("rank = 1").drop("rank")


def device_counts(resolved_types: DataFrame, domain: Sequence[str]) -> DataFrame:
    """Counts over a fixed list of types; ambiguous counts as unknown, types without devices as 0."""
    spark = resolved_types.sparkSession
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, domain))).alias("type"))
    found = resolved_types.groupBy(F.when(F.col("type") == "ambiguous", "unknown").otherwise(F.col("type")).alias("type")).agg(F.count("*").alias("n"))
    return names.join(found, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def missing_devices(required: DataFrame, counts: DataFrame) -> DataFrame:
    return required.join(counts.filter("n > 0"), "type", "left_anti")


def profile(imu: Column, dvl: Column, power: Column, usbl: Column) -> Column:
    """The richest profile that the devices at hand allow."""
    return first_reason([("full_stack", imu & dvl & power & usbl), ("nav_power", imu & dvl & power), ("nav", imu & dvl), ("imu_only", imu), ("power_only", power)], "no_sensor")


def incident_window(rows: DataFrame, anchors: DataFrame, before_s: float, after_s: float) -> DataFrame:
    """Rows within a time range of any anchor of their run, anchors flagged; windows, no range join.

    A row is in range if the last anchor before it is at most ``after_s`` back or the next one at
    most ``before_s`` ahead.
    """
    marked = rows.join(anchors.select("run_id", "_row", F.lit(True).alias("anchor")), ["run_id", "_row"], "left").withColumn("anchor", F.coalesce("anchor", F.lit(False)))
    at = F.when(F.col("anchor"), F.col("t_s"))
    order = W.partitionBy("run_id").orderBy("t_s")
    last = F.max(at).over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
    following = F.min(at).over(order.rangeBetween(W.currentRow, W.unboundedFollowing))
    near = (F.col("t_s") - last <= after_s) | (following - F.col("t_s") <= before_s)
    return marked.withColumn("_near", F.coalesce(near, F.lit(False))).filter("_near").drop("_near")


def completeness(artifacts: DataFrame, required: Sequence[str], optional: Sequence[str]) -> DataFrame:
    """Per bundle the missing artifact groups and a status from (bundle, artifact) rows."""
    have = artifacts.groupBy("bundle").agg(F.collect_set("artifact").alias("have"))
    lacks = lambda names: F.array_except(F.array(*map(F.lit, names)), F.col("have"))
    rows = have.withColumns({"missing_required": lacks(required), "missing_optional": lacks(optional)})
    status = first_reason([("failed", F.size("missing_required") > 0), ("incomplete", F.size("missing_optional") > 0)], "complete")
    return rows.select("bundle", F.array_join("missing_required", ",").alias("missing_required"), F.array_join("missing_optional", ",").alias("missing_optional"), status.alias("status"))


#: What the merging of a run's logs into one timeline reads, and the artifact that each input is. Fixed values.
MERGE_INPUTS = {"nav_timing": "nav.nav_timing", "nav_state": "nav.nav_state", "control_log": "control.control_loop", "telemetry_timeline": "telemetry.telemetry_timeline", "telemetry_events": "telemetry.telemetry_events"}
#: How far a run got, and where to look first.
STAGE_HINTS = {
    "preflight_failed_before_spawn": "preflight failed: mend what blocks it; empty child logs are expected",
    "child_process_running": "a process is live: read child logs and events together",
    "child_process_stopped_after_start": "processes ran and have stopped: review child logs and events",
    "run_created_without_child_start": "no process was started: read the fault summary and supervisor events",
}


def bundle_summary(runs: DataFrame, artifacts: DataFrame, processes: DataFrame) -> DataFrame:
    """The summary of each run's incident bundle: its stage, what its artifacts lack, and whether its logs can be merged.

    ``runs`` has (bundle, supervisor_state, last_fault_event), ``artifacts`` (bundle, key, required, copied) and
    ``processes`` (bundle, process, state). Returns bundle, run_stage, bundle_status (complete or incomplete),
    required_ok, missing_required and missing_optional (keys in order, joined by commas), merge_ready,
    merge_missing (names of inputs) and hints (array of text). A key that any row reports as copied isn't missing;
    null flags are false, null states and faults empty. A run without rows of artifacts lacks none but can't be
    merged; without processes, or with none that left ``not_started``, its stage is that of a run without a start.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    keys = artifacts.groupBy("bundle", "key").agg(F.bool_or(yes("required")).alias("required"), F.bool_or(yes("copied")).alias("copied"))
    named = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("key"))))
    held = keys.groupBy("bundle").agg(named(F.col("required") & ~F.col("copied")).alias("_required"), named(~F.col("required") & ~F.col("copied")).alias("_optional"), named(F.col("copied")).alias("_copied"))
    state = F.coalesce("state", F.lit(""))
    began = processes.groupBy("bundle").agg(F.bool_and(state == "not_started").alias("_idle"), F.bool_or(~state.isin("", "not_started")).alias("_started"), F.bool_or(state.isin("starting", "running", "stopping")).alias("_live"))
    rows = runs.join(held, "bundle", "left").join(began, "bundle", "left")
    live = yes("_live") | F.coalesce(F.col("supervisor_state").isin("starting", "running", "stopping"), F.lit(False))
    early = yes("_idle") & F.coalesce(F.col("last_fault_event") == "preflight_failed", F.lit(False))
    stage = first_reason([("preflight_failed_before_spawn", early), ("child_process_running", live), ("child_process_stopped_after_start", yes("_started"))], "run_created_without_child_start")
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    lacks = F.array_compact(F.array(*(F.when(~F.array_contains(listed("_copied"), key), F.lit(name)) for name, key in MERGE_INPUTS.items())))
    told = F.create_map(*(F.lit(x) for pair in STAGE_HINTS.items() for x in pair))
    rows = rows.withColumns({"run_stage": stage, "_required": listed("_required"), "_optional": listed("_optional"), "_lacks": lacks})
    whole = first_reason([("required artifacts are missing: the bundle is too small for a review", F.size("_required") > 0), ("optional artifacts are missing: the export itself is sound", F.size("_optional") > 0)], "all artifacts are there")
    return rows.select(
        "bundle", "run_stage", F.when(F.size("_required") + F.size("_optional") > 0, "incomplete").otherwise("complete").alias("bundle_status"), (F.size("_required") == 0).alias("required_ok"),
        F.array_join("_required", ",").alias("missing_required"), F.array_join("_optional", ",").alias("missing_optional"),
        (F.size("_lacks") == 0).alias("merge_ready"), F.array_join("_lacks", ",").alias("merge_missing"), F.array(F.element_at(told, F.col("run_stage")), whole).alias("hints"),
    )


def newest_after(files: DataFrame, starts: DataFrame, slack_s: float = 5.0) -> DataFrame:
    """Per run the newest file that isn't older than its start, less some slack: (run_id, path)."""
    rows = files.join(starts, "run_id").filter(F.col("mtime") >= F.col("start") - slack_s)
    return rows.groupBy("run_id").agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def merged_timeline(logs: dict[str, DataFrame]) -> DataFrame:
    """Logs (run_id, t_s, _row, what) united on one clock, tagged with their name."""
    out = None
    for tag, log in logs.items():
        rows = log.select("run_id", "t_s", "_row", F.col("what").cast("string").alias("what"), F.lit(tag).alias("log"))
        out = rows if out is None else out.unionByName(rows)
    return out


def replay_differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signatures that one of two replays has more often than the other."""
    left, right = (x.groupBy(*keys).agg(F.count("*").alias(n)) for x, n in ((a, "n_a"), (b, "n_b")))
    return left.join(right, list(keys), "full").fillna(0, ["n_a", "n_b"]).filter("n_a <> n_b")


def lost_events(rows: DataFrame) -> Column:
    """Events lost before each one, from gaps of its sequence number."""
    return F.greatest(F.col("seq") - F.lag("seq").over(W.partitionBy("run_id").orderBy("seq")) - 1, F.lit(0))


def command_state(rows: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """The furthest state of each command; ``ranks`` lists states from first to last."""
    table = F.create_map(*(F.lit(x) for i, s in enumerate(ranks) for x in (s, i)))
    return rows.groupBy("run_id", "command").agg(F.max_by("state", F.struct(F.element_at(table, F.col("state")), "t_s")).alias("state"))


#: States of a supervised process and what each event makes of them; an event that isn't listed for a state changes nothing.
LIFECYCLE: dict[tuple[str, str], str] = {
    ("not_started", "start"): "starting",
    ("starting", "started"): "running",
    ("starting", "start_failed"): "failed",
    ("starting", "exit_ok"): "stopped",
    ("starting", "exit_failed"): "failed",
    ("running", "exit_ok"): "stopped",
    ("running", "exit_failed"): "failed",
    ("running", "stop"): "stopping",
    ("starting", "stop"): "stopping",
    ("stopping", "exit_ok"): "stopped",
    ("stopping", "exit_failed"): "stopped",
    ("failed", "retry"): "retrying",
    ("retrying", "start"): "starting",
    ("failed", "start"): "starting",
    ("stopped", "start"): "starting",
}
STATES = "run_id long, _row long, t_s double, event string, before string, state string, ignored boolean, restarts long, dwell_s double, supervisor string"


def process_states(events: DataFrame, transitions: Mapping[tuple[str, str], str] = LIFECYCLE, first: str = "not_started", again: str = "start") -> DataFrame:
    """STATES: the state of each process (run_id) after each of its events (run_id, _row, t_s, event), in order of time.

    ``ignored`` marks events that have no transition from the state they meet. ``restarts`` counts the ``again`` events
    that take effect after the first one, ``dwell_s`` is the time spent in the state before, null for the first event. ``supervisor`` is what
    a supervisor of this process alone would report: failed, stopped or running.
    """
    names = sorted({s for k, v in transitions.items() for s in (k[0], v)} | {first})
    kinds = sorted({k[1] for k in transitions})
    table = np.tile(np.arange(len(names))[:, None], (1, len(kinds) + 1))
    listed = np.zeros(table.shape, bool)
    for (state, event), to in transitions.items():
        table[names.index(state), kinds.index(event)], listed[names.index(state), kinds.index(event)] = names.index(to), True
    columns = [c.split()[0] for c in STATES.split(", ")]
    words = np.array(names, object)
    report = np.array([{"failed": "failed", "stopped": "stopped"}.get(n, "running") for n in names], object)

    class Step:
        def load(self, batch: pd.DataFrame) -> None:
            self.batch, self.t = batch, batch["t_s"].to_numpy(np.float64)
            self.event = pd.Categorical(batch["event"], kinds).codes.astype(np.int64)  # -1, the last column, for others
            self.out, self.dwell = np.zeros((len(batch), 4), np.int64), np.full(len(batch), np.nan)

        def made(self) -> pd.DataFrame:
            before, state, ignored, restarts = self.out.T
            out = self.batch[["run_id", "_row", "t_s", "event"]].reset_index(drop=True)
            return out.assign(before=words[before], state=words[state], ignored=ignored == 1, restarts=restarts, dwell_s=self.dwell, supervisor=report[state])[columns]

        def __call__(self, state: list[np.ndarray], runs: np.ndarray, rows: np.ndarray) -> None:
            now, since, starts = state
            before, event = now[runs], self.event[rows]
            now[runs] = table[before, event]
            known = listed[before, event]
            if again in kinds:
                starts[runs] += known & (event == kinds.index(again))
            self.dwell[rows] = self.t[rows] - since[runs]
            since[runs] = np.where(now[runs] != before, self.t[rows], np.where(np.isnan(since[runs]), self.t[rows], since[runs]))
            self.out[rows] = np.stack((before, now[runs], ~known, np.maximum(starts[runs] - 1, 0)), -1)

    def start(n: int) -> list[np.ndarray]:
        return [np.full(n, names.index(first)), np.full(n, np.nan), np.zeros(n, np.int64)]

    return sorted_runs(events.select("run_id", "_row", "t_s", "event"), "t_s", "_row").mapInPandas(lambda batches: in_step(batches, start, Step()), STATES)


def intent_checks(intents: DataFrame, default_ttl_s: float) -> DataFrame:
    """``intents`` (run_id, source, seq, t_s, ttl_s, _row) with ``in_order`` (newer by number than all before it of its source) and ``expired_at``.

    An accepted intent expires ``ttl_s`` after its time (``default_ttl_s`` where that is 0 or null), unless the source's next accepted one comes
    by then; ``expired_at`` is null if it doesn't expire or isn't accepted.
    """
    source = W.partitionBy("run_id", "source").orderBy("t_s", "_row")
    newest = F.max("seq").over(source.rowsBetween(W.unboundedPreceding, -1))
    rows = intents.withColumn("in_order", F.coalesce(F.col("seq") > newest, F.lit(True)))
    following = F.min(F.when(F.col("in_order"), F.col("t_s"))).over(source.rowsBetween(1, W.unboundedFollowing))
    ttl = F.when(F.coalesce("ttl_s", F.lit(0.0)) > 0, F.col("ttl_s")).otherwise(default_ttl_s)
    deadline = F.col("t_s") + ttl
    return rows.withColumn("_next", following).withColumn("expired_at", F.when(F.col("in_order") & (F.col("_next").isNull() | (F.col("_next") > deadline)), deadline)).drop("_next")


def motion_snapshot(rows: DataFrame, values: Mapping[str, Sequence[str]]) -> DataFrame:
    """(run_id, state, available_fields, summary): the last row of each run told as text, ``name=a,b,c`` for each of ``values`` whose columns are all finite.

    ``state`` is ``unavailable`` where none is.
    """
    columns = sorted({c for names in values.values() for c in names})
    last = rows.groupBy("run_id").agg(F.max_by(F.struct(*columns), F.struct("t_s", "_row")).alias("_x"))
    told = {n: F.concat(F.lit(f"{n}="), F.concat_ws(",", *(fixed(F.col(f"_x.{c}"), 3) for c in names))) for n, names in values.items()}
    there = {n: F.forall(F.array(*(F.col(f"_x.{c}").cast("double") for c in names)), lambda v: v.isNotNull() & ~F.isnan(v)) for n, names in values.items()}
    fields = F.array_compact(F.array(*(F.when(there[n], F.lit(n)) for n in values)))
    state = F.when(F.size(fields) > 0, "available").otherwise("unavailable")
    return last.select("run_id", state.alias("state"), F.array_join(fields, ",").alias("available_fields"), F.concat_ws("; ", *(F.when(there[n], told[n]) for n in values)).alias("summary"))


#: What each startup profile can run as, and what it asks of navigation.
LAUNCH = {"full_stack": ("bench_safe_smoke", "required"), "nav_power": ("bench_safe_smoke", "required"), "nav": ("bench_safe_smoke", "required"), "imu_only": ("sensor_tools", "partial"), "power_only": ("preflight_only", "none"), "no_sensor": ("preflight_only", "none")}


def preflight(scans: DataFrame) -> DataFrame:
    """(run_id, title, ok, detail): the rows of a device scan's preflight table.

    ``scans`` has a row a run: runtime (``bench`` or ``control_only``), counts (map of type to number), bindings (map of type to path), requested and
    selected startup profiles, ambiguous (array of paths), errors and warnings (arrays of text). A control-only runtime goes on
    where a bench would stop: what is ambiguous or lacking costs it navigation alone.
    """
    launch = F.create_map(*(F.lit(x) for k, v in LAUNCH.items() for x in (k, v[0])))
    need = F.create_map(*(F.lit(x) for k, v in LAUNCH.items() for x in (k, v[1])))
    mode, control = F.coalesce(F.element_at(launch, F.col("selected")), F.lit("-")), F.col("runtime") == "control_only"
    pairs = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ", ")
    some = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0
    row = lambda title, ok, detail, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(title).alias("title"), ok.alias("ok"), detail.alias("detail")))
    yes = F.lit(True)
    rows = F.array_compact(
        F.array(
            row("runtime_level", yes, F.concat(F.lit("profile="), "runtime")),
            row("device_inventory", yes, pairs(F.col("counts"))),
            row("device_recommendations", yes, F.when(F.size("bindings") > 0, pairs(F.col("bindings"))).otherwise("no trusted binding recommended yet")),
            row("startup_profile", yes, F.concat(F.lit("requested="), "requested", F.lit(" selected="), "selected", F.lit(" launch_mode="), mode, F.lit(" nav_requirement="), F.coalesce(F.element_at(need, F.col("selected")), F.lit("-")))),
            row("device_binding_ambiguity", control, F.concat(F.array_join("ambiguous", ", "), F.when(control, "; navigation stays disabled").otherwise("")), some("ambiguous")),
            row("startup_profile_requirements", control, F.concat(F.array_join("errors", "; "), F.when(control, "; navigation readiness only").otherwise("")), some("errors")),
            row("startup_profile_gate", control | (mode == "bench_safe_smoke"), F.when(control, F.concat(F.lit("navigation is optional, selected="), "selected")).otherwise(F.concat(F.lit("selected="), "selected", F.lit(" launch_mode="), mode))),
            row("device_scan_risks", yes, F.array_join("warnings", "; "), some("warnings")),
        )
    )
    return scans.select("run_id", F.inline(rows))
