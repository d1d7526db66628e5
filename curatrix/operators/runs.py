"""Runs side by side: guards, comparisons, reports of failures, and gates over sealed sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import column
from . import audit, dedup, metrics


def unique(df: DataFrame, key: str) -> DataFrame:
    """``df`` itself; a missing or repeated key raises ValueError."""
    bad = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))
    if not bad.isEmpty():
        raise ValueError(f"{key} is missing or repeated")
    return df


def slice_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of the wanted ids; raises ValueError unless each of them has exactly one."""
    wanted = ids.select(key).distinct()
    out = df.join(wanted, key, "left_semi")
    if out.count() != wanted.count() or not wanted.join(df, key, "left_anti").isEmpty():
        raise ValueError("rows and wanted ids differ")
    return out


def metric_value(metric: str) -> Column:
    """passed, auto_resolved or a check as 0 or 1; an absent check counts as 0."""
    c = F.col(metric) if metric in ("passed", "auto_resolved") else F.col(f"checks.{metric}")
    return F.coalesce(c, F.lit(False)).cast("int")


def eligible_cases(runs: DataFrame, run: str, case: str, flag: str) -> DataFrame:
    """Cases that all runs call eligible; raises ValueError if runs disagree or none is."""
    per = runs.groupBy(case).agg(F.count_distinct(flag).alias("d"), F.min(flag).alias("eligible"))
    if not per.where("d <> 1").isEmpty():
        raise ValueError("runs disagree on eligibility")
    out = per.where("eligible").select(case)
    if out.isEmpty():
        raise ValueError("no case is eligible")
    return out


def compare(runs: DataFrame, run: str, case: str, tier: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """Rates of each run, by tier too, and mean differences of each two runs, for the named metrics.

    ``runs`` has passed, auto_resolved and checks of every run's cases; all runs must have
    the same cases, each once.
    """
    metrics.same_cases(runs, run, case)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), metric_value(n).alias("value")) for n in names])).alias("m")
    long_ = runs.select(run, case, tier, pairs).select(run, case, tier, "m.metric", "m.value")
    rates = long_.groupBy(run, "metric").agg(F.avg("value").alias("rate"), F.count("*").alias("n"))
    by_tier = long_.groupBy(run, tier, "metric").agg(F.avg("value").alias("rate"), F.count("*").alias("n"))
    l = long_.select(F.col(run).alias("left_run"), case, "metric", F.col("value").alias("l"))
    r = long_.select(F.col(run).alias("right_run"), case, "metric", F.col("value").alias("r"))
    deltas = l.join(r, [case, "metric"]).where("left_run < right_run").groupBy("left_run", "right_run", "metric").agg(F.avg(F.col("r") - F.col("l")).alias("delta"), F.count("*").alias("n"))
    return {"rates": rates, "by_tier": by_tier, "deltas": deltas}


def failure_details(before: DataFrame, after: DataFrame, case: str) -> DataFrame:
    """Cases whose result changed: transition, errors of both, and whether the calls differ."""
    word = lambda c: F.when(c, "pass").otherwise("fail")
    b, a = (t.select(case, F.col("passed").alias(f"{n}_passed"), F.col("errors").alias(f"{n}_errors"), F.col("calls").alias(f"{n}_calls")) for n, t in (("before", before), ("after", after)))
    j = b.join(a, case)
    changed = j.where(F.col("before_passed") != F.col("after_passed"))
    return changed.select(
        case,
        F.concat(word(F.col("before_passed")), F.lit("_to_"), word(F.col("after_passed"))).alias("transition"),
        "before_errors",
        "after_errors",
        (~F.to_json("before_calls").eqNullSafe(F.to_json("after_calls"))).alias("tool_sequence_changed"),
    )


def run_rollup(training: DataFrame, hardware: DataFrame, results: DataFrame, run: str) -> DataFrame:
    """One row for each run with its training, hardware and results; repeated runs raise ValueError."""
    out = unique(training, run)
    for t in (hardware, results):
        out = out.join(unique(t, run), run, "left")
    return out


def gated_margin(df: DataFrame, *scores: str) -> DataFrame:
    """``df`` itself; a row without one of its scores raises an error when it is read."""
    missing = F.coalesce(*[F.when(F.col(s).isNull(), F.lit(s)) for s in scores])
    checked = F.when(missing.isNotNull(), F.raise_error(F.concat(F.lit("missing score: "), missing)).cast("double")).otherwise(F.col(scores[0]).cast("double"))
    return df.withColumn(scores[0], checked)


def with_end(tokens: Column | str, end: int) -> Column:
    """Token ids that end with one end token."""
    t = column(tokens)
    return F.when(F.get(t, F.size(t) - 1).eqNullSafe(F.lit(end)), t).otherwise(F.concat(t, F.array(F.lit(end))))


def allowed_claims(observations: Column | str) -> Column:
    """Field and value of all successful queries' data, the later one of a field winning, as a map."""
    data = F.transform(
        F.filter(column(observations), lambda o: F.coalesce(F.get_json_object(o, "$.ok") == "true", F.lit(False))),
        lambda o: F.coalesce(F.from_json(F.get_json_object(o, "$.data"), "map<string,string>"), F.create_map().cast("map<string,string>")),
    )
    return F.aggregate(data, F.create_map().cast("map<string,string>"), lambda done, m: F.map_concat(F.map_filter(done, lambda k, _: ~F.map_contains_key(m, k)), m))


def sealed_set_faults(parts: dict[str, DataFrame], key: str, others: dict[str, DataFrame], keys: dict[str, Column]) -> list[str]:
    """What speaks against a sealed set: tables whose ids differ, and kinds of keys that it shares with other sets."""
    faults = [] if audit.same_identities(list(parts.values()), key) else ["ids differ between the set's tables"]
    first = next(iter(parts.values()))
    for name, other in others.items():
        faults += [f"{r.key_type} shared with {name}" for r in dedup.leakage(first, other, keys).select("key_type").distinct().orderBy("key_type").collect()]  # as many as kinds of keys
    return faults


def token_audit(df: DataFrame, limits: tuple[int, ...], implausible: int, *lengths: str) -> DataFrame:
    """For each length column: count, least, largest, ceil-rank percentiles, how many exceed each limit, and
    whether any is longer than is plausible."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("long").alias("tokens")) for c in lengths])).alias("x")
    long_ = df.select(pairs).select("x.*").where("tokens is not null")
    ranks = metrics.percentiles(long_, ["field"], "tokens", {f"p{round(p * 100)}": ("nearest", p) for p in (0.5, 0.9, 0.95, 0.99)})
    return long_.groupBy("field").agg(*metrics.summary("tokens", limits), (F.max("tokens") > implausible).alias("implausible")).join(ranks, "field")


def mining_rows(cases: DataFrame, oracles: DataFrame, traces: DataFrame, results: DataFrame, key: str = "case_id") -> DataFrame:
    """One row for each case with structs oracle, trace and result; a case that one of them lacks, and a repeated key,
    raise ValueError."""
    out = unique(cases, key)
    for name, t in (("oracle", oracles), ("trace", traces), ("result", results)):
        if not out.join(unique(t, key), key, "left_anti").isEmpty():
            raise ValueError(f"a case has no {name}")
        out = out.join(t.select(F.col(key), F.struct(*[c for c in t.columns if c != key]).alias(name)), key)
    return out


def with_trace_evidence(items: DataFrame, traces: dict[str, DataFrame], key: str = "case_id", evidence: tuple[str, ...] = ("observations", "termination_reason", "parse_errors")) -> DataFrame:
    """Review items whose structs of each run's name also hold what that run observed; an item without a trace, and a
    repeated trace, raise ValueError."""
    out = items
    for name, t in traces.items():
        if not out.join(unique(t, key), key, "left_anti").isEmpty():
            raise ValueError(f"an item has no trace of {name}")
        seen = t.select(F.col(key), F.struct(*evidence).alias("__seen"))
        kept = [f.name for f in items.schema[name].dataType.fields if f.name not in evidence]
        both = F.struct(*[F.col(f"{name}.{c}").alias(c) for c in kept], *[F.col(f"__seen.{c}").alias(c) for c in evidence])
        out = out.join(seen, key).withColumn(name, both).drop("__seen")
    return out


def stratum(task: Column | str, source: Column | str, scenario: Column | str, split: Column | str, level: Column | str, error: Column | str) -> Column:
    """Source, scenario and split of a row as one key; of a preference pair (task dpo) its level and error too."""
    c, missing = column, F.lit("unknown")
    pair = F.when(c(task) == "dpo", F.concat(F.lit("|"), F.coalesce(c(level), missing), F.lit("|"), F.coalesce(c(error), missing))).otherwise("")
    return F.concat(F.concat_ws("|", c(source), c(scenario), c(split)), pair)


def level_of(*candidates: Column | str, allowed: tuple[str, ...] = ("response", "decision", "parameter")) -> Column:
    """The first level that is there and not empty; one that isn't allowed, and none, raise an error when it is read."""
    found = F.coalesce(*[F.when(column(c) != "", column(c)) for c in candidates], F.lit(""))
    return F.when(found.isin(*allowed), found).otherwise(F.raise_error(F.concat(F.lit("unsupported preference level: "), found)).cast("string"))


def review_id(place: Column | str) -> Column:
    """R and the place (from 1) in three digits or more."""
    text = column(place).cast("string")
    return F.concat(F.lit("R"), F.lpad(text, F.greatest(F.length(text), F.lit(3)), F.lit("0")))


def pair_id(version: str, case: Column | str, step: Column | str) -> Column:
    return F.concat(F.lit(f"dpo-v{version}-rollout-"), column(case), F.lit("-step"), column(step).cast("string"))
