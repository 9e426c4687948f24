"""Checks of networks and estimates, each a relation of issues: network_id, code, element."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slackline.operators import graph
from slackline.operators.schedule import FOLD_LIMIT, by_size, gathered, let, placed


def issue(rows: DataFrame, code: str, element: Column | str = "") -> DataFrame:
    value = F.lit(element) if isinstance(element, str) else element
    return rows.select("network_id", F.lit(code).alias("code"), value.cast("string").alias("element"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def unknown_ends(activities: DataFrame, dependencies: DataFrame, end: str) -> DataFrame:
    return dependencies.join(activities.select("network_id", F.col("activity_id").alias(end)), ["network_id", end], "left_anti")


def repeated_edges(dependencies: DataFrame) -> DataFrame:
    """Every occurrence of an edge after its first."""
    counted = dependencies.groupBy("network_id", "source", "target").agg(F.count("*").alias("n"))
    return counted.filter("n > 1").withColumn("k", F.explode(F.expr("sequence(2, n)"))).drop("n", "k")


def component_counts(activities: DataFrame, dependencies: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """network_id, component_count, acyclic."""
    return by_size(activities.dropDuplicates(["network_id", "activity_id"]), dependencies, fold_counts, loop_counts, fold_limit)


def loop_counts(activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    counted = graph.components(activities, dependencies).groupBy("network_id").agg(F.count_distinct("component").cast("int").alias("component_count"))
    return counted.join(graph.acyclic(activities, dependencies, 0), "network_id").select("network_id", "component_count", F.col("is_dag").alias("acyclic"))


#: Labels of a small network settle within its own row.
COMPONENTS = """aggregate(sequence(1, size(a)), sequence(1, size(a)), (c, r) -> transform(c, (v, i) ->
    least(v, coalesce(array_min(transform(filter(e, x -> x.s = i + 1 or x.t = i + 1), x -> least(c[x.s - 1], c[x.t - 1]))), v))))"""


def fold_counts(activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    rows = gathered(activities, dependencies)
    return rows.select("network_id", F.size(F.array_distinct(F.expr(let(COMPONENTS, "a", "e")))).alias("component_count"), "acyclic")


def graph_issues(activities: DataFrame, dependencies: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """All structural issues; activities that are dummies (is_dummy) may have no duration. Empty networks have no rows to report."""
    return by_size(activities, dependencies, fold_issues, join_issues, fold_limit)


def fold_issues(activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Every check of a small network inside its own row: one grouping of each table, no joins of edges with activities."""
    dummy = F.coalesce(F.col("is_dummy"), F.lit(False)) if "is_dummy" in activities.columns else F.lit(False)
    acts = activities.withColumn("dummy", dummy).groupBy("network_id").agg(F.array_sort(F.collect_list(F.struct("seq", "activity_id", "duration", "dummy"))).alias("all"))
    deps = dependencies.groupBy("network_id").agg(F.collect_list(F.struct("source", "target")).alias("d_all"))
    rows = acts.join(deps, "network_id", "full")
    rows = rows.withColumn("all", F.coalesce("all", F.expr("filter(array(named_struct('seq', 0, 'activity_id', '', 'duration', 0D, 'dummy', false)), x -> false)").cast(rows.schema["all"].dataType)))
    rows = rows.withColumn("d_all", F.coalesce("d_all", F.expr("cast(array() as array<struct<source:string,target:string>>)")))
    rows = rows.withColumn("known", F.expr("filter(all.activity_id, x -> x is not null)")).withColumn("a", F.expr("transform(filter(all, (x, i) -> array_position(all.activity_id, x.activity_id) = i + 1), x -> named_struct('seq', x.seq, 'activity_id', x.activity_id, 'duration', x.duration))")).withColumn("d", F.array_distinct("d_all"))
    rows = placed(rows)
    rows = rows.withColumn("component_count", F.size(F.array_distinct(F.expr(let(COMPONENTS, "a", "e")))))
    has = "coalesce(array_contains(known, {0}), false)"
    found = f"""flatten(array(
        transform(filter(all, x -> x.activity_id is null or trim(x.activity_id) = ''), x -> named_struct('code', 'missing_activity_id', 'element', x.activity_id)),
        transform(filter(all, x -> coalesce(x.duration, 0D) <= 0 and not x.dummy), x -> named_struct('code', 'missing_duration', 'element', x.activity_id)),
        transform(filter(d_all, x -> not {has.format("x.source")}), x -> named_struct('code', 'unknown_dependency_source', 'element', x.source)),
        transform(filter(d_all, x -> not {has.format("x.target")}), x -> named_struct('code', 'unknown_dependency_target', 'element', x.target)),
        transform(filter(d_all, x -> x.source = x.target), x -> named_struct('code', 'self_loop', 'element', x.source)),
        flatten(transform(array_distinct(d_all), x -> array_repeat(named_struct('code', 'duplicate_edge', 'element', concat_ws('->', x.source, x.target)), size(filter(d_all, y -> y = x)) - 1))),
        if(acyclic or size(a) = 0, array(), array(named_struct('code', 'cycle', 'element', ''))),
        if(component_count > 1 and size(a) > 0, array(named_struct('code', 'disconnected_components', 'element', cast(component_count as string))), array()),
        transform(filter(all, v -> not coalesce(exists(d_all, x -> (x.source = v.activity_id or x.target = v.activity_id) and {has.format("x.source")} and {has.format("x.target")}), false)), x -> named_struct('code', 'isolated_activity', 'element', x.activity_id))))"""
    return rows.select("network_id", F.explode(F.expr(let(found, "all", "d_all", "known"))).alias("i")).select("network_id", "i.code", F.col("i.element").cast("string").alias("element"))


def join_issues(activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    """The same by joins, for networks of any size."""
    dummy = F.coalesce(F.col("is_dummy"), F.lit(False)) if "is_dummy" in activities.columns else F.lit(False)
    known = graph.known_edges(activities, dependencies)
    touched = known.select("network_id", F.col("source").alias("activity_id")).union(known.select("network_id", "target")).distinct()
    shape = component_counts(activities, dependencies)
    return union(
        [
            issue(activities.filter("activity_id is null or trim(activity_id) = ''"), "missing_activity_id", F.col("activity_id")),
            issue(activities.filter((F.coalesce("duration", F.lit(0.0)) <= 0) & ~dummy), "missing_duration", F.col("activity_id")),
            issue(unknown_ends(activities, dependencies, "source"), "unknown_dependency_source", F.col("source")),
            issue(unknown_ends(activities, dependencies, "target"), "unknown_dependency_target", F.col("target")),
            issue(dependencies.filter("source = target"), "self_loop", F.col("source")),
            issue(repeated_edges(dependencies), "duplicate_edge", F.concat_ws("->", "source", "target")),
            issue(shape.filter("not acyclic"), "cycle"),
            issue(shape.filter("component_count > 1"), "disconnected_components", F.col("component_count")),
            issue(activities.join(touched, ["network_id", "activity_id"], "left_anti"), "isolated_activity", F.col("activity_id")),
        ]
    )


def graph_status(activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    found = graph_issues(activities, dependencies).groupBy("network_id").agg(F.count("*").alias("issue_count"))
    every = activities.select("network_id").distinct().join(found, "network_id", "left")
    return every.select("network_id", F.when(F.col("issue_count").isNull(), "VALID").otherwise("INVALID").alias("status"), F.coalesce("issue_count", F.lit(0)).alias("issue_count"))


def consistency(activities: DataFrame, issues: DataFrame) -> DataFrame:
    """The first of self_loop, duplicate, cycle, isolated that a network has, else valid."""
    has = lambda code: F.max(F.col("code") == code).alias(code)
    flags = issues.groupBy("network_id").agg(has("self_loop"), has("duplicate_edge"), has("cycle"), has("isolated_activity"))
    rows = activities.select("network_id").distinct().join(flags, "network_id", "left")
    verdict = F.when(F.col("self_loop"), "self_loop").when(F.col("duplicate_edge"), "duplicate").when(F.col("cycle"), "cycle").when(F.col("isolated_activity"), "isolated").otherwise("valid")
    return rows.select("network_id", verdict.alias("consistency"))


def builder_issues(activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    """What construction refuses: repeated ids, negative or zero durations, self and repeated dependencies, missing references."""
    dummy = F.coalesce(F.col("is_dummy"), F.lit(False)) if "is_dummy" in activities.columns else F.lit(False)
    twice = activities.groupBy("network_id", "activity_id").agg(F.count("*").alias("n")).filter("n > 1")
    return union(
        [
            issue(twice, "duplicate_activity", F.col("activity_id")),
            issue(activities.filter((F.col("duration") < 0) | ((F.col("duration") == 0) & ~dummy)), "invalid_duration", F.col("activity_id")),
            issue(dependencies.filter("source = target"), "self_dependency", F.col("source")),
            issue(repeated_edges(dependencies), "duplicate_dependency", F.concat_ws("->", "source", "target")),
            issue(graph.dangling_edges(activities, dependencies), "missing_reference", F.concat_ws("->", "source", "target")),
        ]
    )


#: In the order in which the schedule refuses a network; a cycle counts only without any other error.
PRECEDENCE = ("negative_duration", "missing_duration", "duplicate_activity", "missing_reference", "cycle")


def first_error(activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    """network_id and the code of its first error; networks without error have no row."""
    dummy = F.coalesce(F.col("is_dummy"), F.lit(False)) if "is_dummy" in activities.columns else F.lit(False)
    twice = activities.groupBy("network_id", "activity_id").agg(F.count("*").alias("n")).filter("n > 1")
    parts = [
        activities.filter("duration < 0"),
        activities.filter((F.col("duration").isNull() | (F.col("duration") <= 0)) & ~dummy),
        twice,
        graph.dangling_edges(activities, dependencies),
        component_counts(activities, dependencies).filter("not acyclic"),
    ]
    ranked = [issue(p, code).withColumn("rank", F.lit(k + 1)) for k, (p, code) in enumerate(zip(parts, PRECEDENCE, strict=True))]
    return union(ranked).groupBy("network_id").agg(F.min_by("code", "rank").alias("code"))


def pert_issues(activities: DataFrame) -> DataFrame:
    """network_id, code, activity_id for each rule that an activity's three estimates break; non-numeric text is an issue, not a null."""
    names = ("optimistic_time", "most_likely_time", "pessimistic_time")
    number = {n: F.expr(f"try_cast({n} as double)") for n in names}
    usable = {n: F.when((number[n] >= 0) & ~F.isnan(number[n]) & (number[n] < float("inf")), number[n]) for n in names}
    o, m, p = (usable[n] for n in names)
    when = lambda cond, code: F.when(cond, F.lit(code))
    checks = [when(F.col(n).isNotNull() & number[n].isNull(), "pert_estimate_not_numeric") for n in names]
    checks += [when(number[n].isNotNull() & usable[n].isNull(), "pert_estimate_invalid") for n in names]
    blank = reduce(lambda a, b: a | b, (F.col(n).isNull() | (F.trim(F.col(n).cast("string")) == "") for n in names))
    checks += [when(blank, "missing_pert_estimate"), when(o > m, "pert_ordering"), when(m > p, "pert_ordering"), when(o > p, "pert_ordering")]
    found = F.filter(F.array(*checks), lambda c: c.isNotNull())
    return activities.select("network_id", "activity_id", F.explode(found).alias("code")).select("network_id", "code", "activity_id")


def pert_status(activities: DataFrame) -> DataFrame:
    """NO_PERT_DATA without any estimate, else INVALID, REVIEW_REQUIRED or READY."""
    some = activities.groupBy("network_id").agg(F.max(F.coalesce("optimistic_time", "most_likely_time", "pessimistic_time").isNotNull()).alias("some"))
    kinds = pert_issues(activities).groupBy("network_id").agg(F.max(F.col("code") != "missing_pert_estimate").alias("bad"))
    status = F.when(~F.col("some"), "NO_PERT_DATA").when(F.col("bad"), "PERT_INVALID").when(F.col("bad").isNotNull(), "PERT_REVIEW_REQUIRED").otherwise("PERT_READY")
    return some.join(kinds, "network_id", "left").select("network_id", status.alias("status"))


def topology_issues(activities: DataFrame, dependencies: DataFrame, longest: float = 50.0) -> DataFrame:
    """network_id, code, severity, element of reconstructed networks: errors for broken edges and ids, warnings for weak evidence."""
    dummy = F.coalesce(F.col("is_dummy"), F.lit(False)) if "is_dummy" in activities.columns else F.lit(False)
    blank = (F.coalesce("duration", F.lit(0.0)) <= 0) & ~dummy
    twice = activities.groupBy("network_id", "activity_id").agg(F.count("*").alias("n")).filter("n > 1")
    ends = graph.ends(activities, graph.known_edges(activities, dependencies)).groupBy("network_id").agg(F.max("is_source").alias("has_source"), F.max("is_sink").alias("has_sink"))
    shape = component_counts(activities, dependencies)
    structure = graph_issues(activities, dependencies).filter("code in ('isolated_activity', 'disconnected_components')")
    parts = {
        "ERROR": [
            issue(dependencies.filter("source = target"), "self_loop", F.col("source")),
            issue(unknown_ends(activities, dependencies, "source"), "invalid_edge", F.col("source")),
            issue(unknown_ends(activities, dependencies, "target"), "invalid_edge", F.col("target")),
            issue(twice, "duplicate_id", F.col("activity_id")),
            issue(shape.filter("not acyclic"), "cycle"),
        ],
        "WARNING": [
            structure,
            issue(activities.filter(blank), "missing_duration", F.col("activity_id")),
            issue(activities.filter(blank | (F.col("duration") > longest)), "suspicious_duration", F.col("activity_id")),
            issue(activities.filter("activity_id like 'INFERRED!_%' escape '!'"), "suspicious_id", F.col("activity_id")),
            issue(ends.filter("not has_source"), "no_sources"),
            issue(ends.filter("not has_sink"), "no_sinks"),
        ],
    }
    return union([union(rows).withColumn("severity", F.lit(severity)) for severity, rows in parts.items()])


def ground_truth_issues(activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Annotation checks: repeated ids, missing durations (a warning), references to no activity."""
    twice = activities.groupBy("network_id", "activity_id").agg(F.count("*").alias("n")).filter("n > 1")
    return union(
        [
            issue(twice, "duplicate_id", F.col("activity_id")),
            issue(activities.filter("duration is null"), "missing_duration", F.col("activity_id")),
            issue(graph.dangling_edges(activities.dropDuplicates(["network_id", "activity_id"]), dependencies), "unknown_reference", F.concat_ws("->", "source", "target")),
        ]
    )
