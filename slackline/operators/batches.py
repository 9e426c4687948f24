"""Networks of a row each as arrays: both passes, checks and first paths over all networks of an Arrow batch at once.

Rows come from listed(): a (activities in the order of seq, with weight, their duration as double) and d (edges as they stand).
Vertices and edges of a batch are numbered through; a round of an algorithm advances every network of the batch, so
the rounds are as many as the longest chain among them has vertices. A missing duration gives a missing finish, which offers nothing
to its neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackline.shipping import ship


def listed(activities: DataFrame, dependencies: DataFrame, carry: tuple[str, ...] = (), how: str = "left") -> DataFrame:
    """A row a network: a and d, null where a network has none. Rows that lie together by network are grouped as they come, without a hash table."""
    activities.sparkSession.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")
    activities, dependencies = (t.sortWithinPartitions("network_id") for t in (activities, dependencies))
    weight = F.col("duration").cast("double").alias("weight")
    acts = activities.groupBy("network_id").agg(F.sort_array(F.collect_list(F.struct("seq", "activity_id", "duration", *carry, weight))).alias("a"))
    deps = dependencies.groupBy("network_id").agg(F.collect_list(F.struct("source", "target")).alias("d"))
    return acts.join(deps, "network_id", how)


def mapped(rows: DataFrame, f: Callable[[Networks], pa.RecordBatch], schema: str, kind: str = "Networks") -> DataFrame:
    """f of every batch of rows as a class of this module; schema names the columns that f gives."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(KINDS[kind](batch))

    return rows.mapInArrow(run, schema)


def flat(lists: pa.ListArray) -> tuple[pa.StructArray, np.ndarray]:
    """The elements of lists and the place of the list that each comes from; null lists have none."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), n)


def spans(start: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """start[r] up to start[r + 1], for all r of rows in turn."""
    n = start[rows + 1] - start[rows]
    return np.repeat(start[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())


def masked(values: np.ndarray, there: np.ndarray) -> pa.Array:
    return pa.array(values, mask=~there)


class Networks:
    """A batch's vertices by number, distinct edges s -> t with known ends in the order of s, and rounds: vertices by level."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.names = batch.column(batch.schema.get_field_index("network_id"))
        self.size = batch.num_rows
        self.vertices, self.net = flat(batch.column(batch.schema.get_field_index("a")))
        edges, self.edge_net = flat(batch.column(batch.schema.get_field_index("d")))
        ids, ends = self.field("activity_id"), [pc.struct_field(edges, [k]) for k in (0, 1)]
        coded = pa.concat_arrays([ids, *ends]).dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order) + 1, np.int64)
        rank[order], rank[-1] = np.arange(len(order)), -1  # null comes last here, and has no rank
        codes = rank[pc.fill_null(coded.indices, -1).to_numpy()]
        n, m = len(ids), len(edges)
        #: Ranks of the ids among all of the batch; -1 for null.
        self.ids, self.sources, self.targets = codes[:n], codes[n : n + m], codes[n + m :]
        self.count, width = n, len(order) + 1
        known = np.flatnonzero(self.ids >= 0)
        keys, first = np.unique(self.net[known] * width + self.ids[known], return_index=True)
        first = known[first]
        at = [self.find(keys, first, np.where(end >= 0, self.edge_net * width + end, -1)) for end in (self.sources, self.targets)]
        self.source_at, self.target_at = at
        both = (at[0] >= 0) & (at[1] >= 0)
        self.link(at[0][both], at[1][both])

    def link(self, s: np.ndarray, t: np.ndarray) -> None:
        """Takes edges between vertices by number; repeated ones count once."""
        n = self.count
        edge = np.unique(s * n + t)
        self.s, self.t = edge // max(n, 1), edge % max(n, 1)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(self.s, minlength=n))])
        waiting = np.bincount(self.t, minlength=n)
        self.rounds = []
        done = np.zeros(n, bool)
        fresh = np.flatnonzero(waiting == 0)
        while fresh.size:
            self.rounds.append(fresh)
            done[fresh] = True
            to = self.t[spans(self.start, fresh)]
            np.subtract.at(waiting, to, 1)
            fresh = np.unique(to[waiting[to] == 0])
        self.acyclic = np.ones(self.size, bool)
        self.acyclic[self.net[~done]] = False

    @staticmethod
    def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The value of each wanted key, -1 for unknown ones."""
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], -1)

    def field(self, name: str) -> pa.Array:
        return pc.struct_field(self.vertices, [self.vertices.type.get_field_index(name)])

    def numbers(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """A column of vertices as doubles, and where it is not null."""
        column = self.field(name)
        return pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False), pc.is_valid(column).to_numpy(zero_copy_only=False)

    def passes(self) -> None:
        """Starts and finishes of both passes; those of cyclic networks mean nothing. timed: where a duration is."""
        weight, self.timed = self.numbers("weight")
        n = self.count
        self.es, self.ef = np.zeros(n), np.zeros(n)
        best, got = np.full(n, -np.inf), np.zeros(n, bool)
        for level in self.rounds:
            self.es[level] = np.where(got[level], best[level], 0.0)
            self.ef[level] = weight[level] + self.es[level]
            x = spans(self.start, level)
            x = x[self.timed[self.s[x]]]
            np.maximum.at(best, self.t[x], self.ef[self.s[x]])
            got[self.t[x]] = True
        longest, some = np.full(self.size, -np.inf), np.zeros(self.size, bool)
        np.maximum.at(longest, self.net[self.timed], self.ef[self.timed])
        some[self.net[self.timed]] = True
        self.duration = np.where(some, longest, 0.0)
        self.ls, self.lf = np.zeros(n), np.zeros(n)
        for level in reversed(self.rounds):
            x = spans(self.start, level)
            x = x[self.timed[self.t[x]]]
            least, got = self.least(self.s[x], self.ls[self.t[x]])
            self.lf[level] = np.where(got[level], least[level], self.duration[self.net[level]])
            self.ls[level] = self.lf[level] - weight[level]
        self.next, self.followed = self.least(self.s, self.es[self.t])

    def least(self, at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least value at each vertex, NaN last, and where there is one; at rises or is short."""
        least, got = np.full(self.count, np.nan), np.zeros(self.count, bool)
        np.fmin.at(least, at, values)
        got[at] = True
        return least, got

    def scheduled(self) -> pa.RecordBatch:
        """A row an activity of the acyclic networks."""
        self.passes()
        kept = np.flatnonzero(self.acyclic[self.net])
        take = lambda column, where: column.take(pa.array(where))
        times = {"early_start": masked(self.es, np.ones(self.count, bool)), "early_finish": masked(self.ef, self.timed), "late_start": masked(self.ls, self.timed), "late_finish": masked(self.lf, np.ones(self.count, bool)), "next_start": masked(self.next, self.followed)}
        columns = {"network_id": take(self.names, self.net[kept])} | {c: take(self.field(c), kept) for c in ("activity_id", "seq", "duration")} | {c: take(v, kept) for c, v in times.items()}
        return pa.RecordBatch.from_pydict(columns | {"project_duration": pa.array(self.duration[self.net[kept]])})

    def first_walk_totals(self, tolerance: float) -> pa.RecordBatch:
        """A row an acyclic network with a critical vertex: variance along its first critical walk (fewest vertices, then least ids), duration, counts."""
        self.passes()
        n = self.count
        here = self.acyclic[self.net] & self.timed
        critical = here & (np.abs(self.ls - self.es) < tolerance)
        on = critical[self.s] & critical[self.t]
        s, t = self.s[on], self.t[on]
        start = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=n))])
        # ids differ within a network wherever there are edges, so the first vertex that differs decides between walks of one length
        far = np.iinfo(np.int64).max
        length, follow, width = np.ones(n, np.int64), np.full(n, -1), int(self.ids.max(initial=0)) + 1
        for level in reversed(self.rounds):
            x = spans(start, level)
            best = np.full(n, far) if x.size else None
            if best is not None:
                key = length[t[x]] * width + self.ids[t[x]]
                np.minimum.at(best, s[x], key)
                chosen = x[best[s[x]] == key]
                follow[s[chosen]] = t[chosen]
                length[s[chosen]] = length[t[chosen]] + 1
        heads = critical.copy()
        heads[t] = False
        v = np.flatnonzero(heads)
        v = v[np.lexsort((self.ids[v], length[v], self.net[v]))]
        nets, first = np.unique(self.net[v], return_index=True)
        variance, known = self.numbers("variance")
        total, whole, at, row = np.zeros(len(nets)), np.ones(len(nets), bool), v[first], np.arange(len(nets))
        while row.size:
            total[row] += variance[at]
            whole[row] &= known[at]
            at = follow[at]
            row, at = row[at >= 0], at[at >= 0]
        count = lambda rows: np.bincount(self.net[rows], minlength=self.size)[nets]
        return pa.RecordBatch.from_pydict(
            {
                "network_id": self.names.take(pa.array(nets)),
                "project_variance": masked(total, whole),
                "project_duration": pa.array(self.duration[nets]),
                "critical_count": pa.array(count(critical)),
                "non_critical_count": pa.array(count(here & ~critical)),
            }
        )


def same(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the strings of both arrays are; -1 for null."""
    coded = pa.concat_arrays([left.cast(pa.string()), right.cast(pa.string())]).dictionary_encode()
    codes = pc.fill_null(coded.indices, -1).to_numpy().astype(np.int64)
    return codes[: len(left)], codes[len(left) :]


def decided(items: pa.Array, log: pa.StructArray) -> np.ndarray:
    """The row of log (its rows in order) that decides each item, -1 without one."""
    wanted, given = same(items, pc.struct_field(log, [log.type.get_field_index("item_id")]))
    known = np.flatnonzero(given >= 0)
    keys, first = np.unique(given[known], return_index=True)
    return Networks.find(keys, known[first], wanted)


def column_of(log: pa.StructArray, name: str) -> pa.Array:
    return pc.struct_field(log, [log.type.get_field_index(name)])


class Reviewed(Networks):
    """Networks after their reviews, as review.apply() leaves them; sound: those without issue of it or of validate.graph_issues()."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        super().__init__(batch)
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        label, ids = column("label").take(pa.array(self.net)), self.field("activity_id")
        n = self.count
        id_log, _ = flat(column("id_log"))
        by = decided(pc.if_else(pc.is_valid(ids), pc.binary_join_element_wise(label, ids, ":"), label), id_log)
        row = pa.array(by, mask=by < 0)
        gone = pc.fill_null(pc.equal(column_of(id_log, "decision").take(row), "REJECT"), False).to_numpy(zero_copy_only=False)
        names = pc.coalesce(column_of(id_log, "corrected_value").take(row), ids)
        kept = np.flatnonzero(~gone)

        edges, _ = flat(column("d"))
        edge_log, _ = flat(column("edge_log"))
        ends = [pc.struct_field(edges, [k]) for k in (0, 1)]
        by = decided(pc.binary_join_element_wise(pc.binary_join_element_wise(column("label").take(pa.array(self.edge_net)), ends[0], ":"), ends[1], ">"), edge_log)
        row = pa.array(by, mask=by < 0)
        decision = pc.fill_null(column_of(edge_log, "decision").take(row), "PENDING")
        new_end = column_of(edge_log, "new_end").take(row)
        has = lambda word: pc.equal(decision, word)
        source = pc.if_else(has("REVERSE"), ends[1], pc.if_else(has("CHANGE_SOURCE"), new_end, ends[0]))
        target = pc.if_else(has("REVERSE"), ends[0], pc.if_else(has("CHANGE_TARGET"), new_end, ends[1]))
        stays = pc.and_(pc.not_equal(decision, "REJECT"), pc.and_(pc.is_valid(ends[0]), pc.is_valid(ends[1]))).to_numpy(zero_copy_only=False)

        old, both = same(ids, pa.concat_arrays([source, target]))
        final, _ = same(names, names)
        width = max(int(old.max(initial=0)), int(both.max(initial=0))) + 1
        named = kept[old[kept] >= 0]
        keys, first = np.unique(self.net[named] * width + old[named], return_index=True)
        s, t = (self.find(keys, named[first], np.where(end >= 0, self.edge_net * width + end, -1)) for end in np.split(both, 2))
        mapped = stays & (s >= 0) & (t >= 0)
        reviewed = mapped & pc.not_equal(decision, "PENDING").to_numpy(zero_copy_only=False)
        _, times = np.unique(s[reviewed] * n + t[reviewed], return_counts=True)
        repeated = np.unique(s[reviewed] * n + t[reviewed])[times > 1]

        bad = np.zeros(self.size, bool)
        bad[self.net[repeated // max(n, 1)]] = True
        width = int(final.max(initial=0)) + 2
        pairs, times = np.unique(self.net[kept] * width + final[kept] + 1, return_counts=True)
        bad[pairs[times > 1] // width] = True
        blank = pc.fill_null(pc.equal(pc.ascii_trim(names, characters=" "), ""), True).to_numpy(zero_copy_only=False)
        weight, there = self.numbers("weight")
        idle = (np.where(there, weight, 0.0) <= 0) & ~pc.fill_null(self.field("dummy"), False).to_numpy(zero_copy_only=False)
        bad[self.net[kept[(blank | idle)[kept]]]] = True

        # of the vertices that stay: none, or some that no walk along edges in either direction joins
        self.vertices, self.net, self.count = self.vertices.take(pa.array(kept)), self.net[kept], len(kept)
        place = np.full(n, -1)
        place[kept] = np.arange(len(kept))
        self.link(place[s[mapped]], place[t[mapped]])
        part = np.arange(self.count)
        while (low := np.minimum(part[self.s], part[self.t])).size and (np.any(part[self.s] != low) or np.any(part[self.t] != low)):
            np.minimum.at(part, self.s, low)
            np.minimum.at(part, self.t, low)
            part = part[part]
        members = np.bincount(self.net, minlength=self.size)
        parts = np.bincount(self.net[part == np.arange(self.count)], minlength=self.size)
        self.sound = ~bad & self.acyclic & (members > 1) & (parts == 1)

    def totals(self, tolerance: float) -> pa.RecordBatch:
        """A row a sound network: its duration and counts of critical and other activities."""
        self.passes()
        critical = np.abs(self.ls - self.es) < tolerance
        nets = np.flatnonzero(self.sound)
        count = lambda rows: np.bincount(self.net[rows], minlength=self.size)[nets]
        return pa.RecordBatch.from_pydict({"network_id": self.names.take(pa.array(nets)), "project_duration": pa.array(self.duration[nets]), "critical_count": pa.array(count(critical)), "non_critical_count": pa.array(count(~critical))})


KINDS = {"Networks": Networks, "Reviewed": Reviewed}


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def schedules(activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    """network_id, activity_id, seq, duration, starts and finishes, next_start (null for a terminal), project_duration."""
    times = ", ".join(f"{c} double" for c in ("early_start", "early_finish", "late_start", "late_finish", "next_start", "project_duration"))
    kept = ", ".join(f"{c} {type_of(activities, c)}" for c in ("network_id", "activity_id", "seq", "duration"))
    return mapped(listed(activities, dependencies), Networks.scheduled, f"{kept}, {times}")


def first_walk_totals(activities: DataFrame, dependencies: DataFrame, tolerance: float) -> DataFrame:
    """network_id, project_variance, project_duration, critical_count, non_critical_count; activities have a variance."""
    schema = f"network_id {type_of(activities, 'network_id')}, project_variance double, project_duration double, critical_count long, non_critical_count long"
    return mapped(listed(activities.withColumn("variance", F.col("variance").cast("double")), dependencies, ("variance",)), lambda n: n.first_walk_totals(tolerance), schema)


def reviewed_totals(activities: DataFrame, dependencies: DataFrame, id_log: DataFrame, edge_log: DataFrame, tolerance: float) -> DataFrame:
    """network_id, project_duration, critical_count, non_critical_count of reviewed networks without issue; rows of both logs are usable ones and have their network_id."""
    dummy = F.coalesce(F.col("is_dummy"), F.lit(False)) if "is_dummy" in activities.columns else F.lit(False)
    rows = listed(activities.filter("network_id is not null").withColumn("dummy", dummy), dependencies, ("dummy",))
    for name, log, value in (("id_log", id_log, "corrected_value"), ("edge_log", edge_log, "new_end")):
        entry = F.struct("ts", "seq", "decision", F.col(value).cast("string").alias(value), "item_id")
        rows = rows.join(log.sortWithinPartitions("network_id").groupBy("network_id").agg(F.sort_array(F.collect_list(entry)).alias(name)), "network_id", "left")
    rows = rows.withColumn("label", F.col("network_id").cast("string"))
    schema = f"network_id {type_of(activities, 'network_id')}, project_duration double, critical_count long, non_critical_count long"
    return mapped(rows, lambda n: n.totals(tolerance), schema, "Reviewed")
