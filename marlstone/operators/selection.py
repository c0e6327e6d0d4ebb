"""Picks in a fixed order that skip what resembles an earlier pick: the one selection here that is serial by its meaning.

What is accepted decides what may follow, so candidates are visited one by one, in the order of a hash. Only bounded blocks
of them ever reach the driver: the next rows of each category that still lacks picks. When a block runs out, what
resembles the picks so far is dropped from the table first, in a distributed step, so a family of look-alikes costs one
block however large it is.

Defined cases: candidates without a category or an id are never picked; an id given twice is picked once; a target of 0 or a
category without candidates gives a shortfall row like any other; no findings resemble nothing; empty tables give no picks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from marlstone.operators.joins import against_all
from marlstone.session import cut

#: Candidates of a category that are looked at in a round, and picks that a plan may ask for.
BLOCK, MOST_PICKS = 200, 100_000


@dataclass(frozen=True)
class Loop:
    """A round of picks: up to so many of each category, in the order of the categories."""

    name: str
    targets: Mapping[str, int]


def alike(a: Row, b: Row, threshold: float, tolerances: Mapping[str, float]) -> bool:
    """Whether two candidates share enough of their findings and every vital that both have."""
    x, y = set(a.findings or []), set(b.findings or [])
    if not x or not y or len(x & y) < threshold * len(x | y):
        return False
    return all(a[v] is None or b[v] is None or abs(a[v] - b[v]) <= within for v, within in tolerances.items())


def _unlike(held: DataFrame, accepted: list[Row], threshold: float, tolerances: Mapping[str, float]) -> DataFrame:
    """held without what resembles an accepted row."""
    vitals = list(tolerances)
    few = held.sparkSession.createDataFrame([(list(r.findings or []), *[r[v] for v in vitals]) for r in accepted], "f array<string>, " + ", ".join(f"v{i} double" for i in range(len(vitals))) if vitals else "f array<string>")
    both = F.size(F.array_intersect("f", "findings"))
    near = (F.size("findings") > 0) & (F.size("f") > 0) & (both >= threshold * F.size(F.array_union("f", "findings")))
    for i, v in enumerate(vitals):
        near = near & F.coalesce(F.abs(F.col(f"v{i}") - F.col(v)) <= tolerances[v], F.lit(True))
    gone = against_all(few, held).where(near).select("id").distinct()
    return cut(held.join(gone, "id", "left_anti"))


def picked(candidates: DataFrame, loops: Sequence[Loop], order: Column, threshold: float, tolerances: Mapping[str, float], block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """picks (loop, category, pick, id) and shortfalls (loop, category, target, missing) of a plan of loops.

    candidates: id, category, findings (array), the vitals of tolerances. A loop takes no id of an earlier one and nothing
    that resembles any earlier pick.
    """
    if sum(sum(x.targets.values()) for x in loops) > MOST_PICKS:
        raise ValueError(f"a plan asks for more than {MOST_PICKS} picks")
    spark = candidates.sparkSession
    vitals = list(tolerances)
    rows = candidates.where("id is not null and category is not null")
    held = cut(rows.select("id", "category", order.alias("_o"), F.array_sort(F.array_distinct(F.coalesce("findings", F.array().cast("array<string>")))).alias("findings"), *[F.col(v).cast("double").alias(v) for v in vitals]).dropDuplicates(["id"]))
    accepted: list[Row] = []
    used: set = set()
    picks: list[tuple] = []
    short: list[tuple] = []

    def following(after: Mapping[str, tuple | None]) -> dict[str, list[Row]]:
        """The next block of each category behind its cursor: at most `block` rows each."""
        wanted = F.lit(False)
        for name, cursor in after.items():
            own = F.col("category") == name
            wanted = wanted | (own if cursor is None else own & (F.struct("_o", "id") > F.struct(F.lit(cursor[0]).alias("_o"), F.lit(cursor[1]).alias("id"))))
        nth = F.row_number().over(Window.partitionBy("category").orderBy("_o", "id"))
        got = held.where(wanted).withColumn("_n", nth).where(F.col("_n") <= block).collect()
        out: dict[str, list[Row]] = {name: [] for name in after}
        for row in sorted(got, key=lambda r: (r["_o"], r["id"])):
            out[row.category].append(row)
        return out

    for loop in loops:
        names = sorted(loop.targets)
        ready = following({name: None for name in names if loop.targets[name] > 0})
        for name in names:
            have, target = 0, loop.targets[name]
            queue = ready.get(name, [])
            while queue and have < target:
                for row in queue:
                    if have == target:
                        break
                    if row.id in used or any(alike(row, a, threshold, tolerances) for a in accepted):
                        continue
                    accepted.append(row)
                    used.add(row.id)
                    have += 1
                    picks.append((loop.name, name, have, row.id))
                if have < target:
                    if len(queue) < block:
                        break
                    cursor = (queue[-1]["_o"], queue[-1]["id"])
                    if accepted:
                        held = _unlike(held, accepted, threshold, tolerances)
                    queue = following({name: cursor})[name]
            short.append((loop.name, name, target, target - have))
    kind = dict(candidates.dtypes)["id"]
    return (
        spark.createDataFrame(picks, f"loop string, category string, pick int, id {kind}"),
        spark.createDataFrame(short, "loop string, category string, target int, missing int"),
    )
