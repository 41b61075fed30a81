"""What-if scenarios, sensitivity sweeps and regression gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators.quality import ExpectationError


def changed(base: DataFrame, other: DataFrame, key: str = "id", level: str = "lts") -> DataFrame:
    """(key, before, after) of rows whose level differs."""
    b = base.select(key, F.col(level).alias("before"))
    return b.join(other.select(key, F.col(level).alias("after")), key).where("before <> after")


def upgrades(edges: DataFrame, scenario: DataFrame, key: str = "id", level: str = "lts") -> DataFrame:
    """(key, before, after) of scenario rows that would lower an edge's level; ids that no edge has are skipped."""
    return changed(edges, scenario, key, level).where("after < before")


def funded_edges(trails: DataFrame, nodes: DataFrame, most_m: float = 25.0) -> DataFrame:
    """(id, u, v): new edges of single-line trails whose both ends lie within most_m of a node, in degrees times 111,000."""
    from kerbline.operators import spatial

    one = trails.where((F.size("parts") == 1) & (F.size(F.element_at("parts", 1)) > 1))
    at = lambda i: F.element_at(F.element_at("parts", 1), i)
    ends = one.select("id", F.explode(F.array(F.struct(F.lit(0).alias("k"), at(1).alias("p")), F.struct(F.lit(1).alias("k"), at(-1).alias("p")))).alias("e"))
    points = ends.select(F.struct("id", "e.k").alias("id"), F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y"))
    spots = nodes.select(F.col("node_id").alias("id"), F.lit(0).alias("part"), F.lit(0).alias("idx"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = spatial.nearest(points, spots, most_m / 111000.0)
    side = lambda k, n: near.where(F.col("id.k") == k).select(F.col("id.id").alias("id"), F.col("target").alias(n))
    return side(0, "u").join(side(1, "v"), "id").where("u <> v")


def sweep(run: Callable[[dict], DataFrame], variants: list[dict], summary: Callable[[DataFrame], dict]) -> tuple[list[dict], DataFrame | None]:
    """Rows (variant, changed, ... or error) and the ids that any variant changes.

    run: builds the rated edges with overrides. A variant that its own gates refuse becomes a row with the
    error; any other exception is a fault and ends the sweep.
    """
    base = run({}).cache()
    rows, flipped = [{"variant": "baseline", "changed": 0, **summary(base)}], None
    for v in variants:
        try:
            other = run(v["set"])
            moved = changed(base, other).select("id")
            rows.append({"variant": v["name"], "changed": moved.count(), **summary(other)})
            flipped = moved if flipped is None else flipped.unionByName(moved)
        except ExpectationError as e:
            rows.append({"variant": v["name"], "error": str(e)})
    base.unpersist()
    return rows, None if flipped is None else flipped.distinct()


def golden(edges: DataFrame, wanted: DataFrame, key: str = "id", level: str = "lts", expected: str = "expected_lts") -> DataFrame:
    """(key, expected, got, verdict): passed, failed or missing for each labelled row; unlabelled ones are left out."""
    w = wanted.where(F.col(expected).isNotNull()).select(key, F.col(expected).alias("expected"))
    out = w.join(edges.select(key, F.col(level).alias("got")), key, "left")
    return out.withColumn("verdict", F.when(F.col("got").isNull(), "missing").when(F.col("got") == F.col("expected"), "passed").otherwise("failed"))


#: Relative tolerance of each published metric.
TOLERANCES = {"total_miles": 0.02, "low_stress_miles": 0.05, "ridable_lts3_miles": 0.05, "islands": 0.10, "largest_island_miles": 0.10}


def drift(values: dict[str, float], baseline: dict[str, float], tolerances: dict[str, float] = TOLERANCES) -> list[str]:
    """Metrics that left their tolerance of the baseline, as messages; a missing one is a drift, too."""
    out = []
    for name, share in tolerances.items():
        want, got = baseline.get(name), values.get(name)
        if want is None:
            continue
        if got is None or abs(got - want) > share * abs(want):
            out.append(f"{name}: {got} against {want}, tolerance {share:.0%}")
    return out


def markdown(rows: list[dict]) -> str:
    """A sweep's rows as a Markdown table, refused variants below it."""
    names = [k for k in rows[0] if k != "variant"]
    lines = ["| variant | " + " | ".join(names) + " |", "|---|" + "--:|" * len(names)]
    lines += ["| " + r["variant"] + " | " + " | ".join(str(r.get(k, "")) for k in names) + " |" for r in rows if "error" not in r]
    return "\n".join(lines + [f"\n`{r['variant']}` was refused: {r['error']}" for r in rows if "error" in r]) + "\n"
