"""Embedding near-duplicates by sorted projection passes.

Distinct vectors are ordered, in several passes, by concatenated random-hyperplane hashes; neighbours in
a bounded window are verified by cosine in double precision; verified pairs of all passes are united.
Vectors that the passes connect are then compared with all others of their component, block by block, so
that no link within a dense group depends on the window.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import saved, scratch, tidy
from kerbline.operators.components import components


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in rows])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, rep) for every usable row, and (rep, label, v, copies) for each distinct vector of a label; both stored.

    rep is the least id of equal vectors. A row is usable if its label and id are not null and its vector
    is neither null, empty nor zero, and holds only finite numbers.
    """
    v = F.col("v")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    rows = rows.where(F.col("label").isNotNull() & F.col("id").isNotNull() & usable)
    kept = "array<float>" if "float" in vectors.schema[vec_col].dataType.simpleString() else "array<double>"
    rows = rows.withColumn("v", F.transform(v, lambda x: x + 0.0).cast(kept))  # one zero
    keys = rows.withColumn("key", F.sha2(F.concat(F.to_json(F.struct("label")), F.to_json("v")).cast("binary"), 256))
    keys = saved(keys, "vectors")
    of_key = keys.groupBy("key").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"))
    member = saved(keys.select("id", "key").join(of_key.select("key", "rep"), "key").select("id", "rep").distinct(), "members")
    reps = keys.join(of_key, "key").where("id = rep").dropDuplicates(["rep"])  # a repeated row counts once
    return member, saved(reps.select("rep", "label", "v", "copies"), "distinct")


#: Numbers of a sorted part, which one task compares in memory.
PART_NUMBERS = 2_500_000


def effort(n: int, threshold: float, passes: int, planes: int, window: int, miss: float) -> tuple[int, int]:
    """(passes, planes), at least those given, with which a lone pair at the threshold among n vectors of a label is missed with a probability of `miss`.

    Neighbours in a pass share about log2(n / window) leading bits, and a bit is shared with probability
    1 - angle / pi; so passes grow as a small power of n (0.18 at 0.93). Vectors are taken as evenly spread.
    """
    shared = max(0.0, math.log2(max(n, 1) / window))
    meet = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** shared
    needed = math.ceil(math.log(miss) / math.log1p(-meet)) if 0 < meet < 1 else 1
    return max(passes, needed), max(planes, 8 * math.ceil((math.log2(max(n, 1)) + 4) / 8))


def _passes(reps: DataFrame, threshold: float, passes: int, planes: int, window: int, seed: int) -> DataFrame:
    """(a, b) verified pairs of neighbours in each pass's order.

    A pass's sort key is a label, then one bit for each plane, in order. Sorted runs are cut into chunks
    of range partitions; each chunk also gets its successor's first `window` rows, so that no window is cut.
    """
    kind = reps.schema["rep"].dataType.simpleString()
    label = reps.schema["label"].dataType.simpleString()
    vector = reps.schema["v"].dataType.simpleString()
    parts = max(1, -(-(reps.agg(F.sum(F.size("v"))).first()[0] or 0) * passes // PART_NUMBERS))

    def keyed(frames):
        made: dict[int, np.ndarray] = {}
        for frame in frames:
            sizes = frame["v"].map(len).to_numpy()
            for size in np.unique(sizes):
                at = sizes == size
                x = _unit(frame["v"][at])
                if size not in made:
                    made[size] = np.random.default_rng([seed, int(size)]).normal(size=(size, passes * planes))
                for p in range(passes):
                    bits = np.packbits(x @ made[size][:, p * planes : (p + 1) * planes] > 0, axis=1)
                    yield pd.DataFrame({"pass": p, "rep": frame["rep"][at], "label": frame["label"][at], "size": int(size), "key": [b.tobytes() for b in bits], "v": frame["v"][at]})

    keys = reps.select("rep", "label", "v").mapInPandas(tidy(keyed), f"pass int, rep {kind}, label {label}, size int, key binary, v {vector}")
    order = ["pass", "label", "size", "key", "rep"]
    spread = saved(keys.select(*order, "v").repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "sorted")
    heads = spread.withColumn("row", F.row_number().over(Window.partitionBy("part").orderBy(*order))).where(F.col("row") <= window)
    # what follows a part: the heads of the parts behind it, until `window` rows are there
    counts = spread.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each partition
    needs = []
    for i, r in enumerate(counts):
        left, k = window, i + 1
        while left > 0 and k < len(counts):
            needs.append((r["part"], counts[k]["part"], left))
            left, k = left - counts[k]["n"], k + 1
    spark = reps.sparkSession
    needs = spark.createDataFrame(needs, "part int, later int, most int")
    tails = heads.withColumnRenamed("part", "later").join(F.broadcast(needs), "later").where("row <= most").drop("later", "row", "most").withColumn("own", F.lit(False))
    whole = spread.withColumn("own", F.lit(True)).unionByName(tails)

    def compare(frame):
        frame = frame.sort_values(order, kind="stable")
        out_a, out_b = [], []
        ids, own = frame["rep"].to_numpy(), frame["own"].to_numpy()
        for _, rows in frame.reset_index(drop=True).groupby(["pass", "label", "size"], sort=False):
            at = rows.index.to_numpy()
            x = _unit(rows["v"])
            for step in range(1, min(window, len(at) - 1) + 1):
                near = np.nonzero((np.einsum("ij,ij->i", x[:-step], x[step:]) >= threshold) & own[at[:-step]])[0]
                out_a.append(ids[at[near]])
                out_b.append(ids[at[near + step]])
        a = np.concatenate(out_a) if out_a else ids[:0]
        b = np.concatenate(out_b) if out_b else ids[:0]
        return pd.DataFrame({"a": a, "b": b})

    return whole.groupBy("part").applyInPandas(compare, f"a {kind}, b {kind}").distinct()


def _within(reps: DataFrame, comp: DataFrame, threshold: float, block: int) -> DataFrame:
    """(rep, n_links): copies of other vectors linked to each vector of a component; every two blocks meet in a task of their own.

    Work grows with the square of a component's size, as its number of links does; pairs are only counted, so
    many rows at a time. Each vector of a component of m goes to m / block tasks.
    """
    kind = reps.schema["rep"].dataType.simpleString()
    sized = comp.groupBy("component").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / block))
    rows = comp.join(sized, "component").join(reps, F.col("id") == F.col("rep"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "copies", "v")

    def count(frame):
        sizes = frame["v"].map(len)
        out = []
        for _, same in frame.groupby(sizes):
            first = same["block"].to_numpy() == frame["i"].iloc[0]
            x, n, ids = _unit(same["v"]), same["copies"].to_numpy(float), same["rep"].to_numpy()
            alone = frame["i"].iloc[0] == frame["j"].iloc[0]
            left, right = (np.arange(len(x)),) * 2 if alone else (np.flatnonzero(first), np.flatnonzero(~first))
            ahead, back = np.zeros(len(left)), np.zeros(len(right))
            for at in range(0, len(left) if len(right) else 0, 256):
                hit = x[left[at : at + 256]] @ x[right].T >= threshold
                if alone:
                    hit[np.arange(len(hit)), at + np.arange(len(hit))] = False
                ahead[at : at + 256] = hit @ n[right]
                back += n[left[at : at + 256]] @ hit
            out.append(pd.DataFrame({"rep": ids[left], "n": ahead.astype(np.int64)}))
            if not alone:
                out.append(pd.DataFrame({"rep": ids[right], "n": back.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "n": []})

    return rows.groupBy("component", "i", "j").applyInPandas(count, f"rep {kind}, n long").groupBy("rep").agg(F.sum("n").alias("n_links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, passes: int = 8, planes: int = 24, window: int = 12, miss: float = 0.005, block: int = 4096, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: (id, n_links, component_id, kept).

    n_links counts other ids linked directly, component_id is the least id reachable, kept says whether
    that is the row's own. Equal vectors of a label link with each other. Rows that are null, zero, hold
    null or non-finite numbers or have no label link with nothing; vectors of different lengths never
    link. Rows that repeat an id and vector are one vector. Null ids have null components. Recall of
    links between groups is kept by effort(): passes and planes are the least that are made, and grow with
    the rows of the largest label. It is measured in the tests.
    """
    with scratch(vectors.sparkSession) as scope:
        member, reps = distinct_vectors(vectors, id_col, vec_col, label_col)
        most = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        passes, planes = effort(most, threshold, passes, planes, window, miss)
        comp = saved(components(_passes(reps, threshold, passes, planes, window, seed), "a", "b"), "components")
        links = saved(_within(reps, comp, threshold, block), "links")
        per = reps.select("rep", "copies").join(comp.withColumnRenamed("id", "rep"), "rep", "left").join(links, "rep", "left")
        per = per.select("rep", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        of_id = scope.keep(saved(member.join(per, "rep").drop("rep").withColumnRenamed("id", "_id"), "linked"))
    out = vectors.select(F.col(id_col)).join(of_id, F.col(id_col) == F.col("_id"), "left")
    component = F.coalesce("component_id", F.col(id_col))
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col(id_col)).alias("kept"))
