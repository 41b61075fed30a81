"""Exact n-gram Jaccard join of documents by grouped prefixes.

A set's prefix is its p + e shingles of least hash, where p = n - ceil(t n) + 1: two sets of Jaccard t or more
share at least 1 + e shingles of their prefixes. So e shingles of each may be dropped, and those in the most
documents are: the rarest common shingle always stays. Shingles that no other prefix holds need no posting
list either; a document whose p kept shingles are all of that kind is done. Documents with identical
prefixes and size form a group; only groups enter the posting lists, and pairs of groups are filtered by size and
by the places of their common shingle. What is left is expanded to the groups' members, which are verified on the
whole sets. Texts are read once for sizes, digests and prefixes, and candidates once more for their sets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.buckets import crowded, link, may_reach, shared_cores, similar
from kerbline.llm.common import broadcast_if_small, saved, scratch, tidy
from kerbline.llm.shingles import SIZE, shingle_set
from kerbline.operators.components import components

#: e as a share, in percent, of the least overlap ceil(t n). It grows more slowly than that overlap, so of two sets of
#: different sizes the larger one's 1 + e is shared, too.
EXTRA = 15
#: A shingle that so many of a 1/32 sample of the groups hold goes the way of long posting lists; no result depends on it.
HOT_IN_SAMPLE = 40


def _prefix(s: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """p and the prefix of a sorted set."""
    least = -(-percent * len(s) // 100)
    p = len(s) - least + 1
    return p, s[: p + EXTRA * least // 100 + 2]


def signatures(docs: DataFrame, percent: int = 80, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, digest, grp, p, prefix) per row with an id, stored: set size and digest, prefix group, p, the prefix.

    Empty sets have n = 0 and no digest. A task stores each group's prefix once, with the first of its rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    columns = ["id", "n", "digest", "grp", "p", "prefix"]

    def work(frames):
        sent: set[int] = set()
        for frame in frames:
            rows = []
            for key, text in zip(frame["id"], frame["text"]):
                s = shingle_set(text, size)
                if not len(s):
                    rows.append((key, 0, None, 0, 0, None))  # a None would turn a column of numbers into floats
                    continue
                p, prefix = _prefix(s, percent)
                grp = xxhash.xxh3_64_intdigest(prefix.tobytes(), len(s)) - 2**63
                rows.append((key, len(s), xxhash.xxh3_128_digest(s.tobytes()), grp, p, None if grp in sent else prefix.view(np.int64).copy()))
                sent.add(grp)
            yield pd.DataFrame(rows, columns=columns)

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return saved(rows.mapInPandas(tidy(work), f"id {kind}, n long, digest binary, grp long, p long, prefix array<long>"), "signatures")


def _postings(marks: DataFrame, groups: DataFrame) -> DataFrame:
    """(bucket, node, size, rank, pos): the posting lists that groups (grp, id, n, p) need; node is a group's least id.

    pos is the shingle's place in the set. rank is the share of prefix shingles that no other group holds: of
    an original and its edited copies the original ranks first.
    """
    tokens = marks.where("prefix IS NOT NULL").select("grp", F.posexplode("prefix").alias("pos", "token"))
    sample = tokens.where(F.pmod("grp", F.lit(32)) == 0).groupBy("token").agg(F.count_distinct("grp").alias("k"))
    # a long list's frequency is the sample's, scaled: any number will do that is the same for all rows of a shingle
    hot = saved(sample.where(F.col("k") >= HOT_IN_SAMPLE).select("token", (F.col("k") * 32).alias("df")), "hot")
    flagged = tokens.join(broadcast_if_small(hot), "token", "left")
    # short lists: one shuffle by token for both the count and the rows; long ones are dealt by token and group
    cool = flagged.where("df IS NULL").select("token", "grp", "pos").repartition("token").dropDuplicates(["token", "grp"])
    cool = cool.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1")
    if not hot.isEmpty():
        cool = cool.unionByName(flagged.where("df IS NOT NULL").select("token", "grp", "pos", "df").distinct())
    each = saved(cool, "shared").groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("df", "token", "pos"))).alias("have"))
    length = F.col("p") + F.floor((F.col("n") - F.col("p") + 1) * EXTRA / 100) + 2  # of _prefix()
    need = groups.join(each, "grp").withColumn("m", F.least(length, F.col("n"))).withColumn("alone", F.col("m") - F.size("have"))
    need = need.withColumn("need", F.col("p") - F.col("alone")).where("need > 0")
    kept = F.explode(F.slice("have", F.lit(1), F.least(F.col("need"), F.size("have")).cast("int"))).alias("x")
    rows = need.select(F.col("id").alias("node"), F.col("n").alias("size"), (F.col("alone") / F.col("m")).alias("rank"), kept)
    return rows.select(F.col("x.token").alias("bucket"), "node", "size", "rank", "x.pos")


def _sets(docs: DataFrame, size: int, id_col: str, text_col: str) -> Callable[[DataFrame], DataFrame]:
    """A function that returns (id, s), whole sets as arrays, for ids (id); each set is made once, and stored."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made: list[DataFrame] = []

    def work(frames):
        for frame in frames:
            for i in range(0, len(frame), 200):
                part = frame.iloc[i : i + 200]
                yield pd.DataFrame({"id": part["id"], "s": [shingle_set(t, size).view(np.int64) for t in part["text"]]})

    def of(ids: DataFrame) -> DataFrame:
        ids = ids.select("id").distinct()
        for known in made:
            ids = ids.join(known.select("id"), "id", "left_anti")
        ids = saved(ids, "ids")
        if not made or not ids.isEmpty():
            new = texts.join(broadcast_if_small(ids), "id", "left_semi").mapInPandas(tidy(work), f"id {kind}, s array<long>")
            made.append(saved(new.dropDuplicates(["id"]), "sets"))
        out = made[0]
        for more in made[1:]:
            out = out.unionByName(more)
        return out

    return of


def _links(docs: DataFrame, marks: DataFrame, nodes: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b) links that connect whatever similar nodes there are."""
    groups = saved(nodes.groupBy("grp", "n", "p").agg(F.min("node").alias("id"), F.count("*").alias("members")), "groups")
    leads = groups.where("members > 1").select("grp", "n", F.col("id").alias("lead"))
    members = saved(nodes.join(leads, ["grp", "n"]).select("lead", "node", F.col("n").alias("size")), "members")
    sets = _sets(docs, size, id_col, text_col)

    def verify(pairs: DataFrame) -> DataFrame:
        return similar(pairs, sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b"))), "id", percent)

    def cores(open_: DataFrame) -> DataFrame:
        return shared_cores(sets(open_.select(F.col("node").alias("id"))), open_)

    return link(crowded(_postings(marks, groups)), may_reach(percent), verify, cores, None if members.isEmpty() else members)


def jaccard_join(docs: DataFrame, percent: int = 80, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) per row: set size and the least id that links reach, the row's own included.

    Texts link when 100 * shared >= percent * all of their distinct shingles of `size` words. Documents with
    equal sets are one node, so copies cost nothing beyond the first. Null and empty texts have an empty set
    and link with nothing. Rows that repeat an id count once as a node (their texts should be equal). Rows
    with a null id have their set size and a null component. Extra columns are ignored.
    """
    with scratch(docs.sparkSession) as scope:
        marks = signatures(docs, percent, size, id_col, text_col)
        nodes = marks.where("n > 0").groupBy("digest").agg(F.min(F.struct("id", "n", "grp", "p")).alias("x"))
        nodes = saved(nodes.select("digest", F.col("x.id").alias("node"), "x.n", "x.grp", "x.p"), "nodes")
        comp = components(_links(docs, marks, nodes, percent, size, id_col, text_col), "a", "b").withColumnRenamed("id", "node")
        comp = nodes.join(comp, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
        kept = scope.keep(saved(marks.select("id", "n", "digest").join(comp, "digest", "left").select("id", "n", "component"), "components"))
    out = kept.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.unionByName(_nameless(docs.where(F.col(id_col).isNull()), out, size, id_col, text_col))


def _nameless(rows: DataFrame, like: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Rows without an id: only their set size is known."""

    def work(frames):
        for frame in frames:
            yield pd.DataFrame({"n_shingles": [len(shingle_set(t, size)) for t in frame["text"]]})

    n = rows.select(F.col(text_col).alias("text")).mapInPandas(tidy(work), "n_shingles long")
    null = F.lit(None).cast(like.schema[id_col].dataType)
    return n.select(null.alias(id_col), "n_shingles", null.alias("component_id"))
