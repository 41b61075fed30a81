"""Benchmark decontamination by a distributed positional inverted index.

The index holds one row per occurrence (term, doc, pos) and is written to shared storage. A phrase is
found by reading the postings of its rarest term, moving them to the phrase's start, and intersecting
with the moved postings of its next rarest terms. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kerbline.llm.common import BROADCAST_ROWS, broadcast_if_small, saved, scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: runs of 0-9, a-z and non-ASCII after lower-casing A-Z; null has none."""
    cut = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAPS)
    return F.filter(cut, lambda w: w != "")


def build_index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (doc, pos, term), one row per occurrence, stored; pos counts words from 0. Repeated rows repeat their postings.

    terms (term): if given, only their postings are stored (a term filter pushed into the build). It
    is broadcast while its row count allows, shuffled beyond. Texts that are null or without words
    have no postings, nor have rows with a null id.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(words(F.col(text_col))).alias("pos", "term"))
    if terms is not None:
        rows = rows.join(broadcast_if_small(terms.select("term").distinct()), "term", "left_semi")
    return saved(rows.select("term", "doc", "pos"), "postings")


def _windows(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(item, start, terms): every window of size words; an item with fewer is one window."""
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return rows.select("item", "w", F.explode(starts).alias("start")).select("item", "start", F.slice("w", F.col("start") + 1, F.lit(size)).alias("terms"))


def phrases(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, doc, at): each place where a phrase occurs exactly; wanted: (key, terms).

    Terms are ranked by their number of postings, rarest first. The two rarest lists are intersected
    first; what is left is intersected with the lists of all other terms at once.
    """
    terms = wanted.select("key", F.size("terms").alias("n"), F.posexplode("terms").alias("off", "term"))
    counts = index.groupBy("term").agg(F.count("*").alias("df"))
    ranked = terms.join(counts, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    by_key = W.partitionBy("key")
    ranked = ranked.withColumn("least", F.min("df").over(by_key)).where("least > 0")  # a missing term: no match
    ranked = saved(ranked.withColumn("rank", F.row_number().over(by_key.orderBy("df", "off"))).select("key", "n", "off", "term", "rank"), "terms")
    size = ranked.count()

    def lists(rank: int) -> DataFrame:
        part = ranked.where(F.col("rank") == rank).select("key", "n", "off", "term")
        part = F.broadcast(part) if size <= BROADCAST_ROWS else part
        return index.join(part, "term").select("key", "n", "doc", (F.col("pos") - F.col("off")).alias("at"))

    found = lists(1)
    second = lists(2).select("key", "doc", "at")
    two = found.where("n > 1").join(second, ["key", "doc", "at"], "left_semi")
    found = saved(found.where("n = 1").unionByName(two).distinct(), "candidates")  # rows that repeat a document have equal postings
    done = found.where("n <= 2").select("key", "doc", "at")
    more = found.where("n > 2")
    rest = ranked.where("rank > 2").select("key", "off", "term")
    rest = F.broadcast(rest) if size <= BROADCAST_ROWS else rest
    needed = more.join(rest, "key").select("key", "n", "doc", "at", "term", (F.col("at") + F.col("off")).alias("pos"))
    docs = broadcast_if_small(more.select("doc").distinct())
    have = index.join(docs, "doc", "left_semi")
    hits = needed.join(have, ["doc", "pos", "term"]).groupBy("key", "doc", "at").agg(F.count_distinct("pos").alias("k"), F.first("n").alias("n"))
    return done.unionByName(hits.where("k = n - 2").select("key", "doc", "at"))


def near(index: DataFrame, wanted: DataFrame, within: int) -> DataFrame:
    """(key, doc): documents where all terms of a phrase lie, in any order, within a span of so many words.

    Rarest first: each posting of the rarest term opens a span on either side; the other terms' postings
    in it are taken by word blocks, and a span counts if a stretch of within words holds every term.
    """
    terms = wanted.select("key", F.explode(F.array_distinct("terms")).alias("term"))
    counts = index.groupBy("term").agg(F.count("*").alias("df"))
    ranked = terms.join(counts, "term").withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy("df", "term")))
    needs = terms.groupBy("key").agg(F.count("*").alias("n"))
    ranked = saved(ranked.join(needs, "key").select("key", "n", "term", "rank"), "terms")
    start = index.join(ranked.where("rank = 1").select("key", "n", "term"), "term").select("key", "n", "doc", F.col("pos").alias("at"))
    spans = start.select("*", F.explode(F.sequence(F.greatest(F.col("at") - within + 1, F.lit(0)), F.col("at"))).alias("from"))
    blocks = spans.withColumn("block", F.explode(F.array_distinct(F.array(F.floor(F.col("from") / within), F.floor((F.col("from") + within - 1) / within)))))
    others = index.join(ranked.select("key", "term"), "term").select("key", "doc", "pos", "term", F.floor(F.col("pos") / within).alias("block"))
    both = blocks.join(others, ["key", "doc", "block"]).where((F.col("pos") >= F.col("from")) & (F.col("pos") < F.col("from") + within))
    full = both.groupBy("key", "doc", "from", "n").agg(F.count_distinct("term").alias("k")).where("k = n")
    return full.select("key", "doc").distinct()


def _per_document(places: DataFrame, owners: DataFrame) -> DataFrame:
    """(_doc, n_hit, item_ids) of documents with places (key, doc, at, n); owners: (key, item)."""
    spans = places.groupBy("doc", "at").agg(F.max("n").alias("n"))  # one span for each start: overlaps are cut below
    over = W.partitionBy("doc").orderBy("at")
    before = F.coalesce(F.max(F.col("at") + F.col("n")).over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cover = spans.select("doc", F.greatest(F.lit(0), F.col("at") + F.col("n") - F.greatest("at", before)).alias("c")).groupBy("doc").agg(F.sum("c").alias("n_hit"))
    of_doc = places.select("doc", "key").distinct().join(owners, "key").select("doc", "item").distinct().groupBy("doc")
    of_doc = of_doc.agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("item_ids"))
    return cover.join(of_doc, "doc").withColumnRenamed("doc", "_doc")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per document: (id, n_words, n_hit, n_items, item_ids, contaminated); and the occurrences (item, doc, at, n).

    A window is size consecutive words of an item, or a shorter item as a whole; every word inside an
    occurrence is hit. Null and empty texts have no words and are clean. Rows that repeat an id are one
    document each in n_words, but share their hits; null ids are clean. Extra columns are ignored. No
    benchmark rows: every document is clean.
    """
    with scratch(docs.sparkSession, native=False) as scope:  # no Python in this operator
        # words hold no space, so a window's joined words stand for it; 128 bits keep all windows apart
        key = F.unhex(F.md5(F.array_join("terms", " ").cast("binary")))
        windows = _windows(items, size, item_col, item_text).select(key.alias("key"), "item", "terms").dropDuplicates(["key", "item"])
        windows = saved(windows, "windows")
        wanted = saved(windows.select("key", "terms").dropDuplicates(["key"]), "phrases")
        index = build_index(docs, wanted.select(F.explode("terms").alias("term")), id_col, text_col)
        places = phrases(index, wanted).join(broadcast_if_small(wanted.select("key", F.size("terms").alias("n"))), "key")
        places = scope.keep(saved(places, "places"))
        owners = broadcast_if_small(scope.keep(saved(windows.select("key", "item"), "owners")))
        per = scope.keep(saved(_per_document(places, owners), "hits"))
    rows = docs.select(F.col(id_col).alias(id_col), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    out = rows.join(per, F.col(id_col) == F.col("_doc"), "left").select(
        id_col, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
    return out, places.join(owners, "key").select("item", "doc", "at", "n")
