"""Substring dedup: paragraph MinHash banding, exact verification, removals clustered by components.

A paragraph is a line of PASSAGE_WORDS words or more. Lines that collide in a MinHash band are verified by the
exact Jaccard similarity of their five-word shingles, and similar ones form components. Passages need not
fill a line, so runs of PASSAGE_WORDS consecutive words are matched exactly, too, whatever the line breaks in
them. Of every WINDOW runs in a row the one of least hash is indexed (winnowing), so equal passages have
equal indexed runs: any PASSAGE_WORDS + WINDOW - 1 words that two documents share hold one. Of each component of
lines the document of least id keeps its text, and all others lose theirs. Runs are settled on what is left
then: those that touch a lost line neither keep nor lose, and of each other run the document of least id keeps it.
A lost run is carried on to either side, word by word, as far as the keeper's words are the same.

What has fewer than PASSAGE_WORDS words in a row is no passage: licence lines, headings, greetings and other
short lines that unrelated documents share stay in all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kerbline.llm.buckets import crowded, link, may_reach, shared_cores, similar
from kerbline.llm.common import broadcast_if_small, saved, scratch, tidy
from kerbline.llm.shingles import SIZE, mix, shingle_hashes, word_hashes
from kerbline.operators.components import components

#: Bands of ROWS MinHash values each: at a similarity of 0.8 a pair collides with probability 1 - (1 - 0.8^4)^8 = 0.986, at 0.9 with 0.9999.
BANDS, ROWS = 8, 4
PASSAGE_WORDS = 24  # words of a run, and the least of a paragraph
PART_WORDS = 8  # a divisor of PASSAGE_WORDS
WINDOW = 24  # of so many runs in a row one is indexed; at most PASSAGE_WORDS, so that indexed runs leave no gap
_RNG = np.random.default_rng(5)
_MUL = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_BAND = _RNG.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD1B54A32D192ED03)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Texts whose words and shingles are held in memory together: so many at most, and no more once they have so many characters.
TEXTS, CHARS = 200, 1 << 19


def slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over every `width` elements in a row, by doubling."""
    k = 1
    while 2 * k <= width:
        a, k = op(a[:-k], a[k:]), 2 * k
    return op(a[: len(a) - (width - k)], a[width - k :])


class Cut:
    """A text's words, and its lines that hold any by first word and number of words."""

    def __init__(self, text: str):
        lines = text.encode("utf-8", "surrogatepass").lower().split(b"\n")
        self.words = [x for x in map(bytes.split, lines) if x]
        self.line_size = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.line_start = np.cumsum(self.line_size) - self.line_size

    @cached_property
    def h(self) -> np.ndarray:
        """A hash for each word."""
        return word_hashes([w for x in self.words for w in x])

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First words and digests of the indexed runs; the first and the last run of a text always are."""
        if len(self.h) < PASSAGE_WORDS:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        parts = shingle_hashes(self.h, PART_WORDS)  # a run's hash is made of those of its equal parts
        n = len(self.h) - PASSAGE_WORDS + 1
        total = np.full(n, np.uint64(PASSAGE_WORDS))
        for i, factor in enumerate(_MUL[: PASSAGE_WORDS // PART_WORDS]):
            total = total + parts[i * PART_WORDS : i * PART_WORDS + n] * factor
        digests = mix(total)
        chosen = np.zeros(n, bool)
        if n >= WINDOW:
            # a run is some window's least where the greatest least of the windows around it is its own
            least = np.zeros(n + WINDOW - 1, np.uint64)
            least[WINDOW - 1 : n] = slide(digests, WINDOW, np.minimum)
            chosen = slide(least, WINDOW, np.maximum) == digests
        chosen[[0, -1]] = True
        at = np.flatnonzero(chosen)
        return at, digests[at]

    def lines_of_runs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last line that runs with these first words touch."""
        of_word = np.repeat(np.arange(len(self.line_size)), self.line_size)
        return of_word[at], of_word[at + PASSAGE_WORDS - 1]

    @cached_property
    def shingles(self) -> np.ndarray:
        """A hash for every SIZE words of the text, across lines, too."""
        return shingle_hashes(self.h, SIZE)

    def line(self, i: int) -> np.ndarray:
        """Sorted distinct shingles of a line of SIZE words or more."""
        a = self.line_start[i]
        return np.unique(self.shingles[a : a + self.line_size[i] - SIZE + 1])

    def kept(self, lines) -> np.ndarray:
        """Which words lie in none of these lines."""
        out = np.ones(int(self.line_size.sum()), bool)
        for i in lines:
            out[self.line_start[i] : self.line_start[i] + self.line_size[i]] = False
        return out

    def beside(self, at: int, side: int, kept: np.ndarray) -> np.ndarray:
        """Hashes of the words before a run (side 0) or behind it (side 1), up to one that isn't kept; WINDOW - 1 at most."""
        lo, hi = (at + PASSAGE_WORDS, at + PASSAGE_WORDS + WINDOW - 1) if side else (max(0, at - WINDOW + 1), at)
        near, own = self.h[lo:hi].view(np.int64), np.flatnonzero(~kept[lo:hi])
        if not len(own):
            return near
        return near[: own[0]] if side else near[own[-1] + 1 :]

    def paragraphs(self) -> np.ndarray:
        return np.nonzero(self.line_size >= PASSAGE_WORDS)[0]


def bands(shingles: np.ndarray) -> np.ndarray:
    """BANDS bucket keys of a set of shingles."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 4096):
        low = np.minimum(low, mix(shingles[i : i + 4096, None] * _MUL + _ADD).min(axis=0))
    return mix((low.reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _STEP)


def all_bands(sets: list[np.ndarray]) -> np.ndarray:
    """bands() of many sets, one row each; a value at a time over all sets together."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    flat = np.concatenate(sets)
    low = np.stack([np.minimum.reduceat(mix(flat * m + a), starts) for m, a in zip(_MUL, _ADD)], axis=1)
    return mix((low.reshape(-1, BANDS, ROWS) * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _STEP)


def few_texts(frame: pd.DataFrame) -> Iterator[list[tuple]]:
    """Lists of (id, text) of a frame's texts that aren't null or empty, bounded by TEXTS and CHARS; a long text may stand alone."""
    part, chars = [], 0
    for key, text in zip(frame["id"], frame["text"]):
        if text:
            part.append((key, text))
            chars += len(text)
            if len(part) == TEXTS or chars >= CHARS:
                yield part
                part, chars = [], 0
    if part:
        yield part


def parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, idx, n, digest, keys, at, line, more), stored.

    A row of kind r holds a document's indexed runs: digests (keys), first words (at), the first lines that they
    touch (line) and the numbers of further lines (more). A row of kind p is a paragraph: its line (idx), its
    shingles' number (n) and digest, and its band keys.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    columns = ["id", "kind", "idx", "n", "digest", "keys", "at", "line", "more"]

    def rows_of(found):
        for key, cut in found:
            at, digests = cut.runs()
            if len(at):
                first, last = cut.lines_of_runs(at)
                yield key, "r", 0, 0, 0, digests.view(np.int64), at, first, last - first
        lines = [(key, int(p), cut.line(p)) for key, cut in found for p in cut.paragraphs()]
        if lines:
            keys = all_bands([s for *_, s in lines]).view(np.int64)
            for (key, p, s), own in zip(lines, keys):
                yield key, "p", p, len(s), int(mix(np.add.reduce(mix(s), keepdims=True) + np.uint64(len(s))).view(np.int64)[0]), own, None, None, None

    def work(frames):
        for frame in frames:
            for part in few_texts(frame):
                out = list(rows_of([(key, Cut(text)) for key, text in part]))
                if out:
                    yield pd.DataFrame(out, columns=columns)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    ddl = f"id {kind}, kind string, idx int, n int, digest long, keys array<long>, at array<int>, line array<int>, more array<int>"
    return saved(rows.mapInPandas(tidy(work), ddl), "parts")


def _similar_lines(docs: DataFrame, lines: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(digest, component) of paragraphs that others are similar to; a paragraph's digest is that of its shingle set."""
    # equal sets are one node; they need no banding
    nodes = lines.groupBy("digest").agg(F.min(F.struct("id", "idx")).alias("at"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = saved(nodes, "lines")
    rows = nodes.select(F.explode("keys").alias("bucket"), F.col("digest").alias("node"), F.col("n").cast("long").alias("size"), F.lit(0).alias("pos"))
    # who meets the most others in its buckets ranks first: of an original and its edited copies that is the original
    crowds = rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    rows = saved(rows.join(crowds, "bucket"), "crowds")
    met = saved(rows.groupBy("node").agg((-F.sum("m")).cast("double").alias("rank")), "ranks")
    rows = rows.drop("m").join(broadcast_if_small(met), "node")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made: list[DataFrame] = []

    def sets(frames):
        for frame in frames:
            out = []
            for text, want in zip(frame["text"], frame["want"]):
                cut = Cut(text)
                out += [(w["digest"], cut.line(w["idx"]).view(np.int64)) for w in want]
            yield pd.DataFrame(out, columns=["digest", "s"])

    def sets_of(digests: DataFrame) -> DataFrame:
        """(digest, s); each set is made once, and stored."""
        digests = digests.distinct()
        for known in made:
            digests = digests.join(known.select("digest"), "digest", "left_anti")
        place = F.struct(F.col("at.idx").alias("idx"), "digest")
        want = saved(nodes.join(digests, "digest").groupBy(F.col("at.id").alias("id")).agg(F.collect_list(place).alias("want")), "wanted")
        if not made or not want.isEmpty():
            own = texts.join(broadcast_if_small(want.select("id")), "id", "left_semi").join(want, "id")
            made.append(saved(own.mapInPandas(tidy(sets), "digest long, s array<long>").dropDuplicates(["digest"]), "sets"))
        out = made[0]
        for more in made[1:]:
            out = out.unionByName(more)
        return out

    def verify(pairs: DataFrame) -> DataFrame:
        return similar(pairs, sets_of(pairs.select(F.col("a").alias("digest")).union(pairs.select("b"))), "digest", percent)

    def cores(open_: DataFrame) -> DataFrame:
        return shared_cores(sets_of(open_.select(F.col("node").alias("digest"))).withColumnRenamed("digest", "id"), open_)

    return components(link(crowded(rows), may_reach(percent), verify, cores, once=True), "a", "b").withColumnRenamed("id", "digest")


def _lost_lines(docs: DataFrame, own: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, idx) of the paragraphs that go: all of a component but those of its least id; stored."""
    lines = own.where("kind = 'p'").select("id", "idx", "n", "digest", "keys")
    comp = _similar_lines(docs, lines, percent, id_col, text_col)
    named = lines.select("id", "idx", "digest").join(comp, "digest", "left").withColumn("of", F.coalesce("component", "digest"))
    first = named.groupBy("of").agg(F.min("id").alias("keeper"), F.max("id").alias("last")).where("keeper < last")
    first = saved(first.select("of", "keeper"), "keepers")  # stored, so that Spark may split a hot key's rows in the join
    return saved(named.join(broadcast_if_small(first), "of").where("id <> keeper").select("id", "idx"), "gone")


def _lost_runs(own: DataFrame, gone: DataFrame) -> DataFrame:
    """(id, idx, keeper, at) of the runs that go, by first word, and where their keeper has them; stored."""
    runs = own.where("kind = 'r'").select("id", F.inline(F.arrays_zip("at", "keys", "line", "more")).alias("idx", "digest", "line", "n"))
    shared = runs.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("last")).where("least < last")
    shared = saved(shared.select("digest"), "digests")  # as are the keepers below
    runs = saved(runs.join(broadcast_if_small(shared), "digest", "left_semi"), "shared")
    touched = runs.select("id", F.col("idx").alias("at"), F.explode(F.expr("sequence(line, line + n)")).alias("idx"))
    cut = touched.join(gone, ["id", "idx"], "left_semi").select("id", F.col("at").alias("idx")).distinct()
    runs = saved(runs.join(cut, ["id", "idx"], "left_anti").select("id", "idx", "digest"), "left")
    keepers = runs.groupBy("digest").agg(F.min(F.struct("id", "idx")).alias("k"), F.max("id").alias("last")).where("k.id < last")
    keepers = saved(keepers.select("digest", "k"), "keepers")
    lost = runs.join(broadcast_if_small(keepers), "digest").where("id <> k.id")
    return saved(lost.select("id", "idx", F.col("k.id").alias("keeper"), F.col("k.idx").alias("at")).distinct(), "lost")


def _edges(docs: DataFrame, lost: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, at, side, h): for the first and last run of each stretch that a document loses, the keeper's words beside it.

    side 0: at is the first word of the stretch's first run, h the words before; side 1: the last run's, and the
    words behind. Words of lines that the keeper loses end h. WINDOW - 1 words are all that winnowing can leave.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    by = W.partitionBy("id").orderBy("idx")
    opens = F.coalesce(F.col("idx") - F.lag("idx").over(by) > PASSAGE_WORDS, F.lit(True))
    closes = F.coalesce(F.lead("idx").over(by) - F.col("idx") > PASSAGE_WORDS, F.lit(True))
    rows = lost.select("id", "keeper", "idx", (F.col("idx") - F.col("at")).alias("shift"), opens.alias("opens"), closes.alias("closes"))
    sides = F.concat(F.when(F.col("opens"), F.array(F.lit(0))).otherwise(F.array()), F.when(F.col("closes"), F.array(F.lit(1))).otherwise(F.array()))
    rows = saved(rows.where("opens OR closes").select("id", "keeper", "shift", F.col("idx").alias("at"), F.explode(sides).alias("side")), "ends")
    places = rows.select("keeper", F.struct((F.col("at") - F.col("shift")).alias("at"), "side").alias("x")).distinct()
    want = places.groupBy(F.col("keeper").alias("id")).agg(F.collect_list("x").alias("want"))
    want = want.join(gone.groupBy("id").agg(F.collect_set("idx").alias("gone")), "id", "left")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropDuplicates(["id"])

    def work(frames):
        for frame in frames:
            out = []
            for key, text, places, gone in zip(frame["id"], frame["text"], frame["want"], frame["gone"]):
                cut = Cut(text)
                kept = cut.kept([] if gone is None else gone)
                for x in places:
                    out.append((key, x["at"], x["side"], cut.beside(x["at"], x["side"], kept)))
            yield pd.DataFrame(out, columns=["keeper", "k", "side", "h"])

    want = saved(want, "wanted")
    own = texts.join(broadcast_if_small(want.select("id")), "id", "left_semi").join(want, "id")
    beside = saved(own.mapInPandas(tidy(work), f"keeper {kind}, k int, side int, h array<long>").where("size(h) > 0"), "beside")
    beside = broadcast_if_small(beside, beside.count() * WINDOW)
    rows = rows.withColumn("k", F.col("at") - F.col("shift"))
    return rows.join(beside, ["keeper", "k", "side"]).select("id", "at", "side", "h")


def removals(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs array<int>, lines array<int>, edges array<struct<at, side, h>>) of the documents that lose text, stored.

    First words of runs, numbers of lines, and what _edges() gives.
    """
    with scratch(docs.sparkSession) as scope:
        own = parts(docs, id_col, text_col)
        gone = _lost_lines(docs, own, percent, id_col, text_col)
        lost = _lost_runs(own, gone)
        edges = _edges(docs, lost, gone, id_col, text_col)
        rows = lost.select("id", F.col("idx").alias("run")).distinct()
        rows = rows.unionByName(gone.select("id", F.col("idx").alias("line")), allowMissingColumns=True)
        rows = rows.unionByName(edges.select("id", F.struct("at", "side", "h").alias("edge")), allowMissingColumns=True)
        each = rows.groupBy("id").agg(F.collect_set("run").alias("runs"), F.collect_set("line").alias("lines"), F.collect_list("edge").alias("edges"))
        return scope.keep(saved(each, "removals"))


def spans_to_remove(text: str, runs, lines, edges=()) -> list[tuple[int, int]]:
    """[start, end) character spans of lines and of runs of PASSAGE_WORDS words, carried on by edges and joined where they meet."""
    cut = Cut(text)
    gone = ~cut.kept(lines)
    for a in runs:
        gone[a : a + PASSAGE_WORDS] = True
    own = cut.h.view(np.int64)
    for e in edges:
        if e["side"]:
            a = e["at"] + PASSAGE_WORDS
            mine, theirs = own[a : a + len(e["h"])], np.asarray(e["h"])
            same = _leading(mine, theirs[: len(mine)])
            gone[a : a + same] = True
        else:
            a = e["at"]
            mine, theirs = own[max(0, a - len(e["h"])) : a][::-1], np.asarray(e["h"])[::-1]
            same = _leading(mine, theirs[: len(mine)])
            gone[a - same : a] = True
    if not gone.any():
        return []
    where = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    return [(where[a][0], where[b - 1][1]) for a, b in zip(edges[::2], edges[1::2])]


def _leading(x: np.ndarray, y: np.ndarray) -> int:
    """How many first elements of two arrays of one length are equal."""
    differs = np.flatnonzero(x != y)
    return int(differs[0]) if len(differs) else len(x)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; white space behind a cut goes with it unless that joins two lines' words."""
    out, last = [], 0
    for a, b in spans:
        before = text[last:a]
        out.append(before)
        gap = re.compile(r"\s*").match(text, b)
        starts_line = not before.strip(" \t") and (not out[:-1] or "".join(out).endswith("\n") or not "".join(out)) or before.endswith("\n")
        last = gap.end() if starts_line or "\n" not in gap.group() else b
    out.append(text[last:])
    return "".join(out)


def dedup(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages cut from the text, and removed_spans array<struct<start, end>> of the old text.

    All columns and rows stay; texts without a repeated passage stay as they are to the letter. Of texts
    that are whole copies, of PASSAGE_WORDS words at least, all but that of least id become empty. Repeats
    within one id are not removed, so rows that repeat an id keep their text alike. Null ids, null and empty
    texts are left alone. A column named removed_spans would be replaced.
    """
    docs = docs.drop("removed_spans")
    lost = removals(docs, percent, id_col, text_col)
    spans = "array<struct<start:int,end:int>>"
    mark = "_lost"
    while any(c.startswith(mark) for c in docs.columns):
        mark = "_" + mark
    lost = lost.select(F.col("id").alias(f"{mark}_id"), F.struct("runs", "lines", "edges").alias(mark))
    ids = broadcast_if_small(lost.select(f"{mark}_id"))
    match = F.col(id_col) == F.col(f"{mark}_id")
    rest = docs.join(ids, match, "left_anti").withColumn("removed_spans", F.array().cast(spans))

    @F.pandas_udf(f"text string, spans {spans}")
    def cut(text: pd.Series, what: pd.DataFrame) -> pd.DataFrame:
        texts, cuts = [], []
        for old, runs, lines, edges in zip(text, what["runs"], what["lines"], what["edges"]):
            found = spans_to_remove(old, runs, lines, edges) if old else []
            texts.append(without(old, found) if found else old)
            cuts.append([{"start": a, "end": z} for a, z in found])
        return pd.DataFrame({"text": texts, "spans": cuts})

    # only the text passes through Python; all other columns stay as they are
    hit = docs.join(ids, match, "left_semi").join(lost, match).withColumn(mark, cut(F.col(text_col), F.col(mark)))
    columns = [F.col(f"{mark}.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return rest.unionByName(hit.select(*columns, F.col(f"{mark}.spans").alias("removed_spans")))
