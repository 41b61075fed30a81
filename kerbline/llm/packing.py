"""Best-fit packing of tokenised documents into fixed-length sequences, with swap-based local search.

Lengths are all that packing decides on, and there are at most `size` of them. So the driver packs a
histogram (size counts, however large the corpus): best fit by largest lengths makes patterns with
multiplicities, and local search exchanges items between underfull patterns. Documents are then dealt
into the patterns' places by their rank among the documents of equal length.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import saved, tidy

_RUN = re.compile(r"\s\s")


class Encoder:
    """ids of a text as little-endian unsigned 32-bit bytes.

    Where a file's merges stand in the order of their ids, pairs are merged by tiktoken with the file's
    own vocabulary: the same ids in a fifth of the time. Texts with a special token, and files of another
    kind, go through tokenizers. Each part is loaded when a text first needs it.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(special) or r"(?!)")
        self.ranks = _ranks(spec)

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _pairs(self, tail: str):
        import tiktoken

        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|"
        return tiktoken.Encoding(self.path, pat_str=pattern + tail, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def plain(self):
        """For texts without runs of white space."""
        return self._pairs(r"\s+")

    @cached_property
    def spaced(self):
        return self._pairs(r"\s+(?!\S)|\s+")

    def __call__(self, text: str) -> bytes:
        if self.ranks is None or self.special.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        # runs of white space need the pattern's slow look-ahead; single ones never do
        pairs = self.spaced if _RUN.search(text) else self.plain
        return array("I", pairs.encode_ordinary(text)).tobytes()


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of a byte-level BPE file's tokens if its merges stand in the order of their ids, else None."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not spec.get("normalizer")
    vocab = model.get("vocab", {})
    merges = (m.split(" ") if isinstance(m, str) else m for m in model.get("merges", []))
    if model.get("type") != "BPE" or not plain or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}


def tokenise(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32, ids, chunk, k), stored.

    A document's ids end with end_id; longer ones than size are cut so that only the first piece is
    shorter than size. Null and empty texts are a single end_id. ids are little-endian unsigned 32-bit
    bytes, null unless keep_ids. chunk and k number the pieces of each length within the task that made
    them. The tokenizer's file must lie at the same path on every executor.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    kind = docs.schema[id_col].dataType.simpleString()
    width, end = 4 * size, int(end_id).to_bytes(4, "little")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, seen, chunk = None, Counter(), TaskContext.get().partitionId()
        for frame in frames:
            rows = []
            encode = encode or Encoder(tokenizer_path)  # the task's own: workers live on, and it should not
            for key, text in zip(frame.iloc[:, 0], frame.iloc[:, 1]):
                ids = (encode(text) if text else b"") + end
                first = len(ids) % width or width
                cuts = [0, *range(first, len(ids) + 1, width)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    length = (b - a) // 4
                    part = ids[a:b]
                    rows.append((key, piece, a // 4, length, zlib.crc32(part), part if keep_ids else None, chunk, seen[length]))
                    seen[length] += 1
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", "ids", "chunk", "k"])

    # ids pass Python as text, where a null among whole numbers would make them floats
    out = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    schema = "id string, piece int, start long, length long, ids_crc32 long, ids binary, chunk int, k long"
    made = out.mapInPandas(tidy(work), schema)
    return saved(made.withColumn("id", F.col("id").cast(kind)), "pieces")


def best_fit(counts: dict[int, int], size: int) -> Counter:
    """Patterns (lengths, descending) with multiplicities: each bin takes the largest that still fit."""
    left = {n: c for n, c in counts.items() if c}
    lengths = sorted(left)
    bins: Counter = Counter()
    while lengths:
        pattern, room = Counter(), size
        at = len(lengths) - 1
        while at >= 0:
            n = lengths[at]
            fit = min(room // n, left[n])
            if fit:
                pattern[n] += fit
                room -= fit * n
            at = min(at - 1, bisect_right(lengths, room) - 1)
        times = min(left[n] // c for n, c in pattern.items())
        bins[tuple(sorted(pattern.elements(), reverse=True))] += times
        for n, c in pattern.items():
            left[n] -= c * times
        lengths = [n for n in lengths if left[n]]
    return bins


def _without(pattern: tuple, *items: int) -> list[int]:
    rest = list(pattern)
    for x in items:
        rest.remove(x)
    return rest


def local_search(bins: Counter, size: int) -> Counter:
    """Move, swap one for one or two for one between underfull patterns while the sum of squared fills grows.

    Each exchange gives an item, or a larger item or two for a smaller one, to a bin at least as full as
    the giver; so the sum strictly grows, the search ends, and a bin left without items is gone. A bin is
    settled only when no exchange with any other underfull bin would fill it further.
    """
    bins = Counter(bins)
    under = Counter({p: c for p, c in bins.items() if sum(p) < size})
    for p in under:
        del bins[p]
    moved = True
    while moved:
        moved = False
        emptiest = sorted(under, key=sum)
        one: dict[int, list] = {}  # by what is given: the givers, emptiest first
        two: dict[int, list] = {}
        for q in emptiest:
            kinds = sorted(set(q))
            for i, x in enumerate(kinds):
                one.setdefault(x, []).append((q, x))
                for y in kinds[i:]:
                    if x != y or q.count(x) > 1:
                        two.setdefault(x + y, []).append((q, x, y))
        singles, pairs = sorted(one), sorted(two)
        for p in reversed(emptiest):
            gap = size - sum(p)
            if not under[p] or not gap:
                continue
            best = None
            for y in (0, *sorted(set(p))):
                for names, kind in ((singles, one), (pairs, two) if y else ([], {})):
                    i = bisect_right(names, y + gap) - 1
                    while i >= 0 and names[i] > y and (best is None or names[i] - y > best[0]):
                        giver = next((x for x in kind[names[i]] if under[x[0]] > (x[0] == p)), None)
                        if giver and sum(giver[0]) <= sum(p):
                            best = (names[i] - y, giver[0], giver[1:], y)
                            break
                        i -= 1
            if best is None:
                continue
            _, q, items, y = best
            times = under[p] // 2 if p == q else min(under[p], under[q])
            fuller = tuple(sorted((_without(p, y) if y else list(p)) + list(items), reverse=True))
            emptier = tuple(sorted(_without(q, *items) + ([y] if y else []), reverse=True))
            under[p] -= times
            under[q] -= times
            (bins if sum(fuller) == size else under)[fuller] += times
            if emptier:
                under[emptier] += times
            moved = True
        under = Counter({p: c for p, c in under.items() if c > 0})
    return bins + under


def places(bins: Counter) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, sequence, offset): rank r in [lo, hi) among a length goes to sequence + r - lo, at offset."""
    ranks: Counter = Counter()
    out, sequence = [], 0
    for pattern, times in sorted(bins.items(), reverse=True):
        offset = 0
        for n in pattern:
            out.append((n, ranks[n], ranks[n] + times, sequence, offset))
            ranks[n] += times
            offset += n
        sequence += times
    return out


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """pieces of tokenise() with sequence_id and offset: as few sequences of at most size ids as local search finds.

    Only counts by length reach the driver (size rows at most), and the table of places that is
    broadcast grows with the number of patterns, which follows the number of lengths. Ties, repeated
    rows and null ids are pieces like any others; no pieces give no sequences.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = places(local_search(best_fit(histogram, size), size))
    slots = spark.createDataFrame(slots, "length long, lo long, hi long, sequence long, offset long")
    base = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("chunk", "length", base.alias("base")), ["chunk", "length"]).withColumn("rank", F.col("base") + F.col("k"))
    within = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = ranked.alias("p").join(F.broadcast(slots).alias("s"), (F.col("p.length") == F.col("s.length")) & within)
    return placed.select("p.id", "p.piece", "p.start", "p.length", "p.ids_crc32", "p.ids", (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
