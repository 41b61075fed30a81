"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Voters are a fixed lexicon, patterns of spelling and layout in both polarities, and words and word beginnings
that the labelled training rows show to go with toxic texts. A two-class generative model is fitted to the
voters' hits by expectation maximisation; correlated voters are discounted. A logistic classifier over the hits
and over statistics of the text that no voter looks at is trained on the posterior labels and scores every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import held_out, saved, scratch, tidy

# Voters that need no training rows.
LEXICON = (
    "idiot", "moron", "stupid", "loser", "pathetic", "worthless", "scum", "trash", "clown", "disgusting", "imbecile", "dumbass", "bastard", "asshole",
    "bitch", "scumbag", "retard", "vermin", "subhuman", "shut up", "kill yourself", "hate you", "salaud", "connard", "abruti", "ordure", "arschloch",
    "dummkopf", "abschaum", "idiota", "imbécil", "estúpido", "basura", "hijo de puta",
)
PATTERNS = {
    "insult": re.compile(r"you(?:'re|r| are)? (?:just |nothing but )?(?:a |an |such an? )?(?:" + "|".join(w for w in LEXICON if w.isascii() and " " not in w) + r")\b"),
    "threat": re.compile(r"(?:kill|hurt|beat|find) you\b"),
    "marks": re.compile(r"[!?]{3,}"),
    "disguised": re.compile(r"(?<=[a-z])[*@$0134]+(?=[a-z])"),
}
PHRASES = {  # patterns that are no more than words
    "polite": ("please", "thank you", "thanks", "merci", "danke", "bitte", "gracias", "por favor"),
    "notice": ("licensed under", "licenced under", "all rights reserved", "terms of use", "copyright"),
}
CLEAN = ("polite", "notice")  # patterns that vote for the clean class
_PLAIN = str.maketrans("@$0134", "asoiea")
_WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = range(3, 9)  # letters
STATISTICS = ("log_words", "capitals", "digits", "marks", "distinct")


@dataclass
class Model:
    """voters: (kind, text), kind w for a whole word or phrase, p for a word's beginning, q for one that two different words share, x for a pattern; weights, bias of the classifier."""

    voters: list[tuple[str, str]]
    accuracy: list[tuple[float, float]]
    correlated: list[float]
    weights: list[float]
    statistics: list[tuple[float, float, float]]  # mean, scale and weight of each of STATISTICS
    bias: float


class Hits:
    """Which voters a text fires: an Aho-Corasick pass over the whole lower-cased text, and the patterns."""

    def __init__(self, voters: list[tuple[str, str]]):
        import ahocorasick

        self.find, by_text = ahocorasick.Automaton(), defaultdict(list)
        for i, (kind, text) in enumerate(voters):
            for phrase in PHRASES.get(text, ()) if kind == "x" else (text,):
                by_text[phrase].append((i, kind))
        for text, own in by_text.items():
            self.find.add_word(text, (len(text), own))
        if by_text:
            self.find.make_automaton()
        self.any = bool(by_text)
        self.patterns = [(i, text) for i, (kind, text) in enumerate(voters) if kind == "x" and text in PATTERNS]

    def __call__(self, text: str | None) -> set[int]:
        out: set[int] = set()
        if not text:
            return out
        low = text.lower()
        words = defaultdict(set)
        for end, (n, own) in self.find.iter(low) if self.any else ():
            start = end - n + 1
            if start and low[start - 1].isalpha():
                continue
            inside = end + 1 < len(low) and low[end + 1].isalpha()
            for i, kind in own:
                if kind == "q":
                    if len(words[i]) < 2:
                        words[i].add(_WORD.match(low, start).group())
                elif kind == "p" or not inside:
                    out.add(i)
        out.update(i for i, seen in words.items() if len(seen) > 1)
        out.update(i for i, name in self.patterns if _fires(name, low))
        return out


def _fires(name: str, low: str) -> bool:
    if name != "disguised":
        return PATTERNS[name].search(low) is not None
    for m in PATTERNS[name].finditer(low):  # the word around the marks
        a, b = m.span()
        while a and (low[a - 1].isalpha() or low[a - 1] in "*@$0134"):
            a -= 1
        while b < len(low) and (low[b].isalpha() or low[b] in "*@$0134"):
            b += 1
        if b - a < 24 and low[a:b].translate(_PLAIN) in LEXICON:
            return True
    return False


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text, from its characters alone; all 0 for null and empty texts."""
    if not text:
        return [0.0] * len(STATISTICS)
    words = text.split()
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=128)
    size = counts.sum()
    capitals, digits, marks = counts[65:91].sum() / size, counts[48:58].sum() / size, (counts[33] + counts[63]) / size
    return [math.log1p(len(words)), capitals, digits, marks, len(set(words)) / max(1, len(words))]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of at most `most` labelled ids that aren't held out, those of least hash; nulls and other labels are left out.

    Of rows that repeat an id the largest text and label count.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(known), "id")  # the side is bounded by `most`
    return rows.groupBy("id").agg(F.max("text").alias("text"), F.max("y").alias("y"))  # a row an id, however often it stands there


def features(text: str) -> set[str]:
    """A text's candidate voters: w and a word of 3 to 24 letters, p and a beginning, q and one that two different words have."""
    words = set(_WORD.findall(text.lower()))
    out = {"w" + w for w in words if 3 <= len(w) <= 24}
    seen = Counter(w[:n] for w in words for n in BEGINNINGS if len(w) >= n)
    out.update("p" + k for k in seen)
    out.update("q" + k for k, c in seen.items() if c > 1)
    return out


def _log_tail(hits: int, n: int, p: float) -> float:
    """Log of the chance of so many hits or more among n at rate p, by its largest term times its ratio's sum."""
    term = math.lgamma(n + 1) - math.lgamma(hits + 1) - math.lgamma(n - hits + 1) + hits * math.log(p) + (n - hits) * math.log1p(-p)
    ratio = (n - hits) / (hits + 1) * p / (1 - p)
    return term - math.log1p(-min(ratio, 0.99))


def _mine(rows: DataFrame, base: float, least: int, precision: float, chance: float, most: int) -> list[tuple[str, str]]:
    """Voters among the features of toxic rows: those in `least` of them, of that precision, and hardly there by chance.

    Only features of `least` toxic training rows reach the driver, so their number is bounded by the sample's size.
    """

    def count(y: int, wanted: set[str] | None):
        def work(frames):
            seen: Counter = Counter()
            for frame in frames:
                for text in frame["text"][frame["y"] == y]:
                    found = features(text)
                    seen.update(found if wanted is None else found & wanted)
            keys, n = list(seen), list(seen.values())
            for i in range(0, len(keys), 20_000):
                yield pd.DataFrame({"key": keys[i : i + 20_000], "n": n[i : i + 20_000]})

        counts = rows.mapInPandas(tidy(work), "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
        return {r["key"]: r["n"] for r in (counts.where(F.col("n") >= least) if wanted is None else counts).collect()}

    bad = count(1, None)
    good = count(0, set(bad))
    marked = []
    for key, n in bad.items():
        false = good.get(key, 0)
        if n >= precision * (n + false) and _log_tail(n, n + false, base) < math.log(chance):
            marked.append((3 * false - n, len(key), key))
    chosen: list[tuple[str, str]] = []
    spoken: set[str] = set()
    for _, _, key in sorted(marked):  # a beginning that votes speaks for all longer ones and words that have it
        kind, text = key[0], key[1:]
        if len(chosen) < most and not any(text[:n] in spoken for n in range(1, len(text) + (kind != "p"))):
            chosen.append((kind, text))
            if kind == "p":
                spoken.add(text)
    return chosen


def label_model(votes: np.ndarray, prior: float, clean: np.ndarray | None = None, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 per row, hit rates in class 1 and 0, and a discount per voter for its correlations.

    votes: rows x voters, 1 for a vote and 0 for an abstention; clean marks the voters for class 0. Starts
    from rows with any vote for class 1; rates are smoothed towards a voter that is forty times likelier in
    class 1 (for class 0: twice likelier there). A voter's log ratio counts 1 / (1 + sum of its correlations
    over 0.3 with others, within classes), and a row's votes for class 1 together as much as its strongest at
    least. Rows without a vote for class 1 share one ratio.
    """
    n, m = votes.shape
    clean = np.zeros(m, bool) if clean is None else clean
    some = votes[:, ~clean].any(axis=1)
    posterior = np.where(some, 0.95, 0.02) if n else np.zeros(0)
    discount = np.ones(m)
    logit = np.log(prior / (1 - prior))
    for _ in range(rounds):
        s1, s0 = posterior.sum(), n - posterior.sum()
        one = (votes.T @ posterior + np.where(clean, 0.1, 0.2)) / (s1 + 4)
        zero = (votes.T @ (1 - posterior) + np.where(clean, 0.2, 0.005)) / (s0 + 4)
        if n and m:
            spread = np.outer(posterior, one - zero)  # made in place, since it is as large as all votes
            spread += zero
            np.subtract(votes, spread, out=spread)
            scale = np.sqrt(np.einsum("ij,ij->j", spread, spread)) + 1e-9
            close = np.abs(spread.T @ spread) / np.outer(scale, scale)
            np.fill_diagonal(close, 0)
            discount = 1 / (1 + np.where(close > 0.3, close, 0).sum(axis=1))
        ratio = np.where(clean, np.minimum(np.log(one / zero), 0), np.log(one / zero))
        none = np.log(((posterior * ~some).sum() + 0.2) / (s1 + 2)) - np.log((((1 - posterior) * ~some).sum() + 1) / (s0 + 2))
        up = np.where(clean, 0, ratio)
        voted = np.maximum(votes @ (discount * up), (votes * up).max(axis=1, initial=0))
        against = votes @ (discount * np.where(clean, ratio, 0))
        after = 1 / (1 + np.exp(-np.clip(logit + np.where(some, voted, none) + against, -30, 30)))
        done = np.abs(after - posterior).max(initial=0) < 1e-6
        posterior = after
        if done:
            break
    return posterior, one, zero, discount


def linear(x: np.ndarray, target: np.ndarray, start: np.ndarray, pull: np.ndarray, bias: float, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels by Newton steps; weights are drawn to `start` with the strength `pull`."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w0, pull = np.append(start, bias), np.append(pull, 0.05)
    w = w0.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + pull * (w - w0)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 12_000, voters: int = 300, precision: float = 0.9, chance: float = 1e-6,
    id_col: str = "doc_id", text_col: str = "text",
) -> Model:
    """Fit on at most `most` labelled documents that aren't held out (a bounded sample; see training_rows()).

    What reaches the driver is bounded too: features of toxic training rows, `voters` mined voters and the
    hits of `most` rows. Mined voters have this precision among training rows, and a chance below `chance` to be
    in so many toxic ones. Without labelled rows the lexicon and the patterns vote, with smoothed rates.
    """
    with scratch(docs.sparkSession):
        rows = saved(training_rows(docs, labels, label, most, id_col, text_col), "training")
        return _fit(rows, voters, precision, chance)


def _fit(rows: DataFrame, voters: int, precision: float, chance: float) -> Model:
    total, bad = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = (bad + 1) / (total + 10)
    mined = _mine(rows, prior, 4, precision, chance, voters) if bad else []
    names = list(dict.fromkeys([*(("w", w) for w in LEXICON), *(("x", p) for p in (*PATTERNS, *PHRASES)), *mined]))
    clean = np.array([kind == "x" and text in CLEAN for kind, text in names])

    def vote(frames):
        hits = Hits(names)
        for frame in frames:
            yield pd.DataFrame({"hits": [sorted(hits(t)) for t in frame["text"]], "x": [statistics(t) for t in frame["text"]]})

    fired = rows.mapInPandas(tidy(vote), "hits array<int>, x array<double>").collect()
    votes, x = np.zeros((total, len(names))), np.zeros((total, len(STATISTICS)))
    for i, r in enumerate(fired):
        votes[i, list(r["hits"])] = 1
        x[i] = r["x"]
    posterior, one, zero, discount = label_model(votes, prior, clean)
    start = discount * np.where(clean, np.minimum(np.log(one / zero), 0), np.log(one / zero))
    seldom = np.where(clean, start, np.maximum(start, 4.0))
    start = np.where(votes.any(axis=0), start, seldom) if total else np.where(clean, -0.5, 5.0)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if total else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    both = np.hstack([votes, np.clip((x - mean) / scale, -4, 4)])
    pull = np.append(np.full(len(names), 0.5), np.full(x.shape[1], 20.0))
    weights, bias = linear(both, posterior, np.append(start, np.zeros(x.shape[1])), pull, float(np.log(prior / (1 - prior))) - 1)
    stats = list(zip(mean.tolist(), scale.tolist(), weights[len(names) :].tolist()))
    return Model(names, list(zip(one.tolist(), zero.tolist())), discount.tolist(), weights[: len(names)].tolist(), stats, bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: (id, held_out, score, predicted, fired). Null and empty texts score as texts without words.

    Rows are scored on their whole text alone, so repeated rows and ids score alike; null ids stay and
    are not held out; extra columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names, weights, bias = model.voters, np.array(model.weights), model.bias
    mean, scale, pull = np.array(model.statistics).T

    def work(frames):
        hits = Hits(names)
        for frame in frames:
            found = [sorted(hits(t)) for t in frame["text"]]
            own = np.array([statistics(t) for t in frame["text"]]).reshape(-1, len(STATISTICS))
            margin = bias + np.array([weights[f].sum() for f in found]) + np.clip((own - mean) / scale, -4, 4) @ pull
            value = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pd.DataFrame({"id": frame["id"], "score": value, "fired": [[names[i][1] for i in f] for f in found]})

    # ids pass Python as text, where a null among whole numbers would make them floats
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(tidy(work), "id string, score double, fired array<string>").withColumn(id_col, F.col("id").cast(kind))
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "fired")
