"""Toxicity scores from gradient-boosted trees over dense features of a text.

Features are densities of two lexicons (a fixed one of common insults, and terms that the labelled texts
show to be toxic), second-person pronouns near lexicon words, capitals, punctuation, and
disguised spellings.  Trees of logistic loss are grown on histograms of the features; their scores are made
probabilities by isotonic regression on labelled rows that no tree has seen.

A learned term is a word or the first letters of one.  It counts once per group of near copies, so that
a text that was copied a thousand times lends its words no weight, and its weight is the lower end of a
confidence interval of its log odds.  A row that the trees learn from is measured as if it had not been
counted.

The model is fitted on at most ``MOST_ROWS`` labelled rows of each label, those with the smallest hashes
of their id; rows stand for all rows of their label by weight.  Every text is scored whole.

Handling: null or empty text has all features zero and is scored like any other; a text repeated, or an
id repeated, scores alike; null ids and null labels are not learned from; an id labelled twice has its
highest label, a repeated id is learned from once, with its smallest text; without rows of both labels every score is 0, as nothing is known against any document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import store
from evalspark.llm.quality import isotonic
from evalspark.llm.tokens import slabs
from evalspark.llm.words import runs, words_of

# Bounds of the model, whatever the size of the corpus.
MOST_ROWS, MOST_TERMS = 32_768, 8_192
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 80, 3, 0.15, 32, 8.0, 1.0
PREFIXES, NEAR = (4, 6), 8  # letters of a term that is no whole word; words between a pronoun and an insult

# Insults, and pronouns that address someone, of the four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers trash scum pathetic worthless disgusting clown fool fools jerk imbecile "
    "dumbass bastard scumbag filth vermin ugly freak hate idiotisch dumm dummkopf trottel abschaum wertlos widerlich ekelhaft "
    "imbécile stupide crétin ordure minable débile estúpido imbécil basura escoria asqueroso patético inútil".split()
)
PRONOUNS = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti usted ustedes vosotros".split())
PLAIN = str.maketrans("013457@$!", "oieastasi")

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_REPEAT = re.compile(r"([^\W\d])\1\1")
_MARKS = re.compile(r"[!?]{2,}")

NAMES = (
    "insults", "insults_log", "near_pronoun", "pronouns", "weight_most", "weight_second", "weight_sum", "weight_mean",
    "strong_log", "strong_share", "some_log", "some_share", "prefix_most", "prefix_log", "disguised_log", "disguised_share",
    "symbol_share", "spelled", "stretched", "capitals", "upper", "exclaims", "questions", "mark_runs", "marks", "words_log", "word_length",
)


def word_of(token: str) -> str:
    """The lower-case word of a run of characters between white space, without the marks around it; marks within stay."""
    return token.lower() if token.isalpha() else _EDGE.sub("", token.lower())


def plain(word: str) -> str:
    """The word without disguise: digits and signs that stand for letters, and marks within, undone."""
    return re.sub(r"[^\w]|_", "", word.translate(PLAIN))


def terms_of(word: str) -> list[str]:
    """The terms a word stands for: itself, then its first letters with a star."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def sketches(texts: list[str]) -> np.ndarray:
    """The least hash of three words in a row of each text, which near copies mostly share."""
    words = words_of(pa.array(texts, pa.string()))
    hashes, out = words.hashes(), np.zeros(len(texts), np.uint64)
    rows = runs(hashes, 3)
    for k, (a, b) in enumerate(zip(words.first, words.first[1:], strict=False)):
        if b > a:
            out[k] = rows[a : b - 2].min() if b - a > 2 else hashes[a:b].sum()
    return out.view(np.int64)


@dataclass
class Lexicon:
    """Terms with the groups of toxic and clean texts that hold them, and the number of such groups."""

    counts: dict[str, tuple[int, int]] = field(default_factory=dict)
    groups: tuple[int, int] = (0, 0)

    def weights(self, without: int | None = None) -> dict[str, float]:
        """The lower end of the log odds of each term, as if one text of label ``without`` had not been counted."""
        out = {}
        for term, (bad, good) in self.counts.items():
            bad, good = bad - (without == 1), good - (without == 0)
            if bad > 0 and (odds := lower_odds(bad, good, *self.groups)) > 0:
                out[term] = odds
        return out


def lower_odds(bad: int, good: int, bad_groups: int, good_groups: int) -> float:
    """Log odds that a term's text is toxic against any text's, less 1.5 standard errors."""
    p, q = max(bad, 0) + 0.5, max(good, 0) + 0.5
    return math.log(p / (bad_groups + 1)) - math.log(q / (good_groups + 1)) - 1.5 * math.sqrt(1 / p + 1 / q)


_TOKEN_COLUMNS = (
    "words", "letters", "insults", "pronouns", "weight", "some", "strong", "strong_prefix", "disguised", "symbols",
    "stretched", "shouted", "upper", "exclaims", "questions", "mark_runs", "chars", "best", "prefix", "hit", "single",
)
_ADDED = _TOKEN_COLUMNS.index("best")  # columns before are added up


class _Tokens(dict):
    """Numbers of tokens; what is known of a new one is appended to ``rows``, as ``_TOKEN_COLUMNS``."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights, self.rows = weights, []

    def _firsts(self, word: str) -> float:
        return max([self.weights.get(t, 0.0) for t in terms_of(word)[1:]], default=0.0)

    def __missing__(self, token: str) -> int:
        word = word_of(token)
        n, size = len(word), len(token)
        own, first = (self.weights.get(word, 0.0), self._firsts(word)) if n else (0.0, 0.0)
        best, insult, disguised, odd = max(own, first), word in INSULTS, False, False
        upper = 0 if token.islower() else sum(map(str.isupper, token))
        if n and not word.isalpha() and not word.isdigit():
            odd, bare = True, plain(word)
            disguised = bare in INSULTS or (bare != word and self.weights.get(bare, 0.0) > 2)
        exclaims = questions = mark_runs = 0
        if n != size and ("!" in token or "?" in token):
            exclaims, questions, mark_runs = token.count("!"), token.count("?"), len(_MARKS.findall(token))
        shouted = upper > 2 and upper == sum(map(str.isalpha, token))
        self.rows.append((
            n > 0, n, insult, word in PRONOUNS, own if best > 0.5 else 0, best > 0.5, best > 2, best > 2 and first > 2, disguised, odd,
            _REPEAT.search(word) is not None, shouted, upper, exclaims, questions, mark_runs,
            size, best, first, insult or disguised or best > 2, n == 1 and word.isalpha(),
        ))
        self[token] = number = len(self)
        return number


class Measure:
    """Features of texts; remembers what it knows of a token, within a bound.

    ``without`` is the label of the texts, if they were counted in the lexicon.
    """

    def __init__(self, lexicon: Lexicon, without: int | None = None, most: int = 400_000):
        self.weights, self.most = lexicon.weights(without), most
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.table = _Tokens(self.weights), np.zeros((0, len(_TOKEN_COLUMNS)), np.float32)

    def of(self, texts: list[str]) -> np.ndarray:
        """One row of features for each text."""
        if len(self.numbers) > self.most:
            self._forget()
        tokens, sizes = [], []
        for text in texts:
            own = text.split()
            tokens += own
            sizes.append(len(own))
        at = np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens))
        if new := self.numbers.rows:
            self.table = np.concatenate([self.table, np.array(new, np.float32)])
            self.numbers.rows = []
        sizes = np.array(sizes, np.int64)
        full = np.flatnonzero(sizes)
        out = np.zeros((len(texts), len(NAMES)))
        if not len(full):
            return out
        starts = (np.cumsum(sizes) - sizes)[full]
        owner = np.repeat(np.arange(len(texts)), sizes)
        total = {c: np.add.reduceat(self.table[at, k].astype(float), starts) for k, c in enumerate(_TOKEN_COLUMNS[:_ADDED])}
        best, prefix, hit, single = (self.table[at, k] for k in range(_ADDED, len(_TOKEN_COLUMNS)))
        top = np.maximum.reduceat(best, starts)
        whose = np.repeat(np.arange(len(full)), sizes[full])
        tops = np.flatnonzero(best == top[whose])
        _, firsts = np.unique(whose[tops], return_index=True)
        rest = best.copy()
        rest[tops[firsts]] = 0
        second = np.maximum.reduceat(rest, starts)

        near = np.zeros(len(texts))
        hits, spoken = np.flatnonzero(hit), np.flatnonzero(self.table[at, _TOKEN_COLUMNS.index("pronouns")])
        if len(hits) and len(spoken):
            right = np.searchsorted(spoken, hits)
            close = np.zeros(len(hits), bool)
            for side in (np.maximum(right - 1, 0), np.minimum(right, len(spoken) - 1)):
                close |= (np.abs(spoken[side] - hits) <= NEAR) & (owner[spoken[side]] == owner[hits])
            near = np.bincount(owner[hits[close]], minlength=len(texts)).astype(float)
        three = np.flatnonzero((single[2:] > 0) & (single[1:-1] > 0) & (single[:-2] > 0) & (owner[2:] == owner[:-2]))
        spelled = np.bincount(owner[three], minlength=len(texts))[full]

        n, length = np.maximum(total["words"], 1), total["chars"]
        out[full] = np.stack([
            total["insults"] / n, np.log1p(total["insults"]), near[full], total["pronouns"] / n, top, second,
            np.log1p(total["weight"]), total["weight"] / n, np.log1p(total["strong"]), total["strong"] / n,
            np.log1p(total["some"]), total["some"] / n, np.maximum.reduceat(prefix, starts), np.log1p(total["strong_prefix"]),
            np.log1p(total["disguised"]), total["disguised"] / n, total["symbols"] / n, spelled, total["stretched"] / n,
            total["shouted"] / n, total["upper"] / length, total["exclaims"] / n, total["questions"] / n, total["mark_runs"],
            (length - total["letters"]) / length, np.log1p(total["words"]), total["letters"] / n,
        ], axis=1)
        return out


def held_out(doc_id: str = "doc_id"):
    """Rows kept from all learning: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _known(df: DataFrame, labels: DataFrame, label: str, text: str, doc_id: str) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, label of the rows to learn from, and how many labelled ids of each label there are."""
    rows = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where("doc_id is not null and label is not null").where(~held_out("doc_id"))
    rows = rows.groupBy("doc_id").agg((F.max("label") > 0).cast("int").alias("label"))
    total = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    some = [rows.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_ROWS) for y in (0, 1)]
    chosen = store.written(some[0].unionByName(some[1]), "learned")
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # At most 2 * MOST_ROWS ids, so the texts need not be shuffled.
    known = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return store.written(known, "known"), total


def learn_terms(known: DataFrame) -> Lexicon:
    """The strongest terms of the labelled texts, near copies counted once a term."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slabs(batch.column(0)):
                found = pa.array(sketches(texts), pa.int64())
                rest = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([found, *rest.columns], ["sketch", "text", "label"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            counts = np.array(list(total.values()), np.int64)
            return pa.RecordBatch.from_pydict({"term": pa.array(list(total), pa.string()), "bad": counts[:, 0], "good": counts[:, 1]})

        total: dict[str, list[int]] = {}
        for batch in batches:
            for first, texts in slabs(batch.column(0)):
                labels = batch.column(1).slice(first, len(texts)).to_pylist()
                for text, label in zip(texts, labels, strict=True):
                    for term in {t for w in set(map(word_of, set(text.split()))) if w for t in terms_of(w)}:
                        if term in total:
                            total[term][1 - label] += 1
                        else:
                            total[term] = [label, 1 - label]
            if len(total) > 500_000:
                yield rows()
                total = {}
        if total:
            yield rows()

    groups = known.select("text", "label").mapInArrow(seen, "sketch long, text string, label int")
    groups = groups.groupBy("sketch", "label").agg(F.min("text").alias("text"))
    groups = store.written(groups.select("text", "label"), "groups")
    sizes = {r["label"]: r["n"] for r in groups.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sizes.get(1, 0), sizes.get(0, 0)
    terms = groups.mapInArrow(counted, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    strength = F.log((F.col("bad") + 0.5) / (n[0] + 1)) - F.log((F.col("good") + 0.5) / (n[1] + 1))
    strength -= 1.5 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = terms.where("bad > 1").withColumn("strength", strength).where("strength > 0.5")
    rows = best.orderBy(F.desc("strength"), "term").limit(MOST_TERMS).collect()
    return Lexicon({r["term"]: (r["bad"], r["good"]) for r in rows}, n)


@dataclass
class Tree:
    """A full binary tree: at node k feature[k] > cut[k] leads to 2k + 2, else to 2k + 1; values of the last level."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def apply(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(DEPTH):
            at = 2 * at + 1 + (bins[rows, self.feature[at]] > self.cut[at])
        return self.value[at - (2**DEPTH - 1)]


def grow(bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> Tree:
    """One tree by the gain of second order, from histograms of each level."""
    inner, n_features = 2**DEPTH - 1, bins.shape[1]
    tree = Tree(np.zeros(inner, np.int64), np.full(inner, BINS, np.int64), np.zeros(inner + 1))
    at = np.zeros(len(bins), np.int64)
    for level in range(DEPTH):
        first, nodes = 2**level - 1, 2**level
        place = ((at - first)[:, None] * n_features + np.arange(n_features)) * BINS + bins
        shape = nodes, n_features, BINS
        size = int(np.prod(shape))
        g, h = (np.bincount(place.ravel(), np.repeat(x, n_features), size).reshape(shape).cumsum(axis=2) for x in (gradient, hessian))
        g_all, h_all = g[:, :, -1:], h[:, :, -1:]
        gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
        gain[(h < 0.25 * LEAST) | (h_all - h < 0.25 * LEAST)] = 0  # about LEAST rows of even odds
        flat = gain.reshape(nodes, -1)
        best = flat.argmax(axis=1)
        splits = flat[np.arange(nodes), best] > 1e-9
        tree.feature[first : first + nodes] = np.where(splits, best // BINS, 0)
        tree.cut[first : first + nodes] = np.where(splits, best % BINS, BINS)
        at = 2 * at + 1 + (bins[np.arange(len(bins)), tree.feature[at]] > tree.cut[at])
    leaf = at - inner
    g, h = (np.bincount(leaf, x, inner + 1) for x in (gradient, hessian))
    tree.value = -RATE * g / (h + RIDGE)
    return tree


@dataclass
class Model:
    lexicon: Lexicon = field(default_factory=Lexicon)
    edges: list[np.ndarray] = field(default_factory=list)  # of the bins of each feature
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    raw: np.ndarray = field(default_factory=lambda: np.zeros(0))  # calibrated scores at raw ones
    score: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x, "left") for e, x in zip(self.edges, rows.T, strict=True)], axis=1)

    def raw_scores(self, rows: np.ndarray) -> np.ndarray:
        bins = self.bins(rows)
        return self.start + sum((t.apply(bins) for t in self.trees), np.zeros(len(rows)))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(self.raw_scores(rows), self.raw, self.score) if len(self.raw) else np.zeros(len(rows))


def boosted(rows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Model:
    """Trees for the log odds of the label."""
    edges = [np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], method="nearest")) for x in rows.T]
    # Rare features, zero almost everywhere, get their edges from the rest.
    for k, x in enumerate(rows.T):
        if len(edges[k]) < BINS // 2 and len(rest := x[x > x.min()]):
            more = np.quantile(rest, np.linspace(0, 1, BINS // 2)[:-1], method="nearest")
            edges[k] = np.unique(np.concatenate([edges[k], [x.min()], more]))[: BINS - 1]
    share = np.clip((weight * label).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    model = Model(edges=edges, start=float(np.log(share / (1 - share))))
    bins, raw = model.bins(rows), np.full(len(rows), model.start)
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-raw))
        tree = grow(bins, weight * (chance - label), weight * np.maximum(chance * (1 - chance), 1e-6))
        model.trees.append(tree)
        raw += tree.apply(bins)
    return model


def calibrated(model: Model, rows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Model:
    """The share of toxic rows, rising with the raw score."""
    raw, place = np.unique(model.raw_scores(rows), return_inverse=True)
    bad, total = (np.bincount(place, x, len(raw)) for x in (weight * label, weight))
    model.raw, model.score = raw, np.clip(isotonic(bad, total), 0, 1)
    return model


def fit(df: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id") -> Model:
    """Learns terms and trees from four fifths of the labelled rows that are not held out, and calibrates on the rest."""
    known, total = _known(df, labels, label, text, doc_id)
    part = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit("+"))) % 5
    learned = known.where(part != 4)
    lexicon = learn_terms(learned.select("text", "label"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {without: Measure(lexicon, without) for without in (0, 1, None)}
        for batch in batches:
            for first, texts in slabs(batch.column(0)):
                rest = batch.slice(first, len(texts))
                side = np.array([y if learns else -1 for y, learns in zip(*(c.to_pylist() for c in rest.columns[1:]), strict=True)])
                rows = np.zeros((len(texts), len(NAMES)))
                for without, measure in of.items():
                    own = np.flatnonzero(side == (-1 if without is None else without))
                    rows[own] = measure.of([texts[k] for k in own])
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64())), *rest.columns[1:]], ["row", "label", "learns"])

    rows = known.select("text", "label", (part != 4).alias("learns")).mapInArrow(measured, "row array<double>, label int, learns boolean")
    rows = rows.toArrow()  # numbers of at most 2 * MOST_ROWS ids
    matrix = np.array(rows.column(0).to_pylist(), float).reshape(-1, len(NAMES))
    y, learns = np.asarray(rows.column(1), float), np.asarray(rows.column(2), bool)
    order = np.lexsort((learns, y, *matrix.T))  # the same sums in every run
    matrix, y, learns = matrix[order], y[order], learns[order]
    if not (0 < y[learns].sum() < learns.sum()):
        return Model(lexicon)
    here = Counter(y.tolist())
    weight = np.where(y > 0, total[1] / here[1.0], total[0] / here[0.0])
    weight *= len(y) / weight.sum()
    model = boosted(matrix[learns], y[learns], weight[learns])
    model.lexicon = lexicon
    seen = ~learns if 0 < y[~learns].sum() < (~learns).sum() else learns
    return calibrated(model, matrix[seen], y[seen], weight[seen])


def score(df: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most MOST_TERMS terms and TREES trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(shared.value.lexicon)
        for batch in batches:
            for first, texts in slabs(batch.column(1)):
                scores = pa.array(shared.value.scores(measure.of(texts)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), scores], ["doc_id", "score"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id long, score double")


def classify(df: DataFrame, labels: DataFrame, threshold: float = 0.5, label: str = "toxic", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``threshold`` on) of every row of ``df``."""
    found = score(df, fit(df, labels, label, text, doc_id), text, doc_id)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
