"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Voters look at each text: built-in lexicons, lexicons of words and stems mined from a bounded
   sample of labelled rows, and patterns (several hits, density, second-person attack, masked
   insults, shouting, bursts of marks). A voter fires or stays silent.
2. The vote patterns of ALL documents are counted; a latent two-class model with a dependency tree
   over the voters is fitted to the counts by EM. It yields each voter's accuracy and, along the
   tree, the class-conditional correlations, hence a posterior for every pattern.
3. An L1 logistic regression over words, words with masked letters restored, and stems is trained
   on the posteriors of a bounded sample and scores every document, so that forms no voter knows
   are caught through their stems. The sample is of the labelled rows; without any, of all rows.

Defined results: a NULL text scores NULL and is not toxic; an empty text scores as no evidence;
repeated rows are scored alike; with no labels the mined lexicons are empty and the other voters
vote, and a word needs three rows of the sample to count; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from driftglass.llm._common import materialise, released, slices

#: Bound of the sample that lexicons are mined from and the classifier is trained on.
SAMPLE_ROWS = 8000
#: A mined term needs this many toxic rows, this share of them, and this precision.
MIN_ROWS, MIN_SHARE, MIN_PRECISION = 4, 0.02, 0.92
L1, ROUNDS, MIN_Z = 2e-3, 150, 2.5
THRESHOLD = 0.5

MIND = frozenset("idiot idiots idiotic moron morons moronic stupid imbecile dumb dumbass fool retard retarded cretin".split())
WORTH = frozenset("worthless trash garbage scum loser losers pathetic vermin filth useless".split())
CONDUCT = frozenset("clown clowns disgusting disgrace creep pervert bastard bitch asshole shit fuck fucking".split())
BUILT_IN = MIND | WORTH | CONDUCT

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_WORD = re.compile(r"\w+")
_MASKED = re.compile(r"\b[^\W\d_]+[*@$013457]+\w*\b|\b[@$013457]\w+\b")
_PLAIN = str.maketrans({"1": "i", "0": "o", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "*": None})
_ATTACK = re.compile(r"\b(?:you|u|they)\s*(?:are|re|'re)?\s+(?:such\s+)?(?:an?\s+)?(\w+)")
_MASKS = "*@$013457"
VOTERS = ("mind", "worth", "conduct", "mined words", "mined stems a", "mined stems b", "mined stems c", "two hits", "dense hits", "attack", "masked", "shouting", "bursts")
STEMS = (3, 4, 5, 6, 7, 8)


def terms_of(word: str) -> list[str]:
    """The word itself and its stems, marked by a trailing dash."""
    return [word, *(word[:k] + "-" for k in STEMS if len(word) > k)]


def words_of(text: str) -> set[str]:
    """The distinct words of a text, and what masked ones stand for."""
    low = text.lower()
    words = set(_WORD.findall(low))
    if any(c in low for c in _MASKS):
        words.update(w.translate(_PLAIN) for w in _MASKED.findall(low))
    return words


class Votes:
    """Vote masks of texts; bit i is VOTERS[i]."""

    def __init__(self, mined: frozenset[str]):
        self.mined = mined
        self.silent: set[str] = set()

    def word(self, w: str) -> int:
        mask = (w in MIND) | (w in WORTH) << 1 | (w in CONDUCT) << 2 | (w in self.mined and w not in BUILT_IN) << 3
        for k in STEMS:
            if len(w) > k and (t := w[:k] + "-") in self.mined:
                mask |= 16 << (xxh3_64_intdigest(t) % 3)
        return mask

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        low = text.lower()
        words = _WORD.findall(low)
        mask, hits = 0, set()
        for w in set(words) - self.silent:
            if m := self.word(w):
                mask |= m
                hits.add(w)
            else:
                self.silent.add(w)
        if len(self.silent) > 200_000:
            self.silent.clear()
        if hits:
            mask |= (len(hits) > 1) << 7
            mask |= (sum(w in hits for w in words) * 150 > len(words)) << 8
            mask |= any(m in hits for m in _ATTACK.findall(low)) << 9
        if any(c in low for c in _MASKS):
            mask |= any(w.translate(_PLAIN) in BUILT_IN for w in _MASKED.findall(low)) << 10
        caps = len(text) - len(text.encode().translate(None, _CAPITALS)) if text.isascii() else sum(map(str.isupper, text))
        mask |= (caps * 2 > len(text)) << 11
        mask |= (text.count("!!") * 40 > len(words)) << 12
        return mask


class LabelModel:
    """Two latent classes over binary voters joined in a tree, fitted to pattern counts by EM."""

    def __init__(self, masks: np.ndarray, counts: np.ndarray, n: int = len(VOTERS), rounds: int = 40):
        self.n = n
        x = (masks[:, None] >> np.arange(n)) & 1
        total = counts.sum()
        lexical = x[:, :7].sum(1) > 0
        masked = x[:, 10] > 0
        post = np.where(lexical | masked, 0.95, 0.01)
        self.parent = np.full(n, -1)
        for r in range(rounds):
            if r == 5:
                self.parent = self._tree(x, counts, post)
            self.prior = float(np.clip((counts * post).sum() / max(total, 1), 1e-6, 0.6))
            self.tables = np.empty((2, n, 2))  # class, voter, value of the parent -> P(fires)
            for y, p in enumerate((1 - post, post)):
                w = counts * p
                for j in range(n):
                    for v in (0, 1):
                        at = w if self.parent[j] < 0 else w * (x[:, self.parent[j]] == v)
                        self.tables[y, j, v] = ((at * x[:, j]).sum() + 0.1) / (at.sum() + 1.0)
            # lexical voters are anchored: never likelier on clean text than on toxic text
            for j in (*range(7), 10):
                self.tables[1, j] = np.maximum(self.tables[1, j], self.tables[0, j])
            post = self._posterior(x)
        self.accuracy = {}
        for j in range(n):
            right = (counts * np.where(x[:, j], post, 1 - post)).sum()
            self.accuracy[VOTERS[j] if n == len(VOTERS) else j] = float(right / max(total, 1))

    def _tree(self, x: np.ndarray, counts: np.ndarray, post: np.ndarray) -> np.ndarray:
        """Maximum spanning tree by class-conditional mutual information."""
        info = np.zeros((self.n, self.n))
        for p in (1 - post, post):
            w = counts * p
            share = w.sum() / max(counts.sum(), 1)
            w = w / max(w.sum(), 1e-12)
            one = w @ x
            both = (x * w[:, None]).T @ x
            for a in (0, 1):
                for b in (0, 1):
                    pa_, pb = (one if a else 1 - one), (one if b else 1 - one)
                    joint = both if a and b else (one[:, None] - both if a else (one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both))
                    joint = np.clip(joint, 1e-12, 1)
                    info += share * joint * np.log(joint / np.clip(pa_[:, None] * pb[None, :], 1e-12, 1))
        np.fill_diagonal(info, -1)
        self.correlation = info
        parent, reached = np.full(self.n, -1), [0]
        while len(reached) < self.n:
            rest = [j for j in range(self.n) if j not in reached]
            gain, i, j = max((info[i, j], -i, -j) for i in reached for j in rest)
            parent[-j] = -i if gain > 1e-6 else -1
            reached.append(-j)
        return parent

    def _posterior(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), np.log(self.prior) - np.log1p(-self.prior))
        for j in range(self.n):
            v = 0 if self.parent[j] < 0 else x[:, self.parent[j]]
            p = np.clip(self.tables[:, j, :][:, v], 1e-6, 1 - 1e-6) if np.ndim(v) else np.clip(self.tables[:, j, 0], 1e-6, 1 - 1e-6)[:, None]
            score += np.where(x[:, j], np.log(p[1]) - np.log(p[0]), np.log1p(-p[1]) - np.log1p(-p[0]))
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        return self._posterior((masks[:, None] >> np.arange(self.n)) & 1) if len(masks) else np.empty(0)


def train(rows: list[tuple[str, float]]) -> tuple[list[str], np.ndarray, float]:
    """L1 logistic regression (accelerated proximal gradient) on (text, posterior): terms, weights, bias.

    Terms whose rate among likely toxic rows is within MIN_Z deviations of the common rate are left out.
    """
    if not rows:
        return [], np.empty(0), -20.0
    y = np.array([p for _, p in rows])
    # texts as numbers of their words, whose terms are listed once: the terms of all texts are many times as long as these
    index: dict[str, int] = {}
    known: dict[str, int] = {}
    of_word, ends, texts = array("i"), array("q", [0]), []
    for text, _ in rows:
        own = array("i")
        for w in words_of(text):
            if (k := known.get(w)) is None:
                k = known[w] = len(known)
                of_word.extend(index.setdefault(t, len(index)) for t in terms_of(w))
                ends.append(len(of_word))
            own.append(k)
        texts.append(np.array(own))
    del known
    of_word, ends = np.array(of_word, np.int32), np.array(ends)

    def terms_at(own: np.ndarray) -> np.ndarray:
        size = ends[own + 1] - ends[own]
        return of_word[np.repeat(ends[own] - np.cumsum(size) + size, size) + np.arange(size.sum())]

    df, bad = np.zeros(len(index), np.int64), np.zeros(len(index))
    for own, p in zip(texts, y.tolist(), strict=True):
        f = terms_at(own)
        np.add.at(df, f, 1)
        np.add.at(bad, f, p)
    rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    z = np.abs(bad - df * rate) / np.sqrt(np.maximum(df, 1) * rate * (1 - rate))
    chosen = (df >= 3) & (z > MIN_Z)
    if not chosen.any():
        return [], np.empty(0), float(np.log(rate / (1 - rate)))
    terms = [t for t, c in zip(index, chosen, strict=True) if c]
    del index
    flat = [f[chosen[f]] for f in map(terms_at, texts)]
    del texts
    doc = np.repeat(np.arange(len(rows)), [len(f) for f in flat])
    at = (np.cumsum(chosen) - 1)[np.concatenate(flat)]
    n, m = len(rows), len(terms)
    scale = 1 / np.sqrt(np.maximum(np.bincount(at, minlength=m), 1) / n + 0.01)  # rare features count alike
    val = np.minimum(scale[at], 10.0)
    half = np.where(y >= 0.5, 0.5 / max((y >= 0.5).sum(), 1), 0.5 / max((y < 0.5).sum(), 1))
    w, z, bias, zb, t = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0
    # a bound of the curvature by power iteration
    u = np.ones(m)
    for _ in range(8):
        u = np.bincount(at, val * (half * np.bincount(doc, val * u[at], n))[doc], m)
        big = np.linalg.norm(u)
        u /= max(big, 1e-12)
    step = 1 / (0.25 * big * 1.1 + 0.25)
    for _ in range(ROUNDS):
        s = np.bincount(doc, val * z[at], n) + zb
        g = half * (1 / (1 + np.exp(-np.clip(s, -40, 40))) - y)
        nw = z - step * np.bincount(at, val * g[doc], m)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * L1, 0)
        nb = zb - step * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - bias)
        w, bias, t = nw, nb, nt
    s = np.bincount(doc, val * w[at], n)
    # scale and offset are refitted on the sparse score, as the penalty shrinks it
    a, b = 1.0, bias
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -40, 40)))
        r, d = half * (p - y), half * np.maximum(p * (1 - p), 1e-4)
        h = np.array([[(d * s * s).sum() + 1e-3, (d * s).sum()], [(d * s).sum(), d.sum() + 1e-3]])
        move = np.linalg.solve(h, np.array([(r * s).sum() + 1e-3 * (a - 1), r.sum()]))
        a, b = a - 0.5 * move[0], b - 0.5 * move[1]
    used = np.flatnonzero(w)
    return [terms[i] for i in used], (a * w * np.minimum(scale, 10.0))[used], float(b)


class Scorer:
    """Probability of a text from the sparse weights of its distinct words and their stems."""

    def __init__(self, terms: list[str], weights, bias: float):
        self.weights = dict(zip(terms, map(float, weights), strict=True))
        self.bias, self.silent = bias, set()

    def word(self, w: str) -> float:
        get = self.weights.get
        return get(w, 0.0) + sum(get(w[:k] + "-", 0.0) for k in STEMS if len(w) > k)

    def __call__(self, text: str) -> float:
        found = []
        for w in words_of(text) - self.silent:
            if v := self.word(w):
                found.append(v)
            else:
                self.silent.add(w)
        if len(self.silent) > 200_000:
            self.silent.clear()
        s = self.bias + sum(sorted(found))  # sorted: the same sum in every process
        return float(1 / (1 + np.exp(-min(max(s, -40.0), 40.0))))


def mine_lexicon(sample: DataFrame) -> frozenset[str]:
    """Words and stems typical of toxic rows in sample (text, toxic); counted on the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = (Counter(), Counter())
        for b in slices(batches):
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                both[bool(toxic)].update({t for w in set(_WORD.findall((text or "").lower())) for t in terms_of(w)})
        terms = list(both[1])
        yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "bad": pa.array([both[1][t] for t in terms], pa.int64()), "good": pa.array([0] * len(terms), pa.int64())})
        terms = list(both[0])
        yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "bad": pa.array([0] * len(terms), pa.int64()), "good": pa.array([both[0][t] for t in terms], pa.int64())})

    n_bad = sample.where("toxic = 1").count()
    least = max(MIN_ROWS, int(MIN_SHARE * n_bad))
    counted = sample.select("text", "toxic").mapInArrow(released(count), "term string, bad bigint, good bigint").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    best = counted.where(f"bad >= {least} and bad >= {MIN_PRECISION} * (bad + good)")
    return frozenset(r.term for r in best.collect())  # no more than a bounded sample has


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of at most rows labelled documents, chosen by a hash of their ids."""
    ids = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(rows)  # a bounded sample: SAMPLE_ROWS
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text is not null").select("text", "toxic")


def unlabelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text) of at most rows documents, chosen by a hash of their texts."""
    return docs.where("text is not null").select("text").orderBy(F.xxhash64("text", F.lit(7)), "text").limit(rows)  # a bounded sample: SAMPLE_ROWS


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Votes, LabelModel | None, Scorer]:
    sample = materialise(labelled_sample(docs, labels), "toxic-sample")
    votes = Votes(mine_lexicon(sample))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            seen = Counter(map(votes, b.column(0).to_pylist()))
            yield pa.RecordBatch.from_pydict({"mask": pa.array(list(seen), pa.int32()), "n": pa.array(list(seen.values()), pa.int64())})

    patterns = docs.where("text is not null").select("text").mapInArrow(released(vote), "mask int, n bigint").groupBy("mask").agg(F.sum("n").alias("n")).orderBy("mask").collect()
    if not patterns:
        return votes, None, Scorer(*train([]))
    model = LabelModel(np.array([r["mask"] for r in patterns]), np.array([r.n for r in patterns], float))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            post = model.posterior(np.array([votes(t) for t in b.column(0).to_pylist()], np.int64))
            yield pa.RecordBatch.from_pydict({"k": pa.array([0] * b.num_rows, pa.int32()), "text": b.column(0), "p": pa.array(post, pa.float64())})

    def learn(table: pa.Table) -> pa.Table:
        terms, weights, bias = train(sorted(zip(table.column("text").to_pylist(), table.column("p").to_pylist(), strict=True)))
        return pa.table({"terms": pa.array([terms], pa.list_(pa.string())), "weights": pa.array([weights.tolist()], pa.list_(pa.float64())), "bias": pa.array([bias])})

    texts = sample.select("text") if sample.count() else materialise(unlabelled_sample(docs), "toxic-texts")
    got = texts.mapInArrow(released(label), "k int, text string, p double").groupBy("k").applyInArrow(released(learn), "terms array<string>, weights array<double>, bias double").first()
    return votes, model, Scorer(got.terms, got.weights, got.bias)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_toxic, toxic) for every row of docs."""
    _, _, scorer = fit(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = [None if t is None else round(scorer(t), 6) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "p_toxic": pa.array(p, pa.float64()), "toxic": pa.array([x is not None and x >= THRESHOLD for x in p], pa.bool_())})

    return docs.select("doc_id", "text").mapInArrow(released(score), "doc_id bigint, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows judged toxic; the judgement is made row by row, so no join by id is needed."""
    _, _, scorer = fit(docs, labels)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ok = [t is None or round(scorer(t), 6) < THRESHOLD for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(released(keep), docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
