"""Toxicity by weak supervision.

Many voters (lexicons, patterns, and words and stems mined from a bounded
sample of labelled rows) judge each text or abstain.  A generative label model
estimates every voter's accuracy and the correlations of voters given the class
by expectation maximisation, correlated voters counting less; its posteriors are
the soft labels of a linear classifier over words and stems, which scores texts.
Labels of the sample have no vote: they choose the mined words, and where the
classifier's scores are cut.
"""

from __future__ import annotations

import re
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import balanced

#: Labelled rows that training takes at most (about): the documented bound of the sample.
SAMPLE_ROWS = 12_000
#: Bytes of text that the sample takes at most (about); longer texts mean fewer rows.
SAMPLE_BYTES = 96 << 20
#: Features of the linear classifier.
FEATURES = 6_000
STEMS = (4, 5, 6)
WORDS = re.compile(r"[^\W\d_]+")
#: Insults and degrading words, by kind.  Fixed values.
LEXICONS = {
    "stupidity": "idiot idiots idiotic moron morons moronic stupid dumb imbecile cretin fool dimwit halfwit brainless",
    "worth": "worthless pathetic loser losers useless failure scum trash garbage vermin filth filthy",
    "disgust": "disgusting revolting repulsive vile nasty gross sickening ugly",
    "ridicule": "clown clowns joke laughable ridiculous freak creep weirdo",
    "profanity": "damn crap hell shit bullshit fuck fucking bastard bitch asshole",
    "german": "idiot dumm trottel abschaum arschloch wertlos ekelhaft versager depp",
    "french": "idiot imbécile crétin nul ordure salaud minable dégoûtant connard",
    "spanish": "idiota imbécil estúpido basura asqueroso patético perdedor cabrón",
}
#: Patterns of address and threat.  Fixed values.
PATTERNS = (
    r"\byou(?:'re| are) (?:an? |so |such an? )?(?:\w+ )?(?:idiot|moron|loser|fool|clown|stupid|pathetic|worthless|scum|trash|disgusting)",
    r"\b(?:shut up|get lost|go away and die|drop dead|kill yourself|i hate you|hate you all)\b",
    r"\b(?:such|what) an? (?:idiot|moron|loser|clown|joke)\b",
)


def features_of(text: str | None) -> set[str]:
    """Distinct words, and their first letters as stems ``lowei~``."""
    words = set(WORDS.findall((text or "").lower()))
    out = set(words)
    for n in STEMS:
        out.update([w[:n] + "~" for w in words if len(w) >= n])
    return out


class Voters:
    """Votes 1 (toxic), 0 (not) or -1 (abstains) of every voter on a text."""

    def __init__(self, mined: list[tuple[str, float]]):
        self.lexicons = [frozenset(v.split()) for v in LEXICONS.values()]
        self.patterns = [re.compile(p, re.I) for p in PATTERNS]
        order = sorted(mined, key=lambda x: (-x[1], x[0]))
        self.mined = [frozenset(f for f, _ in order[k::6]) for k in range(6)] if order else []
        self.every = frozenset().union(*self.lexicons, *self.mined)

    def __call__(self, text: str | None, own: set[str]) -> list[int]:
        votes = [1 if own & x else -1 for x in self.lexicons]
        votes += [1 if own & x else (0 if k % 2 else -1) for k, x in enumerate(self.mined)]
        low = (text or "").lower()
        votes += [1 if p.search(low) else -1 for p in self.patterns]
        hits = len(own & self.every)
        votes.append(0 if hits == 0 else -1)
        votes.append(1 if hits >= 3 else (0 if hits == 0 else -1))
        return votes


class Sample:
    """Features of the training texts as numbers: one pair (row, feature) for each distinct feature of a text."""

    def __init__(self, texts: list[str | None]):
        vocabulary: dict[str, int] = {}
        rows, cols = [], []
        for i, t in enumerate(texts):
            own = [vocabulary.setdefault(x, len(vocabulary)) for x in sorted(features_of(t))]
            cols.append(np.array(own, np.int32))
            rows.append(np.full(len(own), i, np.int32))
        self.n = len(texts)
        self.names = np.array([*vocabulary, ""], dtype=object)[:-1]
        self.per_row = cols
        self.r = np.concatenate([*rows, np.zeros(0, np.int32)])
        self.c = np.concatenate([*cols, np.zeros(0, np.int32)])

    def counts(self, weights: np.ndarray | None = None) -> np.ndarray:
        """In how many texts, or in what weight of texts, each feature occurs."""
        return np.bincount(self.c, weights=None if weights is None else weights[self.r], minlength=len(self.names)).astype(float)


def mine(sample: Sample, toxic: np.ndarray, least: int = 4) -> list[tuple[str, float]]:
    """Words and stems that occur in toxic texts nearly alone, with their weight."""
    pos, every = sample.counts(toxic.astype(float)), sample.counts()
    pure = pos / np.maximum(every, 1)
    worth = pos / (every + 1) * np.log1p(pos)
    found = np.nonzero((pos >= least) & (pure >= 0.95))[0]
    return sorted(((sample.names[i], float(worth[i])) for i in found), key=lambda x: (-x[1], x[0]))[:600]


def label_model(votes: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors, per-voter tables P(vote | class) and voter correlations given the class.

    Classes start from the votes' majority.  A voter's log likelihood is divided
    by one plus its summed positive correlations with the others, so that copies
    of one voter count about as one.
    """
    n, m = votes.shape
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    said = (votes == 1).sum(1) - (votes == 0).sum(1)
    post = np.where(said > 0, 0.9, 0.1 * prior)
    table, corr = np.zeros((2, m, 3)), np.eye(m)
    for _ in range(rounds):
        weight = np.stack([1 - post, post])
        table = np.einsum("cn,nmv->cmv", weight, hot) + 0.5
        table /= table.sum(2, keepdims=True)
        resid = sum(w[:, None] * (votes - (table[c] @ np.array([-1.0, 0.0, 1.0]))) for c, w in enumerate(weight))
        sd = np.sqrt((resid**2).mean(0)) + 1e-9
        corr = (resid.T @ resid) / n / np.outer(sd, sd)
        worth = 1 / (1 + np.maximum(corr - np.eye(m), 0).sum(1))
        gain = np.einsum("nmv,mv->nm", hot, np.log(table[1]) - np.log(table[0])) @ worth
        post = 1 / (1 + np.exp(-np.clip(gain + np.log(prior / (1 - prior)), -30, 30)))
    return post, table, corr


def fit_linear(sample: Sample, soft: np.ndarray, k: int = FEATURES, rounds: int = 400) -> tuple[dict[str, float], float]:
    """Logistic regression on the soft labels, by gradient descent with momentum.

    Features are the at most k whose deviation from independence of the class is
    beyond 3.5 standard deviations: words that both classes use carry no weight.
    """
    base = float(np.clip(soft.mean(), 0.01, 0.99))
    every, mass = sample.counts(), sample.counts(soft)
    z2 = (mass - base * every) ** 2 / (every * base * (1 - base) + 1.0)
    found = np.nonzero((every >= 3) & (z2 >= 12))[0]
    found = found[np.argsort(-z2[found], kind="stable")][:k]
    at = np.full(len(sample.names), -1)
    at[found] = np.arange(len(found))
    own = at[sample.c] >= 0
    r, c = sample.r[own], at[sample.c[own]]
    m = len(found)
    w, b = np.zeros(m), float(np.log(base / (1 - base)))
    vw, vb = np.zeros(m), 0.0
    step = 1.0 / np.maximum(every[found], 1) ** 0.5
    for _ in range(rounds):
        z = np.bincount(r, weights=w[c], minlength=sample.n) + b
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft
        gw = np.bincount(c, weights=e[r], minlength=m) + 0.02 * w
        vw = 0.8 * vw - 0.05 * step * gw
        vb = 0.8 * vb - 0.2 * e.mean()
        w, b = w + vw, b + vb
    return {x: float(v) for x, v in zip(sample.names[found], w) if abs(v) > 1e-3}, float(b)


def fitting_cut(z: np.ndarray, toxic: np.ndarray) -> float:
    """The cut of the scores with the fewest wrong rows, nearest to 0 of several; 0 where all rows are alike."""
    if toxic.all() or not toxic.any():
        return 0.0
    order = np.argsort(z, kind="stable")
    z, y = z[order], toxic[order]
    wrong = (~y).sum() + np.concatenate([[0], np.cumsum(np.where(y, 1, -1))])  # with the first k below the cut
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    split = np.concatenate([[True], z[1:] > z[:-1], [True]])
    wrong, cuts = wrong[split], cuts[split]
    best = cuts[wrong == wrong.min()]
    return float(best[np.argmin(np.abs(best))])


def held_out(doc_id) -> Column:
    """Whether a row's label is never learnt from."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """Texts and labels of about ``rows`` labelled rows and ``size`` bytes at most, chosen by a hash of their doc_id.

    A doc_id with several labels is toxic if one says so.  Raises if there are labelled texts and none is chosen.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    share = min(1.0, rows / max(1, known.count()))
    chosen = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)  # 63 bits
    below = lambda part: chosen <= F.lit(min(2**63 - 1, int(part * 2**63)))
    known = known.filter(below(share))
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(known), F.col("_doc") == F.col("doc_id"))  # bounded by rows
    n, held = found.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long"))).first()
    if (held or 0) > size:
        found = found.filter(below(share * size / held))
    got = [(r[1], r[2]) for r in sorted(found.select("_doc", "text", "_toxic").collect(), key=lambda r: (r[0], r[1] or ""))]
    if n and not got:
        raise ValueError(f"none of {n} labelled texts fits a sample of {size} bytes")
    return got


def train(rows: list[tuple[str | None, int]]) -> tuple[dict[str, float], float]:
    """Weights and bias of the classifier; without rows the fixed lexicons, and a warning."""
    toxic = np.array([y for _, y in rows], bool)
    prior = float(np.clip(toxic.mean() if len(toxic) else 0.1, 0.01, 0.5))
    if not rows:
        warnings.warn("no labelled text to learn from: the fixed lexicons alone score", stacklevel=2)
        return {w: 6.0 for x in LEXICONS.values() for w in x.split()}, float(np.log(prior / (1 - prior)))
    sample = Sample([t for t, _ in rows])
    voters = Voters(mine(sample, toxic))
    asked = np.array([x in voters.every for x in sample.names], bool)
    votes = np.array([voters(t, set(sample.names[own[asked[own]]])) for (t, _), own in zip(rows, sample.per_row)])
    soft, _, _ = label_model(votes, prior)
    weights, bias = fit_linear(sample, soft)
    w = np.array([weights.get(x, 0.0) for x in sample.names])
    return weights, bias - fitting_cut(np.bincount(sample.r, weights=w[sample.c], minlength=sample.n) + bias, toxic)


def score(docs: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """``doc_id, score`` of every row; a null or empty text scores by the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # at most FEATURES entries

    def run(batches):
        w = shared.value
        plain = {x: v for x, v in w.items() if not x.endswith("~")}
        stems = {n: {x: v for x, v in w.items() if x.endswith("~") and len(x) == n + 1} for n in STEMS}
        for b in batches:
            out = []
            for at in range(0, b.num_rows, 500):
                for text in b.column(1).slice(at, 500).to_pylist():
                    words = set(WORDS.findall((text or "").lower()))
                    z = bias + sum(plain[x] for x in sorted(words & plain.keys()))
                    for n, own in stems.items():
                        if own:
                            z += sum(own[x] for x in sorted({y[:n] + "~" for y in words if len(y) >= n} & own.keys()))
                    out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return balanced(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Labels are learnt only from rows whose crc32(doc_id) mod 5 is not 0.  Rows
    without a label, null, empty and very long texts, null doc_ids and repeated
    rows are all scored; without any labelled text the fixed lexicons decide,
    with a warning.  Other columns are not looked at.  Empty table: empty.
    """
    weights, bias = train(training_rows(docs, labels, rows))
    return score(docs, weights, bias).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op8_query(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
