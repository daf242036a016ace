"""Toxic spans and document scores by a linear-chain conditional random field.

1. Labelled tokens. From a bounded sample of labelled documents (``TRAIN_ROWS`` per class, the ids'
   hash decides which; near copies of one class, with a similarity of 0.8 or more on word triples, count
   once) the words and word beginnings that set toxic documents apart are found. The
   tokens of toxic documents that carry one are tagged toxic, all others clean.
2. The field. Two states; a token's features are its lower-case word, its first three to six letters
   and its last three (those that the sample shows twice); transitions are learned. Weights maximise
   the penalised likelihood of tagged segments, with forward-backward gradients.
3. Scores. Forward-backward marginals p of every token of a whole text give the odds that any token
   is toxic, 1 / prod(1 - p) - 1, over the tokens above the noise of ordinary words (``NOISE``); a
   logistic fit on the sample turns their logarithm into the score. Tokens with a marginal of one half
   or more are the offending offsets.

The sample is trained in one task of bounded size; scoring is one pass over the documents without a
shuffle, so a lost task is simply run again.

Defined cases: a null text is the empty text, which has no toxic token and so the lowest score; a text
without words likewise; repeated rows give a row each; null ids stay null; labels that are null or not
0 or 1, and labels of unknown documents, are left out, and a document labelled both ways counts as
toxic; without labels of both classes every score is the share of toxic labels (0 without labels);
an empty table gives no rows; other columns pass through untouched.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.llm.common import arrow, table, whole

WORDS = re.compile(r"\w+")
TRAIN_ROWS = 2500  # labelled documents of each class at most
TRAIN_BYTES = 20_000  # longer documents are not drawn for the sample
SEGMENT = 48  # tokens
SEGMENTS = 6000  # of either kind at most
MINIMA = 64
ALIKE = 0.8
CUE_SHARE = 0.01
EPOCHS = 60
NOISE = 0.2
LOW = -2.0
TOKENS_AT_ONCE = 3_000_000
SPANS = "array<struct<start:int,end:int,marginal:double>>"


def features(word: str) -> list[str]:
    word = word.lower()
    return ["w" + word, *("p" + word[:n] for n in range(3, 7) if len(word) >= n), "s" + word[-3:]]


def triple_hashes(words: list[str]) -> np.ndarray:
    """Sorted distinct hashes of a document's lower-case word triples; of the whole of it, if shorter."""
    low = [w.lower() for w in words]
    triples = {" ".join(low[i : i + 3]) for i in range(max(1, len(low) - 2))}
    return np.unique(np.fromiter((zlib.crc32(t.encode()) for t in triples), np.uint64, len(triples)))


def without_copies(docs: list[list[str]], toxic: np.ndarray) -> list[int]:
    """Numbers of the documents whose word triples are not like those of an earlier one of their class.

    Alike means a similarity of ``ALIKE`` or more, taken on the whole sets; it is only computed where
    the signatures of two documents, ``MINIMA`` minima each, agree nearly that often.
    """
    draw = np.random.default_rng(7)
    factors = draw.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = draw.integers(0, 2**63, MINIMA, dtype=np.uint64)
    kept = []
    signatures = {y: np.empty((int((toxic == y).sum()), MINIMA), dtype=np.uint32) for y in (False, True)}
    sets: dict[bool, list[np.ndarray]] = {False: [], True: []}
    for number, words in enumerate(docs):
        y = bool(toxic[number])
        hashes = triple_hashes(words)
        own = ((hashes[:, None] * factors + terms) >> np.uint64(32)).min(0).astype(np.uint32)
        agree = (signatures[y][: len(sets[y])] == own).mean(1)
        likely = np.flatnonzero(agree >= ALIKE - 3 * math.sqrt(ALIKE * (1 - ALIKE) / MINIMA))
        for other in likely[np.argsort(-agree[likely], kind="stable")]:
            both = len(np.intersect1d(hashes, sets[y][other], assume_unique=True))
            if both >= ALIKE * (len(hashes) + len(sets[y][other]) - both):
                break
        else:
            signatures[y][len(sets[y])] = own
            sets[y].append(hashes)
            kept.append(number)
    return kept


def cue_features(toxic: list[list[str]], clean: list[list[str]]) -> set[str]:
    """Word and beginning features far more frequent among toxic documents, in ``CUE_SHARE`` of them at least."""
    def of(words: list[str]) -> set[str]:
        return {f for w in set(words) for f in features(w) if f[0] != "s"}

    least = max(2 if len(toxic) < 30 else 3, math.ceil(CUE_SHARE * len(toxic)))
    of_toxic: Counter = Counter()
    for words in toxic:
        of_toxic.update(of(words))
    frequent = {f: n for f, n in of_toxic.items() if n >= least}
    of_clean: Counter = Counter()
    for words in clean:
        of_clean.update(f for f in of(words) if f in frequent)
    cues = set()
    for f, n in frequent.items():
        share = (n + 0.5) / (len(toxic) + 1)
        if share >= 10 * (of_clean[f] + 0.5) / (len(clean) + 1) and of_clean[f] / len(clean) <= 0.02 * share:
            cues.add(f)
    return cues


def marginals(scores: np.ndarray, lengths: np.ndarray, start: float, moves: np.ndarray) -> np.ndarray:
    """P(state 1) per token of the sequences laid end to end; longest first.

    ``scores`` are the odds factors of state 1, ``start`` the odds of beginning in it, ``moves`` the
    2 x 2 transition factors. Both passes run over positions, all sequences at once.
    """
    starts = np.cumsum(lengths) - lengths
    longest = int(lengths.max(initial=0))
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    forward, backward = np.empty_like(scores), np.empty_like(scores)
    (m00, m01), (m10, m11) = moves
    x = None
    for t in range(longest):
        at = starts[: active[t]] + t
        one = scores[at]
        if t == 0:
            one = one * start
            x = one / (1 + one)
        else:
            x = x[: active[t]]
            y = 1 - x
            one = one * (y * m01 + x * m11)
            x = one / (one + (y * m00 + x * m10))
        forward[at] = x
    b = np.empty(0, dtype=scores.dtype)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        if len(b):
            nxt = scores[at[: len(b)] + 1]
            one = nxt * b
            zero = 1 - b
            up = m10 * zero + m11 * one
            down = m00 * zero + m01 * one
            b = up / (up + down)
        if n > len(b):
            b = np.concatenate([b, np.full(n - len(b), 0.5, dtype=scores.dtype)])
        backward[at] = b
    joint = forward * backward
    return joint / (joint + (1 - forward) * (1 - backward))


def _segments(docs: list[tuple[list[str], bool]], cues: set[str]) -> tuple[list, list]:
    """Tagged pieces of the sample, evenly spread: up to ``SEGMENTS`` with a cue, and as many without."""
    known: dict[str, bool] = {}

    def has_cue(word):
        if word not in known:
            known[word] = any(f in cues for f in features(word))
        return known[word]

    with_cue, others = [], []
    for words, toxic in docs:
        for at in range(0, len(words), SEGMENT):
            part = words[at : at + SEGMENT]
            hits = [has_cue(w) for w in part]
            (with_cue if any(hits) else others).append((part, [int(h and toxic) for h in hits]))
    chosen = [part for parts in (with_cue, others) for part in parts[:: -(-len(parts) // SEGMENTS) or 1]]
    return [c[0] for c in chosen], [c[1] for c in chosen]


def fit_field(segments: list[list[str]], tags: list[list[int]], penalty: float = 0.3) -> dict:
    """Weights, start and transitions by penalised likelihood with adaptive gradient steps."""
    order = sorted(range(len(segments)), key=lambda i: -len(segments[i]))
    segments, tags = [segments[i] for i in order], [tags[i] for i in order]
    lengths = np.array([len(s) for s in segments], dtype=np.int64)
    words = [w for segment in segments for w in segment]
    n = len(words)
    frequency = Counter(words)
    seen_features: Counter = Counter()
    of_word = {w: features(w) for w in frequency}
    for w, count in frequency.items():
        for f in of_word[w]:
            seen_features[f] += count
    number = {f: i for i, f in enumerate(f for f, count in seen_features.items() if count > 1)}
    known = {w: [number[f] for f in found if f in number] for w, found in of_word.items()}
    owner = np.repeat(np.arange(n), [len(known[w]) for w in words])
    cells = np.fromiter((c for w in words for c in known[w]), dtype=np.int64)
    used = list(number)
    tag = np.fromiter((t for s in tags for t in s), dtype=np.float64)
    first = np.cumsum(lengths) - lengths
    inner = np.ones(n, dtype=bool)
    inner[first] = False
    here, before = np.flatnonzero(inner), np.flatnonzero(inner) - 1
    weights, start, moves = np.zeros(len(used)), 0.0, np.zeros((2, 2))
    bias = math.log((tag.sum() + 1) / (n - tag.sum() + 1))
    past = {"w": np.full(len(used), 1e-8), "b": 1e-8, "s": 1e-8, "m": np.full((2, 2), 1e-8)}
    seen = np.zeros((2, 2))
    np.add.at(seen, (tag[before].astype(int), tag[here].astype(int)), 1)
    for epoch in range(EPOCHS):
        step = 0.5 if epoch < EPOCHS // 2 else 0.25
        odds = np.exp(np.clip(np.bincount(owner, weights[cells], n) + bias, -30, 30))
        p = marginals(odds, lengths, math.exp(start), np.exp(moves))
        gap = tag - p
        gradient = np.bincount(cells, gap[owner], len(used)) - penalty * weights
        # expected transitions, from the marginals of neighbours under the chain's own factors
        expected = _pair_sums(odds, p, here, before, np.exp(moves))
        for name, grad in (("w", gradient), ("b", gap.sum()), ("s", gap[first].sum()), ("m", seen - expected - moves)):
            past[name] = past[name] + grad**2
            change = step * grad / np.sqrt(past[name])
            if name == "w":
                weights = weights + change
            elif name == "b":
                bias += change
            elif name == "s":
                start += change
            else:
                moves = moves + change
    kept = {f: float(w) for f, w in zip(used, weights) if abs(w) > 0.02}
    return {"weights": kept, "bias": bias, "start": start, "moves": moves}


def _pair_sums(odds, p, here, before, factors) -> np.ndarray:
    """Expected counts of state pairs: each pair's table has the two marginals and the chain's odds ratio."""
    ratio = factors[0, 0] * factors[1, 1] / (factors[0, 1] * factors[1, 0])
    a, b = p[before], p[here]
    if abs(ratio - 1) < 1e-9:
        both = a * b
    else:
        s = 1 + (a + b) * (ratio - 1)
        both = (s - np.sqrt(np.maximum(0, s * s - 4 * ratio * (ratio - 1) * a * b))) / (2 * (ratio - 1))
    both = both.sum()
    return np.array([[len(here) - a.sum() - b.sum() + both, b.sum() - both], [a.sum() - both, both]])


class Scorer:
    """The field over whole texts; word factors are kept per process."""

    def __init__(self, model: dict):
        self.model = model
        self.known: dict[str, float] = {}

    def factor(self, word: str) -> float:
        if len(self.known) > 150_000:
            self.known.clear()
        weights = self.model["weights"]
        score = sum(weights.get(f, 0.0) for f in features(word)) + self.model["bias"]
        found = self.known[word] = math.exp(min(30.0, max(-30.0, score)))
        return found

    def token_marginals(self, texts: list[str]) -> list[np.ndarray]:
        known, factor = self.known, self.factor
        odds: list[np.ndarray] = []
        for text in texts:
            words = WORDS.findall(text)
            odds.append(np.fromiter((known.get(w) or factor(w) for w in words), np.float64, len(words)))
        order = np.argsort([-len(o) for o in odds], kind="stable")
        lengths = np.array([len(odds[i]) for i in order], dtype=np.int64)
        flat = np.concatenate([odds[i] for i in order]) if len(odds) else np.empty(0)
        p = marginals(flat, lengths, math.exp(self.model["start"]), np.exp(self.model["moves"]))
        out: list = [None] * len(texts)
        for i, part in zip(order, np.split(p, np.cumsum(lengths)[:-1])):
            out[i] = part
        return out

    def any_toxic(self, p: np.ndarray) -> float:
        """Logarithm of the odds that a token is toxic; of the largest marginal's where all are noise.

        Far below ``LOW`` it is flattened, so that a few labels without a toxic word do not bend the
        logistic fit.
        """
        most = float(min(p.max(), 1 - 1e-12)) if len(p) else 1e-9
        if most < NOISE:
            odds = max(-20.0, math.log(most / (1 - most)))
        else:
            total = -np.log1p(-np.minimum(p[p >= NOISE], 1 - 1e-12)).sum()
            odds = min(20.0, math.log(math.expm1(min(total, 50.0))))
        return float(odds if odds >= LOW else LOW + 0.05 * (odds - LOW))

    def score(self, p: np.ndarray) -> float:
        a, b = self.model["logistic"]
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, a + b * self.any_toxic(p)))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps, with softened targets; a rarer toxic class weighs more."""
    n1, n0 = y.sum(), (1 - y).sum()
    weight = np.where(y == 1, math.sqrt(max(1.0, n0 / n1)), 1.0)
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = design.T @ (design * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hessian, design.T @ (weight * (target - p)) - 1e-3 * beta), -2, 2)
    return float(beta[0]), float(max(beta[1], 1e-3))


def train(sample: pd.DataFrame) -> dict:
    """The model of a bounded sample with columns ``text`` and ``toxic``."""
    sample = sample.sort_values(["toxic", "text"])
    texts, toxic = sample["text"].tolist(), sample["toxic"].to_numpy() == 1
    if toxic.all() or not toxic.any():
        return {"constant": float(toxic.mean()) if len(toxic) else 0.0}
    one: dict[str, str] = {}  # a word is held once
    words = [[one.setdefault(w, w) for w in WORDS.findall(t)] for t in texts]
    kept = without_copies(words, toxic)
    texts, words, toxic = [texts[i] for i in kept], [words[i] for i in kept], toxic[kept]
    if toxic.all() or not toxic.any():
        return {"constant": float(toxic.mean())}
    cues = cue_features([w for w, y in zip(words, toxic) if y], [w for w, y in zip(words, toxic) if not y])
    model = fit_field(*_segments(list(zip(words, toxic)), cues))
    scorer = Scorer(model)
    signal = np.array([scorer.any_toxic(p) for p in scorer.token_marginals(texts)])
    model["logistic"] = _logistic(signal, toxic.astype(float))
    return model


def is_held_out(key: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> dict:
    """Fit on the labelled documents outside the held-out third; the model has a fixed size."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & ~is_held_out(key))
        .groupBy(F.col(key).alias("key"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    sized = docs.select(F.col(key).alias("key"), F.octet_length(whole(text)).alias("size"))
    drawable = sized.where(F.col("size") <= TRAIN_BYTES).select("key").join(known, "key")
    drawn = [
        drawable.where(F.col("toxic") == y).dropDuplicates(["key"]).orderBy(F.xxhash64("key"), "key").limit(TRAIN_ROWS)
        for y in (0, 1)
    ]
    # at most 2 * TRAIN_ROWS pairs of an id and a label are broadcast
    sample = (
        docs.select(F.col(key).alias("key"), whole(text).alias("text"))
        .where(F.octet_length("text") <= TRAIN_BYTES)
        .join(F.broadcast(drawn[0].unionByName(drawn[1])), "key")
        .select("text", "toxic", F.lit(0).alias("one"))
    )
    fitted = sample.groupBy("one").applyInPandas(
        lambda rows: pd.DataFrame({"model": [pickle.dumps(train(rows))]}), "model binary"
    )
    found = fitted.collect()
    return pickle.loads(found[0]["model"]) if found else {"constant": 0.0}


_SCORERS: dict[str, Scorer] = {}


def _scored(batches: Iterator[pa.RecordBatch], model: dict, kind: pa.DataType, digest: str) -> Iterator[pa.RecordBatch]:
    if "constant" not in model and digest not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[digest] = Scorer(model)
    scorer = _SCORERS.get(digest)
    for batch in batches:
        column = batch.column("text")
        sizes = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
        for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // (6 * TOKENS_AT_ONCE))) + 1):
            if not len(part):
                continue
            rows = batch.slice(int(part[0]), len(part))
            texts = rows.column("text").to_pylist()
            if scorer is None:
                scores, spans = [model["constant"]] * len(texts), [[] for _ in texts]
            else:
                found = scorer.token_marginals(texts)
                scores = [scorer.score(p) for p in found]
                spans = [_offsets(t, p) for t, p in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("row"), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["row", "score", "spans"]
            )


def _offsets(text: str, p: np.ndarray) -> list[dict]:
    """Start and end character of the tokens with a marginal of one half or more."""
    if not len(p) or p.max() < 0.5:
        return []
    return [
        {"start": m.start(), "end": m.end(), "marginal": float(x)} for m, x in zip(WORDS.finditer(text), p) if x >= 0.5
    ]


def score_toxicity(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``row`` (the document's columns), ``score`` and ``spans`` (offending offsets) per document."""
    rows = docs.select(F.struct("*").alias("row"), whole(text).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
    digest = str(zlib.crc32(pickle.dumps(model)))
    inner = rows.schema["row"].dataType.simpleString()
    return arrow(
        rows, lambda batches: _scored(batches, model, kind, digest), f"row {inner}, score double, spans {SPANS}"
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and prediction."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    # only the id goes along with the text
    scored = score_toxicity(docs.select("doc_id", F.col("text").alias("scored")), model, "scored")
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        is_held_out("row.doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "spans",
    )
