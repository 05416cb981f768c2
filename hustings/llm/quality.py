"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` tokens. A passage's features are how its tokens look (shares of
case, digits, marks and symbols, hashed token shapes) and how much of it repeats earlier words of the
document. An encoder, a gated attention and a logistic layer are learned together from document labels
alone: a passage's weight says how much it speaks for the whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm.encode import forget
from hustings.llm.labelled import held_out, training_rows
from hustings.llm.store import whole_texts
from hustings.llm.textops import NOT_SPACE, U, mix, shingle_hashes, steps, table_of, word_bounds, word_hashes

PASSAGE = 64
SHAPES, HIDDEN, GATE = 32, 24, 12
MOST_ROWS, EPOCHS = 6000, 12
CUT = 0.3
UPPER, LOWER, DIGIT = table_of(bytes(range(65, 91))), table_of(bytes(range(97, 123))), table_of(bytes(range(48, 58)))
MARK = table_of(b".,;:!?'\"-()")
HIGH = table_of(bytes(range(128, 256)))
SYMBOL = ~(UPPER | LOWER | DIGIT | MARK | HIGH | ~NOT_SPACE)
STATS = 14
FEATURES = STATS + SHAPES


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, its document); a document without tokens has one passage of zeros."""
    n = len(off) - 1
    start, end, doc = word_bounds(data, off, NOT_SPACE)
    counts = np.bincount(doc, minlength=n)
    first = np.concatenate(([0], np.cumsum(counts)))
    in_doc = np.arange(len(start)) - first[doc]
    per_doc = np.maximum(1, -(-counts // PASSAGE))
    base = np.concatenate(([0], np.cumsum(per_doc)))
    passage = base[doc] + in_doc // PASSAGE
    total = int(base[-1])
    length = (end - start).astype(np.float64)
    by_class = []
    for t in (UPPER, LOWER, DIGIT, MARK, SYMBOL, HIGH):
        c = np.concatenate(([0], np.cumsum(t[data], dtype=np.int64)))
        by_class.append((c[end] - c[start]) / np.maximum(length, 1))
    upper, lower, digit, mark, symbol, high = by_class
    # how a token looks: class of first and last byte, shares in coarse steps, length
    classes = (1 * UPPER + 2 * LOWER + 3 * DIGIT + 4 * MARK + 5 * SYMBOL + 6 * HIGH).astype(np.int64)
    if len(start):
        coarse = classes[data[start]] + 8 * classes[data[end - 1]] + 64 * np.minimum(3, (upper * 4).astype(int)) + 256 * np.minimum(3, (symbol * 4).astype(int)) + 1024 * np.minimum(7, (length / 3).astype(int))
        shape = (mix(coarse.astype(U)) % U(SHAPES)).astype(np.int64)
    else:
        shape = np.zeros(0, np.int64)
    h = word_hashes(data, start, end)
    again = _repeats(h, doc)
    again5 = np.zeros(len(h))
    if len(h) >= 5:
        s, d = shingle_hashes(h, doc, 5, n)
        long_docs = counts >= 5
        rep = _repeats(s, d)[long_docs[d]]
        place = first[:-1][d[long_docs[d]]] + _rank(d[long_docs[d]])
        again5[place] = rep
    values = [upper, lower, digit, mark, symbol, high, np.minimum(length, 30) / 10, (length > 20) * 1.0, (length <= 2) * 1.0, again, again5, (upper > 0.9) * 1.0, (symbol > 0.2) * 1.0]
    size = np.maximum(np.bincount(passage, minlength=total), 1)
    out = np.zeros((total, FEATURES), np.float32)
    for k, v in enumerate(values):
        out[:, k] = np.bincount(passage, weights=v, minlength=total) / size
    out[:, STATS - 1] = np.log1p(np.repeat(counts, per_doc)) / 8
    out[:, STATS:] = np.bincount(passage * SHAPES + shape, minlength=total * SHAPES).reshape(total, SHAPES) / size[:, None]
    return out, np.repeat(np.arange(n), per_doc)


def _rank(groups: np.ndarray) -> np.ndarray:
    """Place in its run of equal neighbours."""
    i = np.arange(len(groups))
    new = np.concatenate(([True], groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, bool)
    return i - np.maximum.accumulate(np.where(new, i, 0)) if len(groups) else i


def _repeats(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """1.0 where the value stood earlier in the document."""
    key = mix(h + doc.astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(h))
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ w["encode"] + w["encode0"])
        u, g = np.tanh(h @ w["see"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        raw = (u * g) @ w["attend"]
        top = np.maximum.reduceat(raw, starts)
        e = np.exp(raw - top[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        whole = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"z": z, "h": h, "u": u, "g": g, "a": a, "whole": whole, "logit": whole @ w["out"] + w["out0"]}


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 11, epochs: int = EPOCHS) -> Model:
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
    small = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {"encode": small(FEATURES, HIDDEN), "encode0": np.zeros(HIDDEN, np.float32), "see": small(HIDDEN, GATE), "gate": small(HIDDEN, GATE), "attend": small(GATE), "out": small(HIDDEN), "out0": np.zeros(1, np.float32)}
    m = Model(every.mean(axis=0), every.std(axis=0) + 1e-3, w)
    one, two, t = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    n = len(bags)
    bad = max(1, int((labels == 0).sum()))
    weight = np.where(labels == 0, min(5.0, max(1.0, (n - bad) / bad)), 1.0)
    for epoch in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 32):
            pick = order[at : at + 32]
            sizes = np.array([len(bags[i]) for i in pick])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            bag = np.repeat(np.arange(len(pick)), sizes)
            f = m.forward(np.concatenate([bags[i] for i in pick]), starts, bag)
            d = ((1 / (1 + np.exp(-f["logit"])) - labels[pick]) * weight[pick] / len(pick))[:, None]
            g = {"out": (d * f["whole"]).sum(axis=0), "out0": d.sum(axis=0)}
            d_whole = d * w["out"]
            d_h = f["a"][:, None] * d_whole[bag]
            pull = (f["h"] * d_whole[bag]).sum(axis=1)
            d_raw = f["a"] * (pull - np.add.reduceat(f["a"] * pull, starts)[bag])
            g["attend"] = ((f["u"] * f["g"]) * d_raw[:, None]).sum(axis=0)
            both = d_raw[:, None] * w["attend"]
            d_see, d_gate = both * f["g"] * (1 - f["u"] ** 2), both * f["u"] * f["g"] * (1 - f["g"])
            g["see"], g["gate"] = f["h"].T @ d_see, f["h"].T @ d_gate
            d_h = (d_h + d_see @ w["see"].T + d_gate @ w["gate"].T) * (1 - f["h"] ** 2)
            g["encode"], g["encode0"] = f["z"].T @ d_h, d_h.sum(axis=0)
            t += 1
            rate = 0.01 * 0.85**epoch
            for k in w:
                one[k] = 0.9 * one[k] + 0.1 * g[k]
                two[k] = 0.999 * two[k] + 0.001 * g[k] ** 2
                w[k] -= (rate * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    if n and labels.min() != labels.max():
        # the cut is set where the weighted errors of both kinds are fewest, and moved to CUT
        logits = np.array([m.forward(b, np.array([0]), np.zeros(len(b), np.int64))["logit"][0] for b in bags])
        order = np.argsort(logits)
        s, y = logits[order], labels[order]
        lost = np.concatenate(([0], np.cumsum((y == 1) / max(1, (y == 1).sum())))) + np.concatenate(([1], 1 - np.cumsum((y == 0) / bad)))
        lost[1:-1][s[1:] == s[:-1]] = 9
        i = int(np.argmin(lost))
        edge = s[0] - 1 if i == 0 else s[-1] + 1 if i == n else (s[i - 1] + s[i]) / 2
        w["out0"] += np.float32(np.log(CUT / (1 - CUT)) - edge)
    return m


def _train_in_task(most: int):
    """The sample's model, pickled, from the one task that has the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        kinds = pa.schema([("text", pa.string()), ("label", pa.int32()), ("order", pa.int64())])
        whole = pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=kinds) for b in batches], kinds)
        whole = whole.sort_by([("order", "ascending"), ("text", "ascending")]).slice(0, most).combine_chunks()
        bags = []
        for part, data, off in steps(whole.to_batches(), most=1 << 20):
            x, doc = features(data, off)
            cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
            bags += [x[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(bags, whole["label"].to_numpy()))], pa.binary())], ["model"])

    return run


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", modulus: int = 5, remainder: int = 0, most: int = MOST_ROWS) -> Model:
    """A model from at most ``most`` labelled rows that are not held out, trained in one task on an executor."""
    chosen = F.broadcast(training_rows(labels, column, modulus, remainder, most))
    # of rows that share a doc_id the least text, so the sample is no larger than the labels and the same at every run
    sample = whole_texts(docs).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    sample = sample.select("text", "label", F.xxhash64("doc_id", F.lit(1)).alias("order"))
    row = sample.coalesce(1).mapInArrow(_train_in_task(most), "model binary").first()
    return pickle.loads(row[0]) if row else train([], np.zeros(0, np.int64))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in steps(batches):
            x, doc = features(data, off)
            f = model.forward(x, np.searchsorted(doc, np.arange(part.num_rows)), doc)
            score = 1 / (1 + np.exp(-f["logit"].astype(np.float64)))
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(score)], ["doc_id", "held_out", "score"])

    return run


def quality(docs: DataFrame, model: Model, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1), predicted (1 from a score of ``CUT``).

    docs: doc_id, text and other columns, which are ignored. Null and empty texts are one passage of zeros.
    Repeated rows and null doc_ids (not held out) are returned as they come; an empty table gives no rows.
    Every passage of a text counts; texts never leave the task that reads them.
    """
    rows = whole_texts(docs).withColumn("held_out", held_out(modulus, remainder))
    scored = rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
