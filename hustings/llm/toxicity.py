"""Toxicity by a convolutional text classifier trained in numpy.

A word is several hashed embeddings side by side: two of the word, so that two words are alike only if both
hashes meet, and one for each of its first few bytes, which its inflected and compound forms share. Filters of
several widths run over a document's words, the largest answer of each filter over the whole text is pooled,
and a logistic layer weighs them. Because of the pooling a gradient reaches only the few words that won, so
training is sparse. A word's embeddings and its part in each filter are the same wherever it stands, so they are
computed once for the distinct words of a block or batch, and positions only add them up. All labelled rows are learned from: those of a larger table by trainers side by side, whose models
are averaged after each pass. The decision threshold is calibrated by language, told from the text's own function words,
and scores are shifted so that the threshold is ``CUT`` in each.
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
from hustings.llm.store import materialise, release, whole_texts
from hustings.llm.textops import ALNUM, U, byte_sums, steps, word_bounds, word_hashes

BITS, DIM, FILTERS, WIDTHS = 16, 4, 8, (1, 2, 3)
#: Bytes of a word's beginnings that have embeddings.
BEGINNINGS = (3, 4, 5, 6)
TABLES = 2 + len(BEGINNINGS)
ROWS = 1 << BITS
#: Labelled rows that one task learns from alone, about what each of several trainers has beyond that, and passes over them.
TRAINER_ROWS, EPOCHS = 6000, 5
CUT = 0.3
#: Positive rows of a language in the calibration part below which it has the common threshold.
LEAST_POSITIVE = 8
#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for with as on are this be by from at have",
    "fr": "le la les des et un une du est que qui dans pour par sur au elle il pas avec",
    "de": "der die das und ist nicht ein eine zu den mit von dem des auf sich im auch es dass",
    "es": "el los las de que y en un una por con para su se del al lo como es no",
}
_known: list[tuple[np.ndarray, np.ndarray]] = []


def _function_words() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and the languages (bits) that have them."""
    if not _known:
        by_hash: dict[int, int] = {}
        for i, words in enumerate(FUNCTION_WORDS.values()):
            for w in words.split():
                data = np.frombuffer(w.encode(), np.uint8)
                h = int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])
                by_hash[h] = by_hash.get(h, 0) | 1 << i
        keys = np.array(sorted(by_hash), U)
        _known.append((keys, np.array([by_hash[int(k)] for k in keys])))
    return _known[0]


def languages(h: np.ndarray, of: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The language with most function words of each document; their number for none. h: of distinct words, ``of`` them."""
    keys, bits = _function_words()
    i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    got = np.where(keys[i] == h, bits[i], 0)[of]
    counted = np.flatnonzero(got)
    got, doc = got[counted], doc[counted]
    counts = np.stack([np.bincount(doc, weights=(got >> b) & 1, minlength=n) for b in range(len(FUNCTION_WORDS))], axis=1)
    return np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), len(FUNCTION_WORDS))


def word_rows(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """A row of each table for each word; row 0 is padding."""
    out = np.empty((len(h), TABLES), np.uint16)
    out[:, 0] = (h >> U(64 - BITS)) % U(ROWS - 1) + U(1)
    out[:, 1] = (h & U(ROWS - 1)) % U(ROWS - 1) + U(1)
    for i, k in enumerate(BEGINNINGS):
        p = word_hashes(data, start, np.minimum(end, start + k), sums)
        out[:, 2 + i] = (p >> U(20)) % U(ROWS - 1) + U(1)
    return out


def distinct_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes and rows of the distinct words, number among them and document of each word), words told apart by their hashes."""
    start, end, doc = word_bounds(data, off, ALNUM)
    sums = byte_sums(data)
    h, of = _numbers(word_hashes(data, start, end, sums))
    at = np.empty(len(h), np.int64)
    at[of] = np.arange(len(of))
    return h, word_rows(data, start[at], end[at], h, sums), of, doc


def _numbers(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, number of each hash among them)."""
    coded = pa.array(h, pa.uint64()).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def _firsts(words: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words, number of each word among them); slots has a place for each word and may hold anything."""
    place = np.arange(len(words))
    slots[words] = place
    stands = slots[words]
    own = np.flatnonzero(stands == place)
    number = np.empty(len(words), np.int64)
    number[own] = np.arange(len(own))
    return words[own], number[stands]


def laid_out(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, starts): words of documents (numbers or rows) one after another, each document followed by padding (0) as
    wide as a filter reaches."""
    pad = max(WIDTHS) - 1
    counts = np.bincount(doc, minlength=n)
    starts = np.concatenate(([0], np.cumsum(counts + pad)))
    out = np.zeros((int(starts[-1]), *words.shape[1:]), words.dtype)
    out[np.arange(len(words)) + doc * pad] = words
    return out, starts[:-1]


@dataclass
class Model:
    tables: np.ndarray  # (TABLES, ROWS, DIM)
    filters: list[np.ndarray]  # width x (TABLES DIM) x FILTERS
    bias: np.ndarray
    out: np.ndarray
    base: float
    shift: np.ndarray  # by language, the last for none

    def embed(self, rows: np.ndarray) -> np.ndarray:
        flat = rows + np.arange(0, TABLES * ROWS, ROWS)
        return self.tables.reshape(-1, DIM).take(flat.ravel(), axis=0).reshape(len(rows), TABLES * DIM)

    def parts(self, e: np.ndarray) -> np.ndarray:
        """What a word adds to the filters at each of their places: the first (with the bias) of all filters, then the
        second of those that have one, and so on; WIDTHS ascend, so these are the last ones."""
        out = e @ np.concatenate([w[j] for j in range(max(WIDTHS)) for w in self.filters if len(w) > j], axis=1)
        out[:, : len(self.bias)] += self.bias
        return out

    def added(self, parts: np.ndarray) -> np.ndarray:
        """Filters' answers at each position, from the parts of the words from there on, which are overwritten."""
        n, all_ = len(parts), FILTERS * len(WIDTHS)
        out, at = parts[:, :all_], all_
        for j in range(1, max(WIDTHS)):
            many = FILTERS * sum(w > j for w in WIDTHS)
            out[: max(0, n - j), all_ - many :] += parts[j:, at : at + many]
            at += many
        return out

    def answers(self, e: np.ndarray) -> np.ndarray:
        """Filters' answers at each position, over the words from there on."""
        return self.added(self.parts(e))

    def answers_of(self, rows: np.ndarray, words: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(answers at each position, distinct words, number of each position's among them); words number rows.

        A filter that starts in the padding would reach the words of the next document, so it has the bias alone."""
        own, number = _firsts(words, slots)
        mine = rows[own]
        answers = self.added(self.parts(self.embed(mine)).take(number, axis=0))
        answers[(mine[:, 0] == 0)[number]] = self.bias
        return answers, own, number

    def pooled(self, rows: np.ndarray, starts: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
        """The largest answers of each document, in blocks of bounded size; words number rows, or are these."""
        words = np.arange(len(rows)) if words is None else words
        out = np.full((len(starts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        ends, slots = np.append(starts[1:], len(words)), np.empty(len(rows), np.int64)
        size, reach = 1 << 16, max(WIDTHS) - 1
        for a in range(0, len(words), size):
            b = min(len(words), a + size)
            answers = self.answers_of(rows, words[a : min(len(words), b + reach)], slots)[0][: b - a]
            i, j = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b)
            best = np.maximum.reduceat(answers, np.maximum(starts[i:j] - a, 0), axis=0)
            out[i:j] = np.maximum(out[i:j], best)
        return np.maximum(out, 0)

    def logits(self, rows: np.ndarray, starts: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
        return self.pooled(rows, starts, words) @ self.out + self.base


def _begin(rng: np.random.Generator) -> Model:
    m = Model(
        rng.normal(0, 0.1, (TABLES, ROWS, DIM)).astype(np.float32),
        [rng.normal(0, 0.5 / w, (w, TABLES * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.full(FILTERS * len(WIDTHS), 0.1, np.float32), rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0, np.zeros(len(FUNCTION_WORDS) + 1),
    )
    m.tables[:, 0] = 0
    return m


def _share(mean: float) -> float:
    return min(0.9, max(0.02, mean))


def _squares(m: Model) -> dict:
    """Sums of squared gradients, by which steps shrink."""
    return {"tables": np.full((TABLES, ROWS), 1e-2, np.float32), "filters": [np.full_like(w, 1e-2) for w in m.filters], "bias": np.full_like(m.bias, 1e-2), "out": np.full_like(m.out, 1e-2)}


@dataclass
class Texts:
    rows: np.ndarray  # of the distinct words; the first is padding
    docs: list[np.ndarray]  # each document's words, as numbers of rows, and padding

    def logits(self, m: Model, which: np.ndarray | range) -> np.ndarray:
        """The documents' logits, many at a time."""
        out = [np.zeros(0, np.float32)]
        for at in range(0, len(which), 256):
            docs = [self.docs[i] for i in which[at : at + 256]]
            starts = np.cumsum([0, *map(len, docs)])[:-1]
            out.append(m.logits(self.rows, starts, np.concatenate(docs)))
        return np.concatenate(out)


def _texts(h: np.ndarray, rows: np.ndarray, docs: list[np.ndarray]) -> Texts:
    """docs: words as numbers of h and rows, where words may come again."""
    h, again = _numbers(h)
    first = np.zeros((len(h) + 1, TABLES), np.uint16)
    first[again + 1] = rows
    padding = np.zeros(max(WIDTHS) - 1, np.int32)
    return Texts(first, [np.concatenate((again[d] + 1, padding), dtype=np.int32) for d in docs])


def _pass(m: Model, second: dict, texts: Texts, labels: np.ndarray, share: float, order: np.ndarray) -> None:
    """One pass over the texts in the given order; changes the model and its sums of squares."""
    rate, weight = 0.08, np.where(labels == 1, min(5.0, (1 - share) / share), 1.0)
    tables, squares = m.tables.reshape(-1, DIM), second["tables"].reshape(-1)
    slots, every = np.empty(len(texts.rows), np.int64), np.arange(FILTERS * len(WIDTHS))
    for at in range(0, len(order), 16):
        batch = order[at : at + 16]
        docs = [texts.docs[i] for i in batch]
        ends = np.cumsum([len(d) for d in docs])
        answers, own, number = m.answers_of(texts.rows, np.concatenate(docs), slots)
        rows = texts.rows[own]
        e = m.embed(rows)
        where = np.stack([answers[b - len(d) : b].argmax(axis=0) + b - len(d) for d, b in zip(docs, ends, strict=True)])
        top = answers[where, every]
        z = np.maximum(top, 0)
        d = (1 / (1 + np.exp(-(z @ m.out + m.base))) - labels[batch]) * weight[batch] / len(batch)
        g_top = np.where(top > 0, d[:, None] * m.out, 0).astype(np.float32)
        g_filters = [np.zeros_like(w) for w in m.filters]
        touched, grads = [], []
        for k, w in enumerate(m.filters):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            for j in range(len(w)):
                inside = (where[:, cols] + j < ends[:, None]) & (g_top[:, cols] != 0)
                g = (g_top[:, cols] * inside)[:, :, None]
                words = number[np.minimum(where[:, cols] + j, ends[:, None] - 1)]
                g_filters[k][j] = (e[words] * g).sum(axis=0).T
                touched.append(words[inside])
                grads.append((w[j].T * g)[inside])
        words = np.concatenate(touched)
        if len(words):
            ids, g = (rows[words] + np.arange(0, TABLES * ROWS, ROWS)).ravel(), np.concatenate(grads).reshape(-1, DIM)
            g[ids % ROWS == 0] = 0
            by_id = ids.argsort(kind="stable")
            ids = ids[by_id]
            firsts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            total, ids = np.add.reduceat(g[by_id], firsts, axis=0), ids[firsts]
            squares[ids] += (total**2).mean(axis=1)
            tables[ids] -= rate * total / np.sqrt(squares[ids])[:, None]
        for k in range(len(WIDTHS)):
            second["filters"][k] += g_filters[k] ** 2
            m.filters[k] -= rate * g_filters[k] / np.sqrt(second["filters"][k])
        for name, grad in (("bias", g_top.sum(axis=0)), ("out", d @ z)):
            second[name] += grad**2
            setattr(m, name, (getattr(m, name) - rate * grad / np.sqrt(second[name])).astype(np.float32))
        m.base -= 0.02 * float(d.sum())


def train(docs: list[np.ndarray], labels: np.ndarray, lang: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """docs: rows of words (n, TABLES) of each document."""
    rows = np.concatenate([np.zeros((0, TABLES), np.uint16), *docs])
    edges = np.cumsum([0, *map(len, docs)])
    # each word counts as one of its own
    return _train(_texts(np.arange(len(rows), dtype=U), rows, [np.arange(a, b) for a, b in zip(edges, edges[1:], strict=False)]), labels, lang, seed, epochs)


def _train(texts: Texts, labels: np.ndarray, lang: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """A fifth, the last, is kept for calibration."""
    rng = np.random.default_rng(seed)
    m = _begin(rng)
    n = len(texts.docs)
    fit = n - n // 5 if n >= 50 else n
    share = _share(float(labels[:fit].mean()) if fit else 0.5)
    m.base = float(np.log(share / (1 - share)))
    second = _squares(m)
    for _ in range(epochs):
        _pass(m, second, texts, labels, share, rng.permutation(fit))
    kept = np.arange(fit, n) if fit < n else np.arange(n)
    _calibrate(m, texts.logits(m, kept).astype(np.float64), labels[kept], lang[kept])
    return m


def _calibrate(m: Model, logits: np.ndarray, labels: np.ndarray, lang: np.ndarray) -> None:
    """Thresholds: those with the best F1 on the rows kept back, in the middle of the gap that they lie in."""
    common = _threshold(logits, labels)
    for code in range(len(FUNCTION_WORDS) + 1):
        mine = lang == code
        own = _threshold(logits[mine], labels[mine]) if (labels[mine] == 1).sum() >= LEAST_POSITIVE else common
        m.shift[code] = np.log(CUT / (1 - CUT)) - own


def _threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    if not len(labels) or labels.min() == labels.max():
        return float(np.log(CUT / (1 - CUT)))
    order = np.argsort(-logits)
    hit = np.cumsum(labels[order] == 1)
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + hit[-1])
    s = logits[order]
    f1[:-1][s[:-1] == s[1:]] = -1
    i = int(f1.argmax())
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i] - 1)


_ROWS = pa.schema([("text", pa.string()), ("label", pa.int32()), ("order", pa.int64())])


def _read(batches: list[pa.RecordBatch]) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """(texts, labels, languages, order), in that order."""
    whole = pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=_ROWS) for b in batches], _ROWS)
    whole = whole.sort_by([("order", "ascending"), ("text", "ascending")]).combine_chunks()
    hashes, rows, docs, lang, known = [np.zeros(0, U)], [np.zeros((0, TABLES), np.uint16)], [], [np.zeros(0, np.int64)], 0
    for part, data, off in steps(whole.to_batches(), most=1 << 20):
        h, r, of, doc = distinct_words(data, off)
        cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
        docs += [of[a:b] + known for a, b in zip(cut, cut[1:], strict=False)]
        lang.append(languages(h, of, doc, part.num_rows))
        hashes.append(h)
        rows.append(r)
        known += len(h)
    return _texts(np.concatenate(hashes), np.concatenate(rows), docs), whole["label"].to_numpy(), np.concatenate(lang), whole["order"].to_numpy()


def _train_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model, pickled, from the one task that has all rows."""
    forget()
    texts, labels, lang, _ = _read(list(batches))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_train(texts, labels, lang))], pa.binary())], ["model"])


# --- trainers side by side ---------------------------------------------------

#: Rows by ``order`` from which a fifth is kept for calibration.
KEPT_BACK = (1 << 63) - (1 << 64) // 5
#: Rows of a table that are summed together.
CHUNK = 1 << 14


def _in_runs(batches: Iterator[pa.RecordBatch], kept: bool) -> Iterator[tuple[Texts, np.ndarray, np.ndarray]]:
    """(texts, labels, languages) of about ``TRAINER_ROWS`` rows each, either of those kept back or of the others."""
    held: list[pa.RecordBatch] = []

    for b in batches:
        mine = b.filter(pa.array((b.column(2).to_numpy() >= KEPT_BACK) == kept))
        if mine.num_rows:
            held.append(mine)
        if sum(x.num_rows for x in held) >= TRAINER_ROWS:
            yield _read(held)[:3]
            held = []
    if held:
        yield _read(held)[:3]


def _dense(m: Model, second: dict) -> np.ndarray:
    """All that every document changes, as one vector."""
    return np.concatenate([np.ravel(x) for x in (*m.filters, m.bias, m.out, m.base, *second["filters"], second["bias"], second["out"])], dtype=np.float64)


def _set_dense(m: Model, second: dict, v: np.ndarray) -> None:
    at = 0

    def like(x: np.ndarray) -> np.ndarray:
        nonlocal at
        at += x.size
        return v[at - x.size : at].reshape(x.shape).astype(np.float32)

    m.filters, m.bias, m.out = [like(w) for w in m.filters], like(m.bias), like(m.out)
    m.base = float(like(np.zeros(1))[0])
    second |= {"filters": [like(w) for w in second["filters"]], "bias": like(second["bias"]), "out": like(second["out"])}


def _one_pass(state: bytes, share: float, epoch: int):
    """A trainer's pass over its rows, from the common state: (chunk, ids, changes, weight) of the table rows that it
    met, and of chunk -1 the rest; weight is its number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        m, second = pickle.loads(state)
        tables, squares, n = m.tables.copy(), second["tables"].copy(), 0
        for texts, labels, _ in _in_runs(batches, False):
            _pass(m, second, texts, labels, share, np.random.default_rng([epoch, n]).permutation(len(labels)))
            n += len(labels)
        if not n:
            return
        out = [(-1, b"", _dense(m, second).tobytes(), n)]
        for t in range(TABLES):
            met = np.flatnonzero(second["tables"][t] != squares[t])
            for c in range(0, ROWS, CHUNK):
                ids = met[(met >= c) & (met < c + CHUNK)]
                if len(ids):
                    change = np.concatenate((m.tables[t, ids] - tables[t, ids], (second["tables"][t, ids] - squares[t, ids])[:, None]), axis=1)
                    out.append(((t * ROWS + c) // CHUNK, (ids - c).astype("<u2").tobytes(), change.astype("<f4").tobytes(), n))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["chunk", "ids", "change", "rows"])

    return run


def _averages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Averages of a chunk's changes over the trainers that met a row, by their numbers of rows; one trainer's at a time is held."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for chunk, ids, change, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if chunk < 0:
                v = np.frombuffer(change, np.float64)
                sums[chunk] = sums.get(chunk, 0) + np.append(v, 1.0) * n
            else:
                s = sums.setdefault(chunk, np.zeros((CHUNK, DIM + 2)))
                v = np.frombuffer(change, "<f4").reshape(-1, DIM + 1)
                s[np.frombuffer(ids, "<u2")] += np.concatenate((v, np.ones((len(v), 1))), axis=1) * n
    for chunk, s in sums.items():
        if chunk < 0:
            ids, mean = b"", s[:-1] / s[-1]
        else:
            met = np.flatnonzero(s[:, -1])
            ids, mean = met.astype("<u2").tobytes(), (s[met, :-1] / s[met, -1:]).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([ids], pa.binary()), pa.array([mean.tobytes()], pa.binary())], ["chunk", "ids", "change"])


def _kept_logits(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for texts, labels, lang in _in_runs(batches, True):
            parts = [texts.logits(model, range(len(labels))).astype("<f4"), labels.astype("i1"), lang.astype("i1")]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["logits", "labels", "lang"])

    return run


def _train_together(rows: DataFrame, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """rows: text, label, order. A trainer is a task that reads a part of the rows; of all of them only averages and,
    of the rows kept back for calibration, six bytes each come to the driver."""
    mean = rows.filter(F.col("order") < KEPT_BACK).agg(F.avg("label")).first()[0]
    share = _share(0.5 if mean is None else mean)
    m = _begin(np.random.default_rng(seed))
    m.base = float(np.log(share / (1 - share)))
    second = _squares(m)
    for epoch in range(epochs):
        told = rows.mapInArrow(_one_pass(pickle.dumps((m, second)), share, epoch), "chunk int, ids binary, change binary, rows long")
        for chunk, ids, change in told.repartition(TABLES * ROWS // CHUNK + 1, "chunk").mapInArrow(_averages, "chunk int, ids binary, change binary").toLocalIterator():
            if chunk < 0:
                _set_dense(m, second, np.frombuffer(change, np.float64))
                continue
            t, c = divmod(chunk * CHUNK, ROWS)
            at, v = np.frombuffer(ids, "<u2").astype(np.int64) + c, np.frombuffer(change, "<f4").reshape(-1, DIM + 1)
            m.tables[t, at] += v[:, :DIM]
            second["tables"][t, at] += v[:, DIM]
    got = rows.mapInArrow(_kept_logits(m), "logits binary, labels binary, lang binary").collect()
    logits, labels, lang = (np.concatenate([np.zeros(0, k), *[np.frombuffer(r[i], k) for r in got]]) for i, k in enumerate(("<f4", "i1", "i1")))
    _calibrate(m, logits.astype(np.float64), labels, lang)
    return m


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", modulus: int = 4, remainder: int = 2, alone: int = TRAINER_ROWS) -> Model:
    """A model from all labelled rows that are not held out: up to ``alone`` of them in one task on an executor, more by
    trainers side by side. Of rows that share a doc_id the least text is taken."""
    chosen = training_rows(labels, column, modulus, remainder)
    many = -(-chosen.count() // alone)
    texts = whole_texts(docs).filter(~held_out(modulus, remainder))
    if many > 1:
        texts, chosen = texts.repartition(many, "doc_id"), chosen.repartition(many, "doc_id")
    else:
        chosen = F.broadcast(chosen)
    sample = texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    sample = sample.select("text", "label", F.xxhash64("doc_id", F.lit(1)).alias("order"))
    if many > 1:
        passing: list[str] = []
        # no more trainers than have about as many rows as one that is alone, however the table is read
        model = _train_together(materialise(sample, "toxicity-rows", passing).coalesce(many))
        release(passing)
        return model
    row = sample.coalesce(1).mapInArrow(_train_in_task, "model binary").first()
    return pickle.loads(row[0]) if row else train([], np.zeros(0, np.int64), np.zeros(0, np.int64))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part, data, off in steps(batches):
            n = part.num_rows
            h, rows, of, doc = distinct_words(data, off)
            words, starts = laid_out(of + 1, doc, n)
            logits = model.logits(np.concatenate((np.zeros((1, TABLES), np.uint16), rows)), starts, words)
            score = 1 / (1 + np.exp(-(logits + model.shift[languages(h, of, doc, n)])))
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(score.astype(np.float64))], ["doc_id", "held_out", "score"])

    return run


def toxicity(docs: DataFrame, model: Model, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1), predicted (1 from a score of ``CUT``).

    docs: doc_id, text and other columns, which are ignored. Null and empty texts have the score of no words.
    Repeated rows and null doc_ids (not held out) are returned as they come; an empty table gives no rows.
    Whole texts are scored, in blocks, where they are read; nothing is shuffled.
    """
    rows = whole_texts(docs).withColumn("held_out", held_out(modulus, remainder))
    scored = rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
