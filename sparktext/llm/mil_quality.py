"""Text quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktext.llm.common import identified, slices
from sparktext.llm.words import LOWER, mixed, word_bounds, word_hashes

PASSAGE_WORDS = 64
# Bounds of the labelled sample a model is fitted on; texts that are scored have no bound.
TRAIN_ROWS = 6_000
TRAIN_PASSAGES = 400_000
# Passages scored in one matrix product.
TOGETHER = 20_000
KINDS = 11
FEATURES = KINDS + 9
OUT = "doc_id bigint, text_hash bigint, score double, most_weighted int, most_weight double"


def _kinds() -> np.ndarray:
    """Kind of each byte: blank or other, lower, upper, digit, stop, mark, sign, bar, line end, later byte, first byte."""
    kind = np.zeros(256, np.int64)
    kind[97:123], kind[65:91], kind[48:58] = 1, 2, 3
    for value, signs in ((4, b".,;:?'\"-()"), (5, b"!"), (6, b"#$%&*@^~_=+<>/\\{}[]`"), (7, b"|"), (8, b"\n")):
        kind[list(signs)] = value
    kind[128:192], kind[192:] = 9, 10
    return kind


KIND = _kinds()


def passages(text: str, words: int = PASSAGE_WORDS) -> np.ndarray:
    """One row of features per passage of ``words`` words: shares of kinds of characters, word lengths,
    repetition, and how full the passage is. A text without words is one row of zeros."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends = word_bounds(raw)
    n = len(starts)
    if not n:
        return np.zeros((1, FEATURES))
    count = -(-n // words)
    bounds = np.append(starts[::words], len(raw))
    bounds[0] = 0
    of_byte = np.repeat(np.arange(count) * KINDS, np.diff(bounds))
    kinds = np.bincount(of_byte + KIND[raw], minlength=count * KINDS).reshape(count, KINDS).astype(np.float64)
    of_word = np.arange(n) // words
    full = np.bincount(of_word, minlength=count).astype(np.float64)
    length = (ends - starts).astype(np.float64)
    mean = np.bincount(of_word, length, count) / full
    spread = np.bincount(of_word, (length - mean[of_word]) ** 2, count) / full
    hashes = word_hashes(LOWER[raw], starts, ends)
    _, first, times = np.unique(mixed(hashes ^ (of_word.astype(np.uint64) << np.uint64(32))), return_index=True, return_counts=True)
    distinct = np.bincount(of_word[first], minlength=count) / full
    top = np.zeros(count)
    np.maximum.at(top, of_word[first], times)
    again = np.zeros(n)
    again[1:] = hashes[1:] == hashes[:-1]
    columns = [np.log(mean), np.sqrt(spread) / 10, distinct, top / full, np.bincount(of_word, again, count) / full]
    columns += [np.bincount(of_word, length <= 2, count) / full, np.log1p(full) / 4, kinds[:, 8] / full, np.minimum(kinds[:, 6], 10) / 10]
    return np.column_stack([kinds / kinds.sum(1, keepdims=True), *columns])


@dataclass
class Model:
    """Encoder, gated attention and scorer; parameters in a dict of arrays."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """All bags at once: rows of ``x`` are passages, ``starts`` the first row of each bag."""
        p = self.p
        x = (x - self.mean) / self.scale
        encoded = np.maximum(x @ p["E"] + p["e"], 0)
        tanh, gate = np.tanh(encoded @ p["V"]), 1 / (1 + np.exp(-(encoded @ p["U"])))
        energy = (tanh * gate) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        bag = np.repeat(np.arange(len(starts)), sizes)
        weight = np.exp(energy - np.maximum.reduceat(energy, starts)[bag])
        weight /= np.add.reduceat(weight, starts)[bag]
        pooled = np.add.reduceat(encoded * weight[:, None], starts)
        logit = pooled @ p["c"] + p["b"]
        return {"x": x, "encoded": encoded, "tanh": tanh, "gate": gate, "bag": bag, "weight": weight, "pooled": pooled, "logit": logit}

    def score(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = self.forward(x, starts)
        return 1 / (1 + np.exp(-np.clip(out["logit"], -30, 30))), out["weight"]

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over the bags."""
        p, o = self.p, self.forward(x, starts)
        d_logit = (1 / (1 + np.exp(-np.clip(o["logit"], -30, 30))) - y) / len(y)
        d_pooled = d_logit[:, None] * p["c"]
        of_row = d_pooled[o["bag"]]
        d_weight = (o["encoded"] * of_row).sum(1)
        mean = np.add.reduceat(d_weight * o["weight"], starts)[o["bag"]]
        d_energy = o["weight"] * (d_weight - mean)
        both = o["tanh"] * o["gate"]
        d_tanh = d_energy[:, None] * p["w"] * o["gate"] * (1 - o["tanh"] ** 2)
        d_gate = d_energy[:, None] * p["w"] * both * (1 - o["gate"])
        d_encoded = o["weight"][:, None] * of_row + d_tanh @ p["V"].T + d_gate @ p["U"].T
        d_encoded *= o["encoded"] > 0
        return {
            "E": o["x"].T @ d_encoded, "e": d_encoded.sum(0), "V": o["encoded"].T @ d_tanh, "U": o["encoded"].T @ d_gate,
            "w": both.T @ d_energy, "c": o["pooled"].T @ d_logit, "b": d_logit.sum(keepdims=True),
        }


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 16, epochs: int = 40, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Model:
    """Adam on the logistic loss of bag labels. One class alone gives a model that answers its share."""
    rows = np.concatenate(bags) if bags else np.zeros((1, FEATURES))
    rng = np.random.default_rng(seed)
    share = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
    shapes = {"E": (FEATURES, hidden), "e": (hidden,), "V": (hidden, hidden), "U": (hidden, hidden), "w": (hidden,), "c": (hidden,), "b": (1,)}
    p = {k: rng.normal(0, 0.3 if len(s) > 1 else 0.1, s) for k, s in shapes.items()}
    p["e"], p["b"] = np.zeros(hidden), np.array([np.log(share / (1 - share))])
    model = Model(rows.mean(0), np.maximum(rows.std(0), 1e-3), p)
    if not len(labels) or labels.min() == labels.max():
        p["c"] = np.zeros(hidden)
        return model
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-5
        for i in range(0, len(order), batch):
            chosen = [bags[k] for k in order[i : i + batch]]
            starts = np.cumsum([0, *map(len, chosen[:-1])])
            step += 1
            for k, g in model.gradients(np.concatenate(chosen), starts, labels[order[i : i + batch]]).items():
                g = g + 1e-4 * p[k] * (k not in ("b", "e"))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                p[k] = p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def held_out(id_col: str, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [passages(text).astype("f4") for text in batch.column("text").to_pylist()]
        columns = [batch.column("doc_id"), batch.column("label"), pa.array([len(r) for r in rows], pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "n", "features"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = TRAIN_ROWS, max_passages: int = TRAIN_PASSAGES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled rows that are not held out: about ``max_rows`` of them, taken by a hash of the
    id, and at most ``max_passages`` passages (whole documents in hash order). Of several labels of
    one id the largest counts; NULL labels and ids are left out."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.max(label).cast("double").alias("label"))
    known = known.where(~held_out("doc_id"))
    share = min(1.0, max_rows / max(1, known.count()))
    taken = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = identified(docs, id_col, text_col).join(F.broadcast(taken), "doc_id").select("doc_id", "text", "label")
    encoded = rows.mapInArrow(_encode, "doc_id bigint, label double, n int, features binary")
    upto = encoded.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("slice")).agg(F.sum("n").alias("n")).orderBy("slice").collect()
    slices, room = [], max_passages
    for row in upto:
        if row["n"] <= room:
            slices.append(row["slice"])
            room -= row["n"]
    sample = encoded.where(F.pmod(F.xxhash64("doc_id"), F.lit(64)).isin(slices or [-1])).toArrow().sort_by("doc_id").to_pydict()
    bags = [np.frombuffer(f, "f4").reshape(-1, FEATURES).astype(np.float64) for f in sample["features"]]
    return fit(bags, (np.array(sample["label"], np.float64) > 0).astype(np.float64))


def _scores(model: Model):
    def scored(bags: list[np.ndarray]) -> Iterator[tuple[float, int, float]]:
        starts = np.cumsum([0, *map(len, bags[:-1])])
        scores, weights = model.score(np.concatenate(bags), starts)
        for i, j, value in zip(starts, np.append(starts[1:], len(weights)), scores, strict=True):
            best = int(np.argmax(weights[i:j]))
            yield float(value), best, float(weights[i + best])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bags, held, rows = [], 0, []
            for text in batch.column("text").to_pylist():
                bags.append(passages(text))
                held += len(bags[-1])
                if held > TOGETHER:
                    rows += scored(bags)
                    bags, held = [], 0
            rows += scored(bags) if bags else []
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.float64(), pa.int32(), pa.float64()), strict=True)]
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *columns], ["doc_id", "text_hash", "score", "most_weighted", "most_weight"])

    return run


def score_column(model: Model, text: Column) -> Column:
    """Score of a text as a column, for filters that keep all other columns as they are."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        at = pa.array(np.arange(len(texts)))
        batch = pa.RecordBatch.from_arrays([at, at, texts], ["doc_id", "text_hash", "text"])
        return pa.concat_arrays([pa.array([], pa.float64()), *[out.column("score") for out in _scores(model)([batch])]])

    return scored(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, score, most_weighted (passage with the largest attention), most_weight.

    Every passage of every text counts; a NULL or empty text is one empty passage. One pass, no
    shuffle, a row per row. Ids are not looked at.
    """
    return identified(docs, id_col, text_col).mapInArrow(_scores(model), OUT)
