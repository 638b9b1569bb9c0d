"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

Subwords are the runs of three and four bytes of the text, A-Z lower-cased and other ASCII than letters made
spaces (runs of spaces alone do not count). Each is hashed to one of ``BUCKETS`` rows of an embedding table; the
average of a text's rows goes through a linear layer and a softmax. Training is plain stochastic
gradient descent in numpy on the driver, over a bounded sample of labelled rows. As average and layer are
both linear, the trained model is shipped as one table of logits per bucket.

A softmax only says which of the learned languages is the likeliest. So a text must also be familiar: the mean, over its subwords,
of the log of how much oftener the predicted language's sample has them than chance would (``familiarity``; about 3.5
for text of a learned language, below 0 for noise and most others).

The sample: for each language up to ``PER_LANG`` rows (of all languages about ``SAMPLE_ROWS``) in the order of a hash of their ids,
``SPAN`` characters at a hashed place of each; the ``MAX_LANGS`` most frequent languages are learned. A fifth of it calibrates: a
temperature that makes scores probabilities; the score below which a prediction is rejected (all but ``REJECTED`` of the calibration
rows that are predicted rightly lie above it, or all but ``REJECTED_ROWS`` where that is more, so that no few rows set it; and it
is above the score of a guess); and the least familiarity, a third of the way from the calibration texts with their letters
shuffled up to the calibration texts themselves. Predictions read whole texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and rejected, and so is every text if nothing
could be learned; ties go to the first language in sorted order; repeated rows each get their prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, released, text_slices

BUCKETS, DIM = 1 << 16, 16
PER_LANG, SAMPLE_ROWS, SPAN, MAX_LANGS = 1000, 16_000, 1500, 256
EPOCHS, LEAST_STEPS, RATE, SEED = 4, 10_000, 0.5, 11
#: The least score is this part of the calibration rows' low quantile: texts of two languages or of one word score low, and are no noise.
REJECTED, REJECTED_ROWS, MARGIN = 0.001, 4, 0.7
UND = "und"

_LUT = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)
_SPACES = {3: 0x202020, 4: 0x20202020}
_LETTER = regex.compile(r"\p{L}")


def subwords(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the run that starts at each byte (there are len - size + 1), and whether it counts."""
    low = _LUT[data]
    n = len(low) - size + 1
    code = low[:n].copy()
    for k in range(1, size):
        code |= low[k : k + n] << np.uint32(8 * k)
    real = code != np.uint32(_SPACES[size])
    h = code * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return (h >> np.uint32(16)).astype(np.int32), real


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, padded by spaces, and the part of its subwords in each."""
    data = np.frombuffer(b"  " + text.encode("utf-8", "replace") + b"  ", np.uint8)
    got = [b[r] for b, r in (subwords(data, s) for s in _SPACES)]
    ids, n = np.unique(np.concatenate(got), return_counts=True)
    return ids, (n / max(1, n.sum())).astype(np.float64)


def subword_count(text: str) -> int:
    data = np.frombuffer(b"  " + text.encode("utf-8", "replace") + b"  ", np.uint8)
    return sum(int(subwords(data, s)[1].sum()) for s in _SPACES)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # a row for each language: logits by bucket, before temperature
    bias: np.ndarray
    temperature: float
    least: float
    known: np.ndarray | None = None  # a row for each language: familiarity of each bucket
    familiar: float = -np.inf

    def scores(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)

    def rows(self) -> np.ndarray:
        """Logits and familiarities in one table, with a bucket of zeros at the end for runs that do not count."""
        known = np.zeros_like(self.table) if self.known is None else self.known
        both = np.concatenate([self.table, known]).astype(np.float32)
        return np.ascontiguousarray(np.pad(both, ((0, 0), (0, 1))))

    def accepts(self, lang: str, score: float, familiarity: float) -> bool:
        return lang != UND and score >= self.least and familiarity >= self.familiar


def gradients(emb: np.ndarray, out: np.ndarray, bias: np.ndarray, part: np.ndarray, y: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the loss -log softmax(part @ emb @ out + bias)[y], by emb, out and bias."""
    hidden = part @ emb
    z = hidden @ out + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    p[y] -= 1
    return np.outer(part, out @ p), np.outer(hidden, p), p


def familiarity(data: list[tuple], langs: int) -> np.ndarray:
    """By language and bucket: log of the bucket's share of the language's subwords (one half added) against an equal share."""
    n = np.full((langs, BUCKETS), 0.5)
    for ids, part, total, y in data:
        n[y, ids] += part * total
    return np.log(n / n.sum(1, keepdims=True) * BUCKETS)


def shuffled(text: str, rng: np.random.Generator) -> str:
    """The text's letters in any order, its words as long as before: noise of the same letters."""
    chars = np.array(list(text))
    at = np.flatnonzero([c.isalpha() for c in chars.tolist()])
    chars[at] = chars[rng.permutation(at)]
    return "".join(chars.tolist())


def train(rows: list[tuple[str, str]]) -> Model | None:
    """rows: (text, lang), in a fixed order."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    rng = np.random.default_rng(SEED)
    texts = [(text, langs.index(lang)) for text, lang in rows]
    data = [(*features(text), subword_count(text), y) for text, y in texts]
    some = [i for i, d in enumerate(data) if len(d[0])]
    split = len(some) >= 50
    held = some[::5] if split else some
    fit = [data[i] for k, i in enumerate(some) if k % 5 or not split]
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(1, len(fit))))  # few rows are seen more often
    steps, step = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            ids, part, _, y = fit[i]
            rate = RATE * (1 - step / steps)
            step += 1
            by_emb, by_out, by_bias = gradients(emb[ids], out, bias, part, y)
            out -= rate * by_out
            bias -= rate * by_bias
            emb[ids] -= rate * 20 * by_emb
    model = Model(langs, np.ascontiguousarray((emb @ out).T), bias, 1.0, 0.0, familiarity(fit, len(langs)))
    logits = np.array([model.table[:, data[i][0]] @ data[i][1] + bias for i in held]).reshape(-1, len(langs))
    truth = np.array([data[i][3] for i in held], np.int64)

    # a label is right with a probability of less than 1, so that the temperature does not fall without end
    doubt = 1 / (len(truth) + 2)

    def loss(t: float) -> float:
        model.temperature = t
        s = np.log(np.maximum(model.scores(logits), 1e-300))
        return -((1 - doubt) * s[np.arange(len(truth)), truth] + doubt * s.mean(1)).sum() if len(truth) else 0.0

    model.temperature = min(np.geomspace(0.01, 10, 61), key=loss)
    model.least = least_score(model.scores(logits), truth)
    known = lambda text: (lambda ids, part: (model.known[:, ids] @ part).max())(*features(text))
    if held:
        clean = np.quantile([known(texts[i][0]) for i in held], 0.01)
        noise = np.quantile([known(shuffled(texts[i][0], rng)) for i in held], 0.9)
        model.familiar = float(noise + (clean - noise) / 3)
    return model


def least_score(scores: np.ndarray, truth: np.ndarray) -> float:
    """The score below which a prediction is rejected, by the calibration rows' scores and labels.

    A wrong prediction says nothing of how sure right ones are, and its label's score may be next to 0. No softmax over k languages
    scores below 1 / k, so at or below that nothing would be rejected (of one language every score is 1).
    """
    right = scores.max(1)[scores.argmax(1) == truth] if len(truth) else np.zeros(0)
    found = np.quantile(right, max(REJECTED, min(1.0, REJECTED_ROWS / len(right)))) * MARGIN if len(right) else 0.0
    return float(max(found, min(1.0, 1.1 / scores.shape[1])))


def learnable(id_col: str) -> Column:
    """Rows that may be learned from: crc32 of the id as text is not 1 modulo 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """At most SAMPLE_ROWS pieces (one for each language at least) of SPAN characters, in the order of their hashes."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & learnable(id_col))
    counts = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    if not counts:
        return []
    each = max(1, min(PER_LANG, SAMPLE_ROWS // len(counts)))
    h = F.xxhash64(F.col(id_col), F.lit(SEED))
    rate = F.coalesce(*(F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 1.3 * each / r["count"] + 64 / r["count"]))) for r in counts))
    some = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), h.alias("h"))
    some = some.where((F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))) < rate)
    place = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - SPAN, F.lit(1))).cast("int") + 1
    some = some.select("lang", "h", F.substring("text", place, F.lit(SPAN)).alias("text"))
    top = some.orderBy("h", "lang", "text").limit(2 * (each + 64) * len(counts)).collect()
    left = {r["lang"]: each for r in counts}
    out = []
    for r in top:
        left[r["lang"]] -= 1
        if left[r["lang"]] >= 0:
            out.append((r["text"], r["lang"]))
    return out


def predict(model: Model | None, column: pa.Array, table: np.ndarray | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and familiarity of each text of a string column; ``table`` is ``model.rows()``."""
    langs, best, known = [UND] * len(column), np.zeros(len(column)), np.zeros(len(column))
    if model is None:
        return langs, best, known
    table = model.rows() if table is None else table
    k = len(model.langs)
    for row, end, data, off in text_slices(column):
        n = end - row
        total, seen = np.zeros((n, len(table))), np.zeros(n)
        # two spaces before and after each text
        padded = np.full(len(data) + 4 * n, 32, np.uint8)
        for i in range(n):
            padded[off[i] + 4 * i + 2 : off[i + 1] + 4 * i + 2] = data[off[i] : off[i + 1]]
        starts = off + 4 * np.arange(n + 1)
        for size in _SPACES:
            for at in range(0, len(padded) - size + 1, 4 * SLICE_BYTES):
                # runs that start here; of a text longer than that, the parts are summed
                bucket, real = subwords(padded[at : at + 4 * SLICE_BYTES + size - 1], size)
                for gap in range(1, size):  # runs that would go on into the next text
                    cross = starts[1:] - gap - at
                    real[cross[(cross >= 0) & (cross < len(real))]] = False
                bucket[~real] = BUCKETS
                first = int(np.searchsorted(starts, at, "right")) - 1
                last = int(np.searchsorted(starts, at + len(real), "left"))
                begins = np.maximum(starts[first:last] - at, 0)
                seen[first:last] += np.add.reduceat(real, begins, dtype=np.int64)
                for y in range(len(table)):
                    total[first:last, y] += np.add.reduceat(table[y][bucket], begins, dtype=np.float64)
        mean = total / np.maximum(seen, 1)[:, None]
        scores = model.scores(mean[:, :k] + model.bias)
        top = scores.argmax(1)
        for i in range(n):
            text = column[row + i].as_py()
            if text is not None and _LETTER.search(text):
                langs[row + i] = model.langs[top[i]]
                best[row + i] = min(1.0, scores[i, top[i]])
                known[row + i] = mean[i, k + top[i]]
    return langs, best, known


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Per document: id, lang_pred, score, familiarity, accepted (both at or above their calibrated least). Trains at once."""
    sent = docs.sparkSession.sparkContext.broadcast(train(sample(docs, id_col, text_col, lang_col)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        table = model and model.rows()
        for part in parts:
            found = predict(model, part.column("text"), table)
            accepted = [model is not None and model.accepts(*f) for f in zip(*found, strict=True)]
            arrays = [part.column("id"), pa.array(found[0], pa.string()), pa.array(found[1]), pa.array(found[2]), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "lang_pred", "score", "familiarity", "accepted"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(released(run), f"id {kind}, lang_pred string, score double, familiarity double, accepted boolean")
    return found.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is accepted; columns as before. Predicted beside the row: no join."""
    sent = docs.sparkSession.sparkContext.broadcast(train(sample(docs, id_col, text_col, lang_col)))
    at = docs.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        table = model and model.rows()
        for part in parts:
            found = predict(model, part.column(at), table)
            yield part.filter(pa.array([model is not None and model.accepts(*f) for f in zip(*found, strict=True)], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
