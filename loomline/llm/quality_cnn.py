"""Document quality by a convolutional network over bytes, in numpy.

Bytes are embedded, filters of 12 bytes slide over the text in steps of 2, so that chunks overlap and cover the
whole document, each filter keeps its maximum over the document, and a logistic unit combines the maxima.  Training is by
Adam on a sample of labelled rows; bytes that only repeat what stands up to 32 bytes before are replaced by one symbol
first, as no filter could learn equality.  The gradient of a maximum goes to the chunk that attained it.  For scoring, embedding
and filter are multiplied out into one table for each pair of neighbouring bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import plain_names, slices, table

WIDTH, STEP, FILTERS, EMBED = 12, 2, 16, 8
#: Bound of the training sample: labelled rows (those with the smallest hash of their doc_id).
SAMPLE_ROWS = 3000
#: Bounds of the sample in bytes: a longer text is not trained on (but scored whole, like any other), and the first rows that fit are.
SAMPLE_TEXT, SAMPLE_BYTES = 64 << 10, 32 << 20
STEPS, BATCH, RATE, DECAY = 700, 48, 0.01, 1e-4
#: How far back a repetition may start, bytes that must agree, the symbol for it, and the gap between texts laid out together.
BACK, AGREE, REPEAT, GAP = 32, 8, 1, 48
#: Bytes that are scored together.
CHUNK = 1 << 18

SCORE_SCHEMA = "doc_id long, score double"


def mark_repeats(flat: np.ndarray) -> np.ndarray:
    """``flat`` with every byte replaced by REPEAT where the AGREE bytes from it on equal those up to BACK bytes before."""
    out = flat.copy()
    for a in range(0, len(flat), CHUNK):  # with what is needed from before and after
        first = max(0, a - BACK)
        part = flat[first : a + CHUNK + AGREE].astype(np.uint64)
        if len(part) < AGREE:
            break
        for width in (1, 2, 4):
            part = part[:-width] | part[width:] << np.uint64(8 * width)
        seen = np.zeros(len(part), dtype=bool)
        for back in range(1, min(BACK, len(part) - 1) + 1):
            seen[back:] |= part[back:] == part[:-back]
        seen = seen[a - first :][:CHUNK]
        view = out[a : a + len(seen)]
        view[seen & (view != 0)] = REPEAT
    return out


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts one after the other, each followed by zeros so that no repetition touches two, and where the chunks of each begin and stop (in steps)."""
    sizes = np.array([(len(t) + GAP + 1) // STEP * STEP for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    flat = np.zeros(int(ends[-1]) + WIDTH, dtype=np.uint8)
    for t, end, size in zip(texts, ends, sizes):
        flat[end - size : end - size + len(t)] = np.frombuffer(t, np.uint8)
    return mark_repeats(flat), (ends - sizes) // STEP, (ends - WIDTH) // STEP + 1


class ByteCnn:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBED)),
            "kernel": r.normal(0, 0.3, (WIDTH, EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": r.normal(0, 0.3, FILTERS),
            "shift": np.zeros(1),
        }
        self.pairs = None

    def tables(self) -> np.ndarray:
        """(WIDTH, 256, FILTERS): what a byte adds to each filter at each place."""
        return np.einsum("be,wef->wbf", self.p["embed"], self.p["kernel"]).astype(np.float32)

    def ready(self) -> ByteCnn:
        t = self.tables()
        self.pairs = [(t[w][:, None, :] + t[w + 1][None, :, :]).reshape(65536, FILTERS) for w in range(0, WIDTH, 2)]
        return self

    def activations(self, flat: np.ndarray) -> np.ndarray:
        """Each filter at each chunk of ``flat``."""
        both = flat[: len(flat) // 2 * 2 : 2].astype(np.int32) * 256 + flat[1::2]
        n = len(both) - WIDTH // 2 + 1
        act = np.take(self.pairs[0], both[:n], axis=0)
        for k in range(1, WIDTH // 2):
            act += np.take(self.pairs[k], both[k : k + n], axis=0)
        return act

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text; texts are taken about a quarter of a megabyte at a time."""
        out, held, size = [], [], 0
        for t in texts:
            if held and size + len(t) > CHUNK:
                out.append(self._scores(held))
                held, size = [], 0
            held.append(t)
            size += len(t)
        return np.concatenate([*out, self._scores(held)]) if held else np.empty(0)

    def _scores(self, texts: list[bytes]) -> np.ndarray:
        flat, starts, stops = laid_out(texts)
        if len(texts) == 1:  # the maxima of overlapping parts give those of the whole
            flat = flat[: stops[0] * STEP + WIDTH - STEP]
            top = np.max([self.activations(flat[a : a + CHUNK + WIDTH]).max(axis=0) for a in range(0, len(flat) - WIDTH + 1, CHUNK)], axis=0)
        else:
            top = np.maximum.reduceat(self.activations(flat), np.column_stack([starts, stops]).ravel(), axis=0)[::2]
        z = np.maximum(np.atleast_2d(top) + self.p["bias"], 0) @ self.p["out"] + self.p["shift"]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def fit(self, texts: list[bytes], labels: list[int], seed: int = 11) -> ByteCnn:
        r = np.random.default_rng(seed)
        y = np.asarray(labels, dtype=np.float64)
        rate = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
        self.p["shift"][:] = np.log(rate / (1 - rate))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        order = np.empty(0, dtype=np.int64)
        for step in range(1, STEPS + 1 if len(y) else 0):
            if len(order) < BATCH:
                order = np.concatenate([order, *(r.permutation(len(y)) for _ in range(-(-BATCH // len(y))))])
            mine, order = order[:BATCH], order[BATCH:]
            grads = self._gradients([texts[i] for i in mine], y[mine])
            lr = RATE * (1 - 0.9 * step / STEPS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                g = g + DECAY * self.p[k] * (k != "shift")
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.001 * (g * g - s[k])
                self.p[k] = self.p[k] - lr * m[k] / (np.sqrt(s[k]) + 1e-8)
        return self.ready()

    def _gradients(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        t = self.tables()
        flat, starts, stops = laid_out(texts)
        n = (len(flat) - WIDTH) // STEP + 1
        act = np.take(t[0], flat[: n * STEP : STEP], axis=0)
        for w in range(1, WIDTH):
            act += np.take(t[w], flat[w : w + n * STEP : STEP][:n], axis=0)
        at = np.array([a + act[a:b].argmax(axis=0) for a, b in zip(starts, stops)])
        pre = act[at, np.arange(FILTERS)] + p["bias"]
        hidden = np.maximum(pre, 0)
        prob = 1 / (1 + np.exp(-np.clip(hidden @ p["out"] + p["shift"], -60, 60)))
        dz = (prob - y) / len(y)
        dpre = dz[:, None] * p["out"] * (pre > 0)
        bytes_at = flat[at[:, :, None] * STEP + np.arange(WIDTH)]  # documents x filters x places
        dtable = np.zeros((WIDTH, 256, FILTERS))
        np.add.at(dtable, (np.arange(WIDTH)[None, None, :], bytes_at, np.arange(FILTERS)[None, :, None]), dpre[:, :, None])
        return {
            "embed": np.einsum("wbf,wef->be", dtable, p["kernel"]),
            "kernel": np.einsum("be,wbf->wef", p["embed"], dtable),
            "bias": dpre.sum(axis=0),
            "out": hidden.T @ dz,
            "shift": dz.sum(keepdims=True),
        }


def held_out():
    """Rows kept from training: crc32 of the doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ByteCnn:
    """A network fitted to at most ``rows`` labelled documents that are not held out, within the bounds of the sample in bytes."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    ids = ids.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.where(F.octet_length(F.col("text").cast("string")).isNull() | (F.octet_length(F.col("text").cast("string")) <= SAMPLE_TEXT)).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.max("text").alias("text"))
    sample = sample.withColumn("size", F.octet_length("text")).where(F.col("size") <= SAMPLE_TEXT)
    so_far = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # of ``rows`` rows at most
    sample = sample.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES).select("doc_id", "quality", "text").collect()
    sample.sort(key=lambda r: r.doc_id)
    return ByteCnn().fit([r.text.encode() for r in sample], [r.quality for r in sample])


def score(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """doc_id and score of every row; one pass, no shuffle."""
    weights = {k: v.tolist() for k, v in model.p.items()}

    def run(batches):
        import pyarrow as pa

        net = ByteCnn()
        net.p = {k: np.array(v) for k, v in weights.items()}
        net.ready()
        for batch in slices(batches):
            got = net.scores([(t or "").encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORE_SCHEMA)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; one row for each row of ``docs``.

    Only texts enter a score.  Null texts are scored as empty ones; repeated rows get equal scores; a null doc_id counts as not held
    out and is never trained on; a doc_id labelled more than once has its largest label; without labels every score is one half.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score one half or more, with all their columns, whatever their names.

    Null texts are scored as empty ones; repeated rows stay or go together; without labels nothing goes; an empty table gives no rows.
    """
    model = train(docs, labels)
    weights = {k: v.tolist() for k, v in model.p.items()}
    docs, back = plain_names(docs, "doc_id", "text")

    def run(batches):
        import pyarrow as pa

        net = ByteCnn()
        net.p = {k: np.array(v) for k, v in weights.items()}
        net.ready()
        for batch in slices(batches):
            got = net.scores([(t or "").encode() for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(got >= 0.5))

    return back(docs.mapInArrow(run, docs.schema))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
