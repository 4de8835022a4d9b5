"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 128
BATCH = 1024


def _letters() -> np.ndarray:
    """Whether a byte belongs to a letter: ASCII letters and every byte past ASCII."""
    b = np.arange(256)
    return ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGRU:
    """Two gated recurrent layers, one from each side of a window, and a softmax at every byte."""

    def __init__(self, classes: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["w" + d] = rng.normal(0, 0.3, (256, 3 * hidden))
            self.p["u" + d] = rng.normal(0, hidden ** -0.5, (hidden, 3 * hidden))
            self.p["c" + d] = np.zeros(hidden)  # inside the reset product
        self.p["v"] = rng.normal(0, 0.3, (2 * hidden, classes))
        self.p["o"] = np.zeros(classes)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _side(self, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (time, row, hidden) of one direction; x is (time, row)."""
        n, steps = self.hidden, len(x)
        w, u, c = self.p["w" + d], self.p["u" + d], self.p["c" + d]
        out = np.empty((steps, x.shape[1], n), np.float32)
        h = np.zeros((x.shape[1], n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, g = w[x[t]], h @ u
            gates = _sigmoid(a[:, :2 * n] + g[:, :2 * n])
            z, r, inner = gates[:, :n], gates[:, n:], g[:, 2 * n:] + c
            m = np.tanh(a[:, 2 * n:] + r * inner)
            if keep is not None:
                keep.append((t, h, z, r, inner, m))
            h = m + z * (h - m)
            out[t] = h
        return out

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities (time, row, class) of every byte of x (time, row)."""
        v, n = self.p["v"], self.hidden
        s = self._side("f", x) @ v[:n] + self._side("b", x) @ v[n:] + self.p["o"]
        np.exp(s - s.max(-1, keepdims=True), out=s)
        s /= s.sum(-1, keepdims=True)
        return s

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Cross-entropy gradients by backpropagation through time. weight: (time, row)."""
        n, kept = self.hidden, {"f": [], "b": []}
        states = np.concatenate([self._side(d, x, kept[d]) for d in "fb"], axis=-1)
        s = states @ self.p["v"] + self.p["o"]
        s = np.exp(s - s.max(-1, keepdims=True))
        s /= s.sum(-1, keepdims=True)
        np.put_along_axis(s, y[None, :, None].repeat(len(x), 0), np.take_along_axis(
            s, y[None, :, None].repeat(len(x), 0), 2) - 1, 2)
        s *= (weight / max(1.0, weight.sum()))[..., None]
        grad = {"v": np.einsum("tbh,tbc->hc", states, s), "o": s.sum((0, 1))}
        down = s @ self.p["v"].T
        for k, d in enumerate("fb"):
            u, part = self.p["u" + d], down[..., k * n:(k + 1) * n]
            gw, gu, gc = (np.zeros_like(self.p[a + d]) for a in "wuc")
            dh = np.zeros(x.shape[1:] + (n,), np.float32)
            for t, h, z, r, inner, m in reversed(kept[d]):
                dh = dh + part[t]
                dm = dh * (1 - z) * (1 - m * m)
                dz = dh * (h - m) * z * (1 - z)
                dr = dm * inner * r * (1 - r)
                di = dm * r
                into = np.concatenate([dz, dr, dm], 1)
                back = np.concatenate([dz, dr, di], 1)
                np.add.at(gw, x[t], into)
                gu += h.T @ back
                gc += di.sum(0)
                dh = dh * z + back @ u.T
            grad |= {"w" + d: gw, "u" + d: gu, "c" + d: gc}
        return grad

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int, rows: int, rate: float, seed: int) -> None:
        """Adam over ``steps`` batches of ``rows`` windows; x and weight are (row, time)."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for i in range(1, steps + 1):
            pick = rng.integers(0, len(x), rows)
            g = self.gradients(np.ascontiguousarray(x[pick].T), y[pick], weight[pick].T)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            now = rate * min(1.0, 2 * (1 - (i - 1) / steps))
            for k, v in g.items():
                v = v / max(1.0, norm)
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                self.p[k] -= (now * first[k] / (1 - 0.9 ** i) / (np.sqrt(second[k] / (1 - 0.99 ** i)) + 1e-8)).astype(np.float32)


def _cut(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that cover the bytes, and from where each one's labels count.

    The last window is moved back to end with the text; a short text is one window."""
    n = len(data)
    starts = np.arange(0, max(1, n), width)
    fresh = starts.copy()
    starts[-1] = max(0, min(starts[-1], n - width))
    return starts, fresh - starts


def sample_windows(
    docs: DataFrame, text_col: str, lang_col: str, key: Column, per_lang: int, most_texts: int, width: int, each: int,
) -> list:
    """Up to ``each`` windows, spread evenly, of about ``per_lang`` texts of every language, and of
    fewer where there are so many languages that ``most_texts`` would not do, but of some of each."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"), key.alias("key"))
    rows = rows.where("text is not null and lang is not null and length(text) > 0")
    langs = rows.groupBy("lang").agg(F.count("*").alias("n"))
    n_langs = langs.count()
    per_lang = min(per_lang, max(4, most_texts // max(1, n_langs)))
    # Some thousand rows of two columns go to every task, so that no text is moved for them; more are joined.
    rows = rows.join(F.broadcast(langs) if n_langs <= 10_000 else langs, "lang").withColumn("place", F.col("key") * F.col("n"))

    def windows(batches):
        for batch in batches:
            out, lang, place = [], [], []
            for text, name, at in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "place"))):
                data = text.encode()
                for k in range(min(each, 1 + (len(data) - 1) // width)):
                    first = max(0, len(data) - width) * k // max(1, each - 1)
                    out.append(data[first:first + width].ljust(width))
                    lang.append(name)
                    place.append(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(place, pa.float64()), pa.array(out, pa.binary())],
                names=["lang", "place", "window"])

    kept = rows.where(F.col("place") < per_lang).select("text", "lang", "place")
    found = kept.mapInArrow(windows, "lang string, place double, window binary")
    return found.orderBy("place", "lang", "window").collect()


def train(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key: Column | None = None, per_lang: int = 400,
    most_texts: int = 40_000, hidden: int = 8, steps: int = 260, rows: int = 192, rate: float = 0.02, seed: int = 7,
) -> tuple[ByteGRU, list[str]] | None:
    """The network and its languages, learned from windows of a bounded sample of labelled texts.

    About ``per_lang`` texts of every language, chosen by a hash of the row, with up to 4 windows of
    ``WINDOW // 2`` bytes each; of more than 100 languages fewer texts each, so that about ``most_texts``
    are taken in all. None where no labelled text is left.
    """
    width = WINDOW // 2
    key = F.abs(F.xxhash64(F.lit(seed), F.col(text_col))) / F.lit(float(2 ** 63)) if key is None else key
    sample = sample_windows(docs, text_col, lang_col, key, per_lang, most_texts, width, 4)
    if not sample:
        return None
    names = sorted({r.lang for r in sample})
    x = np.frombuffer(b"".join(bytes(r.window) for r in sample), np.uint8).reshape(-1, width)
    y = np.array([names.index(r.lang) for r in sample])
    # Each language has the same share of the batches.
    order = np.concatenate([np.resize(np.flatnonzero(y == k), max(np.bincount(y))) for k in range(len(names))])
    net = ByteGRU(len(names), hidden, seed)
    net.fit(x[order], y[order], _letters()[x[order]].astype(np.float32), steps, rows, rate, seed)
    return net, names


def pooled(net: ByteGRU, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities (text, class) over the letters of whole texts, NaN where there are none."""
    letter = _letters()
    datas = [np.frombuffer(t, np.uint8) for t in texts]
    which, starts, fresh = [], [], []
    for i, data in enumerate(datas):
        s, f = _cut(data, WINDOW)
        which.append(np.full(len(s), i)), starts.append(s), fresh.append(f)
    which, starts, fresh = map(np.concatenate, (which, starts, fresh))
    total = np.zeros((len(texts), net.p["v"].shape[1]))
    count = np.zeros(len(texts))
    steps = np.arange(WINDOW)
    for at in range(0, len(which), BATCH):
        x = np.full((min(BATCH, len(which) - at), WINDOW), 32, np.uint8)
        for row, (i, s) in enumerate(zip(which[at:at + BATCH].tolist(), starts[at:at + BATCH].tolist())):
            part = datas[i][s:s + WINDOW]
            x[row, :len(part)] = part
        weight = (letter[x] & (steps >= fresh[at:at + BATCH, None])).astype(np.float32)
        labels = net.labels(np.ascontiguousarray(x.T))
        np.add.at(total, which[at:at + BATCH], np.einsum("tbc,bt->bc", labels, weight))
        np.add.at(count, which[at:at + BATCH], weight.sum(1))
    with np.errstate(invalid="ignore"):
        return total / count[:, None]


def _labelled(model: tuple[ByteGRU, list[str]] | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of some texts, some megabytes worked on together."""
    name, score = ["und"] * len(texts), [0.0] * len(texts)
    some = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)] if model else []
    at = 0
    while at < len(some):
        size, end = 0, at
        while end < len(some) and (end == at or size < 4_000_000):
            size += len(texts[some[end]])
            end += 1
        means = pooled(model[0], [texts[i].encode() for i in some[at:end]])
        for i, m in zip(some[at:end], means):
            best = int(np.argmax(m))
            name[i], score[i] = model[1][best], float(min(1.0, m[best]))
        at = end
    return name, score


def languages(
    docs: DataFrame, model: tuple[ByteGRU, list[str]] | None, id_col: str = "doc_id", text_col: str = "text",
    extra: list[str] | None = None,
) -> DataFrame:
    """One row per document: (id, lang_pred, score), and the ``extra`` columns of the input.

    The network reads every byte of the text in windows of ``WINDOW`` bytes and labels each; the
    probabilities of the letters' bytes are averaged over the text, the largest one is the label.
    Texts are read a batch of ``BATCH`` windows at a time, so a long text costs time, not memory.

    Null and empty texts and texts without a letter are ``und`` with score 0, and so is every text
    where nothing was learned. Null ids and repeated rows are rows of their own.
    """
    def label(batches):
        for batch in batches:
            name, score = _labelled(model, batch.column(1).to_pylist())
            found = [pa.array(name, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], *found], names=["id", *(extra or []), "lang_pred", "score"])

    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c) for c in extra or []))
    out = rows.drop("text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return rows.mapInArrow(label, out).withColumnRenamed("id", id_col)


def keep_known(
    docs: DataFrame, model: tuple[ByteGRU, list[str]] | None, least: float = 0.5, text_col: str = "text",
) -> DataFrame:
    """The documents, with all their columns, whose language is told with a score of ``least`` and
    more; ``und`` goes. Where nothing was learned nothing can be told, and all documents stay. Null,
    empty and letterless texts go. Repeated rows and null ids are judged by their text; a long text is
    read whole, an empty table stays empty. Rows are judged where they are read and not moved."""
    if model is None:
        return docs
    def keep(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            name, score = _labelled(model, texts)
            yield batch.filter(pa.array([n != "und" and s >= least for n, s in zip(name, score)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
