"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is its own embedding beside the mean of its characters' n-gram embeddings, so that
unseen forms of a word are known by their characters. Windows of WINDOW words that overlap by
WINDOW - STRIDE run through a GRU in both directions; attention pools the states, and a text's score
comes from its highest window. Trained here in numpy on a bounded sample of labelled rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.runtime import crc_fold, read_table, ship
from tidemark.llm.textops import byte_class, mix, slices, split_words

WINDOW, STRIDE = 48, 32
#: At most this many labelled rows of each class, of at most so many characters, and so many windows are learned from.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_WINDOWS = 3000, 6000, 24_000
WORD_BUCKETS, GRAM_BUCKETS, EMBED, HIDDEN, ATTEND = 1 << 14, 1 << 14, 12, 12, 8
GRAMS = (3, 4, 5)
UPDATES, BATCH, RATE = 450, 96, 0.01
#: Share of words whose own embedding is hidden in an update, so that characters are learned from too.
BLIND = 0.25
CHUNK, EMBED_WORDS = 2048, 20_000
_ALNUM = byte_class("alnum")
f32 = np.float32


@dataclass
class Inputs:
    """Distinct words of some texts: word bucket, n-gram buckets (ragged), and each word's place among them."""

    word: np.ndarray
    gram: np.ndarray
    gram_at: np.ndarray
    place: np.ndarray
    first: np.ndarray


def inputs_of(data: np.ndarray, off: np.ndarray) -> Inputs:
    w = split_words(data, off, _ALNUM, lower=True)
    h, pick, place = np.unique(w.hashes(), return_index=True, return_inverse=True)
    size = w.end[pick] - w.start[pick]
    # '<word>' of every distinct word, one after another
    end = np.cumsum(size + 2)
    start = end - size - 2
    line = np.zeros(int(end[-1]) if len(end) else 0, np.uint64)
    if len(end):
        inner = np.ones(len(line), bool)
        inner[start] = inner[end - 1] = False
        line[start], line[end - 1] = 1, 2
        at = np.repeat(w.start[pick] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        line[inner] = w.data[at]
    owner = np.repeat(np.arange(len(size)), size + 2)
    grams, owners = [], []
    for n in GRAMS:
        if len(line) >= n:
            g = np.zeros(len(line) - n + 1, np.uint64)
            for j in range(n):
                g = g * np.uint64(257) + line[j : len(line) - n + 1 + j] + np.uint64(1)
            ok = owner[: len(g)] == owner[n - 1 :]
            grams.append((mix(g[ok]) % np.uint64(GRAM_BUCKETS)).astype(np.int32))
            owners.append(owner[: len(g)][ok])
    gram, own = (np.concatenate(grams), np.concatenate(owners)) if grams else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    order = np.argsort(own, kind="stable")
    return Inputs((h % np.uint64(WORD_BUCKETS)).astype(np.int32), gram[order], np.searchsorted(own[order], np.arange(len(size) + 1)), place.astype(np.int64), w.first)


def together(parts: list[Inputs]) -> Inputs:
    """One after another; a word of two parts is there twice."""
    ahead = lambda sizes: np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    words, grams, places = (ahead([len(x) for x in xs]) for xs in ([p.word for p in parts], [p.gram for p in parts], [p.place for p in parts]))
    last = lambda xs, at: np.concatenate([*(x[:-1] + a for x, a in zip(xs, at, strict=True)), [xs[-1][-1] + at[-1]]])
    return Inputs(
        np.concatenate([p.word for p in parts]), np.concatenate([p.gram for p in parts]), last([p.gram_at for p in parts], grams),
        np.concatenate([p.place + a for p, a in zip(parts, words, strict=True)]), last([p.first for p in parts], places),
    )


def subset(x: Inputs, words: np.ndarray) -> Inputs:
    """Some of the distinct words, without places."""
    n = np.diff(x.gram_at)[words]
    at = np.repeat(x.gram_at[words] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    return Inputs(x.word[words], x.gram[at], np.concatenate([[0], np.cumsum(n)]), np.zeros(0, int), np.zeros(0, int))


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window; the last of a text ends with it. A wordless text has none."""
    n = np.diff(first)
    count = np.where(n == 0, 0, np.where(n <= WINDOW, 1, -(-(n - WINDOW) // STRIDE) + 1))
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[text] + np.minimum(nth * STRIDE, np.maximum(n[text] - WINDOW, 0))
    return text, begin, np.minimum(n[text], WINDOW)


def _sig(x: np.ndarray) -> np.ndarray:
    return f32(0.5) * np.tanh(f32(0.5) * x) + f32(0.5)


@dataclass
class Network:
    p: dict = field(default_factory=dict)
    scale: tuple = (1.0, 0.0)
    rate: float = 0.1

    @staticmethod
    def fresh(seed: int = 11) -> Network:
        r = np.random.default_rng(seed)
        normal = lambda *shape, s=None: (r.standard_normal(shape) * (s or 1 / np.sqrt(shape[0]))).astype(f32)
        p = {"Ew": normal(WORD_BUCKETS, EMBED, s=0.02), "Ec": normal(GRAM_BUCKETS, EMBED, s=0.02)}
        for d in "fb":
            p |= {f"W{d}": normal(2 * EMBED, 3 * HIDDEN), f"U{d}": normal(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, f32)}
        return Network(p | {"A": normal(2 * HIDDEN, ATTEND), "a": np.zeros(ATTEND, f32), "v": normal(ATTEND), "o": normal(2 * HIDDEN), "c": np.zeros(1, f32)})

    def embed(self, x: Inputs) -> np.ndarray:
        n = np.diff(x.gram_at)
        out = np.empty((len(n), 2 * EMBED), f32)
        out[:, :EMBED] = self.p["Ew"][x.word]
        for a in range(0, len(n), EMBED_WORDS):
            at = x.gram_at[a : a + EMBED_WORDS + 1]
            own = self.p["Ec"][x.gram[at[0] : at[-1]]]
            sums = np.add.reduceat(own, at[:-1] - at[0], axis=0) if len(own) else 0
            out[a : a + EMBED_WORDS, EMBED:] = sums / np.sqrt(np.maximum(np.diff(at), 1)).astype(f32)[:, None]
        return out

    def gru(self, g: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """g: (time, batch, 3 HIDDEN) inputs by step; mask: (time, batch, 1). States by step."""
        steps, n, _ = g.shape
        u, h, H = self.p[f"U{d}"], np.zeros((n, HIDDEN), f32), HIDDEN
        out = np.empty((steps, n, H), f32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            s = h @ u
            zr = _sig(g[t, :, : 2 * H] + s[:, : 2 * H])
            z, r = zr[:, :H] * mask[t], zr[:, H:]
            c = np.tanh(g[t, :, 2 * H :] + r * s[:, 2 * H :])
            new = h + z * (c - h)
            if keep is not None:
                keep.append((t, h, z, zr[:, :H], r, c, s[:, 2 * H :]))
            out[t] = h = new
        return out

    def pool(self, h: np.ndarray, mask: np.ndarray):
        q = np.tanh(h @ self.p["A"] + self.p["a"])
        e = np.where(mask[..., 0] > 0, q @ self.p["v"], f32(-1e9))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = (w[..., None] * h).sum(axis=0)
        return q, w, pooled, pooled @ self.p["o"] + self.p["c"][0]

    def logits(self, x: Inputs, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of every window."""
        e = self.embed(x)
        g = {d: e @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"}
        out = np.empty(len(begin), f32)
        order = np.argsort(n, kind="stable")
        for a in range(0, len(order), CHUNK):
            i = order[a : a + CHUNK]
            t = np.arange(int(n[i].max()))[:, None]
            at = x.place[np.minimum(begin[i] + t, len(x.place) - 1)]
            mask = (t < n[i]).astype(f32)[..., None]
            h = np.concatenate([self.gru(g[d][at], mask, d) for d in "fb"], axis=2)
            out[i] = self.pool(h, mask)[3]
        return out

    def logits_in_parts(self, x: Inputs, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The same for many texts at once, without holding all their words' inputs."""
        out = np.empty(len(begin), f32)
        for a in range(0, len(begin), CHUNK):
            b, k = begin[a : a + CHUNK], n[a : a + CHUNK]
            at = x.place[np.minimum(b + np.arange(WINDOW)[:, None], len(x.place) - 1)].T
            used, local = np.unique(at, return_inverse=True)
            part = subset(x, used)
            part.place = local.ravel()
            out[a : a + CHUNK] = self.logits(part, np.arange(len(b)) * WINDOW, k)
        return out

    def highest(self, x: Inputs) -> np.ndarray:
        """The highest window's logit of each text; nan for wordless ones."""
        text, begin, n = windows_of(x.first)
        best = np.full(len(x.first) - 1, -np.inf)
        np.maximum.at(best, text, self.logits(x, begin, n))
        return np.where(np.isinf(best), np.nan, best)

    def probability(self, best: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(best), self.rate, 1 / (1 + np.exp(-np.clip(self.scale[0] * best + self.scale[1], -30, 30))))

    def gradients(self, x: Inputs, begin: np.ndarray, n: np.ndarray, y: np.ndarray, keep_word: np.ndarray) -> dict:
        p, H = self.p, HIDDEN
        t = np.arange(int(n.max()))[:, None]
        at = x.place[np.minimum(begin + t, len(x.place) - 1)]
        used, local = np.unique(at, return_inverse=True)
        local = local.reshape(at.shape)
        part = subset(x, used)
        sub_n = np.diff(part.gram_at)
        # words that are known by their characters alone in this update
        only = keep_word[used % len(keep_word)][:, None]
        e = self.embed(part)
        e[:, :EMBED] *= only
        mask = (t < n).astype(f32)[..., None]
        keeps, hs = {"f": [], "b": []}, []
        for d in "fb":
            hs.append(self.gru((e @ p[f"W{d}"] + p[f"b{d}"])[local], mask, d, keeps[d]))
        h = np.concatenate(hs, axis=2)
        q, w, pooled, logit = self.pool(h, mask)
        dl = ((_sig(logit) - y) / len(y)).astype(f32)
        g = {"o": pooled.T @ dl, "c": np.array([dl.sum()], f32)}
        dp = dl[:, None] * p["o"]
        dh = w[..., None] * dp
        dw = (h * dp).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=0))
        g["v"] = np.tensordot(de, q, axes=([0, 1], [0, 1]))
        dq = de[..., None] * p["v"] * (1 - q * q)
        g["A"], g["a"] = np.tensordot(h, dq, axes=([0, 1], [0, 1])), dq.sum(axis=(0, 1))
        dh = dh + dq @ p["A"].T
        dx = np.zeros_like(e)
        for d, own in (("f", dh[..., :H]), ("b", dh[..., H:])):
            dg, dU, back = np.zeros((*at.shape, 3 * H), f32), np.zeros_like(p[f"U{d}"]), np.zeros((at.shape[1], H), f32)
            for s, h0, z, z0, r, c, sc in reversed(keeps[d]):
                dn = own[s] + back
                dc = dn * z * (1 - c * c)
                dz = dn * (c - h0) * mask[s] * z0 * (1 - z0)
                dr = dc * sc * r * (1 - r)
                dg[s] = np.concatenate([dz, dr, dc], axis=1)
                ds = np.concatenate([dz, dr, dc * r], axis=1)
                dU += h0.T @ ds
                back = dn * (1 - z) + ds @ p[f"U{d}"].T
            flat = dg.reshape(-1, 3 * H)
            word = np.zeros((len(used), 3 * H), f32)
            np.add.at(word, local.ravel(), flat)
            g |= {f"U{d}": dU, f"b{d}": flat.sum(axis=0), f"W{d}": e.T @ word}
            dx += word @ p[f"W{d}"].T
        g["Ew"], g["Ec"] = np.zeros_like(p["Ew"]), np.zeros_like(p["Ec"])
        np.add.at(g["Ew"], part.word, dx[:, :EMBED] * only)
        np.add.at(g["Ec"], part.gram, np.repeat(dx[:, EMBED:] / np.sqrt(np.maximum(sub_n, 1))[:, None], sub_n, axis=0).astype(f32))
        return g


def calibrate(score: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Slope (positive) and offset of the logistic curve from scores to labels.

    Scores are first brought to mean 0 and deviation 1. A Newton step that does not lower the loss
    enough is halved, so the fit also converges where scores tell the labels apart altogether.
    """
    middle, spread = score.mean(), score.std() + 1e-6
    x = np.stack([(score - middle) / spread, np.ones(len(score))], axis=1).astype(float)
    pull = np.array([ridge, 1e-6])
    loss = lambda c: (weight * (np.logaddexp(0, x @ c) - y * (x @ c))).sum() + (pull * c * c).sum() / 2
    c = np.zeros(2)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ c, -500, 500)))
        grad = x.T @ (weight * (q - y)) + pull * c
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(pull), grad)
        size = 1.0
        while size > 1e-6 and loss(c - size * step) > loss(c) - 1e-4 * size * (grad @ step):
            size /= 2
        if size <= 1e-6 or grad @ step < 1e-10:
            break
        c = c - size * step
    slope = max(c[0], 0.05) / spread
    return float(slope), float(c[1] - slope * middle)


def train(texts: list[str], labels: list[int], rate: float | None = None, seed: int = 11) -> Network:
    """A network from texts and their 0/1 labels.

    A toxic text need not be toxic in all its windows: after a third of the updates its windows are
    scored, and only those near its highest stay positive. At the end a logistic curve is fitted from
    highest windows to labels, weighted to the positive rate.
    """
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    y = np.array(labels, f32)
    if not len(y) or y.min() == y.max():
        net.rate = float(y.mean()) if len(y) else 0.0
        net.p["o"][:] = 0
        net.scale = (1.0, 30.0 if net.rate > 0.5 else -30.0)
        return net
    rate = float(y.mean()) if rate is None else rate
    net.rate = min(rate, 0.499)
    x = together([inputs_of(data, off) for _, _, data, off in slices(pa.array(texts, pa.string()))])
    text, begin, n = windows_of(x.first)
    if len(text) > SAMPLE_WINDOWS:
        keep = np.sort(r.permutation(len(text))[:SAMPLE_WINDOWS])
        text, begin, n = text[keep], begin[keep], n[keep]
    pos, neg = np.flatnonzero(y[text] == 1), np.flatnonzero(y[text] == 0)
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in range(2))
    for step in range(1, UPDATES + 1):
        if step in (UPDATES // 3, UPDATES * 2 // 3):
            score = net.logits_in_parts(x, begin, n)
            top = np.full(len(y), -np.inf)
            np.maximum.at(top, text, score)
            mine = np.flatnonzero(y[text] == 1)
            pos = mine[(score[mine] >= top[text[mine]] - 0.5) | (score[mine] > 2)]
            # the hardest negatives come twice as often
            neg = np.flatnonzero(y[text] == 0)
            neg = np.concatenate([neg, neg[np.argsort(-score[neg])[: len(neg) // 2]]])
        i = np.concatenate([r.choice(pos, BATCH // 3), r.choice(neg, BATCH - BATCH // 3)])
        g = net.gradients(x, begin[i], n[i], y[text[i]], (r.random(9973) >= BLIND).astype(f32))
        lr = RATE * min(1, (UPDATES - step + 1) / (UPDATES * 0.4))
        for k, a in net.p.items():
            d = np.clip(g[k], -1, 1)
            m[k] += 0.1 * (d - m[k])
            v[k] += 0.01 * (d * d - v[k])
            a -= (lr * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(f32)
    text, begin, n = windows_of(x.first)
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, text, net.logits_in_parts(x, begin, n))
    ok = ~np.isinf(best)
    s, z = best[ok], y[ok]
    share = z.mean()
    weight = np.where(z == 1, rate / max(share, 1e-9), (1 - rate) / max(1 - share, 1e-9))
    net.scale = calibrate(s, z, weight)
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, text, toxic, rate): at most `rows` labelled rows of each class outside fold 0, and the share of label 1.

    Texts of at most `chars` characters go first, then longer ones, each in order of a hash; a class
    stops at rows * chars characters. So a class of which enough texts are short is learned from
    those, and one of long texts from as many of them as the bound allows. Null texts are left out; a
    doc_id that is there several times is sampled with its least text.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rate = known.agg(F.avg("toxic")).first()[0]
    sizes = docs.where("text IS NOT NULL").select("doc_id", F.length("text").cast("long").alias("n")).join(known, "doc_id").groupBy("doc_id").agg(F.max("n").alias("n"), F.first("toxic").alias("toxic"))
    order = [F.col("n") > chars, F.xxhash64(F.lit("toxicity"), "doc_id"), F.col("doc_id")]
    picked = sizes.where("toxic = 1").orderBy(*order).limit(rows).unionByName(sizes.where("toxic = 0").orderBy(*order).limit(rows))
    upto = F.sum("n").over(Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))  # at most `rows` rows each
    picked = picked.withColumn("upto", upto).where(F.col("upto") <= rows * chars).select("doc_id", "toxic")
    found = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).withColumn("rate", F.lit(float(rate or 0.0)))


def _train(batches) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)), key=lambda r: r[0])
    net = train([r[1] for r in rows], [r[2] for r in rows], rows[0][3] if rows else None)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """Learns `toxic` of labels (doc_id, toxic) from texts alone; rows with another label or of fold 0 are not learned from.

    One task trains on the sample, which is bounded by SAMPLE_ROWS and SAMPLE_CHARS (of its windows at most
    SAMPLE_WINDOWS, drawn at random, are learned from), and returns the
    network, which has a fixed size. Without labels of both classes every text gets their share.
    """
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels).select("doc_id", "text", "toxic", "rate")
    made = sample.coalesce(1).mapInArrow(_train, "net binary").collect()
    return pickle.loads(made[0].net) if made else train([], [])


def _score(net, batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a, end, data, off in slices(b.column(1)):
            best = net.value.highest(inputs_of(data, off))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(a, end - a), pa.array(net.value.probability(best), pa.float64())], ["_key", "score"])


def score_toxicity(docs: DataFrame, net: Network, key: str = "doc_id") -> DataFrame:
    """key and score (0 to 1) of every row, over all overlapping windows of the whole text.

    Null and wordless texts get the positive rate of the labels. Repeated rows get equal scores, an
    empty table none. Only `key` and `text` are read, so other columns cannot clash.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(net)  # of fixed size, whatever the corpus
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col("text").cast("binary"))
    return rows.mapInArrow(lambda it: _score(sent, it), f"_key {kind}, score double").withColumnRenamed("_key", key)


def _keep(net, at: int, batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [net.value.probability(net.value.highest(inputs_of(data, off))) < 0.5 for _, _, data, off in slices(b.column(at))]
        yield b.filter(pa.array(np.concatenate(ok))) if ok else b


def keep_clean(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of docs, with all columns, that score under 0.5."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda it: _keep(sent, at, it), docs.schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    net = fit(docs, read_table(spark, sf_dir, "labels"))
    out = score_toxicity(docs, net)
    return out.select("doc_id", F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
