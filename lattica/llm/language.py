"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy by backpropagation through time.

Each direction has update and reset gates and a candidate state. A byte enters through a table of what it adds to the three; the states of
both directions at a byte give a distribution over the languages at that byte, and a document's distribution is the mean over all its
bytes. Texts are read whole, in stretches of STRETCH bytes that each start from the zero state, many at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, free_name, tidy

HIDDEN, STRETCH, UNDETERMINED = 8, 128, "und"
#: The training sample: snippets of each language at most, and characters of a snippet.
SNIPPETS, SNIPPET_CHARS = 800, 160
#: Rows of a language that are looked at for each snippet.
MARGIN = 1.25


@dataclass
class Network:
    """table: 2 directions x 256 bytes x (update, reset, candidate); state: 2 x 3H x H; out: 2H x languages; bias: languages."""

    languages: list[str]
    table: np.ndarray
    state: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(languages: list[str], seed: int = 5, hidden: int = HIDDEN, kind=np.float32) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(kind)
        return Network(languages, draw(2, 256, 3 * hidden, scale=0.3), draw(2, 3 * hidden, hidden, scale=hidden**-0.5), draw(2 * hidden, len(languages), scale=0.3), np.zeros(len(languages), kind))

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.state, self.out, self.bias]


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all positions of windows x (windows x bytes) with languages y, and its gradients, back through every step."""
    b, t_max = x.shape
    h_n = net.state.shape[2]
    states = np.zeros((2, t_max, b, h_n), net.table.dtype)
    kept: list[list] = [[None] * t_max, [None] * t_max]
    for d in (0, 1):
        h, u = np.zeros((b, h_n), net.table.dtype), net.state[d]
        for t in range(t_max) if d == 0 else range(t_max - 1, -1, -1):
            a, g = net.table[d][x[:, t]], h @ u.T
            z, r = _sigmoid(a[:, :h_n] + g[:, :h_n]), _sigmoid(a[:, h_n : 2 * h_n] + g[:, h_n : 2 * h_n])
            q = g[:, 2 * h_n :]
            n = np.tanh(a[:, 2 * h_n :] + r * q)
            kept[d][t] = (h, z, r, q, n)
            h = n + z * (h - n)
            states[d, t] = h
    both = np.concatenate([states[0], states[1]], axis=2)
    logits = both @ net.out + net.bias
    p = np.exp(logits - logits.max(2, keepdims=True))
    p /= p.sum(2, keepdims=True)
    rows = np.arange(b)
    loss = -np.log(np.maximum(p[:, rows, y], 1e-12)).mean()
    p[:, rows, y] -= 1
    p /= b * t_max
    d_out, d_bias, d_both = np.einsum("tbh,tbl->hl", both, p), p.sum((0, 1)), p @ net.out.T
    d_table, d_state = np.zeros_like(net.table), np.zeros_like(net.state)
    for d in (0, 1):
        u, dh, steps = net.state[d], np.zeros((b, h_n), net.table.dtype), np.empty((t_max, b, 3 * h_n), net.table.dtype)
        for t in range(t_max - 1, -1, -1) if d == 0 else range(t_max):
            h, z, r, q, n = kept[d][t]
            dh = dh + d_both[t, :, d * h_n : (d + 1) * h_n]
            dn, dz = dh * (1 - z) * (1 - n * n), dh * (h - n) * z * (1 - z)
            dr, dq = dn * q * r * (1 - r), dn * r
            steps[t] = np.concatenate([dz, dr, dn], 1)
            back = np.concatenate([dz, dr, dq], 1)
            d_state[d] += back.T @ h
            dh = dh * z + back @ u
        order = np.argsort(x.T.ravel(), kind="stable")
        sorted_bytes = x.T.ravel()[order]
        cut = np.flatnonzero(np.concatenate([[True], sorted_bytes[1:] != sorted_bytes[:-1]]))
        d_table[d][sorted_bytes[cut]] = np.add.reduceat(steps.reshape(-1, 3 * h_n)[order], cut)
    return float(loss), [d_table, d_state, d_out.astype(net.out.dtype), d_bias.astype(net.bias.dtype)]


def train(snippets: list[bytes], labels: list[str], steps: int = 260, batch: int = 192, span: int = 48, rate: float = 0.02, seed: int = 5) -> Network:
    """Adam on windows of `span` bytes, each language as often as any other."""
    languages = sorted(set(labels))
    net, rng = Network.fresh(languages, seed), np.random.default_rng(seed)
    if len(languages) < 2:
        return net
    by = [[np.frombuffer(s, np.uint8) for s, label in zip(snippets, labels) if label == name and s] for name in languages]
    by = [x or [np.frombuffer(b" ", np.uint8)] for x in by]
    mean, square = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(languages), batch)
        x = np.empty((batch, span), np.uint8)
        for i, label in enumerate(y):
            s = by[label][rng.integers(len(by[label]))]
            at = rng.integers(max(1, len(s) - span + 1))
            x[i] = np.resize(s[at : at + span], span)
        _, grads = gradients(net, x, y)
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(net.parameters(), grads, mean, square):
            g *= min(1.0, 1.0 / max(size, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


class Reader:
    """Runs a network over many stretches at once. Gates are computed as tanh of half their input, so the halves go into the weights."""

    def __init__(self, net: Network):
        h = net.state.shape[2]
        half = np.concatenate([np.full(2 * h, 0.5), np.ones(h)]).astype(np.float32)
        self.h, self.net = h, net
        self.table = [np.ascontiguousarray((net.table[d] * half).T.astype(np.float32)) for d in (0, 1)]
        self.state = [np.ascontiguousarray(net.state[d].astype(np.float32) * 0.5) for d in (0, 1)]  # the candidate's half is the reset gate's
        self.out, self.bias = np.ascontiguousarray(net.out.T.astype(np.float32)), net.bias.astype(np.float32)[:, None]

    def _step(self, d: int, bytes_now: np.ndarray, h: np.ndarray) -> np.ndarray:
        k, n = self.h, h.shape[1]
        g = np.empty((3 * k, n), np.float32)
        index = bytes_now.astype(np.intp)
        for i, row in enumerate(self.table[d]):
            np.take(row, index, out=g[i], mode="clip")
        u = self.state[d] @ h
        gates = g[: 2 * k]
        gates += u[: 2 * k]
        np.tanh(gates, out=gates)
        gates += 1  # twice the gates
        new, q = g[2 * k :], u[2 * k :]
        q *= gates[k:]
        new += q
        np.tanh(new, out=new)
        h = h - new
        h *= gates[:k]
        h *= 0.5
        h += new
        return h

    def probabilities(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The mean over the bytes of each text (texts x languages); zero for empty ones."""
        size = np.diff(offsets)
        pieces = -(-size // STRETCH)
        text = np.repeat(np.arange(len(size)), pieces)
        part = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = offsets[:-1][text] + part * STRETCH
        length = np.minimum(STRETCH, offsets[1:][text] - begin)
        order = np.argsort(-length, kind="stable")
        begin, length, text = begin[order], length[order], text[order]
        active = np.searchsorted(-length, -np.arange(STRETCH), "left")  # stretches that have a byte t
        total = np.zeros((len(self.net.languages), len(text)), np.float32)
        most = int(length[0]) if len(length) else 0
        forward, h = [], np.zeros((self.h, len(text)), np.float32)
        for t in range(most):
            h = self._step(0, raw[begin[: active[t]] + t], h[:, : active[t]])
            forward.append(h)
        h = np.zeros((self.h, 0), np.float32)
        for t in range(most - 1, -1, -1):
            n = active[t]
            h = self._step(1, raw[begin[:n] + t], np.concatenate([h, np.zeros((self.h, n - h.shape[1]), np.float32)], 1))
            logits = self.out[:, : self.h] @ forward[t]
            logits += self.out[:, self.h :] @ h
            logits += self.bias
            np.minimum(logits, 60, out=logits)
            np.exp(logits, out=logits)
            logits /= logits.sum(0)
            total[:, :n] += logits
        out = np.zeros((len(size), len(self.net.languages)))
        for j in range(out.shape[1]):
            out[:, j] = np.bincount(text, total[j], minlength=len(size))
        return out / np.maximum(size, 1)[:, None]


def held_out(key: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", snippets: int = SNIPPETS) -> Network:
    """Trains on at most `snippets` snippets of each language: of rows that are not held out and have an id, a text and a language, those
    with the smallest hashes, each cut out at a place its hash names. Without such rows the network has no languages. Languages are the
    classes of the network, so there are few.

    Rows are counted by language first; only those whose hash is among the lowest MARGIN x snippets to be expected, the same rows
    however the table is partitioned, are looked at closer, so no task or language gathers more than that."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).where(F.col("k").isNotNull() & F.col("t").isNotNull() & F.col("l").isNotNull())
    rows = rows.where(~held_out("k"))
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([], [])
    # hashes are even over 64 bits, the sign included
    bound = {name: min((1 << 63) - 1, int(MARGIN * snippets / n * 2.0**64) - (1 << 63)) for name, n in counts.items()}
    below = F.create_map(*[F.lit(x) for pair in bound.items() for x in pair])
    rows = rows.withColumn("h", F.xxhash64(F.col("k").cast("string"), F.lit(17))).where(F.col("h") <= below[F.col("l")])
    at = F.pmod(F.shiftright("h", 20), F.greatest(F.length("t") - SNIPPET_CHARS, F.lit(0)) + 1) + 1
    cut = F.substring("t", at.cast("int"), F.lit(SNIPPET_CHARS))
    found = rows.select("l", "h", cut.alias("s")).groupBy("l", "h").agg(F.min("s").alias("s")).orderBy("l", "h").collect()
    taken: dict[str, list] = {}
    for r in found:
        if len(taken.setdefault(r.l, [])) < snippets:
            taken[r.l].append(r.s.encode())
    return train([s for x in taken.values() for s in x], [name for name, x in taken.items() for _ in x])


def predict(docs: DataFrame, net: Network, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs with lang_pred and score (or `names`), the probability of lang_pred. lang_pred is `und` with score 0 where the text
    is null or has no letter, and everywhere if the network has no languages; with one language that is the prediction. Columns of
    these names are replaced; repeated rows are judged alike; an empty table stays empty."""
    docs = docs.drop(*names)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    languages, columns = np.array([*net.languages, UNDETERMINED], object), [*docs.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, reader = regex.compile(r"\p{L}"), Reader(net)
        for batch in batches:
            begin, offsets = 0, buffers(batch.column(at))[1]
            while begin < len(batch):
                end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + (1 << 18), "right")) - 1)
                rows, begin = batch.slice(begin, end - begin), end
                p = reader.probabilities(*buffers(rows.column(at))) if net.languages else np.zeros((len(rows), 1))
                best = p.argmax(1)
                score = p[np.arange(len(rows)), best]
                none = np.array([not net.languages or t is None or letter.search(t) is None for t in rows.column(at).to_pylist()], bool)
                best[none], score[none] = len(net.languages), 0.0
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(languages[best].tolist(), pa.string()), pa.array(np.clip(score, 0.0, 1.0))], columns)

    return docs.mapInArrow(tidy(run), schema)


def recognised(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of docs whose language is determined with a probability of at least `least`, with the columns of docs, whatever their names.
    A bilingual text has about half for each of its languages, so the default drops texts of no language only. Null and empty texts and
    those without a letter are of no language and go; repeated rows go or stay together; without languages to learn from, or
    without rows, nothing is left."""
    names = tuple(free_name(docs, n) for n in ("lang_pred", "score"))
    rows = predict(docs, fit(docs), names=names)
    return rows.where((F.col(names[0]) != UNDETERMINED) & (F.col(names[1]) >= least)).select(*docs.columns)
