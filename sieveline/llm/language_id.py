"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text is read as letters (ASCII lower-cased) and bytes from 128 up; each run of other bytes is one boundary. It is cut into segments, each a run of letters with
the boundary after it, of at most ``SEGMENT`` bytes. The network reads a segment in both directions, with a boundary on each side, and gives every position, boundaries
included, a distribution over the languages; a document's probabilities are the mean over all positions of its whole text. State doesn't cross a boundary: a segment's
sum is a function of its bytes alone, so a worker keeps the sums of up to ``CACHE`` segments, without which reading all bytes in numpy would cost several times the CPU.

The languages are all that labelled documents have. The model is fitted on the driver to at most ``SAMPLE`` labelled documents, shared evenly by the languages and chosen by a
hash of doc_id, of each at most its first ``LONGEST`` characters; it is a few kilobytes whatever the input. Everything else is one pass without a shuffle.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without any labelled document all are ``und``; a null doc_id is held out of
training; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sieveline.llm import common as C

SAMPLE = 1200
#: Characters of a document that are learned from; all of it is judged.
LONGEST = 1 << 15
SEGMENT = 64
CACHE = 300_000
HIDDEN, EMBED = 16, 12
STEPS, BATCH = 500, 96
UNKNOWN = "und"
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def segments(text: str | None) -> list[bytes]:
    parts = (text or "").encode().translate(_FOLD).split()
    if any(len(p) > SEGMENT for p in parts):
        parts = [q for p in parts for q in _cut(p)]
    return parts


def _cut(word: bytes) -> list[bytes]:
    """Pieces of at most SEGMENT bytes; none begins inside a letter."""
    out = []
    while len(word) > SEGMENT:
        at = SEGMENT
        while at > SEGMENT - 4 and 128 <= word[at] < 192:
            at -= 1
        out.append(word[:at])
        word = word[at:]
    return [*out, word] if word else out


def _padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte codes, time by word, boundary (0) on both sides; and a mask of the word's own positions with the boundary after it."""
    length = np.array([len(w) for w in words])
    codes = np.zeros((int(length.max()) + 2, len(words)), np.int64)
    row = np.arange(codes.shape[0])[:, None]
    mask = (row >= 1) & (row <= length[None, :])
    codes.T[mask.T] = np.frombuffer(b"".join(words), np.uint8)
    return codes, (row >= 1) & (row <= length[None, :] + 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights by name; forward, backward and Adam."""

    def __init__(self, languages: list[str], seed: int = 7):
        draw = np.random.default_rng(seed)
        self.languages = languages
        shape = lambda *s: (draw.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {"emb": shape(256, EMBED), "out": shape(2 * HIDDEN, len(languages)), "out_b": np.zeros(len(languages), np.float32)}
        for side in "fb":
            self.w |= {f"{side}x": shape(EMBED, 3 * HIDDEN), f"{side}h": shape(HIDDEN, 3 * HIDDEN), f"{side}b": np.zeros(3 * HIDDEN, np.float32)}

    def _scan(self, side: str, gates: np.ndarray, keep: bool):
        """Gated recurrent units over time, first to last row of gates."""
        n, width, h = gates.shape[0], gates.shape[1], np.zeros((gates.shape[1], HIDDEN), np.float32)
        out, held, wh = np.empty((n, width, HIDDEN), np.float32), [], self.w[f"{side}h"]
        for t in range(n):
            zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + h @ wh[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            g = np.tanh(gates[t, :, 2 * HIDDEN :] + (r * h) @ wh[:, 2 * HIDDEN :])
            if keep:
                held.append((h, z, r, g))
            h = (1 - z) * h + z * g
            out[t] = h
        return out, held

    def forward(self, codes: np.ndarray, keep: bool = False):
        x = self.w["emb"][codes]
        ahead, one = self._scan("f", x @ self.w["fx"] + self.w["fb"], keep)
        back, two = self._scan("b", (x @ self.w["bx"] + self.w["bb"])[::-1], keep)
        state = np.concatenate([ahead, back[::-1]], axis=2)
        logit = state @ self.w["out"] + self.w["out_b"]
        logit -= logit.max(axis=2, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(axis=2, keepdims=True)
        return p, (x, state, one, two)

    def _unscan(self, side: str, grad: np.ndarray, held: list, x: np.ndarray, into: dict) -> np.ndarray:
        wh, dh, gates = self.w[f"{side}h"], np.zeros_like(grad[0]), np.empty((*grad.shape[:2], 3 * HIDDEN), np.float32)
        dwh = np.zeros_like(wh)
        for t in range(len(grad) - 1, -1, -1):
            h, z, r, g = held[t]
            dh = dh + grad[t]
            dg = dh * z * (1 - g * g)
            drh = dg @ wh[:, 2 * HIDDEN :].T
            dz, dr = dh * (g - h) * z * (1 - z), drh * h * r * (1 - r)
            dzr = np.concatenate([dz, dr], axis=1)
            dwh[:, : 2 * HIDDEN] += h.T @ dzr
            dwh[:, 2 * HIDDEN :] += (r * h).T @ dg
            gates[t, :, : 2 * HIDDEN], gates[t, :, 2 * HIDDEN :] = dzr, dg
            dh = dh * (1 - z) + drh * r + dzr @ wh[:, : 2 * HIDDEN].T
        flat = gates.reshape(-1, 3 * HIDDEN)
        into[f"{side}h"], into[f"{side}b"], into[f"{side}x"] = dwh, flat.sum(axis=0), x.reshape(-1, EMBED).T @ flat
        return gates @ self.w[f"{side}x"].T

    def gradients(self, codes: np.ndarray, mask: np.ndarray, label: np.ndarray) -> dict:
        p, (x, state, one, two) = self.forward(codes, True)
        grad = p.copy()
        grad[:, np.arange(len(label)), label] -= 1
        grad *= (mask / mask.sum())[:, :, None].astype(np.float32)
        into = {"out": state.reshape(-1, 2 * HIDDEN).T @ grad.reshape(-1, grad.shape[2]), "out_b": grad.sum(axis=(0, 1))}
        down = grad @ self.w["out"].T
        dx = self._unscan("f", down[:, :, :HIDDEN], one, x, into)
        dx = dx + self._unscan("b", down[::-1, :, HIDDEN:], two, x[::-1], into)[::-1]
        which = np.zeros((256, codes.size), np.float32)
        which[codes.reshape(-1), np.arange(codes.size)] = 1
        return into | {"emb": which @ dx.reshape(-1, EMBED)}

    def fit(self, words: list[bytes], labels: np.ndarray, weight: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        draw, m, v = np.random.default_rng(seed), {}, {}
        upto = np.cumsum(weight) / weight.sum()
        for step in range(1, steps + 1):
            pick = np.minimum(np.searchsorted(upto, draw.random(BATCH)), len(words) - 1)
            codes, mask = _padded([words[i] for i in pick])
            rate = 0.01 * min(1, step / 50) * (1 - 0.9 * step / steps)
            for k, g in self.gradients(codes, mask, labels[pick]).items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def sums(self, words: list[bytes]) -> np.ndarray:
        """Per word the sum of its positions' distributions."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for a in range(0, len(order), 4096):
            part = order[a : a + 4096]
            codes, mask = _padded([words[i] for i in part])
            out[part] = (self.forward(codes)[0] * mask[:, :, None]).sum(axis=0)
        return out


def train(rows: list[tuple[str, str]]) -> Network | None:
    """rows: (text, language)."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    counts = {lang: Counter() for lang in languages}
    for text, lang in rows:
        counts[lang].update(segments(text))
    words = [(w, i, n / max(1, sum(counts[lang].values()))) for i, lang in enumerate(languages) for w, n in sorted(counts[lang].items())]
    model = Network(languages)
    if words:
        model.fit([w for w, _, _ in words], np.array([i for _, i, _ in words]), np.sqrt(np.array([x for _, _, x in words])))
    return model


def held_out(name: str = "doc_id"):
    """Column: crc32 of doc_id as text leaves 1 modulo 3; null counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string")), F.lit(3)) == 1, F.lit(True))


def labelled_sample(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """(text, language) of at most ``sample`` labelled documents outside the held-out part: of each language, those of least hash of doc_id."""
    rows = docs.where("lang is not null and text is not null").where(~held_out()).select("doc_id", F.substring("text", 1, LONGEST).alias("text"), "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return []
    if len(counts) > sample:
        raise ValueError(f"{len(counts)} languages for a sample of {sample}")
    each, bound = sample // len(counts), F.lit(2**63 - 1)
    for lang, n in counts.items():  # rows under a bound that some 2 * each + 100 are expected to meet
        if n > 2 * each + 100:
            bound = F.when(F.col("lang") == lang, F.lit(int((2 * each + 100) / n * 2.0**64) - 2**63)).otherwise(bound)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))
    few = rows.where(F.xxhash64("doc_id") <= bound).withColumn("place", place).where(F.col("place") <= each)
    return [(r["text"], r["lang"]) for r in few.orderBy("lang", "place").select("text", "lang").collect()]


class Table:
    """The sums of the segments that a worker has met."""

    def __init__(self):
        self.key, self.place, self.sums = None, {}, None

    def of(self, model: Network, key: int, texts: list[Counter]) -> list[np.ndarray]:
        """The summed distributions of each text; key tells models apart."""
        if self.key != key or len(self.place) > CACHE:
            self.key, self.place, self.sums = key, {}, np.zeros((0, len(model.languages)), np.float32)
        new = list({w for t in texts for w in t if w not in self.place})
        if new:
            start = len(self.place)
            self.sums = np.concatenate([self.sums, model.sums(new)])
            self.place.update((w, start + i) for i, w in enumerate(new))
        out = []
        for t in texts:
            at = np.fromiter((self.place[w] for w in t), np.int64, len(t))
            out.append(np.fromiter(t.values(), np.float32, len(t)) @ self.sums[at])
        return out


_table = Table()


def table() -> Table:
    return _table


def _judge(model: Network | None, names: tuple[str, str]):
    # a fitted model is told from others by its weights, for the worker's table
    key = 0 if model is None else zlib.crc32(b"".join(model.w[k].tobytes() for k in sorted(model.w)))

    def run(batches):
        for batch in batches:
            texts, langs, scores, size = batch.column("text"), [], [], 0
            todo: list[Counter] = []

            def settle(todo):
                totals = table().of(model, key, todo) if model is not None else [()] * len(todo)
                for words, total in zip(todo, totals, strict=True):
                    if model is None or not words:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    p = total / total.sum()
                    best = int(np.argmax(p))
                    langs.append(model.languages[best])
                    scores.append(float(min(1.0, p[best])))

            for t in texts:
                text = t.as_py()
                todo.append(Counter(segments(text)) if text and any(map(str.isalpha, text)) else Counter())
                size += len(text or "")
                if size > 4 << 20:
                    settle(todo)
                    todo, size = [], 0
            settle(todo)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in batch.schema.names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, *names],
            )

    return run


def identified(docs: DataFrame, sample: int = SAMPLE, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score under the given names, which docs must not have."""
    model = train(labelled_sample(docs, sample))
    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add(names[0], StringType()).add(names[1], DoubleType())
    return docs.mapInArrow(C.thrifty(_judge(model, names)), schema)


def predictions(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    out = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: Least mean probability of the best language that a kept document has.
LEAST_SCORE = 0.4


def accepted(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents in a learned language, with all their columns, whatever the names; those without text or letters (``und``), or without a clear
    language, go. Repeated rows are judged alike and stay repeated; without any labelled document none stays; an empty table stays empty."""
    names = (C.free(docs, "lang_pred"), C.free(docs, "lang_score"))
    return identified(docs, names=names).where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least)).select(*docs.columns)
