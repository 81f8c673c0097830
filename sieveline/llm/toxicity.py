"""Toxicity of deobfuscated text: a noisy-channel decoder restores words, then a linear model scores them.

Tokens that look disguised (signs or digits among letters, a letter three or more times in a row, letters set apart one by one)
become lattices: each sign stands for the letters it may mimic or for nothing, a repeated letter for itself or nothing, and between spaced letters a
word may end. Letters count as set apart with marks at them or alone between them ("i d i o t." or "i . d . i"). Chunks of at most ``CHUNK`` letters
in a row ("id iot", "k i ll") also count as each word of up to ``JOINED`` letters that neighbours make together, beside what they are alone. Signs at a token's end count both as marks and as the letters that decoding
finds in them ("a$$"), and a token all of signs that mimic is decoded ("455"). Viterbi decoding takes the path of least channel cost minus log probability under a character trigram model, whose
counts come from all documents (per task arrays of ``SIGNS``**3 counts, added up in Spark). Other words are kept.

The score is a logistic regression over words and word beginnings that the labelled sample marks as telling (by z of their log odds), fitted on the
driver to at most ``SAMPLE`` labelled documents of either class of at most ``LONGEST`` characters, chosen by a hash of doc_id. Scoring is one pass without a shuffle.

Defined results: null text is empty and has the base score; documents whose label is null or missing aren't learned from; of several labels of a doc_id the
greatest counts; without labels of both classes all scores are 0; a null doc_id is not held out and never learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sieveline.llm import common as C

SAMPLE = 2500
#: Characters of the longest document that labels are learned from; longer ones are scored like all others.
LONGEST = 1 << 16
THRESHOLD = 0.3
CACHE = 200_000
#: Letters of a piece that may be a chunk of a word set apart, and of the word; marks alone are part of a run up to so many, too.
CHUNK, JOINED = 3, 16
#: Character classes of the language model: 0 boundary, 1-26 a-z, 27 any other letter.
SIGNS = 28
# Signs and the letters that they commonly mimic.
MIMICS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l"}
_SIGN_COST, _DROP_SIGN, _DROP_REPEAT, _DROP_DOUBLE, _SPLIT = 1.0, 5.0, 0.4, 4.0, 4.0
_DROP_JUNK, _DROP_MARK = 0.2, 2.0  # of signs at a token's end: three or more alike; those that are usual marks there
_TRAIL = ".,;:!?#$%&*|\"'()[]{}<>~_-=+/\\"
_HEAD = ".,;:?#%&*\"'[]{}>~_-=/\\"
_OPENS, _CLOSES = frozenset("\"'([{<"), frozenset(".,;:!?\"')]}>")
_MIMICKING = "".join(MIMICS)
_THRICE = re.compile(r"(.)\1\1")


def sign_of(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27


# ---------------------------------------------------------------- character language model
_CLASS = np.full(256, 0, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[192:] = np.arange(1, 27), np.arange(1, 27), 27  # a lead byte stands for its letter


def _count(batches):
    total = np.zeros(SIGNS**3, np.int64)
    for batch in batches:
        data, offsets = C.text_bytes(batch.column("text"))
        for a, b in C.pieces(offsets):
            part = data[offsets[a] : offsets[b]]
            x = _CLASS[part[(part < 128) | (part >= 192)]]
            x = x[np.append(True, (x[1:] != 0) | (x[:-1] != 0))] if len(x) else x  # one boundary between words
            x = np.concatenate([[0], x, [0]])
            pair = np.where(x[:-1] == 0, 0, x[:-1] * SIGNS) + x[1:]
            first = np.concatenate([[0], x[:-2]])
            first = np.where(x[:-1] == 0, 0, first)  # nothing before a boundary counts
            total += np.bincount(first * SIGNS * SIGNS + pair, minlength=SIGNS**3)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """-ln P(c | a, b) over SIGNS**3, from the counts of all texts, smoothed by pairs and single characters."""
    counts = np.zeros(SIGNS**3)
    for r in docs.select("text").mapInArrow(_count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # SIGNS**3 rows at most
        counts[r["gram"]] = r["n"]
    three = counts.reshape(SIGNS, SIGNS, SIGNS)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SIGNS)
    p2 = (two + 5 * p1[None, :]) / (two.sum(axis=1, keepdims=True) + 5)
    return -np.log((three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5))


# ---------------------------------------------------------------- decoding
def disguised(token: str) -> bool:
    """token: lower case, without marks at its ends."""
    if token.isalpha():
        return _THRICE.search(token) is not None
    letters = sum(map(str.isalpha, token))
    if not letters:
        return False
    return any(c in MIMICS for c in token) or letters < len(token) or any(len(list(g)) > 2 for _, g in groupby(token))


def signs_after(core: str, token: str) -> str:
    """The signs right after the core of a token without marks at its head that may stand for last letters."""
    tail = token[len(core) :]
    return tail[: len(tail) - len(tail.lstrip(_MIMICKING))] if tail else ""


def decode(symbols: str, model: list, spaced: bool = False, tail: int = 0) -> list[str]:
    """The words of least cost; spaced: a word may end after any symbol; tail: so many signs at the end may be mere marks."""
    beam: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    before, runs = "", [(k, len(list(g))) for k, g in groupby(symbols)]
    for i, (s, long) in enumerate((k, n > 2) for k, n in runs for _ in range(n)):
        options: list[tuple[str, float]] = [(s, 0.0)] if s.isalpha() else [(c, _SIGN_COST) for c in MIMICS.get(s, "")] + [("", _DROP_SIGN if s in MIMICS else 0.5)]
        if i >= len(symbols) - tail and (long or s in "!|(<"):
            options.append(("", _DROP_JUNK if long else _DROP_MARK))
        if s == before:
            options.append(("", _DROP_REPEAT if long else _DROP_DOUBLE))
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, said) in beam.items():
            starts = [(a, b, cost, said)]
            if spaced and b:
                starts.append((0, 0, cost + _SPLIT + model[a][b][0], said + " "))
            for letter, price in options:
                for p, q, c, text in starts:
                    if letter:
                        k = sign_of(letter)
                        key, value = (q, k), (c + price + model[p][q][k], text + letter)
                    else:
                        key, value = (p, q), (c + price, text)
                    if key not in new or value < new[key]:
                        new[key] = value
        beam, before = new, s
    return min((cost + model[a][b][0] if b else cost, said) for (a, b), (cost, said) in beam.items())[1].split()


class Pieces(dict):
    """By token that may be a part of a run of pieces: (letters; empty for marks alone, the letter or sign set apart if it is one, whether a mark opens, or closes, a run there).
    Other tokens are only in ``others``."""

    def __init__(self):
        super().__init__()
        self.others: set[str] = set()

    def learn(self, tokens: set[str]) -> None:
        if len(self) + len(self.others) >= CACHE:
            self.clear()
            self.others.clear()
        for token in tokens.difference(self.others):
            if token in self:
                continue
            found = None if len(token) > CHUNK and token.isalpha() else self.part(token)
            if found is None:
                self.others.add(token)
            else:
                self[token] = found

    @staticmethod
    def part(token: str) -> tuple | None:
        low = token.lower()
        tail = low.lstrip(_HEAD)
        core = tail.rstrip(_TRAIL)
        if not core:
            return ("", token if token in MIMICS else "", False, False) if len(token) <= CHUNK else None
        if len(core) == 1 and core in MIMICS or len(core) <= CHUNK and any(map(str.isalpha, core)) and all(c.isalpha() or c in MIMICS for c in core):
            bare = core.lstrip("(<") or core  # a bracket may stand for a letter of a chunk, or open a row
            signs = signs_after(core, tail)
            return (core + signs if len(signs) < 3 else core, bare if len(bare) == 1 else "", bare != core or not _OPENS.isdisjoint(low[: len(low) - len(tail)]), not _CLOSES.isdisjoint(tail[len(core) :]))
        return None


class Restorer:
    """Restored words of texts, with the decoded tokens kept."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.known: dict[str, tuple[str, ...]] = {}
        self.pieces = Pieces()

    def token(self, token: str) -> tuple[str, ...]:
        found = self.known.get(token)
        if found is None:
            low = token.lower().lstrip(_HEAD)
            core = low.rstrip(_TRAIL)
            signs = signs_after(core, low)
            if core.isalpha() and not disguised(core):
                found = (core,)
            elif not any(map(str.isalpha, core)):
                whole = core + signs
                found = tuple(decode(whole, self.model, tail=len(signs))) if core and len(whole) > 1 and all(c in MIMICS for c in whole) else ()
            elif disguised(core):
                found = tuple(decode(core, self.model))
            else:
                found = (core,)
            if signs and any(map(str.isalpha, core)):  # both readings count: the signs as marks, and as the path of least cost has them
                found += tuple(w for w in decode(core + signs, self.model, tail=len(signs)) if w not in found)
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[token] = found
        return found

    def spaced(self, letters: list[str]) -> tuple[str, ...]:
        run = "".join(letters).lower()
        key = f" {run}"
        found = self.known.get(key)
        if found is None:
            short = "".join(k * min(3, len(list(g))) for k, g in groupby(run))
            found = tuple(decode(short, self.model, True))
            if len(key) <= 64:
                self.known[key] = found
        return found

    def words(self, text: str | None) -> Counter:
        tokens = text.split() if text else []
        out: Counter = Counter()
        for t, n in Counter(tokens).items():
            for w in self.token(t):
                out[w] += n
        for run in self.runs(tokens):
            for w in self.apart(run):
                out[w] += 1
        return out

    def runs(self, tokens: list[str]) -> list[tuple]:
        """The longest runs of two or more pieces."""
        self.pieces.learn(set(tokens))
        out = []
        for held, group in groupby(map(self.pieces.get, tokens), bool):
            if held and len(run := tuple(group)) > 1:
                out.append(run)
        return out

    def apart(self, run: tuple) -> list[str]:
        """Words that the pieces of a run make together, each once: those of three or more single letters in a row, and all others that neighbouring chunks join to."""
        rows = self.singles(run)
        found = {w for row in rows for w in self.spaced([run[i][1] for i in row])}
        row_of = {i: k for k, row in enumerate(rows) for i in row}
        chunks = [(i, core) for i, (core, *_) in enumerate(run) if core]
        for n, (i, word) in enumerate(chunks):
            row = row_of.get(i, -1)
            for j, chunk in chunks[n + 1 :]:
                word += chunk
                if len(word) > JOINED:
                    break
                if len(word) < 3 or row >= 0 and row_of.get(j) == row:
                    continue
                if word.isalpha() and not _THRICE.search(word):
                    found.add(word)
                elif any(map(str.isalpha, word)):
                    found.update(self.token(word))
        return sorted(found)

    def singles(self, run: tuple) -> list[list[int]]:
        """Places of letters set apart one by one, three at least. An opening mark begins a row and a closing one ends it, unless the letter before has one as well, as in "i. d. i."."""
        rows: list[list[int]] = [[]]
        closed = False
        for i, (core, letter, opens, closes) in enumerate(run):
            if letter or core:
                if not letter or opens and not closed:
                    rows.append([])
                if letter:
                    rows[-1].append(i)
                    if closes and len(rows[-1]) > 1 and not closed:
                        rows.append([])
                closed = closes
        return [row for row in rows if len(row) >= 3]


# ---------------------------------------------------------------- scoring
def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) > k)]


class Scorer:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.stems = {f[:4] for f in weights}
        self.known: dict[str, tuple[str, ...]] = {}
        self.tokens: dict[str, tuple[str, ...]] = {}
        self.silent: set[str] = set()
        self.runs: dict[tuple, tuple[str, ...]] = {}

    def telling(self, word: str) -> tuple[str, ...]:
        if word[:4] not in self.stems:  # which all features of a word begin with
            return ()
        found = self.known.get(word)
        if found is None:
            found = tuple(f for f in features(word) if f in self.weights)
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = found
        return found

    def told(self, bag: Counter) -> dict[str, int]:
        out: dict[str, int] = {}
        for w, n in bag.items():
            for f in self.telling(w):
                out[f] = out.get(f, 0) + n
        return out

    def told_by(self, tool: Restorer, text: str | None) -> dict[str, int]:
        """As told(tool.words(text)); most tokens tell nothing: they are kept apart, and no others are counted."""
        tokens, out, told = text.split() if text else [], {}, {}
        for t in set(tokens).difference(self.silent):
            found = self.tokens.get(t)
            if found is None:
                found = self.told_of(tool, t)
            if found:
                told[t] = found
        for t, n in Counter(filter(told.__contains__, tokens)).items() if told else ():
            for f in told[t]:
                out[f] = out.get(f, 0) + n
        for run in tool.runs(tokens):
            found = self.runs.get(run)
            if found is None:
                found = tuple(f for w in tool.apart(run) for f in self.telling(w))
                if len(run) <= 8:
                    if len(self.runs) >= CACHE:
                        self.runs.clear()
                    self.runs[run] = found
            for f in found:
                out[f] = out.get(f, 0) + 1
        return out

    def told_of(self, tool: Restorer, token: str) -> tuple[str, ...]:
        """What a token that isn't kept yet tells. A plain word whose stem no feature has isn't even looked up."""
        low = token.lower().lstrip(_HEAD)
        core = low.rstrip(_TRAIL)
        if core.isalpha() and core[:4] not in self.stems and (len(core) == len(low) or low[len(core)] not in MIMICS) and not _THRICE.search(core):
            found = ()
        else:
            found = tuple(f for w in tool.token(token) for f in self.telling(w))
        if len(self.tokens) + len(self.silent) >= CACHE:
            self.tokens.clear()
            self.silent.clear()
        if found:
            self.tokens[token] = found
        else:
            self.silent.add(token)
        return found

    def score(self, told: dict[str, int]) -> float:
        z = self.bias + math.fsum(self.weights[f] * math.log1p(n) for f, n in told.items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[tuple[Counter, int]], odds: float, least_z: float = 3.0, steps: int = 400) -> Scorer | None:
    """rows: restored words and label. odds: of label 1 among all labelled rows, to undo the sample's balance."""
    pos = [b for b, y in rows if y]
    neg = [b for b, y in rows if not y]
    if not pos or not neg:
        return None
    has = [Counter(f for b in side for f in {f for w in b for f in features(w)}) for side in (pos, neg)]
    picked = []
    for f, n in has[0].items():
        m = has[1][f]
        if n >= 2 and (math.log((n + 0.5) / (len(pos) - n + 0.5)) - math.log((m + 0.5) / (len(neg) - m + 0.5))) / math.sqrt(1 / (n + 0.5) + 1 / (m + 0.5)) > least_z:
            picked.append(f)
    picked.sort()
    blank = Scorer(dict.fromkeys(picked, 0.0), 0.0)
    place = {f: i for i, f in enumerate(picked)}
    row, col, val = [], [], []
    for i, (b, _) in enumerate(rows):
        for f, n in blank.told(b).items():
            row.append(i)
            col.append(place[f])
            val.append(math.log1p(n))
    row, col, val = np.array(row, np.int64), np.array(col, np.int64), np.array(val)
    y = np.array([y for _, y in rows], float)
    share = odds / (1 + odds)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w, bias = np.zeros(len(picked)), math.log(odds)
    m, v = np.zeros(len(picked) + 1), np.zeros(len(picked) + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(row, val * w[col], len(y))
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(y)
        g = np.append(np.bincount(col, val * gap[row], len(picked)) + 2e-4 * w, gap.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return Scorer({f: float(x) for f, x in zip(picked, w, strict=True)}, float(bias))


def held_out(name: str = "doc_id"):
    """Column: crc32 of doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Scorer | None]:
    """The character model of all texts and the scorer."""
    model = character_model(docs)
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_y"))
    known = C.stored(known, "labels")
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    chosen = [(r["_id"], r["_y"]) for y in counts for r in known.where(F.col("_y") == y).orderBy(F.xxhash64("_id")).limit(sample).collect()]
    if not chosen:
        return model, None
    few = docs.sparkSession.createDataFrame(chosen, "_id long, _y int")
    few = F.broadcast(few)  # 2 * sample rows of two numbers
    texts = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST).join(few, docs["doc_id"].cast("long") == few["_id"])
    one = texts.groupBy("_id").agg(F.min_by(F.struct("text", "_y"), F.struct(F.xxhash64("text"), "text")).alias("one"))  # rows that repeat a doc_id: one of them
    found = one.orderBy("_id").select("one.text", "one._y").collect()
    tool = Restorer(model)
    return model, fit([(tool.words(r["text"]), r["_y"]) for r in found], counts.get(1, 0) / max(1, counts.get(0, 0)))


def _score(model: np.ndarray, scorer: Scorer | None):
    def run(batches):
        tool = Restorer(model)
        for batch in batches:
            scores = [scorer.score(scorer.told_by(tool, t.as_py())) if scorer else 0.0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model, scorer = train(docs, labels)
    out = docs.mapInArrow(_score(model, scorer), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
