"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. For every language their
probabilities are fitted by expectation maximisation on word counts. A word's
probability in a language is the sum, over all ways to cut it into pieces, of
the product of their probabilities; a forward pass computes it. A text scores the
sum of its words' log probabilities, in every language at once, and each distinct
word is scored once in a worker (the store of words is bounded).

The fit reads a bounded sample: SAMPLE documents a language, those with the
smallest hashes of their ids. All else covers every document.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import STORE_BYTES, free_name, kept_in_worker, slices

SAMPLE, ROUNDS, SMOOTH, FLOOR = 150, 3, 0.05, 1e-9
#: Letters up to which products of probabilities stay in a float's range.
SAFE = 40
WORD = re.compile(r"[^\W\d_]+")
START = "▁"


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


@dataclass
class Model:
    """langs: sorted names. pieces: piece -> its probability in each of them. longest: the most characters of a piece."""

    langs: list[str]
    pieces: dict[str, np.ndarray]

    def __post_init__(self):
        self.longest = max(map(len, self.pieces), default=1)

    def forward(self, word: str) -> np.ndarray:
        """Log probability of ``word`` in each language, summed over all segmentations."""
        s, k = START + word, len(self.langs)
        get, floor = self.pieces.get, np.full(k, FLOOR)
        alpha, shift, longest = [np.ones(k)], 0.0, self.longest
        for j in range(1, len(s) + 1):
            p = get(s[j - 1 : j])
            acc = alpha[j - 1] * (floor if p is None else p)
            for i in range(max(0, j - longest), j - 1):
                p = get(s[i:j])
                if p is not None:
                    acc = acc + alpha[i] * p
            alpha.append(acc)
            if j % 16 == 0:  # long words: keep the numbers in range
                top = acc.max()
                shift += math.log(top)
                for n in range(max(0, j - longest), j + 1):
                    alpha[n] = alpha[n] / top
        return np.log(np.maximum(alpha[-1], 1e-300)) + shift


def expected(spans: list[tuple[int, int, str]], n: int, prob: dict[str, float]) -> list[float]:
    """How often each span is used, summed over all segmentations of ``n`` characters, weighted by their probability."""
    if n <= SAFE:
        fore, back = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for i, j, p in spans:
            fore[j] += fore[i] * prob[p]
        for i, j, p in reversed(spans):
            back[i] += prob[p] * back[j]
        return [fore[i] * prob[p] * back[j] / fore[n] for i, j, p in spans]
    low = float("-inf")  # longer words, by logarithms
    fore, back = [0.0] + [low] * n, [low] * n + [0.0]
    for i, j, p in spans:
        fore[j] = float(np.logaddexp(fore[j], fore[i] + math.log(prob[p])))
    for i, j, p in reversed(spans):
        back[i] = float(np.logaddexp(back[i], math.log(prob[p]) + back[j]))
    return [math.exp(fore[i] + math.log(prob[p]) + back[j] - fore[n]) for i, j, p in spans]


def fit_language(counts: dict[str, int], vocab: set[str]) -> dict[str, float]:
    """Piece probabilities of one language by expectation maximisation over its words."""
    spans: dict[str, list[tuple[int, int, str]]] = {}
    longest = max(map(len, vocab), default=1)
    for w in counts:
        s = START + w
        spans[w] = [(i, j, s[i:j]) for j in range(1, len(s) + 1) for i in range(max(0, j - longest), j) if j - i == 1 or s[i:j] in vocab]
    prob: dict[str, float] = {}
    for x in spans.values():
        for _, _, p in x:
            prob[p] = 0.0
    prob = dict.fromkeys(prob, 1 / max(1, len(prob)))
    for _ in range(ROUNDS):
        seen = dict.fromkeys(prob, 0.0)
        for w, c in counts.items():
            for (_, _, p), x in zip(spans[w], expected(spans[w], len(w) + 1, prob)):
                seen[p] += c * x
        total = sum(seen.values()) + SMOOTH * len(seen)
        prob = {p: (x + SMOOTH) / total for p, x in seen.items()}
    return prob


def fit(df: DataFrame, vocab_path: str, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most ``sample`` labelled documents a language, which alone come to the driver.

    Rows with a null text or label are no examples. The sample is found by hash:
    a first pass counts the labels, a second keeps about twice the bound by a
    threshold and cuts it to the bound, so no task sees a whole language.
    """
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], {})
    near = F.lit(False)
    for lang, n in sizes.items():
        near = near | ((F.col("lang") == lang) & (F.pmod("h", F.lit(1 << 32)) < int(min(1.0, 2 * sample / n + 20 / n) * (1 << 32))))
    w = Window.partitionBy("lang").orderBy("h", "text")
    taken = rows.filter(near).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= sample)
    words = taken.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    counts: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    for r in words.groupBy("lang", "word").count().toLocalIterator():
        counts[r["lang"]][r["word"]] = r["count"]
    vocab = set(vocabulary(vocab_path))
    langs = sorted(counts)
    fitted = [fit_language(counts[x], vocab) for x in langs]
    pieces: dict[str, np.ndarray] = {}
    for k, probs in enumerate(fitted):
        for p, x in probs.items():
            if p not in pieces:
                pieces[p] = np.full(len(langs), FLOOR)
            pieces[p][k] = max(x, FLOOR)
    return Model(langs, pieces)


class PieceTable:
    """Piece hashes -> rows of probabilities, looked up for many substrings at once.

    Substrings are compared by a 64-bit polynomial hash. Rows 0 and 1 stand for
    no piece and for an unknown single character.
    """

    BASE, BITS = np.uint64(0x9E3779B97F4A7C15 | 1), 20

    def __init__(self, model: Model):
        k, self.levels, self.longest = len(model.langs), [], model.longest
        self.prob = np.zeros((len(model.pieces) + 2, k))
        self.prob[1] = FLOOR
        rest = []
        with np.errstate(over="ignore"):
            for n, (piece, p) in enumerate(model.pieces.items(), 2):
                self.prob[n] = p
                h = np.uint64(0)
                for c in piece:
                    h = h * self.BASE + np.uint64(ord(c))
                rest.append((int(h), n))
            while rest:  # a piece whose slot is taken goes to the next level
                slots, keys, later = np.zeros(1 << self.BITS, np.int32), np.zeros(len(self.prob), np.uint64), []
                for h, n in rest:
                    at = self.slot(np.array([h], np.uint64), len(self.levels))[0]
                    if slots[at]:
                        later.append((h, n))
                    else:
                        slots[at], keys[n] = n, h
                self.levels.append((slots, keys))
                rest = later

    def slot(self, h: np.ndarray, level: int) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.BITS - 7 * (level % 6))).astype(np.int64) & ((1 << self.BITS) - 1)

    def rows(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int32)
        for level, (slots, keys) in enumerate(self.levels):
            n = slots[self.slot(h, level)]
            out = np.where((n > 0) & (keys[n] == h), n, out)
        return out

    def forward(self, words: list[str]) -> np.ndarray:
        """Model.forward for words of one length, below 32."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
        codes = np.concatenate([np.full((len(words), 1), ord(START), np.uint32), codes], axis=1).astype(np.uint64)
        size = codes.shape[1]
        with np.errstate(over="ignore"):
            prefix = [np.zeros(len(words), np.uint64)]
            for j in range(size):
                prefix.append(prefix[j] * self.BASE + codes[:, j])
            power = [np.uint64(1)]
            for _ in range(self.longest):
                power.append(power[-1] * self.BASE)
            alpha = [np.ones((len(words), self.prob.shape[1]))]
            for j in range(1, size + 1):
                acc = None
                for i in range(max(0, j - self.longest), j):
                    row = self.rows(prefix[j] - prefix[i] * power[j - i])
                    if j - i == 1:
                        row = np.maximum(row, 1)
                    elif not row.any():
                        continue
                    part = alpha[i] * self.prob[row]
                    acc = part if acc is None else acc + part
                alpha.append(acc)
        return np.log(np.maximum(alpha[-1], 1e-300))


class Scorer:
    """Sums of word scores for texts, with a store of words that is bounded in bytes."""

    def __init__(self, model: Model, most: int = STORE_BYTES):
        self.model, self.most, self.table = model, most, PieceTable(model)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.rows, self.held = np.zeros((1024, len(self.model.langs))), 0

    def add(self, words: set[str]) -> None:
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w), []).append(w)
        for size, same in by_size.items():
            got = self.table.forward(same) if size < 32 else np.array([self.model.forward(w) for w in same])
            first = len(self.index)
            while first + len(same) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[first : first + len(same)] = got
            self.index.update(zip(same, range(first, first + len(same))))
            self.held += len(same) * (size + 160 + 16 * len(self.model.langs))

    def score(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Log probabilities in each language; None for a text without letters."""
        split = [WORD.findall(t.lower()) if t else [] for t in texts]
        if self.held > self.most:
            self.forget()
        fresh: set[str] = set()
        for words in split:
            fresh.update(w for w in words if w not in self.index)
        self.add(fresh)
        get = self.index.__getitem__
        return [self.rows[np.fromiter(map(get, w), np.int64, len(w))].sum(axis=0) if w else None for w in split]


def predict(df: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` (all, if None) and the predicted language and score of every row, from the text alone.

    ``score`` is the posterior probability of the prediction under equal priors.
    A null text, one without letters, or a model without languages gives ``und``
    and 0.0. Equal scores go to the language first in the alphabet. Rows with the
    same or a null id are each scored; an empty table gives no rows. Columns that
    are kept pass through, but ones named as ``names`` are replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    shared = df.sparkSession.sparkContext.broadcast((model.langs, model.pieces))  # at most sample x languages documents' pieces

    which = uuid.uuid4().hex  # this model among those that a worker may meet

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, pieces = shared.value
        scorer = kept_in_worker(f"langid {which}", "scorer", lambda: Scorer(Model(langs, pieces))) if langs else None
        for batch in batches:
            for part in slices(batch):
                texts, found, scores = part.column(0).to_pylist(), [], []
                for got in scorer.score(texts) if scorer else [None] * len(texts):
                    if got is None:
                        found.append("und")
                        scores.append(0.0)
                        continue
                    odds = got - got.max()
                    found.append(langs[int(np.argmax(odds))])
                    scores.append(float(1 / np.exp(odds).sum()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names[1:], *names])

    kept = df.select(*keep)
    schema = StructType([*kept.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return df.select(F.col(text_col).alias(free_name(df, "whole_text")), *kept.columns).mapInArrow(run, schema)


def keep_identified(df: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``df`` with a language, of a posterior of at least ``least``, with all their columns.

    Null texts and those without letters go; null and repeated ids make no
    difference; an empty table, and a model without languages, give no rows.
    """
    lang, score = free_name(df, "lang_pred"), free_name(df, "lang_score")
    scored = predict(df, model, None, text_col, (lang, score))
    return scored.filter((F.col(lang) != "und") & (F.col(score) >= least)).drop(lang, score)
