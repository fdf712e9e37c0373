"""6. Language ID by segmentation-marginalised unigrams.

A language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum over all
its segmentations into pieces, by the forward algorithm; a text's is the product over its words (runs of letters,
lower-cased). Words and texts of any length are taken whole: a long word's sums are kept as logarithms. Training is
expectation-maximisation on the word counts of a bounded sample of labelled documents, all word types of it; how many
documents of a language it has is a parameter.

Defined results: a text that is null or has no letters is "und" with score 0; of languages that are equally likely
the first in the order of their names is taken; without labelled documents all are "und"; a null doc_id or lang is
never learned from; repeated rows get equal results; an empty table gives an empty result; more than LANGUAGES
labels are an error, as the model would not fit a task. Other columns pass through identify(), whatever their names,
but one that has the name of a result is replaced.
"""

from __future__ import annotations

import re
import uuid
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaweave.llm.common import map_rows, small_batches, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"
LANGUAGES = 500
#: Of a word up to that long the sums can't vanish; those of longer ones are kept as logarithms.
SHORT_WORD = 36
#: Words are summed together as long as their longest times their number is no more than that.
CELLS = 200_000
CACHED_WORDS = 400_000
EM_ROUNDS = 3
FLOOR = 1e-7


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


class Pieces(dict):
    """Numbers of the pieces, and a trie of them: its steps are keys (state, letter) in order, and the states they reach."""

    def __init__(self, pieces: dict[str, int]) -> None:
        super().__init__(pieces)
        steps: dict[tuple[int, str], int] = {}
        number = [-1]  # of the piece that ends in a state
        for piece, n in pieces.items():
            state = 0
            for letter in piece:
                if (state, letter) not in steps:
                    steps[state, letter] = len(number)
                    number.append(-1)
                state = steps[state, letter]
            number[state] = n
        keys = np.array([state << 21 | ord(letter) for state, letter in steps], np.int64)
        order = np.argsort(keys)
        self.keys, self.reached, self.number = keys[order], np.fromiter(steps.values(), np.int64, len(steps))[order], np.array(number)

    def __reduce__(self):
        return Pieces, (dict(self),)

    def arcs(self, letters: np.ndarray, at: np.ndarray):
        """For each length in turn: at which places (numbers in `at`) a piece or any one letter starts, and its number."""
        state, which = np.zeros(len(at), np.int64), np.arange(len(at))
        length = 1
        while len(which):
            wanted = state << 21 | letters[at[which] + length - 1]
            step = np.minimum(np.searchsorted(self.keys, wanted), max(len(self.keys) - 1, 0))
            known = self.keys[step] == wanted if len(self.keys) else np.zeros(len(which), bool)
            state = self.reached[step[known]]
            found = np.full(len(which), len(self) if length == 1 else -1)
            found[known] = np.where(self.number[state] >= 0, self.number[state], found[known])
            yield length, which[found >= 0], found[found >= 0]
            which, length = which[known], length + 1


def read_pieces(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i) and not model.is_byte(i)]
    kept = dict.fromkeys(p for p in plain if LETTERS.fullmatch(p.removeprefix(START) or "a"))
    return Pieces({p: i for i, p in enumerate(kept)})


class Lattice:
    """All segmentations of words. An arc is a word, a start, an end and a piece; the last piece is any other letter."""

    def __init__(self, words: list[str], pieces: Pieces) -> None:
        self.n, self.sizes = len(words), np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        self.width = int(self.sizes.max(initial=0)) + 1
        letters = np.frombuffer("".join(f"{START}{w}\0" for w in words).encode("utf-32-le"), "<u4").astype(np.int64)
        of, begin = np.repeat(np.arange(self.n), self.sizes), np.cumsum(self.sizes + 1) - self.sizes - 1
        place = np.arange(len(of)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        arcs = [np.stack([of[i], place[i], place[i] + length, piece]) for length, i, piece in pieces.arcs(letters, begin[of] + place)]
        self.arcs = np.concatenate(arcs, axis=1).astype(np.int32) if arcs else np.zeros((4, 0), np.int32)

    def by(self, k: int) -> list[np.ndarray]:
        """The arcs by their start (1) or end (2)."""
        sorted_ = self.arcs[:, np.argsort(self.arcs[k], kind="stable")]
        cuts = np.searchsorted(sorted_[k], np.arange(self.width + 1))
        return [sorted_[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Logarithms of the sums over all segmentations up to each place."""
        by_end = self.by(2)
        if self.width <= SHORT_WORD + 2:
            alpha = np.zeros((self.width, self.n))
            alpha[0] = 1
            for e in range(1, self.width):
                w, s, _, k = by_end[e]
                alpha[e] = np.bincount(w, alpha[s, w] * p[k], self.n)
            with np.errstate(divide="ignore"):
                return np.log(alpha)
        logs = np.zeros((self.width, self.n))
        for e in range(1, self.width):
            w, s, _, k = by_end[e]
            with np.errstate(divide="ignore"):  # relative to the place before, from which one letter leads here
                logs[e] = logs[e - 1] + np.log(np.bincount(w, np.exp(logs[s, w] - logs[e - 1, w]) * p[k], self.n))
            logs[e, e > self.sizes] = 0  # past the word's end
        return logs

    def backward(self, p: np.ndarray) -> np.ndarray:
        logs = np.full((self.width, self.n), -np.inf)
        logs[self.sizes, np.arange(self.n)] = 0
        by_start = self.by(1)
        for s in range(self.width - 2, -1, -1):
            w, _, e, k = by_start[s]
            here = np.unique(w)
            base = logs[s + 1]
            logs[s, here] = (base + np.log(np.maximum(np.bincount(w, np.exp(logs[e, w] - base[w]) * p[k], self.n), 1e-300)))[here]
        return logs

    def log_sums(self, p: np.ndarray) -> np.ndarray:
        return self.forward(p)[self.sizes, np.arange(self.n)]

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is used, over all segmentations of words that occur so often."""
        alpha, beta = self.forward(p), self.backward(p)
        w, s, e, k = self.arcs
        share = np.exp(alpha[s, w] + beta[e, w] - alpha[self.sizes, np.arange(self.n)][w]) * p[k]
        return np.bincount(k, share * counts[w], len(p))


def batches_of(words: list[str]):
    """Numbers of words that are summed together: those of similar length, as many as CELLS allow."""
    order, at = sorted(range(len(words)), key=lambda i: len(words[i])), 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to - at + 1) * len(words[order[to]]) <= CELLS and (len(words[order[to]]) <= SHORT_WORD) == (len(words[order[at]]) <= SHORT_WORD):
            to += 1
        yield order[at:to]
        at = to


def lattices(words: list[str], pieces: Pieces):
    for some in batches_of(words):
        yield np.array(some), Lattice([words[i] for i in some], pieces)


def learn(words: list[str], counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    """The probability of each piece, and of any other letter, in words that occur so often."""
    parts, p = list(lattices(words, pieces)), np.full(len(pieces) + 1, 1 / (len(pieces) + 1))
    for _ in range(EM_ROUNDS):
        used = sum(lattice.expected(p, counts[some]) for some, lattice in parts)
        p = used / max(used.sum(), 1e-9) + FLOOR
        p /= p.sum()
    return p


def _learn(words, pieces: Pieces):
    words = words.sort_values("word")
    return pd.DataFrame({"lang": words["lang"].iloc[:1].values, "model": [learn(list(words["word"]), words["n"].to_numpy(float), pieces).tobytes()]})


class Scorer:
    def __init__(self, model: dict[str, np.ndarray], pieces: Pieces) -> None:
        self.langs, self.model, self.pieces = list(model), list(model.values()), pieces
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.langs)))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [words_of(t) for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.clear()
        new = [w for w in dict.fromkeys(w for ws in split for w in ws) if w not in self.known]
        if new and self.langs:
            logs = np.zeros((len(new), len(self.langs)))
            for some, lattice in lattices(new, self.pieces):
                logs[some] = np.stack([lattice.log_sums(p) for p in self.model], axis=1)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.logs = np.vstack([self.logs, logs])
        best, score = [], []
        for ws in split:
            if not ws or not self.langs:
                best.append("und"), score.append(0.0)
                continue
            logs = self.logs[np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))].sum(0)
            odds = np.exp(logs - logs.max())
            best.append(self.langs[int(odds.argmax())]), score.append(float(odds.max() / odds.sum()))
        return best, score


def _count_words(batches):
    for batch in batches:
        found: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for w in words_of(text):
                found[lang, w] = found.get((lang, w), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(labelled: DataFrame, sample: int = 1500, vocabulary: str = VOCABULARY) -> tuple[dict[str, np.ndarray], Pieces]:
    """labelled: doc_id, text, lang. About `sample` documents a language, drawn by a hash of doc_id over all of them;
    a task learns from a language's word counts in these, and the driver gets one number a piece and language."""
    small_batches(labelled.sparkSession)
    pieces = read_pieces(vocabulary)
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return {}, pieces
    part = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))))
    drawn = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < part[F.col("lang")] * 1_000_000)
    words = drawn.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def learned(words):
        return _learn(words, pieces)

    models = words.groupBy("lang").applyInPandas(learned, "lang string, model binary").collect()
    return {r["lang"]: np.frombuffer(r["model"], float) for r in sorted(models)}, pieces


_scorers: dict[str, Scorer] = {}


def _identify(batches, names: list[str], out: list[str], model, key: str):
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(*model.value)
    for batch in batches:
        lang, score = _scorers[key](batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=out)


def identify(docs: DataFrame, model: dict[str, np.ndarray], pieces: Pieces) -> DataFrame:
    """docs: text. Adds lang_pred and score (the language's posterior probability under equal priors)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model, pieces))  # one number a piece of the fixed vocabulary and language
    return map_rows(docs, "text", partial(_identify, model=shared, key=uuid.uuid4().hex), "lang_pred string, score double")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.filter("doc_id IS NOT NULL AND NOT held_out"))
    return identify(docs.drop("lang"), *model).drop("text")
