"""Counterfactual-regularised toxicity classifier.

A word's features are the word and its prefixes, hashed; a word's score is the sum of their weights, and a text's
evidence is its highest word score, calibrated by the threshold with the fewest errors. The word weights come from a
logistic regression over the words of each labelled text. For every labelled text that holds identity terms, its loss
also has the squared change of that evidence, and of the regression's own sum, between the text and a copy whose terms
are swapped for others of their language (another one each epoch, seen in training or not), so that naming a group
isn't evidence. No weight is masked.

Bounds: TRAIN_ROWS labelled rows of quality.SAMPLE_BYTES in all at most, of which every word is used; 2**BITS weights.
Cases: null and empty texts get the score of no evidence; without labels of both classes every text gets the share of
label 1 (0 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import ALNUM_TABLE
from .quality import append_scores, labelled_sample

TRAIN_ROWS, BITS, SWAP_PENALTY, EPOCHS = 6000, 18, 2.0, 12
CACHE_WORDS = 150_000

#: Neutral words for groups of people, by language.
IDENTITY_TERMS = {
    "en": "women men girls boys immigrants refugees muslims christians jews hindus buddhists atheists gays lesbians transgender black white asian african american mexican disabled elderly",
    "de": "frauen männer mädchen jungen einwanderer flüchtlinge muslime christen juden schwarze weiße asiaten afrikaner behinderte",
    "fr": "femmes hommes filles garçons immigrés réfugiés musulmans chrétiens juifs noirs blancs asiatiques africains handicapés",
    "es": "mujeres hombres niñas niños inmigrantes refugiados musulmanes cristianos judíos negros blancos asiáticos africanos discapacitados",
}


def word_features(word: bytes) -> list[int]:
    """Hashed features: the word, and its prefixes of 4, 5 and 6 characters."""
    text = word.decode("utf-8", "replace")
    keys = [b"w" + word, *(b"p" + text[:n].encode() for n in (4, 5, 6) if len(text) > n)]
    return [zlib.crc32(k) & ((1 << BITS) - 1) for k in keys]


class ToxicityClassifier:
    def __init__(self, rows: list[tuple[bytes, int]], penalty: float = SWAP_PENALTY):
        self.prior = float(np.mean([y for _, y in rows])) if rows else 0.0
        self.weights = None
        y = np.array([c for _, c in rows], float)
        if not len(y) or y.min() == y.max():
            return
        docs = [sorted(set(t.translate(ALNUM_TABLE).split())) for t, _ in rows]
        words: dict[bytes, int] = {}
        ids = [np.array([words.setdefault(w, len(words)) for w in d], np.int64) for d in docs]
        groups = [[words.setdefault(t.encode(), len(words)) for t in terms.split()] for terms in IDENTITY_TERMS.values()]
        features = [word_features(w) for w in words]
        width = max(map(len, features), default=1)
        table = np.full((len(words), width), 1 << BITS, np.int64)  # the last weight is always 0
        for k, f in enumerate(features):
            table[k, : len(f)] = f
        group_of = {t: g for g in groups for t in g}
        named = {i: [t for t in d.tolist() if t in group_of] for i, d in enumerate(ids)}
        weights, seen = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-2)
        bias, rng = float(np.log(y.mean() / (1 - y.mean()))), np.random.default_rng(7)
        balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        for epoch in range(EPOCHS):
            for i in rng.permutation(len(ids)):
                if not len(ids[i]):
                    continue
                rows_ = table[ids[i]]
                z = bias + weights[rows_].sum()
                g = balance[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i])
                if abs(g) >= 1e-3:
                    f = rows_.reshape(-1)
                    np.add.at(seen, f, g * g)
                    np.subtract.at(weights, f, 0.3 * g / np.sqrt(seen[f]))
                    weights[-1] = 0
                if named[i] and penalty:
                    other = self._swapped(ids[i], named[i], group_of, epoch)
                    self._even_out(weights, table, ids[i], other, penalty)
            weights *= 0.97
        self.weights = weights[:-1].astype(np.float32)
        word_score = weights[table].sum(axis=1)
        x = np.array([self._evidence(word_score[k]) for k in ids])
        self.cut, self.slope = self._calibrate(x, y)

    @staticmethod
    def _swapped(ids: np.ndarray, named: list[int], group_of: dict[int, list[int]], epoch: int) -> np.ndarray:
        """The words of a text with each identity term replaced by another of its language."""
        swap = {}
        for t in named:
            g = group_of[t]
            swap[t] = g[(g.index(t) + 1 + epoch % (len(g) - 1)) % len(g)]
        return np.unique([swap.get(t, t) for t in ids.tolist()])

    @classmethod
    def _even_out(cls, weights: np.ndarray, table: np.ndarray, own: np.ndarray, other: np.ndarray, penalty: float) -> None:
        """A gradient step on the squared changes between a text and its copy: of the evidence, then of the sum."""
        scores = [weights[table[k]].sum(axis=1) for k in (own, other)]
        tops = [k[[int(s.argmax())]] for k, s in zip((own, other), scores, strict=True)]
        for a, b in (tops, (np.setdiff1d(own, other), np.setdiff1d(other, own))):
            f = np.r_[table[a].reshape(-1), table[b].reshape(-1)]
            sign = np.r_[np.ones(table[a].size), -np.ones(table[b].size)]
            change = float((weights[f] * sign).sum())
            keys, at = np.unique(f, return_inverse=True)
            slope = np.bincount(at, sign)  # of the change, by weight; what both hold has none
            slope[keys == len(weights) - 1] = 0
            if (norm := float(slope @ slope)) > 0:
                weights[keys] -= min(0.2 * penalty, 1.0) * change / norm * slope

    @staticmethod
    def _evidence(scores: np.ndarray) -> float:
        return float(scores.max()) if len(scores) else 0.0

    @staticmethod
    def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """The threshold with the fewest errors, in the middle of its gap, and a slope from the spread around it."""
        order = np.argsort(x, kind="stable")
        xs, ys = x[order], y[order]
        errors = np.r_[0, np.cumsum(ys)] + np.r_[(1 - ys).sum(), (1 - ys).sum() - np.cumsum(1 - ys)]
        ties = np.r_[True, xs[1:] > xs[:-1], True]
        errors = np.where(ties, errors, np.inf)
        k = int(np.argmin(errors))
        lo, hi = xs[max(k - 1, 0)], xs[min(k, len(xs) - 1)]
        return float((lo + hi) / 2), float(4 / (x.std() + 1e-9))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_known"}

    def forget(self) -> None:
        self.__dict__.pop("_known", None)

    def score(self, text: bytes) -> float:
        if self.weights is None:
            return self.prior
        known = self.__dict__.setdefault("_known", {})
        if len(known) > CACHE_WORDS:
            known.clear()
        words = set(text.translate(ALNUM_TABLE).split())
        best = -np.inf if words else 0.0
        for w in words:
            s = known.get(w)
            if s is None:
                s = known[w] = float(self.weights[word_features(w)].sum())
            if s > best:
                best = s
        return float(1 / (1 + np.exp(-np.clip(self.slope * (best - self.cut), -30, 30))))


def train(docs: DataFrame, labels: DataFrame, keep, label: str = "toxic", rows: int = TRAIN_ROWS) -> ToxicityClassifier:
    return ToxicityClassifier(labelled_sample(docs, labels, label, keep, rows))


__all__ = ["ToxicityClassifier", "append_scores", "train"]
