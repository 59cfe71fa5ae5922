"""Reading level of each document (problem 9).

Method: a linear pairwise ranker learnt from pairs of graded sample texts, its scores
calibrated into levels by isotonic regression.  Vocabulary features: every word of the
samples has a distribution over the grades it is used in, and a weight, large for words
kept to few grades; a text is described by the weighted mean of its words'
distributions and grades.  Syntax features: mean and largest sentence length, commas,
openers of dependent clauses, long words and nominal endings.  A sample's own words are
left out of the distributions it is described by, so the ranker and its calibration see
it as they will see a new text.  The scale of the syntax features is chosen by
cross-validation.

The samples (a fixed table, ``MAX_SAMPLES`` at most) are fitted on the driver; the
model, two numbers per word and a few more, travels with the scoring function, which
reads every whole text once.

Texts are judged by their sentences: front matter, headings, tables, reference lists,
page marks and citation brackets are left out first.  The language is taken from the
text's function words, whatever its label says.

Defined results: null and blank texts, and texts without a single word, get a null
level and language; a text without any word of the samples is scored by its syntax
alone; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound on the graded samples the ranker is fitted on, by anchor_id; all of their pairs are used.
MAX_SAMPLES = 1000
#: Parts of the cross-validation that chooses the scale of the syntax features, and the scales.
FOLDS, SYNTAX_SCALES = 8, (0.1, 0.3, 1.0)
PENALTY = 1e-3
#: Words whose shape and part a worker remembers.
MEMORY = 200_000
#: Smoothing of a word's distribution, in shares of the median word's mass, and how a
#: word's weight falls with the variance of its grades: (variance + SPREAD) ** -PURITY.
SMOOTHING, SPREAD, PURITY = 0.03, 0.15, 3.0

#: Frequent function words of the languages told apart.
FUNCTION_WORDS = {
    "en": "the of and to in is was were that it for with as at by from which not be has had they them we this an are on",
    "de": "der die das und ist nicht mit dem den des ein eine wurde war bei wir zu auf für wo dass weil im als von sich",
    "fr": "le la les des et est une dans que pour avec où nous du au à car plus un sans sur qui ne pas était l'équipe",
    "es": "el la los las y es una en que para con donde del al por más un sin se no era porque lo su fue durante",
}
_LANGUAGE_OF: dict[str, list[str]] = {}
for _code, _words in FUNCTION_WORDS.items():
    for _word in _words.split():
        _LANGUAGE_OF.setdefault(_word, []).append(_code)

_MARKS = str.maketrans({c: " " for c in ".,;:!?()[]{}\"*/|#<>=_~`•…“”„«»–—\\"})
_FRONT = re.compile(r"\A\s*---\r?\n.*?\n---[ \t]*(?:\r?\n|\Z)", re.S)
_REFERENCES = re.compile(r"^#+\s*(?:references|bibliography|works cited|literature)\b.*?(?=^#|\Z)", re.S | re.M | re.I)
_DROPPED = re.compile(r"^[ \t]*(?:#.*|\|.*|<!--.*?-->.*|[-*•]?[ \t]*[^\W\d][^()\n]{0,80}\(\d{4}[a-z]?\)\.? .*|[-=*_]{3,})[ \t]*$", re.M)
_BRACKETS = re.compile(r"<!--.*?-->|\[[^\[\]]{0,90}\d{4}[a-z]?[^\[\]]{0,20}\]", re.S)
_BULLET = re.compile(r"^[ \t]*(?:[-*•]|\d+[.)])[ \t]+", re.M)
#: Words that open a dependent clause.
_CLAUSE_WORDS = frozenset("that which whose where when whenever because although though if since whereas while whether provided notwithstanding insofar neither nor unless until".split())


def sentences_only(text: str) -> str:
    """The text without what isn't part of its sentences; all of it, if nothing would be left."""
    bare = _FRONT.sub("", text) if text.lstrip()[:3] == "---" else text
    if "#" in bare:
        bare = _REFERENCES.sub("", bare)
    if "#" in bare or "|" in bare or "<!" in bare or "(" in bare:
        bare = _DROPPED.sub("", bare)
    if "[" in bare or "<!" in bare:
        bare = _BRACKETS.sub(" ", bare)
    if "\n" in bare or bare[:2] in ("- ", "* ", "• "):
        bare = _BULLET.sub("", bare)
    return bare if bare.strip() else text


def words_of(text: str) -> Counter:
    return Counter(text.lower().translate(_MARKS).split())


def language(words: Counter) -> str | None:
    """Language with most function words among ``words``; None if it has none of them."""
    votes = dict.fromkeys(FUNCTION_WORDS, 0)
    for word in _LANGUAGE_OF.keys() & words.keys():
        for code in _LANGUAGE_OF[word]:
            votes[code] += words[word]
    best = max(votes, key=lambda code: votes[code])
    return best if votes[best] else None


_STOPS = re.compile(r"[.!?]+(?:\s+|\Z)")
_NOMINAL = ("tion", "ity", "ance", "ence", "ment", "ness", "ism")


def _syntax(text: str, words: Counter) -> list[float]:
    """Mean and largest sentence length, commas, clause openers, letters, long words and nominal endings a word."""
    letters = long = nominal = clauses = 0
    for word, k in words.items():
        size, is_long, is_nominal, is_clause = _shape(word)
        letters += size * k
        if is_long:
            long += k
        if is_nominal:
            nominal += k
        if is_clause:
            clauses += k
    return _rates(text, max(1, words.total()), letters, long, nominal, clauses)


def _shape(word: str) -> tuple[int, bool, bool, bool]:
    size = len(word)
    return size, size >= 10, size >= 7 and word.endswith(_NOMINAL), word in _CLAUSE_WORDS


def _rates(text: str, n: int, letters: int, long: int, nominal: int, clauses: int) -> list[float]:
    sizes = [len(part.split()) for part in _STOPS.split(text)]
    whole = sum(sizes) or n
    return [math.log1p(whole / (sum(map(bool, sizes)) or 1)), math.log1p(max(sizes) or n), text.count(",") / n, clauses / n, letters / n, long / n, nominal / n]


class Ranker:
    """Pairwise linear ranker with isotonic levels; see the module for its features."""

    def __init__(self, texts: list[str], levels: list[int], scales: tuple[float, ...] = SYNTAX_SCALES, folds: int = FOLDS, penalty: float = PENALTY):
        parts = [(t, words_of(t)) for t in map(sentences_only, texts)]
        grades = np.array(levels, dtype=float)
        order = np.random.default_rng(5).permutation(len(parts))
        right = dict.fromkeys(scales, 0.0)
        for k in range(folds if len(scales) > 1 else 0):
            held, rest = order[k::folds], np.sort(np.concatenate([order[j::folds] for j in range(folds) if j != k] or [order[:0]]))
            if not len(held) or len(set(grades[rest])) < 2:
                continue
            features = self._describe([parts[i] for i in rest], grades[rest])
            for scale in scales:
                self._learn(features, grades[rest], scale, penalty)
                right[scale] += float((self.level(np.array([self.score(*parts[i]) for i in held])) == grades[held]).sum())
        #: Share of held-out samples on their own level, by scale of the syntax features.
        self.accuracy = {scale: n / len(parts) for scale, n in right.items()}
        self.scale = max(scales, key=lambda s: right[s])
        self._learn(self._describe(parts, grades), grades, self.scale, penalty)

    def _describe(self, parts: list[tuple[str, Counter]], grades: np.ndarray) -> np.ndarray:
        """Features of the samples, each without its own share in the words' distributions."""
        self.grades = np.unique(grades)
        place = {w: i for i, w in enumerate(sorted({w for _, ws in parts for w in ws}))}
        grade = np.searchsorted(self.grades, grades)
        mass = np.zeros((len(place), len(self.grades)))
        per_grade = np.bincount(grade, minlength=len(self.grades)).astype(float)
        rows = []
        for g, (_, ws) in zip(grade, parts, strict=True):
            at = np.fromiter((place[w] for w in ws), dtype=np.int64, count=len(ws))
            n = np.fromiter(ws.values(), dtype=float, count=len(ws))
            share = n / max(1.0, n.sum())
            mass[at, g] += share / per_grade[g]
            rows.append((at, n, share / per_grade[g]))
        added = SMOOTHING * float(np.median(mass.sum(1))) if len(place) else 1.0
        prior = per_grade / per_grade.sum()

        def described(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(weight, distribution and mean grade) of words with grade masses ``of``."""
            known = of.sum(1) > 1e-12
            spread = (of + added * prior) / (of.sum(1, keepdims=True) + added)
            mean = spread @ self.grades
            variance = np.maximum(0.0, spread @ self.grades**2 - mean**2)
            return known / (variance + SPREAD) ** PURITY, np.column_stack([spread, mean])

        weight, values = described(mass)
        self.words = {w: (float(weight[i]), values[i]) for w, i in place.items()}
        self.nothing = np.append(prior, prior @ self.grades)
        features = []
        for g, (at, n, own), (text, ws) in zip(grade, rows, parts, strict=True):
            others = mass[at]
            others[:, g] -= own
            weight, values = described(others)
            total = float(weight @ n)
            features.append(np.concatenate([(weight * n) @ values / total if total > 0 else self.nothing, _syntax(text, ws)]))
        return np.array(features)

    def _learn(self, features: np.ndarray, grades: np.ndarray, scale: float, penalty: float) -> None:
        centre, spread = features.mean(0), features.std(0) + 1e-9
        n_words = len(self.grades) + 1
        factor = np.where(np.arange(features.shape[1]) < n_words, 1.0, scale) / spread
        weights = pairwise(((features - centre) * factor), grades, penalty)
        slope = weights * factor
        self.word_slope, self.syntax_slope = slope[:n_words], slope[n_words:].tolist()
        self.offset = -float(slope @ centre)
        #: word -> (weight, weight times its part of the score)
        self.word_parts = {w: (weight, weight * float(values @ self.word_slope)) for w, (weight, values) in self.words.items() if weight > 0}
        self.memory: dict[str, tuple] = {}
        self.no_words = float(self.nothing @ self.word_slope)
        self.knots, self.levels = isotonic(features @ slope + self.offset, grades)

    def score(self, text: str, words: Counter) -> float:
        total = value = 0.0
        n = letters = long = nominal = clauses = 0
        memory = self.memory
        for word, k in words.items():
            known = memory.get(word)
            if known is None:
                known = (*_shape(word), *self.word_parts.get(word, (0.0, 0.0)))
                if len(memory) < MEMORY:
                    memory[word] = known
            size, is_long, is_nominal, is_clause, weight, part = known
            n += k
            letters += size * k
            if is_long:
                long += k
            if is_nominal:
                nominal += k
            if is_clause:
                clauses += k
            if weight:
                total += weight * k
                value += part * k
        grammar = sum(x * w for x, w in zip(_rates(text, max(1, n), letters, long, nominal, clauses), self.syntax_slope, strict=True))
        return (value / total if total else self.no_words) + grammar + self.offset

    def level(self, scores: np.ndarray) -> np.ndarray:
        """Nearest level of the isotonic curve at each score."""
        return np.clip(np.rint(np.interp(scores, self.knots, self.levels)), self.grades[0], self.grades[-1])


def pairwise(features: np.ndarray, grades: np.ndarray, penalty: float, rounds: int = 50) -> np.ndarray:
    """Weights of the linear pairwise ranker over all pairs of different grades.

    Minimises the mean logistic loss of score differences, wider apart and weightier for
    wider grades, by Newton steps; the pairs are only ever summed, so all of them count.
    """
    apart = np.maximum(0.0, grades[:, None] - grades[None, :])
    n = max(1, int((apart > 0).sum()))
    weights = np.zeros(features.shape[1])

    def loss(w: np.ndarray) -> float:
        scores = features @ w
        return float((apart * np.logaddexp(0, apart - scores[:, None] + scores[None, :])).sum()) / n + penalty * float(w @ w) / 2

    now = loss(weights)
    for _ in range(rounds):
        scores = features @ weights
        push = 1 / (1 + np.exp(np.clip(scores[:, None] - scores[None, :] - apart, -30, 30)))
        slope, bend = apart * push, apart * push * (1 - push)
        gradient = (slope.sum(0) - slope.sum(1)) @ features / n + penalty * weights
        curve = features.T @ ((bend.sum(0) + bend.sum(1))[:, None] * features - (bend + bend.T) @ features) / n + penalty * np.eye(len(weights))
        step, part = np.linalg.solve(curve, gradient), 1.0
        while part > 1e-4 and (then := loss(weights - part * step)) > now:
            part /= 2
        if part <= 1e-4 or now - then < 1e-9:
            break
        weights, now = weights - part * step, then
    return weights


def isotonic(scores: np.ndarray, values: np.ndarray, weights: np.ndarray | None = None, steps: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step curve closest to ``values`` (pool adjacent violators).

    A knot stands in the middle of each step; with ``steps`` one at both of its ends.
    """
    order = np.argsort(scores, kind="stable")
    weights = np.ones(len(scores)) if weights is None else weights
    pools: list[list[float]] = []
    for s, v, w in zip(scores[order], values[order], weights[order], strict=True):
        pools.append([v, float(w), s, s])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, n2, _, b2 = pools.pop()
            v1, n1, a1, _ = pools.pop()
            pools.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, a1, b2])
    if steps:
        ends = [(x, p[0]) for p in pools for x in dict.fromkeys((p[2], p[3]))]
        return np.array([x for x, _ in ends]), np.array([v for _, v in ends])
    return np.array([(p[2] + p[3]) / 2 for p in pools]), np.array([p[0] for p in pools])


def fit(anchors: DataFrame) -> Ranker | None:
    """Ranker over ``anchors`` (anchor_id, level, text); ``MAX_SAMPLES`` rows at most, by anchor_id.

    None if there are fewer than two levels to tell apart; every level is null then.
    """
    rows = anchors.where("text IS NOT NULL AND level IS NOT NULL").orderBy("anchor_id").select("text", "level").limit(MAX_SAMPLES).collect()
    if len({r["level"] for r in rows}) < 2:
        return None
    return Ranker([r["text"] for r in rows], [int(r["level"]) for r in rows])


def levels(documents: DataFrame, ranker: Ranker | None) -> DataFrame:
    """(doc_id, n_chars, language, score, level) of every row of ``documents``."""

    @F.pandas_udf("language string, score double, level bigint")
    def judge(texts: pd.Series) -> pd.DataFrame:
        spoken, scores = [], []
        for text in texts:
            words = words_of(bare := sentences_only(text)) if text and text.strip() else Counter()
            spoken.append(language(words))
            scores.append(ranker.score(bare, words) if words and ranker else np.nan)
        scores = np.array(scores, dtype=float)
        level = pd.array(ranker.level(np.nan_to_num(scores)).astype("int64") if ranker else [0] * len(scores), dtype="Int64")
        level[np.isnan(scores)] = pd.NA
        return pd.DataFrame({"language": spoken, "score": scores, "level": level})

    judged = documents.select("doc_id", "n_chars", judge("text").alias("j"))
    return judged.select("doc_id", "n_chars", "j.language", "j.score", "j.level")
