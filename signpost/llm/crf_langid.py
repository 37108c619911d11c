"""Language ID by a linear-chain conditional random field over words.

Each word of a line gets a language. Its features are affixes of one to three characters, character pairs and triples,
and the whole word if the training lexicon knows it; transitions between neighbouring words' languages are learned too.
Forward-backward gives every word's probabilities; a document's language is the one with the largest sum over its words
that hold a letter, and its score that sum's share.

Training text is cut into word sequences and joined across languages, so that the field sees switches; it is fitted by
Adam on the exact likelihood, on at most `max_pieces` word sequences from at most `max_docs` documents of each language, drawn by
hash. A sequence is a line's words, at most `MAX_RUN` at a time; every word of every text is labelled.

Defined cases: texts that are null or hold no letter are `und` with score 0; rows without language are not learned from;
without any learned language every row is `und`; repeated rows are labelled alike; ties go to the first language in code
point order; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost.llm.common import written

MAX_DOCS = 400
MAX_PIECES = 2_500
#: Words per training sequence before two are joined.
PIECE = 24
MAX_RUN = 96
MAX_FEATURES = 40_000
#: Words whose scores a task keeps before it starts anew; results do not depend on it.
KNOWN_WORDS = 200_000
#: Hashes that decide on a sample lie below this.
UNIT = 2**31
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER = re.compile(r"[^\W\d_]")


def word_features(word: str) -> list[str]:
    w = word.strip(".,;:!?*#$%&()\"'").lower() or word
    out = ["w" + w, "a" + w[:1], "b" + w[:2], "c" + w[:3], "x" + w[-1:], "y" + w[-2:], "z" + w[-3:]]
    out += ["2" + w[i : i + 2] for i in range(len(w) - 1)]
    out += ["3" + w[i : i + 3] for i in range(len(w) - 2)]
    return out


def runs_of(text: str) -> list[list[str]]:
    """Word sequences of a text: lines, cut after MAX_RUN words."""
    out = []
    for line in text.split("\n"):
        w = WORD.findall(line)
        out += [w[i : i + MAX_RUN] for i in range(0, len(w), MAX_RUN)]
    return out


def forward_backward(emit: np.ndarray, length: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Posteriors (n, t, k), expected transitions (k, k) and log likelihood norms of padded sequences.

    emit: (n, t, k) scores, rows sorted by falling length. Scaled sums, so long sequences do not underflow.
    """
    n, t, k = emit.shape
    top = emit.max(2, keepdims=True)
    e = np.exp(emit - top)
    move = np.exp(trans)
    alpha, scale = np.zeros((n, t, k)), np.ones((n, t))
    live = [int((length > i).sum()) for i in range(t)]
    a = np.exp(start) * e[:, 0]
    scale[:, 0] = a.sum(1)
    alpha[:, 0] = a / scale[:, 0, None]
    for i in range(1, t):
        m = live[i]
        a = (alpha[:m, i - 1] @ move) * e[:m, i]
        scale[:m, i] = a.sum(1)
        alpha[:m, i] = a / scale[:m, i, None]
    beta = np.ones((n, t, k))
    pairs = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        m = live[i + 1]
        nxt = e[:m, i + 1] * beta[:m, i + 1] / scale[:m, i + 1, None]
        beta[:m, i] = nxt @ move.T
        pairs += (alpha[:m, i].T @ nxt) * move
    inside = np.arange(t)[None, :] < length[:, None]
    norm = ((np.log(scale) + top[:, :, 0]) * inside).sum()
    return alpha * beta * inside[:, :, None], pairs, norm


class Field:
    """Learned weights; a few MB, so it travels with every task. A task keeps the scores of words it has met."""

    def __init__(self, langs: list[str], index: dict[str, int], weights: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.langs, self.index, self.weights, self.trans, self.start = langs, index, weights, trans, start
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.emit = np.zeros((0, len(self.langs)))
        self.lettered = np.zeros(0, bool)

    def emissions(self, vocabulary: list[str]) -> np.ndarray:
        """Scores (words, languages): sums of the known features' weights, all words at once."""
        get = self.index.get
        flat: list[int] = []
        sizes = np.zeros(len(vocabulary), np.int64)
        for i, w in enumerate(vocabulary):
            found = [j for f in word_features(w) if (j := get(f)) is not None]
            sizes[i] = len(found)
            flat += found
        owner = np.repeat(np.arange(len(vocabulary)), sizes)
        rows = self.weights[flat]
        sums = [np.bincount(owner, rows[:, k], len(vocabulary)) for k in range(len(self.langs))]
        return np.stack(sums, axis=1) if len(vocabulary) else self.emit[:0]

    def _coded(self, runs: list[list[str]]) -> list[np.ndarray]:
        """Word numbers of the runs; scores of new words are worked out."""
        if len(self.ids) > KNOWN_WORDS:
            self._forget()
        ids = self.ids
        coded = [np.fromiter((ids.setdefault(w, len(ids)) for w in r), np.int64, len(r)) for r in runs]
        new = list(islice(ids, len(self.emit), None))
        self.emit = np.concatenate([self.emit, self.emissions(new)])
        self.lettered = np.concatenate([self.lettered, np.fromiter((LETTER.search(w) is not None for w in new), bool, len(new))])
        return coded

    def _labelled(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per text the posteriors of its words in order, and which words hold a letter."""
        runs, cuts = [], [0]
        for t in texts:
            runs += runs_of(t or "")
            cuts.append(len(runs))
        coded = self._coded(runs)
        found: list[np.ndarray] = [self.emit[:0]] * len(runs)
        order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
        for s in range(0, len(order), 512):
            rows = order[s : s + 512]
            length = np.array([len(coded[i]) for i in rows])
            padded = np.zeros((len(rows), int(length[0])), np.int64)
            for j, i in enumerate(rows):
                padded[j, : length[j]] = coded[i]
            post, _, _ = forward_backward(self.emit[padded], length, self.trans, self.start)
            for j, i in enumerate(rows):
                found[i] = post[j, : length[j]]
        joined = lambda parts, none: [np.concatenate([none, *parts[x:y]]) for x, y in zip(cuts, cuts[1:])]  # noqa: E731,B905
        return joined(found, self.emit[:0]), joined([self.lettered[c] for c in coded], self.lettered[:0])

    def label_words(self, texts: list[str | None]) -> list[np.ndarray]:
        """Per text the (words, languages) posteriors of all its words in order."""
        return self._labelled(texts)[0]

    def label_texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) per text."""
        out = []
        for post, lettered in zip(*self._labelled(texts), strict=True):
            if not lettered.any():
                out.append(("und", 0.0))
                continue
            share = post[lettered].mean(0)
            out.append((self.langs[int(share.argmax())], float(min(1.0, share.max()))))
        return out


def fit_field(pairs: list[tuple[str, str]], *, epochs: int = 4, rate: float = 0.05, batch: int = 64) -> Field | None:
    """Fit on (word sequence, language); None without one. Sequences are joined two by two, whatever their languages."""
    rng = np.random.default_rng(11)
    langs = sorted({lang for _, lang in pairs})
    runs = [(r, langs.index(lang)) for text, lang in pairs for r in runs_of(text)]
    if not runs:
        return None
    seen = Counter(f for r, _ in runs for w in r for f in word_features(w))
    index = {f: i for i, (f, c) in enumerate(x for x in seen.most_common(MAX_FEATURES) if x[1] > 1)}
    k = len(langs)
    rng.shuffle(runs)
    half = len(runs) // 2
    mixed = [(a + b, [x] * len(a) + [y] * len(b)) for (a, x), (b, y) in zip(runs[:half], runs[half : 2 * half], strict=True)]
    mixed = mixed or [(r, [x] * len(r)) for r, x in runs]
    w = [np.zeros((len(index) + 1, k)), np.zeros((k, k)), np.zeros(k)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    known: dict[str, list[int]] = {}
    step = 0
    for _ in range(epochs):
        for s in range(0, len(mixed), batch):
            step += 1
            part = sorted(mixed[s : s + batch], key=lambda x: -len(x[0]))
            length = np.array([len(x[0]) for x in part])
            t = int(length[0])
            emit, gold = np.zeros((len(part), t, k)), np.zeros((len(part), t, k))
            feats, rows = [], []
            trans_gold, start_gold = np.zeros((k, k)), np.zeros(k)
            for i, (seq, tags) in enumerate(part):
                for j, word in enumerate(seq):
                    f = known.get(word)
                    if f is None:
                        f = known[word] = [index[x] for x in word_features(word) if x in index]
                    feats += f
                    rows += [i * t + j] * len(f)
                gold[i, np.arange(len(seq)), tags] = 1
                np.add.at(trans_gold, (tags[:-1], tags[1:]), 1)
                start_gold[tags[0]] += 1
            feats_a, rows_a = np.array(feats, np.int64), np.array(rows, np.int64)
            flat = emit.reshape(-1, k)
            np.add.at(flat, rows_a, w[0][feats_a])
            post, moves, _ = forward_backward(emit, length, w[1], w[2])
            diff = (post - gold).reshape(-1, k)
            g0 = np.zeros_like(w[0])
            np.add.at(g0, feats_a, diff[rows_a])
            grads = [g0 / len(part), (moves - trans_gold) / len(part), (post[:, 0].sum(0) - start_gold) / len(part)]
            for i, g in enumerate(grads):
                g = g + 1e-4 * w[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6)
    return Field(langs, index, w[0], w[1], w[2])


def _shares(rows: DataFrame, counted: Column, most: int) -> Column:
    """Below which hash a row of a language is kept, so that about 2 * most are. There are as many languages as the field has."""
    counts = rows.groupBy("lang").agg(counted.alias("n")).collect()
    limits = [(F.lit(r.lang), F.lit(min(1.0, 2 * most / max(1, r.n)) * UNIT)) for r in counts]
    return F.create_map(*[x for pair in limits for x in pair])[F.col("lang")] if limits else F.lit(0.0)


def train(docs: DataFrame, learnable: Column, *, max_docs: int = MAX_DOCS, max_pieces: int = MAX_PIECES) -> Field | None:
    """Fit on at most max_docs documents of each language, and on max_pieces of their word sequences, both by hash.

    Hashes below a share of the language's count give about twice as many, of which the driver keeps the smallest.
    """
    usable = docs.where(learnable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("lang", "doc_id", "text")
    drawn = usable.select("lang", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(UNIT)).alias("u"))
    drawn = drawn.where(F.col("u") < _shares(usable, F.approx_count_distinct("doc_id"), max_docs)).distinct().toPandas()
    if drawn.empty:
        return None
    drawn = drawn.sort_values(["lang", "u", "doc_id"]).groupby("lang").head(max_docs)
    chosen = docs.sparkSession.createDataFrame(drawn[["doc_id"]].drop_duplicates())
    # max_docs ids per language
    texts = written(usable.join(F.broadcast(chosen), "doc_id", "left_semi").dropDuplicates(["doc_id", "lang"]), "language-sample")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc_id, lang, text in zip(b["doc_id"], b["lang"], b["text"], strict=True):
                pieces = [r[i : i + PIECE] for r in runs_of(text or "") for i in range(0, len(r), PIECE)]
                if pieces:
                    yield pd.DataFrame({"doc_id": doc_id, "at": range(len(pieces)), "lang": lang, "piece": [" ".join(p) for p in pieces]})

    rows = texts.mapInPandas(cut, "doc_id long, at long, lang string, piece string")
    rows = rows.withColumn("u", F.pmod(F.xxhash64("doc_id", "at", "piece"), F.lit(UNIT)))
    found = rows.where(F.col("u") < _shares(rows, F.count(F.lit(1)), max_pieces)).toPandas()
    found = found.sort_values(["lang", "u", "piece"]).groupby("lang").head(max_pieces)
    return fit_field(sorted(zip(found["piece"], found["lang"], strict=True)))


def label_documents(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, lang_pred and score of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b["text"])
            found = [x for i in range(0, len(texts), 400) for x in field.label_texts(texts[i : i + 400])]
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    slim = docs.select("doc_id", "text")
    if field is None:
        return slim.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return slim.mapInPandas(run, "doc_id long, lang_pred string, score double")
