"""Operator 2, toxicity by compression distance.

Separate zstandard dictionaries are trained on toxic and on ordinary text. Texts are cut into windows of a few words, and
each window is compressed twice: with the ordinary dictionaries alone and with the toxic ones beside them. What the toxic
ones save, in bytes, is the window's distance. Windows end by marks that both sides know, so that their last words are searched too.

A toxic text is mostly ordinary, so its dictionaries are trained in rounds: after each, the windows whose distance
exceeds what nearly all ordinary windows reach are the samples of the next. Texts are dealt to folds, and the
windows of a fold are measured with dictionaries of the other folds only. Thresholds are calibrated on
labelled texts that trained no dictionary: each distance gets the log ratio of its shares among toxic and ordinary windows,
and a text's sum of these, over the root of its number of windows, gets a probability by a logistic curve whose two numbers are
fitted on the same texts, each label weighted by its true share. Sizes of windows and dictionaries are those of SETTINGS that
order the calibration texts best (area under the curve; ties: the first): longer windows tell more where examples are many,
single words where they are a few hundred.

The model is fitted on at most ``sample`` labelled rows of each label (a parameter), read whole. Every document is scored over its
whole text, in one pass without shuffles.

Defined results: null and empty texts, and texts of white space, score as a text without windows; very long texts are windows like others (a
word of more than ``LONGEST`` bytes is several words); without labelled rows of both kinds every score is the share of label 1
(0.5 with no rows); where samples are too few for a dictionary of its size a smaller one is trained, and where they are too few for
any, they are its content themselves; repeated documents get equal scores, and of a labelled document's rows with one id the least text teaches;
equal distances are equal whatever their window; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, read_table, slices

THRESHOLD = 0.3
LONGEST = 64
PIECE = re.compile(rb"\S{1,%d}" % LONGEST)
#: Closes every dictionary and every window: the last bytes of what is compressed aren't searched.
FRAME = bytes(range(1, 25))
FOLDS = 4
#: Windows whose lengths a worker keeps.
KEPT = 1 << 17
LEAST, MOST = -10, 20  # distances beyond count as these
PARAMETERS = dict(strategy=zstandard.STRATEGY_BTLAZY2, min_match=4, search_log=5, chain_log=18, hash_log=17, window_log=18, target_length=32)
_WORKER: dict[bytes, object] = {}


@dataclass(frozen=True)
class Setting:
    """Words of a window, and of one in training (short ones hold less that is ordinary); segment and piece of zstandard's trainer; share of
    ordinary windows below the bar of a round; bytes of the ordinary dictionary, and of the toxic ones by round; whether the windows that a text
    keeps are one sample, so that single words, too short to train on, stand together."""

    words: int
    sample_words: int
    segment: int
    piece: int
    below: float
    ordinary: int
    toxic: tuple[int, ...]
    joined: bool = False


SETTINGS = (Setting(6, 2, 12, 8, 0.998, 1 << 17, (8192, 4096, 4096, 3072, 3072)), Setting(1, 1, 32, 6, 0.99, 1 << 16, (16384, 8192, 4096, 3072, 3072), joined=True))


def windows(text: str | None, words: int = SETTINGS[0].words) -> list[bytes]:
    pieces = PIECE.findall((text or "").lower().encode())
    return [b" " + b" ".join(pieces[k : k + words]) + b" " for k in range(0, len(pieces), words)]


def train_dictionary(samples: list[bytes], size: int, setting: Setting = SETTINGS[0]) -> bytes:
    """A dictionary trained by zstandard, of half the size while samples are too few; in the end their own different ones, longest last."""
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, k=setting.segment, d=setting.piece).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b"".join(sorted(set(samples), key=lambda w: (len(w), w)))


def lengths(content: bytes):
    """The compressed length of a window with this dictionary, loaded as content: a byte no match covers costs a byte."""
    parameters = zstandard.ZstdCompressionParameters(**PARAMETERS, write_content_size=False, write_checksum=False, write_dict_id=False)
    held = zstandard.ZstdCompressionDict(content + FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=parameters)
    compress = zstandard.ZstdCompressor(compression_params=parameters, dict_data=held).compress

    def measure(own: list[bytes]) -> np.ndarray:
        of = {w: len(compress(w + FRAME)) for w in dict.fromkeys(own)}
        return np.fromiter(map(of.__getitem__, own), np.int64, len(own))

    return measure


def _of(texts: list[str], words: int) -> list[bytes]:
    return [w for t in texts for w in windows(t, words)]


def toxic_dictionaries(toxic: list[str], ordinary: list[str], base: bytes, setting: Setting) -> bytes:
    """The toxic dictionaries that the last round leads to, one for each fold, end to end. `ordinary` sets the bars."""
    texts = [[windows(t, setting.sample_words) for t in toxic[i::FOLDS]] for i in range(FOLDS)]
    folds = [[w for own in fold for w in own] for fold in texts]
    others = [_of(ordinary[i::FOLDS], setting.sample_words) for i in range(FOLDS)]
    plain = lengths(base)
    before, before_others = [plain(own) for own in folds], [plain(own) for own in others]
    pieces = lambda fold: [x for own in fold if own for x in ([b"".join(own)] if setting.joined else own)]
    trained = lambda size: [train_dictionary([w for j in range(FOLDS) if j != i for w in samples[j]], size, setting) for i in range(FOLDS)]
    samples = [pieces(fold) for fold in texts]
    for size in setting.toxic:
        both = [lengths(base + d) for d in trained(size)]
        bar = np.quantile(np.concatenate([b - f(own) for b, f, own in zip(before_others, both, others)]), setting.below) if any(others) else 0.0
        far = [iter((b - f(own) > bar).tolist()) for b, f, own in zip(before, both, folds)]
        kept = [pieces([[w for w in own if next(marks)] for own in fold]) for fold, marks in zip(texts, far)]
        if not all(kept):
            break
        samples = kept
    return b"".join(trained(setting.toxic[-1]))


@dataclass
class ToxicityModel:
    """Contents of the dictionaries, log ratio of each distance from LEAST to MOST, and the curve's slope and height."""

    ordinary: bytes
    toxic: bytes
    words: int = SETTINGS[0].words
    ratio: np.ndarray = field(default_factory=lambda: np.zeros(MOST - LEAST + 1))
    slope: float = 0.0
    height: float = 0.0

    def distances(self, own: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionaries save in each window. The worker keeps its last model's, and what it measured last."""
        key = self.ordinary + b"\0" + self.toxic
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = lengths(self.ordinary), lengths(self.ordinary + self.toxic), {}
        plain, both, held = _WORKER[key]
        new = [w for w in dict.fromkeys(own) if w not in held]
        found = dict(zip(new, np.clip(plain(new) - both(new), LEAST, MOST).tolist()))
        out = np.fromiter((found[w] if w in found else held[w] for w in own), np.int64, len(own))
        if len(held) + len(found) > KEPT:
            held.clear()
        if len(found) <= KEPT:
            held.update(found)
        return out

    def measured(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Distances of all texts' windows, end to end, and each text's number of windows."""
        own = [windows(t, self.words) for t in texts]
        return self.distances([w for x in own for w in x]), np.array([len(w) for w in own], np.int64)

    def evidence(self, distances: np.ndarray, n: np.ndarray) -> np.ndarray:
        values, ends = np.concatenate(([0.0], np.cumsum(self.ratio[distances - LEAST]))), np.cumsum(n)
        return (values[ends] - values[ends - n]) / np.sqrt(n + 5)

    def score(self, column: pa.Array) -> np.ndarray:
        texts = column.to_pylist()
        evidence = self.evidence(*self.measured(texts)) if self.slope else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.height, -30, 30)))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and height of the logistic curve, by Newton's method with a light ridge on the slope."""
    a = np.column_stack([x, np.ones(len(x))])
    at, ridge = np.zeros(2), np.diag([1e-3, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ at, -30, 30)))
        step = np.linalg.solve((a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + ridge, a.T @ (weight * (y - p)) - ridge @ at)
        at = at + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(at[0]), 1e-9), float(at[1])


def _area(score: np.ndarray, toxic: int) -> float:
    """Area under the curve; the first `toxic` scores are of label 1."""
    ordinary = np.sort(score[toxic:])
    return float((np.searchsorted(ordinary, score[:toxic], "left") + np.searchsorted(ordinary, score[:toxic], "right")).sum()) / (2 * toxic * len(ordinary))


def fit(rows: list[tuple[str, int]], share: float | None = None, settings: tuple[Setting, ...] = SETTINGS) -> ToxicityModel:
    """Two of three texts of a label train the dictionaries, the rest calibrates and chooses the setting; share: of label 1 among all labelled rows."""
    toxic, ordinary = [t for t, y in rows if y], [t for t, y in rows if not y]
    share = (len(toxic) / len(rows) if rows else 0.5) if share is None else share
    if not toxic or not ordinary:
        return ToxicityModel(b"", b"", height=float(np.log(np.clip(share, 1e-4, 1 - 1e-4) / np.clip(1 - share, 1e-4, 1))))
    rest = [own[2::3] or own for own in (toxic, ordinary)]
    training = [[t for k, t in enumerate(own) if k % 3 < 2] for own in (toxic, ordinary)]
    y = np.repeat([1.0, 0.0], [len(rest[0]), len(rest[1])])
    weight = np.where(y > 0, share / len(rest[0]), (1 - share) / len(rest[1])) * len(y)
    best, found = -1.0, None
    for setting in settings:
        base = train_dictionary(_of(training[1], setting.words), setting.ordinary, setting)
        model = ToxicityModel(base, toxic_dictionaries(training[0], rest[1], base, setting), setting.words)
        measured = [model.measured(texts) for texts in rest]
        counts = [np.bincount(d - LEAST, minlength=MOST - LEAST + 1) + 0.5 for d, _ in measured]
        ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
        model.ratio = np.round(ratio * 2**20) / 2**20  # so that sums are exact, whatever stands beside a text in its batch
        evidence = np.concatenate([model.evidence(*m) for m in measured])
        if (area := _area(evidence, len(rest[0]))) > best:
            best, found = area, model
            model.slope, model.height = _curve(evidence, y, weight)
    return found


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, rest: int = 2, sample: int = 3000) -> ToxicityModel:
    parts = [labelled_sample(docs, labels.filter(F.col(label) == y), label, folds, rest, sample) for y in (0, 1)]
    found = reduce(DataFrame.union, parts).toArrow()
    rows = sorted(zip(found["doc_id"].to_pylist(), found["label"].to_pylist(), found["text"].to_pylist()))
    share = labels.filter(F.col(label).isin(0, 1) & ~held_out("doc_id", folds, rest)).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return fit([(t, y) for _, y, t in rows], share)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and the score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(batch.column("text")), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
