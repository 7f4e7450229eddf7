import random

import numpy as np
import pyarrow as pa
import zstandard

from episodica.llm import toxicity

RNG = random.Random(3)
SYLLABLES = ["ka", "lo", "mi", "ter", "ven", "shu", "dra", "pel", "on", "ist"]
BAD = ["grobianisch", "zyxwortig", "quarkhirn"]


def text(bad, n):
    words = ["".join(RNG.choices(SYLLABLES, k=RNG.randint(1, 4))) for _ in range(n)]
    return " ".join(RNG.choice(BAD) if bad and RNG.random() < 0.06 else w for w in words)


ROWS = [(text(k % 3 == 0, RNG.randint(20, 200)), int(k % 3 == 0)) for k in range(360)]


def test_scores_are_those_of_a_plain_recomputation():
    model = toxicity.fit(ROWS)
    assert model.ordinary and model.toxic and model.slope > 0

    def size(content, window):
        parameters = zstandard.ZstdCompressionParameters(**toxicity.PARAMETERS, write_content_size=False, write_checksum=False, write_dict_id=False)
        held = zstandard.ZstdCompressionDict(content + toxicity.FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(compression_params=parameters, dict_data=held).compress(window + toxicity.FRAME))

    def score(t):
        words, at = [], []
        for w in (t or "").lower().encode().split():
            words += [w[k : k + toxicity.LONGEST] for k in range(0, len(w), toxicity.LONGEST)]
        total, n = 0.0, 0
        for k in range(0, len(words), model.words):
            window = b" " + b" ".join(words[k : k + model.words]) + b" "
            saved = min(max(size(model.ordinary, window) - size(model.ordinary + model.toxic, window), toxicity.LEAST), toxicity.MOST)
            total, n = total + model.ratio[saved - toxicity.LEAST], n + 1
            at.append(saved)
        return 1 / (1 + np.exp(-(model.slope * total / np.sqrt(n + 5) + model.height)))

    texts = [text(k % 2, 60) for k in range(12)] + [None, "", " \n", "é" * 300, "Ka LO " + BAD[0].upper(), text(True, 3000)]
    got = model.score(pa.array(texts, pa.string()))
    assert np.allclose(got, [score(t) for t in texts])
    assert got[12] == got[13] == got[14]
    one = np.concatenate([model.score(pa.array([t], pa.string())) for t in texts])
    assert np.array_equal(got, one)


def test_every_labelled_text_is_read_whole():
    """What is said only at the very end of long texts is learnt and found."""
    rows = [(text(False, 800) + (" " + " ".join(RNG.choices(BAD, k=12)) if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(180)]
    model = toxicity.fit(rows)
    probe = [text(False, 800) + " " + " ".join(RNG.choices(BAD, k=12)) for _ in range(20)] + [text(False, 812) for _ in range(20)]
    got = model.score(pa.array(probe))
    assert (got[:20] >= toxicity.THRESHOLD).mean() >= 0.9 and (got[20:] >= toxicity.THRESHOLD).mean() <= 0.1


def test_two_models_in_one_worker():
    other = toxicity.fit([(t, 1 - y) for t, y in ROWS])
    model = toxicity.fit(ROWS)
    column = pa.array([t for t, _ in ROWS[:40]])
    first = model.score(column)
    other.score(column)
    assert np.array_equal(model.score(column), first)


def test_one_label_only():
    assert np.allclose(toxicity.fit([("a b", 1)] * 3).score(pa.array(["x", None])), 1, atol=1e-3)
    assert np.allclose(toxicity.fit([], 0.25).score(pa.array(["x"])), 0.25)
    assert np.allclose(toxicity.fit([]).score(pa.array(["x"])), 0.5)


def test_a_few_hundred_texts_with_one_toxic_word_in_a_hundred():
    rng = random.Random(12)
    common = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(900)]
    bad = ["grobianisch", "zyxwort", "quarkig", "vuxel", "hzzmno"]
    text = lambda share: " ".join(rng.choice(bad) if rng.random() < share else rng.choice(common[: rng.choice([60, 900])]) for _ in range(rng.randint(150, 400)))
    rows = [(text(0.012 if k % 6 == 0 else 0.0), int(k % 6 == 0)) for k in range(900)]
    model = toxicity.fit(rows[:600])
    y, score = np.array([y for _, y in rows[600:]]), model.score(pa.array([t for t, _ in rows[600:]]))
    assert (score[y == 1] >= toxicity.THRESHOLD).mean() >= 0.6 and (score[y == 0] >= toxicity.THRESHOLD).mean() < 0.05


def test_few_samples_get_a_smaller_dictionary():
    assert 0 < len(toxicity.train_dictionary([b" one ", b" two words "], 4096)) < 4096
    assert toxicity.train_dictionary([b" a ", b" longer one ", b" a "], 4096) == b" a  longer one "
