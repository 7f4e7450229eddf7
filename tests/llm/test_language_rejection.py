import random

import numpy as np
import pyarrow as pa

from episodica.llm import language_id

RNG = random.Random(5)
#: Languages of the model, and one that shares a few trigrams with them.
STEMS = {"aa": ["kal", "mor", "tun", "sil", "vek"], "bb": ["öst", "ügr", "äln", "ßar", "wöh"], "cc": ["qui", "que", "eau", "oux", "ais"]}
OTHER = ["kal", "zyp", "jíw", "hłb", "ngx", "rdź", "pfo"]


def words(stems, n):
    return ["".join(RNG.choices(stems, k=RNG.randint(1, 3))) for _ in range(n)]


def test_unlearned_languages_go_and_short_clean_texts_stay():
    langs = RNG.choices(list(STEMS), k=300)
    texts = [" ".join(words(STEMS[v], RNG.randint(10, 60))) for v in langs]
    texts[7] = "".join(RNG.choices("0123456789abcdef", k=60)) + " kal"  # one outlier must not set the threshold
    langs[7] = "aa"
    model = language_id.fit(texts, langs, features=400)
    odd = [" ".join(words(OTHER, n)) for n in (8, 40, 400)] + ["".join(RNG.choices("0123456789abcdef", k=400)), "".join(RNG.choices("ABCDEFGHIJKLMNOPqrstuvwxyz0123456789+/", k=800)), "人人生而自由在尊严和权利上一律平等", "kal " + "人人生而自由 " * 9]
    _, score, rejected = language_id.predict(model, pa.array(odd))
    assert rejected.all(), list(zip(odd, score))
    for n in (2, 4, 8, 60, 2000):
        clean = [(v, " ".join(words(STEMS[v], n))) for v in STEMS for _ in range(20)]
        names, _, rejected = language_id.predict(model, pa.array([t for _, t in clean]))
        assert rejected.mean() <= 0.02 and np.mean([a == v for a, (v, _) in zip(names, clean)]) > 0.97
    again = [v + " " + " ".join(["mor"] * 500) for v in ("kal tun", "sil vek")]
    assert not language_id.predict(model, pa.array(again))[2].any()
