import json

import pyarrow as pa

from episodica.llm import tokens

TEXTS = ["A plain text, isn't it?", "Ünïcode 123 and more", None, "", "a ^ b  c", "x" * 500]


def test_a_file_with_other_settings_is_encoded_whole(tmp_path):
    with open(tokens.vocabulary_path()) as f:
        held = json.load(f)
    assert tokens.Encoder(tokens.vocabulary_path()).by_chunk
    held["normalizer"] = {"type": "NFC"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(held))
    encoder = tokens.Encoder(str(path))
    assert not encoder.by_chunk
    ids, offsets = encoder.encode(pa.array(TEXTS, pa.string()))
    for text, a, b in zip(TEXTS, offsets[:-1], offsets[1:]):
        assert ids[a:b].tolist() == [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]
