"""Token ids of whole texts, by the tokenizers library.

A text equals the run of its white-space-separated chunks to this vocabulary: white space is dropped and
every match of the pre-tokenizer is encoded on its own. So distinct chunks are encoded once per worker and
kept in a bounded cache. Texts in which a chunk could read differently are encoded whole, and so are all texts where a
vocabulary's file has another normalizer or pre-tokenizer than this one's.
"""

from __future__ import annotations

import json
import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
CACHE = 400_000
#: Texts to encode whole: they may hold special tokens, control characters that Arrow takes for white space,
#: or characters that lower-casing in advance might change otherwise than the tokenizer does.
UNUSUAL = r"<\||[\x{1c}-\x{1f}\x{130}\x{250}-\x{10ffff}]"
#: Stops at the end of a word are matches of their own to the pre-tokenizer.
TAIL = r"([\pL\pN])([.,;:!?]+)(\s|$)"
#: The settings of a vocabulary file under which texts may be encoded by chunks.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Stands between chunks that are encoded together; one id, which only a chunk with this mark can give.
MARK = "^"
_WORKER: dict[str, Encoder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str, end_id: int = END_ID, cache: int = CACHE):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.by_chunk = held.get("normalizer") == NORMALIZER and held.get("pre_tokenizer") == PRE_TOKENIZER
        self.end = end_id
        self.limit = cache
        self.known: dict[str, bytes] = {}
        marks = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = marks[0] if len(marks) == 1 else None

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        """Ids of new chunks, many to a call."""
        if len(self.known) + len(chunks) > self.limit:
            self.known = {}
        alone = [c for c in chunks if MARK in c or self.mark is None]
        self.known.update((c, ids.tobytes()) for c, ids in zip(alone, self._whole(alone)))
        chunks = [c for c in chunks if MARK not in c] if self.mark is not None else []
        for k in range(0, len(chunks), 8192):
            part = chunks[k : k + 8192]
            lines = [part[j : j + 64] for j in range(0, len(part), 64)]
            for own, ids in zip(lines, self._whole([f" {MARK} ".join(x) for x in lines])):
                cut, raw = (4 * np.flatnonzero(ids == self.mark)).tolist(), ids.tobytes()
                self.known.update((c, raw[a + 4 : b]) for c, a, b in zip(own, [-4, *cut], [*cut, len(raw)]))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (uint32), each text's closed by the end id, and n+1 offsets; null is empty."""
        n = len(column)
        column = pc.fill_null(column, "").cast(pa.large_string())
        unusual = np.array(pc.match_substring_regex(column, UNUSUAL), bool)
        if not self.by_chunk:
            unusual[:] = True
        if unusual.any():
            plain = pc.if_else(pa.array(unusual), pa.scalar("", pa.large_string()), column)
        else:
            plain = column
        words = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(plain), TAIL, r"\1 \2\3"))
        at = np.asarray(words.offsets, np.int64)
        coded = words.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = [b"" if not c else self.known.get(c) for c in chunks]
        if new := [k for k, x in enumerate(ids) if x is None]:
            self._learn([chunks[k] for k in new])
            for k in new:
                ids[k] = self.known[chunks[k]]
        end = len(ids)
        ids.append(np.array([self.end], np.uint32).tobytes())
        others = np.flatnonzero(unusual)
        if len(others):
            ids += [x.tobytes() for x in self._whole(column.take(pa.array(others)).to_pylist())]
        # the chunk numbers of each text: its words, what was encoded whole, and the end
        counts = np.diff(at) + 1
        counts[others] = 2
        offsets = np.concatenate(([0], np.cumsum(counts)))
        order = np.full(int(offsets[-1]), end, np.int64)
        keep = np.ones(len(order), bool)
        keep[offsets[1:] - 1] = False
        keep[offsets[others]] = False
        code = np.asarray(coded.indices, np.int64)
        kept = np.repeat(~unusual, np.diff(at))
        order[keep] = code[kept]
        order[offsets[others]] = end + 1 + np.arange(len(others))
        # gather the ids of each chunk number in turn
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, start = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(size) - size
        length = size[order]
        to = np.cumsum(length)
        out = flat[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(start[order] - (to - length), length)]
        return out, np.concatenate(([0], to))[offsets] if n else np.zeros(1, np.int64)


def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """The worker's own encoder, kept between tasks."""
    key = f"{path} {end_id}"
    if key not in _WORKER:
        _WORKER[key] = Encoder(path, end_id)
    return _WORKER[key]
