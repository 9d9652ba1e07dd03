"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import regex

MEMO_ENTRIES = 600_000
LONG_CHUNK = 64
WORD_END = "</w>"
# Outside these ranges libraries may know different versions of Unicode: such chunks are encoded
# by the tokenizer alone.
_UNSURE = re.compile("[^\x00-\u024f\u0391-\u03c9\u0400-\u045f\u3041-\u3096\u4e00-\u9fa5\uac00-\ud7a3]").search


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Encode texts chunk by chunk, chunks being what stands between ASCII white space.

    It gives the ids of the whole text for tokenizers that drop white space, split at it and mark
    the ends of words, as the word-end vocabulary does. The first MEMO_ENTRIES short chunks and
    words are remembered; others are encoded each time they come. Chunks are split into words by
    the tokenizer's own pattern, and many words are encoded at once and told apart by their last
    ids. Ids are kept as little-endian 32-bit numbers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        patterns = [p["pattern"]["Regex"] for p in form["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self._words = regex.compile(patterns[0]).findall
        self._special = [t["content"] for t in form["added_tokens"]]
        self._ends = np.zeros(self._tokenizer.get_vocab_size(), dtype=bool)
        self._ends[[i for t, i in self._tokenizer.get_vocab().items() if t.endswith(WORD_END)]] = True
        self._chunks: dict[bytes, bytes] = {}
        self._word_ids: dict[str, bytes] = {}

    def _is_unsure(self, chunk: bytes) -> bool:
        text = chunk.decode("utf-8", "replace")
        return bool(_UNSURE(text)) or any(s in text for s in self._special)

    def _one_by_one(self, chunks: list[bytes]) -> list[bytes]:
        texts = [c.decode("utf-8", "replace") for c in chunks]
        found = self._tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _encode_words(self, words: list[str]) -> list[bytes] | None:
        ids = np.array(self._tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        cuts = np.flatnonzero(self._ends[ids]) + 1
        if len(cuts) != len(words):
            return None
        raw, at = ids.tobytes(), (4 * cuts).tolist()
        return [raw[i:j] for i, j in zip([0, *at], at, strict=False)]

    def _encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        joined = b" ".join(chunks).decode("utf-8", "replace")
        if _UNSURE(joined) or any(s in joined for s in self._special):
            unsure = [c for c in chunks if self._is_unsure(c)]
            ids = dict(zip(unsure, self._one_by_one(unsure), strict=True))
            plain = [c for c in chunks if c not in ids]
            ids.update(zip(plain, self._encode_chunks(plain) if plain else [], strict=True))
            return [ids[c] for c in chunks]
        parts = self._tokenizer.normalizer.normalize_str(joined).split(" ")
        if len(parts) != len(chunks):
            return self._one_by_one(chunks)
        split = list(map(self._words, parts))
        known = self._word_ids
        new = list({w for words in split for w in words if w not in known})
        if new:
            found = self._encode_words(new)
            if found is None:
                return self._one_by_one(chunks)
            known.update(zip(new, found, strict=True))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        full = len(known) > MEMO_ENTRIES
        for word in new:
            if full or len(word) > LONG_CHUNK:
                del known[word]
        return out

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        split = [(t or b"").split() for t in texts]
        memo = self._chunks
        new = list({c for words in split for c in words if c not in memo})
        if new:
            memo.update(zip(new, self._encode_chunks(new), strict=True))
        out = [np.frombuffer(b"".join(map(memo.__getitem__, words)), dtype="<u4") for words in split]
        full = len(memo) > MEMO_ENTRIES
        for chunk in new:
            if full or len(chunk) > LONG_CHUNK:
                del memo[chunk]
        return out


@lru_cache(2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker and file."""
    return ChunkEncoder(path)
