"""Byte-level BPE from a tokenizers file: whole-token proof, counts and ids."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

from .common import file_bytes

#: The byte-level pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a worker's cache holds before it starts anew.
CACHE_ENTRIES = 400_000


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    table.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))})
    return table


@lru_cache(maxsize=2)
def prove_whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and that the library encodes, alone, as exactly that one token.

    Offline and once a process: the set depends on the vocabulary file alone, whose size bounds it.
    """
    tok = Tokenizer.from_file(path)
    alphabet, pat = byte_alphabet(), regex.compile(PATTERN)
    strings, ids = [], []
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    for piece, i in vocab.items():
        try:
            s = bytes(alphabet[c] for c in piece).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        m = pat.match(s)
        if m and m.end() == len(s):
            strings.append(s)
            ids.append(i)
    got = tok.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, i, e in zip(strings, ids, got, strict=True) if e.ids == [i])


def _understood(spec: dict) -> bool:
    """Whether the file asks for nothing but what :class:`ByteBpe` does."""
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    odd = any(a.get(flag) for a in added for flag in ("lstrip", "rstrip", "single_word", "normalized") if not (flag == "normalized" and not spec.get("normalizer")))
    parts = ("ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "dropout", "unk_token", "byte_fallback")
    return bool(plain) and not odd and not spec.get("normalizer") and not any(model.get(p) for p in parts)


class ByteBpe:
    """Ids and counts of texts under a byte-level BPE file, equal to the tokenizers library's on that file.

    The file's merges are checked to stand in the order of their ids; then the lowest id wins a merge, which is the rule
    of the merging core used here (the library's own is several times slower on new words). Special strings inside a
    text are matched first, as the library does by default.
    """

    def __init__(self, vocabulary: str | bytes, whole: frozenset[str] = frozenset()):
        """``vocabulary``: the file's path, or its bytes, as executors get it."""
        spec = json.loads(file_bytes(vocabulary) if isinstance(vocabulary, str) else vocabulary)
        if not _understood(spec):
            raise ValueError("the vocabulary file asks for more than byte-level BPE with plain added tokens")
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        made = [vocab["".join(p)] for p in pairs]
        if made != sorted(made):
            raise ValueError("merges are not in the order of their ids")
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in vocab.items()}
        self.whole, self.pat, self.cache = whole, regex.compile(PATTERN), {}
        self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.single = self.core._core_bpe.encode_single_piece
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens") or []}
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        if self.cut is None or not any(s in text for s in self.special):
            return [(text, None)]
        return [(s, self.special.get(s)) for s in self.cut.split(text) if s]

    def ids(self, text: str | None) -> np.ndarray:
        found = [np.array([i], np.uint32) if i is not None else self.core.encode_to_numpy(s, disallowed_special=()) for s, i in self.segments(text or "") if s]
        return np.concatenate(found) if len(found) > 1 else found[0] if found else np.zeros(0, np.uint32)

    def count(self, text: str | None) -> int:
        """Pre-tokens in the proven set count one; the rest are merged, through a bounded cache."""
        n, whole, cache = 0, self.whole, self.cache
        for segment, special in self.segments(text or ""):
            if special is not None:
                n += 1
                continue
            for w in self.pat.findall(segment):
                if w in whole:
                    n += 1
                    continue
                k = cache.get(w)
                if k is None:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    k = cache[w] = len(self.single(w.encode("utf-8")))
                n += k
        return n
