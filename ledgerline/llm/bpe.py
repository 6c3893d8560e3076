"""Byte-level BPE over pre-tokens: ids of a text are the ids of its pre-tokens, so each distinct pre-token is encoded once."""

from __future__ import annotations

import json
import os

import numpy as np
import regex

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies of this family.
PIECE = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Outside these blocks the installed libraries' Unicode tables can differ; such texts are split by the tokenizer itself.
ODD = regex.compile(r"[^\x00-՗ -⁯ぁ-ゖァ-ヺ一-龥가-힣]")
MAX_CACHE = 400_000
MAX_WHOLE = 200_000


def check_rules(rules: dict, path: str) -> None:
    """Raises ValueError unless texts are split as this module splits them: byte level with its usual pattern, no normaliser, plain special tokens only."""
    split = rules.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    marks = all(t["special"] and not any(t[k] for k in ("lstrip", "rstrip", "single_word", "normalized")) for t in rules.get("added_tokens") or [])
    if rules.get("normalizer") or not plain or not marks or rules.get("truncation") or rules.get("padding"):
        raise ValueError(f"{path}: only byte-level vocabularies without normaliser, prefix space, truncation, padding and unusual added tokens can be counted by pieces")


class PieceEncoder:
    """Splits texts into pre-tokens and encodes each distinct one once per worker (the cache is bounded)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        check_rules(json.loads(self.tokenizer.to_str()), path)
        self.special = [t.content for t in added.values() if t.special]
        self._splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.cache: dict[str, bytes] = {}
        self._whole = None

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or not ODD.search(text):
            return PIECE.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order; a special token's string is a piece of its own, as the library treats it by default."""
        if self._splitter is None or not any(s in text for s in self.special):
            return self._plain(text)
        return [p for i, part in enumerate(self._splitter.split(text)) for p in ([part] if i % 2 else self._plain(part))]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece by the library; no special tokens are added."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def learn(self, lists: list[list[str]]) -> None:
        new = list(set().union(*lists) - self.cache.keys()) if lists else []
        if len(self.cache) + len(new) > MAX_CACHE:
            self.cache.clear()
            new = list(set().union(*lists))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for piece, ids in zip(part, self.encode_pieces(part), strict=True):
                self.cache[piece] = np.asarray(ids, self.dtype).tobytes()

    def whole(self):
        """A faster encoder of whole plain texts over the same vocabulary, or None where merge order isn't id order.

        The vocabulary's tokens, decoded to bytes, are its ranks: merges in order of ids, as the file's are, give the same ids.
        """
        if self._whole is None:
            import tiktoken

            model = json.loads(self.tokenizer.to_str())["model"]
            vocab, of = model["vocab"], byte_of_char()
            merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
            if merged == sorted(merged) and all(c in of for t in vocab if t not in self.special for c in t):
                ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if token not in self.special}
                self._whole = tiktoken.Encoding("whole", pat_str=PIECE.pattern, mergeable_ranks=ranks, special_tokens={})
            else:
                self._whole = False
        return self._whole or None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as arrays of ``dtype``. Texts that are odd, very long or hold special strings go piece by piece."""
        whole = self.whole()
        plain = [bool(whole) and len(t) <= MAX_WHOLE and (t.isascii() or not ODD.search(t)) and not any(s in t for s in self.special) for t in texts]
        lists = [[] if p else self.pieces(t) for t, p in zip(texts, plain, strict=True)]
        self.learn([x for x in lists if x])
        get = self.cache.__getitem__
        return [
            np.asarray(whole.encode_ordinary(t), self.dtype) if p else np.frombuffer(b"".join(map(get, pieces)), self.dtype)
            for t, p, pieces in zip(texts, plain, lists, strict=True)
        ]


def byte_of_char() -> dict[str, int]:
    """The byte behind each character of byte-level vocabularies: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
