"""Token ids, and the bytes each token stands for, by a tokenizer file of the tokenizers library.

Where the file is plain byte-level BPE whose merges stand in the order of their ids, tiktoken's engine is run over the
same vocabulary: it gives the same ids (tests hold it against tokenizers) in about a quarter of the time. Any other file
is run by tokenizers itself, and its offsets tell the spans. As in tokenizers, a string of an added token in a text, such
as `<|endoftext|>`, is that token; nothing else is added.
"""

from __future__ import annotations

import functools
import json

import numpy as np


def byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in byte-level BPE files: itself if printable, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Encoder:
    """Text to ids. ``sizes`` holds the bytes that each id stands for, where ids alone tell them, else None."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbols, vocab = byte_symbols(), spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        ranks = {bytes(symbols[c] for c in token): i for token, i in vocab.items() if token not in added and all(c in symbols for c in token)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"].get("merges", ())]
        before = spec.get("pre_tokenizer") or {}
        plain = (
            spec["model"]["type"] == "BPE"
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not spec.get("normalizer")
            and len(ranks) == 256 + len(merges)
            and all(vocab.get(a + b) == 256 + n for n, (a, b) in enumerate(merges))
            and not any(x.get(k) for x in spec.get("added_tokens", ()) for k in ("lstrip", "rstrip", "single_word"))
        )
        if plain:
            import public_tokenizers
            import tiktoken

            self.sizes = np.zeros(max([*ranks.values(), *added.values()]) + 1, np.int64)
            for token, i in [*ranks.items(), *((text.encode(), i) for text, i in added.items())]:
                self.sizes[i] = len(token)
            engine = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
            strings = tuple(added)

            def encode(text: str) -> list[int]:
                if any(x in text for x in strings):
                    return engine.encode(text, allowed_special="all", disallowed_special=())
                return engine.encode_ordinary(text)

            self._encode = encode
        else:
            from tokenizers import Tokenizer

            self.sizes, self._engine = None, Tokenizer.from_file(path)
            self._encode = lambda text: self._engine.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self._encode(text), np.uint32)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids, and the bytes of the UTF-8 text at which the tokens begin and end."""
        if self.sizes is not None:
            ids = self(text)
            ends = np.cumsum(self.sizes[ids])
            return ids, ends - self.sizes[ids], ends
        made = self._engine.encode(text, add_special_tokens=False)
        data = np.frombuffer(text.encode(), np.uint8)
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # the byte of each character
        chars = np.array(made.offsets, np.int64).reshape(-1, 2)
        return np.array(made.ids, np.uint32), at[chars[:, 0]], at[chars[:, 1]]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder a path and process."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
