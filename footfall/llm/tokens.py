"""Token ids of whole texts by a public byte-level tokenizer.

The tokenizer file decides the ids. Where it is a plain byte-level BPE whose ids
follow its merges, its vocabulary is handed to `tiktoken`, which merges the same
pairs in the same order several times faster; any other file, and any text
that holds one of the file's added tokens, is encoded by `tokenizers`.
"""

from __future__ import annotations

import json
import os
from array import array

DEFAULT_TOKENIZER = "byte_bpe_50k.json"

# Fixed value: how tokenizers of this family cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODERS: dict[str, TokenEncoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """Vocabulary as merge ranks, if the file is a plain byte-level BPE."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, cut = content["model"], content.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and content.get("normalizer") is None
        and cut.get("type") == "ByteLevel"
        and cut.get("add_prefix_space") is False
        and cut.get("use_regex", True)
        and not model.get("dropout")
        and not model.get("ignore_merges")
        and not model.get("byte_fallback")
        and not model.get("continuing_subword_prefix")
        and not model.get("end_of_word_suffix")
    )
    if not plain:
        return None
    vocabulary, merges = model["vocab"], model["merges"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    letters, added = _byte_letters(), {t["content"] for t in content.get("added_tokens", [])}
    return {
        bytes(letters[x] for x in token): rank
        for token, rank in vocabulary.items()
        if token not in added
    }


class TokenEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        ranks = _ranks(path)
        self._fast = None
        if ranks is not None:
            import tiktoken

            self._fast = tiktoken.Encoding(
                "own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
            ).encode_ordinary

    def encode(self, text: str | None) -> bytes:
        """Ids of a text; a null or empty text has none."""
        if not text:
            return b""
        if self._fast is None or any(token in text for token in self._added):
            ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self._fast(text)
        return array("I", ids).tobytes()


def encoder(path: str) -> TokenEncoder:
    """The encoder of a tokenizer file, kept by each Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = TokenEncoder(path)
    return _ENCODERS[path]
