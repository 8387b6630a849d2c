"""Byte-level BPE encoding inside tasks, from a public vocabulary file whose path is a parameter."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: White space from which on the pattern's engine may give up: it keeps a place for each character.
_LONG_SPACE = re.compile(r"\s{100000}")


@dataclass(frozen=True)
class Vocabulary:
    """Merge ranks file, split pattern and special strings of a byte-level BPE."""

    path: str
    pattern: str
    special: dict[str, int] = field(default_factory=dict)
    #: The same vocabulary for the tokenizers package, which takes white space of any length.
    json_path: str | None = None

    def encoder(self) -> Callable[[str], list[int]]:
        """Text -> ids; special strings inside a text get their own ids."""
        import tiktoken

        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("public", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=dict(self.special))
        other: list = []

        def encode(text: str) -> list[int]:
            if self.json_path is None or not _LONG_SPACE.search(text):
                return encoding.encode(text, allowed_special="all")
            if not other:
                from tokenizers import Tokenizer

                other.append(Tokenizer.from_file(self.json_path))
            return other[0].encode(text, add_special_tokens=False).ids

        # Two successive bytes that are in no token: no token reaches over such a place.
        within = np.zeros((256, 256), bool)
        for token in ranks:
            b = np.frombuffer(token, np.uint8)
            within[b[:-1], b[1:]] = True
        encode.within, encode.special = within, tuple(self.special)  # type: ignore[attr-defined]
        return encode


def public_vocabulary() -> Vocabulary:
    """The 50k vocabulary that the tokenizers package of this machine ships."""
    import public_tokenizers

    return Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, public_tokenizers.path("byte_bpe_50k.json"))
