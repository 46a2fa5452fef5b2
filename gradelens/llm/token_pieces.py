"""Token ids of whole texts for a byte-level vocabulary that two libraries share.

``tokenizers`` (the JSON file) is the standard.  ``tiktoken`` with the rank file
of the same vocabulary gives the same ids for texts of plain Latin letters,
digits, ASCII marks, blanks and line feeds (tests compare the two) in a third of
the time; texts with any other character, or with ``<|``, which may begin the
special string, go through ``tokenizers``.
"""
from __future__ import annotations

import base64
import os
import re
import zlib
from array import array

_OTHER = re.compile(r"[^ \n!-~À-ɏ]|<\|")


class TokenEncoder:
    """``ids(texts)``: for each text its ids as little-endian uint32 bytes."""

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self._full = Tokenizer.from_file(json_path)
        self._plain = None
        if ranks_path:
            import tiktoken
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if self._plain is not None and not _OTHER.search(text):
                got = self._plain(text)
            else:
                got = self._full.encode(text, add_special_tokens=False).ids
            out.append(array("I", got).tobytes())
        return out


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
