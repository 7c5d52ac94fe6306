"""Token ids of the public word tokenizer, remembered by chunk.

The tokenizer drops white space and no token crosses it, so a text's ids are those of its blank-free
chunks after one another. Inside a chunk its own pre-tokenizer cuts pieces (letters, digits,
others), and ids depend on the piece alone. Both levels are remembered up to ``LIMIT`` entries;
what is not remembered goes through the tokenizer itself, so the ids are the tokenizer's
whatever the limit.
"""

from __future__ import annotations

import re
from array import array

LIMIT = 300_000       # remembered chunks, and remembered pieces, of one Python worker
LONGEST = 64          # bytes of a chunk worth remembering

_LATIN = "a-zß-öø-ÿ"  # small letters that normalisation leaves as they are
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
# Fixed value: the pre-tokenizer's pattern, for text of these letters in lower case.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")



class _Pieces(dict):
    """Ids of pieces of plain letters, digits or marks in lower case."""

    def __init__(self, tokenizer):
        self.model = tokenizer.model
        # what the byte-level step makes of each plain letter
        letters = [chr(c) for c in range(0xDF, 0x100) if re.match(f"[{_LATIN}]", chr(c))]
        self.bytes = {ord(c): tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}

    def __missing__(self, piece: str) -> bytes:
        text = piece if piece.isascii() else piece.translate(self.bytes)
        ids = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        if len(self) < LIMIT and len(piece) < LONGEST:
            self[piece] = ids
        return ids


class _Chunks(dict):
    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.piece = _Pieces(tokenizer).__getitem__

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if _PLAIN.fullmatch(text):
            ids = b"".join(map(self.piece, _PIECE.findall(text.lower())))
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) < LIMIT and len(chunk) < LONGEST:
            self[chunk] = ids
        return ids


_open: dict[str, _Chunks] = {}


def encoder(path: str):
    """A function from UTF-8 text to its ids as 32-bit bytes (little-endian on every Spark platform)."""
    if path not in _open:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        _open[path] = _Chunks(t)
    get = _open[path].__getitem__
    return lambda text: b"".join(map(get, text.split()))


def word_tokenizer() -> str:
    """Where the vocabulary file of the word tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
