"""Token ids of whole texts by the tokenizers library, with its merges computed once per distinct piece.

A byte-level BPE cuts a text into pieces before it merges bytes, and merges never cross a piece. The pieces
are found here with one regular expression over characters whose classes are plain (Latin letters, digits,
common punctuation); a text with any other character goes to the library whole. Either way the ids are the
library's.
"""

from __future__ import annotations

import re
import struct

from tokenizers import Tokenizer
from tokenizers.models import BPE

#: Letters, digits and blanks up to U+024F, with punctuation up to U+20AC that is none of these.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \xa0"
_PLAIN = re.compile("[\t-\r -~\xa0-ɏ‐-‧‰-›€]*")
#: Fixed value: the piece pattern of byte-level BPE.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class PieceIds(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers; holds at most `bound` pieces.

    A piece goes to the library's model, in its vocabulary's characters; the library would cut it no further.
    """

    def __init__(self, path: str, bound: int = 500_000):
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.library.model
        self.bytes = byte_characters()
        self.bound = bound
        cut = repr(self.library.pre_tokenizer).replace(" ", "")
        self.plain = isinstance(self.model, BPE) and self.library.normalizer is None and cut.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in cut

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.bytes))]
        got = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a text, four bytes each."""
        if not self.plain or not _PLAIN.fullmatch(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, _PIECE.findall(text)))


_loaded: dict[str, PieceIds] = {}


def piece_ids(path: str) -> PieceIds:
    """The tokenizer of this Python worker."""
    if path not in _loaded:
        _loaded[path] = PieceIds(path)
    return _loaded[path]


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
