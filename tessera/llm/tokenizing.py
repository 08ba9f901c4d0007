"""Token ids of whole texts by the tokenizers library, word by word.

The public word vocabulary treats every run between ASCII white space on its
own (its normalisers and its split pattern never join across white space), so
a text's ids are its runs' ids in order.

Texts of ASCII and Latin-1 letters are cut into pieces by the vocabulary's own
split pattern and the library's BPE model encodes each distinct piece once per
worker process; any other text is taken run by run, and a run with other
characters goes through the library's whole pipeline.  Tests hold both ways
against encoding the whole text at once.

Memory is bounded: ``MEMO`` runs and ``MEMO`` pieces of at most
``MEMO_BYTES`` bytes are kept, then the table starts anew.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

END_ID = 1         # appended to each document
MEMO = 200_000
MEMO_BYTES = 40    # longer runs are kept for their batch only

# fixed values: the vocabulary's split pattern, over lower-case ASCII and Latin-1, and the texts it holds for
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x09-\x0d a-zß-öø-ÿ0-9]+")
_SIMPLE = re.compile(r"[\x09-\x0d -~À-ÖØ-öø-ÿ]*")


def _byte_letters() -> dict[int, str]:
    """The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    out, nxt = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in out:
            out[b], nxt = chr(nxt), nxt + 1
    return out


_LETTERS = _byte_letters()


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Pieces(dict):
    """Ids of pieces as bytes; a new piece is encoded by the BPE model when first asked for."""

    def __init__(self, model):
        super().__init__()
        self._model = model

    def __missing__(self, piece: str) -> bytes:
        # ASCII stands for itself in the byte alphabet
        letters = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(_LETTERS)
        ids = _pack([t.id for t in self._model.tokenize(letters)])
        if len(piece) <= MEMO_BYTES:
            self[piece] = ids
        return ids


class Encoder:
    """Encode texts to little-endian unsigned 32-bit ids, END_ID appended."""

    def __init__(self, vocab_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark owns the cores
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(vocab_file)
        self._specials = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        self._pieces = _Pieces(self._tok.model)
        self._runs: dict[bytes, bytes] = {}

    def _simple(self, text: str) -> bool:
        return _SIMPLE.fullmatch(text) is not None and not ("<" in text and any(x in text for x in self._specials))

    def _by_pieces(self, text: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, _PIECE.findall(text.lower())))

    def _by_runs(self, text: str) -> bytes:
        """Run by run: simple ones by their pieces, the others by the library's whole pipeline."""
        # runs of bytes between ASCII white space: exactly what bytes.split() cuts
        out = []
        for run in text.encode("utf-8").split():
            ids = self._runs.get(run)
            if ids is None:
                s = run.decode("utf-8")
                ids = self._by_pieces(s) if self._simple(s) else _pack(self._tok.encode(s, add_special_tokens=False).ids)
                if len(run) <= MEMO_BYTES:
                    self._runs[run] = ids
            out.append(ids)
        return b"".join(out)

    def batch(self, texts) -> list[bytes]:
        """Ids of each text as bytes; a null text is empty and has END_ID only."""
        for table in (self._pieces, self._runs):
            if len(table) > MEMO:
                table.clear()
        end = _pack([END_ID])
        return [(self._by_pieces(t) if self._simple(t) else self._by_runs(t)) + end if t else end for t in texts]


@lru_cache(maxsize=1)
def encoder(vocab_file: str) -> Encoder:
    """One encoder per worker process, so that its table serves the following tasks too."""
    return Encoder(vocab_file)


def forget() -> None:
    """Drop this process's encoder and its tables; for workers that go on to work which needs the memory."""
    encoder.cache_clear()


def default_vocab() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
