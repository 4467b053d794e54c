"""Token ids of whole texts, by word.

The tokenizer drops white space and no merge crosses it, so a text's ids are those of its space-separated pieces in a
row. Corpora repeat their words; a memo of two generations holds the ids of the pieces seen last. Pieces of Latin letters,
digits and ASCII marks, whose normal form is plain, are split here and merged by a byte-pair engine that is given the same
vocabulary; all others go to the tokenizer itself.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

#: Pieces held by each generation of the memo; longer pieces than PIECE characters are not held.
MEMO, PIECE = 120_000, 48
#: The id written after each document.
END = 1
#: Stands for the end of a word; a control character, which never takes the plain way.
MARK = b"\x01"
#: Letters of which each is its own normal form, as pieces after lower-casing.
LETTERS = "a-zß-öø-ɏ"
PLAIN = re.compile(f"[!-~À-ɏ]+")
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: visible ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """ids(text) for one worker. path: the tokenizer's file; end: the id appended to each document, None for none."""

    def __init__(self, path: str | None = None, end: int | None = END):
        from tokenizers import Tokenizer

        path = path or default_path()
        self.tokenizer = Tokenizer.from_file(path)
        self.end = b"" if end is None else np.array([end], "<u4").tobytes()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.engine = self._engine(path)

    @staticmethod
    def _engine(path: str):
        """An engine that merges as the file says, or None if the file is of another kind."""
        import tiktoken

        with open(path) as f:
            model = json.load(f)["model"]
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or len(model["vocab"]) != 512 + len(model["merges"]):
            return None
        of = byte_letters()
        ranks = {}
        for token, k in model["vocab"].items():
            word, end = (token[:-4], MARK) if token.endswith("</w>") else (token, b"")
            ranks[bytes(of[c] for c in word) + end] = k
        if len(ranks) != len(model["vocab"]):
            return None
        return tiktoken.Encoding("words", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})

    def piece(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            if self.engine and PLAIN.fullmatch(piece) and "<|" not in piece:
                ids = self.engine.encode_ordinary("\x01".join(WORDS.findall(piece.lower())) + "\x01")
            else:
                ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
            got = array("I", ids).tobytes()
        if len(piece) <= PIECE:
            if len(self.young) >= MEMO:
                self.old, self.young = self.young, {}
            self.young[piece] = got
        return got

    def ids(self, text: str | None) -> np.ndarray:
        """uint32 ids of a text (null: empty) and the end id."""
        out: list[bytes] = []
        add, known, piece = out.append, self.young.get, self.piece
        for p in (text or "").replace("\n", " ").split(" "):
            got = known(p)
            if got is None:
                if not p:
                    continue
                got = piece(p)
                known = self.young.get
            add(got)
        add(self.end)
        return np.frombuffer(b"".join(out), dtype="<u4")
