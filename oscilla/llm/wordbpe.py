"""Token ids of whole texts by a tokenizers file, word by word.

The tokenizers used here drop white space and never merge across it, so a text's ids are the ids of its words
in order; special tokens that stand in a text are cut out first and keep their own ids. Each Python worker keeps the
ids of the words it has met (at most ``room`` of them, then it starts anew), lower-cased. Of a new word of plain
characters the pieces between which nothing is merged go to the library's merging model, any other word to the whole library.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

DEFAULT = "word_bpe_49k.json"
#: ASCII and Latin-1 letters, digits and marks: composed forms that lower-case to one character.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The file's own split, for plain words.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\\[-`{-~]+")
_encoders: dict[str, WordEncoder] = {}


def tokenizer_path(name: str = DEFAULT) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, the others from 256 on in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: b if b in printable else next(others) for b in range(256)}


class WordEncoder:
    """Only for tokenizers that lower-case, split at white space and drop it."""

    def __init__(self, path: str, room: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        # special tokens are looked for here, in the text as it stands; what is left is ordinary text, whatever its case
        self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.code, self.dtype = "H" if small else "I", np.dtype(np.uint16 if small else np.uint32)
        self.special = {t.content.encode(): array(self.code, [i]).tobytes() for i, t in added.items()}
        self.cuts = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if added else None
        self.letters = _byte_letters()
        self.room = room
        self.memo: dict[bytes, bytes] = {}
        self._clear()

    def _clear(self) -> None:
        # no word begins with a space, so these keys are theirs alone
        self.memo.clear()
        self.memo.update((b" " + k, v) for k, v in self.special.items())

    def _words(self, text: bytes) -> list[bytes]:
        if self.cuts is None or not self.cuts.search(text):
            return text.lower().split()
        return [w for part in self.cuts.split(text) for w in ([b" " + part] if part in self.special else part.lower().split())]

    def _piece(self, piece: str) -> bytes:
        held = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tokenize(held)]).tobytes()

    def _learn(self, new: set[bytes], words: list[bytes]) -> None:
        """Adds the new ones of a text's words."""
        memo, code = self.memo, self.code
        if len(memo) + 2 * len(new) > self.room:
            self._clear()
            new = set(words).difference(memo)
        odd = []
        for raw in new:
            word = raw.decode()
            if raw.isalpha():
                memo[raw] = self._piece(word)
            elif _PLAIN.fullmatch(word):
                pieces = []
                for piece in _PIECES.findall(word.lower()):
                    key = piece.encode()
                    if (ids := memo.get(key)) is None:
                        ids = memo[key] = self._piece(piece)
                    pieces.append(ids)
                memo[raw] = b"".join(pieces)
            else:
                odd.append((raw, word))
        for at in range(0, len(odd), 4096):
            some = odd[at : at + 4096]
            found = self.tokenizer.encode_batch_fast([w for _, w in some], add_special_tokens=False)
            memo.update((raw, array(code, e.ids).tobytes()) for (raw, _), e in zip(some, found, strict=True))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them with add_special_tokens=False."""
        out = []
        for text in texts:
            words = self._words(text)
            found = list(map(self.memo.get, words))
            if None in found:
                self._learn({w for w, ids in zip(words, found, strict=True) if ids is None}, words)
                found = [self.memo[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
            out.append(np.frombuffer(b"".join(found), self.dtype))
        return out


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for this file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
