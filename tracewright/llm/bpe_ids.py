"""Token ids of whole texts by a public tokenizer whose tokens never span white space, with a bounded word cache."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice
from struct import pack

import numpy as np

#: Characters that str.split() takes for white space but the tokenizer does not; such texts go to it whole.
CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Words and parts of words kept for each Python worker, those of first use, so that the frequent ones are there; and the latest ones beside them.
MOST_WORDS, LATEST_WORDS = 300_000, 300_000
#: Below this code point lower-casing does not depend on a letter's neighbours, and every letter is composed.
PLAIN = "ɐ"
_ALL_PLAIN = re.compile(f"[^{PLAIN}-\U0010ffff]+").fullmatch
_LETTERS, _DIGITS = ("".join(re.escape(chr(c)) for c in range(ord(PLAIN)) if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
#: The parts of a plain word in lower case that the tokenizer encodes one by one, as its own pattern has them.
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}]+").findall
#: The sign that stands for each byte of a part in the tokenizer's vocabulary: printable ones are their own.
_OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _OWN)}


class WordIds:
    """Little-endian unsigned 32-bit ids of texts, equal to the tokenizer's own for every text.

    The tokenizer drops white space and encodes each part of a word (letters, a digit, other signs) by itself, so the ids of
    a text are those of its words' parts one after another. Words with signs from ``PLAIN`` on go to the tokenizer as they
    are; a text with a special token's name or an unusual control character is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.words: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        signs = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(_SIGNS)
        ids = [t.id for t in self.model.tokenize(signs)]
        return pack(f"<{len(ids)}I", *ids)

    def _learn(self, new: Iterable[str]) -> None:
        """Puts words and their parts in the cache."""
        known, others = self.words, []
        get, made_of = known.get, self._part
        for word in new:
            low = word.lower()
            if not (word.isascii() or (_ALL_PLAIN(word) and _ALL_PLAIN(low))):
                others.append(word)
            elif low.isalpha():
                ids = get(low)
                known[word] = known[low] = made_of(low) if ids is None else ids
            else:
                made = []
                for part in _PARTS(low):
                    ids = get(part)
                    if ids is None:
                        ids = known[part] = made_of(part)
                    made.append(ids)
                known[word] = b"".join(made)
        known.update(zip(others, self._encode(others), strict=True))

    def of(self, texts: list[str]) -> Iterator[bytes]:
        whole = [i for i, t in enumerate(texts) if any(c in t for c in CONTROLS) or any(s in t for s in self.special)]
        apart = dict(zip(whole, self._encode([texts[i] for i in whole]), strict=True))
        words = [[] if i in apart else t.split() for i, t in enumerate(texts)]
        known = self.words
        if len(known) > MOST_WORDS + LATEST_WORDS:
            for w in list(islice(known, MOST_WORDS, None)):
                del known[w]
        self._learn(set().union(*words).difference(known))
        for i, own in enumerate(words):
            yield apart[i] if i in apart else b"".join(map(known.__getitem__, own))


_made: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each path and Python worker."""
    if path not in _made:
        _made[path] = WordIds(path)
    return _made[path]
