"""Byte-level BPE of texts by way of their words, each distinct word encoded by the tokenizers library once.

A space or line end that follows a character other than white space always starts a new pre-token, whatever stands around
it, and no earlier pre-token looks past it. Cutting a text there therefore changes no id.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import compress, repeat
from operator import is_

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
MOST_WORDS = 1_500_000
JOINED_WORDS = 2_000
ENCODED_BYTES = 2 << 20  # of texts encoded at once
UNSAFE = re.compile(r"\s[ \n]")  # white space before a space or line end: what stands round it is encoded whole
SAFE = re.compile(r"(?<=\S)(?=[ \n])")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Recent(dict):
    """A dictionary that keeps between ``most`` / 2 and ``most`` of the entries used last.

    ``get`` sees the younger half alone and costs what a plain dictionary's does; ``find`` also brings back older entries.
    """

    def __init__(self, most: int):
        self.most, self.older = most, {}

    def find(self, key):
        value = self.get(key)
        if value is None:
            value = self.older.pop(key, None)
            if value is not None:
                self[key] = value
        return value

    def turn(self) -> None:
        """Make room: entries of before count as older once there are many."""
        if len(self) > self.most // 2:
            self.older = dict(self)
            self.clear()

    def add(self, found: dict) -> None:
        self.turn()
        self.update(found)


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes. Words are remembered up to a bound; hold one per Python worker."""

    def __init__(self, path: str | None = None, most_words: int = MOST_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words = Recent(most_words)  # what follows a space -> ids of both; what begins with a line end -> its ids
        self.heads = Recent(most_words // 8)  # what begins a text or a line
        self.parts = Recent(most_words // 4)  # of texts with unsafe places: all from one safe place to the next
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.signs = {sign: self.whole(sign) for sign in ",.\n"}
        self.tokenizer.model._resize_cache(0)  # what is known is kept here
        self.merged = self.tokenizer.model.tokenize
        self.letters = {b: c for c, b in byte_signs().items() if b >= 128}
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.direct = self.tokenizer.normalizer is None and not any(a.content.strip().isalpha() for a in added)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _of_letters(self, word: str, lead: str) -> bytes:
        """Ids of a word of letters alone, which is one pre-token with the sign of the space before it, if any."""
        signs = word if word.isascii() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        return array("I", [token.id for token in self.merged(lead + signs)]).tobytes()

    def _learn_heads(self, words: set[str]) -> None:
        """See to it that ``heads`` has all ``words``; call after its turn."""
        new = []
        for w in words:
            if self.heads.find(w) is None:
                if self.direct and w.isalpha():
                    self.heads[w] = self._of_letters(w, "")
                else:
                    new.append(w)
        for word, encoded in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.heads[word] = np.array(encoded.ids, dtype="<u4").tobytes()

    def _spaced_words(self, words: list[str]) -> dict[str, bytes]:
        """Many words in one text: each word's ids begin where an id begins with a space."""
        found = {}
        groups = [words[i:i + JOINED_WORDS] for i in range(0, len(words), JOINED_WORDS)]
        for group, encoded in zip(groups, self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(encoded.ids, dtype="<u4")
            starts = np.flatnonzero(self.spaced[ids]) * 4
            if len(starts) != len(group):
                raise ValueError("the vocabulary has tokens with a space inside")
            data, ends = ids.tobytes(), [*starts[1:].tolist(), len(ids) * 4]
            found.update(zip(group, map(data.__getitem__, map(slice, starts.tolist(), ends))))
        return found

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words not met lately. A comma or full stop after a letter, and a line end before a word, are pre-tokens of
        their own, so such words are put together from known parts. A line end before other white space may be of one pre-token
        with it: such words are encoded whole."""
        found, stems, wanted, lines = {}, {}, set(), {}
        older = self.words.older.pop
        for w in words:
            known = older(w, None)
            if known is not None:
                found[w] = known
            elif w[:1] == "\n":
                if w[1:2].isspace():
                    found[w] = self.whole(w)
                else:
                    lines[w] = w[1:]
            elif not w or w[-1].isspace():
                found[w] = self.whole(" " + w)
            elif w[-1] in ",." and w[-2:-1].isalpha():
                stems[w] = w[:-1]
            else:
                wanted.add(w)
        self._learn_heads(set(lines.values()))
        found.update((w, self.signs["\n"] + self.heads[head]) for w, head in lines.items())
        for stem in set(stems.values()) - wanted:
            known = self.words.find(stem)
            if known is None:
                wanted.add(stem)
            else:
                found[stem] = known
        if self.direct:
            letters = set(filter(str.isalpha, wanted))
            wanted -= letters
            found.update((w, self._of_letters(w, "Ġ")) for w in letters)
        found.update(self._spaced_words(list(wanted)))
        found.update((w, found[stem] + self.signs[w[-1]]) for w, stem in stems.items())
        return found

    def _learn_parts(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of parts of texts: words where they hold no unsafe place, else encoded whole."""
        found, words = {}, {}
        for part in parts:
            known = self.parts.older.pop(part, None)
            if known is not None:
                found[part] = known
            elif UNSAFE.search(part):
                found[part] = self.whole(part)
            else:
                words[part] = part[1:] if part[0] == " " else part
        learnt = self._learn(set(words.values()))
        self.words.update(learnt)
        found.update((part, learnt[word]) for part, word in words.items())
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        for held in (self.words, self.parts, self.heads):
            held.turn()
        unsafe = [UNSAFE.search(t) is not None for t in texts]
        cut = [SAFE.split(t) if u else t.replace("\n", " \n").split(" ") for t, u in zip(texts, unsafe)]
        heads = [c[0] for c in cut]
        new: tuple[set[str], set[str]] = set(), set()
        for c, u in zip(cut, unsafe):
            del c[0]
            new[u].update(compress(c, map(is_, map((self.parts if u else self.words).get, c), repeat(None))))
        self._learn_heads(set(heads))
        self.parts.update(self._learn_parts(new[True]))
        self.words.update(self._learn(new[False]))
        ids_of = self.words.__getitem__, self.parts.__getitem__
        return [self.heads[head] + b"".join(map(ids_of[u], c)) for head, c, u in zip(heads, cut, unsafe)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str | None = None) -> WordEncoder:
    """The worker's encoder of a vocabulary; what it has learnt serves later tasks of the worker too."""
    key = path or ""
    if key not in _encoders:
        _encoders[key] = WordEncoder(path)
    return _encoders[key]


def byte_signs() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_table(tokenizer) -> list[bytes]:
    """Bytes of each id under the byte-level alphabet."""
    sign = byte_signs()
    added = tokenizer.get_added_tokens_decoder()
    table = []
    for i in range(tokenizer.get_vocab_size(with_added_tokens=True)):
        token = tokenizer.id_to_token(i) or ""
        table.append(token.encode() if i in added else bytes(sign[c] for c in token))
    return table
