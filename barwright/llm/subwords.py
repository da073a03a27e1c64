"""Subword ids of words, remembered: a public tokenizer is asked once for each different word.

The vocabulary ``word_bpe_49k`` drops white space, never joins across it and folds case, so the ids of a text are those
of its words one after the other. Unknown words lose the marks at their ends, which are looked up apart; words of letters go
straight to the merges of the tokenizer's model, all others through the whole tokenizer, many at a time, parted by a word whose
one id no other gives.
"""

import unicodedata
from array import array
from functools import cache
from itertools import islice

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Words that a Python worker remembers over its tasks; bounds its memory.
REMEMBERED = 1_000_000
#: Texts whose words are learnt together, and words asked for in one call.
TEXTS, ASKED = 500, 400
TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PART = b"0"
LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")


def parted(word):
    """(core, tail) whose ids one after the other are those of the word."""
    if b"<|" in word:  # may hold a special token, which is matched as written
        return word, b""
    core = word.lower()
    short = core.rstrip(TAIL)
    return (short, core[len(short):]) if short and len(short) < len(core) and short[-1] in LETTERS else (core, b"")


def _printable():
    """Byte -> the character that stands for it in byte-level vocabularies: itself if printable, else the next above 255."""
    out, above = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b], above = chr(above), above + 1
    return out


BYTES = _printable()


def letters(core):
    """The word as the model's merges see it, if it is of lower-case Latin letters; else None."""
    if core.isascii():
        return core.decode() if core.isalpha() else None
    s = core.decode()
    plain = s.isalpha() and max(s) < "\u0250" and s == s.lower() and unicodedata.is_normalized("NFC", s)
    return core.decode("latin-1").translate(BYTES) if plain else None


@cache
def shared(path=VOCABULARY, unit="I", remembered=REMEMBERED):
    """The WordIds of this Python worker, which later tasks find with the words of earlier ones."""
    return WordIds(path, remembered, unit)


class WordIds:
    def __init__(self, path=VOCABULARY, remembered=REMEMBERED, unit="I"):
        """``unit`` is the array code of an id: I for 32 bits, H for 16, which take vocabularies below 65,536."""
        self.tokenizer = Tokenizer.from_file(path)
        self.unit, self.wide = unit, array(unit).itemsize
        self.remembered, self.known = remembered, {}
        self.model = self.tokenizer.model
        self.part = self.tokenizer.encode(PART.decode(), add_special_tokens=False).ids
        assert len(self.part) == 1

    def ask(self, cores):
        """Ids of words as bytes, in order."""
        out = []
        for i in range(0, len(cores), ASKED):
            some = cores[i:i + ASKED]
            ids = np.array(self.tokenizer.encode((b" " + PART + b" ").join(some).decode(), add_special_tokens=False).ids, self.unit)
            cuts = np.nonzero(ids == self.part[0])[0].tolist()
            raw, w = ids.tobytes(), self.wide
            out += [raw[w * a + w:w * b] for a, b in zip([-1] + cuts, cuts + [len(ids)])]
        return out

    def learn(self, words):
        """Ids of those of ``words`` (bytes) that are not remembered; they are remembered as long as there is room.

        Words met first tend to be the commonest, so none of them gives way to later ones.
        """
        new = [w for w in words if w not in self.known]
        pairs = [parted(w) for w in new]
        ids, merges, plain = {b"": b""}, self.model.tokenize, []
        for c in {c for p in pairs for c in p if c}:
            s = letters(c)
            if s is not None:
                ids[c] = array(self.unit, [t.id for t in merges(s)]).tobytes()
            elif PART in c or b"<|" in c:
                ids[c] = array(self.unit, self.tokenizer.encode(c.decode(), add_special_tokens=False).ids).tobytes()
            else:
                plain.append(c)
        ids.update(zip(plain, self.ask(plain)))
        learnt = {w: ids[core] + ids[tail] for w, (core, tail) in zip(new, pairs)}
        self.known.update(islice(learnt.items(), max(0, self.remembered - len(self.known))))
        return learnt

    def of_texts(self, texts):
        """Ids of each text (bytes) as little-endian unsigned integers, text by text."""
        for i in range(0, len(texts), TEXTS):
            split = [t.split() for t in texts[i:i + TEXTS]]
            met = set().union(*split)
            learnt, known = self.learn(met), self.known
            if not learnt.keys() <= known.keys():
                known = {w: learnt[w] if w in learnt else known[w] for w in met}
            for words in split:
                yield b"".join(map(known.__getitem__, words))

    def ids(self, text):
        return next(self.of_texts([text]))
