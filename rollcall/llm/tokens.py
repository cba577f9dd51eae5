"""Token ids of whole texts by a tokenizer of the ``tokenizers`` library, with the ids of a word kept per worker.

The vocabulary used here drops white space before merging, so a text's ids are those of its parts between
blanks and line ends, one after the other. Each distinct part is given to the library once per worker and cache.
Texts that hold the start of a special token are given to the library whole. ``check_tokenizer`` refuses tokenizers
for which parts, closing marks or the case of ASCII letters do change a neighbour's ids.

Where the tokenizer cuts texts into runs of letters, digits and other signs (``LETTER_RUNS``), a word of Latin letters is one
such run, whatever its case, and the signs after it are another. Such words go to the library's own model without the
general cutting; the ids are the same.

Caches have two generations: what was not used while one filled goes with the next, and frequent words stay. A stage
that holds its caches between tasks learns a frequent word once a worker, not once a task; ``release`` drops them
when the worker's next task is another operator's.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from itertools import compress

import numpy as np

from .common import worker_state

CACHE_WORDS = 120_000               # words of a generation; two generations of words and two of their cores are held
MARKS = ".,;:!?"
LATIN = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+").fullmatch      # composed letters, in lower case too
LETTER_RUNS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


class Recent(dict):
    """A dict of two generations: an entry found in the older one moves to this one."""

    def __init__(self, most: int, old: dict | None = None):
        super().__init__()
        self.most, self.old = most, old or {}

    def __missing__(self, key):
        self[key] = value = self.old[key]
        return value

    def held(self, key) -> bool:
        return key in self or key in self.old

    def aged(self) -> Recent:
        """This cache, or an empty one with this as the older generation, once it is full."""
        if len(self) <= self.most:
            return self
        self.old = {}
        return Recent(self.most, self)


def check_tokenizer(lib) -> None:
    """Fail unless texts fall apart at blanks, line ends and closing marks, and ASCII letters have no case."""
    def ids(text):
        return lib.encode(text, add_special_tokens=False).ids
    letters = "abcdefghijklmnopqrstuvwxyz"
    fine = ids("ab  cd\nef ") == ids("ab") + ids("cd") + ids("ef") and all(ids(f"x{c.upper()}") == ids(f"x{c}") for c in letters)
    for mark in MARKS:
        fine = fine and ids(f"ab{mark}{mark} cd") == ids("ab") + ids(mark * 2) + ids("cd") and all(
            ids(f"x{c}{mark}") == ids(f"x{c}") + ids(mark) for c in letters)
    if not fine:
        raise ValueError("this tokenizer does not cut texts at blanks, line ends and closing marks, or has cased letters")


def letter_runs(lib):
    """The model of a tokenizer that cuts texts as ``LETTER_RUNS``, for lower-case words between blanks: ASCII ones, which are
    their own bytes, and all. None for tokenizers that cut otherwise."""
    from tokenizers import Tokenizer, pre_tokenizers
    parts = json.loads(lib.to_str())
    cut, normal = ((parts[k] or {}).get(of) for k, of in (("pre_tokenizer", "pretokenizers"), ("normalizer", "normalizers")))
    if cut != LETTER_RUNS or normal != NORMALIZERS or parts["model"].get("dropout"):
        return None
    plain, words = Tokenizer(lib.model), Tokenizer(lib.model)
    plain.pre_tokenizer = blanks = pre_tokenizers.Split(" ", "removed")
    words.pre_tokenizer = pre_tokenizers.Sequence([blanks, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return plain, words


class WordEncoder:
    """ids(text) -> little-endian unsigned 32-bit ids of the text, without added special tokens."""

    def __init__(self, path: str, words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.I)
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        check_tokenizer(self.lib)
        self.letters = letter_runs(self.lib)
        self.words, self.ends_in_letter = words, {}
        self.forget()

    def _letter_end(self, core: str) -> bool:
        """Whether a word still ends in a letter after normalisation, which may end it in a combining mark."""
        c = core[-1]
        if c.isascii():
            return c.isalpha()
        if c not in self.ends_in_letter:
            made = self.lib.normalizer.normalize_str("x" + c) if self.lib.normalizer else c
            self.ends_in_letter[c] = c.isalpha() and made[-1:].isalpha()
        return self.ends_in_letter[c]

    def _encode(self, words: list[str], latin: list[str]) -> None:
        """Distinct parts: words of letters in one text, each ending in one closing id; others one by one."""
        rest = [w for w in words if not w.isalpha()]
        ways = [(self.lib, [w for w in words if w.isalpha()])]
        if latin:
            ways += [(self.letters[0], [w for w in latin if w.isascii()]), (self.letters[1], [w for w in latin if not w.isascii()])]
        for lib, plain in ways:
            for at in range(0, len(plain), 1024):
                some = plain[at:at + 1024]
                ids = np.array(lib.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) == len(some) and ends[-1] == len(ids):
                    data, stops = ids.tobytes(), (ends * 4).tolist()
                    self.cores.update(zip(some, [data[a:b] for a, b in zip([0, *stops], stops)]))
                else:                                   # a vocabulary without word ends
                    rest += some
        for at in range(0, len(rest), 4096):
            some = rest[at:at + 4096]
            for w, e in zip(some, self.lib.encode_batch_fast(some, add_special_tokens=False)):
                self.cores[w] = array("I", e.ids).tobytes()

    def _learn(self, parts: list[str]) -> None:
        """Lists of strings side by side: a tuple for each part would have the garbage collector look through the caches."""
        cores, known = self.cores, self.known
        if self.letters:
            lows = "\n".join(parts).lower().split("\n")
            bodies = [w.rstrip(string.punctuation) for w in lows]
            fine = [LATIN(w) is not None for w in bodies]
            parts, others = list(compress(parts, fine)), [p for p, f in zip(parts, fine) if not f]
            lows, bodies = list(compress(lows, fine)), list(compress(bodies, fine))
            tails = [w[len(b):] for w, b in zip(lows, bodies)]
            latin = set(bodies)
        else:
            parts, bodies, tails, others, latin = [], [], [], parts, set()
        new = set(tails)
        for p in others:
            low = p.lower() if p.isascii() else p   # ASCII case and closing marks never change a neighbour's ids
            core = low.rstrip(MARKS)
            if core is low or len(core) == len(low) or not core or not self._letter_end(core):
                core, tail = low, ""
            else:
                tail = low[len(core):]
            parts.append(p)
            bodies.append(core)
            tails.append(tail)
            new.add(core)
            new.add(tail)
        self._encode(*[[c for c in some if not cores.held(c)] for some in (new - latin, latin)])
        known.update(zip(parts, [cores[c] + cores[t] if t else cores[c] for c, t in zip(bodies, tails)]))

    def many(self, some: list[str]) -> list[bytes]:
        """Ids of each text; call it with some megabytes of text at a time."""
        parts = [() if self.special.search(t) else t.replace("\n", " ").split(" ") for t in some]
        self.known, self.cores = self.known.aged(), self.cores.aged()
        known, old = self.known, self.known.old
        found = [list(map(known.get, p)) for p in parts]        # None: not in this generation
        gaps = [[i for i, ids in enumerate(f) if ids is None] for f in found]
        new = []
        for w in {p[i] for p, gap in zip(parts, gaps) for i in gap}:
            ids = old.get(w)
            if ids is None:
                new.append(w)
            else:
                known[w] = ids
        if new:
            self._learn(new)
        for p, f, gap in zip(parts, found, gaps):
            for i in gap:
                f[i] = known[p[i]]
        return [b"".join(f) if p else self.whole(t) for t, p, f in zip(some, parts, found)]

    def forget(self) -> None:
        """Give the caches' memory back; the next task may be another operator's."""
        self.known, self.cores = Recent(self.words, {"": b""}), Recent(self.words)
        self.known[""] = b""

    def whole(self, text: str) -> bytes:
        return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()


def encoder(path: str, words: int = CACHE_WORDS) -> WordEncoder:
    """The encoder of this Python worker."""
    held = worker_state().setdefault("encoders", {})
    if (path, words) not in held:
        held[path, words] = WordEncoder(path, words)
    return held[path, words]
