"""Token ids of whole texts, by the tokenizers library, inside Spark tasks.

Both supported vocabularies always cut a text at a single space between two other characters, and
cut a word from punctuation after it. So the library is asked once per distinct word, and a bounded
cache of a Python worker answers for repeats. The cache changes the speed only, never an id; texts
with any other white space than single spaces and line ends go to the library whole.
"""

import gc
import os
import re
import zlib
from array import array

import numpy as np
import public_tokenizers

from .common import kept

CACHED = 600_000  # chunks that a worker knows
CACHED_IDS = 6_000_000  # ids that a worker keeps of them
CACHED_LENGTH = 32  # characters of the longest cached chunk
LINE = 200  # words in a line for the library

# What makes a text go to the library whole: other white space, runs of it, or some at an end.
_SPACES = [c for c in map(chr, range(0x3100)) if c.isspace() and c not in " \n"] + ["\u180e"]
_RUNS = ["  ", " \n", "\n ", "\n\n"]
_WORD = r"[A-Za-zÀ-ÖØ-öø-ÿ]+"
_MARKS = r"[!-&(-/:-@\[-`{-~]+"
# A word, perhaps the first of a line, with marks (no apostrophe) behind it.
_PARTS = re.compile(rf"(\n?)({_WORD})({_MARKS})?")


def _odd(text):
    return (text[0] in " \n" or text[-1] in " \n" or any(r in text for r in _RUNS)
            or any(c in text for c in _SPACES))


class _Known(dict):
    """Numbers of chunks in the order in which they are met; those of no ids yet are in ``new``."""

    def __init__(self):
        self.first, self.new = 0, []

    def __missing__(self, chunk):
        self[chunk] = number = self.first + len(self.new)
        self.new.append(chunk)
        return number


class _Pool:
    """Ids of numbered chunks, one after the other."""

    def __init__(self):
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.spans = np.empty((2, 1 << 14), np.int64)  # of each number: where its ids begin, how many

    def add(self, numbers, ids, sizes):
        """The ids of the numbers, put together, and how many are of each."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while len(numbers) and max(numbers) >= self.spans.shape[1]:
            self.spans = np.concatenate([self.spans, np.empty_like(self.spans)], axis=1)
        self.ids[self.used:self.used + len(ids)] = ids
        self.spans[:, numbers] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)

    def gathered(self, numbers):
        """The ids of all these numbers in turn, and where those of each end."""
        start, size = self.spans.take(numbers, axis=1)
        ends = np.cumsum(size)
        at = np.repeat(start - ends + size, size)
        at += np.arange(len(at))
        return self.ids.take(at), ends


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, each text followed by ``end_id``.

    ``name``: a file of the public tokenizers, or a path. Null counts as empty; the strings of
    special tokens in a text are ordinary text. ``cached``: chunks to be known, ``CACHED`` by default.
    """

    def __init__(self, name, end_id, cached=None):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True
        # Whether the word after a space carries that space in its first id.
        self.lead = " " if self._ids([" b"]) != self._ids(["b"]) else ""
        self.end = array("I", [end_id]).tobytes()
        self.end_id = end_id
        self.cached = cached or CACHED
        # Which ids begin a word behind a space, or else end a word.
        vocabulary, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.marks = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.marks[[i for t, i in vocabulary.items() if (
            t.startswith("Ġ") if self.lead else suffix and t.endswith(suffix))]] = True
        self._forget()
        # Such a vocabulary never cuts a word: its model may get words that are cut already.
        self.words = None
        kind = pre_tokenizers.ByteLevel
        added = self.tokenizer.get_added_tokens_decoder().values()
        if self.lead and not self.tokenizer.normalizer and all(a.special for a in added) \
                and isinstance(self.tokenizer.pre_tokenizer, kind):
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            written = kind(add_prefix_space=False, use_regex=False).pre_tokenize_str
            self.written = {k: written(chr(k))[0][0] for k in range(0xC0, 0x100)}
            # The first word of a line comes behind the line's end, which is a piece of its own.
            (end,) = self.tokenizer.encode("\n", add_special_tokens=False).ids[:1]
            self.marks[end] = True
            self.written[10] = written("\n")[0][0] + " "

    def _forget(self):
        # No chunk is empty, nor two spaces: they stand for the end and for nothing.
        self.known, self.pool = _Known(), _Pool()
        self.pool.add([self.known["  "], self.known[""]], [self.end_id], np.array([0, 1]))
        self.known.first, self.known.new = 2, []

    def _ids(self, texts):
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _words(self, words):
        """Ids of each of the words behind a space, or behind a line's end, put together, and how
        many each has. One call for all of them, in lines: long ones take the library longer."""
        if self.words:
            words = [" Ġ" + w if w.isascii() and w[0] != "\n" else
                     (" " if w[0] == "\n" else " Ġ") + w.translate(self.written) for w in words]
            lines = ["".join(words[k:k + LINE]) for k in range(0, len(words), LINE)]
        else:
            lines = [self.lead + " ".join(words[k:k + LINE]) for k in range(0, len(words), LINE)]
        found = (self.words or self.tokenizer).encode_batch_fast(lines, add_special_tokens=False)
        ids = np.array([i for x in found for i in x.ids], np.uint32)
        at = np.flatnonzero(self.marks[ids])
        if len(at) != len(words):  # a vocabulary that does not mark them
            return _together(self._ids([self.lead + w for w in words]))
        return ids, np.diff(at, append=len(ids)) if self.lead else np.diff(at, prepend=-1)

    def _learn(self):
        """Ids of the new chunks: of a word, or of a word and the marks behind it that the
        vocabulary never joins to it, or of anything else whole."""
        known, pool, match = self.known, self.pool, _PARTS.fullmatch
        numbers, words, joined, parts, firsts, odd = [], [], [], [], [], []
        # The parts of a chunk are chunks that may be new too: the list grows while it is walked.
        for number, chunk in enumerate(known.new, known.first):
            if chunk.isascii() and chunk.isalpha():
                numbers.append(number)
                words.append(chunk)
            elif chunk[-1] == " ":
                (firsts if chunk[0].isalnum() else odd).append(number)
            elif not (m := match(chunk)) or m[1] and self.lead and not self.words:
                odd.append(number)
            elif m[3]:
                joined.append(number)
                parts += known[m[1] + m[2] if self.lead else m[2]], known[m[3] + " "]
            elif m[1] and not self.lead:
                joined.append(number)
                parts += known[m[2]], 0
            else:
                numbers.append(number)
                words.append(chunk)
        if words:
            pool.add(numbers, *self._words(words))
        for some in (firsts, odd):
            chunks = [known.new[n - known.first] for n in some]
            pool.add(some, *_together(self._ids([
                c[:-1] if c[-1] == " " else c if c[0] == "\n" else self.lead + c
                for c in chunks])))
        ids, ends = pool.gathered(np.array(parts, np.int64))
        pool.add(joined, ids, np.diff(ends[1::2], prepend=0))

    def _keep(self, used):
        """The new chunks stay known, the long ones excepted; all are forgotten again where there
        is no room. ``used``: ids before them."""
        known = self.known
        full = len(known) - len(known.new) >= self.cached or used >= CACHED_IDS
        for chunk in known.new:
            if full or len(chunk) > CACHED_LENGTH:
                del known[chunk]
        if full:
            self.pool.used = used
        else:
            known.first += len(known.new)
        known.new = []

    def encode(self, texts):
        """One bytes object per text."""
        gc.disable()  # many small objects and no cycles: collecting would only cost time
        try:
            return self._encoded(texts)
        except BaseException:
            self._forget()  # some chunks may have numbers but no ids
            raise
        finally:
            gc.enable()

    def _encoded(self, texts):
        known, used = self.known, self.pool.used
        out, slow, cut, ends, numbers = [None] * len(texts), [], [], [], array("q")
        for k, text in enumerate(texts):
            if not text or _odd(text):
                slow.append(k)
                continue
            own = text.replace("\n", " \n").split(" ")
            own[0] += " "  # no space before it: another chunk than the same word later on
            own.append("")
            numbers.extend(map(known.__getitem__, own))
            cut.append(k)
            ends.append(len(numbers))
        numbers = np.frombuffer(numbers, np.int64)
        if known.new:
            many = len(known.new) * 4 > len(numbers) and len(known) > self.cached * 3 // 4
            self._learn()
        ids, last = self.pool.gathered(numbers)
        ends = last[np.array(ends, np.int64) - 1].tolist()
        for k, start, end in zip(cut, [0, *ends], ends):
            out[k] = ids[start:end].tobytes()
        for k, own in zip(slow, self._ids([texts[k] or "" for k in slow])):
            out[k] = own + self.end
        if known.new:
            self._forget() if many else self._keep(used)  # many: the texts have changed
        return out


def _together(found):
    """Ids of several pieces as one array, and how many each has."""
    return np.frombuffer(b"".join(found), np.uint32), \
        np.array([len(x) // 4 for x in found], np.int64)


def encoder(name, end_id, cached=None):
    """The worker's encoder."""
    return kept(("encoder", name, end_id, cached), lambda: Encoder(name, end_id, cached))


def crc(data):
    """Unsigned CRC-32."""
    return zlib.crc32(data) & 0xFFFFFFFF
