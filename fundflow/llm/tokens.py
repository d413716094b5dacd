"""Token ids through the tokenizers library, with a word-run memory per task.

``Encoder`` gives the ids the library gives for a whole text.  The
tokenizer's normaliser and pre-tokenizer never join characters across a
blank or a line feed (composition never involves either, the split pattern
matches no white space, and no added token holds one), so a text's ids are
the ids of its runs between blanks, in order.  Each distinct run goes
through the library once and is remembered.  The tests hold the result
against the library's ids of whole texts.
"""
from __future__ import annotations

import os
import zlib
from collections.abc import Iterable

import numpy as np

from .common import remembers, works_for

#: Runs longer than this many characters are encoded but not remembered.
RUN_CHARS = 64
#: Remembered runs per Python worker (about 150 bytes each).
RUNS_KEPT = 800_000
#: Parts runs within one library call; a run that holds it is encoded alone.
MARK = "\x00"
#: ASCII signs that end a run (no apostrophe: it starts contractions).
SIGNS = ".,!?;:*$%&#|-()[]{}<>/+=\"@_~^`\\"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Whole-text encoder; ``dtype`` is the narrowest unsigned type for the vocabulary."""

    def __init__(self, path: str, runs_kept: int = RUNS_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        size = self.lib.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.runs_kept = runs_kept
        mark = self.encode_whole(MARK)
        self.marks = np.zeros(size, bool)
        self.marks[mark] = len(mark) == 1
        suffix = getattr(self.lib.model, "end_of_word_suffix", None)
        self.ends = np.zeros(size, bool)
        for token, i in self.lib.get_vocab(with_added_tokens=False).items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        # letters and signs part, and case is dropped: checked on this file
        self.lower = all(self.encode_whole(a + b) == self.encode_whole(a.lower()) + self.encode_whole(b)
                         for a in ("The", "ONHA", "x") for b in [*SIGNS, SIGNS])
        self.runs: dict[str, bytes] = {"": b""}

    def _library(self, runs: list[str], words: bool) -> dict[str, bytes]:
        """Ids of each run from the library, many runs to a call.

        ``words``: runs of letters, each one pre-token, whose ids end with
        the one id of an end-of-word token; other runs are parted by a NUL.
        """
        out, wide = {}, self.dtype.itemsize
        last, join = (self.ends, " ") if words else (self.marks, f" {MARK} ")
        plain = runs if words else [r for r in runs if MARK not in r]
        for i in range(0, len(plain), 256):
            part = plain[i:i + 256]
            ids = np.array(self.lib.encode(join.join(part), add_special_tokens=False).ids, self.dtype)
            cuts = (np.flatnonzero(last[ids]) * wide).tolist()
            raw = ids.tobytes()
            if words and len(cuts) == len(part):
                at = 0
                for run, cut in zip(part, cuts):
                    out[run] = raw[at:cut + wide]
                    at = cut + wide
            elif not words and len(cuts) == len(part) - 1:
                at = 0
                for run, cut in zip(part, [*cuts, len(raw)]):
                    out[run] = raw[at:cut]
                    at = cut + wide
        if len(out) < len(runs):
            for run in runs:
                if run not in out:
                    out[run] = np.array(self.encode_whole(run), self.dtype).tobytes()
        return out

    def _learn(self, runs: list[str]) -> dict[str, bytes]:
        """Ids of new runs.  Letters followed by ASCII signs are two
        pre-tokens and letters are lower-cased, so such a run is its
        lower-case letters' ids and its signs' ids."""
        parts, words, others, known = [], set(), [], self.runs
        for run in runs:
            core = run.rstrip(SIGNS)
            if self.lower and core.isalpha() and (core.isascii() or core.islower() and max(core) < "\u0250"):
                tail = run[len(core):]
                core = core.lower()
                parts.append((run, core, tail))
                if core not in known:
                    words.add(core)
                if tail not in known:
                    others.append(tail)
            else:
                others.append(run)
        got = self._library(list(words), True)
        got |= self._library(list(set(others)), False)
        for run, core, tail in parts:
            head = got[core] if core in got else known[core]
            got[run] = head + (got[tail] if tail in got else known[tail]) if tail else head
        return got

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian bytes of ``dtype``; null is the empty text."""
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        known = self.runs
        new = list(set().union(*split).difference(known)) if split else []
        fresh = self._learn(new)
        long = {k: v for k, v in fresh.items() if len(k) > RUN_CHARS}
        if len(known) + len(fresh) - len(long) > self.runs_kept:
            # forgetting costs time only: a forgotten run is encoded again
            seen = {r: known[r] for s in split for r in s if r in known}
            known = self.runs = {"": b""} | seen
        known.update((k, v) for k, v in fresh.items() if k not in long)
        if not long:
            return [b"".join(map(known.__getitem__, s)) for s in split]
        return [b"".join(long[r] if r in long else known[r] for r in s) for s in split]

    def encode_whole(self, text: str | None) -> list[int]:
        """The library's own ids of the whole text, for tests."""
        return self.lib.encode(text or "", add_special_tokens=False).ids


_ENCODERS: dict[str, Encoder] = {}
remembers("tokens", _ENCODERS.clear)


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and tokenizer file."""
    works_for("tokens")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def batches(rows: list, sizes: list[int], most: int = 4_000_000):
    """Cuts ``rows`` into lists of at most ``most`` in size (one row at least)."""
    out, total = [], 0
    for r, n in zip(rows, sizes):
        if out and total + n > most:
            yield out
            out, total = [], 0
        out.append(r)
        total += n
    if out:
        yield out


def crc32_ids(ids: bytes, dtype: np.dtype) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.frombuffer(ids, dtype).astype("<u4").tobytes())
