"""BPE encoding and decoding with a tokenization automaton.

``MergeAutomaton`` is the deterministic automaton whose paths are exactly
the token sequences that byte-pair encoding gives.  It is compiled from the
merge list by one gadget per merge, in rank order.  It starts with every
state having an arc for every base symbol; the state entered by an arc is
named by the arc's label, so the automaton stays deterministic.  The gadget
of ``(a, b) -> c``:

* ``S_c`` becomes a copy of ``S_b`` as it is then;
* ``S_a`` loses its arc ``b`` (``a b`` is never left unmerged);
* every state that has an arc ``a`` (now) gets the arc ``c``.

A merge whose arc ``a b`` doesn't exist at its turn can never apply and
adds nothing.  States are kept as versions instead of copies: each gadget
records its turn, what its state was copied from, which arc made its arc
and which arc it removed.  That is linear in the merges, where written-out
copies would need (tokens)^2 arcs.  ``arc`` reads a transition from these
tables by stepping back through the gadgets, and keeps the answer in the
transition table.

Encoding a word walks the automaton by table transitions, longest label
first, never twice from the same place; decoding emits the labels of the
arcs.

Defined results: null text is the empty text (no ids, empty decoded text);
ties and repeated rows give one row each; an empty table gives no rows;
other columns are ignored.
"""
from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as T

#: Remembered runs, words and transitions per Python worker.
RUNS_KEPT, WORDS_KEPT, ARCS_KEPT = 300_000, 300_000, 2_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], arcs_kept: int = ARCS_KEPT):
        self.ids = dict(vocab)
        self.labels = {i: s for s, i in vocab.items()}
        size = max(self.labels) + 1 if self.labels else 0
        self.turn = [-1] * size          # 2 * rank of the gadget that made the token, -1: base symbol
        self.copied = [-1] * size        # the state it was copied from
        self.through = [-1] * size       # the arc that made its arc
        self.removed: dict[int, int] = {}
        self.size, self.arcs_kept = size, arcs_kept
        self.table: dict[int, bool] = {}
        dead: set[int] = set()
        for rank, (a, b) in enumerate(merges):
            x, y, c = self.ids[a], self.ids[b], self.ids[a + b]
            if self.turn[c] >= 0:
                continue
            if x in dead or y in dead or not self._step_back(x, y, 2 * rank):
                dead.add(c)
                continue
            dead.discard(c)
            self.turn[c], self.copied[c], self.through[c] = 2 * rank, y, x
            self.removed[x * size + y] = 2 * rank
        self.ids = {s: i for s, i in self.ids.items() if i not in dead}
        self.longest = max(map(len, self.ids), default=0)

    def _step_back(self, x: int, y: int, time: int) -> bool:
        """Whether ``S_x`` had the arc ``y`` just before ``time``."""
        turn, removed, size = self.turn, self.removed, self.size
        while True:
            gone = removed.get(x * size + y)
            if gone is not None and gone < time:
                return False
            if turn[x] > turn[y]:        # S_x is the copy of another state, made then
                time = turn[x]
                x = self.copied[x]
            elif turn[y] >= 0:           # arc y was given to the states that had its first part
                time = turn[y] + 1
                y = self.through[y]
            else:
                return True

    def arc(self, x: int, y: int) -> bool:
        """Whether the finished automaton has the arc ``y`` from ``S_x``."""
        key = x * self.size + y
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= self.arcs_kept:
                self.table.clear()
            known = self.table[key] = self._step_back(x, y, 1 << 60)
        return known

    def encode(self, word: str, end: str = "") -> list[int]:
        """Token ids of one word of base symbols; ``end`` is added to its last symbol.

        Follows arcs from the start state, longest label first.  A word's
        prefix has one accepted path only, so a place from which no arc leads
        on is never tried again and the walk is linear in the word.
        """
        n, get, table, size, longest = len(word), self.ids.get, self.table, self.size, self.longest
        out: list[int] = []
        cuts = [0]
        shut: set[int] = set()
        at, state, upto = 0, -1, n
        while at < n:
            for i in range(min(upto, at + longest), at, -1):
                t = get(word[at:i] if i < n else word[at:] + end)
                if t is None or i in shut:
                    continue
                if state >= 0:
                    ok = table.get(state * size + t)
                    if not (self.arc(state, t) if ok is None else ok):
                        continue
                out.append(t)
                cuts.append(i)
                at, state, upto = i, t, n
                break
            else:
                if not out:
                    raise ValueError(f"no token sequence for {word!r}")
                shut.add(at)
                out.pop()
                upto = cuts.pop() - 1
                at, state = cuts[-1], out[-1] if out else -1
        return out

    def decode(self, ids: Iterable[int]) -> list[str]:
        """Labels of the arcs taken; ids without an arc of their own (added tokens) are not known here."""
        return [self.labels[i] for i in ids]


class WordBPE:
    """The tokenizer file's whole path: added tokens, normaliser, pre-split, automaton, labels.

    Serves files of the kind NFC + white space to a blank + lower case,
    words by pattern, byte symbols, an end-of-word mark and no decoder
    (decoding then joins labels by blanks).
    """

    #: White space of the tokenizer's patterns.
    BLANKS = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or spec["decoder"] is not None:
            raise ValueError("not a tokenizer file of the kind this encoder serves")
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.end = model["end_of_word_suffix"] or ""
        self.automaton = MergeAutomaton(model["vocab"], merges)
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.automaton.labels.update({i: s for s, i in self.added.items()})
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.words = regex.compile(split["pattern"]["Regex"].replace("\\s", "\\p{White_Space}"))
        self.blank = regex.compile(self.BLANKS + "+")
        self.symbols = dict(enumerate(byte_symbols()))
        self.by_word: dict[str, tuple[bytes, str]] = {}
        self.by_run: dict[str, tuple[bytes, str]] = {"": (b"", "")}

    def _word(self, word: str) -> tuple[bytes, str]:
        known = self.by_word.get(word)
        if known is None:
            plain = word.isascii() and word.isalnum()  # such symbols stand for themselves
            base = word if plain else word.encode().decode("latin-1").translate(self.symbols)
            ids = self.automaton.encode(base, self.end)
            known = np.array(ids, "<u4").tobytes(), " ".join(self.automaton.decode(ids))
            if len(word) <= T.RUN_CHARS:
                if len(self.by_word) >= WORDS_KEPT:
                    self.by_word.clear()
                self.by_word[word] = known
        return known

    def _run(self, run: str) -> tuple[bytes, str]:
        """Ids and labels of a text without blanks and line feeds (or any text)."""
        ids, labels = [], []
        for part in self.added_split.split(run) if "<|" in run else (run,):
            if part in self.added:
                ids.append(np.array([self.added[part]], "<u4").tobytes())
                labels.append(part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # lower case without context
            part = self.blank.sub(" ", part).lower()
            for word in self.words.findall(part):
                a, b = self._word(word)
                ids.append(a)
                labels.append(b)
        return b"".join(ids), " ".join(labels)

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of a whole text."""
        by_run, found = self.by_run, []
        for run in (text or "").replace("\n", " ").split(" "):
            known = by_run.get(run)
            if known is None:
                known = self._run(run)
                if len(run) <= T.RUN_CHARS:
                    if len(by_run) >= RUNS_KEPT:
                        by_run.clear()
                        by_run[""] = b"", ""
                    by_run[run] = known
            if known[0]:
                found.append(known)
        return b"".join([k[0] for k in found]), " ".join([k[1] for k in found])


_CODERS: dict[str, WordBPE] = {}


def coder(path: str) -> WordBPE:
    if path not in _CODERS:
        _CODERS[path] = WordBPE(path)
    return _CODERS[path]


def encode_documents(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``, ``decoded``) of ``docs(doc_id, text)``.

    One pass over the scan: no exchange.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = coder(tokenizer)
        for pdf in parts:
            out = {"doc_id": pdf["doc_id"].astype("Int64")}
            counts, shas, texts, ids_all, decoded_all = [], [], [], [], []
            for text in pdf["text"]:
                ids, decoded = bpe.encode(text)
                counts.append(len(ids) // 4)
                shas.append(hashlib.sha256(ids).hexdigest())
                texts.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    ids_all.append(ids)
                    decoded_all.append(decoded)
            out |= {"n_tokens": counts, "ids_sha256": shas, "decoded_sha256": texts}
            if with_ids:
                out |= {"ids": ids_all, "decoded": decoded_all}
            yield pd.DataFrame(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInPandas(run, schema + (", ids binary, decoded string" if with_ids else ""))


def bpe_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """op3: every document with the word-level BPE file."""
    return encode_documents(docs, T.tokenizer_path())
