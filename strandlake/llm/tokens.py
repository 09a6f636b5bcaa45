"""Operator 10: exact token counts at every prefix, by dynamic programming over byte-level BPE.

For a byte-pair vocabulary the encoding of a string is the only split in which
every adjacent token pair is one that the merges would leave alone.  So the last
token of each prefix, and with it the prefix's exact count, follows from those of
shorter prefixes: ``count[i] = count[i - len(t)] + 1`` for the one token ``t`` that
ends at ``i`` and is compatible with the last token before it.

Texts are cut at spaces that follow a non-space character.  No pre-token spans
such a cut, so a text's prefix table is the running sum of the tables of its
chunks; tables of chunks are kept between rows.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, require, texts

_CUT = re.compile(r"(?<=\S)(?= )")
_ODD_RUN = re.compile(r"\s[ ]")
#: Letters with at most some signs after them: their pre-tokens are plain in every version of Unicode.
_SIMPLE = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([-.,;:!?|#$%&*()]*)")
#: Printable stand-ins of the byte-level alphabet: printable Latin-1 bytes as they are, the others from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: chr(b) if b in _PRINTABLE else chr(256 + sum(x not in _PRINTABLE for x in range(b))) for b in range(256)}
_CACHE: dict[str, "PrefixCounter"] = {}
#: Chunk tables kept by a worker; the store is emptied when full, so its memory is bounded.
MAX_CHUNKS = 400_000
#: Documents whose chunks are looked up together.
WARM = 1000
MAX_PAIRS = 400_000


class PrefixCounter:
    """Prefix token counts of one byte-level BPE vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        cut = told.get("pre_tokenizer") or {}
        if told.get("normalizer") or told["model"]["type"] != "BPE" or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) != ("ByteLevel", False, True):
            raise ValueError(f"prefix counts need a byte-level vocabulary without normalization; {path} is none")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        #: True for a token that its own merges reach, False for what only ends such a token.
        self.endings: dict[str, bool] = {}
        for token in self.tok.get_vocab(with_added_tokens=False):
            if self._merged(token) == [token]:
                for k in range(1, len(token)):
                    self.endings.setdefault(token[k:], False)
                self.endings[token] = True
        self.special = sorted((a.content for a in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pairs: dict[tuple[str, str], bool] = {}
        self.chunks, self.spaced, self.words = _Store(self.chunk_table), _Store(lambda w: self.chunk_table(" " + w)), _Store(self._word)
        self.before: tuple[str, list[int], list[str]] = "", [0], [""]
        #: Counts at each prefix of the longest run of one white-space character so far, by character.
        self.runs: dict[str, tuple[int, list[int]]] = {}

    @classmethod
    def load(cls, path: str) -> "PrefixCounter":
        if path not in _CACHE:
            _CACHE[path] = cls(path)
        return _CACHE[path]

    def _merged(self, piece: str) -> list[str]:
        return [t.value for t in self.model.tokenize(piece)]

    def _is_pair(self, key: tuple[str, str]) -> bool:
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        known = self.pairs[key] = self._merged(key[0] + key[1]) == [*key]
        return known

    def _piece(self, piece: str) -> list[int]:
        """Counts at each byte prefix of one pre-token, given in the byte alphabet."""
        n, kind, known = len(piece), self.endings.get, self.pairs.get
        count, last, start = [0] * (n + 1), [""] * (n + 1), 1
        # In sorted order words share beginnings, and a prefix has one table whatever follows it.
        before, before_count, before_last = self.before
        while start <= n and piece[:start] == before[:start]:
            start += 1
        count[:start], last[:start] = before_count[:start], before_last[:start]
        for i in range(start, n + 1):
            j = i - 1
            while True:
                token = piece[j:i]
                is_token = kind(token)
                if is_token is None or j < 0:
                    raise ValueError("the vocabulary lacks a byte")
                if is_token:
                    if j == 0:
                        break
                    fits = known(key := (last[j], token))
                    if fits or fits is None and self._is_pair(key):
                        break
                j -= 1
            count[i], last[i] = count[j] + 1, token
        self.before = piece, count, last
        return count

    def _word(self, word: str) -> bytes:
        """The steps of a pre-token of plain letters or signs, perhaps after a space."""
        ends = self._char_counts(word, word.replace(" ", _BYTES[32]) if word.isascii() else "".join([_BYTES[b] for b in word.encode()]))
        return bytes([(y - x) & 255 for x, y in zip(ends, ends[1:])])

    def _counts_plain(self, text: str) -> list[int]:
        """Exact count at each character prefix of a text without special strings."""
        out, base, run = [0], 0, (0, 0, [0])
        for piece, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text):
            part = text[a:b]
            if part[0].isspace() and not run[0] <= a < run[1]:
                run = self._run(text, a, out)
            if part.isspace():
                out += run[2][a + 1 - run[0] : b + 1 - run[0]]
                base += len(self._merged(piece))
            elif part[0] == "'" and len(part) <= 3 and part[1:].isalpha():
                # "'r" is two pre-tokens, "'re" is one.
                for i in range(a + 1, b + 1):
                    out.append(base + len(self._encode(text[a:i])))
                base = out[-1]
            else:
                ends = self._char_counts(part, piece)
                # its first space ends the run of white space that it is part of until something follows
                first = run[2][a + 1 - run[0]] if part[0].isspace() and a > run[0] else base + ends[1]
                out.append(first)
                out += [base + c for c in ends[2:]]
                base = out[-1] if len(part) > 1 else base + ends[-1]
        return out

    def _char_counts(self, text: str, piece: str) -> list[int]:
        """``_piece`` at the end of each character of ``text``, whose bytes ``piece`` stands for."""
        count = self._piece(piece)
        if len(piece) == len(text):
            return count
        at, ends = 0, [0]
        for ch in text:
            at += len(ch.encode())
            ends.append(count[at])
        return ends

    def _run(self, text: str, start: int, out: list[int]) -> tuple[int, int, list[int]]:
        """Start, end and counts at each prefix of the white space from ``start`` on.

        Such a run is one pre-token for as long as nothing follows it.
        """
        end = start + len(text[start:]) - len(text[start:].lstrip())
        white = text[start:end]
        pieces = self.tok.pre_tokenizer.pre_tokenize_str(white)
        if len(pieces) == 1:
            known = self.runs.get(white[0], (0, [0])) if white.count(white[0]) == len(white) else None
            if known is None:
                counts = self._char_counts(white, pieces[0][0])
            else:
                if known[0] < len(white):
                    # a run of one character begins all longer ones
                    known = self.runs[white[0]] = (len(white), self._char_counts(white, pieces[0][0]))
                counts = known[1]
        else:
            counts = [len(self._encode(white[:i])) for i in range(len(white) + 1)]
        return start, end, [out[start] + c for c in counts[: len(white) + 1]]

    def _encode(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _counts(self, chunk: str) -> list[int]:
        if not self.split_special or not any(s in chunk for s in self.special):
            return self._counts_plain(chunk)
        # parts: plain, special, plain, ...; a special string that isn't complete yet is plain text after the plain part.
        out, parts = [0], self.split_special.split(chunk)
        for k in range(0, len(parts), 2):
            base, plain, special = out[-1], parts[k], parts[k + 1] if k + 1 < len(parts) else ""
            out += [base + c for c in self._counts_plain(plain)[1:]]
            if special:
                end = out[-1]
                out += [base + c for c in self._counts_plain(plain + special[:-1])[len(plain) + 1 :]] + [end + 1]
        return out

    def chunk_table(self, chunk: str) -> bytes:
        if simple := _SIMPLE.fullmatch(chunk):
            word, signs = simple.groups()
            return self.words[word] + self.words[signs] if signs else self.words[word]
        if "\n" in chunk and all(lines := [_SIMPLE.fullmatch(x) for x in chunk.split("\n")]) and not any(x[1][0] == " " for x in lines[1:]):
            return b"\x01".join([self.words[x[1]] + (self.words[x[2]] if x[2] else b"") for x in lines])
        counts = self._counts(chunk) if chunk else [0]
        steps = [y - x for x, y in zip(counts, counts[1:])]
        if steps and not -128 <= min(steps) <= max(steps) < 128:
            raise ValueError("a token is longer than a step can hold")
        return bytes([x & 255 for x in steps])

    def steps(self, text: str) -> bytes:
        """One signed byte a character: what it adds to the count of the prefix it ends."""
        if _ODD_RUN.search(text):
            return b"".join(map(self.chunks.__getitem__, _CUT.split(text)))
        head, *rest = text.split(" ")
        return self.chunks[head] + b"".join(map(self.spaced.__getitem__, rest))

    def warm(self, batch: list[str]) -> None:
        """Make the tables of a batch's new chunks in sorted order."""
        new: set[str] = set()
        for text in batch:
            if "  " not in text:
                new.update(text.split(" ")[1:])
        store = self.spaced
        for word in sorted(new):
            store[word]

    def prefix_counts(self, text: str) -> np.ndarray:
        """count[i]: tokens of ``text[:i]``, for i from 0 to its length."""
        return np.concatenate([[0], np.cumsum(np.frombuffer(self.steps(text), np.int8), dtype=np.int64)])

    def total(self, text: str) -> int:
        return int(np.frombuffer(self.steps(text), np.int8).sum(dtype=np.int64))

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that takes ``budget`` tokens or fewer."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])


class _Store(dict):
    """What ``make`` gives for each short key, emptied when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) >= MAX_CHUNKS:
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


def count_tokens(docs: DataFrame, vocabulary: str, *, limit: int = 1024, keep_table: bool = False) -> DataFrame:
    """Exact token counts of whole texts, with the table of every prefix.

    ``docs`` has doc_id and text; further columns are ignored.  Returns a row for
    each row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``),
    fit_chars (characters of the longest prefix within ``limit``) and, with
    ``keep_table``, steps: one signed byte a character whose running sum is the
    count at each prefix.  No begin, end or padding tokens are added; special
    strings inside texts are single tokens, as the library has it.  A null text is
    an empty one: no bytes, no tokens.  Repeated rows give repeated results; long
    texts and long runs of white space take time in proportion; an empty table gives
    an empty one.
    """
    require(docs, "doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint" + ", steps binary" * keep_table

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = PrefixCounter.load(vocabulary)
        n_bytes, n_tokens, fit, tables = [], [], [], []
        rows = texts(batch.column(1))
        for at, text in enumerate(rows):
            if at % WARM == 0:
                counter.warm(rows[at : at + WARM])
            steps = counter.steps(text)
            counts = np.frombuffer(steps, np.int8).cumsum(dtype=np.int32)
            total = int(counts[-1]) if len(counts) else 0
            n_bytes.append(len(text) if text.isascii() else len(text.encode()))
            n_tokens.append(total)
            fit.append(len(text) if total <= limit else int(len(counts) - np.argmax(counts[::-1] <= limit)) if (counts <= limit).any() else 0)
            if keep_table:
                tables.append(steps)
        cols = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(fit, pa.int64())]
        names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"]
        if keep_table:
            cols.append(pa.array(tables, pa.binary()))
            names.append("steps")
        return pa.RecordBatch.from_arrays(cols, names)

    return map_arrow(docs.select("doc_id", "text"), run, schema)
