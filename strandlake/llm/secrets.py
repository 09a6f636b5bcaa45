"""Operator 7: secret scans.

An Aho-Corasick automaton finds the keywords of every rule in one pass over a
text; a regular expression is tried only where a keyword starts, anchored there;
rules whose tokens carry a checksum (CRC-32, mod 97, Luhn) keep a hit only if it
holds.  Runs of
hexadecimal digits have no keyword; a probe of every 16th byte of the whole
Arrow buffer tells which texts can hold one at all.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, require, text_buffer, texts

# Kinds in the order in which spans at one place are listed, their keywords and patterns.
KINDS = ("assign", "access", "hex", "forge_token", "registry_token", "bank_account", "payment_card")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
FORGE = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
REGISTRY = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
ACCOUNT = re.compile(r"iban[\"']?[ :=#]{0,3}[\"']?([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", re.IGNORECASE | re.ASCII)
CARD = re.compile(r"(?:credit card|debit card|card number|visa|mastercard|amex)[\"']?(?: no\.?| number)?[ :=#]{0,3}[\"']?([0-9](?:[ -]?[0-9]){12,18})(?![0-9])", re.IGNORECASE | re.ASCII)
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "forge_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "registry_token": ("npm_",),
    "bank_account": ("iban",),
    "payment_card": ("credit card", "debit card", "card number", "visa", "mastercard", "amex"),
}
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
RULES = {"assign": ASSIGN, "access": ACCESS, "forge_token": FORGE, "registry_token": REGISTRY, "bank_account": ACCOUNT, "payment_card": CARD}

_UPPER = dict(zip(range(65, 91), range(97, 123)))
_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*range(48, 58), *range(97, 103)]] = True
_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        _AUTOMATON = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for word in words:
                _AUTOMATON.add_word(word, (kind, len(word)))
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def checksum62(body: str) -> str:
    """CRC-32 of a token's body in base 62, six digits."""
    value, out = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        out = DIGITS62[digit] + out
    return out.rjust(6, "0")


def mod97(account: str) -> int:
    """An account number's remainder by 97: country and check digits last, letters as 10 to 35; 1 if it is right."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def luhn(number: str) -> int:
    """A card number's digit sum, every second from the right doubled, by 10; 0 if it is right."""
    digits = [int(c) for c in reversed(number)]
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(digits)) % 10


def _passes(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 8
    if kind == "access":
        return m.end() - m.start() >= 16
    if kind == "bank_account":
        return mod97(m[1].replace(" ", "").upper()) == 1
    if kind == "payment_card":
        return luhn(re.sub("[ -]", "", m[1])) == 0
    return checksum62(m[1]) == m[2]


def find_secrets(text: str, may_hold_hex: bool = True) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind as listed."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = text.translate(_UPPER)
    found: list[tuple[str, int, int]] = []
    past = dict.fromkeys(RULES, 0)
    hits: dict[str, list[int]] = {}
    for end, (kind, n) in _automaton().iter(lower):
        hits.setdefault(kind, []).append(end + 1 - n)
    for kind, starts in hits.items():
        rule = RULES[kind]
        for start in sorted(set(starts)):
            # A failing match takes its place too: matches of a kind never overlap.
            if start >= past[kind] and (m := rule.match(text, start)):
                past[kind] = m.end()
                if _passes(kind, m):
                    found.append((kind, start, m.end()))
    if may_hold_hex:
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if len(found) > 1:
        found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def hex_candidates(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts may hold 32 hexadecimal digits in a row: such a run has two neighbours among every 16th byte."""
    probe = _IS_HEX[data[::16]]
    at = np.flatnonzero(probe[:-1] & probe[1:]) * 16
    may = np.zeros(len(offsets) - 1, bool)
    may[np.clip(np.searchsorted(offsets, at, "right") - 1, 0, max(0, len(may) - 1))] = True
    may[np.clip(np.searchsorted(offsets, at + 16, "right") - 1, 0, max(0, len(may) - 1))] = True
    return may


def _scan(batch_text: pa.Array) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    may = hex_candidates(*text_buffer(batch_text)) if len(batch_text) else []
    for text, hexy in zip(texts(batch_text), may):
        yield text, find_secrets(text, bool(hexy))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in every whole text.

    ``docs`` has doc_id and text; further columns are ignored.  Returns a row for
    each row: doc_id; n_assign, n_access, n_hex; base_spans (kind:start:end of
    those three kinds, comma-joined), base_sha256 of that; spans (all kinds).
    Offsets are code points, ends exclusive.  A null or empty text has no spans.
    Repeated rows give repeated results; long texts are scanned whole; an empty
    table gives an empty one.
    """
    require(docs, "doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, list[int]] = {k: [] for k in KINDS[:3]}
        base, digests, spans = [], [], []
        for _, found in _scan(batch.column(1)):
            kinds = [s[0] for s in found]
            for k, c in counts.items():
                c.append(kinds.count(k))
            base.append(b := _joined([s for s in found if s[0] in counts]))
            digests.append(hashlib.sha256(b.encode()).hexdigest())
            spans.append(_joined(found))
        arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts.values()), pa.array(base, pa.string()), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "base_sha256", "spans"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with each maximal covered stretch replaced by ``mark``."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs``, all columns and rows, with the secrets in text replaced; null texts stay null.

    A column n_chars, if there is one, follows the new text; all others stay,
    whatever their names.  Overlapping spans are one mark; repeated rows are treated
    alike; an empty table gives an empty one.
    """
    require(docs, "text")
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(at)
        new = [redact(text, found, mark) if found else text for text, found in _scan(column)]
        valid = column.is_valid().to_pylist()
        arrays = list(batch.columns)
        arrays[at] = pa.array([t if v else None for t, v in zip(new, valid)], column.type)
        if "n_chars" in batch.schema.names:
            k = batch.schema.get_field_index("n_chars")
            old = arrays[k].to_pylist()
            arrays[k] = pa.array([len(t) if v else n for t, v, n in zip(new, valid, old)], arrays[k].type)
        return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return map_arrow(docs, run, docs.schema)
