"""Secret scans: fixed patterns, and guess costs of values in credential contexts."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A value that a credential word announces, whatever its alphabet.
CONTEXT = re.compile(
    r"""(?i:(?<![a-z])(?:pass(?:word|wd|phrase)?|pwd|secret(?:[_-]?key)?|(?:access|auth|refresh|bearer)?[_-]?token|api[_-]?key|private[_-]?key|credentials?|bearer))"""
    r"""["']?[\x20\t]*(?::=|=>|[:=]|(?<=(?i:bearer))\x20)[\x20\t]*["']?([^\s"'<>,;]{8,})""",
    re.A,
)
#: A text without any of these can't match; looking for them first is much cheaper.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "api", "private", "credential", "bearer")
LOGIN = re.compile(r"://[^\s/:@\"'<>]+:([^\s/@\"'<>]{4,})@")

# Very common words and passwords, most common first.
COMMON = (
    "password 123456 12345678 qwerty abc123 monkey letmein dragon baseball iloveyou trustno1 sunshine master welcome shadow "
    "ashley football jesus michael ninja mustang admin login princess solo starwars hello freedom whatever passw0rd charlie "
    "superman batman hunter jordan secret summer winter spring autumn love test guest root user default changeme example sample "
    "the and that for with this from have your will can are not you all new one time day year people work home house money "
    "water light dark night star moon fire green blue black white red cat dog horse tiger lion eagle bird fish tree flower "
    "apple orange banana computer internet server system network data access token key code file service account client public "
    "private temp demo null none true false value string placeholder redacted hidden"
).split()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
#: Letters of a word at most.
LONGEST = 16
# The rows of a US keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@301!5$7", "aaeoiisst")
NEAR = {
    a: frozenset(
        ROWS[r + dr][c + dc]
        for dr, dc in ((0, -1), (0, 1), (-1, 0), (-1, 1), (1, 0), (1, -1))
        if 0 <= r + dr < 4 and 0 <= c + dc < len(ROWS[r + dr])
    )
    for r, row in enumerate(ROWS)
    for c, a in enumerate(row)
}
DATES = (
    re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d"),
    re.compile(r"(?:19|20)\d\d"),
)
#: Signs between words.
SEPARATORS = "_-./:(),"
#: Values that cost 10**GUESS_LOG10 guesses or more are reported.
GUESS_LOG10 = 10.0
#: What a span behind another adds.
FURTHER = 0.3
#: Signs of a long value that are looked at first.
LEADING = 256


@lru_cache(maxsize=1)
def _ranks() -> dict[str, int]:
    """Ranks of the common words, and behind them of the words of three letters
    or more and the word parts of four or more of the vocabulary, which has
    frequent ones first."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    out = dict(RANK)
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        w = p.lstrip("▁").lower()
        if 3 + (w == p.lower()) <= len(w) <= LONGEST and w.isascii() and w.isalpha():
            out.setdefault(w, len(out) + 1)
    return out


def _pool(s: str) -> int:
    n = 0
    n += 26 * any("a" <= c <= "z" for c in s)
    n += 26 * any("A" <= c <= "Z" for c in s)
    n += 10 * any("0" <= c <= "9" for c in s)
    n += 33 * any(not c.isalnum() and c < "\x7f" for c in s)
    return n + 100 * any(c >= "\x7f" for c in s)


def _ends(i: int, last: int, least: int, step: int = 1):
    """Where a span that may end at ``last`` ends: there, or up to ``LONGEST``
    signs before, where a word that overlaps it may begin."""
    return range(last, max(least, last - LONGEST) - 1, -step)


def _edges(s: str):
    """(start, end, log10 of the guesses, kind) of every span that isn't brute
    force.  Time and number are linear in ``s``: of a repeat or walk, the ends
    that :func:`_ends` gives."""
    n, low = len(s), s.lower()
    low = low if len(low) == n else s
    plain = low.translate(LEET)
    ranks = _ranks()
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            rank = ranks.get(low[i:j])
            odd = 0 if s[i:j] == low[i:j] else 1
            if rank is None and (rank := ranks.get(plain[i:j])):
                odd += 1
            if rank:
                yield i, j, math.log10(rank * 2**odd * (4 if odd else 1)), "word"
    for i in range(n):
        if s[i] in SEPARATORS:
            yield i, i + 1, math.log10(len(SEPARATORS)), "separator"
    for i in range(n):
        for pattern in DATES:
            if m := pattern.match(s, i):
                yield i, m.end(), math.log10(120 if m.end() - i == 4 else 365 * 120 * 4), "date"
    for size in range(1, 9):
        same = 0  # so many signs from here on equal those ``size`` later
        for i in range(n - size - 1, -1, -1):
            same = same + 1 if s[i] == s[i + size] else 0
            if same >= size:
                base = math.log10(max(10, _pool(s[i : i + size]))) * size
                for j in _ends(i, i + size + same // size * size, i + max(2 * size, 3), size):
                    yield i, j, base + math.log10((j - i) // size), "repeat"
    # a walk goes on while each sign is next to the one before
    turns = [0] * (n + 1)  # changes of direction up to here
    for i in range(2, n):
        turns[i] = turns[i - 1] + (_step(low, i) != _step(low, i - 1))
    end = n
    for i in range(n - 2, -1, -1):
        end = end if low[i + 1] in NEAR.get(low[i], ()) else i + 1
        for j in _ends(i, end, i + 4):
            yield i, j, math.log10(94) + (1 + turns[j - 1] - turns[i + 1]) * math.log10(6) + math.log10(j - i), "walk"
    end, ahead = n, 0
    for i in range(n - 2, -1, -1):
        d = ord(low[i + 1]) - ord(low[i]) if low[i : i + 2].isalnum() else 0
        d = d if d in (1, -1) else 0
        end = i + 1 if not d else end if d == ahead else i + 2
        ahead = d
        for j in _ends(i, end, i + 3):
            yield i, j, math.log10(26 * 2 * (j - i)), "walk"


def _step(low: str, i: int):
    """Direction on the keyboard from the sign before ``i``."""
    a, b = ROWS_AT.get(low[i - 1]), ROWS_AT.get(low[i])
    return None if a is None or b is None else b - a


ROWS_AT = {a: r * 100 + c for r, row in enumerate(ROWS) for c, a in enumerate(row)}


@lru_cache(maxsize=4096)
def _short_cost(value: str) -> float:
    return _cheapest(value)


def _cheapest(value: str) -> float:
    n = len(value)
    each = math.log10(max(10, _pool(value)))
    best = [0.0] + [math.inf] * n
    ends: list[list] = [[] for _ in range(n + 1)]
    for i, j, cost, _ in _edges(value):
        ends[j].append((i, cost))
    for j in range(1, n + 1):
        best[j] = min(best[j - 1] + each, min((best[i] + max(cost, 0.0) + (FURTHER if i else 0.0) for i, cost in ends[j]), default=math.inf))
    return best[n]


def guess_cost(value: str) -> float:
    """log10 of the guesses for ``value``: the cheapest way to cut it into common
    words, separators, dates, repeats, keyboard walks, runs and brute-force
    signs, where each span but the first costs ``FURTHER`` more.  The whole
    value, however long, in time linear in it."""
    return _short_cost(value) if len(value) <= 64 else _cheapest(value)


def is_guess(value: str, least: float = GUESS_LOG10) -> bool:
    """Whether a credential-context value is a secret: costly to guess,
    and no reference to a variable or a placeholder."""
    body = value.strip(".,:;!?)(]}[{")
    if len(body) < 8 or body.startswith(("$", "{{", "%", "<")):
        return False
    # a span over the border of a leading part stands for LONGEST brute-force signs
    # of it at most, so a part that costs that much more decides for the whole
    head = body[:LEADING]
    if len(head) < len(body) and guess_cost(head) - LONGEST * math.log10(_pool(head) or 10) >= least:
        return True
    return guess_cost(body) >= least


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, where the secret itself starts), by start, then kind."""
    low = text.lower()
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out = [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def all_spans(text: str, least: float = GUESS_LOG10) -> list[tuple[int, int, str, int]]:
    """The base spans, and ``guess`` spans of costly values that no single base span
    holds whole; they may overlap base spans."""
    base = base_spans(text)
    more = []
    low = text.lower()
    for pattern, words in ((CONTEXT, CONTEXT_WORDS), (LOGIN, ("://",))):
        if not any(w in low for w in words):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(1)
            if not any(s <= a and b <= e for s, e, _, _ in base) and is_guess(m[1], least):
                more.append((a, b, "guess", a))
    return sorted({*base, *more}, key=lambda x: (x[0], KINDS.index(x[2]), x[1])) if more else base


def joined(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k, _ in spans)


def redact(text: str, mark: str = "[REDACTED]") -> str:
    """``text`` with each secret replaced by ``mark``; overlapping ones by one."""
    out, at = [], 0
    for start, end in sorted((v, e) for _, e, _, v in all_spans(text)):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:] if out else text


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        cols: list[list] = [[], [], [], [], []]
        for text in batch.column("text"):
            spans = all_spans(text.as_py())
            base = [x for x in spans if x[2] != "guess"]
            for k in range(3):
                cols[k].append(sum(x[2] == KINDS[k] for x in base))
            cols[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
            cols[4].append(joined(spans))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Positions are code points, ends exclusive.  A null or empty text has no
    spans; repeated rows stay repeated, a null id stays null.  Whole texts are
    scanned where they lie: no shuffle.
    """
    return docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(
        _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def _redact(column: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [None if t is None else redact(t) for t in batch.column(column).to_pylist()]
        yield batch.set_column(column, batch.schema.field(column), pa.array(texts, batch.schema.field(column).type))


def redact_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; all columns and rows stay."""
    at = docs.columns.index(text)
    return docs.mapInArrow(lambda it, k=at: _redact(k, it), docs.schema)
