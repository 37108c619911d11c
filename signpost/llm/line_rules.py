"""Quality rules, line first.

Every line is judged alone: too many symbols for its letters (punctuation rule), a menu of short linked words
(navigation), or a third of it in sentences with a phrase of licences, consent and site furniture (boilerplate), however
long it is. Failing lines are removed, and a
document that loses more than `max_loss` of its word characters with them is rejected. Before that stand the base rules:
fewer than 50 words, or more than half of the words in repeated three-word windows.

Defined cases: null and empty texts have no words and fail the base rules; repeated rows are judged alike; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import pandas as pd
from pyspark.sql import DataFrame

MIN_WORDS = 50
#: A line fails when symbols reach this share of its word characters.
MAX_SYMBOLS = 0.1
#: A document is rejected when its removed lines hold more than this share of its word characters.
MAX_LOSS = 0.5
#: A line fails when sentences with a boilerplate phrase hold at least this share of its word characters.
MAX_BOILERPLATE = 1 / 3
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
SEPARATOR = re.compile(rb"\||>|\xc2\xbb|\xe2\x80\xba")
#: Most bytes of an entry of a menu.
MENU_ENTRY = 30
BOILERPLATE = re.compile(
    rb"all rights reserved|released under the [\w .-]{1,40}licen[cs]e|licensed under|cookie(?:s| policy)|privacy policy"
    rb"|terms of (?:use|service)|click here|subscribe to|sign (?:in|up)|log ?in\b|enable javascript|copyright \(c\)"
    rb"|\(c\) \d{4}|lorem ipsum|share (?:this|on)|read more",
    re.I,
)
#: Ends of sentences: a mark before white space, or a full-width one.
SENTENCE_END = re.compile(rb"[.!?]+(?=\s)|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    hit = [counts[w] > 1 for w in windows]
    return sum(a or b or c for a, b, c in zip([*hit, False, False], [False, *hit, False], [False, False, *hit], strict=True))


def is_menu(line: bytes) -> bool:
    """At least three short entries between separators; the last one may be empty."""
    *entries, last = SEPARATOR.split(line.strip(SPACE))
    return len(entries) > 1 and len(last) <= MENU_ENTRY and all(0 < len(e) <= MENU_ENTRY for e in entries)


def line_fails(line: bytes, n_chars: int) -> bool:
    """n_chars: the line's word characters."""
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if symbols >= MAX_SYMBOLS * n_chars:
        return True
    if is_menu(line):
        return True
    hits = [m.span() for m in BOILERPLATE.finditer(line)]
    return bool(hits) and _sentences_size(line, hits) >= MAX_BOILERPLATE * n_chars


def _sentences_size(line: bytes, hits: list[tuple[int, int]]) -> int:
    """Word characters of the sentences that the hits lie in."""
    size = start = i = 0
    for end in [*(m.end() for m in SENTENCE_END.finditer(line)), len(line)]:
        while i < len(hits) and hits[i][1] <= start:
            i += 1
        if i < len(hits) and hits[i][0] < end:
            size += _code_points(line[start:end].translate(None, SPACE))
        start = end
    return size


def _code_points(b: bytes) -> int:
    """Continuation bytes of UTF-8 do not count."""
    return len(b) if b.isascii() else len(b.decode("utf-8", "replace"))


def judge(text: str | None) -> tuple[int, int, int, int, int, bool, bool, int, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars, cleaned text."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    word_chars = _code_points(b"".join(words))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = raw.split(b"\n")
    sizes = [_code_points(line.translate(None, SPACE)) for line in lines]
    worded = list(compress(lines, sizes))
    n_dup = len(worded) - len(set(worded))
    n_repeat = repeated_words(words)
    base_failed = len(words) < MIN_WORDS or 100 * n_repeat > 50 * len(words)
    good = [not size or not line_fails(line, size) for line, size in zip(lines, sizes, strict=True)]
    lost = sum(size for size, ok in zip(sizes, good, strict=True) if not ok)
    kept = not base_failed and lost <= MAX_LOSS * word_chars
    cleaned = b"\n".join(compress(lines, good)).decode("utf-8", "replace")
    return len(words), word_chars, n_symbols, n_dup, n_repeat, base_failed, kept, lost, cleaned


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def judge_documents(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id and the counts and verdicts of `judge`; with_text adds `cleaned`, the text without its failing lines."""
    names = (*COLUMNS, "cleaned") if with_text else COLUMNS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [judge(x)[: len(names)] for x in batch["text"]]
            out = pd.DataFrame(found, columns=list(names))
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    kinds = {"base_failed": "boolean", "kept": "boolean", "cleaned": "string"}
    schema = "doc_id long, " + ", ".join(f"{n} {kinds.get(n, 'long')}" for n in names)
    return docs.select("doc_id", "text").mapInPandas(run, schema)
