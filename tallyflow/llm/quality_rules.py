"""Line-first cleaning: rules for each line, failing lines removed, documents that lose too much rejected.

A line fails when it ends neither as a sentence nor, if long enough, in a colon, shouts, is navigation (separated items, or a short line repeated
through the text), is symbol noise, or is boilerplate such as licence and cookie notices.

Defined cases: a null text has no words and fails the base rule; lines without a word are neutral and stay; ties and
repeated rows each get their own row; an empty table gives an empty result; only the id and the text are read, so
other columns may have any name. Whole texts are read, however long.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.arrowtext import SPACE, parts, per_text, raw, word_starts
from tallyflow.llm.common import table

SYMBOLS = b"#*$%&|<>"
#: A line ends as a sentence with one of these, before any closing marks and white space.
TERMINAL = (".", "!", "?", "…", "。", "！", "？", "؟", "۔", "।")
#: Closing marks are quotes and what Unicode classes as closing brackets and as quotation marks of either side.
QUOTES, CLOSING = "\"'", ("Pe", "Pf", "Pi")
#: A line of at least so many words may also end in a colon, as before a list or a quotation.
COLON_WORDS = 5
#: Separators of menu items; a line is navigation with this many or more, at least one for every so many words.
SEPARATORS = ("|", "•", "·", "»", "›")
LEAST_SEPARATORS, WORDS_A_SEPARATOR = 2, 4
#: A line of fewer words than the first that the text has as often as the second is navigation too.
ITEM_WORDS, ITEM_TIMES = 10, 3
#: Boilerplate: a line is page furniture where it has two of these, in lower case, or one that is this share of its bytes, in percent.
BOILERPLATE_SHARE = 30
BOILERPLATE = (
    r"licen[cs]ed under", r"(released|distributed|published|available) under", r"rights reserved", r"spdx-license-identifier", r"permission is hereby granted",
    r"copyright (\(c\)|©|[0-9]{4})", r"(cookie|privacy) (policy|notice|settings)", r"(we|site) uses? cookies", r"accept (all )?cookies", r"terms of (service|use)",
    r"(sign up|subscribe) (to|for) (our|the)", r"click here", r"enable javascript", r"lorem ipsum",
)
#: A line fails with more symbols than this share of its bytes in words, in percent, or more exclamation marks than words.
SYMBOL_SHARE = 10
#: A document is rejected when less than this share of its words stays, in percent.
KEEP_SHARE = 50

_BOILERPLATE = re.compile("|".join(BOILERPLATE).encode())
_TERMINAL = tuple(t.encode() for t in TERMINAL)
_SEPARATORS = tuple(t.encode() for t in SEPARATORS)
_CLOSING = b" \t\n\r\x0b\x0c" + QUOTES.encode() + b")]}"


def ends_sentence(line: bytes, n_words: int = 0) -> bool:
    tail = line.rstrip(_CLOSING)
    while tail and tail[-1] >= 0x80:
        at = len(tail) - 1
        while at and tail[at] & 0xC0 == 0x80:
            at -= 1
        if unicodedata.category(tail[at:].decode("utf-8", "surrogatepass")) not in CLOSING:
            break
        tail = tail[:at].rstrip(_CLOSING)
    return tail.endswith(_TERMINAL) or n_words >= COLON_WORDS and tail.endswith(b":")


def is_boilerplate(line: bytes) -> bool:
    found = [m[0] for m in _BOILERPLATE.finditer(line.lower())]
    return len(found) > 1 or 100 * sum(map(len, found)) > BOILERPLATE_SHARE * len(line)


def line_fails(line: bytes, n_words: int, times: int = 1) -> bool:
    """Whether a line with words, ``times`` in its text, fails by punctuation, as navigation, as symbol noise or as boilerplate."""
    if not ends_sentence(line, n_words) or line.count(b"!") > n_words:
        return True
    if n_words < ITEM_WORDS and times >= ITEM_TIMES:
        return True
    separators = sum(line.count(c) for c in _SEPARATORS)
    if separators >= LEAST_SEPARATORS and separators * WORDS_A_SEPARATOR >= n_words:
        return True
    symbols = sum(line.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    if symbols and 100 * symbols > SYMBOL_SHARE * len(line):
        return True
    return is_boilerplate(line)


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words in windows of ``size`` words that the text has twice or more, the first included. Exact: no hashes.

    Windows are numbered by doubling: pairs, then fours, then the whole window; each step gives equal windows equal
    numbers.
    """
    n = len(words)
    if n <= size:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0

    def number(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
        found, at = np.unique(a * np.int64(int(b.max()) + 1) + b, return_inverse=True)
        return at.astype(np.int64), len(found)

    pairs, k = number(ids[:-1], ids[1:])
    if k == n - 1:
        return 0
    fours, k = number(pairs[:-2], pairs[2:])
    if k == n - 3:
        return 0
    fives, k = number(fours[:-1], ids[4:])
    if k == n - 4:
        return 0
    again = np.bincount(fives)[fives] > 1
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, np.nonzero(again)[0], 1)
    np.add.at(covered, np.nonzero(again)[0] + size, -1)
    return int((np.cumsum(covered)[:n] > 0).sum())


def _clean(text: bytes) -> tuple[int, int, int, bytes]:
    """(duplicate lines, words, words kept, text of the lines that stay)."""
    lines = text.split(b"\n")
    counts = [len(x.split()) for x in lines]
    times = Counter(x for x, n in zip(lines, counts, strict=True) if n)
    kept, stay = 0, []
    for line, n in zip(lines, counts, strict=True):
        if n:
            if line_fails(line, n, times[line]):
                continue
            kept += n
        stay.append(line)
    return sum(times.values()) - len(times), sum(counts), kept, b"\n".join(stay)


OUT = "doc_id {id}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, n_words_kept bigint"


def clean_lines(docs: DataFrame, with_text: bool = False, extra: list[str] | None = None) -> DataFrame:
    """The figures of every document, the verdict ``kept`` and, if asked for, ``clean_text``; ``extra`` columns ride along."""
    extra = extra or []
    picked = docs.select(F.col("doc_id"), F.col("text"), *extra)
    fields = picked.schema
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole, 1)):
            data, at = raw(b.column(1))
            space = SPACE[data]
            n_words = per_text(word_starts(data, at, space), at)
            chars = per_text(~space & ((data & 0xC0) != 0x80), at)
            symbols = per_text(symbol[data], at)
            texts = [data[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            rows = [_clean(t) for t in texts]
            repeats = np.array([repeated_words(t.split()) for t in texts], np.int64)
            failed = (n_words < 10) | (100 * repeats > 20 * n_words)
            words_kept = np.array([r[2] for r in rows], np.int64)
            kept = ~failed & (100 * words_kept >= KEEP_SHARE * n_words)
            cols = [b.column(0), pa.array(n_words), pa.array(chars), pa.array(symbols), pa.array([r[0] for r in rows], pa.int64())]
            cols += [pa.array(repeats), pa.array(failed), pa.array(kept), pa.array(words_kept)]
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_kept"]
            if with_text:
                cols.append(pa.array([r[3].decode("utf-8", "surrogatepass") for r in rows], pa.string()))
                names.append("clean_text")
            yield pa.RecordBatch.from_arrays([*cols, *(b.column(2 + i) for i in range(len(extra)))], [*names, *extra])

    schema = OUT.format(id=fields["doc_id"].dataType.simpleString()) + ", clean_text string" * with_text
    return picked.mapInArrow(run, schema + "".join(f", `{c}` {fields[c].dataType.simpleString()}" for c in extra))


def op10_line_first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents"))


_CLOSED = r"[\x20\x09-\x0D" + QUOTES.replace("'", "''") + "".join(rf"\p{{{c}}}" for c in CLOSING) + "]*$"
_ENDED, _COLON = "[" + "".join(TERMINAL) + "]" + _CLOSED, ":" + _CLOSED
SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l0 AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t),
l AS (SELECT rid, line, pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw, strlen(line) AS nb,
        length(line) - length(regexp_replace(line, '[{"".join(SEPARATORS)}]', '', 'g')) AS seps, length(line) - length(replace(line, '!', '')) AS bangs,
        length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS syms, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
        row_number() OVER (PARTITION BY rid, line ORDER BY pos) AS occ, count(*) OVER (PARTITION BY rid, line) AS times FROM l0),
r AS (SELECT *, NOT (regexp_matches(line, '{_ENDED}') OR nw >= {COLON_WORDS} AND regexp_matches(line, '{_COLON}')) OR bangs > nw OR (nw < {ITEM_WORDS} AND times >= {ITEM_TIMES}) OR (seps >= {LEAST_SEPARATORS} AND seps * {WORDS_A_SEPARATOR} >= nw)
        OR (syms > 0 AND 100 * syms > {SYMBOL_SHARE} * nb) OR len(bp) > 1 OR 100 * coalesce(list_sum(list_transform(bp, lambda x: strlen(x))), 0) > {BOILERPLATE_SHARE} * nb AS fails FROM (SELECT *, regexp_extract_all(low, '{"|".join(BOILERPLATE)}') AS bp FROM l) WHERE nw > 0),
a AS (SELECT rid, count(*) FILTER (occ > 1) AS n_dup_lines, sum(CASE WHEN fails THEN 0 ELSE nw END) AS kept_words FROM r GROUP BY rid),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t)),
g AS (SELECT rid, p, CASE WHEN lead(p, 4) OVER o IS NOT NULL THEN concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) END AS win FROM w WINDOW o AS (PARTITION BY rid ORDER BY p)),
c AS (SELECT rid, p, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY rid, win) > 1 THEN 1 ELSE 0 END AS again FROM g),
m AS (SELECT rid, max(again) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM c),
rep AS (SELECT rid, sum(hit) AS n_repeat_words FROM m GROUP BY rid),
f AS (SELECT t.doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(a.n_dup_lines, 0) AS n_dup_lines,
        coalesce(rep.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(a.kept_words, 0)::BIGINT AS n_words_kept
      FROM t LEFT JOIN a USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_words_kept >= {KEEP_SHARE} * n_words AS kept, n_words_kept FROM b
"""
