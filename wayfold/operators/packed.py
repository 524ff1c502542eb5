"""Several values packed in one field: one value per row, with its position.

Dialects are chosen by minimum description length. A dialect is a set of quote marks and a set of delimiters; a field is
parsed under every set of the quote marks that occur in it. A delimiter that is not met costs its name for nothing, and a
mark outside quotes that is no delimiter would stand in an unquoted value, which may hold none; so of the dialects with
given quote marks the one with just the marks met outside quotes is always the cheapest, and only that one is scored. A
parse with flaws (a quote mark that encloses nothing, values that touch) has to spell the field out, so one with fewer
flaws is always cheaper, and quotes that pair up never lose to a parse that separates at them. Between parses with
equal flaws the value codes decide: a value is a walk over kinds of characters (letters, digits, single signs), and the
walk's steps have the code lengths of their frequency in the whole column, counted in a first pass. There are at most
some hundred kinds of steps, so nothing is left out of the code table and no value is cut. Separators cost the entropy
of their kinds within the field, empty items a fixed price.

What a parse means is fixed: an unquoted value consists of letters, digits, `.`, `_` and `-`; everything else outside
quotes separates, one mark with blanks around it or a run of blanks alone. Brackets around the list and quotes around a
value are not part of a value; within quotes nothing separates, and a doubled or backslashed quote stands for itself. Two
marks in a row, or a mark at either end, enclose an empty item, which counts in the position but gives no row. A quoted
value that is empty or blank is an empty item too. Null, empty and hollow fields give no row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = " \t\r\n"
OPENING, CLOSING = "[({<⟨【［（｛", "])}>⟩】］）｝"
#: Quote marks, opening to closing.
QUOTES = {'"': '"', "'": "'", "`": "`", "“": "”", "‘": "’", "«": "»", "„": "“"}
#: Bits of a character beside its kind, and of an empty item.
CHAR_BITS, EMPTY_BITS = 5.0, 12.0


@lru_cache(maxsize=256)
def _tokens(quotes: str) -> re.Pattern:
    """Quoted value (one group for each kind of quote), bare value or single mark."""
    quoted = []
    for q in quotes:
        a, z = re.escape(q), re.escape(QUOTES[q])
        quoted.append(rf"{a}((?:\\{z}|{z}{z}|[^{z}])*){z}")
    return re.compile("|".join([*quoted, r"([^\W]|[.\-])+", rf"[^{BLANK}]"]))


@lru_cache(maxsize=16)
def _escape(close: str) -> re.Pattern:
    """A backslashed or doubled quote, read once from left to right."""
    z = re.escape(close)
    return re.compile(rf"\\{z}|{z}{z}")


_BARE = re.compile(r"(?:\w|[.\-])+|[^ \t\r\n]")


def strip_list(field: str) -> str:
    """The list without outer blanks and brackets."""
    body = field.strip(BLANK)
    while body and (body[0] in OPENING or body[-1] in CLOSING):
        if body[0] in OPENING:
            body = body[1:]
        if body and body[-1] in CLOSING:
            body = body[:-1]
        body = body.strip(BLANK)
    return body


def _assemble(tokens: Iterator[tuple[str | None, str, int, int]]) -> tuple[list[tuple[int, str]], Counter, int, int]:
    """Values with positions, kinds of separators, number of empty items and of values that touch."""
    items, marks, empty, touching = [], Counter(), 0, 0
    pos, filled, end, marked = 1, False, -1, False
    for value, text, a, z in tokens:
        if value is None:
            marks[text] += 1
            empty += not filled
            pos, filled, marked = pos + 1, False, True
        else:
            if filled:
                marks[" "] += 1
                touching += a == end
                pos += 1
            value = value.strip(BLANK)
            if value:
                items.append((pos, value))
            else:
                empty += 1
            filled, marked = True, False
        end = z
    return items, marks, empty + marked, touching


def parse(body: str, quotes: str) -> tuple[list[tuple[int, str]], Counter, int, int, int]:
    """`body` under the dialect whose quote marks are `quotes`; the last number counts quotes left open."""
    opened = 0

    def tokens():
        nonlocal opened
        for m in _tokens(quotes).finditer(body):
            text = m.group()
            k = m.lastindex
            if k and k <= len(quotes):
                close = QUOTES[quotes[k - 1]]
                yield _escape(close).sub(lambda _, c=close: c, m.group(k)), text, m.start(), m.end()
            elif text[0].isalnum() or text[0] in "._-":
                yield text, text, m.start(), m.end()
            else:
                opened += text in QUOTES or text in QUOTES.values()
                yield None, text, m.start(), m.end()

    return *_assemble(tokens()), opened


def parse_bare(body: str) -> list[tuple[int, str]]:
    """A body without quote marks: there is one dialect."""
    out, pos, filled = [], 1, False
    for t in _BARE.findall(body):
        if t[0].isalnum() or t[0] in "._-":
            pos += filled
            out.append((pos, t))
            filled = True
        else:
            pos, filled = pos + 1, False
    return out


def dialects(body: str) -> list[str]:
    """Sets of quote marks to try: every set of those that occur, larger ones first. Of equal costs the first wins."""
    there = [q for q in QUOTES if q in body]
    return ["".join(c) for n in range(len(there), -1, -1) for c in combinations(there, n)]


_RUN = re.compile(r"[^\W\d_]+|\d+|[ \t\r\n]+|.", re.DOTALL)


def _kind(run: str) -> str:
    c = run[0]
    return "a" if c.isalpha() else "0" if c.isdigit() else " " if c in BLANK else c if c in "._-" else "?"


@lru_cache(maxsize=100_000)
def steps(value: str) -> tuple[tuple[str, int], ...]:
    """The steps of a value from kind to kind, from its start ^ to its end $, with their numbers."""
    kinds = "^" + "".join(_kind(r) for r in _RUN.findall(value)) + "$"
    return tuple(Counter(a + b for a, b in zip(kinds, kinds[1:])).items())


def parse_cost(parsed, code: dict[str, float], escape: float) -> tuple[int, float]:
    """(flaws, bits): fewer flaws are cheaper whatever the bits."""
    items, marks, empty, touching, opened = parsed
    bits = sum(code.get(s, escape) * n for _, v in items for s, n in steps(v)) + CHAR_BITS * sum(len(v) for _, v in items)
    total = sum(marks.values())
    bits += sum(-n * math.log2(n / total) for n in marks.values()) + CHAR_BITS * len(marks)
    return touching + opened, bits + EMPTY_BITS * empty


def best_parse(field: str, code: dict[str, float], escape: float) -> list[tuple[int, str]]:
    body = strip_list(field)
    tries = dialects(body)
    if len(tries) == 1:
        return parse_bare(body)
    parsed = [parse(body, q) for q in tries]
    clean = [p for p in parsed if not p[3] + p[4]] or parsed
    if all(p[0] == clean[0][0] for p in clean[1:]):  # one reading only: no choice to score
        if clean is not parsed:
            return clean[0][0]
    return min(clean, key=lambda p: parse_cost(p, code, escape))[0]


def _count_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for b in batches:
        values: Counter = Counter()  # each value of a batch is taken apart once
        for field in b.column(0).to_pylist():
            body = strip_list(field or "")
            tries = dialects(body)
            for q in tries:
                values.update(t for t in _BARE.findall(body) if t[0].isalnum() or t[0] in "._-") if len(tries) == 1 else values.update(v for _, v in parse(body, q)[0])
        for v, m in values.items():
            for s, n in steps(v):
                seen[s] += n * m
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["step", "n"])


def value_codes(df: DataFrame, field: str) -> tuple[dict[str, float], float]:
    """Code lengths in bits of the steps of all values of the column, given the kind they start from, and that of a step
    never seen. At most a hundred rows come to the driver, as there are nine kinds."""
    counts = df.select(field).mapInArrow(_count_steps, "step string, n long").groupBy("step").agg(F.sum("n").alias("n"))
    rows = counts.collect()
    total: Counter = Counter()
    for r in rows:
        total[r["step"][0]] += r["n"]
    return {r["step"]: -math.log2(r["n"] / (total[r["step"][0]] + 1)) for r in rows}, math.log2(max(total.values(), default=0) + 2)


def split_packed(df: DataFrame, key: str, field: str, codes: tuple[dict[str, float], float] | None = None) -> DataFrame:
    """(`key`, pos, value) of every field; repeated rows (same key and field) count once.

    One shuffle, for the copies; parsing is local to a row. A field of any length is parsed by one task as one value
    of a row would be read by one task anyway.
    """
    rows = df.select(key, field).filter(F.col(field).isNotNull()).distinct()
    code, escape = codes or value_codes(df, field)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, value = [], [], []
            for i, f in enumerate(b.column(1).to_pylist()):
                for p, v in best_parse(f, code, escape):
                    at.append(i)
                    pos.append(p)
                    value.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(value, pa.string())], names=[key, "pos", "value"])

    return rows.mapInArrow(run, f"`{key}` {kind}, pos int, value string")


PACKED = {"complete_pcenter_naive": "projects", "greedy_abs_job_par": "selected", "sample_p2000": "medians"}


def p5_found(spark, sf_dir: str) -> DataFrame:
    from wayfold.session import table

    parts = []
    for name, field in PACKED.items():
        out = split_packed(table(spark, sf_dir, name), "rec_id", field)
        parts.append(out.select(F.lit(name).alias("tbl"), "rec_id", "pos", "value"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: The rule with both ASCII quote marks, the dialect that these tables' fields come out under.
_P5_PART = r"""
SELECT tbl, rec_id, pos, value FROM (
  SELECT 'TABLE_NAME' AS tbl, rec_id, mark,
    CAST(1 + coalesce(sum(CASE WHEN mark THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, f ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + sum(CASE WHEN NOT mark AND after_value THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, f ORDER BY k ROWS UNBOUNDED PRECEDING) AS INTEGER) AS pos,
    trim(CASE WHEN token[1] = '"' THEN regexp_replace(token[2:-2], '\\"|""', '"', 'g')
      WHEN token[1] = chr(39) THEN regexp_replace(token[2:-2], '\\\x27|\x27\x27', chr(39), 'g') ELSE token END, ' ' || chr(9) || chr(10) || chr(13)) AS value
  FROM (SELECT *, NOT lag(mark, 1, true) OVER (PARTITION BY rec_id, f ORDER BY k) AS after_value FROM (
    SELECT rec_id, f, k, tokens[k] AS token, NOT (len(tokens[k]) > 1 AND tokens[k][1] IN ('"', chr(39))) AND NOT regexp_matches(tokens[k], '^[\w.-]') AS mark FROM (
      SELECT rec_id, f, tokens, unnest(range(1, len(tokens) + 1)) AS k FROM (
        SELECT rec_id, f, regexp_extract_all(regexp_replace(regexp_replace(f, '^[\s\[({<]+', ''), '[\s\])}>]+$', ''),
          '"(?:\\"|""|[^"])*"|\x27(?:\\\x27|\x27\x27|[^\x27])*\x27|[\w.-]+|[^ \t\r\n]') AS tokens
        FROM (SELECT DISTINCT rec_id, FIELD_NAME AS f FROM TABLE_NAME WHERE FIELD_NAME IS NOT NULL)))))
) WHERE NOT mark AND value <> ''"""
P5_SQL = " UNION ALL ".join(_P5_PART.replace("TABLE_NAME", n).replace("FIELD_NAME", f) for n, f in PACKED.items())
