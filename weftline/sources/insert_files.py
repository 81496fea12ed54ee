"""INSERT text of any size, cut and read by Spark's tasks.

Whether a line lies inside a quoted string, and how deep in parentheses, follows from all text before it.  Each split of a file is scanned
once for what it does to such a state, whichever it starts with (a split starts inside a string or not): a row for each split goes to the driver, which
puts them one after another.  Then every split knows its state, and cuts its lines where no string and no parenthesis is open and a statement's
head is complete.  What is then between cuts is a statement or some rows of one, and is read where it lies.  Pieces that a split's end goes
through are put together and read apart.  Rows whose head stands in an earlier split get it from the last split that has one.

Both scans go over the bytes of many lines at once (``_look``).  Lines that are one row of plain strings, numbers, true, false and null are read by Arrow's
reader of CSV (``_plain``); all other lines, and those beside comments or letters beyond ASCII outside strings, by the regular expressions below, one by one.

Lines may be as long as Spark's text reader takes; a statement may have any number of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import StoreError

_TOKEN = re.compile(r"'[^']*(?:''[^']*)*'|'|--|[();]|\b(?:insert|values)\b", re.IGNORECASE)
_CLOSE = re.compile(r"[^']*(?:''[^']*)*'(?!')")
_HEAD = re.compile(r'insert\s+into\s+"?([\w.]+)"?\s*\(([^)]*)\)\s*values\b', re.IGNORECASE)
_BLANK = re.compile(r"(?:\s|,|--[^\n]*)*")
_ITEM = re.compile(r"\s*(?:(?:(?:date|timestamp)\s+)?'([^']*(?:''[^']*)*)'|([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false)|(null))(?:::\w+)?\s*([,)])", re.IGNORECASE)

OUT, HEAD, ROWS = "out", "head", "rows"


def scan(line: str, quoted: bool, depth: int, part: str) -> tuple[bool, int, str]:
    """The state after a line: inside a string, depth of parentheses, part of a statement."""
    at = 0
    if quoted:
        m = _CLOSE.match(line)
        if not m:
            return True, depth, part
        at = m.end()
    for m in _TOKEN.finditer(line, at):
        t = m[0]
        if t == "--":
            break
        if t == "'":
            return True, depth, part
        if t == "(":
            depth += 1
        elif t == ")":
            depth -= 1
        elif t == ";":
            part = OUT
        elif t[0] != "'":
            part = HEAD if t.lower() == "insert" else ROWS if part in (HEAD, "") else part
    return False, depth, part


_WORDS = [np.frombuffer(w, np.uint8) for w in (b"insert", b"values")]


#: Bytes of words; and of a row's text outside strings: comma, parentheses, quotes that open and close, digit, sign, point, exponent, letter of a word.
_LETTER = np.array([chr(i).isalnum() or i == 95 or i >= 128 for i in range(256)])
_COMMA, _OPEN, _CLOSED, _QUOTE, _UNQUOTE, _DIGIT, _SIGN, _POINT, _EXP, _IN_WORD, _ELSE = range(11)
_KIND = np.full(256, _ELSE, np.uint8)
for _of, _kind in ((b",", _COMMA), (b"(", _OPEN), (b")", _CLOSED), (b"0123456789", _DIGIT), (b"+-", _SIGN), (b".", _POINT), (b"eE", _EXP)):
    _KIND[list(_of)] = _kind
#: What may follow what, and what may do so across white space.
_MAY = np.zeros((16, 16), bool)
for _kind, _then in ((_OPEN, (_DIGIT, _SIGN, _QUOTE, _IN_WORD)), (_COMMA, (_DIGIT, _SIGN, _QUOTE, _IN_WORD)), (_DIGIT, (_DIGIT, _POINT, _EXP, _COMMA, _CLOSED)), (_SIGN, (_DIGIT,)), (_POINT, (_DIGIT,)), (_EXP, (_SIGN, _DIGIT)), (_QUOTE, (_UNQUOTE,)), (_UNQUOTE, (_QUOTE, _COMMA, _CLOSED)), (_IN_WORD, (_IN_WORD, _COMMA, _CLOSED)), (_CLOSED, (_OPEN,))):
    _MAY[_kind, list(_then)] = True
_APART = np.zeros((16, 16), bool)
_APART[[_COMMA, _OPEN, _CLOSED], :] = _APART[:, [_COMMA, _OPEN, _CLOSED]] = True
_APART[_QUOTE, _UNQUOTE] = True
_LITERALS = [np.frombuffer(w, np.uint8) for w in (b"null", b"true", b"false")]
_NULLS = ["".join(w) for w in product(*zip("null", "NULL", strict=True))]


def _word(b: np.ndarray, at: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Which of the places have a word, in any case."""
    out = at + len(word) < len(b)
    for i, c in enumerate(word):
        out &= (b[np.minimum(at + i, len(b) - 1)] | 32) == c
    return out


class _Look:
    """Bytes of lines, each with its line end, seen at once: what is outside strings, parentheses, and the places of ``;``, insert and values."""

    def __init__(self, b: np.ndarray, quoted: bool):
        self.b, self.quote = b, b == 39
        #: after each byte
        self.within = (np.cumsum(self.quote, dtype=np.uint8) & 1) ^ np.uint8(quoted)
        self.out = (self.within == 0) & ~self.quote
        dash = (b == 45) & self.out
        #: not so where there is a comment, or a letter that a word may have beyond ASCII
        self.exact = not ((dash[1:] & dash[:-1]).any() or ((b >= 128) & self.out).any())
        if not self.exact:
            return
        self.ends = np.flatnonzero(b == 10)
        self.open, self.close = (b == 40) & self.out, (b == 41) & self.out
        self.depth = np.cumsum(self.open.view(np.int8) - self.close.view(np.int8), dtype=np.int64)
        low = b | 32
        found = [(p, OUT) for p in np.flatnonzero((b == 59) & self.out).tolist()]
        for word, part in zip(_WORDS, (HEAD, ROWS), strict=True):
            at = np.flatnonzero((low == word[0]) & self.out)
            at = at[_word(b, at, word)]
            at = at[~_LETTER[b[at + len(word)]] & ((at == 0) | ~_LETTER[b[at - 1]])]
            found += [(p, part) for p in at.tolist()]
        self.marks = sorted(found)

    def after(self, state: tuple) -> tuple:
        """The state after all lines."""
        part = state[2]
        for _, what in self.marks:
            part = _next(part, what)
        return bool(self.within[-1]), state[1] + int(self.depth[-1]), part

    def cuts(self, state: tuple) -> tuple[np.ndarray, np.ndarray]:
        """By line: whether it may be cut at its end, and whether it starts among a statement's rows and has no mark."""
        parts = [state[2]]
        for _, what in self.marks:
            parts.append(_next(parts[-1], what))
        seen = np.searchsorted(np.array([p for p, _ in self.marks], np.int64), self.ends)  # marks up to a line's end
        seen_before = np.concatenate([[0], seen[:-1]])
        is_ = lambda what: np.array([p == what for p in parts])
        ends = (self.within[self.ends] == 0) & (state[1] + self.depth[self.ends] == 0) & ~is_(HEAD)[seen]
        return ends, is_(ROWS)[seen_before] & (seen == seen_before)


def _next(part: str, what: str) -> str:
    if what == ROWS:
        return ROWS if part in (HEAD, "") else part
    return what


def _plain(look: _Look, may: np.ndarray) -> tuple[np.ndarray, pa.Array | None, int]:
    """Which lines are one row of plain literals, these rows as lists, and how many values each has.  Only lines of ``may``, which start outside all, are asked.

    A line that is anything else is left out; of rows with unlike numbers of values, those with the most usual one are taken.
    """
    b, ends = look.b, look.ends
    none = np.zeros(len(ends), bool), None, 0
    good = may.copy()
    starts = np.concatenate([[0], ends[:-1] + 1])
    opened, closed = np.flatnonzero(look.open), np.flatnonzero(look.close)
    own = lambda at: np.searchsorted(ends, at)
    good &= (np.bincount(own(opened), minlength=len(ends)) == 1) & (np.bincount(own(closed), minlength=len(ends)) == 1)
    good &= look.within[ends] == 0
    if not good.any():
        return none
    mine = np.repeat(good, ends - starts + 1)
    blank = ((b == 32) | (b == 9)) & look.out
    inner = np.cumsum(look.open.view(np.int8) - look.close.view(np.int8), dtype=np.int64) - np.repeat(np.concatenate([[0], look.depth[ends[:-1]]]), ends - starts + 1)
    # around the parentheses there is nothing but commas
    odd = [np.flatnonzero(mine & (inner == 0) & ~(blank | look.close | ((b == 44) & look.out) | (b == 10))), np.flatnonzero(mine & (inner < 0))]
    at = np.flatnonzero(mine & ~blank & ((inner == 1) | look.close) & (look.out | look.quote))
    kind = _KIND[b[at]]
    kind[look.quote[at]] = np.where(look.within[at[look.quote[at]]] == 1, _QUOTE, _UNQUOTE)
    before = np.concatenate([[_CLOSED], kind[:-1]])
    first = np.flatnonzero(((kind == _ELSE) | (kind == _EXP)) & ((before == _COMMA) | (before == _OPEN)))
    if len(first):
        for word in _LITERALS:
            there = first[_word(b, at[first], word)]
            there = there[there + len(word) <= len(at)]
            for i in range(len(word)):
                kind[there + i] = _IN_WORD
    fits = _MAY[kind[:-1], kind[1:]] & (_APART[kind[:-1], kind[1:]] | (np.diff(at) == 1))
    bad = np.flatnonzero(~fits)
    odd += [at[bad], at[np.minimum(bad + 1, len(at) - 1)]]
    some = np.flatnonzero((kind == _POINT) | (kind == _EXP) | (kind <= _CLOSED))  # a number has a point, an exponent, or a point and then an exponent
    twice = ((kind[some[1:]] == _POINT) & ((kind[some[:-1]] == _POINT) | (kind[some[:-1]] == _EXP))) | ((kind[some[1:]] == _EXP) & (kind[some[:-1]] == _EXP))
    odd.append(at[some[1:]][twice])
    good[own(np.concatenate(odd))] = False
    if not good.any():
        return none
    commas = np.bincount(own(at[kind == _COMMA]), minlength=len(ends))
    usual = int(np.bincount(commas[good]).argmax())
    good &= commas == usual
    mine = np.repeat(good, ends - starts + 1)
    text = np.where(look.close, np.uint8(10), b)[mine & ~blank & ((inner == 1) & ~look.open | look.close)]
    names = [str(i) for i in range(usual + 1)]
    table = csv.read_csv(
        pa.BufferReader(pa.py_buffer(text.tobytes())),
        csv.ReadOptions(use_threads=False, block_size=len(text) + 1, column_names=names),
        csv.ParseOptions(delimiter=",", quote_char="'", double_quote=True, escape_char=False, newlines_in_values=False, ignore_empty_lines=False),
        csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), null_values=_NULLS, strings_can_be_null=True, quoted_strings_can_be_null=False),
    )
    n = table.num_rows
    if n != good.sum():
        return none
    values = pa.concat_arrays([c for column in table.columns for c in column.chunks])
    order = (np.arange(n)[:, None] + np.arange(usual + 1)[None, :] * n).ravel()
    return good, pa.ListArray.from_arrays(pa.array(np.arange(0, n * (usual + 1) + 1, usual + 1), pa.int32()), values.take(pa.array(order))), usual + 1


def _by_split(batches):
    """(path, start, lines) of each split, in pieces; a split's lines follow each other."""
    for batch in batches:
        paths, starts, values = (batch.column(c) for c in ("path", "start", "value"))
        if not len(paths):
            continue
        turns = np.flatnonzero(np.diff(starts.to_numpy())) + 1
        ends = sorted({*turns.tolist(), *pc.run_end_encode(paths).run_ends.to_pylist()})
        a = 0
        for b in ends:
            yield paths[a].as_py(), starts[a].as_py(), values.slice(a, b - a)
            a = b


def _bytes(lines: pa.Array) -> np.ndarray:
    """Lines one after another, each with its line end."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines.cast(pa.string())), "\n")
    return np.concatenate([np.frombuffer(joined[0].as_buffer(), np.uint8), np.array([10], np.uint8)])


def _table(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _effects(batches):
    """What a split does to a state: for both ways to start, whether it ends in a string, the change of depth, and the part ('' is unchanged)."""
    done: dict[tuple, list] = {}
    for path, start, lines in _by_split(batches):
        ways = done.setdefault((path, start), [(False, 0, ""), (True, 0, "")])
        b = _bytes(lines)
        for i, way in enumerate(ways):
            look = _Look(b, way[0])
            if look.exact:
                ways[i] = look.after(way)
                continue
            for line in lines.to_pylist():
                way = scan(line, *way)
            ways[i] = way
    if done:
        rows = [(path, start, *ways[0], *ways[1]) for (path, start), ways in done.items()]
        yield _table(rows, ["path", "start", "q0", "d0", "p0", "q1", "d1", "p1"], [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()])


def _skip(text: str, at: int) -> int:
    """After the parenthesis that closes the one at ``at``."""
    depth = 0
    for m in _TOKEN.finditer(text, at):
        depth += (m[0] == "(") - (m[0] == ")")
        if m[0] == ")" and depth == 0:
            return m.end()
    return len(text)


def _row(text: str, at: int) -> tuple[list, int] | None:
    """The literals of the parentheses that open at ``at``, as text, and where they end; None if there is anything else."""
    values, at = [], at + 1
    while m := _ITEM.match(text, at):
        values.append(m[1].replace("''", "'") if m[1] is not None else m[2])
        at = m.end()
        if m[4] == ")":
            return values, at
    return None


#: ``unit``: -1, or the place of a piece over several splits; ``head``: name and columns with commas between, '' of another statement.
_ROW = "path string, start long, unit long, at long, n long, kind string, head string, size int, literals array<string>, text string"
_NAMES = ["path", "start", "unit", "at", "n", "kind", "head", "size", "literals", "text"]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]


class _Reader:
    """Reads the text of a split, or of a piece over several, in order: rows (``row``; of a head that an earlier split has: ``early``), and at its end the head that it leaves
    (``left``) and how many it has."""

    def __init__(self, path: str, start: int, unit: int):
        self.of, self.head, self.heads, self.at, self.rows = (path, start, unit), None, 0, 0, []

    def batches(self):
        """What was read since."""
        if self.rows:
            yield _table(self.rows, _NAMES, _KINDS)
            self.rows = []

    def left(self) -> None:
        self.rows.append((*self.of, -1, self.heads, "left", self.head, None, None, None))

    def piece(self, kind: str, text: str) -> None:
        """Text that goes through a split's end."""
        self.rows.append((*self.of, self.at, 0, kind, None, None, None, text))
        self.at += 1

    def _fit(self, size: int) -> None:
        if self.head and size != self.head.count(","):
            raise StoreError(f"a row of {self.head.partition(',')[0]} has not as many values as columns")

    def lists(self, literals: pa.Array, size: int):
        """Rows that are read already."""
        if self.head != "":
            self._fit(size)
            n = len(literals)
            same = (*self.of, self.at, None, "row" if self.head else "early", self.head, size, None, None)
            columns = [pa.nulls(n, k) if v is None else pa.repeat(pa.scalar(v, k), n) for v, k in zip(same, _KINDS, strict=True)]
            columns[4], columns[8] = pa.array(np.arange(n), pa.int64()), literals
            yield from self.batches()
            yield pa.RecordBatch.from_arrays(columns, _NAMES)
        self.at += 1

    def text(self, text: str) -> None:
        """A piece between cuts.  A statement of another kind has the head ''."""
        place, n = 0, 0
        while (place := _BLANK.match(text, place).end()) < len(text):
            if text[place] == ";":
                self.head, place = "", place + 1
            elif m := _HEAD.match(text, place):
                self.head, self.heads, place = ",".join([m[1], *(c.strip().strip('"') for c in m[2].split(","))]), self.heads + 1, m.end()
            elif text[place] == "(" and self.head != "":
                found = _row(text, place)
                if found is None:
                    if self.head is None:  # may be no INSERT
                        place = _skip(text, place)
                        continue
                    raise StoreError(f"not a row of literals: {text[place : place + 60]}")
                values, place = found
                self._fit(len(values))
                self.rows.append((*self.of, self.at, n, "row" if self.head else "early", self.head, len(values), values, None))
                n += 1
            else:  # another statement: to its end
                end = next((m.start() for m in _TOKEN.finditer(text, place) if m[0] == ";"), len(text))
                self.head, place = self.head or "", max(end, place + 1)
        self.at += 1


def _read_splits(known: dict, batches):
    """What ``_Reader`` gives for each split, and its pieces that go through a split's end; ``first``: up to its first cut, where it starts within a piece, ``last``: after
    its last cut, ``all``: without a cut."""
    reader, held, cut, inside, state = None, [], False, False, None

    def rest():
        if reader:
            if held:
                reader.piece("all" if inside and not cut else "last", "\n".join(held))
            reader.left()
            yield from reader.batches()

    for path, start, lines in _by_split(batches):
        if reader is None or reader.of[:2] != (path, start):
            yield from rest()
            reader, held, cut, state = _Reader(path, start, -1), [], False, known[path, start]
            inside = state[0] or state[1] != 0 or state[2] == HEAD
        look = _Look(_bytes(lines), state[0])
        plain, lists, size, taken = np.zeros(len(lines), bool), None, 0, 0
        if look.exact:
            ends, rows = look.cuts(state)
            plain, lists, size = _plain(look, rows & np.concatenate([[not held and (cut or not inside)], ends[:-1]]))
            state = look.after(state)
        else:
            ends = np.zeros(len(lines), bool)
            for i, line in enumerate(lines.to_pylist()):
                state = scan(line, *state)
                ends[i] = not state[0] and state[1] == 0 and state[2] != HEAD
        turns = [0, *(np.flatnonzero(np.diff(plain)) + 1).tolist(), len(lines)]
        for a, b in zip(turns, turns[1:], strict=False):
            if plain[a]:
                cut = True
                yield from reader.lists(lists.slice(taken, b - a), size)
                taken += b - a
                continue
            for line, end in zip(lines.slice(a, b - a).to_pylist(), ends[a:b].tolist(), strict=True):
                held.append(line)
                if end:
                    if inside and not cut:
                        reader.piece("first", "\n".join(held))
                    else:
                        reader.text("\n".join(held))
                    held, cut = [], True
        yield from reader.batches()
    yield from rest()


def _read_pieces(batches):
    """What ``_Reader`` gives for each piece over several splits."""
    for batch in batches:
        for path, start, at, text in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "at", "text")), strict=True):
            reader = _Reader(path, start, at)
            reader.at = at
            reader.text(text)
            reader.left()
            yield from reader.batches()


def read(spark: SparkSession, path: str, save: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, int]:
    """(path, start, at, n, head, size, name, columns, literals) of every row, in order of the first four, and how many INSERT statements there are.

    ``head`` is name and columns with commas between, ``size`` the number of literals.  ``save`` writes a frame to a folder that all machines share, and reads it again.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    effects = lines.mapInArrow(_effects, "path string, start long, q0 boolean, d0 long, p0 string, q1 boolean, d1 long, p1 string").collect()
    known, before, state = {}, None, (False, 0, OUT)
    for r in sorted(effects, key=lambda r: (r["path"], r["start"])):
        if r["path"] != before:
            before, state = r["path"], (False, 0, OUT)
        known[r["path"], r["start"]] = state
        quoted, depth, part = (r["q1"], r["d1"], r["p1"]) if state[0] else (r["q0"], r["d0"], r["p0"])
        state = (quoted, state[1] + depth, part or state[2])
    # a state for each split
    found = save(lines.mapInArrow(partial(_read_splits, known), _ROW), "rows")
    own = Window.partitionBy("path").orderBy("start", "at")
    edges = found.where("kind IN ('first', 'last', 'all')").withColumn("piece", F.sum(F.when(F.col("kind") == "last", 1).otherwise(0)).over(own))
    joined = edges.groupBy("path", "piece").agg(F.sort_array(F.collect_list(F.struct("start", "at", "text"))).alias("parts"))
    joined = joined.select("path", F.col("parts")[0]["start"].alias("start"), F.col("parts")[0]["at"].alias("at"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    found = found.unionByName(save(joined.mapInArrow(_read_pieces, _ROW), "pieces"))
    left = found.where("kind = 'left'").select("path", "start", "unit", "n", "head")
    statements = left.agg(F.sum("n")).first()[0] or 0
    earlier = Window.partitionBy("path").orderBy("start", "unit").rowsBetween(Window.unboundedPreceding, -1)
    heads = left.select("path", "start", "unit", F.last("head", ignorenulls=True).over(earlier).alias("head"))
    columns = ["path", "start", "at", "n", "head", "size", "literals"]
    early = found.where("kind = 'early'").drop("head").join(heads, ["path", "start", "unit"]).where("head <> ''")
    rows = found.where("kind = 'row'").select(*columns).unionByName(early.select(*columns))
    parts = F.split("head", ",")
    return rows.select("path", "start", "at", "n", "head", "size", parts[0].alias("name"), F.slice(parts, 2, F.size(parts) - 1).alias("columns"), "literals"), statements
