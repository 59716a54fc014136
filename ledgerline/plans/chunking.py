"""Greedy wrapping of long threads without gathering them.

A thread (the messages of a channel-day, joined by newlines) may be far larger than a task's memory.  Its messages are
dealt in order by ranges, so that a thread stands in consecutive parts, and wrapped in two passes:

1. Each part describes its first thread as a map from the state of the open line to the state after the part's
   last message of it: how many lines end, and how many columns the open line has then.  A line begun at a given
   word ends at one given word, so all starts share their paths, and the map is a few steps over the columns.  The
   part's last thread, if it begins there, is described by its end state alone.
2. The maps of a thread that crosses parts are composed in part order (steps and counts only, no text), which gives
   every part the state of its first line.  Then each part cuts its own messages, and lines that cross a
   border are put together from their pieces (at most ``width`` characters).

Messages are cleaned ones: no white space but single spaces between words.  An empty message counts as the blank of its
newline; a null one is no message.  The lines equal those of ``text.wrap`` over the joined text."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerline.plans.text import WRAP_PIECE
from ledgerline.session import cut_lineage


@dataclass
class Line:
    """An open line: ``used`` columns up to its last word, ``blanks`` newlines since, ``number`` lines before it."""
    used: int = 0
    blanks: int = -1          # the first message of a thread has no newline before it
    number: int = 0

    def column(self, width: int) -> int:
        """Where the next word would begin.  Blanks before the first word fill lines that are dropped."""
        if self.used:
            return min(self.used + self.blanks, width + 1)
        return (self.blanks - 1) % width + 1 if self.blanks > 0 else 0


class Stretch:
    """The words of consecutive messages of one thread."""

    def __init__(self, width: int):
        self.width, self.words, self.gaps, self.ends = width, [], [], []
        self.lead = self.trail = 0           # newlines before the first word and after the last

    def add(self, text: str, sizes) -> None:
        self.trail += 1
        at = 0
        blank = 0
        for size in sizes:
            piece = text[at:at + size]
            at += size
            if piece[0] == " ":
                blank += size
                continue
            if not self.words:
                self.lead, gap = self.trail, 0
            else:
                gap = blank + self.trail
            self.trail = blank = 0
            self.words.append(piece)
            self.gaps.append(gap)
            self.ends.append((self.ends[-1] if self.ends else 0) + gap + len(piece))

    def cut(self, i: int, off: int, free: int) -> int:
        """Characters taken of a word longer than a line: up to the last hyphen that fits, else all that fit."""
        front = self.words[i][off:off + free]
        hyphen = front.rfind("-")
        return hyphen + 1 if hyphen > 0 and front[:hyphen].strip("-") else free

    def line(self, i: int, off: int, column: int) -> tuple[int, int, int]:
        """The line that goes on at ``column`` with word i (``off`` characters of it are used): the word and
        offset the next line begins with, and the columns used."""
        base = self.ends[i] - len(self.words[i]) + off - column
        j = max(bisect_right(self.ends, base + self.width), i)
        used = self.ends[j - 1] - base if j > i else column
        if j == len(self.words):
            return j, 0, used
        done = off if j == i else 0
        at = used + (self.gaps[j] if j > i else 0)
        if len(self.words[j]) - done > self.width and at <= self.width:
            return j, done + self.cut(j, done, self.width - at), used
        return j, done, used

    def paths(self):
        """(end column, lines ended) from a line's first word to the end of the stretch, each found once."""
        known: dict = {}

        def follow(i: int, off: int) -> tuple[int, int]:
            path = []
            while (i, off) not in known:
                path.append((i, off))
                j, o, used = self.line(i, off, 0)
                if j == len(self.words):
                    known[(i, off)] = (used, 0)
                    path.pop()
                    break
                i, off = j, o
            end, n = known[(i, off)]
            for key in reversed(path):
                n += 1
                known[key] = (end, n)
            return end, n
        return follow

    def steps(self) -> tuple[int, list]:
        """The map of the stretch: columns up to ``fits`` end no line; from then on steps of
        (first column, columns used at the end, lines ended)."""
        fits = self.width - self.ends[-1]
        follow, out = self.paths(), []
        for column in range(max(fits + 1, 0), self.width + 2):
            i, off, used = self.line(0, 0, column)
            end, n = follow(i, off) if i < len(self.words) else (used, -1)
            if not out or out[-1][1:] != [end, n + 1]:
                out.append([column, end, n + 1])
        return fits, out


def after(state: Line, width: int, words: int, lead: int, trail: int, total: int, fits: int, steps: list, first_kept: bool) -> Line:
    """The open line after a stretch with this map.  ``first_kept``: the stretch's first word may stay on a line
    that holds blanks alone, which is no line if it ends there."""
    if not words:
        return Line(state.used, state.blanks + trail, state.number)
    begun = state.used > 0
    column = Line(state.used, state.blanks + lead, state.number).column(width)
    if column <= fits:
        return Line(column + total, trail, state.number)
    _, end, n = steps[bisect_right([s[0] for s in steps], column) - 1]
    return Line(end, trail, state.number + n - (0 if begun or first_kept else 1))


def _stretches(batches: Iterator[pd.DataFrame], keys: Sequence[str], width: int):
    """(key, first row, Stretch) for every thread of a part, in order; one thread's words of a part at a time."""
    now, row, held = None, None, None
    for b in batches:
        for r in b.itertuples(index=False):
            key = tuple(None if pd.isna(v) else v for v in (getattr(r, k) for k in keys))
            if held is None or key != now:
                if held is not None:
                    yield now, row, held
                now, row, held = key, r, Stretch(width)
            held.add(r.msg, r.sizes)
    if held is not None:
        yield now, row, held


def takes(column: int, size: int, width: int) -> bool:
    """Whether a line that is blank up to ``column`` is a line although the next word, of ``size``, may end it."""
    return column + size <= width or size > width


def chunk_threads(df: DataFrame, keys: Sequence[str] = ("channel",), ts: str = "ts", order: Sequence[str] = ("ts", "conv_id", "turn"),
                  text: str = "clean_content", width: int = 3000, parts: int | None = None) -> DataFrame:
    """(keys, day, chunk_no, chunk): every thread wrapped greedily into chunks of at most ``width`` characters.
    ``parts`` is the number of ranges the messages are dealt to (default: the session's)."""
    g = [f"k{i}" for i in range(len(keys))] + ["day"]
    d = df.filter(F.col(text).isNotNull()).select(
        *[F.col(k).alias(a) for k, a in zip(keys, g)], F.to_date(ts).alias("day"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)],
        F.col(text).alias("msg"))
    by = [*g, *[f"o{i}" for i in range(len(order))]]
    dealt = (d.repartitionByRange(parts, *by) if parts else d.repartitionByRange(*by)).sortWithinPartitions(*by, "msg")
    dealt = cut_lineage(dealt.withColumn("part", F.spark_partition_id())
                        .withColumn("sizes", F.transform(F.regexp_extract_all("msg", F.lit(WRAP_PIECE), F.lit(0)), F.length)))
    types = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    gt = ", ".join(f"{k} {types[k]}" for k in g)
    ends = "words int, lead int, trail int, total bigint, fits bigint, steps array<array<bigint>>, fresh array<bigint>"

    def describe(batches):
        """The part's first thread and its last."""
        row, last = None, None
        for n, (key, first, s) in enumerate(_stretches(batches, g, width)):
            last = (n, key, first, s)
            if n == 0:
                row = (key, first, s)
        if row is None:
            return
        out = [row] if last[0] == 0 else [row, last[1:]]
        for n, (key, first, s) in enumerate(out):
            fits, steps = s.steps() if s.words else (0, [])
            start = Line()
            column = Line(0, start.blanks + s.lead, 0).column(width)
            kept = bool(s.words) and takes(column, len(s.words[0]), width)
            alone = after(start, width, len(s.words), s.lead, s.trail, s.ends[-1] if s.words else 0, fits, steps, kept)
            yield pd.DataFrame([[*key, int(first.part), len(s.words), s.lead, s.trail, s.ends[-1] if s.words else 0, fits,
                                 steps if n == 0 else [], [alone.used, alone.blanks, alone.number, len(s.words[0]) if s.words else 0]]],
                               columns=[*g, "part", "words", "lead", "trail", "total", "fits", "steps", "fresh"])

    maps = dealt.select(*g, "part", "msg", "sizes").mapInPandas(describe, f"{gt}, part int, {ends}")

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        """The state in which every part after the first finds the thread."""
        out, state = [], None
        for r in pdf.sort_values("part").itertuples(index=False):
            if state is None:
                state = Line(int(r.fresh[0]), int(r.fresh[1]), int(r.fresh[2]))
                continue
            out.append([*[getattr(r, k) for k in g], int(r.part), state.used, state.blanks, state.number])
            steps = [[int(x) for x in s] for s in r.steps]
            column = Line(state.used, state.blanks + r.lead).column(width)
            state = after(state, width, int(r.words), int(r.lead), int(r.trail), int(r.total), int(r.fits), steps, takes(column, int(r.fresh[3]), width))
        return pd.DataFrame(out, columns=[*g, "part", "used", "blanks", "number"])

    carried = maps.groupBy(*g).applyInPandas(compose, f"{gt}, part int, used int, blanks int, number bigint")
    # one row a part at most: as small as the list of parts
    carried = F.broadcast(carried.select(*[F.col(k).alias(f"c_{k}") for k in g], F.col("part").alias("c_part"), "used", "blanks", "number"))
    same = F.col("part") == F.col("c_part")
    for k in g:
        same = same & F.col(k).eqNullSafe(F.col(f"c_{k}"))

    def lines(batches):
        for key, first, s in _stretches(batches, g, width):
            if not s.words:
                continue
            state = Line() if pd.isna(first.number) else Line(int(first.used), int(first.blanks), int(first.number))
            begun, blanks, no = state.used > 0, state.blanks + s.lead, state.number
            column = Line(state.used, blanks).column(width)
            found, i, off = [], 0, 0
            lead = " " * (column if not begun else blanks)
            while i < len(s.words):
                j, o, used = s.line(i, off, column)
                cells = [s.words[i][off:]] if j > i else []
                for k in range(i + 1, j):
                    cells += [" " * s.gaps[k], s.words[k]]
                if j < len(s.words):
                    start = off if j == i else 0
                    room = (used + (s.gaps[j] if j > i else 0)) <= width
                    if len(s.words[j]) - start > width and room:         # a long word begins, or its blank alone, on this line
                        cells += [" " * s.gaps[j] if j > i else "", s.words[j][start:o]]
                        held = True
                    else:
                        held = j > i
                else:
                    held = True
                text_ = "".join(cells)
                if held and (text_ or lead):
                    found.append((no, lead + text_))
                if held or begun:
                    no += 1
                lead, column, begun = "", 0, True
                i, off = j, o
            yield pd.DataFrame([[*key, n, int(first.part), t] for n, t in found], columns=[*g, "chunk_no", "part", "cell"])

    cells = (dealt.select(*g, "part", "msg", "sizes").join(carried, same, "left").drop("c_part", *[f"c_{k}" for k in g])
             .mapInPandas(lines, f"{gt}, chunk_no bigint, part int, cell string"))
    whole = cells.groupBy(*g, "chunk_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "cell"))), lambda c: c["cell"]), "").alias("chunk"))
    return whole.select(*[F.col(a).alias(k) for k, a in zip(keys, g)], "day", F.col("chunk_no").cast("int").alias("chunk_no"), "chunk")
