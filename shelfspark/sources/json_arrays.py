"""Large JSON arrays read by many tasks (the reading itself in Arrow batches).

A file that is one array can't be cut at line ends, so it is cut at closing
braces, wherever they stand, and each split is scanned twice. The first scan
tells what the split does to the reader's state (inside a string, after a
backslash, depth of brackets), for every state it may begin in, and how many
elements end in it; composed from split to split these give the state and the
number of elements before each one. The second scan, begun in that state, cuts
the split into whole elements and the pieces at its two ends; the pieces of an
element that lies over several splits are put together by its number, which is
also its row number in the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUT, IN, ESCAPED = 0, 1, 2  # outside a string, inside one, inside one behind a backslash
_REST = {IN: re.compile(r'(?:[^"\\]|\\.)*"', re.S), ESCAPED: re.compile(r'.(?:[^"\\]|\\.)*"', re.S)}  # to the end of an open string
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},]|"', re.S)


class Scan(NamedTuple):
    """Effect of a text on the state it begins in: the state after it, the change
    of depth, and the separators at each depth relative to the beginning."""
    end: int
    depth: int
    commas: dict[int, int]


def tokens(text: str, state: int) -> Iterator[tuple[str, int]]:
    """(bracket or comma outside strings, place) of a text that begins in
    ``state``; at last ("", state at its end)."""
    at = 0
    if state != OUT:
        closed = _REST[state].match(text)
        if closed is None:
            yield "", _open_end(text, state)
            return
        at = closed.end()
    for m in _TOKEN.finditer(text, at):
        token = m.group()
        if token == '"':  # a string that the text doesn't close
            yield "", _open_end(text[m.end():], IN)
            return
        if len(token) == 1:
            yield token, m.start()
    yield "", OUT


def _open_end(text: str, state: int) -> int:
    """State at the end of a text that lies wholly inside a string."""
    if state == ESCAPED:
        if not text:
            return ESCAPED
        text = text[1:]
    slashes = len(text) - len(text.rstrip("\\"))
    return ESCAPED if slashes % 2 else IN


def scan(text: str, state: int) -> Scan:
    depth, commas, end = 0, {}, state
    for token, at in tokens(text, state):
        if token == "":
            end = at
        elif token == ",":
            commas[depth] = commas.get(depth, 0) + 1
        else:
            depth += 1 if token in "[{" else -1
    return Scan(end, depth, commas)


def joined(a: Scan, b: Scan) -> Scan:
    """The effect of two texts, one after the other."""
    commas = dict(a.commas)
    for d, n in b.commas.items():
        commas[a.depth + d] = commas.get(a.depth + d, 0) + n
    return Scan(b.end, a.depth + b.depth, commas)


def pieces(text: str, state: int, depth: int, number: int) -> Iterator[tuple[int, str]]:
    """(number of the element, part of its text) of a split that begins in
    ``state`` at ``depth`` of the file, behind ``number`` separators of the array."""
    begin = 0 if depth > 0 else None
    for token, at in tokens(text, state):
        if token == "":
            break
        if token in "[{":
            depth += 1
            if depth == 1 and begin is None:
                begin = at + 1  # the array opens
        elif token in "]}":
            depth -= 1
            if depth == 0:  # and closes
                yield number, text[begin:at]
                return
        elif depth == 1:
            yield number, text[begin:at]
            number, begin = number + 1, at + 1
    if begin is not None:
        yield number, text[begin:]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """Texts of a split, one unit of (file, block) after the other, with the braces that they were cut at."""
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (t + "}" for t in batch.column(2).to_pylist()))


def _segments(spark: SparkSession, path) -> DataFrame:
    lines = spark.read.option("lineSep", "}").text(path)
    value = F.make_valid_utf8("value").alias("value")
    return lines.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), value)


def read_split_array(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """The objects of JSON arrays (one a file) with their places ``_file`` and
    ``_number`` (from 0) in the file; a file is read by as many tasks as it has
    splits. Elements that are no object of the schema give null cells, as
    Spark's reader does; text behind the array is not read."""
    segments = _segments(spark, path)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple[str, int], list[Scan]] = {}
        for file, block, text in _units(batches):
            before = done.get((file, block)) or [Scan(s, 0, {}) for s in (OUT, IN, ESCAPED)]
            seen = {s: scan(text, s) for s in {x.end for x in before}}
            done[file, block] = [joined(x, seen[x.end]) for x in before]
        for (file, block), scans in done.items():
            yield pa.RecordBatch.from_pydict({
                "_file": [file] * 3, "_block": pa.array([block] * 3, "int64"), "state": pa.array([OUT, IN, ESCAPED], "int32"),
                "end": pa.array([x.end for x in scans], "int32"), "depth": pa.array([x.depth for x in scans], "int32"),
                "commas": pa.array([list(x.commas.items()) for x in scans], pa.map_(pa.int32(), pa.int64()))})

    kinds = "_file string, _block long, state int, end int, depth int, commas map<int,long>"
    effects: dict[str, dict[int, dict[int, Scan]]] = {}
    for r in segments.mapInArrow(first, kinds).collect():  # three small rows a split
        effects.setdefault(r["_file"], {}).setdefault(r["_block"], {})[r["state"]] = Scan(r["end"], r["depth"], r["commas"])
    begins = {}
    for file, blocks in effects.items():
        state, depth, number = OUT, 0, 0
        for block in sorted(blocks):
            begins[file, block] = (state, depth, number)
            effect = blocks[block][state]
            # separators of the array itself: at depth 1 of the file
            state, depth, number = effect.end, depth + effect.depth, number + effect.commas.get(1 - depth, 0)
    shared = spark.sparkContext.broadcast(begins)  # a few numbers a split

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, at, held, rows = None, (OUT, 0, 0), [], []

        def flush() -> None:
            if held:
                rows.append((*unit[:1], held[0][0], unit[1], "".join(p for _, p in held)))
                held.clear()

        for file, block, text in _units(batches):
            if unit != (file, block):
                flush()
                unit, at = (file, block), shared.value[file, block]
            state, depth, number = at
            for n, piece in pieces(text, state, depth, number):
                if held and held[0][0] != n:
                    flush()
                held.append((n, piece))
            effect = scan(text, state)
            at = effect.end, depth + effect.depth, number + effect.commas.get(1 - depth, 0)
            if len(rows) >= 10_000:
                yield _rows(rows)
                rows = []
        flush()
        if rows:
            yield _rows(rows)

    cut = segments.mapInArrow(second, "_file string, _number long, _block long, text string")
    # one row per element and split: more only for elements that a split's end cuts
    texts = cut.groupBy("_file", "_number").agg(F.sort_array(F.collect_list(F.struct("_block", "text"))).alias("p"))
    whole = texts.select("_file", "_number", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    return whole.where(F.trim(F.regexp_replace("text", r"\\s", "")) != "").select(F.from_json("text", schema).alias("r"), "_file", "_number") \
        .select(*[F.col("r")[f].alias(f) for f in schema.fieldNames()], "_file", "_number")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = ("string", "int64", "int64", "string")
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["_file", "_number", "_block", "text"])
