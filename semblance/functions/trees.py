"""Trees of source texts and their pq-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle

# Ship the helpers inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 3
NONE = "*"


def depths(items: list[str]) -> tuple[list[str], list[int]]:
    """Labels and depths of the nodes of a text in order; items that begin with a line feed carry
    the indentation of the line they open.

    The first item of a line is as deep as its indentation has levels, the others lie below it, and
    what stands in brackets below the bracket. A line feed inside brackets opens no line.
    """
    labels, found = [], []
    levels, inside, width, head = [0], 0, 0, True
    for item in items:
        if item[:1] == "\n":
            if not inside:
                width, head = len(item) - 1, True
            continue
        if head:
            while levels[-1] > width:
                levels.pop()
            if levels[-1] < width:
                levels.append(width)
            depth, head = len(levels) - 1, False
        else:
            if item in (")", "]", "}"):
                inside = max(0, inside - 1)
            depth = len(levels) + inside
        if item in ("(", "[", "{"):
            inside += 1
        labels.append(item)
        found.append(depth)
    return labels, found


def pq_grams(items: list[str]) -> list[str]:
    """All pq-grams of a text's tree: a node's parent, the node, and three children in a row.

    Missing relatives are ``*``; the lines without indentation are children of a root of that name.
    A text without nodes has no grams.
    """
    labels, found = depths(items)
    if not labels:
        return []
    children: list[list[str]] = [[] for _ in range(len(labels) + 1)]
    parents = []
    last: list[int] = []
    for place, (label, depth) in enumerate(zip(labels, found)):
        del last[depth:]
        parent = last[-1] if last else -1
        last.append(place)
        parents.append(parent)
        children[parent].append(label)
    edge = [NONE] * (WINDOW - 1)
    out = []
    for place, below in enumerate(children):
        label = labels[place] if place < len(labels) else NONE
        above = labels[parents[place]] if place < len(labels) and parents[place] >= 0 else NONE
        row = edge + below + edge if below else [NONE] * WINDOW
        out += [" ".join((above, label, *row[k : k + WINDOW])) for k in range(len(row) - WINDOW + 1)]
    return out


def gram_batches(keys: list[str]):
    """``grams`` of the last column; columns ``keys`` stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if items is None else pq_grams(items) for items in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(made, pa.list_(pa.string()))], [*keys, "grams"])

    return run
