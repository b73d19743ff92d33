"""Joining fragments of wires within a panel."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

Points = list[tuple[float, float]]


def joined(a: Points, b: Points, gap: float, least_cos: float) -> Points | None:
    """The two lines as one, if their nearest ends are within ``gap`` and the second goes on in the first's direction."""
    ways = [(a, b), (a, b[::-1]), (a[::-1], b), (a[::-1], b[::-1])]  # each pair of ends, as "last of one, first of other"
    ways = [ways[2], ways[3], ways[0], ways[1]]  # of equal distances: the first line's start before its end
    one, other = min(ways, key=lambda w: math.dist(w[0][-1], w[1][0]))
    if math.dist(one[-1], other[0]) > gap:
        return None
    far, out = math.dist(one[0], one[-1]), math.dist(other[0], other[-1])
    if not far or not out:
        return None
    ahead = (one[-1][0] - one[0][0]) * (other[-1][0] - other[0][0]) + (one[-1][1] - one[0][1]) * (other[-1][1] - other[0][1])
    return one + other if ahead / (far * out) >= least_cos else None


def merge_lines(lines: list[dict], gap: float, angle: float) -> list[dict]:
    """Join pairs, the first that fits each time, until none does. A joined line has the colour of its longer part."""
    least_cos, numbers, apart = math.cos(math.radians(angle)), count(), set()
    lines = [(next(numbers), x) for x in lines]
    while True:
        for (i, a), (j, b) in combinations(lines, 2):
            if (i, j) in apart:  # tried before
                continue
            points = joined(a["points"], b["points"], gap, least_cos)
            if points:
                length = sum(math.dist(p, q) for p, q in zip(points, points[1:], strict=False))
                new = {"id": min(a["id"], b["id"]), "points": points, "length": length, "color": a["color"] if a["length"] >= b["length"] else b["color"], "n": a["n"] + b["n"]}
                lines = [(k, x) for k, x in lines if k not in (i, j)] + [(next(numbers), new)]
                break
            apart.add((i, j))
        else:
            return [x for _, x in lines]


def merge_segments(wires: DataFrame, gap: float = 14.0, angle: float = 25.0, panel: str = "panel_id") -> DataFrame:
    """panel, wire_id (least of the parts), sx, sy, ex, ey, length, color, parts. Input: panel, wire_id, sx..ey, length, color.

    The order of joins matters, so a panel is walked in one task; it holds tens of wires, however many panels there are.
    A task walks its panels one after another, in their order.
    """
    schema = f"`{panel}` {wires.schema[panel].dataType.simpleString()}, wire_id long, sx double, sy double, ex double, ey double, length double, color string, parts long"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def walked(key: object, lines: list[dict]) -> list[tuple]:
        return [(key, x["id"], *x["points"][0], *x["points"][-1], x["length"], x["color"], x["n"]) for x in merge_lines(lines, gap, angle)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for own, wire, sx, sy, ex, ey, length, color in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and own != key:
                    out += walked(key, held)
                    held = []
                key = own
                held.append({"id": wire, "points": [(sx, sy), (ex, ey)], "length": length, "color": color, "n": 1})
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*walked(key, held), strict=True), arrow, strict=True)], schema=arrow)

    rows = wires.select(panel, "wire_id", "sx", "sy", "ex", "ey", "length", "color")
    return rows.repartition(panel).sortWithinPartitions(panel, "wire_id").mapInArrow(run, schema)
