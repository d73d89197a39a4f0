"""Trees as PNG pictures: a tidy layout by outlines and a raster encoder. A task draws a tree; trees are metadata."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dots for a dot of a glyph, and, in dots, room around a text, between boxes and between levels.
SCALE, PAD, APART, DROP = 2, 8, 16, 40

# The author's own glyphs of five by seven dots, rows from the top.
GLYPHS = {
    " ": "..... ..... ..... ..... ..... ..... .....",
    "-": "..... ..... ..... ##### ..... ..... .....",
    ".": "..... ..... ..... ..... ..... .##.. .##..",
    ",": "..... ..... ..... ..... .##.. ..#.. .#...",
    ":": "..... .##.. .##.. ..... .##.. .##.. .....",
    ">": ".#... ..#.. ...#. ....# ...#. ..#.. .#...",
    "0": ".###. #...# #..## #.#.# ##..# #...# .###.",
    "1": "..#.. .##.. ..#.. ..#.. ..#.. ..#.. .###.",
    "2": ".###. #...# ....# ...#. ..#.. .#... #####",
    "3": "##### ...#. ..#.. ...#. ....# #...# .###.",
    "4": "...#. ..##. .#.#. #..#. ##### ...#. ...#.",
    "5": "##### #.... ####. ....# ....# #...# .###.",
    "6": "..##. .#... #.... ####. #...# #...# .###.",
    "7": "##### ....# ...#. ..#.. .#... .#... .#...",
    "8": ".###. #...# #...# .###. #...# #...# .###.",
    "9": ".###. #...# #...# .#### ....# ...#. .##..",
    "N": "#...# ##..# #.#.# #..## #...# #...# #...#",
    "S": ".#### #.... #.... .###. ....# ....# ####.",
    "V": "#...# #...# #...# #...# #...# .#.#. ..#..",
    "a": "..... ..... .###. ....# .#### #...# .####",
    "c": "..... ..... .###. #.... #.... #...# .###.",
    "e": "..... ..... .###. #...# ##### #.... .###.",
    "g": "..... .#### #...# #...# .#### ....# .###.",
    "i": "..#.. ..... .##.. ..#.. ..#.. ..#.. .###.",
    "l": ".##.. ..#.. ..#.. ..#.. ..#.. ..#.. .###.",
    "n": "..... ..... #.##. ##..# #...# #...# #...#",
    "o": "..... ..... .###. #...# #...# #...# .###.",
    "r": "..... ..... #.##. ##..# #.... #.... #....",
    "s": "..... ..... .###. #.... .###. ....# ####.",
    "t": ".#... .#... ###.. .#... .#... .#..# ..##.",
    "u": "..... ..... #...# #...# #...# #..## .##.#",
}
UNKNOWN = "##### #...# #...# #...# #...# #...# #####"


def node_lines(edges: DataFrame, cell_node: DataFrame, snv_node: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """(tree_id, node, lines): what a box says: the node, its numbers of cells and SNVs and its score, if it has one.

    All tables carry tree_id; scores: tree_id, node, score. A node is one that an edge, a cell or an SNV names.
    """
    key = ["tree_id", "node"]
    count = lambda owned, name: owned.groupBy(*key).agg(F.count("*").alias(name))
    cells, snvs = count(cell_node, "c"), count(snv_node, "m")
    ends = edges.select("tree_id", F.explode(F.array("parent", "child")).alias("node"))
    size = ends.union(cells.select(*key)).union(snvs.select(*key)).distinct()
    size = size.join(cells, key, "left").join(snvs, key, "left").na.fill(0, ["c", "m"])
    size = size.withColumn("s", F.lit(None).cast("double")) if scores is None else size.join(scores.select(*key, F.col("score").alias("s")), key, "left")
    lines = F.array(F.col("node").cast("string"), F.format_string("cells: %d", "c"), F.format_string("SNVs: %d", "m"), F.when(F.col("s").isNotNull(), F.format_number("s", 2)))
    return size.select(*key, F.array_compact(lines).alias("lines"))


def pictures(edges: DataFrame, lines: DataFrame) -> DataFrame:
    """(tree_id, width, height, png) for each tree. edges: tree_id, parent, child; lines: tree_id, node, lines, for all nodes.

    Several roots stand side by side. A tree without edges is its boxes. Characters without a glyph are drawn as a frame.
    """
    up = edges.select("tree_id", F.col("child").alias("node"), "parent")

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        texts = {int(n): [str(x) for x in ls] for n, ls in zip(rows["node"], rows["lines"])}
        above = {int(n): None if pd.isna(p) else int(p) for n, p in zip(rows["node"], rows["parent"])}
        width, height, data = png(texts, above)
        return pd.DataFrame({"tree_id": [rows["tree_id"].iloc[0]], "width": [width], "height": [height], "png": [data]})

    return lines.join(up, ["tree_id", "node"], "left").groupBy("tree_id").applyInPandas(draw, "tree_id long, width int, height int, png binary")


def candidate_name(tree_id: int, loglik: float | None, compat: bool = True) -> str:
    """File name of a candidate's picture: its number and its log-likelihood, rounded. compat: the minus stands twice."""
    if loglik is None:
        return f"tree{tree_id}.png"
    whole = float(round(loglik))
    return f"tree{tree_id}_{'+' if whole >= 0 else '-' if compat else ''}{whole}.png"


def write_pictures(drawn: DataFrame, path_of) -> None:
    """Write each picture to the file path_of(tree_id), wherever the session's file systems reach; one is held at a time."""
    spark = drawn.sparkSession
    for row in drawn.select("tree_id", "png").toLocalIterator():
        _write(spark, path_of(row["tree_id"]), bytes(row["png"]))


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


# --- inside a task ----------------------------------------------------------------------------------------------------


def middles(children: dict, root, widths: dict) -> dict:
    """Where each box has its middle, the root at 0: subtrees as near to each other as their outlines allow, parents over
    their children.

    An outline lists, deepest level first, the leftmost and rightmost edge, less an offset of the whole outline. Two of them
    merge in as many steps as the shallower has levels, by changing the deeper one in place.
    """
    order, stack = [], [root]
    while stack:
        order.append(n := stack.pop())
        stack.extend(children.get(n, ()))
    shift, outline = {root: 0.0}, {}
    for n in reversed(order):
        low, high, off, at = [], [], 0.0, []
        for c in children.get(n, ()):
            l, h, o = outline.pop(c)
            both = range(1, min(len(low), len(l)) + 1)
            move = max((high[-i] + off - l[-i] - o for i in both), default=-APART) + APART
            o += move
            if len(l) > len(low):
                for i in both:
                    l[-i] = low[-i] + off - o
                low, high, off = l, h, o
            else:
                for i in both:
                    high[-i] = h[-i] + o - off
            at.append((c, move))
        if at:
            middle = (at[0][1] + at[-1][1]) / 2
            shift.update((c, x - middle) for c, x in at)
            off -= middle
        low.append(-widths[n] / 2 - off)
        high.append(widths[n] / 2 - off)
        outline[n] = (low, high, off)
    x = {}
    for n in order:
        x[n] = x.get(n, 0.0) + shift[n]
        for c in children.get(n, ()):
            x[c] = x[n]
    return x


def boxes(texts: dict[int, list[str]], above: dict) -> dict[int, tuple[int, int, int, int]]:
    """node: left, top, width, height of its box, in dots. above: parent by node, None for roots."""
    children: dict = {}
    for n in sorted(texts):
        children.setdefault(above[n], []).append(n)
    widths = {n: 6 * SCALE * max(map(len, ls), default=0) + 2 * PAD for n, ls in texts.items()} | {None: 0}
    tall = 9 * SCALE * max(map(len, texts.values()), default=0) + 2 * PAD
    x = middles(children, None, widths)
    if len(x) != len(texts) + 1:
        raise ValueError("some nodes hang below no root")
    depth = {None: -1}
    for n in x:  # parents come first
        if n is not None:
            depth[n] = depth[above[n]] + 1
    left = min((x[n] - widths[n] / 2 for n in texts), default=0) - PAD
    return {n: (round(x[n] - widths[n] / 2 - left), depth[n] * (tall + DROP) + PAD, widths[n], tall) for n in texts}


def _text(band: np.ndarray, left: int, top: int, text: str) -> None:
    for i, c in enumerate(text):
        dots = np.array([[d == "#" for d in row] for row in GLYPHS.get(c, UNKNOWN).split()])
        dots = dots.repeat(SCALE, 0).repeat(SCALE, 1)
        at = band[top : top + dots.shape[0], left + 6 * SCALE * i : left + 6 * SCALE * i + dots.shape[1]]
        at[dots] = 0


def png(texts: dict[int, list[str]], above: dict) -> tuple[int, int, bytes]:
    """Width, height and file of a tree's picture, in shades of grey; one level is drawn at a time."""
    box = boxes(texts, above)
    levels: dict[int, list[int]] = {}
    for n, b in box.items():
        levels.setdefault(b[1], []).append(n)
    below: dict[int, list[int]] = {}
    for n, p in above.items():
        below.setdefault(p, []).append(n)
    width = max((b[0] + b[2] for b in box.values()), default=0) + PAD
    tall = max((b[3] for b in box.values()), default=0)

    def bands() -> Iterator[np.ndarray]:
        yield np.full((PAD, width), 255, np.uint8)
        for top in sorted(levels):
            band = np.full((tall + DROP, width), 255, np.uint8)
            for n in levels[top]:
                x, _, w, h = box[n]
                band[:h, x : x + w] = 0
                band[2 : h - 2, x + 2 : x + w - 2] = 255
                for i, line in enumerate(texts[n]):
                    _text(band, x + PAD, PAD + 9 * SCALE * i, line)
                for c in below.get(n, ()):
                    ends = x + w / 2, box[c][0] + box[c][2] / 2
                    steps = max(DROP, int(abs(ends[1] - ends[0])) + 1)
                    xs = np.linspace(*ends, steps).astype(int)
                    ys = np.linspace(tall, tall + DROP - 1, steps).astype(int)
                    band[ys, xs] = band[ys, np.minimum(xs + 1, width - 1)] = 96
            yield band

    height = PAD + len(levels) * (tall + DROP)
    packer = zlib.compressobj()
    body = b"".join(packer.compress(np.pad(b, ((0, 0), (1, 0))).tobytes()) for b in bands()) + packer.flush()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return width, height, b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", body) + part(b"IEND", b"")
