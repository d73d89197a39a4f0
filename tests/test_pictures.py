"""K7, K8: boxes that don't overlap, files that hold what was drawn."""

import random
import struct
import zlib

import numpy as np
import pytest

from cladewise.sources import pictures


def pixels(data: bytes) -> np.ndarray:
    """A PNG in shades of grey without filters, all checksums compared."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts = 8, []
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        parts.append((kind, body))
        at += 12 + n
    assert [k for k, _ in parts] == [b"IHDR", b"IDAT", b"IEND"]
    width, height, *rest = struct.unpack(">IIBBBBB", parts[0][1])
    assert rest == [8, 0, 0, 0, 0]
    rows = np.frombuffer(zlib.decompress(parts[1][1]), np.uint8).reshape(height, width + 1)
    assert not rows[:, 0].any()
    return rows[:, 1:]


def random_tree(n: int, seed: int, near: int | None = None) -> tuple[dict, dict]:
    r = random.Random(seed)
    above = {i: None if i == 0 else r.randrange(max(0, i - (near or i)), i) for i in range(n)}
    return {i: [str(i), "c" * r.randrange(20)][: r.randrange(1, 3)] for i in range(n)}, above


@pytest.mark.parametrize("n, near", [(1, None), (2, None), (5, None), (60, None), (60, 2), (400, 5), (3000, 1)])
def test_boxes_do_not_overlap(n, near):
    for seed in range(5):
        texts, above = random_tree(n, seed, near)
        box = pictures.boxes(texts, above)
        level = {}
        for x, y, w, h in box.values():
            level.setdefault(y, []).append((x, x + w))
        for row in level.values():
            row.sort()
            assert all(b[0] - a[1] >= pictures.APART - 1 for a, b in zip(row, row[1:]))
        assert min(x for x, *_ in box.values()) >= 0
        kids = {}
        for c, p in above.items():
            kids.setdefault(p, []).append(c)
        middle = lambda i: box[i][0] + box[i][2] / 2
        for p, cs in kids.items():
            if p is not None:  # a parent is over the middle of its outer children
                assert abs(middle(p) - (middle(min(cs)) + middle(max(cs))) / 2) <= 2
                assert all(box[c][1] > box[p][1] + box[p][3] for c in cs)


def test_odd_trees():
    assert pictures.png({}, {})[:2] == (pictures.PAD, pictures.PAD)
    two = pictures.boxes({3: ["3"], 4: ["4"]}, {3: None, 4: None})
    assert two[3][1] == two[4][1] and two[4][0] - two[3][0] - two[3][2] >= pictures.APART - 1
    with pytest.raises(ValueError, match="no root"):
        pictures.boxes({1: ["1"], 2: ["2"]}, {1: 2, 2: 1})


def test_text_can_be_read_off():
    texts, above = {0: ["0", "cells: 12"], 7: ["7", "SNVs: 3,456"], 9: ["9", "~"]}, {0: None, 7: 0, 9: 0}
    width, height, data = pictures.png(texts, above)
    got, box = pixels(data), pictures.boxes(texts, above)
    assert got.shape == (height, width)
    s = pictures.SCALE
    for n, (x, y, w, h) in box.items():
        assert not got[y, x : x + w].any() and not got[y : y + h, x].any()  # the frame
        for i, line in enumerate(texts[n]):
            for j, c in enumerate(line):
                top, left = y + pictures.PAD + 9 * s * i, x + pictures.PAD + 6 * s * j
                dots = got[top : top + 7 * s : s, left : left + 5 * s : s] == 0
                assert ["".join(".#"[int(d)] for d in row) for row in dots] == pictures.GLYPHS.get(c, pictures.UNKNOWN).split()
    gap = got[box[0][1] + box[0][3] : box[7][1]]
    assert all(set(np.unique(row)) == {96, 255} for row in gap)  # the links, from box to box


def test_glyphs():
    for c, rows in (pictures.GLYPHS | {"?": pictures.UNKNOWN}).items():
        assert [len(r) for r in rows.split()] == [5] * 7, c
    assert len(set(pictures.GLYPHS.values())) == len(pictures.GLYPHS)


def test_pictures_by_tree(spark, tmp_path):
    edges = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (2, 5, 6)], "tree_id long, parent int, child int")
    cells = spark.createDataFrame([(1, 10, 1), (1, 11, 1), (3, 10, 0)], "tree_id long, cell_id long, node int")
    snvs = spark.createDataFrame([(2, 20, 6)], "tree_id long, snv_id long, node int")
    lines = pictures.node_lines(edges, cells, snvs, spark.createDataFrame([(2, 6, -1234.5)], "tree_id long, node int, score double"))
    got = {(r["tree_id"], r["node"]): r["lines"] for r in lines.collect()}
    assert got[1, 1] == ["1", "cells: 2", "SNVs: 0"] and got[2, 6] == ["6", "cells: 0", "SNVs: 1", "-1,234.50"]
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, 5), (2, 6), (3, 0)}
    drawn = pictures.pictures(edges, lines)
    pictures.write_pictures(drawn, lambda i: str(tmp_path / f"t{i}.png"))
    for row in drawn.collect():
        data = (tmp_path / f"t{row['tree_id']}.png").read_bytes()
        assert pixels(data).shape == (row["height"], row["width"]) and data == bytes(row["png"])
    assert pictures.pictures(edges.limit(0), lines.limit(0)).count() == 0


def test_names():
    name = pictures.candidate_name
    assert name(3, -5.2) == "tree3_--5.0.png" and name(3, -5.2, False) == "tree3_-5.0.png"
    assert name(0, 7.0) == "tree0_+7.0.png" and name(0, None) == "tree0.png"
