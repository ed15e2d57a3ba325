"""Pictures as arrays: PNG, edges, skew (I2) and stable regions (I6), in NumPy; what a task does to one picture.

A grey picture is a two-dimensional array of bytes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"

#: Channels of each PNG colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_chunks(data: bytes):
    """(kind, body) of each chunk; ValueError where one is cut off or its checksum is wrong."""
    if not data.startswith(MAGIC):
        raise ValueError("no PNG")
    at = len(MAGIC)
    while at < len(data):
        head = data[at : at + 8]
        if len(head) < 8:
            raise ValueError("a chunk is cut off")
        n, kind = struct.unpack(">I4s", head)
        body, crc = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or struct.unpack(">I", crc)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + n
    raise ValueError("no end")


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """The bytes of each row (its filter first) as they were: what lies left, above or both is added back."""
    out = np.zeros((len(rows) + 1, rows.shape[1] - 1 + step), dtype=np.uint8)
    for y, row in enumerate(rows, 1):
        kind, x, up = int(row[0]), row[1:], out[y - 1]
        own = out[y]
        if kind == 0:
            own[step:] = x
        elif kind == 2:
            own[step:] = x + up[step:]
        elif kind == 1:
            # A running sum of each channel, modulo 256.
            for c in range(step):
                own[step + c :: step] = np.cumsum(x[c::step], dtype=np.uint8)
        elif kind in (3, 4):
            line, above = bytearray(len(own)), up.tobytes()
            for i, v in enumerate(x.tobytes(), step):
                a, b = line[i - step], above[i]
                if kind == 3:
                    p = (a + b) >> 1
                else:
                    c = above[i - step]
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    p = a if pa <= pb and pa <= pc else b if pb <= pc else c
                line[i] = (v + p) & 255
            own[:] = np.frombuffer(bytes(line), dtype=np.uint8)
        else:
            raise ValueError("an unknown filter")
    return out[1:, step:]


def png_size(data: bytes) -> tuple[int, int]:
    """Width and height, from the first chunk alone."""
    if len(data) < 24 or not data.startswith(MAGIC) or data[12:16] != b"IHDR":
        raise ValueError("no PNG")
    return struct.unpack(">II", data[16:24])


def decode_png(data: bytes, most_pixels: int = 1 << 26) -> np.ndarray:
    """The picture in grey: colours weighted 0.299, 0.587, 0.114; alpha is ignored. ValueError for what is no such PNG.

    All colour types and depths, without interlacing; of 16 bits the high byte counts. Pictures of more than
    ``most_pixels`` are refused before they are inflated, and never more bytes are inflated than the size tells.
    """
    head, palette, parts = None, None, []
    for kind, body in png_chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
    if head is None:
        raise ValueError("no head")
    w, h, depth, colour, _, _, interlaced = head
    if interlaced or colour not in CHANNELS or depth not in (1, 2, 4, 8, 16) or not 0 < w * h <= most_pixels:
        raise ValueError("a PNG of another kind")
    channels = CHANNELS[colour]
    wide = (w * channels * depth + 7) // 8
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(parts), h * (wide + 1))
    except zlib.error as e:
        raise ValueError("damaged pixels") from e
    if len(raw) != h * (wide + 1):
        raise ValueError("pixels are missing")
    rows = _unfiltered(np.frombuffer(raw, dtype=np.uint8).reshape(h, wide + 1), max(1, channels * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)[:, : w * channels]
        rows = (bits * (1 << np.arange(depth)[::-1])).sum(-1).astype(np.uint8)
        if colour == 0:
            rows = (rows.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    x = rows.reshape(h, w, channels)
    if colour == 3:
        if palette is None or x.max(initial=0) >= len(palette):
            raise ValueError("no such colour")
        x = palette[x[:, :, 0]]
    if x.shape[2] < 3:
        return np.ascontiguousarray(x[:, :, 0])
    # Weights in 2 ** 14 parts, rounded to the nearest.
    return ((x[:, :, 0] * np.uint32(4899) + x[:, :, 1] * np.uint32(9617) + x[:, :, 2] * np.uint32(1868) + 8192) >> 14).astype(np.uint8)


def encode_png(g: np.ndarray, level: int = 6) -> bytes:
    """A grey picture as PNG; each row as what it adds to the one above."""
    h, w = g.shape
    rows = np.zeros((h, w + 1), dtype=np.uint8)
    rows[:, 0], rows[0, 1:] = 2, g[0]
    rows[1:, 1:] = g[1:] - g[:-1]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def shrunk(g: np.ndarray, width: int, height: int) -> np.ndarray:
    """The picture at a smaller size, each pixel the mean of the area that it covers."""

    def along(x: np.ndarray, n: int) -> np.ndarray:
        total = np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
        at = np.linspace(0, len(x), n + 1)
        low = np.minimum(at.astype(int), len(x) - 1)
        return np.diff(total[low] + (at - low)[:, None] * (total[low + 1] - total[low]), axis=0) * (n / len(x))

    return np.rint(along(along(g.astype(np.float64), height).T, width).T).astype(np.uint8)


def edges(g: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Where edges are: Sobel gradients that are largest across their direction, above ``high`` or joined to such by others
    above ``low``."""
    p = np.pad(g.astype(np.int32), 1, mode="edge")
    dx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    dy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    size = np.abs(dx) + np.abs(dy)
    m = np.pad(size, 1)
    ax, ay = np.abs(dx), np.abs(dy)
    # Within 22.5 degrees of an axis the neighbours along it count, else those along the diagonal.
    flat, steep = ay <= ax * 0.41421356, ay > ax * 2.41421356
    same = (dx ^ dy) >= 0
    at = lambda i, j: m[1 + i : m.shape[0] - 1 + i, 1 + j : m.shape[1] - 1 + j]
    before = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(same, at(-1, -1), at(-1, 1))))
    after = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(same, at(1, 1), at(1, -1))))
    weak = (size > low) & (size > before) & (size >= after)
    out = weak & (size > high)
    while True:
        q = np.pad(out, 1)
        near = np.zeros_like(out)
        for i in range(3):
            for j in range(3):
                near |= q[i : i + out.shape[0], j : j + out.shape[1]]
        new = weak & near
        if (new == out).all():
            return out
        out = new


def edge_density(g: np.ndarray) -> float:
    return float(edges(g).mean()) if g.size else 0.0


def dark_points(g: np.ndarray, width: int = 15, below: int = 6) -> np.ndarray:
    """(y, x) of pixels darker by ``below`` than the Gaussian mean around them."""
    sigma = 0.3 * ((width - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(width) - width // 2) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    p = np.pad(g.astype(np.float64), width // 2, mode="edge")
    rows = sum(k[i] * p[:, i : i + g.shape[1]] for i in range(width))
    mean = np.rint(sum(k[i] * rows[i : i + g.shape[0]] for i in range(width)))
    return np.argwhere(g.astype(np.int32) - mean <= -below)


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull, counter-clockwise, without points on its sides."""
    # Of each row only the ends can be on it.
    order = np.lexsort((points[:, 1], points[:, 0]))
    points = points[order]
    first = np.append(True, points[1:, 0] != points[:-1, 0])
    keep = first | np.append(first[1:], True)
    pts = [tuple(p) for p in np.unique(points[keep], axis=0).tolist()]
    if len(pts) <= 2:
        return np.array(pts)

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(reversed(pts)))


def least_rectangle(points: np.ndarray) -> tuple[float, float]:
    """(area, angle in degrees from 0 to below 90) of the least rectangle around the points.

    One of its sides lies on a side of the hull, so the rectangles on those are compared; of equal ones the least angle.
    """
    h = hull(points).astype(np.float64)
    if len(h) < 2:
        return 0.0, 0.0
    side = np.roll(h, -1, axis=0) - h
    angle = np.mod(np.degrees(np.arctan2(side[:, 1], side[:, 0])), 90.0)
    angle[np.isclose(angle, 90.0)] = 0.0
    areas = []
    for a in np.radians(angle):
        u, v = h @ (np.cos(a), np.sin(a)), h @ (-np.sin(a), np.cos(a))
        areas.append((u.max() - u.min()) * (v.max() - v.min()))
    areas = np.round(areas, 6)
    best = min(zip(areas.tolist(), angle.tolist(), strict=True))
    return best


def skew(g: np.ndarray, least_points: int = 100) -> float:
    """Degrees by which the dark points' least rectangle is turned, -45 to 45; 0 for few points.

    The least turn of an upright rectangle that gives it: a page turned by 3 degrees gives 3 or -3 whichever side is longer.
    """
    points = dark_points(g)
    if len(points) < least_points:
        return 0.0
    _, angle = least_rectangle(points)
    return angle if angle <= 45 else angle - 90.0


def stable_regions(g: np.ndarray, delta: int = 5, least: int = 30, share: float = 0.05, variation: float = 0.25) -> list[tuple[int, int, int, int]]:
    """(x1, y1, x2, y2) of maximally stable regions of dark and of bright pixels, x2 and y2 beyond the last.

    Pixels join in order of their grey value, by union-find; a component is a node of the tree at each grey value at which
    it has grown. A node's variation is the share by which its area grows over ``delta`` values; it is a region if that is
    at most ``variation``, less than that of the nodes next to it on its branch, and its area between ``least`` and a share
    of the picture. Zones of one value are found once, for both trees.
    """
    out = set()
    value, spans, pairs = flat_zones(g)
    for grey in (value, 255 - value):
        out |= set(_stable(_joined_zones(grey, spans, pairs), delta, least, int(g.size * share), variation))
    return sorted(out, key=lambda b: (b[1], b[0], b[3], b[2]))


def _least_of_set(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number of each one's set, where the pairs join 0 to n - 1."""
    low = np.arange(n)
    while True:
        p, q = low[a], low[b]
        if (p == q).all():
            return low
        np.minimum.at(low, np.maximum(p, q), np.minimum(p, q))
        while (low != (lower := low[low])).any():
            low = lower


def flat_zones(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Connected pixels of one value: their value; area, x1, y1, x2, y2; and the pairs of zones that touch, each once.

    Pixels of a row are joined to runs first, so what follows grows with the runs, not with the pixels.
    """
    h, w = g.shape
    first = np.ones((h, w), dtype=bool)
    first[:, 1:] = g[:, 1:] != g[:, :-1]
    at = np.flatnonzero(first)
    y, x = np.divmod(at, max(1, w))
    long = np.diff(at, append=g.size)
    value = g.ravel()[at]
    run = np.cumsum(first).reshape(h, w) - 1
    # Two runs of neighbouring rows first touch where one of them begins.
    meet = first[1:] | first[:-1]
    up, down = run[:-1][meet], run[1:][meet]
    same = value[up] == value[down]
    one, zone = np.unique(_least_of_set(len(at), up[same], down[same]), return_inverse=True)
    n = len(one)
    spans = np.empty((n, 5), dtype=np.int64)
    spans[:, 0] = np.bincount(zone, long, n)
    spans[:, 1:3], spans[:, 3:] = max(h, w), 0
    for c, ufunc, ends in ((1, np.minimum, x), (2, np.minimum, y), (3, np.maximum, x + long), (4, np.maximum, y + 1)):
        ufunc.at(spans[:, c], zone, ends)
    right = np.flatnonzero(x)
    a, b = zone[np.append(up[~same], right - 1)], zone[np.append(down[~same], right)]
    return value[one], spans, np.stack(np.divmod(np.unique(np.minimum(a, b) * n + np.maximum(a, b)), max(1, n)), axis=1)


def component_tree(g: np.ndarray) -> list[list[int]]:
    """Nodes of the tree of components of pixels up to each value: value, area, x1, y1, x2, y2, parent (-1 at the root).

    A node whose parent is -2 is none: it joined another of its own value.
    """
    return _joined_zones(*flat_zones(g))


def _joined_zones(value: np.ndarray, spans: np.ndarray, pairs: np.ndarray) -> list[list[int]]:
    """The component tree of flat zones: a zone joins those that it touches when its value comes."""
    nodes = [[v, *s, -1] for v, s in zip(value.tolist(), spans.tolist(), strict=True)]
    root, alike = list(range(len(nodes))), list(range(len(nodes)))

    def find(way: list[int], i: int) -> int:
        while way[i] != i:
            way[i] = i = way[way[i]]
        return i

    # The one of the higher value first. Zones that touch differ in value.
    pairs = np.where((value[pairs[:, 0]] > value[pairs[:, 1]])[:, None], pairs, pairs[:, ::-1])
    for i, j in pairs[np.argsort(value[pairs[:, 0]], kind="stable")].tolist():
        a, b = find(root, i), find(root, j)
        if a == b:
            continue
        p, q = nodes[a], nodes[b]
        # What has a lower value becomes a child; what has this one already is the same node from now on.
        if q[0] != p[0]:
            q[6] = a
        else:
            q[6], alike[b] = -2, a
        p[1:6] = p[1] + q[1], min(p[2], q[2]), min(p[3], q[3]), max(p[4], q[4]), max(p[5], q[5])
        root[b] = a

    for n in nodes:
        if n[6] >= 0:
            n[6] = find(alike, n[6])
    return nodes


def _stable(nodes: list[list[int]], delta: int, least: int, most: int, variation: float) -> list[tuple[int, int, int, int]]:
    change: dict[int, float] = {}
    for k, n in enumerate(nodes):
        if n[6] <= -2 or not least <= n[1] <= most:
            continue
        top = k
        while nodes[top][6] >= 0 and nodes[nodes[top][6]][0] <= n[0] + delta:
            top = nodes[top][6]
        change[k] = (nodes[top][1] - n[1]) / n[1]
    lower: dict[int, float] = {}
    for k, c in change.items():
        if (up := nodes[k][6]) >= 0:
            lower[up] = min(lower.get(up, np.inf), c)
    found = []
    for k, c in change.items():
        up = nodes[k][6]
        if c <= variation and c < change.get(up, np.inf) and c <= lower.get(k, np.inf):
            found.append(tuple(nodes[k][2:6]))
    return found
