"""Cropped and edited copies of images by local descriptors.

Corners are found at several scales of an image; around each the direction of its intensity
centroid turns a fixed pattern of binary tests, giving a descriptor of BITS bits that rotation and
brightness leave alone.  Descriptors meet in Hamming tables: one equi-join on each part of their
bits.  Matches within RADIUS bits vote for the rotation, scale and shift that carry one image to the
other; two images are linked when LEAST matches agree.  Classes are connected components.

Images with equal pixels are one node from the start.  Images with a part that over MOST corners
share are the crowd: there pairs of corners would be too many rows, so the images meet in blocks and
their matches and votes stay in the task, which tells each image's number of links and joins classes.
No pair of images that share a part is left out.

Defined cases: an image that is null, damaged or without corners is a class of its own (with its
equal copies); ties between corners go to the upper, then left one; rows with a null id are left
out; repeated rows are one image; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, written
from tessera.llm.simhash import components

SCALES = (1.0, 0.75, 0.5)
CORNERS, REACH, TURNS, BITS = 10, 7, 24, 128
RADIUS, LEAST = 14, 5
MOST = 16
BLOCK, LEAST_BLOCKS, STEP, CELLS = 8192, 4, 100_000, 32
SHIFT_BIN, TURN_BIN = 8.0, 3
SIDE, GRID = 64, 8
IMAGES = "id long, width int, height int, pixels binary"
POINTS = "id long, point int, x float, y float, scale int, turn int, d0 long, d1 long"


@cache
def pattern() -> np.ndarray:
    """The tests at each turn: (TURNS, BITS, 4) offsets y1, x1, y2, x2 within REACH."""
    rng = np.random.default_rng(11)
    points = np.clip(rng.normal(0, REACH / 2.2, (BITS, 2, 2)), -REACH + 1, REACH - 1)
    out = np.empty((TURNS, BITS, 4), np.int64)
    for k in range(TURNS):
        a = 2 * np.pi * k / TURNS
        turn = np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])  # of (y, x)
        out[k] = np.clip(np.rint(points @ turn.T), -REACH, REACH).reshape(BITS, 4)
    return out


@cache
def disc() -> np.ndarray:
    y, x = np.mgrid[-REACH : REACH + 1, -REACH : REACH + 1]
    return np.argwhere(y * y + x * x <= REACH * REACH) - REACH


@cache
def resizer(size: int, scale: float) -> np.ndarray:
    """Matrix that takes size samples to round(size * scale), each a Gaussian mean around its place."""
    n = max(1, round(size * scale))
    gap = (np.arange(n)[:, None] + 0.5) / n * size - 0.5 - np.arange(size)[None]
    weight = np.exp(-0.5 * (gap / (0.8 / scale)) ** 2)
    return (weight / weight.sum(axis=1, keepdims=True)).astype(np.float32)


def around(a: np.ndarray) -> np.ndarray:
    """Binomial mean over 3 x 3."""
    p = np.pad(a, ((0, 0), (1, 1), (1, 1)), mode="edge")
    rows = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return (rows[:, :, :-2] + 2 * rows[:, :, 1:-1] + rows[:, :, 2:]) / 16


def described(images: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For each scale of (n, height, width) images: image, x, y, turn, packed bits of its corners."""
    found = []
    for scale in SCALES:
        small = resizer(images.shape[1], scale) @ images.astype(np.float32) @ resizer(images.shape[2], scale).T
        n, height, width = small.shape
        if min(height, width) <= 2 * REACH + 2:
            found.append(None)
            continue
        gy, gx = np.gradient(small, axis=(1, 2))
        xx, yy, xy = around(gx * gx), around(gy * gy), around(gx * gy)
        corner = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = np.full_like(corner, -np.inf)
        inside = (slice(None), slice(REACH, height - REACH), slice(REACH, width - REACH))
        inner[inside] = corner[inside]
        peak = inner > 1e-3
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    other = np.roll(inner, (dy, dx), axis=(1, 2))
                    peak &= inner >= other if dy < 0 or dy == 0 and dx < 0 else inner > other
        value = np.where(peak, inner, -np.inf).reshape(n, -1)
        best = np.argsort(-value, axis=1, kind="stable")[:, :CORNERS]
        image, slot = np.nonzero(np.isfinite(np.take_along_axis(value, best, axis=1)))
        place = best[image, slot]
        y, x = place // width, place % width
        around_it = small[image[:, None], y[:, None] + disc()[None, :, 0], x[:, None] + disc()[None, :, 1]]
        around_it = around_it - around_it.mean(axis=1, keepdims=True)
        angle = np.arctan2(around_it @ disc()[:, 0], around_it @ disc()[:, 1])
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
        smooth, tests = around(small), pattern()[turn]
        first = smooth[image[:, None], y[:, None] + tests[:, :, 0], x[:, None] + tests[:, :, 1]]
        second = smooth[image[:, None], y[:, None] + tests[:, :, 2], x[:, None] + tests[:, :, 3]]
        bits = np.packbits(first < second, axis=1).view(">i8").astype(np.int64)
        found.append((image, (x + 0.5) / width * images.shape[2], (y + 0.5) / height * images.shape[1], turn, bits))
    return found


def descriptors(nodes: DataFrame) -> DataFrame:
    """Corners and descriptors of images (id, width, height, pixels): 8-bit grey, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
            for node, width, height, pixels in zip(*[c.to_pylist() for c in batch.columns]):
                if pixels and width and height and len(pixels) == width * height:
                    shapes.setdefault((height, width), []).append((node, pixels))
            for (height, width), some in shapes.items():
                step = max(1, 1_000_000 // (height * width))
                for k in range(0, len(some), step):
                    part = some[k : k + step]
                    stack = np.frombuffer(b"".join(p for _, p in part), np.uint8).reshape(len(part), height, width)
                    names = np.array([n for n, _ in part])
                    for s, hit in enumerate(described(stack)):
                        if hit is None or not len(hit[0]):
                            continue
                        image, x, y, turn, bits = hit
                        order = np.arange(len(image)) - np.searchsorted(image, image)
                        columns = [pa.array(names[image], pa.int64()), pa.array((s * CORNERS + order).astype(np.int32)), pa.array(x.astype(np.float32)), pa.array(y.astype(np.float32)), pa.array(np.full(len(image), s, np.int32)), pa.array(turn.astype(np.int32)), pa.array(bits[:, 0]), pa.array(bits[:, 1])]
                        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in POINTS.split(", ")])

    return nodes.select("id", "width", "height", "pixels").mapInArrow(run, POINTS)


def part_keys():
    """Three parts of a descriptor's bits (43, 43 and 42), each with its number."""
    low = F.lit((1 << 43) - 1)
    high = F.shiftrightunsigned("d0", 43).bitwiseOR(F.shiftleft(F.shiftrightunsigned("d1", 43), 21))
    return F.array(*[F.struct(F.lit(k).alias("part"), v.alias("bits")) for k, v in enumerate((F.col("d0").bitwiseAND(low), F.col("d1").bitwiseAND(low), high))])


def keyed(points: DataFrame) -> DataFrame:
    return points.select("*", F.inline(part_keys()))


def crowded(points: DataFrame) -> DataFrame:
    """Ids of the images with a part that over MOST corners share."""
    sizes = keyed(points).groupBy("part", "bits").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"))
    many = sizes.filter((F.col("low") < F.col("high")) & (F.col("n") > MOST)).select("part", "bits")
    return cut(keyed(points).join(many.hint("merge"), ["part", "bits"], "left_semi").select("id").distinct())


def matches(points: DataFrame, crowd: DataFrame | None = None) -> DataFrame:
    """For pairs of images a < b: the matched corners, at least LEAST of them (at most all of a with all
    of b, a fixed number).  Pairs of two images of the crowd (id) are left out."""
    flagged = points.withColumn("busy", F.lit(False)) if crowd is None else points.join(crowd.withColumn("busy", F.lit(True)).hint("merge"), "id", "left").withColumn("busy", F.coalesce("busy", F.lit(False)))
    entries = keyed(flagged)
    meet = entries.groupBy("part", "bits").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.bool_and("busy").alias("all")).filter("low < high and not all").select("part", "bits")
    shared = written(entries.join(meet.hint("merge"), ["part", "bits"], "left_semi"), "shared")
    a, b = shared.alias("a"), shared.alias("b")
    apart = F.bit_count(F.col("a.d0").bitwiseXOR(F.col("b.d0"))) + F.bit_count(F.col("a.d1").bitwiseXOR(F.col("b.d1")))
    pairs = a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.id") < F.col("b.id")) & ~(F.col("a.busy") & F.col("b.busy")) & (apart <= RADIUS))
    found = pairs.select(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("id", "point", "x", "y", "scale", "turn")])
    ends = [c for c in found.columns if not c.startswith("id")]
    together = found.groupBy("id_a", "id_b").agg(F.collect_set(F.struct(*ends)).alias("m")).filter(F.size("m") >= LEAST)
    return together.select("id_a", "id_b", F.inline("m"))


class Block:
    """Corners of some images as flat arrays, the images by id."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, corners: dict[str, np.ndarray]):
        order = np.argsort(ids, kind="stable")
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.ids, sizes = ids[order], sizes[order]
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        rows = np.repeat(first[order] - self.start[:-1], sizes) + np.arange(self.start[-1])
        self.image = np.repeat(np.arange(len(ids)), sizes)
        self.corner = {k: v[rows] for k, v in corners.items()}
        self.corner |= {k: self.corner[k].astype(np.int64).view(np.uint64) for k in ("d0", "d1")}
        d0, d1 = self.corner["d0"], self.corner["d1"]
        low = np.uint64((1 << 43) - 1)
        self.parts = [d0 & low, d1 & low, d0 >> np.uint64(43) | d1 >> np.uint64(43) << np.uint64(21)]


def near_corners(one: Block, other: Block, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Corners of one and of other that share a part and are within RADIUS, each pair once, of those images that have
    LEAST such pairs of one difference of scale; all of an image of one together, for about STEP pairs (and at most CELLS times as many counts) at once.

    The shared parts of two images are counted before their corners are looked at: few images share LEAST."""
    zooms = 2 * len(SCALES) - 1
    spans, work = [], np.zeros(len(one.image), np.int64)
    for mine, theirs in zip(one.parts, other.parts):
        order = np.argsort(theirs, kind="stable")
        value, image = theirs[order], other.image[order]
        high = np.searchsorted(value, mine, "right")
        if same:  # from behind an image's own corners on, as those of a value are in order of images
            stops = np.append(np.flatnonzero((value[1:] != value[:-1]) | (image[1:] != image[:-1])) + 1, len(value))
            low = np.empty_like(high)
            low[order] = np.repeat(stops, np.diff(stops, prepend=0))
        else:
            low = np.searchsorted(value, mine, "left")
        spans.append((order, low, high - low, image * zooms - other.corner["scale"][order]))
        work += high - low
    d, e = one.corner, other.corner
    wide = len(other.ids) * zooms
    before = np.concatenate([[0], np.cumsum(work)])[one.start] + np.arange(len(one.start)) * (wide // CELLS)
    cuts = np.flatnonzero(np.diff(before[:-1] // STEP)) + 1
    for first, last in zip([0, *cuts], [*cuts, len(one.ids)]):
        s, t = one.start[first], one.start[last]
        base = (one.image[s:t] - first) * wide + d["scale"][s:t] + len(SCALES) - 1
        places, keys = [], []
        for _, low, n, place in spans:
            n = n[s:t]
            at = np.repeat(low[s:t] - np.cumsum(n) + n, n)
            at += np.arange(len(at))
            places.append(at)
            keys.append(np.repeat(base, n) + place[at])
        enough = np.bincount(np.concatenate(keys)) >= LEAST
        hits = []
        for k, ((order, _, n, _), at, key) in enumerate(zip(spans, places, keys)):
            kept = np.flatnonzero(enough[key])
            i, j, key = np.searchsorted(np.cumsum(n[s:t]), kept, "right") + s, order[at[kept]], key[kept]
            near = np.bitwise_count(d["d0"][i] ^ e["d0"][j]) + np.bitwise_count(d["d1"][i] ^ e["d1"][j]) <= RADIUS
            for p in range(k):
                near &= one.parts[p][i] != other.parts[p][j]
            hits.append((i[near], j[near], key[near]))
        i, j, key = (np.concatenate(x) for x in zip(*hits))
        _, pair, n = np.unique(key, return_inverse=True, return_counts=True)
        enough = n[pair] >= LEAST
        yield i[enough], j[enough]


def vote(code: np.ndarray, point: np.ndarray, bins: list[tuple[np.ndarray, float]], pair: np.ndarray, linked: np.ndarray) -> None:
    """Mark in linked the pairs of which LEAST points fall into one bin of each kind; bins overlap by half.

    Kind by kind, only matches go on whose bins so far hold LEAST and whose pair is not linked yet."""
    if not bins:
        first = np.unique(code * (len(SCALES) * CORNERS) + point, return_index=True)[1]
        _, at, n = np.unique(code[first], return_index=True, return_counts=True)
        linked[pair[first[at[n >= LEAST]]]] = True
        return
    (value, size), *others = bins
    for half in (0.0, 0.5):
        bin_ = np.floor(value / size + half).astype(np.int64)
        _, within, n = np.unique(code * (np.ptp(bin_) + 1) + bin_ - bin_.min(), return_inverse=True, return_counts=True)
        on = np.flatnonzero((n[within] >= LEAST) & ~linked[pair])
        if len(on):
            vote(within[on], point[on], [(v[on], w) for v, w in others], pair[on], linked)


def block_links(one: Block, other: Block, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the linked images in one and in other: what matches() and agreed() find, in memory."""
    for i, j in near_corners(one, other, same):
        if not len(i):
            continue
        names, pair = np.unique(one.image[i] * len(other.ids) + other.image[j], return_inverse=True)
        turned = one.ids[one.image[i]] > other.ids[other.image[j]]
        a, b = ({k: np.where(turned == swap, one.corner[k][i], other.corner[k][j]) for k in ("point", "x", "y", "scale", "turn")} for swap in (False, True))
        angle = (b["turn"].astype(np.int64) - a["turn"]) * (2 * np.pi / TURNS)
        ratio = np.array(SCALES)[a["scale"]] / np.array(SCALES)[b["scale"]]
        xa, ya, xb, yb = (v.astype(float) for v in (a["x"], a["y"], b["x"], b["y"]))
        dx = xb - ratio * (np.cos(angle) * xa - np.sin(angle) * ya)
        dy = yb - ratio * (np.sin(angle) * xa + np.cos(angle) * ya)
        bins = [(np.mod(angle, 2 * np.pi), TURN_BIN * 2 * np.pi / TURNS), (dx, SHIFT_BIN), (dy, SHIFT_BIN)]
        zoom = a["scale"].astype(np.int64) - b["scale"] + len(SCALES)
        linked = np.zeros(len(names), bool)
        vote(pair * (2 * len(SCALES)) + zoom, a["point"].astype(np.int64), bins, pair, linked)
        yield np.divmod(names[linked], len(other.ids))


def joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (the least place of a class) after the links u, v."""
    while (label[u] != label[v]).any():
        x, y = label[u], label[v]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def crowd_links(points: DataFrame, crowd: DataFrame) -> DataFrame:
    """Links among images of the crowd (id), in a few rows for each two blocks of images: b, its number of links n
    there, and an a < b of its class there (null if b is the least).

    Every image meets every other in one task: blocks of BLOCK images in pairs.  That is quadratic in the crowd,
    but a task holds two blocks and about STEP pairs of corners, whatever the sizes of groups."""
    blocks = max(LEAST_BLOCKS, -(-crowd.count() // BLOCK))
    fields = {"point": "tinyint", "x": "float", "y": "float", "scale": "tinyint", "turn": "tinyint", "d0": "long", "d1": "long"}
    corner = F.struct(*[F.col(c).cast(t).alias(c) for c, t in fields.items()])
    packed = points.join(crowd.hint("merge"), "id", "left_semi").groupBy("id").agg(F.collect_list(corner).alias("m")).select("id", *[F.col(f"m.{c}").alias(c) for c in fields])
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = packed.withColumns({"own": own, "met": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))}).withColumns({"low": F.least("own", "met"), "high": F.greatest("own", "met")})

    def run(key: tuple, group: pa.Table) -> pa.Table:
        low, high = (k.as_py() for k in key)
        sides = []
        for block in dict.fromkeys((low, high)):
            some = group.filter(pa.compute.equal(group["own"], block))
            sizes = pa.compute.list_value_length(some["point"]).to_numpy().astype(np.int64)
            sides.append(Block(some["id"].to_numpy(), sizes, {c: pa.compute.list_flatten(some[c]).to_numpy() for c in fields}))
        one, other, shift = sides[0], sides[-1], len(sides[0].ids) if len(sides) > 1 else 0
        ids = np.concatenate([s.ids for s in sides])
        rank = np.argsort(np.argsort(ids))
        label, n = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for u, v in block_links(one, other, low == high):
            u, v = rank[u], rank[v + shift]
            n += np.bincount(u, minlength=len(ids)) + np.bincount(v, minlength=len(ids))
            label = joined(label, u, v)
        ids, b = np.sort(ids), np.flatnonzero(n)
        return pa.table({"a": pa.array(ids[label[b]], pa.int64(), mask=label[b] == b), "b": pa.array(ids[b], pa.int64()), "n": pa.array(n[b], pa.int64())})

    return dealt.drop("met").groupBy("low", "high").applyInArrow(run, "a long, b long, n long")


def agreed(found: DataFrame) -> DataFrame:
    """Linked images a < b: LEAST corners of a whose matches agree on rotation, scale and shift."""
    angle = (F.col("turn_b") - F.col("turn_a")) * (2 * np.pi / TURNS)
    ratio = F.element_at(F.array(*[F.lit(s) for s in SCALES]), F.col("scale_a") + 1) / F.element_at(F.array(*[F.lit(s) for s in SCALES]), F.col("scale_b") + 1)
    moved = found.withColumns({"angle": angle, "ratio": ratio}).withColumns(
        {
            "dx": F.col("x_b") - F.col("ratio") * (F.cos("angle") * F.col("x_a") - F.sin("angle") * F.col("y_a")),
            "dy": F.col("y_b") - F.col("ratio") * (F.sin("angle") * F.col("x_a") + F.cos("angle") * F.col("y_a")),
        }
    )
    # bins overlap by half, so matches near an edge meet in one of them
    half = F.array(F.lit(0.0), F.lit(0.5))
    votes = moved.select("id_a", "id_b", "point_a", (F.col("scale_a") - F.col("scale_b")).alias("zoom"), F.pmod("angle", F.lit(2 * np.pi)).alias("angle"), "dx", "dy")
    for name, width in (("dx", SHIFT_BIN), ("dy", SHIFT_BIN), ("angle", TURN_BIN * 2 * np.pi / TURNS)):
        votes = votes.withColumn("__h", F.explode(half)).withColumn(name, F.struct(F.floor(F.col(name) / width + F.col("__h")).alias("bin"), "__h")).drop("__h")
    tally = votes.groupBy("id_a", "id_b", "zoom", "angle", "dx", "dy").agg(F.countDistinct("point_a").alias("n"))
    return tally.filter(F.col("n") >= LEAST).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def copies(images: DataFrame) -> DataFrame:
    """id, class_id (least id of the class), n_links (links its pixels have to others), n_points."""
    shape = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("width", "height")]
    pixels = F.coalesce(F.sha2("pixels", 256), F.concat(F.lit("none"), F.col("id").cast("string")))
    named = written(images.filter("id is not null").withColumn("node", F.sha2(F.concat_ws(":", *shape, pixels), 256)).select("id", "width", "height", "pixels", "node"), "images")
    ids = named.select("id", "node").distinct()
    nodes = cut(ids.groupBy("node").agg(F.min("id").alias("least")))
    distinct = named.join(nodes.select("node", F.col("least").alias("id")).hint("merge"), ["node", "id"]).dropDuplicates(["id"])
    points = written(descriptors(distinct), "points")
    crowd = crowded(points)
    linked = cut(agreed(matches(points, crowd)))
    within = cut(crowd_links(points, crowd))
    roots = components(linked.union(within.filter("a is not null").select("a", "b"))).withColumnsRenamed({"node": "least", "root": "class_id"})
    one = F.lit(1).cast("long").alias("n")
    counts = linked.select(F.col("a").alias("least"), one).union(linked.select("b", one)).union(within.select("b", "n"))
    ends = counts.groupBy("least").agg(F.sum("n").alias("n_links"))
    corners = points.groupBy(F.col("id").alias("least")).agg(F.count(F.lit(1)).alias("n_points"))
    known = nodes.join(corners, "least", "left").join(ends, "least", "left").join(roots, "least", "left")
    known = cut(known.select("node", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_points", F.lit(0)).cast("long").alias("n_points")))
    return ids.join(known, "node").select("id", "class_id", "n_links", "n_points")


def rendered(vectors: DataFrame, key: str = "vec_id", values: str = "embedding") -> DataFrame:
    """Media column of a table of vectors: each as a smooth grey picture of its GRID x GRID values."""
    up = resizer_up()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = []
            for vector in batch.column(1).to_pylist():
                v = np.array(vector if vector and None not in vector else [], float)
                if len(v) != GRID * GRID or not np.isfinite(v).all():
                    pixels.append(None)
                    continue
                v = (v - v.mean()) / max(v.std(), 1e-12)
                grey = up @ v.reshape(GRID, GRID) @ up.T
                pixels.append(np.clip(128 + 50 * grey, 0, 255).astype(np.uint8).tobytes())
            size = pa.array([SIDE] * len(pixels), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), size, size, pa.array(pixels, pa.binary())], names=["id", "width", "height", "pixels"])

    return vectors.select(key, values).mapInArrow(run, IMAGES)


def resizer_up() -> np.ndarray:
    """SIDE x GRID interpolation by Gaussian weights."""
    gap = (np.arange(SIDE)[:, None] + 0.5) / SIDE * GRID - 0.5 - np.arange(GRID)[None]
    weight = np.exp(-0.5 * (gap / 0.45) ** 2)
    return weight / weight.sum(axis=1, keepdims=True)
