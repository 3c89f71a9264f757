"""Media columns: cropped and edited copies of images by local descriptors.

An image is a binary column in the portable graymap format. Corners are found at all scales, half an octave apart;
around each one, binary tests between smoothed pixels, turned by the corner's orientation, make a descriptor of 128
bits. Descriptors meet in tables of their 16-bit parts and are kept within a Hamming radius. Each match states a turn,
a scale and a shift; matches that state nearly the same are fitted by one similarity transform, and an image that
enough of a query's corners agree on is a copy.

A stated set of query images is searched for among all images: queries go out in blocks of bounded size, and every
image is described, looked up and judged where it lies. No descriptor is dropped and none crosses the network.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwatch.llm.common import attach, read_table, written
from helmwatch.llm.textscan import mix

BITS = 128
TABLES = 8
RADIUS = 18
TURNS = 24
PATCH = 7
CHOICE = 8
MARGIN = PATCH + 1
#: Least corner strength (product of squared gradients of 8-bit pixels).
STRENGTH = 1000.0
MIN_VOTES = 4
#: Matches of one copy lie within this many pixels of its transform, at the scale of the image's corner.
TOLERANCE = 2.5
#: A match's own turn (radians) and scale (octaves) differ from the transform's by this at most.
TURN_OFF, SCALE_OFF = 0.35, 0.6
#: Query descriptors that go out at once: 4 MB of descriptors, 4 MB of tables.
BLOCK = 1 << 17
#: Pixels that are described at once; a larger image is alone.
STACK_PIXELS = 1 << 18
#: Table hits that are tested at once.
STEP = 1 << 20
#: Rows that are rendered or described at once; pairs of a query and an image that are judged at once.
ROWS = 512
PAIRS = 1 << 16

CORNER = np.dtype([("x", "<f4"), ("y", "<f4"), ("angle", "<f4"), ("level", "<i4"), ("lo", "<u8"), ("hi", "<u8")])
DESCRIPTOR_SCHEMA = "id long, digest binary, side int, n int, corners binary"
_KINDS = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]


def _tests() -> np.ndarray:
    """TURNS x BITS x 2 points x (y, x): one random set of tests, turned. A patch is brighter towards its orientation,
    here x, so a test between places of different x has a likely answer; of CHOICE as many random tests those with the
    least difference in x are taken."""
    rng = np.random.Generator(np.random.PCG64(11))
    points = rng.normal(0, PATCH / 2.0, (CHOICE * BITS, 2, 2))
    points *= np.minimum(1, PATCH / np.linalg.norm(points, axis=2, keepdims=True))
    points = points[np.abs(points[:, 0, 0] - points[:, 1, 0]) >= 2]
    points = rng.permutation(points[np.argsort(np.abs(points[:, 0, 1] - points[:, 1, 1]))[:BITS]])
    angles = 2 * np.pi * np.arange(TURNS) / TURNS
    turn = np.array([[np.cos(angles), np.sin(angles)], [-np.sin(angles), np.cos(angles)]])  # (y, x) rows
    return np.rint(np.einsum("abt,kpb->tkpa", turn, points)).astype(np.int32)


TESTS = _tests()
_DISC = np.array([(y, x) for y in range(-PATCH, PATCH + 1) for x in range(-PATCH, PATCH + 1) if y * y + x * x <= PATCH * PATCH])


def write_graymap(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def read_graymap(data: bytes | None) -> np.ndarray | None:
    """An image's pixels, or None for what is no binary graymap of 8 bits."""
    fields, at = [], 2
    if not data or data[:2] != b"P5":
        return None
    while len(fields) < 3:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if not data[at:end].isdigit():
            return None
        fields.append(int(data[at:end]))
        at = end
    w, h, top = fields
    body = data[at + 1 : at + 1 + w * h]
    return np.frombuffer(body, np.uint8).reshape(h, w) if w and h and top < 256 and len(body) == w * h else None


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2r + 1 of the last two axes; edges repeat."""
    p = np.pad(a, ((0, 0), (r, r), (r, r)), mode="edge")
    h, w = a.shape[1:]
    rows = reduce(np.add, (p[:, k : k + h] for k in range(2 * r + 1)))
    return reduce(np.add, (rows[:, :, k : k + w] for k in range(2 * r + 1)))


def _shrunk(a: np.ndarray) -> np.ndarray:
    """The stack at 1/sqrt(2) of its sides, between the nearest two rows and columns of the smoothed pixels."""
    a = _box(a, 1) / np.float32(9)
    for axis in (1, 2):
        n = int(a.shape[axis] / 2**0.5)
        at = (np.arange(n) + 0.5) * 2**0.5 - 0.5
        low = np.minimum(at.astype(np.int64), a.shape[axis] - 2)
        part = (at - low).astype(np.float32).reshape((-1, 1) if axis == 1 else (-1,))
        a = np.take(a, low, axis) * (1 - part) + np.take(a, low + 1, axis) * part
    return a


def describe(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(image of every corner, corners) of images of one size, a stack of 8-bit pixels; by image. x and y are pixels
    of the whole image from its centre. Corners are all local maxima of the corner strength above STRENGTH."""
    pixels, level, found = stack.astype(np.float32), 0, []
    height, width = stack.shape[1:]
    while min(pixels.shape[1:]) > 2 * MARGIN + 2:
        h, w = pixels.shape[1:]
        smooth = _box(pixels, 1) / np.float32(9)
        gy, gx = np.zeros_like(smooth), np.zeros_like(smooth)
        gy[:, 1:-1] = (smooth[:, 2:] - smooth[:, :-2]) / 2
        gx[:, :, 1:-1] = (smooth[:, :, 2:] - smooth[:, :, :-2]) / 2
        a, b, c = (_box(x, 2) / np.float32(25) for x in (gx * gx, gy * gy, gx * gy))
        strength = a * b - c * c - np.float32(0.05) * (a + b) ** 2
        inner = strength[:, MARGIN : h - MARGIN, MARGIN : w - MARGIN]
        around = np.pad(inner, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf)
        rows = np.maximum(np.maximum(around[:, :-2], around[:, 1:-1]), around[:, 2:])
        peak = np.maximum(np.maximum(rows[:, :, :-2], rows[:, :, 1:-1]), rows[:, :, 2:])
        image, ys, xs = np.nonzero((inner >= peak) & (inner > STRENGTH))
        if len(ys):
            ys, xs = ys + MARGIN, xs + MARGIN
            flat = smooth.ravel()
            at = (image * h + ys) * w + xs
            disc = flat[at[:, None] + (_DISC[:, 0] * w + _DISC[:, 1])]
            disc -= disc.mean(axis=1, keepdims=True)
            angle = np.arctan2(disc @ _DISC[:, 0].astype(np.float32), disc @ _DISC[:, 1].astype(np.float32))
            offsets = (TESTS[..., 0] * w + TESTS[..., 1])[np.rint(angle * TURNS / (2 * np.pi)).astype(np.int64) % TURNS]
            words = np.packbits(flat[at[:, None] + offsets[..., 0]] < flat[at[:, None] + offsets[..., 1]], axis=1).view("<u8")
            corners = np.empty(len(ys), CORNER)
            scale = 2 ** (level / 2)
            corners["x"], corners["y"] = (xs + 0.5) * scale - width / 2, (ys + 0.5) * scale - height / 2
            corners["angle"], corners["level"], corners["lo"], corners["hi"] = angle, level, words[:, 0], words[:, 1]
            found.append((image, corners))
        pixels, level = _shrunk(pixels), level + 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, CORNER)
    image, corners = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(image, kind="stable")
    return image[order], corners[order]


def _described(images: list[bytes | None]) -> list[tuple[bytes | None, int, bytes]]:
    """(digest, longer side, corners) of every image; equal ones are described once."""
    digests = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in images]
    first: dict[bytes, int] = {}
    for k, d in enumerate(digests):
        if d is not None:
            first.setdefault(d, k)
    pixels = {k: p for k in first.values() if (p := read_graymap(images[k])) is not None}
    alike: dict[tuple[int, int], list[int]] = {}
    for k, p in pixels.items():
        alike.setdefault(p.shape, []).append(k)
    corners: dict[int, tuple[int, bytes]] = {}
    for (h, w), rows in alike.items():
        step = max(STACK_PIXELS // (h * w), 1)
        for s in range(0, len(rows), step):
            own = rows[s : s + step]
            image, found = describe(np.stack([pixels[k] for k in own]))
            cuts = np.searchsorted(image, np.arange(len(own) + 1))
            for k, a, b in zip(own, cuts[:-1], cuts[1:], strict=True):
                corners[k] = (max(h, w), found[a:b].tobytes())
    return [(d, *corners.get(first.get(d, -1), (0, b""))) for d in digests]


def _sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in DESCRIPTOR_SCHEMA.split(", ")]
    for batch in _sliced(batches, ROWS):
        digests, sides, corners = zip(*_described(batch.column(1).to_pylist()), strict=True)
        counts = [len(c) // CORNER.itemsize for c in corners]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip((batch.column(0), digests, sides, counts, corners), _KINDS, strict=True)], names=names)


def descriptors(images: DataFrame, id_col: str = "id", image_col: str = "image") -> DataFrame:
    """(id, digest, side, n, corners) of every row: a digest of the image's bytes, its longer side, its n corners.

    Null, empty, unreadable and even images have no corners, a null no digest; repeated rows repeat theirs; an empty
    table has none; other columns are ignored."""
    return images.select(F.col(id_col).cast("long"), F.col(image_col)).mapInArrow(_describe, DESCRIPTOR_SCHEMA)


def _parts(corners: np.ndarray) -> np.ndarray:
    """n x TABLES: the 16-bit parts of descriptors."""
    return np.stack([corners["lo"], corners["hi"]], axis=1).view("<u2")


class Block:
    """Queries' corners and their tables: for each part, the corners sorted by it and where each value begins."""

    def __init__(self, rows: list[tuple[int, int, bytes]]):
        self.corners = np.concatenate([np.zeros(0, CORNER), *(np.frombuffer(c, CORNER) for _, _, c in rows)])
        n = [len(c) // CORNER.itemsize for _, _, c in rows]
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.sides = np.array([r[1] for r in rows], np.float64)
        self.query = np.repeat(np.arange(len(rows)), n)
        self.parts = _parts(self.corners)
        self.orders = [np.argsort(self.parts[:, k], kind="stable") for k in range(TABLES)]
        self.begins = [np.searchsorted(self.parts[o, k], np.arange(1 << 16 | 1)) for k, o in enumerate(self.orders)]

    def matches(self, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query corner, corner) of all pairs within RADIUS that share a table entry, each once."""
        parts, found = _parts(corners), []
        for k in range(TABLES):
            begin = self.begins[k][parts[:, k].astype(np.int64)]
            count = self.begins[k][parts[:, k].astype(np.int64) + 1] - begin
            ends = np.cumsum(count)
            at = 0
            while at < len(ends):
                done = int(ends[at - 1]) if at else 0
                end = max(int(np.searchsorted(ends, done + STEP, side="right")), at + 1)
                n = count[at:end]
                i = np.repeat(np.arange(at, end), n)
                q = self.orders[k][np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at:end], n)]
                far = np.bitwise_count(self.corners["lo"][q] ^ corners["lo"][i]) + np.bitwise_count(self.corners["hi"][q] ^ corners["hi"][i])
                keep = far <= RADIUS
                q, i = q[keep], i[keep]
                fresh = ~(self.parts[q, :k] == parts[i, :k]).any(axis=1)
                found.append((q[fresh], i[fresh]))
                at = end
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    def _places(self, q: np.ndarray) -> np.ndarray:
        return self.corners["x"][q] + 1j * self.corners["y"][q].astype(np.float64)

    def agreed(self, q: np.ndarray, image: np.ndarray, corners: np.ndarray) -> list[tuple[int, int, int]]:
        """(query, image, votes) for matches between query corners q and corners of images: those pairs of images of
        which MIN_VOTES or more query corners agree on one turn, scale and shift."""
        query = self.query[q]
        pair = query * (int(image.max(initial=0)) + 1) + image
        keep = np.bincount(pair)[pair] >= MIN_VOTES if len(pair) else np.zeros(0, bool)
        q, image, query, corners = q[keep], image[keep], query[keep], corners[keep]
        if not len(q):
            return []
        pair = np.unique(pair[keep], return_inverse=True)[1]
        own = self.corners[q]
        step = corners["level"] - own["level"]
        turn = np.mod(corners["angle"] - own["angle"], 2 * np.pi)
        # Coarse cells in two overlapping grids each way, first of scale and turn, then of the shift within those; by
        # its noise in turn and scale a match may be off by an eighth of the query's side.
        rows, groups = [], []
        for grid in range(4):
            level = np.floor_divide(step + grid % 2, 2)
            around = np.floor_divide(np.mod(turn + grid // 2 * np.pi / 8, 2 * np.pi), np.pi / 4).astype(np.int64)
            cell = (pair * 64 + np.clip(level + 32, 0, 63)) * 9 + around
            some = np.flatnonzero(np.bincount(cell)[cell] >= MIN_VOTES)
            z, to = self._places(q[some]), corners["x"][some] + 1j * corners["y"][some].astype(np.float64)
            shift = to - z * 2.0 ** (step[some] / 2) * np.exp(1j * turn[some])
            width = np.maximum(8.0, self.sides[query[some]] * 2.0 ** (level[some] - grid % 2 / 2) / 4)
            for fine in range(4):
                key = cell[some].astype(np.uint64)
                for part, half in ((shift.real, fine % 2), (shift.imag, fine // 2)):
                    key = mix(key * np.uint64(31) + np.floor(part / width + half / 2).astype(np.int64).view(np.uint64))
                group, counts = np.unique(key, return_inverse=True, return_counts=True)[1:]
                enough = counts[group] >= MIN_VOTES
                rows.append(some[enough])
                groups.append(group[enough] + (4 * grid + fine << 32))
        row, group = np.concatenate(rows), np.unique(np.concatenate(groups), return_inverse=True)[1]
        if not len(row):
            return []
        # One similarity transform a cell by least squares, three times, closing in on the matches that agree.
        z, to = self._places(q[row]), corners["x"][row] + 1j * corners["y"][row].astype(np.float64)
        step, turn = step[row], turn[row]
        slack = TOLERANCE * 2.0 ** (corners["level"][row] / 2)
        inside = np.ones(len(row), bool)
        total = lambda v: np.bincount(group, np.where(inside, v.real, 0)) + 1j * np.bincount(group, np.where(inside, v.imag, 0))
        for wide in (4, 2, 1):
            n = np.maximum(np.bincount(group, inside), 1)
            mean_z, mean_to = total(z + 0j) / n, total(to + 0j) / n
            dz, dto = z - mean_z[group], to - mean_to[group]
            power = np.maximum(total(np.abs(dz) ** 2 + 0j).real, 1e-9)
            factor = total(np.conj(dz) * dto) / power
            size = np.maximum(np.abs(factor), 1e-9)[group]
            off = np.abs(np.angle(np.exp(1j * turn) * np.conj(factor[group])))
            inside = (np.abs(dto - factor[group] * dz) <= wide * slack) & (off <= TURN_OFF) & (np.abs(step / 2 - np.log2(size)) <= SCALE_OFF)
        seen = np.unique((group * len(self.corners) + q[row])[inside]) // len(self.corners)
        votes = np.bincount(seen, minlength=group.max() + 1)
        of = np.zeros(group.max() + 1, np.int64)
        of[group] = row
        best: dict[tuple[int, int], int] = {}
        for g in np.flatnonzero(votes >= MIN_VOTES).tolist():
            key = (int(query[of[g]]), int(image[of[g]]))
            best[key] = max(best.get(key, 0), int(votes[g]))
        return [(*key, n) for key, n in best.items()]


FOUND_SCHEMA = "id long, digest binary, query_id long, votes long"


def _search(held):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for every image, and one for every query that an image with corners is a copy of, equal images of a
        slice once."""
        block = Block(held.value)
        for batch in _sliced(batches, max(PAIRS // max(len(block.ids), 1), 1)):
            ids, digests, corners = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist()
            first = {d: k for k, d in reversed(list(enumerate(digests))) if d is not None and corners[k]}
            rows = sorted(first.values())
            own = np.concatenate([np.zeros(0, CORNER), *(np.frombuffer(corners[k], CORNER) for k in rows)])
            image = np.repeat(np.array(rows, np.int64), [len(corners[k]) // CORNER.itemsize for k in rows])
            q, i = block.matches(own)
            found = block.agreed(q, image[i], own[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array([*ids, *[None] * len(found)], pa.int64()), pa.array([*digests, *(digests[k] for _, k, _ in found)], pa.binary()), pa.array([*[None] * len(ids), *(int(block.ids[x]) for x, _, _ in found)], pa.int64()), pa.array([*[None] * len(ids), *(n for _, _, n in found)], pa.int64())],
                names=["id", "digest", "query_id", "votes"],
            )

    return search


def find_copies(indexed: DataFrame, queries: DataFrame) -> DataFrame:
    """Which images of indexed hold the content of which queries; both are descriptors().

    Rows (query_id, picture_id, class_id, votes). Images with equal bytes are one class, named by its smallest id. For
    every image of indexed one row with its class and null query_id and votes; for every query and class that is a copy
    one row with the class's id as picture_id and the number of the query's corners that agree. A null image is a class
    of its own and matches nothing. Descriptors within RADIUS that share a table entry match; up to TABLES - 1
    differing bits they share one surely.
    """
    spark = indexed.sparkSession
    asked = written(queries.where("n > 0").select("id", "side", "n", "corners"), "query-descriptors")
    blocks = max(-(-int(asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // BLOCK), 1)
    if blocks > 1:
        indexed = written(indexed, "descriptors")
    found = None
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).select("id", "side", "corners").collect()
        held = spark.sparkContext.broadcast([(r["id"], r["side"], bytes(r["corners"])) for r in rows])
        part = written(indexed.mapInArrow(_search(held), FOUND_SCHEMA).where(F.lit(k == 0) | F.col("query_id").isNotNull()), "copies-found")
        found = part if found is None else found.union(part)
    images = found.where("query_id IS NULL").select("id", "digest")
    classes = images.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("class_id"))
    members = attach(images.where("digest IS NOT NULL"), "digest", classes).select("id", "class_id").union(images.where("digest IS NULL").select("id", "id"))
    copies = attach(found.where("query_id IS NOT NULL").groupBy("query_id", "digest").agg(F.max("votes").alias("votes")), "digest", classes)
    return members.select(F.lit(None).cast("long").alias("query_id"), F.col("id").alias("picture_id"), "class_id", F.lit(None).cast("long").alias("votes")).union(copies.select("query_id", F.col("class_id").alias("picture_id"), "class_id", "votes"))


# Pictures for the vectors of a table: blobs whose outlines follow a smooth field, a mixture weighted by the vector.
SIDE = 64
_known: dict[int, np.ndarray] = {}


def _fields(n: int) -> np.ndarray:
    if n not in _known:
        noise = np.random.Generator(np.random.PCG64(5)).normal(size=(n, SIDE, SIDE))
        smooth = _box(_box(noise, 1), 1)
        _known[n] = (smooth / smooth.std()).reshape(n, -1).astype(np.float32)
    return _known[n]


def picture(vectors: list[list[float] | None]) -> list[np.ndarray | None]:
    """A picture of every vector; null and empty ones have none."""
    out: list[np.ndarray | None] = [None] * len(vectors)
    by: dict[int, list[int]] = {}
    for k, v in enumerate(vectors):
        if v:
            by.setdefault(len(v), []).append(k)
    for n, rows in by.items():
        v = np.nan_to_num(np.array([[0.0 if x is None else x for x in vectors[k]] for k in rows], np.float32))
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        pixels = (128 + 90 * np.tanh(3 * (v @ _fields(n)))).astype(np.uint8).reshape(-1, SIDE, SIDE)
        for k, p in zip(rows, pixels, strict=True):
            out[k] = p
    return out


def edited(pixels: np.ndarray, seed: int) -> np.ndarray:
    """A copy edited in the way that seed picks: a darker crop; a crop turned by a quarter, with noise; a brighter
    crop at three quarters of the size; a crop turned by 15 to 40 degrees with less contrast."""
    rng = np.random.default_rng(seed)
    side, turn, zoom, gain, add = [(52, 0, 1, 0.8, 12), (52, np.pi / 2, 1, 1, 0), (42, 0, 4 / 3, 0.9, 20), (44, np.pi / 180 * rng.uniform(15, 40), 1, 0.85, 10)][int(rng.integers(4))]
    reach = side / 2 * zoom * (abs(np.cos(turn)) + abs(np.sin(turn)))
    free = np.maximum(np.array(pixels.shape) / 2 - reach, 0)
    cy, cx = np.array(pixels.shape) / 2 + rng.uniform(-1, 1, 2) * free
    at = (np.arange(side) + 0.5 - side / 2) * zoom
    y = np.clip(cy + at[:, None] * np.cos(turn) + at[None] * np.sin(turn) - 0.5, 0, pixels.shape[0] - 1.001)
    x = np.clip(cx - at[:, None] * np.sin(turn) + at[None] * np.cos(turn) - 0.5, 0, pixels.shape[1] - 1.001)
    y0, x0 = y.astype(np.int64), x.astype(np.int64)
    p, fy, fx = pixels.astype(np.float64), y - y0, x - x0
    mixed = (p[y0, x0] * (1 - fx) + p[y0, x0 + 1] * fx) * (1 - fy) + (p[y0 + 1, x0] * (1 - fx) + p[y0 + 1, x0 + 1] * fx) * fy
    return np.clip(mixed * gain + add + (rng.normal(0, 3, mixed.shape) if turn == np.pi / 2 else 0), 0, 255).astype(np.uint8)


def _render(edit: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, ROWS):
            ids = batch.column(0).to_pylist()
            images = [None if p is None else write_graymap(edited(p, i or 0) if edit else p) for i, p in zip(ids, picture(batch.column(1).to_pylist()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], names=["id", "image"])

    return run


def pictures(vectors: DataFrame, edit: bool = False) -> DataFrame:
    """(id, image) for vectors (vec_id, embedding): pictures, or edited copies of them."""
    return vectors.select(F.col("vec_id").cast("long").alias("id"), "embedding").mapInArrow(_render(edit), "id long, image binary")


def op9_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    indexed = descriptors(pictures(vectors))
    queries = descriptors(pictures(vectors.where("vec_id % 100 = 0"), edit=True))
    return find_copies(indexed, queries)
