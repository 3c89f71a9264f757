import numpy as np
import pytest

from helmwatch.llm import media


def rows_of(frame):
    return [(r["id"], r["side"], bytes(r["corners"])) for r in frame.collect()]


def brute(indexed, queries):
    """All pairs of descriptors, tested one by one, and the same consensus."""
    block = media.Block(rows_of(queries))
    rows = rows_of(indexed)
    own = np.concatenate([np.frombuffer(c, media.CORNER) for _, _, c in rows])
    image = np.repeat(np.arange(len(rows)), [len(c) // media.CORNER.itemsize for _, _, c in rows])
    q, i = [], []
    for k, corner in enumerate(block.corners):
        far = np.bitwise_count(own["lo"] ^ corner["lo"]) + np.bitwise_count(own["hi"] ^ corner["hi"])
        near = np.flatnonzero(far <= media.RADIUS)
        q.append(np.full(len(near), k))
        i.append(near)
    q, i = np.concatenate(q), np.concatenate(i)
    return {(int(block.ids[a]), rows[b][0]): n for a, b, n in block.agreed(q, image[i], own[i])}


def copies(found):
    return {(r["query_id"], r["picture_id"]): r["votes"] for r in found.collect() if r["query_id"] is not None}


def test_edited_copies_are_found_and_recall_holds(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    indexed = media.descriptors(media.pictures(vectors)).cache()
    queries = media.descriptors(media.pictures(vectors.where("vec_id % 20 = 0"), edit=True)).cache()
    got, want = copies(media.find_copies(indexed, queries)), brute(indexed, queries)
    assert len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert sum((i, i) in got for i in range(0, 500, 20)) >= 0.88 * 25
    assert sum(q != i for q, i in got) <= 1


def test_several_blocks_find_the_same(spark, monkeypatch):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id < 60")
    indexed = media.descriptors(media.pictures(vectors))
    queries = media.descriptors(media.pictures(vectors.where("vec_id % 10 = 0"), edit=True))
    whole = sorted(map(str, media.find_copies(indexed, queries).collect()))
    monkeypatch.setattr(media, "BLOCK", 100)
    assert sorted(map(str, media.find_copies(indexed, queries).collect())) == whole


@pytest.mark.parametrize("size", [200, 320])
def test_small_crops_of_larger_pictures(size):
    """A turned crop of a tenth of the area."""
    rng = np.random.default_rng(size)
    big = np.clip(128 + 60 * media._box(media._box(rng.normal(size=(5, size, size)), 1), 1) / 9, 0, 255).astype(np.uint8)
    part = int(size / 10**0.5)
    crops = [np.rot90(big[0][20 : 20 + part, 30 : 30 + part]), big[1][-part - 9 : -9, 5 : 5 + part]]
    rows = [(k, d[1], d[2]) for k, d in enumerate(media._described([media.write_graymap(c) for c in crops]))]
    block, whole = media.Block(rows), media._described([media.write_graymap(b) for b in big])
    own = np.concatenate([np.frombuffer(d[2], media.CORNER) for d in whole])
    image = np.repeat(np.arange(5), [len(d[2]) // media.CORNER.itemsize for d in whole])
    q, i = block.matches(own)
    assert {(a, b) for a, b, _ in block.agreed(q, image[i], own[i])} == {(0, 0), (1, 1)}


def test_equal_pictures_are_one_class(spark):
    """A third of the rows show one picture: queries meet it once, every row names its class."""
    vectors = [(i, [float(x) for x in np.random.default_rng(i % 3 and i).normal(size=64)]) for i in range(30)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    indexed = media.descriptors(media.pictures(table))
    found = media.find_copies(indexed, media.descriptors(media.pictures(table.where("vec_id in (0, 1, 3)")))).collect()
    assert {(r["query_id"], r["picture_id"]) for r in found if r["query_id"] is not None} == {(0, 0), (1, 1), (3, 0)}
    assert {r["picture_id"]: r["class_id"] for r in found if r["query_id"] is None} == {i: i if i % 3 else 0 for i in range(30)}


def test_rotation_by_a_quarter_keeps_descriptors():
    rng = np.random.default_rng(1)
    image = np.kron(rng.integers(0, 255, (16, 16)), np.ones((5, 5))).astype(np.uint8)
    a, b = (media.describe(p[None])[1] for p in (image, np.rot90(image)))
    a, b = a[a["level"] == 0], b[b["level"] == 0]
    far = np.bitwise_count(a["lo"][:, None] ^ b["lo"]) + np.bitwise_count(a["hi"][:, None] ^ b["hi"])
    assert (far.min(axis=1) <= media.RADIUS).sum() >= len(a) // 2


def test_awkward_images(spark):
    rows = [(1, None), (2, b""), (3, b"P6 1 1 255 x"), (4, b"P5 900 900 255 short"), (5, media.write_graymap(np.full((64, 64), 9))), (6, b"P5\n# note\n2 2\n255\nabcd"), (6, None)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "id long, image binary, digest int, class_id int")
    found = media.descriptors(table)
    assert [r["n"] for r in found.collect()] == [0] * 7
    members = media.find_copies(found, found).collect()
    assert sorted(r["picture_id"] for r in members) == [1, 2, 3, 4, 5, 6, 6] and all(r["query_id"] is None and r["class_id"] == r["picture_id"] for r in members)
    assert media.find_copies(media.descriptors(table.where("id > 9")), found).count() == 0
    assert media.picture([None, [], [float("nan"), None]])[2].shape == (64, 64)
