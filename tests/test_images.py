import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from capturelake.functions import pixels as Px
from capturelake.operators import images as I
from capturelake.operators import kernels as K
from capturelake.operators import similarity as S
from capturelake.sources import readers


def png(rgb: np.ndarray) -> bytes:
    h, w = rgb.shape[:2]
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def scene(shift=0, size=(768, 1024)):
    a = np.full((*size, 3), 120, dtype=np.uint8)
    a[200:500, 220 + shift:620 + shift] = (200, 60, 40)
    a[::16] = 30
    a[:, ::24] = 220
    return a


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("batch")
    p = root / "p1"
    p.mkdir()
    (p / "good_1.png").write_bytes(png(scene()))
    (p / "dup_good_1.png").write_bytes(png(scene()))
    (p / "good_2.png").write_bytes(png(np.rot90(scene(24), 2).copy()))
    (p / "dark.png").write_bytes(png(np.full((768, 1024, 3), 12)))
    (p / "bright.png").write_bytes(png(np.full((768, 1024, 3), 245)))
    (p / "lowres.png").write_bytes(png(scene(0, (240, 320))[:240, :320]))
    (p / "broken.png").write_bytes(b"no image")
    return str(root)


def test_batch_validation(spark):
    rows = [("good_1.png", 1024, 768, 0.5, 0.5, 0b1111), ("dup_good_1.png", 1024, 768, 0.5, 0.5, 0b1110), ("good_2.png", 1024, 768, 0.5, 0.5, -1),
            ("dark.png", 1024, 768, 0.05, 0.5, 0), ("bright.png", 1024, 768, 0.97, 0.5, 1 << 40), ("lowres.png", 320, 240, 0.5, 0.5, 1 << 41)]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "project_id int, image_id long, name string, width int, height int, "
                               "brightness double, sharpness double, dhash long").withColumn("pixel_count", F.col("width") * F.col("height"))
    judged = I.quality_reasons(df, readers.IMAGE_SUFFIXES)
    good = judged.filter(F.col("status") != I.REJECTED)
    unique = S.dedupe_images(good, ["project_id"], [F.lower("name"), F.col("name")], "dhash", 2, 6)
    final = {r.name: r for r in S.apply_duplicates(unique).collect()}
    bad = {r.name: list(r.rejected_reasons) for r in judged.collect() if r.status == I.REJECTED}
    assert bad["dark.png"][0] == "underexposed" and bad["bright.png"][0] == "overexposed"
    assert "low_resolution" in bad["lowres.png"]
    # The copy that sorts first by name is the one that stays.
    assert list(final["good_1.png"].rejected_reasons) == ["duplicate_near"]
    assert sorted(n for n, r in final.items() if r.status != I.REJECTED) == ["dup_good_1.png", "good_2.png"]


def test_unreadable_file_stays_as_row(spark, folder):
    rows = {r.name: r for r in readers.read_decoded_images(spark, folder).select("name", "width", "reject_reason").collect()}
    assert rows["broken.png"].reject_reason == "unreadable_image" and rows["broken.png"].width is None
    assert rows["good_1.png"].width == 1024
    files = readers.read_images(spark, folder).select("name", "extension", "project_id").collect()
    assert len(files) == 7 and {f.project_id for f in files} == {"p1"} and {f.extension for f in files} == {".png"}


def test_array_and_numpy_metrics_agree(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.integers(0, 256, 64).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, px array<int>")
    px = F.col("px")
    native = df.withColumn("edges", Px.edge_map(px, 8, 8)).select(
        "i", Px.brightness(px), Px.contrast(px), Px.sharpness(F.col("edges")), Px.blur_score(Px.laplacian(px, 8, 8)),
        Px.difference_hash(px, 8, 8), Px.pooled_hash(px))
    numpy = K.metrics_from_sums(df.withColumn("sums", K.thumbnail_sums(px))).select(
        "i", "brightness", "contrast", "sharpness", "blur_score", "sums.dhash", "sums.phash")
    assert sorted(map(tuple, native.collect())) == sorted(map(tuple, numpy.collect()))


def test_coverage_of_tiny_batches(spark):
    df = spark.createDataFrame([(1, 1, "a.png", 5)], "project_id int, image_id int, name string, dhash long")
    r = I.coverage_summary(df).first()
    assert (r.unique_hash_ratio, r.median_nearest_hamming, r.neighbor_similarity_ratio, r.possible_low_coverage) == (1.0, 64, 0.0, False)
