"""Baseline frames against the Java runtime's own decoder."""

import struct

import numpy as np
import pytest

from gridjobs.llm import avi, jpeg


def java_frame(spark, rgb, gray=False, quality=0.75):
    """A frame that Java's writer makes: 4:2:0, the standard's Huffman tables, quantisation by quality."""
    jvm = spark._jvm
    h, w = rgb.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, 10 if gray else 1)
    for y in range(h):
        for x in range(w):
            r, g, b = (int(v) for v in rgb[y, x])
            value = (0xFF << 24 | r << 16 | g << 8 | b)
            image.setRGB(x, y, value - (1 << 32))
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionQuality(quality)
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.close()
    return bytes(out.toByteArray())


def java_luma(spark, frame, w, h):
    jvm = spark._jvm
    reader = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("jpeg").next()
    reader.setInput(jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.ByteArrayInputStream(frame)))
    raster = reader.readRaster(0, None)
    into = spark.sparkContext._gateway.new_array(jvm.int, w * h)
    raster.getSamples(0, 0, w, h, 0, into)
    return np.array(list(into)).reshape(h, w)


def picture(seed, w=45, h=37):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    base = np.stack([x * 5, y * 6, 255 - x * 3 - y], 2) + rng.normal(scale=25, size=(h, w, 3))
    return np.clip(base, 0, 255).astype(np.uint8)


@pytest.mark.parametrize(("gray", "quality"), [(False, 0.3), (False, 0.75), (False, 1.0), (True, 0.5)])
def test_samples_equal_javas(spark, gray, quality):
    rgb = picture(int(quality * 10))
    frame = java_frame(spark, rgb, gray, quality)
    planes = jpeg.decode(frame)
    assert planes[0].shape == (37, 45) and [p.shape for p in planes[1:]] == ([] if gray else [(19, 23)] * 2)
    far = np.abs(planes[0].astype(int) - java_luma(spark, frame, 45, 37))
    assert far.max() <= 1 and (far == 0).mean() > 0.9


def without(frame, code):
    """The frame without its markers of one code."""
    out, at = [frame[:2]], 2
    while frame[at + 1] != 0xDA:
        n = struct.unpack_from(">H", frame, at + 2)[0]
        if frame[at + 1] != code:
            out.append(frame[at : at + 2 + n])
        at += 2 + n
    return b"".join(out) + frame[at:]


def test_frames_without_tables_mean_the_standards(spark):
    frame = java_frame(spark, picture(3))
    bare = without(frame, 0xC4)
    assert len(bare) < len(frame) - 300
    assert all(np.array_equal(a, b) for a, b in zip(jpeg.decode(frame), jpeg.decode(bare)))


def test_own_frames_decode_alike():
    payload = bytes(np.random.default_rng(1).integers(0, 256, 64 * 21, dtype=np.uint8))
    frames = avi.encode_frames(payload)
    _, samples = avi.decode_frames(frames)
    for frame, fast in zip(frames, samples):
        plane = jpeg.decode(frame)[0].astype(int)
        blocks = plane.reshape(4, 8, 4, 8).transpose(0, 2, 1, 3).reshape(16, 64)
        assert np.abs(blocks - fast).max() <= 1


def test_bad_frames_are_errors(spark):
    frame = java_frame(spark, picture(4))
    at = frame.index(b"\xff\xc0")
    with pytest.raises(ValueError, match="FFC2"):
        jpeg.decode(frame[:at] + b"\xff\xc2" + frame[at + 2 :])
    with pytest.raises(ValueError, match="ends before|no Huffman code"):
        jpeg.decode(frame[: len(frame) // 2])
    with pytest.raises(ValueError, match="not a JPEG"):
        jpeg.decode(b"")
    with pytest.raises(ValueError, match="no frame header"):
        jpeg.decode(b"\xff\xd8\xff\xd9")


def test_clips_of_foreign_files(spark):
    dark, light = (np.full((24, 24, 3), v, np.uint8) for v in (20, 220))
    made = [java_frame(spark, x) for x in (dark, light)]
    movie = avi.write_avi([made[0]] * 5 + [made[1]] * 3 + [made[0]] * 4)
    files = spark.createDataFrame([("a", bytearray(movie)), ("b", None), ("c", bytearray(avi.write_avi([made[1]])))], "path string, content binary")
    got = sorted(tuple(r) for r in avi.file_clips(files).collect())
    assert [(i, k, a, b) for i, k, a, b, _ in got] == [("a", 0, 0.0, 200.0), ("a", 1, 200.0, 320.0), ("a", 2, 320.0, 480.0), ("c", 0, 0.0, 40.0)]
    assert [round(m, -1) for *_, m in got] == [20, 220, 20, 220]
    assert avi.file_clips(files.limit(0)).collect() == []
