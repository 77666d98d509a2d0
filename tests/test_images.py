from __future__ import annotations

import time

import numpy as np
import pytest

from quire.operators import imageparts, images


def flooded(mask: np.ndarray, corners: bool) -> list[set]:
    """Areas by walking from pixel to pixel."""
    left, out = set(zip(*np.nonzero(mask), strict=True)), []
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not (a and b))]
    while left:
        start = min(left)
        left.discard(start)
        area, todo = {start}, [start]
        while todo:
            y, x = todo.pop()
            for a, b in near:
                if (y + a, x + b) in left:
                    left.discard((y + a, x + b))
                    area.add((y + a, x + b))
                    todo.append((y + a, x + b))
        out.append(area)
    return out


@pytest.mark.parametrize("corners", [False, True])
def test_areas_against_a_walk(corners):
    r = np.random.default_rng(2)
    for share in (0.0, 0.2, 0.45, 0.6, 0.9, 1.0):
        for shape in ((1, 1), (1, 40), (40, 1), (37, 53)):
            mask = r.random(shape) < share
            label, want = images.components(mask, corners), flooded(mask, corners)
            assert label.shape == shape and label.max(initial=0) == len(want)
            for area in want:
                assert len({label[p] for p in area}) == 1 and (label == label[min(area)]).sum() == len(area)
            binary = np.where(mask, 0, 255).astype(np.uint8)
            boxes = sorted(((min(x for _, x in a), min(y for y, _ in a), max(x for _, x in a) - min(x for _, x in a) + 1, max(y for y, _ in a) - min(y for y, _ in a) + 1) for a in want if len(a) >= 3), key=lambda b: (b[1], b[0]))
            assert sorted(images.zones(binary, 3, corners)) == sorted(map(tuple, np.array(boxes, int).reshape(-1, 4).tolist()))
            left = {p for a in flooded(mask, False) if len(a) >= 6 for p in a}
            assert set(zip(*np.nonzero(images.denoise(binary) == 0), strict=True)) == left
            assert (images.denoise(255 - binary, white_text=True) == 255 - images.denoise(binary)).all()


def test_a_serpentine_of_a_whole_page():
    mask = np.zeros((3000, 5000), bool)
    mask[::2] = True
    mask[1::4, -1] = mask[3::4, 0] = True
    start = time.time()
    label = images.components(mask)
    assert time.time() - start < 20
    assert label.max() == 1 and (label[mask] == 1).all()


def test_many_specks():
    binary = np.where(np.random.default_rng(3).random((2000, 3000)) < 0.3, 0, 255).astype(np.uint8)
    start = time.time()
    out = images.denoise(binary)
    assert time.time() - start < 20
    assert (images.denoise(out) == out).all()


def test_median():
    binary = np.where(np.random.default_rng(4).random((20, 30)) < 0.5, 0, 255).astype(np.uint8)
    for size in (3, 5):
        around = np.lib.stride_tricks.sliding_window_view(np.pad(binary, size // 2, mode="edge"), (size, size))
        assert (images.median(binary, size) == np.median(around, axis=(2, 3))).all()


def test_otsu():
    r = np.random.default_rng(5)
    gray = np.concatenate([r.normal(60, 10, 3000), r.normal(190, 20, 7000)]).clip(0, 255).astype(np.uint8).reshape(100, 100)
    values = gray.ravel().astype(float)
    between = [0 if not ((values <= t).any() and (values > t).any()) else (values <= t).mean() * (values > t).mean() * (values[values <= t].mean() - values[values > t].mean()) ** 2 for t in range(256)]
    assert images.otsu(gray) == int(np.argmax(between))


def test_resample_is_the_mean_of_what_a_pixel_covers():
    image = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert (images.resample(image, 3, 4) == np.rint(image.reshape(3, 2, 4, 2).mean(axis=(1, 3)))).all()
    assert (images.resample(image, 6, 8) == image).all()
    assert (images.resample(np.full((7, 5, 3), 9, np.uint8), 4, 11) == 9).all()
    assert abs(images.resample(image, 5, 3).mean() - image.mean()) < 1


def lines(height=600, width=800) -> np.ndarray:
    page = np.full((height, width), 255, np.uint8)
    r = np.random.default_rng(6)
    for y in range(60, height - 60, 24):
        at = 80
        while at < width - 120:
            n = int(r.integers(10, 60))
            page[y : y + 10, at : at + n] = 0
            at += n + 12
    return page


@pytest.mark.parametrize("angle", [2.0, -2.0, 0.7, -3.4, 0.0])
def test_a_turned_page_comes_back(angle):
    turned = images.turned(lines(), angle)
    assert abs(images.skew(images.threshold(turned)) - angle) < 0.1
    back = images.deskew(turned)
    assert abs(images.skew(images.threshold(back))) < 0.1
    assert back.shape == turned.shape


def test_empty_pages_stay():
    white = np.full((50, 40), 255, np.uint8)
    assert images.skew(white) == 0 and (images.deskew(white) == white).all()
    assert (images.turned(lines(), 0.0) == lines()).all()


def test_canvas():
    out = images.on_canvas(np.zeros((10, 20, 3), np.uint8), 40, 40)
    black = np.nonzero((out == 0).all(axis=2))
    assert out.shape == (40, 40, 3) and (black[0].min(), black[0].max(), black[1].min(), black[1].max()) == (6, 25, 0, 39)
    assert (images.on_canvas(np.zeros((10, 20), np.uint8), 40, 40, "top")[:20] == 0).all()
    assert (images.on_canvas(np.zeros((10, 20), np.uint8), 40, 40, "bottom")[20:] == 0).all()


PAGES = "k int, height int, width int, channels int, data binary"


def test_too_many_pixels_are_an_error(spark, monkeypatch):
    with pytest.raises(ValueError, match="too large"):
        images.array(20_000, 20_000, 1, b"")
    rows = spark.createDataFrame([(1, 100_000, 100_000, 1, b"x")], PAGES)
    assert "too large" in images.measure(rows, "k").first().error


SPLITS = ", insets struct<top:int,bottom:int,left:int,right:int>, splits array<struct<suffix:string,reading_order:int,L:int,R:int,T:int,B:int>>"


def test_ocr_crops(spark):
    page = np.arange(600, dtype=np.uint16).astype(np.uint8).reshape(20, 30)
    data = (20, 30, 1, page.tobytes())
    split = [("b", 1, 10, None, None, None), ("a", 0, None, 10, -5, 99), ("empty", 2, 5, 5, None, None), ("beyond", 3, 40, 50, None, None)]
    rows = [(1, *data, (1, 2, 3, 4), None), (2, *data, (1, 2, 3, 4), split), (3, *data, None, []), (4, *data, (15, 15, 0, 0), None), (5, None, None, None, None, None, None), (6, 20, 30, 1, b"short", None, None)]
    found = {(r.k, r.suffix): r for r in imageparts.ocr_crops(spark.createDataFrame(rows, PAGES + SPLITS), "k").collect()}
    inner = page[1:18, 3:26]
    for key, want in (((1, ""), inner), ((2, "a"), inner[:, :10]), ((2, "b"), inner[:, 10:]), ((3, ""), page)):
        r = found.pop(key)
        assert (images.array(r.height, r.width, r.channels, r.data) == want).all() and r.error is None
    assert {k: bool(r.error) for k, r in found.items()} == {(4, ""): True, (5, ""): True, (6, ""): True}


REGIONS = ", page_type string, regions array<struct<index:int,L:int,T:int,R:int,B:int,gray:boolean,output_format:string>>"


def test_regions(spark):
    page = np.random.default_rng(7).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    data = (20, 30, 3, page.tobytes())
    own = [(1, 2, 3, 12, 9, False, "png"), (2, -4, -4, 99, 99, True, "jpg"), (3, 9, 0, 9, 0, False, "png"), (4, 5, None, 0, None, None, "jpg")]
    rows = [(1, *data, "normal", own), (2, *data, "plate_p", []), (3, *data, "plate_p", own[:1]), (4, *data, "normal", None)]
    found = {(r["k"], r["index"]): r for r in imageparts.region_crops(spark.createDataFrame(rows, PAGES + REGIONS), "k").collect()}
    for key, want in (((1, 1), page[3:9, 2:12]), ((1, 2), np.rint(images.luma(page)).astype(np.uint8)), ((1, 4), page[:, 5:]), ((2, 1), page), ((3, 1), page[3:9, 2:12])):
        r = found.pop(key)
        assert (images.array(r.height, r.width, r.channels, r.data) == want).all(), key
    assert set(found) == {(1, 3)} and found[1, 3].error == "empty region after clamping: L=9 R=9 T=0 B=20"
