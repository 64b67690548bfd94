"""Progressive streams with restart markers, written by a small encoder, against the same without."""

import numpy as np

from tallyspark.llm import jpeg, media

SIZES, RUNS = range(11), [r << 4 | s for r in range(16) for s in range(1, 9)] + [0x00, 0xF0]


def segment(marker, body):
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + bytes(body)


def packed(bits):
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def number(v):
    size = int(abs(v)).bit_length()
    return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""


def stream(parts, width, height, interval):
    """parts: {component: (blocks in scan order of the component, 64 coefficients)}, sampling 1 x 1, one interleaved scan of the DC
    coefficients and one of the others for each component.  Every code has its symbol's place in four, or nine, bits."""
    out = b"\xff\xd8" + segment(0xDB, [0, *[1] * 64])
    out += segment(0xC2, [8, *height.to_bytes(2, "big"), *width.to_bytes(2, "big"), len(parts), *(x for c in parts for x in (c, 0x11, 0))])
    out += segment(0xC4, [0x00, 0, 0, 0, len(SIZES), *[0] * 12, *SIZES]) + segment(0xC4, [0x10, *[0] * 8, len(RUNS), *[0] * 7, *RUNS])
    if interval:
        out += segment(0xDD, interval.to_bytes(2, "big"))

    def scan(head, units):
        step = interval or len(units)
        made = [packed("".join(b for f in units[i : i + step] for b in f(i))) for i in range(0, len(units), step)]
        body = b"".join((bytes([0xFF, 0xD0 + (k - 1) % 8]) if k else b"") + m for k, m in enumerate(made))
        return segment(0xDA, head) + body

    blocks = len(next(iter(parts.values())))

    def dc(i):
        def unit(start):
            for coef in parts.values():
                size, bits = number(int(coef[i, 0] - (coef[i - 1, 0] if i > start else 0)))
                yield format(size, "04b") + bits

        return unit

    def ac(coef):
        def unit(_):
            run = 0
            for v in coef[1:]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    yield format(RUNS.index(0xF0), "09b")
                    run -= 16
                size, bits = number(int(v))
                yield format(RUNS.index(run << 4 | size), "09b") + bits
                run = 0
            if run:
                yield format(RUNS.index(0), "09b")

        return unit

    out += scan([len(parts), *(x for c in parts for x in (c, 0x00)), 0, 0, 0], [dc(i) for i in range(blocks)])
    for c, coef in parts.items():
        out += scan([1, c, 0x00, 1, 63, 0], [ac(b) for b in coef])
    return out + b"\xff\xd9"


def test_restart_markers(spark):
    rng = np.random.default_rng(6)
    for colours in (1, 3):
        parts = {c + 1: np.where(rng.random((20, 64)) < 0.2, rng.integers(-120, 121, (20, 64)), 0) for c in range(colours)}
        whole = jpeg.Image(stream(parts, 40, 32, 0))
        for c, coef in parts.items():
            assert np.array_equal(whole.coef[c], coef)
        streams = {n: stream(parts, 40, 32, n) for n in (1, 2, 7, 19, 20, 100)}
        for data in streams.values():
            got = jpeg.Image(data)
            assert all(np.array_equal(got.coef[c], coef) for c, coef in parts.items()) and np.array_equal(got.rgb(), whole.rgb())
        rows = [(0, stream(parts, 40, 32, 0)), *streams.items(), (-1, streams[7].replace(b"\xff\xd1", b"", 1))]
        got = {r["doc_id"]: r for r in media.tensors(spark.createDataFrame([(i, bytearray(x)) for i, x in rows], "doc_id long, media binary")).collect()}
        assert len({bytes(got[n]["rgb"]) for n in (0, *streams)}) == 1 and "restart" in got[-1]["error"]
