import struct

import numpy as np
import pytest

from tracewright.sources import mdf, recordings


def test_round_trip(spark, samples, tmp_path):
    path = str(tmp_path / "a.mf4")
    w = mdf.Writer()
    w.group("Engine", np.array([0.0, 0.5, 1.0]), [("Speed", "rpm", np.array([1.0, 2.5, np.nan]), {}), ("Gear", "", np.array([1.0, 4.0, 9.0]), {1.0: "Park", 4.0: "Drive"})])
    w.group("Plain", np.array([2.0]), [("X", "", np.array([7.0]), {})], packed=False)
    w.save(path)
    got = {(r["message"], r["signal"], r["t_s"]): (r["value"], r["label"], r["unit"]) for r in recordings.read_recording(spark, path).samples.collect()}
    assert got[("Engine", "Gear", 0.5)] == (4.0, "Drive", "") and got[("Engine", "Gear", 1.0)] == (9.0, None, "") and got[("Engine", "Speed", 0.5)] == (2.5, None, "rpm") and got[("Plain", "X", 2.0)][0] == 7.0
    assert len(got) == 7
    out = str(tmp_path / "b.mf4")
    mdf.write_samples(recordings.read_recording(spark, path).samples, out)
    again = {(r["message"], r["signal"], r["t_s"]): (r["value"], r["label"]) for r in mdf.read_samples(spark, out).collect() if r["signal"] != "Speed"}
    assert again == {k: v[:2] for k, v in got.items() if k[1] != "Speed"}


def frames_file(path):
    """A raw bus group: a bit-packed record of ID, IDE, channel, direction, length and bytes."""
    w = mdf.Writer()
    records = b"".join(struct.pack("<dIBB8s", t, ident | (ide << 31), ch | (way << 4), n, data) for t, ident, ide, ch, way, n, data in (
        (1.0, 0x100, 0, 1, 0, 8, b"\x60\x09\x64\0\0\0\0\0"), (1.5, 0x18FF50E5, 1, 2, 1, 2, b"\x01\x02\0\0\0\0\0\0"),
    ))
    layout = [("CAN_DataFrame.ID", 0, 8, 0, 29), ("CAN_DataFrame.IDE", 0, 11, 7, 1), ("CAN_DataFrame.BusChannel", 0, 12, 0, 4), ("CAN_DataFrame.Dir", 0, 12, 4, 1), ("CAN_DataFrame.DataLength", 0, 13, 0, 8), ("CAN_DataFrame.DataBytes", 10, 14, 0, 64)]
    nxt = 0
    for name, kind, byte, bit, bits in reversed(layout):
        nxt = w._put(b"CN", (nxt, 0, w._text(name), 0, 0, 0, 0, 0), struct.pack("<BBBBIIIIBBH", 0, 0, kind, bit, byte, bits, 0, 0, 0, 0, 0) + bytes(48))
    top = w._put(b"CN", (0, nxt, w._text("CAN_DataFrame"), 0, 0, 0, 0, 0), struct.pack("<BBBBIIIIBBH", 0, 0, 10, 0, 8, 112, 0, 0, 0, 0, 0) + bytes(48))
    time = w._put(b"CN", (top, 0, w._text("t"), 0, 0, 0, 0, 0), struct.pack("<BBBBIIIIBBH", 2, 1, 4, 0, 0, 64, 0, 0, 0, 0, 0) + bytes(48))
    cg = w._put(b"CG", (0, time, 0, 0, 0, 0), struct.pack("<QQHHIII", 0, 2, 6, 0, 0, 22, 0))
    half = w._put(b"DT", (), records[:22]), w._put(b"DT", (), records[22:])
    dl = w._put(b"DL", (0, *half), struct.pack("<BBHIQQ", 0, 0, 0, 2, 0, 22))
    dg = w._put(b"DG", (0, cg, dl, 0), bytes(8))
    struct.pack_into("<q", w.body, 88, dg)
    w.save(path)


def test_raw_frames(spark, tmp_path):
    path = str(tmp_path / "raw.mf4")
    frames_file(path)
    with open(path, "rb") as f:
        assert mdf.content(f.read()) == {"raw_can": True, "raw_lin": False, "decoded": False}
    rec = recordings.read_recording(spark, path)
    assert rec.kind == "frames"
    got = [(r["t_s"], r["channel"], r["arb_id"], r["is_extended"], r["direction"], bytes(r["payload"])) for r in rec.frames.orderBy("frame_idx").collect()]
    assert got == [(0.0, 1, 0x100, False, "Rx", b"\x60\x09\x64\0\0\0\0\0"), (0.5, 2, 0x18FF50E5, True, "Tx", b"\x01\x02")]


def test_conversions_and_damage(tmp_path):
    c = mdf.Channel("x", "", 0, 2, 0, 0, 8, {"kind": 1, "values": (10.0, 0.5), "texts": []})
    raw = mdf.raw_values(c, np.array([[254], [2]], np.uint8))
    assert raw.tolist() == [-2, 2] and mdf.physical(c, raw)[0].tolist() == [9, 11]
    c.conversion = {"kind": 8, "values": (0.0, 5.0, 6.0, 9.0), "texts": ["low", "high"]}
    assert mdf.physical(c, np.array([3, 7, 99]))[1] == ["low", "high", None]
    big = mdf.Channel("y", "", 0, 1, 4, 0, 12, None)
    assert mdf.raw_values(big, np.array([[0xAB, 0xCD]], np.uint8)).tolist() == [0xABC]
    path = str(tmp_path / "d.mf4")
    frames_file(path)
    with open(path, "rb") as f:
        data = f.read()
    broken = mdf.Reader(data[: len(data) - 60])
    assert list(broken.groups()) == [] and broken.warnings
    with pytest.raises(mdf.MdfError):
        mdf.Reader(b"MDF     3.30")
