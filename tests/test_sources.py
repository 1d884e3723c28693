import datetime
import struct
import zlib

import pytest

from tracewright.sources import asc, blf, csv_files, recordings, text, trc
from tracewright.sources.databases import DatabaseError

ASC = """date Mon Jan 1 10:00:00 2024
base hex  timestamps absolute
   0.001000 1  100             Rx   d 8 60 09 64 00 00 00 00 00
   0.002000 2  18FF50E5x       Tx   d 4 04 00 00 00
   0.002500 1  200             Rx   r 4
   0.003000 CANFD   1 Rx        1FF                                   1 0 9 12 01 02 03 04 05 06 07 08 09 0A 0B 0C
   0.003100 CANFD   1 Rx        1FF  SomeName                           0 0 8 8 01 02 03 04 05 06 07 08
   0.003200 1  101             Rx   d 8 60 09
   0.004000 1  ErrorFrame
   0.005000 Li 60 Rx 2 0A 03 checksum = 11
   0.006000 1  Statistic: D 5 R 1 XD 0 XR 0 E 0 O 0 B 1.50%
   0.007000 CAN 1 Status:chip status error passive - TxErr: 130 RxErr: 3
// a comment
"""
TRC1 = """;$FILEVERSION=1.1
;$STARTTIME=45000.5
     1)         1.0  Rx         0100  8  60 09 64 00 00 00 00 00
     2)         2.0  Tx     18FF50E5  4  04 00 00 00
     3)         2.5  Rx         0200  4  RTR
     4)         3.5  Warng  FFFFFFFF  4  00 00 00 08  BUSHEAVY
     5)         4.5  Error      0001  4  00 01 02 03
"""
TRC2 = """;$FILEVERSION=2.1
;$COLUMNS=N,O,T,B,I,d,R,L,D
      1         1.000 DT 1      0100 Rx -  8    60 09 64 00 00 00 00 00
      2         2.000 FB 2  18FF50E5 Tx -  9    01 02 03 04 05 06 07 08 09 0A 0B 0C
      3         3.000 RR 1      0200 Rx -  4
      4         3.200 ST 1         - -  -  4    00 00 00 10
      5         3.300 EC 1         - -  -  2    05 80
      6         3.500 EV 1 User text here
      7         3.600 XL 1 foo
"""


def write(tmp_path, name, body):
    path = tmp_path / name
    path.write_bytes(body.encode() if isinstance(body, str) else body)
    return str(path)


def rows(frame):
    return [(r["t_s"], r["bus"], r["channel"], r["arb_id"], r["is_extended"], r["is_fd"], r["is_error"], r["is_remote"], r["is_brs"], r["dlc"], r["direction"], bytes(r["payload"])) for r in frame.orderBy("frame_idx").collect()]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    path = write(tmp_path, "many.txt", "".join(f"line {k}\r\n" for k in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        got = text.read_lines(spark, path).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["line_no"], r["value"]) for r in got] == [(k, f"line {k}") for k in range(5000)]


def test_asc(spark, tmp_path):
    path = write(tmp_path, "a.asc", ASC)
    got = rows(asc.read_frames(spark, path))
    assert got == [
        (0.001, "CAN", 1, 0x100, False, False, False, False, False, 8, "Rx", b"\x60\x09\x64\0\0\0\0\0"), (0.002, "CAN", 2, 0x18FF50E5, True, False, False, False, False, 4, "Tx", b"\x04\0\0\0"),
        (0.0025, "CAN", 1, 0x200, False, False, False, True, False, 4, "Rx", b""), (0.003, "CAN", 1, 0x1FF, False, True, False, False, True, 12, "Rx", bytes(range(1, 13))),
        (0.0031, "CAN", 1, 0x1FF, False, True, False, False, False, 8, "Rx", bytes(range(1, 9))), (0.004, "CAN", 1, 0, False, False, True, False, False, 0, "Unknown", b""),
        (0.005, "LIN", 1, 0x20, False, False, False, False, False, 2, "Rx", b"\x0a\x03"),
    ]
    status = {r["kind"]: r["values"] for r in asc.read_status(spark, path).collect()}
    assert status["statistics"]["D"] == "5" and status["controller"] == {"state": "error passive", "tec": "130", "rec": "3"}


def test_asc_decimal(spark, tmp_path):
    path = write(tmp_path, "d.asc", "base dec timestamps absolute\n 1.0 1  256 Rx d 1 0A\n")
    assert rows(asc.read_frames(spark, path))[0][3] == 256


def test_trc(spark, tmp_path):
    one, two = write(tmp_path, "b.trc", TRC1), write(tmp_path, "c.trc", TRC2)
    assert trc.header(spark, one)["start"] == datetime.datetime(2023, 3, 15, 12)
    assert [(r[3], r[6], r[7], r[9], r[10]) for r in rows(trc.read_frames(spark, one))] == [(0x100, False, False, 8, "Rx"), (0x18FF50E5, False, False, 4, "Tx"), (0x200, False, True, 4, "Rx"), (0, True, False, 0, "Tx")]
    assert trc.read_status(spark, one).first()["values"] == {"state": "warning"}
    got = rows(trc.read_frames(spark, two))
    assert [(r[2], r[3], r[5], r[8], r[9]) for r in got] == [(1, 0x100, False, False, 8), (2, 0x18FF50E5, True, True, 12), (1, 0x200, False, False, 4)]
    assert got[1][0] == pytest.approx(0.001)
    assert [r["values"] for r in trc.read_status(spark, two).orderBy("t_s").collect()] == [{"state": "bus off"}, {"tec": "128", "rec": "5", "state": "error passive"}]
    assert [(r["channel"], r["text"]) for r in trc.read_events(spark, two).collect()] == [(1, "User text here")]
    assert {r["reason"]: r["n"] for r in trc.skipped(spark, two).collect()} == {"CAN XL frames": 1}
    with pytest.raises(trc.TrcError, match="version"):
        trc.header(spark, write(tmp_path, "v.trc", ";$FILEVERSION=9.9\n"))
    with pytest.raises(trc.TrcError, match="trace line"):
        trc.header(spark, write(tmp_path, "w.trc", "@ TEXT @\nhello\n"))


def test_blf(spark, tmp_path):
    path = str(tmp_path / "d.blf")
    blf.write_simple(path, [(0.5, 1, 0x100, b"LOBJabcd"), (0.75, 2, 0x18FF50E5, b"\x01\x02"), (1.0, 1, 0x101, b"")])
    assert [(r[0], r[2], r[3], r[4], r[11]) for r in rows(blf.read_frames(spark, path))] == [(0, 1, 0x100, False, b"LOBJabcd"), (0.25, 2, 0x18FF50E5, True, b"\x01\x02"), (0.5, 1, 0x101, False, b"")]


def test_blf_objects_and_damage():
    def obj(kind, body, t):
        return struct.pack("<4sHHII", b"LOBJ", 32, 1, 32 + len(body), kind) + struct.pack("<IHHQ", 2, 0, 0, t) + body + b"\0" * ((32 + len(body)) % 4)

    fd = struct.pack("<HBBIIBBBB4x", 1, 1, 9, 0x123, 0, 0, 3, 12, 0) + bytes(range(12)) + bytes(52)
    lin = bytearray(124)
    struct.pack_into("<H", lin, 12, 2)
    lin[37], lin[38], lin[112], lin[113], lin[122] = 0x21, 2, 7, 8, 1
    fd64 = bytearray(40)
    fd64[0], fd64[1], fd64[2], fd64[34] = 1, 9, 12, 0
    struct.pack_into("<I", fd64, 4, 0x80000777)
    struct.pack_into("<I", fd64, 12, 0x3000)
    stream = obj(100, fd, 10**9) + obj(57, bytes(lin), 2 * 10**9) + obj(101, bytes(fd64) + bytes(range(12)), 3 * 10**9) + obj(73, struct.pack("<H8xBxxxxxI", 1, 0, 0) + bytes(12), 4 * 10**9) + obj(65, b"skip", 5 * 10**9)
    packed = zlib.compress(stream)
    body = struct.pack("<4sHHII", b"LOBJ", 16, 1, 32 + len(packed), 10) + struct.pack("<H6xI4x", 2, len(stream)) + packed
    data = struct.pack("<4sI", b"LOGG", 144).ljust(144, b"\0") + body + b"\0" * (len(body) % 4)
    c, warnings = blf.parse(data)
    assert not warnings and c["t_s"].tolist() == [1, 2, 3, 4] and c["bus"].tolist() == ["CAN", "LIN", "CAN", "CAN"]
    assert c["arb_id"].tolist() == [0x123, 0x21, 0x777, 0] and c["is_fd"].tolist() == [True, False, True, False] and c["is_brs"].tolist() == [True, False, True, False] and c["is_error"].tolist() == [False, False, False, True]
    assert c["payload"].to_pylist() == [bytes(range(12)), b"\x07\x08", bytes(range(12)), b""] and c["direction"].tolist()[:3] == [1, 1, 0]
    _, warnings = blf.parse(data + b"garbage that is no object")
    assert warnings
    with pytest.raises(blf.BlfError):
        blf.parse(b"nonsense")


def test_csv(spark, tmp_path):
    narrow = write(tmp_path, "n.csv", "channel,message_name,message_id,signal_name,unit,timestamp,value,raw_value\n1,Eng,256,Speed,rpm,0.1,1200.5,\n1,Gear,0x200,Gear,,0.2,Drive,4\nbad,line\n")
    got = [(r["signal_key"], r["message_id"], r["t_s"], r["value"], r["label"]) for r in csv_files.read_narrow(spark, narrow).orderBy("seq").collect()]
    assert got == [("CH1::Eng::Speed", 256, 0.1, 1200.5, None), ("CH1::Gear::Gear", 0x200, 0.2, 4.0, "Drive")]
    wide = write(tmp_path, "w.csv", "Timestamps [s],EngSpeed [rpm],Throttle (%)\n0,1,2\n0.5,,3\nx,1,1\n")
    got = [(r["signal"], r["unit"], r["t_s"], r["value"]) for r in csv_files.read_wide(spark, wide).orderBy("seq", "signal").collect()]
    assert got == [("EngSpeed", "rpm", 0, 1), ("Throttle", "%", 0, 2), ("Throttle", "%", 0.5, 3)]
    raw = write(tmp_path, "r.csv", "TimestampEpoch;BusChannel;ID;IDE;DLC;DataLength;Dir;EDL;BRS;ESI;RTR;DataBytes\n1.0;1;100;0;8;8;Rx;0;0;0;0;60 09 64 00 00 00 00 00\n1.1;2;18FF50E5;1;9;12;1;1;1;0;0;0102030405060708090A0B0C\nx;1;1;0;0;0;0;0;0;0;0;\n")
    got = rows(csv_files.read_raw(spark, raw))
    assert [(r[2], r[3], r[4], r[5], r[8], r[9], r[10]) for r in got] == [(1, 0x100, False, False, False, 8, "Rx"), (2, 0x18FF50E5, True, True, True, 12, "Tx")]


def test_dispatch(spark, tmp_path):
    path = write(tmp_path, "a.asc", ASC)
    assert recordings.read_recording(spark, path).kind == "frames"
    wide = write(tmp_path, "w.csv", "time,A\n0,1\n")
    assert recordings.read_recording(spark, wide).samples.count() == 1 and not recordings.database_required(spark, wide)
    with pytest.raises(DatabaseError, match="needed"):
        recordings.read_recording(spark, path, {})
    with pytest.raises(DatabaseError, match="LDF"):
        recordings.read_recording(spark, write(tmp_path, "b.trc", TRC1), {("CAN", 1): "x.ldf"})
    for name, words in (("x.arxml", "not supported"), ("x.bin", "Unsupported")):
        with pytest.raises(recordings.UnsupportedFormat, match=words):
            recordings.read_recording(spark, name)
    with pytest.raises(csv_files.CsvError):
        recordings.read_recording(spark, write(tmp_path, "u.csv", "foo,bar\n1,2\n"))
    info = {r["item"]: r["value"] for r in recordings.measurement_info(spark, write(tmp_path, "c.trc", TRC1)).collect()}
    assert info["Version"] == "1.1" and info["Start"].startswith("2023-03-15")


def test_channel_config(tmp_path):
    path = write(tmp_path, "c.json", '{"type": "x", "version": 1, "channels": {"1": "a.dbc", "LIN:2": "b.ldf", "bad": "c", "3": 5}}')
    config = recordings.read_channel_config(path)
    assert config == {("CAN", 1): "a.dbc", ("LIN", 2): "b.ldf"}
    recordings.save_channel_config(path, config)
    assert recordings.read_channel_config(path) == config


def blf_container(frames, method=2, damage=False):
    """Top-level container bytes of classic frames (time, channel, id, data)."""
    import struct
    import zlib

    body = b""
    for t, channel, ident, data in frames:
        inner = struct.pack("<HBBI8s", channel, 0, len(data), ident, data.ljust(8, b"\0"))
        body += struct.pack("<4sHHII", b"LOBJ", 32, 1, 32 + len(inner), 1) + struct.pack("<IHHQ", 2, 0, 0, round(t * 1e9)) + inner
    packed = zlib.compress(body) if method == 2 else body
    packed = b"\xff" * len(packed) if damage else packed
    out = struct.pack("<4sHHII", b"LOBJ", 16, 1, 32 + len(packed), 10) + struct.pack("<H6xI4x", method, len(body)) + packed
    return out + b"\0" * (len(out) % 4)


def test_blf_leaves_out_what_it_cannot_unpack_and_says_so(spark, tmp_path):
    import struct

    from tracewright.sources import blf
    from tracewright.sources.recordings import read_recording

    frame = lambda k: [(k * 0.1, 1, 0x100 + k, bytes([k] * 4))]
    head = struct.pack("<4sI", b"LOGG", 144).ljust(144, b"\0")
    path = tmp_path / "parts.blf"
    path.write_bytes(head + blf_container(frame(1)) + blf_container(frame(2), method=5) + blf_container(frame(3), method=0) + blf_container(frame(4), damage=True) + blf_container(frame(5)))
    got = read_recording(spark, str(path))
    assert [(r["frame_idx"], r["arb_id"]) for r in got.frames.orderBy("frame_idx").collect()] == [(0, 0x101), (1, 0x103), (2, 0x105)]
    told = [r["warning"] for r in got.warnings.collect()]
    assert len(told) == 2 and "method 5" in told[0] and "inflated" in told[1]
    empty = tmp_path / "empty.blf"
    empty.write_bytes(head)
    with pytest.raises(blf.BlfError):
        read_recording(spark, str(empty))


def test_headings_of_csv_tables():
    import re

    from tracewright.sources.csv_files import _is_time, bracketed, plain_heading

    for text in ("EngSpeed [rpm]", "Speed(km/h)", "a [b] c (d)", "open [", "x ] y", "[only]", "", "mixed [a)", "((x)", " padded [u] "):
        units = [m.group(1) for m in re.finditer(r"[\[(]([^\])]*)[\])]", text)]
        assert bracketed(text) == (re.sub(r"[\[(][^\])]*[\])]", "", text), units), text
    for text, wanted in (("Timestamps [s]", True), ("time", True), ("T", True), ("t[ms]", True), ("Time (s)", False), ("times", False), ("Timestamp [s", False), ("Time of day", False)):
        assert _is_time(text) == wanted, text
    assert plain_heading(" Timestamp-Epoch ") == "timestampepoch"


def test_long_ranges_of_multiplexers_are_kept():
    from tracewright.sources.databases import parse_dbc

    text = 'BO_ 5 M: 8 X\n SG_ Mux M : 0|32@1+ (1,0) [0|0] "" X\n SG_ A m0 : 32|8@1+ (1,0) [0|0] "" X\n\nSG_MUL_VAL_ 5 A Mux 3-3, 10-4000000;\n'
    signal = parse_dbc(text).messages[0].signal("A")
    assert signal.mux_ids == [3] and signal.mux_ranges == [(10, 4_000_000)]


def test_a_conversion_job_writes_what_its_reader_gives_back(spark, tmp_path):
    from tracewright.plans.exports import ConvertJob, run_job
    from tracewright.sources import blf
    from tracewright.sources.recordings import read_recording

    frames = [(0.0, 1, 0x100, b"\x01\x02"), (0.5, 2, 0x18FEF100, b"\x03"), (1.0, 1, 0x7FF, b"")]
    source = str(tmp_path / "in.blf")
    blf.write_simple(source, frames)
    for suffix in (".asc", ".trc", ".csv"):
        target = str(tmp_path / f"out{suffix}")
        run_job(spark, ConvertJob((source,), target, start=0.0, end=0.7))
        rows = read_recording(spark, target).frames.orderBy("frame_idx").collect()
        assert [(round(r["t_s"], 6), r["channel"], r["arb_id"], r["is_extended"], bytes(r["payload"])) for r in rows] == [(0.0, 1, 0x100, False, b"\x01\x02"), (0.5, 2, 0x18FEF100, True, b"\x03")], suffix
    with pytest.raises(ValueError, match="Unsupported"):
        run_job(spark, ConvertJob((source,), str(tmp_path / "out.blf")))
