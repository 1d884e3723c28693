import inspect
import math
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import align, decode, search, statistics, trace, view
from tracewright.operators.keys import FRAMES, channel_label, decode_channel_key, flags, signal_key
from tracewright.plans import exports
from tracewright.sources import asc, csv_files
from tracewright.sources.databases import Database, DatabaseError, Message, Signal, channel_config, compatibility_warning, load_database, parse_dbc, parse_ldf, pgn_of, tables

DBC = '''VERSION ""
BO_ 256 Engine: 8 X
 SG_ Speed : 0|16@1+ (0.5,0) [0|0] "rpm" X
 SG_ Throttle : 16|8@1+ (0.5,0) [0|0] "%" X

BO_ 512 Gear: 4 X
 SG_ Gear : 0|8@1+ (1,0) [0|0] "" X

BO_ 610 Nested: 8 X
 SG_ Outer M : 0|4@1+ (1,0) [0|0] "" X
 SG_ Inner m0M : 4|4@1+ (1,0) [0|0] "" X
 SG_ InnerA m0 : 8|8@1+ (1,0) [0|0] "" X
 SG_ InnerB m1 : 8|8@1+ (1,0) [0|0] "" X
 SG_ OuterB m1 : 16|8@1- (1,0) [0|0] "" X
 SG_ Plain : 24|8@1+ (1,0) [0|0] "" X

BO_ 2566834709 J: 8 X
 SG_ V : 0|8@1+ (1,0) [0|0] "" X

SIG_VALTYPE_ 999 F : 1;
SG_MUL_VAL_ 610 InnerA Inner 0-0;
SG_MUL_VAL_ 610 InnerB Inner 1-1, 3-4;
VAL_ 512 Gear 1 "Park" 4 "Drive" ;
'''
LDF = '''LIN_description_file;
Signals { WindowPos: 8, 0, M, S; LockState: 2, 0, M, S; }
Frames { DoorCmd: 0x20, M, 2 { WindowPos, 0; LockState, 8; } }
Signal_encoding_types { Lock { logical_value, 0, "Unlocked"; logical_value, 1, "Locked"; } Pos { physical_value, 0, 255, 0.5, 0, "%"; } }
Signal_representation { Lock: LockState; Pos: WindowPos; }
'''


def frames(spark, rows):
    """rows: (arb_id, payload[, changes])"""
    out = []
    for k, (arb, payload, *more) in enumerate(rows):
        d = {"t_s": k / 1000, "bus": "CAN", "channel": 1, "is_extended": arb > 0x7FF, "is_fd": False, "is_error": False, "is_remote": False, "is_brs": False, "direction": "Rx"} | (more[0] if more else {})
        out.append((k, d["t_s"], d["bus"], d["channel"], arb, d["is_extended"], d["is_fd"], d["is_error"], d["is_remote"], d["is_brs"], d.get("dlc", len(payload)), d["direction"], bytearray(payload)))
    return spark.createDataFrame(out, FRAMES)


def test_hold_equals_numpy_whatever_the_buckets(spark, samples):
    rng = np.random.default_rng(3)
    series = {k: (np.round(rng.uniform(0, 50, n), 1), rng.normal(size=n).round(3)) for k, n in (("A", 200), ("B", 37), ("C", 5))}
    expected = {}
    clean = {k: dict(sorted(zip(t.tolist(), v.tolist(), strict=True), key=lambda x: x[0])) for k, (t, v) in series.items()}
    start = max(min(c) for c in clean.values())
    for t in sorted({t for c in clean.values() for t in c if t >= start}):
        expected[t] = tuple(c[max(x for x in c if x <= t)] for c in clean.values())
    for buckets in (1, 7, 400):
        got = {r["t_s"]: (r["s0"], r["s1"], r["s2"]) for r in align.aligned(samples(**series), ["A", "B", "C"], buckets=buckets).collect()}
        assert got == expected


def test_grids(spark, samples):
    assert align.grid_steps(0, 1, 0.1) == 10 and align.grid_steps(0, 1, 0.3) == 3
    with pytest.raises(ValueError):
        align.grid_steps(0, 1, 0)
    s = samples(A=([0, 1, 1, 2], [1, 2, 3, 4]), B=([0.5], [9]))
    got = [tuple(r) for r in align.on_grid(s, ["A", "B"], align.reference_grid(s, "A")).orderBy("t_s").collect()]
    assert got == [(0, 1, None), (1, 3, 9), (1, 3, 9), (2, 4, 9)]
    got = [tuple(r) for r in align.on_grid(s, ["A"], align.regular_grid(spark, 0, 2, 0.5)).orderBy("t_s").collect()]
    assert got == [(0, 1), (0.5, 1), (1, 3), (1.5, 3), (2, 4)]
    with pytest.raises(ValueError, match="either"):
        exports.Timebase().grid(s, ["A"])
    assert exports.Timebase(recurrence_s=0.5).rows(s, ["A"]) == 5


def test_statistics(samples):
    rng = np.random.default_rng(1)
    t, v = rng.permutation(5000) / 100.0, 1e6 + rng.uniform(-0.5, 0.5, 5000)
    v[7] = math.nan
    row = statistics.range_statistics(samples(A=(t, v)), 2.0, 7.5).first()
    inside = v[(t >= 2) & (t <= 7.5) & ~np.isnan(v)]
    assert (row["min"], row["max"], row["samples"]) == (inside.min(), inside.max(), len(inside))
    assert row["std"] == pytest.approx(inside.std(), rel=1e-6) and row["mean"] == pytest.approx(inside.mean()) and row["rms"] == pytest.approx(np.sqrt((inside**2).mean()))
    s = samples(A=([0, 1, 1, 3], [5, -7, 8, 9]), B=([0, 1], [1, 2], ["x", "y"]))
    held = statistics.range_statistics(s, 1.2, 1.8, hold=True).collect()
    assert [(r["signal_key"], r["mean"], r["std"], r["rms"], r["samples"]) for r in held] == [("A", -7, 0, 7, 0)]
    assert statistics.range_statistics(s, 1.2, 1.8).count() == 0
    fit = {r["signal_key"]: (r["low"], r["high"]) for r in statistics.fit_range(samples(A=([0, 1], [0, 10]), Z=([0], [0]), N=([0], [-4])), 0, 1).collect()}
    assert fit == {"A": (-0.5, 10.5), "Z": (-1, 1), "N": (-4.2, -3.8)}
    assert statistics.typical_recurrence(samples(A=([0, 1, 1, 4, 6], [0] * 5))).first()["recurrence_s"] == 2
    assert statistics.statistics_range((0, 9), (5, 2)) == (2, 5) and statistics.statistics_range((0, 9), (None, 2)) == (0, 9)


def test_nearest_takes_the_later_of_two_and_clamps(samples):
    s = samples(A=([0, 2, 4], [1, 2, 3]))
    assert [align.nearest(s, t).first()["value"] for t in (-5, 1, 3.1, 99)] == [1, 2, 3, 3]
    s = samples(A=([0, 2], [1, 5]), B=([0, 2], [1, 2], ["on", None]))
    assert {r["signal_key"]: r["difference"] for r in align.cursor_difference(s, 0, 2).collect()} == {"A": 4, "B": None}


def test_databases(tmp_path):
    db = parse_dbc(DBC)
    names = {m.name: m for m in db.messages}
    assert names["J"].extended and names["J"].frame_id == 0x18FECA15 and pgn_of(0x18FECA15) == 0xFECA and pgn_of(0x18EF1215) == 0xEF00
    assert names["Gear"].signal("Gear").choices == {1: "Park", 4: "Drive"}
    assert names["Nested"].signal("InnerB").mux_ids == [1, 3, 4] and names["Nested"].signal("InnerB").mux_signal == "Inner"
    ldf = parse_ldf(LDF)
    assert ldf.messages[0].signal("LockState").choices == {0: "Unlocked", 1: "Locked"} and ldf.messages[0].signal("WindowPos").scale == 0.5
    with pytest.raises(DatabaseError):
        parse_dbc("nothing")
    path = tmp_path / "a.xyz"
    path.write_text("x")
    with pytest.raises(DatabaseError, match="unsupported"):
        load_database(str(path))
    assert compatibility_warning("a.ldf", "CAN") and not compatibility_warning("a.dbc", "CAN")


def test_decode_against_python_integers(spark):
    rng = random.Random(5)
    m = Message(0x100, "M", 64)
    while len(m.signals) < 40:
        x = Signal(f"s{len(m.signals)}", rng.randrange(512), rng.choice([1, 3, 8, 12, 16, 31, 33, 57, 64]), rng.random() < 0.5, rng.random() < 0.5)
        if x.bytes_needed <= 64:
            m.signals.append(x)
    m.signals += [Signal("f16", 16, 16, is_float=True, signed=True), Signal("f32", 32, 32, is_float=True, signed=True), Signal("f64", 71, 64, True, True, True)]
    data = [bytes(rng.randrange(256) for _ in range(64)) for _ in range(40)]
    messages, signals, _ = tables(spark, {"d": Database([m])})
    out = decode.decode(frames(spark, [(0x100, p) for p in data]), messages, signals, channel_config(spark, {("CAN", 0): "d"}))
    got = {(r["seq"], r["signal"]): r["value"] for r in out.collect()}
    for k, p in enumerate(data):
        for x in m.signals:
            raw = int.from_bytes(p, "big") >> (512 - x.first_bit - x.length) if x.big_endian else int.from_bytes(p, "little") >> x.start
            raw &= (1 << x.length) - 1
            if x.is_float:
                value = struct.unpack({16: ">e", 32: ">f", 64: ">d"}[x.length], raw.to_bytes(x.length // 8, "big"))[0]
            else:
                value = float(raw - (1 << x.length) if x.signed and raw >> (x.length - 1) else raw)
            assert got.get((k, x.name)) == (None if math.isnan(value) else value), x


def test_decode_rules(spark):
    messages, signals, _ = tables(spark, {"d": parse_dbc(DBC), "l": parse_ldf(LDF)})
    config = channel_config(spark, {("CAN", 0): "d", ("LIN", 1): "l"})
    rows = [
        (0x100, b"\x60\x09\x64\0\0\0\0\0"), (0x200, b"\x04\0\0\0"), (0x200, b"\x07\0\0\0\xff\xff"), (0x100, b"\x10\x00"), (610, b"\x00\x11\x22\x33\0\0\0\0"), (610, b"\x31\x11\xff\x33\0\0\0\0"), (610, b"\x70\x11\x22\x33\0\0\0\0"),
        (0x300, b"\0"), (0x100, b"\x01\x00\x02", {"is_error": True}), (0x20, b"\x0a\x01", {"bus": "LIN"}), (0x20, b"\x0a\x01"), (0x18FECA99, b"\x05\0\0\0\0\0\0\0"), (0x18FECA15, b"\x06\0\0\0\0\0\0\0"),
    ]
    f = frames(spark, rows)
    got = {(r["seq"], r["signal"]): (r["value"], r["label"]) for r in decode.decode(f, messages, signals, config).collect()}
    assert got == {
        (0, "Speed"): (1200, None), (0, "Throttle"): (50, None), (1, "Gear"): (4, "Drive"), (2, "Gear"): (7, None), (3, "Speed"): (8, None),
        (4, "Outer"): (0, None), (4, "Inner"): (0, None), (4, "InnerA"): (0x11, None), (4, "Plain"): (0x33, None), (5, "Outer"): (1, None), (5, "OuterB"): (-1, None), (5, "Plain"): (0x33, None),
        (6, "Outer"): (0, None), (6, "Inner"): (7, None), (6, "Plain"): (0x33, None), (9, "WindowPos"): (5, None), (9, "LockState"): (1, "Locked"), (11, "V"): (5, None), (12, "V"): (6, None),
    }
    keys = {r["signal_key"] for r in decode.decode(f, messages, signals, config).collect()}
    assert {"CH1::J [SA 0x99]::V", "CH1::J [SA 0x15]::V", "LIN1::DoorCmd::LockState"} <= keys
    bound = decode.bind(f, messages, config)
    c = decode.counters(bound).first()
    assert (c["total"], c["errors"], c["decoded"], c["unmatched"]) == (13, 1, 10, 2)
    assert {r["message"]: r["n_short"] for r in decode.short_frames(bound).collect()} == {"Engine": 2}
    assert decode.decode_frame(f, 1, messages, signals, config).first()["label"] == "Drive"
    scores = {(r["db_id"], r["bus"]): (r["ids"], r["hits"]) for r in decode.match_scores(f, messages).collect()}
    assert scores[("d", "CAN")] == (7, 5) and scores[("l", "LIN")] == (1, 1)
    assert decode.from_first(f.where("frame_idx > 2")).agg(F.min("t_s")).first()[0] == 0


def test_labels_and_hex(spark):
    df = spark.createDataFrame([(10.0,), (10.5,), (10.2,), (math.nan,)], "v double")
    choices = F.create_map(F.lit(0).cast("long"), F.lit("zero"), F.lit(1).cast("long"), F.lit("one"))
    assert [r[0] for r in df.select(decode.physical_to_label(F.col("v"), F.lit(0.5), F.lit(10.0), choices)).collect()] == ["zero", "one", None, ""]
    h = lambda v, n, signed: spark.range(1).select(view.raw_hex(F.lit(float(v)), F.lit(1.0), F.lit(0.0), F.lit(n), F.lit(signed), F.lit(False))).first()[0]
    assert [h(255, 8, False), h(-1, 12, True), h(256, 8, False), h(1.5, 8, False)] == ["0xFF", "0xFFF", "", ""]


def test_previous_frame_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(0x100 + rng.randrange(16), bytes(rng.randrange(3) for _ in range(rng.randrange(9))), {"channel": rng.choice([1, 2, None]), "is_error": rng.random() < 0.1, "is_remote": rng.random() < 0.1, "is_fd": rng.random() < 0.5}) for _ in range(600)]
    last, expected = {}, {}
    for k, (arb, data, d) in enumerate(rows):
        kind = (arb, d["channel"], d["is_error"], d["is_remote"])
        p = last.get(kind)
        changed = [] if d["is_remote"] else [p is not None and (i >= len(rows[p][1]) or rows[p][1][i] != b) for i, b in enumerate(data)]
        expected[k] = (p, None if p is None else pytest.approx((k - p) / 1000), changed)
        last[kind] = k
    got = {r["frame_idx"]: (r["prev_idx"], r["delta_s"], r["changed"]) for r in trace.differences(frames(spark, rows)).collect()}
    assert got == expected


def test_search(spark):
    rows = [(0x103, b"\x10\x00"), (0x110, b"\x01\x02"), (0x200, b"\xab\xcd", {"direction": "Tx", "channel": 2})]
    f = frames(spark, rows).withColumn("name", F.when(F.col("frame_idx") == 1, "EngineSpeed"))
    find = lambda needle, **how: sorted(r["frame_idx"] for r in trace.search(f, needle, **how).collect())
    assert find("") == [0, 1, 2] and find("0x103") == [0] and find("engine") == [1] and find("tx") == [2] and find("abcd") == [2] and find("bc") == []
    assert find("0.001") == [1] and find("can 2 200") == [2] and find("10") == [0, 1] and find("tx", channel=1) == []
    assert find("abcd", data_limit=2) == []
    assert [r["frame_idx"] for r in trace.page(f, 1, 1).collect()] == [1]
    assert trace.first_at_or_after(f, 0.0005).first()[0] == 1 and trace.last_at_or_before(f, 0.0005).first()[0] == 0
    row = trace.render(trace.differences(f)).orderBy("frame_idx").first()
    assert (row["time"], row["delta_ms"], row["id"], row["name"], row["data"]) == ("0.000000", "", "0x103", "(unmatched)", "10 00")
    assert trace.first_ids(f).first()["text"] == "CH1 | 0x103 | DLC=2 | Rx"
    assert {r["channel"]: r["ids"] for r in trace.prescan(f).collect()} == {1: [0x103, 0x110], 2: [0x200]}


def test_names(spark, tmp_path):
    signals = spark.createDataFrame([("EngSpeed",), ("Throttle",), ("a.b",)], "signal string")
    assert [r[0] for r in search.search_names(signals, "n?sp").collect()] == ["EngSpeed"] and [r[0] for r in search.search_names(signals, "a.b").collect()] == ["a.b"]
    picked, missing = search.select_names(signals, ["engspeed", "thr*", "zzz"])
    assert sorted(r[0] for r in picked.collect()) == ["EngSpeed", "Throttle"] and [r[0] for r in missing.collect()] == ["zzz"]
    path = tmp_path / "list.txt"
    path.write_text("# note\n\n EngSpeed \nThr*\n")
    assert [r[0] for r in search.read_selection(spark, str(path)).collect()] == ["EngSpeed", "Thr*"]


def test_keys(spark):
    row = spark.range(1).select(signal_key(F.lit("LIN"), F.lit(2), F.lit("M"), F.lit("S")).alias("a"), signal_key(F.lit("CAN"), F.lit(None).cast("int"), F.lit("M"), F.lit("S")).alias("b"), channel_label(F.lit("CAN"), F.lit(1)).alias("c"),
                                flags(extended=F.lit(True), fd=F.lit(False), lin=F.lit(False), error=F.lit(True), remote=F.lit(False), brs=F.lit(True)).alias("f")).first()
    assert tuple(row) == ("LIN2::M::S", "CH?::M::S", "CAN 1", 1 + 16 + 64)
    assert decode_channel_key("LIN:1") == ("LIN", 1) and decode_channel_key("3") == ("CAN", 3) and decode_channel_key("x") is None


def test_views(samples):
    s = samples(A=([0, 1, 0.5, 2], [1, math.nan, 3, 4]))
    assert [r["drawn"] for r in view.segments(s).orderBy("seq").collect()] == [False, False, True, False]
    points = view.step_points(samples(A=([0, 1, 3], [5, 6, 7]))).orderBy("seq", "corner").collect()
    assert [(p["t_s"], p["value"]) for p in points] == [(0, 5), (1, 5), (1, 6), (3, 6), (3, 7)]
    assert {r["bucket"]: (r["min"], r["max"]) for r in view.peaks(samples(A=([0, 1, 2, 4], [3, 1, 2, 9])), 0, 4, 2).collect()} == {0: (1, 3), 1: (2, 9)}


def test_exports(spark, samples, tmp_path):
    s = samples(**{"CH1::M::A": ([0, 1], [1.5, 2]), "CH1::N::A": ([0.5], [7], ["on"]), "CH1::N::B": ([0], [3])}).withColumn("message", F.lit("M"))
    table = exports.wide_table(s, ["CH1::M::A", "CH1::N::A", "CH1::N::B"], exports.Timebase(recurrence_s=0.5))
    assert table.columns == ["Time", "CH1::M::A", "CH1::N::A", "B"]
    assert [tuple(r) for r in table.orderBy("Time").collect()] == [(0, "1.5", None, "3.0"), (0.5, "1.5", "on", "3.0"), (1, "2.0", "on", "3.0")]
    exports.export_csv(s, ["CH1::M::A", "CH1::N::B"], exports.Timebase(reference="CH1::M::A"), str(tmp_path / "out"), single=True)
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    rows = [tuple(r) for r in exports.table_view(s, ["CH1::M::A", "CH1::N::A"]).collect()]
    assert rows == [("0.000000", "1.5", ""), ("0.500000", "1.5", "on"), ("1.000000", "2", "on")]
    exports.write_safely(s, str(tmp_path / "safe"))
    assert spark.read.parquet(str(tmp_path / "safe")).count() == s.count()
    assert exports.convert_samples([s], ["CH1::M::A"], 0, 1, 0.25).count() == 5
    assert exports.export_excel(table, str(tmp_path / "t.xlsx")) == 3
    body = zipfile.ZipFile(str(tmp_path / "t.xlsx")).read("xl/worksheets/sheet1.xml").decode()
    assert body.count("<row>") == 4 and "<t xml:space=\"preserve\">on</t>" in body


def test_frames_round_trip(spark, tmp_path):
    rows = [(0x100, b"\x01\x02"), (0x18FF50E5, bytes(range(12)), {"is_fd": True, "is_brs": True, "direction": "Tx", "dlc": 12}), (0x200, b"", {"is_remote": True, "dlc": 4}), (0, b"", {"is_error": True, "direction": "Unknown"}), (0x21, b"\x0a\x0b", {"bus": "LIN"})]
    f = frames(spark, rows)
    exports.convert_frames([f, f], str(tmp_path / "o.asc"))
    back = asc.read_frames(spark, str(tmp_path / "o.asc")).drop("frame_idx").collect()
    assert len(back) == 10
    key = lambda r: (r["arb_id"], r["bus"], r["is_extended"], r["is_fd"], r["is_error"], r["is_remote"], r["is_brs"], r["direction"], bytes(r["payload"]))
    assert sorted(map(key, back)) == sorted(map(key, f.collect() * 2))
    can = f.where("bus = 'CAN' and not is_error and not is_remote")
    exports.convert_frames([can], str(tmp_path / "o.csv"), 0, 10)
    assert sorted(map(key, csv_files.read_raw(spark, str(tmp_path / "o.csv") + "/*.csv").collect())) == sorted(map(key, can.collect()))
    with pytest.raises(ValueError, match="Unsupported"):
        exports.convert_frames([f], "x.mf4")


def test_general_format(spark):
    values = [0.0, 1.0, 2.64, 123456.0, 1234567.0, 0.0001234567, 0.00001234, -7.25, 999999.5, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(exports.general_format(F.col("v"))).collect()] == ["%.6g" % v for v in values]


@pytest.mark.parametrize("job, words", [
    (exports.ConvertJob((), "o.csv"), "at least one"), (exports.ConvertJob(("a.asc", "b.blf"), "o.asc"), "one format"), (exports.ConvertJob(("a.csv",), "a.csv"), "overwrite"), (exports.ConvertJob(("a.asc",), "o.asc", 2, 1), "after the start"),
    (exports.ConvertJob(("a.csv",), "o.csv", raster=-1), "positive"), (exports.ConvertJob(("a.asc",), "o.asc", raster=1), "raw"), (exports.ConvertJob(("a.csv",), "o.xyz"), "Unsupported"),
])
def test_convert_job_rules(job, words):
    with pytest.raises(ValueError, match=words):
        job.validate()


def test_step_points_of_long_series(spark):
    n = 100_001
    s = spark.range(n).selectExpr("'A' as signal_key", "id as seq", "cast(id as double) as t_s", "cast(id as double) as value")
    assert view.step_points(s).groupBy("corner").count().orderBy("corner").collect() == [(0, n), (1, n - 1)]
    assert view.step_points(s, most=n - 1).count() == n


def test_search_looks_into_data_of_large_stores(spark):
    one = frames(spark, [(0x200, b"\xab\xcd")]).drop("frame_idx", "payload")
    many = spark.range(500_001).selectExpr("id as frame_idx", "if(id = 7, X'ABCD', X'0102') as payload").crossJoin(one)
    assert [r["frame_idx"] for r in trace.search(many, "abcd").collect()] == [7]
    assert trace.search(many, "abcd", data_limit=500_000).count() == 0


def test_table_view_keeps_the_union_of_times(samples):
    s = samples(**{"CH1::M::A": ([0, 2, 4], [1, 2, 3]), "CH1::N::A": ([1, 3], [7, 8])})
    keys = ["CH1::M::A", "CH1::N::A"]
    whole = [tuple(r) for r in exports.table_view(s, keys).collect()]
    assert [r[0] for r in whole] == [f"{t}.000000" for t in range(5)]
    assert [tuple(r) for r in exports.table_view(s, keys, most=2).collect()] == whole[:2]
    assert inspect.signature(exports.table_view).parameters["most"].default is None
