import math

import pytest

from tracewright.functions.formula import FormulaError, catalogue_rows, formula_functions, insertion, matches, parse, references_of, rename_reference
from tracewright.plans.calculated import Definition, Registry, calculate, estimate_points, load_library, save_library

NAN, INF = math.nan, math.inf


def same(found, expected):
    assert len(found) == len(expected), (found, expected)
    for (t, v), (wt, wv) in zip(found, expected, strict=True):
        assert t == wt
        assert (math.isnan(v) and math.isnan(wv)) or v == pytest.approx(wv, rel=1e-12, abs=1e-12), (t, v, wv)


@pytest.fixture(scope="module")
def run(samples):
    def go(formula, **series):
        out = calculate(samples(**series), formula, buckets=3).orderBy("t_s").collect()
        return [(r["t_s"], r["value"]) for r in out]

    return go


def test_union_grid_starts_at_the_latest_first_sample(run):
    same(run("`A` + `B`", A=([0, 2], [1, 3]), B=([1, 3], [10, 20])), [(1, 11), (2, 13), (3, 23)])


def test_order_is_repaired_and_the_last_of_equal_times_counts(run):
    same(run("abs(`A`)", A=([0, 1, 2, 0], [-10, -20, -30, -40])), [(0, 40), (1, 20), (2, 30)])
    same(run("lag(`A`, 1)", A=([2, 0, 1], [30, 10, 20])), [(0, NAN), (1, 10), (2, 20)])


SCALAR = [
    ("abs(`A`)", [-2, 3], [2, 3]), ("sqrt(`A`)", [4, -1], [2, NAN]), ("exp(`A`)", [0, 1], [1, math.e]), ("log(`A`)", [1, 0], [0, NAN]), ("log10(`A`)", [100, -1], [2, NAN]), ("log2(`A`)", [8, 1], [3, 0]),
    ("pow(`A`, 2)", [3, -2], [9, 4]), ("sign(`A`)", [-5, 0], [-1, 0]), ("mod(`A`, -3)", [7, -7], [-2, -1]), ("`A` % 3", [-7, 7], [2, 1]), ("round(`A`)", [2.5, 3.5], [2, 4]), ("round(`A`, 1)", [1.26, -1.26], [1.3, -1.3]),
    ("round(`A`, -1)", [25, 36], [20, 40]), ("floor(`A`)", [-1.5, 1.5], [-2, 1]), ("ceil(`A`)", [-1.5, 1.5], [-1, 2]), ("trunc(`A`)", [-1.5, 1.5], [-1, 1]), ("min(`A`, 1)", [0, 5], [0, 1]), ("max(`A`, 1)", [0, 5], [1, 5]),
    ("clamp(`A`, 0, 2)", [-1, 5], [0, 2]), ("sin(`A`)", [0, math.pi / 2], [0, 1]), ("asin(`A`)", [1, 2], [math.pi / 2, NAN]), ("acos(`A`)", [1, 0], [0, math.pi / 2]), ("atan2(`A`, 1)", [0, 1], [0, math.pi / 4]),
    ("degrees(`A`)", [math.pi, 0], [180, 0]), ("radians(`A`)", [180, 0], [math.pi, 0]), ("IF(`A` > 1, 5, 6)", [0, 2], [6, 5]), ("`A` / 0", [1, 0], [NAN, NAN]), ("1 / (1 / (`A` * 0))", [1, -1], [0, 0]),
    ("`A` & 3", [6, 5.5], [2, 2]), ("`A` | 1", [6, 12], [7, 13]), ("`A` ^ 5", [6, 12], [3, 9]), ("`A` << 2", [6, 5], [24, 20]), ("`A` >> 1", [6, 5], [3, 2]), ("1 << `A`", [64, 2], [NAN, 4]), ("~`A`", [0, 5], [-1, -6]),
    ("`A` > 0 AND `A` < 3", [1, 5], [1, 0]), ("not `A`", [0, 2], [1, 0]), ("`A` == 1 or `A` == 2", [2, 3], [1, 0]), ("0 < `A` <= 2", [2, 3], [1, 0]), ("`A` != 1", [1, 2], [0, 1]), ("pi * `A` + e", [0, 1], [math.e, math.pi + math.e]),
    ("2 ** -`A` ** 2", [1, 2], [0.5, 0.0625]), ("NOT `A` > 1 OR `A` == 3", [0, 3], [1, 1]), ("0x10 + 1_0 + .5 + 1e1 * `A`", [0, 1], [26.5, 36.5]), ("- -`A` - -1", [0, 1], [1, 2]), ("`A` - 1 - 1", [0, 5], [-2, 3]), ("1 < `A` < 3 < 4", [2, 3], [1, 0]),
    ("`A` | 1 ^ 3 & 2 << 1", [0, 8], [1, 9]), ("True + `A`", [0, 1], [1, 2]), ("sqrt(`A`) > 2", [-1, 9], [0, 1]), ("-`A` ** 2", [3, 1], [-9, -1]), ("log(`A` * 0) < 0", [1, 2], [1, 1]),
]


def test_scalar_functions(run):
    for formula, values, expected in SCALAR:
        try:
            same(run(formula, A=([0, 1], values)), [(0, expected[0]), (1, expected[1])])
        except AssertionError as e:
            raise AssertionError(formula) from e


def test_nan_inputs_mask_the_result(run):
    same(run("IF(`A` > 0, 1, 2)", A=([0, 1, 2], [1, NAN, INF])), [(0, 1), (1, NAN), (2, NAN)])


def test_temporal_functions(run):
    t, v = [0, 0.5, 2, 5], [10, 20, 30, 40]
    same(run("lag(`A`, 2)", A=(t, v)), [(0, NAN), (0.5, NAN), (2, 10), (5, 20)])
    same(run("lag(`A`, 9)", A=(t, v)), [(x, NAN) for x in t])
    same(run("delay(`A`, 1.5)", A=(t, v)), [(0, NAN), (0.5, NAN), (2, 20), (5, 30)])
    same(run("rolling_sum(`A`, 2)", A=(t, v)), [(0, NAN), (0.5, 30), (2, 50), (5, 70)])
    same(run("rolling_avg(`A`, 2)", A=(t, [1, NAN, 3, 5])), [(0, NAN), (0.5, NAN), (2, NAN), (5, 4)])
    same(run("integral(`A`)", A=(t, v)), [(0, 0), (0.5, 5), (2, 35), (5, 125)])
    same(run("integral(`A`)", A=(t, [1, NAN, 1, 1])), [(0, 0), (0.5, NAN), (2, NAN), (5, NAN)])
    same(run("integral(`A`) + 0 * `B`", A=([0, 1], [2, 3]), B=([0, 0.5, 9], [0, 0, 0])), [(0, 0), (0.5, 1), (1, 2), (9, 2)])
    same(run("derivative(`A`)", A=([0, 1, 1, 3], [0, 2, 5, 9])), [(0, NAN), (1, NAN), (3, 2)])
    same(run("diag(`A`, 2, 1.5)", A=([0, 1, 2, 3, 4, 5], [1, 1, 0, 0, 0, 1])), list(zip(range(6), [2, 4, 2.5, 1, 0, 2], strict=True)))
    same(run("diag(`A`, 1, 1)", A=([0, 1, 2], [1, NAN, 1])), [(0, 1), (1, NAN), (2, NAN)])


def test_time_signal(run):
    same(run("`Time` + `A`", A=([1, 2], [10, 20])), [(1, 11), (2, 22)])
    same(run("`Time` * 2", A=([1, 2], [10, 20]), B=([3], [0])), [(1, 2), (2, 4), (3, 6)])


@pytest.mark.parametrize("formula, words", [
    ("", "empty"), ("1 + 1", "one signal at least"), ("`A` + x", "x is neither"), ("sqroot(`A`)", "is sqrt meant"), ("sqrt(`A`, 1)", "takes 1, not 2"), ("if(`A`, 1, 2)", "in capitals"), ("`A` > 0 & `B` > 0", "need parentheses"),
    ("(`A` > 0) & `B` > 0", "need parentheses"), ("`A` > (`B` & 1)", "need parentheses"), ("`A", "left open"), ("` ` + 1", "no name"), ("lag(`A` + 1, 1)", "a signal itself"), ("lag(`A`, `B`)", "plain numbers"), ("diag(`A`, -`B`, 1)", "plain numbers"),
    ("[`A`]", "no meaning"), ("`A`.real", "no meaning"), ("'x' + `A`", "no meaning"), ("min(a=`A`)", "no meaning"), ("`A` +", "ends where"), ("`A` * / 2", "missing before '/'"), ("(`A` + 1", "closing parenthesis"), ("`A` `B`", "not expected"),
    ("`A` // 2", "missing before '/'"), ("round()", "takes 1 or 2"), ("1.2.3 + `A`", "not expected"),
])
def test_bad_formulas(formula, words):
    with pytest.raises(FormulaError, match=words):
        parse(formula)


def test_bad_amounts(samples):
    for formula, words in (("lag(`A`, 1.5)", "whole numbers"), ("lag(`A`, -1)", "of 0 or more"), ("rolling_sum(`A`, 0)", "of 1 or more"), ("delay(`A`, 1 / 0)", "finite")):
        with pytest.raises(FormulaError, match=words):
            calculate(samples(A=([0], [1])), formula)


def test_unknown_reference_and_rewriting():
    with pytest.raises(FormulaError, match="No such signal: B"):
        parse("`A` + `B`", ["A"])
    assert references_of("`A` + ` B ` (") == ["A", "B"]
    assert rename_reference("`A` + `AB`", "A", "C") == "`C` + `AB`"


def test_catalogue(spark):
    rows = catalogue_rows()
    assert formula_functions(spark).count() == len(rows)
    assert any(matches(r, "square root") for r in rows)
    assert insertion("sqrt") == ("sqrt()", 5)
    assert insertion("AND") == (" AND ", 5)


def test_registry(samples, tmp_path):
    r = Registry([Definition("Sum", "`A` + `B`")])
    r.put(Definition("Twice", "`CH?::Generate Signals::Sum` * 2"))
    base = samples(A=([0, 2], [1, 3]), B=([1, 3], [10, 20]))
    assert [(x["t_s"], x["value"]) for x in r.calculate(base, "twice").orderBy("t_s").collect()] == [(1, 22), (2, 26), (3, 46)]
    with pytest.raises(FormulaError, match="Sum -> Twice -> Sum"):
        r.put(Definition("Sum", "`CH?::Generate Signals::Twice`"), replacing="Sum")
    with pytest.raises(FormulaError, match="exists already"):
        r.put(Definition("SUM", "`A`"))
    r.put(Definition("Total", "`A` + `B`"), replacing="Sum")
    assert r.get("twice").formula == "`CH?::Generate Signals::Total` * 2"
    assert r.dependents("Total") == ["Twice"]
    path = str(tmp_path / "lib.json")
    save_library(path, r)
    entries, wrong = load_library(path)
    fresh = Registry()
    assert fresh.import_config(entries) == (2, []) and not wrong
    assert fresh.import_config([{"name": "x"}, {"name": "Total", "formula": "`A`"}], "overwrite") == (1, ["entry 1: name and formula are required"])
    fresh.delete("Total")
    assert len(fresh) == 1


def test_estimate(samples):
    row = estimate_points(samples(A=([0, 1], [1, 2]), B=([0], [1])), "`A` + `B`").first()
    assert (row["points"], row["bytes"], row["warn"]) == (3, 192, False)
