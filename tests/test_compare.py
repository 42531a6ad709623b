import json
import random
from decimal import Decimal

import pytest
import xlsx as X

from quillgrid import EngineError, ReconcileOptions, reconcile
from quillgrid.cli import main

SCHEMA = {"Lot": "BIGINT", "Grade": "VARCHAR", "Weight": "DECIMAL(12,3)"}
BEFORE = {"Hall A": [["Lot", "Grade", "Weight"], [11, "fine", 2.5], [12, "raw", 7], [13, None, 1]], "Hall 'B'": [["Weight", "Lot", "Grade"], [0.125, 21, "raw"], [4, 22, "fine"]]}
AFTER = {"Yard": [["Grade", "Weight", "Lot"], ["raw", 7, 12], ["fine", 4, 22], ["fine", 9, 31]], "Hall A": [["Lot", "Grade", "Weight"], [13, "raw", 1], [11, "fine", 2.501]]}


def area(rows):
    return f"A1:{chr(64 + len(rows[0]))}{len(rows)}"


@pytest.fixture
def pair(tmp_path):
    return X.write(tmp_path / "old.xlsx", BEFORE), X.write(tmp_path / "new.xlsx", AFTER)


def spec(**more):
    return {"before_ranges": {k: area(v) for k, v in BEFORE.items()}, "after_ranges": {k: area(v) for k, v in AFTER.items()}, "schema": SCHEMA, "keys": ["Lot"]} | more


def test_changes_and_where_they_are(pair, spark, tmp_path):
    out = tmp_path / "told.jsonl"
    got = reconcile(*pair, **spec(), spark=spark, output=out, cache_dir=str(tmp_path / "kept"))
    assert got["rows"] == {"before": 5, "after": 5} and got["counts"] == {"added": 1, "removed": 1, "changed": 2, "unchanged": 2}
    assert got["changed_columns"] == {"Grade": 1, "Weight": 1}
    told = [json.loads(x) for x in out.read_text().splitlines()]
    assert [(x["kind"], x["key"]["Lot"]) for x in told] == [("changed", 11), ("changed", 13), ("removed", 21), ("added", 31)] and told == got["sample"]
    assert told[1] == {"kind": "changed", "key": {"Lot": 13}, "before": {"sheet": "Hall A", "values": {"Grade": None, "Weight": "1.000"}}, "after": {"sheet": "Hall A", "values": {"Grade": "raw", "Weight": "1.000"}}, "changed_columns": ["Grade"]}
    assert told[2]["before"] == {"sheet": "Hall 'B'", "values": {"Grade": "raw", "Weight": "0.125"}} and told[2]["after"] is None and told[3]["before"] is None
    with pytest.raises(EngineError, match="exists"):
        reconcile(*pair, **spec(), spark=spark, output=out)
    again = reconcile(*pair, **spec(), options=ReconcileOptions(cache_dir=str(tmp_path / "kept"), sample_limit=3, output=out, overwrite=True), spark=spark)
    assert again["cache_hits"] == {"before": 2, "after": 2} and again["sample_truncated"] and len(again["sample"]) == 3


def test_keys_alone(pair, spark):
    got = reconcile(*pair, **spec(compare_columns=[]), spark=spark)
    assert got["counts"] == {"added": 1, "removed": 1, "changed": 0, "unchanged": 4} and got["changed_columns"] == {}


def test_bad_keys(tmp_path, spark):
    a = X.write(tmp_path / "a.xlsx", {"S": [["ID", "V"], [1, 1], [1, 2]], "N": [["ID", "V"], [None, 1]], "One": [["ID", "V"], [1, 1]]})
    run = lambda before, **k: reconcile(a, a, before_ranges=before, after_ranges={"One": "A1:B2"}, schema={"ID": "BIGINT", "V": "BIGINT"}, keys=["ID"], spark=spark, **k)
    with pytest.raises(EngineError, match="repeat"):
        run({"S": "A1:B3"})
    with pytest.raises(EngineError, match="null key"):
        run({"N": "A1:B2"})
    with pytest.raises(EngineError, match="repeat"):
        run({"One": "A1:B2", "S": "A1:B2"})
    with pytest.raises(EngineError):
        run({"One": "A1:B2"}, output=a)
    with pytest.raises(EngineError):
        run({"One": "A1:B2"}, sample_limit=10_000)
    with pytest.raises(EngineError):
        run({"One": "A1:B2"}, options=ReconcileOptions(), sample_limit=1)


def test_long_decimals_keys_of_two_columns_and_columns_left_out(tmp_path, spark):
    rows = lambda tail, other: [["Year", "Unit", "Rate", "Check"], ["2031", "kg", f"3.{'0' * 16}{tail}", X.F("Z9")], ["2031", "lb", other, X.F("Z8")], ["2032", "kg", "-1", X.F("")]]
    a, b = X.write(tmp_path / "a.xlsx", {"S": rows("7", 0)}), X.write(tmp_path / "b.xlsx", {"S": rows("8", None)})
    schema = {"Year": "BIGINT", "Unit": "VARCHAR", "Rate": "DECIMAL(30,17)", "Check": "DOUBLE"}
    got = reconcile(a, b, before_ranges={"S": "A1:D4"}, after_ranges={"S": "A1:D4"}, schema=schema, keys=["Year", "Unit"], compare_columns=["Rate"], spark=spark)
    assert got["counts"] == {"added": 0, "removed": 0, "changed": 2, "unchanged": 1}
    assert [(x["key"]["Unit"], x["before"]["values"]["Rate"], x["after"]["values"]["Rate"]) for x in got["sample"]] == [("kg", "3.00000000000000007", "3.00000000000000008"), ("lb", "0.00000000000000000", None)]


def test_equals_a_comparison_of_dicts(tmp_path, spark):
    rng = random.Random(17)
    made = lambda lot: (rng.choice([None, "raw", "fine", ""]), Decimal(rng.randrange(10**6)).scaleb(-3))  # noqa: ARG005, E731
    old = {lot: made(lot) for lot in rng.sample(range(5000), 900)}
    new = {lot: made(lot) if rng.random() < 0.2 else v for lot, v in old.items() if rng.random() < 0.9} | {lot: made(lot) for lot in rng.sample(range(5000, 6000), 60)}

    def book(path, lots, names):
        deal = {n: [["Lot", "Grade", "Weight"]] for n in names}
        for lot, (grade, weight) in rng.sample(sorted(lots.items()), len(lots)):
            deal[rng.choice(names)].append([lot, grade, str(weight)])
        return X.write(path, deal, shared=True), {n: area(rows) for n, rows in deal.items()}

    (a, before), (b, after) = book(tmp_path / "a.xlsx", old, ["x", "y", "z"]), book(tmp_path / "b.xlsx", new, ["z", "u"])
    got = reconcile(a, b, before_ranges=before, after_ranges=after, schema=SCHEMA, keys=["Lot"], spark=spark, output=tmp_path / "o.jsonl")
    both = old.keys() & new.keys()
    changed = {lot for lot in both if old[lot] != new[lot]}
    assert got["counts"] == {"added": len(new.keys() - old.keys()), "removed": len(old.keys() - new.keys()), "changed": len(changed), "unchanged": len(both - changed)}
    assert got["changed_columns"] == {c: sum(old[lot][i] != new[lot][i] for lot in both) for i, c in enumerate(("Grade", "Weight"))}
    told = [json.loads(x)["key"]["Lot"] for x in (tmp_path / "o.jsonl").read_text().splitlines()]
    assert told == sorted(changed | old.keys() ^ new.keys())


def test_command_line(pair, spark, tmp_path, capsys):
    (tmp_path / "spec.json").write_text(json.dumps(spec()))
    base = ["--workspace", str(tmp_path)]
    assert main([*base, "reconcile", "old.xlsx", "new.xlsx", "--spec", "spec.json"]) == 0
    assert json.loads(capsys.readouterr().out)["counts"]["added"] == 1
    (tmp_path / "r.json").write_text(json.dumps({"Hall A": "A1:C4"}))
    (tmp_path / "s.json").write_text(json.dumps(SCHEMA))
    assert main([*base, "--metrics", "query-sheets", "old.xlsx", "SELECT sum(Weight) AS s FROM Sales", "--ranges", "r.json", "--schema", "s.json"]) == 0
    assert json.loads(capsys.readouterr().out)["rows"] == [["10.500"]]
    for bad in (["inspect", "../x.xlsx"], ["inspect", "/etc/passwd"], ["inspect", "com1.xlsx"], ["inspect", "a:b.xlsx"], ["inspect", "old.xlsx."], ["inspect", "x/nul"], ["read", "old.xlsx", "Hall A", "A1:ZZ99999"], ["reconcile", "old.xlsx", "new.xlsx", "--spec", "s.json"]):
        assert main([*base, *bad]) == 2
        assert "error" in json.loads(capsys.readouterr().err.splitlines()[-1])
    assert main([*base, "inspect", "old.xlsx"]) == 0 and main([*base, "read", "old.xlsx", "Hall A", "A1:C2"]) == 0
    for command in ("formulas", "dependencies", "styles", "validate"):
        assert main([*base, command, "old.xlsx", "Hall A", "A1:C2"]) == 0
    assert main([*base, "inspect", "old.xlsx", "--sheet", "Hall A", "--deep", "--limit", "2"]) == main([*base, "patterns", "old.xlsx", "Hall A"]) == main([*base, "find", "old.xlsx", "Weight", "--full"]) == 0
    (tmp_path / "p.json").write_text(json.dumps([{"operation": "SET_VALUE", "sheet": "Hall A", "cell": "Z9", "value": 4}]))
    assert main([*base, "patch", "old.xlsx", "p.json", "made.xlsx"]) == 0 and (tmp_path / "made.xlsx").exists()
    assert main([*base, "patch", "old.xlsx", "p.json", "../made.xlsx"]) == 2
    (tmp_path / "out").mkdir()
    (tmp_path / "link.xlsx").symlink_to("/etc/hosts")
    (tmp_path / "nowhere.xlsx").symlink_to(tmp_path / "missing.xlsx")
    assert main([*base, "inspect", "link.xlsx"]) == main([*base, "inspect", "nowhere.xlsx"]) == 2
