from pyspark.sql import functions as F

from structaudit.functions import formula as fm
from structaudit.functions import keys as k

ASPIRIN = "BSYNRYMUTXBXSQ-UHFFFAOYSA-N"


def test_compare_keys(evaluated):
    rows = [
        (ASPIRIN, ASPIRIN), (ASPIRIN, "BSYNRYMUTXBXSQ-UHFFFAOYSA-M"), (ASPIRIN, "BSYNRYMUTXBXSQ-ABCDEFGHSA-N"),
        (ASPIRIN, "RYYVLZVUVIJVGH-UHFFFAOYSA-N"), (ASPIRIN, None), ("", ASPIRIN), ("ab", "cd"),
    ]
    got = evaluated(rows, "l string, r string", m=k.compare_keys(F.col("l"), F.col("r")))
    assert [g["m"] for g in got] == [
        "exact", "exact", "skeleton", "different", "uncomparable", "uncomparable", "skeleton"
    ]


def test_key_parts(evaluated):
    got = evaluated(
        [(ASPIRIN,), (" bsynrymutxbxsq-uhfffaoysa-n ",), ("SHORT",)], "key string",
        sk=k.skeleton(F.col("key")), ok=k.is_valid_key(F.col("key")),
    )
    assert [g["ok"] for g in got] == [True, True, False]
    assert got[0]["sk"] == "BSYNRYMUTXBXSQ" and got[2]["sk"] is None


def test_family_and_confidence(evaluated):
    nan = float("nan")
    got = evaluated(
        [("decoder/x0.9", 0.5), ("reader@.venv310", nan), ("a-b", None), ("plain", float("inf"))], "e string, c double",
        f=k.engine_family(F.col("e")), floor=k.confidence_or_floor(F.col("c")), js=k.json_confidence(F.col("c")),
    )
    assert [g["f"] for g in got] == ["decoder", "reader", "a", "plain"]
    assert [g["floor"] for g in got][:3] == [0.5, -1.0, -1.0]
    assert [g["js"] for g in got] == [0.5, None, None, None]


def test_mask_bins_and_token_mean(evaluated):
    got = evaluated(
        [("ABC", "AXCD", 0.85, [0.5, 1.0]), (None, "AB", 1.5, [])], "ref string, read string, c double, t array<double>",
        m=k.key_diff_mask(F.col("ref"), F.col("read")), b=k.confidence_bin(F.col("c")), mean=k.mean_token_confidence(F.col("t")),
    )
    assert [g["m"] for g in got] == ["=x=x", "=="]
    assert [g["b"] for g in got] == ["0.85~0.9", None]
    assert [g["mean"] for g in got] == [0.75, None]


def test_heavy_atom_formula(evaluated):
    cases = {
        "CN(C)C": "C3N", "CN(C)(C)(C)C": "C5N", "CC(=O)Oc1ccccc1C(=O)O": "C9O4",
        "CC(=O)Oc1ccccc1C(=O)O.[I-].[I-]": "C9O4", "(((": None, "": None, "O=[N+]([O-])c1ccccc1": "C6NO2",
        "c1cc[nH]c1": "C4N", "[Na+].[Cl-]": "ClNa", "CCO.CCO": "C2O",
    }
    got = evaluated([(s,) for s in cases], "s string", f=fm.heavy_atom_formula(F.col("s")))
    assert [g["f"] for g in got] == list(cases.values())


def test_largest_fragment_keeps_only_the_largest(evaluated):
    got = evaluated([("CC.CN1C=NC=C1",), ("((.CCO",)], "s string", f=fm.largest_fragment_formula(F.col("s")))
    assert [g["f"] for g in got] == ["C4N2", "C2O"]


def test_formula_maps(evaluated):
    got = evaluated(
        [("C9H8O4", "C8H8O4N"), ("CHC2", "C")], "a string, b string",
        last=fm.parse_formula(F.col("a")), total=fm.atom_total(F.col("a")),
        note=fm.formula_delta_note(F.col("a"), F.col("b")), hill=fm.hill_formula(fm.parse_formula(F.col("b"))),
    )
    assert got[0]["last"] == {"C": 9, "H": 8, "O": 4} and got[0]["total"] == 21
    assert got[0]["note"] == "C 1 fewer, N 1 more" and got[0]["hill"] == "C8H8NO4"
    assert got[1]["last"] == {"C": 2, "H": 1} and got[1]["total"] == 4


def test_marks_and_nonsense(evaluated):
    got = evaluated(
        [("*C*", "C8", "C9"), ("C.C.C.C", "C8", "C40"), ("C.C.C", "C15", "C40"), (None, None, "C50")], "s string, r string, f string",
        m=fm.unreadable_marks(F.col("s")), n=fm.nonsense_size(F.col("r"), F.col("f")),
    )
    assert [g["m"] for g in got] == ["wildcards:2", "fragments:4", None, None]
    assert [g["n"] for g in got] == [False, True, False, None]
