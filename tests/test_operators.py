import re

import pytest
from pyspark.sql import functions as F

from veilscan.operators import documents, ignore, image, mrz, stats


def ignored(spark, rules, paths):
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    return [r[0] for r in df.select(rules.column(F.col("p"))).collect()]


def test_default_ignores(spark):
    paths = ["/project/node_modules/package", "/project/file.log", "/project/.env.local", "/project/src/main.go", None]
    assert ignored(spark, ignore.IgnoreRules.default(), paths) == [True, True, True, False, None]


def test_rule_file_and_enabling(spark):
    r = ignore.IgnoreRules.parse("# note\n/tmp\n*.e\nsrc/**/x?.py\nnode_modules\n\n*.test.js")
    assert (r.dirs, r.files, r.extensions, r.globs) == ({"tmp"}, {"node_modules"}, {".e", ".test.js"}, ["src/**/x?.py"])
    assert ignored(spark, r, ["/tmp/a", "a.E", "src/q/xy.py", "/node_modules/a", "/q/node_modules", "a.test.js"]) == [True, True, True, False, True, False]
    assert ignore.IgnoreRules().empty() and ".pdf" not in ignore.IgnoreRules.default().enable("documents").extensions


@pytest.mark.parametrize(("glob", "text", "hit"), [("*.go", "main.go", True), ("*.go", "a/main.go", False), ("**/x", "a/b/x", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("a.b+", "a.b+", True), ("a.b", "axb", False)])
def test_globs(glob, text, hit):
    assert bool(re.search(ignore.glob_to_regex(glob), text)) is hit


FINDINGS = "file_path string, line_number int, pattern_type string, severity string, description string, risk_score double, finding_id long"


def findings(spark):
    rows = [
        ("a", 1, "password", "critical", "Password assignment detected", 90.0, 1), ("a", 2, "Pass-port", " HIGH", "x", 70.0, 2), ("b", 3, "bic", "medium", None, float("nan"), 3),
        (None, None, None, None, None, None, 4), ("b", 3, "bic", "medium", None, 10.0, 5), ("c", 9, "iban", "high", "y", 69.0, 6),
    ]
    return stats.cleaned(spark.createDataFrame(rows, FINDINGS))


def test_summaries(spark):
    f = findings(spark)
    s = stats.report_summary(f).first()
    assert (s["total_findings"], s["critical_findings"], s["high_findings"], s["average_risk_score"], s["highest_risk_score"]) == (6, 1, 2, 59.75, 90.0)
    files = {r["file_path"]: r for r in stats.per_file(f).collect()}
    assert files["a"]["max_severity"] == "critical" and files[None]["max_severity"] == "low" and files["b"]["medium"] == 2
    assert [r["file_path"] for r in stats.most_affected_files(f, 2).collect()] == ["a", "b"]
    assert [r["finding_id"] for r in stats.critical_findings(f).collect()] == [1, 2]
    assert [r["finding_id"] for r in ignore.unignored(f, f.where("file_path = 'a'"), f.where("finding_id = 6")).orderBy("finding_id").collect()] == [3, 4, 5]
    assert {r["file_path"] for r in stats.files_with_text(f, "PASS", "critical").collect()} == {"a"}


def test_empty_findings(spark):
    f = findings(spark).limit(0)
    s = stats.report_summary(f).first()
    assert s["total_findings"] == 0 and s["average_risk_score"] == 0
    assert stats.risk_assessment(f).first()["risk_level"] == "low" and stats.recommendations(f).count() == 0
    assert stats.per_file(f).count() == 0 and stats.critical_findings(f).count() == 0


@pytest.mark.parametrize(("critical", "high", "low", "level"), [(10, 0, 0, "critical"), (5, 10, 0, "critical"), (3, 0, 0, "high"), (0, 10, 0, "high"), (1, 0, 0, "medium"), (0, 5, 0, "medium"), (0, 1, 0, "moderate"), (0, 0, 10, "moderate"), (0, 0, 9, "low")])
def test_risk_levels(spark, critical, high, low, level):
    rows = [("critical",)] * critical + [("high",)] * high + [("low",)] * low
    f = spark.createDataFrame(rows, "severity string").withColumn("risk_score", F.lit(1.0))
    assert stats.risk_assessment(f).first()["risk_level"] == level


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Паспорт серия 45 12 номер 345678", {"passport"}), ("Водительское удостоверение номер 78 22 123456", {"driver_license", "passport"}), ("Führerschein Nummer: ABC123456", {"driver_license"}), ("СНИЛС: 123-456-789 01", {"id_card"}),
        ("Карта Visa: 4111 1111 1111 1111", {"credit_card"}), ("IBAN: DE89370400440532013000 Баланс", {"bank_statement"}), ("Полис ОМС: 1234567890123456", {"medical_record"}), ("nothing here", set()), ("", set()), (None, set()),
    ],
)
def test_document_types(spark, text, kinds):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert {r["document_type"] for r in documents.classify(df, "id", "text").collect()} >= kinds
    if not kinds:
        assert documents.classify(df, "id", "text").count() == 0


SPECIMEN = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"


def test_zone_of_the_specimen(spark):
    df = spark.createDataFrame([(1, "text\n" + SPECIMEN.lower().replace("<", "«")), (2, "no zone"), (3, None), (4, ""), (5, "V" + SPECIMEN[1:])], "id int, text string")
    rows = {r["id"]: r for r in mrz.parsed(df, "id", "text").collect()}
    r = rows[1]
    assert (r["mrz_type"], r["surname"], r["given_names"], r["document_number"], r["nationality"], r["sex"]) == ("TD3", "ERIKSSON", "ANNA MARIA", "L898902C3", "UTO", "F")
    assert all(r["check_digit_results"].values()) and r["is_valid"] and r["validation_score"] == 100.0
    assert set(rows) == {1, 5} and rows[5]["mrz_type"] == "MRVA" and not rows[5]["is_valid"]


def test_check_digits_and_found_lines(spark):
    df = spark.createDataFrame([("123456789", "7"), ("AB1234567", "0"), ("12é", "1"), ("1<<", "<")], "d string, c string")
    assert [r[0] for r in df.select(mrz.check_digit_fits(F.col("d"), F.col("c"))).collect()] == [True, False, False, False]
    t = spark.createDataFrame([(SPECIMEN,), ("plain",)], "t string").select(mrz.found_lines(F.col("t")).alias("z")).collect()
    assert SPECIMEN.split("\n")[0] in t[0]["z"] and t[1]["z"] == []


@pytest.mark.parametrize(("w", "h", "kind", "score"), [(700, 1000, "passport_page", 12.0), (158, 100, "passport_page", 12.0), (100, 100, None, 0.0), (1000, 100, None, 0.0), (78, 100, "passport_photo", 0.0), (None, 5, None, 0.0), (0, 5, None, 0.0)])
def test_geometry(spark, w, h, kind, score):
    r = spark.createDataFrame([(w, h)], "w int, h int").select(image.geometry(F.col("w"), F.col("h")).alias("g")).first()["g"]
    assert (r["document_type"], r["geometry_score"]) == (kind, score)


def test_image_signals(spark):
    rows = [(1, 1420, 1000, SPECIMEN + "\nsurname: X given name: Y\n15.03.1985 20.05.2015"), (2, 100, 100, None), (3, 1580, 1000, ""), (4, 300, 385, "passport")]
    got = {r["id"]: r for r in image.judged(spark.createDataFrame(rows, "id int, w int, h int, t string"), "id", "w", "h", "t").collect()}
    assert got[1]["is_document"] and got[1]["mrz_score"] == 70.0 and got[1]["structure_score"] == 20.0
    assert not got[2]["is_document"] and got[2]["keyword_score"] == 0 and got[3]["document_type"] == "passport_page"
    assert got[4]["document_type"] == "passport_photo" and got[4]["final_score"] == 0
