from veilscan import config


def test_sizes():
    assert [config.parse_size(t) for t in ("12", "1KB", "2 mb", "3G", "5XB", "x")] == [12, 1024, 2 << 20, 3 << 30, 5, 0]
    assert [config.size_text(n) for n in (0, 1023, 1536, 1 << 20, 1234567890)] == ["0 B", "1,023 B", "1.50 KB", "1 MB", "1.14 GB"]


def test_settings(tmp_path):
    path = str(tmp_path / "c.json")
    config.Settings(max_file_size=5, concurrency=900).used("a").used("b").used("a").save(path)
    s = config.Settings.load(path)
    assert (s.max_file_size, s.concurrency, s.recent) == (1024, 64, ["a", "b"])
    (tmp_path / "c.json").write_text("{broken")
    assert config.Settings.load(path) == config.Settings() == config.Settings.load(str(tmp_path / "none"))


def test_ignored_findings(spark, tmp_path):
    path = str(tmp_path / "i.json")
    config.IgnoreState(path).ignore_file("a").ignore_finding("b", 3, "bic")
    state = config.IgnoreState(path)
    f = spark.createDataFrame([("a", 1, "x"), ("b", 3, "bic"), ("b", 4, "bic"), (None, 3, "bic")], "file_path string, line_number int, pattern_type string")
    assert state.counts() == (1, 1)
    assert sorted(map(str, (r["file_path"] for r in state.applied(spark, f).collect()))) == ["None", "b"]
    state.ignore_finding("b", 9, "bic")
    assert state.restore_finding("b", 9, "bic").counts() == (1, 1) and state.restore_finding("b", 8, "bic").counts() == (1, 1)
    assert state.restore("b").counts() == (1, 0) and state.clear().counts() == (0, 0)
    assert state.applied(spark, f).count() == 4


def test_selected_files(spark):
    f = spark.createDataFrame([("a", 2, "x", "low", "m", 1.0), ("a", 1, "x", "low", "m", 1.0), ("b", 1, "x", "low", "m", 1.0)], "file_path string, line_number int, pattern_type string, severity string, matched_text string, risk_score double")
    rows = config.selected(f, ["a"]).collect()
    assert len(rows) == 1 and [r["line_number"] for r in rows[0]["findings"]] == [1, 2]


def test_document_findings(spark):
    from pyspark.sql import functions as F

    from veilscan.operators import image

    schema = "id int, p string, final_score double, is_document boolean, document_type string, confidence string, mrz_names string, page int"
    j = spark.createDataFrame([(1, "/d/page-7.png", 85.0, True, "passport", "Высокая", None, 7), (2, "/d/x.png", 10.0, False, "id_card", "Нет", None, 1), (3, "/d/y.png", 70.0, True, "passport", "Высокая", "ERIKSSON ANNA", 1)], schema)
    r = image.document_findings(j, "id", F.col("p")).orderBy("id").collect()
    assert len(r) == 2 and (r[0]["line_number"], r[0]["severity"], r[0]["description"], r[0]["risk_level"], len(r[0]["warnings"]), len(r[0]["data_found"])) == (1, "critical", "Паспорт обнаружен", "critical", 3, 4)
    assert r[0]["context"] == "Изображение документа (confidence: Высокая)" and (r[1]["description"], r[1]["context"]) == ("Паспорт с MRZ обнаружен", "MRZ: ERIKSSON ANNA")
    pages = image.document_findings(j, "id", F.col("p"), F.col("page")).orderBy("id").collect()
    assert (pages[0]["line_number"], pages[0]["description"], pages[0]["context"]) == (7, "Паспорт обнаружен в PDF", "PDF страница 7 (confidence: Высокая)")
