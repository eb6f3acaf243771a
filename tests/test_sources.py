import json
import zipfile

from grantlens.sources import bulk, records, web


def test_csv_by_name_quotes_and_short_rows(spark, tmp_path):
    a = tmp_path / "A_2000.csv"
    b = tmp_path / "A_2001.csv"
    a.write_text('APPLICATION_ID,ACTIVITY,FY,PI_NAMEs,PROJECT_TITLE,TOTAL_COST,CORE_PROJECT_NUM\n1,R01,2000,"A ""B"" (contact)","two\nlines",100,C1\nx,R01,bad,,t,,C2\n')
    b.write_text("FY,CORE_PROJECT_NUM,APPLICATION_ID,OPPORTUNITY NUMBER,TOTAL_COST\n2001,C1,2,PA-1,50\n2001,C3\n")
    rows = {r.core_project_num + str(r.application_id): r for r in bulk.read_awards(spark, [str(a), str(b)]).collect()}
    assert rows["C11"].project_title == "two\nlines" and rows["C11"].pi_names == 'A "B" (contact)'
    assert rows["C2None"].fiscal_year is None and rows["C12"].foa_number == "PA-1" and rows["C3None"].total_cost is None
    links = tmp_path / "L_C_2013.csv"
    links.write_text("PMID,PROJECT_NUMBER\n1,C1\n1,C1\n,C1\n2,\n")
    assert [tuple(r) for r in bulk.read_publinks(spark, [str(links)]).collect()] == [("1", "C1", 2013)]
    bulk.build(spark, [str(a), str(b)], [str(links)], str(tmp_path / "store"))
    store = bulk.connect(spark, str(tmp_path / "store"))
    assert store["award_pi"].where("contact_pi_name = 'A \"B\"'").count() == 1


def frame(spark, *values):
    return spark.createDataFrame([(json.dumps(v),) for v in values], "json string")


def test_award_json(spark):
    raw = {"appl_id": 7, "project_num": "5R01", "agency_ic_admin": "CA", "principal_investigators": [{"profile_id": 1, "first_name": "A", "last_name": "B", "full_name": " "}], "terms": ["x", "y"], "full_study_section": {"name": "S"}}
    r = records.awards_from_json(frame(spark, raw, {}), "json").collect()
    assert r[0].ic == "CA" and r[0].principal_investigators[0].full_name == "A B" and r[0].terms == ["x", "y"] and r[0].study_section == "S"
    assert r[1].application_id is None and r[1].principal_investigators == []


def test_article_and_metric_json(spark):
    raw = {"uid": "1", "title": "A study.", "pubdate": "2020 Mar", "source": "J", "authors": [{"name": "X Y"}], "articleids": [{"idtype": "doi", "value": "10.1"}], "pubtype": ["Review"]}
    r = records.articles_from_json(frame(spark, raw), "json").first()
    assert (r.title, r.year, r.journal, r.doi, r.pmcid, r.authors) == ("A study", 2020, "J", "10.1", None, ["X Y"])
    m = records.metrics_from_json(frame(spark, {"pmid": 5, "is_clinical": "Yes", "cited_by_clin": [1, 2], "relative_citation_ratio": "1.5"}, {"year": 1}), "json").collect()
    assert len(m) == 1 and m[0].is_clinical and m[0].clinical_citers == ["1", "2"] and m[0].rcr == 1.5


def test_trial_json(spark):
    section = {
        "identificationModule": {"nctId": "N1", "officialTitle": "T", "secondaryIdInfos": [{"type": "NIH", "id": "5R01DK075877-03"}, {"type": "OTHER_GRANT", "id": "U.S. NIH Grant 5R18DK096394"}, {"type": "OTHER_GRANT", "id": "R01XX000001"}, {"type": "NIH", "id": "R01 DK 075877"}]},
        "statusModule": {"primaryCompletionDateStruct": {"date": "2021-09"}},
        "designModule": {"phases": ["PHASE1", "PHASE2"], "enrollmentInfo": {"count": 10}},
        "armsInterventionsModule": {"interventions": [{"type": "DRUG", "name": "Remdesivir"}, {"name": "Other"}]},
    }
    r = records.trials_from_json(frame(spark, {"protocolSection": section, "hasResults": True}), "json").first()
    assert (r.title, r.completion_date, r.phase, r.enrollment, r.has_results) == ("T", "2021-09", "PHASE1/PHASE2", 10, True)
    assert r.interventions == ["DRUG: Remdesivir", "Other"] and r.grants == ["R01DK075877", "R18DK096394"]


def test_labels_series_and_foa(spark):
    r = records.labels_from_json(frame(spark, {"openfda": {"brand_name": ["B"]}, "indications_and_usage": ["i" * 400]}), "json").first()
    assert r.brand_name == "B" and len(r.indication) == 300 and r.route is None
    series = spark.createDataFrame([("1999", "Cancer", "United States", "1,000", "25.0"), ("2000", "Cancer", "Ohio", "x", "")], "year string, cause_name string, state string, deaths string, aadr string")
    assert [tuple(r)[3:] for r in records.mortality(series, "Cancer").collect()] == [(1000, 25.0)]
    numbers = spark.createDataFrame([("RFA-1",), ("PA-2",), ("NOT-3",)], "foa_number string")
    hits = spark.createDataFrame([("RFA-1", 0, "other", "first", "A", "s"), ("RFA-1", 1, "rfa-1", "exact", "A", "s"), ("PA-2", 0, "zz", "only", "A", "s")], "foa_number string, pos int, number string, title string, agency string, status string")
    got = {r.foa_number: r for r in records.resolve_foa(numbers, hits).collect()}
    assert got["RFA-1"].title == "exact" and got["PA-2"].title == "only" and got["NOT-3"].derived


def test_assays(spark):
    df = spark.createDataFrame([("n",), ("n",), ("m",)], "assay string")
    assert [tuple(r) for r in records.assay_summary(df).orderBy("assay").collect()] == [("m", 1, 3, 2), ("n", 2, 3, 2)]


def test_client_keeps_answers_and_pages(tmp_path):
    calls = []

    def fetch(url, body):
        calls.append(url)
        ask = json.loads(body)
        rows = [{"id": i} for i in range(ask["offset"], min(7, ask["offset"] + ask["limit"]))]
        return json.dumps({"meta": {"total": 7}, "results": rows}).encode()

    client = web.CachedClient(tmp_path, fetch=fetch)
    rows, short = web.pages(client, "u", {"q": 1}, limit=5, page=3)
    assert [r["id"] for r in rows] == [0, 1, 2, 3, 4] and short
    n = len(calls)
    assert web.pages(client, "u", {"q": 1}, limit=5, page=3)[0] == rows and len(calls) == n
    assert web.in_batches(["2", "9", "1"], lambda ids: [{"k": i} for i in ids if i != "9"], "k", 2) == [{"k": "2"}, {"k": "1"}]


def test_retry():
    left = [ConnectionError(), ConnectionError()]

    def call():
        if left:
            raise left.pop()
        return 1

    assert web.with_retry(call, wait=0) == 1


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>FY</t></si><si><t>note</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2"><v>2001</v></c><c r="B2"><v>10</v></c><c r="C2"><v>3</v></c><c r="D2"><v>30</v></c></row><row><c r="A3" t="s"><v>1</v></c></row></sheetData></worksheet>')
    rows = [(r + [None] * 4)[:4] for r in web.workbook_rows(tmp_path / "w.xlsx")]
    got = records.success_rates(spark.createDataFrame(rows, "fy string, reviewed string, awarded string, rate string")).collect()
    assert [tuple(r) for r in got] == [(2001, 10, 3, 0.3)]


def test_yearly_files_have_addresses(tmp_path, monkeypatch):
    import zipfile

    import pytest

    from grantlens.sources import bulk

    asked = []

    def download(url, to, force=False, timeout=600):
        asked.append(url)
        with zipfile.ZipFile(to, "w") as z:
            z.writestr("rows.csv", "A")
        return to

    monkeypatch.setattr(bulk, "download", download)
    assert bulk.yearly("publinks", 2013, root=tmp_path).read_text() == "A"
    assert asked == ["https://reporter.nih.gov/exporter/linktables/download/2013"] and (tmp_path / "RePORTER_PUBLNK_C_2013.zip").exists()
    with pytest.raises(ValueError, match="kind"):
        bulk.yearly("else", 2013)
