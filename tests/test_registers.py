from datetime import date
from decimal import Decimal

from worksight.functions import parsing as P
from worksight.sources import registers as S


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_contractor(spark):
    df = spark.createDataFrame([("012345 A. Rao 9876543210",), ("000000 B",), (" na ",), ("-",), (None,), ("C Ltd.",)], "x string")
    got = [tuple(r) for r in df.select(P.contractor(df.x), P.contractor_code(df.x)).collect()]
    assert got == [("A. Rao", "012345"), ("B", None), (None, None), (None, None), (None, None), ("C Ltd", None)]


def test_public_view_finds_its_header(spark, tmp_path):
    text = 'Report\nmade,today\nWard,Job Number,Name of Work,Contractor,BR Date,Gross\n"151, K",151-22-000004,"Road,\nfirst ""A"" part",012345 A. Rao 9876543210,26-Apr-2022,"1,234.50"\n151,bad,x,y,,\n151,151-22-000005\n,151-22-000006,,na,,\n'
    got = S.public_view(S.read_cells(spark, put(tmp_path / "a.csv", text))).orderBy("source_row").collect()
    assert [(r.source_row, r.job_number) for r in got] == [(1, "151-22-000004"), (4, "151-22-000006")]
    r = got[0]
    assert (r.description, r.ward, r.contractor, r.contractor_code, r.br_date, r.gross) == ('Road, first "A" part', "151", "A. Rao", "012345", date(2022, 4, 26), Decimal("1234.50"))
    assert got[1].contractor is None and got[1].ward_name == "" and got[1].gross is None


def test_work_details(spark, tmp_path):
    text = "﻿ID,WODetails,BRNumber,Amount,Ward No\n7,151-22-000004</a> Drain work,CBR-1/01-Jan-2020 BR-12/02-Feb-2020 Rtgs-9/03-Mar-2020,100,151\n8,no link,,1,\n"
    (r,) = S.work_details(S.read_cells(spark, put(tmp_path / "a.csv", text))).collect()
    assert (r.ifms_id, r.description, r.br_no, r.br_date, r.payment_ref, r.payment_date, r.ward) == ("7", "Drain work", "12", date(2020, 2, 2), "RTGS 9", date(2020, 3, 3), "151")


def test_lakh_and_wrapped_dates(spark, tmp_path):
    a = put(tmp_path / "a.csv", "Job_Code,RTGS_No,RTGS_Date,Gross_ Amount In Lakhs\n151-22-000004,5,01/02/2021,12.34\n")
    b = put(tmp_path / "b.csv", 'Job Code,BR,RTGS,Gross\n151-22-000004,"3/16-Oct-\n2018",,10\n')
    c = put(tmp_path / "c.csv", "Job_Code,Amount in Rs.,Date\n151-22-000004,5,01/02/2021\n151-22-000004,6,01/02/2021\n")
    bills, estimates = S.load_registers(spark, {"bill_register": a, "scheme_payments": b, "job_codes": c})
    got = {r.kind: r for r in bills.collect()}
    assert got["bill_register"].gross == Decimal("1234000.00") and got["bill_register"].payment_status == "Paid (RTGS)"
    assert got["scheme_payments"].br_date == date(2018, 10, 16) and got["scheme_payments"].ward == "151" and got["scheme_payments"].payment_ref is None
    assert [tuple(r) for r in estimates.collect()] == [("151-22-000004", Decimal("6.00"))]


def test_department_and_empty_file(spark, tmp_path):
    head = "Job Number,Work Order Details,Ward,Contractor,Work Order Number,Work Order Date,Total Amount in Rs,Deduction in Rs,Net Payment in Rs\n"
    cells = S.read_cells(spark, put(tmp_path / "a.csv", head + "151-22-000004,x,1,na,2,01-02-2015,10,1,9\n151-22-000005,x,1\n"))
    assert [(r.job_number, r.nett, r.wo_date) for r in S.department(cells).collect()] == [("151-22-000004", Decimal("9.00"), date(2015, 2, 1))]
    assert S.public_view(S.read_cells(spark, put(tmp_path / "e.csv", ""))).count() == 0


def test_columns_past_the_first_width_are_read(spark, tmp_path):
    from worksight.sources.registers import read_cells, with_header

    head = [f"h{i}" for i in range(69)] + ["Job Number", "last, one"]
    rows = [",".join(f'"{c}"' for c in head), ",".join([*(f"{i}" for i in range(69)), "151-20-000001", '"x, y"'])]
    (tmp_path / "wide.csv").write_text("preamble\n" + "\n".join(rows) + "\n")
    got = with_header(read_cells(spark, str(tmp_path / "wide.csv")), "Job Number").collect()
    assert len(got) == 1 and got[0].cells[69:71] == ["151-20-000001", "x, y"] and got[0].header[70] == "last, one"


def test_job_numbers_past_the_millionth(spark, tmp_path):
    a = put(tmp_path / "a.csv", "Job Number,Name of Work\n151-22-1000004,Road\n151-22-00004,Drain\n")
    c = put(tmp_path / "c.csv", "Job_Code,Amount in Rs.,Date\n151-22-1000004,5,01/02/2021\n151-22-100000,6,01/02/2021\n")
    bills, estimates = S.load_registers(spark, {"public_view": a, "job_codes": c})
    assert [r.job_number for r in bills.collect()] == ["151-22-1000004"]
    assert sorted((r.job_number, r.estimate) for r in estimates.collect()) == [("151-22-100000", 6), ("151-22-1000004", 5)]
