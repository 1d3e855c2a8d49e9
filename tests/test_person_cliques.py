"""Names of one date that differ in one place make no pairs."""

from docuvet.operators import persons


def test_rows_grow_no_faster_than_the_records(spark, monkeypatch):
    written, stored = {}, persons._stored

    def counting(df, label):
        out = stored(df, label)
        written[label] = written.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(persons, "_stored", counting)
    n = 300
    rows = [(i, f"ANNA K{chr(0x4E00 + i)}", "1990-01-01", f"{chr(0x5000 + i)}") for i in range(n)] + [(n, "ANNA K", "1990-01-01", None), (n + 1, "ANNNA K", "1990-01-01", None)]
    got = persons.same_persons(spark.createDataFrame(rows, "case_id long, name string, dob string, doc_number string")).collect()
    links = {r["case_id"]: r["n_links"] for r in got}
    assert links == {**{i: n for i in range(n)}, n: n + 1, n + 1: 1}
    assert {r["person_id"] for r in got} == {0}
    assert max(written.values()) < 20 * n
