"""Passes of the line stage over texts: none splits a text once for each of its lines, and lines are found again by row and number."""

from strandline.llm.line_dedup import dedup_lines


def test_no_text_is_split_above_the_join(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, "a\nc")], "doc_id long, text string")
    plan = dedup_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "split(" not in plan.split("Join")[0]


def test_lines_of_rows_that_share_an_id_and_odd_blank_lines(spark):
    near, other = "one two three four five six", "one two three four five seven"
    rows = [(1, f"{near}\n \t\x0b\f\r\n "), (1, f"quite unlike all of the others\n{near}"), (1, f"quite unlike all of the others\n{near}"), (2, f"{other}\n \t\x0b\f\r\n \n"), (3, None), (4, "")]
    got = sorted(((r.doc_id, r.text, r._removed) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = [rows[0] + (None,), (1, "quite unlike all of the others", [1]), (1, "quite unlike all of the others", [1]), (2, " \t\x0b\f\r\n", [0, 2]), (3, None, None), (4, "", None)]
    assert got == sorted(want, key=str)
