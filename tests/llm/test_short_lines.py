"""The pipeline's line stage: one edit in lines of 5 to 9 words and in lines without spaces."""

import corpus_pipeline


def test_one_edit_in_short_and_unspaced_lines(spark):
    gone = {
        "Anat with reen of nteres atre are.": "Anat with by of nteres atre are.",
        "five words make this linear": "five words make this line",
        "one more word makes six words": "one more word makes words",
        "seven short words stand in this line": "seven short words stand here in this line",
        "今日はとても天気がいいので公園へ行きます": "今日はとても天気がいいので学園へ行きます",
        "วันนี้อากาศดีมากเราจะไปเที่ยว": "วันนี้อากาศดีมากเราจะไปเที่ยวส",
    }
    stay = [
        "two edits in this small line", "two changes in this short line", "extraordinary four-word line here",
        "extraordinary four-word line there", "http://example.org/page/1", "http://example.org/page/2",
        "今日はとても天気がいいので公園で待ちました", "一 二 三 四 五 六 七 八 九", "一二三四五六七八九十一二三四五六七",
    ]
    rows = [(i, "\n".join(["the first line of this document " + str(i) * 3 + " " + "x" * i, line])) for i, line in enumerate([*gone.values(), *stay])]
    rows += [(100 + i, f"unlike {i} all others {'y' * i} in any place at all\n{line}") for i, line in enumerate(gone)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text.split("\n")[-1] for r in corpus_pipeline.lines(spark, df, "").collect()}
    for i, line in enumerate([*gone.values(), *stay]):
        assert kept[i] == line
    for i, line in enumerate(gone):
        assert kept.get(100 + i) != line, line
