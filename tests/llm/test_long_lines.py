"""Lines longer than a block of word sums: one edit at any place is found, two are not."""

from strandline.llm.line_dedup import dedup_lines


def test_one_edit_anywhere_in_a_long_line(spark):
    rows, expected, n = [], {}, 0
    for at in (0, 1, 63, 64, 65, 127, 128, 149):
        base = [f"w{at}x{i}" for i in range(150)]
        edited = {
            "base": base,
            "replaced": base[:at] + ["new"] + base[at + 1 :],
            "deleted": base[:at] + base[at + 1 :],
            "inserted": base[:at] + ["new", *base[at:]],
            "twice": ["other", *base[:40], *base[41:99], "last", *base[99:]],
        }
        for kind, words in edited.items():
            rows.append((n, " ".join(words)))
            expected[n] = kind not in ("base", "twice")
            n += 1
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r._removed == [0] for r in out.collect()} == expected
