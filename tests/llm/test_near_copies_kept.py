"""Different texts that share an id or have none all stay; of near copies without ids one does."""

from pairmill.llm import neardup


def test_only_near_copies_go(spark):
    words = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    rows = [(None, words("a"), "x"), (None, words("b"), "x"), (None, words("b") + " more", "x"), (None, "", "x"), (None, None, "x")]
    rows += [(5, words("c"), "x"), (5, words("d"), "x"), (5, words("d"), "y"), (6, words("d") + " more", "x"), (7, words("a") + " more", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r["doc_id"] or 0, r["text"] or "", r["source"]) for r in neardup.deduplicated(docs).collect()))
    b = [t for i, t, _ in got if t.startswith("b")]
    assert len(b) == 1  # a near copy without an id goes too
    assert [x for x in got if x[1] != b[0]] == [(0, "", "x"), (0, "", "x"), (5, words("c"), "x"), (5, words("d"), "x"), (7, words("a") + " more", "x")]
