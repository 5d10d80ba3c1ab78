"""Whole licence texts are found as such, with other names and small edits in them, and by more than their first sentence."""

from pairmill.llm import licenses
from pairmill.llm.licence_texts import TEXTS


def test_whole_texts(spark):
    rows = [(n, f"Copyright 2020 Some One\n\n{text}\n\nint main() {{}}") for n, (_, _, text) in enumerate(TEXTS)]
    edited = [w for w in TEXTS[0][2].split()]
    edited[5] = edited[90] = edited[120] = "changed"
    rows += [(100, " ".join(edited)), (101, TEXTS[0][2][:300]), (102, "nothing of the kind")]
    rows += [(103, " ".join(w if i % 3 else "x" for i, w in enumerate(TEXTS[2][2].split())))]  # a third of the words are others
    got = {r["doc_id"]: r["places"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = {t.label: [] for t in licenses.WHOLE}
    for n, (label, _, text) in enumerate(TEXTS):
        size = len(licenses.WHOLE[n].words)
        mine = [p for p in got[n] if p["label"] == label and p["size"] == size]
        assert mine and mine[0]["matched"] == size, label
        whole[label].append(size)
    near = [p for p in got[100] if p["size"] == len(licenses.WHOLE[0].words)]
    assert near and near[0]["matched"] == near[0]["size"] - 3
    assert all(p["size"] < 100 for p in got[101]) and got[102] == [] and not [p for p in got[103] if p["size"] > 100]
