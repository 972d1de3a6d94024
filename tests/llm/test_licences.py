from __future__ import annotations

from curatrix.llm import licences as L


def test_templates_and_planted_lines(spark):
    model = L.classifier()
    for family, texts in L.TEMPLATES.items():
        for t in texts:
            found = model.scan(t)
            assert found and found[0] == family, t
    for t in L.NONE:
        assert model.scan(t) is None, t
    for t in ["Distributed under the terms of the Foo Public License.", "Licensed under a custom license agreement."]:
        assert model.scan(t)[0] == "unknown"
    rows = [(i, f"Some text here.\n{t}\nmore of the same") for i, t in enumerate(x for ts in L.TEMPLATES.values() for x in ts)]
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "no licence at all, only words"), (903, "All rights reserved.\nReleased under the MIT License."), (None, "x " * 5000 + "\nLicensed under the BSD License.")]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS hits")).collect()
    for r in got:
        want = [(i, f[0]) for i, line in enumerate((r.text or "").split("\n")) if (f := model.scan(line))]
        assert [(h.line, h.family) for h in r.hits] == want
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
