from cladeloom.llm import licenses


def test_own_and_inherited(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "r/LICENSE", mit), (2, "r/a/b/x.py", "code the of and"), (3, "r/a/LICENSE.txt", mit.replace("MIT", "xyz") + "\n" + apache), (4, "r/a/y.py", None), (5, "r/z.py", "x\nReleased under the ISC license"),
        (6, "q/z.py", ""), (7, None, apache), (8, None, None), (9, "top.py", "x"), (9, "top.py", "x"), (10, "r/ab/z", "All rights reserved. " + "word " * 50_000), (11, "rr/LICENSES/x", "y"), (12, "r/c/NOTLICENSE", mit), (13, "r/c/d", "z"),
    ]
    files = spark.createDataFrame([(*r, "o") for r in rows], "file_id long, path string, text string, own string")
    got = sorted((r["file_id"], r["license"] or "", r["origin"], r["from_path"] or "") for r in licenses.scan(files).collect())
    assert got == [
        (1, "MIT", "own", ""), (2, "Apache-2.0", "inherited", "r/a/LICENSE.txt"), (3, "Apache-2.0", "own", ""), (4, "Apache-2.0", "inherited", "r/a/LICENSE.txt"), (5, "ISC", "own", ""),
        (6, "", "none", ""), (7, "Apache-2.0", "own", ""), (8, "", "none", ""), (9, "", "none", ""), (9, "", "none", ""), (10, "Proprietary", "own", ""), (11, "", "none", ""), (12, "MIT", "own", ""), (13, "MIT", "inherited", "r/LICENSE"),
    ]
    assert licenses.scan(files.limit(0)).count() == 0


def test_similarity_by_hand(spark):
    m = licenses.Model()
    for name, text in licenses.TEMPLATES:
        for extra in ("", " zzz", " zzz qqq vvv www xxx yyy"):
            df = spark.createDataFrame([(text.rstrip(".") + extra,)], "text string")
            got = df.select(licenses.best_template(df["text"], m)["similarity"]).first()[0]
            i = m.names.index(name)
            own = m.norm[i] / (m.norm[i] ** 2 + len(extra.split()) * m.unknown) ** 0.5
            assert got is None and own < 0.65 or abs((got or 0) - own) < 0.25 and (got or 0) >= round(own, 6) - 1e-6, (name, got, own)
        break
