from parallax.plans import pipelines as PL


def test_both_directions_read_the_staged_rows(spark):
    """The result is made of written rows: nothing of the joins before is planned once for each direction."""
    rows = [(i, f"The cat number{i % 3} sat", f"a Cat lay {'down ' * (i % 4)}") for i in range(40)] + [(40, None, "x"), (40, "x y", "")]
    bitext = spark.createDataFrame(rows, "line_no long, a string, b string")
    casing = spark.createDataFrame([("see the cat cat",), ("a cat Sat",)], "text string")
    out = PL.prepare_training(bitext, casing, 5, "formal", "informal")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.collect()
    assert len(got) == 2 * len(rows)
    plain = {(r.part, r.line_no, r.src.replace("@@ ", "").split(" ", 1)[1]) for r in got if r.line_no < 40}
    assert plain == {(1, i, f"the cat number{i % 3} Sat") for i in range(40)} | {(2, i, " ".join(["a cat lay", *["down"] * (i % 4)])) for i in range(40)}
