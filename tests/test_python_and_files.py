from folioflow.sources import files


def test_manifest_and_env(spark, tmp_path):
    m = tmp_path / "m.jsonl"
    m.write_text('# note\n\n{"sample_id": "a", "image_path": "x.png", "ground_truth": {"route": "invoice", "fields": {"k": "v"}}}\n{"image_path": ""}\n')
    rows = files.manifest(spark, str(m)).collect()
    assert [r.expected_route for r in rows] == ["invoice", "generic"] and rows[0].expected_fields == {"k": "v"}
    assert rows[0].error is None and rows[1].error
    e = tmp_path / "x.env"
    e.write_text("# c\nA='1 2'\nTOKEN=changeme\nbad\n")
    got = {r.key: (r.value, r.error) for r in files.env(spark, str(e)).collect()}
    assert got["A"] == ("1 2", None) and got["bad"][1]
    fails = {r.key: r.reason for r in files.preflight(files.env(spark, str(e)), ["A", "B"], ["TOKEN"]).collect()}
    assert fails == {"B": "missing", "TOKEN": "placeholder"}
