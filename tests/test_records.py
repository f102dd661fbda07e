from lodestone.sources import tables


def test_damaged_lines_are_rejects(spark, tmp_path):
    good = ['{"id": 1, "note": "x"}', '{"id": 2}', '{"note": null, "id": null, "more": [1]}', "{}"]
    bad = ['{"id": 3, "note": "to', '{"id": "three"}', "[1, 2]", "plain text", "7"]
    (tmp_path / "lines.txt").write_text("\n".join([*good, "", "  ", *bad]) + "\n")
    records, rejects = tables.split_records(spark, str(tmp_path / "lines.txt"), "id long, note string")
    assert records.columns == ["id", "note"]
    assert sorted(map(tuple, records.collect()), key=str) == sorted([(1, "x"), (2, None), (None, None), (None, None)], key=str)
    assert sorted(r.line for r in rejects.collect()) == sorted(bad)
