import pytest

from signalbase.__main__ import arguments, main
from signalbase.sources.store import load_json, read_store
from tests.test_incremental import NEWS, drop


def test_build_update_and_job(spark, tmp_path):
    drop(tmp_path, "2026-06-01", ("One", "body"), ("Two", "body"))
    (tmp_path / "taxonomy.json").write_text('{"version": "v7", "leaves": []}')
    store, source = f"{tmp_path}/store", ["--source", f"{NEWS.name}={tmp_path}"]
    built = main(spark, ["build", store, *source, "--taxonomy", f"{tmp_path}/taxonomy.json", "--keep", "2"])
    assert "v7" in built.values() and read_store(spark, store).count() == 2
    assert main(spark, ["update", store, *source])["months"] == []
    drop(tmp_path, "2026-07-01", ("Three", "body"))
    job = main(spark, ["job", store, f"{tmp_path}/job", "--limit", "5"])
    assert job["taxonomy_version"] == "v7" and job["target_unclassified"] == 5 and job["created_at"] in built.values()
    assert load_json(spark, f"{tmp_path}/job", None) == job
    assert main(spark, ["update", store, *source])["months"] == ["2026-07"]
    assert read_store(spark, store).count() == 3


def test_bad_arguments(spark, tmp_path):
    for argv in ([], ["build", "s"], ["build", "s", "--source", "nobody=x"], ["build", "s", "--source", NEWS.name]):
        with pytest.raises(SystemExit):
            arguments(argv)
    with pytest.raises(SystemExit):
        main(spark, ["job", f"{tmp_path}/none", f"{tmp_path}/job"])
