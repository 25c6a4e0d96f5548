"""A folder of stored files against what is declared of them."""

import hashlib

from clauseloom.sources import files

DECLARED = "object_key string, size_bytes long, sha256 string"


def folder(tmp_path):
    contents = {
        "tenants/t/a/v1/original": b"sound", "tenants/t/b/v1/original": b"truncat", "tenants/t/c/v1/original": b"Altered!", "tenants/t/d/v1/original": b"x" * 5000,
        "tenants/u/e/v1/original": b"", "tenants/u/nobody/v1/original": b"?", "tenants/u/g v/1 \u00e9": b"named oddly",
    }
    for key, content in contents.items():
        (tmp_path / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / key).write_bytes(content)
    sound = lambda content: (len(content), hashlib.sha256(content).hexdigest())
    return [
        ("tenants/t/a/v1/original", *sound(b"sound")), ("tenants/t/b/v1/original", *sound(b"truncated")), ("tenants/t/c/v1/original", *sound(b"altered!")),
        ("tenants/t/d/v1/original", *sound(b"x" * 5000)), ("tenants/u/e/v1/original", *sound(b"")), ("tenants/u/gone/v1/original", *sound(b"gone")),
        ("tenants/u/g v/1 \u00e9", *sound(b"named oddly")), (None, 1, "x"),
    ]


def test_every_file_is_judged(spark, tmp_path):
    declared = spark.createDataFrame(folder(tmp_path), DECLARED)
    got = {r.object_key: r.reject_reason for r in files.check_stored(spark, str(tmp_path), declared, limit=1000).collect()}
    assert got == {
        "tenants/t/a/v1/original": None, "tenants/t/b/v1/original": files.FILE_SIZE, "tenants/t/c/v1/original": files.FILE_DIGEST, "tenants/t/d/v1/original": files.FILE_TOO_LARGE,
        "tenants/u/e/v1/original": files.FILE_MISSING, "tenants/u/gone/v1/original": files.FILE_MISSING, "tenants/u/nobody/v1/original": files.FILE_UNKNOWN,
        "tenants/u/g v/1 \u00e9": None, None: files.FILE_MISSING,
    }


def test_sound_contents_are_loaded(spark, tmp_path):
    declared = spark.createDataFrame(folder(tmp_path), DECLARED)
    sound, rejects = files.load_stored(spark, str(tmp_path), declared, limit=1000)
    assert {r.object_key: bytes(r.content) for r in sound.collect()} == {"tenants/t/a/v1/original": b"sound", "tenants/u/g v/1 \u00e9": b"named oddly"}
    assert rejects.count() == 7


def test_contents_beyond_the_limit_are_not_read(spark, tmp_path):
    declared = spark.createDataFrame(folder(tmp_path), DECLARED)
    plan = files.check_stored(spark, str(tmp_path), declared, limit=1000)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,1000)" in plan and "ReadSchema: struct<path:string,length:bigint>" in plan
