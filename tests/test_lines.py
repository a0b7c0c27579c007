"""Strict line readers: exact line numbers over splits and compressed files, verdicts on whole files, digests of bytes."""

import gzip
import hashlib
import json

from pyspark.sql import functions as F

from civicfeed.sources import lines


def test_numbers_over_many_splits(spark, tmp_path):
    texts = {f"f{k}.txt": [f"{k}:{i}" + "x" * (i * 7 % 90) for i in range(900 + 37 * k)] for k in range(3)}
    for name, rows in texts.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    with gzip.open(tmp_path / "z.txt.gz", "wt") as f:
        f.write("\n".join(texts["f1.txt"]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = lines.numbered_lines(spark, str(tmp_path)).withColumn("file", F.element_at(F.split("file", "/"), -1))
        assert got.rdd.getNumPartitions() > 3
        found = {(r.file, r.line): r.value for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {(n, i): t for n, rows in {**texts, "z.txt.gz": texts["f1.txt"]}.items() for i, t in enumerate(rows, 1)}


def address(**changes):
    row = {"address_text": "Москва, улица Мира, д. 5", "latitude": 55.7, "longitude": 37.6, "postal_code": "101000", "is_private": None}
    return json.dumps(row | changes, ensure_ascii=False)


def test_one_bad_line_rejects_its_file(spark, tmp_path):
    files = {
        "good.jsonl": [address(), address(), address(address_text=" Москва, улица Мира, д. 7 ", street="проспект Мира")],
        "json.jsonl": [address(), "{oops", "[1]"],
        "range.jsonl": [address(address_text="a"), address(latitude=91), address(longitude="x"), address(postal_code="12"), address(address_text=" "), address(is_private="yes")],
        "clash.jsonl": [address(), address(postal_code=None)],
        "empty.jsonl": [],
    }
    for name, rows in files.items():
        (tmp_path / name).write_text("\n".join(rows))
    with gzip.open(tmp_path / "packed.jsonl.gz", "wt") as f:
        f.write(address() + "\n" + address(house="1" * 65))
    rows, errors = lines.address_files(spark, str(tmp_path))
    short = F.element_at(F.split("file", "/"), -1).alias("file")
    assert sorted((r.file, r.line, r.error) for r in errors.select(short, "line", "error").collect()) == [
        ("clash.jsonl", 2, "other data for the same address_text"),
        ("empty.jsonl", 0, "no rows"),
        ("json.jsonl", 2, "not a JSON object of the schema"),
        ("json.jsonl", 3, "not a JSON object of the schema"),
        ("packed.jsonl.gz", 2, "house"),
        *[("range.jsonl", i, e) for i, e in ((2, "latitude"), (3, "longitude"), (4, "postal_code"), (5, "address_text"), (6, "not a JSON object of the schema"))],
    ]
    kept = sorted((r.file, r.address_text, r.street, r.house) for r in rows.select(short, "address_text", "street", "house").collect())
    assert [k[0] for k in kept] == ["good.jsonl"] * 2
    assert kept[1][1] == "Москва, улица Мира, д. 7" and kept[1][2] == "проспект Мира" and kept[1][3] == "7"


def test_time_examples(spark, tmp_path):
    row = lambda **c: json.dumps({"text": "завтра", "reference": "2024-01-05T10:00:00Z"} | c)
    (tmp_path / "a.jsonl").write_text("\n\n".join([row(), row(active_from="2024-01-06T00:00:00+03:00", active_to="")]))
    (tmp_path / "b.jsonl").write_text("\n".join(["", row(), row(text=" "), row(active_from="2024-01-07", active_to="2024-01-06"), row(reference="soon")]))
    rows, errors = lines.time_examples(spark, str(tmp_path))
    assert sorted((r.line, r.error) for r in errors.collect()) == [(3, "text"), (4, "active_from after active_to"), (5, "reference")]
    assert sorted((r.line, str(r.active_from)) for r in rows.withColumn("active_from", F.col("active_from").cast("string")).collect()) == [(1, "None"), (3, "2024-01-05 21:00:00")]


def test_manifest_of_bytes(spark, tmp_path):
    for name, data in (("b.bin", b"two"), ("a.bin", b"\x00one")):
        (tmp_path / name).write_bytes(data)
    got = lines.file_manifest(spark, str(tmp_path))
    digest = {n: hashlib.sha256(d).hexdigest() for n, d in (("a.bin", b"\x00one"), ("b.bin", b"two"))}
    assert {r.name: (r.bytes, r.sha256) for r in got.collect()} == {"a.bin": (4, digest["a.bin"]), "b.bin": (3, digest["b.bin"])}
    whole = lines.combined_digest(got).first()
    assert (whole.files, whole.bytes) == (2, 7) and whole.digest == hashlib.sha256("\n".join(f"{n} {digest[n]}" for n in sorted(digest)).encode()).hexdigest()
