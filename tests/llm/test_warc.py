import base64
import gzip
import hashlib
import os

import pytest
from helpers import rng

from sparkloom.llm import warc as W

PAGE = "page_id long, url string, html string"


def pages(spark, n=300):
    r = rng(8)
    rows = [(i, f"http://x.example/{i}?q=é \r\nHost: y", r.choice(["<p>same</p>", None, "", "<p>ü \r\n\r\n WARC/1.1</p>"]) if i % 3 == 0 else "<p>" + "x" * r.randint(0, 3000) + str(i) + "</p>") for i in range(n)]
    return rows + [(None, None, "<p>same</p>"), (7, "u", "<p>same</p>"), (7, "u", "<p>same</p>")]


def expected(rows):
    top = {}
    for k, _, h in rows:
        h = h or ""
        top[h] = max(top.get(h, -1), -1 if k is None else k)
    out = []
    for k, _, h in rows:
        h = h or ""
        revisit = (-1 if k is None else k) < top[h]
        raw = h.encode()
        out.append((k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top[h] if revisit else None))
    return sorted(out, key=str)


def test_round_trip_rolling_and_determinism(spark, tmp_path):
    rows = pages(spark)
    contents = []
    for k, parts in enumerate((3, 11)):
        path = f"file://{tmp_path}/w{k}"
        files = W.write_archive(spark.createDataFrame(rows, PAGE).repartition(parts), path, roll_bytes=2000, min_shards=5).collect()
        back = W.read_archive(spark, path, payloads=True).collect()
        assert sorted(((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back), key=str) == expected(rows)
        texts = {(i, hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows}
        for r in back:
            assert (r["payload"] is None) == (r["record_type"] == "revisit")
            if r["payload"] is not None:
                assert (r["key"], hashlib.sha1(bytes(r["payload"])).hexdigest()) in texts
        folder = f"{tmp_path}/w{k}/archive"
        names = sorted(x for x in os.listdir(folder) if x.endswith(".gz"))
        assert names == sorted(f["name"] for f in files) and len({n.split("-")[1] for n in names}) >= 4 and len(names) > 10
        assert not os.path.exists(f"{tmp_path}/w{k}/_temporary") and not os.path.exists(f"{tmp_path}/w{k}/_manifest")
        contents.append({n: open(f"{folder}/{n}", "rb").read() for n in names})
    assert contents[0] == contents[1]
    keys = []
    for n in names:
        plain = gzip.decompress(contents[0][n]).decode()
        keys.append([int(x.split("\r\n")[0]) for x in plain.split("X-Record-Key: ")[1:]])
    assert [k for x in keys for k in x] == sorted(k for x in keys for k in x)


def test_small_payloads_are_all_responses(spark, tmp_path):
    rows = [(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbbbb"), (4, "u", "bbbbbb")]
    W.write_archive(spark.createDataFrame(rows, PAGE), f"file://{tmp_path}/s", min_revisit_bytes=4)
    assert {r["key"]: r["record_type"] for r in W.read_archive(spark, f"file://{tmp_path}/s").collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty_table_extra_columns_and_damage(spark, tmp_path):
    df = spark.createDataFrame(pages(spark, 30), PAGE).selectExpr("*", "1 AS key", "'x' AS digest", "2 AS len", "3 AS shard")
    W.write_archive(df.limit(0), f"file://{tmp_path}/e")
    assert W.read_archive(spark, f"file://{tmp_path}/e").count() == 0
    W.write_archive(df, f"file://{tmp_path}/d", min_shards=1)
    name = next(x for x in sorted(os.listdir(f"{tmp_path}/d/archive")) if x.endswith(".gz"))
    plain = gzip.decompress(open(f"{tmp_path}/d/archive/{name}", "rb").read())
    for bad in (plain[:-3], plain.replace(b"xxx", b"xyx", 1)):
        open(f"{tmp_path}/d/archive/{name}", "wb").write(gzip.compress(bad))
        (crc := f"{tmp_path}/d/archive/.{name}.crc") and os.path.exists(crc) and os.remove(crc)
        with pytest.raises(Exception, match="ends within|digest"):
            W.read_archive(spark, f"file://{tmp_path}/d").collect()
