"""Contents by ranges: entropy and digests equal those of whole contents; a large file needs little memory."""

import hashlib
import os
import random
import subprocess
import sys

from pyspark.sql import functions as F

from triagelake.operators import casebook, entropy
from triagelake.sources import contents

SIZES = [0, 100, 511, 512, 70_000, 131_072, 131_073, 700_000]


def test_equal_to_whole_contents(spark, tmp_path):
    draw = random.Random(6)
    rows = []
    for i, n in enumerate(SIZES):
        data = bytes(draw.choice(b"abcd") for _ in range(n // 2)) + draw.randbytes(n - n // 2)
        (tmp_path / f"f {i}").write_bytes(data)
        rows.append((i, f"{'file://' if i % 3 == 0 else ''}{tmp_path}/f {i}".replace("file://" + str(tmp_path) + "/f ", "file://" + str(tmp_path) + "/f%20"), data))
    files = spark.createDataFrame(rows, "id int, uri string, content binary")
    whole = {r["id"]: r["h"] for r in entropy.max_entropy(files.select("id", "content"), ["id"]).collect()}
    got = {r["id"]: r for r in contents.sampled_entropy(files, ["id"]).collect()}
    assert len(got) == len(SIZES) and all(r["error"] is None and r["size"] == SIZES[i] for i, r in got.items())
    for i, r in got.items():
        assert (r["h"] is None) == (i not in whole) and (i not in whole or abs(r["h"] - whole[i]) < 1e-9)
    sums = {r["id"]: r for r in contents.digests(files, ["id"]).collect()}
    for i, _, data in rows:
        assert (sums[i]["md5"], sums[i]["sha1"], sums[i]["sha256"]) == tuple(hashlib.new(a, data).hexdigest() for a in ("md5", "sha1", "sha256"))


def test_missing_files_and_integrity(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"one")
    (tmp_path / "b").write_bytes(b"two")
    files = spark.createDataFrame([("a", f"{tmp_path}/a"), ("b", f"{tmp_path}/b"), ("c", f"{tmp_path}/none"), ("d", None)], "path string, uri string")
    got = {r["path"]: r for r in contents.digests(files, ["path"], algorithms=("sha256",)).collect()}
    assert got["c"]["error"].startswith("FileNotFoundError") and got["d"]["error"] == "no address" and got["c"]["sha256"] is None
    known = spark.createDataFrame([(p, "sha256", hashlib.sha256(x).hexdigest()) for p, x in (("a", b"one"), ("b", b"other"), ("c", b"x"))], "path string, algorithm string, value string")
    status = {r["path"]: r["status"] for r in casebook.verify_sources(known, casebook.file_hashes(files)).collect()}
    assert len(status) == 3 and status["a"] != status["b"] != status["c"] != status["a"]


def test_three_gigabytes_in_little_memory(tmp_path):
    path = f"{tmp_path}/large"
    with open(path, "wb") as f:
        f.write(os.urandom(1 << 16))
        f.truncate(3 << 30)
    code = (
        "import sys; from triagelake.sources import contents as c; peak = lambda: int(next(x for x in open('/proc/self/status') if x.startswith('VmHWM')).split()[1]);"
        "c.open_file(sys.argv[1]).close(); a = peak(); s = c.sampled(sys.argv[1], 65536, 512); d = c.digested(sys.argv[1], ('sha1',)); b = peak();"
        "print(s['size'], round(s['h']), d['size'], b // 1024, (b - a) // 1024)"
    )
    out = subprocess.run([sys.executable, "-c", code, path], capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(__file__))})
    size, h, read, peak, more = map(int, out.stdout.split())
    assert (size, h, read) == (3 << 30, 8, 3 << 30) and more < 20 and peak < 300


def test_burst_entropy_from_files(spark, tmp_path):
    """The encryption verdict with contents that are only addresses."""
    for i in range(30):
        (tmp_path / f"d{i}.zzq").write_bytes(os.urandom(4096) if i % 2 else b"a" * 4096)
    rows = [("h", i, f"d{i}.zzq", "/x/", 4096, False, False) for i in range(30)]
    files = spark.createDataFrame(rows, "host_id string, id long, name string, parent_path string, size long, is_directory boolean, is_deleted boolean")
    from triagelake.tables import CaseTables, conform

    t = CaseTables(spark, {"files": conform(files, "files")})
    where = files.select("host_id", "id", F.concat(F.lit(f"{tmp_path}/"), "name").alias("uri"))
    stats = entropy.sample_burst_files(t, where).collect()
    assert [(r["ext"], r["sampled"], r["high"]) for r in stats] == [("zzq", 30, 15)]
