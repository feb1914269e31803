from hashlib import sha256

from newsloom.sources.digest import changed, file_digests, folder_digests


def plain(folder):
    """Digest, files and bytes of every folder below, by a walk."""
    out = {}

    def walk(at, path):
        lines, files, size = [], 0, 0
        for x in sorted(at.iterdir(), key=lambda x: x.name):
            if x.name[0] in "_." or (x.is_file() and not x.stat().st_size):  # no rows for a scan
                continue
            if x.is_dir():
                d, n, s = walk(x, f"{path}/{x.name}" if path else x.name)
                kind = "folder"
            else:
                d, n, s, kind = sha256(x.read_bytes()).hexdigest(), 1, x.stat().st_size, "file"
            if n:
                lines.append(f"{kind} {x.name} {d}")
                files, size = files + n, size + s
        d = sha256("\n".join(lines).encode()).hexdigest()
        if files:
            out[path] = (d, files, size)
        return d, files, size

    walk(folder, "")
    return out


def test_equals_a_plain_walk_and_tells_what_changed(spark, tmp_path):
    top = tmp_path / "run"
    for name, body in {"a.txt": b"1", "b/c.bin": bytes(range(256)) * 100, "b/d/e": b"", "b/d/f": b"x", "g/h/i/j": b"deep", "_SUCCESS": b"", "b/.c.crc": b"no"}.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(body)
    files = file_digests(spark, f"file://{top}")
    first = folder_digests(files)
    assert {r["path"]: (r["digest"], r["files"], r["bytes"]) for r in first.collect()} == plain(top)
    before = spark.createDataFrame(first.collect(), first.schema)
    (top / "b/d/f").write_bytes(b"y")
    (top / "k").mkdir()
    (top / "k/l").write_bytes(b"new")
    again = folder_digests(file_digests(spark, f"file://{top}"))
    got = {r["path"]: r["change"] for r in changed(before, again).collect()}
    assert got == {"": "changed", "b": "changed", "b/d": "changed", "g": "same", "g/h": "same", "g/h/i": "same", "k": "added"}
    moved = spark.createDataFrame([("x/1", 1, "d1"), ("x/2", 1, "d2")], "path string, bytes long, digest string"), spark.createDataFrame([("x/9", 1, "d1"), ("x/8", 1, "d2")], "path string, bytes long, digest string")
    assert len({tuple(sorted((r["path"], r["digest"]) for r in folder_digests(m, names=False).collect())) for m in moved}) == 1
    assert folder_digests(moved[0].limit(0)).count() == 0
