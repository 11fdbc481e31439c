"""Flags, statistics, duplicates, rescans, marks, index files, tree source and progress."""

import os
import random

import pytest
from pyspark.sql import functions as F

from twinfold.functions import flags
from twinfold.functions.blake3 import Blake3, blake3, blake3_many
from twinfold.functions.storage import checkpoint
from twinfold.operators import dups, hashing, mark, rescan, tree
from twinfold.plans.model import FILES, violations
from twinfold.sources import codec, index, walk
from twinfold.streaming import progress


def files(spark, rows):
    """rows: (path, digest) with optional flag, size, mod_ns."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else 1, r[4] if len(r) > 4 else 0, r[2] if len(r) > 2 else 0) for r in rows]
    return spark.createDataFrame(full, FILES)


def test_flags(spark):
    table = [("", 0), ("D", 1), ("J", 2), ("K", 3), ("DX", 5), ("JX", 6), ("KX", 7), ("X", None), ("XX", None), ("DXX", None)]
    rows = spark.createDataFrame(table, "t string, f int").select("t", "f", flags.parse_flag("t").alias("p"), flags.flag_text("f").alias("back"), flags.is_safe("f").alias("safe"), flags.is_stored("f").alias("stored")).collect()
    for r in rows:
        assert r.p == r.f
        if r.f is not None:
            assert r.back == r.t and r.safe == (r.f in (0, 3)) and r.stored == (r.f != 4)
    assert spark.range(1).select(flags.is_stored(F.lit(4)), flags.flag_text(F.lit(17))).first() == (False, "D")


def test_dups(spark):
    """A keep decision rules a directory out, and what is gone is no copy."""
    rows = [("one/p", "x"), ("one/q", "y"), ("one/r", "z"), ("two/p2", "x"), ("two/q2", "y"), ("two/r2", "z", 4), ("three", "w")]
    found = lambda f: {r.dir: (r.alts, [x.path for x in r.lost or []]) for r in dups.dups(f, max_lost=1).collect()}
    assert found(files(spark, rows)) == {"one/": (["two/"], ["one/r"]), "two/": (["one/"], [])}
    assert found(files(spark, [(p, d, 3 if p == "one/q" else f[0] if f else 0) for p, d, *f in rows])) == {"two/": (["one/"], [])}


def random_tree(seed, n=40):
    rnd = random.Random(seed)
    names = ["u", "v", ".git"]
    return [("".join(rnd.choice(names) + "/" for _ in range(rnd.randint(0, 3))) + f"f{i}", str(rnd.randint(0, 12)), rnd.choice([0, 0, 0, 0, 1, 3, 4])) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_dir_stats(spark, seed):
    rows = random_tree(seed)
    f = files(spark, rows)
    live = [(p, g) for p, g, h in rows if not h & 4]
    dirs = {p[: i + 1] for p, _ in live for i, c in enumerate(p) if c == "/"} | {"."}
    under = lambda d, x: d == "." or x.startswith(d)
    atom = lambda d: next((d[: i + 1] for i, c in enumerate(d) if c == "/" and d[:i].split("/")[-1] == ".git"), None)
    want = {(d, sum(x != d and x != "." and under(d, x) for x in dirs), sum(under(d, p) for p, _ in live), len({g for p, g in live if under(d, p)}), atom(d)) for d in dirs}
    assert {tuple(r) for r in tree.dir_stats(f).select("dir", "total_dirs", "total_files", "unique_files", "atom").collect()} == want
    assert {r.dir for r in tree.unique_dirs(f).collect()} == dirs
    assert tree.find_file(f, live[0][0]).count() == 1 and tree.find_dir(f, "u/").first().total_files == sum(under("u/", p) for p, _ in live)
    assert tree.dir_stats(files(spark, [("a", "1", 4)])).count() == 0 and tree.to_index(f).count() == len(rows)


def merged(old, listing):
    """The merged state by looking every row up."""
    seen, out, known = {(p, n, t) for p, n, t in listing}, [], set()
    for p, n, t, f in old:
        f &= 15
        if not f & 4 and (p, n, t) in seen:
            known.add((p, n, t))
            out.append((p, n, t, f | 16))
        elif f & 3:
            out.append((p, n, t, f | 4))
    return sorted(out + [(p, n, t, 0) for p, n, t in seen - known])


@pytest.mark.parametrize("seed", range(3))
def test_rescan(spark, seed):
    """Several scans in a row of a tree in which files change, vanish and return."""
    rnd = random.Random(seed)
    names = [f"dir{i % 3}/file{i}" for i in range(12)]
    old = []
    for _ in range(3):
        listing = [(p, rnd.randint(1, 2), rnd.randint(1, 2)) for p in names if rnd.random() < 0.7]
        before = spark.createDataFrame([(p, f"d{n}", n, t, f) for p, n, t, f in old], FILES)
        now = spark.createDataFrame([(p, f"d{n}", n, t) for p, n, t in listing], "path string, digest string, size bigint, mod_ns bigint")
        got = sorted((r.path, r.size, r.mod_ns, r.flag) for r in rescan.rescan(before, now).collect())
        assert got == merged(old, listing)
        old = [(p, n, t, f if f & 7 else rnd.randint(0, 3)) for p, n, t, f in got]


def test_mark(spark):
    f = files(spark, [("a1", "1"), ("a10", "2"), ("d/x", "3", 1), ("d/y", "4"), ("d/z", "5", 4)])
    assert {r.path: r.flag for r in mark.mark_keep(f, ["a10", "d"]).collect()} == {"a1": 0, "a10": 3, "d/x": 1, "d/y": 3, "d/z": 4}
    with pytest.raises(FileNotFoundError, match="nothing"):
        mark.mark_dup(f, ["a1", "nothing"])


def naive(rows, max_lost):
    """Verdicts by looking at every file of every directory."""
    out = {}
    dirs = {p[: i + 1] for p, _, f in rows if not f & 4 for i, c in enumerate(p) if c == "/"} | {"."}
    for d in dirs:
        under = [(p, g, f) for p, g, f in rows if not f & 4 and (d == "." or p.startswith(d))]
        safe = {g for _, g, _ in under if any(q == g and h & 15 in (0, 3) and not (d == "." or p.startswith(d)) for p, q, h in rows)}
        lost = {g for _, g, _ in under} - safe
        keep = any(f & 3 == 3 for _, _, f in under)
        out[d] = not keep and len(lost) <= max_lost and len(safe) > len(lost) ** 2 and d != "." and not any(x != d and x.endswith(".git/") and d.startswith(x) for x in dirs)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_verdicts_of_random_trees(spark, seed):
    rows = random_tree(seed)
    got = {r.dir: r.is_dup for r in dups.verdicts(files(spark, rows), 2).collect()}
    assert got == naive(rows, 2)


def test_cover_takes_copies_outside_only(spark):
    rows = [(f"P/D/f{i}", str(i)) for i in range(1, 7)] + [(f"P/g{i}", str(i)) for i in range(2, 7)] + [("Q/f1", "1")] + [(f"Q/o{i}", f"o{i}") for i in range(100)]
    f = files(spark, rows)
    found = dups.maximal(f, "P/", 0)
    assert [r.dir for r in found.collect()] == ["P/D/"]
    assert {r.alt for r in dups.alternates(f, found).collect()} == {"P/", "Q/"}
    assert {(r.path, r.kept_path) for r in dups.file_map(f, found).collect()} == {("P/D/f1", "Q/f1")} | {(f"P/D/f{i}", f"P/g{i}") for i in range(2, 7)}
    assert [(r.path, r.kept_path) for r in dups.file_map(f, found, alt="Q").collect()] == [("P/D/f1", "Q/f1")]
    assert dups.file_map(f, found, alt="none").isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_candidates_of_random_trees(spark, seed):
    """Candidates by looking at every copy of every file under a duplicate."""
    rows = random_tree(seed, 60)
    f = files(spark, rows)
    found = checkpoint(dups.maximal(f, max_lost=2))
    ups = lambda p: {"."} | {p[: i + 1] for i, c in enumerate(p) if c == "/"}
    want = set()
    for d in (r.dir for r in found.collect()):
        for digest in {g for p, g, h in rows if p.startswith(d) and not h & 4}:
            for own in {p[: p.rfind("/") + 1] for p, g, h in rows if g == digest and h & 15 in (0, 3) and not p.startswith(d)}:
                atom = min((x for x in ups(own) if x.endswith(".git/")), key=len, default=own)
                want |= {(d, up, digest) for up in ups(atom)}
    assert {(r.dir, r.alt, r.digest) for r in dups.candidates(f, found).collect()} == want


# Published digests of the hash function.
@pytest.mark.parametrize(
    ("data", "want"),
    [
        (b"\x00", "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"),
        (b"\x00\x01", "7b7015bb92cf0b318037702a6cdd81dee41224f734684c2c122cd6359cb1ee63"),
        (b"\x00\x01\x02", "e1be4d7a8ab5560aa4199eea339849ba8e293d55ca0a81006726d184519e647f"),
        (bytes(i % 251 for i in range(31744)), "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47"),
    ],
)
def test_blake3(data, want):
    assert blake3(data).hex() == want


def test_blake3_of_pieces_and_of_many(monkeypatch):
    """Contents in parts, in pieces and side by side have the digests that they have at once."""
    rnd = random.Random(5)
    contents = [rnd.randbytes(n) for n in (0, 1, 64, 1023, 1024, 1025, 2048, 2049, 4096, 5000, 8192, 12289, 16384, 20000)]
    want = [blake3(c) for c in contents]
    assert blake3_many(contents) == want
    monkeypatch.setattr("twinfold.functions.blake3.PART", 2048)
    assert blake3_many(contents) == want
    for c, w in zip(contents, want):
        state = Blake3()
        while c:
            n = rnd.randint(1, 3000)
            state.update(c[:n])
            c = c[n:]
        assert state.digest() == w


# The format of an index, which other readers must understand.
GOLDEN = "".join(
    line + "\n"
    for line in (
        "K\td1/a\t//" + "\t" * 11 + "2009-11-10T23:00:00Z", "\td2/a", "\ta", "\t\t01" + "0" * 62 + "\t1", "\tb\t//" + "\t" * 11 + "2009-11-11T23:00:01Z", "\t\t02" + "0" * 62 + "\t2",
        "\tc\t//" + "\t" * 11 + "2009-11-10T23:00:00Z", "D\td\t\t//", "DX\te \t\t//" + "\t" * 10 + "2009-11-11T23:00:01Z", "\tf", "\t\t03" + "0" * 62 + "\t3",
    )
)
A, B = 1257894000 * 10**9, 1257980401 * 10**9
INDEX = [("d1/a", 1, A, 3), ("d2/a", 1, A, 0), ("a", 1, A, 0), ("b", 2, B, 0), ("gone1", 2, B, 4), ("gone2", 2, B, 4), ("c", 3, A, 0), ("d\t", 3, A, 1), ("e \t", 3, B, 5), ("f", 3, B, 0)]


def test_index(spark, tmp_path):
    f = spark.createDataFrame([(p, f"0{n}" + "0" * 62, n, t, g) for p, n, t, g in INDEX], FILES)
    body = "".join(r.line + "\n" for r in codec.index_lines(f).orderBy("gkey", "n").collect())
    assert body == GOLDEN
    name = str(tmp_path / "x.idx")
    codec.write_index(f, name, "/")
    codec.write_index(f, name, "/")
    assert os.path.exists(name + ".bak")
    root, back = codec.read_index(spark, name)
    assert root == "/" and sorted((r.path, r.size, r.mod_ns, r.flag) for r in back.collect()) == sorted(x for x in INDEX if x[3] != 4)
    assert codec.cat(spark, name).count() == 2 + GOLDEN.count("\n")


@pytest.mark.parametrize(
    ("body", "error"),
    [
        (["K\ta"], "missing mtime"), (["Z\ta\t//\t2009-11-10T23:00:00Z"], "invalid flag"), (["\t/a\t//\t2009-11-10T23:00:00Z"], "invalid entry"), (["\ta\t//\tnow"], "invalid mtime"),
        (["\t\t" + "0" * 64 + "\t1"], "missing group"), (["\ta\t//\t2009-11-10T23:00:00Z", "\t\t00\t1"], "invalid digest"), (["\ta\t//\t2009-11-10T23:00:00Z", "\t\t" + "0" * 64 + "\t-1"], "invalid size"),
        (["\ta\t//\t2009-11-10T23:00:00Z"], "incomplete group"),
    ],
)
def test_index_errors(spark, body, error):
    df = spark.createDataFrame([("x", i + 2, line) for i, line in enumerate(body)], "file string, pos bigint, line string")
    assert any(error in (r.error or "") for r in codec.parse(df).collect())


def test_tree_source(spark, tmp_path):
    for name, data in (("a/x", b"\x00"), ("a/.hidden", b""), ("b", b"\x00\x01\x02"), ("c/d/e", b"1")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    os.symlink("b", tmp_path / "link")
    found, errors = walk.scan(spark, str(tmp_path))
    got = {r.path: (r.digest, r.size) for r in found.collect()}
    assert got == {n: (blake3(d or n.encode()).hex(), len(d)) for n, d in (("a/x", b"\x00"), ("a/.hidden", b""), ("b", b"\x00\x01\x02"), ("c/d/e", b"1"))}
    assert [(r.path, r.error) for r in errors.collect()] == [("link", "not a regular file")]
    (tmp_path / "b").write_bytes(b"new")
    again = rescan.rescan(found.withColumn("flag", F.lit(1)), walk.walk(spark, str(tmp_path)).where("error is null").select("path", "size", "mod_ns"), walk.rehash(str(tmp_path)))
    assert len(got) + 1 >= again.count() >= len(got)
    out = hashing.hash_files(spark, [str(tmp_path / "b"), str(tmp_path / "none"), str(tmp_path / "b")]).collect()
    assert [r.error is None for r in out] == [True, False, True] and out[0].line == f"{blake3(b'new').hex().upper()}  {tmp_path}/b"
    assert hashing.compare(spark.createDataFrame(out).where("error is null")).first().identical


def test_files_that_change_are_errors(spark, tmp_path):
    for name in ("same", "grows", "goes", "decided"):
        (tmp_path / name).write_text(name)
    listing = checkpoint(walk.walk(spark, str(tmp_path)))
    old = spark.createDataFrame([("decided", "d", 1, 1, 3)], FILES)
    (tmp_path / "grows").write_text("longer than before")
    (tmp_path / "goes").unlink()
    (tmp_path / "decided").unlink()
    merged, errors = rescan.rescan_checked(old, listing, walk.rehash(str(tmp_path)))
    assert {(r.path, r.flag) for r in merged.collect()} == {("same", 0), ("decided", 7)}
    assert {r.path: r.error for r in errors.collect()} == {"grows": "file changed while it was read", "goes": "No such file or directory", "decided": "No such file or directory"}


def test_tree_is_dealt_to_tasks(tmp_path):
    """A root with one folder gives many tasks, a wide one no more than were asked for, and each file is read once."""
    for i in range(40):
        (tmp_path / f"top/d{i % 8}/e").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"top/d{i % 8}/e/f{i}").write_bytes(b"x" * i)
    for tasks in (1, 5, 8, 100):
        reader = walk.TreeReader({"path": str(tmp_path), "digest": "true", "tasks": str(tasks)})
        parts = reader.partitions()
        assert min(tasks, 8) <= len(parts) <= tasks
        rows = [r for p in parts for r in reader.read(p)]
        assert sorted(r[0] for r in rows) == sorted(f"top/d{i % 8}/e/f{i}" for i in range(40))
        assert all(r[4] == blake3(b"x" * r[1] or r[0].encode()).hex() for r in rows)


def test_saved_index(spark, tmp_path):
    """Create, keep, update: decisions outlive a rescan, errors come back, and what can't be done saves nothing."""
    root, name = tmp_path / "root", str(tmp_path / "x.idx")
    (root / "d").mkdir(parents=True)
    for n in ("a", "d/b", "d/c"):
        (root / n).write_text(n)
    os.symlink("a", root / "link")
    assert [r.path for r in index.create(spark, name, f"{root}/").collect()] == ["link"]
    index.keep(spark, name, ["d"])
    (root / "d/b").unlink()
    (root / "new").write_text("new")
    assert [(r.path, r.error) for r in index.update(spark, name).collect()] == [("link", "not a regular file")]
    saved, found = codec.read_index(spark, name)
    want = {("a", 0), ("d/b", 7), ("d/c", 3), ("new", 0)}
    assert saved == str(root) and {(r.path, r.flag) for r in found.collect()} == want
    for call in (lambda: index.keep(spark, name, ["d", "none"]), lambda: index.update(spark, name, str(tmp_path / "none"))):
        with pytest.raises(FileNotFoundError):
            call()
    assert {(r.path, r.flag) for r in codec.read_index(spark, name)[1].collect()} == want


def test_progress(spark):
    df = spark.createDataFrame([(1, 1.0, 1, 128), (1, 1.2, 1, 1000), (1, 2.0, 0, 24)], "scan int, t double, files bigint, bytes bigint")
    p = progress.line(progress.ewma(df, ["scan"])).first()
    assert p.line == f"Indexed 2 files (1.1 KiB) in 2s [1 files/sec, {0.9 * 128 + 0.1 * 1024:.0f} B/sec]"
    zero = spark.createDataFrame([(0, 0, 0, 0.0, 0.0)], "files bigint, bytes bigint, seconds bigint, fps double, bps double")
    assert progress.line(zero).first().line == "Indexed 0 files (0 B) in 0s [0 files/sec, 0 B/sec]"


def test_violations(spark):
    good = files(spark, [("a/b", "0" * 64)])
    assert violations(good).count() == 0
    bad = files(spark, [("a", "0" * 64), ("a/b", "1" * 64, 0, 2), ("a/b", "1" * 64, 0, 3), ("../x", "zz", 0, -1)])
    assert {r.rule for r in violations(bad).collect()} == {"file and directory", "path exists twice", "one digest, several sizes", "path", "digest", "size"}
