"""Path algebra against small models in plain Python, over generated paths."""

import itertools
import posixpath
import random

import pytest
from pyspark.sql import functions as F

from twinfold.functions import paths

rnd = random.Random(17)
SAMPLES = [".", *sorted({"/".join(rnd.choice(["k", "kk", "m", "n.x"]) for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "/"]) for _ in range(16)}), "m/.git/n/.git/k", ".svn/k"]
RAW = ["", *sorted({"/".join(rnd.choice(["k", "m", ".", "..", "", "..k", "m.", "q:"]) for _ in range(rnd.randint(1, 5))) for _ in range(120)})]


def up(p):
    """Directories that hold p, itself included if it is one."""
    out, at = ["."], ""
    for name in p.split("/")[:-1]:
        at += name + "/"
        out.append(at)
    return out if p != "." else ["."]


def cleaned(p):
    """By the library's own normaliser, with the rules for what is no path and what is a directory."""
    if not p or p.startswith("/"):
        return ""
    out = posixpath.normpath(p)
    if out == ".." or out.startswith("../") or out[1:2] == ":":
        return ""
    last = p.rsplit("/", 1)[-1]
    return out if out == "." or last not in ("", ".", "..") else out + "/"


def key(p):
    names = [] if p == "." else p.rstrip("/").split("/")
    return [(int(i == len(names) - 1 and not p.endswith("/")), n) for i, n in enumerate(names)]


def test_clean(spark):
    rows = spark.createDataFrame([(p,) for p in RAW], "p string").select("p", paths.clean_path("p").alias("got")).collect()
    # A second byte of ":" is refused before or after cleaning.
    assert [(r.p, r.got) for r in rows if r.p[1:2] != ":"] == [(r.p, cleaned(r.p)) for r in rows if r.p[1:2] != ":"]


def test_readings(spark):
    r = spark.createDataFrame([("k/m",), ("k/m/",), (".",), ("../q",)], "p string").select(paths.either_path("p").alias("e"), paths.strict_file_path("p").alias("s")).collect()
    assert [(x.e.dir, x.e.file, x.s) for x in r] == [("k/m/", "k/m", "k/m"), ("k/m/", "k/m", None), (".", None, None), (None, None, None)]


def test_order(spark):
    pairs = [(a, b) for a, b in itertools.product(SAMPLES, SAMPLES) if a != b]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", (paths.path_key("a") < paths.path_key("b")).alias("less")).collect()
    assert all(r.less == (key(r.a) < key(r.b)) for r in rows)


@pytest.mark.parametrize("skip", [False, True])
def test_steps(spark, skip):
    def steps(p, seen):
        if p == ".":
            return []
        own = [x for x in up(p) if x != "."] + ([] if p.endswith("/") else [p])
        inside = seen is not None and seen.endswith("/") and p.startswith(seen)
        return [x for x in own if not (inside and seen.startswith(x))]

    cases = list(itertools.product(SAMPLES, SAMPLES[1:] if skip else [None]))
    df = spark.createDataFrame(cases, "p string, skip string")
    rows = df.select("p", "skip", (paths.steps("p", F.col("skip")) if skip else paths.steps("p")).alias("got")).collect()
    assert [(r.p, r.skip, r.got) for r in rows] == [(r.p, r.skip, steps(r.p, r.skip)) for r in rows]


def test_pairs(spark):
    df = spark.createDataFrame(list(itertools.product(SAMPLES, SAMPLES)), "a string, b string")
    out = df.select("a", "b", paths.contains("a", "b").alias("contains"), paths.common_root("a", "b").alias("root"), paths.dist("a", "b").alias("dist"))
    for r in out.collect():
        is_dir = r.a == "." or r.a.endswith("/")
        assert r.contains == (r.a == "." or is_dir and (r.b == r.a or r.b.startswith(r.a))), r
        shared = [x for x, y in zip(up(r.a), up(r.b)) if x == y]
        assert r.root == shared[-1], r
        assert r.dist == r.a.count("/") + r.b.count("/") - 2 * (0 if r.root == "." else r.root.count("/")), r


def test_single(spark):
    out = spark.createDataFrame([(p,) for p in SAMPLES], "p string").select("p", paths.parent("p").alias("up"), paths.base("p").alias("base"), paths.atom("p").alias("atom"), paths.is_dir("p").alias("d"), paths.is_file("p").alias("f"), paths.ancestors("p").alias("anc"), paths.proper_ancestors("p").alias("proper"))
    for r in out.collect():
        assert r.d == (r.p == "." or r.p.endswith("/")) and r.f != r.d
        assert r.anc == up(r.p) and r.proper == [x for x in r.anc if x != r.p]
        if r.p != ".":
            assert r.up == ([x for x in up(r.p) if x != r.p])[-1] and r.base == r.p.rstrip("/").split("/")[-1]
        assert r.atom == {"m/.git/n/.git/k": "m/.git/", ".svn/k": ".svn/"}.get(r.p)


def test_order_is_total(spark):
    assert [r.p for r in spark.createDataFrame([(p,) for p in SAMPLES], "p string").orderBy(paths.path_key("p")).collect()] == sorted(SAMPLES, key=key)
